"""SentencePiece encoding and decoding that keeps the source alignment of every piece.

Normalisation walks the model's compiled character map (a Darts double array over UTF-8 prefixes) and
records, for each byte it emits, the source byte it came from. Pieces of the normalised text are then
projected to spans of original bytes. Segmentation uses the sentencepiece library on pre-tokens: no piece
of the vocabulary holds the space mark or a line feed after another character, so a text may be cut before
each run of marks and before each line feed without changing any merge.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vacantia.llm._util import column, slices

MARK = "▁"
_MARK = MARK.encode()
_PARTS = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*").findall
#: Distinct pre-tokens that a worker remembers before it drops the rarer ones.
CACHE = 450_000


class CharsMap:
    """Longest-prefix replacement by a compiled character map; an empty map copies its input."""

    def __init__(self, blob: bytes) -> None:
        self.units: tuple[int, ...] = ()
        self.targets = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.targets = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length of the longest key at ``data[at:]`` and where its replacement starts; (0, 0) if none."""
        units, best = self.units, (0, 0)
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return best

    def steps(self, data: bytes) -> Iterator[tuple[bytes, int, int]]:
        """(replacement, source start, source end) for each step over ``data``."""
        at = 0
        while at < len(data):
            length, target = self.longest(data, at) if self.units else (0, 0)
            if length:
                new = self.targets[target : self.targets.index(b"\0", target)]
            else:
                lead = data[at]
                length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at : at + length]
            yield new, at, at + length
            at += length


class Pieces:
    """A sentencepiece model with alignment, over a model file that the caller names."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        spec = proto.normalizer_spec
        self.map = CharsMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.eos = self.sp.eos_id()
        self.alone = [self.sp.piece_to_id(MARK)]  # the library gives an empty text no mark
        kinds = [(p.piece, p.type) for p in proto.pieces]
        #: a byte piece stands for one byte of source, others for their own bytes
        self.width = np.array([1 if t == 6 else 0 if t == 3 else len(p.encode()) for p, t in kinds], np.int32)
        free = [p for p, t in kinds if t in (1, 4)]
        self.cuts = not any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p in free) and not any(t == 4 for _, t in kinds)
        # word-wise encoding also needs the library to leave the words alone
        self.fast = self.cuts and not self.map.units and self.dummy and not self.squeeze and not proto.trainer_spec.treat_whitespace_as_suffix
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Keep the pre-tokens seen most often, a third of what fits."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE // 3])
        names = list(self.known)
        self.known = {names[k]: j for j, k in enumerate(keep.tolist())}
        counts = self.count[keep]
        ends = np.cumsum(counts)
        self.flat = self.flat[np.repeat(self.start[keep] - (ends - counts), counts) + np.arange(int(counts.sum()))]
        self.start, self.count, self.uses = ends - counts, counts, np.zeros(len(keep), np.int64)

    # -- normalisation

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised UTF-8 and, for each of its bytes plus the end, the source byte it stems from."""
        data = text.encode()
        out, origin = bytearray(), []
        pending = 0 if self.squeeze else None  # squeezing drops leading marks, folds runs and drops trailing ones
        end = 0
        for new, start, stop in self.map.steps(data):
            new = new.replace(b" ", _MARK)
            i = 0
            while i < len(new):
                step = 3 if new.startswith(_MARK, i) else 1
                if step == 3 and self.squeeze and (not out or out.endswith(_MARK)):
                    i += 3
                    continue
                out += new[i : i + step]
                origin += [start] * step
                end = stop
                i += step
        if pending is not None:
            while out.endswith(_MARK):
                del out[-3:], origin[-3:]
                end = origin[-1] + 1 if origin else 0
        if self.dummy and out:
            first = origin[0]
            out[:0], origin[:0] = _MARK, [first] * 3
        origin.append(len(data) if not self.squeeze else end)
        return bytes(out), np.array(origin, np.int64)

    # -- encoding

    def _learn(self, words: list[str]) -> None:
        """Encode pre-tokens: each begins with the mark, a line feed, or both are absent only for the first."""
        forms = [w[1:].replace(MARK, " ") if w[0] == MARK else w for w in words]
        ids = self.sp.encode(forms, num_threads=1)
        # after the library's own leading mark a line feed comes out as it does in the middle of a text
        ids = [self.alone if w == MARK else x if w[0] == MARK else x[1:] for w, x in zip(words, ids, strict=True)]
        base = len(self.flat)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        for w in words:
            self.known[w] = len(self.known)
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))))
        self.start = np.concatenate((self.start, base + np.cumsum(lengths) - lengths))
        self.count = np.concatenate((self.count, lengths))
        self.uses = np.concatenate((self.uses, np.zeros(len(ids), np.int64)))

    @staticmethod
    def _pretokens(text: str) -> list[str]:
        """Parts of the marked text: a cut before each line feed and before each run of marks."""
        return _PARTS((MARK + text).replace(" ", MARK)) if text else []

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and offsets of the texts in them."""
        if not self.fast:
            ids = [x + [self.eos] for x in self.sp.encode(texts, num_threads=1)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
            return np.array([i for x in ids for i in x], np.int32), offsets
        if len(self.known) > CACHE:
            self._shrink()
        parts = [self._pretokens(t) for t in texts]
        new = set().union(*parts).difference(self.known)
        if new:
            self._learn(list(new))
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        self.uses += np.bincount(number, minlength=len(self.uses))
        counts = self.count[number]
        per_text = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        ends = np.concatenate(([0], np.cumsum(counts)))
        total = int(ends[-1])
        where = np.repeat(self.start[number] - ends[:-1], counts) + np.arange(total)
        ids = self.flat[where]
        stops = ends[per_text[1:]]
        ids = np.insert(ids, stops, self.eos)
        return ids, np.concatenate(([0], stops + np.arange(1, len(texts) + 1)))

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece in the source bytes."""
        width = self.width[ids].astype(np.int64)
        unknown = np.flatnonzero(ids == self.sp.unk_id())
        plain = not self.map.units and not self.squeeze and not len(unknown)
        if plain and MARK not in text:
            data = np.frombuffer(text.encode(), np.uint8)
            origin = np.concatenate(([0] * 3, np.repeat(np.arange(len(data)), np.where(data == 32, 3, 1)), [len(data)])) if len(data) and self.dummy else np.concatenate((np.repeat(np.arange(len(data)), np.where(data == 32, 3, 1)), [len(data)]))
        else:
            normal, origin = self.normalize(text)
            if len(unknown):
                surfaces = self.sp.encode(text, out_type=str)
                width[: len(surfaces)] = [len(s.encode()) if i == self.sp.unk_id() else w for s, i, w in zip(surfaces, ids, width[: len(surfaces)], strict=True)]
        ends = np.minimum(np.cumsum(width), len(origin) - 1)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return origin[starts], origin[ends]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


_LOADED: dict[str, Pieces] = {}


def loaded(model_file: str) -> Pieces:
    """One model for each worker process."""
    if model_file not in _LOADED:
        _LOADED[model_file] = Pieces(model_file)
    return _LOADED[model_file]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """Per row: id, ``ids`` with the end id, and if asked ``begins`` and ``ends`` in bytes of the source.

    A null text counts as empty and gives the end id alone. ``model_file`` must be readable on every
    executor (installed with the library's vocabulary files).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", begins array<int>, ends array<int>" * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(model_file)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = ["" if t is None else t for t in column(part, "text").to_pylist()]
                ids, offsets = model.encode_batch(texts)
                offs = pa.array(offsets, pa.int32())
                cols = [column(part, "id"), pa.ListArray.from_arrays(offs, pa.array(ids, pa.int32()))]
                if spans:
                    found = [model.spans(t, ids[a:b]) for t, a, b in zip(texts, offsets, offsets[1:], strict=False)]
                    cols += [pa.ListArray.from_arrays(offs, pa.array(np.concatenate([f[k] for f in found]) if found else [], pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "begins", "ends"][: len(cols)])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, ids array<int>{extra}").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the ``text`` that the library's decode gives for the ids (null ids: empty)."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [model.decode(x or []) for x in column(part, "ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trips(docs: DataFrame, model_file: str, summarise: Callable[[list[int], np.ndarray, np.ndarray, str], tuple], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and what ``summarise(ids, begins, ends, decoded)`` returns, columns as in ``schema``.

    Encoding, spans and decoding of a text happen in one pass, so no array of ids leaves the worker. Null counts as
    empty (the end id alone); texts of any length are encoded whole; rows that repeat get equal results, null ids are
    kept, other columns are ignored, an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(model_file)
        names = [f.split()[0] for f in schema.split(",")]
        for batch in batches:
            for part in slices(batch, "text"):
                texts = ["" if t is None else t for t in column(part, "text").to_pylist()]
                ids, offsets = model.encode_batch(texts)
                rows = []
                for t, a, b in zip(texts, offsets.tolist(), offsets[1:].tolist(), strict=False):
                    own = ids[a:b]
                    begins, ends = model.spans(t, own)
                    own = own.tolist()
                    rows.append(summarise(own, begins, ends, model.decode(own)))
                yield pa.RecordBatch.from_arrays([column(part, "id"), *[pa.array(c) for c in zip(*rows, strict=True)]], ["id", *names])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)
