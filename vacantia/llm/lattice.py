"""LM scoring by the likelihood of a subword lattice.

The pieces of an existing vocabulary weigh all segmentations of a text; the forward recursion in log space
gives the marginal probability over them. Pieces don't cross words, so a text's likelihood is a sum over
its words, and a word is solved once. The vocabulary's own scores are the start; one pass of expectation
maximisation over all training words fits them to the corpus. A word that the training rows hold is one more edge
of its lattice, from end to end: with c its count, N all tokens and V the distinct ones, its probability is
c / (N + V) + V / (N + V) times the marginal of its pieces (Witten and Bell's weights).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm._util import Scratch, column, lower_ascii, partitions, slices, span_hashes, text_buffer, word_spans

#: Stands for the space mark before a word; a byte that no word holds.
MARK = b" "
#: Bytes of text a task takes at once for the join, and distinct words it counts before it sends them on.
SLICE, DISTINCT = 3 << 20, 200_000
#: A word of more bytes is solved alone, in blocks of that many.
LONG = 1 << 16
#: Text bytes that one fragment of the word order stands for, on average.
FRAGMENT_BYTES = 32 << 20
#: Share of the probability that goes to bytes, so that any text has a segmentation.
BYTES = 0.02


@dataclass
class Lattice:
    """Pieces by byte length: sorted hashes, log probabilities and the piece numbers."""

    lengths: list[int]
    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    ids: list[np.ndarray]
    end: float
    size: int

    def edges(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: starts, log probabilities and ids of the pieces found in words at ``offsets``."""
        word_end = np.repeat(offsets[1:], np.diff(offsets))
        for length, hashes, logp, ids in zip(self.lengths, self.hashes, self.logp, self.ids, strict=True):
            starts = np.flatnonzero(np.arange(len(data)) + length <= word_end)
            if not len(starts):
                break
            found = span_hashes(data, starts, starts + length)
            at = np.searchsorted(hashes, found)
            at[at == len(hashes)] = 0
            hit = hashes[at] == found
            yield length, starts[hit], logp[at[hit]], ids[at[hit]]

    def solve(self, data: np.ndarray, offsets: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log marginal of each word and, with ``weight``, the expected count of each piece.

        Words are taken in order of length, in blocks of rows by positions, so all recursions of a block run together.
        """
        n = len(offsets) - 1
        out = np.zeros(n)
        expected = np.zeros(self.size) if weight is not None else None
        size = np.diff(offsets)
        order = np.argsort(size, kind="stable")
        at = 0
        lengthy = order[size[order] > LONG]
        n -= len(lengthy)
        order = order[:n]
        for w in lengthy:
            out[w] = self._solve_long(data[offsets[w] : offsets[w + 1]], weight[w] if weight is not None else 0.0, expected)
        while at < n:
            longest = int(size[order[min(n - 1, at + 4095)]])
            take = order[at : at + max(1, min(4096, (1 << 20) // max(1, longest)))]
            at += len(take)
            most = int(size[take].max())
            bounds = np.concatenate(([0], np.cumsum(size[take])))
            index = np.repeat(offsets[:-1][take] - bounds[:-1], size[take]) + np.arange(bounds[-1])
            block = data[index]
            row = np.repeat(np.arange(len(take)), size[take])
            place = np.arange(bounds[-1]) - bounds[:-1][row]
            found = list(self.edges(block, bounds))
            grid = {}
            for length, starts, logp, ids in found:
                lp = np.full((most, len(take)), -np.inf)
                lp[place[starts], row[starts]] = logp
                grid[length] = lp
            alpha = np.full((most + 1, len(take)), -np.inf)
            alpha[0] = 0
            with np.errstate(divide="ignore", invalid="ignore"):
                for j in range(1, most + 1):
                    terms = [alpha[j - k] + lp[j - k] for k, lp in grid.items() if k <= j]
                    if terms:
                        top = np.maximum.reduce(terms)
                        safe = np.where(np.isfinite(top), top, 0)
                        alpha[j] = np.log(sum(np.exp(t - safe) for t in terms)) + safe
                z = alpha[size[take], np.arange(len(take))]
                out[take] = z
                if expected is None:
                    continue
                beta = np.full((most + 1, len(take)), -np.inf)
                beta[size[take], np.arange(len(take))] = 0
                for j in range(most - 1, -1, -1):
                    terms = [lp[j] + beta[j + k] for k, lp in grid.items() if j + k <= most] + [beta[j]]
                    top = np.maximum.reduce(terms)
                    safe = np.where(np.isfinite(top), top, 0)
                    beta[j] = np.log(sum(np.exp(t - safe) for t in terms)) + safe
            for length, starts, logp, ids in found:
                r, p = row[starts], place[starts]
                share = np.exp(alpha[p, r] + logp + beta[p + length, r] - z[r]) * weight[take][r]
                expected += np.bincount(ids, share, self.size)
        return out, expected

    def _ends(self, data: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, log probabilities and ids of all pieces within ``data[low:high]``."""
        found = [(s + low, s + low + k, lp, ids) for k, s, lp, ids in self.edges(data[low:high], np.array([0, high - low]))]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _solve_long(self, data: np.ndarray, weight: float, expected: np.ndarray | None) -> float:
        """The log marginal of one word, whose pieces are looked up block by block; adds expected counts."""
        n, reach = len(data), max(self.lengths)

        def recur(to: np.ndarray, known: np.ndarray, lp: np.ndarray, first: int, last: int, step: int, value: np.ndarray) -> None:
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(min(first, last), max(first, last) + 2))
            known, lp = known[order].tolist(), lp[order].tolist()
            for j in range(first, last + step, step):
                a, b = cut[j - min(first, last)], cut[j - min(first, last) + 1]
                terms = [value[known[k]] + lp[k] for k in range(a, b)]
                top = max(terms, default=-math.inf)
                if top > -math.inf:
                    value[j] = top + math.log(sum(math.exp(t - top) for t in terms))

        alpha = np.full(n + 1, -np.inf)
        alpha[0] = 0
        for low in range(0, n, LONG):
            high = min(n, low + LONG)
            starts, ends, lp, _ = self._ends(data, max(0, low - reach), high)
            new = ends > low
            recur(ends[new], starts[new], lp[new], low + 1, high, 1, alpha)
        if expected is not None and weight:
            beta = np.full(n + 1, -np.inf)
            beta[n] = 0
            for low in reversed(range(0, n, LONG)):
                high = min(n, low + LONG)
                starts, ends, lp, ids = self._ends(data, low, min(n, high + reach))
                new = starts < high
                starts, ends, lp, ids = starts[new], ends[new], lp[new], ids[new]
                recur(starts, ends, lp, high - 1, low, -1, beta)
                expected += np.bincount(ids, np.exp(alpha[starts] + lp + beta[ends] - alpha[n]) * weight, self.size)
        return float(alpha[n])


def vocabulary(model_file: str) -> tuple[list[bytes], np.ndarray]:
    """Byte strings of the vocabulary's pieces (the space mark as one byte) and probabilities from its scores.

    Scores of a BPE vocabulary are minus the rank of the merge; a piece of rank r gets a weight of 1/(r + 1)
    as in Zipf's law. Log-probability scores of a unigram vocabulary are used as they are. Bytes share ``BYTES``.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=model_file).serialized_model_proto())
    unigram = proto.trainer_spec.model_type == 1
    weights: dict[bytes, float] = {}
    for p in proto.pieces:
        if p.type in (1, 4) and p.piece.strip("▁"):
            key = p.piece.replace("▁", MARK.decode()).encode().lower()
            weights[key] = weights.get(key, 0.0) + (np.exp(p.score) if unigram else 1.0 / (1.0 - p.score))
    weights.setdefault(MARK, max(weights.values(), default=1.0))
    names = sorted(weights)
    values = np.array([weights[n] for n in names])
    values *= (1 - BYTES) / values.sum()
    place = {n: i for i, n in enumerate(names)}
    extra = [bytes([b]) for b in range(256) if bytes([b]) not in place]
    values = np.concatenate((values, np.zeros(len(extra))))
    names += extra
    place = {n: i for i, n in enumerate(names)}
    for b in range(256):
        values[place[bytes([b])]] += BYTES / 256
    return names, values


def build(names: list[bytes], probability: np.ndarray, end: float) -> Lattice:
    by: dict[int, list[int]] = {}
    for i, n in enumerate(names):
        by.setdefault(len(n), []).append(i)
    out = Lattice(sorted(by), [], [], [], float(np.log(end)), len(names))
    for length in out.lengths:
        ids = np.array(by[length])
        data = np.frombuffer(b"".join(names[i] for i in ids), np.uint8)
        starts = np.arange(len(ids)) * length
        hashes = span_hashes(data, starts, starts + length)
        order = np.argsort(hashes)
        out.hashes.append(hashes[order])
        out.ids.append(ids[order])
        out.logp.append(np.log(probability[ids[order]] * (1 - end)))
    return out


def _marked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    return np.frombuffer(b"".join(MARK + w for w in words), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (bytes, A-Z lowered) and ``c``, its count in rows with ``train``; words of other rows have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(seen.items())
            seen.clear()
            for at in range(0, len(items), 20_000):
                w, c = zip(*items[at : at + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(c, pa.int64())], ["word", "c"])

        for batch in batches:
            for part in slices(batch, "text"):
                for t, learn in zip(column(part, "text").to_pylist(), column(part, "train").to_pylist(), strict=True):
                    words = (t or "").encode().lower().split()
                    if learn:
                        seen.update(words)
                    else:
                        for w in words:
                            seen[w] += 0
                if len(seen) > DISTINCT:
                    yield from flush()
        yield from flush()

    return docs.select("text", "train").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of words, bounded in bytes and rows."""
    for part in slices(batch, "word"):
        for at in range(0, part.num_rows, 50_000):
            yield part.slice(at, 50_000)


def _expected(lattice: Lattice, words: DataFrame) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(lattice)  # bounded by the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shared.value.size)
        for batch in batches:
            for part in _bounded(batch):
                total += shared.value.solve(*_marked(column(part, "word").to_pylist()), column(part, "c").to_numpy(zero_copy_only=False).astype(float))[1]
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["piece", "n"])

    return words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))


def _fragment(hashes: np.ndarray, fragments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


_PACKED = "frag int, kind int, owner long, ids binary, hashes binary, a binary, b binary, c binary"
_FIELDS = ["frag", "kind", "owner", "ids", "hashes", "a", "b", "c"]


def _row(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], _FIELDS)


def _vocabulary_rows(words: DataFrame, lattice: Lattice, fragments: int) -> DataFrame:
    """Hash, count and log marginal of every word of the corpus, packed by range of the hash."""
    shared = words.sparkSession.sparkContext.broadcast(lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _bounded(batch):
                data, offsets = _marked(column(part, "word").to_pylist())
                z, _ = shared.value.solve(data, offsets)
                hashes = span_hashes(data, offsets[:-1] + 1, offsets[1:])
                c = column(part, "c").to_numpy(zero_copy_only=False)
                frag = _fragment(hashes, fragments)
                order = np.argsort(frag, kind="stable")
                cut = np.searchsorted(frag[order], np.arange(fragments + 1))
                yield _row([(f, 0, -1, b"", hashes[o].tobytes(), c[o].tobytes(), z[o].tobytes(), b"") for f in range(fragments) if cut[f] < cut[f + 1] for o in (order[cut[f] : cut[f + 1]],)] or [(0, 0, -1, b"", b"", b"", b"", b"")])

    return words.mapInArrow(run, _PACKED)


def _document_rows(docs: DataFrame, fragments: int) -> DataFrame:
    """Distinct words of a slice of documents, packed by range of the hash, with (document, times) postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        owner = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for at in range(0, part.num_rows, 60_000):
                    some = part.slice(at, 60_000)
                    data, offsets = text_buffer(column(some, "text"))
                    data = lower_ascii(data)
                    starts, ends, per = word_spans(data, offsets)
                    hashes = span_hashes(data, starts, ends)
                    uniq, which = np.unique(hashes, return_inverse=True)
                    pair, times = np.unique(which.astype(np.uint64) << np.uint64(16) | np.repeat(np.arange(len(per)), per).astype(np.uint64), return_counts=True)
                    posting = np.diff(np.searchsorted(pair >> np.uint64(16), np.arange(len(uniq) + 1)))
                    first = np.concatenate(([0], np.cumsum(posting)))
                    doc = (pair & np.uint64(0xFFFF)).astype(np.uint16)
                    frag = _fragment(uniq, fragments)  # rises with the hash
                    cut = np.searchsorted(frag, np.arange(fragments + 1))
                    ids = _ids(column(some, "row"), per)
                    rows = []
                    for f in range(fragments):
                        a, b = cut[f], cut[f + 1]
                        if a < b or f == 0:
                            p, q = first[a], first[b]
                            rows.append((f, 1, owner, ids if f == 0 else len(per).to_bytes(8, "little"), uniq[a:b].tobytes(), posting[a:b].astype(np.uint16 if len(per) < 65536 else np.int64).tobytes(), doc[p:q].tobytes(), np.minimum(times[p:q], 1 << 31).astype(np.uint32).tobytes()))
                    owner += 1
                    yield _row(rows)

    return docs.select("row", "text").mapInArrow(run, _PACKED)


def _ids(rows: pa.Array, tokens: np.ndarray) -> bytes:
    """Row numbers and words of a slice's documents."""
    return np.concatenate((rows.to_numpy(zero_copy_only=False).astype(np.int64), tokens.astype(np.int64))).tobytes()


def _join_fragment(n_train: int, distinct: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the words of one fragment for each slice: known words, base and lattice log10 likelihoods."""
    vocabulary, waiting = [], []
    for batch in batches:
        for kind, owner, ids, hashes, a, b, c in zip(*(column(batch, x).to_pylist() for x in _FIELDS[1:]), strict=True):
            if kind == 0:
                vocabulary.append((np.frombuffer(hashes, np.uint64), np.frombuffer(a, np.int64), np.frombuffer(b, np.float64)))
            else:
                waiting.append((owner, ids, hashes, a, b, c))
    hashes = np.concatenate([v[0] for v in vocabulary]) if vocabulary else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    hashes = hashes[order]
    count = np.concatenate([v[1] for v in vocabulary])[order] if vocabulary else np.zeros(0, np.int64)
    z = np.concatenate([v[2] for v in vocabulary])[order] / np.log(10) if vocabulary else np.zeros(0)
    base = np.log10((count + 0.1) / (n_train + 0.1 * (distinct + 1)))
    if n_train:
        with np.errstate(divide="ignore"):
            z = np.logaddexp(np.log(count / (n_train + distinct)), np.log(distinct / (n_train + distinct)) + z * np.log(10)) / np.log(10)
    for owner, ids, hs, posting, doc, times in waiting:
        at = np.repeat(np.searchsorted(hashes, np.frombuffer(hs, np.uint64)), np.frombuffer(posting, np.uint16))
        doc, times = np.frombuffer(doc, np.uint16), np.frombuffer(times, np.uint32).astype(float)
        some, place = np.unique(doc, return_inverse=True)
        known, low, high = (np.bincount(place, times * v[at], len(some)) for v in ((count > 0).astype(float), base, z)) if len(at) else [np.zeros(0)] * 3
        sums = low.tobytes() + high.tobytes() + np.rint(known).astype(np.uint32).tobytes() + some.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int64()), pa.array([ids], pa.binary()), pa.array([sums], pa.binary())], ["owner", "ids", "sums"])


#: Bytes of a document's sums in one fragment: base and lattice, known words, its place in the slice.
_SUMS = 8 + 8 + 4 + 2


def _documents(ids: bytes) -> int:
    """Documents of a slice: the fragment 0 has their row numbers and words, the others have how many there are."""
    return int.from_bytes(ids, "little") if len(ids) == 8 else len(ids) // 16


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice's sums over all fragments. A fragment tells only of documents that have words in it."""
    total, known = None, b""
    for batch in batches:
        for ids, s in zip(column(batch, "ids").to_pylist(), column(batch, "sums").to_pylist(), strict=True):
            total = np.zeros((3, _documents(ids))) if total is None else total
            known = ids if len(ids) != 8 else known
            k = len(s) // _SUMS
            doc = np.frombuffer(s, np.uint16, k, 20 * k)
            for row, (kind, at) in enumerate(((np.uint32, 16 * k), (np.float64, 0), (np.float64, 8 * k))):
                total[row, doc] += np.frombuffer(s, kind, k, at)
    known = np.frombuffer(known, np.int64).reshape(2, -1)
    yield pa.RecordBatch.from_arrays([pa.array(known[0]), pa.array(known[1]), pa.array(np.rint(total[0]).astype(np.int64)), pa.array(total[1]), pa.array(total[2])], ["row", "words", "known", "base", "lattice"])


def score_texts(docs: DataFrame, model_file: str, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are the words of the text (A-Z lowered) and one end. ``base_score`` is the add-0.1 unigram model of
    words, ``score`` the lattice's with its whole words, both in log10 and learned from rows where ``train`` holds;
    the end has the same probability in both. All words of the corpus are counted and solved; documents meet
    their words in fragments of the hash order, whose number follows the bytes of the text, and a fragment sends
    each slice of documents the sums of those that have words in it. Null texts count as empty (the end alone), null ids are kept, repeated rows get equal
    results, texts of any length are read whole (a word of more than ``LONG`` bytes is solved in blocks, its memory
    16 bytes a byte), other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema[id_col].dataType
    whole = kind.simpleString() in ("bigint", "int", "smallint", "tinyint")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    if not whole:
        raise TypeError("ids must be whole numbers")
    words = scratch.cut(count_words(base), "words")
    totals = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    size = base.agg(F.count_if("train").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_docs = size["n"]
    n_train = int(totals["n"] or 0) + n_docs
    distinct = int(totals["v"] or 0) + (1 if n_docs else 0)
    names, probability = vocabulary(model_file)
    pieces = build(names, probability, 0.01)
    fitted = np.zeros(len(names))
    for r in _expected(pieces, words).collect():  # a row for each piece of the vocabulary at most
        fitted[r["piece"]] = r["n"]
    if fitted.sum():
        mass = fitted.sum()
        probability = (np.round(fitted, 6) + 100 * probability) / (mass + 100)
        probability /= probability.sum()
    end = max(n_docs, 1) / (max(n_docs, 1) + fitted.sum() + 1)
    lattice = build(names, probability, end)
    fragments = max(partitions(spark), (size["bytes"] or 0) // FRAGMENT_BYTES)
    null_id = -(1 << 63)
    numbered = base.select(F.coalesce(F.col("id").cast("long"), F.lit(null_id)).alias("row"), "text")
    packed = _vocabulary_rows(words, lattice, fragments).unionByName(_document_rows(numbered, fragments))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _join_fragment(n_train, distinct, batches)

    joined = packed.groupBy("frag").applyInArrow(join, "owner long, ids binary, sums binary")
    summed = joined.groupBy("owner").applyInArrow(_add_up, "row long, words long, known long, base double, lattice double")
    end_count = n_docs
    end_base = float(np.log10((end_count + 0.1) / (n_train + 0.1 * (distinct + 1)))) if n_train or distinct else 0.0
    return summed.select(
        F.when(F.col("row") != null_id, F.col("row")).cast(kind).alias(id_col),
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.lit(1 if n_docs else 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end_base)).alias("base_score"),
        (F.col("lattice") + F.lit(end_base if n_docs else float(lattice.end / np.log(10)))).alias("score"),
    )
