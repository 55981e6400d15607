"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm._util import column, mix, slices

DISCOUNT = 0.75
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with two leading spaces each, non-letters as spaces; offsets; letters per text.

    Runs of non-letters count as one space, so markup and digits add no evidence.
    """
    low = ["  " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))))
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first non-letter after a letter
    keep[offsets[:-1]] = keep[offsets[:-1] + 1] = True
    below = np.concatenate(([0], np.cumsum(keep)))
    n_letters = np.diff(np.concatenate(([0], np.cumsum(letter)))[offsets])
    return np.where(letter, codes, 32)[keep].astype(np.uint64), below[offsets], n_letters


def _trigrams(codes: np.ndarray) -> np.ndarray:
    return (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]


@dataclass
class Table:
    """Values by key: keys hashed and sorted, looked up by binary search."""

    hashes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        hashes = mix(keys.astype(np.uint64) + np.uint64(1))
        order = np.argsort(hashes)
        return cls(hashes[order], values[order].astype(np.float32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = mix(keys + np.uint64(1))
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(keys), bool)


@dataclass
class LangModel:
    """Log probabilities of the last character of a trigram for all languages at once."""

    langs: list[str]
    tri: Table | None = None
    context2: Table | None = None
    bi: Table | None = None
    context1: Table | None = None
    uni: Table | None = None
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    sharpness: float = 20.0
    reject: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        keys = _trigrams(codes)
        at, hit = self.tri.find(keys)
        out = self.tri.values[at]
        if len(miss := np.flatnonzero(~hit)):
            two = np.uint64((1 << 42) - 1)
            out[miss] = self._shorter(self.context2, keys[miss] >> np.uint64(21), self._two(keys[miss] & two))
        return out

    def _two(self, keys: np.ndarray) -> np.ndarray:
        at, hit = self.bi.find(keys)
        out = self.bi.values[at]
        if len(miss := np.flatnonzero(~hit)):
            last = keys[miss] & np.uint64((1 << 21) - 1)
            one, known = self.uni.find(last)
            lower = np.where(known[:, None], self.uni.values[one], self.floor)
            out[miss] = self._shorter(self.context1, keys[miss] >> np.uint64(21), lower)
        return out

    @staticmethod
    def _shorter(contexts: Table, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        at, hit = contexts.find(keys)
        return lower + np.where(hit[:, None], contexts.values[at], np.float32(0))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character in nats, a column per language; letters per text."""
        codes, offsets, letters = _codes(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        if len(codes) > 2:
            logp = self.log_probs(codes)
            for k in range(len(self.langs)):  # a trigram belongs to the text of its last character
                total = np.concatenate(([0.0], np.cumsum(logp[:, k], dtype=np.float64)))
                sums[:, k] = total[np.maximum(offsets[1:] - 2, 0)] - total[offsets[:-1]]
        return -sums / np.maximum(np.diff(offsets) - 2, 1)[:, None], letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language (``und`` without a letter), its calibrated probability, cross-entropy, rejected."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, letters = self.entropies(texts)
        best = h.argmin(1)
        weight = np.exp(-self.sharpness * (h - h.min(1, keepdims=True)))
        score = np.where(letters > 0, weight.max(1) / weight.sum(1), 0.0)
        low = h[np.arange(len(texts)), best]
        return [self.langs[b] if n else "und" for b, n in zip(best, letters, strict=True)], score, low, (letters == 0) | (low > self.reject[best])


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    uniq, at = np.unique(keys, return_inverse=True)
    return uniq, np.bincount(at, values, len(uniq))


def fit(texts: list[str], langs: list[str], calibrate: float = 0.2) -> LangModel:
    """Kneser-Ney trigram models on all but a ``calibrate`` share of the texts, which sets the sharpness
    of the posterior (least log loss on a grid) and each language's rejection bound (a tenth above the
    highest cross-entropy that its own calibration texts have).
    """
    names = sorted(set(langs))
    model = LangModel(names)
    if not names:
        return model
    held = [i for i in range(len(texts)) if i % max(2, round(1 / calibrate)) == 1]
    train = sorted(set(range(len(texts))) - set(held))
    counts = []
    for name in names:
        own = [texts[i] for i in train if langs[i] == name] or [texts[i] for i in range(len(texts)) if langs[i] == name]
        parts = []
        for t in range(0, len(own), 200):
            codes, offsets, _ = _codes(own[t : t + 200])
            keys = _trigrams(codes)
            ok = np.ones(len(codes), bool)
            ok[offsets[:-1]] = ok[offsets[:-1] + 1] = False  # trigrams that end in the padding of a text
            parts.append(np.unique(keys[ok[2:]], return_counts=True))
        counts.append(_sum_by(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(float)))
    every3 = np.unique(np.concatenate([c[0] for c in counts]))
    m21, m42 = np.uint64((1 << 21) - 1), np.uint64((1 << 42) - 1)
    every2, contexts2 = np.unique(every3 & m42), np.unique(every3 >> np.uint64(21))
    every1, contexts1 = np.unique(every3 & m21), np.unique(every2 >> np.uint64(21))
    alphabet = len(every1) + 1
    size = len(names)
    p3, g2 = np.zeros((len(every3), size)), np.zeros((len(contexts2), size))
    p2, g1 = np.zeros((len(every2), size)), np.zeros((len(contexts1), size))
    p1, floor = np.zeros((len(every1), size)), np.zeros(size)

    def spread(uniq: np.ndarray, values: np.ndarray, over: np.ndarray) -> np.ndarray:
        out = np.zeros(len(over))
        out[np.searchsorted(over, uniq)] = values
        return out

    for k, (keys, n) in enumerate(counts):
        bi, before = _sum_by(keys & m42, np.ones(len(keys)))  # continuation counts of bigrams
        uni, firsts = _sum_by(bi & m21, np.ones(len(bi)))
        total1 = firsts.sum()
        floor[k] = DISCOUNT * len(uni) / total1 / alphabet
        p1[:, k] = np.maximum(spread(uni, firsts, every1) - DISCOUNT, 0) / total1 + floor[k]
        ctx, mass = _sum_by(bi >> np.uint64(21), before)
        _, kinds = _sum_by(bi >> np.uint64(21), np.ones(len(bi)))
        mass, kinds = spread(ctx, mass, contexts1), spread(ctx, kinds, contexts1)
        back = np.where(mass > 0, DISCOUNT * kinds / np.maximum(mass, 1), 1.0)
        g1[:, k] = back
        at = np.searchsorted(contexts1, every2 >> np.uint64(21))
        lower = p1[np.searchsorted(every1, every2 & m21), k]
        p2[:, k] = np.maximum(spread(bi, before, every2) - DISCOUNT, 0) / np.maximum(mass[at], 1) + back[at] * lower
        ctx, mass = _sum_by(keys >> np.uint64(21), n)
        _, kinds = _sum_by(keys >> np.uint64(21), np.ones(len(keys)))
        mass, kinds = spread(ctx, mass, contexts2), spread(ctx, kinds, contexts2)
        back = np.where(mass > 0, DISCOUNT * kinds / np.maximum(mass, 1), 1.0)
        g2[:, k] = back
        at = np.searchsorted(contexts2, every3 >> np.uint64(21))
        p3[:, k] = np.maximum(spread(keys, n, every3) - DISCOUNT, 0) / np.maximum(mass[at], 1) + back[at] * p2[np.searchsorted(every2, every3 & m42), k]
    model.tri, model.context2 = Table.of(every3, np.log(p3)), Table.of(contexts2, np.log(g2))
    model.bi, model.context1 = Table.of(every2, np.log(p2)), Table.of(contexts1, np.log(g1))
    model.uni, model.floor = Table.of(every1, np.log(p1)), np.log(floor).astype(np.float32)
    model.reject = np.full(size, np.log(alphabet), np.float32)
    if held:
        h, letters = model.entropies([texts[i] for i in held])
        truth = np.array([names.index(langs[i]) for i in held])
        seen = letters > 0
        grid = [1.0, 2.0, 5.0, 10.0, 20.0, 40.0, 80.0]
        low = h - h.min(1, keepdims=True)
        loss = [(s * low[np.arange(len(held)), truth] + np.log(np.exp(-s * low).sum(1)))[seen].sum() for s in grid]
        model.sharpness = grid[int(np.argmin(loss))]
        for k in range(size):
            if len(own := h[seen & (truth == k), k]):
                model.reject[k] = 1.1 * own.max()
    return model


def sample_labelled(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, per_lang: int) -> tuple[list[str], list[str]]:
    """About ``per_lang`` labelled rows per language at most, by a hash of the id: the bound of the fit."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_lang / n))])
    order = F.xxhash64("id", F.lit("lang"))
    chosen = rows.where((order / float(1 << 63) + 1.0) / 2.0 < share[F.col("lang")])
    picked = chosen.orderBy(order, "id", F.xxhash64("text")).limit(2 * per_lang * len(counts)).select("text", "lang").toArrow()
    both = sorted(zip(picked.column("lang").to_pylist(), picked.column("text").to_pylist(), strict=True))
    return [t for _, t in both], [lang for lang, _ in both]


def identify(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred``, ``score``, ``cross_entropy``, ``rejected``.

    Texts that are null or have no letter are ``und`` with a score of 0 and rejected; texts of any length are read whole;
    equal cross-entropies go to the first language by name. Rows that repeat get equal results, null ids are kept, other
    columns are ignored, an empty table gives no rows. ``rejected`` marks a text whose cross-entropy lies above what its
    language's calibration texts have; the prediction stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB: bounded by the sample it was fitted on
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                lang, score, low, no = shared.value.predict(["" if t is None else t for t in column(part, "text").to_pylist()])
                yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.float64()), pa.array(no, pa.bool_())], ["id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean").withColumnRenamed("id", id_col)
