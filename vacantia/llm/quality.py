"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from counts of byte classes, class transitions
and word shapes; gated attention (tanh times sigmoid) learned from the documents' labels weighs the
passages; a linear layer scores the weighted representation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm._util import column, lower_ascii, slices, span_hashes, text_buffer, word_spans

PASSAGE_WORDS = 64
HIDDEN, GATE = 24, 12
#: Single marks that stand for themselves; other bytes fall into classes.
_MARKS = b".,;:!?|%&$#*@<>{}[]()\"'/\\-_=+~^`"


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    fine = np.zeros(256, np.int64)
    coarse = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            fine[b], coarse[b] = 1, 1
        elif c.islower():
            fine[b], coarse[b] = 2, 2
        elif c.isupper():
            fine[b], coarse[b] = 3, 3
        elif c.isdigit():
            fine[b], coarse[b] = 4, 4
        elif c in " \t":
            fine[b], coarse[b] = 5, 5
        elif b in (10, 11, 12, 13):
            fine[b], coarse[b] = 6, 5
        elif b in _MARKS:
            fine[b], coarse[b] = 7 + _MARKS.index(b), 6
        else:
            fine[b], coarse[b] = 0, 7
    return fine, coarse


_FINE, _COARSE = _byte_classes()
N_FINE, N_COARSE = 7 + len(_MARKS), 8
N_FEATURES = N_FINE + N_COARSE * N_COARSE + 7


def passages(data: np.ndarray, offsets: np.ndarray, words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the number of passages of each text (one at least)."""
    starts, ends, per_text = word_spans(data, offsets)
    n_passages = np.maximum(1, -(-per_text // words))
    first = np.cumsum(n_passages) - n_passages
    total = int(n_passages.sum())
    text_of = np.repeat(np.arange(len(per_text)), per_text)
    rank = np.arange(len(starts)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    passage_of = first[text_of] + rank // words
    # bytes belong to the passage of the word that starts last before them
    begins = rank % words == 0
    marks = np.zeros(len(data) + 1, np.int64)
    opens = np.where(rank[begins] == 0, offsets[:-1][text_of[begins]], starts[begins])
    marks[opens] = 1
    empty = per_text == 0
    n_bytes = np.diff(offsets)
    np.add.at(marks, offsets[:-1][empty & (n_bytes > 0)], 1)
    order = np.cumsum(marks)[:-1] - 1
    held = np.concatenate([passage_of[begins], first[empty & (n_bytes > 0)]])
    held.sort()
    byte_passage = held[order] if len(data) else order
    out = np.zeros((total, N_FEATURES))
    length = np.bincount(byte_passage, minlength=total).astype(float)
    fine = np.bincount(byte_passage * N_FINE + _FINE[data], minlength=total * N_FINE).reshape(total, N_FINE)
    pair = _COARSE[data[:-1]] * N_COARSE + _COARSE[data[1:]] if len(data) > 1 else np.zeros(0, np.int64)
    same = byte_passage[:-1] == byte_passage[1:]
    pairs = np.bincount((byte_passage[:-1] * N_COARSE * N_COARSE + pair)[same], minlength=total * N_COARSE * N_COARSE).reshape(total, -1)
    scale = 1 / np.maximum(length, 1)[:, None]
    out[:, :N_FINE] = np.sqrt(fine * scale)
    out[:, N_FINE : N_FINE + N_COARSE * N_COARSE] = np.sqrt(pairs * scale)
    # word shapes
    if len(starts):
        size = ends - starts
        hashes = span_hashes(lower_ascii(data), starts, ends)
        again = np.zeros(len(starts))
        again[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
        n = np.bincount(passage_of, minlength=total).astype(float)
        per = 1 / np.maximum(n, 1)
        uniq = np.unique(passage_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ hashes, return_index=True)[1]
        shapes = (size / 8, size > 12, again, _COARSE[data[ends - 1]] == 6, size <= 3)
        for k, v in enumerate(shapes):
            out[:, N_FINE + N_COARSE * N_COARSE + k] = np.bincount(passage_of, np.asarray(v, float), total) * per
        out[:, -2] = np.bincount(passage_of[uniq], minlength=total) * per
    out[:, -1] = np.minimum(1, length / 400)
    return out, n_passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class MilModel:
    mean: np.ndarray
    std: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """``x``: standardised passages; every bag has one passage at least."""
        p, starts = self.p, np.cumsum(counts) - counts
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(counts)), counts)
        w = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        w /= np.add.reduceat(w, starts)[bag]
        z = np.add.reduceat(w[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "g": g, "a": w, "z": z, "bag": bag, "y": _sigmoid(z @ p["c"] + p["b"])}

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score per text, passages per text, and the largest attention weight of each text."""
        x, counts = passages(data, offsets)
        f = self.forward((x - self.mean) / self.std, counts)
        return f["y"], counts, np.maximum.reduceat(f["a"], np.cumsum(counts) - counts)


def fit(texts: list[str], labels: list[int], epochs: int = 250, rate: float = 0.01, decay: float = 1e-4) -> MilModel:
    """Adam on the bags' log loss, full batch; constant labels give a constant score."""
    rng = np.random.default_rng(7)
    feats, counts = [], []
    for at in range(0, len(texts), 256):
        x, n = passages(*text_buffer(pa.array(texts[at : at + 256], pa.string())))
        feats.append(x)
        counts.append(n)
    x = np.concatenate(feats) if feats else np.zeros((0, N_FEATURES))
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    y = np.array(labels, float)
    mean, std = (x.mean(0), x.std(0) + 0.02) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    p = {
        "E": rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)),
        "e": np.zeros(HIDDEN),
        "V": rng.normal(0, 0.2, (HIDDEN, GATE)),
        "U": rng.normal(0, 0.2, (HIDDEN, GATE)),
        "w": rng.normal(0, 0.2, GATE),
        "c": rng.normal(0, 0.2, HIDDEN),
        "b": np.zeros(()),
    }
    model = MilModel(mean, std, p)
    if not len(y) or y.min() == y.max():
        p["c"][:] = 0
        p["b"] = np.array(0.0 if not len(y) else 4.0 if y[0] else -4.0)
        return model
    x = (x - mean) / std
    starts = np.cumsum(n) - n
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, epochs + 1):
        f = model.forward(x, n)
        dz = ((f["y"] - y) / len(y))[:, None] * p["c"][None, :]
        dzi = dz[f["bag"]]
        # softmax over a bag: da = a (s - sum a s) with s = dz . h
        s = (dzi * f["h"]).sum(1)
        da = f["a"] * (s - np.add.reduceat(f["a"] * s, starts)[f["bag"]])
        dt = da[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = da[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dzi + dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        grads = {"E": x.T @ dpre, "e": dpre.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ da, "c": f["z"].T @ ((f["y"] - y) / len(y)), "b": ((f["y"] - y) / len(y)).sum()}
        for k, g in grads.items():
            g = g + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def sample_labelled(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, most: int) -> tuple[list[str], list[int]]:
    """The ``most`` labelled rows with the smallest id hashes: the bound of the fit.

    The sampled labels are bounded by ``most``, so they may be broadcast to the text. Of several labels of an id
    the largest counts, of several texts the smallest, so no more than ``most`` rows come to the driver.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(learn).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    order = F.xxhash64("_id", F.lit("label"))
    picked = known.where(order / float(1 << 63) < F.lit(4.0 * most / max(known.count(), 1) - 1.0)).orderBy(order, "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(F.broadcast(picked), "_id")
    rows = rows.groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y")).toArrow()
    both = sorted(zip(rows.column("_id").to_pylist(), rows.column("_t").to_pylist(), rows.column("_y").to_pylist(), strict=True))
    return [b[1] for b in both], [b[2] for b in both]


def score_quality(docs: DataFrame, model: MilModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score``, ``predicted``, ``n_passages`` and ``max_attention``; null texts count as empty.

    Columns of ``docs`` that have these names are replaced. An empty text is a bag of one empty passage; a text of any
    length is read whole, passage by passage. Rows that repeat get equal scores, null ids are kept, an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    new = ["score", "predicted", "n_passages", "max_attention"]
    kept = [c for c in docs.columns if c not in new]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "score double, predicted int, n_passages int, max_attention double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                y, n, a = shared.value.score(*text_buffer(column(part, text_col)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(y, pa.float64()), pa.array((y >= threshold).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(a, pa.float64())], [*kept, *new])

    return docs.mapInArrow(run, schema)
