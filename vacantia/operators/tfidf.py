"""TF-IDF over word n-grams: sublinear term frequency, smoothed idf, unit length per document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.text import let

TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_#+\-.]*"


def _tokens(text_col: str, stopwords: tuple[str, ...]) -> Column:
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({TOKEN})"), 1)
    return F.filter(tokens, lambda t: ~t.isin(*stopwords)) if stopwords else tokens


def _grams(docs: DataFrame, most: int, stopwords: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """``doc`` and ``term``, a row for each n-gram; rows are dealt by document before they multiply."""
    tokens = _tokens(text_col, stopwords)

    def grams(t: Column, n: int) -> Column:
        one = lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)])
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), one)).otherwise(F.array().cast("array<string>"))

    every = let(tokens, lambda t: F.concat(t, *[grams(t, n) for n in range(2, most + 1)]))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col)).repartition("doc")
    return rows.select("doc", F.explode(every).alias("term"))


def terms(docs: DataFrame, most: int = 3, stopwords: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc``, ``term``, ``tf``: n-grams of the tokens that are no stop words, counted in each document.

    The text is shuffled, not its n-grams: rows dealt by document are counted where they are.
    """
    return _grams(docs, most, stopwords, id_col, text_col).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def terms_of(docs: DataFrame, vocab: DataFrame, most: int = 3, stopwords: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``terms`` of a vocabulary of a stated size, which is broadcast, so that other n-grams are never counted."""
    rows = _grams(docs, most, stopwords, id_col, text_col).join(F.broadcast(vocab.select("term")), "term", "left_semi")
    return rows.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(tf: DataFrame, n_docs: int, least: int = 2, share: float = 0.3, features: int | None = None) -> DataFrame:
    """``term``, ``df``, ``idf`` of terms in ``least`` documents or more and at most a ``share`` of them.

    ``features`` keeps the terms that occur most often in the corpus; ties by term.
    """
    v = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= least) & (F.col("df") <= share * n_docs))
    if features is not None:
        v = v.orderBy(F.desc("total"), "term").limit(features)
    return v.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def _joined(at: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Numbers of n-grams with one word more, from those of the n-grams at each place and at the next; -1 for none."""
    out = np.full(len(at), -1, np.int64)
    ok = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0) & (row[:-1] == row[1:]))
    out[ok] = at[ok] * width + at[ok + 1]
    return out


def _places(tokens: pa.ListArray, levels: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row of each token, and for each level which of its n-grams begins there; the last is of all n-grams if it is None."""
    row = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
    at = [pc.fill_null(pc.index_in(tokens.flatten(), value_set=levels[0]), -1).to_numpy(zero_copy_only=False).astype(np.int64)]
    for before, known in zip(levels, levels[1:], strict=False):
        code = _joined(at[-1], row, len(before))
        if known is not None:
            where = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
            code = np.where((code >= 0) & (known[where] == code), where, -1) if len(known) else np.full(len(code), -1)
        at.append(code)
    return row, at


def _by_document(docs: DataFrame, stopwords: tuple[str, ...], id_col: str, text_col: str, each: Callable, schema: str) -> DataFrame:
    """``each`` of batches of whole documents: ids by number, number of each row, tokens."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col)).repartition("doc").sortWithinPartitions("doc").select("doc", _tokens(text_col, stopwords).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(b: pa.RecordBatch, new: list[bool]) -> Iterator[pa.RecordBatch]:
            if b.num_rows:
                yield from each(b.column(0).filter(pa.array(new)), np.cumsum(new) - 1, b.column(1))

        kept = None
        for b in (batch.slice(i, 1024) for batch in batches for i in range(0, batch.num_rows, 1024)):
            b = b if kept is None else pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(kept.columns, b.columns, strict=True)], names=["doc", "tokens"])
            ids = b.column(0).to_pylist()
            new = [True, *[x != y for x, y in zip(ids, ids[1:], strict=False)]]
            # the last document may go on in the next batch
            last = len(new) - 1 - new[::-1].index(True)
            yield from told(b.slice(0, last), new[:last])
            kept = b.slice(last)
        if kept is not None:
            yield from told(kept, [True] + [False] * (kept.num_rows - 1))

    return rows.mapInArrow(run, schema)


def _tallied(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, code and count of each pair that occurs."""
    known, number = np.unique(code, return_inverse=True)
    pair, tf = np.unique(doc * max(1, len(known)) + number, return_counts=True)
    return pair // max(1, len(known)), known[pair % max(1, len(known))], tf


def top_vocabulary(docs: DataFrame, n_docs: int, features: int, most: int = 3, least: int = 2, share: float = 0.3, stopwords: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``vocabulary(terms(docs), n_docs, least, share, features)`` and ``terms_of`` it, without counting every n-gram.

    Exact: an n-gram occurs no more often than those it is made of. Words are counted first; of n-grams with a word
    more, only those are counted whose two parts occur as often as the last of the ``features`` terms found so
    far. The n-grams that do, with ties, come to the driver.
    """
    from vacantia.operators.vectors import cut

    spark, levels, names, terms_found = docs.sparkSession, [], [], []
    floor = least
    for n in range(1, most + 1):
        if n == 1:
            words = docs.select(F.col(id_col).alias("doc"), F.col(text_col)).repartition("doc").select("doc", F.explode(_tokens(text_col, stopwords)).alias("code"))
            counts = words.groupBy("doc", "code").agg(F.count(F.lit(1)).alias("tf")).groupBy("code").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        else:
            known = [*levels, None]

            def count(ids: pa.Array, doc: np.ndarray, tokens: pa.ListArray, known: list = known) -> Iterator[pa.RecordBatch]:
                row, at = _places(tokens, known)
                ok = at[-1] >= 0
                _, code, tf = _tallied(doc[row[ok]], at[-1][ok])
                code, number = np.unique(code, return_inverse=True)
                total = np.bincount(number, tf, len(code)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.bincount(number, minlength=len(code)).astype(np.int64)), pa.array(total)], names=["code", "df", "total"])

            counts = _by_document(docs, stopwords, id_col, text_col, count, "code long, df long, total long").groupBy("code").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        counts = cut(counts.where((F.col("df") >= least) & (F.col("total") >= floor)))
        # the last of the terms so far, if there are as many, bounds what is still of use
        best = counts.where(F.col("df") <= share * n_docs).orderBy(F.desc("total")).limit(features).select("total").collect()
        so_far = sorted([r.total for r in best] + [t for _, _, t in terms_found], reverse=True)
        floor = max(floor, so_far[features - 1]) if len(so_far) >= features else floor
        found = counts.where(F.col("total") >= floor).orderBy("code").collect()
        if n == 1:
            levels.append(pa.array([r.code for r in found], pa.string()))
            names.append([r.code for r in found])
        else:
            width, ends = len(names[-1]), [x.rsplit(" ", 1)[-1] for x in names[-1]]
            levels.append(np.array([r.code for r in found], np.int64))
            names.append([names[-1][r.code // width] + " " + ends[r.code % width] for r in found])
        terms_found += [(x, r.df, r.total) for x, r in zip(names[-1], found, strict=True) if r.df <= share * n_docs]
    kept = sorted(terms_found, key=lambda r: (-r[2], r[0].encode()))[:features]
    chosen = {r[0] for r in kept}
    is_term = [np.array([x in chosen for x in level], bool) for level in names]
    spelt = [pa.array(level, pa.string()) for level in names]

    def tell(ids: pa.Array, doc: np.ndarray, tokens: pa.ListArray) -> Iterator[pa.RecordBatch]:
        row, at = _places(tokens, levels)
        for a, good, names in zip(at, is_term, spelt, strict=True):
            ok = np.flatnonzero(a >= 0)
            ok = ok[good[a[ok]]]
            d, code, tf = _tallied(doc[row[ok]], a[ok])
            if len(d):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), names.take(pa.array(code)), pa.array(tf.astype(np.int64))], names=["doc", "term", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    vocab = spark.createDataFrame([r[:2] for r in kept], "term string, df long").withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)
    return vocab, _by_document(docs, stopwords, id_col, text_col, tell, f"doc {kind}, term string, tf long")


def weights(tf: DataFrame, vocab: DataFrame, bounded: bool = False) -> DataFrame:
    """``doc``, ``term``, ``score``, unit length per document; a ``bounded`` vocabulary is broadcast."""
    raw = tf.join(F.broadcast(vocab) if bounded else vocab, "term").select("doc", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("w") / norm).alias("score"))


def confidence(term: Column, score: Column, indicators: tuple[str, ...] = (), ambiguous: tuple[str, ...] = ()) -> Column:
    """Score with a bonus for indicators and several words, a malus for ambiguous words, within 0 and 1."""
    from vacantia.functions.rules import has_any

    c = score + F.when(has_any(term, indicators), 0.15).otherwise(0.0) - F.when(has_any(term, ambiguous), 0.25).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c + F.when(F.contains(term, F.lit(" ")), 0.05).otherwise(0.0)))


def adaptive_k(words: Column) -> Column:
    """How many terms a document of so many words gives."""
    return F.when(words < 100, 10).when(words < 300, 20).when(words < 500, 30).otherwise(40)


def top_terms(scored: DataFrame, words: DataFrame) -> DataFrame:
    """Best terms of each document, as many as its length allows. ``words``: doc, words."""
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("confidence"), "term"))
    return scored.join(words, "doc").withColumn("rank", rank).where(F.col("rank") <= adaptive_k(F.col("words"))).drop("words")
