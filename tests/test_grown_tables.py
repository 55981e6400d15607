"""Queries on tables with rows that the driver's smallest ones lack."""

import itertools
import os
import random

import numpy as np
import pytest
from test_queries import SF, plain

from vacantia.functions import fuzzy
from vacantia.operators import dedup, selection, tfidf, vectors
from vacantia.plans import registry


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["replacement_jobs", "title_screening"])
def test_half_salaries_round_as_in_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    # halves over odd and even numbers, on both sides of the least size
    price = "CASE WHEN o_orderkey % 3 = 0 THEN 93.5 + o_orderkey % 4 ELSE floor(o_totalprice) + 0.5 END"
    for t in ("orders", "customer", "nation", "region", "lineitem", "part"):
        what = f"* REPLACE (CAST({price} AS DOUBLE) AS o_totalprice)" if t == "orders" else "*"
        con.execute(f"COPY (SELECT {what} FROM '{SF}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == want


def test_silhouette_in_slabs(spark):
    rng = np.random.default_rng(2)
    x, labels = rng.normal(size=(300, 5)), np.append(rng.integers(-1, 90, 298), (200, 200))
    df = spark.createDataFrame([(i, x[i].tolist(), int(labels[i])) for i in range(300)], "vec_id long, embedding array<double>, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    names, want = sorted(set(labels.tolist()) - {-1}), {}
    for k in names:
        own = labels == k
        a, b = d[own][:, own].sum(1) / max(1, own.sum() - 1), np.min([d[own][:, labels == j].mean(1) for j in names if j != k], axis=0)
        want[k] = float(np.mean((b - a) / np.maximum(a, b))) if own.sum() > 1 else 0.0
    for many in (df, df.where("label < 40")):
        got = {r["label"]: r["silhouette"] for r in vectors.silhouette(many, block=64, tile=8).collect()}
        if many is df:
            assert got == pytest.approx(want)
    rows = df.where("label >= 0").selectExpr("vec_id AS id", "embedding AS vec", "cast(label AS long) AS label")
    pairs = vectors.slab_pairs(*[vectors.slabs(rows, 64, columns=("label",))] * 2)
    assert "CartesianProduct" in pairs._jdf.queryExecution().executedPlan().toString()


def test_overlaps_are_streamed_over_documents(spark):
    rng = np.random.default_rng(6)
    rows = list({(d if d else None, int(a), int(a) + n - 1, n) for d in range(9) for a, n in zip(rng.integers(0, 60, 80), rng.integers(1, 4, 80).tolist(), strict=True)})
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, size int")
    want = []
    for d in {r[0] for r in rows}:
        taken = set()
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[3], r[1])):
            if taken.isdisjoint(span := range(r[1], r[2] + 1)):
                taken.update(span)
                want.append(r)
    out = selection.non_overlapping(df)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_sets_are_the_trigrams_whatever_the_parts(spark):
    texts = ["", "a", " ", "Ab  c, ab!", "x" * 40, "Ñandú_1 niño e\u0301 ß \U00010400z", None, "the cat the hat " * 9, "--"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select(fuzzy.spaced_words(df.text).alias("w"), fuzzy.trigrams(df.text).alias("x")).collect()
    for most in (5, 30, 1 << 18):
        for got, r in zip(dedup._sets([r.w for r in rows], most), rows, strict=True):
            got = [got[i : i + 3] for i in range(0, len(got), 3)]
            assert got == sorted(r.x or [])


def test_near_links_of_copies_and_families(spark):
    rnd = random.Random(4)
    words = [rnd.choice("bcdfg") + rnd.choice("aeiou") * rnd.randint(1, 2) + rnd.choice("lmnrs") for _ in range(400)]
    rows = [(i, "de", "one text with many copies") for i in range(900, 600, -1)] + [(901, None, "one text with many copies"), (902, None, "one text with many copies")]
    for i in range(160):
        base = words[i % 5 * 60 : i % 5 * 60 + 60]
        base[rnd.randrange(60)] = rnd.choice(words)
        rows.append((i, rnd.choice(("en", "de")), " ".join(rnd.sample(base, 60))))

    def grams(text):
        return frozenset(f"  {w} "[k : k + 3] for w in text.split() for k in range(len(w) + 1))

    sets = [(i, t, grams(x)) for i, t, x in rows]
    names = {}
    for i, t, x in sets:
        names[t, x] = min(i, names.get((t, x), i))
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for least, block in ((0.95, 16384), (0.9, 40), (0.7, 64)):
        want = {tuple(sorted((i, j))) for ((t, x), i), ((u, y), j) in itertools.combinations(names.items(), 2) if t == u and t and len(x & y) / len(x | y) >= least}
        want |= {(names[t, x], i) for i, t, x in sets if t and names[t, x] != i}
        found = dedup.near_links(df, "doc_id", "lang", "text", body_least=least, block=block)
        got = [(r.id_1, r.id_2) for r in found.collect()]
        assert len(want) > 300 and len(got) == len(set(got)) and set(got) == want
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()


def test_top_vocabulary_counts_what_can_be_in_it(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["ñu", "c++"]
    rows = [(i % 70 if i else None, " ".join(rnd.choices(words, range(1, 33), k=rnd.randint(0, 60))) if i % 9 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    for features, share, stop in ((40, 0.3, ()), (150, 0.9, ("w20",)), (100000, 1.0, ())):
        vocab = tfidf.vocabulary(tfidf.terms(df, 3, stop), 70, share=share, features=features)
        want = {(r.term, r.df, r.idf) for r in vocab.collect()}
        counts = sorted(map(tuple, tfidf.terms_of(df, vocab, 3, stop).select("doc", "term", "tf").collect()), key=str)
        found, tf = tfidf.top_vocabulary(df, 70, features, 3, share=share, stopwords=stop)
        assert {(r.term, r.df, r.idf) for r in found.collect()} == want
        assert sorted(map(tuple, tf.collect()), key=str) == counts
    assert not tfidf.top_vocabulary(df.where("text = ''"), 0, 10)[1].count()
