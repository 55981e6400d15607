"""The corpus pipeline against its stages by brute force, and the registered queries."""

import hashlib
import os

import pytest
import sentencepiece
from test_dedup_and_join import brute

import corpus_pipeline
from vacantia.llm import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in at.collect()}
        out = stage(spark, at, SF)
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns
            assert {r.doc_id for r in rows} <= set(before)
            assert len({r.doc_id for r in rows}) == len(rows)
        if k == 1:
            last = {}
            for i, t in before.items():
                last[t] = max(i, last.get(t, i))
            assert {r.doc_id for r in rows} == set(last.values())
        if k == 2:
            assert {r.doc_id for r in rows} == {c for _, c in brute(list(before.items())).values()}
        if k == 4:
            assert {r.doc_id for r in rows} == set(before)
            whole = sentencepiece.SentencePieceProcessor(model_file=q.piece_model())
            for r in rows:
                ids = [*whole.encode(before[r.doc_id] or ""), whole.eos_id()]
                assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        if k < 4:
            at = spark.createDataFrame(rows, out.schema)


def test_stages_on_odd_rows(spark):
    """Null, empty and repeated texts, a long text, and no rows at all pass every stage."""
    some = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-2, "", "en", "s", 0), (-3, "word " * 60_000, "en", "s", 300_000)], some.schema)
    for docs in (some.limit(0), some.unionByName(odd)):
        at = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:]):
            out = stage(spark, at, SF)
            rows = out.collect()
            assert len(rows) <= docs.count()
            if k < 3:
                assert out.columns == docs.columns
                at = spark.createDataFrame(rows, out.schema)


def test_queries_are_registered():
    known = q.queries()
    assert sorted(known) == sorted([*[n for n in known if n.startswith("op")], "pipeline"])
    assert {n[2:].split("_")[0] for n in known if n.startswith("op")} == {str(k) for k in range(1, 11)}
