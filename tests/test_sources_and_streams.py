"""Readers, writers and streams on files in a temporary folder."""

import datetime

from pyspark.sql import functions as F

from vacantia.sources import readers, writers
from vacantia.streaming import events


def test_taxonomy_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('conceptType,conceptUri,preferredLabel,altLabels,description\nS,u1,Uno,"eins | one","line\nbreak ""q"""\n')
    (tmp_path / "b.csv").write_text("conceptType,conceptUri,preferredLabel\nS,u1,Other\nS,u2,Dos\n")
    got = {r.skill_uri: r for r in readers.taxonomy_csv(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv")}).collect()}
    assert got["u1"].label == "Uno"
    assert got["u1"].alt_labels == ["eins", "one"]
    assert got["u1"].description == 'line\nbreak "q"'
    assert got["u2"].skill_group == "b"


def test_annotations(spark, tmp_path):
    sheet = "# x\n\n## Job #3/300\n\n**Job ID**: `abc`\n\ntext\n\n### Anotación\n\n- [x] **Es software/tech job válido**\n\n**Hard Skills**:\n```\nPython\n C++ \n(PENDIENTE)\n```\n\n**Soft Skills**:\n```\nLiderazgo\n```\n\n**Comentarios**:\n```\n(PENDIENTE)\n```\n\n## Job #4/300\n\n**Job ID**: `no`\n- [ ] **Es software/tech job válido**\n"
    (tmp_path / "s.md").write_text(sheet)
    sheets = readers.annotations(spark, str(tmp_path / "s.md"))
    row = sheets.collect()
    assert [(r.job_num, r.job_id, r.hard_skills, r.soft_skills, r.notes) for r in row] == [(3, "abc", ["Python", "C++"], ["Liderazgo"], None)]
    assert readers.annotation_rows(sheets).count() == 3


def test_postings(spark):
    html = '<script type="application/ld+json">{"@type":"WebSite"}</script><script type="application/ld+json">{"@type":"JobPosting","title":"Dev","description":"D -Requerimientos- R","datePosted":"2024-05-01T10:00:00Z","employmentType":"FULL_TIME","hiringOrganization":{"name":"ACME"},"jobLocation":{"address":{"addressLocality":"Cali","addressRegion":"Valle"}},"baseSalary":{"unitText":"Mensual","value":{"value":"10","currency":"COP"}}}</script>'
    df = spark.createDataFrame([("u", html), ("v", "<p>none</p>"), ("w", None)], "url string, html string")
    (row,) = readers.postings(df).collect()
    assert (row.title, row.company, row.location, row.description, row.requirements) == ("Dev", "ACME", "Cali, Valle", "D", "R")
    assert (row.salary_raw, row.contract_type, row.posted_date) == ("$ 10 COP (Mensual)", "Tiempo completo", datetime.date(2024, 5, 1))


def test_logs_and_listing(spark, tmp_path):
    (tmp_path / "x.log").write_text("a ERROR b\n'item_scraped_count': 12,\nINFO Spider closed (finished)\n")
    (row,) = readers.progress_logs(spark, str(tmp_path / "*.log")).collect()
    assert (row.items, row.errors, row.finished) == (12, 1, True)
    (file,) = readers.listing(spark, str(tmp_path / "*.log")).collect()
    assert file.name == "x.log"


def test_insert_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("t", "d", "r"), ("t", "d", "r"), ("t2", None, "r")], "title string, description string, requirements string")
    target = str(tmp_path / "jobs")
    assert writers.insert_jobs(rows, target) == 2
    assert writers.insert_jobs(rows, target) == 0
    assert spark.read.parquet(target).count() == 2


def test_upserts(spark, tmp_path):
    target = str(tmp_path / "t")
    writers.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int"), target, ["k"])
    writers.upsert(spark.createDataFrame([(2, "c", 9), (3, "d", 3)], "k int, x string, y int"), target, ["k"])
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [(1, "a", 1), (2, "c", 9), (3, "d", 3)]
    writers.upsert(spark.createDataFrame([(1, "z", 7), (4, "n", 4)], "k int, x string, y int"), target, ["k"], only=["x"])
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [(1, "z", 1), (2, "c", 9), (3, "d", 3), (4, "n", 4)]
    writers.replace_by_key(spark.createDataFrame([(1, "q", 0), (1, "r", 0)], "k int, x string, y int"), target, "k")
    assert spark.read.parquet(target).where("k = 1").count() == 2


def test_status_machine(spark):
    jobs = spark.createDataFrame([(1, "pending", None, 0, None), (2, "pending", None, None, None)], "job_id int, extraction_status string, extraction_completed_at timestamp, extraction_attempts int, extraction_error string")
    updates = spark.createDataFrame([(1, "completed", None), (2, "failed", "boom")], "job_id int, status string, error string")
    now = F.lit("2024-01-01").cast("timestamp")
    got = {r.job_id: r for r in writers.with_status(jobs, updates, "extraction", now).collect()}
    assert got[1].extraction_completed_at is not None
    assert (got[2].extraction_status, got[2].extraction_attempts, got[2].extraction_error) == ("failed", 1, "boom")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, 1 + i % 3, datetime.datetime(2024, 1, 1, 0, i), ["completed", "failed", "processing"][i % 3 if i % 2 else 1], f"e{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "seq long, job_id long, ts timestamp, status string, error string")
    for k in range(3):
        df.where(f"seq % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.files(spark, str(tmp_path / "in"), df.schema, per_trigger=1)
    events.to_memory(events.status_stream(stream), "statuses", "update")
    last = {r.job_id: (r.status, r.attempts, r.error) for r in spark.table("statuses").groupBy("job_id").agg(F.max_by(F.struct("status", "attempts", "error"), "attempts").alias("s")).select("job_id", "s.*").collect()}
    want = {r.job_id: r.attempts for r in events.last_status(df).collect()}
    assert {k: v[1] for k, v in last.items()} == want


def test_windows_stream(spark, tmp_path):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, m // 60, m % 60), 1.0) for m in (0, 5, 61, 200)], "ts timestamp, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.files(spark, str(tmp_path / "in"), df.schema)
    got = events.to_memory(events.tumbling(stream, "1 hour", "10 minutes"), "tumbled", "complete")
    assert sorted(r.n for r in got.collect()) == [1, 1, 2]


def test_load_new(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "h string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        events.load_new(events.files(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), "h", str(tmp_path / "ck")).awaitTermination()
        assert sorted(r.h for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_payloads(spark):
    msg = '{"event":"jobs_scraped","timestamp":"2024-01-01T00:00:00Z","data":{"job_ids":["1","2"],"count":2,"country":"CO","spider":"x"}}'
    found = events.payloads(spark.createDataFrame([(msg,), ("broken",)], "value string"))
    assert [(r.task, r.job_id) for r in events.tasks(events.topics(found, "jobs_*")).collect()] == [("extract", "1"), ("extract", "2")]


def test_llm_answers(spark):
    df = spark.createDataFrame([(1, '```{"hard_skills": ["Python"], "soft_skills": [" "]}```'), (2, "no")], "job_id int, answer string")
    assert [tuple(r) for r in readers.llm_skills(df).collect()] == [(1, "hard", "Python")]
