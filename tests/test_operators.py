"""Operators against plain Python on small frames."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.operators import clustering, dedup, evaluate, extract, match, selection, skill_table, tfidf, vectors
from vacantia.operators.aggregates import cooccurring


def test_prf_swaps(spark):
    g = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "job_id int, skill string")
    p = spark.createDataFrame([(1, "a"), (2, "c")], "job_id int, skill string")
    a, b = evaluate.micro(g, p).first(), evaluate.micro(p, g).first()
    assert (a.tp, a.fp, a.fn) == (1, 1, 2)
    assert (a.precision, a.recall, a.f1) == (b.recall, b.precision, b.f1)
    assert evaluate.of_union(g, p).first().tp == 1
    none = evaluate.micro(g.limit(0), p.limit(0)).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_worker_ranges(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    got = [r.worker for r in selection.worker_ranges(df, "k", 5).orderBy("k").collect()]
    assert got == [1] * 5 + [2] * 5 + [3] * 5 + [4] * 4 + [5] * 4
    few = [r.worker for r in selection.worker_ranges(df.where("k < 2"), "k", 5).orderBy("k").collect()]
    assert few == [1, 2]


def test_non_overlapping(spark):
    rows = [(1, 0, 2, 3), (1, 1, 1, 1), (1, 3, 4, 2), (2, 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id int, start int, end int, size int")
    assert sorted(map(tuple, selection.non_overlapping(df).collect())) == [(1, 0, 2, 3), (1, 3, 4, 2), (2, 1, 1, 1)]


def test_drop_contained(spark):
    df = spark.createDataFrame([(1, "machine learning"), (1, "learning"), (1, "learn"), (2, "learning")], "doc_id int, ngram string")
    assert sorted(map(tuple, selection.drop_contained(df).collect())) == [(1, "learn"), (1, "machine learning"), (2, "learning")]


def test_cooccurring(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "a"), (3, "a")], "job_id int, skill_text string")
    assert [tuple(r) for r in cooccurring(df).collect()] == [("a", "b", 2)]


def test_regex_edges(spark):
    df = spark.createDataFrame([(1, "C++ and C#, .NET"), (2, None)], "doc_id long, text string")
    names = {r.skill_text for r in extract.regex_skills(df).collect()}
    assert {"c++", "c#", ".net"} <= names
    strict = {r.skill_text for r in extract.regex_skills(df, strict_edges=True).collect()}
    assert not {"c++", "c#"} & strict


def test_regex_whole_table(spark):
    assert (len(skill_table.PATTERNS), len(skill_table.ALIAS_TABLES)) == (18, 12)
    text = "Pandas and GraphQL; experiencia en Kotlin, VB.NET. Java 17\n\u00b7 Maven \u00b7 end to end \u00b7 Spring Boot\nTools: Zig, rest api"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.skill_text: r for r in extract.regex_skills(df, aliases=skill_table.ALIASES).collect()}
    assert {"Pandas", "GraphQL", "Kotlin", "Java", "java 17", "Maven", "spring boot", "zig", "REST API"} <= set(got)
    assert got["zig"].skill_type == "bullet_point_skills" and text[got["zig"].start : got["zig"].end] == "Zig"
    assert not any("end" in name.split() for name in got)
    bare = {"contextualized_spanish": extract.PATTERNS["contextualized_spanish"]}
    (row,) = extract.regex_skills(df, bare, skill_table.ALIASES).collect()
    assert (row.skill_text, text[row.start : row.end]) == ("Kotlin", "Kotlin")


def test_regex_prefilter_drops_nothing():
    table = extract._table(tuple(extract.PATTERNS.items()), False)
    rnd = random.Random(5)
    words = [*"Experiencia en Java 17+ C++ C# Node.js vuejs SQL Server Spring Boot IBM DB2 bases de datos APIs CI/CD Dataflows Gen2 Kubernetes \u212aotlin REACT GESTI\u00d3N dise\u00f1o - \u00b7 :".split(), "\n", *(re.sub(r"\\s\+", " ", p).replace("\\", "") for k, ps in skill_table.PATTERNS.items() if k not in extract.CAPTURED for p in ps)]
    for _ in range(150):
        text = " ".join(rnd.choice((str, str.upper, str.lower))(rnd.choice(words)) for _ in range(25))
        whole = [(k, p, frozenset(), ()) for k, p, *_ in table]
        assert list(extract._found(text, table, extract.ALIASES)) == list(extract._found(text, whole, extract.ALIASES))


def test_tfidf_against_python(spark):
    docs = ["a b a c", "a c", "b d d", "c d"]
    tf = tfidf.terms(spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string"), most=1)
    got = {(r.doc, r.term): r.score for r in tfidf.weights(tf, tfidf.vocabulary(tf, 4, least=2, share=0.8)).collect()}
    df = {t: sum(t in d.split() for d in docs) for t in "abcd"}
    want = {}
    for i, d in enumerate(docs):
        w = {t: (1 + math.log(d.split().count(t))) * (math.log(5 / (1 + df[t])) + 1) for t in set(d.split()) if 2 <= df[t] <= 3.2}
        n = math.sqrt(sum(x * x for x in w.values()))
        want |= {(i, t): x / n for t, x in w.items()}
    assert got == pytest.approx(want)


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_edit_join_finds_all(spark, most):
    rnd = random.Random(most)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(0, 5))) for _ in range(30)}
    frame = spark.createDataFrame([(w,) for w in words], "s string")
    got = {(r.a, r.b) for r in match.edit_join(frame, frame, most).collect()}
    want = {(a, b) for a, b in itertools.product(words, words) if _levenshtein(a, b) <= most}
    assert {(a, b) for a, b in got if a and b} == {(a, b) for a, b in want if a and b}


def test_layers(spark):
    tax = spark.createDataFrame([("u1", "Python"), ("u2", "JavaScript"), ("u3", "restaurar dentaduras"), ("u4", "data analysis methods")], "skill_uri string, label string")
    skills = spark.createDataFrame([("python",), ("javascrip t",), ("REST",), ("data analysis",), (None,), ("",)], "skill string")
    got = {r.skill: (r.skill_uri, r.method) for r in match.layered(skills, tax, enhanced=True).collect()}
    assert got["python"] == ("u1", "exact")
    assert got["REST"] == (None, "none") or got["REST"][1] == "substring"
    assert got["data analysis"] == ("u4", "substring")
    plain = {r.skill: r.method for r in match.layered(skills, tax).collect()}
    assert plain["REST"] == "none"


@pytest.mark.parametrize("least, short", [(0.92, 0.95), (0.86, 0.92)])
def test_fuzzy_is_exact(spark, least, short):
    from vacantia.functions.fuzzy import partial_ratio, ratio

    rnd = random.Random(3)
    words = [w for w in {"".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 16))) for _ in range(120)} if w.strip()]
    skills = [*words[:50], "kubernets", "developer", "excel", "react", "reat", "REACT", "İstanbul"]
    labels = [*words[50:], "Kubernetes", "developers", "ms-excel", "React.js", "exce", "istanbul"]

    def score(s, t):
        a, b = s.lower(), t.lower()
        return max(ratio(a, b), partial_ratio(a, b)) if 5 <= len(s) <= 6 and len(t) > len(s) else ratio(a, b)

    want = {}
    for s in skills:
        over = [score(s, t) for t in labels if score(s, t) >= (short if len(s) <= 4 else least)]
        if over:
            want[s] = round(max(over), 3)
    got = match.fuzzy(spark.createDataFrame([(s,) for s in skills], "skill string"), spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(labels)], "skill_uri string, label string"), least, short)
    assert {r.skill: r.confidence for r in got.collect()} == want
    assert {"kubernets", "developer", "excel"} <= set(want)


def test_knn_and_silhouette(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 6))
    labels = rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, x[i].tolist(), int(labels[i])) for i in range(60)], "vec_id long, embedding array<double>, label int")
    got = {(r["query"], r["rank"]): r["neighbor"] for r in vectors.knn(df.where("vec_id < 5"), df, 4, block=16).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for q in range(5):
        assert [got[q, k + 1] for k in range(4)] == np.argsort(-s[q])[:4].tolist()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(60):
        own = (labels == labels[i]) & (np.arange(60) != i)
        a, b = d[i, own].mean(), min(d[i, labels == k].mean() for k in range(3) if k != labels[i])
        want.append((b - a) / max(a, b))
    per = {r["label"]: r["silhouette"] for r in vectors.silhouette(df, block=16).collect()}
    assert per == pytest.approx({k: np.mean([w for w, lab in zip(want, labels, strict=True) if lab == k]) for k in range(3)})


def test_density_clusters(spark):
    points = [(i, [float(i % 2) * 10 + 0.1 * (i // 2), 0.0]) for i in range(20)] + [(99, [5.0, 5.0])]
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in clustering.density_clusters(df, 0.25, 2).collect()}
    assert got[99] == -1
    assert {got[i] for i in range(0, 20, 2)} == {got[0]}
    assert {got[i] for i in range(1, 20, 2)} == {got[1]}
    assert got[0] != got[1]


def test_density_clusters_do_not_stop_early(spark):
    df = spark.createDataFrame([((i * 37) % 101, [0.1 * i, 0.0]) for i in range(24)], "vec_id long, embedding array<double>")
    assert {r.cluster for r in clustering.density_clusters(df, 0.15, 1).collect()} == {0}
    with pytest.raises(RuntimeError):
        clustering.density_clusters(df, 0.15, 1, rounds=1)


def test_near_pairs_and_marks(spark):
    body = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, "Dev", body), (2, "dev", body + " x"), (3, "Cook", "another text of its own here"), (4, "DEV", body)], "id long, title string, text string")
    pairs = {(r.id_1, r.id_2) for r in dedup.near_pairs(df, "id", "title", "text").collect()}
    assert {(1, 2), (1, 4), (2, 4)} == pairs
    marks = {r.id: r.duplicate_of for r in dedup.mark_normalised(df, "id", "title", "text").collect()}
    assert marks == {1: None, 2: None, 3: None, 4: 1}


def test_near_pairs_equal_brute_force(spark):
    rnd = random.Random(8)
    base = [[rnd.choice("abcdefghij") + rnd.choice("klmnop") * rnd.randint(1, 3) for _ in range(n)] for n in (3, 10, 30, 30)]
    rows = [(1, "dev", "alpha beta gamma delta"), (2, "dev", "delta gamma beta alpha"), (3, "dev", None), (4, "dev", "...")]
    for i in range(5, 60):
        words = list(rnd.choice(base))
        if rnd.random() < 0.5:
            words[rnd.randrange(len(words))] += rnd.choice(("", "q", "z"))
        rnd.shuffle(words)
        rows.append((i, rnd.choice(("dev", "cook")), " ".join(words)))

    def grams(text):
        return {f"  {w} "[k : k + 3] for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split() for k in range(len(w) + 1)}

    for least in (0.95, 0.8):
        want = {(i, j) for (i, t, x), (j, u, y) in itertools.combinations(rows, 2) if t == u and grams(x) | grams(y) and len(grams(x) & grams(y)) / len(grams(x) | grams(y)) >= least}
        df = spark.createDataFrame(rows, "id long, title string, text string")
        assert {(r.id_1, r.id_2) for r in dedup.near_pairs(df, "id", "title", "text", body_least=least).collect()} == want
    assert (1, 2) in want


def test_quota(spark):
    rows = spark.createDataFrame([("g", r, float(s), i) for i, (r, s) in enumerate([("a", 9), ("a", 8), ("a", 7), ("b", 1), ("c", 5)])], "grp string, role string, score double, id int")
    quotas = spark.createDataFrame([("g", "a", 1), ("g", "b", 1)], "grp string, role string, quota int")
    totals = spark.createDataFrame([("g", 3)], "grp string, total int")
    got = {(r.id, r["pass"]) for r in selection.quota_selection(rows, quotas, totals).collect()}
    assert got == {(0, 1), (3, 1), (1, 2)}


def test_stage_functions_are_lazy(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert "text" in dedup.by_hash(df.withColumn("h", F.sha2("text", 256)), "h", F.asc("doc_id")).columns
