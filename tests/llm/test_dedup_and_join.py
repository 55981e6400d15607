"""Exact dedup and the n-gram join against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vacantia.llm import exact_dedup, ngram_join
from vacantia.llm._util import Scratch
from vacantia.llm.components import components

SCHEMA = "doc_id long, text string, n long, rep string, comp string, id int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", "y", 0) for i, t in rows], SCHEMA)


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    own, holders = {}, defaultdict(list)
    for i, t in rows:
        own[i] = sets(t)
        for g in own[i]:
            holders[g].append(i)
    root = {i: i for i in own}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, s in own.items():
        for j, n in Counter(j for g in s for j in holders[g] if j > i).items():
            if 100 * n >= 75 * (len(s) + len(own[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in own.items()}


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    shared = [rnd.choice(words) for _ in range(60)]
    rows = []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 5, 8, 30, 120]))]
        for _ in range(rnd.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            if rnd.random() < 0.3:
                copy = copy + shared
            rows.append(" ".join(w.upper() if rnd.random() < 0.1 else w for w in copy))
    rows += [" ".join(shared), " ".join([*shared, "tail"]), "", None, "  \t ", "one", "ONE", "a b c d", rows[0], rows[1]]
    # a chain in which neighbours link and ends don't
    line = [f"c{k}" for k in range(100)]
    rows += [" ".join(line[k : k + 60]) for k in range(0, 40, 5)]
    rnd.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_threshold_is_inclusive(spark):
    a = [f"x{k}" for k in range(18)]  # 14 n-grams
    rows = [(1, " ".join(a)), (2, " ".join(a[:16])), (3, " ".join(a[:14]))]  # 12 of 14 and 10 of 14 and 10 of 12
    assert {r.doc_id: r.component_id for r in ngram_join.similar_components(frame(spark, rows)).collect()} == {i: c for i, (_, c) in brute(rows).items()}


def test_join_edges(spark):
    assert ngram_join.similar_components(frame(spark, [])).count() == 0
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (7, long), (8, long + " x"), (9, None), (9, None), (5, "a b c d e f")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, None), (5, 2, 5), (5, 2, 5), (7, 29996, 7), (8, 29997, 7), (9, 0, 9), (9, 0, 9)], key=str)


def test_near_copies_keep_one(spark):
    rows = corpus(3)
    docs = frame(spark, rows)
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in brute(rows).values()}


def test_links_equal_brute_force(spark):
    rnd = random.Random(11)
    base = [[rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(20, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 1, 2))):
            words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 3)}"
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, "alone")]
    own = {i: sets(t) for i, t in rows}
    want = {i: sum(i != j and 4 * len(a & b) >= 3 * len(a | b) > 0 for j, b in own.items()) for i, a in own.items()}
    assert max(want.values()) > 3
    assert {r.doc_id: r.links for r in ngram_join.similar_components(frame(spark, rows), links=True).collect()} == want


def test_unrelated_texts_and_a_family(spark):
    """Texts without links, a family around the threshold with a sub-family, and copies: components and links."""
    rnd = random.Random(21)
    base = [f"b{k}" for k in range(150)]
    other = [*base[:60], *[f"o{k}" for k in range(25)], *base[85:]]
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(40))) for i in range(30)]
    for i in range(100, 300):
        words = list(base if i % 4 else other)
        for _ in range(rnd.randint(0, 7)):
            words[rnd.randrange(len(words))] = f"e{rnd.randint(0, 200)}"
        rows.append((i, " ".join(words)))
    rows += [(400 + k, rows[40 + k % 3][1]) for k in range(20)]
    own = {i: sets(t) for i, t in rows}
    want = {i: sum(i != j and 4 * len(a & b) >= 3 * len(a | b) > 0 for j, b in own.items()) for i, a in own.items()}
    got = {r.doc_id: r for r in ngram_join.similar_components(frame(spark, rows), links=True).collect()}
    assert {i: r.links for i, r in got.items()} == want
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute(rows)
    alone = ngram_join.similar_components(frame(spark, rows[:30])).collect()
    assert all(r.component_id == r.doc_id for r in alone)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges, Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return groups


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, keep):
    rows = [(4, "a"), (2, "a"), (9, "b"), (1, None), (3, ""), (6, "c" * 200_000), (7, "c" * 200_000), (8, "é"), (11, "A")]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, rows), keep=keep).collect()}
    pick = {"min": min, "max": max}[keep]
    for t, ids in exact(rows).items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (pick(ids), len(ids), i == pick(ids))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, "b"), (2, "b"), (None, "c"), (None, "c")]
    out = exact_dedup.exact_dedup(frame(spark, rows), keep="max")
    assert out.count() == 7
    assert out.where("kept").groupBy("text_sha256").count().where("count <> 1").count() == 0
    docs = frame(spark, rows)
    kept = exact_dedup.drop_exact_copies(docs, keep="max")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, "a"), (2, "b"), (None, "c")]


def test_hash_collisions_fall_apart(spark, monkeypatch):
    """Texts whose 128-bit hashes are made equal stay two classes."""
    real = F.md5
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: real(F.lit("same")))
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2), 5: (5, 1)}
