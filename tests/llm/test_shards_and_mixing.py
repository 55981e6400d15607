"""K-d tree shards and soft-membership mixing."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import kd_shard, mixing


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 7, 8) for i, t, s in rows], "doc_id long, text string, source string, lang string, size long, shard int")


def test_shards_are_even_whole_and_gapless(spark):
    rnd = random.Random(5)
    texts = [" ".join("x" * rnd.randint(1, 9) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    rows = [(i, texts[i % 380] if i % 13 else None, f"s{i % 4}") for i in range(600)]
    got = kd_shard.kd_shards(frame(spark, rows), 8).collect()
    assert len(got) == 600
    by_id = {i: t or "" for i, t, _ in rows}
    total, shard_of = [0] * 8, {}
    for r in got:
        t = by_id[r.doc_id]
        assert (r.size, r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
        total[r.shard] += r.size
        assert shard_of.setdefault(t, r.shard) == r.shard
    assert max(total) - min(total) < 0.1 * sum(total) / 8
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("shards", [1, 3, 5])
def test_any_number_of_shards(spark, shards):
    rows = [(i, f"text {i} " * 5, None) for i in range(200)]
    sizes = [r["n"] for r in kd_shard.kd_shards(frame(spark, rows), shards).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == shards
    assert max(sizes) - min(sizes) <= 4 * 46  # a few rows of the longest text


def test_shard_edges(spark):
    assert kd_shard.kd_shards(frame(spark, []), 8).count() == 0
    same = kd_shard.kd_shards(frame(spark, [(i, "same", "s") for i in range(50)]), 8).collect()
    assert len({r.shard for r in same}) == 1
    assert sorted(r.slot for r in same) == list(range(50))
    odd = kd_shard.kd_shards(frame(spark, [(None, None, None), (1, "a", None), (1, "a", None)]), 2)
    assert odd.count() == 3
    assert kd_shard.kd_shards(frame(spark, [(i, "x" * 99, "s" + str(i)) for i in range(64)]), None, target_bytes=1600).select("shard").distinct().count() == 1


def labelled(spark, n=300):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        kind = "ab"[i % 3 == 0]
        words = [rnd.choice(["alpha", "amber", "arc"] if kind == "a" else ["beta", "bold", "bay"]) for _ in range(rnd.randint(5, 30))]
        rows.append((i, " ".join(words), 1, 2))
        if i % 2:
            labels.append((i, kind))
    return spark.createDataFrame(rows, "doc_id long, text string, tokens int, q int"), spark.createDataFrame(labels, "doc_id long, kind string")


def test_mix_meets_targets(spark):
    docs, labels = labelled(spark)
    got = mixing.mix(docs, labels, F.col("kind"), {"a": 1.0, "b": 3.0}, budget=1.2).collect()
    assert len(got) == 300
    tokens = {"a": 0.0, "b": 0.0}
    for r in got:
        assert r.rate >= 0
        assert r.copies in (int(r.rate), int(r.rate) + 1)
        assert abs(sum(r.posterior) - 1) < 1e-9
        for d, p in zip("ab", r.posterior, strict=True):
            tokens[d] += p * r.rate * r.tokens
        assert r.domain == "ab"[r.doc_id % 3 == 0]
    total = sum(r.tokens for r in got)
    assert tokens["a"] == pytest.approx(0.25 * 1.2 * total, rel=0.01)
    assert tokens["b"] == pytest.approx(0.75 * 1.2 * total, rel=0.01)


def features(text):
    """Distinct words and the mark runs at their ends."""
    words = {w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w}
    return words | {"\x01end " + w[len(w.rstrip(mixing.MARKS)) :] for w in words if w[-1] in mixing.MARKS}


@pytest.mark.parametrize("most", [None, 1.0])
def test_mix_against_numpy(spark, most):
    """Posteriors and rates of a plain version: dictionaries for the counts, numpy for the steps."""
    rnd = random.Random(9)
    vocab = {"a": [f"a{k}" for k in range(30)], "b": [f"b{k}!" for k in range(30)], "c": [f"c{k}" for k in range(30)]}
    both = [f"w{k}" for k in range(50)]
    rows, known = [], {}
    for i in range(240):
        kind = rnd.choice("aab" if i % 5 else "bc")
        n = rnd.randint(1, 40)
        rows.append((i, " ".join(rnd.choice(vocab[kind] if rnd.random() < 0.3 else both) for _ in range(n)), 1, 2))
        if i % 2:
            known[i] = kind
    rows += [(900, None, 1, 2), (901, "", 1, 2), (902, "a1 " * 3000, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens int, rate int")
    labels = spark.createDataFrame(list(known.items()), "doc_id long, kind string")
    words = sorted(set().union(*(features(t) for _, t, *_ in rows)))
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", f"pmod(xxhash64(w), {mixing.BUCKETS}) as b").collect()}
    own = {i: {bucket[w] for w in features(t)} for i, t, *_ in rows}
    domains = sorted(set(known.values()))
    counts = {d: Counter(b for i, k in known.items() if k == d for b in own[i]) for d in domains}
    total = sum(counts.values(), Counter())
    weight = {}
    for d in domains:
        mass, rest = sum(counts[d].values()), sum(total.values()) - sum(counts[d].values())
        for b in total:
            x, y = counts[d][b], total[b] - counts[d][b]
            odds = math.log((x + mixing.SMOOTH) / (mass + 1)) - math.log((y + mixing.SMOOTH) / (rest + 1))
            g2 = 2 * sum(n * math.log(n * (mass + rest) / (total[b] * m)) for n, m in ((x, mass), (y, rest)) if n)
            weight[d, b] = odds * max(0.0, 1 - mixing.SHRINK**2 / max(g2, 1e-9)) / mixing.TEMPER
    posterior = []
    for i, *_ in rows:
        score = [math.log((sum(k == d for k in known.values()) + 0.5) / (len(known) + 0.5 * len(domains))) + sum(weight.get((d, b), 0.0) for b in own[i]) for d in domains]
        e = np.exp(np.array(score) - max(score))
        posterior.append(e / e.sum())
    p, t = np.array(posterior), np.array([len((x or "").split()) for _, x, *_ in rows], float)
    share = np.array([0.5, 0.3, 0.2])
    budget = 1.0 if most is None else min(1.0, *(p.T @ t * most / share / t.sum()))
    goal = share * budget * t.sum()
    inverse = np.linalg.inv(p.T @ (p * t[:, None]) + 1e-9 * t.sum() * np.eye(3))
    rate, at, trial = np.ones(len(t)), None, True  # ``at``: the best rates so far, what they miss, their worth
    while True:
        off = p.T @ (t * rate) - goal
        worth = off @ inverse @ off
        if at is not None and worth >= at[2]:
            if not trial:
                rate = at[0]
                break
            rate, trial = np.clip(at[0] - p @ (inverse @ at[1]), 0, most), False
            continue
        if np.abs(off).max() <= mixing.MISS * goal.sum() or at is not None and not trial and at[2] - worth < mixing.GAIN * at[2]:
            break
        free = (rate > 0) & (rate < (np.inf if most is None else most))
        inner = p.T @ (p * (t * free)[:, None]) + 1e-9 * t.sum() * np.eye(3)
        at, trial = (rate, off, worth), True
        rate = np.clip(rate - p @ (np.linalg.inv(inner) @ off), 0, most)
    got = {r.doc_id: r for r in mixing.mix(docs, labels, F.col("kind"), dict(zip("abc", share, strict=True)), 1.0, most=most).collect()}
    assert np.abs(np.array([got[i].posterior for i, *_ in rows]) - p).max() < 1e-9
    assert np.abs(np.array([got[i].rate for i, *_ in rows]) - rate).max() < 1e-6
    # no plain projected-gradient run of a thousand steps comes closer
    plain = np.ones(len(t))
    for _ in range(1000):
        plain = np.clip(plain - p @ (inverse @ (p.T @ (t * plain) - goal)), 0, most)
    off, rest = p.T @ (t * rate) - goal, p.T @ (t * plain) - goal
    assert np.abs(off).max() <= mixing.MISS * goal.sum() or off @ inverse @ off <= 1.02 * (rest @ inverse @ rest)
    assert [got[i].tokens for i, *_ in rows] == t.tolist()


def test_mix_edges(spark):
    docs, labels = labelled(spark, 20)
    odd = docs.unionByName(spark.createDataFrame([(None, None, 0, 0), (5, "", 0, 0), (5, "", 0, 0)], docs.schema))
    got = mixing.mix(odd, labels, F.col("kind"), {"a": 1.0, "b": 1.0})
    assert got.count() == 23
    assert got.where("rate is null or copies is null").count() == 0
    assert mixing.mix(docs.limit(0), labels, F.col("kind"), {"a": 1.0}).count() == 0
    alone = mixing.mix(docs, labels.limit(0), F.col("kind"), {"a": 1.0})
    assert {round(r.rate, 3) for r in alone.collect()} == {1.0}
