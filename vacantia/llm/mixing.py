"""Mixing sources to target weights by soft membership.

A naive Bayes classifier learned from a labelled table gives every document posteriors over domains. Rates
(expected copies, not negative) are then fitted by distributed projected-gradient least squares, so that
the expected tokens of each domain match the targets. DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm._util import Scratch

#: Most labelled rows that the classifier is fitted on.
MOST_LABELLED = 4000
#: Buckets that words are hashed to; every word of every document counts through its bucket.
BUCKETS = 1 << 16
#: A bucket's count in a domain is smoothed by SMOOTH; a weight whose likelihood ratio statistic is G2 is shrunk by
#: 1 - SHRINK^2 / G2; the sum of weights is divided by TEMPER, since words of a document are not independent.
SMOOTH, SHRINK, TEMPER = 0.5, 3.0, 4.0
#: Marks that may end a word and then count as a feature of their own.
MARKS = "!?%&$#*@~^|<>=+"
#: The fit ends when all domains are within MISS of the target tokens, or a step lowers the objective by less than GAIN of it.
MISS, GAIN = 2e-4, 0.01
#: Steps between two tables of rates; in between a rate is computed from the last table.
STEPS_WRITTEN = 8


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _table(values: list, kind: str) -> Column:
    """A constant array, which the optimizer folds once."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast(f"array<{kind}>")


def _sum_of(table: Column, spots: Column, start: Column) -> Column:
    """``start`` and the values of a table at some spots, counted from 1."""
    return F.aggregate(spots, start, lambda acc, x: acc + F.get(table, x - 1))


def _buckets(words: Column) -> Column:
    """Distinct buckets (1 to BUCKETS) of a document's words and of the runs of marks that words end in."""
    bucket = lambda w: (F.pmod(F.xxhash64(w), F.lit(BUCKETS)) + 1).cast("int")
    end = lambda w: F.concat(F.lit("\x01end "), F.substring(w, F.length(F.rtrim(w, F.lit(MARKS))) + 1, F.length(w)))
    marked = lambda w: F.lit(MARKS).contains(F.right(w, F.lit(1)))
    return _let(F.array_distinct(words), lambda d: F.array_distinct(F.concat(F.transform(d, bucket), F.transform(F.array_distinct(F.transform(F.filter(d, marked), end)), bucket))))


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, id_col: str, text_col: str, scratch: Scratch) -> dict:
    """Domains, log priors, the buckets with a weight and their weights by domain.

    Fitted on the ``MOST_LABELLED`` labelled rows with the smallest id hashes; of several labels of an id the
    largest domain counts. A weight is the log odds of the bucket's share of a domain's features against its
    share elsewhere, shrunk by how likely chance explains it; a bucket whose weights all shrink to zero has none.
    """
    known = labels.select(F.col(id_col).alias("_id"), domain.alias("_d")).where("_id is not null and _d is not null").groupBy("_id").agg(F.max("_d").alias("_d"))
    sizes = {r["_d"]: r["n"] for r in known.groupBy("_d").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = sorted(sizes)
    if not domains:
        return {"domains": ["all"], "prior": [0.0], "buckets": [], "weights": [[]]}
    share = min(1.0, 2.0 * MOST_LABELLED / sum(sizes.values()) + 1e-6)
    order = F.xxhash64("_id", F.lit("label"))
    picked = known.where(order / float(1 << 63) < F.lit(2.0 * share - 1.0)).orderBy(order, "_id").limit(MOST_LABELLED)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sampled = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).join(F.broadcast(picked), "_id")
    # bucket 0 counts the documents
    rows = sampled.select("_d", F.explode(F.array_append(_buckets(_words(F.col("_t"))), F.lit(0))).alias("b"))
    seen = [F.count_if(F.col("_d") == d).cast("double").alias(f"n{k}") for k, d in enumerate(domains)]
    counts = scratch.cut(rows.groupBy("b").agg(*seen), "counts")
    names = [f"n{k}" for k in range(len(domains))]
    base = counts.where("b = 0").first()
    mass = counts.where("b > 0").agg(*[F.sum(n).alias(n) for n in names]).first()
    docs_in, mass = [base[n] if base else 0.0 for n in names], [mass[n] or 0.0 for n in names]
    prior = [float(np.log((n + 0.5) / (sum(docs_in) + 0.5 * len(domains)))) for n in docs_in]
    all_of = sum((F.col(n) for n in names), F.lit(0.0))
    weights = []
    for n, own in zip(names, mass, strict=True):
        a, b, part = F.col(n), all_of - F.col(n), own / max(sum(mass), 1.0)
        odds = F.log((a + SMOOTH) / (own + 1.0)) - F.log((b + SMOOTH) / (sum(mass) - own + 1.0))
        log_ratio = lambda x, share: F.when((x > 0) & F.lit(share > 0), x * F.log(x / (all_of * share))).otherwise(0.0)
        g2 = 2.0 * (log_ratio(a, part) + log_ratio(b, 1.0 - part))
        weights.append((odds * F.greatest(F.lit(0.0), 1.0 - SHRINK**2 / F.greatest(g2, F.lit(1e-9))) / TEMPER).alias(n))
    kept = counts.where("b > 0").select("b", *weights).where(" or ".join(f"{n} <> 0" for n in names)).orderBy("b").collect()
    return {"domains": domains, "prior": prior, "buckets": [r["b"] for r in kept], "weights": [[r[n] for r in kept] for n in names]}


def memberships(docs: DataFrame, model: dict, text_col: str, columns: list[Column]) -> DataFrame:
    """``columns``, ``tokens`` and posteriors ``p0``, ``p1``, ... by domain."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = len(model["domains"])
    rows = docs.select(*columns, _words(text).alias("_w")).select("*", F.size("_w").cast("long").alias("tokens"))
    score = [F.lit(x) for x in model["prior"]]
    if model["buckets"]:
        place = np.zeros(BUCKETS + 1, np.int32)
        place[model["buckets"]] = np.arange(1, len(model["buckets"]) + 1)
        spots = _table(place[1:].tolist(), "int")
        rows = rows.withColumn("_w", F.array_sort(F.filter(F.transform(_buckets(F.col("_w")), lambda b: F.get(spots, b - 1)), lambda x: x > 0)))
        score = [_sum_of(_table([float(x) for x in w], "double"), F.col("_w"), s) for s, w in zip(score, model["weights"], strict=True)]
    rows = rows.select("*", *[s.alias(f"_s{k}") for k, s in enumerate(score)]).drop("_w")
    top = F.greatest(*[F.col(f"_s{k}") for k in range(size)]) if size > 1 else F.col("_s0")
    rows = rows.withColumns({f"_x{k}": F.exp(F.col(f"_s{k}") - top) for k in range(size)})
    total = sum((F.col(f"_x{k}") for k in range(1, size)), F.col("_x0"))
    return rows.withColumns({f"p{k}": F.col(f"_x{k}") / total for k in range(size)}).drop(*[f"_{c}{k}" for c in "sx" for k in range(size)])


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], budget: float, most: float | None, scratch: Scratch) -> DataFrame:
    """``members`` with a ``rate`` for each document.

    Least squares over documents: half of (E - G)' A^-1 (E - G), with E the expected tokens by domain, G the
    wanted ones and A the tokens shared by two domains' posteriors. In the metric of 1/tokens its gradient for
    a document is the posterior times A^-1 (E - G), its curvature is at most 1, so full steps go down, and
    the projection is a clip to [0, ``most``]. A step first tries the curvature of the documents that no bound
    holds, which is lower and needs few steps; one that doesn't go down is taken back for a full step in the fixed
    metric. Every step sums E and the curvature over all documents; the driver sees one row of domain totals.
    With ``most`` the budget is at most what the target domains have.
    """
    size = len(domains)
    p = [F.col(f"p{k}") for k in range(size)]
    gram = members.agg(F.sum("tokens").alias("n"), *[F.sum(F.col("tokens") * p[i]).alias(f"t{i}") for i in range(size)], *[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(size) for j in range(i, size)]).first()
    total = float(gram["n"] or 0)
    if not total:
        return members.withColumn("rate", F.lit(1.0))
    share = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    share /= share.sum() or 1.0
    there = np.array([gram[f"t{i}"] for i in range(size)])
    if most is not None:
        budget = min(budget, *[most * t / (s * total) for t, s in zip(there, share, strict=True) if s > 0])
    goal = share * total * budget
    a = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
    inverse = np.linalg.inv(a + 1e-9 * total * np.eye(size))

    def moved(rate: Column, step: np.ndarray) -> Column:
        to = rate - sum((x * F.lit(float(m)) for x, m in zip(p, step, strict=True)), F.lit(0.0))
        return F.greatest(F.lit(0.0), to if most is None else F.least(F.lit(float(most)), to))

    free = (F.col("rate") > 0) & (F.lit(True) if most is None else F.col("rate") < F.lit(float(most)))
    rows, rate, at, best = members, F.lit(1.0 if most is None else min(1.0, float(most))), 0, None
    while True:
        now = rows.withColumn("rate", rate)
        curved = [F.sum(F.when(free, F.col("tokens") * p[i] * p[j])).alias(f"g{i}_{j}") for i in range(size) for j in range(i, size)]
        got = now.agg(*[F.sum(F.col("tokens") * F.col("rate") * x).alias(f"e{k}") for k, x in enumerate(p)], *curved).first()
        off = np.array([got[f"e{k}"] for k in range(size)]) - goal
        worth = float(off @ inverse @ off)
        if best is not None and worth >= best[0]:
            if not best[3]:  # a full step in the fixed metric gains nothing more
                return best[1]
            rows, rate = best[1], moved(F.col("rate"), inverse @ best[2])
            best = (*best[:3], False)
            continue
        if np.abs(off).max() <= MISS * goal.sum() or best is not None and not best[3] and best[0] - worth < GAIN * best[0]:
            return now
        at += 1
        if at % STEPS_WRITTEN == 0:
            now = scratch.cut(now, f"rates{at}")
            scratch.drop(f"rates{at - STEPS_WRITTEN}")
        inner = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(size)] for i in range(size)])
        best = (worth, now, off, True)
        rows, rate = now, moved(F.col("rate"), np.linalg.inv(inner + 1e-9 * total * np.eye(size)) @ off)


def mix(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], budget: float = 1.0, id_col: str = "doc_id", text_col: str = "text", most: float | None = None) -> DataFrame:
    """Per row: id, ``tokens``, ``domain``, ``posterior`` (by domain), ``rate``, ``copies``.

    ``targets``: weights of the domains (those without one get none); ``budget``: total tokens wanted, as a
    multiple of what there is; ``most``: an upper bound of the rates. ``copies`` is the rate rounded up or
    down by a hash of the id, so copies are expected to match the rate. The memory of a task follows the
    longest text, which is read whole. Null texts count as empty and have no tokens; rows that repeat get equal
    results; null ids and extra columns do no harm; an empty table gives no rows; without any label all
    documents are one domain. Domains are few: weights of all of them are kept on the driver.
    """
    scratch = Scratch(docs.sparkSession)
    model = fit_domains(docs, labels, domain, id_col, text_col, scratch)
    rows = scratch.cut(memberships(docs, model, text_col, [F.col(id_col).alias("_id")]), "members")
    size = len(model["domains"])
    rates = fit_rates(rows, model["domains"], targets if size > 1 else {d: 1.0 for d in model["domains"]}, budget, most, scratch)
    scratch.drop("counts")
    dice = F.pmod(F.xxhash64("_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    posterior = F.array(*[F.col(f"p{k}") for k in range(size)])
    return rates.select(
        F.col("_id").alias(id_col),
        "tokens",
        F.element_at(F.array(*[F.lit(d) for d in model["domains"]]), F.array_position(posterior, F.array_max(posterior)).cast("int")).alias("domain"),
        posterior.alias("posterior"),
        "rate",
        F.floor(F.col("rate") + dice).cast("int").alias("copies"),
    )
