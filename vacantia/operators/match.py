"""Taxonomy matching in layers: each layer gets only what the layers before it missed.

Skills are matched once per distinct text; results join back to their occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.fuzzy import matcher_score, substring_confidence, trigram_similarity
from vacantia.functions.text import let, ngrams

MATCH = ("skill", "skill_uri", "label", "confidence", "method")

#: Thresholds of the layers.
FUZZY, FUZZY_SHORT, SUBSTRING = 0.92, 0.95, 0.85
ENHANCED_FUZZY, ENHANCED_SHORT = 0.86, 0.92


def _labels(taxonomy: DataFrame) -> DataFrame:
    """``skill_uri``, ``label``, ``key`` for every label (es and en) of the taxonomy: columns skill_uri, label."""
    return taxonomy.select("skill_uri", "label", F.lower(F.trim("label")).alias("key")).where("key <> ''")


def _best(candidates: DataFrame, method: str) -> DataFrame:
    w = Window.partitionBy("skill").orderBy(F.desc("confidence"), F.desc("starts"), "skill_uri", "label")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("skill", "skill_uri", "label", F.round("confidence", 3).alias("confidence"), F.lit(method).alias("method"))


def exact(skills: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Equal labels, whatever their case."""
    return _best(skills.withColumn("key", F.lower(F.trim("skill"))).join(_labels(taxonomy), "key").withColumns({"confidence": F.lit(1.0), "starts": F.lit(1)}), "exact")


def manual(skills: DataFrame, taxonomy: DataFrame, mapping: DataFrame) -> DataFrame:
    """``mapping``: skill, target, confidence; the target is part of a label, the shortest such label wins.

    A label that holds the target holds its first three characters, on which both sides join.
    """
    wanted = skills.join(mapping.select("skill", F.lower("target").alias("target"), "confidence").where("target <> ''"), "skill").withColumn("piece", F.substring("target", 1, 3))
    pieces = _labels(taxonomy).withColumn("t", F.col("key")).withColumn("piece", F.explode(F.expr(_pieces("array(1, 2, 3)")))).drop("t")
    found = wanted.join(pieces, "piece").where(F.contains("key", "target")).drop("piece")
    w = Window.partitionBy("skill").orderBy(F.length("key"), "skill_uri")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("skill", "skill_uri", "label", "confidence", F.lit("manual_dict").alias("method"))


def _parts(n: str, p: str) -> str:
    """SQL for the ``p`` parts that a text ``s`` of ``n`` characters is cut into, in order."""
    return f"transform(sequence(0, {p} - 1), i -> substring(s, cast({n} * i div {p} as int) + 1, cast({n} * (i + 1) div {p} - {n} * i div {p} as int)))"


def _pieces(sizes: str) -> str:
    """SQL for the distinct substrings of a text ``t`` that have one of these sizes."""
    return f"array_distinct(flatten(transform({sizes}, q -> if(q > length(t), cast(array() as array<string>), transform(sequence(1, greatest(length(t) - q + 1, 1)), i -> substring(t, i, q))))))"


def _alike(skills: DataFrame, taxonomy: DataFrame, least: float) -> DataFrame:
    """Skill and label pairs, each once, among them all that the matcher scores ``least`` or more.

    A ratio of ``least`` leaves (1 - least) of both lengths for insertions and deletions, k together. Of k + 1
    parts of the skill one then stays whole, so parts and the label's length join both sides. Skills of 5 and 6
    characters may also match a window no longer than themselves; their parts join labels of any length.
    """
    if not 0 < least <= 1:
        raise ValueError("a threshold is over 0 and at most 1")
    wide, gap = (2 - least) / least, 1 - least
    slack = lambda both: f"cast(floor({gap!r}D * ({both}) + 1e-6D) as int)"
    lengths = lambda x: f"sequence(greatest(cast(ceil({x} / {wide!r}D - 1e-6D) as int), 1), cast(floor({x} * {wide!r}D + 1e-6D) as int))"
    mids = {q for n in range(5, 13) for p in (int(gap * 2 * n + 1e-6) + 1,) for q in (n // p, -(-n // p))}  # in lower case a character may become two
    sizes = f"array_distinct(flatten(transform({lengths('m')}, n -> array(cast(n div ({slack('n + m')} + 1) as int), cast((n + {slack('n + m')}) div ({slack('n + m')} + 1) as int)))))"

    whole = f"flatten(transform({lengths('n')}, m -> transform({_parts('n', '(' + slack('n + m') + ' + 1)')}, x -> named_struct('m', m, 'k', {slack('n + m')}, 'part', x))))"
    window = f"if(length(skill) between 5 and 6, transform({_parts('n', '(' + slack('2 * n') + ' + 1)')}, x -> named_struct('m', 0, 'k', {2**30}, 'part', x)), array())"
    left = skills.select("skill", F.lower("skill").alias("s")).distinct().withColumn("n", F.length("s")).where("n > 0")
    left = left.select("skill", "s", F.explode(F.array_distinct(F.expr(f"concat({whole}, {window})"))).alias("x")).select("skill", "s", "x.*")
    pieces = f"concat(transform({_pieces(sizes)}, x -> named_struct('m', m, 'part', x)), transform({_pieces('array(' + ', '.join(map(str, sorted(mids))) + ')')}, x -> named_struct('m', 0, 'part', x)))"
    right = _labels(taxonomy).select("skill_uri", "label", F.lower("label").alias("t")).withColumn("m", F.length("t"))
    right = right.select("skill_uri", "label", "t", F.explode(F.expr(pieces)).alias("x")).select("skill_uri", "label", "t", "x.*")
    return left.join(right, ["m", "part"]).where(F.levenshtein("s", "t") <= F.col("k")).select("skill", "skill_uri", "label").distinct()


def fuzzy(skills: DataFrame, taxonomy: DataFrame, threshold: float = FUZZY, short: float = FUZZY_SHORT) -> DataFrame:
    """Best of all labels that score over the threshold (a stricter one up to four characters)."""
    scored = _alike(skills, taxonomy, min(threshold, short)).withColumn("confidence", matcher_score("skill", "label"))
    scored = scored.withColumn("starts", F.startswith(F.lower("label"), F.lower("skill")).cast("int"))
    return _best(scored.where(F.col("confidence") >= F.when(F.length("skill") <= 4, short).otherwise(threshold)), "fuzzy")


def substring(skills: DataFrame, taxonomy: DataFrame, least: float = SUBSTRING, blacklist: tuple[str, ...] = ()) -> DataFrame:
    """Best label that holds the skill, by the ladder of confidences.

    A label holds a skill only if it holds its first character trigram, so trigrams join both sides before the
    test; skills under three characters don't take part.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i.cast("int"), F.lit(3))))
    left = skills.where(F.length("skill") >= 3).withColumn("gram", F.substring(F.lower("skill"), 1, 3))
    labels = _labels(taxonomy).where(F.length("key") >= 3)
    if blacklist:
        labels = labels.where(~F.col("key").isin(*blacklist))
    found = left.join(labels.withColumn("gram", F.explode(let(F.col("key"), grams))), "gram").where(F.expr("contains(key, lower(skill))"))
    scored = found.withColumn("confidence", substring_confidence(F.col("skill"), F.col("label"))).withColumn("starts", F.startswith("key", F.lower("skill")).cast("int"))
    return _best(scored.where(F.col("confidence") >= least), "substring")


def layered(skills: DataFrame, taxonomy: DataFrame, mapping: DataFrame | None = None, enhanced: bool = False) -> DataFrame:
    """Matches of all layers; a skill that no layer matches has null uri and method ``none``.

    Exact, then fuzzy; ``enhanced`` adds the manual dictionary after exact, lowers the fuzzy thresholds and
    ends with substrings. ``skills``: column skill.
    """
    left = skills.select("skill").where("skill is not null and trim(skill) <> ''").distinct()
    layers = [exact]
    if enhanced:
        if mapping is not None:
            layers.append(lambda s, t: manual(s, t, mapping))
        layers += [lambda s, t: fuzzy(s, t, ENHANCED_FUZZY, ENHANCED_SHORT), substring]
    else:
        layers.append(fuzzy)
    out = None
    for layer in layers:
        got = layer(left, taxonomy)
        left = left.join(got.select("skill"), "skill", "left_anti")
        out = got if out is None else out.unionByName(got)
    missed = left.select("skill", F.lit(None).cast("string").alias("skill_uri"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("confidence"), F.lit("none").alias("method"))
    return out.unionByName(missed)


def coverage(matches: DataFrame) -> DataFrame:
    """Total, matched, emergent, share matched and counts by method."""
    total, hit = F.count(F.lit(1)), F.count("skill_uri")
    by = [F.count_if(F.col("method") == m).alias(m) for m in ("exact", "manual_dict", "fuzzy", "substring")]
    return matches.agg(total.alias("total"), hit.alias("matched"), (total - hit).alias("emergent"), F.round(hit * 100.0 / total, 2).alias("coverage"), *by)


def search(taxonomy: DataFrame, query: str, least: float = 0.0) -> DataFrame:
    """Labels by the largest of exact 1.0, contained 0.8 and trigram similarity, those above ``least``."""
    key, q = F.lower("label"), F.lit(query.lower())
    score = F.greatest(F.when(key == q, 1.0).otherwise(0.0), F.when(F.contains(key, q), 0.8).otherwise(0.0), trigram_similarity(key, q))
    return taxonomy.withColumn("confidence", score).where(F.col("confidence") > least)


def edit_join(left: DataFrame, right: DataFrame, most: int = 1) -> DataFrame:
    """Pairs (``a``, ``b``) of distinct strings within an edit distance; both frames have one column ``s``.

    Within distance k one of k + 1 parts of the shorter string stays whole, at most k places off, so parts and
    lengths join both sides before the distance is computed.
    """
    parts = most + 1

    def cuts(s: Column, size: Column) -> Column:
        step = lambda i: F.floor(size * i / parts).cast("int")
        return F.array(*[F.struct(F.lit(i).alias("i"), size.cast("int").alias("n"), F.substring(s, step(i) + 1, step(i + 1) - step(i)).alias("p")) for i in range(parts)])

    a = left.select(F.col("s").alias("a"), F.explode(cuts(F.col("s"), F.length("s"))).alias("k")).select("a", "k.*")
    lengths = F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda d: F.length("s") + d)
    windows = lambda n: F.flatten(F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), n.cast("int").alias("n"), F.substring(F.col("s"), F.greatest(F.floor(n * i / parts).cast("int") + 1 + d, F.lit(1)), (F.floor(n * (i + 1) / parts) - F.floor(n * i / parts)).cast("int")).alias("p")) for d in range(-most, most + 1)]) for i in range(parts)]))
    b = right.select(F.col("s").alias("b"), F.explode(F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: n >= 0), windows)))).alias("k")).select("b", "k.*")
    pairs = a.join(b, ["i", "n", "p"]).select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", most)).where("distance >= 0")


def contained(left: DataFrame, right: DataFrame, share: float = 0.7, least: int = 5) -> DataFrame:
    """Pairs (``a``, ``b``): a string of ``least`` characters or more inside another, at least a ``share`` of its length."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i.cast("int"), F.lit(3))))
    a = left.where(F.length("s") >= least).select(F.col("s").alias("a"), F.substring("s", 1, 3).alias("g"))
    b = right.where(F.length("s") >= 3).select(F.col("s").alias("b"), F.explode(let(F.col("s"), grams)).alias("g"))
    return a.join(b, "g").where("a <> b").where(F.expr("contains(b, a)") & (F.length("a") >= share * F.length("b"))).select("a", "b").distinct()


def plausible(extracted: Column, matched: Column, tech: tuple[str, ...]) -> Column:
    """False only if lengths differ fivefold, one side alone is technical and no word is shared."""
    from vacantia.functions.rules import has_any

    a, b = F.lower(extracted), F.lower(matched)
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: F.length(w) >= 2)
    extreme = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1)) < 0.2
    return F.arrays_overlap(words(a), words(b)) | ~(extreme & (has_any(a, tech) != has_any(b, tech)))


def token_ngrams(texts: DataFrame, text_col: str, most: int = 4) -> DataFrame:
    """Distinct n-grams of texts as a relation with one column ``s``."""
    return texts.select(F.explode(ngrams(F.col(text_col), most)).alias("g")).select(F.col("g.ngram").alias("s")).distinct()
