"""String similarity: trigrams and edit distance in the JVM, indel ratios in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from vacantia.functions.text import let


def spaced_words(text: Column) -> Column:
    """Words in lower case; whatever is no part of a word becomes one space."""
    return F.regexp_replace(F.lower(text), r"(?U)[^\w]+", " ")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded by two spaces before and one after."""
    words = F.filter(F.split(spaced_words(text), " "), lambda w: w != "")
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i.cast("int"), F.lit(3))))
    return F.array_distinct(F.flatten(each))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Common trigrams over all trigrams; 0 if neither text has any."""
    score = lambda p: F.when(F.size(p["x"]) + F.size(p["y"]) > 0, F.size(F.array_intersect(p["x"], p["y"])) / F.size(F.array_union(p["x"], p["y"]))).otherwise(F.lit(0.0))
    return let(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y")), score)


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the longer string."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    rows = (1 << len(a)) - 1
    state = rows
    for ch in b:
        hit = state & places.get(ch, 0)
        state = ((state + hit) | (state - hit)) & rows
    return len(a) - state.bit_count()


@lru_cache(100_000)
def ratio(a: str, b: str) -> float:
    """Indel similarity: twice the common subsequence over both lengths, 0 to 1."""
    return 2 * _lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


@lru_cache(100_000)
def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with any window of its length in the longer, ends included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    n = len(short)
    return max(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


@pandas_udf(DoubleType())
def fuzz_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def matcher_score(skill: pd.Series, label: pd.Series) -> pd.Series:
    """The matcher's score: whole strings only up to 4 characters and from 7 on; parts count for 5 and 6."""

    def one(s: str | None, t: str | None) -> float | None:
        if s is None or t is None:
            return None
        whole = ratio(s.lower(), t.lower())
        return max(whole, partial_ratio(s.lower(), t.lower())) if 5 <= len(s) <= 6 and len(t) > len(s) else whole

    return pd.Series([one(x, y) for x, y in zip(skill, label, strict=True)], dtype="float64")


def substring_confidence(skill: Column, label: Column) -> Column:
    """Ladder of confidence for a skill inside a label; the order of the steps matters."""
    s, t = F.lower(skill), F.lower(label)
    words = F.split(F.trim(t), r"\s+")
    return (
        F.when(F.startswith(t, F.concat(s, F.lit(" "))) | F.startswith(t, F.concat(s, F.lit("("))), 0.95)
        .when(F.array_contains(words, s), F.when(words[0] == s, 0.92).otherwise(0.88))
        .when(F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), s, F.lit(" "))), 0.85)
        .when(F.startswith(t, s), 0.87)
        .when(F.contains(t, s), 0.80)
        .otherwise(0.0)
    )
