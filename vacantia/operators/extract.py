"""Skill extraction: regular expressions with positions, phrase dictionaries and combined pipelines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import text as T
from vacantia.operators import skill_table

#: The source system's 18 categories, and names of this package that they lack.
PATTERNS = skill_table.PATTERNS | {"plain_names": (r"\.NET", r"SQL\s+Server", "SQL")}
#: All its aliases with canonical names in lower case; ``skill_table.ALIASES`` has them as written there.
ALIASES = {"node": "node.js", "nodejs": "node.js"} | {alias: name.lower() for alias, name in skill_table.ALIASES.items()}
#: Categories whose first group is the skill, and those that bring their own edges.
CAPTURED, OWN_EDGES = ("contextualized_spanish", "bullet_point_skills"), ("bullet_point_skills",)
#: Letters that match others of the alphabet when case is ignored, though their lower case differs.
FOLDED = re.compile("[\u0130\u0131\u017f\u212a\u212b]")


def compile_patterns(patterns: dict[str, tuple[str, ...]], strict_edges: bool = False) -> list[tuple[str, re.Pattern]]:
    """Whole-word patterns. With ``strict_edges`` both ends are ``\\b``, as the source system has them, so that names
    that end in a symbol only match before a letter; otherwise no word character may touch the match."""
    edge = (r"\b", r"\b") if strict_edges else (r"(?<!\w)", r"(?!\w)")
    return [(kind, re.compile(p if kind in OWN_EDGES else f"{edge[0]}(?:{p}){edge[1]}", re.I)) for kind, ps in patterns.items() for p in ps]


def _lead(p: str) -> str:
    """The literal, in lower case, that every match of ``p`` starts with; empty if that isn't plain to see."""
    out, at, step = "", 0, re.compile(r"\\(\W)|([\w #/-])")
    while m := step.match(p, at):
        out, at = out + (m[1] or m[2]), m.end()
    return (out[:-1] if p[at : at + 1] in ("?", "*", "{") else out).lower()


def _needs(kind: str, p: str) -> tuple[frozenset, tuple[str, ...]]:
    """Words that a text must all have, and literals of which it must hold one, for ``p`` to match; empty if unknown."""
    none = frozenset(), ()
    if kind in OWN_EDGES or any(ord(c) > 255 or c == "\u00b5" for c in p):
        return none
    if re.fullmatch(r"\w+(?:(?: |\\s\+|-|\\\.|\\/)\w+)*", p):
        return frozenset(re.split(r"\\s\+|\\.|[ -]", p.lower())), ()
    group = re.match(r"\((?:\?:)?([^()?\\]+)\)(?![?*{])", p)
    rest = re.sub(r"\([^()]*\)", "", p[group.end() :] if group else p)
    if "|" in rest or "(" in rest:
        return none
    leads = tuple(_lead(x) for x in (group[1].split("|") if group else (p,)))
    return (frozenset(), leads) if all(leads) else none


@lru_cache(8)
def _table(patterns: tuple, strict_edges: bool) -> list[tuple]:
    sources = [(kind, p) for kind, ps in patterns for p in ps]
    return [(kind, compiled, *_needs(kind, p)) for (kind, p), (_, compiled) in zip(sources, compile_patterns(dict(patterns), strict_edges), strict=True)]


def _found(text: str, table: list[tuple], aliases: dict[str, str]) -> Iterator[tuple]:
    """Name, category, start and end of each skill of a text."""
    low, plain, seen = text.lower(), not FOLDED.search(text), set()
    words = set(re.findall(r"\w+", low))
    norm = lambda name: aliases.get(name.lower().strip(), name.lower().strip())
    for category, pattern, needed, any_of in table:
        if plain and (not needed <= words or (any_of and not any(x in low for x in any_of))):
            continue
        for m in pattern.finditer(text):
            group = 1 if category in CAPTURED and m.lastindex else 0
            if category == "bullet_point_skills" and not skill_table.BULLET_STOPWORDS.isdisjoint(m[group].lower().split()):
                continue
            name = norm(m[group])
            if (key := norm(name)) not in seen:
                seen.add(key)
                yield name, category, *m.span(group)


def regex_skills(docs: DataFrame, patterns: dict[str, tuple[str, ...]] = PATTERNS, aliases: dict[str, str] = ALIASES, id_col: str = "doc_id", text_col: str = "text", strict_edges: bool = False) -> DataFrame:
    """``doc_id``, ``skill_text``, ``skill_type``, ``start``, ``end``, ``context``, ``confidence``; one row per alias and document.

    The first match of a name stays, in the order of the pattern table. Null texts give no rows. A pattern is only
    tried on texts that have its words.
    """
    items = tuple((kind, tuple(ps)) for kind, ps in patterns.items())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _table(items, strict_edges)
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                for name, category, start, end in _found(text or "", table, aliases):
                    rows.append((i, name, category, start, end, text[max(0, start - 50) : end + 50].strip(), 0.8))
            yield pd.DataFrame(rows, columns=["id", "skill_text", "skill_type", "start", "end", "context", "confidence"])

    out = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInPandas(run, f"id {kind}, skill_text string, skill_type string, start int, end int, context string, confidence double")
    return out.withColumnRenamed("id", "doc_id")


def ngram_dictionary(labels: DataFrame, label_col: str = "label", id_col: str = "skill_id", most: int = 4, least: int = 3) -> DataFrame:
    """``ngram``, ``skills`` (sorted ids): the inverted index of the labels' n-grams."""
    rows = labels.select(F.col(id_col).alias("skill_id"), F.explode(T.ngrams(T.matching_form(label_col), most)).alias("g"))
    return rows.where(F.length("g.ngram") >= least).groupBy(F.col("g.ngram").alias("ngram")).agg(F.array_sort(F.collect_set("skill_id")).alias("skills"))


def dictionary_matches(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", label_id: str = "skill_id", most: int = 4, least: int = 3) -> DataFrame:
    """``doc_id``, ``skill_id``, ``ngram``, ``start``, ``end``, ``size`` for each n-gram that equals a label's matching form.

    The labels, a taxonomy that fits the memory of each executor, are broadcast, so that no other n-gram is shuffled."""
    known = labels.select(F.col(label_id).alias("skill_id"), T.matching_form(label_col).alias("ngram")).distinct()
    grams = docs.select(F.col(id_col).alias("doc_id"), F.explode(T.ngrams(T.matching_form(text_col), most)).alias("g")).select("doc_id", "g.*")
    return grams.where(F.length("ngram") >= least).join(F.broadcast(known), "ngram").select("doc_id", "skill_id", "ngram", "start", "end", "size")


def longest_per_skill(matches: DataFrame) -> DataFrame:
    """The largest n-gram by which a document matched a skill; ties by place."""
    w = Window.partitionBy("doc_id", "skill_id").orderBy(F.desc("size"), "start")
    return matches.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def combine(*methods: DataFrame) -> DataFrame:
    """Union of method results (doc_id, skill_text, method, confidence, start); the earlier method, then the earlier place stays per name."""
    out = None
    for rank, rows in enumerate(methods):
        part = rows.select("doc_id", "skill_text", "method", "confidence", "start", F.lit(rank).alias("_rank"))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("doc_id", F.lower(F.trim("skill_text"))).orderBy("_rank", "start")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def final_confidence(extraction: str = "confidence", taxonomy: str = "match_confidence") -> Column:
    return F.round(0.7 * F.col(extraction) + 0.3 * F.coalesce(F.col(taxonomy), F.lit(0.0)), 4)
