"""Text functions as column expressions; pandas only where no built-in has the semantics."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Entities that a chain of built-in replacements decodes; the ampersand comes last.
BASIC_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))

#: Letters with marks and the letter each stands for, in pairs.
_MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


@pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """All named and numeric entities of HTML 5."""
    return text.map(html.unescape, na_action="ignore")


def basic_unescape(c: Column | str) -> Column:
    """The common entities, without leaving the JVM."""
    out = _col(c)
    for entity, char in BASIC_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def collapse_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def remove_html(c: Column | str) -> Column:
    """Tags vanish, entities are decoded, ends are trimmed."""
    return F.trim(html_unescape(F.regexp_replace(_col(c), "<[^>]+>", "")))


def tags_to_space(c: Column | str) -> Column:
    """Entities are decoded after each tag has become a space."""
    return html_unescape(F.regexp_replace(_col(c), "<[^>]+>", " "))


def breaks_to_space(c: Column | str) -> Column:
    """Line breaks become spaces, other tags vanish, white space is folded."""
    return collapse_space(F.regexp_replace(F.regexp_replace(_col(c), r"<br ?/?>", " "), "<[^>]+>", ""))


def fold_punctuation(c: Column | str) -> Column:
    """A run of exclamation or question marks becomes its last mark."""
    return F.regexp_replace(_col(c), "([!?]){2,}", "$1")


def remove_emojis(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"[\x{10000}-\x{10FFFF}\x{2600}-\x{27BF}]", "")


def clean_text(c: Column | str) -> Column:
    return collapse_space(html_unescape(_col(c)))


def clean_title(c: Column | str) -> Column:
    return collapse_space(fold_punctuation(remove_emojis(tags_to_space(F.coalesce(_col(c), F.lit(""))))))


def clean_description(c: Column | str) -> Column:
    return collapse_space(tags_to_space(F.coalesce(_col(c), F.lit(""))))


def combined_text(*parts: Column | str) -> Column:
    """Parts that are not empty, joined by line feeds."""
    return F.concat_ws("\n", *[F.nullif(_col(p), F.lit("")) for p in parts])


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(_col(c), r"\s+"), lambda w: w != ""))


def content_hash(title: Column | str, description: Column | str, requirements: Column | str, literal_none: bool = False) -> Column:
    """SHA-256 of the three texts one after the other; a missing text is empty, or the word None if asked."""
    missing = F.lit("None" if literal_none else "")
    return F.sha2(F.concat(*[F.coalesce(_col(c), missing) for c in (title, description, requirements)]), 256)


def normalize_text(c: Column | str) -> Column:
    """Lower case, everything but letters, digits and underscores as single spaces."""
    return collapse_space(F.regexp_replace(F.lower(_col(c)), r"(?U)[^\w\s]", " "))


def dedup_key(c: Column | str) -> Column:
    """Lower case without punctuation, white space folded."""
    return collapse_space(F.regexp_replace(F.lower(_col(c)), r"(?U)[^\w\s]", ""))


def strip_marks(c: Column | str) -> Column:
    """Latin letters without their marks, inside the JVM."""
    return F.translate(_col(c), _MARKED, _PLAIN)


@pandas_udf(StringType())
def to_ascii(text: pd.Series) -> pd.Series:
    """Compatibility decomposition; what is not ASCII then goes."""
    return text.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


def matching_form(c: Column | str) -> Column:
    """Lower case, no marks, only a-z, 0-9 and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_marks(F.lower(_col(c))), "[^a-z0-9\\s]", " "), "\\s+", " "))


@pandas_udf(StringType())
def title_case(text: pd.Series) -> pd.Series:
    """Python's title case: a letter after anything that is no letter is upper case."""
    return text.map(str.title, na_action="ignore")


def plain_ngrams(tokens: Column, n: int) -> Column:
    """The ``n``-grams of an array of tokens, joined by spaces."""
    one = lambda t: lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)])
    return let(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), one(t))).otherwise(F.array().cast("array<string>")))


def ngrams(c: Column, most: int) -> Column:
    """Structs (ngram, start, end, size) of all token n-grams of a text with single spaces."""

    def of(tokens: Column, n: int) -> Column:
        one = lambda i: F.struct(F.array_join(F.slice(tokens, i + 1, F.lit(n)), " ").alias("ngram"), i.cast("int").alias("start"), (i + n - 1).cast("int").alias("end"), F.lit(n).alias("size"))
        return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), one)).otherwise(F.array().cast("array<struct<ngram:string,start:int,end:int,size:int>>"))

    return let(F.filter(F.split(c, " "), lambda w: w != ""), lambda tokens: F.flatten(F.array(*[of(tokens, n) for n in range(1, most + 1)])))


def context(text: Column, start: Column, length: Column, window: int = 50) -> Column:
    """What stands around a match at 0-based ``start``."""
    low = F.greatest(start - window, F.lit(0))
    return F.trim(F.substring(text, (low + 1).cast("int"), (start + length + window - low).cast("int")))
