"""Text analysis shared by profiling and search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def analyzed(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def padded(text: Column) -> Column:
    """Words joined and edged by blanks: a phrase is contained in this as a substring."""
    return F.concat(F.lit(" "), F.array_join(analyzed(text), " "), F.lit(" "))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase's words stand in the text next to each other; a phrase without words never does."""
    return (F.size(analyzed(phrase)) > 0) & F.contains(padded(text), padded(phrase))


def has_any(text: Column, query: Column) -> Column:
    """Whether any word of the query is a word of the text."""
    return F.arrays_overlap(analyzed(text), analyzed(query))


def tokens(text: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def pieces(text: Column) -> Column:
    """Tokens split at everything that is neither letter nor digit."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def is_number(text: Column) -> Column:
    """Whether the trimmed text is a decimal number; nan and inf aren't."""
    return F.coalesce(F.trim(text).rlike(NUMERIC), F.lit(False))


def number(text: Column) -> Column:
    return F.when(is_number(text), F.trim(text).try_cast("double"))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text's lower-cased letters, words parted and edged by one blank."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))
    chars = F.split(plain, "")
    # by place in a list: a substring of a text is searched for from its beginning
    behind = lambda k: F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(0)))
    both = lambda a, b: F.concat(a, b)
    runs = F.zip_with(F.zip_with(chars, behind(1), both), behind(2), both)
    return F.array_distinct(F.filter(runs, lambda x: x.isNotNull() & (x != "")))
