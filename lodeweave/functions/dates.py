"""Dates in free text, by a fixed list of formats: no Python on the executors, no guessing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark pattern and strptime pattern of each accepted format, tried in this order.
FORMATS = (
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSS", "%Y-%m-%dT%H:%M:%S.%g"),
    ("MM-dd-yyyy", "%m-%d-%Y"),
    ("MM/dd/yyyy", "%m/%d/%Y"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("MMM d, yyyy", "%b %d, %Y"),
    ("d MMM yyyy", "%d %b %Y"),
)


def shape(pattern: str) -> str:
    """A regular expression that every text in the format matches: a failing parse costs far more than a failing match."""
    out, i = "(?i)^", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "'":
            end = pattern.index("'", i + 1)
            out += re.escape(pattern[i + 1 : end])
            i = end + 1
            continue
        n = 1
        while c.isalpha() and i + n < len(pattern) and pattern[i + n] == c:
            n += 1
        out += {"y": r"[+-]?\d+", "M": r"\d+" if n < 3 else r"\p{L}+\.?"}.get(c, r"\d+") if c.isalpha() else re.escape(c)
        i += n
    return out + "$"


def parse_date(text: Column) -> Column:
    """Timestamp of a text in one of FORMATS, else null."""
    return F.coalesce(*(F.try_to_timestamp(F.when(text.rlike(shape(f)), text), F.lit(f)) for f, _ in FORMATS))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def validate_date(text: Column) -> Column:
    """ISO-8601 text of a date, null if it isn't one (P-12)."""
    return iso(parse_date(text))
