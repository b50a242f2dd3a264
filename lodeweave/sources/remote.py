"""What remote sources need besides a network: addresses to ask, and tables of what they answer (S-10, S-11, S-13, S-14).

Requests are rows, so that whoever fetches them may do so from many tasks; responses come back as rows of
JSON texts and become tables by DataFrame functions alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.functions import dates
from lodeweave.sources.readers import reader

#: What the sources' services expect.
PAGE = 1000
FIRST_DATE = "1800-01-01"


def year_chunks(start: Column, end: Column) -> Column:
    """S-10: a list of (start, end) dates of a year at most that cover a range; a range without length, or one that ends early, is one chunk."""
    first, last = start.cast("date"), end.cast("date")
    years = F.sequence(F.lit(0), F.greatest(F.year(last) - F.year(first), F.lit(0)))
    cut = lambda k: F.add_months(first, (k * 12).cast("int"))
    chunks = F.transform(years, lambda k: F.struct(cut(k).alias("start"), F.when(cut(k + 1) < last, cut(k + 1)).otherwise(last).alias("end"), k.alias("k")))
    used = F.filter(chunks, lambda c: (c["k"] == 0) | (c["start"] < last))
    return F.transform(used, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))


def offsets(count: Column, limit: int = PAGE) -> Column:
    """S-10: first rows (from 1) of the pages that an answer of ``count`` rows comes in; an empty answer is one page."""
    return F.sequence(F.lit(1).cast("bigint"), F.greatest(count.cast("bigint"), F.lit(1).cast("bigint")), F.lit(limit).cast("bigint"))


def common_station(seen: DataFrame, by: str = "location") -> DataFrame:
    """S-10: (by, station): for each place the station to ask.

    seen (by, station, at_end, place): stations that answered for the first day (at_end false) or the last
    one, in order of ``place``. The first of the last day's that has the first day too is taken, else the last
    day's first, else the first day's first; a place without stations has no row. Repeated rows change nothing.
    """
    of = seen.where("station is not null").groupBy(by, "station").agg(F.min(F.when(F.col("at_end"), F.col("place"))).alias("e"), F.min(F.when(~F.col("at_end"), F.col("place"))).alias("s"))
    rank = F.when(F.col("e").isNotNull() & F.col("s").isNotNull(), 0).when(F.col("e").isNotNull(), 1).otherwise(2)
    return of.groupBy(by).agg(F.min(F.struct(rank.alias("rank"), F.coalesce("e", "s").alias("place"), "station"))["station"].alias("station"))


_READINGS = T.ArrayType(T.StructType([T.StructField("date", T.StringType()), T.StructField("station", T.StringType()), T.StructField("value", T.DoubleType())]))


def readings(responses: DataFrame, data_type: str) -> DataFrame:
    """S-10: (date, stationid, city, <data_type>) of responses (city, body); bodies without results give no rows."""
    rows = responses.select("city", F.explode(F.from_json(F.get_json_object("body", "$.results"), _READINGS)).alias("r"))
    return rows.select("r.date", F.col("r.station").alias("stationid"), "city", F.col("r.value").alias(data_type))


def country_requests(spark: SparkSession, address: str, indicator: str, locations: Sequence[str] | None, ids: dict[str, str], constraints: dict | None = None) -> DataFrame:
    """S-11: (location, url): a request for each known country, or one for all where none is given; years only if both ends are.

    Locations without an id are left out. ``address`` is the service's root.
    """
    bounds = (constraints or {}).get("date_range") or {}
    years = f"&date={bounds['start'][:4]}:{bounds['end'][:4]}" if bounds.get("start") and bounds.get("end") else ""
    asked = [(x, ids[x]) for x in locations if x in ids] if locations else [(None, "ALL")]
    rows = [(x, f"{address.rstrip('/')}/countries/{i}/indicators/{indicator}?format=json{years}") for x, i in asked]
    return spark.createDataFrame(rows, "location string, url string")


def paged_union(responses: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """S-11: rows of all pages as one table with the other columns kept; a body is a pair of remarks on the page and a list of rows.

    The schema names the rows' fields, nested ones too; pages that aren't such pairs give no rows.
    """
    rest = [F.col(f"`{c}`") for c in responses.columns if c != body]
    rows = responses.select(*rest, F.explode(F.from_json(F.get_json_object(body, "$[1]"), f"array<struct<{schema}>>")).alias("_r"))
    return rows.select(*rest, "_r.*")


def dated_address(address: str, constraints: dict | None = None, today: date | None = None) -> str:
    """S-13: an address whose second part is the range of dates asked for: from FIRST_DATE, to today, unless given."""
    bounds = (constraints or {}).get("date_range") or {}
    head, *rest = address.split("&")
    asked = f"d1={bounds.get('start') or FIRST_DATE}&d2={bounds.get('end') or (today or date.today()).isoformat()}"
    return "&".join([head, asked, *rest[1:]])


@reader("jdbc")
def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """S-14: a table of a database, lazily; partitioned reads take Spark's own options (partitionColumn, lowerBound, ...)."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def of_years(df: DataFrame, constraints: dict | None = None, place: int = 0, year: int = 3, width: int = 5) -> DataFrame:
    """S-14: the first ``width`` columns of rows whose year is in the range and whose place is among the named ones; filters reach the source.

    Ends, or places, that aren't given ask nothing; ends are dates or years, and ends that are neither ask nothing.
    """
    c = constraints or {}
    at, when = F.col(f"`{df.columns[place]}`"), F.col(f"`{df.columns[year]}`")
    bounds = c.get("date_range") or {}
    for end, test in (("start", lambda x, y: x >= y), ("end", lambda x, y: x <= y)):
        if bounds.get(end):
            given = F.lit(str(bounds[end]))
            wanted = F.coalesce(F.year(dates.parse_date(given)), given.try_cast("int"))
            df = df.where(wanted.isNull() | test(when, wanted))
    names = (c.get("named_entity") or {}).get(place)
    if names:
        df = df.where(at.isin(list(names)))
    return df.select(*(F.col(f"`{n}`") for n in df.columns[:width]))
