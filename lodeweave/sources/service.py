"""A service of dated readings as a Spark source (S-10, S-11): filters become requests, a task for each place and year.

    spark.read.format("readings").option("fetch", "my.module:ask").option("places", '["Rome"]').option("start", "2019-01-01").load()

``fetch`` names a function that executors call with a request (place, start, end, offset, limit, kind) and that returns the
answer's JSON: {"count": n, "results": [{"date", "station", "value"}]}. The network is its business; ``recorded`` answers from a folder that all
machines share.

What a query asks of ``city`` and ``date`` is pushed: a place that isn't asked for isn't requested, nor is a year outside the range. Spark
still checks dates, since requests are cut by days.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lodeweave.session import ship
from lodeweave.sources.remote import FIRST_DATE, PAGE

SCHEMA = "date timestamp, stationid string, city string, value double"


@dataclass
class Asked(InputPartition):
    """One place and a range of days, a year at most."""

    place: str
    start: date
    end: date


def recorded(request: dict) -> str | None:
    """The answer that a file of the folder ``path`` holds: <place>_<start>_<offset>.json; None where there is no such file."""
    file = Path(request["path"], f"{request['place']}_{request['start']}_{request['offset']}.json")
    return file.read_text() if file.exists() else None


def _day(value: object) -> date:
    return value.date() if isinstance(value, datetime) else value if isinstance(value, date) else date.fromisoformat(str(value)[:10])


def years(start: date, end: date) -> Iterator[tuple[date, date]]:
    """The days from start to end, both included, by calendar years; none if the end comes first."""
    while start <= end:
        last = min(end, date(start.year, 12, 31))
        yield start, last
        start = last + timedelta(days=1)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        module, _, name = self.options.get("fetch", f"{__name__}:recorded").partition(":")
        self.module, self.name = module, name
        self.places: list[str] = list(json.loads(self.options["places"]))
        self.start, self.end = (_day(self.options.get(k) or d) for k, d in (("start", FIRST_DATE), ("end", date.today().isoformat())))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name == "city" and isinstance(f, EqualTo):
                self.places = [p for p in self.places if p == f.value]
            elif name == "city" and isinstance(f, In):
                self.places = [p for p in self.places if p in f.value]
            else:
                if name == "date" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) and f.value is not None:
                    self.start = max(self.start, _day(f.value))
                if name == "date" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)) and f.value is not None:
                    self.end = min(self.end, _day(f.value))
                yield f

    def partitions(self) -> list[Asked]:
        return [Asked(p, a, b) for p in dict.fromkeys(self.places) for a, b in years(self.start, self.end)] or [Asked("", self.end + timedelta(days=1), self.end)]

    def read(self, partition: Asked) -> Iterator[tuple]:
        """The readings of all pages of an answer; an answer that is missing or has no results is an empty one."""
        if partition.start > partition.end:
            return
        fetch = getattr(importlib.import_module(self.module), self.name)
        limit, offset, count = int(self.options.get("limit", PAGE)), 1, 1
        while offset <= count:
            request = {"place": partition.place, "start": partition.start.isoformat(), "end": partition.end.isoformat(), "offset": offset, "limit": limit, "kind": self.options.get("kind"), "path": self.options.get("path")}
            answer = json.loads(fetch(request) or "{}")
            count = int(answer.get("count") or 0)
            for r in answer.get("results") or []:
                value = r.get("value")
                yield datetime.fromisoformat(r["date"]), r.get("station"), partition.place, None if value is None else float(value)
            offset += limit


class Readings(DataSource):
    """Options: places (a JSON list), start, end (dates), fetch, kind, limit (rows of a page), path."""

    @classmethod
    def name(cls) -> str:
        return "readings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format ``readings`` known to a session, and lets filters reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Readings)
