"""Readers by name, with constraints and implicit variables (S-01 to S-22; S-10, S-11, S-13 and S-14 are in ``remote``), and the CSV sink (K-01, K-05)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path
from threading import Event, Timer
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.functions import dates, html
from lodeweave.sources import workbooks

Reader = Callable[..., DataFrame]
READERS: dict[str, Reader] = {}


def reader(name: str) -> Callable[[Reader], Reader]:
    """S-01: registers a reader; only registered names are ever called."""
    def add(f: Reader) -> Reader:
        READERS[name] = f
        return f

    return add


@reader("csv")
def read_csv(spark: SparkSession, url: str, encoding: str = "UTF-8", **_) -> DataFrame:
    """S-05, S-12, S-17."""
    return spark.read.csv(url, header=True, inferSchema=True, encoding=encoding)


@reader("parquet")
def read_parquet(spark: SparkSession, url: str, **_) -> DataFrame:
    return spark.read.parquet(url)


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """S-06: nested fields as columns ``a.b``; list items as ``a.0``, as many as the longest list has."""
    while True:
        arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
        structs = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, T.StructType)}
        if not arrays and not structs:
            return df
        lengths = df.agg(*(F.coalesce(F.max(F.size(F.col(f"`{a}`"))), F.lit(0)).alias(str(i)) for i, a in enumerate(arrays))).first() if arrays else []
        longest = dict(zip(arrays, lengths))
        columns = []
        for f in df.schema:
            c = F.col(f"`{f.name}`")
            if f.name in longest:
                columns += [F.get(c, F.lit(i)).alias(f"{f.name}{separator}{i}") for i in range(max(0, longest[f.name]))]
            elif f.name in structs:
                columns += [c.getField(x).alias(f"{f.name}{separator}{x}") for x in structs[f.name].fieldNames()]
            else:
                columns.append(c)
        df = df.select(*columns)


@reader("json")
def read_json(spark: SparkSession, url: str, separator: str = ".", **_) -> DataFrame:
    return flattened(spark.read.json(url, multiLine=True), separator)


def _whole(spark: SparkSession, url: str) -> bytes:
    """One file's bytes, through Spark's file systems."""
    return bytes(spark.read.format("binaryFile").load(url).select("content").first()["content"])


def _named(names: Sequence[str]) -> list[str]:
    return unique_names([n or f"column_{i}" for i, n in enumerate(names)])


def _columns(rows: DataFrame, header: Sequence[str | None] | None, width: int) -> DataFrame:
    """Rows (cells) as text columns: named by the header, else numbered."""
    names = _named([str(c or "") for c in [*header, *[None] * (width - len(header))]]) if header is not None else [str(i) for i in range(width)]
    return rows.select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))


@reader("html")
def read_html(spark: SparkSession, url: str, index: str | int = 0, xpath: str | None = None, **_) -> DataFrame:
    """S-09, S-18: a table of a page, all columns texts, cells that a row lacks empty; chosen by place or ``xpath`` (see ``html.chooses``).

    The first matching table of each page counts. Pages are parsed by the executors; the driver gets the widest row's size and a header.
    """
    pages = spark.read.format("binaryFile").load(url).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
    rows = html.tables(pages, "path", "html", xpath or str(index))
    first = rows.groupBy("path").agg(F.min("table").alias("table"))
    rows = rows.join(first, ["path", "table"])
    found = rows.agg(F.max(F.size("cells")).alias("width"), F.min_by(F.when(F.col("header"), F.col("cells")), F.struct("path", "row")).alias("header")).first()
    width = found["width"] or 0
    header = found["header"] and [*found["header"], *(str(i) for i in range(len(found["header"]), width))]
    out = _columns(rows.where(~F.col("header")).orderBy("path", "row"), header, width)
    return out.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in out.columns))


@reader("excel")
def read_excel(spark: SparkSession, url: str, index: str | int = 0, **_) -> DataFrame:
    """S-07, S-08, S-16: a sheet of a workbook, or of each workbook that the address matches, all columns texts; names are those of the first workbook's header."""
    if url.split("?")[0].lower().endswith(".xls"):
        raise ValueError(f"{url} is a workbook of the old binary format, which isn't read; save it as .xlsx")
    rows = workbooks.tabular(workbooks.read(spark, url, int(index)))
    found = rows.agg(F.max(F.size("cells")).alias("width"), F.min_by(F.when(F.col("kind") == "header", F.col("cells")), F.when(F.col("kind") == "header", F.col("path"))).alias("header")).first()
    return _columns(rows.where("kind = 'data'").orderBy("path", "row"), found["header"] or [], found["width"] if found["header"] else 0)


def n_parts(spark: SparkSession, url: str, file_type: str | None = None) -> int | None:
    """How many tables a workbook or a page holds; None for a file that is one table."""
    kind = kind_of(url, file_type)
    files = spark.read.format("binaryFile").load(url)
    if kind == "excel":
        return workbooks.sheets(files.select("path", "content")).agg(F.coalesce(F.max("sheet") + 1, F.lit(0))).first()[0]
    return html.tables(files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("html")), "path").agg(F.coalesce(F.max("table") + 1, F.lit(0))).first()[0] if kind == "html" else None


def kind_of(url: str, file_type: str | None = None) -> str:
    """S-04: the reader of a file type or, without one that is known, of an address's suffix; else a page's."""
    return SUFFIXES.get(file_type or Path(url.split("?")[0]).suffix.lstrip(".").lower(), "html")


SUFFIXES = {"csv": "csv", "json": "json", "xls": "excel", "xlsx": "excel", "parquet": "parquet"}


@reader("general")
def read_general(spark: SparkSession, url: str, file_type: str | None = None, **arguments) -> DataFrame:
    """S-04: by file type or the address's suffix, else as a page."""
    return READERS[kind_of(url, file_type)](spark, url=url, **arguments)


def constraint(df: DataFrame, constraints: dict) -> Column:
    """Predicates that Catalyst pushes to the source: named entities by column position and a range of dates.

    Only bounds that are given filter; the range applies to the first column of times.
    """
    out = F.lit(True)
    for i, values in (constraints.get("named_entity") or {}).items():
        out = out & F.col(f"`{df.columns[int(i)]}`").isin(list(values))
    bounds = constraints.get("date_range") or {}
    times = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    if times:
        for end, test in (("start", lambda c, b: c >= b), ("end", lambda c, b: c <= b)):
            if bounds.get(end):
                out = out & test(F.col(f"`{times[0]}`"), dates.parse_date(F.lit(bounds[end])))
    return out


def with_implicit(df: DataFrame, variables: Sequence[dict]) -> DataFrame:
    """P-13: constant columns of variables that have a value, named or numbered."""
    for i, v in enumerate(variables or []):
        if v.get("value"):
            df = df.withColumn(v.get("name") or f"implicit_variable_{i}", F.lit(v["value"]))
    return df


@contextmanager
def limited(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """S-02: cancels the Spark jobs that this thread starts within the block and that run on after so many seconds.

    Jobs carry a tag of the block, also those that an action on a lazy table starts later, if it is taken within such a block; what other threads
    run, on the same table too, isn't touched. A cancelled action raises Spark's error of a cancelled job, and so does one that is begun when time is up.
    """
    if not seconds:
        yield
        return
    sc, tag, over = spark.sparkContext, f"limited-{uuid4()}", Event()

    def cancel() -> None:
        while not over.wait(0.2):  # again and again, as later jobs of the block carry the tag too
            sc.cancelJobsWithTag(tag)

    timer = Timer(seconds, cancel)
    timer.daemon = True
    sc.addJobTag(tag)
    timer.start()
    try:
        yield
    finally:
        over.set()
        timer.cancel()
        sc.removeJobTag(tag)


def implicit_metadata(description: dict, variables: Sequence[dict]) -> dict:
    """P-13: the description with a variable for each implicit one that has a value: its name, or number, and its value as the only entity."""
    made = [
        {"name": v.get("name") or f"implicit_variable_{i}", "description": f"implicit variable: {v.get('name') or i}", "semantic_type": [t] if isinstance(t := v.get("semantic_type") or [], str) else list(t), "named_entity": [str(v["value"])]}
        for i, v in enumerate(variables or [])
        if v.get("value")
    ]
    return {**description, "variables": [*(description.get("variables") or []), *made]}


def load(spark: SparkSession, description: dict, constraints: dict | None = None, variables: Sequence[int] | None = None, timeout: float | None = 900) -> DataFrame:
    """S-02, S-03: the described dataset, lazily: constrained, with the chosen columns, with implicit ones.

    What a reader must look at (a schema, one file) is cancelled after ``timeout`` seconds; what is done with the table is limited by taking
    the action within ``limited``, or by ``fetched``.
    """
    m = description["materialization"]
    if m["source"] not in READERS:
        raise ValueError(f"no reader named {m['source']}")
    with limited(spark, timeout):
        df = READERS[m["source"]](spark, **(m.get("arguments") or {}))
    if constraints:
        df = df.where(constraint(df, constraints))
    if variables is not None:
        df = df.select(*(F.col(f"`{df.columns[i]}`") for i in variables))
    return with_implicit(df, description.get("implicit_variables") or [])


def fetched(df: DataFrame, path: str, seconds: float | None = 900) -> DataFrame:
    """S-02, K-04: a lazy table as Parquet at a path, written within so many seconds or not at all."""
    with limited(df.sparkSession, seconds):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def load_user(spark: SparkSession, data: DataFrame | str) -> DataFrame:
    """S-22: a table, a CSV path, or a folder with a datasetDoc.json that names its entry table."""
    if not isinstance(data, str):
        return data
    if data.endswith(".csv"):
        return read_csv(spark, data)
    path = data if data.endswith("datasetDoc.json") else f"{data.rstrip('/')}/datasetDoc.json"
    doc = json.loads(_whole(spark, path))
    resources = doc["dataResources"]
    tagged = [r for r in resources if "https://metadata.datadrivendiscovery.org/types/DatasetEntryPoint" in (r.get("resType"), *r.get("tags", []))]
    named = [r for name in ("learningData", "0") for r in resources if r.get("resID") == name]
    entry = [*tagged, *named, *resources][0]
    return read_csv(spark, f"{path.rsplit('/', 1)[0]}/{entry['resPath']}")


def sets_by_key(df: DataFrame, key: str, columns: Sequence[str], separator: str = ";") -> DataFrame:
    """S-19, S-20: for each key the sorted distinct values of each column, joined."""
    return df.groupBy(key).agg(*(F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), separator).alias(c) for c in columns))


def pivoted(df: DataFrame, key: str, category: str, value: str, categories: Sequence[str]) -> DataFrame:
    """S-19: a column for each given category with its smallest value; given categories spare a pass."""
    return df.groupBy(key).pivot(category, list(categories)).agg(F.min(value))


def filled_down(df: DataFrame, order: str, columns: Sequence[str], by: str) -> DataFrame:
    """S-16: missing cells take the last value above, within each ``by``."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*(F.last(F.col(c), ignorenulls=True).over(w).alias(c) if c in columns else F.col(c) for c in df.columns))


def declared(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """S-15: the declared columns alone, missing ones null."""
    return df.select(*(F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names))


def unique_names(names: Sequence[str]) -> list[str]:
    """K-05: x, x.1, x.2, ...; the first keeps its name, and no made name is one that is given."""
    out: list[str] = []
    for n in names:
        free, k = n, 0
        while free in out or (k and free in names):
            k += 1
            free = f"{n}.{k}"
        out.append(free)
    return out


def write_csv(df: DataFrame, path: str) -> str:
    """K-01: "Success", or "Failed: " and why."""
    try:
        df.toDF(*unique_names(df.columns)).write.mode("overwrite").csv(path, header=True)
    except Exception as e:  # noqa: BLE001  what the sink reports, like the result, is a text
        return f"Failed: {e}"
    return "Success"
