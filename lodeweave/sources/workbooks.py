"""Workbooks (.xlsx) as rows: a task for each sheet, rows streamed from its XML (S-07, S-08, S-16).

Files are read by Spark, from any store it knows. A file is opened once to deal out its sheets, packed as they are, with the texts
that its sheets share; sheets are then read wherever there is room. The driver sees none of them.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.session import ship

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of an Arrow batch.
_ROWS = 2000
SHEET = "path string, sheet int, name string, packed binary"
ROW = "path string, sheet int, name string, row int, cells array<string>"


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and member of each sheet, in the workbook's order."""
    found = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in book.namelist() else {}
    out = []
    for i, s in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")):
        target = found.get(s.get(_REL)) or f"worksheets/sheet{i + 1}.xml"
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")))
    return out


def _packed(book: zipfile.ZipFile, member: str) -> bytes:
    """A workbook with one sheet and the shared texts, as a zip file of its own."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, source in (("sheet", member), ("shared", "xl/sharedStrings.xml")):
            if source in book.namelist():
                with book.open(source) as f, z.open(name, "w") as g:
                    while part := f.read(1 << 20):
                        g.write(part)
    return out.getvalue()


def _column(ref: str) -> int:
    at = 0
    for ch in filter(str.isalpha, ref):
        at = at * 26 + ord(ch.upper()) - 64
    return at - 1


def _text(node) -> str:
    """The runs of a text, without its phonetic guides."""
    return "".join(t.text or "" for child in node if child.tag != f"{_NS}rPh" for t in child.iter(f"{_NS}t"))


def _rows(packed: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row from 0, its cells) of a sheet; an element is let go once it is read."""
    with zipfile.ZipFile(io.BytesIO(packed)) as z:
        shared = []
        if "shared" in z.namelist():
            with z.open("shared") as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{_NS}si":
                        shared.append(_text(node))
                        node.clear()
        if "sheet" not in z.namelist():
            return
        with z.open("sheet") as f:
            at = -1
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{_NS}row":
                    continue
                at = int(node.get("r", at + 2)) - 1
                cells: dict[int, str | None] = {}
                for c in node.iter(f"{_NS}c"):
                    place = _column(c.get("r")) if c.get("r") else max(cells, default=-1) + 1
                    inline, value = c.find(f"{_NS}is"), c.find(f"{_NS}v")
                    text = _text(inline) if inline is not None else value.text if value is not None else None
                    cells[place] = shared[int(text)] if c.get("t") == "s" and text is not None else text
                node.clear()
                if cells:
                    yield at, [cells.get(i) for i in range(max(cells) + 1)]


def sheets(files: DataFrame) -> DataFrame:
    """SHEET of every sheet of workbooks (path, content); files that aren't workbooks raise zipfile.BadZipFile in their task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as book:
                    for i, (name, member) in enumerate(_sheets(book)):
                        yield pa.RecordBatch.from_pylist([{"path": path, "sheet": i, "name": name, "packed": _packed(book, member)}], pa.schema([("path", pa.string()), ("sheet", pa.int32()), ("name", pa.string()), ("packed", pa.binary())]))

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, SHEET)


def rows(files: DataFrame, sheet: int | None = None) -> DataFrame:
    """ROW of workbooks (path, content): every sheet, or the one at a place from 0; rows without cells are left out."""
    dealt = sheets(files)
    if sheet is not None:
        dealt = dealt.where(F.col("sheet") == sheet)
    schema = pa.schema([("path", pa.string()), ("sheet", pa.int32()), ("name", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, number, name = (batch.column(c)[i].as_py() for c in range(3))
                held = []
                for at, cells in _rows(batch.column(3)[i].as_py()):
                    held.append({"path": path, "sheet": number, "name": name, "row": at, "cells": cells})
                    if len(held) == _ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema)

    return dealt.repartition("path", "sheet").mapInArrow(run, ROW)


def read(spark: SparkSession, url: str, sheet: int | None = None) -> DataFrame:
    """ROW of the workbooks at a path, a pattern or in a folder."""
    return rows(spark.read.format("binaryFile").load(url).select("path", "content"), sheet)


def tabular(cells: DataFrame) -> DataFrame:
    """S-08, S-16: (path, sheet, name, row, kind, cells) of ROW: which rows are the header, data, or remarks above and below.

    Columns without a value in a sheet are left out. Rows with more than half of the remaining cells empty are remarks as long as
    no other row has come, or none comes any more; the first that isn't one is the header.
    """
    key = ["path", "sheet"]
    full = cells.where(F.exists("cells", lambda x: x.isNotNull()))
    used = full.select(*key, F.posexplode("cells").alias("at", "x")).where("x is not null").groupBy(*key).agg(F.array_sort(F.collect_set("at")).alias("used"))  # a number for each column
    kept = full.join(used, key).withColumn("cells", F.transform("used", lambda i: F.get("cells", i))).drop("used")
    good = kept.withColumn("good", F.size(F.filter("cells", lambda x: x.isNull())) <= F.size("cells") / 2)
    ends = good.groupBy(*key).agg(F.min(F.when(F.col("good"), F.col("row"))).alias("first"), F.max(F.when(F.col("good"), F.col("row"))).alias("last"))
    at = F.col("row")
    kind = F.when(F.col("first").isNull() | (at < F.col("first")), "above").when(at == F.col("first"), "header").when(at <= F.col("last"), "data").otherwise("below")
    return good.join(ends, key).select(*key, "name", "row", kind.alias("kind"), "cells")


def _cell(place: int, row: int, value: object) -> str:
    letters, k = "", place + 1
    while k:
        k, rest = divmod(k - 1, 26)
        letters = chr(65 + rest) + letters
    return "" if value is None else f'<c r="{letters}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def written(lines: list[list]) -> bytes:
    """A workbook of one sheet with these rows, all cells texts."""
    ns = f'xmlns="{_NS[1:-1]}"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Sheet1" sheetId="1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f"<worksheet {ns}><sheetData>".encode())
            for i, line in enumerate(lines, 1):
                f.write(f'<row r="{i}">{"".join(_cell(c, i, v) for c, v in enumerate(line))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def packed(df: DataFrame, by: str, order: str, title: str | None = None) -> DataFrame:
    """(path, content): a workbook for each value of a column, which is its path, with the other columns as a table below a title; a workbook's rows are made in one task."""
    columns = [c for c in df.columns if c != by]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        body = [[None if pd.isna(x) else x for x in r] for r in frame[columns].itertuples(index=False)]
        lines = [*([[title], []] if title else []), columns, *body]
        return pd.DataFrame({"path": [str(frame[by].iloc[0])], "content": [written(lines)]})

    ship(df.sparkSession)
    return df.groupBy(by).applyInPandas(run, "path string, content binary")
