"""Readers, pages and the CSV sink."""

import io
import json
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodeweave import api
from lodeweave.functions import html
from lodeweave.sources import readers, workbooks

ROOT = Path(__file__).resolve().parents[1]


def test_csv_constraints_and_implicit(spark, tmp_path):
    (tmp_path / "t.csv").write_text("date,city,v\n2018-01-01 00:00:00,a,1\n2018-02-01 00:00:00,b,2\n2018-03-01 00:00:00,a,3\n")
    d = {"materialization": {"source": "general", "arguments": {"url": str(tmp_path / "t.csv")}}, "implicit_variables": [{"name": "unit", "value": "mm"}, {"value": None}]}
    df = readers.load(spark, d, {"named_entity": {"1": ["a"]}, "date_range": {"start": "2018-01-15"}}, variables=[0, 2])
    assert df.columns == ["date", "v", "unit"] and [(r.v, r.unit) for r in df.collect()] == [(3, "mm")]
    with pytest.raises(ValueError):
        readers.load(spark, {"materialization": {"source": "os", "arguments": {}}})


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id"), F.lit("x").alias("c")).write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    text = df.where(readers.constraint(df, {"named_entity": {1: ["x", "y"]}})).select("c")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(c, [x,y])]" in text.replace("IsNotNull(c), ", "") and "ReadSchema: struct<c:string>" in text


def test_json_flatten(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"a": {"b": 1, "c": [1, 2]}, "d": "x"}, {"a": {"b": 2, "c": [3]}, "d": None}]))
    df = readers.read_json(spark, str(tmp_path / "t.json"))
    assert sorted(df.columns) == ["a.b", "a.c.0", "a.c.1", "d"]
    assert sorted((r["a.b"], r["a.c.0"], r["a.c.1"]) for r in df.collect()) == [(1, 1, 2), (2, 3, None)]


PAGE = """<html><head><title> A page </title><meta name="description" content="of tables"></head><body>
<a href="/d/one.csv">Prices</a><a href="http://h.org/two.pdf">Two</a><a href="three.xlsx">download data</a><a>none</a>
<table><tr><th>Surface</th><th>Albedo</th></tr><tr><td>Ice</td><td>0.5</td></tr><tr><td>Sand</td></tr></table><table><tr><td>1</td></tr></table></body></html>"""


def test_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, PAGE, "http://h.org/p/"), (2, PAGE, None), (3, None, None)], "page_id long, html string, url string")
    got = {(r.page_id, r.text, r.href) for r in html.links(pages).collect()}
    assert (1, "Prices", "http://h.org/d/one.csv") in got and (2, "Two", "http://h.org/two.pdf") in got and not any(p == 2 and t == "Prices" for p, t, _ in got)
    assert pages.select(html.description(F.col("html"))).first()[0] == "A page\nof tables"
    assert sorted((r.title, r.url) for r in api.describe_links(pages).collect()) == [("Prices", "http://h.org/d/one.csv"), ("three.xlsx", "http://h.org/p/three.xlsx")]
    (tmp_path / "p.html").write_text(PAGE)
    table = readers.READERS["general"](spark, url=str(tmp_path / "p.html"))
    assert table.columns == ["Surface", "Albedo"] and [tuple(r) for r in table.collect()] == [("Ice", "0.5"), ("Sand", "")]
    assert readers.read_html(spark, str(tmp_path / "p.html"), index=1).columns == ["0"]


def test_links_of_bare_pages(spark):
    page = "<a href='r?u=http://y'>One</a><p><a href='/b'>Two<a>none</a><a href>Three</a> <a href='ftp://x/z'>Fo&amp;ur"
    assert html.parse_links(page, "http://h.org/p/q") == [("One", "http://h.org/p/r?u=http://y"), ("Two", "http://h.org/b"), ("Three", "http://h.org/p/q"), ("Fo&ur", "ftp://x/z")]
    assert html.parse_links(page, None) == [("Fo&ur", "ftp://x/z")] and html.parse_links(None, None) == []
    pages = spark.createDataFrame([("<title>A &amp;lt; b</title><META content='x, y' lang=en Name=description>",), ("<meta name='keywords' content='k'><meta data-name='description' content='c'>",), (None,)], "html string")
    assert [r[0] for r in pages.select(html.description(F.col("html"))).collect()] == ["A &lt; b\nx, y", "", ""]


def test_links_need_no_code_on_the_executors(tmp_path):
    code = f"""
import sys; sys.path.append({str(ROOT)!r})
from pyspark.sql import SparkSession
from lodeweave.functions import html
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
pages = spark.createDataFrame([(1, "<a href='/b'>Two</a>", "http://h.org/p")], "page_id long, html string, url string")
assert [tuple(r) for r in html.links(pages).collect()] == [(1, "Two", "http://h.org/b")]
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.parametrize("url,valid", [("http://a.example.com/x?y=1", True), ("ftp://localhost:21/", True), ("https://10.0.0.1/a", True), ("gopher://a.com", False), ("http://nodot", False), (None, False)])
def test_urls(spark, url, valid):
    assert spark.createDataFrame([(url,)], "u string").select(html.url_valid(F.col("u"))).first()[0] is valid


def workbook(rows):
    cell = lambda c, r, v: "" if v is None else f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{i}">' + "".join(cell(c, i, v) for c, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_excel_header_and_footer(spark, tmp_path):
    rows = [["Title", None, None], [None, None, None], ["a", "b", "c"], ["1", "2", "3"], ["4", None, "6"], ["source: x", None, None]]
    (tmp_path / "t.xlsx").write_bytes(workbook(rows))
    df = readers.read_general(spark, str(tmp_path / "t.xlsx"))
    assert df.columns == ["a", "b", "c"] and [tuple(r) for r in df.collect()] == [("1", "2", "3"), ("4", None, "6")]
    told = workbooks.tabular(workbooks.read(spark, str(tmp_path / "t.xlsx"))).orderBy("row").collect()
    assert [(r.row, r.kind, r.cells[0]) for r in told] == [(0, "above", "Title"), (2, "header", "a"), (3, "data", "1"), (4, "data", "4"), (5, "below", "source: x")]
    (tmp_path / "e.xlsx").write_bytes(workbook([[None]]))
    assert readers.read_excel(spark, str(tmp_path / "e.xlsx")).columns == []
    with pytest.raises(ValueError, match="old binary"):
        readers.read_general(spark, "/none/t.xls")


def test_workbooks_of_a_folder(spark, tmp_path):
    """Shared texts, several sheets in an order of their own, gaps, and a folder of files."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"b{k}.xlsx", "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Last" sheetId="9" r:id="rId9"/><sheet name="First" sheetId="1" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/a.xml"/><Relationship Id="rId9" Target="/xl/worksheets/z.xml"/></Relationships>')
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>shared </t></si><si><r><t>in </t></r><r><t>runs</t></r><rPh><t>no</t></rPh></si></sst>")
            z.writestr("xl/worksheets/a.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="AA2"><v>{k}</v></c></row><row r="3"/><row r="7"><c><v>1.5</v></c><c t="s"><v>0</v></c></row></sheetData></worksheet>')
            z.writestr("xl/worksheets/z.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    got = sorted((r.path[-7:], r.sheet, r.name, r.row, r.cells) for r in workbooks.read(spark, str(tmp_path)).collect())
    assert got == [(f"b{k}.xlsx", 1, "First", i, c) for k in range(3) for i, c in ((1, [None, "in runs", *[None] * 24, str(k)]), (6, ["1.5", "shared "]))]
    assert readers.n_parts(spark, str(tmp_path / "b0.xlsx")) == 2 and workbooks.read(spark, str(tmp_path), 0).count() == 0


def test_written_workbooks_come_back(spark):
    rows = [("x", i, "a<b> & c " if i % 2 else None, f"{i}") for i in range(30)] + [("y", 1, "\u00e9", "z")]
    df = spark.createDataFrame(rows, "book string, n long, s string, t string")
    back = workbooks.tabular(workbooks.rows(workbooks.packed(df, "book", "n", "Title"))).collect()
    assert sorted((r.path, *r.cells) for r in back if r.kind == "data") == sorted((b, str(n), s, t) for b, n, s, t in rows)
    assert {tuple(r.cells) for r in back if r.kind == "header"} == {("n", "s", "t")} and sum(r.kind == "above" for r in back) == 2
    assert [workbooks._column(workbooks._cell(i, 1, "v").split('"')[1]) for i in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]


def test_tables_of_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, PAGE), (2, '<table id="t" class="a b"><tr><td>1<td>2</table><table class="b"><tr><th>h</th></tr></table>'), (3, ""), (4, None)], "page_id long, html string")
    flat = lambda selector: sorted((r.page_id, r.table, r.row, r.header, r.cells) for r in html.tables(pages, selector=selector).collect())
    every = flat(None)
    assert every[:3] == [(1, 0, 0, True, ["Surface", "Albedo"]), (1, 0, 1, False, ["Ice", "0.5"]), (1, 0, 2, False, ["Sand"])] and {r[0] for r in every} == {1, 2}
    assert flat("1") == flat("//table[2]") == [r for r in every if r[1] == 1] and flat("#t") == flat('//table[@id="t"]') == [r for r in every if r[:2] == (2, 0)]
    assert flat(".b") == [r for r in every if r[0] == 2] and flat("//table") == every
    with pytest.raises(ValueError):
        html.chooses("div > table", 0, {})
    html.register(spark)
    pages.createOrReplaceTempView("some_pages")
    assert spark.sql("SELECT page_id, t.cells FROM some_pages, LATERAL page_tables(html, '0') t WHERE t.row = 1").collect()[0].cells == ["Ice", "0.5"]
    for i in (1, 2):
        (tmp_path / f"p{i}.html").write_bytes(PAGE.encode() + b"\xff")
    both = readers.read_html(spark, str(tmp_path), xpath="//table[1]")
    assert both.columns == ["Surface", "Albedo"] and [tuple(r) for r in both.collect()] == [("Ice", "0.5"), ("Sand", "")] * 2


def test_transforms(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", None, 4)], "k string, c string, n long")
    assert {r.k: r.c for r in readers.sets_by_key(df, "k", ["c"]).collect()} == {"a": "x;y", "b": ""}
    assert {r.k: (r.x, r.y) for r in readers.pivoted(df, "k", "c", "n", ["x", "y"]).collect()} == {"a": (1, 2), "b": (None, None)}
    assert [r.c for r in readers.filled_down(df.where("k = 'a'").withColumn("c", F.when(F.col("n") < 2, F.col("c"))), "n", ["c"], "k").orderBy("n").collect()] == ["x"] * 3
    assert readers.declared(df, ["n", "zz"]).columns == ["n", "zz"]
    assert readers.unique_names(["x", "y", "x", "x"]) == ["x", "y", "x.1", "x.2"] and readers.unique_names(["x", "x", "x.1", ""]) == ["x", "x.2", "x.1", ""]
    assert readers.write_csv(df, f"{tmp_path}/out") == "Success" and spark.read.csv(f"{tmp_path}/out", header=True).count() == 4
    assert readers.write_csv(df, "nofs://x/y").startswith("Failed: ")


def test_user_data(spark, tmp_path):
    (tmp_path / "tables").mkdir()
    (tmp_path / "tables" / "learningData.csv").write_text("a,b\n1,2\n")
    (tmp_path / "datasetDoc.json").write_text(json.dumps({"dataResources": [{"resID": "0", "resPath": "none"}, {"resID": "learningData", "resPath": "tables/learningData.csv"}]}))
    assert readers.load_user(spark, str(tmp_path)).columns == ["a", "b"]
    df = spark.range(1)
    assert readers.load_user(spark, df) is df
    assert api.describe_url(spark, str(tmp_path / "tables" / "learningData.csv"))["title"] == "learningData"
    with pytest.raises(ValueError):
        api.describe_url(spark, "http://x/y.pdf")
