"""Hits and their tables, remote sources' transforms, generators."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lodeweave import api
from lodeweave.operators import catalog as store
from lodeweave.operators import generators
from lodeweave.plans import datasets, dsl
from lodeweave.sources import readers, remote


def _catalog(spark, tmp_path, n=3):
    (tmp_path / "t.csv").write_text("when,city,v\n2018-01-01,Oslo,1\n2018-02-01,Rome,2\n2018-03-01,Oslo,3\n")
    m = {"source": "general", "arguments": {"url": str(tmp_path / "t.csv")}}
    return store.documents(spark, [{"dataset_id": i * store.STEP, "title": f"t{i}", "keywords": [f"k{i}"], "materialization": m, "variables": [{"dataset_id": i * store.STEP + 1, "name": "when"}, {"dataset_id": i * store.STEP + 2, "name": "city", "named_entity": ["Oslo", "Rome"][: i + 1]}]} for i in range(n)])


def test_keyword_arguments(spark, tmp_path):
    c = _catalog(spark, tmp_path)
    ids = lambda df: sorted(r.dataset_id for r in df.collect())
    assert ids(datasets.query(c)) == [0, 10_000, 20_000]
    assert ids(datasets.query(c, dataset_id=0)) == [0] and ids(datasets.query(c, variable_id=10_002)) == [10_000]
    terms = spark.createDataFrame([("Oslo",), ("Rome",), (None,)], "term string")
    assert sorted((r.dataset_id, r.score) for r in datasets.query(c, terms, 0.9).collect()) == [(10_000, 3.0), (20_000, 3.0)]
    assert ids(datasets.query(c, terms, 0.5, key_values=[("keywords", "k0")])) == [0]
    assert ids(datasets.query(c, terms.limit(0))) == []


def test_best_of_each_column(spark, tmp_path):
    c = _catalog(spark, tmp_path)
    data = spark.createDataFrame([(1, "Oslo"), (2, "Rome"), (3, None)], "n int, city string")
    got = datasets.search_columns(c, data, columns=["city"], best=2).collect()
    assert sorted((r.column_idx, r.dataset_id, r.n_terms, r["rank"]) for r in got) == [(1, 10_000, 2, 1), (1, 20_000, 2, 2)]
    assert datasets.search_columns(c, data, columns=[]).count() == 0


def test_table_of_a_hit(spark, tmp_path):
    c = _catalog(spark, tmp_path)
    assert datasets.load_by_id(c, 10_000).count() == 3 and datasets.load_by_id(c, 10_000, head=2).count() == 2
    with pytest.raises(KeyError):
        datasets.load_by_id(c, 5)
    doc = datasets.described(c, 0)
    first = datasets.cached(spark, doc, f"{tmp_path}/cache").count()
    (tmp_path / "t.csv").write_text("when,city,v\n")
    assert first == 3 == datasets.cached(spark, doc, f"{tmp_path}/cache").count()


def test_profiled_anew(spark, tmp_path):
    c = _catalog(spark, tmp_path)
    new = datasets.described(api.refreshed(c, 0), 0)
    assert new["keywords"] == ["k0"] and new["variables"][1]["named_entity"] == ["Oslo", "Rome"] and [v["dataset_id"] for v in new["variables"]] == [1, 2, 3]
    assert api.refreshed(c, 0).count() == 3


def test_join_indices_and_summary(spark):
    left = spark.range(1).select("id", F.lit("x").alias("city"))
    variables = [{"name": "a"}, {"name": "town", "named_entity": ["p", "q", "r", "s"]}]
    assert datasets.join_indices(left, variables, [["city"], [0]], [["town"], [0]]) == ([[1], [0]], [[1], [0]])
    with pytest.raises(ValueError):
        datasets.join_indices(left, variables, [["city"]], [])
    text = datasets.summary({"dataset_id": 7, "title": "T", "variables": variables}, [[1]], [[1]])
    assert "[1] town (p, q, r ...)" in text and "[1] <-> [1]" in text and "None" in datasets.summary({"variables": []})
    many = datasets.summary({"variables": [{"name": f"c{i}"} for i in range(12)]})
    assert "[4] c4" in many and "c5" not in many and "c6" not in many and "[7] c7" in many


def test_constrained_join(spark, tmp_path):
    c = _catalog(spark, tmp_path)
    left = spark.createDataFrame([("Oslo", datetime(2018, 1, 1)), ("Oslo", datetime(2018, 2, 15)), ("Bonn", datetime(2018, 1, 5))], "town string, day timestamp")
    got = datasets.constrained_join(left, datasets.described(c, 0), {1: ["Oslo"]}, [0], [1]).collect()
    assert sorted((r.town, r.v) for r in got if r.v is not None) == [("Oslo", 1), ("Oslo", 1)] and sum(r.town == "Bonn" for r in got) == 1
    with pytest.raises(ValueError):
        datasets.constrained_join(left, datasets.described(c, 0), {}, [0], [1])


def test_catalog_tables(spark, tmp_path):
    assert store.create(spark, "kept_catalog", f"{tmp_path}/c") and not store.create(spark, "kept_catalog") and store.exists(spark, "kept_catalog")
    assert spark.table("kept_catalog").count() == 0 and spark.table("kept_catalog").columns == store.SCHEMA.names
    assert store.drop(spark, "kept_catalog") and not store.exists(spark, "kept_catalog") and not store.drop(spark, "kept_catalog")


def test_hits_without_a_page(spark, tmp_path):
    c = _catalog(spark, tmp_path)
    assert dsl.hits(c, {}).count() == 3 and [r.dataset_id for r in dsl.run(c, {}, size=1, offset=1).collect()] == [10_000]


def test_loading_leaves_the_callers_group(spark, tmp_path):
    c = _catalog(spark, tmp_path)
    spark.sparkContext.setJobGroup("mine", "my work")
    try:
        datasets.load_by_id(c, 0)
        assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "mine"
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("start,end", [("2018-03-01", "2018-03-01"), ("2018-03-01", "2019-03-01"), ("2018-03-01", "2019-03-02"), ("2016-02-29", "2019-01-05"), ("2019-05-01", "2018-01-01")])
def test_year_chunks(spark, start, end):
    df = spark.createDataFrame([(start, end)], "s string, e string")
    got = [(c["start"], c["end"]) for c in df.select(remote.year_chunks(F.col("s"), F.col("e")).alias("c")).first()["c"]]
    assert got[0][0] == date.fromisoformat(start) and got[-1][1] == date.fromisoformat(end)
    assert all(x[1] == y[0] for x, y in zip(got, got[1:])) and all((e - s).days <= 366 for s, e in got)
    assert len(got) == {"2018-03-01": 1, "2019-03-01": 1, "2019-03-02": 2, "2019-01-05": 3, "2018-01-01": 1}[end]


def test_stations_and_readings(spark):
    seen = spark.createDataFrame([("a", "s1", False, 1), ("a", "s2", False, 2), ("a", "s2", True, 1), ("a", "s0", True, 0), ("b", "s5", True, 3), ("b", "s4", False, 1), ("c", "s7", False, 1), ("c", None, True, 0)], "location string, station string, at_end boolean, place int")
    assert sorted(map(tuple, remote.common_station(seen).collect())) == [("a", "s2"), ("b", "s5"), ("c", "s7")]
    assert remote.common_station(seen.limit(0)).count() == 0
    bodies = spark.createDataFrame([("Rome", '{"results":[{"date":"d","station":"s","value":3}]}'), ("Bonn", "{}"), ("Oslo", None), ("Bern", "no")], "city string, body string")
    assert [tuple(r) for r in remote.readings(bodies, "TAVG").collect()] == [("d", "s", "Rome", 3.0)]
    assert spark.range(1).select(remote.offsets(F.lit(2001)).alias("o"), remote.offsets(F.lit(0)).alias("e")).first() == ([1, 1001, 2001], [1])


def test_countries(spark):
    ask = lambda *a: [tuple(r) for r in remote.country_requests(spark, "http://h/v2/", "X", *a).collect()]
    assert ask(["France", "Nowhere"], {"France": "FRA"}, {"date_range": {"start": "1990-01-01", "end": "2000-05-05"}}) == [("France", "http://h/v2/countries/FRA/indicators/X?format=json&date=1990:2000")]
    assert ask(None, {}) == [(None, "http://h/v2/countries/ALL/indicators/X?format=json")] and ask(["Nowhere"], {}) == []
    bodies = spark.createDataFrame([("a", '[{"page":1},[{"v":1},{"v":null}]]'), ("b", '[{"message":"no"}]'), ("c", None)], "location string, body string")
    assert sorted(map(str, remote.paged_union(bodies, "v int").collect())) == ["Row(location='a', v=1)", "Row(location='a', v=None)"]


def test_dated_address():
    a, on = "http://h/x?c=1&old&f=csv", date(2020, 3, 4)
    assert remote.dated_address(a, None, on) == "http://h/x?c=1&d1=1800-01-01&d2=2020-03-04&f=csv"
    assert remote.dated_address(a, {"date_range": {"start": "2001-01-01", "end": "2002-01-01"}}) == "http://h/x?c=1&d1=2001-01-01&d2=2002-01-01&f=csv"


def test_of_years(spark):
    df = spark.createDataFrame([("a", 1, 2, 1990, 5, 6), ("a", 1, 2, 1995, 5, 6), ("b", 1, 2, 1995, 5, 6), (None, 1, 2, None, 5, 6)], "p string, i int, e int, y int, v int, u int")
    assert [r.y for r in remote.of_years(df, {"named_entity": {0: ["a"]}, "date_range": {"start": "1991"}}).collect()] == [1995]
    assert remote.of_years(df).count() == 4 and remote.of_years(df).columns == ["p", "i", "e", "y", "v"]
    assert remote.of_years(df, {"date_range": {"start": "soon"}}).count() == 4
    assert "jdbc" in readers.READERS


def test_generators(spark):
    assert [r.score for r in generators.good_tables(spark.createDataFrame([(0.8,), (0.9,), (None,)], "score double")).collect()] == [0.9]
    dump = spark.createDataFrame([("a", 0, None, "{| x |} <table> <tablet>"), ("b", 1, None, "{|"), ("c", 0, "a", "{|"), ("d", 0, None, None)], "title string, ns int, redirect string, text string")
    assert [tuple(r) for r in generators.articles_with_tables(dump).collect()] == [("a", 2)]
    nested = spark.createDataFrame([(({"id": 1, "utcDate": "x"}), ["p", "q"]), (({"id": 1, "utcDate": None}), None)], "m struct<id:int,utcDate:string>, tags array<string>")
    assert sorted(map(tuple, generators.key_entities(nested).collect())) == [("m_id", "Identifier", "1"), ("m_utcDate", "Time", "x"), ("tags_0", "Text", "p"), ("tags_1", "Text", "q")]
    packages = spark.createDataFrame([("t", "u", [("k",), (None,)], [("text/CSV", "r1", "d", "c"), (None, "r2", "d", "c"), ("pdf", "r3", "d", "c")])], "title string, url string, tags array<struct<name:string>>, resources array<struct<mimetype:string,url:string,description:string,created:string>>")
    (row,) = generators.csv_resources(packages).collect()
    assert row.keywords == ["k"] and row.materialization["arguments"] == {"url": "r1", "file_type": "csv"}


def test_a_description_for_each_table(spark, tmp_path):
    rows = lambda *n: "".join(f"<tr><td>{x}</td></tr>" for x in n)
    (tmp_path / "page").write_text(f"<body><table><tr><th>A</th></tr>{rows('x', 'y')}</table><table></table><table><tr><th>B</th></tr>{rows('z')}</table></body>")
    got = api.describe_tables(spark, str(tmp_path / "page"))
    assert [(d["materialization"]["arguments"]["index"], d["variables"][0]["name"]) for d in got] == [("0", "A"), ("2", "B")]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert [d["title"] for d in api.describe_tables(spark, str(tmp_path / "t.csv"))] == ["t"]


def test_bulk_reports_what_fails(spark, monkeypatch):
    page = '<body><a href="http://h.example.org/a.csv">Prices</a><a href="http://h.example.org/a.csv">Prices</a><a href="http://h.example.org/b.csv">Rain</a></body>'
    pages = spark.createDataFrame([(1, page, "http://h.example.org/")], "page_id long, html string, url string")

    def one(_, url):
        if "b.csv" in url:
            raise OSError("gone")
        return [{"title": "a", "url": url}]

    monkeypatch.setattr(api, "describe_tables", one)
    made, failed = api.describe_pages(spark, pages)
    assert [(d["title"], d["url"]) for d in made] == [("Prices", "http://h.example.org/a.csv")] and failed == [("http://h.example.org/b.csv", "gone")]
