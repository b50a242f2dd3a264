"""What is done with found tables: joins by id, limits on lazy work, templates, category sets, page loading, recipes."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from lodeweave import api
from lodeweave.functions import html
from lodeweave.operators import catalog, generators, recipes
from lodeweave.plans import schema
from lodeweave.sources import readers


def slow(spark, seconds=60):
    """A table whose every row takes its time, known only when it is read."""
    @F.udf("long")
    def wait(x):
        time.sleep(seconds)
        return x

    return spark.range(0, 2, numPartitions=2).select(wait("id").alias("x"))


def test_slow_lazy_work_is_cancelled_and_other_work_isnt(spark, tmp_path):
    readers.READERS["slow"] = lambda spark, **_: slow(spark)
    readers.READERS["quick"] = lambda spark, **_: slow(spark, 4)
    try:
        lazy = readers.load(spark, {"materialization": {"source": "slow"}}, timeout=1)
        quick = readers.load(spark, {"materialization": {"source": "quick"}}, timeout=1)
        done = []
        other = threading.Thread(target=lambda: done.append(quick.count() and quick.agg(F.sum("x")).first()[0]))
        other.start()
        began = time.time()
        with pytest.raises(Exception, match="(?i)cancel"), readers.limited(spark, 1.5):
            lazy.agg(F.sum("x")).collect()
        with pytest.raises(Exception, match="(?i)cancel"):
            readers.fetched(lazy, str(tmp_path / "out"), 0.5)
        assert time.time() - began < 30
        other.join()
        assert done == [1]
        # the thread's later jobs run on
        assert spark.range(10).count() == 10
        with readers.limited(spark, None):
            assert spark.range(10).count() == 10
        assert readers.fetched(spark.range(3), str(tmp_path / "kept"), 600).count() == 3
    finally:
        del readers.READERS["slow"], readers.READERS["quick"]


@pytest.fixture
def known(spark, tmp_path):
    spark.createDataFrame([("Rome", "2020-01-01", 2.5), ("Oslo", "2020-02-01", 1.5)], "city string, day string, area double").write.parquet(f"{tmp_path}/t.parquet")
    return catalog.documents(spark, [{"dataset_id": 10_000, "title": "t", "variables": [{"name": "city"}, {"name": "day"}, {"name": "area"}], "implicit_variables": [{"name": "land", "value": "x"}, {"value": ""}], "materialization": {"source": "parquet", "arguments": {"url": f"{tmp_path}/t.parquet"}}}])


def test_join_from_an_id(spark, known):
    mine = spark.createDataFrame([("Rome", 1), ("Bonn", 2)], "town string, k long")
    out, matches = api.augment_from(known, mine, 10_000, [["town"]], [["city"]])
    assert matches is None and sorted((r.town, r.k, r.area, r.land) for r in out.collect()) == [("Bonn", 2, None, None), ("Rome", 1, 2.5, "x")]
    near = spark.createDataFrame([("Roma", 1), ("Oslo", 2)], "town string, k long")
    out, matches = api.augment_from(known, near, 10_000, [[0]], [[0]], "fuzzy")
    assert sorted((r.town, r.k, r.area) for r in out.collect()) == [("Oslo", 2, 1.5), ("Roma", 1, 2.5)] and matches.count() == 2
    out, _ = api.augment_from(known, near, 10_000, [["town"]], [["city"]], "exact_match", {"named_entity": {0: ["Oslo"]}})
    assert sorted((r.town, r.area) for r in out.collect()) == [("Oslo", 1.5), ("Roma", None)]
    with pytest.raises(KeyError):
        api.augment_from(known, mine, 5, [[0]], [[0]])
    with pytest.raises(ValueError):
        api.augment_from(known, mine, 10_000, [[0], [1]], [[0]])


def test_implicit_variables_are_described():
    made = readers.implicit_metadata({"title": "t", "variables": [{"name": "a"}]}, [{"name": "year", "value": "2007"}, {"value": ""}, {"value": "x", "semantic_type": "Text"}])
    assert [(v["name"], v.get("named_entity")) for v in made["variables"]] == [("a", None), ("year", ["2007"]), ("implicit_variable_2", ["x"])] and made["variables"][2]["semantic_type"] == ["Text"]


def test_intersection_prefers_rows_with_matches(spark):
    kind = "dataset_id long, title string, matches array<int>"
    a = spark.createDataFrame([(0, "a0", []), (1, "a1", [1]), (2, "a2", None)], kind)
    b = spark.createDataFrame([(0, "b0", [5]), (1, "b1", [6]), (3, "b3", [7])], kind)
    c = spark.createDataFrame([(0, "c0", [8]), (1, "c1", None), (1, "c1", None)], kind)
    assert sorted((r.dataset_id, r.title) for r in catalog.intersection(a, b, c, prefer="matches").collect()) == [(0, "b0"), (1, "a1")]
    assert sorted((r.dataset_id, r.title) for r in catalog.intersection(a, b, c).collect()) == [(0, "a0"), (1, "a1")]


def test_templates(spark):
    rows = spark.createDataFrame([("a", ["x", "y"], "2020", None), ("b", None, None, None)], "name string, places array<string>, first string, last string")
    made = generators.templated(rows, F.concat(F.lit("series "), "name"), "csv", {"url": F.col("name"), "kind": "k"}, [generators.Variable("place", "p", ["Country"], F.col("places")), generators.Variable(F.col("name"), start=F.col("first"), end=F.col("last"))], "told", provenance="here")
    assert made.schema.names == catalog.SCHEMA.names and [f.dataType for f in made.schema] == [f.dataType for f in catalog.SCHEMA]
    r = {x.title: x for x in made.collect()}["series a"]
    assert (r.description, r.provenance, r.materialization.arguments, r.variables[0].named_entity, r.variables[1].name, r.variables[1].temporal_coverage.start) == ("told", "here", {"url": "a", "kind": "k"}, ["x", "y"], "a", "2020")
    inserted = catalog.insert(spark.createDataFrame([], catalog.SCHEMA), made)
    assert [x.dataset_id for x in inserted.orderBy("title").collect()] == [0, 10_000]


def test_lists_are_united(spark):
    one, two = spark.createDataFrame([("a", 1), (None, 2)], "name string, v int"), spark.createDataFrame([("a", 5, "w"), ("b", 6, "w")], "name string, v int, more string")
    assert sorted((r.name, r.v, r.more) for r in generators.united(one, two, by="name").collect()) == [("a", 1, None), ("b", 6, "w")]
    assert sorted(r.name for r in generators.united(one.select("name"), two.select("name"), by="name").collect()) == ["a", "b"]
    names = spark.createDataFrame([("http://h/d/Crops_Some-Thing_E_All_Data_(Norm).zip",), ("x.y.zip",), ("",)], "u string").select(generators.bulk_name(F.col("u"))).collect()
    assert [r[0] for r in names] == ["crops_some_thing_e_all_data", "x", ""]


def test_category_sets_and_pages(spark):
    facts = spark.createDataFrame([("p", "s1", "b;a"), ("p", "s1", "b"), ("p", "s2", None), ("q", "s1", ""), (None, "s", "c")], "by string, subject string, sets string")
    got = generators.category_sets(facts, "by", "subject", "sets")
    assert sorted((r.by, r.n_subjects, r.categories) for r in got.collect()) == [("p", 2, "a;b"), ("q", 1, "")]
    assert sorted((r.id, r.page) for r in generators.paged(spark.range(7), ["id"], 3).collect()) == [(i, i // 3) for i in range(7)]


def test_pages_are_loaded(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.html").write_bytes(b"<p>file \xff</p>")
    path = str(tmp_path / "sub" / "a.html")
    rows = [(1, "http://h.org/x"), (2, "http://h.org/none.html"), (3, path), (4, str(tmp_path / "gone.html")), (5, "<p>text</p>"), (6, "http is a word"), (7, None), (8, "")]
    sources = spark.createDataFrame(rows, "page_id long, source string")
    answers = spark.createDataFrame([("http://h.org/x", "<p>answer</p>")], "url string, body string")
    got = {r.page_id: (r.url, r.html) for r in html.loaded(sources, answers=answers, folder=str(tmp_path)).collect()}
    assert got == {1: ("http://h.org/x", "<p>answer</p>"), 2: ("http://h.org/none.html", None), 3: (None, "<p>file \ufffd</p>"), 4: (None, rows[3][1]), 5: (None, "<p>text</p>"), 6: (None, "http is a word"), 7: (None, None), 8: (None, "")}
    assert html.loaded(sources).where("html is null").count() == 3


def test_addresses_that_pages_share_have_one_answer_in_sql_too(spark, tmp_path):
    import duckdb

    from lodeweave.queries import searching

    rows = [(0, "http://h.org/x", "b"), (4, "http://h.org/x", "a"), (2, "http://h.org/x", "never fetched"), (6, "http://h.org/y", "nor this"), (1, "http://h.org/z", "text"), (3, None, "http://h.org/x"), (5, None, None)]
    rows += [(8, "http://h.org/v\n", "ends"), (10, "http://h.org/v\n", "not"), (12, "no address", "page"), (14, None, "page"), (16, "httpS://K.org?\v", "page"), (18, "HTTP://h.org/x", "page"), (20, "http://h.org/n", None), (22, "http://h.\u212aa", "page"), (7, "", "http://h.org/v\r\n"), (24, "http://h.org/ a", "page")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: tuple(r) for r in searching.pages_loaded(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: r for r in db.sql(searching.ORACLES["pages_loaded"]).fetchall()} == got and len(got) == len(rows)
    assert got[0][1:] == got[2][1:] == got[3][1:] == got[4][1:] and got[0][2] == 1 and got[6][2:] == (None, None)


def test_recipes(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 2), ("a", "y", 3.0, None), (None, "x", 5.0, 4), ("a", None, 9.0, 1)], "k string, c string, v double, n int")
    assert sorted((r.k or "", r.v, r.n) for r in recipes.means(df, ["k"]).collect()) == [("", 5.0, 4.0), ("a", 4.333333, 1.5)]
    got = recipes.pivoted_means(df, ["k"], "c", "v")
    assert got.columns == ["k", "x", "y"] and sorted((r.k or "", r.x, r.y) for r in got.collect()) == [("", 5.0, None), ("a", 1.0, 3.0)]
    assert [r.v for r in recipes.head(df, ["v"], 2, ["v"]).collect()] == [1.0, 3.0]
