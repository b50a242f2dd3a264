"""Catalog and search."""

import json

import pytest

from lodeweave import api
from lodeweave.operators import catalog, search
from lodeweave.plans import dsl
from lodeweave.operators.log import CatalogLog
from lodeweave.streaming import ingest


def doc(i, title, entities, start=None, end=None, url=None):
    return {
        "dataset_id": i, "title": title, "description": f"about {title}", "keywords": [title], "url": url, "date_published": "2015-05-05",
        "variables": [{"dataset_id": i + 1, "name": f"{title} name", "semantic_type": [], "named_entity": entities}, {"dataset_id": i + 2, "name": "when", "temporal_coverage": {"start": start, "end": end}}],
        "materialization": {"source": "general", "arguments": {"url": url or f"http://x/{title}.csv", "index": "0"}},
    }


@pytest.fixture(scope="module")
def store(spark):
    return catalog.documents(spark, [
        doc(0, "cities", ["New York City", "Los Angeles", "Boston"], "2010-01-01", "2020-01-01"),
        doc(10_000, "teams", ["Brazil", "France", "Spain"], "2018-06-01", "2018-07-15"),
        doc(20_000, "players", ["Brazil", "Angeles, Los"], None, None),
    ]).persist()


def ids(df):
    return sorted(r.dataset_id for r in df.select("dataset_id").distinct().collect())


def test_phrases_within_one_value(spark, store):
    index = search.postings(store)
    terms = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    assert ids(search.terms_hits(index, terms("new york", "los angeles"))) == [0]
    assert ids(search.terms_hits(index, terms("York Los"))) == []
    hit = search.terms_hits(index, terms("brazil", "spain", "peru")).first()
    assert (hit.dataset_id, hit.n_terms, hit.terms, hit["values"]) == (10_000, 2, ["brazil", "spain"], ["Brazil", "Spain"])
    assert ids(search.terms_hits(index, terms("brazil", "spain", "peru"), 0.1)) == [10_000, 20_000]
    assert ids(search.terms_hits(index, terms("..."))) == []
    assert search.needed(3) == 2 and search.needed(5) == 3


def test_predicates(store):
    assert ids(store.where(search.temporal("2018-06-10", "2018-07-01"))) == [0, 10_000]
    assert ids(store.where(search.temporal("bad", None))) == [0, 10_000, 20_000]
    same = [("variables.name", "teams name"), ("variables.named_entity", "France")]
    assert ids(store.where(search.key_values(same))) == [10_000]
    assert ids(store.where(search.key_values([("variables.name", "when"), ("variables.named_entity", "France")]))) == []
    assert ids(store.where(search.key_values([("keywords", ["teams", "cities"])], disjunctive=True))) == [0, 10_000]
    assert ids(store.where(search.key_values([("keywords", ["teams", "cities"])]))) == []
    assert ids(store.where(search.any_field("spain"))) == [10_000]
    assert ids(store.where(search.by_variable_id(20_001))) == [20_000]
    assert ids(store.where(search.url_is("http://x/teams.csv"))) == [10_000]
    assert ids(store.where(search.any_of(search.by_id(0), None, search.by_id(5)))) == [0]


def test_dsl(spark, store):
    need = {"required_variables": [{"type": "generic_entity", "named_entities": {"items": ["Brazil"]}}, {"type": "temporal_entity", "start": "2018-06-02", "end": "2018-06-03"}]}
    assert ids(dsl.run(store, need)) == [10_000]
    either = {"desired_variables": [{"type": "geospatial_entity", "named_entities": {"items": ["boston"]}}, {"type": "generic_entity", "variable_name": "players"}]}
    assert ids(dsl.run(store, either)) == [0, 20_000]
    assert ids(dsl.run(store, {"dataset": {"name": ["teams", "cities"], "date_published": {"after": "2015-01-01", "before": "2015-12-31"}}})) == [0, 10_000]
    assert ids(dsl.run(store, {"dataset": {"date_published": {"before": "2014-01-01"}}})) == []
    assert len(ids(dsl.run(store, {}))) == 3 and len(dsl.run(store, {}, size=2).collect()) == 2
    hidden = dsl.run(store, {}).schema["variables"].dataType.elementType.fieldNames()
    assert "named_entity" not in hidden
    with pytest.warns(UserWarning):
        dsl.run(store, {"dataset": {"creator": "me"}})
    for bad in ({"nonsense": 1}, {"dataset": {"colour": 1}}, {"required_variables": [{"type": "circle"}]}):
        with pytest.raises(ValueError):
            dsl.run(store, bad)


def test_search_with_a_table(spark, store):
    mine = spark.createDataFrame([("Brazil", "New York City", 1), ("France", "Boston", 2)], "team string, city string, n long")
    hits = api.search(store, None, mine).collect()
    assert {h.dataset_id: h.matches[0].i for h in hits} == {10_000: 0, 20_000: 0, 0: 1}
    one = api.search(store, {"required_variables": [{"type": "dataframe_columns", "names": ["team"]}, {"type": "dataframe_columns", "index": [0]}]}, mine)
    found = one.where("dataset_id = 10000").first()
    assert dsl.join_columns(found.matches, {0: [0]}) == [([0], 0)]


def test_upsert_and_ids(spark, store):
    new = [doc(0, "teams", ["Chile"], url="http://x/teams.csv"), doc(0, "new one", ["x"])]
    for d in new:
        d.pop("dataset_id")
    out = api.upload(store, [*new, {"title": "no source"}]).persist()
    assert ids(out) == [0, 10_000, 20_000, 30_000]
    r = {x.title: x for x in out.collect()}
    assert r["teams"].dataset_id == 10_000 and r["teams"].variables[0].named_entity == ["Chile"] and r["teams"].status == "not_profiled"
    assert [v.dataset_id for v in r["new one"].variables] == [30_001, 30_002]
    assert catalog.next_id(store.limit(0)).first()[0] == 0
    assert ids(catalog.intersection(store, store.where("dataset_id > 0"), store.where("dataset_id < 20000"))) == [10_000]
    again = catalog.upsert(out, catalog.documents(spark, new))
    assert ids(again) == ids(out)


def test_lines_way_back(spark, store, tmp_path):
    catalog.save_lines(store, f"file://{tmp_path}/c")
    got = catalog.load_lines(spark, f"file://{tmp_path}/c")
    assert sorted(map(str, got.collect())) == sorted(map(str, store.collect()))


def test_ingest_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    def put(name, d):
        (tmp_path / "in" / name).write_text(json.dumps(d) + "\n")
    put("a.json", doc(0, "a", ["x"]))
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        put("b.json", doc(0, "b", ["y"]))
    log = CatalogLog(spark, str(tmp_path / "out"))
    assert ids(log.read()) == [0, 10_000]
    # a stream that starts anew takes all files again, into the same catalog
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "other")).awaitTermination()
    assert ids(log.read()) == [0, 10_000]


def test_bm25_order(spark):
    df = spark.createDataFrame([(1, "red red blue"), (2, "red"), (3, "green"), (4, None)], "id long, t string")
    got = [r.id for r in search.bm25(df, "RED", "id", "t", 5).collect()]
    assert sorted(got) == [1, 2]


def test_validate():
    assert catalog.validate({"materialization": {"source": "csv"}}) == []
    assert len(catalog.validate({"title": 3, "keywords": "x"})) == 3
