"""The catalog's log, and schemas compiled to a projection."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodeweave import api
from lodeweave.operators import catalog
from lodeweave.operators.log import CatalogLog
from lodeweave.plans import dsl, schema
from lodeweave.session import shared_path


def docs(spark, *rows):
    return catalog.documents(spark, [{"title": t, "keywords": [k], "variables": [{"name": "v"}], "materialization": {"source": "csv", "arguments": {"url": u}}} for t, u, k in rows])


def shown(df):
    return sorted((r.dataset_id, r.title, r.keywords[0], r.variables[0].dataset_id) for r in df.collect())


def test_log_of_batches(spark):
    log = CatalogLog(spark, shared_path(spark, "log"))
    assert log.read().count() == 0
    assert log.append(docs(spark, ("b", "u2", "x"), ("a", "u1", "x")), "one")
    first = [(0, "a", "x", 1), (10_000, "b", "x", 10_001)]
    assert shown(log.read()) == first
    assert not log.append(docs(spark, ("zz", "u9", "x")), "one") and shown(log.read()) == first
    files = lambda: {f for f in log._changes().inputFiles()}
    before = files()
    assert log.append(docs(spark, ("a2", "u1", "y"), ("a1", "u1", "z"), ("c", "u3", "x")), "two")
    assert before < files()  # nothing is written again
    assert shown(log.read()) == [(0, "a2", "y", 1), (10_000, "b", "x", 10_001), (20_000, "c", "x", 20_001)]
    assert log.remove(spark.createDataFrame([(20_000,)], "dataset_id long"), "three") and not log.remove(log.read(), "three")
    small = log.compact(shared_path(spark, "log"))
    for one in (log, small):
        assert shown(one.read()) == [(0, "a2", "y", 1), (10_000, "b", "x", 10_001)]
        # ids aren't given again, and what comes back has its own
        one.append(docs(spark, ("d", "u4", "x"), ("c", "u3", "back")), "four")
        assert shown(one.read())[2:] == [(20_000, "c", "back", 20_001), (30_000, "d", "x", 30_001)]
    # a batch that broke off while it was written isn't there
    (spark.createDataFrame([], CatalogLog.SCHEMA)).write.parquet(f"{log.path}/_writing-five")
    assert log.read().count() == 4 and log.append(docs(spark, ("e", "u5", "x")), "five") and log.read().count() == 5


def test_lines_are_uploaded_or_come_back(spark):
    log = CatalogLog(spark, shared_path(spark, "log"))
    lines = [json.dumps({"title": "a", "materialization": {"source": "csv"}}), json.dumps({"title": 1}), "{", "[]", None]
    bad = api.upload_lines(log, spark.createDataFrame([(x,) for x in lines], "line string"), "b").collect()
    assert [r.title for r in log.read().collect()] == ["a"] and {r.line: r.violations for r in bad}[lines[1]] == ["title must be a text", "materialization is required"]
    assert {r.line for r in bad} == set(lines[1:])


CASES = [
    ({"materialization": {"source": "csv"}}, []),
    ({"materialization": {"source": 1, "arguments": []}, "title": None}, ["materialization.source must be a text", "materialization.arguments must be an object"]),
    ({"materialization": {}, "keywords": "x"}, ["keywords must be a list", "materialization.source is required"]),
    ({"materialization": None, "keywords": ["a", 2, None]}, ["keywords[1] must be a text", "keywords[2] must not be null", "materialization is required"]),
    ({"materialization": {"source": "x"}, "variables": [{"name": "ok", "named_entity": ["a"]}, {"temporal_coverage": {"start": 5}}, 7]}, ["variables[1].temporal_coverage.start must be a text", "variables[2] must be an object"]),
    ({"materialization": {"source": "x"}, "implicit_variables": [{"name": "a", "value": True, "semantic_type": "one"}], "license": 3}, ["license must be an object", "implicit_variables[0].value must be a text"]),
]
QUERIES = [
    ({}, []),
    ({"dataset": {"about": "x", "name": ["a"], "keywords": "b", "colour": "red"}, "else": 1}, ["unknown key dataset.colour", "unknown key else"]),
    ({"required_variables": [{"type": "temporal_entity", "granularity": "week"}, {"type": "none"}, {}]}, ["required_variables[0].granularity must be one of year, month, day, hour, minute, second"] + [f"required_variables[{i}] must have a type of temporal_entity, geospatial_entity, dataframe_columns, generic_entity" for i in (1, 2)]),
    ({"desired_variables": [{"type": "geospatial_entity", "circle": {"latitude": "north", "longitude": 1.5}}, {"type": "dataframe_columns", "index": [0, 1.5], "names": ["a"]}]}, ["desired_variables[0].circle.latitude must be a number", "desired_variables[1].index[1] must be a whole number"]),
    ({"dataset": []}, ["dataset must be an object"]),
]


@pytest.mark.parametrize("node,cases", [(schema.DESCRIPTION, CASES), (schema.QUERY, QUERIES)])
def test_violations_of_documents(spark, node, cases):
    for doc, wrong in cases:
        assert schema.check(node, doc) == wrong
    lines = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(cases)], "i int, line string")
    assert {r.i: r.violations for r in schema.violations(lines, node).collect()} == {i: w for i, (_, w) in enumerate(cases)}


def test_both_checks_agree(spark):
    rng = random.Random(11)
    values = [None, 1, 1.5, "x", True, [], ["a"], [1, None], {}, {"name": 1}, {"start": "x", "end": []}, [{"name": "n", "semantic_type": ["t", 2]}], {"source": "s"}]
    names = ["title", "keywords", "license", "variables", "implicit_variables", "materialization", "url", "other"]
    many = [{n: rng.choice(values) for n in names if rng.random() < 0.7} for _ in range(200)]
    lines = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(many)], "i int, line string")
    got = {r.i: r.violations for r in schema.violations(lines).collect()}
    assert got == {i: schema.check(schema.DESCRIPTION, d) for i, d in enumerate(many)}


def test_bad_queries_are_refused(spark):
    with pytest.raises(ValueError, match="granularity"):
        dsl.hits(spark.createDataFrame([], catalog.SCHEMA), QUERIES[2][0])


def test_numbers_of_new_descriptions_follow_their_order(spark):
    old = docs(spark, ("x", "u", "k")).withColumn("dataset_id", F.lit(50_000).cast("long"))
    new = docs(spark, *((f"t{i:02d}", f"n{i}", "k") for i in range(30))).repartition(5)
    got = {r.title: r.dataset_id for r in catalog.insert(old, new).collect()}
    assert got == {"x": 50_000} | {f"t{i:02d}": 60_000 + i * catalog.STEP for i in range(30)}
