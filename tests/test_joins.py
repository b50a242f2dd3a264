"""Joins against known results, and their plans."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeweave import api
from lodeweave.operators import joins
from lodeweave.operators.joins import Feature
from lodeweave.plans import features

WEATHER = [
    ("12-01-2018", "los angeles", 10), ("12-02-2018", "new york", 20), ("12-03-2018", "seattle", 30), ("12-04-2018", "los angeles", 40), ("12-05-2018", "new york", 50), ("12-06-2018", "seattle", 60),
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(WEATHER)], "lid long, date string, City string, temp long")
    right = spark.createDataFrame([(0, 12, 1, 2018, "los angeles", 1.0), (1, 12, 3, 2018, "new york", 2.0), (2, 12, 7, 2018, "new york", 3.0), (3, 1, 1, 2017, "nowhere", 9.0)], "rid long, month long, day long, year long, city string, wind double")
    return left, right


def wind(df):
    return [r.wind for r in df.orderBy("lid").collect()]


def test_date_only(sides):
    left, right = sides
    fs = features.plan(left, right, [[1]], [[1, 2, 3]])
    assert [f.kind for f in fs] == ["date"]
    out, matches = joins.fuzzy_join(left, right, "lid", "rid", fs)
    # the nearest day wins; of days equally near the larger right id
    assert wind(out) == [1.0, 2.0, 2.0, 2.0, 3.0, 3.0]
    assert joins.report(left, matches, "lid").first().cover_ratio == 1.0
    assert out.columns == ["lid", "date", "City", "temp", "city", "wind"]


def test_city_blocks(sides):
    left, right = sides
    out, matches = joins.fuzzy_join(left, right, "lid", "rid", [Feature(("City",), ("city",), "category")])
    assert wind(out) == [1.0, 3.0, None, 1.0, 3.0, None]
    r = joins.report(left, matches, "lid").first()
    assert (r.n_rows, r.n_matched) == (6, 4)
    assert "CartesianProduct" not in plan_of(matches) and "BroadcastNestedLoop" not in plan_of(matches) and "Python" not in plan_of(matches)


def test_first_characters_block_large_sides(spark):
    left = spark.range(200).select(F.col("id").alias("lid"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("k"))
    right = spark.range(200).select(F.col("id").alias("rid"), F.concat(F.when(F.col("id") % 2 == 0, "a").otherwise("b"), F.col("id").cast("string")).alias("r"))
    pairs = joins.scored_pairs(left, right, "lid", "rid", [Feature(("k",), ("r",), "string")])
    assert "NestedLoop" not in plan_of(pairs)
    assert pairs.where("rid % 2 = 1").count() == 0
    best = {r.lid: r.rid for r in joins.best_matches(pairs).collect()}
    assert best[100] == 100


def test_equi_join_suffixes_and_nulls(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v long")
    right = spark.createDataFrame([("a", 7), ("a", 8), (None, 9)], "k string, v long")
    out = joins.equi_left_join(left, right, ["k"], ["k"])
    assert out.columns == ["k", "v_x", "v_y"]
    assert sorted(out.collect(), key=str) == sorted([("a", 1, 7), ("a", 1, 8), (None, 2, 9), ("c", 3, None)], key=str)
    assert joins.equi_left_join(left, right, ["k"], ["k"], null_safe=False).where("k is null").first().v_y is None
    with pytest.raises(ValueError):
        joins.equi_left_join(left, right, ["k"], [])


def test_exact_match_needs_half(spark):
    left = spark.createDataFrame([(0, "x", 1), (1, "x", 9), (2, "q", 1)], "lid long, a string, n long")
    right = spark.createDataFrame([(0, "x", 1, "r0"), (1, "x", 2, "r1")], "rid long, b string, m long, name string")
    out, _ = api.augment(left, right, [[1], [2]], [[1], [2]], "exact_match", "lid", "rid")
    assert {r.lid: r.name for r in out.collect()} == {0: "r0", 1: "r1", 2: "r0"}


def test_null_keys_stay_unmatched(spark):
    left = spark.createDataFrame([(0, None), (1, "abcd")], "lid long, a string")
    right = spark.createDataFrame([(0, None, 1), (1, "abce", 2)], "rid long, b string, v long")
    out, _ = joins.fuzzy_join(left, right, "lid", "rid", [Feature(("a",), ("b",), "category")])
    assert {r.lid: r.v for r in out.collect()} == {0: None, 1: None}


def test_feature_planner(spark):
    df = spark.createDataFrame([(f"2018-01-0{i}", "ab"[i % 2], float(i), f"text {i}", i % 2) for i in range(1, 7)], "d string, c string, n double, s string, k long")
    kinds = [f.kind for f in features.plan(df, df, [[0], [1], [2], [3], [4]], [[0], [1], [2], [3], [4]])]
    assert kinds == ["date", "category", "number", "string", "category_number"]
    assert features.plan(df, df, [[1, 3]], [[1, 3]])[0].kind == "token"
    with pytest.raises(ValueError):
        features.plan(df, df, [[0]], [])


def test_unknown_joiner(spark):
    df = spark.range(2)
    with pytest.warns(UserWarning):
        assert api.augment(df, df, [[0]], [[0]], "zipper") == (df, None)
    with pytest.raises(ValueError):
        api.augment(df, df, (), ())


def test_row_ids_are_contiguous(spark):
    df = spark.range(100, numPartitions=7).select((F.col("id") * 37 % 101).alias("v"))
    out = joins.with_row_ids(df, ["v"]).orderBy("v").collect()
    assert [r.row_id for r in out] == list(range(100))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("abc", max_size=4), min_size=1, max_size=6), st.lists(st.text("abc", max_size=4), min_size=1, max_size=6))
def test_fuzzy_join_keeps_left_rows(spark, a, b):
    left = spark.createDataFrame(list(enumerate(a)), "lid long, k string")
    right = spark.createDataFrame([(i, x, i) for i, x in enumerate(b)], "rid long, r string, v long")
    pairs = joins.scored_pairs(left, right, "lid", "rid", [Feature(("k",), ("r",), "string")], block="none", threshold=-1.0)
    rows = pairs.collect()
    assert all(0 <= r.score <= 1 for r in rows)
    out, _ = joins.fuzzy_join(left, right, "lid", "rid", [Feature(("k",), ("r",), "string")], block="none")
    assert out.count() == len(a)


def test_nearest_and_shared_tokens_equal_all_pairs(spark, monkeypatch):
    """Candidates from bins and from rare tokens lose nothing against every pair."""
    import random

    r = random.Random(3)
    left = spark.createDataFrame([(i, r.choice([None, float(r.randrange(-50, 50)), r.uniform(-500, 500)])) for i in range(200)] + [(900, 1e6), (901, 2.0)], "lid bigint, x double")
    right = spark.createDataFrame([(i, r.choice([None, float(r.randrange(-50, 50)), r.uniform(-300, 900)])) for i in range(150)], "rid bigint, y double")
    feature = [joins.Feature(("x",), ("y",), "number")]
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for bins in (200, 3):
        monkeypatch.setattr(joins, "BINS", bins)
        assert rows(joins.linked(left, right, "lid", "rid", feature)) == rows(joins.best_matches(joins.scored_pairs(left, right, "lid", "rid", feature)))
    assert joins.linked(left, right.limit(0), "lid", "rid", feature).count() == 0
    words = ["red", "blue", "tall", "old", "new", "house", "tree", "Tree", "car"]
    texts = lambda n: [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 6)))) for i in range(n)]
    a, b = spark.createDataFrame(texts(80), "lid bigint, x string"), spark.createDataFrame(texts(80), "rid bigint, y string")
    feature = [joins.Feature(("x",), ("y",), "token")]
    for threshold in (0.3, 0.5, 0.8, 1.0):
        got = joins.linked(a, b, "lid", "rid", feature, threshold=threshold)
        sets = {(t, i): frozenset(x.lower().split()) for t, df in (("l", a), ("r", b)) for i, x in df.collect()}
        want = {}
        for (t, i), x in sets.items():
            if t == "l":
                all_ = [(len(x & y) / len(x | y), j) for (u, j), y in sets.items() if u == "r" and x | y]
                if all_ and max(all_)[0] >= threshold:
                    want[i] = max(all_)
        assert {x.lid: (x.score, x.rid) for x in got.collect()} == want
