"""Linkage by the segment index and by merged ranges against all pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodeweave import api
from lodeweave.operators import joins
from lodeweave.operators.joins import Feature
from lodeweave.plans import features


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    longest = max(len(a), len(b))
    return 1 - distance(a, b) / longest if longest else 1.0


def words(rng, n):
    out = []
    for _ in range(n):
        w = "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 14)))
        out.append(w)
        if rng.random() < 0.5:
            k = rng.randrange(0, len(w) + 1)
            out.append(w[:k] + rng.choice(["", "x", "ab"]) + w[k + rng.randrange(0, 3) :])
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.75, 0.9, 1.0])
def test_segment_index_finds_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    a, b = words(rng, 60), words(rng, 60)
    left = spark.createDataFrame([(i, w) for i, w in enumerate([*a, None])], "id bigint, w string").repartition(3)
    right = spark.createDataFrame([(i, w) for i, w in enumerate([*b, None])], "rid bigint, r string").repartition(2)
    pairs = joins.scored_pairs(left, right, "id", "rid", [Feature(("w",), ("r",), "string")], block="none", threshold=threshold)
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString() and "Cartesian" not in pairs._jdf.queryExecution().toString()
    # a missing text compares as an empty one; rows that look alike stand for each other with the largest id
    a, b = [*a, ""], [*b, ""]
    last = {w: i for i, w in enumerate(b)}
    want = {(i, last[y]): alike(x, y) for i, x in enumerate(a) for y in last if alike(x, y) >= threshold}
    got = {(r.lid, r.rid): r.score for r in pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_segments_cover_a_string(spark):
    rows = spark.createDataFrame([(n, d) for n in range(0, 30) for d in range(0, max(1, n))], "n int, d int").withColumn("i", F.explode(F.sequence(F.lit(0), "d")))
    start, size = joins._segment(F.col("n"), F.col("d"), F.col("i"))
    at = {}
    for r in rows.select("n", "d", "i", start.alias("s"), size.alias("k")).collect():
        at.setdefault((r.n, r.d), []).append((r.i, r.s, r.k))
    for (n, d), parts in at.items():
        end = 0
        for _, s, k in sorted(parts):
            assert s == end and (k > 0 or n == 0)
            end += k
        assert end == n and len(parts) == d + 1


@pytest.mark.parametrize("kind", ["number", "date"])
@pytest.mark.parametrize("rows_of_a_bin", [20_000, 3])
def test_nearest_of_ranges(spark, monkeypatch, kind, rows_of_a_bin):
    monkeypatch.setattr(joins, "BIN_ROWS", rows_of_a_bin)
    rng = random.Random(8)
    # most left values lie where the right side has none
    ls = [rng.choice([rng.randrange(-50, 50), rng.randrange(5000, 5010), 7]) for _ in range(150)] + [None]
    rs = [rng.choice([rng.randrange(-60, 60), 9000, 4990]) for _ in range(80)] + [None]
    as_time = (lambda x: F.timestamp_seconds(x)) if kind == "date" else (lambda x: F.col(x).cast("double"))
    left = spark.createDataFrame(list(enumerate(ls)), "id bigint, v bigint").withColumn("v", as_time("v"))
    right = spark.createDataFrame(list(enumerate(rs)), "rid bigint, r bigint").withColumn("r", as_time("r"))
    span = max(x for x in ls if x is not None) - min(x for x in ls if x is not None)
    got = {r.lid: (r.rid, round(r.score, 9)) for r in joins.linked(left, right, "id", "rid", [Feature(("v",), ("r",), kind)]).collect()}
    want = {}
    for i, x in enumerate(ls):
        score = lambda y: max(0.0, 1 - abs(x - y) / span) ** 0.5 if kind == "number" else 1 - abs(x - y) / span  # noqa: B023, E731
        best = max(((score(y), j) for j, y in enumerate(rs) if y is not None), default=None) if x is not None else None
        if best and best[0] >= 0.5:
            want[i] = (best[1], round(best[0], 9))
    assert got == want


def test_nearest_of_nothing(spark):
    left, none = spark.createDataFrame([(1, 2.0)], "id bigint, v double"), spark.createDataFrame([], "rid bigint, r double")
    feature = [Feature(("v",), ("r",), "number")]
    assert joins.linked(left, none, "id", "rid", feature).count() == 0
    assert joins.linked(left.limit(0), none, "id", "rid", feature).count() == 0


def test_nearest_takes_time_in_proportion(spark):
    """A thousand right numbers and many left ones in one range: a running pass, no search from each row."""
    took = []
    for n in (100_000, 100_000, 400_000):
        left = spark.range(n).select(F.col("id"), (F.col("id") / n * 1000).alias("v"))
        right = spark.range(1000).select(F.col("id").alias("rid"), (F.col("id") * 1.0).alias("r"))
        t = time.time()
        assert joins.linked(left, right, "id", "rid", [Feature(("v",), ("r",), "number")]).where("score > 0").count() == n
        took.append(time.time() - t)
    assert took[2] < 8 * took[1] + 5


def test_row_ids_of_stored_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    out = joins.with_row_ids(df, ["v"])
    assert sorted((r.v, r.row_id) for r in out.collect()) == [(i, i) for i in range(1000)] and joins.with_row_ids(df.limit(0), ["v"]).count() == 0


def test_token_sets_find_all_pairs(spark):
    rng = random.Random(12)
    sets = lambda n: [" ".join(rng.choice("a b c d e f gg hh ii jj".split()) for _ in range(rng.randrange(0, 9))) for _ in range(n)]
    a, b = sets(70), sets(70)
    left = spark.createDataFrame(list(enumerate(a)), "id bigint, w string").repartition(3)
    right = spark.createDataFrame(list(enumerate(b)), "rid bigint, r string").repartition(3)
    for threshold in (0.3, 0.5, 0.8):
        got = {(r.lid, r.rid) for r in joins.scored_pairs(left, right, "id", "rid", [Feature(("w",), ("r",), "token")], block="none", threshold=threshold).collect()}
        last = {tuple(y.split()): j for j, y in enumerate(b)}
        want = {(i, j) for i, x in enumerate(a) for y, j in last.items() if x.split() and y and len({*x.split()} & {*y}) / len({*x.split()} | {*y}) >= threshold}
        assert got == want


#: Days, places and readings of the golden linkages, and what is expected of the wind column in row order.
WEATHER = [("12-01-2018", "New York", 55, "rain", 3), ("12-02-2018", "Los Angeles", 75, "sunny", 2), ("12-05-2018", "Chicago", 41, "wind", 3), ("12-06-2018", "Chicago", 42, "cloudy", 2), ("12-07-2018", "Chicago", 43, "snow", 3), ("12-08-2018", "Los Angeles", 72, "moggy", 2)]
WIND = [(12, 1, 2018, "new york", 37.5), (12, 2, 2018, "los angeles", 22.1), (12, 5, 2018, "chicago", 58.8)]


@pytest.mark.parametrize(
    "left_columns,right_columns,wind",
    [([[0]], [[0, 1, 2]], [37.5, 22.1, 58.8, 58.8, 58.8, 58.8]), ([[1]], [[3]], [37.5, 22.1, 58.8, 58.8, 58.8, 22.1]), ([[0], [1]], [[0, 1, 2], [3]], [37.5, 22.1, 58.8, 58.8, 58.8, 22.1])],
)
def test_golden_linkages(spark, left_columns, right_columns, wind):
    left = spark.createDataFrame([(*r, i) for i, r in enumerate(WEATHER)], "date string, city string, temp long, description string, `air condition` long, lid long")
    right = spark.createDataFrame([(*r, i) for i, r in enumerate(WIND)], "month long, day long, year long, city string, wind double, rid long")
    out, matches = api.augment(left, right, left_columns, right_columns, "fuzzy", "lid", "rid")
    assert [r.wind for r in out.orderBy("lid").collect()] == wind and joins.report(left, matches, "lid").first().cover_ratio == 1.0


def test_golden_features(spark):
    left = spark.createDataFrame(WEATHER, "date string, city string, temp long, description string, `air condition` long")
    assert [f.kind for f in features.plan(left, left, [[i] for i in range(5)], [[i] for i in range(5)])] == ["date", "category", "number", "string", "category_number"]
