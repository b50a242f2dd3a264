"""Joins: the equi left join, and record linkage (exact and fuzzy) with blocking (J-00 to J-08).

Linkage compares distinct key tuples, not rows: a score depends on the key values alone and ties go
to the largest right id, so each side is first reduced to its distinct keys (the right one with its largest
id), and the best match is chosen for a key before rows are joined to it. Candidates come from equi-joins: blocks
on an explicit key; for token sets an inverted index of each set's rarest tokens, of which two sets above the
threshold share one; for one string an index of segments of which one stays whole within the edits that the threshold allows; for
one number or date the nearest values on either side, by a merge of sorted ranges. Only what none of these covers lets every left key meet
every right key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import dates, similarity, text
from lodeweave.session import shared_path

THRESHOLD = 0.5
BLOCK_PAIRS = 10_000


def equi_left_join(left: DataFrame, right: DataFrame, left_columns: Sequence[str], right_columns: Sequence[str], null_safe: bool = True) -> DataFrame:
    """J-01: left join on columns of which the right ones take the left names; other equal names get _x and _y.

    Nulls match nulls, as in pandas, unless ``null_safe`` is false.
    """
    if len(left_columns) != len(right_columns) or not left_columns:
        raise ValueError("left and right columns must be as many, and one at least")
    keys = set(left_columns)
    rest = [c for c in right.columns if c not in right_columns]
    shared = {c for c in rest if c in left.columns and c not in keys}
    l, r = left.alias("l"), right.alias("r")
    cond = None
    for a, b in zip(left_columns, right_columns):
        x, y = F.col(f"l.`{a}`"), F.col(f"r.`{b}`")
        one = x.eqNullSafe(y) if null_safe else x == y
        cond = one if cond is None else cond & one
    mine = [F.col(f"l.`{c}`").alias(f"{c}_x" if c in shared else c) for c in left.columns]
    theirs = [F.col(f"r.`{c}`").alias(f"{c}_y" if c in shared or c in keys else c) for c in rest]
    return l.join(r, cond, "left").select(*mine, *theirs)


@dataclass(frozen=True)
class Feature:
    """Columns of either side that are compared as one: how, and whether they can be a block.

    kind: "string" (edit distance), "category" (equality without case; blocks), "token" (Jaccard),
    "number", "category_number" (equality) or "date".
    """

    left: tuple[str, ...]
    right: tuple[str, ...]
    kind: str


def _merged(columns: Sequence[str], kind: str, dtypes: dict[str, str]) -> Column:
    cols = [F.col(f"`{c}`") for c in columns]
    if kind == "number":
        total = cols[0].cast("double")
        for c in cols[1:]:
            total = total + c.cast("double")
        return total
    if kind == "date":
        if len(columns) == 1 and dtypes[columns[0]] in ("timestamp", "timestamp_ntz", "date"):
            return F.unix_timestamp(cols[0].cast("timestamp")).cast("double")
        parts = [F.lpad(c.cast("string"), 2, "0") if dtypes[n] in ("int", "bigint") and n.lower() != "year" else c.cast("string") for n, c in zip(columns, cols)]
        return F.unix_timestamp(dates.parse_date(F.concat_ws("-", *parts))).cast("double")
    if kind == "token":
        return F.flatten(F.array(*(F.coalesce(text.tokens(c.cast("string")), F.array().cast("array<string>")) for c in cols)))
    if kind == "string":
        return F.concat_ws(" ", *(F.replace(c.cast("string"), F.lit("_"), F.lit(" ")) for c in cols))
    return cols[0] if len(cols) == 1 else F.array(*(c.cast("string") for c in cols))


def _score(kind: str, a: Column, b: Column, span: Column, exact: bool) -> Column:
    if exact:
        return similarity.equal(a, b)
    if kind == "string":
        return similarity.levenshtein(a, b)
    if kind == "category":
        return similarity.equal_ignoring_case(a.cast("string"), b.cast("string"))
    if kind == "token":
        return similarity.jaccard(a, b)
    if kind == "number":
        return similarity.numeric(a, b, span)
    if kind == "date":
        return similarity.temporal(a, b, span)
    return similarity.equal(a, b)


#: Rows of both sides that a bin of sorted values has, about, and the bins' number on one of two levels: BINS * BINS at most.
BIN_ROWS = 20_000
BINS = 64


def _bins(values: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One row with the edges of bins that hold about as many of the values (v) each, in two levels; and their number."""
    side = max(1, min(BINS, math.ceil(math.sqrt(n / BIN_ROWS))))
    bins = side * side
    edges = F.percentile_approx("v", F.array(*(F.lit(k / bins) for k in range(1, bins))), F.lit(10 * bins + 1000)) if bins > 1 else F.array().cast("array<double>")
    found = values.agg(F.coalesce(edges, F.array().cast("array<double>")).alias("e"))
    upper = F.filter("e", lambda x, i: i % side == side - 1)
    return found.select(upper.alias("_upper"), F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.slice("e", i * side + 1, side - 1)).alias("_lower")), bins


def _nearest(keys: DataFrame, theirs: DataFrame) -> DataFrame:
    """Each left number l0 with the right one before or at it and the one at or after it (r0, rid): a merge of sorted ranges.

    Ranges are cut at quantiles of both sides together, so that neither fills one alone. In a range two running passes, upwards and
    downwards, carry the last right number along; where a range has none before a key, the nearest ranges' edges serve, a table of a row for each range.
    """
    theirs, mine = theirs.where("r0 is not null"), keys.where("l0 is not null")
    kept, own = list(keys.columns), F.struct(F.col("r0").alias("r0"), "rid")
    right = theirs.select(F.col("r0").alias("v"), own.alias("at"), F.lit(None).cast(mine.select(F.struct(*kept).alias("x")).schema["x"].dataType).alias("key"))
    both = right.union(mine.select(F.col("l0").alias("v"), F.lit(None).cast(right.schema["at"].dataType).alias("at"), F.struct(*kept).alias("key")))
    cuts, bins = _bins(both, both.count())
    at_most = lambda edges, v: F.size(F.filter(edges, lambda x: x <= v))
    high = F.least(at_most(F.col("_upper"), F.col("v")), F.size("_lower") - 1)
    both = both.join(F.broadcast(cuts)).withColumn("bin", high * int(math.isqrt(bins)) + at_most(F.get("_lower", high), F.col("v"))).drop("_upper", "_lower")
    up, down = (Window.partitionBy("bin").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("v"), F.desc("v")))
    near = both.withColumn("low", F.last("at", True).over(up)).withColumn("high", F.last("at", True).over(down)).where("key is not null")
    edges = both.where("at is not null").groupBy("bin").agg(F.max_by("at", "v").alias("last"), F.min_by("at", "v").alias("first"))
    every = keys.sparkSession.range(bins, numPartitions=1).select(F.col("id").cast("int").alias("bin")).join(edges, "bin", "left")
    above, below = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.desc("bin"), F.asc("bin")))  # ``bins`` rows
    every = every.select("bin", F.last("last", True).over(below).alias("below"), F.last("first", True).over(above).alias("above"))
    found = near.join(F.broadcast(every), "bin").select("key.*", F.explode(F.array(F.coalesce("low", "below"), F.coalesce("high", "above"))).alias("at"))
    return found.where("at is not null").select(*kept, "at.*").distinct()


def _edits(n: Column, threshold: float) -> Column:
    """Edits that two strings of which the longer has n characters may be apart."""
    return F.floor(n * (1 - threshold) + 1e-9).cast("int")


def _segment(n: Column, d: Column, i: Column) -> tuple[Column, Column]:
    """Where segment i of a string of n characters in d + 1 segments begins, from 0, and its length; the last ones are longer by one."""
    base, short = F.floor(n / (d + 1)).cast("int"), d + 1 - n % (d + 1)
    return i * base + F.greatest(F.lit(0), i - short), base + F.when(i >= short, 1).otherwise(0)


def _alike(keys: DataFrame, theirs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of strings whose edit similarity reaches the threshold, by a segment index.

    The longer of two strings is cut into d + 1 segments, d the edits allowed at its length: one of them stands whole in
    the shorter one, near its place. So segments meet substrings by equality of (length, segment number, text). Of substrings those are
    taken that can be the first whole segment from the left and from the right: the shift is bounded by the segments
    before, and with the difference in length by those behind.
    """
    n, d, i = F.col("n"), F.col("d"), F.col("i")
    lengths = lambda df, s: df.select(F.length(s).alias("n")).distinct()

    def segments(df: DataFrame, s: str) -> DataFrame:
        rows = df.where(F.col(s).isNotNull()).withColumn("n", F.length(s)).withColumn("d", _edits(n, threshold)).withColumn("i", F.explode(F.sequence(F.lit(0), d)))
        start, size = _segment(n, d, i)
        return rows.withColumn("part", F.substring(F.col(s), start + 1, size))

    def substrings(df: DataFrame, s: str, longer: DataFrame, least: int) -> DataFrame:
        own = F.length(s)
        rows = df.where(F.col(s).isNotNull()).withColumn("n", F.explode(F.sequence(own, F.greatest(own, F.floor(own / threshold + 1e-9).cast("int"))))).where(n >= own + least)
        rows = rows.join(F.broadcast(longer), "n").withColumn("d", _edits(n, threshold)).withColumn("i", F.explode(F.sequence(F.lit(0), d)))
        (start, size), more = _segment(n, d, i), n - own
        low = F.greatest(F.lit(0), start - i, start - more - (d - i))
        high = F.least(own - size, start + i, start - more + (d - i))
        rows = rows.withColumn("_low", low).withColumn("_high", high).withColumn("_size", size).where("_low <= _high")
        parts = F.array_distinct(F.transform(F.sequence("_low", "_high"), lambda q: F.substring(F.col(s), q + 1, F.col("_size"))))
        return rows.withColumn("part", F.explode(parts)).drop("_low", "_high", "_size", "d")

    out = None
    for a, x, b, y, least in ((theirs, "r0", keys, "l0", 0), (keys, "l0", theirs, "r0", 1)):
        met = segments(a, x).join(substrings(b, y, lengths(a, x), least), ["n", "i", "part"]).where(F.expr("levenshtein(l0, r0, d) >= 0")).select(*keys.columns, *theirs.columns)
        out = met if out is None else out.union(met)
    return out.distinct()


def _sharing(keys: DataFrame, theirs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of token sets that share one of their rarest tokens, as all do whose similarity reaches the threshold (prefix filter).

    Of these, pairs go whose sizes alone keep them below it (length filter), and tokens behind which too few are left on either
    side to reach it; the first token that two sets share is never such a one (position filter).
    """
    left, right = keys.withColumn("t", similarity.token_set(F.col("l0"))), theirs.withColumn("t", similarity.token_set(F.col("r0")))
    often = left.select(F.explode("t").alias("w")).union(right.select(F.explode("t"))).groupBy("w").agg(F.count("*").alias("n"))

    def prefixes(df: DataFrame, side: str) -> DataFrame:
        ranked = df.select(*(c for c in df.columns if c != "t"), F.xxhash64("t").alias("k"), F.size("t").alias("size"), F.explode("t").alias("w")).join(often, "w")
        place = F.row_number().over(Window.partitionBy(*(c for c in df.columns if c != "t"), "k").orderBy("n", "w"))
        return ranked.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).drop("k", "n").withColumnsRenamed({"size": f"{side}_size", "place": f"{side}_place"})

    a, b = F.col("a_size"), F.col("b_size")
    near = (a >= b * threshold - 1e-9) & (b >= a * threshold - 1e-9)
    reach = F.least(a - F.col("a_place"), b - F.col("b_place")) + 1 >= F.ceil((a + b) * (threshold / (1 + threshold)) - 1e-9)
    return prefixes(left, "a").join(prefixes(right, "b"), "w").where(near & reach).select(*keys.columns, *theirs.columns).distinct()


def _scored_keys(left: DataFrame, right: DataFrame, left_id: str, right_id: str, features: Sequence[Feature], exact: bool, block: str, threshold: float, nearest: bool) -> tuple[DataFrame, list[str], DataFrame]:
    """Left rows' keys, their names, and (keys, right id, score) of candidates at or above the threshold."""
    if not features:
        raise ValueError("no features to compare")
    lt, rt = dict(left.dtypes), dict(right.dtypes)
    n = len(features)
    l = left.select(F.col(left_id).alias("lid"), *(_merged(f.left, f.kind, lt).alias(f"l{i}") for i, f in enumerate(features)))
    r = right.select(F.col(right_id).alias("rid"), *(_merged(f.right, f.kind, rt).alias(f"r{i}") for i, f in enumerate(features)))
    lk, rk = [f"l{i}" for i in range(n)], [f"r{i}" for i in range(n)]
    keys = l.select(*lk).distinct()
    theirs = r.groupBy(*rk).agg(F.max("rid").alias("rid"))
    spans = [i for i, f in enumerate(features) if f.kind in ("number", "date") and not exact]
    if spans:
        keys = keys.join(F.broadcast(l.agg(*((F.max(f"l{i}") - F.min(f"l{i}")).alias(f"s{i}") for i in spans))))
    blocked = [i for i, f in enumerate(features) if f.kind == "category"]
    strings = [i for i, f in enumerate(features) if f.kind == "string"]
    lower = lambda c: F.lower(F.col(c).cast("string"))
    a = b = None
    if exact and n == 1:
        a, b = F.col("l0"), F.col("r0")
    elif blocked and block == "auto":
        a, b = (F.concat(*(lower(f"{s}{i}") for i in blocked)) for s in "lr")
    elif strings and block == "auto" and _many(left, right):
        a, b = (F.concat(*(F.substring(lower(f"{s}{i}"), 1, 1) for i in strings)) for s in "lr")
    if a is not None:
        pairs = keys.withColumn("_b", a).join(theirs.withColumn("_b", b), "_b")
    elif n == 1 and features[0].kind == "token" and threshold > 0:
        pairs = _sharing(keys, theirs, threshold)
    elif n == 1 and features[0].kind == "string" and threshold > 0:
        pairs = _alike(keys, theirs, threshold)
    elif n == 1 and spans and nearest:
        pairs = _nearest(keys, theirs)
    else:
        pairs = keys.join(theirs, F.lit(True))
    total = None
    for i, f in enumerate(features):
        one = _score(f.kind, F.col(f"l{i}"), F.col(f"r{i}"), F.col(f"s{i}") if i in spans else F.lit(0.0), exact)
        one = F.when(F.col(f"l{i}").isNull() | F.col(f"r{i}").isNull(), F.lit(0.0)).otherwise(one)
        total = one if total is None else total + one
    return l, lk, pairs.select(*lk, "rid", (total / n).alias("score")).where(F.col("score") >= threshold)


def _of_rows(l: DataFrame, lk: list[str], found: DataFrame) -> DataFrame:
    """What was found for a key, for each row with it."""
    found = found.select(*(F.col(c).alias(f"_{c}") for c in lk), *(c for c in found.columns if c not in lk))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in lk]
    return l.join(found, same).drop(*lk, *(f"_{c}" for c in lk))


def scored_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, features: Sequence[Feature], exact: bool = False, block: str = "auto", threshold: float = THRESHOLD) -> DataFrame:
    """(left id, right id, score) of candidate pairs at or above the threshold.

    block: "auto" takes category features as the block, else, for string features and more than BLOCK_PAIRS
    row pairs, their first characters, else none; "none" compares all keys.
    """
    l, lk, scored = _scored_keys(left, right, left_id, right_id, features, exact, block, threshold, False)
    return _of_rows(l, lk, scored).select("lid", "rid", "score")


def linked(left: DataFrame, right: DataFrame, left_id: str, right_id: str, features: Sequence[Feature], exact: bool = False, block: str = "auto", threshold: float = THRESHOLD) -> DataFrame:
    """J-06: (lid, rid, score): each left row's best right row, of equals the one with the largest id; chosen once for each distinct key."""
    l, lk, scored = _scored_keys(left, right, left_id, right_id, features, exact, block, threshold, True)
    best = scored.groupBy(*lk).agg(F.max(F.struct("score", "rid")).alias("b")).select(*lk, F.col("b.rid").alias("rid"), F.col("b.score").alias("score"))
    return _of_rows(l, lk, best).select("lid", "rid", "score")


def linked_all(left: DataFrame, right: DataFrame, left_id: str, right_id: str, features: Sequence[Feature], exact: bool = False, block: str = "auto", threshold: float = THRESHOLD) -> DataFrame:
    """J-06b: (lid, rids): all right keys' rows that reach the threshold, by id; gathered once for each distinct key."""
    l, lk, scored = _scored_keys(left, right, left_id, right_id, features, exact, block, threshold, False)
    return _of_rows(l, lk, scored.groupBy(*lk).agg(F.array_sort(F.collect_set("rid")).alias("rids"))).select("lid", "rids")


def _many(left: DataFrame, right: DataFrame) -> bool:
    """Whether there are more than BLOCK_PAIRS pairs of rows; reads no more rows than needed to know."""
    a = left.limit(BLOCK_PAIRS + 1).count()
    return a > 0 and a * right.limit(BLOCK_PAIRS // a + 1).count() > BLOCK_PAIRS


def best_matches(pairs: DataFrame) -> DataFrame:
    """J-06: (lid, rid, score): each left row's best right row, of equals the one with the largest id."""
    best = F.max(F.struct("score", "rid"))
    return pairs.groupBy("lid").agg(best.alias("b")).select("lid", F.col("b.rid").alias("rid"), F.col("b.score").alias("score"))


def all_matches(pairs: DataFrame) -> DataFrame:
    """J-06b: (lid, rids): all right rows that reach the threshold, by id."""
    return pairs.groupBy("lid").agg(F.array_sort(F.collect_set("rid")).alias("rids"))


def fuzzy_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, features: Sequence[Feature], exact: bool = False, block: str = "auto", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """J-02, J-03, J-07: left rows with their best right row's other columns, and the matches (lid, rid, score).

    Every left row stays once; right columns that are compared are left out; other equal names get "_y".
    """
    matches = linked(left, right, left_id, right_id, features, exact, block, threshold)
    used = {c for f in features for c in f.right} | {right_id}
    rest = [c for c in right.columns if c not in used]
    theirs = right.select(F.col(right_id).alias("_rid"), *(F.col(f"`{c}`").alias(f"{c}_y" if c in left.columns else c) for c in rest))
    found = matches.select(F.col("lid").alias("_lid"), F.col("rid").alias("_rid")).join(theirs, "_rid").drop("_rid")
    out = left.join(found, left[left_id] == F.col("_lid"), "left").drop("_lid")
    return out, matches


def report(left: DataFrame, matches: DataFrame, left_id: str) -> DataFrame:
    """J-08: rows, matched rows and their ratio."""
    both = left.select(F.col(left_id).alias("lid")).join(matches.select("lid", "rid"), "lid", "left")
    return both.agg(F.count("*").alias("n_rows"), F.count("rid").alias("n_matched"), F.coalesce(F.try_divide(F.count("rid"), F.count("*")), F.lit(0.0)).alias("cover_ratio"))


def with_row_ids(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Contiguous ids from 0 in a stated order, by a range sort and a sum of partition sizes: no task sorts all rows.

    The sorted rows are stored in the shared folder, so that sizes and ids are of the same order whatever is computed again.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "row-ids")
    df.orderBy(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")).write.parquet(path)
    cut = spark.read.parquet(path)
    sizes = cut.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    return cut.join(F.broadcast(ahead), "_p").withColumn(name, (F.col("_i") + F.col("_ahead")).cast("bigint")).drop("_p", "_i", "_ahead")
