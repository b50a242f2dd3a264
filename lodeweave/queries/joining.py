"""Queries of joins and linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import joins
from lodeweave.operators.joins import Feature
from lodeweave.queries.common import table


def equi_left_join(spark: SparkSession, d: str) -> DataFrame:
    """J-01."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.equi_left_join(orders, table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["o_custkey"], ["c_custkey"])


def equi_left_join_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """J-01 with equal names on both sides."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("lang"), "quality")
    return joins.equi_left_join(docs, labels, ["doc_id"], ["id"])


def equi_left_join_nullsafe(spark: SparkSession, d: str) -> DataFrame:
    """J-01: nulls match nulls."""
    gaps = lambda df, n, k: df.select(F.when(F.col(n) % 3 != 0, F.col(n)).alias(n), k)
    return joins.equi_left_join(gaps(table(spark, d, "nation"), "n_regionkey", "n_name"), gaps(table(spark, d, "region"), "r_regionkey", "r_name"), ["n_regionkey"], ["r_regionkey"])


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("lid"))
    right = part.select(F.concat(F.lit("x"), F.col("p_name")).alias("r_name"), F.col("lid").alias("rid"), F.length("p_name").cast("bigint").alias("size"))
    return part, right


def fuzzy_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    """J-03, M-05: every distinct part name and a changed copy of it, without a block (some tens of names on either side)."""
    left, right = _names(spark, d)
    out, _ = joins.fuzzy_join(left, right, "lid", "rid", [Feature(("p_name",), ("r_name",), "string")], block="none")
    return out.select("p_name", "lid", "size")


def fuzzy_first_character(spark: SparkSession, d: str) -> DataFrame:
    """J-05b: customers against suppliers by name, blocked by first characters of more than 10,000 pairs."""
    left = table(spark, d, "customer").select(F.concat(F.substring("c_mktsegment", 1, 4), F.lit("_"), F.col("c_nationkey").cast("string")).alias("k"), "c_custkey")
    right = table(spark, d, "supplier").select(F.concat(F.lit("AUTO "), F.col("s_nationkey").cast("string")).alias("rk"), F.col("s_suppkey").alias("rid"), "s_acctbal")
    pairs = joins.linked(left, right, "c_custkey", "rid", [Feature(("k",), ("rk",), "string")])
    return pairs.select(F.col("lid").alias("c_custkey"), F.col("rid").alias("s_suppkey"), F.round("score", 6).alias("score"))


def fuzzy_token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """M-03 over two columns on each side."""
    part = table(spark, d, "part").groupBy("p_name", "p_size").agg(F.min("p_partkey").alias("lid")).withColumn("ls", F.col("p_size").cast("string"))
    right = part.select(F.concat_ws(" ", F.lit("new"), "p_name").alias("rn"), (F.col("p_size") + 1).cast("string").alias("rs"), F.col("lid").alias("rid"))
    found = joins.linked(part, right, "lid", "rid", [Feature(("p_name", "ls"), ("rn", "rs"), "token")], block="none")
    return found.select("lid", "rid", F.round("score", 6).alias("score"))


def fuzzy_date_nearest(spark: SparkSession, d: str) -> DataFrame:
    """M-06: each day with orders, and the nearest day with a shipment."""
    left = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").cast("timestamp").alias("day")).agg(F.min("o_orderkey").alias("lid"))
    right = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").cast("timestamp").alias("ship")).agg(F.min("l_orderkey").alias("o"))
    right = right.select("ship", F.unix_date(F.to_date("ship")).cast("bigint").alias("rid"))
    found = joins.linked(left, right, "lid", "rid", [Feature(("day",), ("ship",), "date")])
    return found.select("lid", "rid", F.round("score", 9).alias("score"))


def fuzzy_number(spark: SparkSession, d: str) -> DataFrame:
    """M-04: each nation's mean customer balance, and the supplier with the most alike balance."""
    left = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 2).alias("bal"))
    right = table(spark, d, "supplier").select("s_acctbal", F.col("s_suppkey").alias("rid"))
    found = joins.linked(left, right, "c_nationkey", "rid", [Feature(("bal",), ("s_acctbal",), "number")])
    return found.select(F.col("lid").alias("c_nationkey"), F.col("rid").alias("s_suppkey"))


def _linked(spark: SparkSession, d: str, exact: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    left = table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("seg") if not exact else F.col("c_mktsegment").alias("seg"), "c_nationkey")
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_mktsegment").alias("rseg"), F.col("c_nationkey").alias("rn"), F.round("c_acctbal", 2).alias("bal"))
    fs = [Feature(("seg",), ("rseg",), "category"), Feature(("c_nationkey",), ("rn",), "category_number")]
    out, m = joins.fuzzy_join(left, right, "c_custkey", "rid", fs, exact=exact)
    return left, out, m


def fuzzy_multi_feature(spark: SparkSession, d: str) -> DataFrame:
    """J-04, J-05a: two features, blocked by the category."""
    return _linked(spark, d, False)[1]


def exact_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """J-02: equality of both features, of which half suffices."""
    return _linked(spark, d, True)[1]


def cover_ratio(spark: SparkSession, d: str) -> DataFrame:
    """J-08."""
    left = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    right = table(spark, d, "labels").select(F.col("doc_id").alias("rid"), F.concat(F.lit("src"), (F.col("doc_id") % 9).cast("string")).alias("s"))
    m = joins.linked(left, right, "id", "rid", [Feature(("source",), ("s",), "category")])
    return joins.report(left, m, "id").select("n_rows", "n_matched", F.round("cover_ratio", 6).alias("cover_ratio"))


def all_matches_threshold(spark: SparkSession, d: str) -> DataFrame:
    """J-06b: all names within half of the edits."""
    left, right = _names(spark, d)
    found = joins.linked_all(left, right, "lid", "rid", [Feature(("p_name",), ("r_name",), "string")], block="none", threshold=0.6)
    return found.select("lid", F.size("rids").cast("bigint").alias("n"), F.array_join("rids", ",").alias("rids"))


QUERIES = {f.__name__: f for f in (equi_left_join, equi_left_join_suffixes, equi_left_join_nullsafe, fuzzy_levenshtein, fuzzy_first_character, fuzzy_token_jaccard, fuzzy_date_nearest, fuzzy_number, fuzzy_multi_feature, exact_one_to_one, cover_ratio, all_matches_threshold)}

_LEV = "1 - levenshtein(l.k, r.k) / CAST(greatest(length(l.k), length(r.k)) AS DOUBLE)"
_BEST = "row_number() OVER (PARTITION BY lid ORDER BY score DESC, rid DESC)"
_NAMES = "l AS (SELECT p_name AS k, p_name, min(p_partkey) AS lid FROM part GROUP BY p_name), r AS (SELECT 'x' || p_name AS k, lid AS rid, CAST(length(p_name) AS BIGINT) AS size FROM l)"
_LINKED = """
WITH l AS (SELECT c_custkey, {seg} AS seg, c_nationkey FROM customer),
r AS (SELECT c_custkey AS rid, c_mktsegment AS rseg, c_nationkey AS rn, round(c_acctbal, 2) AS bal FROM customer),
m AS (SELECT c_custkey AS lid, rid, row_number() OVER (PARTITION BY c_custkey ORDER BY ({one} + CAST(c_nationkey = rn AS INT)) DESC, rid DESC) AS n, ({one} + CAST(c_nationkey = rn AS INT)) / 2.0 AS score FROM l JOIN r ON lower(seg) = lower(rseg))
SELECT c_custkey, seg, c_nationkey, bal FROM l LEFT JOIN (SELECT * FROM m WHERE n = 1 AND score >= 0.5) m ON m.lid = c_custkey LEFT JOIN r ON r.rid = m.rid
"""
ORACLES = {
    "equi_left_join": "SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "equi_left_join_suffixes": "SELECT d.doc_id, d.lang AS lang_x, d.n_chars, l.toxic AS lang_y, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "equi_left_join_nullsafe": "WITH n AS (SELECT CASE WHEN n_regionkey % 3 <> 0 THEN n_regionkey END AS n_regionkey, n_name FROM nation), r AS (SELECT CASE WHEN r_regionkey % 3 <> 0 THEN r_regionkey END AS k, r_name FROM region) SELECT n_regionkey, n_name, r_name FROM n LEFT JOIN r ON n_regionkey IS NOT DISTINCT FROM k",
    "fuzzy_levenshtein": f"WITH {_NAMES}, p AS (SELECT lid, rid, size, {_LEV} AS score FROM l, r), b AS (SELECT *, {_BEST} AS n FROM p WHERE score >= 0.5) SELECT p_name, l.lid, size FROM l LEFT JOIN b ON b.lid = l.lid AND n = 1",
    "all_matches_threshold": f"WITH {_NAMES}, p AS (SELECT lid, rid, {_LEV} AS score FROM l, r) SELECT lid, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid) AS rids FROM p WHERE score >= 0.6 GROUP BY lid",
    "fuzzy_first_character": f"""
WITH l AS (SELECT replace(substr(c_mktsegment, 1, 4) || '_' || CAST(c_nationkey AS VARCHAR), '_', ' ') AS k, c_custkey AS lid FROM customer),
r AS (SELECT 'AUTO ' || CAST(s_nationkey AS VARCHAR) AS k, s_suppkey AS rid FROM supplier),
big AS (SELECT (SELECT count(*) FROM customer) * (SELECT count(*) FROM supplier) > 10000 AS many),
p AS (SELECT lid, rid, {_LEV} AS score FROM l, r, big WHERE NOT many OR lower(substr(l.k, 1, 1)) = lower(substr(r.k, 1, 1))),
b AS (SELECT *, {_BEST} AS n FROM p WHERE score >= 0.5)
SELECT lid AS c_custkey, rid AS s_suppkey, round(score, 6) AS score FROM b WHERE n = 1""",
    "fuzzy_token_jaccard": f"""
WITH g AS (SELECT p_name, p_size, min(p_partkey) AS id FROM part GROUP BY p_name, p_size),
l AS (SELECT id AS lid, list_distinct(list_filter(string_split_regex(lower(p_name) || ' ' || CAST(p_size AS VARCHAR), '\\s+'), lambda x: x <> '')) AS k FROM g),
r AS (SELECT id AS rid, list_distinct(list_filter(string_split_regex('new ' || lower(p_name) || ' ' || CAST(p_size + 1 AS VARCHAR), '\\s+'), lambda x: x <> '')) AS k FROM g),
p AS (SELECT lid, rid, len(list_intersect(l.k, r.k)) / CAST(len(list_distinct(list_concat(l.k, r.k))) AS DOUBLE) AS score FROM l, r),
b AS (SELECT *, {_BEST} AS n FROM p WHERE score >= 0.5)
SELECT lid, rid, round(score, 6) AS score FROM b WHERE n = 1""",
    "fuzzy_date_nearest": f"""
WITH l AS (SELECT CAST(o_orderdate AS DATE) AS day, min(o_orderkey) AS lid FROM orders GROUP BY 1),
s AS (SELECT max(epoch(day)) - min(epoch(day)) AS span FROM l),
r AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS ship FROM lineitem),
p AS (SELECT lid, CAST(date_diff('day', DATE '1970-01-01', ship) AS BIGINT) AS rid, 1 - abs(epoch(day) - epoch(ship)) / span AS score FROM l, r, s),
b AS (SELECT *, {_BEST} AS n FROM p WHERE score >= 0.5)
SELECT lid, rid, round(score, 9) AS score FROM b WHERE n = 1""",
    "fuzzy_number": f"""
WITH l AS (SELECT c_nationkey AS lid, round(avg(c_acctbal), 2) AS bal FROM customer GROUP BY 1), s AS (SELECT max(bal) - min(bal) AS span FROM l),
p AS (SELECT lid, s_suppkey AS rid, sqrt(greatest(0, 1 - abs(bal - s_acctbal) / span)) AS score FROM l, supplier, s),
b AS (SELECT *, {_BEST} AS n FROM p WHERE score >= 0.5)
SELECT lid AS c_nationkey, rid AS s_suppkey FROM b WHERE n = 1""",
    "fuzzy_multi_feature": _LINKED.format(seg="lower(c_mktsegment)", one="1"),
    "exact_one_to_one": _LINKED.format(seg="c_mktsegment", one="1"),
    "cover_ratio": "WITH m AS (SELECT DISTINCT 'src' || CAST(doc_id % 9 AS VARCHAR) AS s FROM labels) SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(s) AS BIGINT) AS n_matched, round(count(s) / CAST(count(*) AS DOUBLE), 6) AS cover_ratio FROM documents LEFT JOIN m ON lower(source) = lower(s)",
}
