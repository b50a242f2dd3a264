"""Queries of profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import profile
from lodeweave.queries.common import number_sql, table, words_sql


def _r(df: DataFrame, *whole: str, n: int = 6) -> DataFrame:
    """Counts as long numbers, ratios rounded."""
    return df.select(*(F.round(c, n).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXTS = ["p_name", "p_brand", "p_type"]


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")


def profile_missing(spark, d):
    """F-01."""
    return _r(profile.missing(_labelled(spark, d), ["doc_id", "lang", "quality", "toxic"]))


def profile_distinct(spark, d):
    """F-02."""
    return _r(profile.distinct(table(spark, d, "orders"), ORDERS).drop("categorical"))


def categorical_columns(spark, d):
    """P-09."""
    return profile.distinct(table(spark, d, "orders"), ORDERS).select("column", "categorical")


def profile_spaces(spark, d):
    """F-03."""
    part = table(spark, d, "part").select(*(F.when(F.col("p_partkey") % k == 0, F.concat(F.lit("  "), c)).when(F.col("p_partkey") % k == 1, F.concat(c, F.lit("\t"))).when(F.col("p_partkey") % k != 2, F.col(c)).alias(c) for k, c in zip((5, 7, 11), TEXTS)))
    return _r(profile.spaces(part, TEXTS))


def profile_numeric(spark, d):
    """F-08, F-19."""
    return _r(profile.numeric_values(table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderkey") % 3 == 0, "1e3").otherwise(F.col("o_orderstatus"))), ["o_orderkey", "o_orderpriority", "status"]))


def profile_numeric_signs(spark, d):
    """F-10."""
    return _r(profile.signs(table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_nationkey") - 1).alias("shifted")), ["c_custkey", "c_acctbal", "shifted"]))


def profile_outliers(spark, d):
    """F-09."""
    return _r(profile.outliers(table(spark, d, "lineitem").withColumn("cube", F.pow("l_extendedprice", F.lit(3))), [*NUMBERS, "cube"]))


def profile_quartiles(spark, d):
    """F-11."""
    return _r(profile.targets(table(spark, d, "lineitem"), NUMBERS), n=4)


def profile_top_tokens(spark, d):
    """F-15."""
    return _r(profile.top_tokens(table(spark, d, "documents"), ["text", "lang"]))


def profile_top_values(spark, d):
    """F-14."""
    return _r(profile.top_tokens(table(spark, d, "part"), TEXTS, by="value"))


def profile_tokens_punct(spark, d):
    """F-17."""
    return _r(profile.top_tokens(table(spark, d, "documents"), ["text", "source"], by="punctuation"))


def profile_distinct_tokens(spark, d):
    """F-04, F-16."""
    return _r(profile.token_numbers(table(spark, d, "documents"), ["text", "lang", "source"]))


def profile_punct_token_numbers(spark, d):
    """F-17: the same of tokens split at punctuation."""
    return _r(profile.token_numbers(table(spark, d, "documents"), ["text", "source"], by="punctuation"))


def profile_numeric_tokens(spark, d):
    """F-12."""
    return _r(profile.top_tokens(table(spark, d, "documents"), ["text"], only="numeric"))


def profile_alnum_tokens(spark, d):
    """F-13."""
    return _r(profile.top_tokens(table(spark, d, "documents"), ["text"], only="alphanumeric"))


def profile_digit_density(spark, d):
    """F-18."""
    return _r(profile.digit_density(table(spark, d, "documents"), ["text", "lang", "source"]), n=9)


def profile_filenames(spark, d):
    """F-06."""
    return _r(profile.filenames(table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("address")), ["address"]))


def profile_punctuation(spark, d):
    """F-07."""
    return _r(profile.punctuation(table(spark, d, "documents"), "text"), n=9)


def profile_pearson(spark, d):
    """F-20."""
    return _r(profile.pearson(table(spark, d, "lineitem"), NUMBERS))


def profile_spearman(spark, d):
    """F-21."""
    return _r(profile.spearman(table(spark, d, "lineitem"), NUMBERS))


def profile_language(spark, d):
    """F-05."""
    return _r(profile.language(table(spark, d, "documents"), "text"))


def named_entity_columns(spark, d):
    """P-02."""
    return _r(profile.entity_columns(_mixed(spark, d)))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_custkey").cast("string").alias("number"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("american"))


def named_entity_values(spark, d):
    """P-01."""
    return profile.entity_values(table(spark, d, "part"), ["p_brand", "p_type"])


def temporal_coverage(spark, d):
    """P-03, P-04."""
    return profile.temporal_coverage(_mixed(spark, d), ["day", "american", "o_orderpriority"], {"american": ("1990-01-01", None)})


def majority_semantic_type(spark, d):
    """G-01."""
    m = _mixed(spark, d).withColumn("gaps", F.when(F.col("day") > "2100-01-01", F.col("day"))).withColumn("range", F.concat(F.length("number"), F.lit(" - "), F.length("day")))
    return _r(profile.majority_type(m, ["day", "american", "o_orderpriority", "number", "gaps", "range"]))


def profile_language_learnt(spark, d):
    """F-05: by profiles that are learnt from the documents' own labels."""
    docs = table(spark, d, "documents")
    return profile.language_by(docs, "text", profile.language_profiles(docs, "text", "lang"))


def profile_summary(spark, d):
    """F-23, its plain figures."""
    return _r(profile.summary(table(spark, d, "orders").select("o_custkey", "o_totalprice", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("priority"), F.col("o_orderstatus").alias("status"))))


def majority_entity_type(spark, d):
    """G-01: columns of places and people, by lists of names."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(F.lower("n_name").alias("nation"), "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.col("c_mktsegment")).alias("mixed"))
    known = n.select(F.col("n_name").alias("value"), F.lit("Location").alias("type")).union(c.select("c_name", F.lit("Person")))
    return profile.majority_type(rows, ["nation", "c_name", "c_mktsegment", "mixed"], known=known)


_NAMES = "profile_missing profile_distinct categorical_columns profile_spaces profile_numeric profile_numeric_signs profile_outliers profile_quartiles profile_top_tokens profile_top_values profile_tokens_punct profile_distinct_tokens profile_punct_token_numbers profile_numeric_tokens profile_alnum_tokens profile_digit_density profile_filenames profile_punctuation profile_pearson profile_spearman profile_language named_entity_columns named_entity_values temporal_coverage majority_semantic_type majority_entity_type profile_summary profile_language_learnt".split()
QUERIES = {n: globals()[n] for n in _NAMES}


def _union(make, columns) -> str:
    return " UNION ALL ".join(make(c) for c in columns)


def _summary_sql(c: str) -> str:
    numbers = f"avg({c}), stddev_samp({c}), CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE), quantile_cont({c}, 0.5)" if c.startswith("o_") else "NULL, NULL, NULL, NULL, NULL"
    mode = f"CAST((SELECT {c} FROM o WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1) AS VARCHAR)"
    spread = f"(SELECT sum(CAST(k AS DOUBLE) * k) FROM (SELECT count(*) AS k FROM o WHERE {c} IS NOT NULL GROUP BY {c})) / (CAST(count({c}) AS DOUBLE) * count({c}))"
    return f"SELECT '{c}' AS \"column\", valid, invalid, \"unique\", mode, round(herfindahl, 6) AS herfindahl, round(mean, 6) AS mean, round(std, 6) AS std, round(least, 6) AS least, round(most, 6) AS most, round(median, 6) AS median FROM (SELECT count({c}) AS valid, count(*) - count({c}) AS invalid, count(DISTINCT {c}) AS \"unique\", {mode} AS mode, {spread} AS herfindahl, {numbers} FROM o) t(valid, invalid, \"unique\", mode, herfindahl, mean, std, least, most, median)"


_B = "CAST({} AS BIGINT)"
_MIXED = "m AS (SELECT o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_custkey AS VARCHAR) AS number, strftime(o_orderdate, '%m/%d/%Y') AS american FROM orders)"
_DATE = "coalesce(try_strptime({0}, '%Y-%m-%d'), try_strptime({0}, '%m/%d/%Y'))"


def _tokens_sql(t: str, columns: list[str], split: str, where: str = "true") -> str:
    cells = _union(lambda c: f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {t}", columns)
    return f"WITH c AS ({cells}), t AS (SELECT col, unnest({split}) AS token FROM c), n AS (SELECT col, token, count(*) AS n FROM t WHERE {where} GROUP BY 1, 2)"


_SPACE = "list_filter(string_split_regex(v, '\\s+'), lambda x: x <> '')"
_PUNCT = "list_filter(string_split_regex(v, '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_TOP = " SELECT col AS \"column\", token, CAST(n AS BIGINT) AS n, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, token) AS rank FROM n) WHERE rank <= 10"
_LAB = "x AS (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_SPACED = ", ".join(f"CASE WHEN p_partkey % {k} = 0 THEN '  ' || {c} WHEN p_partkey % {k} = 1 THEN {c} || chr(9) WHEN p_partkey % {k} <> 2 THEN {c} END AS {c}" for k, c in zip((5, 7, 11), TEXTS))
_CORR = "SELECT a AS \"column\", round(min(r), 6) AS min, round(max(r), 6) AS max, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(stddev_samp(r), 6) AS std FROM r GROUP BY a"


def _corr_sql(source: str) -> str:
    return "r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, corr({a}, {b}) AS r FROM {source}" for a in NUMBERS for b in NUMBERS) + ") " + _CORR


def _punct_sql() -> str:
    marks = ",".join(f"({ord(m)})" for m in profile.PUNCTUATION)
    return f"""
WITH c AS (SELECT CASE WHEN {number_sql('text')} THEN '' ELSE coalesce(text, '') END AS v, length(coalesce(text, '')) AS chars FROM documents),
m AS (SELECT chr(x) AS p FROM (VALUES {marks}) t(x)),
d AS (SELECT p, length(v) - length(replace(v, p, '')) AS k, CASE WHEN length(v) > 0 THEN (length(v) - length(replace(v, p, ''))) / CAST(length(v) AS DOUBLE) ELSE 0 END AS den, chars FROM c, m),
s AS (SELECT p, sum(k) AS k, avg(den) AS a, stddev_pop(den) AS sd, sum(chars) AS chars FROM d GROUP BY p),
o AS (SELECT d.p, count(*) FILTER (WHERE abs(den - a) > 3 * sd) AS o FROM d JOIN s ON d.p = s.p GROUP BY d.p)
SELECT s.p AS punctuation, CAST(k AS BIGINT) AS count, round(k / CAST(chars AS DOUBLE), 9) AS ratio, round(a, 9) AS density_of_cell, CAST(o AS BIGINT) AS num_outlier_cells
FROM s JOIN o ON s.p = o.p WHERE k > 0 ORDER BY k DESC, s.p LIMIT 10"""


_STOP = {"en": "the and of to in is that for with was are this by be at from or", "fr": "le la les des et un une du que qui dans pour est avec sur par", "de": "der die das und ist nicht ein eine mit von zu den im auf für des", "es": "el la los las de que y en un una por con para es se del"}
_LANG = ", ".join(f"len(list_intersect(w, {v.split()!r})) AS {k}" for k, v in _STOP.items())
ORACLES = {
    "profile_missing": f"WITH {_LAB} " + _union(lambda c: f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS number_of_missing_values, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS ratio_of_missing_values FROM x", ["doc_id", "lang", "quality", "toxic"]),
    "profile_distinct": _union(lambda c: f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS number_of_distinct_values, round(count(DISTINCT {c}) / CAST(count(*) AS DOUBLE), 6) AS ratio_of_distinct_values FROM orders", ORDERS),
    "categorical_columns": _union(lambda c: f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) < 0.2 AS categorical FROM orders", ORDERS),
    "profile_spaces": f"WITH p AS (SELECT {_SPACED} FROM part) " + _union(lambda c: f"SELECT '{c}' AS \"column\", CAST(l AS BIGINT) AS number_of_leading_spaces, round(l / CAST(n AS DOUBLE), 6) AS ratio_of_leading_spaces, CAST(t AS BIGINT) AS number_of_trailing_spaces, round(t / CAST(n AS DOUBLE), 6) AS ratio_of_trailing_spaces FROM (SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches({c}, '^\\s+')) AS l, count(*) FILTER (WHERE coalesce({c}, '') = '' OR regexp_matches({c}, '\\s+$')) AS t FROM p)", TEXTS),
    "profile_numeric": "WITH x AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN '1e3' ELSE o_orderstatus END AS status FROM orders) " + _union(lambda c: f"SELECT '{c}' AS \"column\", CAST(k AS BIGINT) AS number_of_numeric_values, round(k / CAST(n AS DOUBLE), 6) AS ratio_of_numeric_values, CAST(nullif(d, 0) AS BIGINT) AS number_of_values_containing_numeric_char, round(nullif(d, 0) / CAST(n AS DOUBLE), 6) AS ratio_of_values_containing_numeric_char FROM (SELECT count({c}) AS n, count(*) FILTER (WHERE {number_sql(c)}) AS k, count(*) FILTER (WHERE regexp_matches(CAST({c} AS VARCHAR), '[0-9]')) AS d FROM x)", ["o_orderkey", "o_orderpriority", "status"]),
    "profile_numeric_signs": "WITH x AS (SELECT c_custkey, c_acctbal, c_nationkey - 1 AS shifted FROM customer) " + _union(lambda c: f"SELECT '{c}' AS \"column\", " + ", ".join(f"CAST(count(*) FILTER (WHERE {c} {t}) AS BIGINT) AS {n}" for n, t in (("positive", "> 0"), ("negative", "< 0"), ("zero", "= 0"), ("one", "= 1"), ("minus_one", "= -1"))) + " FROM x", ["c_custkey", "c_acctbal", "shifted"]),
    "profile_outliers": "WITH x AS (SELECT *, pow(l_extendedprice, 3) AS cube FROM lineitem) " + _union(lambda c: f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE abs({c} - m) > 3 * s) AS BIGINT) AS number_of_outlier_numeric_values FROM x, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM x)", [*NUMBERS, "cube"]),
    "profile_quartiles": _union(lambda c: f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3 FROM lineitem", NUMBERS),
    "profile_top_tokens": _tokens_sql("documents", ["text", "lang"], _SPACE) + _TOP,
    "profile_top_values": _tokens_sql("part", TEXTS, "[v]", "token IS NOT NULL") + _TOP,
    "profile_tokens_punct": _tokens_sql("documents", ["text", "source"], _PUNCT) + _TOP,
    "profile_distinct_tokens": _tokens_sql("documents", ["text", "lang", "source"], _SPACE) + ", s AS (SELECT col, sum(n) AS n, count(*) AS k, nullif(sum(CASE WHEN regexp_matches(token, '[0-9]') THEN n ELSE 0 END), 0) AS g FROM n GROUP BY col) SELECT col AS \"column\", CAST(n AS BIGINT) AS number_of_tokens, CAST(k AS BIGINT) AS number_of_distinct_tokens, CAST(g AS BIGINT) AS number_of_tokens_containing_numeric_char, round(k / CAST(n AS DOUBLE), 6) AS ratio_of_distinct_tokens, round(CAST(g AS DOUBLE) / CAST(n AS DOUBLE), 6) AS ratio_of_tokens_containing_numeric_char FROM s",
    "profile_punct_token_numbers": _tokens_sql("documents", ["text", "source"], _PUNCT) + ", s AS (SELECT col, sum(n) AS n, count(*) AS k, nullif(sum(CASE WHEN regexp_matches(token, '[0-9]') THEN n ELSE 0 END), 0) AS g FROM n GROUP BY col) SELECT col AS \"column\", CAST(n AS BIGINT) AS number_of_tokens, CAST(k AS BIGINT) AS number_of_distinct_tokens, CAST(g AS BIGINT) AS number_of_tokens_containing_numeric_char, round(k / CAST(n AS DOUBLE), 6) AS ratio_of_distinct_tokens, round(CAST(g AS DOUBLE) / CAST(n AS DOUBLE), 6) AS ratio_of_tokens_containing_numeric_char FROM s",
    "profile_numeric_tokens": _tokens_sql("documents", ["text"], _SPACE, number_sql("token")) + _TOP,
    "profile_alnum_tokens": _tokens_sql("documents", ["text"], _SPACE, "regexp_matches(token, '^[\\p{L}\\p{N}]+$')") + _TOP,
    "profile_digit_density": _union(lambda c: f"SELECT '{c}' AS \"column\", round(sum(length({c}) - length(regexp_replace({c}, '[0-9]', '', 'g'))) / CAST(sum(length({c})) AS DOUBLE), 9) AS numeric_char_density FROM documents", ["text", "lang", "source"]),
    "profile_filenames": "SELECT 'address' AS \"column\", CAST(count(*) FILTER (WHERE regexp_matches(regexp_replace(url, '^https?://', ''), '^\\w+\\.[a-z]{1,5}')) AS BIGINT) AS num_filename FROM pages",
    "profile_punctuation": _punct_sql(),
    "profile_pearson": "WITH " + _corr_sql("lineitem"),
    "profile_spearman": "WITH k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in NUMBERS) + " FROM lineitem), " + _corr_sql("k"),
    "profile_language": f"WITH w AS (SELECT {words_sql('text')} AS w FROM documents WHERE text IS NOT NULL AND NOT {number_sql('text')}), n AS (SELECT {_LANG} FROM w), b AS (SELECT CASE WHEN fr >= greatest(en, de, es) THEN 'fr' WHEN es >= greatest(en, de) THEN 'es' WHEN en >= de THEN 'en' ELSE 'de' END AS language FROM n WHERE greatest(en, fr, de, es) > 0) SELECT language, CAST(count(*) AS BIGINT) AS count FROM b GROUP BY 1",
    "named_entity_columns": f"WITH {_MIXED} " + _union(lambda c: f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, count(*) FILTER (WHERE {c} IS NOT NULL AND {_DATE.format(c)} IS NULL) > 0 AND count(*) FILTER (WHERE {number_sql(c)}) / CAST(count(DISTINCT {c}) AS DOUBLE) <= 0.5 AS is_entity FROM m", ["o_orderpriority", "o_orderstatus", "day", "number", "american"]),
    "named_entity_values": "SELECT DISTINCT 'p_brand' AS \"column\", p_brand AS value FROM part WHERE p_brand IS NOT NULL UNION ALL SELECT DISTINCT 'p_type', p_type FROM part WHERE p_type IS NOT NULL",
    "temporal_coverage": f"WITH {_MIXED} " + _union(lambda c: f"SELECT '{c}' AS \"column\", " + ("'1990-01-01T00:00:00'" if c == "american" else f"CASE WHEN n >= 1 AND n >= rows // 2 THEN strftime(a, '%Y-%m-%dT%H:%M:%S') END") + " AS start, CASE WHEN n >= 1 AND n >= rows // 2 THEN strftime(z, '%Y-%m-%dT%H:%M:%S') END AS \"end\" FROM (SELECT count(*) AS rows, count(t) AS n, min(t) AS a, max(t) AS z FROM (SELECT " + _DATE.format(c) + " AS t FROM m))", ["day", "american", "o_orderpriority"]),
    "majority_entity_type": "WITH x AS (SELECT count(*) AS n FROM customer) SELECT unnest(['nation', 'c_name', 'c_mktsegment', 'mixed']) AS \"column\", unnest(['Location', 'Person', 'Text', 'Text']) AS semantic_type, unnest([n, n, n, n]) AS n_values FROM x",
    "profile_language_learnt": f"""WITH c AS (SELECT doc_id, lang, {number_sql('text')} AS number, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, lang, number, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS g FROM c),
n AS (SELECT lang, gram, count(*) AS n FROM (SELECT lang, unnest(g) AS gram FROM g WHERE lang IS NOT NULL) GROUP BY ALL),
p AS (SELECT lang, list(gram) AS grams FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= 300) GROUP BY lang),
s AS (SELECT doc_id, p.lang AS language, len(list_intersect(g, grams)) AS k FROM g, p WHERE NOT number QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, p.lang DESC) = 1)
SELECT language, CAST(count(*) AS BIGINT) AS count FROM s WHERE k > 0 GROUP BY 1""",
    "profile_summary": "WITH o AS (SELECT o_custkey, o_totalprice, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority, o_orderstatus AS status FROM orders) " + _union(_summary_sql, ["o_custkey", "o_totalprice", "priority", "status"]),
    "majority_semantic_type": f"WITH {_MIXED}, x AS (SELECT *, CASE WHEN day > '2100-01-01' THEN day END AS gaps, CAST(length(number) AS VARCHAR) || ' - ' || CAST(length(day) AS VARCHAR) AS range FROM m) " + _union(lambda c: f"SELECT '{c}' AS \"column\", CASE WHEN (n - h) / CAST(n AS DOUBLE) >= 0.8 THEN 'MissingData' WHEN t / CAST(h AS DOUBLE) >= 0.8 THEN 'Time' WHEN f / CAST(h AS DOUBLE) >= 0.8 THEN 'Float' WHEN i / CAST(h AS DOUBLE) >= 0.8 THEN 'Interval' ELSE 'Text' END AS semantic_type, CAST(h AS BIGINT) AS n_values FROM (SELECT count(*) AS n, count(*) FILTER (WHERE trim({c}) <> '') AS h, count(*) FILTER (WHERE {_DATE.format(c)} IS NOT NULL) AS t, count(*) FILTER (WHERE {number_sql(c)}) AS f, count(*) FILTER (WHERE regexp_matches(trim({c}), '^[+-]?[0-9.]+\\s*(-|to)\\s*[+-]?[0-9.]+$')) AS i FROM x)", ["day", "american", "o_orderpriority", "number", "gaps", "range"]),
}
