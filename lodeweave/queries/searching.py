"""Queries of search and of the catalog, pages and recipes."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import html
from lodeweave.operators import catalog as store
from lodeweave.operators import recipes, search
from lodeweave.operators.index import TextIndex
from lodeweave.operators.log import CatalogLog
from lodeweave.plans import dsl, schema
from lodeweave.queries.common import SQL, catalog, padded_sql, table, words_sql
from lodeweave.session import shared_path
from lodeweave.sources import readers


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("term")).union(table(spark, d, "nation").select("n_name"))


def search_terms_ratio(spark, d):
    """Q-01."""
    hits = search.terms_hits(search.postings(catalog(spark, d)), table(spark, d, "part").select(F.col("p_brand").alias("term")), 0.5)
    return hits.select("dataset_id", F.col("offset").cast("bigint").alias("off"), "n_terms")


def search_terms_inner_hits(spark, d):
    """Q-02, Q-03."""
    hits = search.terms_hits(search.postings(catalog(spark, d)), _terms(spark, d), 0.1)
    return hits.select("dataset_id", F.col("offset").cast("bigint").alias("off"), "n_terms", F.array_join("terms", "|").alias("terms"), F.array_join("values", "|").alias("vals"))


def search_temporal(spark, d):
    """Q-04."""
    return catalog(spark, d).where(search.temporal("2024-01-02", "2024-01-03")).select("dataset_id")


def search_keyvalue_and(spark, d):
    """Q-05, Q-06: both hold on one variable."""
    return catalog(spark, d).where(search.key_values([("keywords", "sample"), ("variables.name", "o_orderdate"), ("variables.description", "dtype timestamp")])).select("dataset_id", "title")


def search_keyvalue_or(spark, d):
    """Q-06: any value of a list."""
    return catalog(spark, d).where(search.key_values([("variables.named_entity", ["FURNITURE", "signup"])], disjunctive=True)).select("dataset_id", "title")


def search_phrase(spark, d):
    """Phrases over the documents' texts."""
    docs = table(spark, d, "documents")
    return docs.where(F.coalesce(search.text.has_phrase(F.col("text"), F.lit("Of The")), F.lit(False))).select("doc_id")


def search_about(spark, d):
    """Q-08, Q-20."""
    return dsl.run(catalog(spark, d), {"dataset": {"about": "lineitem furniture"}}).select("dataset_id", "title")


def search_url(spark, d):
    """Q-07."""
    return catalog(spark, d).where(search.url_is("http://data.example.org/part.csv")).select("dataset_id")


def search_required_and(spark, d):
    """Q-24, Q-29: every required variable."""
    q = {"required_variables": [{"type": "generic_entity", "about": "timestamp"}, {"type": "generic_entity", "named_entities": {"items": ["purchase", "1-URGENT"]}}]}
    return dsl.run(catalog(spark, d), q).select("dataset_id", "title")


def search_desired_or(spark, d):
    """Q-25, Q-28: one of the desired variables."""
    q = {"desired_variables": [{"type": "geospatial_entity", "named_entities": {"items": ["ASIA", "EUROPE"]}}, {"type": "generic_entity", "variable_name": "lang"}]}
    return dsl.run(catalog(spark, d), q).select("dataset_id", "title")


def search_date_range(spark, d):
    """Q-23."""
    q = {"dataset": {"date_published": {"after": "2012-01-01", "before": "2016-06-30"}}}
    return dsl.run(catalog(spark, d), q).select("dataset_id")


def search_dataframe_columns(spark, d):
    """Q-26, O-06: a table's columns."""
    q = {"required_variables": [{"type": "dataframe_columns", "names": ["c_mktsegment"]}]}
    hits = dsl.run(catalog(spark, d), q, table(spark, d, "customer"))
    return hits.select("dataset_id", F.col("score").cast("bigint").alias("score"), F.col("matches")[0]["offset"].cast("bigint").alias("off"))


def search_fanout_dedup(spark, d):
    """O-02."""
    p = table(spark, d, "part")
    terms = p.select(F.lit("p_type").alias("column"), F.lit(0).alias("place"), F.col("p_type").alias("term")).union(p.select(F.lit("p_brand"), F.lit(1), "p_brand"))
    hits = search.fan_out(search.postings(catalog(spark, d)), terms)
    return hits.select("dataset_id", F.col("column").alias("col"), "n_terms")


def search_bm25_topk(spark, d):
    """Q-11, Q-14: from an index of the texts."""
    index = TextIndex.build(table(spark, d, "documents"), "doc_id", "text", shared_path(spark, "texts"))
    return index.score("worthless the of and", 20).withColumnRenamed("key", "doc_id")


def search_scored(spark, d):
    """Q-08, Q-14: hits by the relevance of their descriptions, from an index of these."""
    c = catalog(spark, d)
    texts = TextIndex.build(c, "dataset_id", search.document_text(), shared_path(spark, "descriptions"))
    hits = dsl.run(c, {"dataset": {"about": "lineitem orders timestamp furniture table"}}, texts=texts)
    return hits.select("dataset_id", F.round("score", 5).alias("score"))


def catalog_next_id(spark, d):
    """B-02."""
    return store.next_id(catalog(spark, d))


def _news(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(spark, d)
    changed = c.where("dataset_id in (20000, 60000)").withColumns({"title": F.concat(F.lit("new "), F.col("title")), "dataset_id": F.lit(None).cast("bigint")})
    fresh = c.where("dataset_id <= 10000").withColumns({"title": F.concat(F.lit("copy of "), F.col("title")), "materialization": F.struct(F.lit("csv").alias("source"), F.col("materialization.arguments").alias("arguments"))})
    return changed.unionByName(fresh)


def catalog_upsert(spark, d):
    """B-03, B-07, B-12."""
    out = store.upsert(catalog(spark, d), _news(spark, d))
    return out.select("dataset_id", "title", F.array_join(F.transform("variables", lambda v: v["dataset_id"].cast("string")), ",").alias("ids"))


def catalog_log(spark, d):
    """B-07, B-08, B-12: two batches of a log, the second with new and renewed descriptions, taken twice."""
    log = CatalogLog(spark, shared_path(spark, "log"))
    log.append(catalog(spark, d), "first")
    for _ in range(2):
        log.append(_news(spark, d), "second")
    return log.read().select("dataset_id", "title", F.array_join(F.transform("variables", lambda v: v["dataset_id"].cast("string")), ",").alias("ids"))


def bulk_validation(spark, d):
    """B-16: descriptions of documents, of which four in five have something wrong."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    source = F.struct(F.lit("csv").alias("source"))
    good = F.to_json(F.struct(F.col("lang").alias("title"), F.array("source", "lang").alias("keywords"), source.alias("materialization")))
    many = F.array(F.struct(F.lit("a").alias("name"), F.struct(F.lit("2020").alias("start")).alias("temporal_coverage")), F.struct(F.lit("b").alias("name"), F.struct(F.lit("2020").alias("start")).alias("temporal_coverage")))
    wrong_list = F.replace(F.to_json(F.struct(many.alias("variables"), source.alias("materialization"))), F.lit('"b","temporal_coverage":{"start":"2020"}'), F.lit('"b","temporal_coverage":{"start":2020}'))
    kinds = F.array(good, F.to_json(F.struct(F.col("n_chars").alias("title"), source.alias("materialization"))), F.to_json(F.struct(F.col("source").alias("keywords"))), wrong_list, F.substring(good, 1, 9))
    lines = docs.select("doc_id", F.get(kinds, (F.col("doc_id") % 5).cast("int")).alias("line"))
    return schema.violations(lines).select("doc_id", F.array_join("violations", "; ").alias("violations"))


def pages_loaded(spark, d):
    """H-06: pages given as text or as an address that was fetched."""
    p = table(spark, d, "pages").select("page_id", "url", "html")
    sources = p.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.col("html")).alias("source"))
    answers = p.where("page_id % 4 = 0").select("url", F.col("html").alias("body"))
    return html.loaded(sources, answers=answers).select("page_id", "url", F.length("html").cast("bigint").alias("chars"), F.md5("html").alias("digest"))


def catalog_existing(spark, d):
    """B-11."""
    return store.existing(catalog(spark, d), _news(spark, d)).select("title")


def catalog_intersection(spark, d):
    """B-17."""
    c = catalog(spark, d)
    return store.intersection(c.select("dataset_id", "title"), c.where(search.any_field("timestamp")), c.where(search.key_values([("keywords", "orders")], phrase=False))).select("dataset_id", "title")


def links_extract(spark, d):
    """H-01."""
    return html.links(table(spark, d, "pages"))


def links_filter(spark, d):
    """H-03, H-04: addresses of pages by whether they could be data, and titles by whether they tell anything."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.element_at(F.array(*map(F.lit, (".csv", ".PDF", "", ".html#x", ".json"))), (F.col("page_id") % 5 + 1).cast("int"))).alias("u"), F.concat(F.lit("Get "), F.when(F.col("page_id") % 3 == 0, "Data").otherwise("prices")).alias("t"))
    return p.select("page_id", html.looks_like_data(F.col("u")).alias("data"), html.dull_title(F.col("t")).alias("dull"))


def page_description(spark, d):
    """H-02; every other page is given a meta description, whose attributes stand the other way round."""
    meta = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta content="Page &amp; number '), F.col("page_id").cast("string"), F.lit('" name="description">'))).otherwise("")
    return table(spark, d, "pages").select("page_id", html.description(F.concat("html", meta)).alias("description"))


def url_valid(spark, d):
    """H-05."""
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.replace("url", F.lit("http"), F.lit("gopher"))).otherwise(F.col("url")).alias("u"))
    return p.select("page_id", html.url_valid(F.col("u")).alias("valid"))


def json_flatten(spark, d):
    """S-06."""
    events = table(spark, d, "events")
    one = events.select("event_id", F.struct(F.from_json("props", "k bigint").alias("props"), F.array("event_type", F.col("user_id").cast("string")).alias("who")).alias("e"))
    flat = readers.flattened(one)
    return flat.select("event_id", F.col("`e.props.k`").alias("k"), F.col("`e.who.0`").alias("who_0"), F.col("`e.who.1`").alias("who_1"))


def collect_set_concat(spark, d):
    """S-19."""
    return readers.sets_by_key(table(spark, d, "events").select("user_id", "event_type", F.dayofweek("ts").alias("day")), "user_id", ["event_type", "day"])


def pivot_mean(spark, d):
    """R-02."""
    return recipes.pivoted_means(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity")


def group_mean(spark, d):
    """R-01."""
    return recipes.means(table(spark, d, "events"), ["event_type"], ["value"]).withColumnRenamed("value", "mean")


def implicit_variables(spark, d):
    """P-13."""
    return readers.with_implicit(table(spark, d, "nation").select("n_nationkey"), [{"name": "year", "value": "2007"}, {"value": ""}, {"value": "x"}])


def constraint_filter(spark, d):
    """S-03, S-14: predicates pushed to the scan."""
    e = table(spark, d, "events").select("event_id", "ts", "event_type")
    return e.where(readers.constraint(e, {"named_entity": {2: ["purchase", "error"]}, "date_range": {"start": "2024-01-02", "end": "2024-01-04"}})).select("event_id", "event_type")


def head_n(spark, d):
    """S-21."""
    return recipes.head(table(spark, d, "orders"), ["o_orderkey"], 25, ["o_orderkey", "o_orderstatus"])


_NAMES = "search_terms_ratio search_terms_inner_hits search_temporal search_keyvalue_and search_keyvalue_or search_phrase search_about search_url search_required_and search_desired_or search_date_range search_dataframe_columns search_fanout_dedup search_bm25_topk search_scored catalog_next_id catalog_log bulk_validation pages_loaded catalog_upsert catalog_existing catalog_intersection links_extract links_filter page_description url_valid json_flatten collect_set_concat pivot_mean group_mean implicit_variables constraint_filter head_n".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_LINK = '(?is)<a href="([^"]*)"[^>]*>(.*?)</a>'
_decoded = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
    _decoded = f"replace({_decoded}, '{_name}', '{_char}')"

_POST = f", post AS (SELECT dataset_id, off, v AS value, {padded_sql('v')} AS p FROM (SELECT dataset_id, off, unnest(ents) AS v FROM vars))"
_HITS = "SELECT dataset_id, off, count(DISTINCT term) AS n_terms, list_sort(list_distinct(list(term))) AS terms, list_sort(list_distinct(list(value))) AS vs FROM post JOIN asked ON contains(p, tp) AND tp <> '  ' GROUP BY 1, 2"


def _asked(terms: str) -> str:
    return f", asked AS (SELECT DISTINCT lower(term) AS term, {padded_sql('term')} AS tp FROM ({terms}) WHERE term IS NOT NULL ORDER BY 1 LIMIT 1000)"


_P_BRAND = "SELECT p_brand AS term FROM part"
_BOTH = "SELECT c_mktsegment AS term FROM customer UNION ALL SELECT n_name FROM nation"
_DOCTEXT = ", alltext AS (SELECT s.dataset_id, s.title, concat_ws(' ', s.title, s.description, s.url, array_to_string(s.keywords, ' '), (SELECT string_agg(concat_ws(' ', v.name, 'column name dtype ' || CASE WHEN v.ents IS NULL THEN 'timestamp' ELSE 'string' END, array_to_string(coalesce(v.ents, []), ' ')), ' ') FROM vars v WHERE v.dataset_id = s.dataset_id)) AS t FROM sets s)"
_BM = ["and", "of", "the", "worthless"]
_CNT = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS n{i}" for i, w in enumerate(_BM))
_DF = ", ".join(f"count(*) FILTER (WHERE n{i} > 0) AS d{i}" for i in range(len(_BM)))
_SCORE = " + ".join(f"CASE WHEN n{i} > 0 THEN ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * n{i} * 2.2 / (n{i} + 1.2 * (0.25 + 0.75 * len / mean)) ELSE 0 END" for i in range(len(_BM)))
_FULLTEXT = ", fulltext AS (SELECT s.dataset_id, concat_ws(' ', s.title, s.description, s.url, array_to_string(s.keywords, ' '), (SELECT string_agg(concat_ws(' ', v.name, 'column name ' || v.name || ' dtype ' || CASE WHEN v.ents IS NULL THEN 'timestamp' ELSE 'string' END, array_to_string(coalesce(v.ents, []), ' ')), ' ') FROM vars v WHERE v.dataset_id = s.dataset_id)) AS t FROM sets s)"
_ABOUT = ["furniture", "lineitem", "orders", "table", "timestamp"]
_ABOUT_CNT = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS n{i}" for i, w in enumerate(_ABOUT))
_ABOUT_DF = ", ".join(f"count(*) FILTER (WHERE n{i} > 0) AS d{i}" for i in range(len(_ABOUT)))
_ABOUT_SCORE = " + ".join(f"CASE WHEN n{i} > 0 THEN ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * n{i} * 2.2 / (n{i} + 1.2 * (0.25 + 0.75 * len / mean)) ELSE 0 END" for i in range(len(_ABOUT)))
_ABOUT_ANY = " OR ".join(f"n{i} > 0" for i in range(len(_ABOUT)))
_OWN = "'column name: ' || v.name || ', dtype: ' || CASE WHEN v.ents IS NULL THEN 'timestamp' ELSE 'string' END"
_URL = html.URL
#: The same pattern for texts whose A-Z are small, with what Spark's regular expressions mean by white space and by a text's end, before a last line break too.
_ADDRESS = _URL.removeprefix("(?i)").replace("A-Z", "a-z").replace(r"\S", r"[^ \t\n\x0B\f\r]").replace("$", r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?$")
_ENDS = "['.csv', '.PDF', '', '.html#x', '.json']"
ORACLES = {
    "search_terms_ratio": f"{SQL}{_POST}{_asked(_P_BRAND)}, h AS ({_HITS}) SELECT CAST(dataset_id AS BIGINT) AS dataset_id, CAST(off AS BIGINT) AS off, CAST(n_terms AS BIGINT) AS n_terms FROM h WHERE n_terms >= ceil(0.5 * (SELECT count(*) FROM asked))",
    "search_terms_inner_hits": f"{SQL}{_POST}{_asked(_BOTH)}, h AS ({_HITS}) SELECT CAST(dataset_id AS BIGINT) AS dataset_id, CAST(off AS BIGINT) AS off, CAST(n_terms AS BIGINT) AS n_terms, array_to_string(terms, '|') AS terms, array_to_string(vs, '|') AS vals FROM h WHERE n_terms >= ceil(0.1 * (SELECT count(*) FROM asked))",
    "search_temporal": f"{SQL} SELECT DISTINCT CAST(dataset_id AS BIGINT) AS dataset_id FROM vars WHERE date_trunc('second', s) <= TIMESTAMP '2024-01-02' AND date_trunc('second', e) >= TIMESTAMP '2024-01-03'",
    "search_keyvalue_and": f"{SQL} SELECT CAST(s.dataset_id AS BIGINT) AS dataset_id, title FROM sets s WHERE list_contains(keywords, 'sample') AND EXISTS (SELECT 1 FROM vars v WHERE v.dataset_id = s.dataset_id AND name = 'o_orderdate' AND contains({padded_sql(_OWN)}, ' dtype timestamp '))",
    "search_keyvalue_or": f"{SQL}{_POST} SELECT DISTINCT CAST(s.dataset_id AS BIGINT) AS dataset_id, title FROM sets s JOIN post p ON p.dataset_id = s.dataset_id WHERE contains(p.p, ' furniture ') OR contains(p.p, ' signup ')",
    "search_phrase": f"SELECT doc_id FROM documents WHERE contains({padded_sql('text')}, ' of the ')",
    "search_about": f"{SQL}{_DOCTEXT} SELECT CAST(dataset_id AS BIGINT) AS dataset_id, title FROM alltext WHERE len(list_intersect({words_sql('t')}, ['lineitem', 'furniture'])) > 0",
    "search_url": f"{SQL} SELECT CAST(dataset_id AS BIGINT) AS dataset_id FROM sets WHERE url = 'http://data.example.org/part.csv'",
    "search_required_and": f"{SQL}{_POST} SELECT CAST(s.dataset_id AS BIGINT) AS dataset_id, title FROM sets s WHERE EXISTS (SELECT 1 FROM vars v WHERE v.dataset_id = s.dataset_id AND v.ents IS NULL) AND EXISTS (SELECT 1 FROM post p WHERE p.dataset_id = s.dataset_id AND (contains(p.p, ' purchase ') OR contains(p.p, ' 1 urgent ')))",
    "search_desired_or": f"{SQL}{_POST}, g AS (SELECT dataset_id FROM post WHERE contains(p, ' asia ') OR contains(p, ' europe ') GROUP BY dataset_id, off) SELECT CAST(dataset_id AS BIGINT) AS dataset_id, title FROM sets WHERE dataset_id IN (SELECT dataset_id FROM g UNION SELECT dataset_id FROM vars WHERE contains({padded_sql('name')}, ' lang '))",
    "search_date_range": f"{SQL} SELECT CAST(dataset_id AS BIGINT) AS dataset_id FROM sets WHERE published BETWEEN DATE '2012-01-01' AND DATE '2016-06-30'",
    "search_dataframe_columns": f"{SQL}{_POST}{_asked('SELECT c_mktsegment AS term FROM customer')}, h AS ({_HITS}) SELECT CAST(dataset_id AS BIGINT) AS dataset_id, CAST(n_terms + 1 AS BIGINT) AS score, CAST(off AS BIGINT) AS off FROM h WHERE n_terms >= ceil(0.5 * (SELECT count(*) FROM asked))",
    "search_fanout_dedup": f"{SQL}{_POST}, q AS (SELECT DISTINCT 'p_type' AS col, 0 AS place, lower(p_type) AS term, {padded_sql('p_type')} AS tp FROM part UNION ALL SELECT DISTINCT 'p_brand', 1, lower(p_brand), {padded_sql('p_brand')} FROM part), n AS (SELECT col, count(*) AS k FROM q GROUP BY col), h AS (SELECT q.col, place, dataset_id, off, count(DISTINCT term) AS n_terms FROM post JOIN q ON contains(p, tp) GROUP BY 1, 2, 3, 4), g AS (SELECT h.*, row_number() OVER (PARTITION BY dataset_id ORDER BY place, n_terms DESC, off) AS r FROM h JOIN n ON n.col = h.col WHERE n_terms >= ceil(0.5 * k)) SELECT CAST(dataset_id AS BIGINT) AS dataset_id, col, CAST(n_terms AS BIGINT) AS n_terms FROM g WHERE r = 1",
    "search_bm25_topk": f"WITH t AS (SELECT doc_id, {words_sql(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS t FROM documents), c AS (SELECT doc_id, len(t) AS len, {_CNT} FROM t), s AS (SELECT count(*) AS docs, avg(len) AS mean, {_DF} FROM c) SELECT doc_id, round({_SCORE}, 6) AS score FROM c, s WHERE n0 + n1 + n2 + n3 > 0 ORDER BY 2 DESC, 1 LIMIT 20",
    "search_scored": f"{SQL}{_FULLTEXT}, t AS (SELECT dataset_id, {words_sql('t')} AS t FROM fulltext), c AS (SELECT dataset_id, len(t) AS len, {_ABOUT_CNT} FROM t), s AS (SELECT count(*) AS docs, avg(len) AS mean, {_ABOUT_DF} FROM c) SELECT CAST(dataset_id AS BIGINT) AS dataset_id, round({_ABOUT_SCORE}, 5) AS score FROM c, s WHERE {_ABOUT_ANY}",
    "catalog_next_id": f"{SQL} SELECT CAST(coalesce(max(dataset_id) + 10000, 0) AS BIGINT) AS next_id FROM sets",
    "catalog_upsert": f"""{SQL}, cur AS (SELECT dataset_id, CASE WHEN dataset_id IN (20000, 60000) THEN 'new ' || title ELSE title END AS title, dataset_id AS src FROM sets
UNION ALL SELECT 90000 + 10000 * (row_number() OVER (ORDER BY title) - 1), 'copy of ' || title, dataset_id FROM sets WHERE dataset_id <= 10000)
SELECT CAST(dataset_id AS BIGINT) AS dataset_id, title, (SELECT string_agg(CAST(cur.dataset_id + v.off + 1 AS VARCHAR), ',' ORDER BY v.off) FROM vars v WHERE v.dataset_id = src) AS ids FROM cur""",
    "catalog_log": f"""{SQL}, one AS (SELECT 10000 * (row_number() OVER (ORDER BY title) - 1) AS id, title, dataset_id AS src FROM sets),
cur AS (SELECT id, CASE WHEN src IN (20000, 60000) THEN 'new ' || title ELSE title END AS title, src FROM one UNION ALL SELECT 90000 + 10000 * (row_number() OVER (ORDER BY title) - 1), 'copy of ' || title, dataset_id FROM sets WHERE dataset_id <= 10000)
SELECT CAST(id AS BIGINT) AS dataset_id, title, (SELECT string_agg(CAST(cur.id + v.off + 1 AS VARCHAR), ',' ORDER BY v.off) FROM vars v WHERE v.dataset_id = src) AS ids FROM cur""",
    "bulk_validation": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'title must be a text' WHEN 2 THEN 'keywords must be a list; materialization is required' WHEN 3 THEN 'variables[1].temporal_coverage.start must be a text' ELSE 'no JSON document' END AS violations FROM documents",
    "pages_loaded": f"""WITH s AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE html END AS source FROM pages),
k AS (SELECT page_id, source, coalesce(regexp_matches(source, '^(http|ftp)') AND regexp_matches(translate(source, '{ascii_uppercase}', '{ascii_lowercase}'), '{_ADDRESS}'), false) AS is_url FROM s),
a AS (SELECT url AS asked, min(html) AS body FROM pages WHERE page_id % 4 = 0 GROUP BY url),
r AS (SELECT page_id, CASE WHEN is_url THEN source END AS url, CASE WHEN is_url THEN body ELSE source END AS page FROM k LEFT JOIN a ON is_url AND source = asked)
SELECT page_id, url, CAST(length(page) AS BIGINT) AS chars, md5(page) AS digest FROM r""",
    "catalog_existing": f"{SQL} SELECT 'new ' || title AS title FROM sets WHERE dataset_id IN (20000, 60000)",
    "catalog_intersection": f"{SQL} SELECT CAST(dataset_id AS BIGINT) AS dataset_id, title FROM sets WHERE dataset_id IN (SELECT dataset_id FROM vars WHERE ents IS NULL) AND list_contains(keywords, 'orders')",
    "links_filter": f"WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || list_extract({_ENDS}, CAST(page_id % 5 + 1 AS BIGINT)) AS u FROM pages) SELECT page_id, lower(regexp_extract(u, '\\.([^./#]*)(?:#[^/]*)?$', 1)) NOT IN ({', '.join(repr(x) for x in html.SKIPPED_SUFFIXES)}) AS data, page_id % 3 = 0 AS dull FROM p",
    "links_extract": f"SELECT page_id, trim(text) AS text, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href ELSE href END AS href FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS href, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS text FROM pages)",
    "page_description": f"SELECT page_id, concat_ws(chr(10), nullif(trim({_decoded}), ''), CASE WHEN page_id % 2 = 0 THEN 'Page & number ' || page_id END) AS description FROM pages",
    "url_valid": f"SELECT page_id, regexp_matches(CASE WHEN page_id % 4 = 0 THEN replace(url, 'http', 'gopher') ELSE url END, '{_URL}') AS valid FROM pages",
    "json_flatten": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS who_0, CAST(user_id AS VARCHAR) AS who_1 FROM events",
    "collect_set_concat": "SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS event_type, string_agg(DISTINCT CAST(dayofweek(ts) + 1 AS VARCHAR), ';' ORDER BY CAST(dayofweek(ts) + 1 AS VARCHAR)) AS day FROM events GROUP BY user_id",
    "pivot_mean": "SELECT l_returnflag, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS F, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS O FROM lineitem GROUP BY 1",
    "group_mean": "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "implicit_variables": "SELECT n_nationkey, '2007' AS year, 'x' AS implicit_variable_2 FROM nation",
    "constraint_filter": "SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'error') AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-04'",
    "head_n": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY 1 LIMIT 25",
}
