"""Queries of what is done with hits, of remote sources' transforms and of generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave import api
from lodeweave.functions import html
from lodeweave.operators import catalog as store
from lodeweave.operators import generators, search
from lodeweave.plans import datasets
from lodeweave.queries.common import SQL, catalog, padded_sql, table
from lodeweave.sources import readers, remote, workbooks


def search_keywords(spark, d):
    """O-03: conjunctions of keyword arguments, and none."""
    c, segments = catalog(spark, d), table(spark, d, "customer").select(F.col("c_mktsegment").alias("term"))
    asked = {
        "all": datasets.query(c),
        "terms": datasets.query(c, segments, 0.5, query_string="sample nothing", key_values=[("keywords", "customer")]),
        "time": datasets.query(c, query_string="timestamp", start="2024-01-02", end="2024-01-03"),
        "ids": datasets.query(c, dataset_id=60_000, variable_id=60_002),
    }
    out = None
    for name, hits in asked.items():
        one = hits.select(F.lit(name).alias("asked"), "dataset_id", F.col("score").cast("bigint").alias("score"))
        out = one if out is None else out.union(one)
    return out


def search_columns_best(spark, d):
    """O-05."""
    return datasets.search_columns(catalog(spark, d), table(spark, d, "part").select("p_brand", "p_type"), columns=["p_brand", "p_type"])


def entity_constraints(spark, d):
    """Q-03."""
    terms = table(spark, d, "customer").select(F.col("c_mktsegment").alias("term")).union(table(spark, d, "nation").select("n_name"))
    hits = search.terms_hits(search.postings(catalog(spark, d)), terms, 0.1)
    return datasets.entity_constraints(hits).select("dataset_id", F.col("offset").cast("bigint").alias("off"), F.array_join("values", "|").alias("vals"))


def _described(name: str, d: str, dataset_id: int) -> dict:
    return {"dataset_id": dataset_id, "title": name, "materialization": {"source": "parquet", "arguments": {"url": f"{d}/{name}.parquet"}}}


def constrained_join(spark, d):
    """O-09: a table of event types and first days, joined to the events that its search matched, of its range of dates."""
    first = F.date_trunc("day", F.min("ts"))
    mine = table(spark, d, "events").groupBy("event_type").agg(first.alias("since")).where("event_type in ('error', 'purchase')")
    mine = mine.select(F.col("event_type").alias("kind"), F.explode(F.array("since", F.expr("since + interval 2 days"))).alias("day"))
    hits = search.terms_hits(search.postings(catalog(spark, d)), mine.select(F.col("kind").alias("term")))
    values = {3: [v for r in hits.where("dataset_id = 60000").select("values").collect() for v in r["values"]]}  # one row: one variable of one dataset
    joined = datasets.constrained_join(mine, _described("events", d, 60_000), values, [0], [3])
    return joined.select("kind", "day", "event_id")


def load_by_id(spark, d):
    """S-21: catalog id, description, table."""
    c = store.documents(spark, [_described("supplier", d, 10_000), _described("orders", d, 20_000)])
    return datasets.load_by_id(c, 20_000, constraints={"named_entity": {5: ["1-URGENT"]}}).select("o_orderkey", "o_orderstatus")


def generated_metadata(spark, d):
    """P-11, B-04 to B-06: the descriptions that profiling makes of whole tables."""
    tables = {"region": 0, "nation": 10_000}
    made = [api.generate_metadata(table(spark, d, t), {"dataset_id": i, "title": t}) for t, i in tables.items()]
    segments = table(spark, d, "orders").select("o_orderpriority", "o_orderdate")
    made.append(api.generate_metadata(segments, {"dataset_id": 20_000, "title": "orders"}))
    v = search.variables(store.documents(spark, made))
    return v.select("dataset_id", F.col("offset").cast("bigint").alias("off"), F.col("v.name").alias("name"), F.array_join("v.named_entity", "|").alias("entities"), F.col("v.temporal_coverage.start").alias("first"), F.col("v.temporal_coverage.end").alias("last"))


def year_chunks(spark, d):
    """S-10: each customer's years of orders, cut to requests of a year at most."""
    ranges = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("e"))
    return ranges.select("o_custkey", F.explode(remote.year_chunks(F.col("s"), F.col("e"))).alias("c")).select("o_custkey", F.date_format("c.start", "yyyy-MM-dd").alias("start"), F.date_format("c.end", "yyyy-MM-dd").alias("end"))


def common_station(spark, d):
    """S-10: for each event type a user seen on the first and the last day."""
    e = table(spark, d, "events").select("event_type", "user_id", "event_id", F.to_date("ts").alias("day"))
    ends = e.groupBy("event_type").agg(F.min("day").alias("s"), F.max("day").alias("e"))
    seen = e.join(F.broadcast(ends), "event_type").where("day in (s, e)")
    seen = seen.select("event_type", F.col("user_id").alias("station"), (F.col("day") == F.col("e")).alias("at_end"), F.col("event_id").alias("place"))
    return remote.common_station(seen, "event_type")


def paged_union(spark, d):
    """S-11: orders as pages of JSON, read back as one table."""
    o = table(spark, d, "orders")
    row = F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("value")).alias("country"))
    pages = o.groupBy("o_orderpriority", F.floor(F.col("o_orderkey") / 500).alias("page")).agg(F.to_json(F.collect_list(row)).alias("rows"))
    bodies = pages.select("o_orderpriority", F.concat(F.lit('[{"page":'), F.col("page").cast("string"), F.lit("},"), "rows", F.lit("]")).alias("body"))
    return remote.paged_union(bodies, "id bigint, country struct<value:string>").select("o_orderpriority", "id", F.col("country.value").alias("country"))


def area_years(spark, d):
    """S-14: rows of named places within years, of their first five columns."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_custkey", F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice")
    return remote.of_years(o, {"named_entity": {0: ["1-URGENT", "5-LOW"]}, "date_range": {"start": "1994-03-01", "end": "1996"}})


def key_entities(spark, d):
    """G-05: distinct values under each key of nested events."""
    e = table(spark, d, "events").select(F.from_json("props", "k bigint").alias("props"), F.struct(F.col("user_id").alias("id"), F.array("event_type").alias("kinds")).alias("who"))
    return generators.key_entities(e)


def page_tables(spark, d):
    """G-03."""
    return table(spark, d, "pages").select("page_id", generators.n_tables(F.col("html")).alias("n_tables"))


def html_tables(spark, d):
    """S-09, S-18: the rows of tables of all pages, whose lists are turned into tables."""
    page = F.col("html")
    for old, new in (("<ul>", '<table class="nav">'), ("</ul>", "</table>"), ("<li>", "<tr><td>"), ("</li>", "</td><td>x</td></tr>")):
        page = F.replace(page, F.lit(old), F.lit(new))
    rows = html.tables(table(spark, d, "pages").select("page_id", page.alias("html")), selector=".nav")
    return rows.select("page_id", F.col("table").cast("bigint").alias("tab"), F.col("row").cast("bigint").alias("line"), F.array_join("cells", "|").alias("cells"))


def workbook_tables(spark, d):
    """S-07, S-08, S-16: workbooks of a hundred parts each, written and read as rows, header and title told apart."""
    parts = table(spark, d, "part").select(F.expr("p_partkey div 100").cast("string").alias("book"), "p_partkey", "p_name", "p_brand", "p_type")
    rows = workbooks.tabular(workbooks.rows(workbooks.packed(parts, "book", "p_partkey", "Parts of the sample warehouse")))
    cell = lambda i, name: F.get("cells", F.lit(i)).alias(name)
    return rows.where("kind = 'data'").select(F.col("path").alias("book"), cell(0, "p_partkey"), cell(1, "p_name"), cell(2, "p_brand"), cell(3, "p_type"))


def template_documents(spark, d):
    """G-06: a description for each indicator of two lists (kinds of events, order priorities), with the nations as places."""
    events, orders, nations = table(spark, d, "events"), table(spark, d, "orders"), table(spark, d, "nation")
    mine = events.groupBy(F.col("event_type").alias("name")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    others = orders.groupBy(F.col("o_orderpriority").alias("name")).agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    rows = generators.united(mine, others, by="name").join(F.broadcast(nations.agg(F.array_sort(F.collect_set("n_name")).alias("places"))))  # one row: the nations
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    made = generators.templated(
        rows, F.concat(F.lit("indicator "), F.col("name")), "csv", {"url": F.concat(F.lit("http://data.example.org/"), F.col("name"))},
        [generators.Variable("place", "the place", ["https://schema.org/Country"], F.col("places")), generators.Variable("time", "the time", ["https://schema.org/DateTime"], start=iso("first"), end=iso("last")), generators.Variable("value", F.concat(F.lit("the value of "), F.col("name")))],
        description="by place and time", keywords=F.array("name", F.lit("indicator")),
    )
    v = F.col("variables")
    return made.select("title", F.array_join("keywords", ",").alias("keywords"), F.col("materialization.arguments")["url"].alias("url"), F.size(v[0]["named_entity"]).cast("bigint").alias("places"), v[1]["temporal_coverage"]["start"].alias("first"), v[1]["temporal_coverage"]["end"].alias("last"), v[2]["description"].alias("value"))


def category_sets(spark, d):
    """G-04: for each kind of event its users, and the union of the days of the week that users are seen on, 10 rows a page."""
    e = table(spark, d, "events").select("event_type", "user_id", F.dayofweek("ts").alias("day"))
    facts = e.join(readers.sets_by_key(e, "user_id", ["day"]).withColumnRenamed("day", "days"), "user_id")
    sets = generators.category_sets(facts, "event_type", "user_id", "days")
    return generators.paged(sets, ["event_type"], 2)


def csv_resources(spark, d):
    """G-07: pages as packages of resources."""
    p = table(spark, d, "pages")
    kind = F.get(F.array(F.lit("text/csv"), F.lit("application/pdf"), F.lit(None), F.lit("text/CSV")), (F.col("page_id") % 4).cast("int"))
    resource = F.struct(F.col("url"), kind.alias("mimetype"), F.lit("d").alias("description"), F.lit("2020-01-01").alias("created"))
    packages = p.select(F.col("page_id").cast("string").alias("title"), "url", F.array(F.struct(F.lit("t").alias("name")), F.struct(F.lit(None).cast("string").alias("name"))).alias("tags"), F.array(resource).alias("resources"))
    return generators.csv_resources(packages).select("title", "url", F.array_join("keywords", ",").alias("keywords"), F.col("date_published").alias("published"))


_NAMES = "search_keywords search_columns_best entity_constraints constrained_join load_by_id generated_metadata year_chunks common_station paged_union area_years key_entities page_tables html_tables workbook_tables template_documents category_sets csv_resources".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_POST = f", post AS (SELECT dataset_id, off, v AS value, {padded_sql('v')} AS p FROM (SELECT dataset_id, off, unnest(ents) AS v FROM vars))"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


def _asked(terms: str) -> str:
    return f", asked AS (SELECT DISTINCT lower(term) AS term, {padded_sql('term')} AS tp FROM ({terms}) WHERE term IS NOT NULL ORDER BY 1 LIMIT 1000)"


def _entities(name: str, of: str, dataset_id: int, off: int) -> str:
    return f"SELECT {dataset_id} AS dataset_id, {off} AS off, '{name}' AS name, (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT {name} AS x FROM {of})) AS entities, NULL AS first, NULL AS last"


def _plain(name: str, dataset_id: int, off: int) -> str:
    return f"SELECT {dataset_id}, {off}, '{name}', NULL, NULL, NULL"


ORACLES = {
    "search_keywords": f"""{SQL}{_POST}{_asked('SELECT c_mktsegment AS term FROM customer')}, h AS (SELECT dataset_id, off, count(DISTINCT term) AS n FROM post JOIN asked ON contains(p, tp) GROUP BY 1, 2)
SELECT 'all' AS asked, CAST(dataset_id AS BIGINT) AS dataset_id, CAST(1 AS BIGINT) AS score FROM sets
UNION ALL SELECT 'terms', CAST(h.dataset_id AS BIGINT), CAST(max(n) + 1 AS BIGINT) FROM h JOIN sets s ON s.dataset_id = h.dataset_id AND list_contains(keywords, 'customer') WHERE n >= ceil(0.5 * (SELECT count(*) FROM asked)) GROUP BY 2
UNION ALL SELECT DISTINCT 'time', CAST(dataset_id AS BIGINT), CAST(1 AS BIGINT) FROM vars WHERE date_trunc('second', s) <= TIMESTAMP '2024-01-02' AND date_trunc('second', e) >= TIMESTAMP '2024-01-03'
UNION ALL SELECT 'ids', CAST(60000 AS BIGINT), CAST(1 AS BIGINT)""",
    "search_columns_best": f"""{SQL}{_POST}, q AS (SELECT DISTINCT 0 AS c, lower(p_brand) AS term, {padded_sql('p_brand')} AS tp FROM part UNION ALL SELECT DISTINCT 1, lower(p_type), {padded_sql('p_type')} FROM part), n AS (SELECT c, count(*) AS k FROM q GROUP BY c),
h AS (SELECT q.c, dataset_id, off, count(DISTINCT term) AS m FROM post JOIN q ON contains(p, tp) GROUP BY 1, 2, 3), g AS (SELECT h.c, dataset_id, max(m) AS m FROM h JOIN n ON n.c = h.c WHERE m >= ceil(0.5 * k) GROUP BY 1, 2), r AS (SELECT g.*, row_number() OVER (PARTITION BY c ORDER BY m DESC, dataset_id) AS r FROM g)
SELECT CAST(c AS INTEGER) AS column_idx, CAST(dataset_id AS BIGINT) AS dataset_id, CAST(m AS BIGINT) AS n_terms, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 10""",
    "entity_constraints": f"""{SQL}{_POST}{_asked('SELECT c_mktsegment AS term FROM customer UNION ALL SELECT n_name FROM nation')} SELECT CAST(dataset_id AS BIGINT) AS dataset_id, CAST(off AS BIGINT) AS off, string_agg(DISTINCT value, '|' ORDER BY value) AS vals
FROM post JOIN asked ON contains(p, tp) GROUP BY 1, 2 HAVING count(DISTINCT term) >= ceil(0.1 * (SELECT count(*) FROM asked))""",
    "constrained_join": """WITH f AS (SELECT event_type AS kind, date_trunc('day', min(ts)) AS since FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1), m AS (SELECT kind, since AS day FROM f UNION ALL SELECT kind, since + INTERVAL 2 DAY FROM f)
SELECT kind, CAST(day AS TIMESTAMP) AS day, event_id FROM m LEFT JOIN (SELECT * FROM events WHERE event_type IN ('error', 'purchase') AND ts BETWEEN (SELECT min(day) FROM m) AND (SELECT max(day) FROM m)) e ON e.event_type = kind""",
    "load_by_id": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'",
    "generated_metadata": f"""SELECT CAST(dataset_id AS BIGINT) AS dataset_id, CAST(off AS BIGINT) AS off, name, entities, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last FROM ({_plain('r_regionkey', 0, 0).replace('SELECT 0, 0', 'SELECT 0 AS dataset_id, 0 AS off').replace("'r_regionkey', NULL, NULL, NULL", "'r_regionkey' AS name, CAST(NULL AS VARCHAR) AS entities, CAST(NULL AS VARCHAR) AS first, CAST(NULL AS VARCHAR) AS last")}
UNION ALL {_entities('r_name', 'region', 0, 1)} UNION ALL {_plain('n_nationkey', 10000, 0)} UNION ALL {_entities('n_name', 'nation', 10000, 1)} UNION ALL {_plain('n_regionkey', 10000, 2)}
UNION ALL {_entities('o_orderpriority', 'orders', 20000, 0)} UNION ALL SELECT 20000, 1, 'o_orderdate', NULL, (SELECT {_ISO.format('min(o_orderdate)')} FROM orders), (SELECT {_ISO.format('max(o_orderdate)')} FROM orders))""",
    "year_chunks": """WITH r AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1), c AS (SELECT o_custkey, e, k, CAST(s + to_years(CAST(k AS INTEGER)) AS DATE) AS a, CAST(s + to_years(CAST(k + 1 AS INTEGER)) AS DATE) AS b FROM r, generate_series(0, 20) g(k) WHERE k <= year(e) - year(s))
SELECT o_custkey, strftime(a, '%Y-%m-%d') AS start, strftime(least(b, e), '%Y-%m-%d') AS "end" FROM c WHERE k = 0 OR a < e""",
    "common_station": """WITH d AS (SELECT event_type, user_id, event_id, CAST(ts AS DATE) AS day, min(CAST(ts AS DATE)) OVER (PARTITION BY event_type) AS s, max(CAST(ts AS DATE)) OVER (PARTITION BY event_type) AS e FROM events),
u AS (SELECT event_type, user_id, min(event_id) FILTER (WHERE day = e) AS pe, min(event_id) FILTER (WHERE day = s AND s <> e) AS ps FROM d WHERE day IN (s, e) GROUP BY 1, 2)
SELECT event_type, user_id AS station FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN pe IS NOT NULL AND ps IS NOT NULL THEN 0 WHEN pe IS NOT NULL THEN 1 ELSE 2 END, coalesce(pe, ps)) AS r FROM u) WHERE r = 1""",
    "paged_union": "SELECT o_orderpriority, o_orderkey AS id, o_orderstatus AS country FROM orders",
    "area_years": "SELECT o_orderpriority, o_orderstatus, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND year(o_orderdate) BETWEEN 1994 AND 1996",
    "key_entities": """SELECT DISTINCT 'props_k' AS key, 'Text' AS semantic_type, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
UNION ALL SELECT DISTINCT 'who_id', 'Identifier', CAST(user_id AS VARCHAR) FROM events WHERE user_id IS NOT NULL UNION ALL SELECT DISTINCT 'who_kinds_0', 'Text', event_type FROM events WHERE event_type IS NOT NULL""",
    "html_tables": r"SELECT page_id, tab, CAST(line AS BIGINT) AS line, trim(regexp_replace(regexp_replace(replace(replace(replace(item, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '</?(a|b)( [^>]*)?>', '', 'g'), '\s+', ' ', 'g')) || '|x' AS cells FROM (SELECT page_id, tab, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS line FROM (SELECT page_id, CAST(k - 1 AS BIGINT) AS tab, regexp_extract_all(uls[k], '(?s)<li>(.*?)</li>', 1) AS items FROM (SELECT page_id, uls, unnest(range(1, len(uls) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1) AS uls FROM pages))))",
    "workbook_tables": "SELECT CAST(p_partkey // 100 AS VARCHAR) AS book, CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type FROM part",
    "template_documents": "WITH i AS (SELECT event_type AS name, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1 UNION ALL SELECT o_orderpriority, min(o_orderdate), max(o_orderdate) FROM orders WHERE o_orderpriority NOT IN (SELECT event_type FROM events) GROUP BY 1) SELECT 'indicator ' || name AS title, name || ',indicator' AS keywords, 'http://data.example.org/' || name AS url, (SELECT count(DISTINCT n_name) FROM nation) AS places, strftime(a, '%Y-%m-%dT%H:%M:%S') AS first, strftime(z, '%Y-%m-%dT%H:%M:%S') AS last, 'the value of ' || name AS value FROM i",
    "category_sets": "WITH u AS (SELECT DISTINCT user_id, CAST(dayofweek(ts) + 1 AS VARCHAR) AS day FROM events), p AS (SELECT event_type, count(DISTINCT e.user_id) AS n_subjects, string_agg(DISTINCT day, ';' ORDER BY day) AS categories FROM events e JOIN u ON u.user_id = e.user_id GROUP BY 1) SELECT *, (row_number() OVER (ORDER BY event_type) - 1) // 2 AS page FROM p",
    "page_tables": r"SELECT page_id, CAST(coalesce(len(regexp_extract_all(lower(html), '<table\b|\{\|')), 0) AS BIGINT) AS n_tables FROM pages",
    "csv_resources": "SELECT CAST(page_id AS VARCHAR) AS title, url, 't' AS keywords, '2020-01-01' AS published FROM pages WHERE page_id % 4 IN (0, 3)",
}
