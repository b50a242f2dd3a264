"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Each window of a test item (10 consecutive words; a shorter item is one window) is looked up by its two
rarest terms. How often the benchmark's terms occur in the training documents is counted first, map-side;
then the index stores the postings (term, document, position) of the chosen terms alone. The posting
lists of a window's rarest and second rarest term, each shifted by the term's offset in the item, are
intersected: equal shifts are candidates for the phrase, shifts that differ by at most ``SLOP`` words are
proximity matches. Of a candidate, that stretch alone of the document that the item would cover is cut out and
compared with the item's words; what matches is handed on as intervals of positions.

Windows whose rarest term doesn't occur can't match and are dropped there. Tables that follow the
benchmark (its terms, its windows) or the matches are broadcast only if their rows and bytes are counted to be
few; beyond, the same joins shuffle. Terms with long posting lists aren't shuffled by term while the benchmark
is within that bound.

Cases: null texts have no words; such documents have 0 words and no hits, such items never match;
several items with equal texts each match; rows with equal id and text are each given the same
result; extra columns are ignored; an empty benchmark contaminates nothing; empty documents give an
empty result. Documents are told apart by a 64-bit hash of id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm._store import bounded, forget, stored

WINDOW = 10
SLOP = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII but for digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z lower-cased: ``translate`` makes a string of every character, so ASCII words take ``lower``, which does the same to them."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def cased_words(text: Column) -> Column:
    """Words in order, in the case they have. Cutting between them costs a fraction of matching each."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words in order."""
    return F.transform(cased_words(text), lowered)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of both: rows with equal keys are alike, and so are their results."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words) of each item that has words."""
    return stored(benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0").distinct(), "decontam-items")


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, key, pos) of every occurrence of the given terms."""
    found = docs.select("key", F.posexplode(cased_words(F.col("text"))).alias("pos", "word")).withColumn("term", lowered(F.col("word")))
    return found.join(bounded(terms), "term", "left_semi").select("term", "key", "pos")


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of the terms occurs, stored; summed map-side."""
    found = docs.select(F.explode(cased_words(F.col("text"))).alias("word")).select(lowered(F.col("word")).alias("term"))
    return stored(found.join(bounded(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")), "decontam-terms")


def rarest(items: DataFrame, frequency: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item, a, term_a, b, term_b): of each window the offsets of its rarest and second rarest terms (b is null in windows of one word)."""
    tokens = items.select("item", F.size("words").alias("size"), F.posexplode("words").alias("at", "term"))
    counted = tokens.join(bounded(frequency), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    window = Window.partitionBy("item").orderBy("at").rowsBetween(0, n - 1)
    ranked = F.array_sort(F.collect_list(F.struct("n", "at", "term")).over(window))
    starts = counted.withColumn("r", ranked).where((F.col("at") == 0) | (F.col("at") <= F.col("size") - n))
    first, second = F.col("r")[0], F.get("r", F.lit(1))
    return stored(starts.where("r[0].n > 0").select("item", first["at"].alias("a"), first["term"].alias("term_a"), second["at"].alias("b"), second["term"].alias("term_b")).distinct(), "decontam-rarest")


def matches(index: DataFrame, pairs: DataFrame, slop: int = SLOP) -> DataFrame:
    """(key, item, shift, exact): where the two rarest terms of a window stand as in the item, or within ``slop`` words of that."""
    first = index.join(bounded(pairs.withColumnRenamed("term_a", "term")), "term").select("key", "item", "a", "b", (F.col("pos") - F.col("a")).alias("shift"))
    second = index.join(bounded(pairs.where("b is not null").withColumnRenamed("term_b", "term")), "term").select("key", "item", "a", "b", (F.col("pos") - F.col("b")).alias("other"))
    step = slop + 1
    cell = lambda c: F.floor(F.col(c) / step)
    # the rarer term's list is the one that is written into three cells
    near = first.where("b is not null").withColumn("cell", F.explode(F.array(cell("shift") - 1, cell("shift"), cell("shift") + 1)))
    both = near.join(second.withColumn("cell", cell("other")), ["key", "item", "a", "b", "cell"]).where(F.abs(F.col("shift") - F.col("other")) <= slop)
    found = both.select("key", "item", "shift", (F.col("shift") == F.col("other")).alias("exact")).union(first.where("b is null").select("key", "item", "shift", F.lit(True)))
    return stored(found.groupBy("key", "item", "shift").agg(F.max("exact").alias("exact")), "decontam-matches")


def covered(docs: DataFrame, items: DataFrame, found: DataFrame, n: int = WINDOW) -> DataFrame:
    """(key, item_id, begin, end): stretches of positions that whole windows of the item cover, of the candidates (key, item, shift)."""
    sized = found.join(bounded(items.select("item", F.size("words").alias("size"))), "item")
    held = bounded(sized.groupBy("key").agg(F.collect_list(F.struct("item", "shift", "size")).alias("c")))
    # (item, shift, the document's words where the item would stand) of each candidate; the words are made once a document
    cut = lambda w, c: F.struct(c["item"].alias("item"), c["shift"].alias("shift"), F.slice(w, F.greatest(c["shift"], F.lit(0)) + 1, c["size"] + F.least(c["shift"], F.lit(0))).alias("there"))
    stretches = F.flatten(F.transform(F.array(words_of(F.col("text"))), lambda w: F.transform("c", lambda c: cut(w, c))))
    rows = docs.join(held, "key").select("key", F.explode(stretches).alias("s")).select("key", "s.item", "s.shift", "s.there")
    rows = rows.join(bounded(items), "item")
    lost = F.greatest(-F.col("shift"), F.lit(0))  # words of the item that would stand before the document
    same = F.transform("words", lambda x, i: F.coalesce(F.get("there", i - lost) == x, F.lit(False)))
    rows = rows.select("key", "item_id", "shift", same.alias("same"))
    size = F.least(F.size("same"), F.lit(n))
    whole = F.transform(F.sequence(F.lit(0), F.size("same") - size), lambda s: F.forall(F.slice("same", s + 1, size), lambda x: x))
    rows = rows.select("key", "item_id", "shift", size.alias("n"), whole.alias("whole")).where(F.array_contains("whole", True))
    edge = lambda side: F.filter(F.transform("whole", lambda x, i: F.when(x & ~F.coalesce(F.get("whole", i + side), F.lit(False)), i)), lambda i: i.isNotNull())
    runs = rows.select("key", "item_id", "shift", "n", F.explode(F.arrays_zip(edge(-1).alias("first"), edge(1).alias("last"))).alias("r"))
    return runs.select("key", "item_id", (F.col("shift") + F.col("r.first")).alias("begin"), (F.col("shift") + F.col("r.last") + F.col("n")).alias("end")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items (ids of items with whole windows), n_near (items with proximity or phrase matches).

    docs (doc_id, text), benchmark (item_id, text). text_key: a 64-bit hash of the text.
    """
    rows = keyed(docs)
    items = items_of(benchmark)
    frequency = frequencies(rows, items.select(F.explode("words").alias("term")).distinct())
    pairs = rarest(items, frequency, n)
    chosen = pairs.select(F.col("term_a").alias("term")).union(pairs.where("term_b is not null").select("term_b")).distinct()
    index = stored(occurrences(rows, chosen), "decontam-index")
    found = matches(index, pairs, slop)
    forget(index, frequency, pairs)
    spans = stored(covered(rows, items, found.where("exact"), n), "decontam-spans")
    # the length of a document's spans' union: what each adds beyond the furthest end before it
    before = Window.partitionBy("key").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    added = F.greatest(F.col("end") - F.greatest("begin", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    hits = spans.groupBy("key", "begin").agg(F.max("end").alias("end")).select("key", added.alias("added")).groupBy("key").agg(F.sum("added").alias("n_hit"))
    names = spans.groupBy("key").agg(F.collect_set("item_id").alias("items"))
    near = found.groupBy("key").agg(F.count_distinct("item").alias("n_near"))
    per_doc = stored(near.join(hits, "key", "left").join(names, "key", "left"), "decontam-docs")
    forget(spans, found, items)
    counted = rows.select("key", "doc_id", F.xxhash64("text").alias("text_key"), F.size(cased_words(F.col("text"))).cast("bigint").alias("n_words"))
    nothing = F.array().cast(per_doc.schema["items"].dataType)
    out = counted.join(bounded(per_doc), "key", "left")
    return out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", nothing).alias("items"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hits and matching benchmark items of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda s: array_to_string(w[s:s + 9], ' '))) AS g FROM b WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT r, s.n, unnest(range(1, len(w) - s.n + 2)) AS p, unnest(list_transform(range(1, len(w) - s.n + 2), lambda p: array_to_string(w[p:p + s.n - 1], ' '))) AS g FROM d, sizes s WHERE len(w) >= s.n
), m AS (
  SELECT DISTINCT r, item_id, p, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), hit AS (
  SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM m) GROUP BY r
), it AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
