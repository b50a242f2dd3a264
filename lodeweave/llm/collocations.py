"""Collocations: frequent word sequences, level by level, and how firmly they hold together.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words at blanks
and tabs. Level 1 counts words for each language; level k counts the sequences of k words whose two
overlapping sequences of k - 1 words are frequent (``support`` occurrences or more). What is
broadcast between levels is the set of frequent (k - 1)-grams as bits at their hashes: ``BITS`` bits
at most, whatever the vocabulary. A bit that stands for two sequences only lets a rare one be
counted in vain: its count is exact and below ``support``, so it goes with the others. Levels are
stored tables of the frequent sequences and their counts; a text is counted in parts of a few MB,
each part as rows that Spark sums map-side and then by (lang, phrase).

Each cut of a candidate finds the counts of its two parts in the level tables, whose rows are there
since a part is at least as frequent as the whole. Products are decimals of 38 digits: counts may
have 15.

The last step keeps the best ``top`` of each language by rounds: candidates are dealt out by hash
into groups of some ``GROUP``, each keeps its best ``top``, until a language is one group.

Cases: a null text has no words, a null language is ``und``; an empty table gives an empty result;
repeated rows count each; a word of any length is a word; a language without candidates has no row.
Columns other than text and lang are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm._bytes import Words, mix, raw, slices, words
from lodeweave.llm._store import arrow, forget, stored

SUPPORT = 10
LONGEST = 3
#: A candidate goes if a longer one around it has this share of its occurrences, in percent.
COVER = 50
TOP = 2000
#: Bits of the broadcast set of frequent sequences: 16 for each, 2**27 (16 MB) at most.
BITS = 1 << 27
#: Bytes of text that are counted at once.
PART = 2 << 20
#: Candidates of a language in one group of the last step, about.
GROUP = 50_000

_BREAK = b".,;:!?\n\x0b\x0c\r"
_BREAKS = np.zeros(256, bool)
_BREAKS[list(_BREAK)] = True
_WORD = ~_BREAKS
_WORD[[0x20, 0x09]] = False
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[0x20] = False
_CUT = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_WHOLE = re.compile(rb"[^ \t.,;:!?\n\x0b\x0c\r]+")
_PRIME = np.uint64(0xD6E8FEB86659FD93)


def _parts(text: pa.Array, k: int) -> Iterator[pa.Array]:
    """A column of one text, or if that is long of consecutive parts; a part begins k - 1 words early, so that every run of k words is in one part."""
    data, _ = raw(text)
    if len(data) <= PART:
        yield text
        return
    data, at = data.tobytes(), 0
    while at < len(data):
        found = _CUT.search(data, at + PART)
        end = found.start() if found else len(data)
        begin, reach = at, 64
        while k > 1 and at:
            low = max(0, at - reach)
            # without the first word, which may be cut, unless the text begins there
            ends = [m.start() for m in _WHOLE.finditer(data, low, at)][0 if low == 0 else 1 :]
            if len(ends) >= k - 1 or low == 0:
                begin = ends[max(0, len(ends) - k + 1)] if ends else at
                break
            reach *= 4
        yield pa.array([data[begin:end]], pa.large_binary())
        at = end


def _hashes(word: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each position on."""
    h = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for j in range(k):
        h = mix(h * _PRIME + word[j : j + len(h)])
    return h


def _lang_hash(langs: pa.Array) -> np.ndarray:
    data, at = raw(pc.binary_join_element_wise(langs, "lang", ""))  # hashes are of one byte or more
    return Words(data, at[:-1], np.diff(at), at).hashes()


def _counted(lang: pa.Array, text: pa.Array, k: int, frequent: np.ndarray | None) -> pa.RecordBatch:
    """Rows (lang, phrase, n) of the k-grams of some texts; for k = 1 also the number of words, as the phrase without words."""
    found = words(text, _WORD)
    offsets = np.concatenate([[0], np.cumsum(found.length)])
    joined = np.ascontiguousarray(found.data[_WORD[found.data]])
    column = pa.Array.from_buffers(pa.large_binary(), len(found.start), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
    code, names = column.indices.to_numpy().astype(np.int64), column.dictionary
    langs = lang.dictionary_encode()
    of = langs.indices.to_numpy().astype(np.int64)[found.doc]
    at = np.arange(len(code))
    if k > 1:
        breaks = np.concatenate([[0], np.cumsum(_BREAKS[found.data])])
        near = (breaks[found.start[1:]] == breaks[found.start[:-1] + found.length[:-1]]) & (found.doc[1:] == found.doc[:-1])
        data, ends = raw(names)
        h = _hashes(Words(data, ends[:-1], np.diff(ends), ends).hashes()[code], k - 1)
        h = mix(h ^ _lang_hash(langs.dictionary)[of[: len(h)]]) & np.uint64(len(frequent) * 64 - 1)
        known = (frequent[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) > 0
        runs = known[:-1] & known[1:]
        for j in range(k - 1):
            runs = runs & near[j : j + len(runs)]
        at = np.flatnonzero(runs)
    key = of[at]
    for j in range(k):
        if len(key) and (int(key.max()) + 1) * len(names) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(names) + code[at + j]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    phrase = names.take(pa.array(code[at[first]]))
    for j in range(1, k):
        phrase = pc.binary_join_element_wise(phrase, names.take(pa.array(code[at[first] + j])), pa.scalar(b" ", names.type))
    which = of[at[first]]
    if k == 1:
        phrase = pa.concat_arrays([phrase, pa.array([b""] * len(langs.dictionary), phrase.type)])
        which, n = np.append(which, np.arange(len(langs.dictionary))), np.append(n, np.bincount(of, minlength=len(langs.dictionary)))
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(which)).cast("string"), phrase.cast("binary").cast("string"), pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])


def _level(docs: DataFrame, k: int, frequent: np.ndarray | None, support: int) -> DataFrame:
    """The frequent k-grams with their counts, stored; at level 1 also a row without words for each language."""
    shared = None if frequent is None else docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else shared.value
        for batch in batches:
            for part in slices(batch, "text", PART):
                lang, text = part.column(0), part.column(1)
                if len(part) == 1:
                    for one in _parts(text, k):
                        yield _counted(lang, one, k, bits)
                else:
                    yield _counted(lang, text, k, bits)

    rows = arrow(docs, run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return stored(rows.where((F.col("n") >= support) | (F.col("phrase") == "")), f"level-{k}")


def _bits(level: DataFrame, k: int, most: int) -> np.ndarray:
    """The set of a level's rows, as bits at their hashes (64 in a number); ``most`` bits at most."""
    level = level.where("phrase <> ''").select("lang", "phrase")
    size = 1 << 10
    while size < min(most, 16 * level.count()):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "phrase", PART):
                h = words(part.column(1), _NOT_BLANK).hashes().reshape(len(part), k)
                total = np.zeros(len(part), np.uint64)
                for j in range(k):
                    total = mix(total * _PRIME + h[:, j])
                langs = part.column(0).dictionary_encode()
                total = mix(total ^ _lang_hash(langs.dictionary)[langs.indices.to_numpy()]) & np.uint64(size - 1)
                yield pa.RecordBatch.from_arrays([pa.array((total >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (total & np.uint64(63))).view(np.int64))], ["at", "bits"])

    rows = arrow(level, run, "at int, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # size / 64 rows at most
    out = np.zeros(size // 64, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def levels(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, bits: int = BITS) -> list[DataFrame]:
    """Tables (lang, phrase, n) of the frequent sequences of 1 to ``longest`` words; the first has each language's number of words too (phrase ``''``)."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    out = [_level(docs, 1, None, support)]
    for k in range(2, longest + 1):
        out.append(_level(docs, k, _bits(out[-1], k - 1, bits), support))
    return out


def _part(word: Column, start: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(word, start, n), " ")


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, in rounds over groups of a bounded size."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows, size = rows.withColumn("_h", F.xxhash64("phrase")), max(GROUP, 4 * top)
    groups = -(-rows.count() // size)
    while groups > 1:
        by = Window.partitionBy("lang", F.pmod("_h", F.lit(groups))).orderBy(*order)
        rows = rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= top).drop("_r")
        groups = -(-groups * top // size)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top).drop("_h")


def scored(tables: list[DataFrame], cover: int = COVER) -> DataFrame:
    """lang, phrase, a, l, r, score of every candidate that no longer one covers."""
    every = tables[0].where("phrase <> ''")
    for t in tables[1:]:
        every = every.union(t)
    several = tables[1]
    for t in tables[2:]:
        several = several.union(t)
    cand = several.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"), F.size(F.split("phrase", " ")).alias("m"))
    cuts = cand.select("lang", "phrase", "a", "w", F.col("m"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("left"), _part(F.col("w"), F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(every.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in "alr")
    cuts = cuts.withColumn("prod", a * a * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("parts", l * r).withColumn("score", F.expr("prod div parts"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    # every shorter candidate inside a longer one, with the largest count of what is around it
    m, i = F.col("m"), F.col("i")
    inner = cand.where("m > 2").select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(2), m - 1)).alias("i"))
    inner = inner.select("lang", "a", "w", "i", F.explode(F.sequence(F.lit(1), m - i + 1)).alias("s")).select("lang", F.col("a").alias("around"), _part(F.col("w"), F.col("s"), i).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    return lowest.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < cover * F.col("a"), F.lit(True))).drop("around")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, cover: int = COVER, top: int = TOP, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` best phrases of 2 to ``longest`` words of each language."""
    if longest < 2 or support < 1:
        raise ValueError("phrases have two words at least, and occur")
    tables = levels(docs, support, longest, bits)
    kept = stored(scored(tables, cover), "candidates")
    total = tables[0].where("phrase = ''").select("lang", F.col("n").alias("n"))
    out = stored(_best(kept, top).join(F.broadcast(total) if total.count() <= 100_000 else total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    forget(kept, *tables)
    return out


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 firmest phrases of 2 to 3 words of each language of the documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), f1 AS (
  SELECT lang, p AS phrase, count(*) AS n FROM (SELECT lang, unnest(w) AS p FROM w) GROUP BY ALL
), f2 AS (
  SELECT lang, p AS phrase, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM w WHERE len(w) > 1) GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, p AS phrase, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS p FROM w WHERE len(w) > 2) GROUP BY ALL HAVING count(*) >= 10
), total AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f1 GROUP BY lang
), cuts AS (
  SELECT lang, phrase, n AS a, 1 AS k, split_part(phrase, ' ', 1) AS lp, split_part(phrase, ' ', 2) AS rp FROM f2
  UNION ALL SELECT lang, phrase, n, 1, split_part(phrase, ' ', 1), split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3) FROM f3
  UNION ALL SELECT lang, phrase, n, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3) FROM f3
), parts AS (
  SELECT * FROM f1 UNION ALL SELECT * FROM f2
), cut_scores AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.n AS l, r.n AS r, CAST((1000000 * CAST(c.a AS HUGEINT) * c.a) // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM cuts c JOIN parts l ON l.lang = c.lang AND l.phrase = c.lp JOIN parts r ON r.lang = c.lang AND r.phrase = c.rp
), lowest AS (
  SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), around AS (
  SELECT lang, phrase, max(n) AS n FROM (
    SELECT lang, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2) AS phrase, n FROM f3
    UNION ALL SELECT lang, split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3), n FROM f3
  ) GROUP BY lang, phrase
), kept AS (
  SELECT c.lang, c.phrase, c.a, c.l, c.r, c.score FROM lowest c LEFT JOIN around x ON x.lang = c.lang AND x.phrase = c.phrase WHERE x.n IS NULL OR 100 * x.n < 50 * c.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank, k.phrase, k.a, k.l, k.r, t.n, k.score
FROM kept k JOIN total t ON t.lang = k.lang QUALIFY rank <= 2000
"""
