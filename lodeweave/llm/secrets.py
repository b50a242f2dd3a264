"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov chains over characters are trained from labelled samples: random strings
(label 1) and ordinary identifiers (label 0). A long token that no pattern has found is a secret too if its
log-likelihood ratio, for each of its transitions, is at least ``THRESHOLD``. Everything is a DataFrame
expression: samples are counted by an aggregation, the table of 128 x 128 ratios (a fixed bound) is a
literal of the plan, and each text is scanned by one projection, with no shuffle.

Positions are code points. Spark gives a pattern's matches and what lies between them; their lengths,
summed up in turn, are the positions. What runs over all matches of a text goes in blocks of ``BLOCK``, so that
no list is copied for each of its members: the work follows the matches' number.

Cases: a null text is an empty one and has no spans; repeated rows each get their result; very long
tokens are scored whole, a stretch at a time; extra columns stay in ``scan``'s result unless they are named like
the new ones, which replace them; an empty table gives an empty result; without samples every ratio is 0 and only
the patterns find anything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the three base kinds, in the order in which kinds sort.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_ASSIGNED = 8
#: Tokens that the Markov models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 0.35
_SIZE = 128
_SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Matches of a text that are folded at once.
BLOCK = 256
#: Code points of a stretch of a text or a token.
STRETCH = 1024

# Words of which ordinary identifiers are made, for the labelled samples.
IDENTIFIER_WORDS = (
    "account add after array async base before block buffer build button byte cache call change char check child class client close code "
    "column command config connect content context count create current data date default delete depth device display document domain "
    "element empty entry error event field file filter find first folder form format frame function get global group handle header height "
    "image index init input insert item key language last layout length level library limit line link list load local log main manager map "
    "message method model module name network next node number object offset open option order output page parent parse path pattern pixel "
    "point position previous print process query queue range read record remove render request result return root row save scale schema "
    "screen search section select server service session set shape size source start state status stream string style system table target "
    "task template test text thread time title token total tree type update upload user value version view visible weight width window "
    "word worker write zone"
).split()


#: Characters of which ordinary rulers are made, each repeated.
RULED = "".join(map(chr, range(48, 58))) + "".join(chr(c + k) for c in range(97, 123) for k in (0, -32)) + "+/_=-"


def samples(spark: SparkSession, n: int = 4000, first: int = 0) -> DataFrame:
    """(text, label): n random strings of three alphabets, and n ordinary texts (identifiers of four styles, rulers of one character), all from a rule; another ``first`` gives others."""
    ids = spark.range(first, first + n, numPartitions=1)
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")).cast("binary"), 256)
    base = F.base64(F.unhex(digest))
    mixed = F.when(F.col("id") % 3 == 0, digest).when(F.col("id") % 3 == 1, base).otherwise(F.regexp_replace(base, "[+/=]", ""))
    words = F.split(F.lit(" ".join(IDENTIFIER_WORDS)), " ")

    def word(k: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))

    four = [word(k) for k in range(4)]
    snake, camel = F.concat_ws("_", *four), F.concat(four[0], *(F.initcap(w) for w in four[1:]))
    path = F.concat(F.concat_ws("/", *four), F.lit("-"), F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(100)).cast("string"))
    ruler = F.repeat(F.substring(F.lit(RULED), (F.floor(F.col("id") / 5) % len(RULED) + 1).cast("int"), F.lit(1)), F.lit(20))
    style = F.col("id") % 5
    named = F.when(style == 0, snake).when(style == 1, camel).when(style == 2, F.upper(snake)).when(style == 3, ruler).otherwise(path)
    return ids.select(mixed.alias("text"), F.lit(1).alias("label")).union(ids.select(named, F.lit(0)))


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.least(F.ascii(c), F.lit(_SIZE - 1)))


def _steps(codes: Column) -> Column:
    """a * 128 + b for each two characters that follow each other."""
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * _SIZE + b)


def train(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of each transition, add-one smoothed; labelled (text, label 0 or 1)."""
    usable = labelled.where("length(text) > 1 and label in (0, 1)").select("label", F.explode(_steps(_codes(F.col("text")))).alias("step"))
    # at most 2 * 128 * 128 rows come to the driver
    counts = {(r["label"], r["step"]): r["n"] for r in usable.groupBy("label", "step").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [0.0] * (_SIZE * _SIZE)
    seen = sorted({s // _SIZE for _, s in counts} | {s % _SIZE for _, s in counts})
    totals = {(y, a): sum(counts.get((y, a * _SIZE + b), 0) for b in seen) for y in (0, 1) for a in seen}
    out = [0.0] * (_SIZE * _SIZE)
    for a in seen:
        for b in seen:
            p, q = ((counts.get((y, a * _SIZE + b), 0) + 1) / (totals[y, a] + len(seen)) for y in (1, 0))
            out[a * _SIZE + b] = math.log(p / q)
    return out


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def _blocks(values: Column) -> Column:
    """Where the blocks of an array begin, from 1; none if it is empty."""
    return F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions: above 0 it looks rather random."""
    values = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")

    def total(text: Column) -> Column:
        return F.aggregate(_steps(_codes(text)), F.lit(0.0), lambda acc, s: acc + F.element_at(values, s + 1))

    # stretches overlap by the character that two transitions share
    long = F.aggregate(
        F.regexp_extract_all(token, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)),
        F.struct(F.lit(0.0).alias("sum"), F.lit("").alias("last")),
        lambda acc, x: F.struct((acc["sum"] + total(F.concat(acc["last"], x))).alias("sum"), F.right(x, F.lit(1)).alias("last")),
        lambda acc: acc["sum"],
    )
    return F.when(F.length(token) <= STRETCH, total(token)).otherwise(long) / F.greatest(F.length(token) - 1, F.lit(1))


def _placed(text: Column, pattern: str, kind: int, keep: Column, hits: Column) -> Column:
    """Spans of a pattern's matches, those alone that ``keep`` (an array of booleans) tells to."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    lengths = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), F.transform(hits, lambda h: F.length(h)).alias("size"), keep.alias("keep"))

    def one(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x["size"]).alias("end"))
        return F.struct((begin + x["size"]).alias("at"), F.when(x["keep"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def block(x: Column):
        def of(acc: Column, first: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), F.array().cast(_SPANS).alias("out"))
            return _let(F.aggregate(F.slice(x, first, BLOCK), start, one), lambda b: F.struct(b["at"].alias("at"), F.array_append(acc["out"], b["out"]).alias("out")))

        return of

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))
    placed = _let(lengths, lambda x: F.aggregate(_blocks(x), start, block(x), lambda acc: F.flatten(acc["out"])))
    return F.when(F.exists(keep, lambda x: x), placed).otherwise(F.array().cast(_SPANS))


#: Steps of a binary search, the largest first: arrays of up to 2**31 members.
_STEPS = [1 << k for k in range(30, -1, -1)]


def _below(spans: Column, place: Column) -> Column:
    """How many of the spans, sorted by start and disjoint, begin before the place."""
    steps = F.filter(F.array(*map(F.lit, _STEPS)), lambda s: s <= F.size(spans))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(spans, at + s - 1)["start"] < place, F.lit(False)), at + s).otherwise(at))


def _meets(spans: Column, begin: Column, end: Column) -> Column:
    """Whether one of the spans, sorted and disjoint, shares a position with [begin, end)."""
    return (F.size(spans) > 0) & F.coalesce(F.get(spans, _below(spans, end) - 1)["end"] > begin, F.lit(False))


def scan(docs: DataFrame, table: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, kind, end) by start, then kind."""
    kept = [c for c in docs.columns if c not in ("base_spans", "spans")]
    t = F.col("_text")
    all_of = lambda p, k: F.regexp_extract_all(t, F.lit(p), F.lit(k))
    # the input's columns lie in one of their own, so that no name clashes
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    found = found.withColumns({"_assign": all_of(ASSIGN, 0), "_access": all_of(ACCESS, 0), "_hex": all_of(HEX, 0), "_token": all_of(TOKEN, 0)})
    found = found.withColumn("_values", F.when(F.size("_assign") > 0, all_of(ASSIGN, 2)).otherwise(F.array().cast("array<string>")))
    every = lambda c: F.transform(c, lambda x: F.lit(True))
    likely = F.transform("_token", lambda v: ratio(v, table) >= threshold)
    found = found.withColumns({
        "_a": _placed(t, ASSIGN, 0, F.transform("_values", lambda v: F.length(v) >= LEAST_ASSIGNED), F.col("_assign")),
        "_b": _placed(t, ACCESS, 1, every("_access"), F.col("_access")),
        "_c": _placed(t, HEX, 2, every("_hex"), F.col("_hex")),
        "_d": _placed(t, TOKEN, 3, likely, F.col("_token")),
    })
    apart = F.filter("_d", lambda m: ~(_meets(F.col("_a"), m["start"], m["end"]) | _meets(F.col("_b"), m["start"], m["end"]) | _meets(F.col("_c"), m["start"], m["end"])))
    base = F.concat("_a", "_b", "_c")
    return found.select(*(F.col("_row")[c].alias(c) for c in kept), F.array_sort(base).alias("base_spans"), F.array_sort(F.concat(base, apart)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by one mark; spans that overlap are one stretch."""

    def between(parts: Column, begin: Column, end: Column) -> Column:
        """Code points begin to end (exclusive) of a text given in parts of STRETCH."""
        i, j = F.floor(begin / STRETCH).cast("int"), F.floor(end / STRETCH).cast("int")
        part = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
        head, tail = F.substring(part(i), begin % STRETCH + 1, F.lit(STRETCH)), F.substring(part(j), F.lit(1), end % STRETCH)
        return F.when(i == j, F.substring(part(i), begin % STRETCH + 1, end - begin)).otherwise(F.concat(head, F.array_join(F.slice(parts, i + 2, j - i - 1), ""), tail))

    def made(parts: Column) -> Column:
        def one(acc: Column, s: Column) -> Column:
            piece = F.concat(acc["out"], between(parts, acc["at"], s["start"]), F.lit(mark))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when((s["start"] >= acc["at"]), piece).otherwise(acc["out"]).alias("out"))

        def block(acc: Column, first: Column) -> Column:
            got = F.aggregate(F.slice(spans, first, BLOCK), F.struct(acc["at"].alias("at"), F.lit("").alias("out")), one)
            return _let(got, lambda b: F.struct(b["at"].alias("at"), F.array_append(acc["out"], b["out"]).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(_blocks(spans), start, block, lambda acc: F.concat(F.array_join(acc["out"], ""), between(parts, acc["at"], F.length(text))))

    return F.when(F.size(spans) > 0, _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), made)).otherwise(text)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and places of secrets in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs, train(samples(spark)))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return out.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), number(3).alias("n_markov"))
