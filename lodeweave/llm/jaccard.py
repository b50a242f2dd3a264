"""N-gram Jaccard join with Bayesian candidate pruning (BayesLSH, Satuluri and Parthasarathy, VLDB 2012).

1. Each text becomes its set of word shingles (64-bit hashes of ``N`` words; a shorter text is one
   shingle) and ``HASHES`` MinHash values, next to each other in one pass over the texts.
2. Texts with equal sets are one class; its smallest doc_id represents it. Only classes go on, so
   exact copies, however many, cost one aggregation that is summed map-side.
3. Classes that agree in a band of MinHash values fall into one bucket. Each is tied to the smallest class
   of its buckets, about one tie a class, and the ties' connected components hold all candidates.
4. Candidates are the pairs that share a bucket, in components of any size. Classes meet in units: a component of at most ``BLOCK`` classes
   is one unit, so that each text is moved once; of a larger component (texts full of boilerplate run together in chains) each bucket is a unit, and a
   pair counts in the first bucket that holds both. A unit is dealt in blocks of at most ``BLOCK`` x ``BLOCK`` classes. There MinHash
   values are compared ``STEP`` at a time, and a pair goes when the posterior probability that its
   similarity reaches the threshold (uniform prior) is below ``TOLERANCE``. What is left is verified exactly on
   the shingle sets. A block hands on, for each class, its number of links and one tie to the block's
   component, never the pairs; a unit of n classes is ceil(n / BLOCK) ** 2 / 2 blocks for as many tasks.

What the numbers mean for recall: two classes that just reach 0.8 miss all ``BANDS`` bands with
probability (1 - 0.8 ** ROWS) ** BANDS = 5e-5 (1e-8 at 0.9); pruning loses at most TOLERANCE of what it
drops. ``exact=True`` loses no link: it prunes nothing, and its buckets are the shingles of each set's
prefix. Two sets that reach the threshold have at least ``threshold * size`` shingles in common, so the smallest
of these is among the first ``size - threshold * size + 1`` of either set; a pair counts in its bucket alone.
A shingle that very many prefixes hold makes a unit of as many classes, dealt in blocks like any other.

Cases: texts without words (null and empty ones too) have no shingles, no links and a class of their
own; a null doc_id takes part as any other row under its text, and never represents a class that has
ids; repeated rows are documents each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import _bytes
from lodeweave.llm._graph import components, starred
from lodeweave.llm._store import arrow, bounded, forget, stored

N = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
HASHES = 128
STEP = 16
TOLERANCE = 1e-4
BLOCK = 1024
#: Shingles of a block's classes at most (8 bytes each), so that blocks of very long texts hold fewer classes.
BLOCK_SHINGLES = 1 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Pairs whose overlaps are counted at a time in exact mode.
_PAIRS = 1 << 18


def shingles(column: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin (one more than texts)."""
    w = _bytes.words(column, _bytes.WORD)
    h = w.hashes()
    size = np.diff(w.before)
    grams = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(len(column)), grams)
    at = w.before[:-1][doc] + _bytes.spans_of(grams)
    value = np.zeros(len(at), np.uint64)
    for k in range(n):
        inside = k < size[doc]
        value[inside] = _bytes.mix(value[inside] * _GOLD + h[at[inside] + k] + np.uint64(1))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(column) + 1))


def _coefficients(hashes: int) -> np.ndarray:
    return _bytes.mix(np.arange(1, hashes + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)


def signature(values: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of one set that isn't empty."""
    low = np.full(len(coefficients), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 2048):
        part = values[i : i + 2048]
        x = part[None, :] * coefficients[:, None]
        x ^= x >> np.uint64(29)
        x *= _GOLD
        np.minimum(low, x.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float = THRESHOLD, hashes: int = HASHES, step: int = STEP, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches needed): with fewer, the posterior chance of reaching the threshold is below ``tolerance``.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1); its tail above t is
    the chance of at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The buckets (one a band) of MinHash values, whose last axis has at least BANDS * ROWS of them."""
    rows = sig[..., : BANDS * ROWS].reshape(*sig.shape[:-1], BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:-1])
    for k in range(ROWS):
        key = _bytes.mix(key * _GOLD + rows[..., k] + np.uint64(1))
    return key


def prefix(values: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest of a sorted set's shingles, one of which every set that reaches the threshold has too."""
    return values[: len(values) - max(1, ceil(threshold * len(values) - 1e-9)) + 1]


def signatures(docs: DataFrame, n: int = N, exact: float | None = None) -> DataFrame:
    """(doc_id, text_key, set_key, size, bands) of each row of docs (doc_id, text), stored; texts without words have a null set_key.

    bands: the text's buckets; with a threshold as ``exact``, its prefix for that threshold.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _coefficients(BANDS * ROWS)
        for batch in batches:
            for part in _bytes.slices(batch, "text"):
                value, at = shingles(part.column("text"), n)
                keys, bands = [], []
                for i in range(part.num_rows):
                    s = value[at[i] : at[i + 1]]
                    if not len(s):
                        keys.append(None), bands.append(None)
                        continue
                    keys.append(np.array([s.sum(), _bytes.mix(s).sum(), len(s)], np.uint64).tobytes())
                    found = band_keys(signature(s, a)) if exact is None else prefix(s, exact)
                    bands.append(found.view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(keys, pa.binary()), pa.array(np.diff(at)), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_key", "set_key", "size", "bands"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return stored(arrow(rows, run, f"doc_id {kind}, text_key bigint, set_key binary, size bigint, bands array<bigint>"), "jaccard-sets")


def _sizes(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([len(s) for s in sets], np.int64)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of so many (left, right) pairs."""
    if len(pairs) < 2000:
        return np.array([np.isin(left[i], right[j], assume_unique=True, kind="sort").sum() for i, j in pairs], np.int64)
    used_l, at_l = np.unique(pairs[:, 0], return_inverse=True)
    used_r, at_r = np.unique(pairs[:, 1], return_inverse=True)
    if left is right:
        used_l = used_r = np.union1d(used_l, used_r)
        at_l, at_r = np.searchsorted(used_l, pairs[:, 0]), np.searchsorted(used_l, pairs[:, 1])
    flat_l, flat_r = np.concatenate([left[i] for i in used_l]), np.concatenate([right[j] for j in used_r])
    if left is right:
        common, often = np.unique(flat_l, return_counts=True)
        common = common[often > 1]
    else:
        common = np.intersect1d(flat_l, flat_r)
    row_l, row_r = np.repeat(np.arange(len(used_l)), _sizes([left[i] for i in used_l])), np.repeat(np.arange(len(used_r)), _sizes([right[j] for j in used_r]))
    keep_l, keep_r = np.isin(flat_l, common), np.isin(flat_r, common)
    col_l, col_r = np.searchsorted(common, flat_l[keep_l]), np.searchsorted(common, flat_r[keep_r])
    row_l, row_r = row_l[keep_l], row_r[keep_r]
    total = np.zeros((len(used_l), len(used_r)), np.float32)
    for c in range(0, len(common), 4096):  # 0/1 matrices over so many shingles at a time; their product counts what is common
        a, b = np.zeros((len(used_l), 4096), np.float32), np.zeros((len(used_r), 4096), np.float32)
        i, j = (col_l >= c) & (col_l < c + 4096), (col_r >= c) & (col_r < c + 4096)
        a[row_l[i], col_l[i] - c] = 1
        b[row_r[j], col_r[j] - c] = 1
        total += a @ b.T
    return total[at_l, at_r].astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray], sig_l: np.ndarray, sig_r: np.ndarray, same: bool, threshold: float = THRESHOLD, band: int = -1) -> np.ndarray:
    """(i, j) of the pairs that share a bucket and reach the threshold; i < j if both sides are the ``same``.

    ``band``: the bucket's band, if the block is of a bucket; pairs that agree in an earlier one meet there.
    """
    key_l, key_r = band_keys(sig_l), band_keys(sig_r)
    agree = np.zeros((len(left), len(right)), bool)
    for k in range(BANDS if band < 0 else band):
        agree |= key_l[:, k, None] == key_r[None, :, k]
    alive = agree if band < 0 else ~agree
    if same:
        alive = np.triu(alive, 1)
    match = np.zeros(alive.shape, np.int16)
    needed = least_matches(threshold)
    for n, least in needed:
        if alive.sum() * 8 < alive.size:  # few are left: compare those alone
            i, j = np.nonzero(alive)
            got = match[i, j].astype(np.int64)
            for m, enough in needed[n // STEP - 1 :]:
                got += (sig_l[i, m - STEP : m] == sig_r[j, m - STEP : m]).sum(axis=1)
                stay = got >= enough
                i, j, got = i[stay], j[stay], got[stay]
            pairs = np.stack([i, j], axis=1)
            break
        for k in range(n - STEP, n):
            match += sig_l[:, k, None] == sig_r[None, :, k]
        alive &= match >= least
    else:
        pairs = np.argwhere(alive)
    return _reached(left, right, pairs, threshold)


def _reached(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the pairs that reach the threshold."""
    if not len(pairs):
        return pairs
    both = _overlaps(left, right, pairs)
    union = _sizes(left)[pairs[:, 0]] + _sizes(right)[pairs[:, 1]] - both
    return pairs[both >= threshold * union - 1e-9]


def linked_exactly(left: list[np.ndarray], right: list[np.ndarray], same: bool, threshold: float, bucket: int) -> np.ndarray:
    """(i, j) of the pairs that reach the threshold and whose smallest common shingle is the ``bucket``; i < j if both sides are the ``same``.

    Only pairs whose sizes are near enough are compared, ``_PAIRS`` at a time.
    """
    size_l, size_r = _sizes(left), _sizes(right)
    low, high = np.minimum(size_l[:, None], size_r[None, :]), np.maximum(size_l[:, None], size_r[None, :])
    alive = low >= threshold * high - 1e-9
    candidates = np.argwhere(np.triu(alive, 1) if same else alive)
    found = [_reached(left, right, candidates[i : i + _PAIRS], threshold) for i in range(0, len(candidates), _PAIRS)]
    own = np.array([bucket], np.int64).view(np.uint64)[0]
    before_l, before_r = ([s[: np.searchsorted(s, own)] for s in side] for side in (left, right))
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
    return pairs[_overlaps(before_l, before_l if left is right else before_r, pairs) == 0] if len(pairs) else pairs


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component, of n with links."""
    root = np.arange(n)
    while len(pairs):
        low = root.copy()
        np.minimum.at(low, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 1], root[pairs[:, 0]])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def _met(batches: Iterator[pa.RecordBatch], n: int, threshold: float, exact: bool) -> Iterator[pa.RecordBatch]:
    """Links and ties of each block; a block's rows come one after another."""
    a = _coefficients(HASHES)
    held: list[tuple] = []
    now = None
    out: list[tuple] = []

    def block() -> None:
        ids, weights, sides = np.array([x[0] for x in held]), np.array([x[1] for x in held]), np.array([x[2] for x in held])
        sets = [x[3] for x in held]
        sigs = None if exact else np.stack([signature(x[3], a) for x in held])
        l, r = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        same = now[2] == now[3]
        if not same and not (len(l) and len(r)):  # one of the two buckets is empty: its other pairs are of the diagonal blocks
            return
        r = l if same else r
        left = [sets[i] for i in l]
        right = left if same else [sets[j] for j in r]
        if exact:
            pairs = linked_exactly(left, right, same, threshold, now[0])
        else:
            pairs = linked(left, right, sigs[l], sigs[r], same, threshold, now[1])
        i, j = l[pairs[:, 0]], r[pairs[:, 1]]
        links = np.bincount(i, weights[j], len(held)) + np.bincount(j, weights[i], len(held))
        classes = np.bincount(i, minlength=len(held)) + np.bincount(j, minlength=len(held))
        order = np.argsort(ids)
        rank = np.empty(len(held), np.int64)
        rank[order] = np.arange(len(held))
        root = ids[order][_roots(len(held), np.stack([rank[i], rank[j]], axis=1))[rank]]
        out.extend((int(ids[k]), int(root[k]), int(links[k]), int(classes[k])) for k in np.flatnonzero(classes))

    def given() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*out)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["cid", "root", "links", "classes"])

    for batch in batches:
        for part in _bytes.slices(batch, "text"):
            value, at = shingles(part.column("text"), n)
            rows = zip(*(part.column(c).to_pylist() for c in ("cid", "n", "side", "unit", "band", "bi", "bj")))
            for k, (cid, weight, side, *key) in enumerate(rows):
                if key != now and held:
                    block()
                    held.clear()
                now = key
                held.append((cid, weight, side, value[at[k] : at[k + 1]].copy()))
        if len(out) > 10_000:
            yield given()
    if held:
        block()
    if out:
        yield given()


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """doc_id, class_id, n_copies, n_links, n_linked_classes, group_id of each row of docs (doc_id, text).

    class_id: the smallest doc_id whose text has the same shingles; n_copies: rows of the class; n_links:
    other rows whose similarity reaches the threshold, copies included; n_linked_classes: other classes
    linked; group_id: the smallest doc_id that links lead to.
    """
    return keyed_duplicates(docs, n, threshold, exact).drop("text_key", "group_key")


def keyed_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """``near_duplicates`` with text_key, a 64-bit hash of the row's text, and group_key, that of the text which
    represents its group: ids may be null or several rows' own, so (group_id, group_key) names the one that stays.
    """
    sets = signatures(docs, n, threshold if exact else None)
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    sized = sets.where("set_key is not null").groupBy("set_key").agg(F.min(rep).alias("rep"), F.count("*").alias("n"), F.min("size").alias("size"))
    classes = stored(sized.select("set_key", F.xxhash64("set_key").alias("cid"), F.col("rep.doc_id").alias("class_id"), F.col("rep.text_key").alias("text_key"), "n", "size"), "jaccard-classes")
    same = sets["doc_id"].eqNullSafe(classes["class_id"]) & (sets["text_key"] == classes["text_key"])
    bands = sets.join(classes, same).select("cid", F.posexplode("bands").alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.min("cid").alias("lead"), F.count("*").alias("m")).where("m > 1").select("bucket", "lead")
    buckets = stored(bands.join(shared, "bucket"), "jaccard-buckets")
    if exact:
        member = buckets.select("cid").distinct()
        units = buckets.select("cid", F.col("bucket").alias("unit"), F.lit(0).alias("band")).distinct()
    else:
        member = components(starred(buckets.select(F.col("cid").alias("a"), F.col("lead").alias("b")))).select(F.col("node").alias("cid"), F.col("root").alias("comp"))
    member = stored(member.join(classes.drop("set_key"), "cid"), "jaccard-members")
    if not exact:
        small = member.groupBy("comp").agg(F.count("*").alias("members")).where(F.col("members") <= BLOCK).select("comp")
        alone = member.join(small, "comp", "left_semi").select("cid", F.col("comp").alias("unit"), F.lit(-1).alias("band"))
        large = member.join(small, "comp", "left_anti").select("cid")
        units = alone.union(buckets.join(large, "cid", "left_semi").select("cid", "bucket", "band").distinct())
    units = units.join(member.select("cid", "size"), "cid")
    # blocks: as many as keep each one within BLOCK classes and BLOCK_SHINGLES shingles on average
    sizes = units.groupBy("unit", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("m"))
    dealt = units.join(sizes, ["unit", "band"]).withColumn("mine", F.pmod(F.xxhash64(F.lit(5), "cid"), F.col("m")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    blocks = dealt.withColumn("other", other).select("cid", "unit", "band", low.alias("bi"), high.alias("bj"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    # of a class one row's text alone is moved: such rows' keys are broadcast while they are few, and joined by a shuffle beyond
    wanted = bounded(member.select("cid", "n", F.col("class_id").alias("of"), F.col("text_key").alias("of_key")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    texts = rows.join(wanted, (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("cid", "n", "text").dropDuplicates(["cid"])
    ready = blocks.join(texts, "cid").select("cid", "n", "side", "unit", "band", "bi", "bj", "text")
    ready = ready.repartition("unit", "band", "bi", "bj").sortWithinPartitions("unit", "band", "bi", "bj", "cid")
    met = stored(arrow(ready, lambda b: _met(b, n, threshold, exact), "cid bigint, root bigint, links bigint, classes bigint"), "jaccard-links")
    forget(buckets, member)
    links = met.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("classes").alias("classes"))
    roots = components(starred(met.select(F.col("cid").alias("a"), F.col("root").alias("b")))).select(F.col("node").alias("cid"), "root")
    named = roots.join(classes.select("cid", "class_id", F.col("text_key").alias("class_key")), "cid")
    groups = named.join(named.groupBy("root").agg(F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id", "class_key")).alias("lead")), "root").select("cid", "lead")
    classed = classes.select("set_key", "cid", "class_id", F.col("text_key").alias("class_key"), "n")
    lead = F.coalesce("lead", F.struct(F.col("class_id").isNull().alias("none"), "class_id", "class_key"))
    done = classed.join(links, "cid", "left").join(groups, "cid", "left").withColumn("lead", lead)
    done = stored(done.select("set_key", "class_id", "n", "links", "classes", F.col("lead.class_id").alias("group_id"), F.col("lead.class_key").alias("group_key")), "jaccard-done")
    forget(met, classes)
    out = sets.select("doc_id", "text_key", "set_key").join(done, "set_key", "left")
    own, copies = F.coalesce("class_id", "doc_id"), F.coalesce("n", F.lit(1))
    return out.select("doc_id", own.alias("class_id"), copies.alias("n_copies"), (F.coalesce("links", F.lit(0)) + copies - 1).alias("n_links"), F.coalesce("classes", F.lit(0)).alias("n_linked_classes"), F.coalesce("group_id", own).alias("group_id"), "text_key", F.coalesce("group_key", "text_key").alias("group_key"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and group of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
