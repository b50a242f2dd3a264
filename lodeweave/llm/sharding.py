"""Sharding by a permutation-filled lookup table (Eisenbud et al., "Maglev", NSDI 2016).

Each shard prefers the slots of a prime-sized table in an order of its own; shards take turns and
each claims its next preferred slot that is still free, until the table is full. A key's slot is a
hash modulo the table's size, its shard is the table's entry: constant time, shards of nearly equal
size, and few keys move when a shard comes or goes.

The table has ``slots`` rows whatever the data, so it is broadcast: at most MAX_SLOTS rows of two
integers. Placement is one projection and one broadcast hash join; nothing is shuffled.

Cases: a null key is placed like the empty string; repeated rows go to the same shard; an empty
table gives an empty result; columns of the input named like the new ones are replaced by them (the key is read
first, should it be one of them); give other names to keep them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bound of the broadcast table: 2**22 rows of two integers are 64 MB in a hash relation.
MAX_SLOTS = 1 << 22
SHARDS = 64
SLOTS = 65_537


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(names: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard's number for each slot. ``slots`` must be a prime, at least as large as the shards' number."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct, and one at least")
    if not _is_prime(slots) or not len(names) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from {len(names)} to {MAX_SLOTS}")
    at = [_number(x, "offset") % slots for x in names]
    step = [_number(x, "skip") % (slots - 1) + 1 if slots > 2 else 1 for x in names]
    table, free = [-1] * slots, slots
    while True:
        for shard in range(len(names)):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + step[shard]) % slots
            table[slot] = shard
            at[shard] = (slot + step[shard]) % slots
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: the first 60 bits of its MD5 modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, names: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard), made of one literal: no Python on the executors."""
    table = ",".join(map(str, lookup_table(names, slots)))
    return spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(table), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int"))


def place(df: DataFrame, key: str, names: Sequence[str] | None = None, slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard's number of each row.

    A key that holds a large share of all rows would fill one shard; give a key that tells its rows
    apart (a row's id, or the key and a number from 0 to the parts wanted) to spread it.
    """
    names = [f"shard-{i:04d}" for i in range(SHARDS)] if names is None else names
    table = table_frame(df.sparkSession, names, slots).toDF(slot, shard)
    kept = [c for c in df.columns if c not in (slot, shard)]
    placed = df.select(*(F.col(f"`{c}`") for c in kept), slot_of(F.col(f"`{key}`"), slots).alias(slot))
    return placed.join(F.broadcast(table), slot, "left").select(*(F.col(f"`{c}`") for c in kept), slot, shard)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot and shard of every document."""
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id")
