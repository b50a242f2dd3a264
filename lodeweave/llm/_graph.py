"""Connected components of links, with joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm._store import forget, stored


def starred(ties: DataFrame) -> DataFrame:
    """(a, b) with the components of ties (a member, b its lead), about one a member.

    A member is tied to its smallest lead alone, and its other leads to that one: leads are few, so after
    the aggregations there is little more than one tie a member, however many leads each had.
    """
    led = ties.where("a <> b").groupBy("a").agg(F.collect_set("b").alias("leads")).select("a", "leads", F.array_min("leads").alias("b"))
    return led.select(F.explode(F.array_append("leads", F.col("a"))).alias("a"), "b").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node of its component.

    Each round every node takes the smallest root among itself and its neighbours, then its root's
    root; rounds end when nothing changes, as they must, since roots only fall. Each round's labels are
    stored, so a lost executor costs a round at most. Nothing is collected but whether something changed.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"), F.lit(True).alias("fell")), "labels")
    while labels.where("fell").limit(1).count():
        known = labels.select("node", "root")
        near = both.join(known.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        low = known.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "r").alias("root"), F.col("root").alias("old"))
        up = known.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = stored(low.join(up, "root", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "old").select("node", "root", (F.col("root") != F.col("old")).alias("fell")), "labels")
        forget(labels)
        labels = new
    forget(both)
    return labels.select("node", "root")
