"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, saved


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``; label is the smallest node
    of its component.

    Every round each node takes the smallest grandparent among its
    neighbours, its parent takes the same, and chains are halved, so the
    number of rounds is logarithmic in practice.  A hub costs partial
    minima before the shuffle, not a gathered neighbour list.  Only the
    count of changed nodes reaches the driver.
    """
    both = (edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
            .unionByName(edges.select(F.col(dst).alias("u"), F.col(src).alias("v"))).filter("u <> v").distinct())
    both = saved(both, "edges")
    state = saved(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                  .select("node", F.least("node", "m").alias("f")), "labels")
    while True:
        parent = state.select(F.col("node").alias("f"), F.col("f").alias("g"))
        grand = state.join(parent, "f").select("node", "f", "g")
        near = (both.join(grand.select(F.col("node").alias("v"), F.col("g")), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("g").alias("m")))
        own = grand.join(near, "node")
        told = own.select(F.explode(F.array(
            F.struct("node", F.least("f", "g", "m").alias("c"), F.col("f").alias("old")),
            F.struct(F.col("f").alias("node"), F.col("m").alias("c"), F.lit(None).cast("long").alias("old")))).alias("x"))
        new = saved(told.select("x.*").groupBy("node").agg(F.min("c").alias("f"), F.max("old").alias("old")), "labels")
        changed = new.filter("f <> old").count()
        drop(state)
        state = new
        if not changed:
            drop(both)
            return state.select("node", F.col("f").alias("label"))
