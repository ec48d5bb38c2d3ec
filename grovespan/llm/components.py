"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, saved


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` (either direction, repeats allowed) -> node, component: the least node that it is linked to (itself for that node).

    Each round links every node's larger neighbours, and then its smaller ones,
    to the least neighbour; rounds grow as the logarithm of the longest chain.
    A node of very many neighbours is no large row: its neighbours are grouped by
    pre-aggregated minima and joined, never gathered, and the minima are dealt anew
    before the join, which Spark can then split at a hot node. Rounds are written tables
    in the shared folder; the one before goes when the next is there.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(most_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.repartition(F.xxhash64("u", F.lit(1))), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.repartition(F.xxhash64("u", F.lit(1))), "u")
        star = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = saved(star)
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(now)
        now = new
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
