"""Streams: the online balanced tree per episode, and windows over the attempt log."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MERGES = "episode_id bigint, prefix int, node string, left string, right string, lo int, hi int, level int"
_STATE = "next int, levels array<int>, waiting array<int>"


def _name(lo: int, hi: int, level: int) -> str:
    return f"leaf_{lo}" if level == 0 else f"node_OB_{lo}_{hi}_L{level}"


def _arrive(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The merges that the arrived leaves complete; leaves that come early wait for those before them.

    The state is the next leaf, the levels of the live roots from left to right
    (log2 of the leaves so far) and the early leaves.
    """
    after, levels, waiting = state.get if state.exists else (0, [], [])
    levels, early = list(levels), set(waiting)
    for frame in frames:
        early.update(int(x) for x in frame["sequence_index"] if x >= after)
    out = []
    while after in early:
        early.remove(after)
        level = 0
        while levels and levels[-1] == level:
            levels.pop()
            level += 1
            lo, mid = after - (1 << level) + 1, after - (1 << (level - 1))
            out.append((key[0], after, _name(lo, after, level), _name(lo, mid, level - 1), _name(mid + 1, after, level - 1), lo, after, level))
        levels.append(level)
        after += 1
    state.update((after, levels, sorted(early)))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in MERGES.split(", ")])


def merges(arrivals: DataFrame) -> DataFrame:
    """Merge events of ``arrivals(episode_id, sequence_index)``, each once, as soon as its leaves are there and never before."""
    return arrivals.select("episode_id", "sequence_index").groupBy("episode_id").applyInPandasWithState(_arrive, MERGES, _STATE, "append", GroupStateTimeout.NoTimeout)


def live_forest(events: DataFrame) -> DataFrame:
    """The roots after the last merge of each node: merged nodes that are no child of another (leaves aside)."""
    kids = events.select(F.col("episode_id").alias("e"), F.explode(F.array("left", "right")).alias("kid")).distinct()
    return events.join(kids, (F.col("episode_id") == F.col("e")) & (F.col("node") == F.col("kid")), "left_anti").select("episode_id", "node", "lo", "hi")


def attempt_windows(attempts: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window start, stage: attempts, failures and known tokens; rows later than the watermark are dropped by Spark."""
    w = attempts.withWatermark("started_at", late).groupBy(F.window("started_at", width), "stage")
    out = w.agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return out.select(F.col("window.start").alias("start"), "stage", "attempts", "failed", "input_tokens", "output_tokens")


FOREST = "episode_id bigint, prefix int, node string, lo int, hi int, level int"


class FutureLeaf(ValueError):
    """A prefix that the stream has not seen."""


def _power(level):
    return F.call_function("shiftleft", F.lit(1), level)


def _forest(rows: DataFrame) -> DataFrame:
    """The live roots, left to right, of ``rows(episode_id, next, levels)``: spans follow from the levels alone."""
    start = lambda levels, i: F.aggregate(F.slice(levels, F.lit(1), i), F.lit(0), lambda s, x: s + _power(x))
    roots = F.transform("levels", lambda x, i: F.struct(start(F.col("levels"), i).alias("lo"), x.alias("level")))
    each = rows.select("episode_id", (F.col("next") - 1).alias("prefix"), F.explode(roots).alias("r")).select("episode_id", "prefix", "r.lo", (F.col("r.lo") + _power(F.col("r.level")) - 1).alias("hi"), "r.level")
    name = F.when(F.col("level") == 0, F.concat(F.lit("leaf_"), "lo")).otherwise(F.concat(F.lit("node_OB_"), "lo", F.lit("_"), "hi", F.lit("_L"), "level"))
    return each.select("episode_id", "prefix", name.alias("node"), "lo", "hi", "level")


def forest_at(spark, checkpoint: str, batch: int) -> DataFrame:
    """The live forest of every episode as the state store of ``merges`` held it after a batch."""
    state = spark.read.format("statestore").option("path", checkpoint).option("batchId", batch).load()
    return _forest(state.select("key.episode_id", "value.groupState.next", "value.groupState.levels"))


def forests(spark, checkpoint: str, first: int, last: int) -> DataFrame:
    """The live forest of every episode after each batch from ``first`` to ``last`` that gave it leaves, from the store's changes in one read."""
    changes = spark.read.format("statestore").option("path", checkpoint).option("readChangeFeed", "true").option("changeStartBatchId", first).option("changeEndBatchId", last).load()
    return _forest(changes.where("change_type = 'update'").select("key.episode_id", "value.groupState.next", "value.groupState.levels"))


class Prefixes:
    """Leaves fed to ``merges`` prefix by prefix: the state after the last batch of a prefix is that of the prefix (a batch may begin while its files are still written).

    ``leaves(episode_id, sequence_index)`` of whole episodes; each prefix is a folder of
    files below ``folder``. ``at`` reads one prefix from the state store, ``every`` all.
    """

    def __init__(self, leaves: DataFrame, folder: str):
        self.spark, self.checkpoint = leaves.sparkSession, f"{folder}/checkpoint"
        self.seen = 1 + (leaves.agg(F.max("sequence_index")).first()[0] if not leaves.isEmpty() else -1)
        rows = leaves.select("episode_id", F.col("sequence_index").cast("int").alias("sequence_index"))
        rows.withColumn("prefix", F.col("sequence_index")).write.partitionBy("prefix").parquet(f"{folder}/parts")
        arrivals = "episode_id bigint, sequence_index int"
        #: the last batch of each prefix
        self.batches: list[int] = []
        key = "spark.sql.streaming.minBatchesToRetain"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, max(int(before), 10 * self.seen + 10))
        try:
            self.spark.createDataFrame([], arrivals).write.parquet(f"{folder}/in")
            stream = self.spark.readStream.schema(arrivals).parquet(f"{folder}/in")
            query = merges(stream).writeStream.format("noop").outputMode("append").option("checkpointLocation", self.checkpoint).start()
            for prefix in range(self.seen):
                self.spark.read.schema(arrivals).parquet(f"{folder}/parts/prefix={prefix}").write.mode("append").parquet(f"{folder}/in")
                query.processAllAvailable()
                self.batches.append(query.lastProgress["batchId"])
            query.stop()
        finally:
            self.spark.conf.set(key, before)

    def _known(self, prefix: int) -> None:
        if not 0 <= prefix < self.seen:
            raise FutureLeaf(f"prefix {prefix} is none of the {self.seen} leaves seen")

    def at(self, prefix: int) -> DataFrame:
        """The forest of every episode that has this prefix."""
        self._known(prefix)
        return forest_at(self.spark, self.checkpoint, self.batches[prefix]).where(F.col("prefix") == prefix)

    def every(self) -> DataFrame:
        if not self.seen:
            return self.spark.createDataFrame([], FOREST)
        return forests(self.spark, self.checkpoint, 0, self.batches[-1])
