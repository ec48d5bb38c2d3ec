"""States of runs from their log: preparing, running, stalled, completed, with what a stall report says.

A state machine per run with a timer. An event moves the run on and sets the timer to
``gap`` after it; where the timer passes, or the next event of the run is later than
that, the run has stalled. Timers go by event time (the watermark) for recorded logs, or
by the clock for live ones. The state is a few sums per run, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GAP_MS = 6 * 3600 * 1000
SUMS = ("calls", "failed", "input_tokens", "output_tokens", "unknown_usage")
TRANSITIONS = "run_id bigint, at_ms bigint, state string, " + ", ".join(f"{c} bigint" for c in SUMS)
_STATE = "state string, last_ms bigint, timer_ms bigint, " + ", ".join(f"{c} bigint" for c in SUMS)
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What an event makes of its run; others leave it running.
OPENS, CLOSES = "signup", "purchase"


def states_of(event_type: Column) -> Column:
    return F.when(event_type == OPENS, "preparing").when(event_type == CLOSES, "completed").otherwise("running")


class _Machine(StatefulProcessor):
    def __init__(self, gap_ms: int, clock: bool):
        self.gap_ms, self.clock = gap_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _STATE)

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TRANSITIONS.split(", ")])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, last, timer, *sums = self.run.get() if self.run.exists() else (None, None, None, *[0] * len(SUMS))
        out = []
        events = pd.concat(list(rows)).sort_values(["at_ms", "event_id"])
        now = timerValues.getCurrentProcessingTimeInMs() if self.clock else None
        for at, new, *own in zip(events["at_ms"], events["state"], *[events[c] for c in SUMS]):
            at = int(now or at)
            if state in ("preparing", "running") and at > last + self.gap_ms:
                out.append((key[0], last + self.gap_ms, "stalled", *sums))
                state = "stalled"
            sums = [a + int(b) for a, b in zip(sums, own)]
            if new != state:
                out.append((key[0], at, new, *sums))
            state, last = new, at
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = last + self.gap_ms if state in ("preparing", "running") else None
        if timer is not None:
            self.handle.registerTimer(timer)
        self.run.update((state, last, timer, *sums))
        yield self._rows(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state, last, timer, *sums = self.run.get()
        out = []
        if state in ("preparing", "running") and timer == expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], timer, "stalled", *sums))
            self.run.update(("stalled", last, None, *sums))
        yield self._rows(out)

    def close(self) -> None:
        pass


def transitions(events: DataFrame, gap_ms: int = GAP_MS, late: str = "10 minutes", clock: bool = False) -> DataFrame:
    """run_id, at_ms, state and the sums so far, a row for each change of a run's state.

    ``events(event_id, run_id, ts, state, calls, failed, input_tokens, output_tokens,
    unknown_usage)``, a stream; the sums are of the event. A run is taken in the order of
    its time; events behind the watermark are dropped by Spark. ``clock``: timers and
    times go by the clock instead.
    """
    sums = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in SUMS]
    rows = events.where("run_id is not null and ts is not null").select("run_id", "event_id", "ts", F.unix_millis("ts").alias("at_ms"), "state", *sums)
    if not clock:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("run_id").transformWithStateInPandas(_Machine(gap_ms, clock), TRANSITIONS, "append", "ProcessingTime" if clock else "EventTime")


def replayed(events: DataFrame, folder: str, gap_ms: int = GAP_MS, late: str = "10 minutes", files: int = 4) -> DataFrame:
    """``transitions`` of a recorded log: its rows are dealt by time into ``files`` or more batches and streamed in that order."""
    spark = events.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spans = events.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    if spans["a"] is None:
        return spark.createDataFrame([], TRANSITIONS)
    share = (F.unix_micros("ts") - F.unix_micros(F.lit(spans["a"]))) / F.greatest(F.lit(1), F.unix_micros(F.lit(spans["z"])) - F.unix_micros(F.lit(spans["a"])))
    events.where("ts is not null").withColumn("step", F.least(F.floor(share * files), F.lit(files - 1)).cast("int")).write.partitionBy("step").parquet(f"{folder}/steps")
    spark.conf.set(key, _PROVIDER)
    try:
        spark.createDataFrame([], events.schema).write.parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        out = transitions(stream, gap_ms, late).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        for step in range(files):
            part = _step(spark, events, folder, step)
            if part is not None:
                part.write.mode("append").parquet(f"{folder}/in")
                # All of a step's files are there before its batch begins.
                out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(TRANSITIONS).parquet(f"{folder}/out")


def _step(spark, events: DataFrame, folder: str, step: int) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/steps/step={step}")
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(events.schema).parquet(f"{folder}/steps/step={step}") if there else None


def reports(rows: DataFrame) -> DataFrame:
    """run_id, at_ms, report: the text of a stall report for each stall of ``transitions``."""
    line = lambda name, value: F.concat(F.lit(f"- {name}: "), value.cast("string"))
    text = F.array_join(F.array(
        F.lit("# Stall report"), F.lit(""), line("Run", F.col("run_id")), line("Without an event since", F.timestamp_millis("at_ms")), F.lit("- Next milestone blocked: true"), F.lit(""),
        F.lit("## Cumulative calls"), F.lit(""), line("Calls completed or attempted", F.col("calls")), line("Failed", F.col("failed")), F.lit(""),
        F.lit("## Cumulative tokens"), F.lit(""), line("Recorded input tokens", F.col("input_tokens")), line("Recorded output tokens", F.col("output_tokens")), line("Successful calls with missing usage", F.col("unknown_usage")),
    ), "\n")
    return rows.where("state = 'stalled'").select("run_id", "at_ms", text.alias("report"))
