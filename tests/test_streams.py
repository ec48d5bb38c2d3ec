"""State at any prefix, states of runs and replayed logs, against plain Python."""

import time

import pytest
from pyspark.sql import functions as F

from grovespan.streaming import online, raw_log, runs

EVENTS = "event_id bigint, run_id bigint, ts timestamp, state string, calls bigint, failed bigint, input_tokens bigint, output_tokens bigint, unknown_usage bigint"
HOUR = 3_600_000


def plain_forest(leaves):
    """Roots of a binary counter after so many leaves."""
    slots = []
    for k in range(leaves):
        slots.append((k, k, 0))
        while len(slots) > 1 and slots[-1][2] == slots[-2][2]:
            b, a = slots.pop(), slots.pop()
            slots.append((a[0], b[1], a[2] + 1))
    return slots


def test_forest_at_any_prefix(spark, tmp_path):
    sizes = {1: 11, 2: 4, 3: 1, 7: 8}
    leaves = spark.createDataFrame([(e, i) for e, n in sizes.items() for i in range(n)], "episode_id bigint, sequence_index bigint")
    prefixes = online.Prefixes(leaves.repartition(3), str(tmp_path))
    want = {(e, p, lo, hi, level) for e, n in sizes.items() for p in range(n) for lo, hi, level in plain_forest(p + 1)}
    assert {(r["episode_id"], r["prefix"], r["lo"], r["hi"], r["level"]) for r in prefixes.every().collect()} == want
    for p in (0, 2, 6, 10):
        rows = prefixes.at(p).collect()
        assert {(r["episode_id"], r["lo"], r["hi"], r["level"]) for r in rows} == {(e, *r) for e, n in sizes.items() if n > p for r in plain_forest(p + 1)}
        assert all(r["hi"] <= p for r in rows)
    assert {r["node"] for r in prefixes.at(2).where("episode_id = 1").collect()} == {"node_OB_0_1_L1", "leaf_2"}
    for p in (-1, 11, 100):
        with pytest.raises(online.FutureLeaf):
            prefixes.at(p)


def test_no_leaves(spark, tmp_path):
    prefixes = online.Prefixes(spark.createDataFrame([], "episode_id bigint, sequence_index bigint"), str(tmp_path))
    assert prefixes.every().collect() == []
    with pytest.raises(online.FutureLeaf):
        prefixes.at(0)


def plain_states(events, gap, mark):
    out = []
    for run in {e[1] for e in events}:
        state, last, sums = None, None, [0] * 5
        for e in sorted((e for e in events if e[1] == run), key=lambda e: (e[2], e[0])):
            if state in ("preparing", "running") and e[2] > last + gap:
                out.append((run, last + gap, "stalled", *sums))
                state = "stalled"
            sums = [a + b for a, b in zip(sums, e[4:])]
            if e[3] != state:
                out.append((run, e[2], e[3], *sums))
            state, last = e[3], e[2]
        if state in ("preparing", "running") and last + gap <= mark:
            out.append((run, last + gap, "stalled", *sums))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 3, 8])
def test_run_states(spark, tmp_path, files):
    import random

    rng = random.Random(files)
    events, at = [], 1_700_000_000_000
    for k in range(300):
        at += rng.choice([0, 1000, HOUR // 2, 3 * HOUR])
        events.append((k, rng.randint(1, 9), at, rng.choice(["preparing", "running", "running", "running", "completed"]), 1, rng.randint(0, 1), rng.randint(0, 9), rng.randint(0, 9), 0))
    rows = spark.createDataFrame(events, EVENTS.replace("ts timestamp", "ms bigint")).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    got = runs.replayed(rows.repartition(3), str(tmp_path), gap_ms=5 * HOUR, files=files)
    assert sorted(map(tuple, got.collect())) == plain_states(events, 5 * HOUR, at - 600_000)
    reports = runs.reports(got).collect()
    stalled = [r for r in got.collect() if r["state"] == "stalled"]
    assert len(reports) == len(stalled) > 20
    text = {(r["run_id"], r["at_ms"]): r["report"] for r in reports}[stalled[0]["run_id"], stalled[0]["at_ms"]]
    assert f"- Calls completed or attempted: {stalled[0]['calls']}\n" in text and "- Next milestone blocked: true" in text


def test_run_states_of_null_and_no_events(spark, tmp_path):
    from datetime import datetime

    rows = spark.createDataFrame([(1, None, datetime(2024, 1, 1), "running", 1, 0, 0, 0, 0), (2, 5, None, "running", 1, 0, 0, 0, 0), (3, 5, datetime(2024, 1, 1), "running", None, None, 3, None, 0)], EVENTS)
    got = runs.replayed(rows, str(tmp_path / "a")).collect()
    assert [tuple(r)[2:] for r in got] == [("running", 0, 0, 3, 0, 0)] and got[0]["run_id"] == 5
    assert runs.replayed(rows.limit(0), str(tmp_path / "b")).collect() == []


def test_a_live_run_stalls_by_the_clock(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, None, "running", 1, 0, 2, 3, 0), (2, 2, None, "completed", 1, 0, 2, 3, 0)], EVENTS).withColumn("ts", F.current_timestamp())
    rows.write.parquet(str(tmp_path / "in"))
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, runs._PROVIDER)
    try:
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        query = runs.transitions(stream, gap_ms=500, clock=True).writeStream.format("memory").queryName("live").outputMode("append").start()
        for _ in range(80):
            if spark.table("live").where("state = 'stalled'").count():
                break
            time.sleep(0.5)
        query.stop()
    finally:
        spark.conf.set(key, before)
    got = {(r["run_id"], r["state"]): r for r in spark.table("live").collect()}
    assert set(got) == {(1, "running"), (1, "stalled"), (2, "completed")}
    assert got[1, "stalled"]["at_ms"] - got[1, "running"]["at_ms"] == 500


def test_replayed_batches_add_no_row(spark, tmp_path):
    columns = "attempt_id bigint, run_id bigint, stage string, logical_call_id bigint, outcome string, input_tokens bigint, output_tokens bigint, started_at timestamp"
    rows = [(k, k % 3, "leaf", k, ["accepted", "failed", "cancelled_before_start", None][k % 4], k, None if k % 8 == 0 else k, None) for k in range(40)]
    spark.createDataFrame(rows, columns).repartition(4).write.parquet(str(tmp_path / "in"))
    log = raw_log.attempt_log(str(tmp_path / "log"))
    assert log.read(spark, "attempts", "attempt_id bigint").collect() == []
    run = lambda: log.stream(spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination()
    run()
    first = {n: sorted(r["attempt_id"] for r in log.read(spark, n, "attempt_id bigint").collect()) for n in log.tables}
    assert first == {"attempts": list(range(40)), "bindings": list(range(0, 40, 4)), "outputs": [k for k in range(0, 40, 4) if k % 8], "transport": list(range(1, 40, 4))}
    last = log.batches(spark, "attempts")[-1]
    raw_log.uncommit(spark, str(tmp_path / "checkpoint"), last)
    before = next((tmp_path / "log" / "attempts" / f"batch={last}").glob("part-*")).name
    run()
    assert next((tmp_path / "log" / "attempts" / f"batch={last}").glob("part-*")).name != before
    assert {n: sorted(r["attempt_id"] for r in log.read(spark, n, "attempt_id bigint").collect()) for n in log.tables} == first
    (tmp_path / "log" / "attempts" / f"batch={last}" / "_SUCCESS").unlink()
    assert last not in log.batches(spark, "attempts")
