"""Streams give the rows of the batch forms."""

from pyspark.sql import functions as F

from grovespan.operators import trees
from grovespan.sources import tables
from grovespan.streaming import online


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_merges_out_of_order(spark, tmp_path):
    path = str(tmp_path / "in")
    for part in ([3, 0], [2, 5, 1], [4, 6, 7]):
        spark.createDataFrame([(e, i) for i in part for e in (1, 2)], "episode_id bigint, sequence_index int").coalesce(1).write.mode("append").json(path)
    stream = spark.readStream.schema("episode_id bigint, sequence_index int").option("maxFilesPerTrigger", 1).json(path)
    run(online.merges(stream), "merges")
    got = spark.createDataFrame(spark.table("merges").collect(), online.MERGES)
    want = {(r["leaf"], r["node"], r["left"], r["right"]) for r in trees.online_merges(spark, 8).collect()}
    for e in (1, 2):
        assert {(r["prefix"], r["node"], r["left"], r["right"]) for r in got.where(f"episode_id = {e}").collect()} == want
    assert {r["node"] for r in online.live_forest(got).collect()} == {"node_OB_0_7_L3"}


def test_attempt_windows(spark, data, tmp_path):
    path = str(tmp_path / "log")
    rows = tables.attempts(spark, data)
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    run(online.attempt_windows(stream), "windows", "complete")
    got = spark.table("windows").agg(F.sum("attempts"), F.sum("failed"), F.sum("input_tokens")).first()
    assert tuple(got) == (rows.count(), rows.where("outcome = 'failed'").count(), rows.agg(F.sum("input_tokens")).first()[0])
