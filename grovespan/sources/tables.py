"""Sources and sinks, and the domain's tables as views of the bundled ones.

Every view is a projection or one shuffle on its entity's key; readers take any
path that Spark can open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

STAGES = ("leaf", "merge", "answer", "judge")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, sequence_index (from 0), role, token_count: the turns of each conversation in order."""
    turns = load(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select(F.col("conv_id").alias("episode_id"), (F.row_number().over(order) - 1).cast("bigint").alias("sequence_index"), "role", text.evidence_tokens(F.col("text")).alias("token_count"))


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, plan_id, replicate_id, query_id, score of recorded answers."""
    plan = F.create_map(*[F.lit(x) for x in ("A", "left_deep", "N", "canonical_balanced", "R", "right_deep")])
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("bigint").alias("episode_id"), plan[F.col("l_returnflag")].alias("plan_id"),
        F.col("l_linenumber").cast("bigint").alias("replicate_id"), F.col("l_partkey").cast("bigint").alias("query_id"), F.col("l_discount").cast("double").alias("score"),
    )


SCORES_SQL = """scores AS (SELECT l_orderkey::BIGINT AS episode_id, CASE l_returnflag WHEN 'A' THEN 'left_deep' WHEN 'N' THEN 'canonical_balanced' ELSE 'right_deep' END AS plan_id,
  l_linenumber::BIGINT AS replicate_id, l_partkey::BIGINT AS query_id, l_discount::DOUBLE AS score FROM lineitem)"""

EVIDENCE_SQL = r"""evidence AS (SELECT conv_id AS episode_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS sequence_index, role,
  ceil(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]|[^\s\x{1c}-\x{1f}\p{Z}\x{85}]')) * 1.1::DOUBLE)::BIGINT AS token_count FROM conversations)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log read as model-call attempts: one row per event.

    run = user, stage and logical call from the event id, outcome from the event
    type, tokens from the value; the outcome ``signup`` stands for a call that
    was cancelled before its start, ``error`` for one without provider usage.
    """
    e = load(spark, sf_dir, "events")
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.col("event_id") % 4 + 1).cast("int"))
    tokens = F.floor(F.abs(F.col("value"))).cast("bigint")
    outcome = F.when(F.col("event_type") == "signup", "cancelled_before_start").when(F.col("event_type") == "error", "failed").otherwise("accepted")
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("attempt_id"), F.col("user_id").alias("run_id"), stage.alias("stage"), F.floor(F.col("event_id") / 8).cast("bigint").alias("logical_call_id"),
        outcome.alias("outcome"), F.when(~failed, tokens + 10).alias("input_tokens"), F.when(~failed, F.floor(tokens / 3)).alias("cached_tokens"),
        F.when(~failed, F.floor(tokens / 2) + 1).alias("output_tokens"), F.when(~failed & (F.col("event_id") % 11 != 0), F.floor(tokens / 5)).alias("reasoning_tokens"),
        F.col("ts").cast("timestamp").alias("started_at"), (tokens % 60).alias("seconds"),
    )


ATTEMPTS_SQL = """attempts AS (SELECT event_id AS attempt_id, user_id AS run_id, (['leaf', 'merge', 'answer', 'judge'])[event_id % 4 + 1] AS stage, event_id // 8 AS logical_call_id,
  CASE event_type WHEN 'signup' THEN 'cancelled_before_start' WHEN 'error' THEN 'failed' ELSE 'accepted' END AS outcome,
  CASE WHEN event_type <> 'error' THEN floor(abs(value))::BIGINT + 10 END AS input_tokens, CASE WHEN event_type <> 'error' THEN floor(abs(value))::BIGINT // 3 END AS cached_tokens,
  CASE WHEN event_type <> 'error' THEN floor(abs(value))::BIGINT // 2 + 1 END AS output_tokens, CASE WHEN event_type <> 'error' AND event_id % 11 <> 0 THEN floor(abs(value))::BIGINT // 5 END AS reasoning_tokens,
  ts AS started_at, floor(abs(value))::BIGINT % 60 AS seconds FROM events)"""


# Readers and writers of the file formats.

def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """One JSON object a line; blank lines are skipped, malformed ones fail. ``id`` is the first non-empty of three names."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    names = [F.nullif(F.col(c), F.lit("")) for c in ("id", "question_id", "trajectory_id") if c in rows.columns]
    return rows.withColumn("id", F.coalesce(*names)) if names else rows


def read_json_array(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A file that is one JSON array of rows. It cannot be split, so convert it once with ``write_parquet``."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def repeated_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    """Ids that are missing or occur more than once, with their number: empty if the ids are unique."""
    return rows.groupBy(key).agg(F.count("*").alias("rows")).where(F.col(key).isNull() | (F.col("rows") > 1))


def write_jsonl(rows: DataFrame, path: str, key: str | None = None) -> None:
    """Sorted by ``key`` over the files, fields in name order."""
    out = rows.select(*sorted(rows.columns))
    (out.orderBy(key) if key else out).write.mode("overwrite").json(path)


def write_parquet(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Published by Spark's commit protocol, so readers see all of it or nothing."""
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of each file below ``path`` (each must fit in memory of a task)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256")).orderBy("path")


def publish(rows: DataFrame, path: str, run_id: str) -> None:
    """``rows`` as the table of a run beside others; Spark's commit marks it when it is complete."""
    rows.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last run by name that is complete; names of runs sort by time."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    runs = [str(s.getPath()) for s in files.listStatus(top) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not runs:
        raise FileNotFoundError(f"no complete run below {path}")
    return spark.read.parquet(max(runs))


def bad_manifest_lines(lines: DataFrame) -> DataFrame:
    """line of a checksum manifest (``digest  path``) whose digest is not 64 hexadecimal digits or whose path is empty."""
    return lines.where(~F.col("value").rlike("^[0-9a-f]{64}  [^\\n]+$")).select(F.col("value").alias("line"))
