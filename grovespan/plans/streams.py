"""Queries that run a stream over a bundled table and return what it wrote or kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..sources.tables import ATTEMPTS_SQL, attempts, evidence, load
from ..streaming import online, raw_log, runs
from .protocol import query


def _folder(spark: SparkSession) -> str:
    folder = f"{shared_folder(spark).rstrip('/')}/grovespan-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return folder


@query("""WITH p AS (SELECT conv_id AS episode_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS n FROM conversations),
b AS (SELECT episode_id, n - 1 AS prefix, level, ((n >> (level + 1)) << (level + 1))::INT AS lo FROM p, (SELECT unnest(range(0, 31))::INT AS level) WHERE (n >> level) & 1 = 1)
SELECT episode_id, prefix, CASE WHEN level = 0 THEN 'leaf_' || lo ELSE 'node_OB_' || lo || '_' || (lo + (1 << level) - 1) || '_L' || level END AS node, lo, (lo + (1 << level) - 1)::INT AS hi, level FROM b""")
def online_prefix_forests(spark, sf_dir) -> DataFrame:
    """The live forest at every prefix of every conversation, as the stream's state store held it."""
    return online.Prefixes(evidence(spark, sf_dir), _folder(spark)).every()


RUN_EVENTS = {
    "event_id": "event_id", "run_id": "user_id", "ts": "ts", "calls": "CASE WHEN event_type IN ('click', 'error') THEN 1 ELSE 0 END", "failed": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
    "input_tokens": "CASE WHEN event_type = 'click' THEN CAST(floor(value) AS BIGINT) ELSE 0 END", "output_tokens": "CASE WHEN event_type = 'click' THEN CAST(floor(value / 2) AS BIGINT) ELSE 0 END", "unknown_usage": "CASE WHEN event_type = 'click' AND value < 1 THEN 1 ELSE 0 END",
}
_SUMS = ", ".join(f"sum({c}) OVER w AS {c}" for c in runs.SUMS)
_NAMES = ", ".join(f"{c}::BIGINT AS {c}" for c in runs.SUMS)


@query(f"""WITH e AS (SELECT {', '.join(f'{x} AS {n}' for n, x in RUN_EVENTS.items())}, CASE event_type WHEN 'signup' THEN 'preparing' WHEN 'purchase' THEN 'completed' ELSE 'running' END AS state, epoch_us(ts) // 1000 AS at_ms FROM events WHERE user_id IS NOT NULL),
o AS (SELECT *, lag(state) OVER w AS was, lag(at_ms) OVER w AS before, lead(at_ms) OVER w AS after FROM e WINDOW w AS (PARTITION BY run_id ORDER BY at_ms, event_id)),
s AS (SELECT run_id, at_ms, event_id, state, was, before, after, {_SUMS} FROM o WINDOW w AS (PARTITION BY run_id ORDER BY at_ms, event_id)),
mark AS (SELECT max(epoch_us(ts)) // 1000 - 600000 AS mark FROM events),
moved AS (SELECT run_id, at_ms, state, {', '.join(runs.SUMS)} FROM s WHERE was IS NULL OR was <> state OR (was <> 'completed' AND at_ms > before + {runs.GAP_MS})),
stalled AS (SELECT run_id, at_ms + {runs.GAP_MS}, 'stalled', {', '.join(runs.SUMS)} FROM s, mark WHERE state <> 'completed' AND (after > at_ms + {runs.GAP_MS} OR (after IS NULL AND at_ms + {runs.GAP_MS} <= mark)))
SELECT run_id, at_ms, state, {_NAMES} FROM (SELECT * FROM moved UNION ALL SELECT * FROM stalled)""")
def run_states(spark, sf_dir) -> DataFrame:
    """Changes of state of every user's run in the event log, with the sums at each."""
    columns = [F.expr(x).alias(n) for n, x in RUN_EVENTS.items()]
    rows = load(spark, sf_dir, "events").select(*columns, runs.states_of(F.col("event_type")).alias("state"))
    return runs.replayed(rows.withColumn("ts", F.col("ts").cast("timestamp")), _folder(spark))


@query(f"""WITH {ATTEMPTS_SQL} SELECT 'attempts' AS log, stage, outcome, count(*)::BIGINT AS n, sum(output_tokens)::BIGINT AS tokens, count(DISTINCT attempt_id)::BIGINT AS ids FROM attempts GROUP BY ALL
UNION ALL SELECT 'bindings', stage, NULL, count(*)::BIGINT, NULL, count(DISTINCT attempt_id)::BIGINT FROM attempts WHERE outcome = 'accepted' GROUP BY ALL
UNION ALL SELECT 'outputs', stage, NULL, count(*)::BIGINT, sum(output_tokens)::BIGINT, count(DISTINCT attempt_id)::BIGINT FROM attempts WHERE outcome = 'accepted' AND output_tokens IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'transport', stage, 'failed', count(*)::BIGINT, NULL, count(DISTINCT attempt_id)::BIGINT FROM attempts WHERE outcome = 'failed' GROUP BY ALL""")
def raw_log_replay(spark, sf_dir) -> DataFrame:
    """The four raw logs of all attempts, streamed in batches, of which the last is written a second time."""
    folder = _folder(spark)
    rows = attempts(spark, sf_dir)
    rows.repartition(4, "run_id").write.parquet(f"{folder}/in")
    log = raw_log.attempt_log(f"{folder}/log")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    log.stream(stream(), f"{folder}/checkpoint").awaitTermination()
    raw_log.uncommit(spark, f"{folder}/checkpoint", log.batches(spark, "attempts")[-1])
    log.stream(stream(), f"{folder}/checkpoint").awaitTermination()
    key = "attempt_id bigint, run_id bigint, stage string, logical_call_id bigint"
    none = {"outcome": F.lit(None).cast("string"), "output_tokens": F.lit(None).cast("bigint")}
    schemas = {"attempts": f"{key}, outcome string, output_tokens bigint", "bindings": key, "outputs": f"{key}, output_tokens bigint", "transport": f"{key}, outcome string"}
    out = None
    for name, schema in schemas.items():
        own = log.read(spark, name, schema)
        own = own.withColumns({c: x for c, x in none.items() if c not in own.columns})
        part = own.groupBy(F.lit(name).alias("log"), "stage", "outcome").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("tokens"), F.count_distinct("attempt_id").alias("ids"))
        out = part if out is None else out.unionByName(part)
    return out
