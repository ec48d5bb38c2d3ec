"""Queries of the audit of a three-file corpus, over files made of the bundled tables.

Questions are customers, a haystack is the customer's orders by date, a trajectory the
lines of an order; orders without lines are missing trajectories. Some questions lack
their text, evaluator or haystack, and some haystacks have no question. The three files
are written in the shared folder, read again by their readers and audited.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus
from ..sources import json_rows
from ..sources.shared import dropped, saved, shared_folder, shuffles_freed
from ..sources.tables import load
from .protocol import query

SPLIT_BYTES = 256 << 10
#: Lines are dealt in slices of so many bytes of their table, and a bucket has so many of the trajectories' file.
SLICE_BYTES, BUCKET_BYTES = 128 << 20, 8 << 20


def files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write questions.jsonl, haystacks.json and trajectories.jsonl, each as a folder of part files."""
    customers = load(spark, sf_dir, "customer")
    name = F.expr("concat('q', c_custkey, CASE WHEN c_custkey % 17 = 0 THEN '_abs' ELSE '' END)")
    own = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("o"))
    ids = lambda o: F.transform(o, lambda x: F.concat(F.lit("t"), x["o_orderkey"].cast("string")))
    both = customers.join(own, "c_custkey", "left")
    support = F.expr("filter(o, x -> x.o_orderstatus = 'P')")
    asked = both.select(
        name.alias("id"), F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'knowledge-update' WHEN 'MACHINERY' THEN 'temporal-reasoning' ELSE lower(c_mktsegment) END").alias("question_type"),
        F.expr("CASE WHEN c_custkey % 29 <> 0 THEN c_name END").alias("question"), F.col("c_nationkey").cast("string").alias("answer"), F.expr("CASE WHEN c_custkey % 37 = 0 THEN '' ELSE 'substring' END").alias("eval_function"),
        F.lit("shop").alias("domain"), F.expr("CASE WHEN c_nationkey >= 5 THEN string(c_nationkey) END").alias("environment"),
        F.when(F.expr("c_custkey % 31 = 0"), F.array(F.lit("t-1"))).when(F.size(support) > 0, ids(support)).alias("answer_session_ids"),
    )
    asked.write.option("compression", "gzip").json(f"{folder}/questions.jsonl")
    held = both.where("c_custkey % 101 <> 7").select(name.alias("key"), F.coalesce(ids("o"), F.array().cast("array<string>")).alias("value"))
    extra = load(spark, sf_dir, "nation").select(F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("key"), F.array(F.lit("t0")).alias("value"))
    json_rows.write_maps(held.unionByName(extra), f"{folder}/haystacks.json")
    table = load(spark, sf_dir, "lineitem")
    # One slice of orders after the other, so that the shuffle files of one are gone before the next.
    slices = json_rows.size_of(spark, f"{sf_dir}/lineitem.parquet") // SLICE_BYTES + 1
    for k in range(slices):
        _trajectories(table.where(F.pmod(F.xxhash64("l_orderkey"), F.lit(slices)) == k), f"{folder}/trajectories.jsonl")


def _trajectories(table: DataFrame, path: str) -> None:
    """Add the trajectories of an order's lines to the folder ``path``."""
    # Lines are dealt as numbers; their strings are made behind the exchange.
    state = lambda x: F.struct(x["l_returnflag"].alias("thought"), F.concat(F.lit("ship "), x["l_partkey"].cast("string")).alias("action"), F.concat(F.lit("p/"), x["l_suppkey"].cast("string")).alias("url"))
    lines = table.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("s"), F.min("l_shipdate").cast("date").cast("string").alias("d"))
    rows = lines.select(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("id"), F.expr("CASE WHEN l_orderkey % 5 <> 0 THEN d END").alias("current_time"), F.lit("2000-01-01").alias("event_time"), F.transform("s", state).alias("states"))
    rows.write.mode("append").option("compression", "gzip").json(path)


def audit(spark: SparkSession, sf_dir: str, measures: tuple[str, ...] = ("token_count",)) -> corpus.Audit:
    folder = f"{shared_folder(spark).rstrip('/')}/grovespan-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        files(spark, sf_dir, folder)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    own = tuple(f"{folder}/{name}" for name in ("questions.jsonl", "haystacks.json", "trajectories.jsonl"))
    buckets = max(corpus.BUCKETS, json_rows.size_of(spark, own[2]) // BUCKET_BYTES)
    return corpus.Audit(*corpus.read(spark, *own, SPLIT_BYTES), buckets, measures, own)


def released(own: corpus.Audit, result: Callable[[corpus.Audit], DataFrame]) -> DataFrame:
    """A result that needs nothing of the audit but what was saved; its files and tables go."""
    out = result(own)
    own.release()
    return out


BASE = r"""WITH own AS (SELECT o_custkey AS c_custkey, list('t' || o_orderkey ORDER BY o_orderdate, o_orderkey) AS ids,
  list('t' || o_orderkey ORDER BY o_orderdate, o_orderkey) FILTER (o_orderstatus = 'P') AS sup FROM orders GROUP BY o_custkey),
asked AS (SELECT 'q' || c_custkey || CASE WHEN c_custkey % 17 = 0 THEN '_abs' ELSE '' END AS question_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'knowledge-update' WHEN 'MACHINERY' THEN 'temporal-reasoning' ELSE lower(c_mktsegment) END AS question_type,
  CASE WHEN c_custkey % 29 <> 0 THEN c_name END AS question, c_nationkey::VARCHAR AS answer, CASE WHEN c_custkey % 37 = 0 THEN '' ELSE 'substring' END AS eval_function,
  CASE WHEN c_custkey % 31 = 0 THEN ['t-1'] ELSE coalesce(sup, []) END AS support, coalesce(ids, []) AS ids, c_custkey % 101 <> 7 AS held, c_custkey % 17 = 0 AS silent
  FROM customer LEFT JOIN own USING (c_custkey)),
lines AS (SELECT l_orderkey, min(l_shipdate)::DATE::VARCHAR AS d, string_agg(l_returnflag || chr(10) || 'ship ' || l_partkey || chr(10) || 'p/' || l_suppkey, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS body,
  string_agg('{"action":"ship ' || l_partkey || '","thought":"' || l_returnflag || '","url":"p/' || l_suppkey || '"}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS states FROM lineitem GROUP BY l_orderkey),
traj AS (SELECT 't' || l_orderkey AS evidence_id, CASE WHEN l_orderkey % 5 <> 0 THEN d ELSE '2000-01-01' END AS event_time,
  ceil(len(regexp_extract_all(body, '[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]|[^\s\x{1c}-\x{1f}\p{Z}\x{85}]')) * 1.1::DOUBLE)::BIGINT AS token_count,
  sha256('{' || CASE WHEN l_orderkey % 5 <> 0 THEN '"current_time":"' || d || '",' ELSE '' END || '"event_time":"2000-01-01","id":"t' || l_orderkey || '","states":[' || states || ']}') AS raw_sha256 FROM lines),
entry AS (SELECT question_id, unnest(ids) AS evidence_id, unnest(range(len(ids))) AS sequence_index FROM asked WHERE held),
placed AS (SELECT e.*, event_time, token_count, raw_sha256 FROM entry e LEFT JOIN traj t ON e.evidence_id = t.evidence_id),
per AS (SELECT question_id, sum(token_count) AS tokens, list(evidence_id ORDER BY sequence_index) FILTER (token_count IS NULL) AS lost FROM placed GROUP BY question_id),
found AS (SELECT *, list_filter([list_position(ids, x) - 1 FOR x IN support], lambda p: p >= 0) AS places, coalesce(lost, []) AS gone FROM asked LEFT JOIN per USING (question_id) WHERE held),
judged AS (SELECT question_id, question_type, question_type IN ('knowledge-update', 'temporal-reasoning') AS prim, support, silent, len(ids)::BIGINT AS n, coalesce(tokens, 0)::BIGINT AS tokens, len(gone)::BIGINT AS missing,
  CASE WHEN len(list_distinct(places)) > 1 THEN 'multiple' ELSE 'single_or_unknown' END AS support_class,
  CASE WHEN len(places) = 0 THEN 'unknown' WHEN list_avg(places) / greatest(1, len(ids) - 1) < 1 / 3.0::DOUBLE THEN 'early' WHEN list_avg(places) / greatest(1, len(ids) - 1) < 2 / 3.0::DOUBLE THEN 'middle' ELSE 'late' END AS position_bin,
  CASE WHEN len(list_filter(support, lambda x: NOT list_contains(ids, x))) > 0 THEN 'answer_evidence_not_in_episode' WHEN silent THEN 'abstention' WHEN len(gone) > 0 THEN 'missing_trajectory:' || array_to_string(gone[1:5], ',')
    WHEN len(ids) < 4 THEN 'fewer_than_four' WHEN question IS NULL OR answer IS NULL OR eval_function = '' THEN 'unrecoverable_query' END AS reason FROM found)"""


@query(f"{BASE} SELECT question_id, question_type, CASE WHEN reason IS NULL THEN 'normalized' ELSE 'excluded' END AS status, reason, missing FROM judged")
def three_file_conversion(spark, sf_dir) -> DataFrame:
    return released(audit(spark, sf_dir), corpus.Audit.conversion)


@query(f"{BASE} SELECT question_id AS episode_id, sequence_index::BIGINT AS sequence_index, evidence_id, event_time, token_count, raw_sha256 FROM placed WHERE question_id IN (SELECT question_id FROM judged WHERE reason IS NULL)")
def three_file_evidence(spark, sf_dir) -> DataFrame:
    return audit(spark, sf_dir, corpus.MEASURES).evidence()


@query(f"{BASE} SELECT question_type, support_class, position_bin, prim AS \"primary\", count(*)::BIGINT AS n FROM judged WHERE reason IS NULL GROUP BY ALL")
def three_file_strata(spark, sf_dir) -> DataFrame:
    return released(audit(spark, sf_dir), corpus.Audit.strata)


@query(f"""{BASE}, bad AS (SELECT count(*) FILTER (NOT held) + (SELECT count(*) FROM nation) AS problems, count(*) AS questions FROM asked),
sums AS (SELECT count(*) AS converted, count(*) FILTER (reason IS NULL) AS n_master, count(reason) AS excluded, count(*) FILTER (silent) AS abstentions, count(*) FILTER (reason IS NULL AND n >= 4) AS n4, count(*) FILTER (reason IS NULL AND n >= 8) AS n8,
  count(*) FILTER (reason IS NULL AND n >= 16) AS n16, count(*) FILTER (reason IS NULL AND prim) AS primary_n_master, count(*) FILTER (reason IS NULL AND prim AND n >= 4) AS primary_n4, count(*) FILTER (reason IS NULL AND prim AND n >= 8) AS primary_n8,
  count(*) FILTER (reason IS NULL AND prim AND n >= 16) AS primary_n16 FROM judged),
split AS (SELECT *, round_even(primary_n_master * 0.2::DOUBLE, 0)::BIGINT AS development, round_even(primary_n_master * 0.3::DOUBLE, 0)::BIGINT AS calibration,
  round_even(n_master * 0.2::DOUBLE, 0)::BIGINT AS expanded_development, round_even(n_master * 0.3::DOUBLE, 0)::BIGINT AS expanded_calibration FROM bad, sums)
SELECT *, primary_n_master - development - calibration AS acceptance, n_master - expanded_development - expanded_calibration AS expanded_acceptance, converted = questions AS no_silent_drop,
  CASE WHEN problems > 0 OR primary_n_master = 0 THEN 'blocked' WHEN excluded > 0 THEN 'qualified_with_exclusions' ELSE 'qualified' END AS status FROM split""")
def three_file_counts(spark, sf_dir) -> DataFrame:
    own = audit(spark, sf_dir)
    out = released(own, lambda a: saved(a.counts()))
    dropped(own.verdicts())
    return out


@query(f"""{BASE}, m AS (SELECT 'sessions' AS measure, n AS x FROM judged UNION ALL SELECT 'tokens', tokens FROM judged WHERE reason IS NULL), s AS (SELECT measure, list(x ORDER BY x) AS v FROM m GROUP BY measure)
SELECT measure, len(v)::BIGINT AS n, v[1] AS least, v[round_even((len(v) - 1) * 0.5::DOUBLE, 0)::BIGINT + 1] AS p50, v[round_even((len(v) - 1) * 0.95::DOUBLE, 0)::BIGINT + 1] AS p95, v[-1] AS most, round(list_avg(v), 9) AS mean FROM s""")
def three_file_distributions(spark, sf_dir) -> DataFrame:
    return released(audit(spark, sf_dir), corpus.Audit.distributions).withColumn("mean", F.round("mean", 9))


@query("""WITH ids AS (SELECT 'q' || c_custkey || CASE WHEN c_custkey % 17 = 0 THEN '_abs' ELSE '' END AS id, 'no_haystack' AS problem FROM customer WHERE c_custkey % 101 = 7)
SELECT * FROM ids UNION ALL SELECT 'x' || n_nationkey, 'unknown_question' FROM nation""")
def three_file_problems(spark, sf_dir) -> DataFrame:
    return released(audit(spark, sf_dir), lambda a: saved(a.problems()))
