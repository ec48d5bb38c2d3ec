"""The domain's queries over the bundled tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cost, derived, graph, partition, scores, stats, trees, worklog
from ..sources.shared import saved
from ..sources.tables import ATTEMPTS_SQL, EVIDENCE_SQL, SCORES_SQL, attempts, evidence, load, score_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Scores

MACRO = f"""WITH {SCORES_SQL}, e AS (SELECT episode_id, plan_id, replicate_id, avg(score) AS score FROM scores GROUP BY ALL),
m AS (SELECT plan_id, replicate_id, avg(score) AS score, count(*)::BIGINT AS episodes FROM e GROUP BY ALL), q AS (SELECT plan_id, avg(score) AS quality FROM m GROUP BY ALL)"""


@query(f"{MACRO} SELECT plan_id, replicate_id, round(score, 9) AS score, episodes FROM m")
def episode_macro_scores(spark, sf_dir):
    return scores.macro_scores(score_rows(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(f"{MACRO} SELECT plan_id, round(quality, 9) AS quality FROM q")
def plan_quality(spark, sf_dir):
    return scores.plan_quality(score_rows(spark, sf_dir)).withColumn("quality", F.round("quality", 9))


@query(f"{MACRO} SELECT round(avg(quality), 9) AS q_mean, round(min(quality), 9) AS q_worst, round(max(quality), 9) AS q_best FROM q WHERE plan_id <> 'right_deep'")
def task_quality(spark, sf_dir):
    t = scores.task_quality(score_rows(spark, sf_dir), scores.PRIMARY)
    return t.select(*[F.round(c, 9).alias(c) for c in t.columns])


@query(f"{MACRO} SELECT round(max(CASE WHEN plan_id = 'canonical_balanced' THEN quality END) - max(CASE WHEN plan_id = 'left_deep' THEN quality END), 9) AS delta FROM q")
def delta_primary(spark, sf_dir):
    return scores.delta_primary(score_rows(spark, sf_dir)).withColumn("delta", F.round("delta", 9))


@query(f"{MACRO} SELECT round(max(quality) - min(quality), 9) AS range FROM q")
def diagnostic_range(spark, sf_dir):
    return scores.diagnostic_range(score_rows(spark, sf_dir)).withColumn("range", F.round("range", 9))


def _paired(spark, sf_dir) -> DataFrame:
    rows = score_rows(spark, sf_dir).withColumn("replicate_id", F.lit(0))
    return stats.paired_differences(rows.where("plan_id <> 'right_deep'"))


PAIRED = f"""WITH {SCORES_SQL}, p AS (SELECT episode_id, avg(score) FILTER (plan_id = 'left_deep') AS a, avg(score) FILTER (plan_id = 'canonical_balanced') AS b FROM scores GROUP BY ALL),
d AS (SELECT episode_id, b - a AS diff FROM p WHERE a IS NOT NULL AND b IS NOT NULL)"""
DRAW = "('0x' || substr(sha256({key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(f"{PAIRED} SELECT episode_id, round(diff, 9) + 0.0 AS diff FROM d")
def paired_differences(spark, sf_dir):
    return _paired(spark, sf_dir).withColumn("diff", F.round("diff", 9) + 0.0)


@query(f"""{PAIRED}, o AS (SELECT avg(diff) AS delta, count(*)::BIGINT AS independent_blocks FROM d),
h AS (SELECT diff, b, sha256('7:' || b || ':' || episode_id) AS x FROM d, (SELECT unnest(range(0, 4)) AS b)),
s AS (SELECT b * 256 + i AS p, avg(CASE WHEN ((instr('0123456789abcdef', x[i // 4 + 1]) - 1) >> (3 - i % 4)) & 1 = 0 THEN diff ELSE -diff END) AS m FROM h, (SELECT unnest(range(0, 256)) AS i) WHERE b * 256 + i < 1000 GROUP BY ALL)
SELECT round(delta, 9) AS delta, (count(*) FILTER (abs(m) >= abs(delta) - 1e-12) + 1) / 1001.0::DOUBLE AS p_value, independent_blocks FROM s, o GROUP BY ALL""")
def paired_permutation(spark, sf_dir):
    return stats.permutation_test(_paired(spark, sf_dir), 1000, 7).withColumn("delta", F.round("delta", 9))


@query(f"""WITH {SCORES_SQL}, e AS (SELECT episode_id, replicate_id, avg(score) AS score FROM scores WHERE plan_id = 'left_deep' GROUP BY ALL),
r AS (SELECT (row_number() OVER (ORDER BY replicate_id))::INT AS i, avg(score) AS mean FROM e GROUP BY replicate_id), n AS (SELECT count(*) AS n FROM r),
k AS (SELECT draw, side, (floor({DRAW.format(key="'3:' || draw || ':' || side || ':' || rep")} * n) + 1)::INT AS i FROM n, (SELECT unnest(range(1, 1001)) AS draw), (SELECT unnest([0, 1]) AS side), (SELECT unnest(range(1, 6)) AS rep))
SELECT draw::BIGINT AS draw, round(abs(avg(mean) FILTER (side = 1) - avg(mean) FILTER (side = 0)), 9) AS statistic FROM k JOIN r USING (i) GROUP BY draw""")
def seed_null(spark, sf_dir):
    rows = score_rows(spark, sf_dir).where("plan_id = 'left_deep'")
    means = rows.groupBy("episode_id", "replicate_id").agg(F.avg("score").alias("score")).groupBy("replicate_id").agg(F.avg("score").alias("mean"))
    return stats.seed_null(means, 5, 1000, 3).withColumn("statistic", F.round("statistic", 9))


_POISSON = "[0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]::DOUBLE[]"


@query(f"""{PAIRED}, h AS (SELECT h, diff, sha256('5:' || h || ':' || episode_id) AS x FROM d, (SELECT unnest(range(0, 63)) AS h)),
w AS (SELECT h * 16 + i AS b, diff, len(list_filter({_POISSON}, lambda c: c < (('0x' || substr(x, 4 * i + 1, 4))::INT + 0.5::DOUBLE) / 65536)) AS w FROM h, (SELECT unnest(range(0, 16)) AS i) WHERE h * 16 + i < 1000),
m AS (SELECT b, sum(w * diff) / sum(w) AS m FROM w GROUP BY b) SELECT round(quantile_disc(m, 0.025), 9) AS lower, round(quantile_disc(m, 0.975), 9) AS upper FROM m""")
def bootstrap_interval(spark, sf_dir):
    i = stats.bootstrap_interval(_paired(spark, sf_dir), 1000, 5)
    return i.select(F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


# Text and evidence

@query(f"WITH {EVIDENCE_SQL} SELECT episode_id, sequence_index, role, token_count FROM evidence")
def token_counts(spark, sf_dir):
    return evidence(spark, sf_dir)


@query(f"WITH {EVIDENCE_SQL} SELECT episode_id, sequence_index, sum(token_count) OVER (PARTITION BY episode_id ORDER BY sequence_index)::BIGINT AS running FROM evidence")
def running_tokens(spark, sf_dir):
    return partition.running_tokens(evidence(spark, sf_dir))


@query(f"WITH {EVIDENCE_SQL}, n AS (SELECT episode_id, count(*) AS n FROM evidence GROUP BY 1) SELECT count(*) FILTER (n >= 4)::BIGINT AS n_master, count(*) FILTER (n >= 4)::BIGINT AS n4, count(*) FILTER (n >= 8)::BIGINT AS n8, count(*) FILTER (n >= 16)::BIGINT AS n16 FROM n")
def eligibility_counts(spark, sf_dir):
    return graph.eligibility_counts(evidence(spark, sf_dir))


def _partition_sql(source: str, k: int) -> str:
    """The greedy boundaries by recursion over j, independent of the fold."""
    return f"""WITH RECURSIVE {source}, c AS (SELECT episode_id, sequence_index, token_count, sum(token_count) OVER (PARTITION BY episode_id ORDER BY sequence_index)::BIGINT AS cum,
  count(*) OVER (PARTITION BY episode_id) AS n, sum(token_count) OVER (PARTITION BY episode_id)::BIGINT AS total FROM evidence),
b AS (SELECT episode_id, 0 AS j, 0::BIGINT AS p, max(n)::BIGINT AS n FROM c WHERE n >= {k} GROUP BY episode_id
  UNION ALL SELECT b.episode_id, b.j + 1, arg_min(c.sequence_index + 1, (abs(c.cum - (b.j + 1) * c.total / {k}.0::DOUBLE), c.sequence_index))::BIGINT, b.n
  FROM b JOIN c ON c.episode_id = b.episode_id AND c.sequence_index + 1 BETWEEN b.p + 1 AND b.n - ({k} - (b.j + 1)) WHERE b.j + 1 < {k} GROUP BY b.episode_id, b.j, b.n),
s AS (SELECT episode_id, j AS leaf, p AS start, coalesce(lead(p) OVER (PARTITION BY episode_id ORDER BY j), n) - 1 AS "end" FROM b)
SELECT s.episode_id, leaf::INT AS leaf, start::INT AS start, "end"::INT AS "end", sum(c.token_count)::BIGINT AS tokens FROM s JOIN c ON c.episode_id = s.episode_id AND c.sequence_index BETWEEN start AND "end" GROUP BY ALL"""


EVENT_EVIDENCE_SQL = """evidence AS (SELECT user_id AS episode_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS sequence_index, (floor(abs(value)) + 1)::BIGINT AS token_count FROM events)"""


def _event_evidence(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), (F.row_number().over(order) - 1).cast("bigint").alias("sequence_index"), (F.floor(F.abs("value")) + 1).cast("bigint").alias("token_count"))


@query(_partition_sql(EVIDENCE_SQL, 4))
def token_balanced_partition_k4(spark, sf_dir):
    return partition.partition(evidence(spark, sf_dir), 4)


@query(_partition_sql(EVIDENCE_SQL, 8))
def token_balanced_partition_k8(spark, sf_dir):
    return partition.partition(evidence(spark, sf_dir), 8)


@query(_partition_sql(EVENT_EVIDENCE_SQL, 16))
def token_balanced_partition_k16(spark, sf_dir):
    return partition.partition(_event_evidence(spark, sf_dir), 16)


@query(_partition_sql(EVIDENCE_SQL, 4).replace("SELECT s.episode_id, leaf::INT AS leaf", ", z AS (SELECT s.episode_id, leaf::INT AS leaf") + """)
SELECT episode_id, sha256('{"algorithm":"token_balanced_v1","k":4,"spans":[' || string_agg('{"end":' || "end" || ',"start":' || start || '}', ',' ORDER BY leaf) || ']}') AS partition_hash FROM z GROUP BY episode_id""")
def partition_hashes(spark, sf_dir):
    return partition.partition_hash(partition.partition(evidence(spark, sf_dir), 4), 4)


@query(f"""WITH RECURSIVE {EVIDENCE_SQL}, c AS (SELECT episode_id, sequence_index AS last, 0 AS chunk, sequence_index AS first, token_count AS tokens FROM evidence WHERE sequence_index = 0
UNION ALL SELECT c.episode_id, e.sequence_index, CASE WHEN c.tokens + e.token_count <= 150 THEN c.chunk ELSE c.chunk + 1 END, CASE WHEN c.tokens + e.token_count <= 150 THEN c.first ELSE e.sequence_index END,
  CASE WHEN c.tokens + e.token_count <= 150 THEN c.tokens + e.token_count ELSE e.token_count END FROM c JOIN evidence e ON e.episode_id = c.episode_id AND e.sequence_index = c.last + 1)
SELECT episode_id, chunk::INT AS chunk, first::BIGINT AS first, max(last)::BIGINT AS last, max(tokens)::BIGINT AS tokens FROM c GROUP BY episode_id, chunk, first""")
def episode_chunks(spark, sf_dir):
    return partition.chunked(evidence(spark, sf_dir), 150)


@query(f"""WITH {EVIDENCE_SQL}, o AS (SELECT role, list(token_count ORDER BY token_count) AS v FROM evidence GROUP BY role)
SELECT role, len(v)::BIGINT AS n, v[1] AS least, v[len(v)] AS most, round(list_avg(v), 9) AS mean, v[round_even((len(v) - 1) * 0.5, 0)::INT + 1] AS p50, v[round_even((len(v) - 1) * 0.95, 0)::INT + 1] AS p95 FROM o""")
def quantiles_by_role(spark, sf_dir):
    return scores.quantiles(evidence(spark, sf_dir), ["role"], "token_count").withColumn("mean", F.round("mean", 9))


@query(f"WITH {EVIDENCE_SQL} SELECT role, quantile_disc(token_count, 0.95) AS p95 FROM evidence GROUP BY role")
def p95_nearest_rank(spark, sf_dir):
    return evidence(spark, sf_dir).groupBy("role").agg(scores.nearest_rank("token_count", 0.95).cast("bigint").alias("p95"))


_ARTICLE = r"(^|[^\p{{L}}\p{{N}}_])(a|an|the)($|[^\p{{L}}\p{{N}}_])"
NORMAL = r"trim(regexp_replace(" + "regexp_replace(" * 2 + r"translate(lower({x}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', '')" + rf", '{_ARTICLE}', '\1 \3', 'g')" * 2 + r", '\s+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, {NORMAL.format(x='text')} AS answer FROM conversations".replace(r'\"', '"'))
def normalized_answers(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalized_answer(F.col("text")).alias("answer"))


@query(f"""WITH n AS (SELECT doc_id, {NORMAL.format(x='text')} AS t FROM documents) SELECT min(doc_id) AS first_doc, count(*)::BIGINT AS copies FROM n GROUP BY t HAVING count(*) > 1""".replace(r'\"', '"'))
def normalized_duplicates(spark, sf_dir):
    key = F.sha2(text.normalized_answer(F.col("text")).cast("binary"), 256)
    return load(spark, sf_dir, "documents").groupBy(key.alias("k")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1").drop("k")


@query(f"""WITH a AS (SELECT conv_id, turn, {NORMAL.format(x='text')} AS t, {NORMAL.format(x="first_value(text) OVER (PARTITION BY conv_id ORDER BY turn)")} AS r FROM conversations)
SELECT conv_id, turn, (t = r)::INT AS em, contains(t, r)::INT AS sem FROM a""".replace(r'\"', '"'))
def answer_matches(spark, sf_dir):
    from pyspark.sql import Window

    first = F.first("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = load(spark, sf_dir, "conversations").withColumn("refs", F.array(first))
    return rows.select("conv_id", "turn", text.exact_match(F.col("text"), F.col("refs")).alias("em"), text.substring_match(F.col("text"), F.col("refs")).alias("sem"))


@query(r"""WITH j AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"label": 1}' WHEN 1 THEN '{"label": 0}' WHEN 2 THEN '{"label": true}' WHEN 3 THEN '{"label": 1, "label": 0}' WHEN 4 THEN '{"label": 1, "x": 2}' ELSE 'yes' END AS reply FROM events)
SELECT event_id, CASE reply WHEN '{"label": 1}' THEN 1 WHEN '{"label": 0}' THEN 0 END AS label FROM j""")
def judge_label_parse(spark, sf_dir):
    replies = ['{"label": 1}', '{"label": 0}', '{"label": true}', '{"label": 1, "label": 0}', '{"label": 1, "x": 2}', "yes"]
    reply = F.element_at(F.array(*[F.lit(r) for r in replies]), (F.col("event_id") % 6 + 1).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", text.judge_label(reply).alias("label"))


# Retrieval

COSINE = """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS item_id, round(coalesce(list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 0), 0), 6) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)"""


def _cosine(spark, sf_dir, cost=None, budget=None) -> DataFrame:
    items = load(spark, sf_dir, "embeddings")
    return partition.cosine_scores(items.where("vec_id % 50 = 0"), items, cost, budget)


@query(f"{COSINE} SELECT query_id, item_id, score, rank::INT AS rank FROM r")
def cosine_rank(spark, sf_dir):
    return partition.ranked(_cosine(spark, sf_dir)).select("query_id", "item_id", "score", "rank")


def _packed(spark, sf_dir) -> DataFrame:
    items = partition.ranked(_cosine(spark, sf_dir, F.col("vec_id") % 37 + 5, 200))
    return partition.greedy_pack(items, 200)


PACK = COSINE.replace("WITH q AS", "WITH RECURSIVE q AS") + """, i AS (SELECT query_id, item_id, rank, item_id % 37 + 5 AS cost FROM r),
p AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, []::BIGINT[] AS kept FROM i GROUP BY query_id
  UNION ALL SELECT p.query_id, i.rank, CASE WHEN used + cost <= 200 THEN used + cost ELSE used END, CASE WHEN used + cost <= 200 THEN list_append(kept, item_id) ELSE kept END FROM p JOIN i ON i.query_id = p.query_id AND i.rank = p.rank + 1)"""


@query(f"{PACK} SELECT query_id, used, array_to_string(kept, ',') AS packed FROM p WHERE rank = (SELECT max(rank) FROM i)")
def greedy_pack(spark, sf_dir):
    return _packed(spark, sf_dir).select("query_id", "used", F.array_join(F.transform("packed", lambda x: x.cast("string")), ",").alias("packed"))


@query(f"{PACK} SELECT query_id, array_to_string(list_sort(kept), ',') AS rendered FROM p WHERE rank = (SELECT max(rank) FROM i)")
def chronological_render(spark, sf_dir):
    return _packed(spark, sf_dir).select("query_id", F.array_join(F.transform("rendered", lambda x: x.cast("string")), ",").alias("rendered"))


# Work logs

BOUND = f"""WITH {ATTEMPTS_SQL}, bound AS (SELECT run_id, stage, logical_call_id, arg_max(attempt_id, (started_at, attempt_id)) AS attempt_id FROM attempts WHERE outcome = 'accepted' GROUP BY ALL),
marked AS (SELECT a.*, b.attempt_id IS NOT NULL AS accepted, a.outcome <> 'cancelled_before_start' AS started FROM attempts a LEFT JOIN bound b USING (attempt_id))"""


def _sum_sql(prefix: str, where: str) -> str:
    lost = f"coalesce(bool_or(input_tokens IS NULL) FILTER ({where}), false)"
    known = lambda c: f"CASE WHEN NOT {lost} THEN coalesce(sum({c}) FILTER ({where}), 0)::BIGINT END"
    vague = f"coalesce(bool_or(input_tokens IS NULL OR reasoning_tokens IS NULL) FILTER ({where}), false)"
    return f"""{known('input_tokens')} AS {prefix}_input, {known('cached_tokens')} AS {prefix}_cached, {known('input_tokens')} - {known('cached_tokens')} AS {prefix}_uncached,
{known('output_tokens')} AS {prefix}_output, CASE WHEN NOT {vague} THEN coalesce(sum(reasoning_tokens) FILTER ({where}), 0)::BIGINT END AS {prefix}_reasoning"""


def _marked(spark, sf_dir) -> DataFrame:
    rows = attempts(spark, sf_dir)
    return worklog.marked(rows, worklog.bindings(rows))


@query(f"WITH {ATTEMPTS_SQL} SELECT run_id, stage, {_sum_sql('provider', 'true')} FROM attempts GROUP BY run_id, stage")
def provider_totals(spark, sf_dir):
    return worklog.provider_totals(attempts(spark, sf_dir), "run_id", "stage")


@query(f"""{BOUND} SELECT run_id, {_sum_sql('accepted', 'accepted')}, {_sum_sql('observed', 'started')}, count(*)::BIGINT AS attempts, count(*) FILTER (outcome = 'failed')::BIGINT AS failed, count(*) FILTER (accepted)::BIGINT AS materialized,
coalesce(sum(seconds) FILTER (started), 0)::BIGINT AS latency, coalesce(sum(seconds) FILTER (started AND NOT accepted), 0)::BIGINT AS retry_latency FROM marked GROUP BY run_id""")
def attempt_work(spark, sf_dir):
    return worklog.work(_marked(spark, sf_dir), "run_id")


_STAGES = ", ".join(_sum_sql(p, f"stage = '{s}' AND {w}") for s, (a, o) in {"leaf": ("shared_leaf", "observed_leaf"), "merge": ("accepted_merge", "observed_merge"), "answer": ("accepted_answer", "observed_answer"), "judge": ("accepted_judge", "observed_judge")}.items() for p, w in ((a, "accepted"), (o, "started")))


@query(f"""{BOUND}, t AS (SELECT run_id, {_STAGES}, {_sum_sql('la', "stage <> 'judge' AND accepted")}, {_sum_sql('lo', "stage <> 'judge' AND started")},
coalesce(sum(seconds) FILTER (stage <> 'judge' AND started AND NOT accepted), 0)::BIGINT AS retry_latency FROM marked GROUP BY run_id)
SELECT * EXCLUDE (la_input, la_cached, la_uncached, la_output, la_reasoning, lo_input, lo_cached, lo_uncached, lo_output, lo_reasoning), lo_input + lo_output - la_input - la_output AS retry_tokens FROM t""")
def reconcile_work(spark, sf_dir):
    return worklog.reconciled(_marked(spark, sf_dir), "run_id")


@query(f"""WITH {ATTEMPTS_SQL}, w AS (SELECT run_id, stage, (epoch_us(max(started_at + to_seconds(seconds))) - epoch_us(min(started_at))) / 1e6::DOUBLE AS wall, sum(seconds)::BIGINT AS busy FROM attempts WHERE outcome <> 'cancelled_before_start' GROUP BY ALL)
SELECT run_id, stage, wall, busy, CASE WHEN wall > 0 THEN round(busy / wall, 12) END AS parallelism FROM w""")
def stage_wall_clock(spark, sf_dir):
    return worklog.stage_clock(attempts(spark, sf_dir)).withColumn("parallelism", F.round("parallelism", 12))


RATES = ("1.250000", "0.125000", "10.000000", "0.000100")


@query(f"WITH {ATTEMPTS_SQL} SELECT attempt_id, ceil((input_tokens - cached_tokens)::DECIMAL(20, 0) * 1.25 + cached_tokens::DECIMAL(20, 0) * 0.125 + output_tokens::DECIMAL(20, 0) * 10 + 100)::BIGINT AS micro_usd FROM attempts")
def usd_estimate(spark, sf_dir):
    return worklog.usd(attempts(spark, sf_dir), *RATES).select("attempt_id", "micro_usd")


@query(f"""WITH {ATTEMPTS_SQL}, c AS (SELECT run_id, stage, ceil((input_tokens - cached_tokens)::DECIMAL(20, 0) * 1.25 + cached_tokens::DECIMAL(20, 0) * 0.125 + output_tokens::DECIMAL(20, 0) * 10 + 100)::BIGINT AS m FROM attempts)
SELECT run_id, stage, CASE WHEN count(m) = count(*) THEN sum(m)::BIGINT END AS c_life FROM c GROUP BY ALL""")
def lifecycle_cost(spark, sf_dir):
    return worklog.lifecycle_cost(worklog.usd(attempts(spark, sf_dir), *RATES), "run_id", "stage")


def _merge_events(spark, sf_dir) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    tokens = lambda c, m: (F.col(c) % m + 1).cast("bigint")
    return li.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("event_id"), tokens("l_partkey", 97).alias("left_tokens"), tokens("l_suppkey", 89).alias("right_tokens"),
        tokens("l_orderkey", 61).alias("output_tokens"), F.lit(128).cast("bigint").alias("budget"), tokens("l_partkey", 50).alias("payload_tokens"),
        F.col("l_linenumber").cast("bigint").alias("left_hi"), (F.col("l_partkey") % 9).cast("bigint").alias("right_lo"), F.when(F.col("l_returnflag") == "R", "cache").otherwise("generated").alias("source"))


@query("""WITH m AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS event_id, l_partkey % 97 + 1 AS l, l_suppkey % 89 + 1 AS r, l_orderkey % 61 + 1 AS o, l_partkey % 50 + 1 AS p, l_linenumber AS hi, l_partkey % 9 AS lo, l_returnflag <> 'R' AS generative FROM lineitem)
SELECT event_id, (l + r) / 128.0::DOUBLE AS pressure, round(o / (l + r)::DOUBLE, 12) AS compression, o / 128.0::DOUBLE AS utilization, p / 128.0::DOUBLE AS payload_ratio, round(abs(l - r) / (l + r)::DOUBLE, 12) AS imbalance, CASE WHEN hi < lo THEN round((l - r) / (l + r)::DOUBLE, 12) END AS imbalance_signed, generative FROM m""")
def merge_metrics(spark, sf_dir):
    m = worklog.merge_metrics(_merge_events(spark, sf_dir))
    return m.select("event_id", "pressure", F.round("compression", 12).alias("compression"), "utilization", "payload_ratio", F.round("imbalance", 12).alias("imbalance"), F.round("imbalance_signed", 12).alias("imbalance_signed"), "generative")


@query("SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) > 1")
def cross_split_overlap(spark, sf_dir):
    split = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return worklog.overlap(load(spark, sf_dir, "lineitem").withColumn("split", split), "l_suppkey")


@query("SELECT l_suppkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag || l_linestatus) > 1")
def disagreeing_rows(spark, sf_dir):
    return worklog.disagreeing(load(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linenumber"], "l_returnflag", "l_linestatus")


@query("""WITH RECURSIVE e AS (SELECT event_id AS node, floor(abs(value))::BIGINT % 60 AS seconds FROM events),
w AS (SELECT node, seconds AS finish, 1 AS d FROM e WHERE node % 8 = 0 UNION ALL SELECT e.node, w.finish + e.seconds, d + 1 FROM w JOIN e ON e.node = w.node + 1 WHERE e.node % 8 <> 0)
SELECT node, finish FROM w""")
def critical_path(spark, sf_dir):
    nodes = load(spark, sf_dir, "events").select(F.col("event_id").alias("node"), (F.floor(F.abs("value")) % 60).cast("bigint").alias("seconds"))
    edges = nodes.where("node % 8 <> 0").select(F.col("node").alias("parent"), (F.col("node") - 1).alias("child"))
    return worklog.critical_path(edges, nodes)


@query("""WITH RECURSIVE a AS (SELECT event_id AS node, event_id % 5 <> 0 AS cached, event_type <> 'view' AS generated FROM events),
r AS (SELECT node, node AS at, cached, generated FROM a UNION ALL SELECT r.node, a.node, a.cached, a.generated FROM r JOIN a ON a.node = r.at - 1 WHERE r.cached)
SELECT node, generated AS generative FROM r WHERE NOT cached""")
def lineage_generative(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    cached = F.col("event_id") % 5 != 0
    return worklog.generative_lineage(e.select(F.col("event_id").alias("node"), F.when(cached, "cache").when(F.col("event_type") == "view", "deterministic").otherwise("generated").alias("source"), F.when(cached, F.col("event_id") - 1).alias("cache_of")))


# Leakage, splits, strata

def _relations(spark, sf_dir) -> DataFrame:
    """Orders by the parts they take from a supplier (the part alone would join nearly all orders in one group), and by such a part at an equal place."""
    pair = F.concat_ws(":", "l_partkey", "l_suppkey")
    kinds = F.array(F.struct(F.lit("answer_session").alias("relation"), pair.alias("value")), F.struct(F.lit("supporting_evidence_hash").alias("relation"), F.md5(F.concat_ws(":", pair, "l_linenumber").cast("binary")).alias("value")))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("episode_id"), F.explode(kinds).alias("r")).select("episode_id", "r.*")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey::BIGINT AS id, l_partkey || ':' || l_suppkey AS v FROM lineitem),
n AS (SELECT DISTINCT a.id AS a, b.id AS b FROM e a JOIN e b ON a.v = b.v),
r AS (SELECT id, id AS other FROM (SELECT DISTINCT id FROM e) UNION SELECT r.id, n.b FROM r JOIN n ON n.a = r.other),
l AS (SELECT id, min(other) AS label FROM r GROUP BY id),
g AS (SELECT label, count(*)::BIGINT AS group_size, 'lmg-' || substr(sha256('{"episode_ids":[' || string_agg('"' || id || '"', ',' ORDER BY id::VARCHAR) || ']}'), 1, 16) AS group_id FROM l GROUP BY label),
k AS (SELECT label, 'answer_session' AS kind FROM l JOIN e USING (id) GROUP BY label, v HAVING count(*) > 1 UNION SELECT label, 'supporting_evidence_hash' FROM l JOIN (SELECT DISTINCT l_orderkey::BIGINT AS id, l_partkey, l_suppkey, l_linenumber FROM lineitem) USING (id) GROUP BY label, l_partkey, l_suppkey, l_linenumber HAVING count(*) > 1),
s AS (SELECT label, string_agg(DISTINCT kind, ',' ORDER BY kind) AS relations FROM k GROUP BY label)
SELECT id AS episode_id, group_id, group_size, coalesce(relations, '') AS relations FROM l JOIN g USING (label) LEFT JOIN s USING (label)""")
def leakage_components(spark, sf_dir):
    return graph.leakage_groups(_relations(spark, sf_dir))


@query()
def split_assignment(spark, sf_dir):
    groups = graph.leakage_groups(_relations(spark, sf_dir))
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("episode_id"), F.col("o_orderpriority").alias("question_type"), (F.col("o_orderstatus") == "F").cast("int").alias("p"))
    typed = saved(groups.join(orders, "episode_id").groupBy("group_id", "question_type").agg(F.sum("p").alias("primary"), F.count("*").alias("expanded")))
    out = None
    for candidate in graph.SPLITS:
        own = graph.assign_splits(typed, candidate).select(F.lit(candidate).alias("candidate"), "group_id", "split")
        out = own if out is None else out.unionByName(own)
    return out


@query("""WITH p AS (SELECT doc_id, source, sha256('case:' || source || ':' || doc_id) AS pick FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pick, doc_id) AS n FROM p) SELECT doc_id AS episode_id, source AS category FROM r WHERE n <= CASE source WHEN 'src1' THEN 8 WHEN 'src2' THEN 7 ELSE 6 END AND source <> 'src0'""")
def quota_sample(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_id"), F.col("source").alias("category"))
    return graph.quota_sample(rows.where("category <> 'src0'"), {"src1": 8, "src2": 7} | {f"src{i}": 6 for i in range(3, 20)}, "case").select("episode_id", "category")


STRATA = """s AS (SELECT CASE WHEN d.lang = 'en' THEN 'knowledge-update' ELSE 'temporal-reasoning' END AS question_type, CASE WHEN l.quality = 1 THEN 'single' ELSE 'multiple' END AS support_class,
  CASE WHEN d.doc_id % 3 = 0 THEN 'early' WHEN d.doc_id % 3 = 1 THEN 'middle' ELSE 'late' END AS position_bin, count(*)::BIGINT AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL)"""


def _strata(spark, sf_dir) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    place = F.element_at(F.array(F.lit("early"), F.lit("middle"), F.lit("late")), (F.col("doc_id") % 3 + 1).cast("int"))
    return scores.stratum_counts(rows.select(F.when(F.col("lang") == "en", "knowledge-update").otherwise("temporal-reasoning").alias("question_type"), F.when(F.col("quality") == 1, "single").otherwise("multiple").alias("support_class"), place.alias("position_bin")), "question_type", "support_class", "position_bin")


@query(f"WITH {STRATA} SELECT * FROM s")
def evidence_strata(spark, sf_dir):
    return _strata(spark, sf_dir)


DESIGN = f"""WITH {STRATA}, w AS (SELECT *, n / (sum(n) OVER ())::DOUBLE AS weight, CASE question_type WHEN 'knowledge-update' THEN 0.95 ELSE 1.05 END::DOUBLE * CASE support_class WHEN 'single' THEN 0.9 ELSE 1.1 END::DOUBLE * CASE position_bin WHEN 'early' THEN 0.9 WHEN 'late' THEN 1.1 ELSE 1.0 END::DOUBLE AS f FROM s),
design AS (SELECT question_type, support_class, position_bin, n, weight, f / sum(weight * f) OVER () AS multiplier FROM w)"""


@query(f"{DESIGN} SELECT question_type, support_class, position_bin, n, round(weight, 12) AS weight, round(multiplier, 12) AS multiplier FROM design")
def strata_design(spark, sf_dir):
    return stats.strata_design(_strata(spark, sf_dir)).withColumn("weight", F.round("weight", 12)).withColumn("multiplier", F.round("multiplier", 12))


EFFECTS = (-0.15, -0.1, -0.05, 0.0, 0.05, 0.1, 0.15)
PROBS = f"""WITH g AS (SELECT e::DOUBLE AS effect, d::DOUBLE AS discordance FROM (SELECT unnest({list(EFFECTS)}) AS e), (SELECT unnest({list(stats.DISCORDANCE)}) AS d)),
b AS (SELECT *, greatest(0.0, least(1.0, 0.65 + effect)) AS r FROM g), a AS (SELECT *, r - 0.65 AS gap, least(least(0.65 + r, 2 - 0.65 - r), greatest(abs(r - 0.65), discordance)) AS apart FROM b),
j AS (SELECT effect, discordance, (apart + gap) / 2 AS p10, (apart - gap) / 2 AS p01, r - (apart + gap) / 2 AS p11, 1 - (apart + gap) / 2 - (apart - gap) / 2 - (r - (apart + gap) / 2) AS p00 FROM a),
c AS (SELECT effect, discordance, unnest([1, 0, 1, 0]) AS x, unnest([0, 1, 1, 0]) AS y, unnest([p10, p01, p11, p00]) AS p FROM j),
o AS (SELECT effect, discordance, ox - oy AS difference, sum(p * CASE WHEN ox = x THEN 0.95 ELSE 0.05 END * CASE WHEN oy = y THEN 0.95 ELSE 0.05 END) AS probability FROM c, (SELECT unnest([0, 1]) AS ox), (SELECT unnest([0, 1]) AS oy) GROUP BY ALL)"""


# The effects of all strata: the scenario's times the stratum's multiplier.
_OWN = f"""{DESIGN}, {PROBS.removeprefix('WITH ').replace(PROBS[PROBS.index('g AS'):PROBS.index(chr(10))], f'g AS (SELECT DISTINCT e * multiplier AS effect, d::DOUBLE AS discordance FROM design, (SELECT unnest({list(EFFECTS)})::DOUBLE AS e), (SELECT unnest({list(stats.DISCORDANCE)}) AS d)),', 1)}"""


def _one(spark, sf_dir) -> DataFrame:
    """The difference's chances for every effect and discordance of the table's strata, few rows however many episodes they count."""
    design = stats.strata_design(_strata(spark, sf_dir)).select("multiplier").distinct()
    effects = design.select(F.explode(F.array(*[F.lit(float(e)) * F.col("multiplier") for e in EFFECTS])).alias("effect"))
    grid = effects.withColumn("discordance", F.explode(F.array(*[F.lit(float(d)) for d in stats.DISCORDANCE]))).distinct()
    return grid.withColumn("p", stats.difference_probabilities(F.col("effect"), F.col("discordance")))


@query(f"{_OWN} SELECT round(effect, 9) AS effect, discordance, difference::INT AS difference, round(probability, 10) AS probability FROM o")
def difference_probabilities(spark, sf_dir):
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("difference"), F.round(F.col(f"p.{n}"), 10).alias("probability")) for d, n in ((-1, "minus"), (0, "zero"), (1, "plus"))]))
    return _one(spark, sf_dir).select(F.round("effect", 9).alias("effect"), "discordance", each.alias("x")).select("effect", "discordance", "x.*")


_STEP = "".join(f", r{i} AS (SELECT r.effect, r.discordance, r.difference + o.difference AS difference, sum(r.probability * o.probability) AS probability FROM {'o' if i == 2 else f'r{i - 1}'} r JOIN o USING (effect, discordance) GROUP BY ALL)" for i in range(2, 6))


@query(f"{_OWN}{_STEP} SELECT round(effect, 9) AS effect, discordance, difference::INT AS difference, round(probability, 9) AS probability FROM r5")
def difference_distribution(spark, sf_dir):
    return stats.repeated_distribution(_one(spark, sf_dir)).select(F.round("effect", 9).alias("effect"), "discordance", F.col("difference").cast("int").alias("difference"), F.round("probability", 9).alias("probability"))


# Each stratum's effect is the scenario's times its multiplier; the strata's distributions are mixed by weight.
_SCENARIOS = f"(SELECT unnest({list(stats.SIMULATION_EFFECTS)})::DOUBLE AS effect), (SELECT unnest({list(stats.DISCORDANCE)})::DOUBLE AS discordance)"
_MIXED = f"""{DESIGN}, cells AS (SELECT effect, discordance, weight, effect * multiplier AS own FROM {_SCENARIOS}, design),
{PROBS.removeprefix('WITH ').replace(PROBS[PROBS.index('g AS'):PROBS.index(chr(10))], 'g AS (SELECT DISTINCT own AS effect, discordance FROM cells),', 1)}{_STEP},
mixed AS (SELECT c.effect, c.discordance, r5.difference, sum(weight * probability) AS probability FROM cells c JOIN r5 ON r5.effect = c.own AND r5.discordance = c.discordance GROUP BY ALL),
upto AS (SELECT effect, discordance, difference, sum(probability) OVER (PARTITION BY effect, discordance ORDER BY difference) AS upto FROM mixed),
lookup AS (SELECT effect, discordance, list(upto ORDER BY difference) FILTER (difference < 5) AS t FROM upto GROUP BY ALL),
drawn AS (SELECT effect, discordance, draw, t, ('0x' || substr(sha256('17:d:' || effect || ':' || discordance || ':' || draw || ':' || episode), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS v FROM lookup, range({stats.POWER_DRAWS}) d(draw), range(1, 100) e(episode)),
x AS (SELECT effect, discordance, draw, (v > t[1])::INT + (v > t[2])::INT + (v > t[3])::INT + (v > t[4])::INT + (v > t[5])::INT + (v > t[6])::INT + (v > t[7])::INT + (v > t[8])::INT + (v > t[9])::INT + (v > t[10])::INT - 5 AS x FROM drawn),
sums AS (SELECT effect, discordance, draw, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY ALL),
rates AS (SELECT effect, discordance, count(*) FILTER (q > 0 AND abs(s) / sqrt(q) > {stats.Z}) AS detected, count(*) AS draws FROM sums GROUP BY ALL)"""


@query(f"{_MIXED} SELECT effect, discordance, detected, draws, detected / draws AS power FROM rates")
def power_grid(spark, sf_dir):
    """Every effect and discordance, for the 99 episodes that the 20/30/50 split accepts."""
    design = stats.strata_design(_strata(spark, sf_dir))
    rates = stats.power(spark, design, stats.scenario_grid(spark, stats.SIMULATION_EFFECTS), 99, stats.POWER_DRAWS, 17)
    return rates.select("effect", "discordance", "detected", "draws", "power")


@query()
def power_decision(spark, sf_dir):
    """The design of all split candidates, each with the acceptance share of 199 episodes, in every scenario."""
    design = stats.strata_design(_strata(spark, sf_dir))
    scenarios = stats.scenario_grid(spark, stats.SIMULATION_EFFECTS)
    parts = []
    for position, shares in enumerate(graph.SPLITS.values()):
        n = 199 * shares[-1] // 100
        rates = stats.power(spark, design, scenarios, n, stats.POWER_DRAWS, 17 + position)
        parts.append(rates.withColumn("candidate", F.lit(position)))
    return stats.choose_design(functools.reduce(DataFrame.unionByName, parts))


@query("""WITH s AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O')::DOUBLE AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), c AS (SELECT *, k / n AS p, 1.959963984540054::DOUBLE AS z FROM s)
SELECT l_returnflag, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 10) AS lower, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 10) AS upper FROM c""")
def wilson_interval(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").cast("double").alias("k"), F.count("*").cast("double").alias("n")).withColumn("w", stats.wilson(F.col("k"), F.col("n")))
    return s.select("l_returnflag", F.round("w.lower", 10).alias("lower"), F.round("w.upper", 10).alias("upper"))


@query("""WITH o AS (SELECT event_id // 3 AS case_id, event_type <> 'error' AS parsed, CASE WHEN value > 20 THEN 1 ELSE 0 END AS label FROM events), c AS (SELECT case_id, count(*) AS n, count(*) FILTER (parsed) AS parsed, count(*) FILTER (parsed AND label = 1) AS ones, count(*) FILTER (parsed AND label = 0) AS zeros FROM o GROUP BY 1)
SELECT round(avg(CASE WHEN ones = 3 OR zeros = 3 THEN 1 ELSE 0 END), 12) AS unanimity, round(avg(ones * zeros / 3.0::DOUBLE), 12) AS flip, round(sum(parsed) / sum(n)::DOUBLE, 12) AS parse, avg(CASE WHEN ones = 3 OR zeros = 3 THEN 1 ELSE 0 END) >= 0.95 AND avg(ones * zeros / 3.0::DOUBLE) <= 0.05 AND sum(parsed) = sum(n) AS passes FROM c""")
def repeatability_metrics(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("case_id"), (F.col("event_type") != "error").alias("parsed"), (F.col("value") > 20).cast("int").alias("label"))
    r = stats.repeatability(e)
    return r.select(*[F.round(c, 12).alias(c) for c in ("unanimity", "flip", "parse")], "passes")


# Frozen formulas

BUDGETS = (128, 256, 512, 1024)


@query(f"WITH {EVIDENCE_SQL}, e AS (SELECT episode_id, sum(token_count) AS t FROM evidence GROUP BY 1) SELECT b::INT AS budget, avg((t <= b)::INT) AS fit FROM e, (SELECT unnest({list(BUDGETS)}) AS b) GROUP BY b")
def raw_fit(spark, sf_dir):
    return derived.raw_fit(evidence(spark, sf_dir).groupBy("episode_id").agg(F.sum("token_count").alias("tokens")), BUDGETS)


@query(f"WITH {EVIDENCE_SQL}, q AS (SELECT quantile_disc(token_count, 0.25) AS a, quantile_disc(token_count, 0.5) AS b, quantile_disc(token_count, 0.75) AS c FROM evidence) SELECT x::INT AS budget, a / x::DOUBLE AS p25, b / x::DOUBLE AS p50, c / x::DOUBLE AS p75 FROM q, (SELECT unnest({list(BUDGETS)}) AS x)")
def leaf_load(spark, sf_dir):
    return derived.leaf_load(evidence(spark, sf_dir).withColumnRenamed("token_count", "tokens"), BUDGETS)


@query(f"{PAIRED} SELECT count(*) FILTER (diff > 1e-12)::BIGINT AS wins, count(*) FILTER (abs(diff) <= 1e-12)::BIGINT AS ties, count(*) FILTER (diff < -1e-12)::BIGINT AS losses FROM d")
def win_tie_loss(spark, sf_dir):
    return derived.win_tie_loss(_paired(spark, sf_dir))


@query("""WITH p AS (SELECT l_suppkey % 10 AS g, l_partkey % 500 AS cost, max(l_discount)::DOUBLE AS quality FROM lineitem GROUP BY ALL)
SELECT g, cost, quality FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.g = p.g AND o.cost <= p.cost AND o.quality >= p.quality AND (o.cost < p.cost OR o.quality > p.quality))""")
def pareto_front(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("g"), (F.col("l_partkey") % 500).alias("cost")).agg(F.max(F.col("l_discount").cast("double")).alias("quality"))
    return derived.pareto(rows, ["g"], "cost", "quality")


@query(f"WITH {SCORES_SQL}, m AS (SELECT plan_id, replicate_id, avg(score) AS m FROM scores GROUP BY ALL) SELECT plan_id, round(max(m) - min(m), 9) AS range FROM m GROUP BY plan_id")
def plan_seed_range(spark, sf_dir):
    return derived.plan_seed_range(score_rows(spark, sf_dir)).withColumn("range", F.round("range", 9))


@query("""WITH c AS (SELECT event_id % 4 AS concurrency, event_type <> 'error' AS ok, abs(value) AS seconds FROM events)
SELECT concurrency, count(*)::BIGINT AS calls, count(*) FILTER (ok)::BIGINT AS successes, quantile_disc(seconds, 0.95) AS p95, (count(*) - count(*) FILTER (ok)) / count(*)::DOUBLE AS error_rate,
(count(*) - count(*) FILTER (ok)) / count(*)::DOUBLE <= 0.05 AND quantile_disc(seconds, 0.95) <= 180 AS passes FROM c GROUP BY concurrency""")
def call_rollup(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("concurrency"), (F.col("event_type") != "error").alias("ok"), F.abs("value").alias("seconds"))
    return derived.call_rollup(rows, "concurrency")


@query("""WITH u AS (SELECT l_orderkey, avg(l_discount::DOUBLE) FILTER (l_returnflag = 'A') AS a, avg(l_discount::DOUBLE) FILTER (l_returnflag = 'N') AS b FROM lineitem GROUP BY 1)
SELECT count(*)::BIGINT AS pairs, round(avg(b - a), 9) AS effect FROM u WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_effect(spark, sf_dir):
    rows = score_rows(spark, sf_dir).withColumnRenamed("episode_id", "unit_id")
    return derived.paired_effect(rows).withColumn("effect", F.round("effect", 9))


@query("""WITH q AS (SELECT source AS category, count(*)::BIGINT AS have FROM documents GROUP BY 1), w AS (SELECT 'src' || i AS category, CASE i WHEN 3 THEN 0 ELSE 50 END::BIGINT AS want FROM range(0, 23) t(i)) SELECT category, coalesce(want, 0) AS want, coalesce(have, 0) AS have FROM q FULL JOIN w USING (category) WHERE coalesce(want, 0) <> coalesce(have, 0)""")
def quota_shortfalls(spark, sf_dir):
    from ..functions import contracts

    cases = load(spark, sf_dir, "documents").select(F.col("source").alias("category"))
    return contracts.quota_shortfalls(cases, {f"src{i}": 0 if i == 3 else 50 for i in range(23)})


from . import artifacts, cases, corpora, forests, inference, manifests, protocol, streams  # noqa: E402, F401  (the others add to the queries of protocol)

QUERIES |= protocol.QUERIES
SQL |= protocol.SQL
