"""Queries of judge cases and cache keys, support exposure and lifecycle work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases
from ..sources.tables import ATTEMPTS_SQL, attempts, load
from .protocol import query

SEED = "judge-cases-v1"

# Parts as episodes: the reference answer is the type and brand, or the type alone.
EPISODES = "SELECT concat('e', p_partkey) AS episode_id, concat('q', p_partkey) AS query_id, CASE WHEN p_size % 7 = 0 THEN 'other' WHEN p_size % 2 = 0 THEN 'knowledge-update' ELSE 'temporal-reasoning' END AS question_type, CASE WHEN p_partkey % 41 = 0 THEN ' ' ELSE p_name END AS question, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE concat(p_type, ', ', p_brand) END AS reference_answer FROM part"
CASES_SQL = f"""e AS ({EPISODES}), c AS (SELECT *, unnest({list(cases.EXPECTED)}) AS case_category FROM e),
p AS (SELECT *, CASE WHEN position(',' IN reference_answer) > 0 THEN trim(split_part(reference_answer, ',', 1)) WHEN position(' ' IN reference_answer) > 0 THEN split_part(reference_answer, ' ', 1) END AS part FROM c),
a AS (SELECT *, CASE case_category WHEN 'formatting_variation' THEN 'Final answer:' || chr(10) || reference_answer WHEN 'clearly_wrong' THEN '{cases.WRONG}' WHEN 'abstention_like' THEN '{cases.ABSTAINS}' WHEN 'partial' THEN part ELSE reference_answer END AS answer,
  CASE WHEN trim(question) = '' THEN 'missing_field' WHEN question_type = 'other' THEN 'unsupported_task' WHEN case_category = 'partial' AND part IS NULL THEN 'no_partial_answer' END AS problem FROM p),
made AS (SELECT episode_id, query_id, question_type, case_category, CASE WHEN problem IS NULL THEN 'jrq-' || substr(sha256('{{"candidate_answer":"' || replace(answer, chr(10), '\\n') || '","case_category":"' || case_category || '","episode_id":"' || episode_id || '","manifest_id":"{SEED}"}}'), 1, 20) END AS case_id,
  CASE WHEN problem IS NULL THEN answer END AS candidate_answer, CASE WHEN problem IS NULL THEN CASE WHEN case_category IN ('clearly_wrong', 'partial', 'abstention_like') THEN 0 ELSE 1 END END AS expected_label, problem, reference_answer FROM a)"""


def _cases(spark, sf_dir):
    load(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(EPISODES)


@query(f"WITH {CASES_SQL} SELECT episode_id, query_id, question_type, case_category, case_id, candidate_answer, expected_label, problem FROM made")
def judge_cases(spark, sf_dir):
    return cases.judge_cases(_cases(spark, sf_dir), SEED)


@query(f"""WITH {CASES_SQL} SELECT case_id, sha256('{{"candidate_answer_hash":"' || sha256(candidate_answer) || '","decoding_config_hash":"d","judge_model":"j","judge_prompt_hash":"p","output_schema_version":"1","question_id":"' || query_id || '","reference_answer_hash":"' || sha256(reference_answer) || '"}}') AS cache_key
FROM made WHERE problem IS NULL""")
def judge_cache_keys(spark, sf_dir):
    episodes = _cases(spark, sf_dir)
    made = cases.judge_cases(episodes, SEED).where("problem IS NULL").join(episodes.select("episode_id", "reference_answer"), "episode_id")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    key = cases.judge_cache_key(question_id=F.col("query_id"), reference_answer_hash=digest("reference_answer"), candidate_answer_hash=digest("candidate_answer"), judge_prompt_hash=F.lit("p"), judge_model=F.lit("j"), decoding_config_hash=F.lit("d"), output_schema_version=F.lit("1"))
    return made.select("case_id", key.alias("cache_key"))


# Lines of an order annotate two leaves each; every ninth is unresolved, and the values of some orders differ by line.
ANNOTATIONS = {
    "run_id": "l_orderkey", "status": "CASE WHEN l_partkey % 9 = 0 THEN 'unresolved' WHEN l_partkey % 9 = 1 THEN 'expanded_to_chunks' WHEN l_partkey % 200 = 3 THEN 'guessed' ELSE 'exact' END",
    "leaf_ids": "CASE WHEN l_partkey % 9 = 0 AND l_orderkey % 10 <> 1 THEN LIST() ELSE LIST(concat('leaf_', l_linenumber), concat('leaf_', l_linenumber + 1)) END",
    "rewrite_depth": "l_orderkey % 6 + CASE WHEN l_orderkey % 10 = 2 THEN l_linenumber ELSE 0 END", "pressure": "(l_orderkey % 8) / 4.0", "role": "CASE WHEN l_orderkey % 10 = 3 THEN NULL WHEN l_orderkey % 2 = 0 THEN 'E' ELSE 'L' END",
}


@query(f"""WITH a AS (SELECT {', '.join(f'{x} AS {n}' for n, x in ANNOTATIONS.items()).replace('LIST()', '[]::VARCHAR[]').replace('LIST(', 'list_value(').replace('4.0', '4.0::DOUBLE')} FROM lineitem),
c AS (SELECT *, CASE WHEN status = 'guessed' THEN 'status_unknown' WHEN status = 'unresolved' AND len(leaf_ids) > 0 THEN 'unresolved_with_leaves' WHEN status <> 'unresolved' AND role IS NULL THEN 'value_missing' END AS code FROM a),
o AS (SELECT run_id, count(*) AS n, count(*) FILTER (status = 'unresolved') AS unresolved, list(DISTINCT code) FILTER (code IS NOT NULL) AS codes FROM c GROUP BY run_id),
l AS (SELECT run_id, unnest(leaf_ids) AS leaf, rewrite_depth, pressure, role FROM c WHERE code IS NULL AND status <> 'unresolved'),
v AS (SELECT run_id, leaf, min(rewrite_depth) AS r, min(pressure) AS p, min(role) AS role, min(rewrite_depth) <> max(rewrite_depth) AS differs FROM l GROUP BY ALL),
h AS (SELECT run_id, role, count(*) AS n FROM v GROUP BY ALL), g AS (SELECT run_id, string_agg(role || ':' || n, ',' ORDER BY role) AS roles FROM h GROUP BY run_id),
s AS (SELECT run_id, count(*)::BIGINT AS leaves, avg(r) AS rewrite_mean, max(r) AS rewrite_max, avg(p) AS pressure_mean, max(p) AS pressure_max, bool_or(differs) AS differs FROM v GROUP BY run_id)
SELECT o.run_id, coalesce(leaves, 0) AS leaves, unresolved::BIGINT AS unresolved, round(unresolved / n::DOUBLE, 9) AS unresolved_share, round(rewrite_mean, 9) AS rewrite_mean, rewrite_max::BIGINT AS rewrite_max, round(pressure_mean, 9) AS pressure_mean, pressure_max, coalesce(roles, '') AS roles,
  array_to_string(list_sort(list_concat(coalesce(codes, []), CASE WHEN differs THEN ['leaf_inconsistent'] ELSE [] END)), ',') AS problems FROM o LEFT JOIN s USING (run_id) LEFT JOIN g USING (run_id)""")
def support_exposure(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(*[F.expr(x.replace("LIST()", "cast(array() AS array<string>)").replace("LIST(", "array(").replace("4.0", "4.0D")).alias(n) for n, x in ANNOTATIONS.items()])
    out = cases.support_exposure(rows.withColumn("rewrite_depth", F.col("rewrite_depth").cast("bigint")), "run_id")
    return out.withColumns({c: F.round(c, 9) for c in ("unresolved_share", "rewrite_mean", "pressure_mean")})


_WORK = ", ".join(f"CASE WHEN count(*) FILTER (stage = '{s}' AND {c} IS NULL) = 0 THEN coalesce(sum({c}) FILTER (stage = '{s}'), 0)::BIGINT END AS {s}_{n}" for s in ("merge", "answer") for n, c in (("input", "input_tokens"), ("cached", "cached_tokens"), ("output", "output_tokens")))


@query(f"WITH {ATTEMPTS_SQL}, w AS (SELECT run_id, {_WORK} FROM attempts WHERE outcome = 'accepted' AND stage IN ('merge', 'answer') GROUP BY run_id) SELECT *, merge_input - merge_cached AS merge_uncached, answer_input - answer_cached AS answer_uncached FROM w")
def lifecycle_work(spark, sf_dir):
    return cases.lifecycle_work(attempts(spark, sf_dir), "run_id")
