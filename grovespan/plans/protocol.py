"""Queries of record contracts, matching joins and small functions, over rows that break them too.

The bundled tables have no such records, so each query makes them from a table's
rows with expressions that Spark and the oracle read alike; what a query decides
about them is written twice, as columns here and as plain SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contracts, text
from ..operators import derived, graph, joins, partition, stats, worklog
from ..sources import tables
from ..sources.shared import shared_folder
from ..sources.tables import EVIDENCE_SQL, evidence, load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _select(columns: dict[str, str], table: str, where: str = "") -> str:
    """A SELECT that both engines read; ``LIST(`` is an array."""
    return "SELECT " + ", ".join(f'{x} AS "{n}"' for n, x in columns.items()) + f" FROM {table}{where}"


def _rows(spark, sf_dir, columns: dict[str, str], table: str) -> DataFrame:
    return load(spark, sf_dir, table).select(*[F.expr(x.replace("LIST(", "array(")).alias(n) for n, x in columns.items()])


def _codes(checks: dict[str, str]) -> str:
    """SQL of the names of checks that do not hold (null does not), in order."""
    cases = ", ".join(f"CASE WHEN NOT coalesce({x}, false) THEN '{n}' END" for n, x in checks.items())
    return f"array_to_string(list_filter([{cases}], lambda c: c IS NOT NULL), ',')"


def _contract(name: str, table: str, key: str, columns: dict[str, str], checks, sql: dict[str, str]) -> None:
    """A query of the rows that break ``checks()``, with the SQL of the same rules."""
    source = _select(columns, table).replace("LIST(", "list_value(")

    def run(spark, sf_dir):
        return worklog.problems(_rows(spark, sf_dir, columns, table), [key], **checks()).select(key, F.array_join("codes", ",").alias("codes"))

    run.__name__ = name
    query(f"WITH r AS ({source}), c AS (SELECT {key}, {_codes(sql)} AS codes FROM r) SELECT {key}, codes FROM c WHERE codes <> ''")(run)


def _odd(n: int, bad: str, good: str) -> str:
    return f"CASE WHEN o_orderkey % {n} = 0 THEN {bad} ELSE {good} END"


_FILLED = "length(trim({0})) > 0"
_PINNED = "length(trim({0})) > 0 AND {0} NOT IN ('latest', 'default') AND NOT ends_with({0}, '-latest')"


def _filled(*names: str) -> dict[str, str]:
    return {f"{n}_filled": _FILLED.format(n) for n in names}


# Contracts

_contract(
    "contract_episode", "orders", "episode_id",
    {"dataset_id": _odd(7, "' '", "'d'"), "dataset_version_or_commit": "'v1'", "episode_id": "CAST(o_orderkey AS STRING)", "construction_unit_id": _odd(11, "NULL", "'u'"), "family_id": "CAST(o_custkey AS STRING)",
     "split": _odd(5, "'test'", "'calibration'"), "ordered_evidence_ids": _odd(13, "LIST('a', 'a')", "LIST('a', 'b')"), "query_ids": _odd(17, "LIST('q', 'q')", "LIST('q')"), "provenance": _odd(19, "NULL", "'h'")},
    contracts.episode,
    _filled("dataset_id", "dataset_version_or_commit", "episode_id", "construction_unit_id", "family_id", "split") | {
        "evidence_ids": "len(ordered_evidence_ids) > 0 AND len(ordered_evidence_ids) = len(list_distinct(ordered_evidence_ids))", "query_ids": "len(query_ids) > 0 AND len(query_ids) = len(list_distinct(query_ids))",
        "split_known": "split IN ('development', 'calibration', 'acceptance')", "provenance": "provenance IS NOT NULL"},
)

_contract(
    "contract_capacity", "orders", "row_id",
    {"row_id": "CAST(o_orderkey AS BIGINT)", "B_merge": "CAST(o_orderkey % 5 AS INT)", "B_final": "CAST(o_custkey % 2 + o_orderkey % 5 AS INT)", "B_query": "CAST(o_orderkey % 5 AS INT)"},
    contracts.capacity, {"equal": "B_merge = B_final AND B_final = B_query", "positive": "B_merge > 0 AND B_final > 0 AND B_query > 0"},
)

_contract(
    "contract_design", "orders", "row_id",
    {"row_id": "CAST(o_orderkey AS BIGINT)", "r_pilot": "CAST(3 + o_orderkey % 2 AS INT)", "r_formal": "CAST(5 AS INT)", "periodic_rebuild_enabled": "o_orderkey % 3 = 0", "periodic_rebuild_interval": _odd(2, "CAST(o_custkey % 4 AS INT)", "NULL"),
     "delta_decision": "CAST(CASE o_orderkey % 7 WHEN 0 THEN 0.05 WHEN 1 THEN 0.075 WHEN 2 THEN 0.1 WHEN 3 THEN 0.125 WHEN 4 THEN 0.15 WHEN 5 THEN 0.025 ELSE 0.12 END AS DOUBLE)", "topology_results_seen": "o_custkey % 4 = 0",
     "power": "CAST(o_custkey % 10 AS DOUBLE) / 10", "strata": _odd(9, "LIST()", "LIST(1)").replace("LIST()", "NULL"), "analysis_n": "o_orderkey % 100", "independent_episodes": "o_orderkey % 100 + CASE WHEN o_custkey % 6 = 0 THEN 1 ELSE 0 END", "uses_fraction_times_n": _odd(8, "true", "NULL")},
    lambda: contracts.replicates() | contracts.rebuild_interval() | contracts.delta_decision() | {f"n_{k}": v for k, v in contracts.power_inputs().items()},
    {"registered": "r_pilot = 3 AND r_formal = 5", "interval": "CASE WHEN periodic_rebuild_enabled THEN periodic_rebuild_interval > 0 ELSE periodic_rebuild_interval IS NULL END", "on_grid": "delta_decision IN (0.05::DOUBLE, 0.075::DOUBLE, 0.1::DOUBLE, 0.125::DOUBLE, 0.15::DOUBLE)", "least": "delta_decision >= 0.05::DOUBLE",
     "frozen_before_results": "NOT topology_results_seen", "power": "power >= 0.8::DOUBLE", "n_no_fraction_of_n": "NOT coalesce(uses_fraction_times_n, false)", "n_strata": "len(strata) > 0", "n_n_is_independent": "analysis_n = independent_episodes"},
)

_contract(
    "contract_backbone", "orders", "backbone_id",
    {"backbone_id": "CAST(o_orderkey AS STRING)", "role": _odd(6, "'spare'", "'primary'"), "model_family": _odd(10, "''", "'m'"), "provider": "'p'", "endpoint": "'e'", "decoding_config_hash": "'h'",
     "constructor_model_snapshot": _odd(3, "'m-latest'", "'m-2024'"), "merge_model_snapshot": _odd(4, "'latest'", "'m-2024'"), "answer_model_snapshot": _odd(5, "'  '", "'m-2024'")},
    contracts.backbone,
    _filled("backbone_id", "role", "model_family", "provider", "endpoint", "decoding_config_hash") | {"role_known": "role IN ('primary', 'replication')"} | {f"{n}_pinned": _PINNED.format(n) for n in ("constructor_model_snapshot", "merge_model_snapshot", "answer_model_snapshot")},
)

_contract(
    "contract_retrieval", "orders", "retrieval_config_id",
    {"retrieval_config_id": "CAST(o_orderkey AS STRING)", "tokenizer_snapshot": "'t'", "retrieval_unit_version": "'r'", "packing_policy": _odd(7, "' '", "'greedy'"), "tie_break": "'x'", "index_version": "'i'", "sha256": "'s'",
     "embedding_model_snapshot": _odd(3, "'bge'", "'bge@1'"), "similarity_metric": _odd(4, "'dot'", "'cosine_normalized'"), "candidate_top_k": _odd(5, "'20'", "'all'"), "render_order": _odd(6, "'rank'", "'chronological'")},
    contracts.retrieval,
    _filled("retrieval_config_id", "tokenizer_snapshot", "retrieval_unit_version", "packing_policy", "tie_break", "index_version", "sha256") | {
        "embedding_pinned": _PINNED.format("embedding_model_snapshot") + " AND contains(embedding_model_snapshot, '@')", "cosine": "similarity_metric = 'cosine_normalized'", "all_candidates": "candidate_top_k = 'all'", "chronological": "render_order = 'chronological'"},
)

_NODE_NAMES = ("materialized_node_id", "logical_node_id", "run_id", "content_hash", "artifact_kind", "tokenizer_snapshot", "serialization_version", "operator_config_id", "creation_event_type", "creation_event_id", "schema_version", "validation_status", "artifact_status")
_contract(
    "contract_artifact", "orders", "materialized_node_id",
    {n: "'x'" for n in _NODE_NAMES} | {"materialized_node_id": "CAST(o_orderkey AS STRING)", "run_id": _odd(12, "''", "'r'"), "content_artifact_id": "CASE o_orderkey % 6 WHEN 0 THEN '/abs/x' WHEN 1 THEN 'file://x' WHEN 2 THEN 'C:/x' ELSE 'ok' END", "local_surrogate_content_tokens": "CAST(o_custkey % 50 AS INT) - 1",
     "capacity_tokens": "CAST(o_orderkey % 40 AS INT)", "materialization_source": "CASE o_orderkey % 4 WHEN 0 THEN 'generated' WHEN 1 THEN 'cache' WHEN 2 THEN 'deterministic' ELSE 'other' END", "model_snapshot": "'m'", "prompt_hash": _odd(8, "NULL", "'p'"), "response_hash": "'r'", "deterministic_operator_hash": _odd(5, "''", "'d'")},
    contracts.node_artifact,
    _filled(*_NODE_NAMES) | {
        "stable_reference": "length(trim(content_artifact_id)) > 0 AND NOT (content_artifact_id LIKE '/%' OR content_artifact_id LIKE 'file://%' OR regexp_matches(content_artifact_id, '^[A-Za-z]:[/\\\\]'))", "tokens": "local_surrogate_content_tokens >= 0",
        "capacity": "capacity_tokens > 0 AND local_surrogate_content_tokens <= capacity_tokens", "source_known": "materialization_source IN ('generated', 'cache', 'deterministic')",
        "source_fields": "CASE materialization_source WHEN 'generated' THEN length(trim(model_snapshot)) > 0 AND length(trim(prompt_hash)) > 0 AND length(trim(response_hash)) > 0 WHEN 'deterministic' THEN length(trim(deterministic_operator_hash)) > 0 ELSE true END"},
)

_contract(
    "contract_plan_node", "orders", "node",
    {"node": "CAST(o_orderkey AS STRING)", "kind": "CASE o_orderkey % 5 WHEN 0 THEN 'leaf' WHEN 1 THEN 'other' ELSE 'internal' END", "left": _odd(3, "NULL", "'a'"), "right": "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'a' ELSE 'b' END", "lo": "CAST(o_custkey % 4 AS INT) - 1", "hi": "CAST(o_orderkey % 4 AS INT)"},
    contracts.plan_node,
    {"kind_known": "kind IN ('leaf', 'internal')", "leaf_without_children": """kind <> 'leaf' OR ("left" IS NULL AND "right" IS NULL)""", "two_children": """kind <> 'internal' OR ("left" IS NOT NULL AND "right" IS NOT NULL AND "left" <> "right")""", "span": "lo >= 0 AND lo <= hi"},
)

_A = {
    "attempt_id": "CAST(event_id AS STRING)", "run_id": "CAST(user_id AS STRING)", "logical_call_id": "CASE WHEN event_id % 23 = 0 THEN ' ' ELSE 'c' END", "requested_model": "'m'", "provider": "'p'", "provider_route": "'r'", "prompt_hash": "'h'", "tokenizer_snapshot": "'t'", "serialization_version": "'s'",
    "usage_schema_version": "'u'", "parse_status": "'ok'", "status": "'done'", "response_hash": "CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'x' END", "stage": "CASE event_id % 5 WHEN 0 THEN 'leaf' WHEN 1 THEN 'merge' WHEN 2 THEN 'answer' WHEN 3 THEN 'judge' ELSE 'other' END",
    "attempt_outcome": "CASE event_id % 8 WHEN 0 THEN 'accepted_materialized' WHEN 1 THEN 'successful_nonmaterialized' WHEN 2 THEN 'failed_provider' WHEN 3 THEN 'failed_parse' WHEN 4 THEN 'failed_validation' WHEN 5 THEN 'cancelled_before_start' WHEN 6 THEN 'cancelled_after_start' ELSE 'lost' END",
    "returned_model": "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'None' ELSE 'm-1' END", "request_id": "CASE event_id % 7 WHEN 0 THEN ' unknown ' WHEN 1 THEN NULL ELSE 'q' END", "accepted_attempt": "event_id % 8 = 0 OR event_id % 31 = 0", "retry_index": "CAST(event_id % 10 AS INT) - 1",
    "local_surrogate_serialized_input_tokens": "CAST(10 AS INT)", "local_surrogate_output_content_tokens": "CAST(event_id % 12 AS INT) - 1", "provider_usage_source": "CASE event_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'guess' WHEN 2 THEN 'provider_estimated' ELSE 'provider_exact' END",
    "provider_input_tokens_total": "CASE WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN NULL ELSE CAST(user_id % 40 AS INT) END", "provider_cached_input_tokens_subset": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id % 50 AS INT) - 20 END", "provider_output_tokens_total": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id % 20 AS INT) END",
    "provider_reasoning_tokens_subset": "CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(event_id % 30 AS INT) - 5 END", "scheduled_at": "CAST(event_id % 100 AS INT)", "started_at": "CASE WHEN event_id % 16 = 5 THEN NULL ELSE CAST(event_id % 101 AS INT) END", "finished_at": "CASE WHEN event_id % 16 = 5 THEN NULL ELSE CAST(event_id % 103 AS INT) END", "http_status": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 700 AS INT) END",
}
_IDENTITY = "CASE WHEN {0} IS NULL THEN attempt_outcome NOT IN ('accepted_materialized', 'successful_nonmaterialized', 'failed_parse') ELSE lower(trim({0})) NOT IN ('', 'none', 'unknown') END"
_contract(
    "contract_attempt", "events", "attempt_id", _A, contracts.attempt,
    _filled("attempt_id", "run_id", "logical_call_id", "requested_model", "provider", "provider_route", "prompt_hash", "tokenizer_snapshot", "serialization_version", "usage_schema_version", "parse_status", "status") | {
        "response_hash": "response_hash IS NULL OR length(trim(response_hash)) > 0", "stage_known": "stage IN ('leaf', 'merge', 'answer', 'judge')", "outcome_known": "attempt_outcome <> 'lost'", "returned_model": _IDENTITY.format("returned_model"), "request_id": _IDENTITY.format("request_id"),
        "retry_index": "retry_index >= 0", "surrogate_tokens": "local_surrogate_serialized_input_tokens >= 0 AND local_surrogate_output_content_tokens >= 0", "usage_source_known": "provider_usage_source IN ('provider_exact', 'provider_estimated', 'missing')",
        "missing_usage_is_null": "provider_usage_source <> 'missing' OR coalesce(provider_input_tokens_total, provider_cached_input_tokens_subset, provider_output_tokens_total, provider_reasoning_tokens_subset) IS NULL",
        "usage_given": "provider_usage_source = 'missing' OR (provider_input_tokens_total >= 0 AND provider_cached_input_tokens_subset >= 0 AND provider_output_tokens_total >= 0 AND coalesce(provider_reasoning_tokens_subset >= 0, true))",
        "cached_in_input": "provider_usage_source = 'missing' OR provider_cached_input_tokens_subset <= provider_input_tokens_total", "reasoning_in_output": "provider_usage_source = 'missing' OR provider_reasoning_tokens_subset IS NULL OR provider_reasoning_tokens_subset <= provider_output_tokens_total",
        "accepted_flag": "accepted_attempt = (attempt_outcome = 'accepted_materialized')", "times": "CASE WHEN attempt_outcome = 'cancelled_before_start' THEN started_at IS NULL AND finished_at IS NULL ELSE scheduled_at <= started_at AND started_at <= finished_at END", "http_status": "http_status IS NULL OR http_status BETWEEN 100 AND 599"},
)

_contract(
    "contract_execution", "orders", "row_id",
    {"row_id": "CAST(o_orderkey AS BIGINT)", "cache_mode": _odd(3, "'warm'", "'cold'"), "started_at": "CAST(o_custkey % 9 AS INT)", "finished_at": "CAST(o_orderkey % 9 AS INT)", "status": "CASE o_orderkey % 5 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'lost' ELSE 'recorded' END", "first_started_at": _odd(2, "NULL", "CAST(o_custkey % 7 AS INT)"), "last_finished_at": _odd(4, "NULL", "CAST(o_orderkey % 7 AS INT)"),
     "profile": _odd(7, "'both'", "'online'"), "state_tokens": "CAST(o_custkey % 12 AS INT) - 1", "primary_plans": _odd(6, "LIST('canonical_balanced', 'left_deep')", "LIST('left_deep', 'canonical_balanced')"), "diagnostic_plans": _odd(10, "LIST('left_deep')", "LIST('left_deep', 'canonical_balanced', 'right_deep')")},
    lambda: contracts.executor_config() | {f"stage_{k}": v for k, v in contracts.stage_boundary().items()} | contracts.deployment_state() | contracts.plan_sets(),
    {"cold": "cache_mode = 'cold'", "ordered": "finished_at >= started_at", "stage_status_known": "status IN ('recorded', 'unavailable')", "stage_ordered": "status <> 'recorded' OR first_started_at <= last_finished_at", "stage_no_times": "status <> 'unavailable' OR (first_started_at IS NULL AND last_finished_at IS NULL)",
     "profile_known": "profile IN ('offline', 'online')", "tokens": "state_tokens >= 0", "primary": "primary_plans = ['left_deep', 'canonical_balanced']", "diagnostic": "diagnostic_plans = ['left_deep', 'canonical_balanced', 'right_deep']"},
)

_contract(
    "contract_configs", "orders", "row_id",
    {"row_id": "CAST(o_orderkey AS BIGINT)", "tokenizer_id": _odd(4, "'latest'", "'t'"), "tokenizer_revision": _odd(6, "'t-latest'", "'r1'"), "serialization_version": _odd(8, "' '", "'s'"), "estimator": _odd(5, "'other'", "'surrogate_regex_bytes_v1'"), "safety_margin": "CAST(o_custkey % 5 AS INT) - 1",
     "temperature": "CAST(o_orderkey % 2 AS INT)", "output_format": _odd(3, "'text'", "'json_label'"), "judge_model_snapshot": _odd(7, "'j-latest'", "'j-1'"), "routes": _odd(9, "LIST('proxy', 'direct')", "LIST('direct', 'proxy')"), "direct_ok": "o_custkey % 3 = 0", "proxy_ok": "o_custkey % 5 = 0"},
    lambda: contracts.tokenizer_spec() | contracts.judge_config() | contracts.endpoint_probe(),
    {f"{n}_pinned": _PINNED.format(n) for n in ("tokenizer_id", "tokenizer_revision", "serialization_version", "estimator")} | {"margin": "safety_margin >= 0", "estimator_known": "estimator = 'surrogate_regex_bytes_v1'", "temperature": "temperature = 0", "json_label": "output_format = 'json_label'", "model_pinned": _PINNED.format("judge_model_snapshot"), "direct_first": "routes[1] = 'direct'", "reached": "direct_ok OR proxy_ok"},
)


@query("SELECT c_mktsegment AS model_family FROM (SELECT c_mktsegment, CASE WHEN c_nationkey % 25 < 13 THEN 'primary' ELSE 'replication' END AS role FROM customer) GROUP BY c_mktsegment HAVING count(DISTINCT role) > 1")
def backbone_families(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("model_family"), F.when(F.col("c_nationkey") % 25 < 13, "primary").otherwise("replication").alias("role"))
    return contracts.same_family(c)


@query("SELECT user_id AS run_id, count(*)::BIGINT AS n, count(DISTINCT CASE WHEN event_type <> 'error' THEN event_type END)::BIGINT AS known FROM (SELECT user_id, CASE event_id % 6 WHEN 0 THEN 'error' ELSE (['leaf', 'merge', 'answer', 'judge'])[event_id % 4 + 1] END AS event_type FROM events) GROUP BY 1 HAVING NOT (count(*) = 4 AND count(DISTINCT CASE WHEN event_type <> 'error' THEN event_type END) = 4)")
def stage_sets(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.expr("CASE event_id % 6 WHEN 0 THEN 'error' ELSE element_at(array('leaf', 'merge', 'answer', 'judge'), CAST(event_id % 4 + 1 AS INT)) END").alias("stage"))
    return contracts.four_stages(e)


# Label boundary

@query("SELECT d.doc_id, d.lang, l.quality AS answer FROM documents d JOIN labels l USING (doc_id)")
def stage_views(spark, sf_dir):
    """The answer view, made from tables that also carry labels; the schema check lets none through."""
    memory = contracts.construction_view(load(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("x").alias("gold_answer"), F.lit("q").alias("query_text")))
    queries_ = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("answer"), F.lit("s").alias("supporting_session_ids"))
    return contracts.answer_view(memory, queries_, "doc_id")


# Exclusions and counts

_FLAGS = {"episode_id": "CAST(o_orderkey AS BIGINT)", "abstention": "o_orderkey % 11 = 0", "fewer_than_four": "o_orderkey % 7 = 0", "unrecoverable_query": "o_orderkey % 5 = 0", "exact_duplicate": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 9 = 0 END", "ambiguous_support": "o_custkey % 8 = 0", "support_not_in_haystack": "o_custkey % 7 = 0", "invalid_answer_ids": "o_custkey % 6 = 0", "parallel_mismatch": "o_custkey % 5 = 0", "invalid_ids": "o_custkey % 4 = 0"}


@query(f"WITH r AS ({_select(_FLAGS, 'orders')}) SELECT episode_id, CASE {' '.join(f'WHEN {n} THEN {chr(39)}{n}{chr(39)}' for n in list(_FLAGS)[1:])} END AS reason FROM r")
def exclusion_reasons(spark, sf_dir):
    return graph.exclusion_reason(_rows(spark, sf_dir, _FLAGS, "orders")).select("episode_id", "reason")


@query("SELECT o_orderkey::BIGINT AS episode_id, CASE WHEN o_custkey % 6 = 0 THEN 'answer_evidence_not_in_episode' WHEN ends_with(qid, '_abs') OR ends_with(kind, '-abs') OR ends_with(kind, '_abs') THEN 'abstention' WHEN o_orderkey % 7 = 0 THEN 'missing_trajectory' WHEN o_custkey % 10 < 4 THEN 'fewer_than_four' WHEN o_orderkey % 3 = 0 THEN 'unrecoverable_query' END AS reason FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'q_abs' ELSE 'q' END AS qid, CASE o_custkey % 9 WHEN 0 THEN 'multi-abs' WHEN 1 THEN 'multi_abs' ELSE 'abs' END AS kind FROM orders)")
def trajectory_exclusions(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    qid = F.when(F.col("o_orderkey") % 5 == 0, "q_abs").otherwise("q")
    kind = F.when(F.col("o_custkey") % 9 == 0, "multi-abs").when(F.col("o_custkey") % 9 == 1, "multi_abs").otherwise("abs")
    rows = o.select(F.col("o_orderkey").cast("bigint").alias("episode_id"), text.is_abstention(qid, kind).alias("abstention"), (F.col("o_orderkey") % 7 == 0).alias("missing_trajectory"), (F.col("o_custkey") % 10 < 4).alias("fewer_than_four"), (F.col("o_orderkey") % 3 == 0).alias("unrecoverable_query"), (F.col("o_custkey") % 6 == 0).alias("answer_evidence_not_in_episode"))
    return graph.exclusion_reason_v2(rows).select("episode_id", "reason")


@query(f"""WITH {EVIDENCE_SQL}, n AS (SELECT episode_id, count(*)::BIGINT AS n FROM evidence GROUP BY 1) SELECT episode_id, n, n >= 4 AS eligible_k4, n >= 8 AS eligible_k8, n >= 16 AS eligible_k16 FROM n""")
def eligibility_masks(spark, sf_dir):
    return graph.eligibility(evidence(spark, sf_dir)).select("episode_id", "n", "eligible_k4", "eligible_k8", "eligible_k16")


@query("SELECT lang AS question_type, count(*)::BIGINT AS questions, count(*) FILTER (doc_id % 7 = 0)::BIGINT AS abstentions, count(*) FILTER (doc_id % 7 <> 0)::BIGINT AS eligible FROM documents GROUP BY lang")
def question_counts(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select(F.col("lang").alias("question_type"), F.when(F.col("doc_id") % 7 == 0, "q_abs").otherwise("q").alias("question_id"))
    return graph.question_counts(rows)


@query("SELECT l_suppkey AS context_id, sum(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE l_linenumber END)::BIGINT AS questions FROM lineitem GROUP BY 1")
def context_questions(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("context_id"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("question_count"))
    return graph.context_questions(rows)


@query("SELECT n_nationkey AS dataset, count(c_custkey)::BIGINT AS units, count(c_custkey) = 10 AS ten_units, CASE WHEN count(c_custkey) >= 50 THEN 'replicate' ELSE 'descriptive_only' END AS decision FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def replication_units(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("dataset"), "c_custkey")
    return graph.construction_units(rows, "dataset")


@query(f"""WITH {EVIDENCE_SQL}, n AS (SELECT episode_id, count(*) AS n FROM evidence GROUP BY 1 HAVING count(*) >= 4),
c AS (SELECT n.episode_id, s.position, s.position * 4 // n.n AS leaf, n.n FROM n, (SELECT unnest(range(0, 64)) AS position) s WHERE s.position < n.n AND (s.position + n.episode_id) % 3 = 0),
o AS (SELECT episode_id, avg(position) / greatest(1, max(n) - 1) AS center, count(DISTINCT leaf) AS leaves FROM c GROUP BY 1)
SELECT episode_id, CASE WHEN leaves = 1 THEN 'single' ELSE 'multiple' END AS support_class, CASE WHEN center < 1 / 3.0::DOUBLE THEN 'early' WHEN center < 2 / 3.0::DOUBLE THEN 'middle' ELSE 'late' END AS position_bin FROM o""")
def evidence_layouts(spark, sf_dir):
    e = evidence(spark, sf_dir)
    n = e.groupBy("episode_id").agg(F.count("*").alias("n")).where("n >= 4")
    quarters = n.select("episode_id", "n", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("leaf"))
    bound = lambda k: F.ceil(k * F.col("n") / 4).cast("int")
    spans = quarters.select("episode_id", "leaf", bound(F.col("leaf")).alias("start"), (bound(F.col("leaf") + 1) - 1).alias("end"))
    support = e.where((F.col("sequence_index") + F.col("episode_id")) % 3 == 0).select("episode_id", F.col("sequence_index").cast("int").alias("position"))
    placed = joins.leaves_of(support, spans).join(n, "episode_id")
    return graph.layout(placed.select("episode_id", "position", "leaf", "n"))


# Work logs: groups that must agree

@query("SELECT l_suppkey AS episode_id, l_linenumber AS leaf, count(DISTINCT l_returnflag || l_linestatus)::BIGINT AS kinds FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag || l_linestatus) > 1")
def leaf_cache_shared(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("episode_id"), F.col("l_linenumber").alias("leaf"), F.concat("l_returnflag", "l_linestatus").alias("leaf_sha256"))
    return joins.several_of(rows, ["episode_id", "leaf"], "leaf_sha256")


@query("WITH b AS (SELECT l_suppkey AS budget_id, min(l_partkey % 3) AS a, max(l_partkey % 3) AS z FROM lineitem GROUP BY 1) SELECT budget_id, 'differs' AS problem FROM b WHERE a <> z UNION ALL SELECT min(budget_id), 'never_changes' FROM b HAVING count(*) > 1 AND min(a) = max(a)")
def budget_sweep(spark, sf_dir):
    return joins.budget_sweep(load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("budget_id"), (F.col("l_partkey") % 3).alias("b")))


@query("SELECT l_orderkey AS run_id, count(DISTINCT l_returnflag || ':' || l_linestatus || ':' || l_shipmode)::BIGINT AS kinds FROM (SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber % 3 AS l_shipmode FROM lineitem) GROUP BY 1 HAVING count(DISTINCT l_returnflag || ':' || l_linestatus || ':' || l_shipmode) > 1")
def executor_tuples(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).alias("mode"))
    return joins.several_of(rows, ["run_id"], "l_returnflag", "l_linestatus", "mode")


@query("SELECT DISTINCT l_linenumber::BIGINT AS replicate_id FROM lineitem WHERE l_linenumber <> CASE WHEN l_orderkey % 5 = 0 AND l_linenumber > 3 THEN 0 ELSE l_linenumber END")
def seed_mismatches(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("replicate_id"), F.expr("CASE WHEN l_orderkey % 5 = 0 AND l_linenumber > 3 THEN 0 ELSE l_linenumber END").alias("s_merge"), F.col("l_linenumber").alias("s_answer"))
    return contracts.seed_mismatches(rows)


COHORTS = "SELECT o_orderkey::BIGINT AS episode_id, unnest(list_filter([4, 8, 12, 16], lambda k: (o_orderkey + k) % 13 <> 0)) AS k FROM orders"


@query(f"WITH c AS ({COHORTS}), b AS (SELECT episode_id FROM c WHERE k = 16) SELECT k, episode_id FROM c WHERE k <> 16 AND episode_id NOT IN (SELECT * FROM b) UNION ALL SELECT o.k, b.episode_id FROM b, (SELECT unnest([4, 8, 12]) AS k) o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.k = o.k AND c.episode_id = b.episode_id)")
def unequal_cohorts(spark, sf_dir):
    c = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("episode_id"), F.explode(F.filter(F.array(*[F.lit(k) for k in (4, 8, 12, 16)]), lambda k: (F.col("o_orderkey") + k) % 13 != 0)).alias("k"))
    return contracts.unequal_cohorts(c)


@query("SELECT 'sum' AS name, sum(token_count)::BIGINT AS tokens, count(*) FILTER (token_count < 0 OR token_count IS NULL)::BIGINT AS invalid FROM (SELECT CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 71 = 0 THEN -1 ELSE event_id % 100 END AS token_count FROM events)")
def token_sum(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.expr("CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 71 = 0 THEN -1 ELSE event_id % 100 END").alias("token_count"))
    return rows.agg(F.lit("sum").alias("name"), F.sum("token_count").alias("tokens"), F.count_if(F.col("token_count").isNull() | (F.col("token_count") < 0)).alias("invalid"))


SHARED = "SELECT event_id % 40 AS content_id, (event_id % 40) * 3 AS input_tokens, (event_id % 40) AS output_tokens FROM events"


@query(f"SELECT count(*)::BIGINT AS leaves, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM (SELECT DISTINCT * FROM ({SHARED}))")
def shared_leaf_work(spark, sf_dir):
    e = load(spark, sf_dir, "events").select((F.col("event_id") % 40).alias("content_id"), (F.col("event_id") % 40 * 3).alias("input_tokens"), (F.col("event_id") % 40).alias("output_tokens"))
    return worklog.shared_once(e).agg(F.count("*").alias("leaves"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query("SELECT p.l_suppkey AS component, d.declared, p.summed FROM (SELECT l_suppkey, sum(l_linenumber)::BIGINT AS summed FROM lineitem GROUP BY 1) p FULL JOIN (SELECT s_suppkey, (s_suppkey * 7)::BIGINT AS declared FROM supplier) d ON d.s_suppkey = p.l_suppkey WHERE d.declared IS DISTINCT FROM p.summed")
def workload_sums(spark, sf_dir):
    parts = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("component"), F.col("l_linenumber").cast("bigint").alias("calls"))
    declared = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("component"), (F.col("s_suppkey") * 7).cast("bigint").alias("calls"))
    return joins.sums_that_differ(parts, declared, ["component"], "calls")


@query("SELECT user_id AS run_id, CASE WHEN bool_and(event_type <> 'error') THEN 'passed' ELSE 'failed' END AS status FROM events GROUP BY 1")
def status_rollup(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.when(F.bool_and(F.col("event_type") != "error"), "passed").otherwise("failed").alias("status"))


@query("SELECT user_id AS file FROM events WHERE event_type IN ('error', 'view') AND event_id % 3 < 2 GROUP BY 1 HAVING count(DISTINCT event_id % 3) = 2")
def stalled_files(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.element_at(F.array(F.lit("direct"), F.lit("proxy"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int")).alias("route"), (~F.col("event_type").isin("error", "view")).alias("success"))
    return worklog.retrieval_stalled(e, ("direct", "proxy"))


@query("SELECT user_id AS run_id, CASE WHEN bool_or(event_id % 17 = 0) THEN 'quota' WHEN bool_or(event_id % 5 = 0) THEN 'network' ELSE 'unknown' END AS cause FROM events GROUP BY 1")
def stall_causes(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.expr("CASE WHEN event_id % 17 = 0 THEN 'HTTP 403 quota' WHEN event_id % 5 = 0 THEN 'Connection reset' WHEN event_id % 2 = 0 THEN 'x' END").alias("error"))
    return derived.stall_cause(e, [("quota", "quota|403"), ("network", "connection|timeout")], "run_id")


# Joins that must match

@query("""WITH q AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 9 <> 0), h AS (SELECT l_orderkey AS id, l_partkey AS t FROM lineitem WHERE l_orderkey % 4 <> 0), t AS (SELECT p_partkey AS t FROM part WHERE p_partkey % 50 <> 0)
SELECT id AS question_id, 'no_haystack' AS problem FROM q WHERE id NOT IN (SELECT id FROM h) UNION ALL SELECT DISTINCT id, 'unknown_question' FROM h WHERE id NOT IN (SELECT id FROM q) UNION ALL SELECT DISTINCT id, 'missing_trajectory' FROM h WHERE t NOT IN (SELECT t FROM t)""")
def corpus_keys(spark, sf_dir):
    q = load(spark, sf_dir, "orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("question_id"))
    h = load(spark, sf_dir, "lineitem").where("l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("question_id"), F.col("l_partkey").alias("trajectory_id"))
    t = load(spark, sf_dir, "part").where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("trajectory_id"))
    return joins.missing_trajectories(q, h, t)


@query("""WITH a AS (SELECT l_orderkey AS e, l_linenumber AS i, min(l_returnflag) AS x, min(l_linestatus) AS y FROM lineitem WHERE l_orderkey % 50 <> 7 GROUP BY ALL), b AS (SELECT l_orderkey AS e, l_linenumber AS i, min(CASE WHEN l_orderkey % 11 = 0 THEN 'Q' ELSE l_returnflag END) AS x, min(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linestatus END) AS y FROM lineitem WHERE l_orderkey % 60 <> 7 GROUP BY ALL),
j AS (SELECT coalesce(a.e, b.e) AS episode_id, coalesce(a.i, b.i) AS sequence_index, CASE WHEN a.e IS NULL THEN 'only_normal' WHEN b.e IS NULL THEN 'only_raw' ELSE concat_ws(',', CASE WHEN a.x IS DISTINCT FROM b.x THEN 'x' END, CASE WHEN a.y IS DISTINCT FROM b.y THEN 'y' END) END AS differs FROM a FULL JOIN b ON a.e = b.e AND a.i = b.i) SELECT * FROM j WHERE differs <> ''""")
def evidence_mismatches(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("sequence_index"), "l_returnflag", "l_linestatus")
    raw = li.where("episode_id % 50 <> 7").groupBy("episode_id", "sequence_index").agg(F.min("l_returnflag").alias("x"), F.min("l_linestatus").alias("y"))
    normal = li.where("episode_id % 60 <> 7").groupBy("episode_id", "sequence_index").agg(F.min(F.expr("CASE WHEN episode_id % 11 = 0 THEN 'Q' ELSE l_returnflag END")).alias("x"), F.min(F.expr("CASE WHEN sequence_index = 3 THEN NULL ELSE l_linestatus END")).alias("y"))
    return joins.evidence_mismatches(raw, normal, "x", "y")


@query("""SELECT l_orderkey AS episode_id, position, CASE WHEN position <= 2 THEN 0 WHEN position <= 4 THEN 1 END AS leaf FROM (SELECT DISTINCT l_orderkey, l_linenumber AS position FROM lineitem)""")
def session_leaves(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").cast("int").alias("position")).distinct()
    spans = s.select("episode_id").distinct().select("episode_id", F.explode(F.array(*[F.struct(F.lit(k).alias("leaf"), F.lit(a).alias("start"), F.lit(z).alias("end")) for k, a, z in ((0, 1, 2), (1, 3, 4))])).alias("s")).select("episode_id", "s.*")
    return joins.leaves_of(s, spans)


@query("SELECT p_partkey AS item_id, count(l_discount) FILTER (l_quantity < 20)::BIGINT AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 HAVING count(l_discount) FILTER (l_quantity < 20) <> 1")
def unscored_items(spark, sf_dir):
    items = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    return joins.unscored(items, load(spark, sf_dir, "lineitem").where("l_quantity < 20").select(F.col("l_partkey").alias("item_id"), F.col("l_discount").alias("score")), "item_id")


_BA = {"attempt_id": "event_id", "run_id": "user_id", "stage": "event_type", "logical_call_id": "event_id", "attempt_outcome": "CASE WHEN event_id % 4 = 0 THEN 'failed_parse' ELSE 'accepted_materialized' END", "accepted_attempt": "event_id % 4 <> 0 AND event_id % 37 <> 0"}
_BB = {"binding_id": "event_id", "run_id": "CASE WHEN event_id % 29 = 0 THEN user_id + 1 ELSE user_id END", "stage": "event_type", "logical_call_id": "CASE WHEN event_id % 19 = 0 THEN event_id - 1 ELSE event_id END", "accepted_attempt_id": "CASE event_id % 23 WHEN 0 THEN event_id + 100000000 WHEN 1 THEN event_id - 1 WHEN 2 THEN NULL ELSE event_id END", "output_artifact_id": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE event_id END", "binding_status": "CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'succeeded' END"}


@query(f"""WITH a AS ({_select(_BA, 'events')}), b AS ({_select(_BB, 'events', ' WHERE event_id % 41 <> 0')}), ok AS (SELECT * FROM b WHERE binding_status = 'succeeded')
SELECT binding_id::VARCHAR AS id, 'failed_binding_has_output' AS problem FROM b WHERE binding_status <> 'succeeded' AND (accepted_attempt_id IS NOT NULL OR output_artifact_id IS NOT NULL)
UNION ALL SELECT binding_id::VARCHAR, 'binding_without_output' FROM ok WHERE accepted_attempt_id IS NULL OR output_artifact_id IS NULL
UNION ALL SELECT binding_id::VARCHAR, 'unknown_attempt' FROM ok WHERE accepted_attempt_id IS NOT NULL AND accepted_attempt_id NOT IN (SELECT attempt_id FROM a)
UNION ALL SELECT binding_id::VARCHAR, 'identity_differs' FROM ok JOIN a ON attempt_id = accepted_attempt_id WHERE (ok.run_id, ok.stage, ok.logical_call_id) <> (a.run_id, a.stage, a.logical_call_id)
UNION ALL SELECT binding_id::VARCHAR, 'attempt_not_accepted' FROM ok JOIN a ON attempt_id = accepted_attempt_id WHERE attempt_outcome <> 'accepted_materialized' OR NOT accepted_attempt
UNION ALL SELECT attempt_id::VARCHAR, 'accepted_but_unbound' FROM a WHERE accepted_attempt AND attempt_id NOT IN (SELECT accepted_attempt_id FROM ok WHERE accepted_attempt_id IS NOT NULL)
UNION ALL SELECT accepted_attempt_id::VARCHAR, 'attempt_bound_twice' FROM ok WHERE accepted_attempt_id IS NOT NULL GROUP BY accepted_attempt_id HAVING count(*) > 1
UNION ALL SELECT min(binding_id)::VARCHAR, 'call_with_two_outputs' FROM ok GROUP BY run_id, stage, logical_call_id HAVING count(*) > 1""")
def binding_contract(spark, sf_dir):
    return joins.binding_problems(_rows(spark, sf_dir, _BA, "events"), _rows(spark, sf_dir, _BB, "events").where("binding_id % 41 <> 0"))


_EV = {"event_id": "event_id", "run_id": "user_id % 5", "logical_call_id": "event_id % 300", "source": "CASE WHEN event_id % 3 = 0 THEN 'cache' ELSE 'generated' END", "binding_id": "event_id + CASE WHEN event_id % 13 = 0 THEN 100000000 ELSE 0 END", "left_id": "event_id % 200", "right_id": "event_id % 210", "output_id": "event_id % 190", "cache_of": "event_id % 380"}
_AR = {"node": "event_id", "run_id": "event_id % 5", "content_hash": "event_id % 190", "tokens": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 190 END", "capacity": "event_id % 2", "tokenizer": "'t'", "version": "'v'"}
_FIELDS = ("content_hash", "tokens", "capacity", "tokenizer", "version")


@query(f"""WITH e AS ({_select(_EV, 'events')}), a AS ({_select(_AR, 'events', ' WHERE event_id % 17 <> 0')}), t AS (SELECT DISTINCT user_id % 5 AS run_id, event_id % 300 AS logical_call_id FROM events WHERE event_type = 'error'),
s AS (SELECT event_id, run_id, unnest([left_id, right_id, output_id]) AS node FROM e), p AS (SELECT s.*, a.run_id AS a_run FROM s LEFT JOIN a USING (node)), c AS (SELECT e.event_id, e.cache_of, o.* FROM e JOIN a o ON o.node = e.output_id WHERE source = 'cache')
SELECT event_id, 'binding_missing' AS problem FROM e WHERE source = 'generated' AND binding_id NOT IN (SELECT event_id FROM events)
UNION ALL SELECT DISTINCT event_id, 'artifact_missing' FROM p WHERE a_run IS NULL UNION ALL SELECT DISTINCT event_id, 'artifact_of_other_run' FROM p WHERE a_run <> run_id
UNION ALL SELECT event_id, 'cache_call_has_attempt' FROM e SEMI JOIN t USING (run_id, logical_call_id) WHERE source = 'cache'
UNION ALL SELECT event_id, 'cache_source_missing' FROM c WHERE cache_of NOT IN (SELECT node FROM a)
UNION ALL SELECT event_id, 'cache_lineage_differs' FROM c JOIN a b ON b.node = c.cache_of WHERE {' OR '.join(f'c.{f} IS DISTINCT FROM b.{f}' for f in _FIELDS)}""")
def event_contract(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    attempts = e.where("event_type = 'error'").select((F.col("user_id") % 5).alias("run_id"), (F.col("event_id") % 300).alias("logical_call_id"))
    return joins.event_problems(_rows(spark, sf_dir, _EV, "events"), e.select(F.col("event_id").alias("binding_id")), _rows(spark, sf_dir, _AR, "events").where("node % 17 <> 0"), attempts)


@query("WITH a AS (SELECT event_id AS node, CASE WHEN event_id % 4 = 0 THEN 'cache' ELSE 'generated' END AS source FROM events), b AS (SELECT event_id - event_id % 3 AS node FROM events), n AS (SELECT node, source, (SELECT count(*) FROM b WHERE b.node = a.node)::BIGINT AS bindings FROM a) SELECT * FROM n WHERE bindings <> CASE WHEN source = 'generated' THEN 1 ELSE 0 END")
def artifact_bindings(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return joins.artifact_binding_counts(e.select(F.col("event_id").alias("node"), F.when(F.col("event_id") % 4 == 0, "cache").otherwise("generated").alias("source")), e.select((F.col("event_id") - F.col("event_id") % 3).alias("output_artifact_id")))


_REPLY = """CASE event_id % 5 WHEN 0 THEN '{"label": 1}' WHEN 1 THEN '{"label": 0}' WHEN 2 THEN '{"label": "1"}' WHEN 3 THEN 'yes' ELSE '{"label": 1, "label": 1}' END"""


@query(f"""WITH r AS (SELECT user_id AS case_id, (event_id % 4)::INT AS replicate_id, {_REPLY} AS reply, CASE WHEN event_id % 6 = 0 THEN 'x' ELSE sha256({_REPLY}) END AS reply_hash, CASE WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 7 = 0 THEN 0 END AS label, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS replayed FROM events),
w AS (SELECT user_id AS case_id, unnest([0, 1, 2]) AS replicate_id FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 <> 0), n AS (SELECT case_id, replicate_id, count(*) AS n FROM r GROUP BY ALL)
SELECT case_id, replicate_id, 'reply_missing' AS problem FROM w ANTI JOIN n USING (case_id, replicate_id) UNION ALL SELECT case_id, replicate_id, 'reply_repeated' FROM n WHERE n > 1 UNION ALL SELECT case_id, replicate_id, 'reply_unknown' FROM n ANTI JOIN w USING (case_id, replicate_id)
UNION ALL SELECT case_id, replicate_id, 'hash_differs' FROM r WHERE sha256(reply) <> reply_hash UNION ALL SELECT case_id, replicate_id, 'label_differs' FROM r WHERE label IS DISTINCT FROM replayed""")
def judge_replay(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    reply = F.expr(_REPLY)
    rows = e.select(F.col("user_id").alias("case_id"), (F.col("event_id") % 4).cast("int").alias("replicate_id"), reply.alias("reply"), F.when(F.col("event_id") % 6 == 0, "x").otherwise(F.sha2(reply.cast("binary"), 256)).alias("reply_hash"), F.expr("CASE WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 7 = 0 THEN 0 END").alias("label"), text.judge_label(reply).alias("replayed"))
    return joins.replay_problems(e.where("user_id % 3 <> 0").select(F.col("user_id").alias("case_id")).distinct(), 3, rows)


@query("""WITH s AS (SELECT l_orderkey AS episode_id, CASE WHEN l_linenumber = 7 THEN 'acceptance' ELSE 'calibration' END AS split FROM lineitem WHERE l_linenumber IN (1, 7) AND l_orderkey % 5 <> 0), p AS (SELECT episode_id, count(*) AS n, min(split) AS split FROM s GROUP BY 1), e AS (SELECT o_orderkey AS episode_id FROM orders WHERE o_orderkey % 8 <> 0)
SELECT episode_id, 'assigned_twice' AS problem FROM p WHERE n > 1 UNION ALL SELECT episode_id, 'not_assigned' FROM e ANTI JOIN p USING (episode_id) UNION ALL SELECT episode_id, 'unknown_episode' FROM p ANTI JOIN e USING (episode_id) UNION ALL SELECT episode_id, 'chosen' FROM p SEMI JOIN e USING (episode_id) WHERE n = 1 AND split = 'calibration'""")
def split_membership(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem").where("l_linenumber in (1, 7) and l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("episode_id"), F.when(F.col("l_linenumber") == 7, "acceptance").otherwise("calibration").alias("split"))
    return joins.split_membership(s, load(spark, sf_dir, "orders").where("o_orderkey % 8 <> 0").select(F.col("o_orderkey").alias("episode_id")), "calibration")


@query("SELECT o_orderkey AS usage_id, c_mktsegment IN ('BUILDING', 'MACHINERY') AS in_scope FROM orders JOIN customer ON c_custkey = o_custkey")
def pricing_scope(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("usage_id"), F.col("c_mktsegment").alias("model"))
    prices = spark.createDataFrame([("BUILDING", 1.0), ("MACHINERY", 2.0)], "model string, input_rate double")
    return joins.priced_usage(rows, prices, "model").select("usage_id", "in_scope")


# Sets

@query("SELECT 'left' AS side, n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 5 <> 0) UNION ALL SELECT 'right', id FROM (SELECT s_suppkey + 1000000 AS id FROM supplier WHERE s_suppkey % 20 = 0)")
def key_differences(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    right = s.where("s_nationkey % 5 <> 0").select(F.col("s_nationkey").alias("id")).distinct().unionByName(s.where("s_suppkey % 20 = 0").select((F.col("s_suppkey") + 1000000).alias("id")))
    return graph.same_rows(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), right)


@query("SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY event_type, user_id")
def unique_attempts(spark, sf_dir):
    return worklog.unique_attempts(load(spark, sf_dir, "events").select("event_type", "user_id", "event_id"), ["event_type", "user_id"], ["event_id"])


@query("SELECT event_id AS call_id, event_type AS kind, NULL::DOUBLE AS seconds FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, NULL, abs(value) FROM events WHERE event_type <> 'error'")
def completed_calls(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.where("event_type = 'error'").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("kind")).unionByName(e.where("event_type <> 'error'").select(F.col("event_id").alias("call_id"), F.abs("value").alias("seconds")), allowMissingColumns=True)


@query("SELECT o_orderkey AS episode_id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20")
def first_episodes(spark, sf_dir):
    return load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("episode_id")).orderBy("episode_id").limit(20)


@query("SELECT min(o_orderkey) AS episode_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 6)")
def probe_episode(spark, sf_dir):
    rich = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n >= 6").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(rich, "o_orderkey", "left_semi").agg(F.min("o_orderkey").alias("episode_id"))


# Text

@query(r"SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s\p{Z}\x{85}\x{1c}-\x{1f}]'))::INT AS tokens FROM conversations")
def log_tokens(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", text.log_tokens(F.col("text")).cast("int").alias("tokens"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g')) AS question FROM conversations")
def normalized_questions(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalized_question("text").alias("question"))


_KEY = {"dataset_version_or_commit": "v1", "leaf_prompt_hash": "p", "constructor_model_snapshot": "m", "decoding_config_hash": "d", "backbone_id": "b"}


@query("""SELECT event_id, sha256('{"C_leaf":512,"backbone_id":"b","constructor_model_snapshot":"m","dataset_version_or_commit":"v1","decoding_config_hash":"d","episode_id":"' || user_id || '","evidence_span":[' || (event_id % 7) || ',' || (event_id % 7 + 3) || '],"k":8,"leaf_prompt_hash":"p","partition_hash":"h","s_leaf":' || (event_id % 3) || '}') AS cache_key FROM events""")
def leaf_cache_keys(spark, sf_dir):
    span = F.array(F.col("event_id") % 7, F.col("event_id") % 7 + 3)
    key = text.leaf_cache_key(**{k: F.lit(v) for k, v in _KEY.items()}, C_leaf=F.lit(512), episode_id=F.col("user_id").cast("string"), evidence_span=span, k=F.lit(8), partition_hash=F.lit("h"), s_leaf=F.col("event_id") % 3)
    return load(spark, sf_dir, "events").select("event_id", key.alias("cache_key"))


@query("SELECT conv_id, '[t' || conv_id || ']' || chr(10) || string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def session_texts(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))).alias("t"))
    return turns.select("conv_id", text.session_text(F.col("t"), F.concat(F.lit("t"), F.col("conv_id").cast("string"))).alias("body"))


_TRAJ = "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN [role, text] END AS m, CASE WHEN turn % 3 <> 2 THEN [role, text] END AS s, CASE WHEN conv_id % 2 = 0 THEN '' ELSE role END AS content, text AS goal FROM conversations"


@query(f"SELECT conv_id, turn, coalesce(CASE WHEN m IS NOT NULL THEN coalesce(m[1], '') || chr(10) || coalesce(m[2], '') WHEN s IS NOT NULL THEN concat_ws(chr(10), s[1], s[2]) ELSE coalesce(nullif(content, ''), nullif(goal, ''), '') END, '') AS body FROM ({_TRAJ})")
def trajectory_texts(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    one = lambda x: F.struct(x.alias("content"))
    messages = F.when(F.col("turn") % 3 == 0, F.array(one(F.col("role")), one(F.col("text"))))
    none = F.lit(None).cast("string")
    states = F.when(F.col("turn") % 3 != 2, F.array(F.struct(F.col("role").alias("thought"), none.alias("accessibility_tree"), F.col("text").alias("action"), none.alias("url"))))
    return c.select("conv_id", "turn", text.trajectory_text(messages, states, F.when(F.col("conv_id") % 2 == 0, "").otherwise(F.col("role")), F.col("text")).alias("body"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN '' ELSE 'c' END AS first FROM orders")
def answer_evidence_ids(spark, sf_dir):
    lists = [F.when(F.col("o_orderkey") % 4 == k, F.array(F.lit(x), F.lit("z"))) for k, x in ((0, "a"), (1, "b"), (3, "c"))]
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(F.get(text.answer_evidence(*lists), F.lit(0)), F.lit("")).alias("first"))


_PARTS = "CASE o_orderkey % 8 WHEN 0 THEN 'one, two' WHEN 1 THEN 'a; b' WHEN 2 THEN 'x and y' WHEN 3 THEN 'walk then run' WHEN 4 THEN 'First. Second' WHEN 5 THEN 'single' WHEN 6 THEN 'three plain words' ELSE ', leading and more' END"


@query(f"SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'one' WHEN 1 THEN 'a' WHEN 2 THEN 'x' WHEN 3 THEN 'walk' WHEN 4 THEN 'First' WHEN 5 THEN NULL WHEN 6 THEN 'three' ELSE ', leading' END AS part FROM orders")
def partial_answers(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.partial_answer(F.expr(_PARTS)).alias("part"))


@query("SELECT conv_id, turn, contains(lower(trim(text)), 'yes') AS says_yes, contains(lower(text), 'context_length') OR contains(lower(text), 'maximum context') OR contains(lower(text), 'context window') AS too_long, substr(replace(text, 'the', '[REDACTED]'), 1, 500) AS safe, CASE WHEN lower(trim(role)) NOT IN ('', 'none', 'unknown') THEN trim(role) END AS identity FROM conversations")
def reply_flags(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.judge_says_yes(F.col("text")).alias("says_yes"), text.context_too_long(F.col("text")).alias("too_long"), text.redacted(F.col("text"), "the").alias("safe"), text.observed_identity(F.col("role")).alias("identity"))


_PAYLOAD = """CASE event_id % 4 WHEN 0 THEN '{"choices":[{"message":{"content":"c' || event_id || '"}}],"usage":{"prompt_tokens":' || user_id || ',"completion_tokens":7}}' WHEN 1 THEN '{"output_text":"o","usage":{"input_tokens":3,"output_tokens":4,"input_tokens_details":{"cached_tokens":2},"output_tokens_details":{"reasoning_tokens":1}}}' WHEN 2 THEN '{"output":[{"content":[{"text":"t"}]}]}' ELSE 'broken' END"""


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'c' || event_id WHEN 1 THEN 'o' WHEN 2 THEN 't' END AS reply, CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN 3 END::BIGINT AS input, CASE WHEN event_id % 4 = 1 THEN 2 END::BIGINT AS cached, CASE event_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 4 END::BIGINT AS output, CASE WHEN event_id % 4 = 1 THEN 1 END::BIGINT AS reasoning FROM events")
def reply_usage(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.expr(_PAYLOAD).alias("p"))
    return e.select("event_id", derived.response_text(F.col("p")).alias("reply"), derived.usage(F.col("p")).alias("u")).select("event_id", "reply", "u.*")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE (event_id % 60)::DOUBLE END::DOUBLE AS seconds FROM events")
def attempt_durations(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("started", F.col("ts").cast("timestamp"))
    end = F.when(F.col("event_id") % 5 != 0, F.timestamp_micros(F.unix_micros("started") + F.col("event_id") % 60 * 1_000_000))
    return e.select("event_id", text.duration(F.col("started"), end).alias("seconds"))


@query(f"WITH {EVIDENCE_SQL} SELECT episode_id, sequence_index, episode_id || ':evidence:' || lpad(sequence_index::VARCHAR, 3, '0') || ':' || role AS evidence_id FROM evidence")
def evidence_ids(spark, sf_dir):
    e = evidence(spark, sf_dir)
    return e.select("episode_id", "sequence_index", text.evidence_id(F.col("episode_id"), F.col("sequence_index"), F.col("role")).alias("evidence_id"))


# Statistics

@query("SELECT l_suppkey AS unit, CASE WHEN l_suppkey % 3 = 0 THEN 'go_candidate' WHEN l_suppkey % 10 >= 8 AND l_suppkey % 2 = 0 THEN 'equivalence_candidate' ELSE 'inconclusive' END AS class, l_suppkey % 2 = 0 AND l_suppkey % 5 = 0 AND coalesce(l_suppkey % 7 <> 0, false) AS no_go FROM (SELECT s_suppkey AS l_suppkey FROM supplier)")
def null_classes(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), (F.col("s_suppkey") % 10 / 10).alias("power"), (F.col("s_suppkey") % 2 == 0).alias("a"), (F.col("s_suppkey") % 3 == 0).alias("sig"), (F.col("s_suppkey") % 5 == 0).alias("b"), F.when(F.col("s_suppkey") % 7 != 0, True).alias("c"))
    return s.select("unit", stats.classify_null(F.col("power"), F.col("a"), F.col("sig")).alias("class"), stats.formal_no_go_allowed("a", "b", "c").alias("no_go"))


_SHARES = """a AS (SELECT unit_id, 0 AS i, chunk, 0::BIGINT AS tokens, total::BIGINT AS rest FROM w WHERE false
UNION ALL SELECT w.unit_id, w.i, w.chunk, CASE WHEN w.i = n THEN total ELSE least(greatest(1, round_even(total * size / whole::DOUBLE, 0)::BIGINT), total - (n - w.i)) END, 0 FROM w WHERE w.i = 1),
r AS (SELECT w.unit_id, w.i, w.chunk, a.tokens, w.total - a.tokens AS rest FROM w JOIN a USING (unit_id, i) UNION ALL
  SELECT w.unit_id, w.i, w.chunk, CASE WHEN w.i = n THEN rest ELSE least(greatest(1, round_even(total * size / whole::DOUBLE, 0)::BIGINT), rest - (n - w.i)) END,
    rest - CASE WHEN w.i = n THEN rest ELSE least(greatest(1, round_even(total * size / whole::DOUBLE, 0)::BIGINT), rest - (n - w.i)) END FROM r JOIN w ON w.unit_id = r.unit_id AND w.i = r.i + 1)"""


@query(f"""WITH RECURSIVE c AS (SELECT conv_id AS unit_id, turn AS chunk, length(coalesce(text, '')) + 1 AS size, conv_id % 97 + 5 AS total FROM conversations),
w AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY chunk) AS i, count(*) OVER (PARTITION BY unit_id) AS n, sum(size) OVER (PARTITION BY unit_id) AS whole FROM c), {_SHARES} SELECT unit_id, chunk, tokens::BIGINT AS tokens FROM r""")
def chunk_tokens(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("unit_id"), F.col("turn").alias("chunk"), (F.length(F.coalesce("text", F.lit(""))) + 1).cast("bigint").alias("size"), (F.col("conv_id") % 97 + 5).alias("total"))
    return partition.reallocated(c).select("unit_id", "chunk", "tokens")


_UNIT_WORDS = r"len(list_filter(regexp_split_to_array(x, '[\s\x{1c}-\x{1f}\p{Z}\x{85}]+'), lambda w: w <> ''))::BIGINT"


@query(f"""WITH RECURSIVE {EVIDENCE_SQL}, lines AS (SELECT conv_id * 1000 + turn AS unit_id, string_split(coalesce(text, ''), chr(10)) AS v FROM conversations),
turns AS (SELECT unit_id, unnest(v) AS x, unnest(range(len(v))) AS turn FROM lines), t AS (SELECT unit_id, turn, {_UNIT_WORDS} AS words FROM turns),
f AS (SELECT unit_id, turn, words, 0::BIGINT AS c0, greatest(0, (words - 1) // 15)::BIGINT AS c1, words - 15 * greatest(0, (words - 1) // 15) AS filled FROM t WHERE turn = 0
  UNION ALL SELECT t.unit_id, t.turn, t.words, f.c1 + (f.filled + t.words > 15)::BIGINT, f.c1 + (f.filled + t.words > 15)::BIGINT + greatest(0, (t.words - 1) // 15),
    CASE WHEN f.filled + t.words > 15 THEN 0 ELSE f.filled END + t.words - 15 * greatest(0, (t.words - 1) // 15) FROM f JOIN t ON t.unit_id = f.unit_id AND t.turn = f.turn + 1),
p AS (SELECT unit_id, unnest(range(c0, c1 + 1)) AS chunk, c1, words - 15 * (c1 - c0) AS last FROM f),
s AS (SELECT unit_id, chunk, (1 + sum(CASE WHEN chunk = c1 THEN last ELSE 15 END))::BIGINT AS size FROM p GROUP BY ALL),
w AS (SELECT s.*, token_count AS total, row_number() OVER (PARTITION BY unit_id ORDER BY chunk) AS i, count(*) OVER (PARTITION BY unit_id) AS n, sum(size) OVER (PARTITION BY unit_id) AS whole
  FROM s JOIN (SELECT episode_id * 1000 + sequence_index AS unit_id, token_count FROM evidence) USING (unit_id)), {_SHARES} SELECT r.unit_id, r.chunk, size AS model_tokens, tokens::BIGINT AS tokens FROM r JOIN s USING (unit_id, chunk)""")
def unit_chunks(spark, sf_dir):
    """Turns of conversations as units, their lines as turns, cut at 16 words with a header of one."""
    rows = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("unit_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("turn", "text"))
    turns = rows.select("unit_id", F.col("turn").cast("bigint").alias("turn"), F.size(F.filter(F.split("text", r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")).cast("bigint").alias("words"))
    totals = evidence(spark, sf_dir).select((F.col("episode_id") * 1000 + F.col("sequence_index")).alias("unit_id"), F.col("token_count").alias("total"))
    return partition.unit_chunks(turns, totals, 16, 1)


@query("""WITH RECURSIVE c AS (SELECT conv_id AS q, turn AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, greatest(1, len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda w: w <> ''))) AS cost FROM conversations),
p AS (SELECT q, 0::BIGINT AS rank, 0::BIGINT AS used, []::BIGINT[] AS kept FROM c GROUP BY q UNION ALL SELECT p.q, c.rank, CASE WHEN used + cost <= 60 THEN used + cost ELSE used END, CASE WHEN used + cost <= 60 THEN list_append(kept, i) ELSE kept END FROM p JOIN c ON c.q = p.q AND c.rank = p.rank + 1)
SELECT q AS query_id, array_to_string(list_sort(arg_max(kept, rank)), ',') AS indices FROM p GROUP BY q HAVING len(arg_max(kept, rank)) > 0""")
def first_fit(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), rank.alias("rank"), F.col("turn").cast("bigint").alias("index"), "text")
    return partition.first_fit(rows, 60).select("query_id", F.array_join(F.transform("indices", lambda x: x.cast("string")), ",").alias("indices"))


# Files

def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT coalesce(nullif(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_suppkey::VARCHAR END, ''), 'q' || s_suppkey) AS id, s_nationkey AS nation FROM supplier")
def jsonl_round_trip(spark, sf_dir):
    """Suppliers written as lines of JSON and read again, each with the first of its ids that is not empty."""
    path = _folder(spark, "jsonl")
    rows = load(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("question_id"), F.col("s_nationkey").alias("nation"))
    tables.write_jsonl(rows, path, "question_id")
    back = tables.read_jsonl(spark, path, rows.schema)
    return back.select("id", "nation")


@query("SELECT n_nationkey AS question_id, 1::BIGINT AS rows FROM nation WHERE false UNION ALL SELECT n_regionkey, count(*)::BIGINT FROM nation GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark, sf_dir):
    return tables.repeated_ids(load(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("question_id")), "question_id")


@query("SELECT s_nationkey AS nation, count(*)::BIGINT AS suppliers FROM supplier GROUP BY 1")
def published_runs(spark, sf_dir):
    """Two runs published side by side; the view reads the latest that is complete."""
    path = _folder(spark, "runs")
    rows = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    tables.publish(rows.limit(3), path, "run-1")
    tables.publish(rows, path, "run-2")
    return tables.latest(spark, path).groupBy("nation").agg(F.count("*").alias("suppliers"))
