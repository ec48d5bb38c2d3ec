"""Contracts of records as named checks, for ``worklog.problems`` (a table of violations) or ``worklog.enforce`` (fail closed).

Each function returns a dict of check name to boolean column; a null check counts
as failed. Types are a matter of the schema, so a boolean is never a number here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the protocol.
SPLITS = ("development", "calibration", "acceptance")
ROLLING = ("latest", "default")
SOURCES = ("generated", "cache", "deterministic")
PROTECTED = ("gold_answer", "supporting_evidence_ids", "supporting_session_ids", "support_annotations")
QUERY_FIELDS = ("query", "query_id", "query_text")
K_PLANNED = (4, 8, 16)
REPLICATES = (3, 5)
DELTA_GRID = (0.05, 0.075, 0.10, 0.125, 0.15)
DELTA_LEAST = 0.05
JUDGE_QUOTAS = {"gold_equivalent": 8, "clearly_wrong": 8, "partial": 8, "temporal_reasoning": 7, "knowledge_update": 7, "formatting_variation": 6, "abstention_like": 6}

Checks = dict[str, Column]


def filled(name: str) -> Column:
    return F.length(F.trim(F.col(name))) > 0


def digest(name: str) -> Column:
    return F.col(name).rlike("^[0-9a-f]{64}$")


def pinned(name: str) -> Column:
    """A named snapshot, not a rolling alias."""
    return filled(name) & ~F.col(name).isin(*ROLLING) & ~F.col(name).endswith("-latest")


def zoned(name: str) -> Column:
    """ISO time with an explicit zone (Spark itself would take a local one)."""
    return F.col(name).rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp(F.col(name)).isNotNull()


def all_filled(*names: str) -> Checks:
    return {f"{n}_filled": filled(n) for n in names}


def episode() -> Checks:
    distinct = lambda n: (F.size(n) > 0) & (F.size(n) == F.size(F.array_distinct(n)))
    return all_filled("dataset_id", "dataset_version_or_commit", "episode_id", "construction_unit_id", "family_id", "split") | {
        "evidence_ids": distinct("ordered_evidence_ids") & F.forall("ordered_evidence_ids", lambda x: F.length(x) > 0),
        "query_ids": distinct("query_ids"),
        "split_known": F.col("split").isin(*SPLITS),
        "provenance": F.col("provenance").isNotNull(),
    }


def capacity() -> Checks:
    own = [F.col(c) for c in ("B_merge", "B_final", "B_query")]
    return {"equal": F.least(*own) == F.greatest(*own), "positive": F.least(*own) > 0}


def backbone() -> Checks:
    snapshots = ("constructor_model_snapshot", "merge_model_snapshot", "answer_model_snapshot")
    return all_filled("backbone_id", "role", "model_family", "provider", "endpoint", "decoding_config_hash") | {"role_known": F.col("role").isin("primary", "replication")} | {f"{s}_pinned": pinned(s) for s in snapshots}


def same_family(backbones: DataFrame) -> DataFrame:
    """Families that serve as primary and as replication, which a replication must not."""
    return backbones.groupBy("model_family").agg(F.count_distinct("role").alias("n")).where("n > 1").select("model_family")


def retrieval() -> Checks:
    own = all_filled("retrieval_config_id", "tokenizer_snapshot", "retrieval_unit_version", "packing_policy", "tie_break", "index_version", "sha256")
    return own | {
        "embedding_pinned": pinned("embedding_model_snapshot") & F.col("embedding_model_snapshot").contains("@"),
        "cosine": F.col("similarity_metric") == "cosine_normalized",
        "all_candidates": F.col("candidate_top_k") == "all",
        "chronological": F.col("render_order") == "chronological",
    }


def node_artifact() -> Checks:
    names = ("materialized_node_id", "logical_node_id", "run_id", "content_hash", "artifact_kind", "tokenizer_snapshot", "serialization_version", "operator_config_id", "creation_event_type", "creation_event_id", "schema_version", "validation_status", "artifact_status")
    ref, source = F.col("content_artifact_id"), F.col("materialization_source")
    generated = filled("model_snapshot") & filled("prompt_hash") & filled("response_hash")
    return all_filled(*names) | {
        "stable_reference": filled("content_artifact_id") & ~ref.rlike(r"^(/|\\|file://|[A-Za-z]:[\\/])"),
        "tokens": F.col("local_surrogate_content_tokens") >= 0,
        "capacity": (F.col("capacity_tokens") > 0) & (F.col("local_surrogate_content_tokens") <= F.col("capacity_tokens")),
        "source_known": source.isin(*SOURCES),
        "source_fields": F.when(source == "generated", generated).when(source == "deterministic", filled("deterministic_operator_hash")).otherwise(F.lit(True)),
    }


def unresolved(artifacts: DataFrame, contents: DataFrame) -> DataFrame:
    """Artifacts whose content is in no content table."""
    return artifacts.join(contents.select("content_artifact_id"), "content_artifact_id", "left_anti")


def plan_node() -> Checks:
    leaf, inner = F.col("kind") == "leaf", F.col("kind") == "internal"
    return {
        "kind_known": leaf | inner,
        "leaf_without_children": ~leaf | (F.col("left").isNull() & F.col("right").isNull()),
        "two_children": ~inner | (F.col("left").isNotNull() & F.col("right").isNotNull() & ~F.col("left").eqNullSafe(F.col("right"))),
        "span": (F.col("lo") >= 0) & (F.col("lo") <= F.col("hi")),
    }


def replicates(pilot: str = "r_pilot", formal: str = "r_formal") -> Checks:
    return {"registered": (F.col(pilot) == REPLICATES[0]) & (F.col(formal) == REPLICATES[1])}


def delta_decision() -> Checks:
    return {
        "on_grid": F.col("delta_decision").isin(*DELTA_GRID), "least": F.col("delta_decision") >= DELTA_LEAST,
        "frozen_before_results": ~F.col("topology_results_seen"), "power": F.col("power") >= 0.80,
    }


def power_inputs() -> Checks:
    return {"no_fraction_of_n": ~F.coalesce(F.col("uses_fraction_times_n"), F.lit(False)), "strata": F.size("strata") > 0, "n_is_independent": F.col("analysis_n") == F.col("independent_episodes")}


def rebuild_interval() -> Checks:
    """Null if periodic rebuilding is off, else positive."""
    own = F.col("periodic_rebuild_interval")
    return {"interval": F.when(F.col("periodic_rebuild_enabled"), own > 0).otherwise(own.isNull())}


def stage_boundary() -> Checks:
    first, last, status = F.col("first_started_at"), F.col("last_finished_at"), F.col("status")
    return {
        "status_known": status.isin("recorded", "unavailable"),
        "ordered": (status != "recorded") | (first <= last),
        "no_times": (status != "unavailable") | (first.isNull() & last.isNull()),
    }


OUTCOMES = ("accepted_materialized", "successful_nonmaterialized", "failed_provider", "failed_parse", "failed_validation", "cancelled_before_start", "cancelled_after_start")
STAGES = ("leaf", "merge", "answer", "judge")
USAGE_SOURCES = ("provider_exact", "provider_estimated", "missing")
PLACEHOLDERS = ("", "none", "unknown")


def attempt() -> Checks:
    """A model-call attempt: identity by outcome, usage by its source, times in order."""
    names = ("attempt_id", "run_id", "logical_call_id", "requested_model", "provider", "provider_route", "prompt_hash", "tokenizer_snapshot", "serialization_version", "usage_schema_version", "parse_status", "status")
    outcome, source = F.col("attempt_outcome"), F.col("provider_usage_source")
    total, cached, output, reasoning = (F.col(f"provider_{n}") for n in ("input_tokens_total", "cached_input_tokens_subset", "output_tokens_total", "reasoning_tokens_subset"))
    named = outcome.isin("accepted_materialized", "successful_nonmaterialized", "failed_parse")
    identity = lambda c: F.when(F.col(c).isNull(), ~named).otherwise(~F.lower(F.trim(c)).isin(*PLACEHOLDERS))
    lost, early = source == "missing", outcome == "cancelled_before_start"
    scheduled, started, finished = F.col("scheduled_at"), F.col("started_at"), F.col("finished_at")
    return all_filled(*names) | {
        "response_hash": F.col("response_hash").isNull() | filled("response_hash"),
        "stage_known": F.col("stage").isin(*STAGES), "outcome_known": outcome.isin(*OUTCOMES),
        "returned_model": identity("returned_model"), "request_id": identity("request_id"),
        "retry_index": F.col("retry_index") >= 0, "surrogate_tokens": (F.col("local_surrogate_serialized_input_tokens") >= 0) & (F.col("local_surrogate_output_content_tokens") >= 0),
        "usage_source_known": source.isin(*USAGE_SOURCES),
        "missing_usage_is_null": ~lost | F.coalesce(total, cached, output, reasoning).isNull(),
        "usage_given": lost | ((total >= 0) & (cached >= 0) & (output >= 0) & F.coalesce(reasoning >= 0, F.lit(True))),
        "cached_in_input": lost | (cached <= total), "reasoning_in_output": lost | reasoning.isNull() | (reasoning <= output),
        "accepted_flag": F.col("accepted_attempt") == (outcome == "accepted_materialized"),
        "times": F.when(early, started.isNull() & finished.isNull()).otherwise((scheduled <= started) & (started <= finished)),
        "http_status": F.col("http_status").isNull() | F.col("http_status").between(100, 599),
    }


PROFILES = {"offline": "offline_state_tokens", "online": "online_state_tokens"}


def deployment_state() -> Checks:
    return {"profile_known": F.col("profile").isin(*PROFILES), "tokens": F.greatest(F.lit(0), F.col("state_tokens")) == F.col("state_tokens")}


def tokenizer_spec() -> Checks:
    names = ("tokenizer_id", "tokenizer_revision", "serialization_version", "estimator")
    return {f"{n}_pinned": pinned(n) for n in names} | {"margin": F.col("safety_margin") >= 0, "estimator_known": F.col("estimator") == "surrogate_regex_bytes_v1"}


def plan_sets(primary: tuple[str, ...] = ("left_deep", "canonical_balanced"), diagnostic: tuple[str, ...] = ("left_deep", "canonical_balanced", "right_deep")) -> Checks:
    exact = lambda c, names: F.col(c) == F.array(*[F.lit(x) for x in names])
    return {"primary": exact("primary_plans", primary), "diagnostic": exact("diagnostic_plans", diagnostic)}


def judge_config() -> Checks:
    return {"temperature": F.col("temperature") == 0, "json_label": F.col("output_format") == "json_label", "model_pinned": pinned("judge_model_snapshot")}


def endpoint_probe() -> Checks:
    """A probe tries the direct route before the proxy, and is reachable by one at least."""
    return {"direct_first": F.col("routes")[0] == "direct", "reached": F.col("direct_ok") | F.col("proxy_ok")}


def chat_payload() -> Checks:
    """A request is one user message with text, and nothing that makes it more."""
    return {"one_message": F.size("messages") == 1, "user": F.get("messages", F.lit(0))["role"] == "user", "text": F.length(F.trim(F.get("messages", F.lit(0))["content"])) > 0, "no_tools": F.col("tools").isNull(), "temperature": F.col("temperature") == 0}


def four_stages(boundaries: DataFrame) -> DataFrame:
    """Runs whose timing does not have exactly the four stages, each once."""
    return boundaries.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("stage").isin(*STAGES), F.col("stage"))).alias("known")).where("n <> 4 or known <> 4").select("run_id", "n", "known")


def executor_config() -> Checks:
    return {"cold": F.col("cache_mode") == "cold", "ordered": F.col("finished_at") >= F.col("started_at")}


def quota_shortfalls(cases: DataFrame, quotas: dict[str, int] = JUDGE_QUOTAS) -> DataFrame:
    """category, want, have where the numbers of cases differ from the quotas, unknown categories included."""
    want = cases.sparkSession.createDataFrame(list(quotas.items()), "category string, want bigint")
    have = cases.groupBy("category").agg(F.count("*").alias("have"))
    return want.join(have, "category", "full").select("category", F.coalesce("want", F.lit(0)).alias("want"), F.coalesce("have", F.lit(0)).alias("have")).where("want <> have")


def seed_mismatches(rows: DataFrame) -> DataFrame:
    """Replicates whose merge or answer seed is not the replicate's own number."""
    return rows.where(~(F.col("s_merge").eqNullSafe(F.col("replicate_id")) & F.col("s_answer").eqNullSafe(F.col("replicate_id")))).select("replicate_id").distinct()


def unequal_cohorts(cohorts: DataFrame, k: int = 16) -> DataFrame:
    """k, episode_id that a cohort has and the one of ``k`` does not, or the other way round."""
    base = cohorts.where(F.col("k") == k).select("episode_id")
    others = cohorts.where(F.col("k") != k)
    extra = others.join(base, "episode_id", "left_anti").select("k", "episode_id")
    return extra.unionByName(others.select("k").distinct().crossJoin(base).join(others, ["k", "episode_id"], "left_anti"))


# Label boundary: which fields a stage's view may carry is a question of its schema, so it costs no data.

def field_names(kind: T.DataType) -> set[str]:
    """Field names at any depth."""
    if isinstance(kind, T.StructType):
        return {f.name for f in kind.fields}.union(*(field_names(f.dataType) for f in kind.fields)) if kind.fields else set()
    if isinstance(kind, T.ArrayType):
        return field_names(kind.elementType)
    if isinstance(kind, T.MapType):
        return field_names(kind.keyType) | field_names(kind.valueType)
    return set()


def leaked(view: DataFrame, stage: str) -> set[str]:
    """Protected fields that the view of a stage carries against the rule."""
    banned = {"construction": {*PROTECTED, *QUERY_FIELDS}, "answer": set(PROTECTED), "scoring": set()}[stage]
    return field_names(view.schema) & banned


def guarded(view: DataFrame, stage: str) -> DataFrame:
    """``view``, or an error if it leaks; scoring with labels also needs frozen artifacts and an access log id in every row."""
    if bad := leaked(view, stage):
        raise ValueError(f"{stage} must not read {', '.join(sorted(bad))}")
    if stage == "scoring" and field_names(view.schema) & set(PROTECTED):
        ok = F.col("run_artifacts_frozen") & F.col("answer_artifacts_frozen") & filled("access_log_id")
        return view.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit("labels need frozen artifacts and an access log id")).cast("boolean")))
    return view


def construction_view(evidence: DataFrame) -> DataFrame:
    return guarded(evidence.select([c for c in evidence.columns if c not in {*PROTECTED, *QUERY_FIELDS}]), "construction")


def answer_view(memory: DataFrame, queries: DataFrame, key: str = "episode_id") -> DataFrame:
    return guarded(memory.join(queries.select([c for c in queries.columns if c not in PROTECTED]), key), "answer")


def scoring_view(answers: DataFrame, labels: DataFrame, key: str = "query_id") -> DataFrame:
    return guarded(answers.join(labels, key), "scoring")
