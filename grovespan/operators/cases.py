"""Judge cases made of episodes, their cache keys, exposure of support, and the work of a memory's life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# The categories of cases with what the judge should say, tasks, and the candidates that do not come from the reference.
EXPECTED = {"gold_equivalent": 1, "formatting_variation": 1, "clearly_wrong": 0, "partial": 0, "abstention_like": 0, "temporal_reasoning": 1, "knowledge_update": 1}
TASKS = ("knowledge-update", "temporal-reasoning")
FORMATTED = "Final answer:\n"
WRONG = "An unrelated alternative that is not the reference answer."
ABSTAINS = "I cannot determine the answer from the available information."
STATUSES = ("exact", "expanded_to_chunks", "unresolved")
JUDGE_KEY = ("question_id", "reference_answer_hash", "candidate_answer_hash", "judge_prompt_hash", "judge_model", "decoding_config_hash", "output_schema_version")


def _hash(*fields: tuple[str, Column]) -> Column:
    """The hash of canonical JSON, for any text."""
    return text.canonical_text_hash(F.to_json(F.struct(*[c.alias(n) for n, c in fields]), {"ignoreNullFields": "false"}))


def judge_cases(episodes: DataFrame, seed: str, categories: tuple[str, ...] = tuple(EXPECTED)) -> DataFrame:
    """A case per episode and category: case_id, candidate_answer, expected_label, and problem where none can be made.

    ``episodes(episode_id, query_id, question_type, question, reference_answer)``.
    Problems: missing_field (blank text), unsupported_task, no_partial_answer.
    """
    rows = episodes.withColumn("case_category", F.explode(F.array(*[F.lit(c) for c in categories])))
    kind, reference = F.col("case_category"), F.trim("reference_answer")
    candidate = F.when(kind == "formatting_variation", F.concat(F.lit(FORMATTED), reference)).when(kind == "clearly_wrong", WRONG).when(kind == "abstention_like", ABSTAINS).when(kind == "partial", text.partial_answer(reference)).otherwise(reference)
    blank = F.lit(False)
    for c in ("episode_id", "query_id", "question", "reference_answer"):
        blank |= F.coalesce(F.trim(c), F.lit("")) == ""
    problem = F.when(blank, "missing_field").when(~F.coalesce(F.col("question_type").isin(*TASKS), F.lit(False)), "unsupported_task").when(candidate.isNull(), "no_partial_answer")
    label = F.element_at(F.create_map(*[F.lit(x) for c, n in EXPECTED.items() for x in (c, n)]), kind)
    made = rows.withColumns({"candidate_answer": candidate, "problem": problem, "expected_label": label})
    name = F.concat(F.lit("jrq-"), F.substring(_hash(("manifest_id", F.lit(seed)), ("episode_id", F.col("episode_id")), ("case_category", kind), ("candidate_answer", F.col("candidate_answer"))), 1, 20))
    sound = lambda x: F.when(F.col("problem").isNull(), x)
    return made.select("episode_id", "query_id", "question_type", "case_category", sound(name).alias("case_id"), sound(F.col("candidate_answer")).alias("candidate_answer"), sound(F.col("expected_label")).alias("expected_label"), "problem")


def judge_cache_key(**fields: Column) -> Column:
    """The key of a cached verdict: the hash of its seven inputs."""
    if set(fields) != set(JUDGE_KEY):
        raise ValueError(f"a verdict's key needs {', '.join(JUDGE_KEY)}")
    return _hash(*fields.items())


def support_exposure(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key: supporting leaves, unresolved annotations and their share, mean and maximum of rewrites and pressure over leaves, roles with their numbers, problems.

    ``rows(keys, status, leaf_ids, rewrite_depth, pressure, role)``, one per annotation.
    problems, sorted: status_unknown, unresolved_with_leaves, resolved_without_leaves,
    value_missing, leaf_inconsistent (a leaf with several values). Means and maxima are null without a leaf.
    """
    resolved = F.col("status") != "unresolved"
    empty = F.coalesce(F.size("leaf_ids"), F.lit(0)) <= 0
    lacks = F.col("rewrite_depth").isNull() | (F.col("rewrite_depth") < 0) | F.col("pressure").isNull() | (F.col("pressure") < 0) | (F.coalesce("role", F.lit("")) == "")
    code = F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status_unknown").when(~resolved & ~empty, "unresolved_with_leaves").when(resolved & empty, "resolved_without_leaves").when(resolved & lacks, "value_missing")
    marked = rows.withColumn("code", code)
    own = marked.groupBy(*keys).agg(F.count("*").alias("annotations"), F.count_if(F.col("status") == "unresolved").alias("unresolved"), F.array_sort(F.collect_set("code")).alias("codes"))
    value = F.struct("rewrite_depth", "pressure", "role")
    each = marked.where(resolved & F.col("code").isNull()).select(*keys, F.explode("leaf_ids").alias("leaf"), value.alias("v"))
    leaves = each.groupBy(*keys, "leaf").agg(F.min("v").alias("v"), (F.min("v") != F.max("v")).alias("differs"))
    # Roles are few, so they are counted before they meet in one row.
    roles = leaves.groupBy(*keys, F.col("v.role").alias("role")).agg(F.count("*").alias("n"), F.sum("v.rewrite_depth").alias("r"), F.max("v.rewrite_depth").alias("rm"), F.sum("v.pressure").alias("p"), F.max("v.pressure").alias("pm"), F.bool_or("differs").alias("differs"))
    per = roles.groupBy(*keys).agg(
        F.sum("n").alias("leaves"), (F.sum("r") / F.sum("n")).alias("rewrite_mean"), F.max("rm").alias("rewrite_max"), (F.sum("p") / F.sum("n")).alias("pressure_mean"), F.max("pm").alias("pressure_max"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "n"))), lambda x: F.concat_ws(":", x["role"], x["n"].cast("string"))), ",").alias("roles"), F.bool_or("differs").alias("differs"),
    )
    both = own.join(per, list(keys), "left")
    codes = F.array_sort(F.concat("codes", F.when(F.col("differs"), F.array(F.lit("leaf_inconsistent"))).otherwise(F.array().cast("array<string>"))))
    return both.select(*keys, F.coalesce("leaves", F.lit(0)).alias("leaves"), "unresolved", (F.col("unresolved") / F.col("annotations")).alias("unresolved_share"), "rewrite_mean", "rewrite_max", "pressure_mean", "pressure_max", F.coalesce("roles", F.lit("")).alias("roles"), F.array_join(codes, ",").alias("problems"))


def lifecycle_work(attempts: DataFrame, *keys: str) -> DataFrame:
    """Input, cached, uncached and output tokens of the accepted merges and answers of each key, null where an accepted attempt's are not known; judging is no part of it."""
    ok = attempts.where("outcome = 'accepted' and stage in ('merge', 'answer')")
    columns = []
    for stage in ("merge", "answer"):
        own = F.col("stage") == stage
        known = lambda c: F.when(F.count_if(own & F.col(c).isNull()) == 0, F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)))  # noqa: E731, B023
        columns += [known("input_tokens").alias(f"{stage}_input"), known("cached_tokens").alias(f"{stage}_cached"), (known("input_tokens") - known("cached_tokens")).alias(f"{stage}_uncached"), known("output_tokens").alias(f"{stage}_output")]
    return ok.groupBy(*keys).agg(*columns)
