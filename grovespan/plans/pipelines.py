"""The three long pipelines as compositions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, joins, partition, trees, worklog
from ..sources.shared import saved


def normalized_corpus(raw: DataFrame, margin: float = text.MARGIN) -> DataFrame:
    """Evidence rows of ``raw`` (question_id and three parallel arrays of sessions), with ids and token counts.

    Dates stay text: order comes from position. Rows whose arrays differ in length
    are left to ``corpus_audit``, which excludes them.
    """
    turns = lambda s: F.array_join(F.transform(s, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    zipped = F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")
    rows = raw.where((F.size("haystack_session_ids") == F.size("haystack_dates")) & (F.size("haystack_dates") == F.size("haystack_sessions")))
    e = rows.select(F.col("question_id").alias("episode_id"), F.posexplode(zipped).alias("sequence_index", "z"))
    body = turns(F.col("z.haystack_sessions"))
    return e.select(
        "episode_id", F.col("sequence_index").cast("bigint").alias("sequence_index"), F.col("z.haystack_session_ids").alias("source_session_id"), F.col("z.haystack_dates").alias("event_time"),
        text.evidence_id(F.col("episode_id"), F.col("sequence_index"), F.col("z.haystack_session_ids")).alias("evidence_id"), text.evidence_tokens(body, margin).alias("token_count"), F.sha2(body.cast("binary"), 256).alias("raw_sha256"))


def corpus_audit(raw: DataFrame, k: int = 8) -> dict[str, DataFrame]:
    """Episodes with exclusions, evidence, counts, strata, and leakage groups of the cleaned corpus shape.

    Nothing is dropped silently: ``episodes`` has every row, with its reason if it
    is excluded.
    """
    ids, answers = F.col("haystack_session_ids"), F.col("answer_session_ids")
    copies = raw.groupBy(F.sha2(F.to_json(F.struct("question", "answer", "haystack_session_ids")).cast("binary"), 256).alias("h")).agg(F.min("question_id").alias("first"))
    flagged = raw.withColumn("h", F.sha2(F.to_json(F.struct("question", "answer", "haystack_session_ids")).cast("binary"), 256)).join(copies, "h").select(
        raw["*"],
        text.is_abstention(F.col("question_id"), F.col("question_type")).alias("abstention"),
        (F.size(ids) < 4).alias("fewer_than_four"),
        (F.length(F.trim(F.coalesce("question", F.lit("")))) == 0).alias("unrecoverable_query"),
        (F.col("question_id") != F.col("first")).alias("exact_duplicate"),
        F.exists(answers, lambda a: F.size(F.filter(ids, lambda x: x == a)) > 1).alias("ambiguous_support"),
        (F.size(F.array_except(answers, ids)) > 0).alias("support_not_in_haystack"),
        (F.coalesce(F.size(answers), F.lit(0)) <= 0).alias("invalid_answer_ids"),
        ((F.size(ids) != F.size("haystack_dates")) | (F.size(ids) != F.size("haystack_sessions"))).alias("parallel_mismatch"),
        F.exists(ids, lambda x: F.coalesce(F.length(x) == 0, F.lit(True))).alias("invalid_ids"),
    )
    episodes = saved(graph.exclusion_reason(flagged).select("question_id", "question_type", "question", "answer_session_ids", "haystack_session_ids", "reason"))
    kept = episodes.where("reason is null")
    evidence = saved(normalized_corpus(raw.join(kept.select("question_id"), "question_id", "left_semi")))
    spans = partition.partition(evidence.where("token_count > 0"), k)
    support = kept.select(F.col("question_id").alias("episode_id"), F.explode("answer_session_ids").alias("source_session_id")).join(evidence.groupBy("episode_id", "source_session_id").agg(F.min("sequence_index").alias("position")), ["episode_id", "source_session_id"])
    placed = support.join(spans, "episode_id").where("position between start and end").join(evidence.groupBy("episode_id").agg(F.count("*").alias("n")), "episode_id")
    layout = graph.layout(placed.select("episode_id", "position", "leaf", "n")).join(kept.select(F.col("question_id").alias("episode_id"), "question_type"), "episode_id")
    base = F.regexp_replace("question_id", r"_abs$", "")
    support_hashes = support.join(evidence.select("episode_id", F.col("sequence_index").alias("position"), "raw_sha256"), ["episode_id", "position"]).select("episode_id", F.lit("supporting_evidence_hash").alias("relation"), F.col("raw_sha256").alias("value"))
    family = F.col("family_id") if "family_id" in raw.columns else F.lit(None).cast("string")
    families = raw.select(F.col("question_id").alias("episode_id"), F.lit("family").alias("relation"), family.alias("value")).join(kept.select(F.col("question_id").alias("episode_id")), "episode_id", "left_semi")
    sessions = kept.select(F.col("question_id").alias("episode_id"), F.lit("answer_session").alias("relation"), F.explode("answer_session_ids").alias("value"))
    questions = kept.select(F.col("question_id").alias("episode_id"), F.explode(F.array(
        F.struct(F.lit("base_question_id").alias("relation"), base.alias("value")),
        F.struct(F.lit("normalized_question").alias("relation"), F.sha2(text.normalized_question("question").cast("binary"), 256).alias("value")),
    )).alias("r")).select("episode_id", "r.*")
    relations = questions.unionByName(families).unionByName(sessions).unionByName(support_hashes)
    return {
        "episodes": episodes, "evidence": evidence, "counts": graph.eligibility_counts(evidence), "layout": layout,
        "strata": layout.groupBy("question_type", "support_class", "position_bin").agg(F.count("*").alias("n")), "groups": graph.leakage_groups(relations),
    }


def rebuilt_observability(nodes: DataFrame, attempts: DataFrame, bindings: DataFrame, events: DataFrame, artifacts: DataFrame) -> dict[str, DataFrame]:
    """All derived tables of a run from its raw logs, so that they can be deleted and made again.

    ``attempts`` as ``worklog`` reads them, with attempt_outcome and accepted_attempt as
    ``joins.binding_problems`` does; ``bindings`` and ``artifacts`` as the checks of
    ``joins`` read them, artifacts with source; ``events`` as ``joins.event_problems``,
    with plan_id, k, node, the children's nodes, budget and payload_tokens.
    """
    a = artifacts.select(F.col("node").alias("id"), F.col("tokens"))
    three = events
    for side in ("left", "right", "output"):
        three = three.join(a.select(F.col("id").alias(f"{side}_id"), F.col("tokens").alias(f"{side}_tokens")), f"{side}_id", "left")
    spans = nodes.select(F.col("node").alias("n"), "lo", "hi")
    placed = three.join(spans.select(F.col("n").alias("left_node"), F.col("hi").alias("left_hi")), "left_node", "left").join(spans.select(F.col("n").alias("right_node"), F.col("lo").alias("right_lo")), "right_node", "left")
    metrics = worklog.merge_metrics(placed)
    lineage = worklog.generative_lineage(artifacts)
    pressures = placed.select("event_id", "plan_id", "k", "node").join(metrics, "event_id").select("plan_id", "k", "node", "generative", "pressure")
    bound = bindings.where("binding_status = 'succeeded'").select(F.col("accepted_attempt_id").alias("attempt_id"), "run_id", "stage", "logical_call_id")
    return {
        "plan_metrics": trees.plan_metrics(nodes), "plan_problems": trees.violations(nodes), "binding_problems": joins.binding_problems(attempts, bindings), "event_problems": joins.event_problems(events, bindings, artifacts, attempts),
        "artifact_problems": joins.artifact_binding_counts(artifacts, bindings.where("binding_status = 'succeeded'")), "merge_metrics": metrics, "lineage": lineage, "exposure": trees.evidence_exposure(nodes, pressures), "work": worklog.reconciled(worklog.marked(attempts, bound), "run_id"),
    }
