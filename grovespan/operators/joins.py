"""Joins of recorded tables that must match, each as the rows that do not.

All are equi-joins or groups with partial sums; none is a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_trajectories(questions: DataFrame, haystack: DataFrame, trajectories: DataFrame) -> DataFrame:
    """question_id, problem of three files whose keys must match: ``haystack(question_id, trajectory_id)``."""
    q, h = questions.select("question_id"), haystack.select("question_id").distinct()
    none = q.join(h, "question_id", "left_anti").select("question_id", F.lit("no_haystack").alias("problem"))
    more = h.join(q, "question_id", "left_anti").select("question_id", F.lit("unknown_question").alias("problem"))
    lost = haystack.join(trajectories.select("trajectory_id"), "trajectory_id", "left_anti").select("question_id", F.lit("missing_trajectory").alias("problem")).distinct()
    return none.unionByName(more).unionByName(lost)


def evidence_mismatches(raw: DataFrame, normal: DataFrame, *fields: str) -> DataFrame:
    """episode_id, sequence_index, differs: raw and normalised evidence by position, fields that are not equal, or a side that lacks the row."""
    key = ["episode_id", "sequence_index"]
    a = raw.select(*key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("in_a"))
    b = normal.select(*key, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("in_b"))
    both = a.join(b, key, "full")
    apart = F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]))
    codes = F.when(F.col("in_a").isNull(), F.array(F.lit("only_normal"))).when(F.col("in_b").isNull(), F.array(F.lit("only_raw"))).otherwise(apart)
    return both.withColumn("differs", F.array_join(codes, ",")).where("differs <> ''").select(*key, "differs")


def leaves_of(sessions: DataFrame, spans: DataFrame) -> DataFrame:
    """episode_id, position, leaf: the span that holds each position; null where none does."""
    inside = spans.select("episode_id", "leaf", F.explode(F.sequence("start", "end")).alias("position"))
    return sessions.join(inside, ["episode_id", "position"], "left").select("episode_id", "position", "leaf")


def unscored(items: DataFrame, scored: DataFrame, *key: str) -> DataFrame:
    """Keys of ``items`` that have no score, or more than one."""
    n = scored.groupBy(*key).agg(F.count("score").alias("n"))
    return items.select(*key).join(n, list(key), "left").where("coalesce(n, 0) <> 1").select(*key, F.coalesce("n", F.lit(0)).alias("n"))


def binding_problems(attempts: DataFrame, bindings: DataFrame) -> DataFrame:
    """id, problem where successful bindings and accepted attempts are not one to one.

    ``attempts(attempt_id, run_id, stage, logical_call_id, attempt_outcome, accepted_attempt)``,
    ``bindings(binding_id, run_id, stage, logical_call_id, accepted_attempt_id, output_artifact_id, binding_status)``.
    """
    flag = lambda rows, key, text: rows.select(F.col(key).cast("string").alias("id"), F.lit(text).alias("problem"))
    bad = bindings.where("binding_status <> 'succeeded' and (accepted_attempt_id is not null or output_artifact_id is not null)")
    out = flag(bad, "binding_id", "failed_binding_has_output")
    ok = bindings.where("binding_status = 'succeeded'")
    out = out.unionByName(flag(ok.where("accepted_attempt_id is null or output_artifact_id is null"), "binding_id", "binding_without_output"))
    named = ok.where("accepted_attempt_id is not null").select("binding_id", F.col("accepted_attempt_id").alias("attempt_id"), *[F.col(c).alias(f"b_{c}") for c in ("run_id", "stage", "logical_call_id")])
    both = named.join(attempts, "attempt_id", "full")
    out = out.unionByName(flag(both.where("run_id is null"), "binding_id", "unknown_attempt"))
    out = out.unionByName(flag(both.where("run_id is not null and b_run_id is not null and (run_id <> b_run_id or stage <> b_stage or logical_call_id <> b_logical_call_id)"), "binding_id", "identity_differs"))
    out = out.unionByName(flag(both.where("b_run_id is not null and run_id is not null and (attempt_outcome <> 'accepted_materialized' or not accepted_attempt)"), "binding_id", "attempt_not_accepted"))
    out = out.unionByName(flag(both.where("b_run_id is null and accepted_attempt"), "attempt_id", "accepted_but_unbound"))
    twice = named.groupBy("attempt_id").agg(F.count("*").alias("n")).where("n > 1")
    out = out.unionByName(flag(twice, "attempt_id", "attempt_bound_twice"))
    calls = ok.groupBy("run_id", "stage", "logical_call_id").agg(F.count("*").alias("n"), F.min("binding_id").alias("binding_id")).where("n > 1")
    return out.unionByName(flag(calls, "binding_id", "call_with_two_outputs"))


def event_problems(events: DataFrame, bindings: DataFrame, artifacts: DataFrame, attempts: DataFrame) -> DataFrame:
    """event_id, problem of merge events against bindings, their three artifacts, cache sources and attempts.

    ``events(event_id, run_id, logical_call_id, source, binding_id, left_id, right_id, output_id, cache_of)``,
    ``artifacts(node, run_id, content_hash, tokens, capacity, tokenizer, version)``.
    """
    code = lambda rows, text: rows.select("event_id", F.lit(text).alias("problem"))
    out = code(events.where("source = 'generated'").join(bindings.select("binding_id"), "binding_id", "left_anti"), "binding_missing")
    sides = events.select("event_id", "run_id", F.explode(F.array("left_id", "right_id", "output_id")).alias("node"))
    placed = sides.join(artifacts.select("node", F.col("run_id").alias("a_run")), "node", "left")
    out = out.unionByName(code(placed.where("a_run is null"), "artifact_missing").distinct()).unionByName(code(placed.where("a_run <> run_id"), "artifact_of_other_run").distinct())
    calls = attempts.select("run_id", "logical_call_id").distinct()
    out = out.unionByName(code(events.where("source = 'cache'").join(calls, ["run_id", "logical_call_id"], "left_semi"), "cache_call_has_attempt"))
    fields = ("content_hash", "tokens", "capacity", "tokenizer", "version")
    own = events.where("source = 'cache'").join(artifacts.select(F.col("node").alias("output_id"), *fields), "output_id")
    base = artifacts.select(F.col("node").alias("cache_of"), *[F.col(f).alias(f"s_{f}") for f in fields])
    pair = own.join(base, "cache_of", "left")
    same = F.lit(True)
    for f in fields:
        same &= F.col(f).eqNullSafe(F.col(f"s_{f}"))
    return out.unionByName(code(pair.where("s_content_hash is null"), "cache_source_missing")).unionByName(code(pair.where("s_content_hash is not null").where(~same), "cache_lineage_differs"))


def artifact_binding_counts(artifacts: DataFrame, bindings: DataFrame) -> DataFrame:
    """node, source, bindings where a generated artifact has not exactly one binding, or another has any."""
    n = bindings.where("output_artifact_id is not null").groupBy(F.col("output_artifact_id").alias("node")).agg(F.count("*").alias("bindings"))
    both = artifacts.select("node", "source").join(n, "node", "left").withColumn("bindings", F.coalesce("bindings", F.lit(0)))
    return both.where("bindings <> case when source = 'generated' then 1 else 0 end")


def replay_problems(cases: DataFrame, replicates: int, replies: DataFrame) -> DataFrame:
    """case_id, replicate_id, problem: each case has each replicate exactly once, with text, hash and label that replay.

    ``replies(case_id, replicate_id, reply, reply_hash, label, replayed)``. The
    replicates are a column of constants, so the pairs wanted are cases x a fixed number.
    """
    want = cases.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate_id"))
    n = replies.groupBy("case_id", "replicate_id").agg(F.count("*").alias("n"))
    code = lambda rows, text: rows.select("case_id", "replicate_id", F.lit(text).alias("problem"))
    counted = want.join(n, ["case_id", "replicate_id"], "full").join(want.withColumn("wanted", F.lit(True)), ["case_id", "replicate_id"], "left")
    out = code(counted.where("n is null"), "reply_missing").unionByName(code(counted.where("n > 1"), "reply_repeated")).unionByName(code(counted.where("wanted is null"), "reply_unknown"))
    out = out.unionByName(code(replies.where(F.sha2(F.col("reply").cast("binary"), 256) != F.col("reply_hash")), "hash_differs"))
    return out.unionByName(code(replies.where(~F.col("label").eqNullSafe(F.col("replayed"))), "label_differs"))


def split_membership(assignment: DataFrame, episodes: DataFrame, split: str) -> DataFrame:
    """episode_id, problem: episodes assigned twice, not at all, or unknown; and those ``chosen`` by the split."""
    per = assignment.groupBy("episode_id").agg(F.count("*").alias("n"), F.min("split").alias("split"))
    twice = per.where("n > 1").select("episode_id", F.lit("assigned_twice").alias("problem"))
    lost = episodes.select("episode_id").join(per, "episode_id", "left_anti").select("episode_id", F.lit("not_assigned").alias("problem"))
    more = per.join(episodes.select("episode_id"), "episode_id", "left_anti").select("episode_id", F.lit("unknown_episode").alias("problem"))
    chosen = per.where((F.col("n") == 1) & (F.col("split") == split)).join(episodes.select("episode_id"), "episode_id", "left_semi").select("episode_id", F.lit("chosen").alias("problem"))
    return twice.unionByName(lost).unionByName(more).unionByName(chosen)


def priced_usage(rows: DataFrame, prices: DataFrame, *scope: str) -> DataFrame:
    """``rows`` with the price of their scope, and ``in_scope`` false where there is none."""
    return rows.join(prices, list(scope), "left").withColumn("in_scope", F.col("input_rate").isNotNull())


def sums_that_differ(parts: DataFrame, declared: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, declared, summed where the sum of the parts is not what was declared, or one side lacks the key."""
    total = parts.groupBy(*key).agg(F.sum(value).alias("summed"))
    both = declared.select(*key, F.col(value).alias("declared")).join(total, key, "full")
    return both.where(~F.col("declared").eqNullSafe(F.col("summed")))


def several_of(rows: DataFrame, key: list[str], *fields: str) -> DataFrame:
    """Keys with more than one distinct combination of fields, and how many."""
    return rows.groupBy(*key).agg(F.count_distinct(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("\\0")) for f in fields])).alias("kinds")).where("kinds > 1")


def budget_sweep(rows: DataFrame) -> DataFrame:
    """budget_id, problem of ``rows(budget_id, b)``: ids with several budgets, and a sweep of several ids that never changes."""
    per = rows.groupBy("budget_id").agg(F.min("b").alias("a"), F.max("b").alias("z"))
    own = per.where("a <> z").select("budget_id", F.lit("differs").alias("problem"))
    whole = per.agg(F.min("budget_id").alias("budget_id"), F.count("*").alias("n"), F.min("a").alias("a"), F.max("a").alias("z"))
    return own.unionByName(whole.where("n > 1 and a = z").select("budget_id", F.lit("never_changes").alias("problem")))
