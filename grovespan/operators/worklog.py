"""Operational logs: contracts, bindings, provider totals, reconciliation, lineage, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved
from .scores import poisoned_sum

OUTCOMES = ("accepted", "failed", "cancelled_before_start")


def problems(rows: DataFrame, key: list[str], **checks: Column) -> DataFrame:
    """key and codes: one row for each row that fails a check (a null check fails), with the codes in order."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return rows.withColumn("codes", codes).where(F.size("codes") > 0).select(*key, "codes")


def enforce(rows: DataFrame, **checks: Column) -> DataFrame:
    """``rows``; reading them fails at the first row that breaks a check."""
    for name, ok in checks.items():
        rows = rows.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"contract: {name}")).cast("boolean")))
    return rows


def attempt_problems(attempts: DataFrame) -> DataFrame:
    """Attempts that break the log's contract: outcome, usage and its subsets, time."""
    used = F.col("input_tokens").isNotNull()
    return problems(
        attempts, ["attempt_id"],
        outcome=F.col("outcome").isin(*OUTCOMES),
        usage_all_or_none=used == F.col("output_tokens").isNotNull(),
        cached_in_input=F.col("input_tokens").isNull() | (F.col("cached_tokens") <= F.col("input_tokens")),
        reasoning_in_output=F.col("reasoning_tokens").isNull() | (F.col("reasoning_tokens") <= F.col("output_tokens")),
        started=F.col("started_at").isNotNull() & (F.col("seconds") >= 0),
    )


def totals(prefix: str, where: Column) -> list[Column]:
    """Sums of provider tokens over the rows of ``where``: null (unknown) if one has no usage, 0 if there is none."""
    of = lambda c: F.when(where, F.col(c))
    lost = F.coalesce(F.bool_or(F.when(where, F.col("input_tokens").isNull())), F.lit(False))
    known = lambda c: F.when(~lost, F.coalesce(F.sum(of(c)), F.lit(0)))
    vague = lost | F.coalesce(F.bool_or(F.when(where, F.col("reasoning_tokens").isNull())), F.lit(False))
    return [
        known("input_tokens").alias(f"{prefix}_input"), known("cached_tokens").alias(f"{prefix}_cached"),
        (known("input_tokens") - known("cached_tokens")).alias(f"{prefix}_uncached"), known("output_tokens").alias(f"{prefix}_output"),
        F.when(~vague, F.coalesce(F.sum(of("reasoning_tokens")), F.lit(0))).alias(f"{prefix}_reasoning"),
    ]


def provider_totals(attempts: DataFrame, *by: str) -> DataFrame:
    return attempts.groupBy(*by).agg(*totals("provider", F.lit(True)))


def work(attempts: DataFrame, *by: str) -> DataFrame:
    """Accepted and observed totals, counts and latency of the log, in one aggregation."""
    started, accepted = F.col("outcome") != "cancelled_before_start", F.col("accepted")
    return attempts.groupBy(*by).agg(
        *totals("accepted", accepted), *totals("observed", started),
        F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(accepted).alias("materialized"),
        F.coalesce(F.sum(F.when(started, F.col("seconds"))), F.lit(0)).alias("latency"),
        F.coalesce(F.sum(F.when(started & ~accepted, F.col("seconds"))), F.lit(0)).alias("retry_latency"),
    )


def reconciled(attempts: DataFrame, *by: str) -> DataFrame:
    """Per run: totals by stage as columns, the judge's apart, and what retries cost (null where usage is unknown)."""
    stages = {"leaf": ("shared_leaf", "observed_leaf"), "merge": ("accepted_merge", "observed_merge"), "answer": ("accepted_answer", "observed_answer"), "judge": ("accepted_judge", "observed_judge")}
    started, accepted, own = F.col("outcome") != "cancelled_before_start", F.col("accepted"), F.col("stage") != "judge"
    columns = [c for stage, (a, o) in stages.items() for p, w in ((a, accepted), (o, started)) for c in totals(p, (F.col("stage") == stage) & w)]
    life = [*totals("life_accepted", own & accepted), *totals("life_observed", own & started), F.coalesce(F.sum(F.when(own & started & ~accepted, F.col("seconds"))), F.lit(0)).alias("retry_latency")]
    out = attempts.groupBy(*by).agg(*columns, *life)
    extra = F.col("life_observed_input") + F.col("life_observed_output") - F.col("life_accepted_input") - F.col("life_accepted_output")
    return out.withColumn("retry_tokens", extra).drop(*[f"life_{s}_{x}" for s in ("accepted", "observed") for x in ("input", "cached", "uncached", "output", "reasoning")])


def bindings(attempts: DataFrame) -> DataFrame:
    """The accepted attempt of each logical call: its last successful one."""
    ok = attempts.where("outcome = 'accepted'")
    return ok.groupBy("run_id", "stage", "logical_call_id").agg(F.max_by("attempt_id", F.struct("started_at", "attempt_id")).alias("attempt_id"))


def marked(attempts: DataFrame, bound: DataFrame) -> DataFrame:
    """``attempts`` with accepted, whether a binding names them."""
    return attempts.join(bound.select("attempt_id", F.lit(True).alias("accepted")), "attempt_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def stage_clock(attempts: DataFrame) -> DataFrame:
    """run_id, stage, wall: seconds from the first start to the last end, and the ratio of summed to wall time."""
    begin = F.unix_micros("started_at")
    end = begin + F.col("seconds") * 1_000_000
    out = attempts.where("outcome <> 'cancelled_before_start'").groupBy("run_id", "stage").agg(((F.max(end) - F.min(begin)) / 1e6).alias("wall"), F.sum("seconds").alias("busy"))
    return out.withColumn("parallelism", F.when(F.col("wall") > 0, F.col("busy") / F.col("wall")))


def merge_metrics(events: DataFrame) -> DataFrame:
    """Ratios of each merge from left, right and output tokens, its budget, spans and payload."""
    total = F.col("left_tokens") + F.col("right_tokens")
    ratio = lambda x, y: (x / y).cast("double")
    signed = F.when(F.col("left_hi") < F.col("right_lo"), ratio(F.col("left_tokens") - F.col("right_tokens"), total))
    return events.where(total > 0).select(
        "event_id", ratio(total, F.col("budget")).alias("pressure"), ratio(F.col("output_tokens"), total).alias("compression"), ratio(F.col("output_tokens"), F.col("budget")).alias("utilization"),
        ratio(F.col("payload_tokens"), F.col("budget")).alias("payload_ratio"), ratio(F.abs(F.col("left_tokens") - F.col("right_tokens")), total).alias("imbalance"), signed.alias("imbalance_signed"), (F.col("source") == "generated").alias("generative"),
    )


def shared_once(leaves: DataFrame, key: str = "content_id") -> DataFrame:
    """One row of each shared leaf; leaves whose rows disagree are an error."""
    others = [c for c in leaves.columns if c != key]
    kinds = leaves.groupBy(key).agg(F.min(F.struct(*others)).alias("a"), F.max(F.struct(*others)).alias("z"))
    return enforce(kinds, shared_leaf_rows_agree=F.col("a") == F.col("z")).select(key, "a.*")


def disagreeing(rows: DataFrame, key: list[str], *fields: str) -> DataFrame:
    """Keys whose rows do not all have the same fields, by extremes, so no group is gathered."""
    return rows.groupBy(*key).agg(F.min(F.struct(*fields)).alias("a"), F.max(F.struct(*fields)).alias("z")).where("a <> z").select(*key)


def overlap(rows: DataFrame, value: str, split: str = "split") -> DataFrame:
    """Values that occur in more than one split."""
    return rows.groupBy(value).agg(F.min(split).alias("a"), F.max(split).alias("z")).where("a <> z").select(value)


def usd(rows: DataFrame, input_rate: str, cached_rate: str, output_rate: str, fee: str = "0") -> DataFrame:
    """``rows`` with cost, decimal: tokens at rates per million and a fee per request; null where usage is unknown."""
    d = lambda x: F.lit(x).cast("decimal(20,6)")
    plain = (F.col("input_tokens") - F.col("cached_tokens")).cast("decimal(20,0)") * d(input_rate) + F.col("cached_tokens").cast("decimal(20,0)") * d(cached_rate) + F.col("output_tokens").cast("decimal(20,0)") * d(output_rate)
    return rows.withColumn("micro_usd", F.ceil(plain + d(fee) * 1_000_000).cast("bigint"))


def lifecycle_cost(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(poisoned_sum(F.col("micro_usd")).alias("c_life"))


def critical_path(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, finish: the longest sum of seconds of a chain that ends in the node.

    ``edges(parent, child)`` say that the parent waits for the child. Nodes that
    wait for one other are skipped by pointers that double their length, so a
    chain of n nodes takes log2(n) joins; the rest are levels, joins on the rows
    whose finish rose. A cycle is an error: pointers that do not end, or more levels
    than nodes that wait for several.
    """
    own = nodes.select("node", F.col("seconds").cast("bigint").alias("seconds"))
    edges = saved(edges.select("parent", "child").distinct())
    degree = edges.groupBy("parent").agg(F.count("*").alias("n"), F.min("child").alias("child"))
    jump = saved(degree.where("n = 1").join(own, F.col("parent") == F.col("node")).select("node", F.col("child").alias("at"), F.col("seconds").alias("total")))
    size = jump.count()
    for _ in range(size.bit_length() + 1):
        after = jump.select(F.col("node").alias("at"), F.col("at").alias("further"), F.col("total").alias("more"))
        both = jump.join(after, "at", "left")
        longer = saved(both.select("node", F.coalesce("further", "at").alias("at"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"), F.col("further").isNotNull().alias("moved")))
        jump = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    else:
        raise ValueError("the graph has a cycle")
    many = saved(degree.where("n > 1").select(F.col("parent").alias("node")))
    best = own.join(jump.select("node"), "node", "left_anti").select("node", F.col("seconds").alias("finish"))
    ends = jump.select(F.col("node").alias("child"), "at", "total")
    short = edges.join(many, F.col("parent") == F.col("node"), "left_semi").join(ends, "child", "left").select("parent", F.coalesce("at", "child").alias("child"), F.coalesce("total", F.lit(0)).alias("total"))
    short = saved(short.groupBy("parent", "child").agg(F.max("total").alias("total")))
    moved, best = best, saved(best)
    for _ in range(many.count() + 1):
        raised = moved.join(short, F.col("node") == F.col("child")).groupBy("parent").agg(F.max(F.col("finish") + F.col("total")).alias("before"))
        longer = raised.join(own, F.col("parent") == F.col("node")).select(F.col("parent").alias("node"), (F.col("before") + F.col("seconds")).alias("new"))
        moved = saved(longer.join(best, "node").where("new > finish").select("node", F.col("new").alias("finish")))
        if moved.isEmpty():
            break
        best = saved(best.join(moved.withColumnRenamed("finish", "new"), "node", "left").select("node", F.coalesce("new", "finish").alias("finish")))
    else:
        raise ValueError("the graph has a cycle")
    through = jump.join(best.withColumnRenamed("node", "at"), "at").select("node", (F.col("total") + F.col("finish")).alias("finish"))
    return best.unionByName(through)


def generative_lineage(artifacts: DataFrame, levels: int = 64) -> DataFrame:
    """node, generative: whether the first artifact that is no cache copy was generated. A chain that does not end is an error."""
    step = saved(artifacts.select("node", F.when(F.col("source") == "cache", F.col("cache_of")).alias("at"), (F.col("source") == "generated").alias("generative")))
    for _ in range(levels):
        if step.where("at is not null").isEmpty():
            return step.select("node", "generative")
        after = step.select(F.col("node").alias("at"), F.col("at").alias("further"), F.col("generative").alias("g"))
        step = saved(step.join(after, "at", "left").select("node", F.when(F.col("at").isNotNull(), F.col("further")).alias("at"), F.when(F.col("at").isNotNull(), F.coalesce("g", F.lit(False))).otherwise(F.col("generative")).alias("generative")))
    raise ValueError("the cache chain has a cycle")


def retrieval_stalled(attempts: DataFrame, routes: tuple[str, ...]) -> DataFrame:
    """Files for which a failed attempt is known on every route."""
    return attempts.where("not success").groupBy("file").agg(F.count_distinct(F.when(F.col("route").isin(*routes), F.col("route"))).alias("n")).where(F.col("n") == len(routes)).select("file")


def support_exposure(exposure: DataFrame, supports: DataFrame) -> DataFrame:
    """support_id, mean and largest rewrites and pressure over the distinct leaves of a support set, and the share without a leaf."""
    distinct = supports.select("support_id", "leaf").distinct()
    return distinct.join(exposure, "leaf", "left").groupBy("support_id").agg(
        F.avg("rewrites").alias("rewrites_mean"), F.max("rewrites").alias("rewrites_max"), F.avg("pressure_sum").alias("pressure_mean"), F.max("pressure_max").alias("pressure_max"), F.avg(F.col("rewrites").isNull().cast("int")).alias("unresolved"))


def unique_attempts(rows: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """The first row of each combination of fields."""
    first = Window.partitionBy(*fields).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
