"""Frozen formulas over scores, budgets and call logs: fit, load, saturation, decisions, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESOI = 0.05


def raw_fit(episodes: DataFrame, budgets: tuple[int, ...]) -> DataFrame:
    """budget, fit: share of episodes whose evidence fits the budget as it is, in one pass over ``episodes(tokens)``."""
    shares = episodes.agg(*[F.avg((F.col("tokens") <= b).cast("int")).alias(str(b)) for b in budgets])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.col(str(b)).alias("fit")) for b in budgets])).alias("x")).select("x.*")


def leaf_load(leaves: DataFrame, budgets: tuple[int, ...]) -> DataFrame:
    """budget, p25, p50, p75 of leaf tokens over budget (nearest rank)."""
    at = lambda b: [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY tokens)").alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    one = leaves.agg(*at(0))
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), *[(F.col(p) / b).alias(p) for p in ("p25", "p50", "p75")]) for b in budgets])).alias("x")).select("x.*")


def chosen_budgets(fit: DataFrame, targets: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """target, budget: the smallest budget whose fit is nearest to each target."""
    t = fit.select("budget", "fit", F.explode(F.array(*[F.lit(x) for x in targets])).alias("target"))
    return t.groupBy("target").agg(F.min_by("budget", F.struct(F.abs(F.col("fit") - F.col("target")), F.col("budget"))).alias("budget"))


def saturation(rows: DataFrame) -> DataFrame:
    """``rows(full, memory)`` with gap and class: a gap over 0.02, a ceiling at 0.95 or more, or parity."""
    gap = F.col("full") - F.col("memory")
    kind = F.when(F.col("memory") >= 0.95, "ceiling").when(gap > 0.02, "gap").otherwise("parity")
    return rows.withColumn("gap", gap).withColumn("class", kind)


def win_tie_loss(diffs: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    return diffs.agg(F.count_if(F.col("diff") > tolerance).alias("wins"), F.count_if(F.abs("diff") <= tolerance).alias("ties"), F.count_if(F.col("diff") < -tolerance).alias("losses"))


def decision(rows: DataFrame) -> DataFrame:
    """``rows(delta, p_value, delta_decision, ci_excludes_zero, judge_passes, violations)`` with the band of the result."""
    size = F.abs("delta")
    go = (F.col("p_value") < 0.05) & (size >= F.col("delta_decision")) & F.col("ci_excludes_zero") & F.col("judge_passes") & (F.col("violations") == 0)
    return rows.withColumn("band", F.when(go, "go").when((size >= SESOI) & (size < F.col("delta_decision")), "undecidable").otherwise("no_signal"))


def pareto(rows: DataFrame, keys: list[str], cost: str, quality: str) -> DataFrame:
    """Rows that no other of their group beats: none is as cheap and as good, and better in one."""
    order = Window.partitionBy(*keys).orderBy(cost, F.desc(quality)).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(quality).over(order)
    return rows.withColumn("_best", best).where(F.col("_best").isNull() | (F.col(quality) > F.col("_best"))).drop("_best")


def plan_seed_range(rows: DataFrame) -> DataFrame:
    """plan_id, range: spread of a plan's mean score over its replicates."""
    means = rows.groupBy("plan_id", "replicate_id").agg(F.avg("score").alias("m"))
    return means.groupBy("plan_id").agg((F.max("m") - F.min("m")).alias("range"))


def call_rollup(calls: DataFrame, *by: str) -> DataFrame:
    """calls, successes, error_rate and the nearest-rank p95 latency, and whether the limits (0.05, 180 s) hold."""
    out = calls.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if("ok").alias("successes"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY seconds)").alias("p95"))
    rate = (F.col("calls") - F.col("successes")) / F.col("calls")
    return out.withColumn("error_rate", rate).withColumn("passes", (rate <= 0.05) & (F.col("p95") <= 180))


def stall_cause(statuses: DataFrame, rules: list[tuple[str, str]], *by: str) -> DataFrame:
    """The first rule (name, pattern) that any error text of the group matches, else ``unknown``."""
    hits = statuses.groupBy(*by).agg(*[F.bool_or(F.coalesce(F.lower("error").rlike(p), F.lit(False))).alias(f"_{i}") for i, (_, p) in enumerate(rules)])
    return hits.select(*by, F.coalesce(*[F.when(F.col(f"_{i}"), F.lit(n)) for i, (n, _) in enumerate(rules)], F.lit("unknown")).alias("cause"))


def paired_effect(rows: DataFrame) -> DataFrame:
    """pairs, effect: mean difference of the two plans over the units that have both."""
    side = lambda p: F.avg(F.when(F.col("plan_id") == p, F.col("score")))
    both = rows.groupBy("unit_id").agg(side("left_deep").alias("a"), side("canonical_balanced").alias("b")).where("a is not null and b is not null")
    return both.agg(F.count("*").alias("pairs"), F.avg(F.col("b") - F.col("a")).alias("effect"))


def _kind(v: Column, path: str) -> Column:
    """The type of a field of a VARIANT: null where it is missing, VOID where it is null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _string(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def response_text(payload: Column) -> Column:
    """The text of a model's reply in any of three shapes: ``output_text``, the parts of ``output``, or the first choice's message; null if there is none."""
    v = F.try_parse_json(payload)
    items = F.when(_kind(v, "$.output").startswith("ARRAY"), F.try_variant_get(v, "$.output", "array<variant>"))

    def texts(item: Column) -> Column:
        parts = F.transform(F.try_variant_get(item, "$.content", "array<variant>"), lambda p: _string(p, "$.text"))
        return F.when(_kind(item, "$.content").startswith("ARRAY"), F.array_compact(parts)).otherwise(F.array_compact(F.array(_string(item, "$.text"))))

    joined = F.coalesce(F.flatten(F.transform(items, texts)), F.array().cast("array<string>"))
    return F.coalesce(_string(v, "$.output_text"), F.when(F.size(joined) > 0, F.array_join(joined, "")), _string(v, "$.choices[0].message.content"))


def usage(payload: Column) -> Column:
    """struct(input, cached, output, reasoning) of a reply in either shape; the first name that is there counts, null fields are unknown and other types than numbers null."""
    v = F.try_parse_json(payload)

    def first(*paths: str) -> Column:
        out = F.lit(None).cast("bigint")
        for path in reversed(paths):
            number = F.when(_kind(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, path, "double").cast("bigint"))
            out = F.when(_kind(v, path).isNotNull(), number).otherwise(out)
        return out

    return F.struct(
        first("$.usage.input_tokens", "$.usage.prompt_tokens").alias("input"), first("$.usage.input_tokens_details.cached_tokens", "$.usage.prompt_tokens_details.cached_tokens").alias("cached"),
        first("$.usage.output_tokens", "$.usage.completion_tokens").alias("output"), first("$.usage.output_tokens_details.reasoning_tokens", "$.usage.completion_tokens_details.reasoning_tokens").alias("reasoning"))


def usage_available(used: Column) -> Column:
    """Whether ``usage`` has both the input and the output tokens."""
    return used["input"].isNotNull() & used["output"].isNotNull()


def response_hash(raw: Column) -> Column:
    """The recorded hash of an attempt's reply (JSON text) under either of two names; null where the one that counts is no text."""
    v = F.try_parse_json(raw)
    own = F.try_variant_get(v, "$.response_hash", "variant")
    empty = own.isNull() | F.coalesce((F.schema_of_variant(own) == "VOID") | F.to_json(own).isin('""', "0", "false", "[]", "{}"), F.lit(False))
    return F.when(~empty, _string(v, "$.response_hash")).otherwise(_string(v, "$.response_sha256"))
