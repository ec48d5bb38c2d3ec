"""Score aggregation, lifecycle sums and the three quantile rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIMARY = ("left_deep", "canonical_balanced")
DIAGNOSTIC = ("left_deep", "canonical_balanced", "right_deep")


def macro_scores(rows: DataFrame) -> DataFrame:
    """Mean over queries within an episode, then over episodes, per plan and replicate: two levels, both pre-aggregated."""
    keys = [c for c in ("budget", "plan_id", "replicate_id") if c in rows.columns]
    return rows.groupBy("episode_id", *keys).agg(F.avg("score").alias("score")).groupBy(*keys).agg(F.avg("score").alias("score"), F.count("*").alias("episodes"))


def plan_quality(rows: DataFrame) -> DataFrame:
    """Mean of the macro scores over replicates, per plan (and budget)."""
    keys = [c for c in ("budget", "plan_id") if c in rows.columns]
    return macro_scores(rows).groupBy(*keys).agg(F.avg("score").alias("quality"))


def task_quality(rows: DataFrame, plans: tuple[str, ...]) -> DataFrame:
    q = plan_quality(rows).where(F.col("plan_id").isin(*plans))
    return q.agg(F.avg("quality").alias("q_mean"), F.min("quality").alias("q_worst"), F.max("quality").alias("q_best"))


def _of(plan: str) -> Column:
    return F.max(F.when(F.col("plan_id") == plan, F.col("quality")))


def delta_primary(rows: DataFrame) -> DataFrame:
    return plan_quality(rows).agg((_of("canonical_balanced") - _of("left_deep")).alias("delta"))


def diagnostic_range(rows: DataFrame) -> DataFrame:
    return plan_quality(rows).where(F.col("plan_id").isin(*DIAGNOSTIC)).agg((F.max("quality") - F.min("quality")).alias("range"))


def poisoned_sum(value: Column) -> Column:
    """A sum that is null as soon as one value is (Spark's own skips nulls)."""
    return F.when(F.coalesce(F.bool_or(value.isNull()), F.lit(False)), F.lit(None)).otherwise(F.coalesce(F.sum(value), F.lit(0)))


def rank_quantile(rows: DataFrame, keys: list[str], value: str, fraction: float, name: str) -> DataFrame:
    """The value at index half-even round of (n - 1) * fraction, by an exact count per value, so no group is gathered as rows.

    Counts of equal values are summed before the shuffle; the running total per
    group then goes over distinct values only.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys).orderBy(value)
    total = F.sum("c").over(Window.partitionBy(*keys))
    upto = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.bround((total - 1) * F.lit(fraction), 0).cast("bigint")
    return per.select(*keys, F.col(value), upto.alias("upto"), at.alias("at")).where("upto > at").groupBy(*keys).agg(F.min(value).alias(name))


def nearest_rank(value: str, fraction: float) -> Column:
    """The smallest value with at least this share of rows at or below it."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {value})")


def quantiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, min, p50, p95 (index rule), max and mean per group."""
    base = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    p50, p95 = rank_quantile(rows, keys, value, 0.5, "p50"), rank_quantile(rows, keys, value, 0.95, "p95")
    return base.join(p50, keys, "left").join(p95, keys, "left")


def stratum_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))
