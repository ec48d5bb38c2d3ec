"""Call counts and cost bounds of a full experiment, as products of its axes."""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The budgets of the envelope (eleven points) and the token caps of a call.
BUDGET_POINTS = 11
INPUT_CAP, GENERATION_CAP, JUDGE_CAP = 1_000_000, 4_096, 128
BILLED = 2


def _pairs(k: int) -> int:
    return k * (k - 1) // 2


def axes(episodes: int, calibration: int, repeats: int, budgets: int = BUDGET_POINTS, k: int = 8, sweep: tuple[int, ...] = (4, 8, 16)) -> list[tuple[str, str, str, int]]:
    """component, role, part, calls: each part is one product of the axes it runs over."""
    run = lambda n, plans, times: n * plans * budgets * times  # noqa: E731  answers of n episodes
    pilot, formal, online = run(calibration, 3, 3), run(episodes, 3, repeats), run(episodes, 2, repeats)
    rows = [
        ("primary", "generation", "leaves", (calibration + episodes) * k),
        ("primary", "generation", "merges", (pilot + formal) * (k - 1) + online * _pairs(k)),
        ("primary", "generation", "answers", pilot + formal + online * k),
        ("primary", "judge", "answers", pilot + 2 * formal + online * k),
        ("replication", "generation", "leaves", episodes * k),
        ("replication", "generation", "merges", online * (k - 1)),
        ("replication", "generation", "answers", online),
        ("replication", "judge", "answers", online),
        ("SATURATION", "generation", "answers", calibration * (1 + budgets) * repeats),
        ("SATURATION", "judge", "answers", calibration * (1 + budgets) * repeats),
        ("D_leaf", "generation", "all", 1_600),
        ("D_leaf", "judge", "all", 100),
    ]
    for x in sweep:
        rows += [("future_k_sweep", "generation", f"k{x}", 2 * (episodes * x + formal * (x - 1) + formal)), ("future_k_sweep", "judge", f"k{x}", 2 * formal)]
    return rows


def envelope(spark: SparkSession, episodes: int = 199, calibration: int = 60, repeats: int = 5) -> DataFrame:
    """component, role, logical, billable, input_tokens, output_tokens."""
    rows = spark.createDataFrame(axes(episodes, calibration, repeats), "component string, role string, part string, calls bigint")
    out = rows.groupBy("component", "role").agg(F.sum("calls").alias("logical")).withColumn("billable", F.col("logical") * BILLED)
    return out.withColumn("input_tokens", F.col("billable") * INPUT_CAP).withColumn("output_tokens", F.col("billable") * F.when(F.col("role") == "judge", JUDGE_CAP).otherwise(GENERATION_CAP))


def envelopes(counts: DataFrame, repeats: int = 5) -> DataFrame:
    """``envelope`` for every row of ``counts(corpus, episodes, calibration)``."""
    parts = axes(F.col("episodes"), F.col("calibration"), repeats)
    each = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(r).alias("role"), (F.lit(n) if isinstance(n, int) else n).cast("bigint").alias("calls")) for c, r, _, n in parts])
    rows = counts.select("corpus", F.explode(each).alias("x")).select("corpus", "x.*")
    out = rows.groupBy("corpus", "component", "role").agg(F.sum("calls").alias("logical")).withColumn("billable", F.col("logical") * BILLED)
    return out.withColumn("input_tokens", F.col("billable") * INPUT_CAP).withColumn("output_tokens", F.col("billable") * F.when(F.col("role") == "judge", JUDGE_CAP).otherwise(GENERATION_CAP))


def priced(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """``calls`` with micro_usd, rounded up, at ``rates(component, role, input, output)`` in USD per million tokens; a missing rate is an error."""
    both = calls.join(rates, ["component", "role"], "left")
    exact = F.col("input_tokens").cast("decimal(20,0)") * F.col("input") + F.col("output_tokens").cast("decimal(20,0)") * F.col("output")
    return both.withColumn("micro_usd", F.when(F.col("input").isNull(), F.raise_error(F.lit("rate missing")).cast("bigint")).otherwise(F.ceil(exact).cast("bigint"))).drop("input", "output")


def price_rates(models: DataFrame, quota_per_unit: str = "500000") -> DataFrame:
    """model, input, output: USD per million tokens = ratio x largest group ratio x 10^6 / quota; output times the completion ratio."""
    d = lambda c: F.col(c).cast("decimal(18,6)")
    best = F.array_max(F.map_values("group_ratio")).cast("decimal(18,6)")
    base = (d("model_ratio") * best * F.lit(1_000_000) / F.lit(Decimal(quota_per_unit))).cast("decimal(20,6)")
    return models.select("model_name", base.alias("input"), (base * d("completion_ratio")).cast("decimal(20,6)").alias("output"))


def micro_usd(amount: Decimal) -> int:
    return int((amount * 1_000_000).to_integral_value(ROUND_CEILING))


def gate(stages: DataFrame, required: tuple[str, ...], *keys: str) -> DataFrame:
    """keys, stage, position, open: a stage is open if it and all before it have passed, in the fixed order, each bound to the hash of the one before."""
    from pyspark.sql import Window

    names = F.array(*[F.lit(s) for s in required])
    placed = stages.select(*keys, "stage", F.array_position(names, F.col("stage")).cast("int").alias("position"), "status", "hash", "upstream_hash").where("position > 0")
    order = Window.partitionBy(*keys).orderBy("position")
    before = F.lag("hash").over(order)
    ok = (F.col("status") == "passed") & (F.col("position") == F.row_number().over(order)) & ((F.col("position") == 1) | (F.col("upstream_hash") == before))
    checked = placed.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return checked.select(*keys, "stage", "position", F.bool_and("ok").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("open"))
