"""Inference: permutation, seed null, power simulation, intervals, decisions.

Random draws are functions of a seed and the row's identity (SHA-256), so they do
not depend on partitioning, order or retries.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Z = 1.959963984540054
DISCORDANCE = (0.10, 0.15, 0.25, 0.40)
SIMULATION_EFFECTS = (-0.15, -0.125, -0.10, -0.075, -0.05, -0.025, 0.0, 0.025, 0.05, 0.075, 0.10, 0.125, 0.15)
POWER_DRAWS = 1000
DECISION_GRID = (0.05, 0.075, 0.10, 0.125, 0.15)
LEFT = 0.65


def draw(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the hash of ``seed:key:key``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def paired_differences(rows: DataFrame, a: str = "left_deep", b: str = "canonical_balanced") -> DataFrame:
    """episode_id, diff: mean over replicates of b less a, where both exist."""
    means = rows.groupBy("episode_id", "replicate_id").agg(F.avg(F.when(F.col("plan_id") == a, F.col("score"))).alias("a"), F.avg(F.when(F.col("plan_id") == b, F.col("score"))).alias("b"))
    return means.where("a is not null and b is not null").groupBy("episode_id").agg(F.avg(F.col("b") - F.col("a")).alias("diff"))


def permutation_test(diffs: DataFrame, permutations: int, seed: int) -> DataFrame:
    """One row: delta, p_value, independent_blocks.

    The sign of episode e in permutation p is bit p mod 256 of the SHA-256 of
    ``seed:block:e`` with block p div 256. Each batch of episodes adds to a vector
    of all permutations' sums, so no row per episode and permutation is made.
    """
    blocks = -(-permutations // 256)

    def run(batches):
        total, seen = np.zeros(blocks * 256), False
        for batch in batches:
            ids, diff = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for a in range(0, len(ids), 1000):
                raw = b"".join(hashlib.sha256(f"{seed}:{k}:{e}".encode()).digest() for e in ids[a : a + 1000] for k in range(blocks))
                bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, blocks * 256)
                total += diff[a : a + 1000] @ (1.0 - 2.0 * bits)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(permutations)), pa.array(total[:permutations])], ["p", "s"])

    base = diffs.agg(F.avg("diff").alias("delta"), F.count("*").alias("independent_blocks"))
    sums = diffs.select(F.col("episode_id").cast("string"), "diff").mapInArrow(run, "p bigint, s double").groupBy("p").agg(F.sum("s").alias("s"))
    hits = sums.crossJoin(F.broadcast(base)).agg(F.count_if(F.abs(F.col("s") / F.col("independent_blocks")) >= F.abs("delta") - F.lit(1e-12)).alias("hits"))
    return base.crossJoin(hits).select("delta", ((F.col("hits") + 1) / F.lit(float(permutations + 1))).alias("p_value"), "independent_blocks")


def seed_null(run_means: DataFrame, repeats: int, draws: int, seed: int) -> DataFrame:
    """draw, statistic: |mean of ``repeats`` drawn runs less that of ``repeats`` others|; a mean over episodes is linear, so run means suffice."""
    runs = run_means.select(F.row_number().over(Window.orderBy("replicate_id")).alias("i"), "mean", F.count("*").over(Window.partitionBy()).alias("n"))
    n = runs.agg(F.max("n").alias("n"))
    picks = runs.sparkSession.range(1, draws + 1).withColumnRenamed("id", "draw").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).crossJoin(F.broadcast(n))
    picks = picks.withColumn("i", (F.floor(draw(seed, F.col("draw"), F.col("side"), F.col("r")) * F.col("n")) + 1).cast("int"))
    sides = picks.join(F.broadcast(runs.select("i", "mean")), "i").groupBy("draw").agg(F.avg(F.when(F.col("side") == 1, F.col("mean"))).alias("b"), F.avg(F.when(F.col("side") == 0, F.col("mean"))).alias("a"))
    return sides.select("draw", F.abs(F.col("b") - F.col("a")).alias("statistic"))


def strata_design(strata: DataFrame) -> DataFrame:
    """weight of each stratum and its effect multiplier, whose weighted mean is 1."""
    kind = F.when(F.col("question_type") == "knowledge-update", 0.95).otherwise(1.05)
    support = F.when(F.col("support_class") == "single", 0.90).otherwise(1.10)
    place = F.when(F.col("position_bin") == "early", 0.90).when(F.col("position_bin") == "late", 1.10).otherwise(1.0)
    every = Window.partitionBy()
    w = strata.withColumn("weight", F.col("n") / F.sum("n").over(every)).withColumn("factor", kind * support * place)
    return w.withColumn("multiplier", F.col("factor") / F.sum(F.col("weight") * F.col("factor")).over(every)).drop("factor")


def difference_probabilities(effect: Column, discordance: Column, flip: float = 0.05) -> Column:
    """struct(minus, zero, plus): chances that balanced less left is -1, 0, 1 after the judge's flips.

    With flips of rate f on both sides, an observed +1 comes from (1, 0) unflipped,
    from (0, 1) flipped twice, and from equal outcomes of which one flipped.
    """
    right = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(LEFT) + effect))
    gap = right - F.lit(LEFT)
    most = F.least(F.lit(LEFT) + right, F.lit(2.0 - LEFT) - right)
    apart = F.least(most, F.greatest(F.abs(gap), discordance))
    up, down = (apart + gap) / 2, (apart - gap) / 2
    same = F.lit(1.0) - up - down
    keep, twice, once = (1 - flip) ** 2, flip**2, flip * (1 - flip)
    plus, minus = up * keep + down * twice + same * once, down * keep + up * twice + same * once
    return F.struct(minus.alias("minus"), (F.lit(1.0) - plus - minus).alias("zero"), plus.alias("plus"))


def repeated_distribution(one: DataFrame, repeats: int = 5) -> DataFrame:
    """``one`` (with column p of ``difference_probabilities``) by difference: probability and running total of the sum of ``repeats`` draws.

    Trinomial: the chance of u ups and d downs is R!/(u! d! (R-u-d)!) of the powers.
    """
    keys = [c for c in one.columns if c != "p"]
    grid = one.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(repeats)))).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(repeats) - F.col("u"))))
    ways = F.factorial(F.lit(repeats)) / (F.factorial("u") * F.factorial("d") * F.factorial(F.lit(repeats) - F.col("u") - F.col("d")))
    chance = ways * F.pow(F.col("p.plus"), F.col("u")) * F.pow(F.col("p.minus"), F.col("d")) * F.pow(F.col("p.zero"), F.lit(repeats) - F.col("u") - F.col("d"))
    by = grid.groupBy(*keys, (F.col("u") - F.col("d")).alias("difference")).agg(F.sum(chance).alias("probability"))
    order = Window.partitionBy(*keys).orderBy("difference").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.when(F.col("difference") == repeats, F.lit(1.0)).otherwise(F.sum("probability").over(order))
    return by.withColumn("cumulative", upto)


def wilson(successes: Column, trials: Column) -> Column:
    """struct(lower, upper) of the two-sided 95 % Wilson interval, within [0, 1]."""
    p, z2 = successes / trials, Z * Z
    below = 1 + F.lit(z2) / trials
    center = (p + F.lit(z2) / (2 * trials)) / below
    margin = F.lit(Z) * F.sqrt(p * (1 - p) / trials + F.lit(z2) / (4 * trials * trials)) / below
    return F.struct(F.greatest(F.lit(0.0), center - margin).alias("lower"), F.least(F.lit(1.0), center + margin).alias("upper"))


def scenario_grid(spark: SparkSession, effects: tuple[float, ...], discordances: tuple[float, ...] = DISCORDANCE) -> DataFrame:
    a = spark.createDataFrame([(float(e),) for e in effects], "effect double")
    return a.crossJoin(spark.createDataFrame([(float(d),) for d in discordances], "discordance double"))


def power(spark: SparkSession, design: DataFrame, scenarios: DataFrame, n: int, draws: int, seed: int, repeats: int = 5) -> DataFrame:
    """Monte-Carlo detection rate and its Wilson interval for each scenario of (effect, discordance).

    An episode falls in a stratum by its weight and then has the stratum's
    difference; so its difference has the strata's distributions mixed by weight,
    and one draw per scenario, draw and episode is compared with its 2R limits. The
    table of limits is one row per scenario, a fixed small number. A draw detects if
    |sum| / sqrt(sum of squares) exceeds the normal quantile.
    """
    strata = design.select("question_type", "support_class", "position_bin", "multiplier", "weight")
    cells = scenarios.crossJoin(strata).withColumn("p", difference_probabilities(F.col("effect") * F.col("multiplier"), F.col("discordance")))
    table = repeated_distribution(cells.drop("multiplier"), repeats)
    mixed = table.groupBy("effect", "discordance", "difference").agg(F.sum(F.col("weight") * F.col("probability")).alias("probability"))
    order = Window.partitionBy("effect", "discordance").orderBy("difference").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = mixed.withColumn("upto", F.sum("probability").over(order))
    limits = [F.max(F.when(F.col("difference") == d, F.col("upto"))).alias(f"t{d + repeats}") for d in range(-repeats, repeats)]
    lookup = upto.groupBy("effect", "discordance").agg(*limits)
    drawn = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(lookup)).withColumn("episode", F.explode(F.sequence(F.lit(1), F.lit(n))))
    v = draw(seed, F.lit("d"), "effect", "discordance", "draw", "episode")
    above = [(F.col("v") > F.col(f"t{k}")).cast("int") for k in range(2 * repeats)]
    x = drawn.withColumn("v", v).withColumn("x", functools.reduce(lambda p, q: p + q, above, F.lit(-repeats)))
    sums = x.groupBy("effect", "discordance", "draw").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    hit = (F.col("q") > 0) & (F.abs("s") / F.sqrt("q") > Z)
    out = sums.groupBy("effect", "discordance").agg(F.count_if(hit).alias("detected"), F.count("*").alias("draws"))
    rates = out.withColumn("power", F.col("detected") / F.col("draws")).withColumn("interval", wilson(F.col("detected"), F.col("draws")))
    return rates.select("effect", "discordance", "detected", "draws", "power", F.col("interval.lower").alias("lower"), F.col("interval.upper").alias("upper"))


def choose_design(rates: DataFrame, least: float = 0.80) -> DataFrame:
    """One row: the first design, by candidate and then by delta, whose worst scenario has its lower bound at ``least`` or more, and the best of all.

    ``rates(candidate, effect, lower, power)``; equal best bounds go to the first design.
    """
    sized = rates.withColumn("delta", F.round(F.abs("effect"), 6)).where(F.col("delta").isin(*DECISION_GRID))
    worst = sized.groupBy("candidate", "delta").agg(F.min("lower").alias("lower"), F.min("power").alias("power"))
    first = F.min(F.when(F.col("lower") >= least, F.struct("candidate", "delta", "power", "lower")))
    best = F.min(F.struct((-F.col("lower")).alias("below"), "candidate", "delta"))
    one = worst.agg(first.alias("first"), best.alias("best"))
    status = F.when(F.col("first").isNull(), "blocked").otherwise("passed")
    return one.select(status.alias("status"), "first.*", F.col("best.candidate").alias("best_candidate"), F.col("best.delta").alias("best_delta"), (-F.col("best.below")).alias("best_lower"))


def classify_null(power_: Column, excludes: Column, significant: Column) -> Column:
    return F.when(significant, "go_candidate").when((power_ >= 0.80) & excludes, "equivalence_candidate").otherwise("inconclusive")


#: Running chances of 0, 1, 2 ... of a Poisson law of mean 1.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712)


def bootstrap_interval(diffs: DataFrame, draws: int, seed: int) -> DataFrame:
    """Episode-clustered 95 % interval of the mean difference, by Poisson(1) weights, which need no central resampling.

    The weight of episode e in draw b is how many of the running chances are below
    (word + 0.5) / 65536, of the 16-bit word b mod 16 of the SHA-256 of ``seed:b div 16:e``.
    Each batch of episodes adds to vectors of all draws' sums.
    """
    blocks = -(-draws // 16)

    def run(batches):
        weights, sums, seen = np.zeros(blocks * 16), np.zeros(blocks * 16), False
        for batch in batches:
            ids, diff = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for a in range(0, len(ids), 1000):
                raw = b"".join(hashlib.sha256(f"{seed}:{k}:{e}".encode()).digest() for e in ids[a : a + 1000] for k in range(blocks))
                words = np.frombuffer(raw, ">u2").reshape(-1, blocks * 16)
                own = np.searchsorted(np.array(POISSON), (words + 0.5) / 65536).astype(float)
                weights += own.sum(0)
                sums += diff[a : a + 1000] @ own
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(weights[:draws]), pa.array(sums[:draws])], ["b", "w", "s"])

    each = diffs.select(F.col("episode_id").cast("string"), F.col("diff").cast("double")).mapInArrow(run, "b bigint, w double, s double").groupBy("b").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    return each.agg(F.expr("percentile_disc(0.025) WITHIN GROUP (ORDER BY m)").alias("lower"), F.expr("percentile_disc(0.975) WITHIN GROUP (ORDER BY m)").alias("upper"))


def repeatability(observations: DataFrame, replicates: int = 3) -> DataFrame:
    """One row: unanimity, pairwise flip and parse rates, and whether they pass (0.95, 0.05, 1)."""
    case = observations.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if("parsed").alias("parsed"), F.count_if((F.col("label") == 1) & F.col("parsed")).alias("ones"), F.count_if((F.col("label") == 0) & F.col("parsed")).alias("zeros"))
    pairs = replicates * (replicates - 1) // 2
    out = case.agg(
        F.avg(((F.col("ones") == replicates) | (F.col("zeros") == replicates)).cast("int")).alias("unanimity"),
        F.avg(F.col("ones") * F.col("zeros") / F.lit(float(pairs))).alias("flip"), (F.sum("parsed") / F.sum("n")).alias("parse"))
    return out.withColumn("passes", (F.col("unanimity") >= 0.95) & (F.col("flip") <= 0.05) & (F.col("parse") == 1.0))


def normal_p_value(total: float, squares: float, n: int) -> float:
    """Two-sided p of a sum under sign flips, by the normal law; 1 for fewer than two or only zeros."""
    return 1.0 if n < 2 or squares == 0 else math.erfc(abs(total) / math.sqrt(squares) / math.sqrt(2.0))


def formal_no_go_allowed(*flags: str) -> Column:
    """Whether every one of the conditions of a formal no-go holds (null does not)."""
    out = F.lit(True)
    for f in flags:
        out &= F.coalesce(F.col(f), F.lit(False))
    return out
