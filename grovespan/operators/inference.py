"""Tail chances and quantiles of the normal law as columns, the analytic power screen, and tests over three plans.

``erfc`` and ``normal_quantile`` are rational approximations in column arithmetic, with
errors below 1e-14 and 1e-15 relative to the larger of 1 and the value; no Python runs.
The tests read each block once and keep a vector of all permutations' or draws' sums per
task, so no row per block and permutation is made.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import DISCORDANCE, Z
from .stats import draw as chance

# Coefficients of the rational approximations, from the highest power down.
ERF_SMALL = ((1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERFC_LARGE = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))
QUANTILE_CENTER = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
QUANTILE_SIDE = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
QUANTILE_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)
ROOT_PI = 1.7724538509055160273


def _ratio(x: Column, both: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    def poly(c):
        out = F.lit(c[0])
        for k in c[1:]:
            out = out * x + F.lit(k)
        return out

    return poly(both[0]) / poly(both[1])


def erfc(x: Column) -> Column:
    """The complementary error function of a double."""
    y = F.abs(x)
    small = F.lit(1.0) - y * _ratio(y * y, ERF_SMALL)
    coarse = F.floor(y * 16) / F.lit(16.0)
    decay = F.exp(-coarse * coarse) * F.exp(-(y - coarse) * (y + coarse))
    inverse = F.lit(1.0) / (y * y)
    large = decay * (F.lit(1.0 / ROOT_PI) - inverse * _ratio(inverse, ERFC_LARGE)) / y
    tail = F.when(y <= 0.46875, small).when(y <= 4.0, decay * _ratio(y, ERFC_MIDDLE)).when(y < 27.0, large).otherwise(F.lit(0.0))
    return F.when(x.isNull(), None).when(x < 0, F.lit(2.0) - tail).otherwise(tail)


def normal_below(x: Column) -> Column:
    """The chance that a standard normal value is below ``x``."""
    return erfc(-x / F.lit(2.0**0.5)) / 2


def normal_quantile(p: Column) -> Column:
    """The value below which a standard normal value is with chance ``p``; null outside of (0, 1)."""
    q = p - F.lit(0.5)
    far = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    side = F.when(far <= 5.0, _ratio(far - F.lit(1.6), QUANTILE_SIDE)).otherwise(_ratio(far - F.lit(5.0), QUANTILE_FAR))
    inside = F.when(F.abs(q) <= 0.425, q * _ratio(F.lit(0.180625) - q * q, QUANTILE_CENTER)).when(q < 0, -side).otherwise(side)
    return F.when((p > 0) & (p < 1), inside)


def sign_flip_p_value(total: Column, squares: Column, n: Column) -> Column:
    """Two-sided p of a sum under sign flips, by the normal law; 1 for fewer than two or only zeros."""
    z = F.abs(total) / F.sqrt(F.when(squares > 0, squares))
    return F.when((n < 2) | (squares == 0), F.lit(1.0)).otherwise(erfc(z / F.lit(2.0**0.5)))


def analytic_power(candidates: DataFrame, effect: float = 0.05, power: float = 0.8) -> DataFrame:
    """``candidates(candidate, n)`` for every discordance: approximate power for an effect of paired outcomes, and the least effect of that power."""
    rows = candidates.withColumn("discordance", F.explode(F.array(*[F.lit(float(d)) for d in DISCORDANCE])))
    center = F.lit(effect) * F.sqrt("n") / F.sqrt(F.col("discordance") - F.lit(effect**2))
    chance = normal_below(center - F.lit(Z)) + normal_below(-center - F.lit(Z))
    least = (F.lit(Z) + normal_quantile(F.lit(power))) * F.sqrt(F.col("discordance") / F.col("n"))
    return rows.select("candidate", "n", "discordance", F.when(F.col("n") > 0, chance).alias("power"), F.when(F.col("n") > 0, least).alias("least_effect"))


ORDERS = np.array(list(itertools.permutations(range(3))))


def omnibus_test(blocks: DataFrame, permutations: int, seed: int) -> DataFrame:
    """One row: spread (largest less least plan mean), p_value, blocks; of ``blocks(block, a, b, c)``, the scores of three plans.

    In each permutation every block orders its three scores anew, by one of six orders.
    Order number of permutation p in a block: the 16-bit word p mod 16 of the SHA-256 of
    ``seed:p div 16:block``, times 6, over 65536, rounded down.
    """
    hashes = -(-permutations // 16)

    def run(batches):
        sums, seen = np.zeros((hashes * 16, 3)), 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            scores = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1)
            for name, own in zip(names, scores):
                raw = b"".join(hashlib.sha256(f"{seed}:{k}:{name}".encode()).digest() for k in range(hashes))
                sums += own[ORDERS[np.frombuffer(raw, ">u2").astype(np.int64) * 6 >> 16]]
            seen += len(names)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(permutations)), *(pa.array(sums[:permutations, k]) for k in range(3))], ["p", "a", "b", "c"])

    known = blocks.where("a is not null and b is not null and c is not null").select(F.col("block").cast("string").alias("block"), *[F.col(x).cast("double").alias(x) for x in "abc"])
    spread = F.greatest("a", "b", "c") - F.least("a", "b", "c")
    base = known.agg(*[F.sum(x).alias(x) for x in "abc"], F.count("*").alias("blocks")).select(spread.alias("spread"), "blocks")
    sums = known.mapInArrow(run, "p bigint, a double, b double, c double").groupBy("p").agg(*[F.sum(x).alias(x) for x in "abc"]).select(spread.alias("s"))
    # One row beside one row per permutation.
    hits = sums.join(F.broadcast(base), F.col("s") >= F.col("spread") - F.lit(1e-9)).agg(F.count("*").alias("hits"))
    both = base.withColumn("k", F.lit(1)).join(hits.withColumn("k", F.lit(1)), "k")
    return both.where("blocks > 0").select((F.col("spread") / F.col("blocks")).alias("spread"), ((F.col("hits") + 1) / F.lit(float(permutations + 1))).alias("p_value"), "blocks")


def seed_draws(run_means: DataFrame, sides: int, repeats: int, draws: int, seed: int) -> DataFrame:
    """draw, side, mean: for each draw and pseudo-plan the mean of ``repeats`` runs, drawn from ``run_means(replicate_id, mean)``, one row per run."""
    runs = run_means.agg(F.array_sort(F.collect_list(F.struct("replicate_id", "mean"))).alias("runs"))
    each = runs.where(F.size("runs") > 0).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    picked = F.transform(F.sequence(F.lit(1), F.lit(repeats)), lambda r: F.get("runs", F.floor(chance(seed, F.col("draw"), F.col("side"), r) * F.size("runs")).cast("int"))["mean"])
    return each.select("draw", "side", (F.aggregate(picked, F.lit(0.0), lambda s, x: s + x) / repeats).alias("mean"))


def seed_range(draws: DataFrame, share: float = 0.95) -> DataFrame:
    """One row: the quantiles of the seed null's paired difference and of its range, by nearest rank, of ``draws(draw, side, mean)`` with sides 0, 1 and 2."""
    per = draws.groupBy("draw").agg(
        F.abs(F.max(F.when(F.col("side") == 1, F.col("mean"))) - F.max(F.when(F.col("side") == 0, F.col("mean")))).alias("pair"),
        (F.max("mean") - F.min("mean")).alias("range"),
    )
    at = lambda c: F.get(F.array_sort(F.collect_list(c)), (F.ceil(F.count("*") * F.lit(share)) - 1).cast("int"))
    return per.agg(at("pair").alias("d_seed_pair"), at("range").alias("d_seed_range"), F.count("*").alias("draws"))
