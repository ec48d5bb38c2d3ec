"""Queries of tail chances, the analytic power screen, the omnibus test and the seed null's bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference, stats
from ..sources.tables import SCORES_SQL, load, score_rows
from .protocol import query

# erf by Simpson's rule over 2,000 steps, apart from the rational approximations.
_ERF = "(SELECT 2 / sqrt(pi()) * {x} / 6000 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-1 * pow(({x}) * i / 2000.0::DOUBLE, 2))) FROM range(0, 2001) t(i))"


@query(f"""WITH d AS (SELECT l_suppkey AS unit, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS d FROM lineitem WHERE l_quantity < 10),
s AS (SELECT unit, sum(d)::BIGINT AS total, sum(d * d)::BIGINT AS squares, count(*)::BIGINT AS n FROM d GROUP BY unit), z AS (SELECT *, abs(total) / sqrt(greatest(squares, 1)) / sqrt(2.0::DOUBLE) AS z FROM s)
SELECT unit, total, squares, n, round(CASE WHEN n < 2 OR squares = 0 THEN 1.0::DOUBLE ELSE 1 - {_ERF.format(x='z')} END, 11) AS p_value FROM z""")
def sign_flip_p_values(spark, sf_dir):
    d = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    rows = load(spark, sf_dir, "lineitem").where("l_quantity < 10").select(F.col("l_suppkey").alias("unit"), d.alias("d"))
    sums = rows.groupBy("unit").agg(F.sum("d").alias("total"), F.sum(F.col("d") * F.col("d")).alias("squares"), F.count("*").alias("n"))
    return sums.withColumn("p_value", F.round(inference.sign_flip_p_value(F.col("total"), F.col("squares"), F.col("n")), 11))


@query(f"""WITH c AS (SELECT source AS candidate, count(*)::BIGINT AS n FROM documents GROUP BY 1), g AS (SELECT candidate, n, d::DOUBLE AS discordance FROM c, (SELECT unnest({list(stats.DISCORDANCE)}) AS d)),
x AS (SELECT *, 0.05 * sqrt(n) / sqrt(discordance - 0.0025::DOUBLE) AS m FROM g), y AS (SELECT *, ({stats.Z} - m) / sqrt(2.0::DOUBLE) AS u, ({stats.Z} + m) / sqrt(2.0::DOUBLE) AS v FROM x)
SELECT candidate, n, discordance, round((1 - sign(u) * {_ERF.format(x='abs(u)')}) / 2 + (1 - {_ERF.format(x='v')}) / 2, 10) AS power, round(({stats.Z} + 0.8416212335729143) * sqrt(discordance / n), 10) AS least_effect FROM y""")
def analytic_power_screen(spark, sf_dir):
    """Approximate power for 5 points and the least effect found with power 0.8, with each source's documents as episodes."""
    counts = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("candidate")).agg(F.count("*").alias("n"))
    out = inference.analytic_power(counts)
    return out.withColumn("power", F.round("power", 10)).withColumn("least_effect", F.round("least_effect", 10))


PERMUTATIONS = 10_000


@query(f"""WITH {SCORES_SQL}, b AS (SELECT l_suppkey || ':' || l_linenumber AS block, avg(l_discount) FILTER (l_returnflag = 'A') AS a, avg(l_discount) FILTER (l_returnflag = 'N') AS b, avg(l_discount) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY l_suppkey, l_linenumber),
k AS (SELECT * FROM b WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL), h AS (SELECT *, h, sha256('23:' || h || ':' || block) AS x FROM k, range(0, {PERMUTATIONS // 16}) t(h)),
w AS (SELECT a, b, c, h * 16 + w AS p, ((('0x' || substr(x, 4 * w + 1, 4))::INT * 6) >> 16) AS o FROM h, range(0, 16) t(w)),
s AS (SELECT p, sum(CASE WHEN o IN (0, 1) THEN a WHEN o IN (2, 3) THEN b ELSE c END) AS a, sum(CASE WHEN o IN (2, 4) THEN a WHEN o IN (0, 5) THEN b ELSE c END) AS b, sum(CASE WHEN o IN (3, 5) THEN a WHEN o IN (1, 4) THEN b ELSE c END) AS c FROM w GROUP BY p),
o AS (SELECT greatest(sum(a), sum(b), sum(c)) - least(sum(a), sum(b), sum(c)) AS spread, count(*)::BIGINT AS blocks FROM k)
SELECT round(spread / blocks, 9) AS spread, (count(*) FILTER (greatest(a, b, c) - least(a, b, c) >= spread - 1e-9) + 1) / {PERMUTATIONS + 1}.0::DOUBLE AS p_value, blocks FROM s, o GROUP BY spread, blocks""")
def omnibus_permutation(spark, sf_dir):
    """10,000 permutations of three plans' labels within blocks of supplier and replicate."""
    by = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_discount")))
    blocks = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(by("A").alias("a"), by("N").alias("b"), by("R").alias("c"))
    named = blocks.select(F.concat_ws(":", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("block"), "a", "b", "c")
    return inference.omnibus_test(named, PERMUTATIONS, 23).withColumn("spread", F.round("spread", 9))


@query(f"""WITH {SCORES_SQL}, e AS (SELECT episode_id, replicate_id, avg(score) AS score FROM scores WHERE plan_id = 'left_deep' GROUP BY ALL), r AS (SELECT list(mean ORDER BY replicate_id) AS runs FROM (SELECT replicate_id, avg(score) AS mean FROM e GROUP BY 1)),
k AS (SELECT draw, side, runs[(floor(('0x' || substr(sha256('31:' || draw || ':' || side || ':' || rep), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * len(runs)) + 1)::INT] AS x FROM r, range(1, 1001) a(draw), range(0, 3) b(side), range(1, 6) c(rep)),
m AS (SELECT draw, side, avg(x) AS mean FROM k GROUP BY ALL), d AS (SELECT draw, abs(max(mean) FILTER (side = 1) - max(mean) FILTER (side = 0)) AS pair, max(mean) - min(mean) AS range FROM m GROUP BY draw)
SELECT round(quantile_disc(pair, 0.95), 9) AS d_seed_pair, round(quantile_disc(range, 0.95), 9) AS d_seed_range, count(*)::BIGINT AS draws FROM d""")
def seed_null_bounds(spark, sf_dir):
    """The 95 % points of the same-plan null for the paired difference and the range over three plans, from 1,000 draws of five runs each."""
    rows = score_rows(spark, sf_dir).where("plan_id = 'left_deep'")
    means = rows.groupBy("episode_id", "replicate_id").agg(F.avg("score").alias("score")).groupBy("replicate_id").agg(F.avg("score").alias("mean"))
    out = inference.seed_range(inference.seed_draws(means, 3, 5, 1000, 31))
    return out.select(F.round("d_seed_pair", 9).alias("d_seed_pair"), F.round("d_seed_range", 9).alias("d_seed_range"), "draws")
