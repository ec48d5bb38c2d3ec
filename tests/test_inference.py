"""Normal tails and quantiles against the standard library, the omnibus test against plain permutations."""

import hashlib
import itertools
import math
import random
import statistics

from pyspark.sql import functions as F

from grovespan.operators import inference


def test_erfc_and_quantile(spark):
    xs = [0.0, 1e-300, 1e-9, 0.4687, 0.46875, 0.469, 1.0, 3.999, 4.0, 4.001, 6.5, 9.9, 20.0, 26.5, 30.0, float("inf")] + [k / 97 for k in range(1, 900)]
    xs += [-x for x in xs]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", inference.erfc(F.col("x")).alias("y")).collect()
    for x, y in got:
        assert abs(y - math.erfc(x)) <= 1e-15 * 4 + 1e-13 * math.erfc(x) and (math.erfc(x) == 0 or x > 26.9 or abs(y / math.erfc(x) - 1) < 1e-13), x
    ps = [1e-300, 1e-20, 1e-9, 0.01, 0.0749, 0.075, 0.5, 0.8, 0.925, 0.975, 1 - 1e-12] + [k / 701 for k in range(1, 701)]
    for p, y in spark.createDataFrame([(p,) for p in ps], "p double").select("p", inference.normal_quantile(F.col("p"))).collect():
        assert abs(y - statistics.NormalDist().inv_cdf(p)) < 1e-13 * max(1, abs(y)), p
    odd = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,)], "p double").select(inference.normal_quantile(F.col("p")).alias("q"), inference.erfc(F.when(F.col("p") > 5, F.col("p"))).alias("e"))
    assert [tuple(r) for r in odd.collect()] == [(None, None)] * 4


def test_sign_flip_p_values(spark):
    rows = [(3, 9, 9), (0, 5, 5), (-7, 10, 12), (4, 4, 1), (0, 0, 8), (30, 30, 30), (None, None, 0)]
    got = spark.createDataFrame(rows, "t bigint, q bigint, n bigint").select(inference.sign_flip_p_value(F.col("t"), F.col("q"), F.col("n")).alias("p")).collect()
    want = [math.erfc(1 / math.sqrt(2)), 1.0, math.erfc(7 / math.sqrt(10) / math.sqrt(2)), 1.0, 1.0, math.erfc(math.sqrt(30 / 2)), 1.0]
    assert all(abs(r["p"] - w) < 1e-12 for r, w in zip(got, want))


def test_analytic_power(spark):
    rows = inference.analytic_power(spark.createDataFrame([("a", 99), ("none", 0)], "candidate string, n bigint")).collect()
    below = statistics.NormalDist().cdf
    for r in rows:
        if r["n"]:
            m = 0.05 * math.sqrt(99) / math.sqrt(r["discordance"] - 0.0025)
            assert abs(r["power"] - below(m - 1.959963984540054) - below(-m - 1.959963984540054)) < 1e-9
        else:
            assert r["power"] is None and r["least_effect"] is None
    assert [r["discordance"] for r in rows if r["n"]] == [0.10, 0.15, 0.25, 0.40]


def test_omnibus_against_plain_permutations(spark):
    rng = random.Random(8)
    blocks = [(f"b{k}", rng.random(), rng.random() + 0.2, rng.random()) for k in range(25)] + [("gap", None, 1.0, 1.0)]
    got = inference.omnibus_test(spark.createDataFrame(blocks, "block string, a double, b double, c double").repartition(3), 100, 4).first()
    known = blocks[:-1]
    orders = list(itertools.permutations(range(3)))
    spread = lambda sums: max(sums) - min(sums)
    observed, hits = spread([sum(b[j + 1] for b in known) for j in range(3)]), 0
    for p in range(100):
        sums = [0.0] * 3
        for b in known:
            word = hashlib.sha256(f"4:{p // 16}:{b[0]}".encode()).digest()[2 * (p % 16) : 2 * (p % 16) + 2]
            order = orders[int.from_bytes(word, "big") * 6 >> 16]
            for j in range(3):
                sums[j] += b[1 + order[j]]
        hits += spread(sums) >= observed - 1e-9
    assert abs(got["spread"] - observed / 25) < 1e-12 and got["p_value"] == (hits + 1) / 101 and got["blocks"] == 25
    assert inference.omnibus_test(spark.createDataFrame([], "block string, a double, b double, c double"), 10, 4).collect() == []
