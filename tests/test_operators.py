"""Golden values and comparisons with plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from grovespan.functions import text
from grovespan.operators import cost, graph, partition, scores, stats, trees, worklog
from grovespan.sources import tables


def test_scores_golden(spark):
    rows = [("e1", "left_deep", 0.0), ("e1", "canonical_balanced", 1.0), ("e1", "right_deep", 0.5), ("e2", "left_deep", 1.0), ("e2", "canonical_balanced", 1.0), ("e2", "right_deep", 0.0)]
    df = spark.createDataFrame([(e, p, 0, "q", s) for e, p, s in rows], "episode_id string, plan_id string, replicate_id int, query_id string, score double")
    assert {r["plan_id"]: r["quality"] for r in scores.plan_quality(df).collect()} == {"left_deep": 0.5, "canonical_balanced": 1.0, "right_deep": 0.25}
    assert scores.delta_primary(df).first()["delta"] == 0.5
    assert scores.diagnostic_range(df).first()["range"] == 0.75


def test_macro_scores_are_two_level(spark):
    df = spark.createDataFrame([(1, "p", 0, 1.0), (1, "p", 0, 1.0), (1, "p", 0, 1.0), (2, "p", 0, 0.0)], "episode_id int, plan_id string, replicate_id int, score double")
    assert scores.macro_scores(df).first()["score"] == 0.5


def test_poisoned_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, micro_usd int")
    assert {r["k"]: r["c_life"] for r in worklog.lifecycle_cost(df, "k").collect()} == {"a": None, "b": 2}


def greedy_spans(counts, k):
    total, cum, bounds, prev = sum(counts), [], [], 0
    for c in counts:
        cum.append((cum[-1] if cum else 0) + c)
    for j in range(1, k):
        best = min(range(prev + 1, len(counts) - (k - j) + 1), key=lambda i: (abs(cum[i - 1] - j * total / k), i))
        bounds.append(best)
        prev = best
    points = [0, *bounds, len(counts)]
    return [(points[i], points[i + 1] - 1) for i in range(k)]


@pytest.mark.parametrize("k", [4, 8, 16])
def test_balanced_partition_random(spark, k):
    rng = random.Random(k)
    cases = [[rng.randint(1, 40) for _ in range(rng.randint(k, 3 * k))] for _ in range(40)]
    df = spark.createDataFrame([(i, j, c) for i, x in enumerate(cases) for j, c in enumerate(x)], "episode_id int, sequence_index int, token_count bigint")
    got = {}
    for r in partition.partition(df, k).orderBy("episode_id", "leaf").collect():
        got.setdefault(r["episode_id"], []).append((r["start"], r["end"]))
    assert got == {i: greedy_spans(x, k) for i, x in enumerate(cases)}


def test_greedy_pack_random(spark):
    rng = random.Random(3)
    cases = {q: [rng.randint(1, 60) for _ in range(15)] for q in range(20)}
    df = spark.createDataFrame([(q, r, f"i{r}", 100 - r, c) for q, x in cases.items() for r, c in enumerate(x)], "query_id int, rank int, item_id string, sequence_index int, cost int")
    for r in partition.greedy_pack(df, 150).collect():
        used, kept = 0, []
        for i, c in enumerate(cases[r["query_id"]]):
            if used + c <= 150:
                used, kept = used + c, [*kept, f"i{i}"]
        assert (r["used"], r["packed"], r["rendered"]) == (used, kept, kept[::-1])


def test_plans(spark):
    for plan in (*scores.DIAGNOSTIC, "eager_left_deep", "online_canonical_balanced"):
        nodes = trees.generate(spark, plan, 8)
        assert nodes.count() == 15
        assert trees.violations(nodes).count() == 0
    depth = {r["leaf"]: r["depth"] for r in trees.leaf_depths(trees.generate(spark, "left_deep", 4)).collect()}
    assert depth == {0: 3, 1: 3, 2: 2, 3: 1}
    for bad in (("left_deep", 1), ("none", 4), ("online_canonical_balanced", 6)):
        with pytest.raises(ValueError):
            trees.generate(spark, *bad)


def test_tree_violations_found(spark):
    nodes = trees.generate(spark, "canonical_balanced", 4)
    broken = nodes.withColumn("hi", F.when(F.col("node") == "node_B_0_1", 2).otherwise(F.col("hi")))
    assert {r["problem"] for r in trees.violations(broken).collect()} == {"spans_not_contiguous"}
    lost = nodes.where("node <> 'leaf_2'")
    assert "unknown_child" in {r["problem"] for r in trees.violations(lost).collect()}


def test_online_forest(spark):
    by = {}
    for r in trees.live_forest(spark, 8).orderBy("prefix", "position").collect():
        by.setdefault(r["prefix"], []).append(r["node"])
    assert by[2] == ["node_OB_0_1_L1", "leaf_2"]
    assert by[7] == ["node_OB_0_7_L3"]


def test_answers_and_labels(spark):
    df = spark.createDataFrame([("The Cat!", ["a cat"], '{"label": 1}'), ("dog", ["cat"], '{"label": true}'), ("", [""], '{"label": 1, "label": 0}'), (None, ["x"], None)], "c string, refs array<string>, reply string")
    got = [tuple(r) for r in df.select(text.exact_match(F.col("c"), F.col("refs")), text.substring_match(F.col("c"), F.col("refs")), text.judge_label(F.col("reply"))).collect()]
    assert got == [(1, 1, 1), (0, 0, None), (1, 1, None), (None, None, None)]


def test_canonical_hash(spark):
    want = hashlib.sha256(json.dumps({"b": 1, "a": "x", "C": None}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    got = spark.range(1).select(text.canonical_hash(("b", F.lit(1)), ("a", F.lit("x")), ("C", F.lit(None).cast("string")))).first()[0]
    assert got == want
    doc = json.dumps({"t": "é", "f": 1e-05})
    want = hashlib.sha256(json.dumps(json.loads(doc), sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()
    assert spark.createDataFrame([(doc,)], "j string").select(text.canonical_text_hash("j")).first()[0] == want


def test_quantile_rules(spark):
    rng = random.Random(5)
    values = sorted(rng.randint(0, 50) for _ in range(38))
    df = spark.createDataFrame([("k", v) for v in values], "k string, v bigint")
    row = scores.quantiles(df, ["k"], "v").first()
    assert (row["p50"], row["p95"]) == (values[round(37 * 0.5)], values[round(37 * 0.95)])


def test_leakage_groups_random(spark):
    rng = random.Random(9)
    pairs = [(rng.randint(0, 150), rng.randint(0, 110)) for _ in range(160)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for e, v in pairs:
        parent[find(("e", e))] = find(("v", v))
    got = graph.leakage_groups(spark.createDataFrame([(e, "r", str(v)) for e, v in pairs], "episode_id bigint, relation string, value string")).collect()
    group = {r["episode_id"]: r["group_id"] for r in got}
    for a in group:
        for b in group:
            assert (group[a] == group[b]) == (find(("e", a)) == find(("e", b)))


def brute_splits(groups, candidate):
    """Groups dealt one by one, every dimension looked up anew: group -> [(type, primary, expanded)]."""
    shares = dict(zip(("development", "calibration", "acceptance"), (x / 100 for x in graph.SPLITS[candidate])))
    digest = lambda **f: hashlib.sha256(json.dumps(f, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    out = {}
    primary = lambda g: sum(p for _, p, _ in groups[g])
    for g in sorted(groups, key=lambda g: (-primary(g), digest(candidate_id=candidate, group_id=g))):
        def score(split):
            own = [h for h in out if out[h] == split]
            dims = [(sum(primary(h) for h in groups), sum(primary(h) for h in own), primary(g)), (sum(e for x in groups.values() for *_, e in x), sum(e for h in own for *_, e in groups[h]), sum(e for *_, e in groups[g]))]
            for t, p, _ in groups[g]:
                dims.append((sum(q for x in groups.values() for u, q, _ in x if u == t), sum(q for h in own for u, q, _ in groups[h] if u == t), p))
            total = 0.0
            for whole, have, n in dims:
                if whole > 0 and n > 0:
                    total += (abs(shares[split] * whole - have) - abs(shares[split] * whole - have - n)) / whole
            return total, digest(candidate_id=candidate, group_id=g, split=split)

        out[g] = max(shares, key=score)
    return out


def test_splits_brute_force(spark):
    rng = random.Random(17)
    groups = {f"g{i}": [(t, p := rng.randint(0, 2), p + rng.randint(0, 2)) for t in rng.sample(["a", "b", "c"], rng.randint(1, 3))] for i in range(60)}
    df = spark.createDataFrame([(g, t, p, e) for g, x in groups.items() for t, p, e in x], "group_id string, question_type string, primary bigint, expanded bigint")
    for candidate in graph.SPLITS:
        assert {r["group_id"]: r["split"] for r in graph.assign_splits(df, candidate).collect()} == brute_splits(groups, candidate)


def test_group_names_and_relations(spark):
    rows = [("b", "family", "x"), ("a", "family", "x"), ("c", "answer_session", "s"), ("b", "answer_session", "s"), ("d", "family", ""), ("e", "family", None), ("d", "answer_session", "t")]
    got = {r["episode_id"]: r for r in graph.leakage_groups(spark.createDataFrame(rows, "episode_id string, relation string, value string")).collect()}
    name = lambda *ids: "lmg-" + hashlib.sha256(json.dumps({"episode_ids": list(ids)}, separators=(",", ":")).encode()).hexdigest()[:16]
    assert {e: (r["group_id"], r["group_size"], r["relations"]) for e, r in got.items()} == {**{e: (name("a", "b", "c"), 3, "answer_session,family") for e in "abc"}, "d": (name("d"), 1, ""), "e": (name("e"), 1, "")}


def test_critical_path_of_long_chains_and_cycles(spark):
    rng = random.Random(4)
    seconds = {i: rng.randint(0, 9) for i in range(1100)}
    edges = [(i, i - 1) for i in range(1, 1000)] + [(1000 + k, rng.randint(0, 999 + k)) for k in range(100) for _ in range(rng.randint(0, 3))]
    finish = {}
    for i in range(1100):
        finish[i] = seconds[i] + max((finish[c] for p, c in edges if p == i), default=0)
    nodes = spark.createDataFrame(list(seconds.items()), "node bigint, seconds bigint")
    rows = worklog.critical_path(spark.createDataFrame(edges, "parent bigint, child bigint"), nodes).collect()
    assert {r["node"]: r["finish"] for r in rows} == finish and len(rows) == 1100
    for cycle in ([(1, 2), (2, 3), (3, 1)], [(1, 2), (1, 3), (2, 1), (2, 4), (3, 4)]):
        with pytest.raises(ValueError, match="cycle"):
            worklog.critical_path(spark.createDataFrame(cycle, "parent bigint, child bigint"), nodes)


def test_near_text_pairs_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(["common", "word", *(f"w{k}" for k in range(9))]) for _ in range(rng.randint(1, 9)))) for i in range(80)]
    sets = {i: set(x.split()) for i, x in items}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    got = graph.near_text_pairs(spark.createDataFrame(items, "item bigint, text string"), 0.6).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 20


def test_normal_p_value():
    assert stats.normal_p_value(1.0, 1.0, 1) == 1.0 == stats.normal_p_value(0.0, 0.0, 9)
    assert abs(stats.normal_p_value(1.959963984540054, 1.0, 2) - 0.05) < 1e-12


def test_exclusion_precedence(spark):
    df = spark.createDataFrame([(True, True, True), (False, True, True), (False, None, True), (False, False, False)], "abstention boolean, exact_duplicate boolean, invalid_ids boolean")
    assert [r["reason"] for r in graph.exclusion_reason(df).collect()] == ["abstention", "exact_duplicate", "invalid_ids", None]


def test_cost_totals(spark):
    rows = {(r["component"], r["role"]): r["logical"] for r in cost.envelope(spark).collect()}
    assert rows[("primary", "generation")] == 1_100_312 and rows[("future_k_sweep", "judge")] == 197_010
    assert sum(rows.values()) == 3_601_458


def test_difference_distribution_sums_to_one(spark):
    one = stats.scenario_grid(spark, (0.0, 0.1, 0.9)).withColumn("p", stats.difference_probabilities(F.col("effect"), F.col("discordance")))
    for r in stats.repeated_distribution(one).groupBy("effect", "discordance").agg(F.sum("probability").alias("s"), F.max("cumulative").alias("c")).collect():
        assert abs(r["s"] - 1) < 1e-9 and r["c"] == 1.0


def test_power_grows_with_effect(spark):
    design = stats.strata_design(spark.createDataFrame([("knowledge-update", "single", "early", 5), ("temporal-reasoning", "multiple", "late", 7)], "question_type string, support_class string, position_bin string, n bigint"))
    rows = {r["effect"]: r["power"] for r in stats.power(spark, design, stats.scenario_grid(spark, (0.0, 0.1, 0.2), (0.3,)), 80, 80, 1).collect()}
    assert rows[0.0] < 0.2 and rows[0.0] < rows[0.1] < rows[0.2]


def test_enforce_fails(spark):
    df = spark.createDataFrame([(1,), (-1,)], "x int")
    with pytest.raises(PySparkException):
        worklog.enforce(df, positive=F.col("x") > 0).collect()
    assert [r["x"] for r in worklog.problems(df, ["x"], positive=F.col("x") > 0).collect()] == [-1]


def test_cycles_are_errors(spark):
    e = spark.createDataFrame([(1, 2), (2, 1)], "parent bigint, child bigint")
    with pytest.raises(ValueError):
        worklog.critical_path(e, spark.createDataFrame([(1, 1), (2, 1)], "node bigint, seconds bigint"))
    with pytest.raises(ValueError):
        worklog.generative_lineage(spark.createDataFrame([(1, "cache", 2), (2, "cache", 1)], "node bigint, source string, cache_of bigint"), levels=4)


def test_jsonl_round_trip(spark, tmp_path):
    path = str(tmp_path / "x")
    tables.write_jsonl(spark.createDataFrame([("b", 1), ("a", None)], "id string, v int"), path, "id")
    back = tables.read_jsonl(spark, path, "id string, v int")
    assert sorted(tuple(r) for r in back.collect()) == [("a", None), ("b", 1)]
    assert tables.repeated_ids(back.unionByName(back)).count() == 2
    assert tables.checksums(spark, path).count() >= 1


def test_gate_stops_at_first_failure(spark):
    rows = [("a", "passed", "1", None), ("b", "failed", "2", "1"), ("c", "passed", "3", "2")]
    got = cost.gate(spark.createDataFrame(rows, "stage string, status string, hash string, upstream_hash string"), ("a", "b", "c")).orderBy("position").collect()
    assert [r["open"] for r in got] == [True, False, False]


def test_leakage_queries_group_every_order(spark, duck, data):
    from grovespan.plans import queries

    rows = duck.sql("SELECT DISTINCT l_orderkey, l_partkey || ':' || l_suppkey FROM lineitem").fetchall()
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for order, value in rows:
        parent[root(("v", value))] = root(order)
    want = {}
    for order, _ in rows:
        want.setdefault(root(order), set()).add(order)
    got = {}
    for r in queries.leakage_components(spark, data).collect():
        got.setdefault((r["group_id"], r["group_size"]), set()).add(r["episode_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(size == len(x) for (_, size), x in got.items())
    splits = [(r["candidate"], r["group_id"]) for r in queries.split_assignment(spark, data).collect()]
    assert sorted(splits) == sorted((c, g) for g, _ in got for c in ("20/30/50", "15/25/60", "10/20/70"))


def test_power_grid_has_every_scenario(spark, data):
    from grovespan.plans import queries

    rows = queries.power_grid(spark, data).collect()
    effects = (-0.15, -0.125, -0.1, -0.075, -0.05, -0.025, 0.0, 0.025, 0.05, 0.075, 0.1, 0.125, 0.15)
    assert sorted((r["effect"], r["discordance"]) for r in rows) == [(e, d) for e in effects for d in (0.1, 0.15, 0.25, 0.4)]
    assert {r["draws"] for r in rows} == {1000}


def test_manifest_checks_of_empty_and_null_rows(spark):
    from grovespan.operators import manifests

    ratios = spark.createDataFrame([(1, None, 0.3, 0.5), (2, 0.2, 0.3, 0.5), (3, 0.2, 0.3, 0.5)], "candidate int, development double, calibration double, acceptance double")
    assert sorted(map(tuple, manifests.ratio_problems(ratios).collect())) == [(1, "range"), (3, "repeated")]
    assert manifests.ratio_problems(ratios.limit(0)).count() == 0
    strata = spark.createDataFrame([], "candidate int, question_type string, support_leaf_class string, evidence_position_bin string, count bigint")
    accepted = spark.createDataFrame([(1, 0)], "candidate int, n8 bigint")
    assert [r["problem"] for r in manifests.stratum_problems(strata, accepted, ("a", "b")).collect()] == ["empty"]
    counts = spark.createDataFrame([], "candidate int, split string, N_master int, N4 int, N8 int, N16 int")
    assert manifests.split_count_problems(counts, dict.fromkeys(manifests.COUNT_NAMES, 0)).count() == 0


def test_no_design_is_chosen_below_the_bound(spark):
    rates = spark.createDataFrame([(0, 0.05, 0.7, 0.75), (0, -0.05, 0.6, 0.7), (1, 0.1, 0.6, 0.7), (1, 0.2, 0.9, 0.9)], "candidate int, effect double, lower double, power double")
    row = stats.choose_design(rates).first()
    assert (row["status"], row["candidate"], row["best_candidate"], row["best_delta"], row["best_lower"]) == ("blocked", None, 0, 0.05, 0.6)
    won = stats.choose_design(rates, least=0.6).first()
    assert (won["status"], won["candidate"], won["delta"], won["power"], won["lower"]) == ("passed", 0, 0.05, 0.7, 0.6)
