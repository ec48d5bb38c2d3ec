"""Contracts, prompts and the label boundary: one good and several bad cases each."""

import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from grovespan.functions import contracts, prompts, text
from grovespan.operators import worklog

# Hashes of the prompts for Q, A, R.
HASHES = [
    ("single-session-user", False, "c973231683d914de5192e37a06cbd1ba0d16c3c5dad99d9fb1242708b6a624d6"),
    ("temporal-reasoning", False, "68eece862c1e5d18c997191d6dd816a9f56e5ec3b8d04502df332fa71fdb6484"),
    ("knowledge-update", False, "992fa870a148dc7958741db4e4d9590f0947b17e1516ecd8b6c6424fd38c6747"),
    ("single-session-preference", False, "cac49761fd13dbf5e46b602c9a23867a4c96ad11729ebeb1f9846f85aa2bd15b"),
    ("knowledge-update", True, "879152708d282cd7102c4a39182451ec48da2bd424d2e29cea52fbf045b59593"),
]


def codes(df, key, checks):
    return {r[key]: set(r["codes"]) for r in worklog.problems(df, [key], **checks).collect()}


def test_prompt_hashes(spark):
    df = spark.createDataFrame(HASHES, "task string, abstention boolean, want string")
    own = prompts.judge_prompt(F.col("task"), F.lit("Q"), F.lit("A"), F.lit("R"), F.col("abstention"))
    assert df.where(F.sha2(own.cast("binary"), 256) != F.col("want")).count() == 0
    strict = df.select(prompts.judge_prompt(F.col("task"), F.lit("Q"), F.lit("A"), F.lit("R"), F.col("abstention"), json_only=True).alias("p")).collect()
    assert all(prompts.JSON_ONLY in r["p"] and prompts.YES_NO not in r["p"] for r in strict)
    with pytest.raises(PySparkException):
        spark.range(1).select(prompts.judge_prompt(F.lit("none"), F.lit(""), F.lit(""), F.lit(""), F.lit(False))).collect()


def test_episode(spark):
    good = ("d", "v", "e1", "c", "f", "calibration", ["a", "b"], ["q"], {"s": "x"})
    rows = [good, (*good[:2], "e2", "c", " ", "none", ["a", "a"], ["q"], {"s": "x"}), (*good[:2], "e3", "c", "f", "acceptance", [], None, None)]
    df = spark.createDataFrame(rows, "dataset_id string, dataset_version_or_commit string, episode_id string, construction_unit_id string, family_id string, split string, ordered_evidence_ids array<string>, query_ids array<string>, provenance map<string,string>")
    assert codes(df, "episode_id", contracts.episode()) == {"e2": {"family_id_filled", "evidence_ids", "split_known"}, "e3": {"evidence_ids", "query_ids", "provenance"}}


def test_capacity_and_delta(spark):
    df = spark.createDataFrame([(1, 8, 8, 8), (2, 8, 8, 4), (3, 0, 0, 0)], "id int, B_merge int, B_final int, B_query int")
    assert codes(df, "id", contracts.capacity()) == {2: {"equal"}, 3: {"positive"}}
    df = spark.createDataFrame([(1, 0.1, False, 0.9), (2, 0.11, False, 0.9), (3, 0.05, True, 0.5)], "id int, delta_decision double, topology_results_seen boolean, power double")
    assert codes(df, "id", contracts.delta_decision()) == {2: {"on_grid"}, 3: {"frozen_before_results", "power"}}


def test_backbones(spark):
    cols = "backbone_id string, role string, model_family string, constructor_model_snapshot string, merge_model_snapshot string, answer_model_snapshot string, provider string, endpoint string, decoding_config_hash string"
    df = spark.createDataFrame([("a", "primary", "f", "m-1", "m-1", "m-1", "p", "e", "h"), ("b", "replication", "f", "m-latest", "latest", "m", "p", "e", "h")], cols)
    assert codes(df, "backbone_id", contracts.backbone()) == {"b": {"constructor_model_snapshot_pinned", "merge_model_snapshot_pinned"}}
    assert [r[0] for r in contracts.same_family(df).collect()] == ["f"]


def test_label_boundary(spark):
    leaf = spark.createDataFrame([(1, (["x"],))], "episode_id int, meta struct<supporting_evidence_ids:array<string>>")
    with pytest.raises(ValueError):
        contracts.guarded(leaf, "construction")
    with pytest.raises(ValueError):
        contracts.guarded(leaf.select("episode_id", F.lit("q").alias("query_text")), "construction")
    assert contracts.guarded(leaf.select("episode_id", F.lit("q").alias("query_text")), "answer").count() == 1
    labels = spark.createDataFrame([("q", "gold")], "query_id string, gold_answer string")
    answers = spark.createDataFrame([("q", True, True, "log-1")], "query_id string, run_artifacts_frozen boolean, answer_artifacts_frozen boolean, access_log_id string")
    assert contracts.scoring_view(answers, labels).count() == 1
    with pytest.raises(PySparkException):
        contracts.scoring_view(answers.withColumn("answer_artifacts_frozen", F.lit(False)), labels).collect()


def test_small_contracts(spark):
    quotas = {"a": 2, "b": 1}
    cases = spark.createDataFrame([("a",), ("a",), ("c",)], "category string")
    assert sorted(tuple(r) for r in contracts.quota_shortfalls(cases, quotas).collect()) == [("b", 1, 0), ("c", 0, 1)]
    seeds = spark.createDataFrame([(0, 0, 0), (1, 1, 2), (2, None, 2)], "replicate_id int, s_merge int, s_answer int")
    assert sorted(r[0] for r in contracts.seed_mismatches(seeds).collect()) == [1, 2]
    cohorts = spark.createDataFrame([(4, 1), (4, 2), (16, 1), (16, 3), (8, 1), (8, 3)], "k int, episode_id int")
    assert sorted(tuple(r) for r in contracts.unequal_cohorts(cohorts).collect()) == [(4, 2), (4, 3)]
    times = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("2024-13-01T00:00:00Z",)], "t string")
    assert [r[0] for r in times.select(contracts.zoned("t")).collect()] == [True, False, False]


def test_evaluator_cases(spark):
    cases = [("exact", ["quick brown fox"], "The quick, brown fox!", 1), ("exact", ["Paris"], "Lyon", 0), ("sub", ["Paris"], "The answer is Paris.", 1), ("sub", ["The answer is Paris"], "Paris", 0), ("sub", ["answer"], "", 0), ("sub", ["Madrid", "Paris"], "Final answer: paris", 1)]
    df = spark.createDataFrame(cases, "metric string, refs array<string>, c string, want int")
    own = F.when(F.col("metric") == "exact", text.exact_match(F.col("c"), F.col("refs"))).otherwise(text.substring_match(F.col("c"), F.col("refs")))
    assert df.where(own != F.col("want")).count() == 0


def test_partial_answers_and_ids(spark):
    df = spark.createDataFrame([("red, blue",), ("one and two",), ("alpha beta gamma",), ("single",), (None,)], "t string")
    assert [r[0] for r in df.select(text.partial_answer(F.col("t"))).collect()] == ["red", "one", "alpha", None, None]
    got = spark.range(1).select(text.evidence_id(F.lit("e"), F.lit(7), F.lit("s"))).first()[0]
    assert got == "e:evidence:007:s"
    assert hashlib.sha256(b"x").hexdigest() == spark.range(1).select(F.sha2(F.lit("x").cast("binary"), 256)).first()[0]


def test_normalized_question(spark):
    df = spark.createDataFrame([("Ｗhat  IS\tthe Straße?",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalized_question("t")).collect()] == ["what is the strasse?", None]
