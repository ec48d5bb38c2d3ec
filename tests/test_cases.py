"""Judge cases, cache keys, exposure and lifecycle work on null, blank and broken rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from grovespan.operators import cases

EPISODE = "episode_id string, query_id string, question_type string, question string, reference_answer string"


def test_judge_cases(spark):
    rows = [("é1", "q", "knowledge-update", "what", "  Zürich, then Bern "), ("e2", "q", "temporal-reasoning", "what", "one"), ("e3", "q", "x", "what", "one two"), ("e4", None, "knowledge-update", "what", "one two"), ("e5", "q", None, "what", "a"), ("e6", "q", "knowledge-update", "what", " ")]
    got = {(r["episode_id"], r["case_category"]): r for r in cases.judge_cases(spark.createDataFrame(rows, EPISODE), "seed").collect()}
    assert len(got) == 6 * 7
    answers = {c: got["é1", c]["candidate_answer"] for c in cases.EXPECTED}
    assert answers["partial"] == "Zürich" and answers["gold_equivalent"] == "Zürich, then Bern" and answers["formatting_variation"] == "Final answer:\nZürich, then Bern"
    for c in cases.EXPECTED:
        want = json.dumps({"manifest_id": "seed", "episode_id": "é1", "case_category": c, "candidate_answer": answers[c]}, sort_keys=True, separators=(",", ":"))
        assert got["é1", c]["case_id"] == "jrq-" + hashlib.sha256(want.encode()).hexdigest()[:20] and got["é1", c]["expected_label"] == cases.EXPECTED[c]
    assert got["e2", "partial"]["problem"] == "no_partial_answer" and got["e2", "partial"]["case_id"] is None and got["e2", "clearly_wrong"]["problem"] is None
    assert {got[e, "partial"]["problem"] for e in ("e3", "e5")} == {"unsupported_task"} and {got[e, "partial"]["problem"] for e in ("e4", "e6")} == {"missing_field"}


def test_judge_cache_key(spark):
    values = {c: f"{c} ü" for c in cases.JUDGE_KEY}
    key = spark.range(1).select(cases.judge_cache_key(**{c: F.lit(v) for c, v in values.items()}).alias("k")).first()["k"]
    assert key == hashlib.sha256(json.dumps(values, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    with pytest.raises(ValueError):
        cases.judge_cache_key(question_id=F.lit("q"))


def test_support_exposure(spark):
    rows = [
        ("a", "exact", ["l1", "l2"], 2, 0.5, "E"), ("a", "expanded_to_chunks", ["l2"], 2, 0.5, "E"), ("a", "exact", ["l3"], 4, 1.5, "L"), ("a", "unresolved", [], None, None, None),
        ("b", "exact", ["l1"], 1, 0.0, "E"), ("b", "exact", ["l1"], 2, 0.0, "E"), ("b", "unresolved", ["l1"], 0, 0.0, "E"), ("b", "exact", [], 0, 0.0, "E"), ("b", None, ["l1"], 0, 0.0, "E"), ("b", "exact", ["x"], -1, 0.0, "E"), ("b", "exact", ["x"], 1, 0.0, ""),
        ("c", "unresolved", None, None, None, None),
    ]
    got = {r["k"]: r for r in cases.support_exposure(spark.createDataFrame(rows, "k string, status string, leaf_ids array<string>, rewrite_depth bigint, pressure double, role string"), "k").collect()}
    assert tuple(got["a"])[1:] == (3, 1, 0.25, 8 / 3, 4, 2.5 / 3, 1.5, "E:2,L:1", "")
    assert got["b"]["problems"] == "leaf_inconsistent,resolved_without_leaves,status_unknown,unresolved_with_leaves,value_missing" and got["b"]["leaves"] == 1
    assert tuple(got["c"])[1:] == (0, 1, 1.0, None, None, None, None, "", "")


def test_lifecycle_work(spark):
    rows = [(1, "merge", "accepted", 10, 4, 3), (1, "answer", "accepted", 7, None, 2), (1, "judge", "accepted", 99, 9, 9), (1, "merge", "failed", None, None, None), (2, "answer", "accepted", 5, 5, 1), (3, "merge", "failed", 1, 1, 1)]
    got = {r["run_id"]: r for r in cases.lifecycle_work(spark.createDataFrame(rows, "run_id int, stage string, outcome string, input_tokens bigint, cached_tokens bigint, output_tokens bigint"), "run_id").collect()}
    assert (got[1]["merge_input"], got[1]["merge_cached"], got[1]["merge_uncached"], got[1]["merge_output"]) == (10, 4, 6, 3)
    assert (got[1]["answer_input"], got[1]["answer_cached"], got[1]["answer_uncached"], got[1]["answer_output"]) == (7, None, None, 2)
    assert (got[2]["merge_input"], got[2]["answer_uncached"]) == (0, 0) and set(got) == {1, 2}
