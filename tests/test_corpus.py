"""The audit of three files: no exchange in its joins, broken files by name, small and empty corpora."""

import json

import pytest

from grovespan.operators import corpus


def write(folder, questions, haystacks, trajectories):
    (folder / "q.jsonl").write_text("\n".join(q if isinstance(q, str) else json.dumps(q) for q in questions), encoding="utf-8")
    (folder / "h.json").write_text(json.dumps(haystacks) if isinstance(haystacks, dict) else haystacks, encoding="utf-8")
    (folder / "t.jsonl").write_text("\n".join(t if isinstance(t, str) else json.dumps(t) for t in trajectories), encoding="utf-8")


def audited(spark, folder):
    return corpus.Audit(*corpus.read(spark, *[str(folder / n) for n in ("q.jsonl", "h.json", "t.jsonl")]), buckets=3)


def question(k, **more):
    return {"id": k, "question_type": "knowledge-update", "question": "what", "answer": "a", "eval_function": "exact"} | more


TRAJECTORIES = [
    {"id": "a", "messages": [{"role": "user", "content": "one two"}, {"role": "x", "content": None}], "current_time": "t1"},
    {"id": "", "trajectory_id": "b", "states": [{"thought": "é!", "action": "go", "url": None}], "event_time": "t2", "extra": {"z": 1.50, "y": [True, None]}},
    {"id": "c", "content": "", "goal": "the goal"}, {"id": "d", "content": "漢字"}, {"id": "e"},
]


def test_reasons_and_measures(spark, tmp_path):
    every = ["a", "b", "c", "d"]
    questions = [
        question("ok", supporting_evidence_ids=["d", "a", "d"]), question("no_support", question_type="other", domain="x"), question("late", answer_session_ids=["d"], evidence_ids=["a"], family_id="f"), "",
        question("x_abs"), question("y", question_type="z-abs"), question("few"), question("lost"), question("silent", question=""), question("unanswered", answer=None), question("unjudged", eval_function=None), question("foreign", answer_session_ids=["e"]),
        question("foreign_abs", answer_session_ids=["e"]), {"question_id": "unkind", "question": "q", "answer": "", "eval_function": "e"}, question("none"),
    ]
    haystacks = {q.get("id") or q.get("question_id"): every for q in questions if isinstance(q, dict)} | {"few": ["a", "b", "c"], "lost": ["a", "z1", "z2", "b", "z3", "z4", "z5", "z6"], "none": [], "ok": ["a", "b", "a", "c", "d", "e", "a", "b"]}
    write(tmp_path, questions, haystacks, TRAJECTORIES)
    audit = audited(spark, tmp_path)
    got = {r["question_id"]: r for r in audit.judged().collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "ok": None, "no_support": None, "late": None, "x_abs": "abstention", "y": "abstention", "few": "fewer_than_four", "lost": "missing_trajectory:z1,z2,z3,z4,z5", "silent": "unrecoverable_query", "unanswered": "unrecoverable_query",
        "unjudged": "unrecoverable_query", "foreign": "answer_evidence_not_in_episode", "foreign_abs": "answer_evidence_not_in_episode", "unkind": None, "none": "fewer_than_four",
    }
    # d is at 4, a first at 0, d again: (4 + 0 + 4) / 3 / 7.
    assert (got["ok"]["support_class"], got["ok"]["position_bin"]) == ("multiple", "middle")
    assert (got["late"]["support_class"], got["late"]["position_bin"], got["no_support"]["position_bin"]) == ("single_or_unknown", "late", "unknown")
    assert got["unkind"]["question_type"] == "unknown" and not got["unkind"]["primary"]
    evidence = {(r["episode_id"], r["sequence_index"]): r for r in audit.evidence().collect()}
    assert len(evidence) == 8 + 4 * 3 and [evidence["ok", k]["evidence_id"] for k in range(8)] == haystacks["ok"]
    assert evidence["late", 0]["event_time"] == "t1" and evidence["late", 1]["event_time"] == "t2" and evidence["late", 2]["event_time"] is None
    assert [evidence["late", k]["token_count"] for k in range(4)] == [3, 4, 3, 3]  # 2, 3, 2 and 2, a tenth more, rounded up
    import hashlib

    raw = json.dumps(TRAJECTORIES[1], sort_keys=True, separators=(",", ":"))
    assert evidence["late", 1]["raw_sha256"] == hashlib.sha256(raw.encode()).hexdigest()
    families = {r["episode_id"]: r["family_id"] for r in audit.episodes().collect()}
    assert families == {"ok": "unknown:unknown:ok", "no_support": "x:unknown:no_support", "late": "f", "unkind": "unknown:unknown:unkind"}
    assert {r["question_id"]: r["mapping_status"] for r in audit.answer_mapping().collect()}["no_support"] == "not_provided_by_source"
    counts = audit.counts().first()
    assert (counts["questions"], counts["n_master"], counts["n8"], counts["primary_n_master"], counts["abstentions"], counts["problems"]) == (14, 4, 1, 2, 3, 0)
    assert counts["status"] == "qualified_with_exclusions" and counts["no_silent_drop"]


def test_joins_have_no_exchange(spark, tmp_path):
    write(tmp_path, [question(f"q{k}") for k in range(40)], {f"q{k}": [f"t{j}" for j in range(k)] for k in range(40)}, [{"id": f"t{j}", "content": "x " * j} for j in range(40)])
    audit = audited(spark, tmp_path)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (audit.placed(), audit.questions.join(audit.haystacks, "question_id"), audit.haystacks.join(audit.questions, "question_id", "left_anti"), audit.evidence()):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "Join" in plan and "Exchange" not in plan, plan
        assert audit.placed().count() == 780
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_problems_block(spark, tmp_path):
    write(tmp_path, [question("a"), question("a"), question("b"), {"question": "no id"}], {"a": ["t"], "c": ["t"], "b": ["t", None]}, [{"id": "t"}, {"id": "t", "goal": "x"}, {"goal": "no id"}])
    audit = audited(spark, tmp_path)
    assert sorted(map(str, [tuple(r) for r in audit.problems().collect()])) == sorted(map(str, [
        (None, "no_haystack"), ("c", "unknown_question"), (None, "question_without_id"), ("a", "repeated_question"), (None, "trajectory_without_id"), ("t", "repeated_trajectory"), ("b", "invalid_haystack"),
    ]))
    counts = audit.counts().first()
    assert counts["status"] == "blocked" and not counts["no_silent_drop"]


def test_empty_corpus(spark, tmp_path):
    write(tmp_path, [""], {}, [""])
    audit = audited(spark, tmp_path)
    for name in ("problems", "judged", "episodes", "evidence", "conversion", "answer_mapping", "strata", "distributions"):
        assert getattr(audit, name)().collect() == []
    assert audit.counts().first()["status"] == "blocked"


@pytest.mark.parametrize("questions,haystacks,trajectories", [(["{"], "{}", []), ([question("a")], "[]", []), ([question("a")], '{"a": 3}', []), ([question("a")], '{"a": ["t"]}', ["[1"]), ([question("a")], '{"a": ["t"]', [])])
def test_malformed_files_fail(spark, tmp_path, questions, haystacks, trajectories):
    write(tmp_path, questions, haystacks, trajectories)
    with pytest.raises(Exception, match="MALFORMED|Malformed|begins with|does not end"):
        audited(spark, tmp_path).judged().collect()


def test_a_hot_trajectory_is_in_many_buckets(spark, tmp_path):
    write(tmp_path, [question(f"q{k}") for k in range(300)], {f"q{k}": ["hot", f"t{k % 7}", "t1", "t2"] for k in range(300)}, [{"id": f"t{j}"} for j in range(7)] + [{"id": "hot"}])
    audit = audited(spark, tmp_path)
    assert audit.entries.where("trajectory_id = 'hot'").select("salt").distinct().count() == corpus.SALTS
    assert audit.judged().where("reason is null").count() == 300
