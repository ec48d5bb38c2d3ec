"""The long pipelines on small synthetic inputs, and the frozen formulas."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from grovespan.operators import derived, trees, worklog
from grovespan.plans import pipelines

RAW = "question_id string, question_type string, question string, answer string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string>>>, answer_session_ids array<string>"


def episode(name, n, support=(0,), kind="temporal-reasoning", **over):
    ids = [f"{name}-s{i}" for i in range(n)]
    row = {"question_id": name, "question_type": kind, "question": f"what of {name}?", "answer": "x", "haystack_session_ids": ids, "haystack_dates": ["d"] * n, "haystack_sessions": [[("user", f"words of {name} {i}")] for i in range(n)], "answer_session_ids": [ids[i] for i in support]}
    row |= over
    return tuple(row[c.split()[0]] for c in RAW.replace("array<array<struct<role:string,content:string>>>", "x").split(", "))


def test_corpus_audit(spark):
    rows = [episode("e1", 8), episode("e2", 4), episode("e3_abs", 8), episode("e4", 3), episode("e5", 16, (0, 1)), episode("e6", 8, haystack_dates=["d"]), episode("e7", 8, (0,), "knowledge-update", question="What of  E1?")]
    got = pipelines.corpus_audit(spark.createDataFrame(rows, RAW))
    reasons = {r["question_id"]: r["reason"] for r in got["episodes"].collect()}
    assert reasons == {"e1": None, "e2": None, "e3_abs": "abstention", "e4": "fewer_than_four", "e5": None, "e6": "parallel_mismatch", "e7": None}
    assert tuple(got["counts"].first()) == (4, 4, 3, 1)
    layout = {r["episode_id"]: (r["support_class"], r["position_bin"]) for r in got["layout"].collect()}
    assert layout == {"e1": ("single", "early"), "e5": ("single", "early"), "e7": ("single", "early")}
    groups = {r["episode_id"]: r["group_id"] for r in got["groups"].collect()}
    assert groups["e1"] == groups["e7"] != groups["e2"]
    first = got["evidence"].where("episode_id = 'e2' and sequence_index = 0").first()
    assert first["evidence_id"] == "e2:evidence:000:e2-s0"


def test_rebuilt_observability(spark, data):
    nodes = trees.generate(spark, "canonical_balanced", 4)
    cached = F.col("node") == "node_B_2_3"
    source = F.when(cached, "cache").otherwise("generated")
    # Two generated merges and four generated leaves, each bound to an accepted attempt of its own; one merge from the cache.
    made = nodes.where(~cached).select("node", F.row_number().over(Window.orderBy("node")).alias("n"))
    log = made.select(F.col("n").cast("bigint").alias("attempt_id"), F.lit(1).cast("bigint").alias("run_id"), F.when(F.col("node").startswith("leaf"), "leaf").otherwise("merge").alias("stage"), F.col("n").cast("bigint").alias("logical_call_id"), F.lit("accepted").alias("outcome"), F.lit("accepted_materialized").alias("attempt_outcome"), F.lit(True).alias("accepted_attempt"), *[F.lit(5).cast("bigint").alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "seconds")], F.lit("2024-01-01").cast("timestamp").alias("started_at"))
    bindings = made.join(log, F.col("n") == F.col("attempt_id")).select(F.concat(F.lit("b-"), "node").alias("binding_id"), "run_id", "stage", "logical_call_id", F.col("attempt_id").alias("accepted_attempt_id"), F.col("node").alias("output_artifact_id"), F.lit("succeeded").alias("binding_status"))
    events = nodes.where("kind = 'internal'").select(F.concat(F.lit("ev-"), "node").alias("event_id"), F.lit(1).cast("bigint").alias("run_id"), (F.lit(100) + F.col("lo")).cast("bigint").alias("logical_call_id"), F.when(~cached, F.concat(F.lit("b-"), "node")).alias("binding_id"), F.when(cached, "node_B_0_1").alias("cache_of"), "plan_id", "k", "node", F.col("left").alias("left_node"), F.col("right").alias("right_node"), F.col("left").alias("left_id"), F.col("right").alias("right_id"), F.col("node").alias("output_id"), F.lit(100).cast("bigint").alias("budget"), F.lit(90).cast("bigint").alias("payload_tokens"), source.alias("source"))
    artifacts = nodes.select("node", F.lit(1).cast("bigint").alias("run_id"), F.lit("h").alias("content_hash"), F.lit(50).cast("bigint").alias("tokens"), F.lit(100).alias("capacity"), F.lit("t").alias("tokenizer"), F.lit("1").alias("version"), source.alias("source"), F.when(cached, "node_B_0_1").alias("cache_of"))
    got = pipelines.rebuilt_observability(nodes, log, bindings, events, artifacts)
    for name in ("plan_problems", "event_problems", "binding_problems", "artifact_problems"):
        assert got[name].collect() == [], name
    assert {(r["pressure"], r["compression"], r["imbalance_signed"]) for r in got["merge_metrics"].collect()} == {(1.0, 0.5, 0.0)}
    exposure = {r["leaf"]: (r["rewrites"], r["earlier_share"]) for r in got["exposure"].collect()}
    assert exposure == {0: (2, 1.0), 1: (2, 0.5), 2: (1, 0.0), 3: (1, 0.0)}
    assert all(r["generative"] for r in got["lineage"].collect())
    assert got["work"].count() == 1
    lost = pipelines.rebuilt_observability(nodes, log.where("attempt_id <> 1"), bindings, events, artifacts.where("node <> 'leaf_0'"))
    assert [(r["event_id"], r["problem"]) for r in lost["event_problems"].collect()] == [("ev-node_B_0_1", "artifact_missing")]
    assert [r["problem"] for r in lost["binding_problems"].collect()] == ["unknown_attempt"]


def test_formulas(spark):
    ep = spark.createDataFrame([(t,) for t in (50, 100, 300, 900)], "tokens bigint")
    fit = derived.raw_fit(ep, (64, 128, 512, 1024))
    assert [tuple(r) for r in fit.orderBy("budget").collect()] == [(64, 0.25), (128, 0.5), (512, 0.75), (1024, 1.0)]
    assert {r["target"]: r["budget"] for r in derived.chosen_budgets(fit).collect()} == {0.25: 64, 0.5: 128, 0.75: 512, 0.95: 1024}
    s = derived.saturation(spark.createDataFrame([(0.99, 0.96), (0.8, 0.7), (0.8, 0.79)], "full double, memory double")).collect()
    assert [r["class"] for r in s] == ["ceiling", "gap", "parity"]
    p = derived.pareto(spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.4), ("a", 2, 0.9), ("a", 3, 0.9)], "g string, cost int, q double"), ["g"], "cost", "q")
    assert sorted((r["cost"], r["q"]) for r in p.collect()) == [(1, 0.5), (2, 0.9)]
    d = derived.decision(spark.createDataFrame([(0.12, 0.01, 0.1, True, True, 0), (0.07, 0.01, 0.1, True, True, 0), (0.01, 0.5, 0.1, False, True, 0)], "delta double, p_value double, delta_decision double, ci_excludes_zero boolean, judge_passes boolean, violations int")).collect()
    assert [r["band"] for r in d] == ["go", "undecidable", "no_signal"]
    w = derived.win_tie_loss(spark.createDataFrame([(0.1,), (0.0,), (-0.2,), (0.3,)], "diff double")).first()
    assert tuple(w) == (2, 1, 1)


def test_call_logs(spark):
    calls = spark.createDataFrame([(c, i != 0, float(i)) for c in (1, 4) for i in range(20)], "concurrency int, ok boolean, seconds double")
    assert {(r["calls"], r["successes"], r["p95"], r["passes"]) for r in derived.call_rollup(calls, "concurrency").collect()} == {(20, 19, 18.0, True)}
    cause = derived.stall_cause(spark.createDataFrame([("r", "HTTP 403"), ("r", "timeout"), ("s", None)], "run string, error string"), [("forbidden", "403"), ("timeout", "timeout")], "run")
    assert {r["run"]: r["cause"] for r in cause.collect()} == {"r": "forbidden", "s": "unknown"}
    a = json.dumps({"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 1}}})
    b = json.dumps({"output": [{"content": [{"text": "ho"}]}], "usage": {"input_tokens": 7, "output_tokens": 3, "output_tokens_details": {"reasoning_tokens": 2}}})
    got = spark.createDataFrame([(a,), (b,), ("not json",)], "p string").select(derived.response_text(F.col("p")).alias("t"), derived.usage(F.col("p")).alias("u")).collect()
    assert [(r["t"], *r["u"]) for r in got] == [("hi", 5, 1, 2, None), ("ho", 7, None, 3, 2), (None, None, None, None, None)]
    stalled = worklog.retrieval_stalled(spark.createDataFrame([("f", "direct", False), ("f", "proxy", False), ("g", "direct", False), ("g", "proxy", True)], "file string, route string, success boolean"), ("direct", "proxy"))
    assert [r["file"] for r in stalled.collect()] == ["f"]
