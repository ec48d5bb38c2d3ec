"""Leakage groups from the values that episodes share, and splits dealt from a sorted stream."""

import random

import pytest

from grovespan.operators import graph

from test_operators import brute_splits


@pytest.mark.parametrize("hot", [2, 1_000])
def test_only_shared_values_are_kept(spark, monkeypatch, hot):
    monkeypatch.setattr(graph, "HOT_SAMPLE", 1)
    monkeypatch.setattr(graph, "HOT", hot)
    rng = random.Random(hot)
    rows = [(rng.randint(0, 300), rng.choice("ab"), str(rng.randint(0, 400))) for _ in range(400)]
    rows += [(k, "hot", "h") for k in range(0, 300, 3)] + [(500, "a", "own"), (500, "a", "own"), (501, "b", ""), (502, "a", None), (503, None, "x"), (504, None, "x")]
    held: dict = {}
    for e, r, v in rows:
        if v:
            held.setdefault((r, v), set()).add(e)
    relations = spark.createDataFrame(rows, "episode_id bigint, relation string, value string").repartition(3)
    kept = [tuple(x) for x in graph.shared_edges(relations).collect()]
    assert len(kept) == len(set(kept))
    per: dict = {}
    for e, r, v in kept:
        per.setdefault((r, v), set()).add(e)
    assert sorted(map(sorted, (x for x in per.values() if len(x) > 1))) == sorted(map(sorted, (x for x in held.values() if len(x) > 1)))
    assert hot == 2 or all(len(x) > 1 for x in per.values())
    got = {x["episode_id"]: x for x in graph.leakage_groups(relations).collect()}
    assert got.keys() == {e for e, *_ in rows} and got[500]["group_size"] == got[501]["group_size"] == 1
    assert got[503]["group_id"] == got[504]["group_id"] and got[503]["relations"] == ""
    for x in held.values():
        assert len({got[e]["group_id"] for e in x}) == 1


def test_splits_are_dealt_from_a_stream(spark):
    rng = random.Random(5)
    groups = {f"g{i}" if i % 7 else f"é{i}\"": [("a", p := rng.randint(0, 1), p + 1)] for i in range(150)}
    rows = spark.createDataFrame([(g, *x) for g, own in groups.items() for x in own], "group_id string, question_type string, primary bigint, expanded bigint")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for candidate in graph.SPLITS:
            out = graph.assign_splits(rows, candidate)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and "GroupsInPandas" not in plan
            assert {r["group_id"]: r["split"] for r in out.collect()} == brute_splits(groups, candidate)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
