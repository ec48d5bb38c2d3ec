"""Malformed fields of pricing payloads by name, rates, and hashes of replies."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from grovespan.operators import derived, payloads


def good(**more):
    row = {"model_name": "m", "quota_type": 0, "model_ratio": 1.25, "completion_ratio": 4, "enable_groups": ["a"], "supported_endpoint_types": ["openai", "x"]}
    return {"success": True, "pricing_version": "v1", "supported_endpoint": {"openai": {"path": "/v1/chat/completions", "method": "post"}}, "group_ratio": {"a": 1, "b": 2.5}, "data": [row | {"model_ratio": 9}, 3, row]} | more


def without(key):
    return {k: v for k, v in good().items() if k != key}


def row(**more):
    return good(data=[good()["data"][2] | more])


CASES = [
    (good(), []), (None, ["payload:not_json"]), ("{", ["payload:not_json"]), ([1], ["payload:wrong_type"]),
    (without("success"), ["success:missing"]), (good(success=None), ["success:null"]), (good(success="true"), ["success:wrong_type"]), (good(success=False), ["success:invalid"]),
    (good(pricing_version=" "), ["pricing_version:invalid"]), (good(pricing_version=3), ["pricing_version:wrong_type"]),
    (without("supported_endpoint"), ["supported_endpoint.openai.method:missing", "supported_endpoint.openai.path:missing", "supported_endpoint.openai:missing", "supported_endpoint:missing"]),
    (good(supported_endpoint={"openai": {"path": "/x", "method": 1}}), ["supported_endpoint.openai.method:wrong_type", "supported_endpoint.openai.path:invalid"]),
    (good(group_ratio={}), ["group_ratio:invalid", "m.enable_groups:invalid"]), (good(group_ratio={"a": 1, "b": -1, "c": "2", "d": None}), ["group_ratio[b]:invalid", "group_ratio[c]:invalid", "group_ratio[d]:invalid"]),
    (good(data={}), ["data:wrong_type"]), (without("data"), ["data:missing"]), (good(data=[]), ["m:missing"]), (good(data=[None, {"model_name": 3}]), ["m:missing"]),
    (row(quota_type=1), ["m.quota_type:invalid"]), (row(quota_type="0"), ["m.quota_type:wrong_type"]), (row(model_ratio=0), ["m.model_ratio:invalid"]), (row(completion_ratio=None), ["m.completion_ratio:null"]), (row(model_ratio=True), ["m.model_ratio:wrong_type"]),
    (row(enable_groups=[]), ["m.enable_groups:invalid"]), (row(enable_groups=["a", "z"]), ["m.enable_groups:invalid"]), (row(enable_groups="a"), ["m.enable_groups:wrong_type"]), (row(supported_endpoint_types=["x"]), ["m.supported_endpoint_types:invalid"]),
]


def test_problems_by_name(spark):
    rows = [(k, c if isinstance(c, str) or c is None else json.dumps(c)) for k, (c, _) in enumerate(CASES)]
    table = spark.createDataFrame(rows, "k int, raw string")
    got = {r["k"]: r["p"] for r in table.select("k", payloads.pricing_problems(F.col("raw"), ["m"]).alias("p")).collect()}
    assert {k: (CASES[k][0], got[k]) for k in got} == {k: (c, sorted(want)) for k, (c, want) in enumerate(CASES)}
    rates = payloads.pricing_rates(table, "raw", ["m"]).where("k = 0").orderBy("input_rate").collect()
    assert [(r["input_rate"], r["output_rate"]) for r in rates] == [(Decimal("6.25"), Decimal("25")), (Decimal("45"), Decimal("180"))]


def test_response_hash(spark):
    rows = [({"response_hash": "h", "response_sha256": "s"}, "h"), ({"response_hash": "", "response_sha256": "s"}, "s"), ({"response_hash": None, "response_sha256": "s"}, "s"), ({"response_hash": 5, "response_sha256": "s"}, None), ({"response_sha256": 5}, None), ({}, None), (None, None)]
    table = spark.createDataFrame([(k, None if c is None else json.dumps(c)) for k, (c, _) in enumerate(rows)], "k int, raw string")
    assert [r["h"] for r in table.orderBy("k").select(derived.response_hash(F.col("raw")).alias("h")).collect()] == [w for _, w in rows]
    uses = spark.createDataFrame([('{"usage": {"input_tokens": 1, "output_tokens": 2}}',), ('{"usage": {"input_tokens": 1}}',), ("x",)], "raw string")
    assert [r["a"] for r in uses.select(derived.usage_available(derived.usage(F.col("raw"))).alias("a")).collect()] == [True, False, False]


def test_replies(spark):
    replies = [
        ({"output_text": "a", "output": [{"text": "b"}]}, "a"), ({"output_text": 3, "output": [{"content": [{"text": "x"}, {"text": 1}, 5, {"text": "y"}]}, {"text": "z"}, 7]}, "xyz"), ({"output": [], "choices": [{"message": {"content": "c"}}]}, "c"),
        ({"output": "s", "choices": [{"message": {"content": "c"}}, {"message": {"content": "d"}}]}, "c"), ({"output": [{"content": "plain", "text": "t"}]}, "t"), ({"choices": []}, None), ({"choices": [{"message": {"content": None}}]}, None), ({}, None), ("{", None), (None, None),
    ]
    table = spark.createDataFrame([(k, c if isinstance(c, str) or c is None else json.dumps(c)) for k, (c, _) in enumerate(replies)], "k int, raw string")
    assert [r["t"] for r in table.orderBy("k").select(derived.response_text(F.col("raw")).alias("t")).collect()] == [w for _, w in replies]
    uses = [({"usage": {"input_tokens": 3, "completion_tokens": 4.9}}, (3, 4)), ({"usage": {"prompt_tokens": "3"}}, (None, None)), ({"usage": None}, (None, None)), ({"usage": {"input_tokens": None, "prompt_tokens": 5}}, (None, None)), (None, (None, None))]
    table = spark.createDataFrame([(k, None if c is None else json.dumps(c)) for k, (c, _) in enumerate(uses)], "k int, raw string")
    assert [(r["u"]["input"], r["u"]["output"]) for r in table.orderBy("k").select(derived.usage(F.col("raw")).alias("u")).collect()] == [w for _, w in uses]
