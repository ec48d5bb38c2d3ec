"""Checks of pricing payloads, on JSON as VARIANT columns.

A field is looked at with the kind of value that is there, so a wrong type is told from a
missing field and from a null. Everything is one projection over the payloads; the rows
of a payload's models are read by higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The endpoint that must be priced, and the quota units of a dollar.
ENDPOINT, METHOD, QUOTA = "/v1/chat/completions", "POST", 500_000


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kind(v: Column, path: str) -> Column:
    """missing, null, or the kind of the value: string, number, boolean, array, object."""
    inner = F.try_variant_get(v, path, "variant")
    name = lambda s: F.when(s == "VOID", "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(s.isNull(), "missing").otherwise("number")
    return _once(F.schema_of_variant(inner), name)


def _field(v: Column, path: str, want: str, rule: Column | None = None) -> Column:
    """``name:missing``, ``name:null``, ``name:wrong_type`` or, where ``rule`` does not hold, ``name:invalid``; null if it is as it must be."""
    name = path.removeprefix("$.")

    def problem(found: Column) -> Column:
        wrong = F.when(found.isin("missing", "null"), F.concat(F.lit(f"{name}:"), found)).when(found != want, F.lit(f"{name}:wrong_type"))
        return wrong if rule is None else wrong.when(~F.coalesce(rule, F.lit(False)), F.lit(f"{name}:invalid"))

    return _once(kind(v, path), problem)


def _number(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "decimal(30,12)")


def _model_problems(row: Column, groups: Column, model: str) -> Column:
    enabled = F.try_variant_get(row, "$.enable_groups", "array<string>")
    checks = [
        _field(row, "$.quota_type", "number", _number(row, "$.quota_type") == 0),
        _field(row, "$.model_ratio", "number", _number(row, "$.model_ratio") > 0), _field(row, "$.completion_ratio", "number", _number(row, "$.completion_ratio") > 0),
        _field(row, "$.supported_endpoint_types", "array", F.array_contains(F.try_variant_get(row, "$.supported_endpoint_types", "array<string>"), "openai")),
        _field(row, "$.enable_groups", "array", (F.size(enabled) > 0) & F.forall(enabled, lambda g: F.array_contains(F.map_keys(groups), g))),
    ]
    return F.transform(F.array_compact(F.array(*checks)), lambda c: F.concat(F.lit(f"{model}."), c))


def pricing_problems(pricing: Column, models: list[str]) -> Column:
    """Sorted names of what is wrong with a pricing reply (JSON text) for the models that must be in it; empty if nothing is."""
    text = lambda v, path: F.try_variant_get(v, path, "string")
    none = F.array().cast("array<string>")
    number = lambda x: F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.try_variant_get(x, "$", "decimal(30,12)") > 0)

    def of_payload(v: Column) -> Column:
        own = F.array(
            _field(v, "$.success", "boolean", F.try_variant_get(v, "$.success", "boolean")), _field(v, "$.pricing_version", "string", F.trim(text(v, "$.pricing_version")) != ""),
            _field(v, "$.supported_endpoint", "object"), _field(v, "$.supported_endpoint.openai", "object"),
            _field(v, "$.supported_endpoint.openai.path", "string", text(v, "$.supported_endpoint.openai.path") == ENDPOINT),
            _field(v, "$.supported_endpoint.openai.method", "string", F.upper(text(v, "$.supported_endpoint.openai.method")) == METHOD),
            _field(v, "$.group_ratio", "object", F.size(F.try_variant_get(v, "$.group_ratio", "map<string,variant>")) > 0), _field(v, "$.data", "array"),
        )

        def of_model(model: str, groups: Column):
            return lambda row: F.when(row.isNull(), F.array(F.lit(f"{model}:missing"))).otherwise(_model_problems(row, groups, model))

        def of_groups(groups: Column) -> Column:
            bad = F.map_keys(F.map_filter(groups, lambda _, x: ~F.coalesce(number(x), F.lit(False))))
            out = [F.coalesce(F.transform(bad, lambda k: F.concat(F.lit("group_ratio["), k, F.lit("]:invalid"))), none)]
            for model in models:
                # The last row of a name counts.
                row = F.try_element_at(F.filter(F.try_variant_get(v, "$.data", "array<variant>"), lambda x: text(x, "$.model_name") == model), F.lit(-1))
                out.append(F.when(kind(v, "$.data") == "array", _once(row, of_model(model, groups))).otherwise(none))
            return F.concat(*out)

        inside = F.concat(F.array_compact(own), _once(F.try_variant_get(v, "$.group_ratio", "map<string,variant>"), of_groups))
        return F.when(v.isNull(), F.array(F.lit("payload:not_json"))).when(kind(v, "$") != "object", F.array(F.lit("payload:wrong_type"))).otherwise(F.array_sort(inside))

    return _once(F.try_parse_json(pricing), of_payload)


def pricing_rates(rows: DataFrame, raw: str, models: list[str]) -> DataFrame:
    """``rows`` with model, input_rate, output_rate (USD per million tokens) of payloads that ``pricing_problems`` finds nothing wrong with.

    The payable group is not known, so the largest group ratio counts.
    """
    sound = rows.where(F.size(pricing_problems(F.col(raw), models)) == 0).withColumn("_v", F.parse_json(raw))
    best = F.array_max(F.transform(F.map_values(F.variant_get("_v", "$.group_ratio", "map<string,variant>")), lambda x: F.variant_get(x, "$", "decimal(18,6)")))
    each = F.filter(F.variant_get("_v", "$.data", "array<variant>"), lambda x: F.try_variant_get(x, "$.model_name", "string").isin(models))
    exploded = sound.withColumn("_best", best).withColumn("_m", F.explode(each))
    rate = (F.variant_get("_m", "$.model_ratio", "decimal(18,6)") * F.col("_best") * F.lit(1_000_000) / F.lit(QUOTA)).cast("decimal(20,6)")
    out = exploded.withColumns({"model": F.variant_get("_m", "$.model_name", "string"), "input_rate": rate})
    return out.withColumn("output_rate", (F.col("input_rate") * F.variant_get("_m", "$.completion_ratio", "decimal(18,6)")).cast("decimal(20,6)")).drop("_v", "_best", "_m")
