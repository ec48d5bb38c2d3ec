"""Checks of declared manifests against what their rows add up to.

Every check reports all that is wrong and stops at nothing: the results are one row
per manifest part with the names of the rules that it breaks. Sums are partial
aggregates by key; joins are by equal keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import SPLIT_NAMES, SPLITS

#: The names of counts, from the widest to the narrowest, and of strata.
COUNT_NAMES = ("N_master", "N4", "N8", "N16")
SUPPORT_CLASSES = ("single", "multiple")
POSITION_BINS = ("early", "middle", "late")
BILLED = 2


def _codes(**broken: Column) -> Column:
    """The names of the conditions that hold (null counts as broken), in order, as one text."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(True)), F.lit(n)) for n, x in broken.items()])), ",")


def ratio_problems(ratios: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """candidate, codes of ``ratios(candidate, development, calibration, acceptance)``.

    A later candidate of a ratio that an earlier one has is ``repeated``; ratios out
    of range, or that do not sum to one, have no other code.
    """
    values = [F.col(n) for n in SPLIT_NAMES]
    inside, total = F.lit(True), F.lit(0.0)
    for v in values:
        inside &= (v > 0) & (v < 1)
        total += v
    whole = F.abs(total - 1.0) <= tolerance
    known = F.lit(False)
    for shares in SPLITS.values():
        same = F.lit(True)
        for v, share in zip(values, shares):
            same &= F.abs(v - share / 100) <= tolerance
        known |= same
    first = ratios.where(inside & whole).groupBy(*SPLIT_NAMES).agg(F.min("candidate").alias("first"))
    both = ratios.join(first, list(SPLIT_NAMES), "left")
    inside = F.coalesce(inside, F.lit(False))
    codes = _codes(range=~inside, sum=inside & ~whole, not_preregistered=inside & whole & ~known, repeated=inside & whole & (F.col("first") < F.col("candidate")))
    return both.select("candidate", codes.alias("codes")).where("codes <> ''")


def split_count_problems(counts: DataFrame, totals: dict[str, int]) -> DataFrame:
    """candidate, codes of ``counts(candidate, split, N_master, N4, N8, N16)`` against the totals of the corpus.

    A candidate without exactly the three splits, or with a count that is null or
    negative, has that code alone, for its sums say nothing.
    """
    bad, order = F.lit(False), F.lit(True)
    for name in COUNT_NAMES:
        bad |= F.coalesce(F.col(name) < 0, F.lit(True))
    for wide, narrow in zip(COUNT_NAMES, COUNT_NAMES[1:]):
        order &= F.col(wide) >= F.col(narrow)
    per = counts.groupBy("candidate").agg(
        F.count("*").alias("rows"), F.count_distinct(F.when(F.col("split").isin(*SPLIT_NAMES), F.col("split"))).alias("splits"),
        F.count_if(bad).alias("bad"), F.count_if(~order).alias("unordered"), *[F.sum(n).alias(n) for n in COUNT_NAMES])
    incomplete = (F.col("rows") != len(SPLIT_NAMES)) | (F.col("splits") != len(SPLIT_NAMES))
    counted = ~incomplete & (F.col("bad") == 0)
    sums = {f"sum_{n}": counted & (F.col(n) != totals[n]) for n in COUNT_NAMES}
    codes = _codes(splits=incomplete, counts=~incomplete & (F.col("bad") > 0), order=counted & (F.col("unordered") > 0), **sums)
    return per.select("candidate", codes.alias("codes")).where("codes <> ''")


def stratum_problems(strata: DataFrame, acceptance: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """candidate, problem, n of ``strata(candidate, question_type, support_leaf_class, evidence_position_bin, count)``.

    ``acceptance(candidate, n8)`` declares what a candidate's strata must sum to.
    Rows without a full key or a positive count are reported and not added up.
    """
    key = ("question_type", "support_leaf_class", "evidence_position_bin")
    known = {"question_type": categories, "support_leaf_class": SUPPORT_CLASSES, "evidence_position_bin": POSITION_BINS}
    odd = [F.when(~F.coalesce(F.col(k).isin(*known[k]), F.lit(False)), F.lit(k)) for k in key]
    odd.append(F.when(~F.coalesce(F.col("count") > 0, F.lit(False)), F.lit("count")))
    rows = strata.select("candidate", F.explode(F.array_compact(F.array(*odd))).alias("problem")).groupBy("candidate", "problem").agg(F.count("*").alias("n"))
    valid = strata.where(F.expr(" and ".join(f"{k} is not null" for k in key)) & (F.col("count") > 0))
    cells = valid.groupBy("candidate", *key).agg(F.count("*").alias("n"), F.sum("count").alias("total"))
    again = cells.where("n > 1").groupBy("candidate").agg(F.lit("repeated").alias("problem"), F.sum(F.col("n") - 1).alias("n"))
    sums = cells.groupBy("candidate").agg(F.sum("total").alias("total"), F.count_distinct(F.when(F.col("question_type").isin(*categories), F.col("question_type"))).alias("kinds"))
    given = strata.groupBy("candidate").agg(F.count("*").alias("given"))
    whole = acceptance.join(given, "candidate", "left").join(sums, "candidate", "left")
    one = F.lit(1).cast("bigint")
    empty = whole.where("given is null").select("candidate", F.lit("empty").alias("problem"), one.alias("n"))
    apart = whole.where("given is not null and coalesce(total, 0) <> n8").select("candidate", F.lit("sum").alias("problem"), one.alias("n"))
    lacking = (F.lit(len(categories)) - F.coalesce("kinds", F.lit(0))).cast("bigint")
    missing = whole.where("given is not null").select("candidate", F.lit("category_missing").alias("problem"), lacking.alias("n")).where("n > 0")
    return rows.unionByName(again).unionByName(empty).unionByName(apart).unionByName(missing)


def _micro_usd(tokens: Column, rate: Column) -> Column:
    """Tokens at USD per million tokens, in millionths of a dollar, rounded up."""
    return F.ceil(tokens.cast("decimal(20,0)") * rate.cast("decimal(18,6)")).cast("bigint")


def workload_problems(rows: DataFrame, rates: DataFrame, components: tuple[str, ...]) -> DataFrame:
    """row_id, codes of workload rows whose totals do not follow from their parts.

    ``rows(row_id, component, model, logical, billable, input_cap, output_cap, input_total, output_total, micro_usd)``,
    ``rates(model, input, output)`` in USD per million tokens. Money is recomputed
    from the declared token totals; without a rate it is unknown, not zero.
    """
    both = rows.join(rates, "model", "left")
    priced = _micro_usd(F.col("input_total"), F.col("input")) + _micro_usd(F.col("output_total"), F.col("output"))
    has = F.col("input").isNotNull() & F.col("output").isNotNull()
    least = F.least("logical", "billable", "input_cap", "output_cap", "input_total", "output_total")
    nulls = F.lit(False)
    for n in ("logical", "billable", "input_cap", "output_cap", "input_total", "output_total"):
        nulls |= F.col(n).isNull()
    codes = _codes(
        component=~F.col("component").isin(*components), model=~has, negative=nulls | (least < 0),
        billable=F.col("billable") != F.col("logical") * BILLED,
        input_total=F.col("input_total") != F.col("billable") * F.col("input_cap"),
        output_total=F.col("output_total") != F.col("billable") * F.col("output_cap"),
        money=has & (F.col("micro_usd").isNull() | (F.col("micro_usd") != priced)))
    return both.select("row_id", codes.alias("codes")).where("codes <> ''")


def component_problems(rows: DataFrame, declared: DataFrame, components: tuple[str, ...]) -> DataFrame:
    """component, codes where declared sums are not those of the workload rows.

    ``declared(component, status, logical, billable, input_total, output_total, micro_usd)``;
    a required component must have rows and a declaration, others neither.
    """
    fields = ("logical", "billable", "input_total", "output_total", "micro_usd")
    spark = rows.sparkSession
    required = spark.createDataFrame([(c,) for c in components], "component string").withColumn("required", F.lit(True))
    sums = rows.groupBy("component").agg(*[F.sum(f).alias(f"s_{f}") for f in fields], F.lit(True).alias("given"))
    both = required.join(sums, "component", "full").join(declared.withColumn("named", F.lit(True)), "component", "full")
    given, named, wanted = (F.coalesce(n, F.lit(False)) for n in ("given", "named", "required"))
    differ = {f: given & named & ~F.col(f).eqNullSafe(F.col(f"s_{f}")) for f in fields}
    codes = _codes(unknown=~wanted, no_rows=wanted & ~given, not_declared=wanted & ~named, not_frozen=named & ~F.col("status").eqNullSafe(F.lit("frozen")), **differ)
    return both.select("component", codes.alias("codes")).where("codes <> ''")


def binding_problems(audits: DataFrame, powers: DataFrame, candidates: DataFrame, chosen: str) -> DataFrame:
    """audit_id, codes of audits that a passed power artifact does not bind.

    ``audits(audit_id, status, no_silent_drop, body, audit_hash)``,
    ``powers(audit_id, status, body, artifact_hash, input_audit_hash, split_assignment_hash)``,
    ``candidates(audit_id, candidate_id, assignment_hash)``. Bodies are canonical
    JSON without their hash. The chosen candidate must be there exactly once.
    """
    picked = candidates.where(F.col("candidate_id") == chosen).groupBy("audit_id").agg(F.count("*").alias("n"), F.min("assignment_hash").alias("assigned"))
    artifact = powers.select("audit_id", F.col("status").alias("p_status"), F.col("body").alias("p_body"), "artifact_hash", "input_audit_hash", "split_assignment_hash")
    both = audits.join(artifact, "audit_id", "left").join(picked, "audit_id", "left")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    codes = _codes(
        audit_status=~F.col("status").isin("qualified", "qualified_with_exclusions"), silent_drop=~F.col("no_silent_drop"),
        audit_hash=F.col("audit_hash") != digest("body"), power_status=F.col("p_status") != "passed",
        artifact_hash=F.col("artifact_hash") != digest("p_body"), not_bound=F.col("input_audit_hash") != F.col("audit_hash"),
        candidate=F.coalesce("n", F.lit(0)) != 1, assignment_hash=F.col("split_assignment_hash") != F.col("assigned"))
    return both.select("audit_id", codes.alias("codes")).where("codes <> ''")
