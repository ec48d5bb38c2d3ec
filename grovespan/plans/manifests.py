"""Queries of manifest checks, over made rows that keep and break each rule, with SQL of the same rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifests, stats
from ..sources.tables import load
from .protocol import _codes, _odd, _rows, _select, query

_RATIOS = {
    "candidate": "CAST(s_suppkey AS INT)",
    "development": "CAST(CASE s_suppkey % 5 WHEN 0 THEN 0.2 WHEN 1 THEN 0.15 WHEN 2 THEN 0.1 WHEN 3 THEN 0.3 ELSE 1.2 END AS DOUBLE)",
    "calibration": "CAST(CASE s_suppkey % 5 WHEN 0 THEN 0.3 WHEN 1 THEN 0.25 WHEN 2 THEN 0.3 WHEN 3 THEN 0.3 ELSE 0.1 END AS DOUBLE)",
    "acceptance": "CAST(CASE s_suppkey % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.6 WHEN 2 THEN 0.7 WHEN 3 THEN 0.4 ELSE 0.1 END AS DOUBLE)",
}
_INSIDE = "least(development, calibration, acceptance) > 0 AND greatest(development, calibration, acceptance) < 1"
_WHOLE = "abs(development + calibration + acceptance - 1) <= 1e-12"
_KNOWN = " OR ".join(f"(abs(development - {a / 100}) <= 1e-12 AND abs(calibration - {b / 100}) <= 1e-12 AND abs(acceptance - {c / 100}) <= 1e-12)" for a, b, c in manifests.SPLITS.values())


@query(f"""WITH r AS ({_select(_RATIOS, 'supplier')}), g AS (SELECT *, {_INSIDE} AS inside, {_WHOLE} AS whole, {_KNOWN} AS known FROM r),
f AS (SELECT *, min(candidate) FILTER (inside AND whole) OVER (PARTITION BY development, calibration, acceptance) AS first FROM g),
c AS (SELECT candidate, {_codes({'range': 'inside', 'sum': 'NOT inside OR whole', 'not_preregistered': 'NOT inside OR NOT whole OR known', 'repeated': 'NOT inside OR NOT whole OR first = candidate'})} AS codes FROM f)
SELECT * FROM c WHERE codes <> ''""")
def split_ratio_problems(spark, sf_dir):
    return manifests.ratio_problems(_rows(spark, sf_dir, _RATIOS, "supplier"))


_COUNTS = {
    "candidate": "CAST(o_orderkey AS BIGINT)", "split": "CASE o_custkey % 13 WHEN 0 THEN 'test' ELSE 'development' END",
    "N_master": "CAST(50 + o_orderkey % 3 AS INT)", "N4": "CAST(40 AS INT)", "N8": "CAST(CASE o_orderkey % 6 WHEN 1 THEN 45 ELSE 30 END AS INT)",
    "N16": "CAST(CASE o_orderkey % 10 WHEN 2 THEN -1 WHEN 4 THEN NULL ELSE 20 END AS INT)",
}
_OTHERS = " UNION ALL ".join(f"SELECT candidate, '{n}' AS split, 20 AS N_master, 15 AS N4, 10 AS N8, 5 AS N16 FROM a{where}" for n, where in (("calibration", ""), ("acceptance", " WHERE candidate % 11 <> 0")))
_TOTALS = {"N_master": 90, "N4": 70, "N8": 50, "N16": 30}


@query(f"""WITH a AS ({_select(_COUNTS, 'orders')}), r AS (SELECT * FROM a UNION ALL {_OTHERS}),
p AS (SELECT candidate, count(*) AS n, count(DISTINCT split) FILTER (split <> 'test') AS splits, bool_and(coalesce(least(N4, N8) >= 0 AND N16 >= 0, false)) AS ok, bool_and(coalesce(N_master >= N4 AND N4 >= N8 AND N8 >= N16, true)) AS ordered, sum(N_master) AS m, sum(N4) AS n4, sum(N8) AS n8, sum(N16) AS n16 FROM r GROUP BY 1),
g AS (SELECT *, n = 3 AND splits = 3 AS whole FROM p),
c AS (SELECT candidate, {_codes({'splits': 'whole', 'counts': 'NOT whole OR ok', 'order': 'NOT (whole AND ok) OR ordered'} | {f'sum_{n}': f'NOT (whole AND ok) OR {x} = {_TOTALS[n]}' for n, x in (('N_master', 'm'), ('N4', 'n4'), ('N8', 'n8'), ('N16', 'n16'))})} AS codes FROM g)
SELECT * FROM c WHERE codes <> ''""")
def split_count_problems(spark, sf_dir):
    a = _rows(spark, sf_dir, _COUNTS, "orders")
    fixed = {"N_master": 20, "N4": 15, "N8": 10, "N16": 5}
    more = [a.where(where).select("candidate", F.lit(n).alias("split"), *[F.lit(v).alias(c) for c, v in fixed.items()]) for n, where in (("calibration", "true"), ("acceptance", "candidate % 11 <> 0"))]
    return manifests.split_count_problems(a.unionByName(more[0]).unionByName(more[1]), _TOTALS)


#: The two primary categories.
CATEGORIES = ("knowledge-update", "temporal-reasoning")
_STRATA = {
    "candidate": "CAST(l_orderkey AS BIGINT)",
    "question_type": "CASE l_linenumber % 4 WHEN 1 THEN 'knowledge-update' WHEN 2 THEN 'temporal-reasoning' WHEN 3 THEN 'temporal-reasoning' ELSE CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'other' END END",
    "support_leaf_class": "CASE WHEN l_partkey % 31 = 0 THEN 'none' ELSE 'single' END", "evidence_position_bin": "CASE WHEN l_suppkey % 6 = 0 THEN 'end' ELSE 'late' END",
    "count": "CAST(CASE WHEN l_partkey % 23 = 0 THEN 0 ELSE 4 END AS BIGINT)",
}


@query(f"""WITH r AS ({_select(_STRATA, 'lineitem')}), a AS (SELECT o_orderkey AS candidate, 4 * (o_orderkey % 4 + 1) AS n8 FROM orders UNION ALL SELECT -s_suppkey, 4 FROM supplier),
v AS (SELECT * FROM r WHERE question_type IS NOT NULL AND "count" > 0), cells AS (SELECT candidate, question_type, count(*) AS n, sum("count") AS total FROM v GROUP BY candidate, question_type, support_leaf_class, evidence_position_bin),
s AS (SELECT candidate, sum(total) AS total, count(DISTINCT CASE WHEN question_type <> 'other' THEN question_type END) AS kinds FROM cells GROUP BY 1),
w AS (SELECT a.candidate, n8, s.total, coalesce(kinds, 0) AS kinds, a.candidate IN (SELECT candidate FROM r) AS given FROM a LEFT JOIN s USING (candidate))
SELECT candidate, 'question_type' AS problem, count(*) AS n FROM r WHERE question_type IS NULL OR question_type = 'other' GROUP BY 1
UNION ALL SELECT candidate, 'support_leaf_class', count(*) FROM r WHERE support_leaf_class = 'none' GROUP BY 1
UNION ALL SELECT candidate, 'evidence_position_bin', count(*) FROM r WHERE evidence_position_bin = 'end' GROUP BY 1
UNION ALL SELECT candidate, 'count', count(*) FROM r WHERE "count" = 0 GROUP BY 1
UNION ALL SELECT candidate, 'repeated', sum(n - 1)::BIGINT FROM cells WHERE n > 1 GROUP BY 1
UNION ALL SELECT candidate, 'empty', 1 FROM w WHERE NOT given UNION ALL SELECT candidate, 'sum', 1 FROM w WHERE given AND coalesce(total, 0) <> n8
UNION ALL SELECT candidate, 'category_missing', 2 - kinds FROM w WHERE given AND kinds < 2""")
def stratum_problems(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("candidate"), (F.col("o_orderkey") % 4 * 4 + 4).cast("bigint").alias("n8"))
    none = load(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).cast("bigint").alias("candidate"), F.lit(4).cast("bigint").alias("n8"))
    return manifests.stratum_problems(_rows(spark, sf_dir, _STRATA, "lineitem"), orders.unionByName(none), CATEGORIES)


#: The components of the cost bound.
COMPONENTS = ("primary", "replication", "SATURATION", "D_leaf", "future_k_sweep")
_WORK = {
    "row_id": "CAST(o_orderkey AS BIGINT)", "component": "CASE o_custkey % 6 WHEN 0 THEN 'primary' WHEN 1 THEN 'replication' WHEN 2 THEN 'SATURATION' WHEN 3 THEN 'D_leaf' WHEN 4 THEN 'primary' ELSE 'extra' END",
    "model": _odd(19, "'x'", "'m1'"), "logical": "CAST(o_custkey % 50 - 1 AS BIGINT)",
    "billable": f"CAST((o_custkey % 50 - 1) * 2 + {_odd(9, '1', '0')} AS BIGINT)", "input_cap": "CAST(1000 AS BIGINT)", "output_cap": _odd(37, "CAST(NULL AS BIGINT)", "CAST(7 AS BIGINT)"),
    "input_total": f"CAST((o_custkey % 50 - 1) * 2000 + {_odd(8, '5', '0')} AS BIGINT)", "output_total": "CAST((o_custkey % 50 - 1) * 14 AS BIGINT)",
    "micro_usd": f"CAST((o_custkey % 50 - 1) * 5000 + (o_custkey % 50 - 1) * 140 + {_odd(21, '1', '0')} AS BIGINT)",
}
_SUMS = ("logical", "billable", "input_total", "output_total", "micro_usd")
_WORK_SQL = {
    "component": "component <> 'extra'", "model": "model = 'm1'", "negative": "output_cap >= 0 AND logical >= 0 AND billable >= 0 AND input_total >= 0 AND output_total >= 0",
    "billable": "billable = logical * 2", "input_total": "input_total = billable * input_cap", "output_total": "output_total = billable * output_cap",
    "money": "model <> 'm1' OR micro_usd = ceil(input_total * 2.5) + ceil(output_total * 10.0)",
}


@query(f"WITH r AS ({_select(_WORK, 'orders')}), c AS (SELECT row_id, {_codes(_WORK_SQL)} AS codes FROM r) SELECT * FROM c WHERE codes <> ''")
def workload_problems(spark, sf_dir):
    rates = spark.createDataFrame([("m1", "2.5", "10")], "model string, input string, output string")
    return manifests.workload_problems(_rows(spark, sf_dir, _WORK, "orders"), rates, COMPONENTS)


@query(f"""WITH r AS ({_select(_WORK, 'orders')}), s AS (SELECT component, {', '.join(f'sum({n}) AS {n}' for n in _SUMS)} FROM r GROUP BY 1),
d AS (SELECT component, CASE component WHEN 'D_leaf' THEN 'open' ELSE 'frozen' END AS status, logical, billable + CASE component WHEN 'primary' THEN 1 ELSE 0 END AS billable, input_total, output_total, micro_usd FROM s WHERE component <> 'replication'),
q AS (SELECT unnest({list(COMPONENTS)}) AS component), j AS (SELECT coalesce(q.component, s.component) AS component, q.component IS NOT NULL AS wanted, s.component IS NOT NULL AS given, d.component IS NOT NULL AS named, d.status, {', '.join(f'NOT (s.component IS NOT NULL AND d.component IS NOT NULL) OR s.{n} = d.{n} AS k_{n}' for n in _SUMS)} FROM q FULL JOIN s ON s.component = q.component LEFT JOIN d ON d.component = coalesce(q.component, s.component)),
c AS (SELECT component, {_codes({'unknown': 'wanted', 'no_rows': 'NOT wanted OR given', 'not_declared': 'NOT wanted OR named', 'not_frozen': "NOT named OR status = 'frozen'"} | {n: f'k_{n}' for n in _SUMS})} AS codes FROM j)
SELECT * FROM c WHERE codes <> ''""")
def component_problems(spark, sf_dir):
    rows = _rows(spark, sf_dir, _WORK, "orders")
    sums = rows.groupBy("component").agg(*[F.sum(n).alias(n) for n in _SUMS]).where("component <> 'replication'")
    declared = sums.withColumn("billable", F.col("billable") + F.when(F.col("component") == "primary", 1).otherwise(0)).withColumn("status", F.when(F.col("component") == "D_leaf", "open").otherwise("frozen"))
    return manifests.component_problems(rows, declared, COMPONENTS)


_AUDIT = {
    "audit_id": "CAST(o_orderkey AS BIGINT)", "status": _odd(7, "'failed'", _odd(2, "'qualified'", "'qualified_with_exclusions'")), "no_silent_drop": _odd(11, "false", "true"),
    "body": "concat('{\"audit\":', CAST(o_orderkey AS STRING), '}')", "tampered": "o_orderkey % 13 = 0", "power": "concat('{\"power\":', CAST(o_orderkey AS STRING), '}')",
    "power_status": _odd(5, "'blocked'", "'passed'"), "custkey": "CAST(o_custkey AS BIGINT)",
}
_BOUND_SQL = {
    "audit_status": "status <> 'failed'", "silent_drop": "no_silent_drop", "audit_hash": "NOT tampered", "power_status": "audit_id % 17 <> 0 AND power_status = 'passed'",
    "artifact_hash": "audit_id % 17 <> 0 AND custkey % 9 <> 0", "not_bound": "audit_id % 17 <> 0 AND custkey % 10 <> 0",
    "candidate": "custkey % 8 NOT IN (0, 1)", "assignment_hash": "audit_id % 17 <> 0 AND custkey % 8 <> 0 AND custkey % 15 <> 0",
}


@query(f"WITH r AS ({_select(_AUDIT, 'orders')}), c AS (SELECT audit_id, {_codes(_BOUND_SQL)} AS codes FROM r) SELECT * FROM c WHERE codes <> ''")
def bound_audits(spark, sf_dir):
    """Audits and power artifacts with true and false hashes; candidates that are missing (custkey % 8 = 0) or there twice (1)."""
    r = _rows(spark, sf_dir, _AUDIT, "orders")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    r = r.withColumn("audit_hash", F.when(F.col("tampered"), "x").otherwise(digest("body")))
    powers = r.where("audit_id % 17 <> 0").select(
        "audit_id", F.col("power_status").alias("status"), F.col("power").alias("body"), F.when(F.col("custkey") % 9 == 0, "x").otherwise(digest("power")).alias("artifact_hash"),
        F.when(F.col("custkey") % 10 == 0, "y").otherwise(F.col("audit_hash")).alias("input_audit_hash"), F.when(F.col("custkey") % 15 == 0, "z").otherwise("a").alias("split_assignment_hash"))
    named = r.where("custkey % 8 <> 0").select("audit_id", F.explode(F.expr("CASE WHEN custkey % 8 = 1 THEN array('20/30/50', '20/30/50') ELSE array('20/30/50', '15/25/60') END")).alias("candidate_id"), F.lit("a").alias("assignment_hash"))
    return manifests.binding_problems(r, powers, named, "20/30/50")


_RATES = "SELECT (l_suppkey % 3)::INT AS candidate, ((l_linenumber - 4) * 0.05)::DOUBLE AS effect, (CASE WHEN l_suppkey % 3 = 0 THEN 0.5 ELSE 0.7 END + l_partkey % 10 * 0.001 + abs(l_linenumber - 4) * 0.05)::DOUBLE AS lower FROM lineitem"


@query(f"""WITH r AS ({_RATES}), w AS (SELECT candidate, round(abs(effect), 6) AS delta, min(round(lower, 6)) AS lower, min(round(lower, 6)) + 0.01 AS power FROM r WHERE round(abs(effect), 6) IN {stats.DECISION_GRID} GROUP BY ALL),
f AS (SELECT * FROM w WHERE lower >= 0.8 ORDER BY candidate, delta LIMIT 1), b AS (SELECT * FROM w ORDER BY lower DESC, candidate, delta LIMIT 1)
SELECT CASE WHEN f.candidate IS NULL THEN 'blocked' ELSE 'passed' END AS status, f.candidate, f.delta, round(f.power, 8) AS power, round(f.lower, 8) AS lower, b.candidate AS best_candidate, b.delta AS best_delta, round(b.lower, 8) AS best_lower FROM b LEFT JOIN f ON true""")
def chosen_design(spark, sf_dir):
    size = F.abs(F.col("l_linenumber") - 4) * 0.05
    lower = F.round(F.when(F.col("l_suppkey") % 3 == 0, 0.5).otherwise(0.7) + F.col("l_partkey") % 10 * 0.001 + size, 6)
    r = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).cast("int").alias("candidate"), ((F.col("l_linenumber") - 4) * 0.05).alias("effect"), lower.alias("lower"), (lower + 0.01).alias("power"))
    one = stats.choose_design(r)
    return one.withColumns({n: F.round(n, 8) for n in ("power", "lower", "best_lower")})
