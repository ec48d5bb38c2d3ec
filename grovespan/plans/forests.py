"""Queries of reduction trees, over the turns of conversations as leaves, and of cost and gates over table counts.

Trees of equal size are equal, so the plans are made once per distinct number of turns
and joined to the conversations that have it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cost, scores, trees
from ..sources.tables import EVIDENCE_SQL, evidence, load
from .protocol import query

EPISODE = ("episode_id", "plan_id")

EPISODES_SQL = "ep AS (SELECT conv_id AS episode_id, count(*)::INT AS k FROM conversations GROUP BY conv_id), ks AS (SELECT DISTINCT k FROM ep WHERE k > 1)"
NODES_SQL = f"""{EPISODES_SQL}, tree AS (SELECT k, 0 AS lo, k - 1 AS hi FROM ks UNION ALL SELECT k, unnest([lo, (lo + hi) // 2 + 1]), unnest([(lo + hi) // 2, hi]) FROM tree WHERE hi > lo),
at AS (SELECT k, unnest(range(k))::INT AS i FROM ks),
shape AS (SELECT 'left_deep' AS plan_id, k, 'node_L_' || i AS node, 'internal' AS kind, CASE WHEN i = 1 THEN 'leaf_0' ELSE 'node_L_' || (i - 1) END AS l, 'leaf_' || i AS r, 0 AS lo, i AS hi FROM at WHERE i > 0
  UNION ALL SELECT 'right_deep', k, 'node_R_' || i || '_' || (k - 1), 'internal', 'leaf_' || i, CASE WHEN i = k - 2 THEN 'leaf_' || (k - 1) ELSE 'node_R_' || (i + 1) || '_' || (k - 1) END, i, k - 1 FROM at WHERE i < k - 1
  UNION ALL SELECT 'canonical_balanced', k, 'node_B_' || lo || '_' || hi, 'internal', CASE WHEN lo = (lo + hi) // 2 THEN 'leaf_' || lo ELSE 'node_B_' || lo || '_' || ((lo + hi) // 2) END,
    CASE WHEN (lo + hi) // 2 + 1 = hi THEN 'leaf_' || hi ELSE 'node_B_' || ((lo + hi) // 2 + 1) || '_' || hi END, lo, hi FROM tree WHERE lo < hi
  UNION ALL SELECT p, k, 'leaf_' || i, 'leaf', NULL, NULL, i, i FROM at, (SELECT unnest(['left_deep', 'canonical_balanced', 'right_deep']) AS p)),
nodes AS (SELECT episode_id, plan_id, node, kind, l, r, lo::INT AS lo, hi::INT AS hi FROM shape JOIN ep USING (k))""".replace("at AS (", "places AS (").replace("FROM at", "FROM places")
NODES = f"WITH RECURSIVE {NODES_SQL}"
INNER = f"{NODES}, inside AS (SELECT * FROM nodes WHERE kind = 'internal')"
DEPTH = f"{INNER}, d AS (SELECT n.episode_id, n.plan_id, n.lo AS leaf, count(*)::BIGINT AS depth FROM nodes n JOIN inside i ON n.episode_id = i.episode_id AND n.plan_id = i.plan_id AND n.kind = 'leaf' AND n.lo BETWEEN i.lo AND i.hi GROUP BY ALL)"


def _episodes(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("episode_id")).agg(F.count("*").cast("int").alias("k"))


def _nodes(spark, sf_dir) -> DataFrame:
    return trees.of_episodes(_episodes(spark, sf_dir), tuple(scores.DIAGNOSTIC))


@query(f'{NODES} SELECT episode_id, plan_id, node, kind, l AS "left", r AS "right", lo, hi FROM nodes')
def plan_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).drop("k")


@query(f"{NODES} SELECT episode_id, plan_id, node, (row_number() OVER (PARTITION BY episode_id, plan_id ORDER BY hi, lo DESC) - 1)::INT AS step FROM nodes WHERE kind = 'internal'")
def merge_order(spark, sf_dir):
    return trees.merge_order(_nodes(spark, sf_dir), EPISODE).select(*EPISODE, "node", "step")


@query(f"{DEPTH} SELECT episode_id, plan_id, leaf, depth FROM d")
def leaf_depths(spark, sf_dir):
    return trees.leaf_depths(_nodes(spark, sf_dir), EPISODE)


@query(f"{DEPTH} SELECT episode_id, plan_id, max(depth) AS height, avg(depth) AS mean_depth, count(*)::BIGINT AS leaf_count, (count(*) - 1)::BIGINT AS merge_count FROM d GROUP BY episode_id, plan_id")
def plan_metrics(spark, sf_dir):
    return trees.plan_metrics(_nodes(spark, sf_dir), EPISODE)


@query(f"""{NODES}, c AS (SELECT n.episode_id, n.plan_id, n.lo, n.hi, m.hi AS mid FROM nodes n JOIN nodes m ON m.episode_id = n.episode_id AND m.plan_id = n.plan_id AND m.node = n.l WHERE n.kind = 'internal')
SELECT c.episode_id, c.plan_id, f.lo AS leaf, string_agg(CASE WHEN f.lo <= mid THEN 'E' ELSE 'L' END, '' ORDER BY c.hi - c.lo DESC) AS path
FROM c JOIN nodes f ON f.episode_id = c.episode_id AND f.plan_id = c.plan_id AND f.kind = 'leaf' AND f.lo BETWEEN c.lo AND c.hi GROUP BY ALL""")
def role_paths(spark, sf_dir):
    return trees.role_paths(_nodes(spark, sf_dir), EPISODE)


@query(f"""{DEPTH.replace('WITH RECURSIVE ', 'WITH RECURSIVE ' + EVIDENCE_SQL + ', ', 1)}, e AS (SELECT plan_id, episode_id, avg(depth) AS d_mean, max(depth) AS d_max, count(*)::BIGINT AS n_leaves, min(leaf) AS a, max(leaf) AS z
  FROM d JOIN evidence v USING (episode_id) WHERE v.sequence_index = d.leaf AND v.role = 'assistant' GROUP BY ALL)
SELECT e.plan_id, k, e.episode_id AS support_id, round(d_mean, 9) AS d_mean, d_max, (count(i.node) - CASE WHEN n_leaves > 1 THEN 1 ELSE 0 END)::BIGINT AS d_joint, n_leaves
FROM e JOIN ep USING (episode_id) LEFT JOIN inside i ON i.episode_id = e.episode_id AND i.plan_id = e.plan_id AND i.lo <= a AND i.hi >= z GROUP BY e.plan_id, k, e.episode_id, d_mean, d_max, n_leaves""")
def rewrite_distances(spark, sf_dir):
    """How far the assistant's turns of a conversation are from the root of each plan."""
    episodes = _episodes(spark, sf_dir)
    turns = evidence(spark, sf_dir).where("role = 'assistant'").join(episodes, "episode_id")
    supports = turns.select("k", F.col("episode_id").alias("support_id"), F.col("sequence_index").cast("int").alias("leaf"))
    nodes = trees.plan_table(episodes.select("k").distinct(), tuple(scores.DIAGNOSTIC))
    return trees.rewrite_distances(nodes, supports).withColumn("d_mean", F.round("d_mean", 9))


@query(f"""WITH {EPISODES_SQL}, n AS (SELECT episode_id, unnest(range(1, k + 1)) AS n FROM ep), b AS (SELECT episode_id, n, l, ((n >> (l + 1)) << (l + 1))::INT AS lo FROM n, (SELECT unnest(range(0, 31))::INT AS l) WHERE (n >> l) & 1 = 1)
SELECT episode_id, (n - 1)::INT AS prefix, CASE WHEN l = 0 THEN 'leaf_' || lo ELSE 'node_OB_' || lo || '_' || (lo + (1 << l) - 1) || '_L' || l END AS node, l AS level, lo, (lo + (1 << l) - 1)::INT AS hi,
(row_number() OVER (PARTITION BY episode_id, n ORDER BY l DESC) - 1)::INT AS position FROM b""")
def online_live_forest(spark, sf_dir):
    episodes = _episodes(spark, sf_dir)
    return episodes.join(trees.counter_forest(episodes.select("k").distinct()), "k").drop("k")


@query(f"""WITH {EPISODES_SQL}, n AS (SELECT episode_id, unnest(range(k))::INT AS p FROM ep)
SELECT episode_id, p AS leaf, l AS level, 'node_OB_' || (p + 1 - (1 << l)) || '_' || p || '_L' || l AS node, (p + 1 - (1 << l))::INT AS lo, p AS hi FROM n, (SELECT unnest(range(1, 31))::INT AS l) WHERE (p + 1) % (1 << l) = 0""")
def online_merge_events(spark, sf_dir):
    episodes = _episodes(spark, sf_dir)
    return episodes.join(trees.counter_merges(episodes.select("k").distinct()), "k").select("episode_id", "leaf", "level", "node", "lo", "hi")


# Of every four conversations one keeps its trees; the others get a root with equal children, with an unknown child, or a span that is cut short.
BROKEN = {"l": "CASE WHEN episode_id % 4 = 2 AND root THEN 'gone' ELSE l END", "r": "CASE WHEN episode_id % 4 = 1 AND root THEN l ELSE r END", "hi": "CASE WHEN episode_id % 4 = 3 AND root THEN hi - 1 ELSE hi END"}


@query(f"""{NODES}, b AS (SELECT episode_id, plan_id, node, kind, lo, {', '.join(f'{x} AS {n}' for n, x in BROKEN.items())} FROM (SELECT *, kind = 'internal' AND hi - lo + 1 = k AS root FROM nodes JOIN ep USING (episode_id))),
kids AS (SELECT episode_id, plan_id, node AS parent, lo AS plo, hi AS phi, unnest([l, r]) AS node, unnest([0, 1]) AS side FROM b WHERE kind = 'internal'),
placed AS (SELECT kids.*, b.lo, b.hi FROM kids LEFT JOIN b USING (episode_id, plan_id, node)),
cut AS (SELECT episode_id, plan_id, parent, plo, phi, max(lo) FILTER (side = 0) AS lo0, max(hi) FILTER (side = 0) AS hi0, max(lo) FILTER (side = 1) AS lo1, max(hi) FILTER (side = 1) AS hi1 FROM placed GROUP BY ALL),
top AS (SELECT episode_id, plan_id, count(*) AS n, min(node) AS node FROM b WHERE NOT EXISTS (SELECT 1 FROM kids WHERE kids.episode_id = b.episode_id AND kids.plan_id = b.plan_id AND kids.node = b.node) GROUP BY ALL)
SELECT episode_id, plan_id, node, 'children_missing_or_equal' AS problem FROM b WHERE kind = 'internal' AND l = r UNION ALL SELECT episode_id, plan_id, node, 'bad_span' FROM b WHERE lo > hi AND NOT (kind = 'internal' AND l = r)
UNION ALL SELECT episode_id, plan_id, node, 'child_reused' FROM kids GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT episode_id, plan_id, node, 'unknown_child' FROM placed WHERE lo IS NULL
UNION ALL SELECT episode_id, plan_id, parent, 'spans_not_contiguous' FROM cut WHERE lo0 <> plo OR hi1 <> phi OR hi0 + 1 <> lo1 UNION ALL SELECT episode_id, plan_id, node, 'not_one_root' FROM top WHERE n <> 1""".replace("top AS (", "tops AS (").replace("FROM top ", "FROM tops "))
def tree_violations(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).withColumnsRenamed({"left": "l", "right": "r"}).withColumn("root", F.expr("kind = 'internal' AND hi - lo + 1 = k"))
    broken = nodes.select("episode_id", "plan_id", "node", "kind", "lo", *[F.expr(x).alias({"l": "left", "r": "right"}.get(n, n)) for n, x in BROKEN.items()])
    return trees.violations(broken, EPISODE)


@query(f"""{NODES.replace('WITH RECURSIVE ', 'WITH RECURSIVE ' + EVIDENCE_SQL + ', ', 1)}, sums AS (SELECT n.episode_id, n.plan_id, n.node, sum(v.token_count)::BIGINT AS tokens FROM nodes n JOIN evidence v ON v.episode_id = n.episode_id AND v.sequence_index BETWEEN n.lo AND n.hi GROUP BY ALL),
m AS (SELECT n.episode_id, n.plan_id, n.lo, n.hi, c.hi AS mid, tokens / 512.0::DOUBLE AS pressure, tokens > 512 AS generative FROM nodes n JOIN sums USING (episode_id, plan_id, node) JOIN nodes c ON c.episode_id = n.episode_id AND c.plan_id = n.plan_id AND c.node = n.l WHERE n.kind = 'internal')
SELECT f.episode_id, f.plan_id, f.lo AS leaf, count(m.mid)::BIGINT AS rewrites, round(avg((f.lo <= m.mid)::INT), 9) AS earlier_share, round(sum(m.pressure), 9) AS pressure_sum, max(m.pressure) AS pressure_max
FROM nodes f LEFT JOIN m ON m.episode_id = f.episode_id AND m.plan_id = f.plan_id AND m.generative AND f.lo BETWEEN m.lo AND m.hi WHERE f.kind = 'leaf' GROUP BY ALL""")
def evidence_exposure(spark, sf_dir):
    """Rewrites of each turn by merges whose turns together pass a budget of 512 tokens."""
    nodes = _nodes(spark, sf_dir)
    tokens = evidence(spark, sf_dir).select("episode_id", "sequence_index", "token_count")
    inner = nodes.where("kind = 'internal'").select(*EPISODE, "node", F.explode(F.sequence("lo", "hi")).alias("sequence_index"))
    sums = inner.join(tokens, ["episode_id", "sequence_index"]).groupBy(*EPISODE, "node").agg(F.sum("token_count").alias("tokens"))
    pressures = sums.select(*EPISODE, "node", (F.col("tokens") > 512).alias("generative"), (F.col("tokens") / 512.0).alias("pressure"))
    e = trees.evidence_exposure(nodes, pressures, EPISODE)
    return e.select(*EPISODE, "leaf", "rewrites", F.round("earlier_share", 9).alias("earlier_share"), F.round("pressure_sum", 9).alias("pressure_sum"), "pressure_max")


# Cost and gates

@query("""WITH c AS (SELECT coalesce(source, '') AS corpus, count(*)::BIGINT AS e, (count(*) * 3 // 10)::BIGINT AS c FROM documents GROUP BY 1),
x AS (SELECT corpus, unnest(['primary', 'primary', 'replication', 'replication', 'SATURATION', 'SATURATION', 'D_leaf', 'D_leaf', 'future_k_sweep', 'future_k_sweep']) AS component,
  unnest(['generation', 'judge', 'generation', 'judge', 'generation', 'judge', 'generation', 'judge', 'generation', 'judge']) AS role,
  unnest([800 * c + 5288 * e, 99 * c + 1210 * e, 888 * e, 110 * e, 60 * c, 60 * c, 1600, 100, 9296 * e, 990 * e])::BIGINT AS logical FROM c)
SELECT corpus, component, role, logical, 2 * logical AS billable, 2000000 * logical AS input_tokens, 2 * logical * CASE role WHEN 'judge' THEN 128 ELSE 4096 END AS output_tokens FROM x""")
def cost_envelope(spark, sf_dir):
    """Call bounds of an experiment on each source, three tenths of whose documents calibrate."""
    n = F.count("*")
    counts = load(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("")).alias("corpus")).agg(n.alias("episodes"), F.floor(n * 3 / 10).alias("calibration"))
    return cost.envelopes(counts)


STAGES = ("network", "audit", "power", "judge")


@query("""WITH l AS (SELECT l_orderkey AS run_id, l_linenumber AS n, min(l_partkey) AS hash, bool_and(l_returnflag <> 'R') AS ok, min(l_suppkey) AS s FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL),
b AS (SELECT *, CASE WHEN s % 5 = 0 THEN 'other' ELSE (lag(hash) OVER (PARTITION BY run_id ORDER BY n))::VARCHAR END AS upstream FROM l),
g AS (SELECT *, ok AND n = row_number() OVER w AND (n = 1 OR coalesce(upstream = (lag(hash) OVER w)::VARCHAR, false)) AS fine FROM b WINDOW w AS (PARTITION BY run_id ORDER BY n))
SELECT run_id, (['network', 'audit', 'power', 'judge'])[n] AS stage, n::INT AS position, bool_and(fine) OVER (PARTITION BY run_id ORDER BY n) AS open FROM g""")
def gate_status(spark, sf_dir):
    """Gates of runs made of orders: a line is a stage's record, returned ones failed, some are bound to another hash."""
    from pyspark.sql import Window

    per = load(spark, sf_dir, "lineitem").where("l_linenumber <= 4").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").cast("string").alias("hash"), F.bool_and(F.col("l_returnflag") != "R").alias("ok"), F.min("l_suppkey").alias("s"))
    bound = F.when(F.col("s") % 5 == 0, "other").otherwise(F.lag("hash").over(Window.partitionBy("run_id").orderBy("n")))
    rows = per.select("run_id", F.element_at(F.array(*[F.lit(x) for x in STAGES]), F.col("n")).alias("stage"), F.when(F.col("ok"), "passed").otherwise("failed").alias("status"), "hash", bound.alias("upstream_hash"))
    return cost.gate(rows, STAGES, "run_id")
