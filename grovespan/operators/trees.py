"""Reduction trees: generation, validation, depths, rewrite distances, exposure, online forests.

A plan is a table of nodes (plan_id, k, node, kind, left, right, lo, hi). Spans
nest, so depth and rewrite distance are counts of the spans that cover a leaf or
a support set: joins on (plan, k) with a range condition, no recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What names a plan's tree; with episodes, ("episode_id", "plan_id").
KEYS = ("plan_id", "k")
NODE = "plan_id string, k int, node string, kind string, left string, right string, lo int, hi int"


def _leaf(i: Column) -> Column:
    return F.concat(F.lit("leaf_"), i.cast("string"))


def sized(spark: SparkSession, *ks: int) -> DataFrame:
    return spark.createDataFrame([(k,) for k in ks], "k int")


def leaves(sizes: DataFrame, plan: str) -> DataFrame:
    """The leaves of a plan for every ``k`` of ``sizes(k)``."""
    i, none = F.col("i"), F.lit(None).cast("string")
    rows = sizes.select("k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    return rows.select(F.lit(plan).alias("plan_id"), "k", _leaf(i).alias("node"), F.lit("leaf").alias("kind"), none.alias("left"), none.alias("right"), i.alias("lo"), i.alias("hi"))


def _inner(rows: DataFrame, plan: str, node: Column, left: Column, right: Column, lo: Column, hi: Column) -> DataFrame:
    return rows.select(F.lit(plan).alias("plan_id"), "k", node.alias("node"), F.lit("internal").alias("kind"), left.alias("left"), right.alias("right"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def left_deep(sizes: DataFrame, plan: str = "left_deep") -> DataFrame:
    i = F.col("i")
    name = lambda x: F.concat(F.lit("node_L_"), x.cast("string"))
    rows = sizes.select("k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("i"))
    return _inner(rows, plan, name(i), F.when(i == 1, _leaf(F.lit(0))).otherwise(name(i - 1)), _leaf(i), F.lit(0), i)


def right_deep(sizes: DataFrame) -> DataFrame:
    i, end = F.col("i"), F.col("k") - 1
    name = lambda x: F.concat_ws("_", F.lit("node_R"), x.cast("string"), end.cast("string"))
    rows = sizes.select("k", F.explode(F.sequence(F.lit(0), F.col("k") - 2)).alias("i"))
    return _inner(rows, "right_deep", name(i), _leaf(i), F.when(i == F.col("k") - 2, _leaf(end)).otherwise(name(i + 1)), i, end)


def balanced(sizes: DataFrame) -> DataFrame:
    """Ranges halved at (lo + hi) div 2, level by level; log2 of the largest k levels, each an expression on the one before."""
    most = sizes.agg(F.max("k")).first()[0] or 2
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    now = sizes.select("k", F.lit(0).alias("lo"), (F.col("k") - 1).alias("hi")).where("lo < hi")
    every = now
    for _ in range(max(1, (most - 1).bit_length()) - 1):
        halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))
        now = now.select("k", F.explode(halves).alias("r")).select("k", "r.*").where("lo < hi")
        every = every.unionByName(now)
    name = lambda a, b: F.when(a == b, _leaf(a)).otherwise(F.concat_ws("_", F.lit("node_B"), a.cast("string"), b.cast("string")))
    return _inner(every, "canonical_balanced", name(F.col("lo"), F.col("hi")), name(F.col("lo"), mid), name(mid + 1, F.col("hi")), F.col("lo"), F.col("hi"))


def counter_merges(sizes: DataFrame) -> DataFrame:
    """k, leaf, level, node, left, right, lo, hi of the binary counter: leaf i merges once for each trailing zero of i + 1."""
    rows = sizes.select("k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("leaf")).withColumn("n", F.col("leaf").cast("bigint") + 1)
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(31)))).where("n % shiftleft(1L, level) = 0")
    lo, half = (F.col("n") - F.expr("shiftleft(1L, level)")).cast("int"), F.expr("cast(shiftleft(1L, level - 1) as int)")
    name = lambda a, b, at: F.when(at == 0, _leaf(a)).otherwise(F.format_string("node_OB_%d_%d_L%d", a, b, at))
    return rows.select(
        "k", "leaf", "level", name(lo, F.col("leaf"), F.col("level")).alias("node"), name(lo, lo + half - 1, F.col("level") - 1).alias("left"),
        name(lo + half, F.col("leaf"), F.col("level") - 1).alias("right"), lo.alias("lo"), F.col("leaf").alias("hi"),
    )


def counter_forest(sizes: DataFrame) -> DataFrame:
    """k, prefix, node, level, lo, hi, position: after n = prefix + 1 leaves the roots are the set bits of n, widest first."""
    rows = sizes.select("k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("prefix")).withColumn("n", F.col("prefix").cast("bigint") + 1)
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(31)))).where("shiftright(n, level) & 1 = 1")
    lo = F.expr("cast(shiftleft(shiftright(n, level + 1), level + 1) as int)")
    hi = (lo + F.expr("cast(shiftleft(1L, level) as int)") - 1).cast("int")
    node = F.when(F.col("level") == 0, _leaf(lo)).otherwise(F.format_string("node_OB_%d_%d_L%d", lo, hi, F.col("level")))
    out = rows.select("k", "prefix", node.alias("node"), "level", lo.alias("lo"), hi.alias("hi"))
    return out.withColumn("position", F.row_number().over(Window.partitionBy("k", "prefix").orderBy("lo")) - 1)


def online_merges(spark: SparkSession, k: int) -> DataFrame:
    return counter_merges(sized(spark, k)).drop("k")


def live_forest(spark: SparkSession, k: int) -> DataFrame:
    return counter_forest(sized(spark, k)).drop("k")


def plan_table(sizes: DataFrame, plans: tuple[str, ...]) -> DataFrame:
    """All nodes of the plans for every ``k`` of ``sizes(k)`` above 1; the online plan has a root, and so nodes, for powers of two only."""
    sizes = sizes.where("k > 1")
    out = None
    for plan in plans:
        own = sizes
        if plan == "online_canonical_balanced":
            own = sizes.where("k & (k - 1) = 0")
            inner = counter_merges(own).select(F.lit(plan).alias("plan_id"), "k", "node", F.lit("internal").alias("kind"), "left", "right", "lo", "hi")
        elif plan in ("left_deep", "eager_left_deep"):
            inner = left_deep(own, plan)
        elif plan in ("right_deep", "canonical_balanced"):
            inner = {"right_deep": right_deep, "canonical_balanced": balanced}[plan](own)
        else:
            raise ValueError(f"unknown plan {plan}")
        both = leaves(own, plan).unionByName(inner)
        out = both if out is None else out.unionByName(both)
    return out


def of_episodes(episodes: DataFrame, plans: tuple[str, ...]) -> DataFrame:
    """The plans' nodes for every row of ``episodes(episode_id, k)``: made once per distinct k, then joined."""
    return episodes.select("episode_id", "k").join(plan_table(episodes.select("k").distinct(), plans), "k")


def generate(spark: SparkSession, plan: str, k: int) -> DataFrame:
    """All nodes of a plan; unknown plans and k below 2 are errors."""
    if k < 2:
        raise ValueError("a plan needs two leaves or more")
    if plan == "online_canonical_balanced" and k & (k - 1):
        raise ValueError("the online balanced plan reaches one root only for powers of two")
    return plan_table(sized(spark, k), (plan,))


def merge_order(nodes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The internal nodes in the order of execution (children first): by end of span, widest last."""
    order = Window.partitionBy(*keys).orderBy("hi", F.desc("lo"))
    return nodes.where("kind = 'internal'").withColumn("step", F.row_number().over(order) - 1)


def violations(nodes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """plan_id, k, node, problem of every node that breaks the tree contract; empty for a sound plan."""
    n = nodes.alias("n")
    bad = F.when((F.col("kind") == "leaf") & (F.col("left").isNotNull() | F.col("right").isNotNull()), "leaf_with_children")
    bad = bad.when((F.col("kind") == "internal") & (F.col("left").isNull() | F.col("right").isNull() | (F.col("left") == F.col("right"))), "children_missing_or_equal")
    bad = bad.when((F.col("lo") < 0) | (F.col("lo") > F.col("hi")), "bad_span")
    own = nodes.select(*keys, "node", bad.alias("problem")).where("problem is not null")
    kids = nodes.where("kind = 'internal'").select(*keys, F.col("node").alias("parent"), F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.posexplode(F.array("left", "right")).alias("side", "node")).where("node is not null")
    reused = kids.groupBy(*keys, "node").agg(F.count("*").alias("c")).where("c > 1").select(*keys, "node", F.lit("child_reused").alias("problem"))
    placed = kids.join(n.select(*keys, "node", "lo", "hi"), [*keys, "node"], "left")
    unknown = placed.where("lo is null").select(*keys, "node", F.lit("unknown_child").alias("problem"))
    spans = placed.groupBy(*keys, "parent", "plo", "phi").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("lo", "hi")])
    split = spans.where("lo0 <> plo or hi1 <> phi or hi0 + 1 <> lo1").select(*keys, F.col("parent").alias("node"), F.lit("spans_not_contiguous").alias("problem"))
    roots = nodes.join(kids.select(*keys, "node").distinct(), [*keys, "node"], "left_anti").groupBy(*keys).agg(F.count("*").alias("roots"), F.min("node").alias("node")).where("roots <> 1")
    return own.unionByName(reused).unionByName(unknown).unionByName(split).unionByName(roots.select(*keys, "node", F.lit("not_one_root").alias("problem")))


def leaf_depths(nodes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """plan_id, k, leaf, depth: the number of merges whose span covers the leaf, and how often the leaf is on the earlier side."""
    inner = nodes.where("kind = 'internal'").select(*keys, F.explode(F.sequence("lo", "hi")).alias("leaf"), "lo", "hi")
    return inner.groupBy(*keys, "leaf").agg(F.count("*").alias("depth"))


def plan_metrics(nodes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """plan_id, k, merge_count, height, mean_depth, leaf_count."""
    depth = leaf_depths(nodes, keys).groupBy(*keys).agg(F.max("depth").alias("height"), F.avg("depth").alias("mean_depth"), F.count("*").alias("leaf_count"))
    return depth.join(nodes.where("kind = 'internal'").groupBy(*keys).agg(F.count("*").alias("merge_count")), list(keys))


def role_paths(nodes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """plan_id, k, leaf, path: root-to-leaf roles, ``E`` where the leaf is in the earlier child, ``L`` in the later."""
    inner = nodes.where("kind = 'internal'").alias("p")
    child = nodes.select(*keys, F.col("node").alias("left"), F.col("hi").alias("mid"))
    cut = inner.join(child, [*keys, "left"])
    on = cut.select(*keys, "lo", "hi", "mid", F.explode(F.sequence("lo", "hi")).alias("leaf"))
    steps = on.groupBy(*keys, "leaf").agg(F.array_sort(F.collect_list(F.struct((F.col("lo") - F.col("hi")).alias("w"), F.when(F.col("leaf") <= F.col("mid"), "E").otherwise("L").alias("r")))).alias("s"))
    return steps.select(*keys, "leaf", F.array_join(F.transform("s", lambda x: x["r"]), "").alias("path"))


def rewrite_distances(nodes: DataFrame, supports: DataFrame) -> DataFrame:
    """plan_id, k, support_id, d_mean, d_max, d_joint, n_leaves for ``supports(k, support_id, leaf)``.

    The distance of a support set from the root is the number of merges that
    cover it, less one if its lowest common ancestor is itself a merge.
    """
    depth = leaf_depths(nodes)
    each = supports.join(depth, ["k", "leaf"]).groupBy("plan_id", "k", "support_id").agg(F.avg("depth").alias("d_mean"), F.max("depth").alias("d_max"), F.count("*").alias("n_leaves"), F.min("leaf").alias("a"), F.max("leaf").alias("b"))
    inner = nodes.where("kind = 'internal'").select("plan_id", "k", "lo", "hi")
    over = each.join(inner, ["plan_id", "k"]).where("lo <= a and hi >= b").groupBy("plan_id", "k", "support_id").agg(F.count("*").alias("c"))
    both = each.join(over, ["plan_id", "k", "support_id"], "left")
    joint = F.coalesce("c", F.lit(0)) - F.when(F.col("n_leaves") > 1, 1).otherwise(0)
    return both.select("plan_id", "k", "support_id", "d_mean", "d_max", joint.cast("bigint").alias("d_joint"), "n_leaves")


def identifiability(descriptors: DataFrame) -> DataFrame:
    """One row: ``identifiable`` if depths and plans vary and not all rows are collinear."""
    some = (F.count_distinct("d_mean") >= 2) & (F.count_distinct("plan_id") >= 2) & ~F.bool_and(F.coalesce("depth_plan_collinear", F.lit(False)))
    return descriptors.agg(F.when(F.coalesce(some, F.lit(False)), "identifiable").otherwise("descriptive_only").alias("gate"))


def evidence_exposure(nodes: DataFrame, pressures: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per leaf: merges on its way to the root that generated text, share on the earlier side, sum and maximum of their pressure.

    ``pressures(plan_id, k, node, generative, pressure)`` describes the merges.
    """
    inner = nodes.where("kind = 'internal'").join(pressures, [*keys, "node"])
    mid = nodes.select(*keys, F.col("node").alias("left"), F.col("hi").alias("mid"))
    on = inner.join(mid, [*keys, "left"]).where("generative").select(*keys, "mid", "pressure", F.explode(F.sequence("lo", "hi")).alias("leaf"))
    seen = on.groupBy(*keys, "leaf").agg(F.count("*").alias("rewrites"), F.avg((F.col("leaf") <= F.col("mid")).cast("int")).alias("earlier_share"), F.sum("pressure").alias("pressure_sum"), F.max("pressure").alias("pressure_max"))
    every = nodes.where("kind = 'leaf'").select(*keys, F.col("lo").alias("leaf"))
    return every.join(seen, [*keys, "leaf"], "left").fillna({"rewrites": 0})


def forest_violations(forest: DataFrame) -> DataFrame:
    """Prefixes whose live forest does not cover exactly the leaves seen so far, in order."""
    order = Window.partitionBy("prefix").orderBy("lo")
    step = forest.withColumn("before", F.lag("hi", 1, -1).over(order)).withColumn("last", F.max("hi").over(Window.partitionBy("prefix")))
    return step.where("lo <> before + 1 or hi > prefix or last <> prefix").select("prefix", "node")


def future_reads(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix, node: merges that a run would need at a prefix though they reach beyond it. Merges that end later are simply not visible yet."""
    inner = nodes.where("kind = 'internal'").select("node", "lo", "hi", "visible_at")
    return prefixes.join(inner, F.col("visible_at") <= F.col("prefix")).where("hi > prefix").select("prefix", "node")
