"""Queries of matrix hashes and of checksums of files that are written from a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import matrices, payloads
from ..sources import checksums
from ..sources.shared import shared_folder
from ..sources.tables import load
from .protocol import query


@query("""WITH r AS (SELECT label, vec_id, len(embedding) AS w, '[' || array_to_string([x::DOUBLE::VARCHAR FOR x IN embedding], ',') || ']' AS j FROM embeddings)
SELECT label, count(*)::BIGINT AS n_rows, max(w)::BIGINT AS width, sha256('[' || string_agg(j, ',' ORDER BY vec_id) || ']') AS sha256, NULL::VARCHAR AS problem, NULL::VARCHAR AS first_bad, 0::BIGINT AS n_bad FROM r GROUP BY label""")
def embedding_hashes(spark, sf_dir):
    return matrices.matrix_hashes(load(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


# Some rows lose or gain a value: those of label 1 whose id is divisible by 7 are cut to 3 values, those of label 2 by 11 are empty.
@query("""WITH r AS (SELECT label, vec_id, CASE WHEN label % 3 = 1 AND vec_id % 7 = 0 THEN 3 WHEN label % 3 = 2 AND vec_id % 11 = 0 THEN 0 ELSE len(embedding) END AS w FROM embeddings),
f AS (SELECT *, first_value(w) OVER (PARTITION BY label, w > 0 ORDER BY vec_id) AS first FROM r), g AS (SELECT label, arg_min(first, vec_id) FILTER (w > 0) AS width FROM f GROUP BY label)
SELECT r.label, width::BIGINT AS width, (count(*) FILTER (w <> width OR w = 0))::BIGINT AS n_bad, CASE WHEN count(*) FILTER (w <> width OR w = 0) > 0 THEN 'not_rectangular' END AS problem, (arg_min(vec_id, vec_id) FILTER (w <> width OR w = 0))::VARCHAR AS first_bad
FROM r JOIN g ON r.label = g.label GROUP BY r.label, width""")
def embedding_problems(spark, sf_dir):
    cut = F.expr("CASE WHEN label % 3 = 1 AND vec_id % 7 = 0 THEN slice(embedding, 1, 3) WHEN label % 3 = 2 AND vec_id % 11 = 0 THEN slice(embedding, 1, 0) ELSE embedding END")
    return matrices.matrix_hashes(load(spark, sf_dir, "embeddings").withColumn("embedding", cut), "label", "vec_id", "embedding").select("label", "width", "n_bad", "problem", "first_bad")


@query("SELECT coalesce(source, '') AS source, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS sha256, 0::BIGINT AS problems FROM documents GROUP BY 1")
def file_checksums(spark, sf_dir):
    """A file of texts per source, hashed by streamed reads, with the problems that its manifest's check finds."""
    folder = f"{shared_folder(spark).rstrip('/')}/grovespan-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    rows = load(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value"), F.coalesce("source", F.lit("")).alias("source"), "doc_id")
    # The files are the query's data: one per source, each written by the task that its source is dealt to.
    rows.repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id").write.partitionBy("source").text(f"{folder}/texts")
    sums = checksums.checksums(checksums.files_below(spark, f"{folder}/texts"))
    checksums.write_manifest(sums, f"{folder}/manifest")
    bad = checksums.manifest_problems(spark, f"{folder}/manifest").count()
    return sums.select(F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source"), "bytes", "sha256", F.lit(bad).cast("bigint").alias("problems"))


ARTIFACT_LINKS = """seq AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before,
  first_value(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS root FROM orders),
raw AS (SELECT id AS child, CASE WHEN id % 211 = 7 THEN -1 ELSE before END AS parent, id % 97 = 5 AS other FROM seq WHERE before IS NOT NULL
  UNION ALL SELECT id, root, false FROM seq WHERE id <> root AND before IS NULL
  UNION ALL SELECT id, id + 1, false FROM seq WHERE id % 1500 = 0 AND id + 1 IN (SELECT id FROM seq) UNION ALL SELECT id + 1, id, false FROM seq WHERE id % 1500 = 0 AND id + 1 IN (SELECT id FROM seq))"""


@query(f"""WITH RECURSIVE {ARTIFACT_LINKS}, problems AS (SELECT DISTINCT child, CASE WHEN parent = -1 THEN 'missing_parent' ELSE 'hash_differs' END AS problem FROM raw WHERE parent = -1 OR other),
bad AS (SELECT child AS id, string_agg(problem, ',' ORDER BY problem) AS problem FROM problems GROUP BY child), good AS (SELECT DISTINCT child, parent FROM raw WHERE parent <> -1 AND NOT other),
behind AS (SELECT id FROM bad UNION SELECT child FROM good JOIN behind ON parent = behind.id),
ring AS (SELECT id FROM seq WHERE id % 1500 IN (0, 1) AND id - id % 1500 + 1 IN (SELECT id FROM seq) UNION SELECT child FROM good JOIN ring ON parent = ring.id),
rest AS (SELECT id FROM seq WHERE id NOT IN (SELECT id FROM behind) AND id NOT IN (SELECT id FROM ring)),
deep AS (SELECT id, 0 AS level FROM rest WHERE id NOT IN (SELECT child FROM good) UNION SELECT good.child, level + 1 FROM good JOIN deep ON good.parent = deep.id JOIN rest ON rest.id = good.child),
top AS (SELECT id, max(level) AS level FROM deep GROUP BY id)
SELECT seq.id, CASE WHEN top.id IS NOT NULL THEN 'sound' WHEN bad.id IS NOT NULL THEN 'broken' WHEN seq.id IN (SELECT id FROM behind) THEN 'depends' ELSE 'cycle' END AS status, problem, level::INT AS level
FROM seq LEFT JOIN top ON top.id = seq.id LEFT JOIN bad ON bad.id = seq.id""".replace("top AS (", "tops AS (").replace("JOIN top ON top.id", "JOIN tops top ON top.id"))
def artifact_soundness(spark, sf_dir):
    """Orders as artifacts bound to the customer's order before, first ones to a root per priority, some by a wrong hash, to no artifact, or to each other."""
    from pyspark.sql import Window

    from ..operators import closure

    orders = load(spark, sf_dir, "orders")
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    # The root is the least by date and key, joined: a window would gather a priority in one task.
    roots = orders.groupBy("o_orderpriority").agg(F.min(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("root"))
    seq = orders.join(F.broadcast(roots), "o_orderpriority").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(own).alias("before"), "root")
    digest = lambda x: F.sha2(x.cast("string").cast("binary"), 256)
    chain = seq.where("before IS NOT NULL").select(F.col("id").alias("child"), F.expr("CASE WHEN id % 211 = 7 THEN -1L ELSE before END").alias("parent"), F.expr("id % 97 = 5").alias("other"))
    first = seq.where("before IS NULL AND id <> root").select(F.col("id").alias("child"), F.col("root").alias("parent"), F.lit(False).alias("other"))
    pair = seq.where("id % 1500 = 0").select("id").join(seq.select((F.col("id") - 1).alias("id")), "id", "left_semi")
    ring = pair.select(F.explode(F.array(F.struct(F.col("id").alias("child"), (F.col("id") + 1).alias("parent")), F.struct((F.col("id") + 1).alias("child"), F.col("id").alias("parent")))).alias("l")).select("l.child", "l.parent", F.lit(False).alias("other"))
    links = chain.unionByName(first).unionByName(ring).select("child", "parent", F.when(F.col("other"), "wrong").otherwise(digest(F.col("parent"))).alias("bound"))
    return closure.soundness(seq.select("id", digest(F.col("id")).alias("hash")), links)


# Pricing replies made of parts: by the key some lack or break a field, by the size some models are enabled for an unknown group.
PAYLOAD = """concat('{"success":', CASE WHEN p_partkey % 8 = 1 THEN 'false' ELSE 'true' END, ',"pricing_version":"', CASE WHEN p_partkey % 8 = 7 THEN ' ' ELSE 'v' END, '",',
 '"supported_endpoint":{"openai":{"path":"/v1/chat/completions","method":"POST"}},"group_ratio":{"a":1,"b":', CASE WHEN p_partkey % 8 = 4 THEN '-1' ELSE '1.5' END, '},"data":[',
 '{"model_name":"m1","quota_type":', CASE WHEN p_partkey % 8 = 2 THEN '1' ELSE '0' END, ',"model_ratio":', CASE WHEN p_partkey % 8 = 3 THEN '0' ELSE string(p_size + 1) END, ',"completion_ratio":4,',
 '"enable_groups":["a"', CASE WHEN p_size % 5 = 0 THEN ',"z"' ELSE '' END, '],"supported_endpoint_types":["openai"]}',
 CASE WHEN p_partkey % 8 = 5 THEN '' ELSE ',{"model_name":"m2","quota_type":0,"model_ratio":0.25,"completion_ratio":2,"enable_groups":["b"],"supported_endpoint_types":["openai"]}' END, ']', CASE WHEN p_partkey % 8 = 6 THEN '' ELSE '}' END)"""


def _payloads(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.expr(PAYLOAD).alias("raw"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 8 = 6 THEN 'payload:not_json' ELSE array_to_string(list_filter([CASE WHEN p_partkey % 8 = 4 THEN 'group_ratio[b]:invalid' END, CASE WHEN p_size % 5 = 0 THEN 'm1.enable_groups:invalid' END,
 CASE WHEN p_partkey % 8 = 3 THEN 'm1.model_ratio:invalid' END, CASE WHEN p_partkey % 8 = 2 THEN 'm1.quota_type:invalid' END, CASE WHEN p_partkey % 8 = 5 THEN 'm2:missing' END, CASE WHEN p_partkey % 8 = 7 THEN 'pricing_version:invalid' END,
 CASE WHEN p_partkey % 8 = 1 THEN 'success:invalid' END], lambda c: c IS NOT NULL), ',') END AS problems FROM part""")
def pricing_problems(spark, sf_dir):
    return _payloads(spark, sf_dir).select("p_partkey", F.array_join(payloads.pricing_problems(F.col("raw"), ["m1", "m2"]), ",").alias("problems"))


@query("""WITH p AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 8 = 0 AND p_size % 5 <> 0)
SELECT p_partkey, 'm1' AS model, (p_size + 1) * 3.0::DOUBLE AS input_rate, (p_size + 1) * 12.0::DOUBLE AS output_rate FROM p UNION ALL SELECT p_partkey, 'm2', 0.75::DOUBLE, 1.5::DOUBLE FROM p""")
def pricing_rates(spark, sf_dir):
    out = payloads.pricing_rates(_payloads(spark, sf_dir), "raw", ["m1", "m2"])
    return out.select("p_partkey", "model", F.col("input_rate").cast("double").alias("input_rate"), F.col("output_rate").cast("double").alias("output_rate"))
