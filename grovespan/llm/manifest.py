"""Merkle dataset manifest: a tree over each source's documents, and one over the sources.

A row is a leaf, H (SHA-256 as lowercase hex) of its fields, each ``-`` if null, else its
UTF-8 byte count, ``:`` and its value. Per source leaves ascend by doc_id; every
``FANOUT`` consecutive nodes become the H of their digests until one, the subroot, is
left. The subroots by source, null first, give the root in the same way.

Nodes are bucketed by their index over ``FANOUT ** LEVELS``; one ``applyInPandas`` call
collapses ``LEVELS`` levels of a bucket, whose root is a node of the next round, so a tree
of n leaves takes log(n) / log(FANOUT ** LEVELS) rounds and no task holds more than a
bucket, however many rows a source has. On the way down each bucket meets the one proof
of its root, and a node's proof is the lower part, from its bucket, before the upper.

Leaves are hashed by Spark expressions and written once; from then on rows are digests,
not texts. Indices are places in a sort by ranges (``tables.positions``), so a hot source
is split. Per-source rows are broadcast while their names are at most ``BROADCAST_BYTES``
together, otherwise joined by shuffle, where Spark splits hot keys.

Null doc_id comes first, and rows of equal doc_id are ordered by leaf, so repeated rows are
leaves of their own with equal subroots; null and empty text differ; null source is a
source. Other columns than the five are not read, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import positions, saved

FANOUT = 16
LEVELS = 2
BROADCAST_BYTES = 8 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_FOLDS = 5


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """H of the values of a row."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf of every row."""
    return docs.select("source", "doc_id", digest(*map(F.col, FIELDS)).alias("leaf"))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(docs: DataFrame) -> DataFrame:
    """``leaves`` and ``changed``, the leaf of the row whose text was lowered, where crc32 of the id is divisible by 5."""
    other = digest(*[lowered(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_FOLDS == 0
    return docs.select("source", "doc_id", digest(*map(F.col, FIELDS)).alias("leaf"), F.when(hit, other).alias("changed"))


def _h(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def collapsed(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """``nodes`` and the rows of nodes above them."""
    rows = [nodes]
    for _ in range(levels):
        rows.append([_h(rows[-1][a : a + fanout]) for a in range(0, len(rows[-1]), fanout)])
    return rows


def _height(n: Column, fanout: int) -> Column:
    """Levels over n leaves."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= fanout
    return sum(((n > q).cast("int") for q in powers[1:]), (n > 1).cast("int"))


def _rounds(nodes: DataFrame, most: int, fanout: int, levels: int) -> list[DataFrame]:
    """``nodes(_gs_tree, _gs_i, _gs_left, leaf, ...)`` and the written tables of bucket roots above, the last with one node per tree; ``_gs_left``: levels to go."""
    block = fanout**levels

    def up(key, rows):
        rows = rows.sort_values("_gs_i")
        left = int(rows["_gs_left"].iloc[0])
        now = min(levels, left)
        top = collapsed(rows["leaf"].tolist(), now, fanout)[-1]
        return rows.iloc[:1].assign(_gs_i=int(key[1]), _gs_left=left - now, leaf=top[0])[["_gs_tree", "_gs_i", "_gs_left", "leaf"]]

    tables = [nodes]
    for _ in range(0, most, levels):
        grouped = tables[-1].select("_gs_tree", "_gs_i", "_gs_left", "leaf").groupBy("_gs_tree", F.floor(F.col("_gs_i") / block).alias("_gs_bucket"))
        tables.append(saved(grouped.applyInPandas(up, "_gs_tree bigint, _gs_i bigint, _gs_left int, leaf string")))
    return tables


def _proofs(nodes: DataFrame, upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` with subroot, before and after: level by level the digests on either side in a node's run. ``upper``: those of the bucket roots."""
    block = fanout**levels
    names = nodes.columns

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return None
        left = left.sort_by("_gs_i").drop_columns(["_gs_bucket"])
        rows = collapsed(left["leaf"].to_pylist(), min(levels, left["_gs_left"][0].as_py()), fanout)
        rest = [right[c][0].as_py() for c in ("before", "after")]
        before, after = [], []
        for p in range(left.num_rows):
            own = [], []
            for row in rows[:-1]:
                a = p - p % fanout
                own[0].append("".join(row[a:p]))
                own[1].append("".join(row[p + 1 : a + fanout]))
                p //= fanout
            before.append(own[0] + rest[0])
            after.append(own[1] + rest[1])
        texts = pa.list_(pa.string())
        # The root of a source's last bucket is the subroot; above, it is handed down.
        own_root = right["subroot"][0].as_py() or right["leaf"][0].as_py()
        left = left.append_column("subroot", pa.array([own_root] * left.num_rows, pa.string()))
        return left.append_column("before", pa.array(before, texts)).append_column("after", pa.array(after, texts))

    keyed = nodes.withColumn("_gs_bucket", F.floor(F.col("_gs_i") / block)).groupBy("_gs_tree", "_gs_bucket")
    above = upper.select("_gs_tree", F.col("_gs_i").alias("_gs_bucket"), "leaf", "subroot", "before", "after").groupBy("_gs_tree", "_gs_bucket")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields] + ["subroot string, before array<string>, after array<string>"])
    return keyed.cogroup(above).applyInArrow(down, schema).select(*names, "subroot", "before", "after")


def _descended(tables: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The proofs of the nodes of ``tables[0]``; ``top``: those of the nodes of the last table."""
    upper = top
    for k in range(len(tables) - 2, -1, -1):
        upper = _proofs(tables[k], upper, fanout, levels)
        if k:
            upper = saved(upper)
    return upper


def manifest(rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``rows(source, doc_id, leaf, ...)`` with subroot, root and the proof: ``before`` and ``after``, the digests beside the node at each level."""
    placed = positions(saved(rows), "source", "doc_id", "leaf")
    per = placed.groupBy("source").agg(F.min("_gs_at").alias("_gs_tree"), F.count("*").alias("n"), F.max(F.octet_length("source")).alias("b"))
    sources = saved(per.select(F.col("source").alias("_gs_source"), "_gs_tree", _height(F.col("n"), fanout).alias("_gs_left"), (F.coalesce("b", F.lit(0)) + 32).alias("b")))
    size = sources.agg(F.count("*").alias("n"), F.sum("b").alias("b"), F.max("_gs_left").alias("most")).first()
    right = sources.drop("b")
    if (size["b"] or 0) <= BROADCAST_BYTES:
        right = F.broadcast(right)
    own = placed.join(right, F.col("source").eqNullSafe(F.col("_gs_source"))).withColumn("_gs_i", F.col("_gs_at") - F.col("_gs_tree"))
    tables = _rounds(own.select(*rows.columns, "_gs_tree", "_gs_i", "_gs_left"), size["most"] or 0, fanout, levels)
    # The sources' tree: places of the subroots in the order of sources, which is that of their first leaves.
    subroots = tables[-1].select("_gs_tree", "leaf")
    height = next(k for k in range(64) if fanout**k >= size["n"])
    many = positions(subroots, "_gs_tree").select(F.lit(0).cast("bigint").alias("_gs_tree"), F.col("_gs_at").alias("_gs_i"), F.lit(height).alias("_gs_left"), "leaf", F.col("_gs_tree").alias("_gs_source"))
    above = _rounds(many, height, fanout, levels)
    nothing = F.array().cast("array<string>")
    last = above[-1].select("_gs_tree", "_gs_i", "leaf", F.lit(None).cast("string").alias("subroot"), nothing.alias("before"), nothing.alias("after"))
    found = above[-1].select("leaf").first()
    top = _descended(above, last, fanout, levels) if height else many.select("_gs_source", "leaf", nothing.alias("before"), nothing.alias("after"))
    top = saved(top.select(F.col("_gs_source").alias("_gs_tree"), F.lit(0).cast("bigint").alias("_gs_i"), "leaf", F.col("leaf").alias("subroot"), "before", "after"))
    out = _descended(tables, top, fanout, levels)
    if len(tables) == 1:  # every source has one leaf
        out = tables[0].join(top.select("_gs_tree", "subroot", "before", "after"), "_gs_tree")
    root = F.lit(found["leaf"] if found else None).cast("string")
    return out.select(*rows.columns, "subroot", root.alias("root"), "before", "after")


def proof_digest() -> Column:
    """H of all siblings of ``before`` and ``after``, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with("before", "after", lambda a, b: F.concat(a, b)), "").cast("binary"), 256)


def folded(leaf: Column) -> Column:
    """The root that a leaf and the siblings of ``before`` and ``after`` give."""
    step = lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]).cast("binary"), 256)
    return F.aggregate(F.arrays_zip("before", "after"), leaf, step)


SQL = """
WITH RECURSIVE entry(n, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM entry WHERE k < 8),
crc(doc_id, s, pos, c) AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR, 1, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, pos + 1, xor(crc.c >> 8, entry.c) FROM crc JOIN entry ON entry.k = 8 AND entry.n = xor(crc.c, ascii(s[pos])) & 255 WHERE pos <= length(s)),
hit AS (SELECT doc_id FROM crc WHERE pos > length(s) AND xor(c, 4294967295) % 5 = 0),
fields AS (
  SELECT d.doc_id, d.source, h.doc_id IS NOT NULL AS hit,
    concat(coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS front, text
  FROM documents d LEFT JOIN hit h ON d.doc_id = h.doc_id),
leaves AS (
  SELECT doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit THEN sha256(front || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM fields),
grown(source, level, nodes) AS (
  SELECT source, 0, list(leaf ORDER BY doc_id NULLS FIRST, leaf) FROM leaves GROUP BY source
  UNION ALL SELECT source, level + 1, [sha256(array_to_string(nodes[g * 16 + 1 : g * 16 + 16], '')) FOR g IN range(0, (len(nodes) + 15) // 16)] FROM grown WHERE len(nodes) > 1),
subroots AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p FROM grown WHERE len(nodes) = 1),
peak(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY p) FROM subroots
  UNION ALL SELECT level + 1, [sha256(array_to_string(nodes[g * 16 + 1 : g * 16 + 16], '')) FOR g IN range(0, (len(nodes) + 15) // 16)] FROM peak WHERE len(nodes) > 1),
placed AS (
  SELECT l.*, s.subroot, s.p AS s, row_number() OVER () AS id, row_number() OVER (PARTITION BY l.source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source),
runs AS (
  SELECT id, level, nodes, p // (16 ** level)::BIGINT AS q FROM placed JOIN grown ON placed.source IS NOT DISTINCT FROM grown.source WHERE len(nodes) > 1
  UNION ALL SELECT id, 100 + level, nodes, s // (16 ** level)::BIGINT FROM placed, peak WHERE len(nodes) > 1),
path AS (
  SELECT id, list({'b': array_to_string(nodes[q // 16 * 16 + 1 : q], ''), 'a': array_to_string(nodes[q + 2 : q // 16 * 16 + 16], '')} ORDER BY level) AS steps FROM runs GROUP BY id),
folded AS (
  SELECT doc_id, leaf, subroot, coalesce(steps, []) AS steps, coalesce(changed, leaf) AS used FROM placed LEFT JOIN path USING (id)),
done AS (
  SELECT *, (SELECT nodes[1] FROM peak WHERE len(nodes) = 1) AS root,
    list_reduce(list_prepend({'b': '', 'a': used}, steps), lambda x, y: {'b': '', 'a': sha256(y.b || x.a || y.a)}).a AS folded_root
  FROM folded)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s.b || s.a FOR s IN steps], '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
"""
