"""Line dedup: overlapping three-line windows.

A document is split at line feeds; every window of three consecutive lines is
hashed; a window found more than once keeps its first occurrence (least doc_id,
then least position) and the later ones are removed: the lines that they cover,
merged, go. A document of fewer than three lines has no window and stays.

DataFrame functions only. Windows shuffle as 128-bit hashes with doc_id and
position, never with text: a window that a third of all documents share becomes
one row per task before the shuffle that counts it, and the join that finds the
occurrences of repeated hashes is one whose hot keys Spark can split. Only the
positions covered in one document meet in one row. Equal windows in a row are one
row with an interval, so a document of one line again and again is small.

Null text counts as empty and is returned as null; empty lines are lines.
Repeated rows (same doc_id and text) are one document for the order of
occurrences and keep or lose the same lines; rows of equal doc_id and other
text are told apart by a hash of the text. Null doc_id comes first. An empty
table gives an empty result. Extra columns stay, except names that begin with
``_gs_``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Pieces:
    """How a text is cut, how many pieces make a run, and what joins the pieces that are left."""

    cut: Callable[[Column], Column]
    run: int
    glue: str


LINE_WINDOWS = Pieces(lambda t: F.split(t, "\n", -1), 3, "\n")


def _runs(text: Column, how: Pieces) -> Column:
    """The runs of the text as struct(a, b, i, z, again): a 128-bit hash, the first and last piece, from 1, and whether it stands for more than one. Equal runs one piece after the other are one struct."""

    def at(all_: Column, i: Column) -> Column:
        parts = [F.get(all_, i + d) for d in range(how.run)]
        return F.struct(F.xxhash64(*[p["a"] for p in parts]).alias("a"), F.xxhash64(*[p["b"] for p in parts]).alias("b"), (i + 1).alias("i"))

    def merged(all_: Column) -> Column:
        starts = F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["a"] != x["a"]) | (F.get(all_, i - 1)["b"] != x["b"]))
        after = lambda s, k: F.coalesce(F.get(s, k + 1)["i"], F.size(all_) + 1)
        ends = lambda s: F.transform(s, lambda x, k: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["i"].alias("i"), (after(s, k) + (how.run - 2)).alias("z"), (after(s, k) - x["i"] > 1).alias("again")))
        return F.get(F.transform(F.array(starts), ends), F.lit(0))

    def runs(e: Column) -> Column:
        found = F.when(F.size(e) >= how.run, F.transform(F.sequence(F.lit(0), F.size(e) - how.run), lambda i: at(e, i)))
        return F.get(F.transform(F.array(found), merged), F.lit(0))

    each = F.transform(how.cut(F.coalesce(text, F.lit(""))), lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b")))
    return F.get(F.transform(F.array(each), runs), F.lit(0))


def later(rows: DataFrame) -> DataFrame:
    """_gs_id, _gs_text, spans: the pieces i to z that later occurrences cover, of ``rows(_gs_id, _gs_text, a, b, i, z, again)``."""
    at = F.struct("_gs_id", "_gs_text", "i")
    first = rows.groupBy("a", "b").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max("again").alias("twice")).where("first <> last or twice").select("a", "b", "first")
    # The first of all occurrences stays; those that follow it in its row do not.
    # Dealt once more, as Spark splits a hot key of a join only where both sides are read from an exchange of their own.
    found = rows.join(first.repartition(F.xxhash64("a", F.lit(1))), ["a", "b"]).where((at != F.col("first")) | F.col("again")).select("_gs_id", "_gs_text", F.when(at == F.col("first"), F.col("i") + 1).otherwise(F.col("i")).alias("i"), "z")
    return found.groupBy("_gs_id", "_gs_text").agg(F.collect_set(F.struct("i", "z")).alias("spans"))


def covered(docs: DataFrame, how: Pieces) -> DataFrame:
    """_gs_id, _gs_text, _gs_cover: the sorted positions (from 1) of the pieces that later occurrences cover, where there are any."""
    rows = docs.select(F.col("doc_id").alias("_gs_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_gs_text"), F.explode(_runs(F.col("text"), how)).alias("w"))
    cover = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["i"], s["z"])))))
    return later(rows.select("_gs_id", "_gs_text", "w.*")).select("_gs_id", "_gs_text", cover.alias("_gs_cover"))


def dedup(docs: DataFrame, how: Pieces) -> DataFrame:
    """``docs`` with _gs_pieces and _gs_removed (long) and _gs_kept, the text that is left."""
    rows = docs.drop(*[c for c in docs.columns if c.startswith("_gs_")])
    own = rows.withColumn("_gs_own", F.xxhash64(F.coalesce("text", F.lit(""))))
    both = own.join(covered(docs, how), F.col("doc_id").eqNullSafe(F.col("_gs_id")) & (F.col("_gs_own") == F.col("_gs_text")), "left")
    every = how.cut(F.coalesce("text", F.lit("")))
    # The pieces between covered positions, gap by gap.
    fences = F.concat(F.array(F.lit(0)), F.col("_gs_cover"), F.array(F.size("_gs_all") + 1))
    gaps = F.filter(F.transform(F.sequence(F.lit(0), F.size("_gs_cover")), lambda k: F.struct((F.get("_gs_fences", k) + 1).alias("s"), (F.get("_gs_fences", k + 1) - F.get("_gs_fences", k) - 1).alias("n"))), lambda g: g["n"] > 0)
    kept = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice("_gs_all", g["s"], g["n"]))), how.glue)
    out = both.withColumn("_gs_all", every).withColumn("_gs_fences", fences)
    return out.select(
        *rows.columns,
        F.size("_gs_all").cast("bigint").alias("_gs_pieces"),
        F.coalesce(F.size("_gs_cover"), F.lit(0)).cast("bigint").alias("_gs_removed"),
        F.when(F.col("_gs_cover").isNull(), F.col("text")).otherwise(kept).alias("_gs_kept"),
    )


def replaced(docs: DataFrame, how: Pieces) -> DataFrame:
    """The columns of ``docs``, with the text that is left and its number of characters in ``n_chars``, if there is such a column."""
    out = dedup(docs, how).withColumn("text", F.col("_gs_kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gs_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[c for c in docs.columns if not c.startswith("_gs_")])


LINE_SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
w AS (SELECT doc_id, a, unnest(range(1, len(a) - 1)) AS i FROM l WHERE len(a) >= 3),
k AS (SELECT doc_id, i, a[i] || chr(10) || a[i + 1] || chr(10) || a[i + 2] AS t FROM w),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM k),
c AS (SELECT DISTINCT doc_id, i + d AS p FROM r, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1),
e AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS p FROM l),
x AS (SELECT e.doc_id, count(*)::BIGINT AS n_lines, count(c.p)::BIGINT AS n_removed, coalesce(string_agg(CASE WHEN c.p IS NULL THEN line END, chr(10) ORDER BY e.p), '') AS kept
  FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM x
"""
