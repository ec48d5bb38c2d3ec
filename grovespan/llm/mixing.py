"""Mixing sources to target weights by repetition rates.

Tokens are aggregated per source; a source's target over its size is its
repetition rate; every document is taken ``floor(rate)`` times plus one
hash-seeded Bernoulli copy with probability equal to the fraction.

Targets share 150 % of all words by the weights 3, 1, 2, repeating over the
sources in code-point order (null last), and stop at twice their source's size;
the excess is shared again by weight until none is above. That repeated sharing
has a closed form: with sources sorted by size over weight, the first ones are
at their bound and the others get weight times one level. All sums are whole
numbers and each target is one division, so reruns agree to the last bit.

Only per-source sums are shuffled, after partial sums. They are broadcast when
they are at most ``BROADCAST_BYTES`` together, otherwise joined by shuffle on
source and a salt, so that a hot source spreads over ``SALTS`` tasks.

The draw is a hash of seed, id and text, so rows of null or equal id and other text are
drawn on their own. Null text has size 0; a null and an empty source are two sources;
repeated rows (same id and text) each count and share one draw; an empty table gives an
empty result. Columns
named ``size``, ``source_size``, ``target``, ``copies`` or ``copy`` are replaced;
all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved

WEIGHTS = (3, 1, 2)
SHARE_NUM, SHARE_DEN, MOST = 3, 2, 2
BROADCAST_BYTES = 8 << 20
#: Bytes of a source's row besides its name.
ROW_BYTES = 64
SALTS = 64
WORD = "[^\\x20\\x09-\\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of ``sizes(source, size)``; the windows run over one row per source."""
    by_name = Window.orderBy(F.col("source").isNull().cast("int"), F.col("source"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull().cast("int"), F.col("source"))
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")).cast("bigint")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    bounded = F.coalesce(F.sum("source_size").over(before), F.lit(0))
    passed = F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = per.withColumns({
        "num": SHARE_NUM * F.sum("source_size").over(every) - SHARE_DEN * MOST * bounded,
        "den": SHARE_DEN * (F.sum("weight").over(every) - passed),
        "before": passed,
    })
    marked = level.withColumn("bound", F.col("num") * F.col("weight") >= MOST * F.col("source_size") * F.col("den"))
    free = F.min(F.when(~F.col("bound"), F.struct("before", "num", "den"))).over(every)
    target = F.when(F.col("bound"), (MOST * F.col("source_size")).cast("double")).otherwise(F.col("weight") * free["num"] / free["den"])
    return marked.select("source", "source_size", target.alias("target"))


def chance(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed, the id and the text alone."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), own)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("bigint") / F.lit(float(16**12))


def plan(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` with size, source_size, target and copies."""
    sized = docs.drop("source_size", "target", "copies", "copy").withColumn("size", words_in(F.col("text")))
    table = saved(targets(sized.select("source", "size")))
    right = table.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    size = table.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        both = sized.join(F.broadcast(right), same)
    else:
        left = sized.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
        salted = right.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = left.join(salted, same & (F.col("_salt") == F.col("_salt_r"))).drop("_salt", "_salt_r")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (chance(F.col("doc_id"), F.col("text"), seed) < rate - F.floor(rate)).cast("bigint")
    return both.withColumn("copies", copies.cast("bigint")).drop("_source")


def emit(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Each document as often as the mix takes it, numbered by ``copy`` from 1."""
    return plan(docs, seed).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies")


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS own, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM per),
level AS (
  SELECT *, 3 * (sum(source_size) OVER ())::BIGINT - 4 * coalesce(sum(source_size) OVER w, 0)::BIGINT AS num,
    2 * ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER w, 0)::BIGINT) AS den
  FROM weighted WINDOW w AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, num * weight >= 2 * source_size * den AS bound FROM level),
free AS (SELECT num AS fnum, den AS fden FROM marked WHERE NOT bound ORDER BY den DESC LIMIT 1),
target AS (
  SELECT source, source_size, CASE WHEN bound THEN (2 * source_size)::DOUBLE ELSE (weight * fnum)::DOUBLE / fden::DOUBLE END AS target
  FROM marked LEFT JOIN free ON true),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || own), 1, 12))::BIGINT / {float(16**12)}::DOUBLE AS u
  FROM sized JOIN target ON sized.source IS NOT DISTINCT FROM target.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
