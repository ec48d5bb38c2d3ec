"""Inputs, shared-folder tables and small helpers of the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where that is unset and all run in one JVM, one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="grovespan-")
            context.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` as a written table in the shared folder: it is computed once, and lost executors do not take it along.

    The folder goes when the driver's JVM ends, or earlier by ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/grovespan-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._grovespan_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of ``saved`` that nothing reads any more."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._grovespan_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def positions(df: DataFrame, *order: str) -> DataFrame:
    """``df`` as a written table with ``_gs_at``, each row's place from 0 in the order by these columns, ascending, null first.

    Rows are dealt by ranges of the columns and of a number of their own, so equal rows
    do not meet in one task. A row's place is that in its task's sorted rows, plus the
    rows of the tasks before; those counts are one row per task and are broadcast.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = df.withColumn("_gs_own", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "_gs_own").sortWithinPartitions(*order, "_gs_own")
    table = saved(dealt.drop("_gs_own").withColumn("_gs_place", F.monotonically_increasing_id()))
    task = F.shiftright("_gs_place", 33)
    counts = table.groupBy(task.alias("_gs_task")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_gs_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_gs_task", before.alias("_gs_before"))
    out = table.withColumn("_gs_task", task).join(F.broadcast(starts), "_gs_task")
    out = out.select(*df.columns, (F.col("_gs_before") + F.col("_gs_place").bitwiseAND(F.lit((1 << 33) - 1))).alias("_gs_at"))
    out._grovespan_path = table._grovespan_path
    return out


def fold(column: Column | str, parts: int) -> Column:
    """crc32 of the value as text, modulo ``parts``; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(None)).cast("string").cast("binary")) % parts


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text: doc_id as struct(z, id, t), null ids last, with a hash of the text, so that rows of equal or null doc_id and other text differ."""
    return docs.select(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t")).alias("doc_id"), "text")
