"""Written tables in the folder that driver and executors share, to cut long lineages."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset and all run in one JVM, a folder of this machine."""
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


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a written table: it is computed once, and lost executors do not take it along. It goes with the driver's JVM."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/grovespan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._grovespan_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of ``saved`` that nothing reads any more."""
    deleted(df.sparkSession, df._grovespan_path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Each write in here deletes its shuffle files when it is done; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
