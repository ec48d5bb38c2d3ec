"""Checksums of files of any size, and manifests of them.

Files are read in blocks by the tasks, straight from the store, so a file never is a
row. A manifest has a line ``digest  path`` per file, sorted by path over its part files.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_rows import opened

BLOCK = 1 << 20
LINE = r"\A[0-9a-f]{64}  [^\r\n]+\z"


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes of every file at or below a path; hidden ones and those of commits aside."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        raise FileNotFoundError(path)
    found, waiting = [], [files.getFileStatus(top)]
    while waiting:
        for s in [waiting.pop()]:
            if s.isDirectory():
                waiting += [x for x in files.listStatus(s.getPath()) if x.getPath().getName()[0] not in "._"]
            else:
                found.append((s.getPath().toString(), s.getLen()))
    return spark.createDataFrame(sorted(found), "path string, bytes bigint")


def checksums(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """``files(path, bytes)`` with sha256, null where the file is not there."""

    def run(batches):
        for batch in batches:
            digests = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                try:
                    with opened(path) as file:
                        while block := file.read(BLOCK):
                            digest.update(block)
                except FileNotFoundError:
                    digests.append(None)
                else:
                    digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], ["path", "bytes", "sha256"])

    return files.select("path", "bytes").repartition(tasks or files.sparkSession.sparkContext.defaultParallelism, "path").mapInArrow(run, "path string, bytes bigint, sha256 string")


def write_manifest(sums: DataFrame, path: str) -> None:
    """Write ``sums(path, sha256)`` as a manifest; a line break in a path, or a missing or malformed digest, is an error."""
    line = F.concat_ws("  ", F.coalesce("sha256", F.lit("")), "path")
    checked = F.when(line.rlike(LINE), line).otherwise(F.raise_error(F.concat(F.lit("no line of a manifest: "), line)))
    sums.orderBy("path").select(checked.alias("value")).write.mode("overwrite").text(path)


def manifest_problems(spark: SparkSession, path: str) -> DataFrame:
    """line, problem of a manifest's lines that are malformed, whose path is repeated, or whose file is missing or differs."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    good = F.col("line").rlike(LINE)
    named = lines.where(good).select("line", F.substring("line", 1, 64).alias("digest"), F.substring("line", 67, 1 << 30).alias("path"))
    found = checksums(named.select("path", F.lit(0).cast("bigint").alias("bytes")).distinct()).select("path", "sha256")
    both = named.join(found, "path")
    code = lambda rows, text: rows.select("line", F.lit(text).alias("problem"))
    twice = named.groupBy("path").agg(F.count("*").alias("n"), F.min("line").alias("line")).where("n > 1")
    return code(lines.where(~good), "malformed").unionByName(code(twice, "repeated_path")).unionByName(code(both.where("sha256 is null"), "missing_file")).unionByName(code(both.where("sha256 <> digest"), "digest_differs"))
