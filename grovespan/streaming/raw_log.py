"""Raw logs as a sink that is written after every batch and can be replayed.

A batch of records goes to one table per kind, each batch to a folder named by its id.
Where a batch is written again, after a failure or from an older checkpoint, its folder
is replaced, so no row is there twice; a reader takes finished folders only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


class RawLog:
    """Tables below ``path``, by name the rows of a batch that each gets (a condition) and its columns."""

    def __init__(self, path: str, tables: dict[str, tuple[Column, list[str]]]):
        self.path, self.tables = path.rstrip("/"), tables

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Write one batch; what a ``foreachBatch`` calls."""
        rows = batch.persist(StorageLevel.DISK_ONLY)
        try:
            for name, (where, columns) in self.tables.items():
                rows.where(where).select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
        finally:
            rows.unpersist()

    def stream(self, rows: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Start writing a stream."""
        return rows.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def batches(self, spark: SparkSession, name: str) -> list[int]:
        """Ids of the finished batches of a table."""
        jvm = spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = top.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(top):
            return []
        parts = [s.getPath() for s in files.listStatus(top)]
        return sorted(int(p.getName().split("=")[1]) for p in parts if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """The rows of a table with the batch that wrote them."""
        done = self.batches(spark, name)
        if not done:
            return spark.createDataFrame([], f"{schema}, batch bigint")
        rows = spark.read.schema(f"{schema}, batch bigint").option("basePath", f"{self.path}/{name}")
        return rows.parquet(*[f"{self.path}/{name}/batch={k}" for k in done])


def attempt_log(path: str) -> RawLog:
    """Logs of attempts: all of them, the accepted ones as bindings, those with output, and the failed ones as transport records."""
    every = ["attempt_id", "run_id", "stage", "logical_call_id", "outcome", "input_tokens", "output_tokens", "started_at"]
    key = ["attempt_id", "run_id", "stage", "logical_call_id"]
    accepted = F.col("outcome") == "accepted"
    return RawLog(path, {"attempts": (F.lit(True), every), "bindings": (accepted, key), "outputs": (accepted & F.col("output_tokens").isNotNull(), [*key, "output_tokens"]), "transport": (F.col("outcome") == "failed", [*key, "outcome"])})


def uncommit(spark: SparkSession, checkpoint: str, batch_id: int) -> None:
    """Forget that the last batch was committed, so that a stream that starts from this checkpoint writes it again."""
    for name in (f"commits/{batch_id}", f"commits/.{batch_id}.crc"):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/{name}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)
