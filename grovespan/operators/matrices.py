"""Shape and hash of matrices that are stored a row per record.

The hash is that of the whole matrix as compact JSON, so it reads the rows in order: a
matrix is a sorted stream of which the task keeps a running hash and the width, never
the rows. Matrices are dealt by their key; one is one stream, as its hash asks.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "n_rows bigint, width bigint, sha256 string, problem string, first_bad string, n_bad bigint"


class _Matrix:
    def __init__(self):
        self.running, self.rows, self.width, self.bad, self.first = hashlib.sha256(b"["), 0, None, 0, None

    def add(self, order, row) -> None:
        if row is None or not row or any(x is None for x in row) or (self.width is not None and len(row) != self.width):
            self.first = str(order) if not self.bad else self.first
            self.bad += 1
        else:
            self.width = len(row)
            self.running.update((b"," if self.rows - self.bad else b"") + json.dumps(row, separators=(",", ":")).encode())
        self.rows += 1

    def result(self) -> tuple:
        if self.bad:
            return self.rows, self.width, None, "not_rectangular", self.first, self.bad
        self.running.update(b"]")
        return self.rows, self.width, self.running.hexdigest(), None, None, 0


def matrix_hashes(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """key, n_rows, width, sha256, problem, first_bad, n_bad of each matrix, rows by ``order``.

    A row that is null or empty, holds a null, or is not as wide as the first good one
    makes the matrix ``not_rectangular``: it has no hash, ``first_bad`` names the row.
    """
    kind = rows.schema[key].dataType.simpleString()
    names = [key, *(c.strip().split(" ")[0] for c in SCHEMA.split(","))]

    def run(batches):
        now, held, out = None, None, []
        for batch in batches:
            for k, o, row in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or k != now:
                    if held is not None:
                        out.append((now, *held.result()))
                    now, held = k, _Matrix()
                held.add(o, row)
        if held is not None:
            out.append((now, *held.result()))
        if out:
            types = [pa.int64() if n in ("n_rows", "width", "n_bad") else pa.string() for n in names[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema.field(0).type), *(pa.array([r[j] for r in out], t) for j, t in enumerate(types, 1))], names)

    stream = rows.select(key, order, F.col(vector).cast("array<double>").alias(vector)).repartition(key).sortWithinPartitions(key, order)
    return stream.mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
