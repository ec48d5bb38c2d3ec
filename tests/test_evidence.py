"""Matrix hashes and checksums against plain Python, on ragged matrices and broken manifests."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from grovespan.operators import matrices
from grovespan.sources import checksums


def test_matrix_hashes(spark, data):
    good = {"a": [[1.0, -0.1, 1e-7], [1e22, 0.30000000000000004, 5e-324]], "b": [[2.5]]}
    rows = [(k, i, v) for k, m in good.items() for i, v in enumerate(m)]
    rows += [("ragged", 1, [1.0, 2.0]), ("ragged", 0, None), ("ragged", 3, [1.0]), ("empty", 0, []), ("hole", 0, [1.0, None]), (None, 0, [4.0])]
    got = {r["k"]: r for r in matrices.matrix_hashes(spark.createDataFrame(rows, "k string, i int, v array<double>").repartition(4), "k", "i", "v").collect()}
    for k, m in good.items():
        assert got[k]["sha256"] == hashlib.sha256(json.dumps(m, separators=(",", ":")).encode()).hexdigest() and (got[k]["n_rows"], got[k]["width"]) == (len(m), len(m[0]))
    assert tuple(got["ragged"])[1:] == (3, 2, None, "not_rectangular", "0", 2)
    assert got["empty"]["problem"] == got["hole"]["problem"] == "not_rectangular" and got[None]["problem"] is None
    assert matrices.matrix_hashes(spark.createDataFrame([], "k string, i int, v array<double>"), "k", "i", "v").collect() == []
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    one = matrices.matrix_hashes(table.withColumn("k", F.lit(1)), "k", "vec_id", "embedding").first()
    whole = [[float(x) for x in r["embedding"]] for r in table.orderBy("vec_id").collect()]
    assert one["sha256"] == hashlib.sha256(json.dumps(whole, separators=(",", ":")).encode()).hexdigest()


def test_manifest_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(checksums, "BLOCK", 1000)
    files = {"a.bin": b"", "sub/b.bin": bytes(range(256)) * 5000, "sub/c d.txt": "é\n".encode() * 3}
    for name, raw in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(raw)
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"x")
    sums = checksums.checksums(checksums.files_below(spark, str(tmp_path / "in")))
    got = {r["path"].split("/in/")[1]: (r["bytes"], r["sha256"]) for r in sums.collect()}
    assert got == {n: (len(raw), hashlib.sha256(raw).hexdigest()) for n, raw in files.items()}
    manifest = str(tmp_path / "manifest")
    checksums.write_manifest(sums, manifest)
    lines = [r["value"] for p in sorted((tmp_path / "manifest").glob("part-*")) for r in spark.read.text(str(p)).collect()]
    assert len(lines) == 3 and lines == sorted(lines, key=lambda x: x[66:])
    assert checksums.manifest_problems(spark, manifest).collect() == []
    (tmp_path / "in" / "a.bin").write_bytes(b"other")
    (tmp_path / "in" / "sub" / "b.bin").unlink()
    (tmp_path / "more.txt").write_text("\n".join([*lines, lines[2], "zz  path", "0" * 64 + "  ", "0" * 64 + " one-blank"]) + "\n")
    found = sorted((r["problem"], r["line"]) for r in checksums.manifest_problems(spark, str(tmp_path / "more.txt")).collect())
    by = {x[66:].split("/in/")[1]: x for x in lines}
    assert found == sorted([("digest_differs", by["a.bin"]), ("malformed", "zz  path"), ("malformed", "0" * 64 + "  "), ("malformed", "0" * 64 + " one-blank"), ("missing_file", by["sub/b.bin"]), ("repeated_path", lines[2])])
    with pytest.raises(FileNotFoundError):
        checksums.files_below(spark, str(tmp_path / "none"))
    for path, digest in (("a\nb", "0" * 64), ("a", "0" * 63), ("a", None)):
        with pytest.raises(Exception, match="no line of a manifest"):
            checksums.write_manifest(spark.createDataFrame([(path, digest)], "path string, sha256 string"), str(tmp_path / "bad"))
