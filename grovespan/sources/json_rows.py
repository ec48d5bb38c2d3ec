"""One JSON array (or object) of any size as rows, read in byte ranges.

Whether a byte is inside a string and how deep it is depends on all bytes before it.
So a first job reads every range once and says what it does to a reader that comes
into it outside of a string and to one that comes in inside (quotes, brackets opened
and closed, escapes taken from the bytes before the range); a running composition of
these few numbers per range is the exact state at the start of each. With that the data
source ``json_rows`` reads all ranges at once: a range has the rows that begin in it,
and reads on to the end of its last. A task holds a block of bytes and its longest row.

Sinks write arrays and objects in parallel, one per file; readers take one file or a
folder of such files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
BLOCK = 1 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_QUOTE, _ESCAPE, _COMMA = 34, 92, 44
_OPEN, _CLOSE = (91, 123), (93, 125)
_BLANKS = b" \t\r\n"
_BOM = b"\xef\xbb\xbf"


class WrongRoot(ValueError):
    """The file's value is not of the kind that was asked for."""


class BrokenJson(ValueError):
    """The file ends inside a value, or there is something before, between or behind its rows that does not belong there."""


def opened(uri: str):
    """A file that can be read at any place, local or in a store that Arrow knows."""
    if uri.startswith("file:"):
        return open("/" + uri[5:].lstrip("/"), "rb")
    if ":" not in uri.split("/")[0]:
        return open(uri, "rb")
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def _structure(block: np.ndarray, inside: bool, escapes: int) -> tuple[np.ndarray, int]:
    """Whether each byte leaves a reader inside a string, and how many escapes the block ends with."""
    places = np.arange(len(block))
    plain = np.maximum.accumulate(np.where(block != _ESCAPE, places, -1))
    quotes = np.flatnonzero(block == _QUOTE)
    before = np.where(quotes > 0, plain[np.maximum(quotes - 1, 0)], -1)
    run = np.where(before >= 0, quotes - 1 - before, quotes + escapes)
    real = np.zeros(len(block), np.int64)
    real[quotes[run % 2 == 0]] = 1
    last = int(plain[-1]) if len(block) else -1
    return (np.cumsum(real) + inside) % 2 == 1, len(block) - 1 - last if last >= 0 else len(block) + escapes


def _steps(block: np.ndarray) -> np.ndarray:
    return np.isin(block, _OPEN).astype(np.int64) - np.isin(block, _CLOSE)


def _escapes_before(file, begin: int) -> int:
    """How many escapes stand right before a place."""
    n = 0
    while begin > 0:
        size = min(4096, begin)
        file.seek(begin - size)
        block = file.read(size)
        own = len(block) - len(block.rstrip(b"\\"))
        n += own
        if own < size:
            break
        begin -= size
    return n


def _unmarked(raw: bytes, at: int) -> bytes:
    """``raw`` with blanks for a byte order mark that a file begins with."""
    n = max(0, min(3 - at, len(raw)))
    return b" " * n + raw[n:] if n and _BOM[at : at + n] == raw[:n] else raw


def effect(path: str, begin: int, end: int) -> tuple[int, int, int, str]:
    """Of a range: the parity of its quotes, the depth it adds for a reader that comes in outside and inside of a string, and its first visible character."""
    parity = outside = within = 0
    first = ""
    with opened(path) as file:
        escapes = _escapes_before(file, begin)
        file.seek(begin)
        at = begin
        while at < end:
            raw = file.read(min(BLOCK, end - at))
            if not raw:
                break
            if not first:
                first = _unmarked(raw, at).lstrip(_BLANKS)[:1].decode("latin-1")
            block = np.frombuffer(raw, np.uint8)
            inside, escapes = _structure(block, bool(parity), escapes)
            steps = _steps(block)
            within += int(steps[inside].sum())
            outside += int(steps[~inside].sum())
            parity = int(inside[-1])
            at += len(raw)
    return parity, outside, within, first


def states(effects: list[tuple[int, int, int, str]]) -> Iterator[tuple[bool, int, str]]:
    """Before each range of a file, and at its end: whether inside of a string, how deep, and the root's first character once it was seen."""
    inside, depth, root = False, 0, ""
    yield inside, depth, root
    for parity, outside, within, first in effects:
        depth += within if inside else outside
        inside ^= bool(parity)
        root = root or first
        yield inside, depth, root


class Range(InputPartition):
    """Bytes of a file of ``size`` bytes and the state before them."""

    def __init__(self, path: str, begin: int, end: int, size: int, inside: bool, depth: int, root: str):
        self.path, self.begin, self.end, self.size = path, begin, end, size
        self.inside, self.depth, self.root = inside, depth, root


def elements(part: Range) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the rows that begin in the range: behind the root's bracket or a comma at depth one."""
    inside, depth, at = part.inside, part.depth, part.begin
    row: list[bytes] | None = None
    start, first, closed = 0, False, part.depth == 0 and part.root != ""
    with opened(part.path) as file:
        escapes = _escapes_before(file, at)
        file.seek(at)
        while at < part.end or row is not None:
            raw = file.read(min(BLOCK, part.size - at))
            if not raw:
                raise BrokenJson(f"{part.path} ends inside a value")
            block = np.frombuffer(raw, np.uint8)
            within, escapes = _structure(block, inside, escapes)
            steps = np.where(within, 0, _steps(block))
            depths = depth + np.cumsum(steps)
            marks = np.flatnonzero(~within & (((block == _COMMA) & (depths == 1)) | ((steps == 1) & (depths == 1)) | ((steps == -1) & (depths == 0))))
            done = 0
            for m in marks.tolist():
                if closed or (steps[m] == 1 and _unmarked(raw[done:m], at + done).strip(_BLANKS)):
                    raise BrokenJson(f"{part.path} has more than one value, near byte {at + m}")
                if row is not None:
                    text = b"".join([*row, raw[done:m]]).strip(_BLANKS)
                    if text:
                        yield start, text
                    elif not (first and steps[m] == -1):
                        raise BrokenJson(f"{part.path} has an empty row before byte {at + m}")
                row, first, closed, done = None, steps[m] == 1, steps[m] == -1, m + 1
                if at + m >= part.end:
                    return
                if not closed:
                    row, start = [], at + m + 1
            rest = raw[done:]
            if row is not None:
                row.append(rest)
            elif closed and rest[: max(0, part.end - at - done)].strip(_BLANKS):
                raise BrokenJson(f"{part.path} goes on behind its value, near byte {at + done}")
            inside, depth, at = bool(within[-1]), int(depths[-1]), at + len(raw)


class _Reader(DataSourceReader):
    def __init__(self, ranges: list[list[Any]], keyed: bool):
        self.ranges, self.keyed = ranges, keyed

    def partitions(self) -> list[Range]:
        return [Range(*r) for r in self.ranges]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        names = ["file", "start", "key", "value"]
        rows: list[tuple[str, int, str | None, str]] = []
        held, decoder = 0, json.JSONDecoder()
        for start, raw in elements(part):
            key, text = None, raw.decode("utf-8")
            if self.keyed:
                try:
                    key, i = decoder.raw_decode(text)
                    rest = text[i:].lstrip()
                except ValueError as e:
                    raise BrokenJson(f"{part.path} has no name at byte {start}") from e
                if not isinstance(key, str) or rest[:1] != ":":
                    raise BrokenJson(f"{part.path} has no name at byte {start}")
                text = rest[1:].strip()
            rows.append((part.path, start, key, text))
            held += len(raw)
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 1 else pa.string()) for k, c in enumerate(zip(*rows))], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 1 else pa.string()) for k, c in enumerate(zip(*rows))], names)


class JsonRows(DataSource):
    """Options: ``ranges``, as ``ranges_of`` finds them, and ``keyed``, whether the roots are objects."""

    @classmethod
    def name(cls) -> str:
        return "json_rows"

    def schema(self) -> str:
        return "file string, start bigint, key string, value string"

    def reader(self, schema) -> _Reader:
        return _Reader(json.loads(self.options["ranges"]), self.options.get("keyed") == "true")


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """A file, or the files of a folder, and their sizes; hidden ones and those of commits aside, and the empty ones that a write of no rows leaves."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        raise FileNotFoundError(path)
    if files.getFileStatus(where).isFile():
        s = files.getFileStatus(where)
        return [(s.getPath().toString(), s.getLen())]
    return sorted((s.getPath().toString(), s.getLen()) for s in files.listStatus(where) if s.isFile() and s.getLen() and s.getPath().getName()[0] not in "._")


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all that a folder holds."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def ranges_of(spark: SparkSession, path: str, root: str, split_bytes: int = SPLIT_BYTES) -> list[list[Any]]:
    """The ranges of the files: path, first and end byte, size, and the state before the first byte. ``root``: the bracket that each must begin with."""
    parts = [(f, a, min(a + split_bytes, size), size) for f, size in _files(spark, path) for a in range(0, max(size, 1), split_bytes)]
    if not parts:
        return []

    def run(batches):
        for batch in batches:
            found = [(k, *effect(*parts[k][:3])) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if j == 4 else pa.int64()) for j, c in enumerate(zip(*found))], ["k", "parity", "outside", "within", "first"])

    # A few numbers for each range; there are as many as the files have ranges.
    found = {r["k"]: r for r in spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, "k bigint, parity bigint, outside bigint, within bigint, first string").collect()}
    out: list[list[Any]] = []
    for file in dict.fromkeys(f for f, *_ in parts):
        own = [(k, p) for k, p in enumerate(parts) if p[0] == file]
        before = list(states([(found[k]["parity"], found[k]["outside"], found[k]["within"], found[k]["first"]) for k, _ in own]))
        inside, depth, first = before[-1]
        if first != root:
            raise WrongRoot(f"{file} begins with {first or 'nothing'!r}, not with {root!r}")
        if inside or depth:
            raise BrokenJson(f"{file} does not end where its value ends")
        out += [[*p, *state] for (_, p), state in zip(own, before)]
    return out


def _rows(spark: SparkSession, path: str, root: str, split_bytes: int) -> DataFrame:
    ranges = ranges_of(spark, path, root, split_bytes)
    if not ranges:
        return spark.createDataFrame([], "file string, start bigint, key string, value string")
    spark.dataSource.register(JsonRows)
    return spark.read.format("json_rows").option("ranges", json.dumps(ranges)).option("keyed", str(root == "{").lower()).load()


def read_array(spark: SparkSession, path: str, schema, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of JSON arrays. Another root is ``WrongRoot``; a row that is no object of the schema fails."""
    value = F.from_json("value", schema, {"mode": "FAILFAST"})
    return _rows(spark, path, "[", split_bytes).select(value.alias("row")).select("row.*")


def read_map(spark: SparkSession, path: str, value_type: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """key, value of the members of JSON objects, each value of ``value_type``. Another root is ``WrongRoot``."""
    value = F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), f"v {value_type}", {"mode": "FAILFAST"})
    return _rows(spark, path, "{", split_bytes).select("key", value["v"].alias("value"))


def read_object(spark: SparkSession, path: str, schema) -> DataFrame:
    """One row: a file that is one JSON object, read by Spark's own reader after its root is checked."""
    files = _files(spark, path)
    if len(files) != 1:
        raise WrongRoot(f"{path} holds {len(files)} files, not one object")
    ranges_of(spark, path, "{")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _enclosed(rows: DataFrame, path: str, marks: str) -> None:
    """Column ``line`` as the rows of one JSON value per file."""

    def run(batches):
        front = marks[0]
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([front + lines[0], *("," + x for x in lines[1:])], pa.string())], ["value"])
                front = ","
        yield pa.RecordBatch.from_arrays([pa.array([marks[1] if front == "," else marks])], ["value"])

    rows.select("line").mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_arrays(rows: DataFrame, path: str) -> None:
    """A folder of files that are each one JSON array of ``rows``' objects."""
    _enclosed(rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")), path, "[]")


def write_maps(rows: DataFrame, path: str) -> None:
    """A folder of files that are each one JSON object, of ``rows(key, value)``; a null key is written as an empty one."""
    name = F.regexp_replace(F.to_json(F.array(F.coalesce("key", F.lit("")))), r"\A\[|\]\z", "")
    _enclosed(rows.select(F.concat(name, F.lit(":"), F.to_json("value")).alias("line")), path, "{}")
