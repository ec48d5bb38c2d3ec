"""Substring dedup: sliding spans of several consecutive sentences.

From every sentence a run goes on until it has ``LEAST`` sentences and ``WORDS``
words or more, and to every sentence one comes from behind likewise; a single
sentence of over ``ALONE_WORDS`` words is a run too. A text of ``LEAST`` sentences or
more that has fewer words is one run, whole, so that later copies of a short text go.
So any sequence of whole sentences that has a run at all is covered by its runs, to its
first and last sentence, whatever the sentences' lengths. ``WORDS`` is half of ``ALONE_WORDS``, so
that a passage of that length that begins and ends inside sentences mostly holds
a run, and two short sentences that happen to repeat do not make one.

Every run is hashed; of a run found more than once the first occurrence (least
doc_id, then least position) stays, and the sentences that others cover go.

A sentence ends with ``.``, ``!`` or ``?`` and a space, with the full-width forms
of these marks, or with line feeds; the spaces and line feeds behind it belong to
it and are not compared.

Text is split and hashed in Arrow batches. Runs shuffle as 128-bit hashes, first
with their counts alone, then with doc_id and position, never with text: a run
that a third of all documents share becomes one row per task before the shuffle
that counts it, and the joins that find the occurrences of repeated hashes read
exchanges on both sides, so that Spark can split hot keys. Only the spans of one
document meet in one row. Equal runs in a row are one row with an
interval, so a document of one sentence again and again is small.

Null text counts as empty and is returned as null. Repeated rows (same doc_id and
text) are one document for the order of occurrences and keep or lose the same
sentences; rows of equal doc_id and other text are told apart by a hash of the
text. Null doc_id comes first. An empty table gives an empty result. Extra columns
stay, except names that begin with ``_gs_``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .repeats import later
from .tables import saved

LEAST = 2
WORDS = 25
ALONE_WORDS = 50

_MARK = np.zeros(256, bool)
_MARK[list(b".!?")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \n\r\t")] = True
#: The last two bytes, in UTF-8, of full-width stop, exclamation and question marks.
_WIDE = ((0xE3, 0x80, 0x82), (0xEF, 0xBC, 0x81), (0xEF, 0xBC, 0x9F))


def cut(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all sentences of the documents, and n + 1 offsets into them; an empty document has none."""
    n = len(buf)
    starts = np.zeros(n, bool)
    if n:
        starts[2:] = _MARK[buf[:-2]] & (buf[1:-1] == 32) & (buf[2:] != 32)
        starts[1:] |= (buf[:-1] == 10) & (buf[1:] != 10)
        for a, b, c in _WIDE:
            starts[3:] |= (buf[:-3] == a) & (buf[1:-2] == b) & (buf[2:-1] == c) & (buf[3:] != 32) & (buf[3:] != 10)
        # A mark and the space behind it may lie in two documents.
        second = offsets[:-1][offsets[:-1] + 1 < n] + 1
        starts[second] = (buf[second - 1] == 10) & (buf[second] != 10)
        starts[offsets[:-1][offsets[:-1] < n]] = True
    at = np.flatnonzero(starts)
    return at, np.searchsorted(at, offsets)


def spans_of(words: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end sentence of the runs that start at each sentence, and of those that end at one and are not among these, singles and whole short documents included. ``to`` parts the documents."""
    n = len(words)
    size = np.diff(to)
    low, high = np.repeat(to[:-1], size), np.repeat(to[1:], size)
    total = np.concatenate([[0], np.cumsum(words)])
    i = np.arange(n)
    end = np.maximum(i + LEAST, np.searchsorted(total, total[:-1] + WORDS))
    begin = np.minimum(i + 1 - LEAST, np.searchsorted(total, total[1:] - WORDS, side="right") - 1)
    forward = i[end <= high]
    ends = i[begin >= low]
    ends = ends[end[begin[ends]] != ends + 1]
    alone = np.flatnonzero(words > ALONE_WORDS)
    short = np.flatnonzero((size >= LEAST) & (total[to[1:]] - total[to[:-1]] < WORDS))
    return forward, end[forward], np.concatenate([begin[ends], alone, to[short]]), np.concatenate([ends + 1, alone + 1, to[short + 1]])


def _digests(raw: memoryview, starts: list[int], ends: list[int]) -> bytes:
    digest = xxhash.xxh3_128_digest
    return b"".join([digest(raw[a:b]) for a, b in zip(starts, ends)])


def runs(docs: DataFrame) -> DataFrame:
    """_gs_id, _gs_text, a, b, i, z, again: the runs of each document, sentences counted from 1."""
    kernel.bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def found(buf: np.ndarray, offsets: np.ndarray):
        at, to = cut(buf, offsets)
        if not len(at):
            return None
        end = np.append(at[1:], len(buf))
        last = np.maximum.accumulate(np.where(_BLANK[buf], -1, np.arange(len(buf))))
        end = np.maximum(np.maximum(last[end - 1] + 1, at), at)
        is_word = kernel._IS_WORD[buf]
        first = is_word.copy()
        first[1:] &= ~is_word[:-1]
        first[at] = is_word[at]
        words = np.add.reduceat(first.astype(np.int64), at)
        each = memoryview(_digests(memoryview(np.ascontiguousarray(buf)), at.tolist(), end.tolist()))
        f, f_end, b, b_end = spans_of(words, to)
        s, e = np.concatenate([f, b]), np.concatenate([f_end, b_end])
        pair = np.frombuffer(_digests(each, (16 * s).tolist(), (16 * e).tolist()), np.int64).reshape(-1, 2)
        doc = np.searchsorted(to, s, side="right") - 1
        # Equal forward runs one sentence after the other.
        same = np.zeros(len(s), bool)
        k = np.arange(1, len(f))
        same[k] = (pair[k] == pair[k - 1]).all(1) & (s[k] == s[k - 1] + 1) & (doc[k] == doc[k - 1])
        head = np.flatnonzero(~same)
        size = np.diff(np.append(head, len(s)))
        first = to[doc[head]]
        return doc[head], pair[head], s[head] - first + 1, e[head + size - 1] - first, size > 1

    def run(batches):
        for batch in batches:
            buf, offsets = kernel.string_buffers(batch.column(2))
            for i, j in kernel.steps(offsets):
                rows = found(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if rows is not None and len(rows[0]):
                    doc, pair, first, last, again = rows
                    which = pa.array(doc + i)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(which), batch.column(1).take(which), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(again)],
                        ["_gs_id", "_gs_text", "a", "b", "i", "z", "again"],
                    )

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    return rows.mapInArrow(run, f"_gs_id {id_type}, _gs_text bigint, a bigint, b bigint, i int, z int, again boolean")


def repeated(rows: DataFrame) -> DataFrame:
    """The ``runs`` whose hash is found more than once. Most are not, so counts go first."""
    often = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("again").alias("twice")).where("n > 1 or twice").select("a", "b")
    return rows.join(often.repartition(F.xxhash64("a", F.lit(1))), ["a", "b"])


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with _gs_pieces and _gs_removed (long) and _gs_kept, the text that is left."""
    rows = docs.drop(*[c for c in docs.columns if c.startswith("_gs_")])
    own = rows.withColumn("_gs_own", F.xxhash64(F.coalesce("text", F.lit(""))))
    spans = later(saved(repeated(runs(rows)))).withColumnRenamed("spans", "_gs_spans")
    both = own.join(spans, F.col("doc_id").eqNullSafe(F.col("_gs_id")) & (F.col("_gs_own") == F.col("_gs_text")), "left").select(*rows.columns, "_gs_spans")
    names, text = rows.columns, rows.columns.index("text")

    def run(batches):
        for batch in batches:
            buf, offsets = kernel.string_buffers(batch.column(text))
            column = batch.column(text)
            pieces, removed, kept = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            spans_ = batch.column(len(names)).to_pylist()
            for k in range(batch.num_rows):
                own = buf[offsets[k] : offsets[k + 1]]
                at, _ = cut(own, np.array([0, len(own)]))
                pieces[k] = len(at)
                if not spans_[k]:
                    kept.append(None)
                    continue
                step = np.zeros(len(at) + 1, np.int64)
                i, z = np.array([(x["i"], x["z"]) for x in spans_[k]], np.int64).T
                np.add.at(step, i - 1, 1)
                np.add.at(step, z, -1)
                gone = np.cumsum(step[:-1]) > 0
                removed[k] = gone.sum()
                kept.append(own[~np.repeat(gone, np.diff(np.append(at, len(own))))].tobytes().decode())
            same = pa.array([x is None for x in kept])
            out = pa.compute.if_else(same, column.cast(pa.string()), pa.array(kept, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(pieces), pa.array(removed), out], [*names, "_gs_pieces", "_gs_removed", "_gs_kept"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["_gs_pieces bigint", "_gs_removed bigint", "_gs_kept string"])
    return both.mapInArrow(run, schema)
