"""Benchmark decontamination by size-partitioned MinHash containment search.

Which documents contain 0.8 or more of a test item's shingles (runs of five
words)? Items are partitioned by their number of shingles (powers of two). MinHash
sees a short item in a set of bounded size only, so for each partition a document
is searched in overlapping windows of twice the partition's upper bound, one bound
apart: an item of at most ``u`` shingles lies whole in a window of ``2u``, whatever
the document's length. A window and an item that agree in any of ``HASHES``
minima make a candidate; a window that holds 0.8 of an item of q > u/2 shingles has
a likeness of at least 0.4u / 2.1u = 0.19, so that all 64 miss with a probability
under 2e-6. Items of at most four shingles are searched in windows of one shingle, whose
minimum is the shingle itself, and so without a miss. Every candidate is then verified by exact containment over the
shingles of the whole document.

The items are broadcast in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_CHARS`` characters, each a pass over the documents, so that a larger
benchmark never outgrows a worker. The documents are not shuffled.

Null and empty documents and items match nothing. An item of fewer than five words
has one shingle, all of its words, and matches a document of just these words.
Repeated rows are matched each for itself; repeated items (same id and text) once.
Only doc_id, text and item_id, text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .tables import keyed

CONTAINS_NUM, CONTAINS_DEN = 4, 5
HASHES = 64
TINY = 4
SEED = 20_011
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 32_000_000


class Items:
    """A block of test items with their minima, by size partition."""

    def __init__(self, ids: list, texts: list[str]):
        buf, offsets = kernel.string_buffers(pa.array(texts, pa.large_string()))
        tokens, at = kernel.words(buf, offsets)
        values, at = kernel.shingles(tokens, at)
        self.ids = ids
        self.sets = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:])]
        sizes = np.array([len(s) for s in self.sets])
        flat = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        sig = kernel.signatures(flat, np.concatenate([[0], np.cumsum(sizes)]), HASHES, SEED)
        power = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        self.parts = []
        for p in np.unique(power[sizes > TINY]):
            members = np.flatnonzero((power == p) & (sizes > TINY))
            order = np.argsort(sig[members], axis=0, kind="stable")
            self.parts.append((1 << int(p), members[order], np.take_along_axis(sig[members], order, axis=0)))
        tiny = np.flatnonzero(sizes <= TINY)
        tiny_flat, owner = np.concatenate([*(self.sets[i] for i in tiny), np.zeros(0, np.uint64)]), np.repeat(tiny, sizes[tiny])
        order = np.argsort(tiny_flat, kind="stable")
        self.tiny, self.tiny_owner = tiny_flat[order], owner[order]

    def candidates(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pairs (document, item) with a window that shares a minimum; ``offsets`` delimit each document's shingles."""
        low = (values >> np.uint64(32)).astype(np.uint32)
        xor, by = kernel.salts(HASHES, SEED)
        found = []
        block = 1 << 15
        if len(self.tiny):
            lo = np.searchsorted(self.tiny, values)
            hit = np.flatnonzero(self.tiny[np.minimum(lo, len(self.tiny) - 1)] == values)
            doc = np.searchsorted(offsets, hit, side="right") - 1
            n = np.searchsorted(self.tiny, values[hit], side="right") - lo[hit]
            item = self.tiny_owner[np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            found.append(np.unique(np.repeat(doc, n) * np.int64(len(self.ids)) + item))
        for bound, members, minima in self.parts:
            # Cells of `bound` shingles, counted within each document; two neighbours make a window.
            counts = np.diff(offsets)
            cells = -(-counts // bound)
            cell_doc = np.repeat(np.arange(len(counts)), cells)
            in_doc = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
            starts = np.repeat(offsets[:-1], cells) + in_doc * bound
            ends = np.append(starts[1:], offsets[-1])
            alone = np.append(cell_doc[1:] != cell_doc[:-1], True)
            a = 0
            while a < len(starts):
                b = max(a + 1, int(np.searchsorted(starts, starts[a] + block)))
                # one cell more, so that windows reach over the edge of the block
                c = min(b + 1, len(starts))
                x = low[starts[a] : ends[c - 1]]
                out, at = np.empty(len(x), np.uint32), starts[a:c] - starts[a]
                for k in range(HASHES):
                    least = np.minimum.reduceat(kernel.hashed_low(x, xor[k], by[k], out), at)
                    window = least[: b - a].copy()
                    if c - a > 1:
                        pairs = np.minimum(least[:-1], least[1:])[: b - a]
                        window[: len(pairs)] = np.where(alone[a : a + len(pairs)], window[: len(pairs)], pairs)
                    keys = minima[:, k]
                    lo = np.searchsorted(keys, window, side="left")
                    hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == window)
                    if len(hit):
                        hi = np.searchsorted(keys, window[hit], side="right")
                        n = hi - lo[hit]
                        item = members[np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), k]
                        found.append(np.unique(np.repeat(cell_doc[a:b][hit], n) * np.int64(len(self.ids)) + item))
                a = b
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def matches(self, values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """document, item, shared shingles and the item's shingles of each verified pair."""
        last, own = -1, None
        for code in self.candidates(values, offsets).tolist():
            doc, item = divmod(code, len(self.ids))
            if doc != last:
                last, own = doc, np.unique(values[offsets[doc] : offsets[doc + 1]])
            s = self.sets[item]
            at = np.minimum(np.searchsorted(own, s), len(own) - 1)
            shared = int((own[at] == s).sum())
            if shared * CONTAINS_DEN >= len(s) * CONTAINS_NUM:
                yield doc, item, shared, len(s)


def blocks(items: DataFrame) -> Iterator[list]:
    """The items in blocks of bounded size; one task never holds more than a block."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    ids, texts, chars = [], [], 0
    for row in rows.toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or chars + len(row["text"]) > BLOCK_CHARS):
            yield [ids, texts]
            ids, texts, chars = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        chars += len(row["text"])
    if ids:
        yield [ids, texts]


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, shared, item_shingles (long), containment (double) of every contaminated pair."""
    spark = docs.sparkSession
    kernel.bounded_batches(spark)
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, shared bigint, item_shingles bigint, containment double"
    out = None
    for block in blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            known = Items(*sent.value)
            for batch in batches:
                ids = batch.column(0)
                buf, offsets = kernel.string_buffers(batch.column(1))
                for i, j in kernel.steps(offsets):
                    tokens, at = kernel.words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    values, at = kernel.shingles(tokens, at)
                    got = list(known.matches(values, at))
                    if got:
                        doc, item, shared, n = (list(x) for x in zip(*got))
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array([i + d for d in doc])), pa.array([known.ids[k] for k in item], arrow_item), pa.array(shared, pa.int64()), pa.array(n, pa.int64()), pa.array([s / m for s, m in zip(shared, n)], pa.float64())],
                            ["doc_id", "item_id", "shared", "item_shingles", "containment"],
                        )

        from pyspark.sql.pandas.types import to_arrow_type

        arrow_item = to_arrow_type(items.schema["item_id"].dataType)
        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def cleaned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item. Rows of one doc_id and text go together."""
    bad = matches(keyed(docs), items).select(F.col("doc_id.id").alias("_gs_id"), F.col("doc_id.t").alias("_gs_key")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_gs_id")) & (F.xxhash64("text") == F.col("_gs_key")), "left_anti")


SQL = r"""
WITH t AS (SELECT doc_id AS id, 0 AS item, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT item_id, 1, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT id, item, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN ['<' || array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT id, count(*)::BIGINT AS n FROM s WHERE item = 1 GROUP BY id),
p AS (SELECT d.id AS doc_id, b.id AS item_id, count(*)::BIGINT AS shared FROM s d JOIN s b ON d.g = b.g AND d.item = 0 AND b.item = 1 GROUP BY ALL)
SELECT doc_id, item_id, shared, n AS item_shingles, shared::DOUBLE / n AS containment FROM p JOIN n ON n.id = p.item_id WHERE shared * 5 >= n * 4
"""
