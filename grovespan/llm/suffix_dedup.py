"""Suffix-array dedup: removes every byte that a repeated 400-byte string covers.

A string of ``LENGTH`` bytes that starts at two places, in one document or in
two, is repeated; all its occurrences are covered, judged on the input; the
covered bytes are cut out.

1. *Anchors.* Of the ``GRAM``-byte grams in every window of ``LENGTH`` bytes, the
   one of least hash (leftmost of equals) is the window's anchor. Equal windows
   have equal anchors at the same offset, so a repeated string is found among
   the surroundings of one gram. An anchor's *context* is the bytes of the windows
   whose anchor it is, some 570. Every window is in one context.
2. *Equal contexts* are counted as 128-bit hashes, partial counts first. A
   context found twice is covered whole. An anchor with one distinct context is
   settled; only distinct contexts of one gram go on, each once.
3. *Shards.* These contexts are dealt by gram into shards of about
   ``SHARD_BYTES``. In a shard, parts of contexts whose middle no other has, and
   parts equal to others, are settled by hashes; of the rest, induced sorting
   gives the suffix array, and permuted common prefixes of ``LENGTH`` or more mark
   the strings that start at two places.
   The names of a shard's leftmost-smaller substrings are not sorted by another
   induction (their alphabet grows with the shard) but by doubling in the groups
   that are still tied.
   A gram of over ``HOT`` contexts would make a shard that grows with the
   input; its windows are instead counted one by one as 128-bit hashes, with
   partial counts before the shuffle, which gives the same rows.
4. The spans of a document meet by its id and are merged.

Joins by a gram, a context or a window read exchanges on both sides, so that Spark
can split a hot one. Some bounded counts run when the query is built.

All shuffles but the last carry hashes and positions. Texts are shuffled only for
documents with contexts to sort or spans to cut; their ids are broadcast to
pick them while they are at most ``BROADCAST_BYTES`` together, beyond that joined.

Null text counts as empty. A text of under 400 bytes keeps all. Repeated rows
(equal doc_id and text) are repeats of each other like any other copies; rows of
equal doc_id and other text are told apart by a hash of the text; null doc_id is
an id. An empty table gives an empty result. Only doc_id and text are read, so
extra columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .suffix_array import common_prefixes, suffix_array
from .tables import dropped, saved

LENGTH = 400
GRAM = 64
SHARD_BYTES = 3_000_000
HOT = 15_000
OWN_SHARD = 1_500
BROADCAST_BYTES = 32 << 20
#: Bytes of an id's row besides its digits or letters.
ROW_BYTES = 48

_BEFORE = LENGTH - GRAM


def grams(buf: np.ndarray) -> np.ndarray:
    """A hash of the gram at each position that has one."""
    n = len(buf)
    up, down = kernel._powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return kernel.mix((sums[GRAM:] - sums[: n - GRAM + 1]) * down[: n - GRAM + 1])


def anchors_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows of ``buf``, their grams' hashes, and the first and last start of each one's windows."""
    found = []
    width = LENGTH - GRAM + 1
    for a in range(0, max(0, len(buf) - LENGTH + 1), kernel.STEP_BYTES):
        part = buf[a : a + kernel.STEP_BYTES + LENGTH - 1]
        h = grams(part)
        # The hash's upper 40 bits, then the position: the minimum is the leftmost of the least.
        least = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        done = 1
        while done * 2 <= width:
            least = np.minimum(least[:-done], least[done:])
            done *= 2
        if done < width:
            rest = width - done
            least = np.minimum(least[:-rest], least[rest:])
        pos = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        edge = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))
        found.append((pos[edge] + a, h[pos[edge]], edge + a, np.append(edge[1:], len(pos)) - 1 + a))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, key, first, last = (np.concatenate(x) for x in zip(*found))
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # an anchor may be met on both sides of a step
    return at[new], key[new], first[new], np.append(last[new[1:] - 1], last[-1])


def _anchors(docs: DataFrame) -> DataFrame:
    """doc_id, th, pos, before, after, gram, c1, c2: every anchor with the hash of its context."""
    kernel.bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            buf, offsets = kernel.string_buffers(batch.column(2))
            for i, j in kernel.steps(offsets):
                part, at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                pos, key, first, last = anchors_of(part)
                doc = np.searchsorted(at, pos, side="right") - 1
                first, last = np.maximum(first, at[doc]), np.minimum(last, at[doc + 1] - LENGTH)
                keep = first <= last  # windows inside the document
                pos, key, doc, begin = pos[keep], key[keep], doc[keep], at[doc[keep]]
                before, after = pos - first[keep], last[keep] + LENGTH - pos
                raw = memoryview(np.ascontiguousarray(part))
                digest = xxhash.xxh3_128_digest
                both = b"".join(digest(raw[a:b], seed=s) for a, b, s in zip((pos - before).tolist(), (pos + after).tolist(), before.tolist()))
                pair = np.frombuffer(both, np.int64).reshape(-1, 2)
                if not len(pos):
                    continue
                which = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(which), batch.column(1).take(which), pa.array((pos - begin).astype(np.int32)), pa.array(before.astype(np.int16)), pa.array(after.astype(np.int16)), pa.array(key.view(np.int64)), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                    ["doc_id", "th", "pos", "before", "after", "gram", "c1", "c2"],
                )

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    return rows.mapInArrow(run, f"doc_id {id_type}, th bigint, pos int, before smallint, after smallint, gram bigint, c1 bigint, c2 bigint")


def sent_bytes(ids: DataFrame) -> int:
    """What the one column of ``ids`` takes when it is broadcast."""
    return ids.agg(F.sum(F.coalesce(F.octet_length(F.col(ids.columns[0]).cast("string")), F.lit(0)) + ROW_BYTES)).first()[0] or 0


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, th, text of the documents whose doc_id is in ``ids``, where these are few enough to be sent; else of all."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    few = ids.select("doc_id").distinct()
    if sent_bytes(few) <= BROADCAST_BYTES:
        few = few.withColumnRenamed("doc_id", "_i")
        rows = rows.join(F.broadcast(few), F.col("doc_id").eqNullSafe(F.col("_i")), "left_semi")
    return rows


_SPANS = "did {0}, th bigint, begin bigint, end bigint"


def repeated_starts(texts: list[bytes], doc: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and place in it of each start of a repeated string, by the suffix array of all ``texts``, in order.

    ``doc`` and ``begin`` place each text; the same place in two texts is one place.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    n = int((sizes + 1).sum()) + 1
    raw = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8)
    t = raw.astype(np.uint16) + np.uint16(2)
    t[starts + sizes] = 1  # parts the texts
    t[-1] = 0  # ends the whole
    owner = np.append(np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1), len(texts) - 1)
    left = (starts + sizes)[owner] - np.arange(n)
    left[-1] = 0
    order = suffix_array(t, 258, LENGTH)
    plcp = common_prefixes(t, raw, order, left.astype(np.int32), starts, 2 * LENGTH)
    line = order[left[order] >= LENGTH]
    if not len(line):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Runs of starts that agree in LENGTH bytes; what lies between two of them agrees as well.
    joined = plcp[line] >= LENGTH
    joined[0] = False
    head = np.flatnonzero(~joined)
    inside = line - starts[owner[line]]
    code = doc[owner[line]] * np.int64(1 << 40) + begin[owner[line]] + inside
    differ = np.minimum.reduceat(code, head) != np.maximum.reduceat(code, head)
    hit = np.flatnonzero(np.repeat(differ, np.diff(np.append(head, len(line)))))
    hit = hit[np.argsort(line[hit])]
    return owner[line[hit]].astype(np.int64), inside[hit]


#: A context's windows begin somewhere at -_BEFORE to 0 from its gram; they are handled in so many parts.
_PARTS = 4
_PART = -(-(_BEFORE + 1) // _PARTS)
#: Bytes that one suffix array sorts at most before the parts are sorted one by one.
_AT_ONCE = 2_500_000


def covered(gram: np.ndarray, doc: np.ndarray, begin: np.ndarray, before: np.ndarray, n: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, first and end byte (of its document) of the spans that repeated strings cover in the contexts of a shard.

    The windows of a part all hold the same middle piece, and lie in one extent.
    A part whose piece no other context of the gram has is settled: nothing
    repeats. Of equal extents, which are covered whole, one goes on. If that
    leaves a gram's piece with one extent, it is settled too. The extents that are
    left are sorted.
    """
    size = np.array([len(x) for x in texts], np.int64)
    rows = []
    for q in range(_PARTS):
        r1 = -_BEFORE + q * _PART
        r2 = min(0, r1 + _PART - 1)
        a, z = np.maximum(before + r1, 0), np.minimum(before + r2 + LENGTH, size)
        p, e = before + r2, before + r1 + LENGTH
        fits = np.flatnonzero((z - a >= LENGTH) & (p >= 0) & (e <= size))
        if len(fits):
            rows.append(np.stack([fits, np.full(len(fits), q), a[fits], z[fits], p[fits], e[fits]], 1))
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    rows = np.concatenate(rows)
    own, part, a, z, p, e = rows.T
    digest = xxhash.xxh3_64_intdigest
    piece = np.array([digest(texts[k][x:y], q) for k, q, x, y in zip(own.tolist(), part.tolist(), p.tolist(), e.tolist())], np.uint64)
    lead = before[own] - a
    whole = np.array([digest(texts[k][x:y], w * _PARTS + q) for k, q, x, y, w in zip(own.tolist(), part.tolist(), a.tolist(), z.tolist(), lead.tolist())], np.uint64)
    key = kernel.mix(gram[own].view(np.uint64)) ^ piece
    whole = kernel.mix(key) ^ whole
    _, first, kind, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    many = (count > 1) | (np.bincount(kind, weights=(n[own] > 1)) > 0)
    # The same place twice (two contexts of one document, or one again) is no repeat by itself.
    place = doc[own] * np.int64(1 << 40) + begin[own] + a
    least, most = np.full(len(count), np.iinfo(np.int64).max), np.full(len(count), -1)
    np.minimum.at(least, kind, place)
    np.maximum.at(most, kind, place)
    many &= (least != most) | (np.bincount(kind, weights=(n[own] > 1)) > 0)
    done = np.flatnonzero(many[kind])
    spans_ = [(own[done], begin[own[done]] + a[done], begin[own[done]] + z[done])]
    _, group, kinds = np.unique(key[first], return_inverse=True, return_counts=True)
    left = first[kinds[group] > 1]
    if len(left):
        left = left[np.lexsort((part[left], own[left]))]
        runs = [left] if (z[left] - a[left]).sum() <= _AT_ONCE else [left[part[left] == q] for q in range(_PARTS)]
        for run in runs:
            if not len(run):
                continue
            new = np.append(True, (own[run][1:] != own[run][:-1]) | (part[run][1:] != part[run][:-1] + 1))
            edge = np.flatnonzero(new)
            last = np.append(edge[1:], len(run)) - 1
            k, s, t = own[run][edge], a[run][edge], z[run][last]
            text, at = repeated_starts([texts[i][x:y] for i, x, y in zip(k.tolist(), s.tolist(), t.tolist())], doc[k], begin[k] + s)
            if len(text):
                cut = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (at[1:] > at[:-1] + LENGTH)))
                tail = np.append(cut[1:], len(text)) - 1
                c = text[cut]
                spans_.append((k[c], begin[k[c]] + s[c] + at[cut], begin[k[c]] + s[c] + at[tail] + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*spans_))


def _sorted_shards(batches):
    """Contexts sorted by shard -> the spans covered in contexts found once."""
    held: list[pa.RecordBatch] = []

    def shard(rows: pa.Table):
        texts = rows["context"].to_pylist()
        ids = rows["did"].combine_chunks().dictionary_encode()
        did = ids.indices.fill_null(len(ids.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        _, doc = np.unique(np.stack([did, rows["th"].to_numpy()], 1), axis=0, return_inverse=True)
        n = rows["n"].to_numpy()
        own, begin, end = covered(rows["gram"].to_numpy(), doc.ravel().astype(np.int64), rows["begin"].to_numpy(), rows["before"].to_numpy().astype(np.int64), n, texts)
        once = n[own] == 1  # contexts found twice are covered whole already
        if not once.any():
            return None
        at = pa.array(own[once])
        return pa.RecordBatch.from_arrays([rows["did"].combine_chunks().take(at), rows["th"].combine_chunks().take(at), pa.array(begin[once]), pa.array(end[once])], ["did", "th", "begin", "end"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(batch.schema.get_field_index("shard")).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if last is not None and key[a] != last and held:
                out = shard(pa.Table.from_batches(held))
                held.clear()
                if out is not None:
                    yield out
            last = key[a]
            held.append(batch.slice(a, b - a))
    if held:
        out = shard(pa.Table.from_batches(held))
        if out is not None:
            yield out


def _windows(batches):
    """The windows of hot grams' contexts as hash and place, for contexts and windows of a batch counted first."""
    for batch in batches:
        rows = {n: batch.column(batch.schema.get_field_index(n)) for n in ("did", "th", "begin", "n", "context")}
        out_owner, out_at, out_hash = [], [], []
        for k, text in enumerate(rows["context"].to_pylist()):
            view = memoryview(text)
            m = len(text) - LENGTH + 1
            if m > 0:
                out_hash.append(b"".join(xxhash.xxh3_128_digest(view[s : s + LENGTH]) for s in range(m)))
                out_owner.append(np.full(m, k))
                out_at.append(np.arange(m))
        if not out_owner:
            continue
        owner, at = np.concatenate(out_owner), np.concatenate(out_at)
        pair = np.frombuffer(b"".join(out_hash), np.int64).reshape(-1, 2)
        which = pa.array(owner)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), rows["did"].take(which), rows["th"].take(which), pa.array(rows["begin"].to_numpy()[owner] + at), rows["n"].take(which)], ["w1", "w2", "did", "th", "begin", "n"])


def _own_exchange(rows: DataFrame, *by: str) -> DataFrame:
    """The aggregated ``rows`` dealt anew, so that a join by their key reads an exchange on either side and Spark can split its hot keys."""
    return rows.repartition(*[F.xxhash64(c, F.lit(1)) for c in by])


def spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """did, th, begin, end: covered bytes of each document, in spans that may overlap."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    every = saved(_anchors(docs))
    again = every.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
    found = saved(every.join(_own_exchange(again, "gram"), "gram"))  # grams found once are settled
    dropped(every)
    place = F.struct("gram", F.col("doc_id").alias("did"), "th", "pos", "before", "after")
    context = saved(found.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min(place).alias("p")).select("c1", "c2", "n", "p.*"))
    kinds = context.groupBy("gram").agg(F.count("*").alias("kinds"))
    open_ = saved(context.join(_own_exchange(kinds, "gram"), "gram"))
    dropped(context)
    twice = open_.where("n > 1").select("c1", "c2")
    whole = found.join(twice, ["c1", "c2"]).select(F.col("doc_id").alias("did"), "th", (F.col("pos") - F.col("before")).cast("bigint").alias("begin"), (F.col("pos") + F.col("after")).cast("bigint").alias("end")).where(f"end - begin >= {LENGTH}")
    several = open_.where("kinds > 1")
    wanted = saved(several.groupBy("did", "th").agg(F.collect_list(F.struct("gram", "kinds", "n", "pos", "before", "after")).alias("want")).withColumnRenamed("th", "wth"))
    total = several.agg(F.sum(F.col("before").cast("bigint") + F.col("after"))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    texts = _picked(docs, wanted.select(F.col("did").alias("doc_id"))).dropDuplicates(["doc_id", "th"])
    cut = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("did")) & (F.col("th") == F.col("wth"))).select("did", "th", F.col("text").cast("binary").alias("b"), F.explode("want").alias("w"))
    cut = cut.select("did", "th", "w.gram", "w.kinds", "w.n", "w.before", (F.col("w.pos") - F.col("w.before")).cast("bigint").alias("begin"), F.expr("substring(b, w.pos - w.before + 1, w.before + w.after)").alias("context"))
    shard = F.when(F.col("kinds") > OWN_SHARD, F.xxhash64("gram")).otherwise(F.pmod(F.xxhash64("gram"), F.lit(shards)))
    cold = cut.where(F.col("kinds") <= hot).select(shard.alias("shard"), "gram", "did", "th", "n", "before", "begin", "context")
    sorted_ = cold.repartition("shard").sortWithinPartitions("shard").mapInArrow(_sorted_shards, _SPANS.format(id_type))
    out = whole.unionByName(sorted_)
    if several.where(F.col("kinds") > hot).limit(1).count():
        w = saved(cut.where(F.col("kinds") > hot).select("did", "th", "n", "begin", "context").mapInArrow(_windows, f"w1 bigint, w2 bigint, did {id_type}, th bigint, begin bigint, n bigint"))
        at = F.struct("did", "th", "begin")
        many = w.groupBy("w1", "w2").agg(F.min(at).alias("a"), F.max(at).alias("z")).where("a <> z").select("w1", "w2")
        out = out.unionByName(w.join(_own_exchange(many, "w1"), ["w1", "w2"]).where("n = 1").select("did", "th", "begin", (F.col("begin") + LENGTH).alias("end")))
    return out


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (long) and kept (binary, the bytes that are left) of every row."""
    merged = saved(spans(docs, hot).groupBy("did", "th").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans")).withColumnRenamed("th", "mth"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            data = batch.column(1).cast(pa.large_binary()).to_pylist()
            for raw, spans_ in zip(data, batch.column(2).to_pylist()):
                kept, at, runs, end = [], 0, 0, -1
                for s in spans_ or ():
                    if s["begin"] > end:
                        kept.append(raw[max(at, 0) : s["begin"]])
                        runs += 1
                    end = max(end, s["end"])
                    at = end
                kept.append(raw[at:])
                left = b"".join(kept)
                for c, v in zip(cols, (len(raw), len(raw) - len(left), runs, left)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    few = merged.select("did").distinct()
    if sent_bytes(few) <= BROADCAST_BYTES:
        marked = rows.join(F.broadcast(few.withColumn("_hit", F.lit(True))), F.col("doc_id").eqNullSafe(F.col("did")), "left").drop("did")
        touched, rest = marked.where("_hit").drop("_hit"), marked.where("_hit is null")
    else:
        touched, rest = rows, None
    both = touched.join(merged, F.col("doc_id").eqNullSafe(F.col("did")) & (F.col("th") == F.col("mth")), "left").select("doc_id", "text", "spans")
    out = both.mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    if rest is not None:
        none = F.lit(0).cast("bigint")
        out = out.unionByName(rest.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept")))
    return out
