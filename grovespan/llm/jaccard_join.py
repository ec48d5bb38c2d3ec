"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Which documents share 0.8 or more of their shingles (runs of five words)?

1. *Classes.* Documents of equal words, in order, are one class; only its least
   doc_id goes on, with the class size, so copies are never compared.
2. *Forest.* Each class has ``TREES`` signatures of ``DEEP`` minima. A tree's trie
   branch at depth d is the set of classes with equal first d minima; a hash of
   these names it, nested in the branch one shorter. ``shortest()`` is the depth at
   which a pair at the threshold meets in some tree with probability ``RECALL``; a
   class that is alone in all branches of that depth is settled.
3. *Deepest prefixes.* Classes that share a branch of depth ``DEEP`` are linked to
   the least of it, so a million equal ones give a million links, not their
   square. The links' connected components are verified whole.
4. *Shortening.* A class shortens its prefix by what it matched: of its links
   found so far, and one more that is supposed at the threshold, the expected
   share that meets at depth d is the mean of 1 - (1 - J^d)^TREES; its depth is the
   longest at which that reaches ``RECALL``. Classes with many close neighbours
   stay deep, others go down to ``shortest()``. Two classes that no deepest
   component has both are compared where they share a branch of the shorter of
   their depths, once, in the first such tree. A branch without such pairs, or
   with the members of one in an earlier tree, is dropped.
5. *Verification.* The texts of a component's or branch's members go to one task
   once; one of over ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles is cut into
   bands of size and bands into blocks, and each two blocks whose sizes can reach
   0.8 meet in a task. A task counts the shared shingles of all its pairs at once,
   with matrices of those shingles in which members differ, and returns one row per
   member: its links, weighted by class sizes, the chance that these do not meet
   at each depth, and the least member that links lead to. So no pair is ever a row,
   and no link inside a component or branch is lost.
6. *Groups.* Components of the verified links are the near-duplicate groups.

The result has one row per document: class_id (least doc_id of its group),
copy_id (least doc_id of equal words), n_links (other documents at 0.8 or more,
copies included) and n_texts (other classes at 0.8 or more).

Null and empty texts have no shingle and are one class. Documents of fewer than
five words have one shingle, all of their words. doc_id is taken to identify a
row; repeated rows count as copies of each other, each with its own result row
(rows of equal doc_id and different text are told apart by their words). Null
doc_id rows are put in their classes like others and come last in order.
Only doc_id and text are read, so extra columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .components import components
from .tables import keyed, saved

NUM, DEN = 4, 5
TREES = 24
DEEP = 8
RECALL = 0.9999
SEED = 7_001
BLOCK = 1024
BLOCK_SHINGLES = 3_000_000


def missed(d: int, likeness=NUM / DEN):
    """The probability that a pair shares no branch of depth d."""
    return (1 - likeness**d) ** TREES


def shortest(recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets with the target probability."""
    return next((d for d in range(DEEP, 1, -1) if 1 - missed(d) >= recall), 1)


def _pairs128(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each document's words in order, as two columns."""
    raw = tokens.tobytes()
    both = b"".join(xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist()))
    return np.frombuffer(both, np.int64).reshape(-1, 2)


def _distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sets = [np.unique(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int64)


def prefix_keys(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document and tree, a 64-bit key of the shortest prefix, and the minima that may follow it."""
    d = shortest()
    s = sig.reshape(len(sig), TREES, DEEP)
    key = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), s.shape[:2]).copy()
    for k in range(d):
        key = kernel.mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k].astype(np.uint64))
    return key.view(np.int64), s[:, :, d:].reshape(len(sig), -1).view(np.int32)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, wa, wb (hash of the words), size (distinct shingles), keys (one per tree; none without shingles), more (the minima behind them)."""
    kernel.bounded_batches(docs.sparkSession)
    wide = TREES * (DEEP - shortest())

    def run(batches):
        for batch in batches:
            buf, offsets = kernel.string_buffers(batch.column(1))
            for i, j in kernel.steps(offsets):
                tokens, at = kernel.words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                values, to = kernel.shingles(tokens, at)
                values, to = _distinct(values, to)
                pair = _pairs128(tokens, at)
                keys, more = prefix_keys(kernel.signatures(values, to, TREES * DEEP, SEED))
                has = np.diff(to) > 0
                ends = np.concatenate([[0], np.cumsum(has)])
                lists = [pa.ListArray.from_arrays(pa.array((ends * n).astype(np.int32)), pa.array(np.ascontiguousarray(x[has]).ravel())) for x, n in ((keys, TREES), (more, wide))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(np.diff(to)), *lists], ["doc_id", "wa", "wb", "size", "keys", "more"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, wa bigint, wb bigint, size bigint, keys array<bigint>, more array<int>")


def branch_keys(d: int) -> Column:
    """The names of a class's branches of depth d, one per tree."""
    wide, longer = DEEP - shortest(), d - shortest()
    return F.transform("keys", lambda k, t: F.xxhash64(F.lit(d), k, *[F.get(F.col("more"), t * wide + x) for x in range(longer)]))


def met(classes: DataFrame) -> DataFrame:
    """The classes that share a branch of the shortest depth with another."""
    rows = classes.select("c", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a <> z").select("key")
    some = rows.join(shared.repartition(F.xxhash64("key", F.lit(1))), "key").select("c").distinct()
    return classes.join(some, "c")


def branch_links(members: DataFrame) -> DataFrame:
    """a, b: each class with the least class of each of its deepest branches."""
    rows = members.select("c", F.explode(branch_keys(DEEP)).alias("key"))
    branch = rows.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a <> z").select("key", "a")
    return rows.join(branch.repartition(F.xxhash64("key", F.lit(1))), "key").where("a <> c").select("a", F.col("c").alias("b")).distinct()


def shortened(members: DataFrame) -> DataFrame:
    """A row for each member of each branch that holds pairs to compare: unit, tree, d, c, rep, copies, size, part (its deepest component), depth, own (its branches of that depth)."""
    out = None
    for d in range(shortest(), DEEP):
        own = branch_keys(d)
        rows = members.where(F.col("depth") >= d).select("c", "rep", "copies", "size", "part", "depth", F.lit(d).alias("d"), F.posexplode(own).alias("tree", "key"))
        out = rows if out is None else out.unionByName(rows)
    stats = out.groupBy("key").agg(
        F.min("part").alias("p"), F.max("part").alias("q"), F.min("depth").alias("least"), F.first("d").alias("d"), F.first("tree").alias("tree"),
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("c")).alias("x"), F.sum(F.pmod(F.xxhash64("c", F.lit(2)), F.lit(1 << 40))).alias("y"))
    stats = stats.where("p <> q and least = d").groupBy("d", "n", "x", "y").agg(F.min(F.struct("tree", "key")).alias("first")).select(F.col("first.key").alias("key"))
    rows = out.join(stats.repartition(F.xxhash64("key", F.lit(1))), "key").withColumn("unit", F.hex("key")).drop("key")
    wide = F.coalesce(*[F.when(F.col("d") == d, branch_keys(d)) for d in range(shortest(), DEEP)])
    return rows.join(members.select("c", "keys", "more"), "c").withColumn("own", wide).drop("keys", "more")


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered ``left`` with those numbered ``right``."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    dense = count > m / 2
    # Shared = dense shingles, less those that either lacks, plus those that both lack, plus the shared rare ones.
    lacks = int(dense.sum()) - np.bincount(owner[dense[code]], minlength=m)
    out = (int(dense.sum()) - lacks[left][:, None] - lacks[right][None, :]).astype(np.float64)
    telling = np.flatnonzero(np.where(dense, m - count, count) >= 2)
    number = np.full(len(count), -1, np.int64)
    number[telling] = np.arange(len(telling))
    which = number[code]
    keep = which >= 0
    own, which = owner[keep], which[keep]
    order = np.argsort(which, kind="stable")
    own, which = own[order], which[order]
    width = max(64, min(len(telling), (1 << 22) // m))
    for a in range(0, len(telling), width):
        b = min(a + width, len(telling))
        lo, hi = np.searchsorted(which, [a, b])
        x = np.zeros((m, b - a), np.float32)
        x[own[lo:hi], which[lo:hi] - a] = 1
        flip = dense[telling[a:b]]
        x[:, flip] = 1 - x[:, flip]
        out += x[left] @ x[right].T
    return out


def linked(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, barred=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each member: its links weighted by copies, its links, the least member that its links lead to, and the summed chances that they share no branch of each longer depth.

    side 0 and 1: only pairs of members of the two sides; all 2: every pair.
    ``barred(left, right)`` marks pairs that are compared elsewhere.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    square = bool((side == 2).all())
    left, right = (np.arange(m), np.arange(m)) if square else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    weight, links, root = np.zeros(m, np.int64), np.zeros(m, np.int64), np.arange(m)
    lost = np.zeros((m, DEEP - shortest()))
    if not len(left) or not len(right):
        return weight, links, root, lost
    shared = shared_counts(sets, left, right)
    both = sizes[left][:, None] + sizes[right][None, :]
    near = (NUM + DEN) * shared >= NUM * both
    if square:
        np.fill_diagonal(near, False)
    if barred is not None:
        near &= ~barred(left, right)
    at, to = np.nonzero(near)
    likeness = shared[at, to] / (both[at, to] - shared[at, to])
    for k, d in enumerate(range(shortest() + 1, DEEP + 1)):
        chance = missed(d, likeness)
        lost[:, k] += np.bincount(left[at], chance, minlength=m)
        if not square:
            lost[:, k] += np.bincount(right[to], chance, minlength=m)
    links[left] = near.sum(1)
    weight[left] = near @ copies[right]
    if not square:
        links[right] = near.sum(0)
        weight[right] = copies[left] @ near
    if near.any():
        while True:
            before = root.copy()
            root[left] = np.minimum(root[left], np.where(near, root[right][None, :], m).min(1))
            root[right] = np.minimum(root[right], np.where(near, root[left][:, None], m).min(0))
            root = root[root]
            if (root == before).all():
                break
    return weight, links, root, lost


_LINKS = "wa bigint, wb bigint, weight bigint, links bigint, ra bigint, rb bigint, lost array<double>"


def _verify(batches):
    """Rows sorted by block; yields the members' links block by block."""
    names = [n.split(" ")[0] for n in _LINKS.split(", ")]
    held: list[pa.RecordBatch] = []

    def block(rows: pa.Table):
        buf, offsets = kernel.string_buffers(rows["text"])
        tokens, at = kernel.words(buf, offsets)
        pair = _pairs128(tokens, at)
        wa, wb = rows["wa"].to_numpy(), rows["wb"].to_numpy()
        # Another text of the same doc_id, or a repeated row, is not the class.
        mark = np.zeros(len(wa), bool)
        own = (pair[:, 0] == wa) & (pair[:, 1] == wb)
        seen = set()
        for k in np.flatnonzero(own).tolist():
            if (key := (wa[k], wb[k])) not in seen:
                seen.add(key)
                mark[k] = True
        keep = np.flatnonzero(mark)
        if len(keep) < 2:
            return None
        order = keep[np.lexsort((wb[keep], wa[keep]))]
        values, to = kernel.shingles(tokens, at)
        sets = [np.unique(values[to[k] : to[k + 1]]) for k in order.tolist()]
        barred = elsewhere(rows.take(pa.array(order))) if "own" in rows.column_names else None
        weight, links, root, lost = linked(sets, rows["copies"].to_numpy()[order], rows["side"].to_numpy()[order], barred)
        hit = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (wa[order][hit], wb[order][hit], weight[hit], links[hit], wa[order][root[hit]], wb[order][root[hit]], list(lost[hit]))], names) if len(hit) else None

    def elsewhere(rows: pa.Table):
        """Pairs of one deepest component, pairs of which neither has the branch's depth, and pairs that share a branch in an earlier tree."""
        part, depth = rows["part"].to_numpy(), rows["depth"].to_numpy()
        d, tree = rows["d"][0].as_py(), rows["tree"][0].as_py()
        own = np.array(rows["own"].to_pylist(), np.int64)

        def barred(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            out = part[left][:, None] == part[right][None, :]
            out |= (depth[left] != d)[:, None] & (depth[right] != d)[None, :]
            for t in range(tree):
                out |= own[left, t][:, None] == own[right, t][None, :]
            return out

        return barred

    def flush():
        if held:
            out = block(pa.Table.from_batches(held))
            held.clear()
            if out is not None:
                yield out

    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        key = batch.column(batch.schema.get_field_index("block")).to_pylist()
        cuts = [0, *(k for k in range(1, len(key)) if key[k] != key[k - 1]), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if key[a] != last:
                yield from flush()
                last = key[a]
            held.append(batch.slice(a, b - a))
    yield from flush()


def blocks(members: DataFrame) -> DataFrame:
    """A row for each block that a member of a unit goes to: block (a text), side."""
    big = members.groupBy("unit").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    large = saved(big.where((F.col("n") > BLOCK) | (F.col("s") > BLOCK_SHINGLES)).select("unit"))
    if large.isEmpty():
        return members.withColumns({"block": F.col("unit"), "side": F.lit(2)})
    banded = members.withColumn("band", F.floor(F.log("size") / F.log(F.lit(DEN / NUM))).cast("int"))
    per_band = banded.join(large, "unit", "left_semi").groupBy("unit", "band").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    cells = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    per_band = per_band.select("unit", "band", cells.alias("cells"))
    below, above = (per_band.select("unit", (F.col("band") + d).alias("band"), F.col("cells").alias(n)) for d, n in ((1, "below"), (-1, "above")))
    around = saved(per_band.join(below, ["unit", "band"], "left").join(above, ["unit", "band"], "left"))
    small = members.join(large, "unit", "left_anti").withColumns({"block": F.col("unit"), "side": F.lit(2)})
    x = F.pmod(F.xxhash64("c"), F.col("cells")).cast("int")
    name = lambda band, a, other, b: F.concat_ws(".", "unit", band, a, other, b)
    at = banded.join(around, ["unit", "band"]).withColumn("x", x)
    own = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda y: F.struct(name(F.col("band"), F.least("x", y), F.col("band"), F.greatest("x", y)).alias("block"), F.when(y == F.col("x"), 2).when(F.col("x") < y, 0).otherwise(1).alias("side")))
    up = F.when(F.col("above").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda y: F.struct(name(F.col("band"), F.col("x"), F.col("band") + 1, y).alias("block"), F.lit(0).alias("side"))))
    down = F.when(F.col("below").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda y: F.struct(name(F.col("band") - 1, y, F.col("band"), F.col("x")).alias("block"), F.lit(1).alias("side"))))
    none = F.array().cast("array<struct<block:string,side:int>>")
    every = at.withColumn("to", F.explode(F.concat(own, F.coalesce(up, none), F.coalesce(down, none)))).select(*members.columns, "to.block", "to.side")
    return small.unionByName(every)


def verified(members: DataFrame, docs: DataFrame) -> DataFrame:
    """The links of the members of each unit, with the texts of ``docs``; a text meets its rows once and then goes to their blocks."""
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    sent = blocks(members).join(texts, F.col("rep") == F.col("_id"))
    more = [n for n in ("part", "depth", "d", "tree", "own") if n in members.columns]
    sent = sent.select("block", "side", "copies", F.col("c.wa").alias("wa"), F.col("c.wb").alias("wb"), "text", *more)
    return saved(sent.repartition("block").sortWithinPartitions("block").mapInArrow(_verify, _LINKS))


def depths(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with depth, to which each one's prefixes are shortened by the links that it has."""
    sums = found.groupBy(F.struct("wa", "wb").alias("c")).agg(F.sum("links").alias("links"), *[F.sum(F.get("lost", F.lit(k))).alias(f"lost{k}") for k in range(DEEP - shortest())])
    both = members.join(sums, "c", "left")
    reached = lambda d: (F.col(f"lost{d - shortest() - 1}") + missed(d)) / (F.col("links") + 1) <= 1 - RECALL
    depth = F.coalesce(*[F.when(reached(d), F.lit(d)) for d in range(DEEP, shortest(), -1)], F.lit(shortest()))
    return both.select(*members.columns, depth.alias("depth"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copy_id, n_links, n_texts: one row per row of ``docs``."""
    return _joined(keyed(docs)).select(*[F.col(f"{c}.id").alias(c) for c in ("doc_id", "class_id", "copy_id")], "n_links", "n_texts")


def _joined(docs: DataFrame) -> DataFrame:
    """The columns of ``join`` for rows whose doc_id is that of ``keyed``, which tells rows of other texts apart."""
    rows = saved(signed(docs))
    classes = saved(rows.groupBy("wa", "wb").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *[F.first(n).alias(n) for n in ("size", "keys", "more")]).withColumn("c", F.struct("wa", "wb")))
    members = saved(met(classes).select("c", "rep", "copies", "size", "keys", "more"))
    deepest = components(branch_links(members)).withColumnRenamed("node", "c")
    parted = saved(members.join(deepest, "c", "left").withColumn("part", F.xxhash64(F.coalesce("component", "c"))))
    unit = F.concat(F.hex("component.wa"), F.hex("component.wb"))
    close = verified(parted.where("component is not null").select("c", "rep", "copies", "size", unit.alias("unit")), docs)
    further = saved(shortened(saved(depths(parted.drop("component"), close))))
    found = close.unionByName(verified(further, docs))
    edges = found.select(F.struct("wa", "wb").alias("a"), F.struct(F.col("ra").alias("wa"), F.col("rb").alias("wb")).alias("b"))
    groups = components(edges).select(F.col("node").alias("c"), "component")
    counts = found.groupBy("wa", "wb").agg(F.sum("weight").alias("weight"), F.sum("links").alias("links")).select(F.struct("wa", "wb").alias("c"), "weight", "links")
    own = classes.select("c", "rep", "copies").join(groups, "c").join(counts, "c")
    least = own.groupBy("component").agg(F.min("rep").alias("class_id"))
    near = own.join(least, "component").select("c", "class_id", "weight", "links")
    full = classes.select("c", "wa", "wb", "rep", "copies").join(near, "c", "left")
    result = full.select("wa", "wb", F.coalesce("class_id", "rep").alias("class_id"), F.col("rep").alias("copy_id"), (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_texts"))
    return rows.select("doc_id", "wa", "wb").join(result, ["wa", "wb"]).select("doc_id", "class_id", "copy_id", "n_links", "n_texts")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of its least doc_id (null is last), and of its text's hash among equal ones."""
    keep = _joined(keyed(docs)).where("doc_id = class_id").select(F.col("doc_id.id").alias("_gs_id"), F.col("doc_id.t").alias("_gs_key")).distinct()
    own = docs.withColumn("_gs_text", F.xxhash64("text"))
    kept = own.join(keep, F.col("doc_id").eqNullSafe(F.col("_gs_id")) & (F.col("_gs_text") == F.col("_gs_key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_gs_text"]).drop("_gs_text")
