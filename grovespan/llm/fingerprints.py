"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is cut at empty lines into sections, a section at line feeds into
paragraphs, a paragraph into blocks of up to ``BLOCK_WORDS`` words. A
paragraph's hash is that of its text, so every character counts; a section's
hash is that of its paragraphs' hashes, the root that of the sections' hashes.
Equal texts have equal roots; where roots differ, the branches that differ
locate the edit, down to a block.

The fingerprint writes the tree as ``root|section=paragraph:blocks,...;...``:
32, 16 and 16 hexadecimal digits and 8 for each block.

Two trees are compared from the root. Equal roots end the comparison with likeness
1. Otherwise the sections in front and behind that are equal, hash by hash, are
passed over whole; of those between, the paragraphs in front and behind that are
equal; what is left are the branches that differ. The likeness is twice the number
of blocks under equal branches and of distinct block hashes that both of the
differing branches hold, over the number of blocks under equal branches (in both)
and of distinct block hashes in differing ones (0 if there is none).
``edit_from`` is the first branch of the edited text that differs, as
section.paragraph.block, and ``edit_to`` the last, as section.paragraph, from 1;
both are null if none does.

``with_next`` compares each text with an edited one, whose last half is replaced
by the beginning of the next document's, and with the next document. The next
id is found on the ids alone, in blocks of ids and blocks of blocks, so no window
spans the table; the text is shuffled once by id, and its tree and the part of it
that the document before needs once more.

DataFrame functions only. Null text counts as empty. Rows of one doc_id follow
the same next document; where several rows share the next id, the text of least
hash is next. After the last id comes the first; a single id is its own next.
Null doc_id has no place in the order: its last half is replaced by nothing and
near_next is 0. An empty table gives an empty result. Only doc_id and text are
read, so extra columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved

BLOCK_WORDS = 4
BLOCK = r"[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,3}"
_SHIFT, _SMALL = 12, 1 << 16


def _sha(x: Column, digits: int) -> Column:
    return F.substring(F.sha2(x.cast("binary"), 256), 1, digits)


def let(x: Column, f) -> Column:
    """``f(x)`` with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _blocks(paragraph: Column) -> Column:
    """The hashes of a paragraph's blocks, 8 digits each, joined."""
    return F.array_join(F.transform(F.regexp_extract_all(paragraph, F.lit(BLOCK), F.lit(0)), lambda b: F.substring(F.md5(b.cast("binary")), 1, 8)), "")


def tree(text: Column) -> Column:
    """struct(root, sections: array of struct(h, paragraphs: array of struct(h, b)))."""

    def section(s: Column) -> Column:
        paragraphs = F.transform(F.split(s, "\n", -1), lambda p: F.struct(_sha(p, 16).alias("h"), _blocks(p).alias("b")))
        return let(paragraphs, lambda ps: F.struct(_sha(F.array_join(F.transform(ps, lambda p: p["h"]), ""), 16).alias("h"), ps.alias("paragraphs")))

    sections = F.transform(F.split(text, "\n\n", -1), section)
    return let(sections, lambda ss: F.struct(_sha(F.array_join(F.transform(ss, lambda s: s["h"]), ""), 32).alias("root"), ss.alias("sections")))


def written(t: Column) -> Column:
    paragraph = lambda p: F.concat(p["h"], F.lit(":"), p["b"])
    section = lambda s: F.concat(s["h"], F.lit("="), F.array_join(F.transform(s["paragraphs"], paragraph), ","))
    return F.concat(t["root"], F.lit("|"), F.array_join(F.transform(t["sections"], section), ";"))


def _mapped_blocks(t: Column, f) -> Column:
    """The tree with ``f`` of each paragraph's blocks."""
    paragraph = lambda p: F.struct(p["h"].alias("h"), f(p["b"]).alias("b"))
    section = lambda s: F.struct(s["h"].alias("h"), F.transform(s["paragraphs"], paragraph).alias("paragraphs"))
    return F.struct(t["root"].alias("root"), F.transform(t["sections"], section).alias("sections"))


def packed(t: Column) -> Column:
    """The tree with its blocks as bytes, to be shuffled."""
    return _mapped_blocks(t, F.unhex)


def unpacked(t: Column) -> Column:
    return _mapped_blocks(t, lambda b: F.lower(F.hex(b)))


def _front(a: Column, b: Column) -> Column:
    """How many items in front are equal."""
    apart = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    return F.when(apart == 0, F.size(a)).otherwise(apart - 1)


def _equal_ends(a: Column, b: Column) -> Column:
    """struct(p, s): how many hashes in front, and of the others behind, are equal."""
    behind = lambda x, p: F.reverse(F.slice(x, p + 1, F.size(x)))
    return let(_front(a, b), lambda p: F.struct(p.alias("p"), _front(behind(a, p), behind(b, p)).alias("s")))


def compared(a: Column, b: Column) -> Column:
    """struct(near, edit_from, edit_to) of two trees, from the root down the branches that differ; places are in ``b``."""
    between = lambda x, e: F.slice(x, e["p"] + 1, F.size(x) - e["p"] - e["s"])
    hashes = lambda x: F.transform(x, lambda y: y["h"])
    children = lambda x, e: F.flatten(F.transform(between(x, e), lambda s: s["paragraphs"]))
    joined = lambda x: F.array_join(F.transform(x, lambda p: p["b"]), "")
    each = lambda x: F.regexp_extract_all(x, F.lit(".{8}"), F.lit(0))
    total = F.aggregate(a["sections"], F.lit(0), lambda n, s: n + F.aggregate(s["paragraphs"], F.lit(0), lambda m, p: m + F.length(p["b"])))

    def place(sections: Column, first: Column, k: Column) -> Column:
        """section.paragraph of the k-th paragraph (from 0) after the first ``first`` sections."""
        sizes = F.transform(F.slice(sections, first + 1, F.size(sections)), lambda s: F.size(s["paragraphs"]))
        at = F.aggregate(sizes, F.struct(first.alias("s"), k.alias("p"), F.lit(False).alias("done")),
                         lambda acc, n: F.when(acc["done"] | (acc["p"] < n), F.struct(acc["s"].alias("s"), acc["p"].alias("p"), F.lit(True).alias("done"))).otherwise(F.struct((acc["s"] + 1).alias("s"), (acc["p"] - n).alias("p"), F.lit(False).alias("done"))))
        return let(at, lambda x: F.concat_ws(".", x["s"] + 1, x["p"] + 1))

    def leaves(m: Column, e1: Column, e2: Column) -> Column:
        same = (total - F.length(m["a"])) / 8
        sides = F.struct(F.array_distinct(each(m["a"])).alias("a"), F.array_distinct(each(m["b"])).alias("b"))
        near = let(sides, lambda d: 2.0 * (same + F.size(F.array_intersect(d["a"], d["b"]))) / F.nullif(2 * same + F.size(d["a"]) + F.size(d["b"]), F.lit(0.0)))
        begin = F.concat_ws(".", place(b["sections"], e1["p"], e2["p"]), _front(each(F.coalesce(m["a1"], F.lit(""))), each(m["b1"])) + 1)
        return F.struct(
            F.coalesce(near, F.lit(0.0)).alias("near"),
            F.when(m["n"] > 0, begin).alias("edit_from"), F.when(m["n"] > 0, place(b["sections"], e1["p"], e2["p"] + m["n"] - 1)).alias("edit_to"),
        )

    def paragraphs(x: Column, e1: Column) -> Column:
        return let(_equal_ends(hashes(x["a"]), hashes(x["b"])), lambda e2: let(F.struct(between(x["a"], e2).alias("a"), between(x["b"], e2).alias("b")), lambda m: let(
            F.struct(joined(m["a"]).alias("a"), joined(m["b"]).alias("b"), F.get(m["a"], F.lit(0))["b"].alias("a1"), F.get(m["b"], F.lit(0))["b"].alias("b1"), F.size(m["b"]).alias("n")), lambda z: leaves(z, e1, e2))))

    none = F.lit(None).cast("string")
    differing = let(_equal_ends(hashes(a["sections"]), hashes(b["sections"])), lambda e1: let(F.struct(children(a["sections"], e1).alias("a"), children(b["sections"], e1).alias("b")), lambda x: paragraphs(x, e1)))
    return F.when(a["root"] == b["root"], F.struct(F.lit(1.0).alias("near"), none.alias("edit_from"), none.alias("edit_to"))).otherwise(differing)


def successors(ids: DataFrame, low: int, high: int) -> DataFrame:
    """``ids(k)``, distinct whole numbers from low to high -> k, nxt: the next larger one (null for the last).

    Every window covers at most 2^12 ids, or 2^16 at the top.
    """
    if high - low < _SMALL:
        return ids.select("k", F.lead("k").over(Window.orderBy("k")).alias("nxt"))
    blocked = ids.withColumn("b", F.shiftright("k", _SHIFT))
    inner = blocked.withColumn("nxt", F.lead("k").over(Window.partitionBy("b").orderBy("k")))
    firsts = blocked.groupBy("b").agg(F.min("k").alias("first"))
    above = successors(firsts.select(F.col("b").alias("k")), low >> _SHIFT, high >> _SHIFT)
    over = above.join(firsts, F.col("nxt") == F.col("b")).select(F.col("k").alias("b"), "first")
    return inner.join(over, "b", "left").select("k", F.coalesce("nxt", "first").alias("nxt"))


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.length(text).cast("bigint").alias("n_chars"), written(tree(text)).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edit_from, edit_to of every row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = saved(rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("k")).agg(F.max(F.length("text")).alias("n"), F.min(F.xxhash64("text")).alias("pick")))
    ends = keys.agg(F.min("k").alias("low"), F.max("k").alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    # Each id, the id before it, and how many characters that one needs of it.
    after = successors(keys.select("k"), low, high).select("k", F.coalesce("nxt", F.lit(low)).alias("nxt"))
    needs = after.join(keys, "k").select(F.col("nxt").alias("id"), F.col("k").alias("prev"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    needs = saved(needs.join(keys.select(F.col("k").alias("id"), "pick"), "id"))
    # Both sides read the same exchange of texts by id; only prefixes and packed trees go on to the id before.
    placed = rows.where("doc_id is not null")
    sent = placed.join(needs, F.col("doc_id") == F.col("id")).where(F.xxhash64("text").bitwiseXOR(F.col("pick")) == 0)  # an equality would be a join key and another exchange
    sent = sent.withColumn("t", tree(F.col("text"))).select("prev", F.expr("substring(text, 1, need)").alias("next_part"), packed(F.col("t")).alias("next_tree"))
    both = placed.join(sent.dropDuplicates(["prev"]), F.col("doc_id") == F.col("prev"), "left").select("doc_id", "text", "next_part", "next_tree")
    lone = rows.where("doc_id is null")
    both = both.unionByName(lone, allowMissingColumns=True)
    own = tree(F.col("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.coalesce(F.col("next_part").substr(F.lit(1), half), F.lit("")))
    out = both.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), own.alias("t"), "next_tree")
    out = out.withColumn("e", tree(F.col("edited")))
    out = out.withColumn("x", compared(F.col("t"), F.col("e"))).withColumn("y", F.when(F.col("next_tree").isNotNull(), compared(F.col("t"), unpacked(F.col("next_tree")))["near"]))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("t")).alias("fingerprint"), written(F.col("e")).alias("edited_fingerprint"),
        F.col("x.near").alias("near_edited"), F.coalesce("y", F.lit(0.0)).alias("near_next"), "x.edit_from", "x.edit_to",
    )


_FRONT = "(coalesce(list_position(list_transform(range(1, greatest(len({a}), len({b})) + 1), lambda i: {a}[i] IS NOT DISTINCT FROM {b}[i]), false), len({a}) + 1) - 1)"


def _ends(name: str, source: str, a: str, b: str) -> str:
    """CTEs that add p and s, the numbers of equal items in front and behind of two lists."""
    rest = f"{name}_r AS (SELECT *, list_reverse({a}[{name}_p + 1:]) AS {name}_ra, list_reverse({b}[{name}_p + 1:]) AS {name}_rb FROM (SELECT *, {_FRONT.format(a=a, b=b)} AS {name}_p FROM {source}))"
    return f"{rest}, {name} AS (SELECT * EXCLUDE ({name}_ra, {name}_rb), {_FRONT.format(a=f'{name}_ra', b=f'{name}_rb')} AS {name}_s FROM {name}_r)"


_MIDDLE = "{x}[{e}_p + 1:len({x}) - {e}_s]"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nxt FROM d),
e AS (SELECT doc_id, text, nxt, left(text, length(text) - length(text) // 2) || left(nxt, length(text) // 2) AS edited FROM o),
v AS (SELECT doc_id, 0 AS k, text AS x FROM e UNION ALL SELECT doc_id, 1, edited FROM e UNION ALL SELECT doc_id, 2, nxt FROM e),
t AS (SELECT doc_id, k, list_transform(list_zip(string_split(x, chr(10) || chr(10)), range(1, len(string_split(x, chr(10) || chr(10))) + 1)), lambda s: list_transform(list_zip(string_split(s[1], chr(10)), range(1, len(string_split(s[1], chr(10))) + 1)), lambda p:
    {{'h': substr(sha256(p[1]), 1, 16), 'at': s[2] || '.' || p[2], 'b': list_transform(regexp_extract_all(p[1], '[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){{0,3}}'), lambda b: substr(md5(b), 1, 8))}})) AS s FROM v),
h AS (SELECT doc_id, k, s, list_transform(s, lambda ps: substr(sha256(array_to_string(list_transform(ps, lambda p: p.h), '')), 1, 16)) AS sh FROM t),
f AS (SELECT doc_id, k, s, sh, substr(sha256(array_to_string(sh, '')), 1, 32) AS root, len(flatten(flatten(list_transform(s, lambda ps: list_transform(ps, lambda p: p.b))))) AS n,
    array_to_string(list_transform(range(1, len(s) + 1), lambda i: sh[i] || '=' || array_to_string(list_transform(s[i], lambda p: p.h || ':' || array_to_string(p.b, '')), ',')), ';') AS body FROM h),
c0 AS (SELECT a.doc_id, b.k, a.root = b.root AS same, a.n, a.s AS sa, b.s AS sb, a.sh AS ha, b.sh AS hb FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.k = 0 AND b.k > 0),
{_ends("e1", "c0", "ha", "hb")},
c1 AS (SELECT doc_id, k, same, n, flatten({_MIDDLE.format(x="sa", e="e1")}) AS pa, flatten({_MIDDLE.format(x="sb", e="e1")}) AS pb FROM e1),
c2 AS (SELECT *, list_transform(pa, lambda p: p.h) AS ga, list_transform(pb, lambda p: p.h) AS gb FROM c1),
{_ends("e2", "c2", "ga", "gb")},
c3 AS (SELECT doc_id, k, same, n, {_MIDDLE.format(x="pa", e="e2")} AS ma, {_MIDDLE.format(x="pb", e="e2")} AS mb FROM e2),
c4 AS (SELECT *, flatten(list_transform(ma, lambda p: p.b)) AS ba, flatten(list_transform(mb, lambda p: p.b)) AS bb, coalesce(ma[1].b, []) AS fa, mb[1].b AS fb FROM c3),
c5 AS (SELECT *, n - len(ba) AS eq, len(list_distinct(ba)) AS da, len(list_distinct(bb)) AS db, len(list_intersect(list_distinct(ba), list_distinct(bb))) AS common FROM c4),
c6 AS (SELECT doc_id, k, CASE WHEN same THEN 1.0 WHEN 2 * eq + da + db > 0 THEN 2.0 * (eq + common) / (2 * eq + da + db) ELSE 0.0 END::DOUBLE AS near,
    CASE WHEN NOT same AND len(mb) > 0 THEN mb[1].at || '.' || ({_FRONT.format(a="fa", b="fb")} + 1) END AS edit_from, CASE WHEN NOT same AND len(mb) > 0 THEN mb[len(mb)].at END AS edit_to FROM c5),
g AS (SELECT doc_id, max(CASE WHEN k = 0 THEN root || '|' || body END) AS fingerprint, max(CASE WHEN k = 1 THEN root || '|' || body END) AS edited_fingerprint FROM f GROUP BY doc_id)
SELECT g.doc_id, length(e.text)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, fingerprint, edited_fingerprint, x.near AS near_edited, y.near AS near_next, x.edit_from, x.edit_to
FROM g JOIN e USING (doc_id) JOIN c6 x ON x.doc_id = g.doc_id AND x.k = 1 JOIN c6 y ON y.doc_id = g.doc_id AND y.k = 2
"""
