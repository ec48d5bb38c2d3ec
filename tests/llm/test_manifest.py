"""The Merkle manifest against a plain recursive version, on awkward rows, and tampering."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grovespan.llm import manifest, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join(map(field, (doc_id, source, lang, n_chars, text))))


def brute(rows, fanout):
    """Per row in its source's order: doc_id, leaf, subroot, root, siblings by level, leaf folded after tampering."""

    def tree(nodes):
        paths, own = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(own):
                a = p // fanout * fanout
                paths[i].append((nodes[a:p], nodes[p + 1 : a + fanout]))
                own[i] = p // fanout
            nodes = [h("".join(nodes[a : a + fanout])) for a in range(0, len(nodes), fanout)]
        return nodes[0], paths

    sources = {}
    if not rows:
        return []
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted((((r[0] is not None, r[0] or 0), leaf(*r)) for r in sources[s]))]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        own = sorted(((r[0] is not None, r[0] or 0), leaf(*r), r) for r in sources[s])
        for (_, node, r), path in zip(own, trees[s][1]):
            path = path + top
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf(r[0], text, *r[2:])
            for before, after in path:
                now = h("".join(before) + now + "".join(after))
            out.append((r[0], node, trees[s][0], root, h("".join(x for b, a in path for x in b + a)), now, now == root))
    return out


def found(spark, docs, fanout, levels):
    rows = manifest.manifest(manifest.tampered(docs), fanout, levels)
    out = rows.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(), manifest.folded(F.coalesce("changed", "leaf")).alias("f"))
    return [tuple(r) for r in out.withColumn("v", F.col("f") == F.col("root")).collect()]


def awkward(n):
    rng = random.Random(n)
    sources = [None, "", "a", "B", "é", "z", "\U0001f642", ""] + [f"s{k}" for k in range(n // 12)]
    rows = [(rng.choice([None, rng.randint(-5, n)]) if rng.random() < 0.1 else k, rng.choice([None, "", "Abc ÀB", "plain", "x" * k]), rng.choice([None, "en", ""]), "hot" if rng.random() < 0.4 else rng.choice(sources), rng.choice([None, k, -1])) for k in range(n)]
    return rows + rows[:3] + [rows[0]] * 4


@pytest.mark.parametrize("n,fanout,levels", [(300, 3, 2), (300, 16, 2), (90, 2, 1), (40, 2, 3)])
def test_same_as_plain_recursion(spark, n, fanout, levels):
    rows = awkward(n)
    assert Counter(found(spark, spark.createDataFrame(rows, DOCS).repartition(5), fanout, levels)) == Counter(brute(rows, fanout))


@pytest.mark.parametrize("rows", [[], [(7, "Text", "en", "one", 4)], [(1, "A", None, None, 1), (2, "b", None, "x", 1)], [(5, "q", "en", "s", 1)] * 5])
def test_small_tables(spark, rows):
    assert Counter(found(spark, spark.createDataFrame(rows, DOCS), 16, 2)) == Counter(brute(rows, 16))


def test_shuffled_join_of_sources_and_clashing_columns(spark, monkeypatch):
    rows = awkward(60)
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(manifest, "BROADCAST_BYTES", 0)
    clash = docs.select("*", *[F.lit("x").alias(n) for n in ("leaf", "changed", "subroot", "root", "before", "after", "n", "b", "_gs_i", "_gs_at", "_gs_tree")])
    assert Counter(found(spark, clash, 4, 2)) == Counter(brute(rows, 4))


def test_tampering_is_found_where_letters_change(spark, data):
    rows = queries.op13_merkle_manifest(spark, data).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in rows:
        hit = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in texts[r["doc_id"]] or "")
        assert r["verified"] is not hit
