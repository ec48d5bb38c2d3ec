"""Cross-tokenizer alignment against offsets of whole encoded texts."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grovespan.llm import alignment

DOCS = "doc_id bigint, text string"


def brute(texts):
    """By definition: byte offsets of whole texts' tokens, cuts where both end, links where ranges overlap."""
    both = alignment.sides(alignment.FOLDER)
    found = []
    for t in texts:
        raw = (" " + (t or "")).encode()
        a = both.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = both.b.encode(t) if t else []
        if not t or b"".join(both.a_bytes[x] for x in a) != raw or b"".join(both.b_bytes[x] for x in b) != raw:
            found.append(None)
            continue

        def spans(ids, of):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(of[x])))
                at = out[-1][1]
            return out

        sa, sb = spans(a, both.a_bytes), spans(b, both.b_bytes)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, p, q = [], 0, 0
        for c in cuts:
            i, j = p, q
            while i < len(sa) and sa[i][1] <= c:
                i += 1
            while j < len(sb) and sb[j][1] <= c:
                j += 1
            groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
            p, q = i, j
        links, j0 = [], 0
        for x, (s, e) in zip(a, sa):
            while sb[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(sb) and sb[j][0] < e:
                links.append((x, b[j]))
                j += 1
        found.append((len(a), len(b), ";".join(groups), len(groups), links))
    count = Counter(p for f in found if f for p in set(f[4]))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            links = f[4]
            out.append((f[0], f[1], f[3], len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(f[2].encode()).hexdigest()))
    return out


def awkward_texts():
    rng = random.Random(17)
    bits = ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "▁", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", "　", "​", "é", "é", "漢字", "🙂", "\U000e0001", "don't", "'s", "12,345.67", "words", " of", " many", "ABC", "\x00", "﻿", "ﬁ", "x" * 300, "-----", "मन", "\x07"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    return texts + [None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "a\n b", "a same text", "a same text", "long " * 9000, "y" * 20_000]


def got(rows):
    return [tuple(r)[1:] for r in sorted(rows.collect(), key=lambda r: r["doc_id"])]


def test_same_as_whole_texts(spark):
    texts = awkward_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    assert got(alignment.scored(docs)) == brute(texts)
    groups = {r["doc_id"]: r["groups"] for r in alignment.align(docs).collect()}
    assert [hashlib.sha256(groups[i].encode()).hexdigest() if groups[i] else "" for i in range(len(texts))] == [x[-1] for x in brute(texts)]


def test_same_on_the_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert got(alignment.scored(docs)) == brute(texts)


@pytest.mark.parametrize("name,value", [("BROADCAST_BYTES", -1), ("RUNS", 5), ("TRANSITIONS", 3), ("RUN_CHARS", 10), ("RUN_CHARS", 300)])
def test_bounds_change_nothing(spark, monkeypatch, name, value):
    texts = awkward_texts()[:60]
    want = brute(texts)
    monkeypatch.setattr(alignment, name, value)
    own = alignment.Aligner(alignment.sides(alignment.FOLDER))
    for k in [*range(0, 60, 7), *range(0, 60, 7)]:
        rows = own.documents(texts[k : k + 7])
        assert [(*r[:4], hashlib.sha256(r[4].encode()).hexdigest() if r[0] else "") for r in rows] == [(*w[:4], w[6]) for w in want[k : k + 7]]
        assert len(own.groups) == len(own.number) == len(own.ends) - 1 == len(own.figures) // 4
        assert name != "RUNS" or len(own.number) <= 5
        assert name != "RUN_CHARS" or sum(map(len, own.number)) == own.chars <= value
    if name == "BROADCAST_BYTES":
        assert got(alignment.scored(spark.createDataFrame(list(enumerate(texts)), DOCS))) == want


def test_without_cuts_whole_texts_are_read():
    both = alignment.Sides(alignment.FOLDER)
    texts = [t for t in awkward_texts()[:80] if t]
    cut = alignment.Aligner(both)
    rows = cut.documents(texts)
    assert both.cuts and len(cut.number) > len(texts)
    both.cuts = False
    whole = alignment.Aligner(both)
    assert [list(map(str, r)) for r in whole.documents(texts)] == [list(map(str, r)) for r in rows]
    assert len(whole.number) <= len(texts)


def test_transitions():
    t = alignment.Transducer([b"ab", b"c"], [b"a", b"bc"])
    assert t.align([0, 1], [0, 1]) == (["0,1|0,1"], [0, 1, 3])
    assert t.states == [(0, b""), (1, b"ab"), (1, b"b"), (2, b"c")]
    assert t.next == [{0: 1}, {0: 2}, {1: 3}, {1: 0}]
    before = t.transitions
    assert t.align([0, 1], [0, 1]) and t.transitions == before
    assert t.align([0], [0]) is None and t.align([1], [0]) is None and t.align([], [0]) is None and t.align([], []) == ([], [])


def test_empty_null_and_extra_columns(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, None), (None, "")], DOCS)
    want = sorted(map(str, alignment.scored(docs).collect()))
    clash = docs.select("*", *[F.lit("x").alias(c) for c in ("pair", "pairs", "n", "best", "times", "link", "n_a", "groups", "_gs_row")])
    assert sorted(map(str, alignment.scored(clash).collect())) == want and len(want) == 4
    assert alignment.scored(docs.limit(0)).collect() == []
