"""Chat formatting: exact round trips, the loss mask, long conversations and awkward rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from grovespan.llm import chat

ROWS = "conv_id bigint, turn bigint, role string, text string"


def awkward_rows():
    rng = random.Random(5)
    bits = ["</s>", "<s>", "[INST]", " [/INST] ", "[AND]", " [AND] ", "\\", "<\\/s>", "[\\\\OUT]", "[", "<", " ", "\n", "é🙂", "ok", "$1", "[ROLE] a [TEXT] ", "[/ROLE]", "</s", "[[INST]]"]
    said = lambda: None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))
    roles = ["user", "assistant", "assistant", "system", "to[INST]ol", None, ""]
    rows = [(c, t, rng.choice(roles), said()) for c in range(40) for t in range(rng.randint(1, 12))]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none")]
    rows += [(50, 1, "assistant", "tie b"), (50, 1, "assistant", "tie a"), (50, None, "user", "first"), (50, 2, "user", "again"), (50, 2, "user", "again")]
    return rows


def plain(rows):
    """What the digest must be, row by row in Python."""
    groups: dict = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, own in groups.items():
        own.sort()
        learned = "".join(x for *_, r, x in own if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        out[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


@pytest.mark.parametrize("most", [chat.SLICE, 1, 3])
def test_round_trip_of_awkward_rows(spark, most):
    rows = awkward_rows()
    out = chat.format_turns(spark.createDataFrame(rows, ROWS).repartition(3), most=most)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digest(out).collect()}
    assert got == plain(rows)
    kept = {r["conv_id"]: r for r in out.collect()}
    assert kept[50]["formatted"] == "<s>[INST] first [/INST][OUT] tie a [AND] tie b </s>[INST] again [AND] again [/INST]"
    raw = kept[50]["formatted"].encode()
    assert [raw[s["start"] : s["start"] + s["size"]].decode() for s in kept[50]["loss_spans"]] == ["tie a", "tie b"]
    assert {c: r["n_turns"] for c, r in kept.items()} == {c: v[0] for c, v in plain(rows).items()}


def test_slices_do_not_change_the_text(spark):
    rows = spark.createDataFrame(awkward_rows(), ROWS)
    whole, cut = ({r["conv_id"]: (r["formatted"], r["loss_spans"]) for r in chat.format_turns(rows, most=m).collect()} for m in (chat.SLICE, 2))
    assert whole == cut


def test_one_conversation_of_many_turns(spark):
    rows = spark.range(6000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "repeat(concat('t', id, ' [INST]'), 3) AS text")
    (got,) = chat.digest(chat.format_turns(rows)).collect()
    assert tuple(got)[1:5] == plain([tuple(r) for r in rows.collect()])[1]


def test_empty_and_extra_columns(spark):
    rows = spark.createDataFrame(awkward_rows(), ROWS)
    assert chat.digest(chat.format_turns(rows.limit(0))).collect() == []
    clash = rows.select("*", *[F.lit(k).alias(n) for k, n in enumerate(("n", "part", "parts", "slice", "marks", "long_id", "count", "_gs_at"))])
    assert sorted(chat.format_turns(clash).collect(), key=str) == sorted(chat.format_turns(rows).collect(), key=str)


def test_other_templates(spark):
    plain_ = chat.Template("<begin>", (("user", "<user>", "</user>"), ("assistant", "<bot>", "</bot>")), ("<as>", "<says>", "</as>"), "<and>")
    rows = [(1, 0, "user", "</s> <user> <\\bot>"), (1, 1, "assistant", "</bot>")]
    out = chat.format_turns(spark.createDataFrame(rows, ROWS), plain_)
    assert out.first()["formatted"] == "<begin><user> </s> <\\user> <\\\\bot> </user><bot> <\\/bot> </bot>"
    assert [tuple(t) for t in out.select(chat.turns(F.col("formatted"), plain_).alias("t")).first()["t"]] == [(r[2], r[3]) for r in rows]
    with pytest.raises(ValueError):
        chat.Template(begin="begin")
    with pytest.raises(ValueError):
        chat.Template(between="<s>")
