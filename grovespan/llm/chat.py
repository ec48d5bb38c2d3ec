"""Chat formatting: one training text per conversation, with Spark expressions only.

Turns are collected and sorted, adjacent turns of one role are merged by an array
aggregation, and the pieces are concatenated::

    <s>[INST] question [/INST][OUT] answer [AND] more of it </s>[ROLE] system [TEXT] rules [/ROLE]

A control string inside a text or a role gets a backslash behind its bracket, and one
that has backslashes there gets one more (``</s>`` to ``<\\/s>``, ``<\\/s>`` to ``<\\\\/s>``),
so the control strings of a template are never part of a text and ``turns`` gives back
every row, role and text to the character. ``loss_spans`` are the UTF-8 byte ranges of
assistant texts in ``formatted``; marks, also those between merged turns, are outside.

Conversations of at most ``SLICE`` turns are one group each. The rows of longer ones get
their places from a sort by ranges, are formatted in slices of ``SLICE`` turns, and only
the slices' texts meet (a conversation's text is one value of the result, and so the
least that one row can hold). Which conversations are long comes from counts of their
ids, broadcast while they are at most ``BROADCAST_IDS``, so most rows are shuffled once.

Rows of equal or null turn are ordered by role and text, null first; repeated rows are
turns of their own; null text and null role count as empty; rows of null conv_id are one
conversation; an empty table gives an empty result. Only the four columns are read, so
extra columns may have any name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import positions, saved

SLICE = 512
BROADCAST_IDS = 100_000


@dataclass(frozen=True)
class Template:
    """Control strings: each in one pair of brackets, without brackets, backslashes and spaces inside."""

    begin: str = "<s>"
    #: role, open, close
    roles: tuple[tuple[str, str, str], ...] = (("user", "[INST]", "[/INST]"), ("assistant", "[OUT]", "</s>"))
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    between: str = "[AND]"
    learned: str = "assistant"

    def __post_init__(self):
        for c in self.controls():
            if not re.fullmatch(r"<[^<>\[\]\\\s]+>|\[[^<>\[\]\\\s]+\]", c):
                raise ValueError(f"not a control string: {c}")
        if len(set(self.controls())) < len(self.controls()):
            raise ValueError("control strings must differ")

    def controls(self) -> list[str]:
        return [self.begin, *(m for r in self.roles for m in r[1:]), *self.other, self.between]

    def marks(self) -> str:
        """A pattern of what stands behind the bracket of a control string, with the bracket in front as a look-behind."""
        kinds = []
        for bracket in "<[":
            bodies = [re.escape(c[1:]) for c in self.controls() if c[0] == bracket]
            if bodies:
                kinds.append((re.escape(bracket) if bracket == "[" else bracket, "|".join(bodies)))
        return "|".join(rf"(?<={b})%s(?=\\*(?:{bodies}))" for b, bodies in kinds)

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self.marks().replace("%s", ""), r"\\")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self.marks().replace("%s", r"\\"), "")

    def opening(self, role: Column) -> Column:
        out = F.concat(F.lit(f"{self.other[0]} "), self.escaped(role), F.lit(f" {self.other[1]} "))
        for name, start, _ in self.roles:
            out = F.when(role == name, F.lit(f"{start} ")).otherwise(out)
        return out

    def closing(self, role: Column) -> Column:
        out = F.lit(f" {self.other[2]}")
        for name, _, end in self.roles:
            out = F.when(role == name, F.lit(f" {end}")).otherwise(out)
        return out

    def blocks(self) -> tuple[str, str]:
        """Patterns of a block of merged turns, and of what its texts stand between."""
        pairs = [(a, b) for _, a, b in self.roles] + [(self.other[0], self.other[2])]
        whole = "|".join(rf"{re.escape(a)} (?s:.*?) {re.escape(b)}" for a, b in pairs)
        fronts = [rf"{re.escape(a)} " for _, a, _ in self.roles] + [rf"{re.escape(self.other[0])} (?s:.*?) {re.escape(self.other[1])} "]
        backs = "|".join(re.escape(b) for _, b in pairs)
        return whole, rf"\A(?:{'|'.join(fronts)})| (?:{backs})\z"


MARKED = Template()
_BLOCKS = "array<struct<role:string,texts:array<string>>>"


def _slices(rows: DataFrame, keys: list[str], template: Template) -> DataFrame:
    """``keys``, n, and the slice of each group: role of the first and last turn, body (without the first turn's mark in front), its bytes, spans in it."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def merged(all_: Column, t: Column) -> Column:
        last = F.get(all_, F.size(all_) - 1)
        more = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        alone = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        return F.when((F.size(all_) > 0) & (last["role"] == t["role"]), F.concat(F.slice(all_, F.lit(1), F.size(all_) - 1), F.array(more))).otherwise(F.concat(all_, F.array(alone)))

    blocks = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.count("*").alias("n"))
    blocks = blocks.select(*keys, "n", F.aggregate("turns", F.array().cast(_BLOCKS), merged).alias("blocks"))

    def piece(block: Column, i: Column, text: Column, j: Column) -> Column:
        front = F.concat(template.closing(F.get("blocks", i - 1)["role"]), template.opening(block["role"]))
        mark = F.when(j > 0, F.lit(f" {template.between} ")).when(i > 0, front).otherwise("")
        return F.struct(mark.alias("mark"), template.escaped(text).alias("text"), (block["role"] == template.learned).alias("loss"))

    pieces = F.flatten(F.transform("blocks", lambda b, i: F.transform(b["texts"], lambda t, j: piece(b, i, t, j))))

    def span(done: Column, p: Column) -> Column:
        start, size = done["at"] + F.octet_length(p["mark"]), F.octet_length(p["text"]).cast("bigint")
        spans = F.when(p["loss"], F.concat(done["spans"], F.array(F.struct(start.alias("start"), size.alias("size"))))).otherwise(done["spans"])
        return F.struct((start + size).alias("at"), spans.alias("spans"))

    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,size:bigint>>").alias("spans"))
    out = blocks.select(*keys, "n", F.col("blocks")[0]["role"].alias("first"), F.element_at("blocks", -1)["role"].alias("last"), pieces.alias("pieces"))
    body = F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), "")
    return out.select(*keys, "n", F.struct("first", "last", body.alias("body"), F.aggregate("pieces", none, span).alias("done")).alias("part"))


def _joined(rows: DataFrame, template: Template) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans of ``rows(conv_id, n, parts)``, the slices of each conversation in order."""

    def mark(part: Column, j: Column) -> Column:
        before = F.get("parts", j - 1)["last"]
        front = F.when(before == part["first"], F.lit(f" {template.between} ")).otherwise(F.concat(template.closing(before), template.opening(part["first"])))
        return F.when(j > 0, front).otherwise(F.concat(F.lit(template.begin), template.opening(part["first"])))

    marked = rows.select("conv_id", "n", "parts", F.transform("parts", mark).alias("marks"))
    text = F.concat(F.array_join(F.transform("parts", lambda p, j: F.concat(F.get("marks", j), p["body"])), ""), template.closing(F.element_at("parts", -1)["last"]))
    size = lambda p, j: F.octet_length(F.get("marks", j)) + p["done"]["at"]
    bases = F.aggregate(F.transform("parts", size), F.array(F.lit(0).cast("bigint")), lambda all_, n: F.concat(all_, F.array(F.element_at(all_, -1) + n)))
    based = marked.select("conv_id", F.col("n").alias("n_turns"), text.alias("formatted"), "parts", "marks", bases.alias("bases"))

    def moved(p: Column, j: Column) -> Column:
        by = F.get("bases", j) + F.octet_length(F.get("marks", j))
        return F.transform(p["done"]["spans"], lambda s: F.struct((s["start"] + by).alias("start"), s["size"].alias("size")))

    return based.select("conv_id", "n_turns", "formatted", F.flatten(F.transform("parts", moved)).alias("loss_spans"))


def format_turns(rows: DataFrame, template: Template = MARKED, most: int = SLICE) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (UTF-8 byte ranges of what is learned) of each conversation of ``rows(conv_id, turn, role, text)``."""
    rows = rows.select("conv_id", "turn", "role", "text")
    long = rows.groupBy(F.col("conv_id").alias("long_id")).count().where(F.col("count") > most).select("long_id")
    long = saved(long)
    count = long.limit(BROADCAST_IDS + 1).count()
    ids = F.broadcast(long) if count <= BROADCAST_IDS else long
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = _slices(rows.join(ids, same, "left_anti") if count else rows, ["conv_id"], template)
    out = _joined(short.select("conv_id", "n", F.array("part").alias("parts")), template)
    if not count:
        return out
    placed = positions(rows.join(ids, same, "left_semi"), "conv_id", "turn", "role", "text").withColumn("slice", F.floor(F.col("_gs_at") / most))
    sliced = _slices(placed.withColumn("turn", F.col("_gs_at")), ["conv_id", "slice"], template)
    met = sliced.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("slice", "part"))).alias("s"))
    return out.unionByName(_joined(met.select("conv_id", "n", F.transform("s", lambda x: x["part"]).alias("parts")), template))


def turns(formatted: Column, template: Template = MARKED) -> Column:
    """The rows that a formatted text was made of, as array of struct(role, text)."""
    whole, edges = template.blocks()
    name = rf"\A{re.escape(template.other[0])} ((?s:.*?)) {re.escape(template.other[1])} "

    def rows(block: Column) -> Column:
        role = template.unescaped(F.regexp_extract(block, name, 1))
        for known, start, _ in template.roles:
            role = F.when(F.startswith(block, F.lit(f"{start} ")), F.lit(known)).otherwise(role)
        texts = F.split(F.regexp_replace(block, edges, ""), re.escape(f" {template.between} "), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), template.unescaped(t).alias("text")))

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(whole), F.lit(0)), rows))


def learned(formatted: Column, spans: Column, template: Template = MARKED) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    each = lambda raw: F.transform(spans, lambda s: template.unescaped(F.substring(raw, s["start"].cast("int") + 1, s["size"].cast("int")).cast("string")))
    return F.get(F.transform(F.array(formatted.cast("binary")), lambda raw: F.array_join(each(raw), "")), F.lit(0))


def digest(rows: DataFrame, template: Template = MARKED) -> DataFrame:
    """conv_id and what a reader of ``formatted`` and ``loss_spans`` finds in them."""
    read = rows.select("conv_id", turns(F.col("formatted"), template).alias("turns"), learned(F.col("formatted"), F.col("loss_spans"), template).alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: Conversation -7 says what the template uses as control strings.
PROBE = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))

SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
placed AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w AS before, lead(role) OVER w AS after,
    length(text) + len(regexp_extract_all(text, '<\\*(?:s|/s)>|\[\\*(?:INST|/INST|OUT|ROLE|TEXT|/ROLE|AND)\]')) AS chars,
    length(role) + len(regexp_extract_all(role, '<\\*(?:s|/s)>|\[\\*(?:INST|/INST|OUT|ROLE|TEXT|/ROLE|AND)\]')) AS role_chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, chars
    + CASE WHEN before = role THEN 7 ELSE CASE role WHEN 'user' THEN 7 WHEN 'assistant' THEN 6 ELSE 15 + role_chars END END
    + CASE WHEN after = role THEN 0 ELSE CASE role WHEN 'user' THEN 8 WHEN 'assistant' THEN 5 ELSE 8 END END AS written
  FROM placed)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(written))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
