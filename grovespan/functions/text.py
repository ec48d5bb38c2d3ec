"""Scalar text functions as Spark columns: token counts, answer scoring, identifiers, label parsing."""

from __future__ import annotations

import json
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two tokenizers' patterns. (?U) makes blanks and word characters Unicode; 0x1C-0x1F are blanks too.
EVIDENCE_TOKEN = r"(?U)[A-Za-z0-9_]+|[一-鿿]|[^\s\x1c-\x1f]"
LOG_TOKEN = r"(?U)\w+|[^\w\s]"
MARGIN = 0.10


def evidence_tokens(text: Column, margin: float = MARGIN) -> Column:
    """Surrogate token count with a safety margin, rounded up; null text has none."""
    n = F.coalesce(F.regexp_count(text, F.lit(EVIDENCE_TOKEN)), F.lit(0))
    return F.ceil(n * F.lit(1.0 + margin)).cast("bigint")


def log_tokens(text: Column) -> Column:
    """Token count of request logs: words and single marks, no margin."""
    return F.coalesce(F.regexp_count(text, F.lit(LOG_TOKEN)), F.lit(0)).cast("bigint")


def normalized_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, blanks collapsed."""
    bare = F.translate(F.lower(text), string.punctuation, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def exact_match(candidate: Column, references: Column) -> Column:
    """1 if the normalised candidate equals any normalised reference, else 0."""
    own = normalized_answer(candidate)
    return F.exists(references, lambda r: normalized_answer(r) == own).cast("int")


def substring_match(candidate: Column, references: Column) -> Column:
    """1 if the normalised candidate contains any normalised reference (an empty one is in all), else 0."""
    own = normalized_answer(candidate)
    return F.exists(references, lambda r: own.contains(normalized_answer(r))).cast("int")


def judge_says_yes(text: Column) -> Column:
    return F.lower(F.trim(text)).contains("yes")


def judge_label(text: Column) -> Column:
    """The label of a strict JSON reply: exactly one key, ``label``, once, a whole number 0 or 1; otherwise null."""
    v = F.try_parse_json(text)
    # A schema text is compared, so true, 1.0 and "1" are no labels; a repeated key does not parse.
    kind = F.schema_of_variant(v)
    value = F.try_variant_get(v, "$.label", "bigint")
    return F.when((kind == "OBJECT<label: BIGINT>") & value.isin(0, 1), value).cast("int")


def is_abstention(row_id: Column, kind: Column) -> Column:
    return F.coalesce(row_id.endswith("_abs"), F.lit(False)) | F.coalesce(kind.endswith("-abs") | kind.endswith("_abs"), F.lit(False))


SEPARATORS = (",", ";", " and ", " then ", ". ")


def partial_answer(text: Column) -> Column:
    """The part before the first of ``SEPARATORS`` that gives one, else the first half of the words; null if that is not a strict part."""
    words = F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda w: w != "")
    half = F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int"))), " ")
    strict = lambda x: F.when((x != "") & (x != text), x)
    return F.coalesce(*[F.when(text.contains(s), strict(F.trim(F.substring_index(text, s, 1)))) for s in SEPARATORS], F.when(F.size(words) > 1, strict(half)))


def canonical_hash(*fields: tuple[str, Column]) -> Column:
    """SHA-256 of compact JSON with sorted keys, for ids, numbers, nulls and ASCII text."""
    ordered = F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda x: x[0])])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}).cast("binary"), 256)


@F.pandas_udf(T.StringType())
def canonical_text_hash(values: pd.Series) -> pd.Series:
    """The hash of a JSON document given as text, for content that is not ASCII or holds floats."""
    import hashlib

    def one(x):
        return None if x is None else hashlib.sha256(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()

    return values.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def normalized_question(values: pd.Series) -> pd.Series:
    """NFKC, blanks collapsed, case folded: Spark has neither NFKC nor case folding."""
    return values.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).split()).casefold(), na_action="ignore")


def evidence_id(episode: Column, position: Column, session: Column) -> Column:
    return F.format_string("%s:evidence:%03d:%s", episode.cast("string"), position, session.cast("string"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays of equal length; 0 if a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot / size)


def context_too_long(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("context_length") | low.contains("maximum context") | low.contains("context window")


def redacted(text: Column, secret: str, most: int = 500) -> Column:
    return F.substring(F.replace(text, F.lit(secret), F.lit("[REDACTED]")), 1, most)


def leaf_cache_key(**fields: Column) -> Column:
    """The key of a cached leaf: the hash of its eleven inputs, the evidence span as an array of two."""
    names = {"dataset_version_or_commit", "episode_id", "k", "partition_hash", "evidence_span", "C_leaf", "leaf_prompt_hash", "constructor_model_snapshot", "decoding_config_hash", "s_leaf", "backbone_id"}
    if set(fields) != names:
        raise ValueError(f"a leaf's key needs {', '.join(sorted(names))}")
    return canonical_hash(*fields.items())


def trajectory_text(messages: Column, states: Column, content: Column, goal: Column) -> Column:
    """Contents of the messages, else of the states' four fields, one a line; else content or goal."""
    of_states = F.flatten(F.transform(states, lambda s: F.array_compact(F.array(*[s[f].cast("string") for f in ("thought", "accessibility_tree", "action", "url")]))))
    return F.when(messages.isNotNull(), F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")).when(states.isNotNull(), F.array_join(of_states, "\n")).otherwise(F.coalesce(F.nullif(content, F.lit("")), F.nullif(goal, F.lit("")), F.lit("")))


def answer_evidence(*lists: Column) -> Column:
    """The first list that is there, else an empty one."""
    return F.coalesce(*lists, F.array().cast("array<string>"))


def session_text(turns: Column, time: Column) -> Column:
    """A header with the session's time and a line ``role: content`` for each turn."""
    return F.array_join(F.concat(F.array(F.concat(F.lit("["), time, F.lit("]"))), F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["content"]))), "\n")


def duration(started: Column, finished: Column) -> Column:
    """Seconds between two times; 0 if one is missing."""
    return F.coalesce((F.unix_micros(finished) - F.unix_micros(started)) / 1e6, F.lit(0.0))


def observed_identity(value: Column) -> Column:
    """The value, or null where it is blank or a placeholder."""
    t = F.trim(value)
    return F.when(~F.lower(t).isin("", "none", "unknown"), t)


def explicit_revision(value: Column) -> Column:
    """The revision, or null where it is a rolling name."""
    return F.when((F.length(F.trim(value)) > 0) & ~F.lower(value).isin("main", "latest", "default", "unknown"), value)
