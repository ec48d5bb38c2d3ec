"""Secret scans with multipart credential linking.

Base kinds, leftmost and non-overlapping within each kind: ``assign`` (a
credential word, a separator and a value of six characters or more), ``access``
(a cloud access identifier of 20 characters or more) and ``hex`` (24 or more
lower-case hexadecimal digits). Weak candidates alone mean little: an account
identifier, a random-looking value or an endpoint. They are reported as
``link_id``, ``link_secret`` and ``link_endpoint`` only when an interval join
within one scope (no blank line between, at most ``scope`` code points apart)
finds the complementary part: a secret needs an identifier or an endpoint, and
either of those needs a secret. Identifiers are values after a word such as
``login`` and mail addresses; endpoints are URLs, hosts with a port and IPv4
addresses; secrets are random-looking runs. Base spans take part in the join as strong
parts (``access`` as identifier, ``assign`` and ``hex`` as secret) and are
always reported themselves. A weak span that overlaps a base span is dropped.

One pass over Arrow batches, no shuffle. Null and empty texts have no spans.
Repeated rows are scanned each for itself. Only ``doc_id`` and ``text`` are
read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import bounded_batches, steps, string_buffers

KINDS = ("assign", "access", "hex", "link_id", "link_secret", "link_endpoint")
#: Five lines of 80 characters.
SCOPE = 400

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones fail as a whole
WEAK_ID = re.compile(r"""(?<![A-Za-z0-9_])(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|key_?id|tenant(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{4,})""", re.I | re.A)
MAIL = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9@-])")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
ADDRESS = re.compile(rf"(?<![0-9A-Za-z.:]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z:]|\.[0-9])")
WEAK_ENDPOINT = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s\"'<>]+|(?<![A-Za-z0-9.-])(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z0-9-]{1,63}:[0-9]{2,5}(?![0-9]))", re.A)

_HINTS = ("passw", "secret", "token", "api")
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True
_LONG_BYTE = np.zeros(256, bool)
_LONG_BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True


def _has_run(buf: np.ndarray, offsets: np.ndarray, of: np.ndarray, least: int) -> np.ndarray:
    """Which documents hold a run of ``least`` such bytes or more; a run ends with its document."""
    out = np.zeros(len(offsets) - 1, bool)
    for i, j in steps(offsets):
        starts = offsets[i : j + 1] - offsets[i]
        # A run ends at each document's start and, after that, at each byte that is not of the kind.
        stops = np.flatnonzero(~of[buf[offsets[i] : offsets[j]]])
        edges = np.concatenate([starts, stops])
        begins = np.concatenate([starts, stops + 1])
        order = np.argsort(edges, kind="stable")
        edges, begins = edges[order], begins[order]
        long = np.flatnonzero(edges[1:] - begins[:-1] >= least)
        out[i + np.searchsorted(starts, begins[long], side="right") - 1] = True
    return out


def _random_looking(value: str) -> bool:
    """Digits with letters of both cases, at 3.5 bits a character or more."""
    if not (any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= 3.5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def linked_spans(text: str, base: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """Weak spans whose complement lies in the same scope."""
    taken = np.array(sorted((s, e) for s, e, _ in base), np.int64).reshape(-1, 2)
    reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]

    def free(s: int, e: int) -> bool:
        k = int(np.searchsorted(taken[:, 0], e)) - 1
        return k < 0 or reach[k] <= s

    weak = {
        "link_id": {m.span(1) for m in WEAK_ID.finditer(text)} | {m.span() for m in MAIL.finditer(text)},
        "link_secret": {m.span() for m in WEAK_SECRET.finditer(text) if _random_looking(m.group())},
        "link_endpoint": {m.span() for m in WEAK_ENDPOINT.finditer(text)} | {m.span() for m in ADDRESS.finditer(text)},
    }
    weak = {k: [x for x in v if free(*x)] for k, v in weak.items()}
    if not any(weak.values()):
        return []
    blanks = np.array([m.start() for m in re.finditer(r"\n[\x20\t\r]*\n", text)], np.int64)
    parts = {
        "id": weak["link_id"] + [(s, e) for s, e, k in base if k == "access"],
        "secret": weak["link_secret"] + [(s, e) for s, e, k in base if k != "access"],
        "endpoint": weak["link_endpoint"],
    }
    needs = {"link_id": ("secret",), "link_endpoint": ("secret",), "link_secret": ("id", "endpoint")}
    out = []
    for kind, spans in weak.items():
        if spans:
            own = np.array(spans, np.int64)
            hit = np.zeros(len(own), bool)
            for p in needs[kind]:
                hit |= near(own, np.array(parts[p], np.int64).reshape(-1, 2), blanks, scope)
            out += [(int(s), int(e), kind) for s, e in own[hit]]
    return out


def near(own: np.ndarray, others: np.ndarray, blanks: np.ndarray, scope: int) -> np.ndarray:
    """Interval join: which of ``own`` has another span, disjoint, within the scope on either side.

    Of the spans that end before one begins, that of the last end is the nearest,
    and no blank line can part it from the one and not those before it; the same
    holds on the other side. So two binary searches decide each span.
    """
    if not len(own) or not len(others):
        return np.zeros(len(own), bool)
    block = lambda x: np.searchsorted(blanks, x)
    by_end = others[np.argsort(others[:, 1], kind="stable")]
    k = np.searchsorted(by_end[:, 1], own[:, 0], side="right") - 1
    before = by_end[np.maximum(k, 0)]
    hit = (k >= 0) & (own[:, 0] - before[:, 1] <= scope) & (block(before[:, 1]) == block(own[:, 0]))
    starts = np.sort(others[:, 0])
    k = np.searchsorted(starts, own[:, 1])
    after = starts[np.minimum(k, len(starts) - 1)]
    return hit | ((k < len(starts)) & (after - own[:, 1] <= scope) & (block(own[:, 1]) == block(after)))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, base and all spans as arrays of (start, end, kind), code points, end exclusive."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).fill_null("")
            buf, offsets = string_buffers(texts)
            hexes, long = _has_run(buf, offsets, _HEX_BYTE, 24), _has_run(buf, offsets, _LONG_BYTE, 20)
            base_out, all_out = [], []
            for i, text in enumerate(texts.to_pylist()):
                low = text.lower()
                base = []
                if hexes[i] or "AKIA" in text or any(h in low for h in _HINTS):
                    base = base_spans(text)
                # Every link needs a secret, strong (base) or weak (a long run).
                more = linked_spans(text, base, scope) if base or long[i] else []
                order = lambda x: (x[0], KINDS.index(x[2]), x[1])
                base_out.append([{"start": s, "end": e, "kind": k} for s, e, k in sorted(base, key=order)])
                all_out.append([{"start": s, "end": e, "kind": k} for s, e, k in sorted(base + more, key=order)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base_out, kind), pa.array(all_out, kind)], ["doc_id", "base", "spans"])

    spans = "array<struct<start:bigint,end:bigint,kind:string>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {spans}, spans {spans}")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of ``scan``'s rows."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scanned.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
