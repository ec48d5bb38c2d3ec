"""Vectorised text kernels shared by the operators that run in Arrow batches.

A *word* is a maximal run of bytes other than space and 0x09-0x0D. A document's
*shingles* are its runs of ``width`` consecutive words; a document of fewer
words (but at least one) has one shingle made of all of them. Null text counts
as empty and has no shingle. Upper and lower case differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5

#: Bytes of text that one vectorised step handles at most (longer documents are cut between words).
STEP_BYTES = 1 << 21

_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_POWERS: dict[str, np.ndarray] = {}


def bounded_batches(spark, rows: int = 500, size: str = "16m") -> None:
    """Bound the Arrow batches that reach Python workers, so their memory follows neither row count nor text length.

    Plans are made when a result is read, so the two settings stay lowered in the
    session; they are never raised.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        try:
            now = _bytes(spark.conf.get(key, None))
            if now is None or now <= 0 or now > _bytes(str(value)):
                spark.conf.set(key, str(value))
        except Exception as e:  # a session may forbid a setting that it does not know
            if "CANNOT_MODIFY" not in str(e):
                raise


def _bytes(setting: str | None) -> int | None:
    """The number that a setting such as 500, 16m or 16mb names."""
    found = re.fullmatch(r"(-?\d+)([kmgt]?)b?", (setting or "").strip().lower())
    return int(found[1]) << (10 * " kmgt".index(found[2] or " ")) if found else None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, STEP_BYTES + 4096)
        for name, base in (("up", _B), ("down", _B_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


_LETTERS = np.zeros(256, bool)
_LETTERS[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_LETTERS[128:] = True


def lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    if len(buf) > 1:
        tail = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][tail] += 32
    return out


def word_prefixes(buf: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the letter-and-digit words of lowered text, each whole and by its first bytes; the document of each hash; words of each document."""
    hashes, docs, words_of = [], [], np.zeros(len(offsets) - 1, np.int64)
    low = lowered(buf)
    for i, j in steps(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        while a < b:
            end = b
            if b - a > 2 * STEP_BYTES:  # one long document: cut between words
                gap = np.flatnonzero(~_LETTERS[low[a : a + STEP_BYTES]])
                end = a + (int(gap[-1]) + 1 if len(gap) else STEP_BYTES)
            part = low[a:end]
            w = _LETTERS[part]
            cut = np.zeros(len(part) + 1, bool)
            cut[np.clip(offsets[i:j] - a, 0, len(part))] = True
            cut[-1] = True
            first, last = w.copy(), w.copy()
            first[1:] &= ~w[:-1] | cut[1:-1]
            last[:-1] &= ~w[1:] | cut[1:-1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            up, down = _powers(len(part))
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            doc = np.searchsorted(offsets, s + a, side="right") - 1
            hashes.append(mix((sums[e] - sums[s]) * down[s]))
            docs.append(doc)
            words_of += np.bincount(doc, minlength=len(words_of))
            for p in prefixes:
                long = np.flatnonzero(e - s > p)
                hashes.append(mix((sums[s[long] + p] - sums[s[long]]) * down[s[long]] + np.uint64(p)))
                docs.append(doc[long])
            a = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), words_of
    return np.concatenate(hashes), np.concatenate(docs), words_of


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (or binary) column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes together, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def _words_of(buf: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and end byte of each word of ``buf``; no word crosses ``starts_at``."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = _IS_WORD[buf]
    cut = np.zeros(n + 1, bool)
    cut[starts_at] = True
    cut[n] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | cut[1:n]
    last = w
    last[:-1] &= ~w[1:] | cut[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)), s, e


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all documents in order, and n + 1 offsets into them."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i, j in steps(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        while a < b or j > i:
            end = b
            if b - a > STEP_BYTES and j == i + 1:
                gap = np.flatnonzero(~_IS_WORD[buf[a : a + STEP_BYTES]])
                if len(gap):
                    end = a + int(gap[-1]) + 1
                else:  # one word longer than a step
                    at = a + STEP_BYTES
                    while at < b and _IS_WORD[buf[at]]:
                        at += 1
                    end = at
            h, s, _ = _words_of(buf[a:end], np.minimum(np.maximum(offsets[i:j] - a, 0), end - a))
            hashes.append(h)
            counts[i:j] += np.diff(np.searchsorted(s, np.append(np.maximum(offsets[i:j] - a, 0), end - a)))
            a = end
            if a >= b:
                break
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def shingles(tokens: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each document's shingles in order (repeats included), and n + 1 offsets into them."""
    n = np.diff(offsets)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(counts)])
    k = np.uint64(0xD6E8FEB86659FD93)
    total = len(tokens)
    run = np.zeros(total, np.uint64)
    for d in range(width):
        if d < total:
            run[: total - d] = run[: total - d] * k + tokens[d:]
        run[max(0, total - d) :] = run[max(0, total - d) :] * k
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], counts) + np.repeat(offsets[:-1], counts)
    out = mix(run[at])
    for i in np.flatnonzero((n > 0) & (n < width)):
        h = 0
        for t in tokens[offsets[i] : offsets[i + 1]].tolist():
            h = (h * int(k) + t) & (2**64 - 1)
        out[ends[i]] = mix(np.array([h ^ 0x5851F42D4C957F2D], np.uint64))[0]
    return out, ends


def salts(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**32, count, dtype=np.uint32), rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1)


def hashed_low(x: np.ndarray, xor: np.uint32, by: np.uint32, out: np.ndarray) -> np.ndarray:
    """One 32-bit hash function of the family, of 32-bit inputs."""
    np.bitwise_xor(x, xor, out=out)
    np.multiply(out, by, out=out)
    out ^= out >> np.uint32(15)
    np.multiply(out, np.uint32(0x2C1B3C6D), out=out)
    return out


def signatures(values: np.ndarray, offsets: np.ndarray, count: int, seed: int) -> np.ndarray:
    """MinHash signatures (documents x count, uint32); documents without shingles have the largest value."""
    n = len(offsets) - 1
    sig = np.full((n, count), 0xFFFFFFFF, np.uint32)
    xor, by = salts(count, seed)
    low = (values >> np.uint64(32)).astype(np.uint32)
    block = 1 << 15
    for a in range(0, len(low), block):
        b = min(a + block, len(low))
        first = int(np.searchsorted(offsets, a, side="right")) - 1
        docs = np.arange(first, int(np.searchsorted(offsets, b, side="left")))
        docs = docs[offsets[docs + 1] > np.maximum(offsets[docs], a)]
        at = np.maximum(offsets[docs], a) - a
        x, out = low[a:b], np.empty(b - a, np.uint32)
        for k in range(count):
            least = np.minimum.reduceat(hashed_low(x, xor[k], by[k], out), at)
            sig[docs, k] = np.minimum(sig[docs, k], least)
    return sig
