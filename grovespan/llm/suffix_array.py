"""Suffix arrays by induced sorting in numpy, and permuted longest common prefixes.

The text is an array of small numbers that ends with a single 0. Positions are
classified as smaller (S) or larger (L) than their successor; the leftmost S
positions (LMS) cut the text into substrings. Those are sorted by a first
induction and named; the string of names is sorted recursively, each recursion
doubling the number of names that are compared and going only into the groups
that are still tied; a second induction gives the whole array. An induction
handles the buckets of the first symbol in order, each in a few array steps, so
its work is linear in the text.

``depth`` bounds the number of symbols by which suffixes are told apart: those
that agree in so many may come in any order.
"""

from __future__ import annotations

import numpy as np

from .kernel import _powers, mix


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which positions are S, and the LMS positions in order."""
    n = len(t)
    small = np.empty(n, bool)
    np.less(t[:-1], t[1:], out=small[:-1])
    small[-1] = True
    # An equal pair has the type of the next unequal one.
    unequal = np.append(np.flatnonzero(t[:-1] != t[1:]), n - 1)
    equal = np.flatnonzero(t[:-1] == t[1:])
    small[equal] = small[unequal[np.searchsorted(unequal, equal)]]
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    return small, lms


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, from the LMS positions in order (of their first symbol at least)."""
    n = len(t)
    out = np.empty(n, np.int32)
    count = np.bincount(t, minlength=sigma)
    ends = np.cumsum(count)
    starts = ends - count
    large = np.bincount(t[~small], minlength=sigma)
    present = np.flatnonzero(count)
    lms_ends = np.cumsum(np.bincount(t[lms], minlength=sigma))
    head = starts.copy()

    def ahead(now: np.ndarray) -> None:
        p = now[now > 0] - 1
        p = p[~small[p]]
        if not len(p):
            return
        tp = t[p]
        if len(p) > 1:
            order = np.argsort(tp, kind="stable")
            p, tp = p[order], tp[order]
        edge = np.flatnonzero(np.append(True, tp[1:] != tp[:-1]))
        size = np.diff(np.append(edge, len(tp)))
        at = head[tp[edge]]
        out[np.repeat(at - edge, size) + np.arange(len(tp))] = p
        head[tp[edge]] += size

    for c in present.tolist():
        done = starts[c]
        while done < head[c]:
            upto = head[c]
            ahead(out[done:upto].copy())
            done = upto
        a, b = (lms_ends[c - 1] if c else 0), lms_ends[c]
        if b > a:
            ahead(lms[a:b])

    tail = ends.copy()

    def back(now: np.ndarray) -> None:
        p = now[now > 0] - 1
        p = p[small[p]]
        if not len(p):
            return
        tp = t[p]
        if len(p) > 1:
            order = np.argsort(tp, kind="stable")
            p, tp = p[order], tp[order]
        edge = np.flatnonzero(np.append(True, tp[1:] != tp[:-1]))
        size = np.diff(np.append(edge, len(tp)))
        at = tail[tp[edge]] - 1
        out[np.repeat(at + edge, size) - np.arange(len(tp))] = p
        tail[tp[edge]] -= size

    out[0] = n - 1
    for c in present[::-1].tolist():
        if c == t[-1]:
            break
        done = ends[c]
        while done > tail[c]:
            downto = tail[c]
            back(out[downto:done][::-1].copy())
            done = downto
        if large[c]:
            back(out[starts[c] : starts[c] + large[c]][::-1].copy())
    return out


def _ordered(names: np.ndarray, rounds: int) -> np.ndarray:
    """Ranks of the suffixes of ``names`` by 2 ** rounds names at least; ties keep one rank."""
    n = len(names)
    count = np.bincount(names)
    rank = (np.cumsum(count) - count)[names].astype(np.int64)  # the place of the group's first
    tied = np.flatnonzero(count[names] > 1)
    h = 1
    for _ in range(rounds):
        if not len(tied):
            break
        after = np.where(tied + h < n, rank[np.minimum(tied + h, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        group = key // (n + 1)
        index = np.arange(len(tied))
        new_group = np.append(True, group[1:] != group[:-1])
        new_key = np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(new_group, index, 0))
        sub = np.maximum.accumulate(np.where(new_key, index, 0))
        rank[tied] = group + sub - first
        alone = new_key & np.append(new_key[1:], True)
        tied = tied[~alone]
        h *= 2
    return rank


def suffix_array(t: np.ndarray, sigma: int, depth: int) -> np.ndarray:
    """The suffixes of ``t`` (which ends with its only 0) in order of their first ``depth`` symbols at least."""
    small, lms = classify(t)
    by_symbol = lms[np.argsort(t[lms], kind="stable")]
    first = induce(t, small, by_symbol, sigma)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    # Equal LMS substrings, next LMS position included, get equal names.
    up, down = _powers(len(t))
    sums = np.empty(len(t) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((t.astype(np.uint64) + np.uint64(1)) * up[: len(t)], out=sums[1:])
    ends = np.append(lms[1:] + 1, len(t))
    content = mix((sums[ends] - sums[lms]) * down[lms]) ^ (ends - lms).astype(np.uint64)
    place = np.empty(len(t), np.int32)
    place[lms] = np.arange(len(lms))
    del sums, first
    sorted_content = content[place[order]]
    name = np.cumsum(np.append(False, sorted_content[1:] != sorted_content[:-1]), dtype=np.int32)
    names = np.empty(len(lms), np.int32)
    names[place[order]] = name
    rank = _ordered(names, max(1, int(np.ceil(np.log2(depth)))))
    return induce(t, small, lms[np.argsort(rank, kind="stable")], sigma)


def common_prefixes(t: np.ndarray, raw: np.ndarray, order: np.ndarray, left: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """The permuted common prefixes: of each suffix with the one before it in order, up to ``most``.

    ``raw`` has the symbols as bytes, ``left`` the number of symbols up to the end
    of each position's text, beyond which nothing is compared. Where the suffix
    before i follows that before i - 1 and the symbols before are equal, the
    prefix is one shorter than that of i - 1; only the other positions, and those
    in ``starts``, are compared, eight bytes at a time.
    """
    n = len(t)
    phi = np.full(n, -1, np.int32)
    phi[order[1:]] = order[:-1]
    led = np.empty(n, bool)
    led[0] = True
    led[1:] = (phi[1:] != phi[:-1] + 1) | (phi[1:] < 1) | (phi[:-1] < 0)
    inner = np.flatnonzero(~led)
    led[inner[t[inner - 1] != t[phi[inner] - 1]]] = True
    led[starts] = True
    at = np.flatnonzero(led & (phi >= 0)).astype(np.int32)
    other = phi[at]
    bound = np.minimum(np.minimum(left[at], left[other]), most).astype(np.int32)
    pad = np.zeros(n + 8, np.uint8)
    pad[:n] = raw
    word = np.lib.stride_tricks.as_strided(pad[:8].view(np.uint64), (n,), (1,))
    length = np.zeros(len(at), np.int32)
    live = np.flatnonzero(bound > 0).astype(np.int32)
    done = 0
    while len(live):
        x = word[at[live] + done] ^ word[other[live] + done]
        apart = np.flatnonzero(x)
        if len(apart):
            # The lowest byte that is not zero is the first that differs.
            low = x[apart] & (~x[apart] + np.uint64(1))
            length[live[apart]] = done + (np.log2(low.astype(np.float64)).astype(np.int32) >> 3)
        live = live[x == 0]
        done += 8
        length[live] = done
        live = live[bound[live] > done]
    length = np.minimum(length, bound)
    last = np.maximum.accumulate(np.where(led, np.arange(n, dtype=np.int32), 0))
    known = np.zeros(n, np.int32)
    known[at] = length
    return np.maximum(known[last] - (np.arange(n, dtype=np.int32) - last), 0)
