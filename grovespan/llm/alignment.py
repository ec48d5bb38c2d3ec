"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes, here a byte-level BPE (A) and a piece BPE with byte
fallback (B). The transducer reads the tokens of both sides; its state is the side that
leads and the bytes of its last token that the other side has not reached yet. The side
behind gives the next token, which is linked to the leading one: it shortens the
residual, or passes it and leads in turn. Where the residual is empty both sides end at
one byte and the group closes. Transitions are memoised by lead, residual and token.

At a lone space between two visible characters the state is always empty: no word of
A's splitting and no piece of B holds a space behind another character (``Sides`` checks
the vocabularies and reads whole texts otherwise). So the transducer also memoises its
runs from one such space to the next. Both memos are bounded: transitions start anew when
they are full, runs that come up when theirs is are aligned for their batch alone.

``align`` returns the groups and the distinct linked pairs of each document; ``counted``
how many documents hold each pair, summed in each task before the shuffle; ``scored``
joins these counts with the links, which are written once and are smaller than the
texts. Counts are broadcast while they are at most ``BROADCAST_BYTES``, otherwise joined
by shuffle, where Spark splits hot pairs.

Null and empty texts, and texts whose tokens do not give their bytes back, have no tokens:
all figures 0, the groups empty. Control strings of the vocabularies are ordinary text.
Repeated rows are documents of their own, null doc_id is kept, an empty table gives an
empty result, and extra columns may have any name, as only doc_id and text are read. The
vocabulary files' folder is a parameter and must be readable on every executor.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .tables import saved

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Most runs and transitions kept by a worker, and characters of the runs kept.
RUNS, TRANSITIONS, RUN_CHARS = 400_000, 1_000_000, 16 << 20
BROADCAST_BYTES, COUNT_BYTES = 256 << 20, 64

_SPACE = "▁"
#: Runs: a space, and all up to the next lone space between two visible characters.
_RUN = re.compile(r" \S+(?:(?! \S)\s+\S*)*|\A\s+\S*(?:(?! \S)\s+\S*)*")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: visible ones stand for themselves, the others for 256 and on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(others)}


class Sides:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(os.path.join(folder, A_FILE))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, B_FILE))
        letters = _byte_letters()
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(letters[c] for c in self.a.id_to_token(i)) if all(c in letters for c in self.a.id_to_token(i)) else self.a.id_to_token(i).encode() for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) for p in pieces) and not any(re.search(r"\S ", t.decode(errors="replace")) for t in self.a_bytes)

    def runs(self, text: str) -> list[str]:
        """The text with a space in front, cut where no token of either side crosses."""
        spaced = " " + text
        found = _RUN.findall(spaced) if self.cuts else [spaced]
        return found if sum(map(len, found)) == len(spaced) else [spaced]

    def encoded(self, runs: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(runs, add_special_tokens=False)]
        return a, self.b.encode([r[1:] for r in runs], num_threads=1)


_SIDES: dict[str, Sides] = {}


def sides(folder: str) -> Sides:
    if folder not in _SIDES:
        _SIDES[folder] = Sides(folder)
    return _SIDES[folder]


class Transducer:
    """Aligns two token lists. A state is (lead, residual): 0 and no bytes, 1 where A leads, 2 where B leads; states and their transitions are numbered as they come up."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.of, self.width = (a_bytes, b_bytes), len(b_bytes)
        self.forget()

    def forget(self) -> None:
        self.numbers = {(0, b""): 0}
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.leads = [0]
        #: of each state: the next state, -1 where the bytes differ, by the token of the side behind
        self.next: list[dict[int, int]] = [{}]
        self.transitions = 0

    def step(self, state: int, token: int) -> int:
        """The state after the side behind (A where none is) gives ``token``, which is noted."""
        lead, residual = self.states[state]
        behind = 1 if lead == 1 else 0
        own = self.of[behind][token]
        if lead and residual.startswith(own):
            rest, ahead = residual[len(own) :], lead
        elif own.startswith(residual):
            rest, ahead = own[len(residual) :], behind + 1
        else:
            rest, ahead = b"", -1
        new = -1
        if ahead >= 0:
            key = (ahead, rest) if rest else (0, b"")
            new = self.numbers.setdefault(key, len(self.states))
            if new == len(self.states):
                self.states.append(key)
                self.leads.append(key[0])
                self.next.append({})
        self.next[state][token] = new
        self.transitions += 1
        return new

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]] | None:
        """The closed groups (``a1,a2|b1``) and the linked pairs (a * size of B + b), or None where the sides' bytes differ."""
        if self.transitions >= TRANSITIONS:
            self.forget()
        after, leads, width = self.next, self.leads, self.width
        na, nb = len(a), len(b)
        i = j = p = q = state = ahead = 0
        groups, links = [], []
        while i < na or j < nb:
            lead = leads[state]
            if lead == 1:
                if j == nb:
                    return None
                token = b[j]
                j += 1
                links.append(ahead * width + token)
            else:
                if i == na:
                    return None
                token = a[i]
                i += 1
                if lead:
                    links.append(token * width + ahead)
            new = after[state].get(token)
            if new is None:
                new = self.step(state, token)
            if new < 0:
                return None
            if leads[new] != lead:
                ahead = token
            state = new
            if not state:
                one = i - p == 1 == j - q
                groups.append(f"{a[p]}|{b[q]}" if one else f"{','.join(map(str, a[p:i]))}|{','.join(map(str, b[q:j]))}")
                p, q = i, j
        return None if state else (groups, links)


class Aligner:
    """Runs of texts, aligned once each: the first ``RUNS`` are kept, those that come up later only for their batch."""

    def __init__(self, both: Sides):
        self.sides, self.transducer = both, Transducer(both.a_bytes, both.b_bytes)
        self.number: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        #: by run: tokens of A and B, groups, and whether the bytes are the text's
        self.figures = array("q")
        #: the linked pairs of all runs, and where each run's end
        self.pairs, self.ends = array("q"), array("q", [0])
        self.fleeting: list[str] = []

    def learn(self, runs: set[str]) -> None:
        new = [r for r in runs if r not in self.number]
        a_bytes, figures, pairs, ends = self.sides.a_bytes, self.figures, self.pairs, self.ends
        for run, a, b in zip(new, *(self.sides.encoded(new) if new else ((), ()))):
            found = self.transducer.align(a, b) if b"".join([a_bytes[x] for x in a]) == run.encode() else None
            if len(self.groups) >= RUNS or self.chars + len(run) > RUN_CHARS:
                self.fleeting.append(run)
            else:
                self.chars += len(run)
            self.number[run] = len(self.groups)
            if found is None:
                figures.extend((0, 0, 0, 0))
                self.groups.append("")
            else:
                figures.extend((len(a), len(b), len(found[0]), 1))
                self.groups.append(";".join(found[0]))
                pairs.extend(found[1])
            ends.append(len(pairs))

    def forget(self) -> None:
        """Drop the runs that were not to be kept. They are not always the last, so all after the first of them go."""
        if not self.fleeting:
            return
        least = min(map(self.number.__getitem__, self.fleeting))
        for run in [r for r, k in reversed(self.number.items()) if k >= least]:
            del self.number[run]
        self.chars = sum(map(len, self.number)) if least < RUNS else self.chars
        del self.groups[least:], self.figures[4 * least :], self.pairs[self.ends[least] :], self.ends[least + 1 :]
        self.fleeting = []

    def documents(self, texts: list[str | None]) -> list[tuple]:
        """Of each text: tokens of A and B, groups, links, the groups' text, the distinct linked pairs and how often each is."""
        cut = [self.sides.runs(t) if t else None for t in texts]
        self.learn({r for c in cut if c for r in c})
        number, groups = self.number.__getitem__, self.groups.__getitem__
        figures = np.frombuffer(self.figures, np.int64).reshape(-1, 4)
        pairs, ends = np.frombuffer(self.pairs, np.int64) if self.pairs else np.zeros(0, np.int64), np.frombuffer(self.ends, np.int64)
        none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        out = []
        for c in cut:
            if c is None:
                out.append(none)
                continue
            ids = list(map(number, c))
            at = np.array(ids, np.int64)
            n_a, n_b, n_groups, right = figures[at].sum(0).tolist()
            if right < len(ids):
                out.append(none)
                continue
            size = ends[at + 1] - ends[at]
            begin = np.cumsum(size) - size
            linked, times = np.unique(pairs[np.repeat(ends[at] - begin, size) + np.arange(int(size.sum()))], return_counts=True)
            out.append((n_a, n_b, n_groups, int(size.sum()), ";".join(map(groups, ids)), linked, times))
        del figures, pairs, ends  # views: their arrays cannot shrink before
        self.forget()
        return out


_ALIGNERS: dict[str, Aligner] = {}


def aligner(folder: str) -> Aligner:
    if folder not in _ALIGNERS:
        _ALIGNERS[folder] = Aligner(sides(folder))
    return _ALIGNERS[folder]


def align(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2``, decimal ids), pairs and times (distinct linked pairs as a * size of B + b, how often) of every row."""
    kernel.bounded_batches(docs.sparkSession)

    def run(batches):
        own = aligner(folder)
        for batch in batches:
            _, offsets = kernel.string_buffers(batch.column(1))
            for i, j in kernel.steps(offsets):
                part = batch.slice(i, j - i)
                rows = list(zip(*own.documents(part.column(1).to_pylist())))
                ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in rows[5]])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c).astype(np.int64))) for c in rows[5:]]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in rows[:4]), pa.array(rows[4], pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def counted(rows: DataFrame, folder: str = FOLDER) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether n is the highest of its A id) of all pairs of ``align``'s rows."""
    sums = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    # An A id has at most as many pairs as B has ids.
    top = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / len(sides(folder).b_bytes))))
    return sums.select("pair", "n", (F.col("n") == top).alias("best"))


def scored(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    own = ["_gs_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    rows = align(docs, folder).select("*", F.monotonically_increasing_id().alias("_gs_row"), digest.alias("groups_sha256"))
    rows = saved(rows.select(*own, "pairs", "times"), "zstd")
    counts = saved(counted(rows, folder))
    if counts.count() * COUNT_BYTES <= BROADCAST_BYTES:
        counts = F.broadcast(counts)
    links = rows.select(*own, F.explode_outer(F.arrays_zip("pairs", "times")).alias("link"))
    met = links.select(*own, F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")).join(counts, "pair", "left")
    sums = met.groupBy(*own).agg(
        F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).alias("n_best"),
        F.coalesce(F.sum(F.col("times") * F.col("n")), F.lit(0)).alias("count_sum"),
    )
    return sums.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
