"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over lowered words and their first 4, 5 and 6 bytes, each
by how often the text has it: at least once, twice, three times, and (twice or
more) once in 400 and once in 150 words. It is trained in numpy from confirmed toxic examples and
unlabelled text by the class-prior-corrected risk estimator

    R = prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

with the logistic loss; where the bracket is negative its gradient is reversed,
as the non-negative estimator asks. Weights carry an L2 penalty.

Labels are read only from the training folds (crc32 of the id as text, modulo 4,
is not 2), and only toxic = 1 rows act as labels of texts; the prior is the share
of toxic rows among the training folds' labelled rows. The training sample is
bounded: at most ``POSITIVES`` toxic texts, copies once, by hash, and about ``UNLABELLED``
texts, those whose 64-bit hash of id and text is under a threshold, repeated rows
once; one task trains on it, not the driver. A sample without a text, where there
are texts, is an error. Everything else, the scores
included, covers all rows. The model
is ``FEATURES`` hashes and weights, a fixed bound, and is broadcast.

A feature must be in ``LEAST_DOCS`` toxic texts, or in all where there are fewer, and its
z score must reach ``LEAST_Z``, or half of the highest that a sample can have where that
is less. Where no feature does, all scores are the prior, but under the threshold.

Null and empty texts score like a text without any known word. Without a toxic
training row every score is 0. A label that repeats with different values counts
as toxic; null labels and null ids do not count. Repeated rows score alike. Only
doc_id and text (labels: doc_id and toxic) are read, so extra columns may have
any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .tables import dropped, saved

POSITIVES = 2_000
UNLABELLED = 6_000
FEATURES = 4_096
LEAST_DOCS = 5
#: A feature must be this many times as common in toxic rows as in unlabelled texts (where a share of ``prior`` is toxic, so 1 / prior is the most).
LEAST_LIFT = 3.0
#: Two-proportion z score below which a feature tells nothing.
LEAST_Z = 4.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
STEPS, RATE, DECAY = 400, 0.05, 1e-4
HELD_OUT, FOLDS = 2, 4
#: Levels of a feature: least count, and one in at most so many words.
LEVELS = ((1, None), (2, None), (3, None), (2, 400), (2, 150))


def fold(name: str):
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % FOLDS


def levels(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which levels each count reaches in a text of so many words (counts x levels)."""
    return np.stack([(count >= c) & (True if r is None else count * r >= words) for c, r in LEVELS], 1)


class Model:
    """Hashes (sorted), their weights by level, and the bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, known: bool = True):
        self.keys, self.weights, self.bias, self.known = keys, weights, bias, known
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not self.known:
            return np.zeros(n)
        margin = np.full(n, self.bias)
        for i, j in kernel.steps(offsets):
            hashes, docs, words = kernel.word_prefixes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], PREFIXES)
            maybe = np.flatnonzero(self.hint[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            hashes, docs = hashes[maybe], docs[maybe]
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            pair, count = np.unique(docs[hit] * np.int64(len(self.keys)) + at[hit], return_counts=True)
            doc, key = pair // len(self.keys), pair % len(self.keys)
            margin[i:j] += np.bincount(doc, (levels(count, words[doc]) * self.weights[key]).sum(1), minlength=j - i)
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def none() -> Model:
    return Model(np.zeros(1, np.uint64), np.zeros((1, len(LEVELS))), 0.0, known=False)


def flat_model(prior: float) -> Model:
    """No feature tells: the prior, but no text is rejected."""
    p = min(prior, 0.99 * THRESHOLD)
    return Model(np.zeros(1, np.uint64), np.zeros((1, len(LEVELS))), float(np.log(p / (1 - p))))


def _features(docs: DataFrame) -> DataFrame:
    """_gs_pos, and of each text the distinct feature hashes, as bytes, their levels, as bits, and a hash of both."""
    kernel.bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            buf, offsets = kernel.string_buffers(batch.column(1))
            keys, bits = [], []
            for k in range(batch.num_rows):
                hashes, _, words = kernel.word_prefixes(buf[offsets[k] : offsets[k + 1]], offsets[k : k + 2] - offsets[k], PREFIXES)
                own, count = np.unique(hashes, return_counts=True)
                keys.append(own.tobytes())
                bits.append((levels(count, words[:1]) << np.arange(len(LEVELS))).sum(1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(bits, pa.binary())], ["_gs_pos", "f", "b"])

    return docs.select("_gs_pos", "text").mapInArrow(run, "_gs_pos boolean, f binary, b binary")


def risk_gradient(g: np.ndarray, n_p: int, prior: float) -> np.ndarray:
    """The direction by margin ``g`` (positives first): that of the risk, or against the bracket's where it is negative."""
    n_u = len(g) - n_p
    p = 1 / (1 + np.exp(-np.clip(g, -60, 60)))
    d = np.empty(len(g))
    # Gradients of l(g) = log(1 + e^-g): -(1 - p); of l(-g): p. Both positive terms together are linear.
    if np.logaddexp(0, g[n_p:]).mean() - prior * np.logaddexp(0, g[:n_p]).mean() < 0:
        d[:n_p], d[n_p:] = prior * p[:n_p] / n_p, -p[n_p:] / n_u
    else:
        d[:n_p], d[n_p:] = -prior / n_p, p[n_p:] / n_u
    return d


def fit(positive: list[tuple[np.ndarray, np.ndarray]], unlabelled: list[tuple[np.ndarray, np.ndarray]], prior: float) -> Model:
    """Train from each text's distinct feature hashes and their levels as bits."""
    if not positive or not unlabelled:
        return none()
    n_p, n_u = len(positive), len(unlabelled)
    texts = [*positive, *unlabelled]
    # Hashes that too few toxic texts have are dropped by a table of counts (which may keep some), before any is sorted.
    few = np.zeros(1 << 22, np.int32)
    slot = lambda x: (x >> np.uint64(42)).astype(np.int64)
    for x, _ in positive:
        np.add.at(few, slot(x), 1)
    least = min(LEAST_DOCS, n_p)
    chosen = [few[slot(x)] >= least for x, _ in texts]
    flat = np.concatenate([x[c] for (x, _), c in zip(texts, chosen)])
    if not len(flat):
        return flat_model(prior)
    bits = np.concatenate([b[c] for (_, b), c in zip(texts, chosen)])
    row = np.repeat(np.arange(n_p + n_u, dtype=np.int32), [int(c.sum()) for c in chosen])
    keys, code = np.unique(flat, return_inverse=True)
    # A column for each hash and level.
    cells = [np.flatnonzero(bits >> k & 1) for k in range(len(LEVELS))]
    row = np.concatenate([row[c] for c in cells])
    code = np.concatenate([code[c] * len(LEVELS) + k for k, c in enumerate(cells)])
    width = len(keys) * len(LEVELS)
    in_p = np.bincount(code[row < n_p], minlength=width)
    in_u = np.bincount(code[row >= n_p], minlength=width)
    both = (in_p + in_u) / (n_p + n_u)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n_p + 1 / n_u))
    z[(in_p < least) | (in_p / n_p < min(LEAST_LIFT, 0.5 + 0.5 / prior) * in_u / n_u)] = -1
    # What all toxic texts have and no other has reaches the root of their number.
    enough = min(LEAST_Z, 0.5 * np.sqrt(n_p + n_u))
    best = np.sort(np.lexsort((np.arange(width), -z))[: min(FEATURES, int((z >= enough).sum()))])
    if not len(best):
        return flat_model(prior)
    number = np.full(width, -1)
    number[best] = np.arange(len(best))
    keep = number[code] >= 0
    row, col = row[keep], number[code][keep]
    w, bias = np.zeros(len(best)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        d = risk_gradient(bias + np.bincount(row, w[col], minlength=n_p + n_u), n_p, prior)
        gw, gb = np.bincount(col, d[row], minlength=len(w)) + DECAY * w, d.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= RATE * fix * m / (np.sqrt(v) + 1e-8)
        bias -= RATE * fix * mb / (np.sqrt(vb) + 1e-8)
    used = np.unique(best // len(LEVELS))
    weights = np.zeros((len(used), len(LEVELS)))
    weights[np.searchsorted(used, best // len(LEVELS)), best % len(LEVELS)] = w
    return Model(keys[used], weights, float(bias))


def drawn(total: int):
    """Which of ``total`` rows are in the unlabelled sample: ``UNLABELLED`` of them are expected, however many there are."""
    top = 2**64 * min(1.0, UNLABELLED / max(1, total))
    return F.xxhash64("doc_id", "text", F.lit(13)) <= F.lit(min(2**63 - 1, int(top) - 2**63))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id") != HELD_OUT))
    own = own.groupBy(F.col("doc_id").alias("_gs_id")).agg(F.max(F.col("toxic").cast("int")).alias("_gs_toxic"))
    count = own.agg(F.count("*").alias("n"), F.sum("_gs_toxic").alias("p")).first()
    if not count["n"] or not count["p"]:
        return none()
    prior = min(max(count["p"] / count["n"], 0.01), 0.9)
    chosen = own.where("_gs_toxic = 1").orderBy(F.xxhash64("_gs_id", F.lit(11)), "_gs_id").limit(POSITIVES).select("_gs_id", F.lit(True).alias("_gs_pos"))
    rows = docs.select("doc_id", "text").where(F.coalesce(fold("doc_id") != HELD_OUT, F.lit(True)))
    total = rows.count()
    positive = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_gs_id")).select("_gs_pos", "text").dropDuplicates(["text"])
    positive = positive.orderBy(F.xxhash64("text", F.lit(11)), "text").limit(POSITIVES)
    some = rows.where(drawn(total)).dropDuplicates(["doc_id", "text"]).select(F.lit(False).alias("_gs_pos"), "text")
    found = saved(_features(positive.unionByName(some)))
    if total and found.where("not _gs_pos").isEmpty():
        raise RuntimeError(f"no unlabelled text was drawn from {total} rows")

    def learn(batches):
        """One task holds the bounded sample, in an order of its own, and returns the model."""
        rows: list[tuple[bool, bytes, bytes]] = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns))
        # Copies of a toxic text are one example, so that their words do not pass for what toxic texts share.
        rows = sorted({r for r in rows if r[0]}) + sorted(r for r in rows if not r[0])
        sides: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}
        for pos, f, b in rows:
            sides[pos].append((np.frombuffer(f, np.uint64), np.frombuffer(b, np.uint8)))
        model = fit(sides[True], sides[False], prior)
        yield pa.RecordBatch.from_arrays([pa.array([model.keys.tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.bias]), pa.array([model.known])], ["keys", "weights", "bias", "known"])

    got = found.coalesce(1).mapInArrow(learn, "keys binary, weights binary, bias double, known boolean").collect()
    dropped(found)
    if not got:
        return none()
    keys = np.frombuffer(got[0]["keys"], np.uint64)
    return Model(keys, np.frombuffer(got[0]["weights"]).reshape(len(keys), -1), got[0]["bias"], got[0]["known"])


def score(docs: DataFrame, model: Model, held_out: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    kernel.bounded_batches(spark)
    sent = spark.sparkContext.broadcast((model.keys, model.weights, model.bias, model.known))

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            buf, offsets = kernel.string_buffers(batch.column(2))
            s = own.scores(buf, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, in one pass and with all their columns."""
    spark = docs.sparkSession
    kernel.bounded_batches(spark)
    sent = spark.sparkContext.broadcast((model.keys, model.weights, model.bias, model.known))

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            buf, offsets = kernel.string_buffers(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(own.scores(buf, offsets) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
