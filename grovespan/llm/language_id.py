"""Language identification by compression with per-language zstandard dictionaries.

For each language a raw-content dictionary is made of slices of its training
texts. A text is compressed with each dictionary, in pieces of ``PIECE``
characters so that the dictionary and not the text's own beginning stays the
main reference, and the language of the smallest total wins. Words are lowered
and all that is not a letter becomes one space first, so that digits and marks
of any language cost nothing.

Only texts with a known language in the training folds (crc32 of the id as text,
modulo 5, is not 0) are learned from. The sample is bounded: about ``SLICES``
slices of ``SLICE`` characters a language, taken by hash of the id, each from the
middle of its text. Dictionaries are sent in blocks of ``BLOCK_LANGUAGES``, each a
pass that hands on the texts with their best size so far, so any number of
languages fits in a worker. Predictions compress the whole text.

The margin is the second smallest size over the smallest, less one. ``score`` is
the winner's share of 2 to the power of minus the size differences in bits,
damped by ``DAMPING``. Predictions of a margin under ``NARROW`` are marked
``rejected``; they still name the smallest. Ties go to the language with more
training rows, then to the lower name.

Null text, or text without a letter, is ``und`` with score 0, and rejected. With
no training row every text is ``und``. A null id counts as empty text, whose crc32
is 0, so its row is held out.
Repeated rows are predicted alike. Only doc_id, text and lang are read, so extra
columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .tables import saved

HELD_OUT, FOLDS = 0, 5
SLICES = 300
SLICE = 400
BLOCK_LANGUAGES = 100
LEVEL = 3
PIECE = 1_500
NARROW = 0.01
DAMPING = 0.15

_NOT_LETTERS = regex.compile(r"\P{L}+")


def fold(name: str):
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % FOLDS


def plain(text: str) -> str:
    return _NOT_LETTERS.sub(" ", text).lower()


def dictionaries(docs: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """Language and dictionary, most training rows first, in blocks."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id") != HELD_OUT))
    known = [(r["lang"], r["count"]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").toLocalIterator()]
    for a in range(0, len(known), BLOCK_LANGUAGES):
        block = known[a : a + BLOCK_LANGUAGES]
        # Three times the rows wanted at most, by hash; then the first of them.
        share = F.create_map(*[x for lang, n in block for x in (F.lit(lang), F.lit(min(2**63 - 1, int(2**64 * min(1.0, 3 * SLICES / n)) - 2**63)))])
        draw = F.xxhash64("doc_id", F.lit(5))
        middle = F.greatest(F.lit(1), F.floor((F.length("text") - SLICE) / 2)).cast("int")
        some = rows.where(F.col("lang").isin([lang for lang, _ in block]) & (draw <= share[F.col("lang")])).select("lang", draw.alias("draw"), F.col("text").substr(middle, F.lit(SLICE)).alias("slice"))
        first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "slice"))
        slices: dict[str, list[str]] = {}
        for r in some.withColumn("k", first).where(F.col("k") <= SLICES).orderBy("lang", "k").collect():
            slices.setdefault(r["lang"], []).append(plain(r["slice"]))
        # The end of a dictionary is the nearest to the text.
        yield [(lang, " ".join(reversed(slices[lang])).encode()) for lang, _ in block if lang in slices]


class Compressors:
    def __init__(self, known: list[tuple[str, bytes]]):
        self.names = [n for n, _ in known]
        self.compress = []
        for _, content in known:
            d = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=4 * PIECE, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=params)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        """Bytes of the whole ``plain`` text with each dictionary."""
        out = [0] * len(self.names)
        for a in range(0, len(text), PIECE):
            piece = text[a : a + PIECE].encode()
            for k, c in enumerate(self.compress):
                out[k] += len(c.compress(piece))
        return out


#: The smallest size so far and its language, the second smallest, and the sum of 2 to the power of minus the damped differences to the smallest.
State = tuple[str, int, int, float]
NONE: State = ("und", -1, -1, 0.0)


def _weight(bytes_more: int) -> float:
    return math.exp2(-min(1000.0, 8 * DAMPING * bytes_more))


def further(state: State, names: list[str], sizes: list[int]) -> State:
    """``state`` after more languages; of equal sizes the earlier one stays."""
    lang, least, second, total = state
    for name, size in zip(names, sizes):
        if least < 0:
            lang, least, total = name, size, 1.0
        elif size < least:
            lang, least, second, total = name, size, least, total * _weight(least - size) + 1.0
        else:
            second, total = size if second < 0 else min(second, size), total + _weight(size - least)
    return lang, least, second, total


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected of every row."""
    spark = docs.sparkSession
    kernel.bounded_batches(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    state = [F.lit(x).cast(t).alias(c) for c, t, x in zip(_STATE, _TYPES, NONE)]
    rows = docs.select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "text", *state)
    blocks = dictionaries(docs)
    block, first = next(blocks, None), True
    while block is not None:
        sent, block = spark.sparkContext.broadcast(block), next(blocks, None)

        def run(batches, sent=sent, last=block is None):
            own = Compressors(sent.value)
            for batch in batches:
                texts = (plain(t) if t else "" for t in batch.column(2).to_pylist())
                states = zip(*(batch.column(3 + c).to_pylist() for c in range(len(_STATE))))
                new = [further(s, own.names, own.sizes(t)) if t.strip() else s for t, s in zip(texts, states)]
                cols = [pa.array(x, t) for x, t in zip(zip(*new), (pa.string(), pa.int64(), pa.int64(), pa.float64()))] if new else batch.columns[3:]
                text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column(2)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], text, *cols], ["doc_id", "held_out", "text", *_STATE])

        # A pass over a further block reads the written one before it.
        rows, first = (rows if first else saved(rows)).mapInArrow(run, f"doc_id {id_type}, held_out boolean, text string, " + ", ".join(f"{c} {t}" for c, t in zip(_STATE, _TYPES))), False
    known = F.col("least") >= 0
    margin = F.when(~known, 0.0).when(F.col("second") < 0, 1.0).otherwise(F.col("second") / F.col("least") - 1)
    out = rows.select("doc_id", "held_out", F.col("lang").alias("lang_pred"), F.when(known, 1 / F.col("total")).otherwise(0.0).alias("score"), margin.alias("margin"))
    return out.withColumn("rejected", F.col("margin") < NARROW)


_STATE, _TYPES = ("lang", "least", "second", "total"), ("string", "bigint", "bigint", "double")
