"""Packing by power-of-two decomposition: no sequence crosses documents, and almost nothing is padded.

A document's tokens are cut into pieces whose lengths are the binary digits of its token count: as many pieces of the longest length as fit, then one
for each set bit of the rest, longest first. Each piece is a sequence of its own, and a sequence whose length is a power of two needs no padding. Pieces of
one length form a bucket; a batch takes sequences of one bucket alone, so that it is a full rectangle of about `batch_tokens` tokens.

1. `pieces` encodes each text once and gives (doc_id, start, length, doc_tokens, ids), where `ids` holds little-endian unsigned 32-bit numbers.
2. `bucketed` numbers the pieces inside their bucket, over the whole corpus: rank in a slice of the bucket, plus the counts of the slices before.
   Slices hold some 50,000 pieces, so no task holds a bucket, and the shuffle carries only the columns that the caller passes on.

The longest length must be a power of two. At most `log2(length)` pieces of a document are shorter than that.

Defined cases: null texts are empty; an empty text has only the end token, one piece of length 1; rows with one id, or with a null id, are documents of their
own; equal rows get different sequences; an empty table gives no rows; other columns of `docs` are not looked at, whatever their names. An id that is taken for
a word of the tokenizer's special list in a text is encoded as the general tokenizer does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored
from .packing import RANKS, TOKENIZER, Encoder
from .text_arrays import slices

LENGTH, END = 2048, 1
BATCH_TOKENS = 1 << 16
SLICE_ROWS = 50_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
NAMES = [x.split()[0] for x in PIECES.split(", ")]


def lengths(tokens: int, longest: int = LENGTH) -> list[int]:
    """The piece lengths of a document, in order: they add up to its token count."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << k for k in reversed(range(longest.bit_length())) if rest >> k & 1]


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, tokenizer: str = TOKENIZER, ranks: str = RANKS
) -> DataFrame:
    """One row for each piece of each document, with its token ids."""
    if length < 1 or length & (length - 1):
        raise ValueError("the longest length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, ranks)
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in NAMES]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encoder.ids(text or ""), end], "<u4")
                start = 0
                for size in lengths(len(ids), length):
                    for column, value in zip(out, (doc, start, size, len(ids), ids[start : start + size].tobytes()), strict=True):
                        column.append(value)
                    start += size
            yield pa.record_batch([pa.array(c, pa.binary() if name == "ids" else pa.int64()) for name, c in zip(NAMES, out, strict=True)], NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def bucketed(found: DataFrame, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """The columns of `found` (`length` among them), and sequence_id, offset, bucket, batch.

    sequence_id counts all pieces of the corpus, bucket by bucket from the shortest, without gaps. `bucket` is the binary logarithm of the length, `batch` the
    number of a batch of at most `batch_tokens` tokens within the bucket: sequences of one length, all batches but a bucket's last one full.
    """
    rows = stored(found)  # what is numbered must not change between counting and numbering
    names = rows.columns
    n_slices = -(-rows.count() // SLICE_ROWS) or 1
    # by place and not by content: equal rows, and those of one id, spread like all others
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_slices)))
    sliced = stored(sliced)
    counts = stored(sliced.groupBy("length", "_slice").agg(F.count("*").alias("n")))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length: 12 of them
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_slice").orderBy(*(c for c in names if c != "length"))
    ranked = sliced.withColumn("_rank", F.row_number().over(inside) - 1).join(base, ["length", "_slice"])
    first, starts = 0, []
    for size in sorted(totals):
        starts += [F.lit(size), F.lit(first)]
        first += totals[size]
    rank = F.col("_before") + F.col("_rank")
    shown = [
        (rank + (F.create_map(*starts)[F.col("length")] if starts else F.lit(0))).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"),
        F.floor(rank / F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length")))).cast("long").alias("batch"),
    ]
    return ranked.select(*(F.col(f"`{c}`") for c in names), *shown)
