"""Packing of tokenised documents into fixed-length sequences by best-fit decreasing.

Pieces of one length are interchangeable, so best-fit decreasing needs only how many pieces there are of each length. `plan` goes through the
lengths from the longest, keeps the open bins of each remaining capacity as ranges of bin numbers, and finds the tightest capacity
that still has an open bin with a segment tree over capacities; it places as many equal pieces there as there are such bins in one step. Every
piece gets the bin that best-fit decreasing of all pieces one by one would give it, over the whole corpus, and the work on the driver is bounded by
the square of the sequence length, whatever the input.

The pieces themselves stay in Spark: each gets its rank among the pieces of its length (a rank in its bucket of documents plus the
counts of the buckets before), and looks its bin up in the plan, which is a table of rank ranges.

Tokens: the vocabulary file is a parameter. Encoding uses the compiled encoder for the rank file of the same vocabulary, four times as fast as the
general one, which takes over for texts that hold a special token's string or that the compiled encoder refuses; tests compare both.

Defined cases: null texts are empty; an empty text has only the end token; a document longer than a sequence is cut so that its first piece is the
remainder and all others are full; rows with one id are packed each on its own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored
from .text_arrays import slices

LENGTH, END = 1024, 2
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
BUCKET_ROWS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Capacities:
    """A segment tree over remaining capacities: the number of open bins under each node."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` with an open bin."""
        i = least + self.size
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:  # a left child: its sibling holds the next larger capacities
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(piece length, first rank, first bin, offset): ranks from there on go to consecutive bins, at that offset."""
    tree, bins = Capacities(length), {c: [] for c in range(length + 1)}
    out, made = [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            capacity = tree.tightest(size)
            if capacity is None:
                capacity, n = length, -(-left // (length // size))
                bins[length].append((made, n))
                tree.add(length, n)
                made += n
            first, n = bins[capacity].pop()
            # best fit goes on with the bin it has begun, as that is the tightest now: bins take as many pieces as they can
            each = capacity // size
            used = min(n, left // each)
            if not used:
                used, each = 1, left
            if n > used:
                bins[capacity].append((first + used, n - used))
            for k in range(each):
                out.append((size, rank + k * used, first, length - capacity + k * size))
            rest = capacity - each * size
            bins[rest].append((first, used))
            tree.add(capacity, -used)
            tree.add(rest, used)
            rank, left = rank + each * used, left - each * used
    return out


class Encoder:
    def __init__(self, tokenizer: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.general = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.special = [t.content for t in self.general.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as error:  # the compiled encoder ends with a panic on texts that its pattern can't match
                if "Panic" not in type(error).__name__ and not isinstance(error, ValueError):
                    raise
        return self.general.encode(text, add_special_tokens=False).ids


def pieces_of(docs: DataFrame, id_col: str, text_col: str, length: int, end: int, tokenizer: str, ranks: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, ranks)
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encoder.ids(text or ""), end], "<u4")
                cuts = [0, *range(len(ids) - (len(ids) - 1) // length * length, len(ids) + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(out, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


PLACED = PIECES + ", sequence_id long, offset long"


def placed(steps: list[tuple[int, int, int, int]]):
    by_length: dict[int, tuple[list, list, list]] = {}
    for size, rank, first, offset in steps:
        for column, value in zip(by_length.setdefault(size, ([], [], [])), (rank, first, offset), strict=True):
            column.append(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for size, rank in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True):
                ranks, firsts, offsets = by_length[size]
                k = bisect_right(ranks, rank) - 1
                sequence.append(firsts[k] + rank - ranks[k])
                offset.append(offsets[k])
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [x.split()[0] for x in PLACED.split(", ")])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece."""
    pieces = stored(pieces_of(docs, id_col, text_col, length, end, tokenizer, ranks))
    n = pieces.count()
    # ranks among pieces of a length: within a bucket of documents, then the counts of the buckets before
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(-(-n // BUCKET_ROWS) or 1)))
    inside = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    counts = stored(bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("l"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = bucketed.withColumn("local", F.row_number().over(inside) - 1).join(base, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b")))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for each length at most
    columns = [x.split()[0] for x in PIECES.split(", ")]
    return ranked.select(*columns, (F.col("local") + F.col("base")).alias("rank")).mapInArrow(placed(plan(totals, length)), PLACED)
