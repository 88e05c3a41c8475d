"""Ranked lexical search the other way round: the items' inverted index is broadcast, and the documents stream through it.

The items (queries) are few and the documents many, so no index of the corpus is built and no posting is shuffled.

1. The items' terms form an inverted index: for each distinct term the items that hold it and how often. Items are taken in blocks of about `block_bytes` of
   item text, so what is broadcast has a bound whatever the number of items; each block is one turn of steps 2 and 3.
2. One pass over all documents counts N, L and, for the index's terms, the documents that hold them. Each task sums up for itself and hands on one row a term.
3. A second pass scores: each document's counts of index terms go through the postings, and every item has a bounded heap of its `k` best documents in
   each task. A task hands on its heaps; they are merged in two steps, first in slices of tasks, so no task sees more than some `k` times the square root
   of the number of tasks for an item.

A term is a maximal run of letters and digits of ASCII and of all other code points; A-Z count as a-z. With n terms in a document, N documents that have
terms, L terms in all of them, df documents that hold a term and tf places of it in the document:
w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 75 + 25 n N div L, score = sum over the item's terms, repeats included, of w (10**9 tf div (1000 tf + 12 m)).
Scores are 64-bit integers, so order and partitioning of the sums don't matter.

Terms are compared by 64-bit hashes of their bytes, which hold the length.

Defined cases: null texts have no terms; a document without terms scores for nothing and is not counted in N; items without terms have no rows; rows of
one item id are one item whose terms add up, and so are those of the null id; documents of equal score come by id, null ids last; rows with one document id are
documents of their own; without documents or items there are no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .text_arrays import Texts, Words, slices, texts_of, words_of

TOP = 20
BLOCK_BYTES = 8 << 20
CELLS = 1 << 22  # scores held at once: documents times items
NO_TERM = np.zeros(256, bool)
NO_TERM[[b for b in range(128) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
N_ROW, L_ROW = -1, -2
HEAPS = "item_id long, doc_id long, score long, task long"
HEAP_NAMES = [x.split()[0] for x in HEAPS.split(", ")]
RESULT = "item_id long, rank int, doc_id long, score long"


def terms_of(texts: Texts) -> Words:
    return words_of(Texts(LOWER[texts.data], texts.offsets), gap=NO_TERM)


@dataclass
class Index:
    """Postings by term: items start[t] to start[t + 1] of `item` hold term t, `times` each."""

    items: list[int | None]
    hashes: np.ndarray  # of the terms, ascending
    start: np.ndarray
    item: np.ndarray
    times: np.ndarray

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of the index's terms in some texts."""
        if not len(self.hashes) or not len(words.hashes):
            return (np.empty(0, np.int64),) * 3
        place = np.searchsorted(self.hashes, words.hashes)
        place[place == len(self.hashes)] = 0
        known = self.hashes[place] == words.hashes
        key, count = np.unique(words.text[known] * len(self.hashes) + place[known], return_counts=True)
        return key // len(self.hashes), key % len(self.hashes), count


def index_of(rows: list[Row]) -> Index:
    """Of rows (item_id, text)."""
    items = sorted({r.item_id for r in rows}, key=lambda i: (i is None, i or 0))
    number = {i: k for k, i in enumerate(items)}
    words = terms_of(texts_of(pa.array([r.text for r in rows], pa.string())))
    owner = np.array([number[r.item_id] for r in rows], np.int64)[words.text]
    hashes, term = np.unique(words.hashes, return_inverse=True)
    key, times = np.unique(term * max(1, len(items)) + owner, return_counts=True)
    start = np.searchsorted(key, np.arange(len(hashes) + 1) * max(1, len(items)))
    return Index(items, hashes, start, key % max(1, len(items)), times)


def term_counts(docs: DataFrame, index) -> dict[int, int]:
    """Documents that hold each term of a broadcast index, and N and L under their own numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Index = index.value
        df, n, total = np.zeros(len(found.hashes), np.int64), 0, 0
        for batch in slices(batches, "text"):
            words = terms_of(texts_of(batch.column(1)))
            df += np.bincount(found.matches(words)[1], minlength=len(df))
            sizes = np.diff(words.first)
            n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array([N_ROW, L_ROW, *held.tolist()], pa.int64()), pa.array([n, total, *df[held].tolist()], pa.int64())], ["term", "n"])

    return {r.term: r.n for r in docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def weights(index: Index, counts: dict[int, int]) -> np.ndarray:
    n = counts.get(N_ROW, 0)
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(index.hashes))], np.int64)


class Heaps:
    """The best documents of each item so far, as rows sorted by item, then best first."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.item, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.null = np.empty(0, bool)
        self.least = np.ones(n_items, np.int64)  # a lower score can't enter

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """`scores`: documents by items."""
        doc, item = np.nonzero(scores >= self.least)
        if not len(doc):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[doc, item]])
        id_, no_id = np.concatenate([self.id, ids[doc]]), np.concatenate([self.null, null[doc]])
        order = np.lexsort((id_, no_id, -score, item))
        first = np.searchsorted(item[order], item[order])
        place = np.arange(len(order)) - first
        kept = order[place < self.k]
        self.item, self.score, self.id, self.null = item[kept], score[kept], id_[kept], no_id[kept]
        full = order[place == self.k - 1]
        self.least[item[full]] = score[full]


def scored(index, weight, n_docs: int, n_terms: int, k: int):
    """Of batches (doc_id, text): (item_id, doc_id, score, task) of each task's heaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Index = index.value
        w: np.ndarray = weight.value
        n_items = len(found.items)
        heaps, sizes = Heaps(n_items, k), np.diff(found.start)
        step = max(1, CELLS // max(1, n_items))
        for batch in slices(batches, "text"):
            words = terms_of(texts_of(batch.column(1)))
            doc, term, tf = found.matches(words)
            n = np.diff(words.first).astype(np.int64)
            m = 75 + 25 * n * n_docs // n_terms if n_terms else n
            part = w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for a in range(0, batch.num_rows, step):
                b = min(batch.num_rows, a + step)
                lo, hi = np.searchsorted(doc, (a, b))
                while lo < hi:  # whole documents, as many as a bounded number of postings allows
                    ends = np.cumsum(sizes[term[lo:hi]])
                    until = lo + int(np.searchsorted(ends, CELLS, "right"))
                    until = hi if until >= hi else max(int(np.searchsorted(doc, doc[min(until, hi - 1)])), int(np.searchsorted(doc, doc[lo], "right")))
                    stop = b if until == hi else int(doc[until])
                    each = sizes[term[lo:until]]
                    entry = np.repeat(np.arange(lo, until), each)
                    posting = np.arange(len(entry)) - np.repeat(np.cumsum(each) - each, each) + found.start[term[entry]]
                    score = np.zeros((stop - a) * n_items, np.int64)
                    np.add.at(score, (doc[entry] - a) * n_items + found.item[posting], part[entry] * found.times[posting])
                    heaps.offer(score.reshape(stop - a, n_items), ids[a:stop], null[a:stop])
                    a, lo = stop, until
        task = TaskContext.get().partitionId()
        names = pa.array([found.items[i] for i in heaps.item.tolist()], pa.int64())
        ids = pa.array(heaps.id, pa.int64(), mask=heaps.null)
        yield pa.record_batch([names, ids, pa.array(heaps.score, pa.int64()), pa.array(np.full(len(names), task, np.int64))], HEAP_NAMES)

    return run


def best(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best rows of each group, `rank` from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)




def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    blocks = -(-(asked.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) // block_bytes)
    out = spark.createDataFrame([], RESULT)
    for block in range(blocks):
        index = index_of(asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect())
        if not len(index.hashes):
            continue
        shared = spark.sparkContext.broadcast(index)
        counts = term_counts(rows, shared)
        weight = spark.sparkContext.broadcast(weights(index, counts))
        heaps = rows.mapInArrow(scored(shared, weight, counts.get(N_ROW, 0), counts.get(L_ROW, 0), k), HEAPS)
        n_slices = max(1, math.isqrt(rows.rdd.getNumPartitions()))
        some = best(heaps.withColumn("slice", F.col("task") % n_slices), k, "item_id", "slice").drop("rank")
        out = out.unionByName(best(some, k, "item_id").select("item_id", "rank", "doc_id", "score"))
    return out
