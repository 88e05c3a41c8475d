"""Removal of repeated passages: a count-min prefilter, then exact grouping of the windows it could not rule out.

A window is `window` consecutive words of one document. Every word is removed that lies in a window whose word sequence also
starts earlier: in a document with a smaller id, or earlier in the same document. Windows are judged on the input.

1. *Sketch.* Each task counts, in `ROWS` rows of `2**CELL_BITS` cells, the anchors of its windows: the position of the smallest hash among the
   n-grams of `ANCHOR` words in the window. Equal windows have equal anchors and different windows starts have different anchor
   positions, so an anchor's count is never below that of any of its windows, and there are some seven times fewer anchors than
   windows. Partition sketches are sparse and are merged in two levels by ranges of cells. The merged sketch, one bit for each cell
   ("two or more"), is the only thing that is broadcast: 32 MB, whatever the input. On larger inputs it rules out less, and loses nothing.
2. *Exact pass.* Windows whose anchor is estimated repeated are sorted within the task by a 96-bit hash. Only the first of each in the
   task is shuffled, so a passage in a third of all documents costs one row per task. In each hash partition rows are sorted and streamed, and all
   but the first start are removals.

Defined cases: a null text has no words; rows with one id count as one document, so the same start in both is not an earlier one; null
ids come last; shorter documents than a window keep all words; empty tables give empty tables. Repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .text_arrays import U64, ints, mix, rolling, slices, texts_of, windows_inside, words_of

WINDOW, ANCHOR = 20, 8
ROWS, CELL_BITS, CHUNK_BITS = 2, 27, 20
FAN = 16
SEEDS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
NULL_ID = (1 << 63) - 1
FLUSH_ANCHORS, FLUSH_WINDOWS = 2_000_000, 500_000


def anchors(words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, position, key): the windows inside one text, and of each the leftmost n-gram of smallest hash."""
    starts = np.flatnonzero(windows_inside(words, window))
    if not len(starts):
        return starts, starts, np.empty(0, U64)
    grams = rolling(words.hashes, anchor, lane=0)
    best, span, want = np.arange(len(grams)), 1, window - anchor + 1
    while 2 * span <= want:
        a, b = best[:-span], best[span:]
        best, span = np.where(grams[a] <= grams[b], a, b), 2 * span
    if want > span:
        a, b = best[: len(best) - (want - span)], best[want - span :]
        best = np.where(grams[a] <= grams[b], a, b)
    at = best[starts]
    return starts, at, grams[at]


def cells_of(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys ^ U64(SEEDS[row])) >> U64(64 - bits)).astype(np.uint32)


def packed(cells: np.ndarray) -> bytes:
    """Sorted (cell, repeated) codes as differences of 16 or 32 bits."""
    steps = np.diff(cells, prepend=np.uint32(0))
    return b"s" + steps.astype("<u2").tobytes() if steps.max(initial=0) < 1 << 16 else b"l" + steps.astype("<u4").tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, "<u2" if blob[:1] == b"s" else "<u4", offset=1).astype(np.uint32), dtype=np.uint32)


SKETCH = "row int, chunk int, salt int, cells binary"


def sketch_parts(bits: int, chunk_bits: int, window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % FAN

        def flush(keys: list[np.ndarray]) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            every = np.concatenate(keys)
            for row in range(ROWS):
                cells, counts = np.unique(cells_of(every, row, bits), return_counts=True)
                codes = ((cells & np.uint32((1 << chunk_bits) - 1)) << np.uint32(1)) | (counts > 1)
                chunks = (cells >> np.uint32(chunk_bits)).astype(np.int32)
                cuts = np.flatnonzero(np.diff(chunks, prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(codes)], strict=True):
                    for column, value in zip(out, (row, int(chunks[a]), salt, packed(codes[a:b].astype(np.uint32))), strict=True):
                        column.append(value)
            return pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["row", "chunk", "salt", "cells"])

        keys, held = [], 0
        for batch in slices(batches, "text"):
            _, at, key = anchors(words_of(texts_of(batch.column(0))), window, anchor)
            if len(at):
                new = key[np.flatnonzero(np.diff(at, prepend=-1))]
                keys.append(new)
                held += len(new)
            if held >= FLUSH_ANCHORS:
                yield flush(keys)
                keys, held = [], 0
        if held:
            yield flush(keys)

    return run


def merged_parts(chunk_bits: int, last: bool):
    """Adds sketches of the same chunk, up to two; `last` gives one bit for each cell, others give sketches again.

    Rows come sorted by their chunk, so one chunk's counts are held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(row: int, chunk: int, salt: int) -> pa.RecordBatch:
            cells = np.flatnonzero(have).astype(np.uint32)
            blob = np.packbits(have > 1).tobytes() if last else packed((cells << np.uint32(1)) | (have[cells] > 1))
            return pa.record_batch([pa.array([row], pa.int32()), pa.array([chunk], pa.int32()), pa.array([salt], pa.int32()), pa.array([blob], pa.binary())], ["row", "chunk", "salt", "cells"])

        now, have = None, np.zeros(1 << chunk_bits, np.uint8)
        for batch in batches:
            for k in range(batch.num_rows):
                row, chunk, salt, blob = (batch.column(i)[k].as_py() for i in range(4))
                key = (row, chunk, 0 if last else salt)
                if key != now:
                    if now:
                        yield result(*now)
                    now = key
                    have[:] = 0
                codes = unpacked(blob)
                cells = codes >> np.uint32(1)
                have[cells] = np.minimum(have[cells] + 1 + (codes & np.uint32(1)).astype(np.uint8), 2)
        if now:
            yield result(*now)

    return run


def repeated_cells(texts: DataFrame, window: int, anchor: int, bits: int) -> list[np.ndarray]:
    """The merged sketch of all windows as ROWS bitmaps of 2**bits cells; its size doesn't depend on the input."""
    chunk_bits = min(CHUNK_BITS, bits)
    parts = texts.select("text").mapInArrow(sketch_parts(bits, chunk_bits, window, anchor), SKETCH)
    parts = parts.repartition("row", "chunk", "salt").sortWithinPartitions("row", "chunk", "salt").mapInArrow(merged_parts(chunk_bits, False), SKETCH)
    parts = parts.repartition("row", "chunk").sortWithinPartitions("row", "chunk").mapInArrow(merged_parts(chunk_bits, True), SKETCH)
    maps = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(ROWS)]
    size = (1 << chunk_bits) // 8
    for part in parts.select("row", "chunk", "cells").collect():  # as large as the bitmaps
        maps[part.row][part.chunk * size : (part.chunk + 1) * size] = np.frombuffer(bytes(part.cells), np.uint8)
    return maps


OPEN = "settled boolean, h1 long, h2 int, id long, text_key int, at int, until int"
TYPES = [pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
NAMES = [x.split()[0] for x in OPEN.split(", ")]


def batch_of(columns: list[np.ndarray], types=TYPES, names=NAMES) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def runs(ids: np.ndarray, keys: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows sorted by (id, key, at) as spans of words [from, until): touching windows become one."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (at[1:] > at[:-1] + window)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(ids)) - 1 if len(a) else a
    return ids[a], keys[a], at[a], at[z] + window


def candidate_windows(sketch, window: int, anchor: int, bits: int):
    """First occurrences within the task of windows that may be repeated; the others are settled as removals at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = sketch.value

        def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            h1, h2, ids, keys, at = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((at, ids, h2, h1))
            h1, h2, ids, keys, at = (x[order] for x in (h1, h2, ids, keys, at))
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            first = (ids == ids[lead]) & (at == at[lead])
            o = np.flatnonzero(first)
            o = o[np.lexsort((at[o], keys[o], ids[o]))]  # rows of one document together compress well
            yield batch_of([np.zeros(len(o), bool), h1[o].view(np.int64), h2[o], ids[o], keys[o], at[o], np.zeros(len(o), np.int32)])
            s = np.flatnonzero(~first)
            s = s[np.lexsort((at[s], keys[s], ids[s]))]
            i, k, a, z = runs(ids[s], keys[s], at[s], window)
            spread = mix(i.view(U64)).view(np.int64)  # settled spans only pass through, dealt by document
            yield batch_of([np.ones(len(i), bool), spread, np.zeros(len(i), np.int32), i, k, a.astype(np.int32), z.astype(np.int32)])

        held, n = [], 0
        for batch in slices(batches, "text"):
            words = words_of(texts_of(batch.column(2)))
            starts, at, key = anchors(words, window, anchor)
            if not len(starts):
                continue
            event = np.flatnonzero(np.diff(at, prepend=-1))
            maybe = np.ones(len(event), bool)
            for row in range(ROWS):
                cell = cells_of(key[event], row, bits)
                maybe &= (maps[row][cell >> np.uint32(3)] >> (7 - (cell & np.uint32(7))).astype(np.uint8) & 1).astype(bool)
            chosen = starts[np.repeat(maybe, np.diff(np.append(event, len(starts))))]
            if not len(chosen):
                continue
            doc = words.text[chosen]
            held.append((rolling(words.hashes, window, 1)[chosen], (rolling(words.hashes, window, 2)[chosen] >> U64(32)).astype(np.uint32).view(np.int32), ints(batch.column(0), NULL_ID)[doc], ints(batch.column(1), 0).astype(np.int32)[doc], (chosen - words.first[doc]).astype(np.int32)))
            n += len(chosen)
            if n >= FLUSH_WINDOWS:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return run


SPANS = "id long, text_key int, at int, until int"


def later_windows(window: int):
    """Of rows sorted by (h1, h2, id, at), all windows but the first start of each; settled spans pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            settled, h1, h2, ids, keys, at, until = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            n = len(h1)
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (settled[1:] != settled[:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            lead_id, lead_at = ids[lead], at[lead]
            if last is not None and not settled[0] and last[:2] == (h1[0], h2[0]):  # the group goes on from the batch before
                same = lead == 0
                lead_id[same], lead_at[same] = last[2], last[3]
            if not settled[-1]:
                last = (h1[-1], h2[-1], lead_id[-1], lead_at[-1])
            out = np.flatnonzero(settled | (ids != lead_id) | (at != lead_at))
            yield batch_of([ids[out], keys[out], at[out], np.where(settled[out], until[out], at[out] + window).astype(np.int32)], TYPES[3:], NAMES[3:])

    return run


RESULT = StructType().add("n_words", "long").add("n_removed", "long").add("kept", "string").add("kept_sha256", "string")


def kept_words(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = texts_of(batch.column(names.index("__text")))
            valid = batch.column(names.index("__text")).is_valid().to_pylist()
            found = batch.column(names.index("__spans"))
            n_words, n_removed, kept, shas = [], [], [], []
            for i in range(len(texts)):
                words = texts.text(i).split()
                n_words.append(len(words))
                spans = found[i].as_py()
                if spans:
                    delta = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        delta[s["at"]] += 1
                        delta[s["until"]] -= 1
                    words = [words[j] for j in np.flatnonzero(np.cumsum(delta[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(words))
                joined = b" ".join(words)
                if with_text:
                    kept.append(joined.decode() if n_removed[-1] else texts.text(i).decode() if valid[i] else None)
                else:
                    kept.append(None)
                shas.append(hashlib.sha256(joined).hexdigest())
            struct = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(shas, pa.string())], ["n_words", "n_removed", "kept", "kept_sha256"])
            keep = [i for i, name in enumerate(names) if name not in ("__text", "__spans")]
            yield pa.record_batch([*(batch.column(i) for i in keep), struct], [*(names[i] for i in keep), "__kept"])

    return run


def removed_spans(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = CELL_BITS) -> DataFrame:
    """Spans of words to remove, as (id, text_key, at, until), of rows (id, text_key, text)."""
    sketch = rows.sparkSession.sparkContext.broadcast(repeated_cells(rows, window, anchor, bits))
    found = rows.select("id", "text_key", "text").mapInArrow(candidate_windows(sketch, window, anchor, bits), OPEN)
    return found.repartition("h1").sortWithinPartitions("settled", "h1", "h2", "id", "at").mapInArrow(later_windows(window), SPANS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_text: bool = True, window: int = WINDOW, bits: int = CELL_BITS, result: str = "repeats") -> DataFrame:
    """The columns `keep` of `docs` (all, if None) and a struct `result` of n_words, n_removed, kept and kept_sha256.

    kept is the text with the repeats taken out, its words joined by one space; a text without repeats is kept as it is. It stands for the text
    column, which is not returned. kept_sha256 is of the kept words joined by one space. An input column named like `result` is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (result, text_col)]
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__id"), F.hash(text_col).alias("__key"), F.col(text_col).alias("__text"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("__row"))
    rows = keyed.select(F.col("__id").alias("id"), F.col("__key").alias("text_key"), F.col("__text").alias("text"))
    spans = removed_spans(rows, window=window, bits=bits).groupBy("id", "text_key").agg(F.collect_set(F.struct("at", "until")).alias("__spans"))  # different ones: no more than the words of one text
    joined = keyed.join(spans, (F.col("__id") == F.col("id")) & (F.col("__key") == F.col("text_key")), "left").select("__row", "__text", "__spans")
    fields = StructType([StructField("__row", joined.schema["__row"].dataType), StructField("__kept", RESULT)])
    out = joined.mapInArrow(kept_words(with_text), fields)
    return out.select("__row.*", F.col("__kept").alias(result))
