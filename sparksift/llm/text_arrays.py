"""Words, lines and n-grams of whole Arrow batches as numpy arrays.

A batch of texts is one byte buffer with offsets, so words and their hashes come from a few array operations per batch instead
of a Python loop per word. A word is ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes. Hashes have 64 bits; exact grouping uses two lanes of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 19
SPAN = 1 << 18
_RANDOM = np.random.default_rng(20240229)
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
BASES = [int(x) | 1 for x in _RANDOM.integers(1 << 40, 1 << 63, 4, dtype=np.uint64)]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SPAN if have is None else 2 * len(have[0]))
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """A hash of every k consecutive values; empty if there are fewer."""
    n = len(values)
    if n < k:
        return np.empty(0, U64)
    out = np.empty(n - k + 1, U64)
    for a in range(0, len(out), SPAN):  # in spans, so that the tables of powers stay small
        part = values[a : min(n, a + SPAN + k - 1)]
        up, down = powers(BASES[1 + lane], len(part))
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up, out=sums[1:])
        out[a : a + SPAN] = (sums[k:] - sums[:-k]) * down[: len(part) - k + 1]
    return mix(out + U64(k))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans ascend and don't overlap."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + SPAN, "right")))
        b = int(ends[j - 1])
        up, down = powers(BASES[0], b - a + 1)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(BYTE_VALUES[data[a:b]] * up[:-1], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64)
        i = j
    return mix(out)


@dataclass
class Texts:
    """The texts of some rows: one buffer, and where each text begins; nulls are empty."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """All words of some texts: byte positions, the text each is in, where each text's words begin, and hashes."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, 8 * column.offset) if n else np.zeros(1, np.int64)
    base, end = int(at[0]), int(at[-1])
    raw = np.frombuffer(data, np.uint8, end - base, base) if end > base else np.empty(0, np.uint8)
    return Texts(raw, at - base)


def words_of(texts: Texts, hashes: bool = True, gap: np.ndarray = IS_SPACE) -> Words:
    """Maximal runs of bytes that are not in `gap`, a table of 256 flags."""
    data, offsets = texts.data, texts.offsets
    inside = ~gap[data]
    new = np.ones(len(data), bool)
    new[1:] = ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    new[cuts] = True
    starts = np.flatnonzero(inside & new)
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    last[cuts[cuts > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(starts, ends, text, first, span_hashes(data, starts, ends) if hashes else np.empty(0, U64))


def windows_inside(words: Words, k: int) -> np.ndarray:
    """For the start of each window of k words, whether it stays in one text."""
    n = len(words.text) - k + 1
    return words.text[:n] == words.text[k - 1 :] if n > 0 else np.empty(0, bool)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.diff(texts_of(column).offsets)
        piece = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def ints(column: pa.Array, null: int) -> np.ndarray:
    """A column of integers with a value for nulls."""
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)
