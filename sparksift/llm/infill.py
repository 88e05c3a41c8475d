"""Fill-in-the-middle documents: cuts at lines, found from memoized summaries of content-defined chunks.

A text is cut into chunks where a rolling hash of its last 32 bytes is 0 in ten bits, so equal passages give equal chunks wherever they stand, and a change in
one place moves no boundary elsewhere. Chunks are 256 to 8192 bytes long, 1 KB on average. A chunk's summary says how many line ends and code points
it holds, where each line end is, in bytes and in code points, and whether a sentinel occurs in it; its first and last bytes show sentinels that lie across chunks.
Summaries are kept in a cache of bounded size in each task. A cache entry is found by the chunk's hash and used only if the content is equal, so a collision
costs a new summary and never a wrong one; what the cache holds changes the time taken, not the result.

A document is summed up by adding its chunks' counts. Line cut u lies in the first chunk in which the running count of line ends reaches u, at the line end that
the chunk's summary names; no text is searched for lines again. The text is then put together from three byte ranges.

`restored` rebuilds the text from the output and the form alone, in plain column functions.

Defined cases: a null or empty text gives form plain, 0 units and an empty output; a text that holds a sentinel stays plain; one line may be of any length;
the cuts depend on the id alone, so rows with one id and text are cut alike, and a null id counts as the empty string; an empty table gives no rows; other
columns are not looked at, whatever their names. Malformed UTF-8 is passed through.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_arrays import BYTE_VALUES, U64, rolling, slices, texts_of

WINDOW, LEAST, MOST, BITS = 32, 256, 8192, 10
CACHE_BYTES = 32 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = tuple(s.encode() for s in (PREFIX, SUFFIX, MIDDLE))
EDGE = 2  # bytes on either side of a chunk boundary that a sentinel of three bytes can take
SEED, RATE, SPM_SHARE = 7, 100, 50
NEWLINE = 10


@dataclass(slots=True)
class Summary:
    """What a chunk adds to its document."""

    content: bytes
    ends: np.ndarray  # bytes up to and with each line end
    points: np.ndarray  # code points up to and with each line end
    n_points: int
    sentinel: bool


def summarise(content: bytes) -> Summary:
    data = np.frombuffer(content, np.uint8)
    ends = np.flatnonzero(data == NEWLINE) + 1
    points = np.cumsum((data & 0xC0) != 0x80)  # a code point is counted at its first byte
    return Summary(content, ends, points[ends - 1], int(points[-1]), any(s in content for s in SENTINELS))


class Summaries:
    """The summaries of the chunks seen last, as far as `limit` bytes of content go."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.size, self.kept = limit, 0, OrderedDict()
        self.hits = self.misses = 0

    def of(self, content: bytes) -> Summary:
        key = hash(content)
        found = self.kept.get(key)
        if found is not None and found.content == content:
            self.hits += 1
            self.kept.move_to_end(key)
            return found
        self.misses += 1
        if found is not None:
            self.size -= len(found.content)
        new = self.kept[key] = summarise(content)
        self.kept.move_to_end(key)
        self.size += len(content)
        while self.size > self.limit and len(self.kept) > 1:
            self.size -= len(self.kept.popitem(last=False)[1].content)
        return new


def candidates(data: np.ndarray) -> np.ndarray:
    """Byte positions after which a chunk may end, by the bytes just before them."""
    hashes = rolling(BYTE_VALUES[data], WINDOW)
    return np.flatnonzero((hashes & U64((1 << BITS) - 1)) == 0) + WINDOW


def chunk_ends(marks: np.ndarray, a: int, b: int) -> list[int]:
    """Ends of the chunks of the text in bytes a to b: at marks whose window lies in the text, not too near, and never too far."""
    out, last = [], a
    for mark in marks[np.searchsorted(marks, a + max(LEAST, WINDOW)) : np.searchsorted(marks, b)].tolist():
        while mark - last > MOST:
            last += MOST
            out.append(last)
        if mark - last >= LEAST:
            out.append(mark)
            last = mark
    while b - last > MOST:
        last += MOST
        out.append(last)
    if b > last:
        out.append(b)
    return out


@dataclass(slots=True)
class Outline:
    """A document as the sum of its chunks: running counts after each chunk, and the chunks' summaries."""

    chunks: list[Summary]
    bytes_: np.ndarray
    lines: np.ndarray
    points: np.ndarray
    units: int
    sentinel: bool

    def cut(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) of the first `unit` units."""
        if not unit:
            return 0, 0
        if unit > self.lines[-1]:  # the last unit has no line end
            return int(self.bytes_[-1]), int(self.points[-1])
        k = int(np.searchsorted(self.lines, unit))
        before = (int(self.bytes_[k - 1]), int(self.lines[k - 1]), int(self.points[k - 1])) if k else (0, 0, 0)
        place = unit - before[1] - 1
        return before[0] + int(self.chunks[k].ends[place]), before[2] + int(self.chunks[k].points[place])


def outline(text: bytes, ends: list[int], cache: Summaries) -> Outline:
    """`ends`: byte positions in the text where its chunks end; the last one is its length."""
    chunks, last, sentinel, tail = [], 0, False, b""
    for end in ends:
        found = cache.of(text[last:end])
        if tail and not sentinel:
            across = tail + found.content[:EDGE]
            sentinel = any(s in across for s in SENTINELS)
        sentinel = sentinel or found.sentinel
        tail = (tail + found.content[-EDGE:])[-EDGE:]
        chunks.append(found)
        last = end
    lines = np.cumsum([len(c.ends) for c in chunks], dtype=np.int64)
    points = np.cumsum([c.n_points for c in chunks], dtype=np.int64)
    units = (int(lines[-1]) + (not text.endswith(b"\n"))) if chunks else 0
    return Outline(chunks, np.array(ends, np.int64), lines, points, units, sentinel)


def draws(seed: int, id_: int | None) -> list[int]:
    """Four numbers below 2**32 for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE, cache_bytes: int = CACHE_BYTES
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row for each document, `output` its text in the form psm, spm or plain.

    `rate` of 100 documents are rearranged, `spm_share` of 100 of those with the suffix first. The two counts are null for plain ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Summaries(cache_bytes)
        psm, spm = (PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()), (SUFFIX.encode(), PREFIX.encode(), MIDDLE.encode())
        for batch in slices(batches, "text"):
            texts = texts_of(batch.column(1))
            marks = candidates(texts.data)
            rows = []
            for i, id_ in enumerate(batch.column(0).to_pylist()):
                a, b = int(texts.offsets[i]), int(texts.offsets[i + 1])
                text = texts.text(i)
                doc = outline(text, [e - a for e in chunk_ends(marks, a, b)], cache)
                h1, h2, h3, h4 = draws(seed, id_)
                if not text or doc.sentinel or h3 % 100 >= rate:
                    rows.append((id_, doc.units, "plain", None, None, text))
                    continue
                low, high = sorted((h1 % (doc.units + 1), h2 % (doc.units + 1)))
                (x, x_points), (y, y_points) = doc.cut(low), doc.cut(high)
                prefix, middle, suffix = text[:x], text[x:y], text[y:]
                if h4 % 100 < spm_share:
                    form, output = "spm", b"".join((spm[0], suffix, spm[1], prefix, spm[2], middle))
                else:
                    form, output = "psm", b"".join((psm[0], prefix, psm[1], suffix, psm[2], middle))
                rows.append((id_, doc.units, form, x_points, y_points - x_points, output))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in COLUMNS.split(", ")])

    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, COLUMNS)
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; a text that holds a sentinel was left plain, so each stands once."""

    def before(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    def after(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, -1)

    def opened(text: Column, mark: str) -> Column:
        return F.substr(text, F.lit(len(mark) + 1))

    middle, rest = after(output, MIDDLE), before(output, MIDDLE)
    psm = F.concat(opened(before(rest, SUFFIX), PREFIX), middle, after(rest, SUFFIX))
    spm = F.concat(after(rest, PREFIX), middle, opened(before(rest, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
