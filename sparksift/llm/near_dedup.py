"""Near duplicates by ProbMinHash over weighted shingles, banding, and exact verification.

A document's shingles are its runs of five words; one that occurs n times weighs 1 + ln n, so that a phrase repeated a thousand times does not outweigh
the rest of a text. A document of one to four words has one shingle, all of it. Two documents are linked if the Jaccard similarity of their shingle
sets is at least 0.8. A class is a connected component of links; its id is its smallest document id, and that document stays.

1. *Signature.* Each shingle is a Poisson process whose rate is its weight; arrivals fall on one of 150 components, and the earliest
   arrival at a component names it. Arrivals are made in order of time and stop as soon as every component of the document has one.
   The chance that a component agrees is the probability Jaccard similarity, the sum over common shingles d of 1 / sum_e max(x_e / x_d, y_e / y_d),
   which is the plain one where weights are equal.
2. *Classes of equal shingle sets* are formed first (two 64-bit sums over shingles, whatever their counts), so copies never meet in a pair.
3. *Bands*: 30 bands of 5 components, and of texts whose shingles differ in count 30 more of a signature with unit weights, in the same
   buckets. So every pair meets by its plain similarity too, which links are defined by: one of 0.8 shares no band with a chance of 7e-6 at most.
4. *Verification.* Pairs are compared exactly, and only those of one bucket that links have not joined yet and whose sizes allow the threshold. A bucket with no more than `EACH` such
   pairs for each of its texts is settled at once. In larger ones every text is compared with one hub, first the text that shares most
   buckets; links are contracted to components, and new hubs are drawn as long as a round joins `WORTH` of the texts. A group of near copies is
   joined after a few rounds, for one comparison a text and round. What is left in large buckets are texts that share a passage rather than being
   copies; their pairs come from an exact prefix-filter join on their rarest shingles.

Defined cases: a text without words (null, empty, blank) is a class of its own. Each distinct shingle set has a key of its own for buckets and sets. Rows
with one id are one document of all their texts' links; null ids are returned as classes of their own, not compared. `one_of_each` goes by texts, with
null ids compared too: a row is dropped only if its class keeps another row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch
from .graph import components, rooted, star_edges, stored
from .text_arrays import U64, Words, mix, rolling, slices, texts_of, words_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_SIZE = 30, 5
SIZE = BANDS * BAND_SIZE
HUB_ROUNDS, EACH, WORTH = 8, 4, 0.5
SALTED = 4096  # members of a bucket that one task of a settled bucket's join takes
SIGNED_BYTES = 3 << 20  # of text at once: a step of the arrivals costs the same for few and many texts
GOLD, OTHER = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)


def shingles(words: Words, n_texts: int, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of each distinct shingle, sorted by text and shingle."""
    n = np.diff(words.first)
    text, value = [np.empty(0, np.int64)], [np.empty(0, U64)]
    for size in range(1, k + 1):  # texts of fewer than k words have one shingle of their length
        h = rolling(words.hashes, size)
        if not len(h):
            break
        t = words.text[: len(h)]
        inside = (t == words.text[size - 1 :]) & (n[t] >= k if size == k else n[t] == size)
        text.append(t[inside])
        value.append(h[inside])
    t, v = np.concatenate(text), np.concatenate(value)
    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    return t[at], v[at], np.diff(np.append(at, len(t)))


def weights(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count)


def signatures(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n_texts: int, size: int = SIZE) -> np.ndarray:
    """ProbMinHash signatures (n_texts, size); texts without shingles get zeros."""
    best = np.full(n_texts * size, np.inf)
    owner = np.zeros(n_texts * size, U64)
    total = np.bincount(text, weight, n_texts)
    limit = np.full(n_texts, 0.0)
    has = total > 0
    limit[has] = size * (np.log(size) + 2) / total[has]
    step = np.where(has, 3 * size / np.maximum(total, 1), 0)
    waiting = np.arange(len(text))  # shingles whose next arrival may still count
    time = np.zeros(len(text))
    arrival = np.zeros(len(text), U64)
    fresh = np.ones(len(text), bool)
    while len(waiting):
        now = waiting
        while len(now):
            draw = now[fresh[now]]
            if len(draw):
                u = mix(value[draw] + GOLD * (arrival[draw] + U64(1)))
                time[draw] += -np.log(((u >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[draw]
                fresh[draw] = False
            now = now[time[now] <= limit[text[now]]]
            slot = ((mix(value[now] ^ (OTHER * (arrival[now] + U64(1)))) >> U64(32)) * U64(size) >> U64(32)).astype(np.int64)
            cell = text[now] * size + slot
            np.minimum.at(best, cell, time[now])
            won = best[cell] == time[now]
            owner[cell[won]] = value[now][won]
            arrival[now] += U64(1)
            fresh[now] = True
        open_ = has & np.isinf(best.reshape(n_texts, size)).any(1)
        limit = np.where(open_, limit + step, limit)
        waiting = waiting[open_[text[waiting]]]
    return owner.reshape(n_texts, size)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1)
    weights = mix(np.arange(1, parts.shape[2] + 1, dtype=U64) * GOLD) | U64(1)
    return mix((mix(parts) * weights).sum(2, dtype=U64) + np.arange(bands, dtype=U64) * OTHER)


def all_bands(text: np.ndarray, value: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2 * BANDS) band hashes of weighted and of unit weight signatures, and which of them count: equal ones once, none of texts without shingles."""
    first = np.searchsorted(text, np.arange(n))
    has = np.bincount(text, minlength=n) > 0
    uneven = np.bincount(text, count != count[np.minimum(first, len(count) - 1)][text], n) > 0 if len(count) else np.zeros(n, bool)
    weighted = band_hashes(signatures(text, value, weights(count), n))
    bands, used = np.hstack([weighted, weighted]), np.repeat(np.stack([has, np.zeros(n, bool)], 1), BANDS, axis=1)
    if uneven.any():  # with one count for all shingles the two signatures are the same
        at = uneven[text]
        number = np.cumsum(uneven) - 1
        unit = band_hashes(signatures(number[text[at]], value[at], np.ones(at.sum()), int(uneven.sum())))
        bands[uneven, BANDS:] = unit
        used[uneven, BANDS:] = unit != weighted[uneven]
    return bands, used


SIGNED = "null_id boolean, id long, h1 long, h2 long, s1 long, s2 long, size int, bands array<long>"


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SIGNED_BYTES):
        n = batch.num_rows
        text, value, count = shingles(words_of(texts_of(batch.column(4))), n)
        sums = [np.zeros(n, U64), np.zeros(n, U64)]
        for lane, salt in enumerate((GOLD, OTHER)):
            np.add.at(sums[lane], text, mix(value ^ mix(salt + U64(lane))))
        bands, used = all_bands(text, value, count, n)
        sizes = np.bincount(text, minlength=n)
        offsets = np.concatenate([[0], np.cumsum(used.sum(1))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[used].view(np.int64)))
        yield pa.record_batch([*batch.columns[:4], *(pa.array(s.view(np.int64)) for s in sums), pa.array(sizes, pa.int32()), lists], [*KEY, "s1", "s2", "size", "bands"])


SETS = "id long, shingles binary"


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        text, value, _ = shingles(words_of(texts_of(batch.column(1))), batch.num_rows)
        cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
        yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array([value[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["id", "shingles"])


def single_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            ids, blobs = batch.column(0).slice(k, 64).to_pylist(), batch.column(1).slice(k, 64).to_pylist()
            sizes = [len(b) // 8 for b in blobs]
            columns = [np.repeat(np.array(ids, np.int64), sizes), np.frombuffer(b"".join(blobs), np.int64), np.repeat(np.array(sizes, np.int32), sizes)]
            yield pa.record_batch([pa.array(c) for c in columns], ["id", "shingle", "size"])


def similarity(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> float:
    """Probability Jaccard similarity of two texts, of their sorted shingles and counts."""
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    nx, ny = weights(nx), weights(ny)
    a, b = nx[i], ny[j]
    ratio = a / b
    order = np.argsort(ratio)
    a, b = a[order], b[order]
    only_x, only_y = float(nx.sum() - a.sum()), float(ny.sum() - b.sum())
    # sum_e max(x_e / x_d, y_e / y_d): the x side for common e of a larger ratio than d, the y side for the others
    above, below = a.sum() - np.cumsum(a), np.cumsum(b)
    return float((1.0 / ((only_x + above) / a + (only_y + below) / b)).sum())


def verified(threshold: float):
    """Pairs whose shingle sets have a Jaccard similarity of the threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            keep = []
            for i, (p, q) in enumerate(zip(x, y, strict=True)):
                both = (len(p) + len(q)) // 8
                if min(len(p), len(q)) >= threshold * max(len(p), len(q)) - 1e-6:
                    common = both - len(np.unique(np.frombuffer(p + q, U64)))
                    if common >= threshold * (both - common) - 1e-9:
                        keep.append(i)
            yield pa.record_batch([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    return run


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verified(threshold), "a long, b long"))


def prefix_pairs(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of members (id, root) of different roots that can reach the threshold, by their rarest shingles.

    With shingles ordered by their number of members, rarest first, two sets of n and m shingles that reach the threshold t share one within the first
    n - ceil(t n) + 1 and m - ceil(t m) + 1, and t n <= m <= n / t. A passage that all members hold is at the end of that order. The
    first common shingle, at places i and j, must leave room for t / (1 + t) (n + m) common ones: 1 + min(n - i, m - j).
    """
    rows = members.join(sets, "id").select("id", "shingles").mapInArrow(single_shingles, "id long, shingle long, size int")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("n", "shingle"))  # within one text
    kept = rows.join(counts, "shingle").withColumn("rank", rank).filter(F.col("rank") <= F.col("size") - F.ceil(F.lit(threshold - 1e-9) * F.col("size")) + 1)
    prefix = stored(kept.filter("n > 1").join(members, "id").select("id", "root", "shingle", "size", "rank"))
    other = prefix.select("shingle", F.col("id").alias("id2"), F.col("root").alias("root2"), F.col("size").alias("size2"), F.col("rank").alias("rank2"))
    near = fits("size", "size2", threshold) & (F.col("root") < F.col("root2"))
    near &= 1 + F.least(F.col("size") - F.col("rank"), F.col("size2") - F.col("rank2")) >= F.lit(threshold / (1 + threshold)) * (F.col("size") + F.col("size2")) - 1e-6
    return prefix.join(other, "shingle").filter(near).select(*ordered("id", "id2")).distinct()


def fits(a: str, b: str, threshold: float) -> Column:
    """Sets of these sizes can reach the threshold."""
    return F.least(a, b) >= F.lit(threshold - 1e-9) * F.greatest(a, b)


def ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_links(buckets: DataFrame, sets: DataFrame, threshold: float, rounds: int = HUB_ROUNDS) -> DataFrame:
    """Links whose components are those of all pairs in a bucket that reach the threshold. buckets: (bucket, id, size), size of the shingle set."""
    scratch = Scratch(buckets.sparkSession)
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    degrees = scratch.stored(buckets.join(sizes, "bucket").groupBy("id").agg(F.sum("n").alias("degree")))
    links, members, turn, before = None, buckets.withColumn("root", F.col("id")), 0, 0
    stars = last_members = None
    while True:
        by_root = members.groupBy("bucket", "root").agg(F.count("*").alias("c"))
        # pairs of members of different components, and the component with most members
        open_ = by_root.groupBy("bucket").agg(
            F.sum("c").alias("n"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"), F.max(F.struct("c", "root")).alias("most")
        ).filter("pairs > 0")
        few = F.col("pairs") <= EACH * F.col("n")
        members = scratch.stored(members.join(open_, "bucket").select("bucket", "id", "size", "root", "n", few.alias("few"), (F.col("root") != F.col("most.root")).alias("minor")))
        scratch.drop(stars, last_members)
        if members.isEmpty():
            return buckets.sparkSession.createDataFrame([], "a long, b long") if links is None else links
        pairs = settled_pairs(members.filter("few"), threshold)
        large = members.filter("not few").select("bucket", "id", "size", "root")
        texts = large.select("id", "root").distinct()
        n = texts.count()
        last = turn == rounds or turn > 0 and before < WORTH * n
        if last:
            pairs = pairs.unionByName(prefix_pairs(texts, sets, threshold))
        else:
            # first the text that shares most buckets, as the original of a group does; then texts by chance, in proportion to that
            chance = -F.log((F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 30)) + 0.5) / (1 << 30)) / F.col("degree")
            first = chance if turn else -F.col("degree").cast("double")
            hubs = large.join(degrees, "id").groupBy("bucket").agg(F.min(F.struct(first.alias("h"), F.col("id").alias("hub"), F.col("size").alias("hub_size"), F.col("root").alias("hub_root"))).alias("m"))
            # one hub for each text and round: of the buckets whose hub it isn't joined with but may be similar to, any
            chosen = large.join(hubs.select("bucket", "m.hub", "m.hub_size", "m.hub_root"), "bucket").filter((F.col("root") != F.col("hub_root")) & fits("size", "hub_size", threshold)).groupBy("id").agg(F.min(F.struct(F.xxhash64("bucket", F.lit(turn)).alias("h"), "hub")).alias("m"))
            pairs = pairs.unionByName(chosen.select(*ordered("id", "m.hub")))
        found = linked(pairs.distinct(), sets, threshold)
        links = found if links is None else links.unionByName(found)
        if last or not n:
            scratch.drop(members, degrees)
            return links
        stars, last_members = star_edges(links, scratch), members
        before, turn = found.count(), turn + 1
        members = large.select("bucket", "id", "size").join(rooted(stars), F.col("id") == F.col("node"), "left").select("bucket", "id", "size", F.coalesce("root", "id").alias("root"))


def settled_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of members of one bucket and different components, for buckets with no more than `EACH` such pairs a member.

    Only members outside a bucket's largest component look for partners. With n members, c of them in that component, there are at least
    n (n - c) / 2 pairs, so the join makes twice the pairs at most, however large the component is. In such a bucket n - c is no more than 2 `EACH`:
    the few are repeated, so that many members are spread over several tasks.
    """
    n_salts = F.floor(F.col("n") / SALTED).cast("int")
    left = members.filter("minor").select("bucket", "id", "size", "root", F.explode(F.sequence(F.lit(0), n_salts)).alias("salt"))
    right = members.select(
        "bucket", F.col("id").alias("id2"), F.col("size").alias("size2"), F.col("root").alias("root2"), F.col("minor").alias("minor2"),
        F.pmod(F.xxhash64("id"), n_salts + 1).cast("int").alias("salt"),
    )
    apart = (F.col("root") != F.col("root2")) & (~F.col("minor2") | (F.col("root") < F.col("root2")))
    return left.join(right, ["bucket", "salt"]).filter(apart & fits("size", "size2", threshold)).select(*ordered("id", "id2"))


KEY = ["null_id", "id", "h1", "h2"]  # of a row: its id (0 for null) and its text's hashes


def keys(id_: Column, text: Column) -> list[Column]:
    id_ = id_.cast("long")
    return [c.alias(k) for k, c in zip(KEY, (id_.isNull(), F.coalesce(id_, F.lit(0)), F.xxhash64(text), F.xxhash64(F.lit(1), text)), strict=True)]


def text_links(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (KEY, text): (KEY, s1, s2, some) of each row, (rep, first, s1, s2) of each distinct shingle set, and links (a, b) of reps.

    first is the smallest key of a row that has the set, null ids last.
    """
    marks = stored(rows.mapInArrow(signed, SIGNED))
    with_words = marks.filter(F.size("bands") > 0)
    first = F.min(F.struct(*KEY)).alias("first")
    # stored, so that reps are drawn once
    texts = stored(with_words.groupBy("s1", "s2").agg(first, F.first("size").alias("size"), F.first("bands").alias("bands")).withColumn("rep", F.monotonically_increasing_id()))
    exploded = texts.select("rep", "size", F.explode("bands").alias("bucket"))
    # a bucket is a hash that holds its band's number, so bands never mix
    shared = exploded.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("bucket")
    buckets = stored(exploded.join(shared, "bucket").select("bucket", F.col("rep").alias("id"), "size"))
    wanted = texts.join(buckets.select(F.col("id").alias("rep")).distinct(), "rep", "left_semi").select("first.*", "rep")
    reps = rows.join(wanted, KEY).dropDuplicates(KEY)  # by the join's key, so without another shuffle
    sets = stored(reps.select(F.col("rep").alias("id"), "text").mapInArrow(shingle_sets, SETS))
    return marks.select(*KEY, "s1", "s2", (F.size("bands") > 0).alias("some")), texts.select("rep", "first", "s1", "s2"), near_links(buckets, sets, threshold)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, kept) of every row's id: one row for each document id, and one for all null ids if there are any."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marks, texts, found = text_links(rows.filter("id is not null").select(*keys(F.col("id"), F.col("text")), "text"), threshold)
    names = texts.select("rep", F.col("first.id").alias("name"))
    links = found.join(names.select(F.col("rep").alias("a"), F.col("name").alias("x")), "a").join(names.select(F.col("rep").alias("b"), F.col("name").alias("y")), "b")
    copies = marks.filter("some").join(texts.select("s1", "s2", F.col("first.id").alias("b")), ["s1", "s2"]).filter("id <> b").select(F.col("id").alias("a"), "b")
    roots = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(copies))
    ids = rows.select("id").distinct()
    out = ids.join(roots, ids.id == roots.node, "left").select("id", F.coalesce("root", "id").alias("class_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("class_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of texts, that of the smallest id, null ids last; the columns of `docs`.

    Rows of one id are classed by their own texts, and so are rows of null ids. Of rows without words those equal in id and text are one, and
    those of null ids all stay.
    """
    # the row travels as one column, so that no name of its own meets those used here
    rows = docs.select(*keys(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.col(f"`{text_col}`").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    marks, texts, links = text_links(rows.select(*KEY, "text"), threshold)
    classes = texts.join(components(links), F.col("rep") == F.col("node"), "left").groupBy(F.coalesce("root", "rep").alias("class")).agg(F.min("first").alias("first"))
    chosen = classes.select("first.*", F.lit(True).alias("some")).unionByName(marks.filter("not some").select(*KEY, "some").distinct())
    found = rows.select(*KEY, "row").join(chosen, KEY)
    own = F.when(F.col("null_id") & ~F.col("some"), F.monotonically_increasing_id())
    kept = found.withColumn("own", own).dropDuplicates([*KEY, "own"])
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
