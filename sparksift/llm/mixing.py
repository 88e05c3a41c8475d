"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source whose target is c times its size gets floor(c) copies and the fraction of c as the probability of one more. Two
documents of a source with such probabilities p, q and sizes s, t pass mass s * dp = -t * dq between them, in a random direction that
leaves both expectations unchanged, until one probability is 0 or 1; that document is settled, the other goes on. Sums of s * p never
change, so a source's words miss its target by less than one document.

Documents are dealt by a hash of their id into buckets, and a task streams each bucket's sources in order of id with one open document for each, so a source that
holds a third of all rows is in all tasks. The open documents, one for each bucket and source, meet in a reduction tree of `FAN`
branches; the last one of a source is rounded to the nearer side. Random numbers are hashes of ids and sizes, so reruns agree whatever the partitioning.

Targets: sources by code point (null last) weigh `WEIGHTS` in turn and share `SHARE` of all words; a target stops at `MOST` times its
source's size and the excess goes to the others by weight. That is min(MOST * size, level * weight) at one level, found with running sums over sources.

Defined cases: a null text has size 0; sizes of 0 are settled at once with 0 words taken; rows with one id are mixed each on its own, in order of size;
null sources are one source; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored

WEIGHTS, SHARE, MOST = [3, 1, 2], 1.5, 2.0
BUCKET_ROWS, FAN = 50_000, 32
WORD = r"[^\x20\x09-\x0D]+"
STATE = "settled boolean, node long, source string, doc_id long, size long, copies long, p double"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(source_col).cast("string").alias("source"),
    )


def targets(sized: DataFrame, weights: list[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): one row for each source. The windows run over sources, not rows."""
    totals = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    levels = (
        totals.withColumn("w", weight)
        .withColumn("ratio", most * F.col("source_size") / F.col("w"))
        .withColumn("budget", share * F.sum("source_size").over(every))
        # the level if all sources before this one are full
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("w").over(onward))
    )
    chosen = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return levels.withColumn("chosen", chosen).select(
        "source", "source_size", "n", F.least(most * F.col("source_size"), F.coalesce(F.col("chosen") * F.col("w"), most * F.col("source_size"))).cast("double").alias("target")
    )


def chance(a: tuple, b: tuple, seed: int) -> float:
    x = (a[0] * 0x9E3779B97F4A7C15 + b[0] * 0xC2B2AE3D27D4EB4F + a[1] * 0x165667B19E3779F9 + b[1] * 0x27D4EB2F165667C5 + seed) & 0xFFFFFFFFFFFFFFFF
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) * 2.0**-53


def transfer(a: tuple, b: tuple, p: float, q: float, seed: int) -> tuple[float, float]:
    """The probabilities of a and b, (id, size) each, after mass has passed: at least one is 0 or 1, size * probability sums as before."""
    s, t = a[1], b[1]
    up, down = min(s * (1 - p), t * q), min(s * p, t * (1 - q))  # mass that a can take, and give
    if chance(a, b, seed) * (up + down) < down:
        new_p = 1.0 if up == s * (1 - p) else p + up / s
        new_q = 0.0 if up == t * q else q - up / t
    else:
        new_p = 0.0 if down == s * p else p - down / s
        new_q = 1.0 if down == t * (1 - q) else q + down / t
    return new_p, new_q


def paired(seed: int):
    """Settles rows sorted by (node, source, doc_id, size); one open row stays for each node and source."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = held = None
        for frame in frames:
            out = []
            for settled, node, source, doc, size, copies, p in frame.itertuples(index=False, name=None):
                source = None if pd.isna(source) else source
                doc = None if pd.isna(doc) else int(doc)
                if settled:
                    out.append((True, node, source, doc, size, copies, 0.0))
                    continue
                if (node, source) != key:
                    if held:
                        out.append((False, *key, *held))
                    key, held = (node, source), None
                row = (doc, int(size), int(copies), float(p))
                if not 0 < p < 1 or not size:
                    out.append((True, *key, doc, size, copies + (1 if p >= 1 else 0), 0.0))
                elif held is None:
                    held = row
                else:
                    new_p, new_q = transfer((held[0] or 0, held[1]), (doc or 0, row[1]), held[3], p, seed)
                    pair = [(*held[:3], new_p), (*row[:3], new_q)]
                    open_ = [x for x in pair if 0 < x[3] < 1]
                    out += [(True, *key, x[0], x[1], x[2] + round(x[3]), 0.0) for x in pair if not 0 < x[3] < 1]
                    held = open_[0] if open_ else None
            yield as_frame(out)
        if held:
            yield as_frame([(False, *key, *held)])

    return run


def as_frame(rows: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    types = ["bool", "int64", object, "Int64", "int64", "int64", "float64"]
    names = [x.split()[0] for x in STATE.split(", ")]
    return pd.DataFrame({n: pd.Series(list(c), dtype=t) for n, c, t in zip(names, columns, types, strict=True)})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights: list[int] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) of each row."""
    sized = stored(sizes(docs, id_col, text_col, source_col))
    goal = stored(targets(sized, weights, share))
    n = goal.agg(F.sum("n")).first()[0] or 0
    buckets = -(-n // BUCKET_ROWS) or 1
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = sized.join(goal.select(F.col("source").alias("src"), "source_size", "target"), F.col("source").eqNullSafe(F.col("src"))).select("doc_id", "size", "source", ratio.alias("ratio"))
    state = wanted.select(
        F.lit(False).alias("settled"), F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).alias("node"), "source", "doc_id", "size",
        F.floor("ratio").alias("copies"), (F.col("ratio") - F.floor("ratio")).alias("p"),
    )
    done, level = [], 0
    while True:
        state = stored(state.repartition("node").sortWithinPartitions("node", "source", "doc_id", "size").mapInPandas(paired(seed + level), STATE))
        done.append(state.filter("settled"))
        state = state.filter("not settled")
        if buckets == 1:
            break
        buckets, level = -(-buckets // FAN), level + 1
        state = state.withColumn("node", F.pmod("node", F.lit(buckets)))
    settled = state.withColumn("copies", F.col("copies") + F.when(F.col("p") >= 0.5, 1).otherwise(0))
    for part in done:
        settled = settled.unionByName(part)
    return settled.join(goal.select(F.col("source").alias("src"), "source_size", "target"), F.col("source").eqNullSafe(F.col("src"))).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, each as often as it is taken; its columns.

    Rows of equal id, size and source share out the copies that were drawn for them.
    """
    drawn = mix(docs, id_col, text_col, source_col).groupBy("doc_id", "size", "source").agg(F.sort_array(F.collect_list("copies"), False).alias("copies"))
    id_, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    # the row travels as one column, so that no name of its own meets those used here
    rows = docs.select(
        id_.cast("long").alias("id"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n"), source.cast("string").alias("src"),
        F.xxhash64(text).alias("h"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )
    joined = rows.join(drawn, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("n") == F.col("size")) & F.col("src").eqNullSafe(F.col("source")))
    turn = F.row_number().over(Window.partitionBy("doc_id", "size", "source").orderBy("h"))
    times = joined.withColumn("times", F.element_at("copies", turn)).select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return times.select(*(F.col("row")[c].alias(c) for c in docs.columns))
