"""Clones: items with equal normalised content, and the findings on them.

The n-th copy's message says "n copies", so copies need a running number. A
window over the hash alone would put all copies of a popular text into one
task. Instead an item gets a chunk, a slice of the file order: numbers are
counted inside (hash, chunk), one row per (hash, chunk) carries the counts of
the chunks before it, and the two are added. A hash seen in every file still
spreads over all chunks, and the offsets hold at most ``CHUNKS`` rows per hash.

Copies meet their group twice, so items are narrow rows that are stored first:
a text is read, normalised and hashed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..storage import Scratch
from .findings import emit, hit
from .members import methods_of

# Three hexadecimal digits of the path's digest.
CHUNKS = 4096


def file_chunk(path: Column) -> Column:
    """Position of a file in the corpus order, coarsely; files are ordered by (chunk, path)."""
    return F.substring(F.md5(path.cast("string")), 1, 3)


def method_items(members: DataFrame, min_statements: int = 3) -> DataFrame:
    """Methods large enough to compare, with the hash of their body in one layout."""
    rows = methods_of(members).filter(F.col("has_body") & (F.col("n_stmts") >= min_statements))
    return rows.select(
        "path", F.col("name").alias("label"), "line", F.coalesce("close_pos", "member").alias("node"), F.col("body_hash").alias("hash")
    )


def clone_groups(items: DataFrame) -> DataFrame:
    """Hashes held by more than one item, with their number of copies; items without a text have no hash."""
    return items.filter("hash IS NOT NULL").groupBy("hash").agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def numbered_copies(items: DataFrame) -> DataFrame:
    """Items of clone groups with their occurrence number ``n`` and the first and second occurrence.

    ``items`` are read several times, see ``stored_items``.
    """
    place = F.struct("path", "label")
    # counts combine before the shuffle; what occurs once leaves before anything is sorted
    copied = clone_groups(items).select("hash")
    rows = items.join(copied, "hash", "left_semi").withColumn("chunk", file_chunk(F.col("path")))
    inside = W.partitionBy("hash", "chunk").orderBy("path", "node")
    local = rows.withColumn("local_n", F.row_number().over(inside))
    per_chunk = local.groupBy("hash", "chunk").agg(
        F.count("*").alias("n_chunk"),
        F.max(F.when(F.col("local_n") == 1, place)).alias("chunk_first"),
        F.max(F.when(F.col("local_n") == 2, place)).alias("chunk_second"),
    )
    chunks = W.partitionBy("hash").orderBy("chunk")
    whole = chunks.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = per_chunk.select(
        "hash", "chunk",
        F.coalesce(F.sum("n_chunk").over(chunks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n_chunk").over(whole).alias("copies"),
        F.first("chunk_first").over(whole).alias("first"),
        F.coalesce(F.first("chunk_second").over(whole), F.nth_value("chunk_first", 2).over(whole)).alias("second"),
    ).filter(F.col("copies") > 1)
    return local.join(offsets, ["hash", "chunk"]).withColumn("n", (F.col("before") + F.col("local_n")).cast("int"))


def stored_items(items: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Items (path, label, line, node, hash) that have a text, written once."""
    return (scratch or Scratch(items.sparkSession)).stored(items.filter("hash IS NOT NULL"))


def clone_findings(items: DataFrame) -> DataFrame:
    """Findings on stored items."""
    detail = """CASE n WHEN 1 THEN concat('(duplicated in ', substring_index(second.path, '/', -1), ':', second.label, ')')
        WHEN 2 THEN concat('(duplicated from ', substring_index(first.path, '/', -1), ':', first.label, ')')
        ELSE concat('(', n, ' copies found across files)') END"""
    rows = numbered_copies(items).withColumn("detail", F.expr(detail))
    return emit(rows, [hit("DUP-001", "true", "MAJOR", "Duplicate code block in method '{label}' {detail}", "line", "node")])
