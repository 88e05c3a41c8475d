"""Scans of source trees and uploads; sinks for findings."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import null_to_dash

FILE_COLUMNS = ["path", "file_name", "content"]


def as_text(content: Column) -> Column:
    """Bytes read as UTF-8; what is malformed becomes U+FFFD, so one odd byte never ends a scan."""
    return F.make_valid_utf8(content.cast("string"))


# Names, and bytes of files, that a task hands on at once.
NAMES, BYTES = 10_000, 8 << 20


def local_root(folder: str) -> str | None:
    """The path in a ``file:`` address without wildcards, else null."""
    named = re.fullmatch(r"file:(?:///|/(?!/))([^{}\[\]*?\\]*)", folder)
    return named and "/" + re.sub("/+", "/", named[1]).strip("/")


def local_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, content) of the files below a folder that all executors see, as ``binaryFile`` has them: no empty ones, none that are hidden.

    Its index holds all names in the driver. Here one task walks the tree and hands the names on as it meets them, and as
    many tasks as a shuffle has read the files, so nothing grows with their number.
    """

    def walk(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa

        def hidden(name: str) -> bool:
            return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")

        def below() -> Iterator[str]:
            if os.path.isfile(root):
                yield root
            folders = [root] if os.path.isdir(root) else []
            while folders:
                with os.scandir(folders.pop()) as entries:
                    for entry in entries:
                        if entry.is_dir():
                            if not hidden(entry.name) or entry.name.startswith(("_common_metadata", "_metadata")):
                                folders.append(entry.path)
                        elif entry.is_file() and not hidden(entry.name):
                            yield entry.path

        for _ in batches:
            names = []
            for path in below():
                if path.endswith(suffix):
                    names.append(path)
                if len(names) == NAMES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])
                    names = []
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

        paths, contents, size = [], [], 0
        for names in batches:
            for path in names.column(0).to_pylist():
                with open(path, "rb") as source:
                    content = source.read()
                if not content:
                    continue
                paths.append(f"file:{path}")
                contents.append(content)
                size += len(content)
                if size >= BYTES or len(paths) == NAMES:
                    yield batch()
                    paths, contents, size = [], [], 0
        if paths:
            yield batch()

    names = spark.range(0, 1, 1, 1).mapInArrow(walk, "path string")
    return names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(read, "path string, content binary")


def scan_sources(spark: SparkSession, folder: str, suffix: str = ".java") -> DataFrame:
    """All files below a folder whose name ends with the suffix in exactly this case.

    A folder that does not exist yields an empty table. One that is given as ``file:`` is listed by a task, any other by the driver.
    """
    root = local_root(folder)
    if root and not re.search(r"[{}\[\]*?\\]", suffix):
        return with_text(local_files(spark, root, suffix))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    try:
        found = reader.load(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, file_name string, content string")
    return with_text(found)


def with_text(found: DataFrame) -> DataFrame:
    return found.select("path", F.substring_index("path", "/", -1).alias("file_name"), as_text(F.col("content")).alias("content"))


def uploaded_sources(uploads: DataFrame, suffix: str = ".java") -> DataFrame:
    """Uploads named like sources in any case; of equal names the last upload stays.

    A maximum per name combines before the shuffle, so a name uploaded a million
    times does not gather in one task.
    """
    kept = uploads.filter(F.col("name").isNotNull() & F.lower("name").endswith(suffix))
    last = F.max(F.struct("upload_ord", "content")).alias("last")
    return kept.groupBy("name").agg(last).select(
        F.col("name").alias("path"), F.col("name").alias("file_name"), F.col("last.content").alias("content"),
        F.col("last.upload_ord").alias("upload_ord"),
    )


# Shown columns of the exported table, in order.
EXPORT = ["severity", "rule_id", "type", "file_name", "line_number", "message", "suggestion"]


def write_json(findings: DataFrame, folder: str) -> None:
    """One JSON object per finding and line, with the de-duplication key as ninth property."""
    key = F.concat_ws(
        ":", "file_name", F.col("line_number").cast("string"), "type", F.coalesce(F.col("rule_id"), F.lit("null"))
    )
    findings.select(
        "type", "message", "severity", F.col("file_name").alias("fileName"), F.col("line_number").alias("lineNumber"),
        F.col("rule_id").alias("ruleId"), "category", "suggestion", key.alias("deduplicationKey"),
    ).write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def write_csv(findings: DataFrame, folder: str) -> None:
    """Shown columns with a header, every field quoted and quotes doubled."""
    shown = [null_to_dash(F.col(c).cast("string")).alias(c) for c in EXPORT]
    findings.select(*shown).write.mode("overwrite").options(header=True, quoteAll=True, escape='"').csv(folder)
