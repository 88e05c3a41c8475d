"""Rules that hold for any text, applied to document tables.

A document is a file here: its path is ``source/id``, its lines are the lines of
the text. All rules and the hash of the clone rule come from one projection over
the texts, which is stored: a full audit reads a table of texts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import SENSITIVE_TERMS
from ..config import AuditConfig
from ..functions import text as tx
from ..functions.sql import contains_any, quote
from ..storage import Scratch
from .clones import clone_findings, stored_items
from .findings import emit, exploded, findings_union, found_array, hit
from .rules import file_hits, measured_files

# A word that a quoted text is given to. It starts where a word starts and gives nothing back, so a long line takes time in proportion to its
# length; whether the word holds a sensitive term is asked afterwards.
SECRET = r'(?<![A-Za-z0-9_])([A-Za-z0-9_]++)[ \t]*+=[ \t]*+"[^"\n]*+"'
# Four numbers with nothing of a number or an address on either side.
ADDRESS = r"(?<![0-9.])([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?!\.?[0-9])"
# What a line must hold to be searched at all; cheap to look for.
SECRET_SIGN = r'=[ \t]*"'
ADDRESS_SIGN = r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"


def document_files(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")
    )


def line_matches(pattern: str, sign: str) -> str:
    """SQL for all matches in ``content`` as an array of (line, nth, match), in reading order."""
    numbered = "transform(split(content, '\\n'), (text, at) -> named_struct('line', at + 1, 'text', text))"
    signed = f"filter({numbered}, x -> x.text RLIKE {quote(sign)})"
    found = f"transform(regexp_extract_all(x.text, {quote(pattern)}, 1), (m, nth) -> named_struct('line', x.line, 'nth', nth, 'match', m))"
    nothing = "CAST(array() AS array<struct<line: int, nth: int, match: string>>)"
    return f"CASE WHEN content RLIKE {quote(sign)} THEN flatten(transform({signed}, x -> {found})) ELSE {nothing} END"


SECRET_HIT = hit("SEC-001", contains_any("lower(m.match)", SENSITIVE_TERMS), "CRITICAL", "Hardcoded sensitive value -> {m.match}", "m.line", "m.nth")
ADDRESS_HIT = hit(
    "SEC-012", "m.match NOT LIKE '127.%' AND m.match <> '0.0.0.0'", "MAJOR", 'Hardcoded IP address -> "{m.match}"', "m.line", "m.nth"
)


def hits_of(matches: str, found: str) -> str:
    return f"array_compact(transform({matches}, m -> {found}))"


def secret_findings(files: DataFrame) -> DataFrame:
    return emit(files, many=[hits_of(line_matches(SECRET, SECRET_SIGN), SECRET_HIT)])


def address_findings(files: DataFrame) -> DataFrame:
    return emit(files, many=[hits_of(line_matches(ADDRESS, ADDRESS_SIGN), ADDRESS_HIT)])


def text_items(files: DataFrame, *keep: str) -> DataFrame:
    """Whole texts as items to compare; the label is the file name."""
    return files.select(
        *keep, "path", F.substring_index("path", "/", -1).alias("label"), F.lit(1).alias("line"), F.lit(0).cast("long").alias("node"),
        tx.content_hash(F.col("content")).alias("hash"),
    )


def text_clones(files: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    return clone_findings(stored_items(text_items(files), scratch))


def text_maintainability(files: DataFrame, complexity: int = 1) -> DataFrame:
    """Lines, words and maintainability index of each text, taken as one straight body."""
    measured = files.select(
        "path", tx.code_lines(F.col("content")).alias("body_lines"), tx.code_words(F.col("content")).alias("body_words")
    )
    index = tx.maintainability(F.col("body_words"), F.lit(complexity), F.col("body_lines"))
    return measured.withColumn("mi", index)


def low_maintainability(files: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Texts below grade A, with the grade and severity of the finding."""
    grade: Column = tx.maintainability_grade(F.col("mi"), cfg.maintainability_grade_a, cfg.maintainability_grade_b)
    graded = text_maintainability(files).withColumn("grade", grade).filter(F.col("grade") != "A")
    return graded.withColumn("severity", F.when(F.col("grade") == "B", "MINOR").otherwise("MAJOR"))


def text_audit(files: DataFrame, cfg: AuditConfig = AuditConfig(), scratch: Scratch | None = None) -> DataFrame:
    """All text rules on a document table, before de-duplication."""
    single, many = [], []
    if cfg.enable_security:
        many = [hits_of(line_matches(SECRET, SECRET_SIGN), SECRET_HIT), hits_of(line_matches(ADDRESS, ADDRESS_SIGN), ADDRESS_HIT)]
    if cfg.enable_metrics:
        single = list(file_hits(cfg).values())
    measured = measured_files(files) if single else files
    if not cfg.enable_duplication:
        return emit(measured, single, many)
    if not single and not many:
        return text_clones(files, scratch)
    rows = measured.withColumn("found", F.expr(found_array(single, many)))
    seen = (scratch or Scratch(files.sparkSession)).stored(text_items(rows, "found"))
    return findings_union([exploded(seen.filter("size(found) > 0"), "found"), clone_findings(seen)])
