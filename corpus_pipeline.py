"""A training corpus from raw documents: language filter, near duplicates, repeated passages, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept, read again from Parquet. All but the last return the
columns of documents, in their order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksift.llm import language, mixing, near_dedup, packing, substrings
from sparksift.session import ensure_checkpoint_dir
from sparksift.sources.tables import table

#: A document stays if its language is recognised with this score; one of fewer letters than this is too short to be rejected for its score.
LEAST_SCORE, SURE_LETTERS = 0.5, 40


def carried(docs: DataFrame) -> Column:
    """All columns of a row but the text as one, `row`: whatever they are called, they meet no column of a stage."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of `row`, those in `new` with their new values."""
    return rows.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a letter whose predicted language is certain enough; `lang` is the prediction.

    The model is fitted on the labelled rows of `docs`. If none are labelled nothing can be recognised, and no row stays.
    """
    rows = docs.select(carried(docs), "text")
    found = language.identify(rows, language.fit(docs))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & ((F.col("score") >= LEAST_SCORE) | (letters < SURE_LETTERS)))
    return unpacked(kept, docs.columns, text=F.col("text"), lang=F.col("lang_pred"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the smallest id."""
    return near_dedup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without words of repeated windows; `n_chars` follows the text."""
    found = substrings.remove_repeats(docs.select(carried(docs), "doc_id", "text"), keep=["row"])
    text = F.col("repeats.kept")
    n_chars = F.when(F.col("repeats.n_removed") > 0, F.length(text)).otherwise(F.col("row.n_chars")).cast("long")
    return unpacked(found, docs.columns, text=text, n_chars=n_chars)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed_rows(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a row, with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]

#: The tokenizer, the trained classifier and the seeded rounding have no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared checkpoint folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
