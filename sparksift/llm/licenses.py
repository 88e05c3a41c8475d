"""License scans: phrases in place, and an exact set-similarity join of text blocks with license templates.

A word is `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased text. A template is the set of its words without the function words below. A
block of a template is any run of as many words of a text as the template has, its function words counted, wherever lines end. Every
block is found that contains at least `CONTAINMENT` of a template's words.

The join is a prefix-filter join on words ordered by their number of documents, rarest first. A text that holds alpha = ceil(CONTAINMENT *
|T|) words of template T shares one of the first |T| - alpha + 1 words of T, within the first |B| - alpha + 1 of its own template words B; texts with fewer than
alpha are left out (length filter), and so are meetings at places that leave too few words for alpha common ones (positional filter). In the texts
that are left, the places of template words are counted exactly, in the block from each such place on. Templates are a fixed list, so their
side of the join is bounded; nothing else is broadcast. DataFrame functions only.

Defined cases: a null text is empty: no words, no labels, score 0. Rows with one id and one text share their answer, which each gets. Equal phrases
count each. The score is the largest containment reached, 1 where a base phrase stands.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import stored

# Phrases with their labels, templates, and words that templates leave out.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("mit", "released under the MIT license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the Apache License Version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the License you may obtain a copy of the License at apache org licenses"),
    ("gpl-3", "this work is licensed under the GNU General Public License version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the Mozilla Public License v 2 0"),
    ("cc-by-nc", "licensed under CC BY NC 4 0"),
    ("cc-by-sa", "this work is licensed under a Creative Commons Attribution ShareAlike 4 0 International License"),
]
LEFT_OUT = ["a", "and", "any", "are", "as", "at", "by", "can", "in", "is", "it", "may", "not", "of", "or", "that", "the", "this", "to", "use", "with", "you"]
CONTAINMENT = 0.8
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_sets() -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(re.sub(BETWEEN, " ", text.lower()).split()) - set(LEFT_OUT))) for label, text in TEMPLATES]


def block_lengths() -> list[int]:
    """Words of each template, all of them."""
    return [len(re.sub(BETWEEN, " ", text.lower()).split()) for _, text in TEMPLATES]


def least_common(n: int) -> int:
    return math.ceil(CONTAINMENT * n - 1e-9)


def plain(text: Column) -> Column:
    """The words of a text, one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), BETWEEN, " "))


def word_count(spaced: Column) -> Column:
    """Words of a text in which each has a space before and after."""
    return F.floor((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2)


def borders(words: list[str]) -> bool:
    return any(words[:k] == words[-k:] for k in range(1, len(words)))


def base_columns(words: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word, base_labels of a text given as `plain` leaves it."""
    spaced = F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" ")))
    n_words = F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long")
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        parts = phrase.split()
        if borders(parts):
            raise ValueError(f"places of {phrase!r} can overlap")
        wanted = " " + "  ".join(parts) + " "
        there = F.contains(spaced, F.lit(wanted))
        pieces = F.split(spaced, re.escape(wanted).replace("\\ ", " "), -1)
        places.append(F.when(there, F.size(pieces) - 1).otherwise(0))
        firsts.append(F.when(there, word_count(pieces[0])))
        lasts.append(F.when(there, n_words - word_count(F.element_at(pieces, -1)) - len(parts)))
        labels.append(F.when(there, F.lit(label)))
    return {
        "n_words": n_words,
        "n_base": sum(places[1:], places[0]).cast("long"),
        "first_word": F.array_min(F.array(*firsts)).cast("long"),
        "last_word": F.array_max(F.array(*lasts)).cast("long"),
        "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def scanned(docs: DataFrame, id_col: str, text_col: str, phrases: dict[str, str], vocabulary: list[str], least: int) -> DataFrame:
    """One row for each document: the base columns, its template words, and of those with `least` different ones the places (pos, w) of all."""
    known = F.array(*(F.lit(w) for w in vocabulary))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", plain(F.col("text")))
    found = rows.withColumn("found", F.array_intersect(F.split("words", " "), known))
    places = F.filter(F.transform(F.split("words", " "), lambda w, i: F.struct(i.alias("pos"), w.alias("w"))), lambda x: F.array_contains(known, x["w"]))
    marks = F.when(F.size("found") >= least, places).otherwise(F.array().cast("array<struct<pos:int,w:string>>"))
    return found.select("doc_id", F.xxhash64("text").alias("text_key"), *(c.alias(n) for n, c in base_columns(F.col("words"), phrases).items()), "found", marks.alias("marks"))


def contained(scan: DataFrame, templates: list[tuple[str, list[str]]], lengths: list[int]) -> DataFrame:
    """(doc_id, text_key, label, containment) of texts and the templates that a block of theirs contains."""
    spark = scan.sparkSession
    counts = {r.word: r.n for r in scan.select(F.explode("found").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # the words of templates only
    order = {w: k for k, w in enumerate(sorted({w for _, s in templates for w in s}, key=lambda w: (counts.get(w, 0), w)))}
    sets = [(k, label, sorted(order[w] for w in words)) for k, (label, words) in enumerate(templates)]
    prefixes = [(rank, k, i, len(s), least_common(len(s))) for k, _, s in sets for i, rank in enumerate(s[: len(s) - least_common(len(s)) + 1])]
    prefix = spark.createDataFrame(prefixes, "rank int, template int, i int, size int, alpha int")
    whole = spark.createDataFrame([(k, label, words, n) for k, ((label, words), n) in enumerate(zip(templates, lengths, strict=True))], "template int, label string, words array<string>, length int")
    ranks = F.create_map(*(F.lit(x) for w, k in order.items() for x in (w, k)))
    texts = scan.filter(F.size("marks") > 0).select("doc_id", "text_key", F.array_sort(F.transform("found", lambda w: F.element_at(ranks, w))).alias("b")).distinct()
    met = texts.select("doc_id", "text_key", F.size("b").alias("n"), F.posexplode("b").alias("j", "rank")).join(prefix, "rank")
    common = F.least("i", "j") + F.least(F.col("size") - F.col("i"), F.col("n") - F.col("j"))
    met = met.filter((F.col("n") >= F.col("alpha")) & (F.col("j") <= F.col("n") - F.col("alpha")) & (common >= F.col("alpha")))
    pairs = met.select("doc_id", "text_key", "template", "alpha").distinct().join(whole, "template")
    marked = scan.filter(F.size("marks") > 0).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "marks").dropDuplicates(["d", "k"])
    held = pairs.join(marked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    # a block that begins at a place of a word of the template has the words of the next places within its length
    own = held.withColumn("own", F.expr("filter(marks, m -> array_contains(words, m.w))"))
    block = "filter(slice(own, i + 1, length), y -> y.pos < x.pos + length)"
    best = own.withColumn("best", F.expr(f"array_max(transform(own, (x, i) -> size(array_distinct(transform({block}, y -> y.w)))))"))
    return best.filter(F.col("best") >= F.col("alpha")).select("doc_id", "text_key", "label", (F.col("best") / F.size("words")).alias("containment"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row."""
    templates = template_sets()
    vocabulary = sorted({w for _, s in templates for w in s})
    scan = stored(scanned(docs, id_col, text_col, phrases, vocabulary, min(least_common(len(s)) for _, s in templates)))
    found = contained(scan, templates, block_lengths()).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("own"), F.max("containment").alias("containment"))  # no more than there are labels
    found = found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "own", "containment")
    out = scan.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).cast("double")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
