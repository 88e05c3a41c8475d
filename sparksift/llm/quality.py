"""Quality rules: fixed limits, then robust multivariate outliers within each language and source.

Every document has a vector of five transformed statistics: log of its words, log of its mean word length, and the logs of 1 + 20 times its shares of
symbols, of repeated lines and of words in repeated windows. For each group (language, source) the minimum covariance determinant estimate
of centre and scatter is found by concentration steps: take the `SUBSET` of the group's documents with the smallest distances, estimate again from those. Every
group has several starts, its medians and quartile ranges and `DRAWS` draws of `DRAWN` documents by hash. After `FIRST` steps the start of the least
determinant goes on, until its determinant falls no more (`MOST_STEPS` at most). A document is rejected if its squared Mahalanobis distance exceeds the
chi-squared quantile of `LEVEL`.

All of it is over all documents. A step is one aggregation of counts, sums and products by group and band of distance, which combines before the
shuffle, so a group with a third of all rows is a few hundred rows afterwards. Bands are 1/8 of a power of two wide: the subset is `SUBSET` of the
rows, or up to a band more. The scatter gets `FLOOR` squared on its diagonal, as most clean documents have no symbols or repeats at all.

Defined cases: groups of fewer than `LEAST` documents with words are pooled by language, pools that are still smaller over all, and if that is small too its
documents are only held against the fixed limits. Null language or source is a value of its own. A null text has no words; it fails the first limit. Rows
with one id are judged each on its own. Columns of the input are not used beyond id, text, language and source, so others may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored
from .text_arrays import IS_SPACE, Texts, Words, rolling, slices, span_hashes, texts_of, windows_inside, words_of

MIN_WORDS, MOST_REPEATED, REPEAT_WINDOW = 20, 30, 8
SUBSET, LEAST, LEVEL = 0.75, 60, 0.999
DRAWS, DRAWN, FIRST, MOST_STEPS = 3, 12, 2, 12
FLOOR = np.array([0.1, 0.05, 0.1, 0.4, 0.4])  # beside a centre of 0, shares over 2.9 % of symbols or 25.6 % of repeats reject alone
DIMENSIONS = len(FLOOR)
FINE = 64  # bins of a statistic for medians and quartiles: 1 / FINE
SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def line_counts(texts: Texts, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the lines with a word, and those of them equal to an earlier line."""
    data, offsets, n = texts.data, texts.offsets, len(texts)
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1, [len(data)]]))
    line = np.unique(np.searchsorted(cuts, words.starts, "right") - 1)  # only lines with a word
    a, b = cuts[line], cuts[line + 1] if len(line) else cuts[line]
    b = b - ((b > a) & (data[b - 1] == 10)) if len(line) else b
    text = np.searchsorted(offsets, a, "right") - 1
    h = span_hashes(data, a, b)
    order = np.lexsort((h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text, minlength=n), np.bincount(text[order][1:][same], minlength=n)


def repeated_words(words: Words, n_texts: int, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Of each text, the words in windows of k words that it holds twice or more."""
    at = np.flatnonzero(windows_inside(words, k))
    h, text = rolling(words.hashes, k)[at], words.text[at]
    order = np.lexsort((h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    hit = np.zeros(len(at), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(cover, at[hit], 1)
    np.add.at(cover, at[hit] + k, -1)
    return sums(np.cumsum(cover[:-1]) > 0, words.first)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = texts_of(batch.column(3))
        words = words_of(texts)
        lines, repeated_lines = line_counts(texts, words)
        counts = [
            np.diff(words.first),
            sums(~IS_SPACE[texts.data] & ((texts.data & 0xC0) != 0x80), texts.offsets),
            sums(IS_SYMBOL[texts.data], texts.offsets),
            lines,
            repeated_lines,
            repeated_words(words, len(texts)),
        ]
        yield pa.record_batch([*batch.columns[:3], *(pa.array(c.astype(np.int64)) for c in counts)], ["doc_id", "lang", "source", *COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(counted, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    n = F.greatest("n_words", F.lit(1))
    share = lambda part, whole: F.log1p(20 * F.col(part) / F.greatest(whole, F.lit(1)))
    vector = [F.log1p("n_words"), F.log1p(F.col("word_chars") / n), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counts.select("*", F.array(*vector).alias("x"), failed.alias("base_failed"))


def groups(stats: DataFrame) -> DataFrame:
    """(lang, source, group): the group of each pair, null where there are too few documents to judge."""
    sizes = stats.groupBy("lang", "source").agg(F.sum(F.when(F.col("n_words") > 0, 1).otherwise(0)).alias("n"))
    small = F.col("n") < LEAST
    by_lang = F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("lang"))
    pooled = sizes.withColumn("pool", F.when(small, by_lang))
    rest = small & (F.col("pool") < LEAST)
    left = F.sum(F.when(rest, F.col("n"))).over(Window.partitionBy())
    name = (
        F.when(~small, F.to_json(F.struct(F.lit(2).alias("level"), "lang", "source")))
        .when(~rest, F.to_json(F.struct(F.lit(1).alias("level"), "lang")))
        .when(left >= LEAST, F.lit("all"))
    )
    return pooled.select(F.col("lang").alias("l"), F.col("source").alias("s"), name.alias("group"))


ESTIMATE = "group string, start int, logdet double, centre array<double>, whiten array<double>"


def triangle(d: int = DIMENSIONS) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def whitened(scatter: np.ndarray) -> list[float]:
    inverse = np.linalg.inv(np.linalg.cholesky(scatter + np.diag(FLOOR**2)))
    return [float(inverse[i, j]) for i, j in triangle()]


def estimate(group: str, start: int, centre: np.ndarray, scatter: np.ndarray) -> dict:
    return {
        "group": group, "start": start, "logdet": float(np.linalg.slogdet(scatter + np.diag(FLOOR**2))[1]), "centre": [float(c) for c in centre], "whiten": whitened(scatter)
    }


def started(frame: pd.DataFrame) -> pd.DataFrame:
    """Medians and quartile ranges from the counts of a group's bins (group, k, bin, n)."""
    centre, spread = [], []
    for k in range(DIMENSIONS):
        part = frame[frame.k == k].sort_values("bin")
        below = part.n.cumsum().to_numpy()
        low, middle, high = (part.bin.to_numpy()[np.searchsorted(below, q * below[-1])] / FINE for q in (0.25, 0.5, 0.75))
        centre.append(float(middle))
        spread.append(((high - low) / 1.349) ** 2)
    return pd.DataFrame([estimate(frame.group.iloc[0], 0, np.array(centre), np.diag(spread))])


def drawn(frame: pd.DataFrame) -> pd.DataFrame:
    """Means and scatters of the documents drawn of a group (group, slot, d1, ...)."""
    out = []
    for k in range(1, DRAWS + 1):
        x = np.array([row["x"] for row in frame[f"d{k}"]])
        out.append(estimate(frame.group.iloc[0], k, x.mean(0), np.cov(x.T, bias=True)))
    return pd.DataFrame(out)


def concentrated(frame: pd.DataFrame) -> pd.DataFrame:
    """Centre and scatter of the nearest bands that hold `SUBSET` of a group."""
    frame = frame.sort_values("band")
    below = frame.n.cumsum().to_numpy()
    used = frame.iloc[: int(np.searchsorted(below, SUBSET * below[-1])) + 1]
    n = float(used.n.sum())
    mean = np.array([used[f"s{i}"].sum() / n for i in range(DIMENSIONS)])
    scatter = np.zeros((DIMENSIONS, DIMENSIONS))
    for i, j in triangle():
        scatter[i, j] = scatter[j, i] = used[f"p{i}_{j}"].sum() / n - mean[i] * mean[j]
    values, vectors = np.linalg.eigh(scatter)  # rounding may leave it a little below zero
    scatter = (vectors * np.maximum(values, 0)) @ vectors.T
    return pd.DataFrame([estimate(frame.group.iloc[0], int(frame.start.iloc[0]), mean, scatter * consistency(SUBSET))])


def chi_squared(x: float, d: int) -> float:
    """The chi-squared distribution function, by the series of the lower incomplete gamma function."""
    a, half = d / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= half / k
        total += term
    return min(1.0, math.exp(-half + a * math.log(half) - math.lgamma(a)) * total)


def quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared(middle, d) < p else (low, middle)
    return low


def consistency(share: float) -> float:
    """What the scatter of the nearest `share` of normal rows lacks."""
    return share / chi_squared(quantile(share, DIMENSIONS), DIMENSIONS + 2)


def squared_distance() -> Column:
    delta = [F.col("x")[i] - F.col("centre")[i] for i in range(DIMENSIONS)]
    place = {ij: k for k, ij in enumerate(triangle())}
    rows = [sum((F.col("whiten")[place[i, j]] * delta[j] for j in range(1, i + 1)), F.col("whiten")[place[i, 0]] * delta[0]) for i in range(DIMENSIONS)]
    return sum((r * r for r in rows[1:]), rows[0] * rows[0])


def starts(rows: DataFrame) -> DataFrame:
    """The estimates that each group begins with."""
    bins = rows.select("group", F.posexplode("x").alias("k", "v")).groupBy("group", "k", F.floor(F.col("v") * FINE).alias("bin")).agg(F.count("*").alias("n"))
    # of the rows of a slot the one with the smallest hash, another for each draw
    draws = [F.min(F.struct(F.xxhash64("x", F.lit(k)).alias("h"), "x")).alias(f"d{k}") for k in range(1, DRAWS + 1)]
    slots = rows.groupBy("group", F.pmod(F.xxhash64("x"), F.lit(DRAWN)).alias("slot")).agg(*draws)
    return bins.groupBy("group").applyInPandas(started, ESTIMATE).unionByName(slots.groupBy("group").applyInPandas(drawn, ESTIMATE))


def step(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The estimates from the documents nearest to each of the estimates `found`."""
    products = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(DIMENSIONS)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in triangle()]
    band = F.floor(8 * F.log2(squared_distance() + 2.0**-20))
    banded = rows.join(found, "group").groupBy("group", "start", band.alias("band")).agg(F.count("*").alias("n"), *products)
    return stored(banded.groupBy("group", "start").applyInPandas(concentrated, ESTIMATE))


def estimates(rows: DataFrame) -> DataFrame:
    """(group, centre, whiten) of rows (group, x): the lower triangle `whiten` makes the distance a plain one."""
    found = stored(starts(rows))
    for _ in range(FIRST):
        found = step(rows, found)
    best = found.groupBy("group").agg(F.min(F.struct("logdet", "start", "centre", "whiten")).alias("b")).select("group", "b.*")
    for _ in range(MOST_STEPS):
        new = step(rows, best).select("group", *(F.col(c).alias(f"new_{c}") for c in ("start", "logdet", "centre", "whiten")))
        lower = F.col("new_logdet") < F.col("logdet") - 1e-6
        both = stored(best.join(new, "group").withColumn("lower", lower))
        best = both.select("group", *(F.when(F.col("lower"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("start", "logdet", "centre", "whiten")))
        if not both.filter("lower").count():
            break
    return best.select("group", "centre", "whiten")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", level: float = LEVEL) -> DataFrame:
    """(doc_id, lang, source, the counts, base_failed, distance, kept) of each row; distance is null where a group is too small."""
    stats = stored(statistics(docs, id_col, text_col, lang_col, source_col))
    named = stats.join(groups(stats), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s")
    named = stored(named)
    found = estimates(named.filter("group is not null and n_words > 0").select("group", "x"))
    distance = named.join(found, "group", "left").withColumn("distance", squared_distance())
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= quantile(level, DIMENSIONS)))
    return distance.select("doc_id", "lang", "source", *COUNTS, "base_failed", "distance", kept.alias("kept"))
