"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts is the number of character n-grams (n = 1 to 3, of the lower-cased text in which every run of
other characters than letters is one space) that both contain, divided by the root of the product of their own numbers. N-grams are those
of the landmark texts, so a text is a row of zeros and ones over this vocabulary, and the kernel between a batch of texts and all
landmarks is one matrix product. Nyström features are that product times the inverse root of the landmarks' own kernel matrix; one-versus-rest
kernel ridge regression on them has a closed form. Prediction is batched matrix products only.

Fitting takes a bounded sample: `PER_LANGUAGE` different labelled texts of each language, those with the smallest hash of id and text, as far as `SAMPLE_BYTES`
bytes of text a language go, and one at least. `LANDMARKS` of all of them are landmarks, two of each language at least. The label counts that set the
sample's threshold are of all labelled rows. The `LANGUAGES` most frequent languages are learned, of equal ones those first by code point. Fitting reads the table twice.

Defined cases: text null or without a letter (Unicode category L) gives `und` with score 0. If there is no labelled row, every text with a letter is `und` too. Equal scores
go to the language that comes first by code point. A null id counts as the empty string, whose remainder is 0. Rows are neither dropped nor merged.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

PER_LANGUAGE, LANDMARKS, LANGUAGES, RIDGE = 300, 160, 400, 1e-2
SAMPLE_BYTES = 4 << 20
NGRAMS = 3
BUCKET_BITS = 18
BATCH = 64
UNKNOWN = "und"
OTHER = re.compile(r"[\W\d_]+")
# word characters that are neither letters nor digits, such as one half and Roman numerals; in classes of their own, which are tables only without categories
# and without characters beyond the first plane
_NUMERALS = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No")]
NUMBERS, BEYOND = re.compile(f"[{''.join(c for c in _NUMERALS if c < chr(0x10000))}]"), re.compile("[\U00010000-\U0010ffff]")
NUMBERS_BEYOND = re.compile(f"[{''.join(c for c in _NUMERALS if c >= chr(0x10000))}]")
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def normal(text: str | None) -> str:
    low = (text or "").lower()
    if not low.isascii():
        low = NUMBERS.sub(" ", low)
        if BEYOND.search(low):
            low = NUMBERS_BEYOND.sub(" ", low)
    return OTHER.sub(" ", low).strip()


def gram_buckets(text: str) -> list[np.ndarray]:
    """Buckets of all n-grams of a normalised text, one array for each n; each n has buckets of its own."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(NGRAMS):
        h = (h[: len(codes) - n] if n == 0 else h[:-1]) + codes[n:] * FACTORS[n]
        mixed = (h ^ (h >> np.uint64(29))) * FACTORS[0]
        out.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + (n << BUCKET_BITS))
    return out


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # bucket -> vocabulary column; the last column is for buckets that no landmark has
    landmarks: np.ndarray  # vocabulary x landmarks, scaled so that the product is the kernel but for the text's own norm
    features: np.ndarray  # landmarks x features
    weights: np.ndarray  # features and 1 x languages

    def kernel(self, texts: list[str]) -> np.ndarray:
        present = np.zeros((len(texts), len(self.landmarks) + 1), np.float32)
        for i, text in enumerate(texts):
            for buckets in gram_buckets(text):
                present[i, self.column[buckets]] = 1
        present = present[:, :-1]
        norm = np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
        return (present @ self.landmarks) / norm

    def scores(self, texts: list[str]) -> np.ndarray:
        phi = self.kernel(texts) @ self.features
        return phi @ self.weights[:-1] + self.weights[-1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        languages, best = [UNKNOWN] * len(texts), [0.0] * len(texts)
        clean = [normal(t) for t in texts]
        some = [i for i, t in enumerate(clean) if t] if self.languages else []
        for a in range(0, len(some), BATCH):
            part = some[a : a + BATCH]
            scores = self.scores([clean[i] for i in part])
            for i, row in zip(part, scores, strict=True):
                top = int(row.argmax())
                languages[i], best[i] = self.languages[top], float(min(max(row[top], 0.0), 1.0))
        return languages, best


def fitted(texts: list[str], labels: list[str], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model of labelled texts; landmarks are taken in turn from the languages."""
    rows = [(normal(t), y) for t, y in zip(texts, labels, strict=True)]
    rows = [(t, y) for t, y in rows if t]
    languages = sorted({y for _, y in rows})
    turn: dict[str, int] = {}
    place = []
    for k, (_, y) in enumerate(rows):
        turn[y] = turn.get(y, -1) + 1
        place.append((turn[y], y, k))
    chosen = [rows[k][0] for _, _, k in sorted(place)[: max(n_landmarks, 2 * len(languages))]]
    used = np.zeros(NGRAMS << BUCKET_BITS, bool)
    grams = [np.unique(np.concatenate(gram_buckets(t))) for t in chosen]
    for g in grams:
        used[g] = True
    size = int(used.sum())
    column = np.full(len(used), size, np.int32)
    column[used] = np.arange(size)
    matrix = np.zeros((size, len(chosen)), np.float32)
    for j, g in enumerate(grams):
        matrix[column[g], j] = 1 / np.sqrt(len(g))
    values, vectors = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
    good = values > 1e-6 * max(values.max(initial=0), 1e-12)
    features = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
    model = Model(languages, column, matrix, features, np.zeros((features.shape[1] + 1, len(languages)), np.float32))
    if rows:
        phi = np.concatenate([model.kernel([t for t, _ in rows[a : a + BATCH]]) @ features for a in range(0, len(rows), BATCH)]).astype(np.float64)
        target = np.array([[float(y == z) for z in languages] for _, y in rows])
        # each language weighs the same, however many rows it has
        share = np.sqrt(1 / (target.sum(0) @ target.T)[:, None])
        phi = np.hstack([phi, np.ones((len(phi), 1))])
        left = (phi * share).T @ (phi * share)
        left[np.arange(len(left) - 1), np.arange(len(left) - 1)] += ridge
        model.weights = np.linalg.solve(left + 1e-9 * np.eye(len(left)), (phi * share).T @ (target * share)).astype(np.float32)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[str, str]]:
    """A sample of at most `per_language` labelled texts of each language that have a letter and aren't held out."""
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")
    )
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("lang").cast("binary")).limit(LANGUAGES).collect()
    if not counts:
        return []
    # hashes up to a threshold: of each language about four times as many rows as are wanted
    low = []
    for r in counts:
        share = min(1.0, 4 * per_language / r.n)
        low += [F.lit(r.lang), F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1)]
    few = rows.filter(F.col("h") <= F.create_map(*low)[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    ranked = few.withColumn("n", F.row_number().over(order)).withColumn("bytes", F.sum(F.octet_length("text")).over(order))
    sample = ranked.filter((F.col("n") == 1) | (F.col("n") <= per_language) & (F.col("bytes") <= SAMPLE_BYTES)).select("lang", "n", "text").collect()
    return [(r.text, r.lang) for r in sorted(sample, key=lambda r: (r.lang, r.n))]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    sample = training_rows(docs, id_col, text_col, lang_col, per_language)
    return fitted([t for t, _ in sample], [y for _, y in sample])


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of `docs` with the two predictions; columns of these names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (lang, score)]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                languages, scores = held.value.predict(part.column(at).to_pylist())
                yield pa.record_batch([*part.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, lang, score])

    picked = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = StructType([*picked.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    return picked.mapInArrow(run, schema)
