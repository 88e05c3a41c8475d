"""Operators on documents, against plain Python and on odd inputs."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from sparksift.llm import language, licenses, mixing, near_dedup, packing, quality, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, id int"


@pytest.fixture(scope="module")
def rows():
    """Few common words, so that passages repeat; copies, near copies, nulls, blanks, long and one-word texts, a repeated row."""
    rng = random.Random(5)
    base = " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(300))
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    texts = [None, "", "  \n\t ", "one", "one", "two words", base, base, passage, "é ü ß 日本 " * 40, "a " * 3000, "x" * 50_000]
    for k in range(30):
        words = [f"w{rng.randrange(40 if k % 3 else 10**6)}" for _ in range(rng.randrange(1, 400))]
        texts.append(" ".join(words))
        if k % 4 == 0:
            near = list(words)
            for _ in range(max(1, len(words) // 120)):
                near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
        if k % 5 == 0:
            texts.append(" ".join(words[: len(words) // 2]) + "\n" + passage + "\n" + " ".join(words[len(words) // 2 :]))
    out = [(i, t, ["en", "de", None][i % 3], ["s1", None, "s2", "é"][i % 4], 0, "extra", 1) for i, t in enumerate(texts)]
    return [*out, out[12]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_classes(docs, rows):
    got = near_dedup.near_classes(docs).collect()
    want = brute.near_classes([(r[0], r[1]) for r in rows])
    assert {r.id: r.class_id for r in got} == want
    assert all(r.kept == (r.id == r.class_id) for r in got)


def test_one_of_each_keeps_columns_and_one_row(docs, rows):
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    want = brute.near_classes([(r[0], r[1]) for r in rows])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_large_group_of_near_copies(spark):
    """Members that are too far from the hub still join, over other members."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(200)]
    texts, now = [], list(words)
    for _ in range(60):  # a chain: each differs a little from the one before
        now = list(now)
        now[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(now))
    rows = list(enumerate(texts))
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.id: r.class_id for r in got.collect()} == brute.near_classes(rows)


def test_large_bucket_of_a_shared_passage(spark):
    """Texts that are mostly one passage meet in large buckets; only real links join them."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join([f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 40))] + passage)) for i in range(150)]
    rows += [(200 + i, t + " end") for i, t in rows[:40:3]]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.id: r.class_id for r in got.collect()} == brute.near_classes(rows)


@pytest.mark.parametrize("texts", [["one text alone"], ["a b c d e f"] * 3, ["a b c d e f", "g h i j k l", "m n"], [None, ""]])
def test_no_candidate_pairs(spark, texts):
    """One document, only exact copies, all different, no words: there is no bucket to open."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute.near_classes(list(enumerate(texts)))
    assert {r.id: r.class_id for r in near_dedup.near_classes(docs).collect()} == want
    assert sorted(r.doc_id for r in near_dedup.one_of_each(docs).collect()) == sorted(set(want.values()))


def test_texts_of_null_and_repeated_ids(spark):
    """Each distinct text is held against the others; only rows whose class keeps another row go."""
    text = lambda c, *more: " ".join([*(f"{c}{k}" for k in range(60)), *more])
    a, b, c, x, y = map(text, "abcxy")
    rows = [(None, a), (None, b), (None, b), (None, None), (None, None), (1, c), (7, x), (7, y), (7, y), (9, text("y", "end")), (None, text("c", "end")), (8, text("x", "end"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert got == {None: None, 1: 1, 7: 7, 8: 7, 9: 7}
    kept = sorted((str(r.doc_id), str(r.text)) for r in near_dedup.one_of_each(docs).collect())
    assert kept == sorted((str(i), str(t)) for i, t in [(None, a), (None, b), (None, None), (None, None), (1, c), (7, x), (7, y)])


def test_links_whatever_the_counts(spark):
    """A few shingles occur often in one text and once in the other; sets are the same or nearly so."""
    rows = []
    for i in range(60):
        words = [f"t{i}w{k}" for k in range(100)]
        often = " ".join([" ".join(words[:40])] * 40)  # some joints more
        rows += [(2 * i, " ".join(words)), (2 * i + 1, f"{often} {' '.join(words[40:])}")]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute.near_classes(rows)
    assert len(set(want.values())) == 60
    assert {r.id: r.class_id for r in got.collect()} == want


def test_bands_have_those_of_unit_weights():
    rng = np.random.default_rng(2)
    value = np.sort(rng.integers(1, 1 << 62, 100, dtype=np.uint64))
    text, twice = np.repeat([0, 2], 100), np.concatenate([value, value])
    count = np.concatenate([np.ones(100, int), np.where(np.arange(100) < 30, 1000, 1)])
    bands, used = near_dedup.all_bands(text, twice, count, 3)
    plain, other = ({*bands[k][used[k]].tolist()} for k in (0, 2))
    assert len(plain) == near_dedup.BANDS and plain <= other and not used[1].any()
    assert len(other) == used[2].sum()


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    value = rng.integers(1, 1 << 62, 120, dtype=np.uint64)
    text = np.repeat([0, 1], [100, 100])
    both = np.concatenate([value[:100], value[20:]])
    count = rng.integers(1, 5, 200)
    signature = near_dedup.signatures(text, both, near_dedup.weights(count), 2, 4096)
    a, b = np.argsort(both[:100]), np.argsort(both[100:])
    expected = near_dedup.similarity(both[:100][a], count[:100][a], both[100:][b], count[100:][b])
    assert abs((signature[0] == signature[1]).mean() - expected) < 0.04


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.integers(0, 3), st.integers(0, 3)), min_size=1, unique_by=lambda x: x[0]))
def test_exact_similarity(items):
    x, y = {k: a for k, a, _ in items if a}, {k: b for k, _, b in items if b}
    arrays = [(np.array(sorted(map(ord, s)), np.uint64), np.array([s[k] for k in sorted(s)], np.uint32)) for s in (x, y)]
    assert near_dedup.similarity(*arrays[0], *arrays[1]) == pytest.approx(brute.probability_jaccard(x, y))


@pytest.mark.parametrize("bits", [27, 6])
def test_remove_repeats(docs, rows, bits):
    """Exact whatever the sketch rules out: with 64 cells it rules out nothing."""
    got = substrings.remove_repeats(docs, keep=["doc_id"], bits=bits).collect()
    want = brute.remove_repeats({(r[0], r[1]) for r in rows})
    assert len(got) == len(rows)
    for r in got:
        assert (r.repeats.n_words, r.repeats.n_removed, r.repeats.kept_sha256) == want[r.doc_id]


def test_remove_repeats_keeps_columns_and_texts(docs, rows):
    out = substrings.remove_repeats(docs)
    assert out.columns == [c for c in docs.columns if c != "text"] + ["repeats"]
    texts = {r[0]: r[1] for r in rows}
    for r in out.collect():
        if not r.repeats.n_removed:
            assert r.repeats.kept == texts[r.doc_id]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, language.fit(docs)).filter(language.held_out()).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_odd_inputs(docs, empty):
    model = language.fitted(["der die das und", "the of and with"], ["de", "en"])
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[0].score == 0
    assert got[3].lang_pred in ("de", "en")
    assert language.identify(empty, model).count() == 0
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_language_needs_a_letter(spark):
    model = language.fitted(["der die das und", "the of and with"], ["de", "en"])
    assert model.predict(["½", "²", "Ⅷ", "12 ¾ ٣", "_", "ª", "漢"])[0][:5] == ["und"] * 5
    assert all(x != "und" for x in model.predict(["ª", "漢"])[0])
    docs = spark.createDataFrame([(None, "a"), (5, "b")], "doc_id long, text string")
    assert {r.h for r in docs.select(language.held_out().alias("h")).collect()} <= {True, False}


def test_language_sample(spark, monkeypatch):
    rows = [(k if k % 11 else None, f"text {chr(97 + k % 26)}{k}" if k % 2 else "same text", "abc"[k % 3] if k % 7 else None) for k in range(400)]
    rows += [(k, "long " * 1000, "big") for k in range(400, 420)] + [(k, "12", "numbers") for k in range(420, 440)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "SAMPLE_BYTES", 6000)
    sample = language.training_rows(docs, "doc_id", "text", "lang", 5)
    count = {lang: sum(y == lang for _, y in sample) for lang in ("a", "b", "c", "big", "numbers")}
    assert count == {"a": 5, "b": 5, "c": 5, "big": 1, "numbers": 0}
    assert sample == language.training_rows(docs.repartition(7), "doc_id", "text", "lang", 5)
    monkeypatch.setattr(language, "LANGUAGES", 2)
    assert len({y for _, y in language.training_rows(docs, "doc_id", "text", "lang", 5)}) == 2  # more languages than are learned are no error


def test_language_against_plain_kernel_ridge():
    """With every text a landmark, Nystroem features give kernel ridge regression itself."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(words) for _ in range(8)) for words in (["der", "die", "und", "haus"], ["the", "and", "house", "of"]) for _ in range(12)]
    labels = ["de"] * 12 + ["en"] * 12
    model = language.fitted(texts, labels, n_landmarks=len(texts))
    grams = lambda t: {f" {t} "[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)}
    known = set().union(*map(grams, texts))
    kernel = lambda x, y: len(grams(x) & grams(y) & known) / np.sqrt(len(grams(x) & known) * len(grams(y)))
    k = np.array([[kernel(x, y) for y in texts] for x in texts])
    # ridge in the kernel's own feature space, with a free intercept and equal weight for each language
    values, vectors_ = np.linalg.eigh(k)
    phi = vectors_[:, values > 1e-6 * values.max()] * np.sqrt(values[values > 1e-6 * values.max()])
    x = np.hstack([phi, np.ones((len(texts), 1))]) / np.sqrt(12)
    target = np.array([[float(y == z) for z in ("de", "en")] for y in labels]) / np.sqrt(12)
    penalty = np.diag([language.RIDGE] * phi.shape[1] + [0.0])
    want = np.hstack([phi, np.ones((len(texts), 1))]) @ np.linalg.solve(x.T @ x + penalty, x.T @ target)
    assert np.abs(model.scores([language.normal(t) for t in texts]) - want).max() < 0.02


def test_language_never_sees_labels(docs):
    model = language.fit(docs)
    swapped = docs.drop("lang", "source")
    a = {r.text: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert a == {r.text: (r.lang_pred, r.score) for r in language.identify(swapped, model).collect()}


def test_mix(docs, rows, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)  # several levels of the tree
    monkeypatch.setattr(mixing, "FAN", 2)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, largest, target, taken = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        size[r.source] += r.size
        largest[r.source] = max(largest[r.source], r.size)
        target[r.source] = r.target
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.size == len(brute.words(dict((x[0], x[1]) for x in rows)[r.doc_id]))
    for s, t in brute.targets(size).items():
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    key = lambda r: (r.doc_id, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.repartition(3)).collect()))


def test_mixed_rows(docs, empty):
    drawn = mixing.mix(docs).collect()
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in drawn)
    assert mixing.mixed_rows(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_transfer_is_unbiased():
    """Over many seeds the first probability keeps its mean, and mass is kept each time."""
    total = 0.0
    for seed in range(4000):
        p, q = mixing.transfer((1, 30), (2, 70), 0.3, 0.6, seed)
        assert p in (0, 1) or q in (0, 1)
        assert 30 * p + 70 * q == pytest.approx(30 * 0.3 + 70 * 0.6)
        total += p
    assert total / 4000 == pytest.approx(0.3, abs=0.03)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abc", max_size=2) | st.none(), st.integers(0, 10**6), min_size=1))
def test_reference_targets_add_up(sizes):
    assert sum(brute.targets(sizes).values()) == pytest.approx(1.5 * sum(sizes.values()))


def best_fit(sizes, length):
    bins = []
    for size in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= size]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= size
        else:
            bins.append(length - size)
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([1, 8, 37, 64]), st.data())
def test_plan_is_best_fit_decreasing(length, data):
    sizes = data.draw(st.lists(st.integers(1, length), max_size=200))
    counts = {s: sizes.count(s) for s in set(sizes)}
    held, steps = defaultdict(list), defaultdict(list)
    for size, rank, first, offset in packing.plan(counts, length):
        steps[size].append((rank, first, offset))
    for size, n in counts.items():
        for r in range(n):
            rank, first, offset = max(s for s in steps[size] if s[0] <= r)
            held[first + r - rank].append((offset, size))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
    assert sorted(length - sum(s for _, s in p) for p in held.values()) == best_fit(sizes, length)


def test_pack(spark, docs, rows, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BUCKET_ROWS", 11)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    special = docs.limit(0).union(spark.createDataFrame([(999, "a<|endoftext|>b " + " " * 3000 + "c", "en", "s", 0, "", 0)], SCHEMA))
    got = packing.pack(docs.union(special), length=64).collect()
    texts = {r[0]: r[1] for r in rows} | {999: "a<|endoftext|>b " + " " * 3000 + "c"}
    bins, per_row = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        per_row[r.doc_id].append(r)
        ids = np.array([*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and 0 < r.length <= 64
        if r.piece:
            assert r.length == 64
    assert set(per_row) == set(texts)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    assert len(bins) == len(best_fit([r.length for r in got], 64))


def test_quality_counts(docs, rows):
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    for i, text, *_ in rows:
        w, t = brute.words(text), text or ""
        cover, seen = [False] * len(w), defaultdict(list)
        for a in range(len(w) - 7):
            seen[tuple(w[a : a + 8])].append(a)
        for at in seen.values():
            for a in at if len(at) > 1 else []:
                cover[a : a + 8] = [True] * 8
        lines = [x for x in t.split("\n") if brute.words(x)]
        r = got[i]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * sum(cover) > 30 * len(w))


def test_quality_rejects_outliers_only(spark):
    rng = random.Random(2)
    good = [(i, " ".join("w" * rng.randrange(2, 9) + str(rng.randrange(999)) for _ in range(rng.randrange(40, 400))), "en", "s") for i in range(200)]
    bad = [(1000 + i, " ".join(f"#*{rng.randrange(9999)}***$$$%%%" for _ in range(60)), "en", "s") for i in range(20)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i, *_ in good)
    assert not any(got[i].kept for i, *_ in bad)


def test_quality_rejects_by_one_statistic(spark):
    """A twelfth of symbols, or lines of which half are repeated, and nothing else of note."""
    rng = random.Random(4)
    line = lambda: " ".join("w" * rng.randrange(2, 9) + str(rng.randrange(999)) for _ in range(12))
    good = [(i, "\n".join(line() for _ in range(rng.randrange(6, 30))), "en", "s") for i in range(200)]
    symbols = [(1000 + i, "\n".join(line().replace(" ", " | ").replace("| ", "", 5) for _ in range(12)), "en", "s") for i in range(10)]
    repeats = [(2000 + i, "\n".join(line() + "\nread more" for _ in range(12)), "en", "s") for i in range(10)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(good + symbols + repeats, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(got[i].kept for i, *_ in good)
    assert not any(got[i].kept for i, *_ in symbols + repeats)


def determinant_by_hand(x, tries=40):
    """The least log determinant of the scatter of 75 % of the rows, with the floor, by plain concentration from many random starts."""
    rng, best = np.random.default_rng(0), np.inf
    h = -(-3 * len(x) // 4)
    floor = np.diag(quality.FLOOR**2)
    for _ in range(tries):
        own = rng.choice(len(x), 8, replace=False)
        for _ in range(30):
            centre, scatter = x[own].mean(0), np.cov(x[own].T, bias=True) * (quality.consistency(0.75) if len(own) == h else 1) + floor
            d = x - centre
            own = np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter), d))[:h]
        best = min(best, np.linalg.slogdet(np.cov(x[own].T, bias=True) * quality.consistency(0.75) + floor)[1])
    return best


def test_determinant_is_the_least(spark):
    """Against many random starts: an eighth of the rows far away in all statistics, and another far away in one."""
    rng = np.random.default_rng(3)
    rows = []
    for g in ("a", "b"):
        x = rng.normal(size=(240, 5)) * [1, 0.3, 0.2, 0.5, 0.1] + [5, 1, 0, 0, 0]
        x[:30] = rng.normal(size=(30, 5)) * 0.02 + [9, 3, 2, 2, 2]
        x[30:60] += [0, 0, 3, 0, 0]
        rows += [(g, v.tolist()) for v in x]
    table = spark.createDataFrame(rows, "`group` string, x array<double>").repartition(5)
    for r in quality.estimates(table).collect():
        x = np.array([v for g, v in rows if g == r.group])
        whiten = np.zeros((5, 5))
        for (i, j), v in zip(quality.triangle(), r.whiten, strict=True):
            whiten[i, j] = v
        logdet = -2 * np.log(np.diag(whiten)).sum()
        assert logdet <= determinant_by_hand(x) + 0.25  # the subset is whole bands, so a little more than 75 %
        distance = (((x - np.array(r.centre)) @ whiten.T) ** 2).sum(1)
        assert (distance[:60] > quality.quantile(quality.LEVEL, 5)).all() and (distance[60:] > quality.quantile(quality.LEVEL, 5)).mean() < 0.05


def test_chi_squared():
    assert quality.chi_squared(quality.quantile(0.95, 5), 5) == pytest.approx(0.95)
    assert quality.quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_licenses(spark):
    texts = [
        "Released under the MIT License.\nMore text",
        "x Apache License, Version 2.0; y APACHE license version 2 z",
        "CC-BY-NC cc by nc",
        "cc by ncx under the mit licenses",
        "This work is licensed under the GNU General Public License, version 3.",
        "this work is licensed\nunder the gnu general public license",
        None,
        "",
        "no license at all here",
    ]
    got = [tuple(r)[1:] for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == (7, 1, 1, 1, "mit", "mit", 1.0)
    assert got[1] == (12, 2, 1, 7, "apache-2", "apache-2", 1.0)
    assert got[2] == (6, 2, 0, 3, "cc-by-nc", "cc-by-nc", 1.0)
    assert got[3][1:5] == (0, None, None, "")
    assert got[4][5] == "gpl-3" and got[4][6] == 1.0 and got[4][1] == 0
    assert got[6] == got[7] == (0, 0, None, None, "", "", 0.0)
    assert got[8][5] == ""


NOTICES = {
    "mit": """/*
 * Permission is hereby granted, free of charge, to any person obtaining
 * a copy of this software and associated documentation files, to deal
 * in the Software without restriction, including without limitation
 */""",
    "gpl-3": """# This program is free software: you can redistribute it
# and/or modify it under the terms of the GNU General Public
# License as published by the Free Software Foundation.""",
    "apache-2": """you may not use this file except in
compliance with the License.

You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0""",
}


def test_wrapped_notices(spark):
    long = "word " * 3000
    texts = [(k, f"{long}\n{text}\n{long}") for k, text in enumerate(NOTICES.values())]
    texts += [(10, " filler ".join(NOTICES["mit"].split())), (11, long + " ".join(sorted(set(NOTICES["gpl-3"].split()))) + long * 2)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[k].labels for k in range(3)] == list(NOTICES) and all(got[k].score >= 0.8 for k in range(3))
    assert got[10].labels == ""  # twice as many words: no block of the template's length holds enough of them


def blocks_by_hand(text, sets, lengths):
    """The largest share of each template in any run of its number of words."""
    words = re.sub(licenses.BETWEEN, " ", text.lower()).split()
    found = {}
    for (label, s), n in zip(sets, lengths, strict=True):
        share = max((len(set(words[i : i + n]) & set(s)) for i in range(len(words))), default=0) / len(s)
        if share >= 0.8 - 1e-9:
            found[label] = max(share, found.get(label, 0))
    return found


def test_license_join_is_exact(spark):
    """All blocks and templates, by counting words."""
    rng = random.Random(8)
    sets, lengths = licenses.template_sets(), licenses.block_lengths()
    vocabulary = sorted({w for _, s in sets for w in s})
    texts = ["\n".join(" ".join(rng.sample(rng.choice(sets)[1] * 2 + vocabulary[:6], rng.randrange(3, 10)) + rng.sample(vocabulary, 3)) for _ in range(6)) for _ in range(60)]
    texts += ["\n".join(" ".join(rng.sample(s, licenses.least_common(len(s)) - d)) for _, s in sets) for d in (0, 1)]
    texts += [" ".join(w + " of" * rng.randrange(3) for w in rng.sample(s, len(s))) + "," + "x " * rng.randrange(9) for _, s in sets for _ in range(3)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    n = 0
    for i, text in enumerate(texts):
        found = blocks_by_hand(text, sets, lengths)
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, got[i].labels.split(","))) == set(found) | base
        assert got[i].score == pytest.approx(1.0 if base else max(found.values(), default=0.0))
        n += bool(found)
    assert 10 < n < len(texts)


def test_empty_tables(empty):
    assert near_dedup.near_classes(empty).count() == 0
    assert near_dedup.one_of_each(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert quality.judged(empty).count() == 0
    assert licenses.license_scan(empty).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g " * 10, None, None), (None, None, None, None), (1, "a b c d e f g " * 10, None, None)], "doc_id long, text string, lang string, source string")
    assert near_dedup.one_of_each(docs).count() >= 1
    removed = {(r.doc_id, r.repeats.n_words): r.repeats.n_removed for r in substrings.remove_repeats(docs).collect()}
    assert removed == {(1, 70): 63, (None, 70): 70, (None, 0): 0}  # null ids come last; the first seven windows are the only ones
    assert mixing.mix(docs).count() == packing.pack(docs).select("doc_id", "piece").count() == 3
    assert quality.judged(docs).count() == licenses.license_scan(docs).count() == 3


def test_settled_pairs_grow_with_the_open_pairs(spark, monkeypatch):
    """A joined group of 20,000 and three others in its bucket: three rows look for partners, spread over several tasks."""
    monkeypatch.setattr(near_dedup, "SALTED", 1000)
    n = 20_000
    members = spark.range(n + 3).selectExpr("7L AS bucket", "id", "100 AS size", f"if(id < {n}, 0L, id) AS root", f"{n + 3}L AS n", f"id >= {n} AS minor")
    got = near_dedup.settled_pairs(members, 0.8)
    assert got.count() == 3 * n + 3 == got.distinct().count()
    small = spark.createDataFrame([(1, i, 100, r, 5, m) for i, r, m in [(1, 1, False), (2, 1, False), (3, 3, True), (4, 4, True), (5, 4, True)]], members.schema)
    assert {tuple(r) for r in near_dedup.settled_pairs(small, 0.8).collect()} == {(1, 3), (2, 3), (1, 4), (2, 4), (1, 5), (2, 5), (3, 4), (3, 5)}

