"""Binary packing, fill-in-middle and reversed search against plain Python."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparksift.llm import binary_packing, infill, queries, reverse_search

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
DOCS = "doc_id long, text string"
ODD = "doc_id long, text string, length string, n string, form string, output string, score string, term string, item_id string, `a.b` string"


def odd(rows):
    return [(*r, *["x"] * 8) for r in rows]


TRICKY = [
    (1, "Alpha beta.\nBeta <P> gamma"), (2, None), (3, ""), (4, "\n\n\n"), (5, "ünï\ncöde — 漢字\n\n½ x"), (None, "no id\nhere"), (None, "no id\nhere"), (5, "beta " * 3000),
    (6, "x\r\ny z\n" * 500), (7, "<"), (8, "a\n<|endoftext|>\nb"), (9, "gamma beta"), (10, "gamma beta"),
]


# binary packing


def encoder():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    found = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return lambda text: [*found.encode(text or "", add_special_tokens=False).ids, binary_packing.END]


def check_packing(rows, docs, length=binary_packing.LENGTH):
    """Rows of bucketed pieces with ids_crc32 hold each id of each document once, in sequences of one piece each."""
    ids = encoder()
    want = Counter()
    for doc, text in docs:
        tokens, start = ids(text), 0
        rest = len(tokens)
        while rest:
            size = min(length, 1 << (rest.bit_length() - 1))
            want[(doc, start, size, zlib.crc32(np.array(tokens[start : start + size], "<u4").tobytes()), len(tokens))] += 1
            start, rest = start + size, rest - size
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert all(r.offset == 0 and r.length == 1 << r.bucket <= length for r in rows)


def packed(docs, length=binary_packing.LENGTH, batch_tokens=binary_packing.BATCH_TOKENS):
    pieces = binary_packing.pieces(docs, length=length)
    return binary_packing.bucketed(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), batch_tokens)


@settings(deadline=None)
@given(st.integers(0, 20_000), st.integers(0, 12))
def test_lengths_add_up(tokens, power):
    found = binary_packing.lengths(tokens, 1 << power)
    assert sum(found) == tokens and all(x & (x - 1) == 0 and x <= 1 << power for x in found)
    assert found == sorted(found, reverse=True) and len([x for x in found if x < 1 << power]) <= power


def test_binary_packing(spark):
    docs = TRICKY + [(100 + k, "word " * k) for k in range(60)]
    rows = packed(spark.createDataFrame(docs, DOCS).repartition(5), 16, 64).collect()
    check_packing(rows, docs, 16)
    batches = defaultdict(list)
    for r in rows:
        batches[r.bucket, r.batch].append(r.sequence_id)
    of_bucket = defaultdict(dict)
    for (bucket, batch), members in batches.items():
        of_bucket[bucket][batch] = len(members)
        assert max(members) - min(members) == len(members) - 1
    for bucket, sizes in of_bucket.items():  # all full but the last one
        assert sorted(sizes) == list(range(len(sizes)))
        assert all(n == 64 >> bucket for b, n in sizes.items() if b < len(sizes) - 1) and sizes[len(sizes) - 1] <= 64 >> bucket


def test_binary_packing_of_many_slices(spark, monkeypatch):
    monkeypatch.setattr(binary_packing, "SLICE_ROWS", 7)
    docs = [(k % 3 if k % 5 else None, "same text here" if k % 2 else "word " * (k % 40)) for k in range(150)]
    check_packing(packed(spark.createDataFrame(docs, DOCS).repartition(3), 8).collect(), docs, 8)


def test_binary_packing_odd_tables(spark):
    assert packed(spark.createDataFrame([], DOCS)).collect() == []
    rows = packed(spark.createDataFrame(odd(TRICKY), ODD)).collect()
    check_packing(rows, TRICKY)
    with pytest.raises(ValueError):
        binary_packing.pieces(spark.createDataFrame([], DOCS), length=1000)


def test_ids_are_the_documents(spark):
    ids = encoder()
    rows = binary_packing.pieces(spark.createDataFrame(TRICKY[:5], DOCS), length=4).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert got == {i: ids(t) for i, t in TRICKY[:5]}


@needs_tables
def test_binary_packing_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    check_packing(queries.op11_binary_packing(spark, SF_DIR).collect(), docs)


# fill-in-middle


def infill_by_hand(doc, text, seed=7, rate=100, share=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < share:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check_infill(made, docs, **options):
    rows = made.select("*", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert Counter(tuple(r[:6]) for r in rows) == Counter(infill_by_hand(i, t, **options) for i, t in docs)
    assert Counter((r.doc_id, r.back) for r in rows) == Counter((i, t or "") for i, t in docs)


def lines(rng, n):
    return "".join("".join(rng.choice("ab é漢<P>SM") for _ in range(rng.randrange(60))) + rng.choice(["\n", "\n", "\n\n", " "]) for _ in range(n))


def test_infill(spark):
    rng = random.Random(3)
    shared = lines(rng, 400)
    docs = TRICKY + [(200 + k, lines(rng, k) + (shared if k % 2 else "")) for k in range(80)] + [(300, "é" * 50_000), (301, "a\n" * 50_000), (302, "x" * 20_000 + "\n" + "x" * 20_000)]
    table = spark.createDataFrame(docs, DOCS).repartition(3)
    check_infill(infill.fill_in_middle(table), docs)
    check_infill(infill.fill_in_middle(table, seed=11, rate=40, spm_share=90), docs, seed=11, rate=40, share=90)
    check_infill(infill.fill_in_middle(table, cache_bytes=1), docs)  # a cache that keeps nothing changes nothing


def test_infill_odd_tables(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], DOCS)).collect() == []
    check_infill(infill.fill_in_middle(spark.createDataFrame(odd(TRICKY), ODD)), TRICKY)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "\n", "é", "<P>", "<", "S>", "word " * 90, "\n" * 300, "漢" * 400]), max_size=30))
def test_outline_of_any_chunks(parts):
    text = "".join(parts).encode()
    data = np.frombuffer(text, np.uint8)
    whole = re.findall(r"[^\n]*\n|[^\n]+", text.decode())
    for ends in (infill.chunk_ends(infill.candidates(data), 0, len(text)), list(range(1, len(text) + 1))):
        doc = infill.outline(text, ends, infill.Summaries())
        assert doc.units == len(whole) and doc.sentinel == ("<P>" in text.decode() or "<S>" in text.decode())
        for u in {0, len(whole) // 3, len(whole) // 2, len(whole)}:
            head = "".join(whole[:u])
            assert doc.cut(u) == (len(head.encode()), len(head))


def test_chunks_follow_the_content():
    rng = random.Random(5)
    passage = bytes(rng.randrange(32, 127) for _ in range(60_000))
    found = []
    for head in (b"", b"some other beginning, " * 9):
        text = head + passage
        ends = infill.chunk_ends(infill.candidates(np.frombuffer(text, np.uint8)), 0, len(text))
        assert ends[-1] == len(text) and max(np.diff([0, *ends])) <= infill.MOST
        found.append({text[a:b] for a, b in zip([0, *ends], ends, strict=False)})
    assert len(found[0] & found[1]) >= 0.8 * len(found[0])


def test_cache_is_bounded_and_checks_content(monkeypatch):
    cache = infill.Summaries(1000)
    for k in range(50):
        cache.of(bytes([65 + k % 26]) * 100 + bytes([k]))
    assert cache.size <= 1000 and cache.size == sum(len(s.content) for s in cache.kept.values())
    monkeypatch.setattr(infill, "hash", lambda content: 1, raising=False)  # all chunks collide
    cache = infill.Summaries(1000)
    assert [len(cache.of(c).ends) for c in (b"a\nb", b"abc", b"\n\n\n", b"abc")] == [1, 0, 3, 0]
    assert cache.size == 3


@needs_tables
def test_infill_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((*infill_by_hand(i, t)[:5], sha(infill_by_hand(i, t)[5]), sha(t or "")) for i, t in docs)
    assert Counter(tuple(r) for r in queries.op12_infill(spark, SF_DIR).collect()) == want


# reversed search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda c: c.group().lower(), t) for t in TERM.findall(text or "")]


def search_by_hand(docs, items, k=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(list)
    for item, text in items:
        asked[item] += terms(text)
    out = []
    for item, words in asked.items():
        found = []
        for doc, c in counts:
            m = 75 + 25 * sum(c.values()) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort(key=lambda f: f[:3])
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(found[:k])]
    return Counter(out)


def search_rows(*args, **options):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in reverse_search.search(*args, **options).collect())


ITEMS = [(1, "Beta beta GAMMA"), (2, None), (3, ""), (4, "漢字 — ½"), (4, "ünï"), (None, "no id"), (5, "?!"), (6, "x y z K")]


def test_search(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)] + ["Ünï", "K", "beta"]
    docs = TRICKY + [(k, " ".join(rng.choice(vocabulary[: rng.randrange(2, 43)]) for _ in range(rng.randrange(30)))) for k in range(300)]
    items = ITEMS + [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))) for k in range(10, 50)]
    table, asked = spark.createDataFrame(docs, DOCS).repartition(9), spark.createDataFrame(items, "item_id long, text string")
    want = search_by_hand(docs, items)
    assert search_rows(table, asked) == want
    assert search_rows(table, asked, block_bytes=100) == want  # many blocks
    assert search_rows(table, asked, k=3) == search_by_hand(docs, items, 3)


def test_search_in_small_steps(spark, monkeypatch):
    monkeypatch.setattr(reverse_search, "CELLS", 5)
    docs = [(k, "b " * (k % 4) + "a c") for k in range(60)]
    found = reverse_search.index_of([type("R", (), {"item_id": i, "text": t}) for i, t in [(1, "a b"), (2, "b c c")]])
    assert found.items == [1, 2] and len(found.hashes) == 3 and found.times.tolist().count(2) == 1
    shared = lambda value: type("B", (), {"value": value})
    import pyarrow as pa

    n, total = 60, sum(k % 4 + 2 for k in range(60))
    w = reverse_search.weights(found, {reverse_search.N_ROW: n, **{t: 60 for t in range(3)}})
    run = reverse_search.scored(shared(found), shared(w), n, total, 60)
    monkeypatch.setattr(reverse_search.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    batch = pa.record_batch([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs])], ["doc_id", "text"])
    small = next(run(iter([batch]))).to_pylist()
    monkeypatch.setattr(reverse_search, "CELLS", 1 << 22)
    assert small == next(run(iter([batch]))).to_pylist()
    holders = [sum(bool({'b', 'c'} & set(t.split())) or i == 1 for _, t in docs) for i in (1, 2)]
    assert len(small) == sum(holders)


def test_search_odd_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert reverse_search.search(none, items).collect() == []
    docs = spark.createDataFrame(odd(TRICKY), ODD)
    assert search_rows(docs, items) == search_by_hand(TRICKY, ITEMS)
    assert reverse_search.search(docs, items.filter("false")).collect() == []
    assert reverse_search.search(docs, items.filter("item_id in (2, 3, 5)")).collect() == []


@needs_tables
def test_search_query(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF_DIR}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = Counter(tuple(r) for r in queries.op13_reverse_search(spark, SF_DIR).collect())
    assert got == search_by_hand(docs, items)
