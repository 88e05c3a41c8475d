"""Pages, URLs, vectors, components, the pipeline and the registry."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

import brute
from pyspark.sql import functions as F
from sparksift.llm import graph, hosts, html_text, vectors
from sparksift.llm.html_text import render


def test_layout():
    page = """<title>t</title><body><h1>Head &amp; foot</h1><p>One <b>two</b>
      three<p title=it's>Four<br>five<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>
      <table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>Apple pie<td>2<tr><td colspan=2>both</table>
      <pre>\n keep   this\n</pre><hr>end"""
    assert render(page).split("\n") == [
        "Head & foot", "", "One two three", "", "Four", "five", "", "- a", "- b", "  3. x", "  4. y", "- c", "", "Cap", "",
        "Name       Qty", "Apple pie  2", "both", "", " keep   this", "", "---", "", "end",
    ]


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain < text & more", "plain < text & more"),
        ("<p>a<!-- b --><p>c", "a\n\nc"),
        ("<div hidden>a</div>b", "b"),
        ("<div style='display : none'>a</div>b", "b"),
        ("<div style='visibility:hidden'>a<i style='visibility:visible'>c</i></div>b", "c\nb"),
        ("<script>if (a</p>b) </script>c", "c"),
        ("<details><summary>s</summary>x</details>y", "s\ny"),
        ("<details open><summary>s</summary>x</details>y", "s\nx\ny"),
        ("<dialog>x</dialog>y", "y"),
        ("</p></div>a</b>", "a"),
        ("<ul><li>" * 3 + "deep", "- - - deep"),
        ("<table><tr><td>a<td><table><tr><td>x<td>y</table>", "a  x  y"),
        ("<p>unclosed <b attr='x", "unclosed"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<p style='display:none;display:block'>a<p style='display: block; display :NONE'>b<p style='display:none !important; display:block'>c<p style='x-display:none'>d", "a d"),
        ("a<!-->b<!--->c<!-- x --!>d<!-- y", "abcd"),
        ("<i style='visibility:hidden;visibility:visible'>a</i>", "a"),
    ],
)
def test_rules(page, text):
    assert " ".join(render(page).split()) == " ".join(text.split())


def test_cells_of_several_rows():
    page = "<table><tr><th rowspan=2>head<td>a<td colspan=2>b<tr><td>c<td rowspan=0>d<td>e<tr><td>1<td>2<td>3<tr><td colspan=2 rowspan=x>f<td>g</table>"
    assert render(page).split("\n") == ["head  a  b", "      c  d  e", "1     2     3", "f           g"]
    wide = "<table><tr><td>漢字<td>x<tr><td>abcdef<td>y<tr><td>é<td>z</table>"
    assert render(wide).split("\n") == ["漢字    x", "abcdef  y", "é       z"]


def test_pages_with_null_and_repeated_ids(spark):
    rows = [(None, "<p>a", "x"), (1, None, "y"), (1, "<p>b", "z"), (1, "<p>b", "z")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert Counter((r.page_id, r.text) for r in got) == {(None, "a"): 1, (1, ""): 1, (1, "b"): 2}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<table><tr><form><td>a<td>b</form></table>c", "a  b\n\nc"),
        ("<table><form><tr><td>a</form><tr><td>b</table>", "a\nb"),
        ("<table><div><tr><td>a</td></tr></div><tr><td>b</table>", "a\nb"),
        ("x<table>loose<tr>text<td>a</td><p>more</p><td>b</table>y", "xloosetext\n\nmore\n\na  b\n\ny"),
        ("<table><tbody><tr><h2>head</h2><td>a</table>", "head\n\na"),
        ("<table><tr><td>a<tr><table><tr><td>b</table></table>", "a\n\nb"),
        ("<table><colgroup><col>c<tr><td>a</table>", "c\n\na"),
        ("<table><caption>t<td>a</table>", "t\na"),
        ("<table><template><tr><td>x</template><tr><td>a</table>", "a"),
        ("<tr>stray<td>a", "stray\na"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math>", "x=1"),
        ("<svg><title>t</title><defs><text>d</text></defs><rect/><text>a</text><text>b</text></svg>", "a\nb"),
        ("<map name=m><area href=q><a href=r>link</a></map>", "link"),
    ],
)
def test_no_visible_text_is_lost(page, text):
    assert [line for line in render(page).split("\n") if line] == [line for line in text.split("\n") if line]


def test_deep_and_long_pages():
    assert render("<div>" * 20_000 + "x") == "x"
    assert render("<b>" + "word " * 200_000).count("word") == 200_000
    assert render("<a " * 20_000) == "" and render("<" * 20_000) == "<" * 20_000


class Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        if tag not in ("b", "i", "a", "span", "em", "strong"):
            self.words.append(" ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        if tag not in ("b", "i", "a", "span", "em", "strong"):
            self.words.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def test_pages_have_all_their_words(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        parser = Visible()
        parser.feed(r.html)
        want = Counter("".join(parser.words).split())
        have = Counter(got[r.page_id].split())
        assert not want - have
        assert set(have - want) <= {"-", "---"} | {w for w in have if w.endswith(".") and w[:-1].isdigit()}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_urls(spark):
    urls = [
        "http://A.org", "http://a.org/", "http://example.org/es/x", "http://sub.example.org/en/12?x#y", "http://example.org/en", "ftp://x.com/fr/",
        "http://x.com/de/a#/fr/", "nothing", None, "http://", "http://xorg/", "http://org/q?u=http://b.com/", "http://com/fr", "x://É.ORG/Ä",
    ]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = hosts.judge_urls(pages, spark.createDataFrame([], "page_id long, bad boolean"))
    got = [(r.host, r.path, r.rule, r.verdict) for r in out.orderBy("page_id").collect()]
    assert got == [
        ("a.org", "", None, "allow"), ("a.org", "/", "org/", "allow"), ("example.org", "/es/x", "example.org/es/", "block"),
        ("sub.example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en", "org/", "allow"), ("x.com", "/fr/", "com/fr/", "allow"),
        ("x.com", "/de/a", "com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("xorg", "/", None, "allow"),
        ("org", "/q", "org/", "allow"), ("com", "/fr", None, "allow"), ("É.org", "/Ä", "org/", "allow"),
    ]
    assert hosts.judge_urls(pages.limit(0), spark.createDataFrame([], "page_id long, bad boolean")).count() == 0


def test_reputation(spark):
    """A host with many bad pages is blocked, one bad page alone is not; a domain's record counts for its new hosts."""
    urls = [f"http://bad.net/{i}" for i in range(60)] + [f"http://h{i % 50}.good{i % 9}.{s}/" for s in ("net", "info") for i in range(400)] + ["http://single.info/"]
    urls += [f"http://h{i % 8}.farm.net/{i}" for i in range(80)] + ["http://new.farm.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = [(i, "bad.net" in u or "single" in u or "farm" in u) for i, u in enumerate(urls) if "new" not in u] + [(0, None), (10**6, True), (None, True)]
    got = {r.host: r.verdict for r in hosts.judge_urls(pages, spark.createDataFrame(outcomes, "page_id long, bad boolean")).collect()}
    assert got["bad.net"] == "block" and got["single.info"] == "allow" and got["h3.good3.net"] == "allow"
    assert got["h2.farm.net"] == "block" and got["new.farm.net"] == "block"


def test_domains(spark, tmp_path):
    path = tmp_path / "suffixes.dat"
    path.write_text("// comment\nuk\nco.uk // inline\ngithub.io\n*.ck\n!www.ck\nk12.ma.us\n\n")
    listed = hosts.suffix_lists(spark, str(path))
    assert listed == ["!www.ck", "*.ck", "co.uk", "github.io", "k12.ma.us", "uk"]
    want = {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.github.io:8080": ("a.github.io", "github.io"), "x.y.foo.ck": ("y.foo.ck", "foo.ck"),
        "a.www.ck": ("www.ck", "ck"), "p.q.k12.ma.us": ("q.k12.ma.us", "k12.ma.us"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[::1]:80": ("[::1]", "[::1]"),
        "localhost": ("localhost", "localhost"), "": ("", ""), "1.2.3": ("2.3", "3"),
    }
    domain, suffix = hosts.domains(F.col("host"), listed)
    rows = spark.createDataFrame([(h,) for h in want], "host string").select("host", domain.alias("d"), suffix.alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in rows} == want


def test_urls_with_null_and_repeated_ids(spark):
    pages = spark.createDataFrame([(None, "http://a.com/x"), (None, "http://a.com/x"), (1, "http://10.0.0.1/"), (1, None), (2, "http://b.net:80/p")], "page_id long, url string")
    outcomes = spark.createDataFrame([(None, True), (1, True), (1, False), (2, None)], "page_id long, bad boolean")
    got = Counter((r.page_id, r.host, r.path) for r in hosts.judge_urls(pages, outcomes).collect())
    assert got == {(None, "a.com", "/x"): 2, (1, "10.0.0.1", "/"): 1, (1, "", ""): 1, (2, "b.net:80", "/p"): 1}


def vectors_brute(rows, threshold=0.93):
    units = {}
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, float)
            units[k] = (i, a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max()), label)
    links, n, alike = [], Counter(), defaultdict(list)
    for k, (_, x, label) in units.items():
        alike[label, len(x)].append(k)
    for keys in alike.values():
        x = np.array([units[k][1] for k in keys])
        for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if a != b:
                n[units[keys[a]][0]] += 1
                links.append((units[keys[a]][0], units[keys[b]][0]))
    return n, brute.classes({r[0] for r in rows}, links)


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        for _ in range(120):
            rows.append((rng.normal(size=16).tolist(), label))
        centre = rng.normal(size=16)
        rows += [((centre + 0.12 * rng.normal(size=16)).tolist(), label) for _ in range(80)]
        rows += [(centre.tolist(), label)] * 3
        walk = rng.normal(size=16)
        for _ in range(15):  # a chain
            walk = walk + 0.25 * rng.normal(size=16)
            rows.append((walk.tolist(), label))
    rows += [(None, 0), ([], 0), ([0.0] * 16, 0), ([float("nan")] * 16, 1), ([None] + [1.0] * 15, 1), ([1.0] * 16, None), ([1.0] * 16, None), ([1.0] * 8, 1), ([2.0] * 8, 1), ([1e30] * 16, 0), ([1e-30] * 16, 0), ([float("inf")] * 16, 0)]
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


@pytest.mark.parametrize("shard, piece", [(1024, 4096), (40, 30)])
def test_near_vectors(spark, vector_rows, monkeypatch, shard, piece):
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "SLICE", piece)
    monkeypatch.setattr(vectors, "BLOCK", piece)
    got = vectors.near_vectors(spark.createDataFrame(vector_rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()
    n, classes = vectors_brute(vector_rows)
    assert len(got) == len(vector_rows)
    found = sum(min(r.n_links, n[r.vec_id]) for r in got)
    assert all(r.n_links <= n[r.vec_id] for r in got)
    assert found >= (1.0 if shard > 100 else 0.9) * sum(n.values())
    if shard > 100:
        assert {r.vec_id: r.component_id for r in got} == classes
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("size", [4, 40])
def test_links_count_on_both_sides(spark, monkeypatch, size):
    """Points between many small shards, and a group of copies that outnumbers them: no row contradicts its component."""
    monkeypatch.setattr(vectors, "SHARD", 60)
    monkeypatch.setattr(vectors, "SLICE", 400)
    monkeypatch.setattr(vectors, "BLOCK", 150)
    rng = np.random.default_rng(size)
    centres = rng.normal(size=(300, 8))
    rows = [(centres[k % 300] + rng.normal(size=8) * 0.2) for k in range(300 * size // 4)] + [centres[0] + rng.normal(size=8) * 0.01 for _ in range(400)]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rows)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    n, classes = vectors_brute(rows)
    sizes = Counter(r.component_id for r in got.values())
    assert all((r.n_links > 0) == (sizes[r.component_id] > 1) for r in got.values())
    assert all(r.n_links <= n[i] for i, r in got.items())
    outside = [i for i in got if n[i] < 300]
    assert sum(got[i].n_links for i in outside) >= 0.99 * sum(n[i] for i in outside)
    assert sum(got[i].n_links for i in got) >= 0.99 * sum(n.values())


def test_audit_sees_lost_links(spark):
    """The links of a large group don't hide that those of the others are lost."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=8)
    rows = [(centre + 0.01 * rng.normal(size=8)).tolist() for _ in range(300)]
    for _ in range(100):
        c = rng.normal(size=8)
        rows += [(c + 0.02 * rng.normal(size=8)).tolist() for _ in range(3)]
    points = spark.createDataFrame([(i, 1, "0", 8, v) for i, v in enumerate(rows)], "rep long, weight long, label string, dim int, v array<double>")
    n, _ = vectors_brute([(i, v, 0) for i, v in enumerate(rows)])
    share = lambda lost: vectors.audited(points, spark.createDataFrame([(i, c - lost(i, c)) for i, c in n.items()], "rep long, n long"), 0.93)
    assert share(lambda i, c: 0) == 1.0
    assert share(lambda i, c: c if i >= 300 else 0) < 0.5
    assert share(lambda i, c: c // 2 if i >= 300 else 0) < 0.7
    assert share(lambda i, c: c // 2 if i < 300 else 0) < 0.7


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [tuple(rng.sample(range(300, 400), 2)) for _ in range(60)] + [(7, 7), (1, None)]
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = brute.classes({x for p in links for x in p if None not in p}, [p for p in links if None not in p])
    assert {r.node: r.root for r in got} == {k: v for k, v in want.items() if k not in (1, 7)}
    assert len(got) == len({r.node for r in got})


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = graph.stored(stage(spark, now, "/root/testdata/sf0.001"))
        seen[name] = now
    names = list(seen)
    for name in names[:-1]:
        assert seen[name].columns == docs.columns
    clean = {r.doc_id: r.text for r in docs.collect()}
    first = {r.doc_id: r.text for r in seen["language_id"].collect()}
    assert first.items() <= clean.items() and len(first) > 0.95 * len(clean)
    classes = brute.near_classes(list(first.items()))
    second = {r.doc_id: r.text for r in seen["near_duplicates"].collect()}
    assert sorted(second) == sorted(set(classes.values()))
    want = brute.remove_repeats(list(second.items()))
    third = seen["repeated_passages"].collect()
    for r in third:
        assert len(brute.words(r.text)) == want[r.doc_id][0] - want[r.doc_id][1]
    size = defaultdict(int)
    for r in third:
        size[r.source] += len(brute.words(r.text))
    target, taken = brute.targets(size), defaultdict(int)
    for r in seen["source_mix"].collect():
        taken[r.source] += len(brute.words(r.text))
    longest = max(len(brute.words(r.text)) for r in third)
    assert all(abs(taken[s] - t) <= longest for s, t in target.items())
    last = seen["packed_sequences"]
    assert last.filter("piece = 0").count() == seen["source_mix"].count()


CLASHING = ["repeats", "__lang", "__n", "__id", "a.b", "row", "lang_pred", "size", "null_id", "h1"]


def test_pipeline_with_clashing_columns_nulls_and_repeated_rows(spark):
    """Extra columns come through each stage as they are; null ids and texts, repeated rows and an empty table are no error."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = docs.select(*[F.expr(f"CAST(NULL AS {t})").alias(c) for c, t in docs.dtypes]).limit(1)
    extra = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    rows = docs.unionByName(odd).unionByName(extra).unionByName(extra).unionByName(docs.limit(5)).unionByName(docs.limit(2).withColumn("text", F.lit("")))
    rows = rows.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING))
    now = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = graph.stored(stage(spark, now, "/root/testdata/sf0.001"))
        assert now.columns == rows.columns, name
        for r in now.collect():
            assert all(r[c] == f"{c}:{'none' if r.doc_id is None else r.doc_id}" for c in CLASHING), name
        assert now.count() > 20, name
    assert corpus_pipeline.packed_sequences(spark, now, "").count() >= now.count()
    now = rows.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        now = graph.stored(stage(spark, now, "/root/testdata/sf0.001"))
        assert now.count() == 0, name


def test_registry_and_import_without_this_part():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)} and "pipeline" in names
