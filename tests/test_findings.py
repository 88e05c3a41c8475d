"""The findings algebra, sources, sinks and settings on small tables."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sparksift.config import AuditConfig
from sparksift.functions import text as tx
from sparksift.operators import findings as A
from sparksift.operators.clones import numbered_copies
from sparksift.operators.text_rules import address_findings, document_files, secret_findings, text_clones
from sparksift.sources.files import scan_sources, uploaded_sources, write_csv, write_json


def finding(rule="SEC-001", line=1, severity="CRITICAL", path="a/X.java", node=0, message="m", type_="Security", advice="s"):
    return (type_, message, severity, path.split("/")[-1], line, rule, A.CATEGORY_OF_TYPE.get(type_, "CODE_SMELL"), advice, path,
            (0, node, 0))


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame(list(rows), A.SCHEMA)


def test_the_first_of_equal_findings_stays(table):
    found = table(finding(node=9, message="late"), finding(node=2, message="first"), finding(node=5, message="mid", severity="MINOR"))
    assert [r.message for r in A.findings_dedup(found).collect()] == ["first"]


def test_a_finding_without_rule_is_kept(table):
    found = table(finding(rule=None), finding(rule=None, node=1), finding())
    assert A.findings_dedup(found).count() == 2


def test_files_of_one_name_merge_only_on_request(table):
    found = table(finding(path="a/X.java"), finding(path="b/X.java"))
    assert A.findings_dedup(found).count() == 2
    assert A.findings_dedup(found, key="file_name").count() == 1


def test_filters(table):
    found = table(finding(message="Hardcoded KEY"), finding(rule=None, line=22, severity="MINOR", type_="Naming", advice=None))
    assert A.filter_severity(found, "minor").count() == 1
    assert A.filter_search(found, "hardcoded key").count() == 1
    assert A.filter_search(found, "minor-naming").count() == 1
    assert A.filter_search(found, "", "MINOR", "Security").count() == 0
    assert A.filter_search(found).count() == 2


def test_text_form(table):
    lines = [r[0] for r in table(finding(), finding(rule=None, advice=None)).select(A.finding_line()).collect()]
    assert lines == [
        "[ CRITICAL ] [SEC-001] Security | X.java | Line 1 -> m\n   Fix: s", "[ CRITICAL ] Security | X.java | Line 1 -> m"
    ]


@pytest.mark.parametrize(
    "counts, score, grade, verdict",
    [((0, 0, 0), 100, "A", "PASS"), ((0, 0, 10), 90, "A", "PASS"), ((0, 0, 11), 89, "B", "PASS"), ((0, 5, 10), 75, "B", "WARN"),
     ((1, 5, 10), 65, "C", "FAIL"), ((4, 2, 0), 54, "D", "FAIL"), ((6, 2, 0), 34, "F", "FAIL"), ((50, 0, 0), 0, "F", "FAIL")],
)
def test_scores(spark, counts, score, grade, verdict):
    row = spark.createDataFrame([counts], "critical long, major long, minor long")
    row = row.withColumn("score", A.health_score(F.col("critical"), F.col("major"), F.col("minor")))
    got = A.quality_gate(row.withColumn("grade", A.health_grade(F.col("score")))).first()
    assert (got.score, got.grade, got.verdict) == (score, grade, verdict)


def test_payload(table):
    found = table(finding(line=3), finding(line=2, severity="MINOR", type_="Naming", rule=None, advice=None))
    doc = json.loads(A.summary_payload(found).select(F.to_json(F.struct("*")).alias("j")).first().j)
    assert doc["summary"] == {"total": 2, "critical": 1, "major": 0, "minor": 1, "score": 89, "grade": "B"}
    assert doc["byType"] == {"Naming": 1, "Security": 1}
    assert [(d["line"], d["ruleId"], d["suggestion"]) for d in doc["defects"]] == [(2, "-", "-"), (3, "SEC-001", "s")]


def test_order(table):
    found = table(finding(line=10), finding(line=9), finding(line=100))
    assert [r.line_number for r in A.order_findings(found, "line").collect()] == [9, 10, 100]
    assert [r.line_number for r in A.order_findings(found, "line", ascending=False).collect()] == [100, 10, 9]


def test_sinks(spark, table, tmp_path):
    found = table(finding(message='say "hi", twice'), finding(line=2, rule=None, advice=None))
    write_json(found, str(tmp_path / "json"))
    rows = [json.loads(line) for f in (tmp_path / "json").glob("*.json") for line in f.read_text().splitlines()]
    assert {len(r) for r in rows} == {9} and {r["deduplicationKey"] for r in rows} == {
        "X.java:1:Security:SEC-001", "X.java:2:Security:null"
    }
    write_csv(found, str(tmp_path / "csv"))
    lines = sorted(line for f in (tmp_path / "csv").glob("*.csv") for line in f.read_text().splitlines())
    assert '"CRITICAL","SEC-001","Security","X.java","1","say ""hi"", twice","s"' in lines
    assert '"CRITICAL","-","Security","X.java","2","m","-"' in lines


def test_scan(spark, tmp_path):
    for name in ("a/A.java", "a/b/B.java", "C.JAVA", "D.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("class é { }")
    found = scan_sources(spark, str(tmp_path)).collect()
    assert {r.file_name for r in found} == {"A.java", "B.java"} and {r.content for r in found} == {"class é { }"}
    assert scan_sources(spark, str(tmp_path / "none")).count() == 0


def test_a_scan_keeps_no_names_in_the_driver(spark, tmp_path):
    """Rows are those of Spark's own reader, whose index of all files is a list in the driver."""
    names = ["A.java", "a/B.java", "a/b/c/D é.java", "a/empty.java", "_no.java", ".no.java", "_no/E.java", "_x=1.java", "_y=1/F.java", ".n/G.java", "H.java._COPYING_",
             "_metadata.java", "_metadata/J.java", "dir.java/I.java", "K.JAVA", "L.txt"]
    for n, name in enumerate(names):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"class \xe9 { }" * (n + 1))
    (tmp_path / "a/link.java").symlink_to(tmp_path / "A.java")
    pick = lambda df: sorted((r.path, r.file_name, r.content) for r in df.collect())
    for folder in (f"file:{tmp_path}", f"file://{tmp_path}//", f"file:{tmp_path}/A.java", f"file:{tmp_path}/a/"):
        own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").load(folder)
        expected = own.selectExpr("path", "substring_index(path, '/', -1) AS file_name", "make_valid_utf8(CAST(content AS STRING)) AS content")
        found = scan_sources(spark, folder)
        assert found.inputFiles() == [] and found.schema == scan_sources(spark, str(tmp_path)).schema
        assert pick(found) == pick(expected) and found.count() > 0
    assert scan_sources(spark, f"file:{tmp_path}/none").count() == 0
    assert scan_sources(spark, f"file:{tmp_path}/a/*").count() == 3  # a wildcard is left to Spark


def test_scan_of_malformed_bytes(spark, tmp_path):
    (tmp_path / "A.java").write_bytes(b"class \xe9 { }")
    (tmp_path / "B.java").write_bytes(b"class B { }")
    found = {r.file_name: r.content for r in scan_sources(spark, str(tmp_path)).collect()}
    assert found == {"A.java": "class \ufffd { }", "B.java": "class B { }"}


def documents(spark, *texts):
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    return document_files(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_addresses_are_whole(spark):
    texts = ["a 10.0.0.12345 b", "1.2.3.4.5", "10.0.0.1.", "x=192.168.1.1;", "10.0.0.1 and 10.0.0.2", "1234.1.1.1", "127.0.0.1", "10.0.0.1..2"]
    found = {(r.path, r.message) for r in address_findings(documents(spark, *texts)).collect()}
    want = [(2, "10.0.0.1"), (3, "192.168.1.1"), (4, "10.0.0.1"), (4, "10.0.0.2"), (7, "10.0.0.1")]
    assert found == {(f"s/{i}", f'Hardcoded IP address -> "{m}"') for i, m in want}


def test_secrets_in_long_lines(spark):
    """Time in proportion to the length of a line: a word of a megabyte takes no longer than its reading."""
    texts = ["a" * 1_000_000 + '="', 'myPassword = "x"', 'title = "password"', 'x="1"secret="2"', "b" * 500_000 + '="v"']
    found = {(r.path, r.message) for r in secret_findings(documents(spark, *texts)).collect()}
    assert found == {("s/1", "Hardcoded sensitive value -> myPassword"), ("s/3", "Hardcoded sensitive value -> secret")}


def test_texts_that_are_missing_are_no_clones(spark):
    found = text_clones(documents(spark, None, None, "same", "same", "")).collect()
    assert {r.path for r in found} == {"s/2", "s/3"}


def test_uploads(spark):
    rows = [("A.java", b"1", 1), ("A.java", b"2", 2), ("B.JAVA", b"3", 3), ("c.txt", b"4", 4), (None, b"5", 5)]
    found = uploaded_sources(spark.createDataFrame(rows, "name string, content binary, upload_ord int"))
    assert {(r.file_name, bytes(r.content)) for r in found.collect()} == {("A.java", b"2"), ("B.JAVA", b"3")}


def test_config():
    assert AuditConfig.from_json(AuditConfig(max_parameters=9).to_json()).max_parameters == 9
    assert AuditConfig.from_json('{"maxParameters": 9, "minCommentRatio": 1, "enableNaming": false, "outputDirectory": "."}') == AuditConfig(
        max_parameters=9, min_comment_ratio=1.0, enable_naming=False
    )
    for wrong in ('{"max_parameters": "9 OR true"}', '{"maxParameters": true}', '{"enableNaming": 1}', '{"maxFileLOC": 1.5}', "[]", '{"outputDirectory": 1}'):
        assert AuditConfig.from_json(wrong) == AuditConfig()
    assert AuditConfig.from_json(None) == AuditConfig.from_json("{") == AuditConfig.from_json('{"unknown": 1}') == AuditConfig()


def reference_profile(text):
    """The line states, one line after the other."""
    counts, inside = {"code": 0, "comment": 0, "blank": 0}, False
    lines = text.split("\n")
    while len(lines) > 1 and lines[-1] == "":
        lines.pop()
    for line in (x.strip() for x in lines):
        if not line:
            counts["blank"] += 1
        elif inside:
            counts["comment"] += 1
            inside = "*/" not in line
        elif line.startswith("/*"):
            counts["comment"] += 1
            inside = "*/" not in line
        else:
            counts["comment" if line.startswith("//") else "code"] += 1
    return counts


def test_line_profile_against_a_walk(spark):
    rng = random.Random(3)
    pieces = ["", "  ", "x", "// c", "/* a", "*/", "/* a */", "*/ y", "z /* w", " //"]
    texts = ["\n".join(rng.choices(pieces, k=rng.randint(1, 12))) + "x" for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.line_profile(F.col("t")).alias("p")).collect()
    for r in rows:
        assert {k: r.p[k] for k in ("code", "comment", "blank")} == reference_profile(r.t)


@pytest.mark.parametrize("text, count", [("", 1), (";;", 0), ("a", 1), (" a", 2), ("a;b;;", 2), ("{\n    return 25;\n}", 4)])
def test_split_count(spark, text, count):
    row = spark.createDataFrame([(text,)], "t string").select(tx.code_words(F.col("t")))
    assert row.first()[0] == count


def test_escape_and_truncate(spark):
    row = spark.createDataFrame([('<a href="x">&amp;', None)], "t string, n string")
    got = row.select(tx.escape_html(F.col("t")), tx.escape_html(F.col("n")), tx.truncate_text(F.col("t"), 5)).first()
    assert tuple(got) == ("&lt;a href=&quot;x&quot;&gt;&amp;amp;", "", "<a hr...")


def test_numbered_copies_against_a_count(spark):
    """A third of all items share one hash; numbers, first and second copy must be those of one global order."""
    rng = random.Random(5)
    items = [(f"p{i:04}", f"m{j}", j, j, "hot" if rng.random() < 0.34 else f"h{rng.randint(0, 250)}")
             for i in range(300) for j in range(rng.randint(1, 3))]
    found = numbered_copies(spark.createDataFrame(items, "path string, label string, line int, node long, hash string"))
    import hashlib

    chunk = lambda p: hashlib.md5(p.encode()).hexdigest()[:3]
    expected = set()
    for _, group in itertools.groupby(sorted(items, key=lambda x: (x[4], chunk(x[0]), x[0], x[3])), key=lambda x: x[4]):
        group = list(group)
        if len(group) > 1:
            expected |= {(g[0], g[1], n, group[0][:2], group[1][:2]) for n, g in enumerate(group, 1)}
    assert {(r.path, r.label, r.n, tuple(r.first), tuple(r.second)) for r in found.collect()} == expected


def test_plans_have_no_cross_join(spark, table):
    found = table(finding())
    for df in (A.relative_bar(found, "file_name"), A.severity_share(found), A.summary_payload(found)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
