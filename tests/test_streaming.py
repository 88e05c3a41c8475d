"""Arriving files are audited set by set."""

import os

from sparksift.plans.audit import audit, audit_run, coverage
from sparksift.streaming.arrivals import arriving_sources, audit_arrivals

SAMPLES = os.path.join(os.path.dirname(__file__), "samples")


def test_arrivals(spark, java_files, tmp_path):
    inbox, sink, checkpoint = (str(tmp_path / d) for d in ("inbox", "sink", "checkpoint"))
    os.mkdir(inbox)
    with open(os.path.join(SAMPLES, "Ledger.java")) as f:
        text = f.read()
    for name in ("Ledger.java", "notes.txt"):
        with open(os.path.join(inbox, name), "w") as f:
            f.write(text)
    for _ in range(2):  # The second start finds nothing new.
        audit_arrivals(arriving_sources(spark, inbox), sink, checkpoint).awaitTermination()
    found = spark.read.parquet(sink)
    expected = audit(java_files(("x/Ledger.java", text)))
    pick = lambda df: sorted((r.file_name, r.line_number, r.rule_id, r.message) for r in df.collect())
    assert pick(found) == pick(expected)


def test_a_run_leaves_no_facts(spark, java_files):
    before = {t.name for t in spark.catalog.listTables()}
    files = java_files(("A.java", "class A { void m() { System.exit(1); }"), ("B.java", "class B { void m() { System.exit(1); } }"), ("C.java", None))
    with audit_run(files) as findings:
        # the broken file is audited as far as it can be read
        assert {r.file_name for r in findings.filter("rule_id = 'SEC-003'").collect()} == {"A.java", "B.java"}
    assert {t.name for t in spark.catalog.listTables()} == before
    assert {r.path: r.reason for r in coverage(files).collect()} == {"A.java": "bracket left open", "C.java": "no text"}


def test_messages_keep_literals_whole(spark, java_files):
    text = 'class A { void m(String n) { run("http://host/file/" + n); find("select a // b" + /* c */ n); } }'
    with audit_run(java_files(("A.java", text))) as findings:
        shown = {r.message for r in findings.filter("rule_id IN ('SEC-002', 'SEC-008')").collect()}
    assert shown == {'Possible Path Traversal -> "http://host/file/" + n', 'Possible SQL Injection -> "select a // b" + n'}
