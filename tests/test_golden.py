"""Findings of a sample file, worked out by hand from the rule texts."""

import os
import re

import pytest

from sparksift.config import AuditConfig
from sparksift.operators.findings import findings_dedup
from sparksift.plans.audit import audit

SAMPLES = os.path.join(os.path.dirname(__file__), "samples")

# (line, rule, severity) of tests/samples/Ledger.java.
LEDGER = {
    (1, "MET-004", "MINOR"),
    (11, "DEAD-005", "MINOR"), (11, "SEC-001", "CRITICAL"),
    (12, "DEAD-005", "MINOR"), (12, "SMELL-015", "MAJOR"),
    (13, "DEAD-005", "MINOR"),
    (14, "NAME-005", "MINOR"),
    (16, "SMELL-002", "MINOR"), (16, "SMELL-010", "MINOR"), (16, "DEAD-002", "MINOR"), (16, "DOC-001", "MINOR"),
    (16, "MET-005", "MAJOR"),
    (17, "SEC-002", "CRITICAL"),
    (18, "SMELL-011", "MINOR"), (18, "NAME-007", "MINOR"),
    (20, "SMELL-013", "MAJOR"),
    (23, "SMELL-016", "MAJOR"),
    (26, "SEC-005", "MAJOR"),
    (28, "SMELL-004", "MAJOR"), (28, "SMELL-012", "MINOR"),
    (35, "SEC-004", "MAJOR"),
    (34, "MET-005", "MINOR"),
    (39, "DEAD-004", "MAJOR"), (39, "MET-005", "MINOR"),
    (40, "SEC-006", "CRITICAL"),
    (41, "SEC-003", "MAJOR"),
    (43, "DEAD-001", "MAJOR"), (43, "SEC-011", "MAJOR"), (43, "SMELL-011", "MINOR"),
    (46, "SMELL-005", "MAJOR"), (46, "DOC-001", "MINOR"), (46, "MET-005", "MAJOR"),
    (50, "SMELL-014", "MINOR"),
    (61, "NAME-002", "MINOR"), (61, "SMELL-017", "MINOR"), (61, "DEAD-006", "MINOR"),
}


@pytest.fixture(scope="module")
def ledger(spark, java_files):
    with open(os.path.join(SAMPLES, "Ledger.java")) as f:
        return java_files(("src/Ledger.java", f.read()))


def keys(findings):
    return {(r.line_number, r.rule_id, r.severity) for r in findings.collect()}


def test_ledger(ledger):
    assert keys(audit(ledger)) == LEDGER


def test_toggles_leave_the_rest_unchanged(ledger):
    off = AuditConfig(enable_metrics=False, enable_naming=False, enable_dead_code=False)
    rest = {k for k in LEDGER if k[1].startswith(("SMELL", "SEC", "DUP")) or k[1] == "DEAD-006"}
    assert keys(audit(ledger, off)) == rest


def test_blank_lines_and_comments_move_findings_only(spark, java_files, ledger):
    text = ledger.first().content
    spread = text.replace(";\n", ";\n\n").replace("{\n", "{ /* { */\n")
    moved = audit(java_files(("src/Ledger.java", spread)))
    # A comment is printed on a line of its own and so counts as one, in its body and in the file.
    counted = lambda found: sorted(r.rule_id for r in found.collect() if r.rule_id not in ("MET-004", "MET-005"))
    assert counted(moved) == sorted(k[1] for k in LEDGER if k[1] not in ("MET-004", "MET-005"))


def test_reformatting_moves_findings_only(java_files, ledger):
    """Every statement on one line, or every token on its own: what depends on lines is taken from the printed layout."""
    text = ledger.first().content
    no_comments = re.sub(r"/\*.*?\*/|//[^\n]*", "", text, flags=re.S)
    dense = re.sub(r"\s*\n\s*", " ", no_comments)
    loose = re.sub(r"(?<=[;{}()])\s*", "\n\n   ", no_comments)
    shown = lambda found: {(r.rule_id, r.severity, r.message) for r in found.collect()}
    one, two, three = (shown(audit(java_files(("src/Ledger.java", t)))) for t in (no_comments, dense, loose))
    assert one == three and {"MET-004", "MET-005", "SMELL-005"} <= {f[0] for f in one}
    # with all on one line, several findings of a rule share that line and the first of them stays
    assert two <= one and {f for f in two if f[0] == "MET-004"} == {f for f in one if f[0] == "MET-004"}


def test_dedup_is_idempotent(ledger):
    found = audit(ledger)
    assert sorted(map(str, findings_dedup(found).collect())) == sorted(map(str, found.collect()))


def test_parts_of_a_corpus_add_up(spark, java_files, ledger):
    text = ledger.first().content
    other = java_files(("src/Other.java", text.replace("Ledger", "Other")))
    cfg = AuditConfig(enable_duplication=False)
    whole = audit(ledger.unionAll(other), cfg)
    parts = audit(ledger, cfg).unionByName(audit(other, cfg))
    pick = lambda df: sorted((r.path, r.line_number, r.rule_id, r.message) for r in df.collect())
    assert pick(whole) == pick(parts)
