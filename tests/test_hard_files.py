"""Broken files, files longer than a task, and limits by project."""

import os

import pytest

from sparksift.catalog import RULES
from sparksift.config import AuditConfig, ProjectLimits
from sparksift.operators.findings import findings_dedup
from sparksift.operators.long_files import block_ends, blocks_of, long_tokens, pieces_of
from sparksift.operators.mending import mended
from sparksift.operators.tokens import FACTS, rejects, tokens
from sparksift.plans.audit import audit, audit_rounds, audit_run, coverage, findings_of
from sparksift.storage import Scratch

SAMPLES = os.path.join(os.path.dirname(__file__), "samples")


def sample(name):
    with open(os.path.join(SAMPLES, name)) as f:
        return f.read()


@pytest.mark.parametrize(
    "broken, whole",
    [
        ("class A { void m() { System.exit(1); }", "class A { void m() { System.exit(1); }\n}"),
        ("class A { void m() { if (x) { a(); }\n @Override\n public void n() { } }", "class A { void m() { if (x) { a(); }}\n @Override\n public void n() { } }"),
        ("class A { } }\nclass B { }", "class A { }  \nclass B { }"),
        ("class A { void m() { f(a[1; } }", "class A { void m() { f(a[1; ])} }"),
        ("class A { void m() ) { x(); } } // end", "class A { void m()   { x(); } } // end"),
        ("class A { int f = new B() { public int g() { return 1; } }.g(); public void h() { } }", None),
        ("enum E { A { public void x() { } }, B; private int q; }", None),
        ("class A { String s = \"{ ( \"; char c = '['; /* { */ // (\n }", None),
        ("}}}", "   "),
        ("", None),
        (None, None),
    ],
)
def test_mending(java_files, broken, whole):
    files = java_files(("A.java", broken), ("B.java", "class B { }"))
    got = {r.path: r.content for r in mended(files).collect()}
    assert got == {"A.java": broken if whole is None else whole, "B.java": "class B { }"}
    assert rejects(mended(files)).collect() == []


def test_a_broken_file_is_audited_and_listed(java_files):
    files = java_files(("p/Open.java", "class A { void m() { System.exit(1); }"), ("p/Fine.java", "class B { void m() { System.exit(2); } }"), ("p/None.java", None))
    with audit_run(files) as found:
        assert {r.path for r in found.filter("rule_id = 'SEC-003'").collect()} == {"p/Open.java", "p/Fine.java"}
    assert {(r.path, r.reason) for r in coverage(files).collect()} == {("p/Open.java", "bracket left open"), ("p/None.java", "no text")}


def big_file():
    ledger, tricky = sample("Ledger.java"), sample("Tricky.java")
    return "\n".join([ledger, tricky, *(ledger.replace("Ledger", f"L{k}") for k in range(6))])


def test_parts_of_a_file_give_its_findings(spark, java_files):
    files = java_files(("a/Big.java", big_file()), ("b/Ledger.java", sample("Ledger.java")), ("c/Empty.java", ""), ("d/Broken.java", "class A {"))
    facts, broken = long_tokens(files, Scratch(spark), block_lines=7, part_tokens=60)
    facts = facts.cache()
    assert [r.path for r in broken.collect()] == ["d/Broken.java"]
    assert facts.filter("path = 'a/Big.java'").select("part").distinct().count() > 10
    # what does not look back beyond the member is the same for every token; the rest is read only within it
    same = ["path", "pos", "tok", "kind", "line", "lvl", "inner_pos", "inner_bk", "starts", "encl_pos", "encl_bk", "decl_pos", "decl_line", "decl_owner",
            "method_level", "class_level", "loop_level", "is_var", "is_param", "is_mname", "is_call", "is_new", "is_type_use", "is_name_use"]
    pick = lambda df: sorted(map(str, df.filter("NOT ghost").select(*same).collect()))
    whole = tokens(files).cache()
    assert pick(facts) == pick(whole)
    assert set(facts.columns) == set(FACTS)
    shown = lambda df: sorted(str(r) for r in findings_dedup(findings_of(df, set(RULES), AuditConfig())).drop("ord").collect())
    assert shown(facts) == shown(whole)


def test_an_audit_takes_long_files_apart(java_files):
    files = java_files(("a/Big.java", big_file()), ("b/Ledger.java", sample("Ledger.java")), ("c/Open.java", "class A { void m() { System.exit(1); }" + " " * 4000))
    shown = lambda df: sorted(str(r) for r in df.drop("ord").collect())
    assert shown(audit(files, long_file=3000, part_tokens=200)) == shown(audit(files))


def test_rounds_add_up(spark, java_files):
    """Clones are found across rounds, broken files in theirs; nothing is left behind."""
    ledger = sample("Ledger.java")
    files = java_files(*[(f"p/F{k}.java", ledger.replace("Ledger", f"L{k}")) for k in range(5)], ("p/Open.java", "class A { void m() { System.exit(1); }"), ("p/No.java", None))
    shown = lambda df: sorted(str(r) for r in df.drop("ord").collect())
    scratch = Scratch(spark)
    assert shown(audit_rounds(files, scratch, 3)) == shown(audit(files))
    assert shown(audit_rounds(files, Scratch(spark), cfg=AuditConfig(enable_duplication=False, enable_metrics=False))) == shown(audit(files, AuditConfig(enable_duplication=False, enable_metrics=False)))
    scratch.drop_all()
    assert spark.read.parquet(f"{scratch.folder}/findings").count() == 0


def test_states_of_the_lexer_at_line_blocks(java_files):
    text = "\n".join(["class A {", "/* a", 'b "x', "c */ int x;", 'String s = """', "/* no", '// \\""" no', '""" + "/*";', "// x {", "}"])
    files = java_files(("A.java", text))
    ends = {r.block: (r.clean, r.from_code, r.from_comment, r.from_text_block) for r in block_ends(blocks_of(files, 1)).collect()}
    assert ends[1] == (False, "/", "/", '"') and ends[3] == (True, "c", "c", '"') and ends[4] == (False, '"', "/", "c")
    assert ends[7][1:] == ('"', "/", "c") and ends[8] == (False, "c", "/", '"')
    pieces = sorted((r.piece, r.content) for r in pieces_of(blocks_of(files, 1)).collect())
    assert "".join(p for _, p in pieces) == text
    assert [p for _, p in pieces] == ["class A {", "\n/* a\nb \"x\nc */ int x;", '\nString s = """\n/* no\n// \\""" no\n""" + "/*";', "\n// x {\n}"]


def test_limits_of_the_longest_prefix(spark, java_files):
    text = "class A { void m(int a, int b, int c, int d) { a(b, c, d); } }"
    files = java_files(("x/A.java", text), ("x/y/A.java", text), ("x/yy/A.java", text), ("A.java", text), ("z/A.java", text))
    rows = [("x", 4, 7), ("x/y/", None, 9), ("z/A.java", 9, None), (None, 1, 1)]
    limits = spark.createDataFrame(rows, "prefix string, max_parameters int, max_method_lines int")
    cfg = ProjectLimits(limits, files, AuditConfig(max_parameters=3))
    of = {r.path: (r.limits.max_parameters, r.limits.max_method_lines, r.limits.max_class_fields) for r in cfg.of_path.collect()}
    assert of == {"x/A.java": (4, 7, 15), "x/y/A.java": (3, 9, 15), "x/yy/A.java": (4, 7, 15), "A.java": (3, 30, 15), "z/A.java": (9, 30, 15)}
    found = audit(files, limits=limits).filter("rule_id = 'SMELL-002'")
    assert {(r.path, r.suggestion.split(": ")[1]) for r in found.collect()} == {("x/y/A.java", "3"), ("A.java", "3")}
    assert {r.path for r in audit(files, limits=limits.filter("false")).filter("rule_id = 'SMELL-002'").collect()} == set(of)
