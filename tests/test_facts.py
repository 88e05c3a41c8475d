"""Lexing and structure on Java that is hard to cut."""

import os

import pytest

from sparksift.operators.members import class_rollup, methods
from sparksift.operators.text_rules import text_audit
from sparksift.operators.tokens import lex, rejects, tokens
from sparksift.plans.audit import rule_findings

SAMPLES = os.path.join(os.path.dirname(__file__), "samples")


@pytest.fixture(scope="module")
def facts(java_files):
    with open(os.path.join(SAMPLES, "Tricky.java")) as f:
        return tokens(java_files(("Tricky.java", f.read()))).cache()


def test_methods(facts):
    columns = ["name", "line", "return_type", "visibility", "n_params", "n_stmts", "cc", "cognitive", "nesting", "has_body"]
    found = {r.name: tuple(r)[1:] for r in methods(facts).select(*columns).collect()}
    assert found["compute"] == (22, "Map<String, List<R>>", "public", 2, 17, 19, 9, 1, True)
    assert found["bodiless"] == (45, "int", "", 1, 0, 1, 0, 0, False)
    assert found["hashCode"][4] == 1 and found["go"][4] == 1
    assert set(found) == {"run", "compute", "hashCode", "bodiless", "helper", "m", "name", "go", "shared", "dist"}


def test_classes(facts):
    columns = ["class_name", "line", "n_methods", "n_fields", "n_constructors", "extended", "implemented"]
    found = [tuple(r) for r in class_rollup(facts).select(*columns).orderBy("line").collect()]
    assert found == [("Tricky", 10, 3, 4, 1, ["Base"], ["Runnable"]), ("Inner", 47, 2, 1, 0, [], [])]


def test_blocks(facts):
    kinds = [r.inner_bk for r in facts.filter("tok = '{'").orderBy("pos").collect()]
    assert kinds[:12] == ["arr", "class", "arr", "arr", "lambda", "anon", "method", "init", "ctor", "loop", "method", "if"]
    assert {"switch", "switchx", "case", "do", "tryres", "catch", "finally", "sync", "enum", "record", "annotation"} <= set(kinds)


def test_variables(facts):
    names = [r.tok for r in facts.filter("is_var").orderBy("pos").collect()]
    assert names == (
        "TABLE sizes more fn task unusedInner q i text e k r in two o hidden flag arr c2 quote s2 A v"
    ).split()


def test_calls(facts):
    names = {r.tok for r in facts.filter("is_call").collect()}
    assert names == {
        "helper", "exit", "entrySet", "getValue", "y", "z", "forEach", "count", "foo", "bar", "read", "done", "length",
        "emptyMap", "stop", "check",
    }


def test_types_of_any_depth(java_files):
    deep = "class A<T extends B<C<D<E<F>>>>> extends p.P<Q<R<S<T>>>> implements I<J<K<L>>>, M { <T extends B<C<D<E>>>> Map<String, T> m() { return null; } }"
    found = tokens(java_files(("A.java", deep)))
    row = class_rollup(found).first()
    assert (row.extended, row.implemented) == (["P"], ["I", "M"])
    assert [r.return_type for r in methods(found).collect()] == ["Map<String, T>"]


def test_every_character_is_covered_once(java_files, spark):
    text = 'class A { // c\n  String s = "a\\"b" + \'"\'; /* x\n */ int i = 0x1F + 1_000 + .5e-3f; }\n// end\n'
    files = java_files(("A.java", text))
    found = tokens(files).orderBy("pos").collect()
    assert [r.tok for r in found if r.kind in "scn"] == ['"a\\"b"', "'\"'", "0x1F", "1_000", ".5e-3f"]
    assert found[-1].line == 3 and sum(r.raw_len for r in lex(files).collect()) == text.index("}") + 1


@pytest.mark.parametrize("literal", ['"' + "a" * 200_000 + '"', '"' + '\\"' * 60_000 + '"'])
def test_long_literals(java_files, literal):
    found = lex(java_files(("A.java", f"class A {{ String s = {literal}; /* {'*' * 100_000} */ }}"))).collect()
    assert len(found) == 9 and literal in {r.tok for r in found}


def test_generics_and_comparisons(java_files):
    text = (
        "class A { boolean f(int n) { Map<String, List<int[]>> m = new HashMap<>(); for (int i = 0; i < n >> 1; i++) { go(); }"
        " return MAX < n && n > MIN || a.<B>c() > x; } }"
    )
    found = tokens(java_files(("A.java", text))).orderBy("pos").collect()
    assert [r.tok for r in found if r.is_var] == ["m", "i"]
    assert [r.tok for r in found if r.is_name_use] == ["i", "n", "i", "MAX", "n", "n", "MIN", "a", "x"]


def test_windows_line_ends(java_files):
    found = tokens(java_files(("A.java", "class A {\r\n  int a;\r\n}\r\n"))).orderBy("pos").collect()
    assert [r.line for r in found] == [1, 1, 1, 2, 2, 2, 3]


def test_rejects(java_files):
    files = java_files(("open.java", "class A { void m() {"), ("shut.java", "class A { } }"), ("fine.java", "class A { } // }"))
    assert {(r.path, r.reason) for r in rejects(files).collect()} == {
        ("open.java", "bracket left open"), ("shut.java", "closing bracket without an opening one"),
    }
    assert {r.path for r in tokens(files).collect()} == {"fine.java"}


def test_tokens_shuffle_the_text_once(java_files):
    plan = tokens(java_files(("A.java", "class A { }")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    member_plan = methods(tokens(java_files(("A.java", "class A { }"))))._jdf.queryExecution().executedPlan().toString()
    assert member_plan.count("Exchange") == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_expressions_are_quoted_without_the_text(java_files):
    """One exchange of the text, which serves the findings too; nothing is joined."""
    plan = plan_of(rule_findings(java_files(("A.java", "class A { }")), "SEC-002"))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_texts_are_read_once(spark, java_files, tmp_path):
    """What the text rules and the clone rule need is stored in one pass: the plan of the findings reads no text."""
    path = str(tmp_path / "texts")
    java_files(("a/1", "same text here"), ("a/2", "same text here"), ("a/3", 'token = "x"')).write.parquet(path)
    found = text_audit(spark.read.parquet(path))
    assert path not in plan_of(found)
    assert sorted(r.rule_id for r in found.collect()) == ["DUP-001", "DUP-001", "SEC-001"]
