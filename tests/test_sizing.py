"""Texts are dealt to parts that a task can sort in memory, and tokens are compared as numbers."""

from pyspark.sql import functions as F

from sparksift.functions.sql import BLOCK_CODES, BLOCK_KINDS, CODED, CODES, coded
from sparksift.operators.tokens import PART_TEXT, lex, sized_parts, text_parts, tokens
from sparksift.plans import planted as P
from sparksift.plans.audit_queries import project_limits


def test_parts_follow_the_size_of_the_text(spark):
    """4 shuffle partitions would hold the tokens of 2 MB each."""
    files = spark.range(64).selectExpr("concat('F', id, '.java') AS path", f"repeat(' ', {PART_TEXT // 8}) AS content")
    assert text_parts(files) < 8 and sized_parts(files) == 8
    assert lex(files).rdd.getNumPartitions() == 8
    assert sized_parts(files.limit(0)) == text_parts(files)


def test_texts_are_rendered_by_many_tasks(spark):
    """A table of one row group is read by one task."""
    part = spark.range(1000).coalesce(1).selectExpr("id AS p_partkey", "1 AS p_size")
    rendered = P.planted(part, "concat('class C', k, ' { }')")
    assert rendered.select(F.spark_partition_id()).distinct().count() > 1


def test_codes_say_the_same_as_texts(java_files):
    assert len(set(CODED)) == len(CODED) and 0 not in CODES.values()
    assert coded("p1 IN ('(', ')') AND NOT tok = 'if' AND n1 IS NULL") == f"c_p1 IN (1, 2) AND NOT c_tok = {CODES['if']} AND c_n1 IS NULL"
    # no word with a code, and values: text
    assert coded("tok = 'main' AND p1 = class_name AND concat(p1, n2)") == "tok = 'main' AND p1 = class_name AND concat(p1, n2)"
    text = "class A<T> { int yield = 1; String record(List<List<T>> a) { return a -> !b ? \"(\" : '('; } }"
    for row in tokens(java_files(("A.java", text))).collect():
        for name in ("tok", "p1", "p2", "p3", "n1", "n2", "n3", "n4", "head"):
            value = row[name]
            literal = name == "tok" and row.kind in "sc"
            assert row[f"c_{name}"] == (None if value is None else 0 if literal else CODES.get(value, 0)), (name, value)


def test_kinds_of_brackets_are_held_as_codes(java_files):
    assert BLOCK_KINDS == sorted(set(BLOCK_KINDS)) and coded("inner_bk = 'arr' OR inner_bk IS NULL") == f"c_inner_bk = {BLOCK_CODES['arr']} OR c_inner_bk IS NULL"
    text = "import a.B; record R(int a) { R { } int[] f = {1}; void m(A a) throws E { for (;;) { } try (B b = c()) { } catch (D d) { } new X(1) { int g; }; } }"
    facts = tokens(java_files(("A.java", text)))
    names = ["inner_bk", "closed_bk", "encl_bk", "decl_owner_kind"]
    for row in facts.collect():
        for name in names:
            assert row[f"c_{name}"] == (None if row[name] is None else BLOCK_CODES[row[name]]), (name, row.tok)
    # the rows that are sorted hold texts of a token and its path, and of the words that are compared with each other
    plan = facts.filter("starts AND inner_bk = 'method'").select("path", "pos", "tok")._jdf.queryExecution().sparkPlan().toString()
    assert "c_inner_bk" in plan and not any(f" AS {name}#" in plan for name in names)


def test_limits_by_project_lex_members_once(spark, tmp_path):
    """Classes and methods come from members that are stored; only the file measures read the tokens again."""
    spark.createDataFrame([(1, 3), (2, 40)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    plan = project_limits(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode(") == 1
