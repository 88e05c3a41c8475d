"""The whole audit over one corpus: every finding, planted or not, stated from the columns.

File ``k`` is written by the case ``k % N`` of ``rule_queries``. Besides its planted rule a case has findings of other
rules; all of them are listed here. As N is a multiple of 2, 3, 4, 6, 8 and 12, those remainders of ``k`` are the same for all files of a case.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .audit import audit
from .audit_queries import GRADED, LOW_INDEX, PERCENT, index_sql
from .fact_queries import clones_sql
from .planted import planted
from .rule_queries import CASES, PART, of_case

SHOWN = ["file_name", "rule_id", "line_number", "severity", "message"]
NUMBER = {key: n for n, key in enumerate(CASES)}


def full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of all rules."""
    return audit(planted(table(spark, sf_dir, "part"), of_case("k", "content"))).select(*SHOWN)


def of(*keys: str) -> str:
    """Files of these cases."""
    return f"k % {len(CASES)} IN ({', '.join(str(NUMBER[key]) for key in keys)})"


def say(text: str) -> str:
    """SQL for a message with the columns in braces."""
    parts = re.split(r"\{(.*?)\}", text.replace("'", "''"))
    return "concat(" + ", ".join(part if i % 2 else f"'{part}'" for i, part in enumerate(parts)) + ", '')"


UNUSED_O = [
    "smell_003_long_method", "smell_011_magic_number", "smell_017_empty_method", "sec_003_system_exit", "sec_008_path_traversal", "sec_009_command_exec",
    "sec_010_stack_trace", "sec_011_thread_sleep", "name_003_variable_camel",
]
OTHER_HEADS = ["name_001_class_pascal", "name_008_exception_suffix", "dead_003_unused_import"]
BAND = "CASE WHEN k % 60 > 45 THEN 'CRITICAL' WHEN k % 60 > 30 THEN 'MAJOR' ELSE 'MINOR' END"
# (cases, rule, line, severity, message, condition): findings besides the planted rule.
ALSO = [
    ([c for c in CASES if c not in OTHER_HEADS], "NAME-001", "2", "MINOR", "Class name 'C{k}' does not follow PascalCase convention", "true"),
    (["dead_003_unused_import"], "NAME-001", "5", "MINOR", "Class name 'C' does not follow PascalCase convention", "true"),
    (UNUSED_O, "DEAD-006", "3", "MINOR", "Unused parameter 'o' in method -> run", "true"),
    (["dead_004_unused_private_method"], "DEAD-006", "5", "MINOR", "Unused parameter 'o' in method -> run", "true"),
    (["smell_002_many_params"], "DEAD-006", "3", "MINOR", "Unused parameter 'p1' in method -> m{k}", "k % 7 > 0"),
    (["smell_010_boolean_param"], "DEAD-006", "3", "MINOR", "Unused parameter 'flag' in method -> run", "true"),
    (["name_004_param_camel"], "DEAD-006", "3", "MINOR", "Unused parameter 'X' in method -> run", "true"),
    (["smell_002_many_params", "dead_004_unused_private_method"], "SMELL-017", "3", "MINOR", "Empty method body -> m{k}", "true"),
    (["doc_001_missing_doc"], "SMELL-017", "4", "MINOR", "Empty method body -> m{k}", "true"),
    (["smell_010_boolean_param", "name_004_param_camel"], "SMELL-017", "3", "MINOR", "Empty method body -> run", "true"),
    (["name_002_method_camel"], "SMELL-017", "3", "MINOR", "Empty method body -> Bad{k}", "true"),
    (["name_009_test_name"], "SMELL-017", "3", "MINOR", "Empty method body -> it_whenSet{k}", "true"),
    (["name_009_test_name"], "NAME-002", "3", "MINOR", "Method name 'it_whenSet{k}' does not follow camelCase convention", "true"),
    (["name_009_test_name"], "DOC-001", "3", "MINOR", "Missing Javadoc on public method -> it_whenSet{k}", "true"),
    (["smell_016_null_return"], "DOC-001", "3", "MINOR", "Missing Javadoc on public method -> m{k}", "true"),
    (["smell_003_long_method"], "DEAD-002", "3", "MINOR", "Unused variable -> v1 in method -> run", "true"),
    (["smell_006_many_fields"], "DEAD-002", "s + 3", "MINOR", "Unused variable -> local in method -> go", "true"),
    (["sec_005_resource_leak"], "DEAD-002", "3", "MINOR", "Unused variable -> a in method -> run", "true"),
    (["sec_007_ldap_injection", "sec_008_path_traversal"], "DEAD-002", "3", "MINOR", "Unused variable -> f in method -> run", "true"),
    (["name_003_variable_camel"], "DEAD-002", "3", "MINOR", "Unused variable -> not_good{k} in method -> run", "true"),
    (["name_006_single_letter"], "DEAD-002", "3", "MINOR", "Unused variable -> b in method -> run", "true"),
    (["smell_009_feature_envy"], "NAME-006", "3", "MINOR", "Single-letter variable name 'f' is not descriptive", "true"),
    (["dead_002_unused_local"], "NAME-006", "4", "MINOR", "Single-letter variable name 'w' is not descriptive", "true"),
    (["dead_003_unused_import"], "NAME-006", "7", "MINOR", "Single-letter variable name 'n' is not descriptive", "true"),
    (["sec_005_resource_leak"], "NAME-006", "4", "MINOR", "Single-letter variable name 'a' is not descriptive", "true"),
    (["sec_007_ldap_injection", "sec_008_path_traversal"], "NAME-006", "4", "MINOR", "Single-letter variable name 'f' is not descriptive", "true"),
    (["smell_015_raw_type"], "DEAD-005", "3", "MINOR", "Unused private field -> f{k} in class -> C{k}", "true"),
    (["name_005_constant_upper"], "DEAD-005", "3", "MINOR", "Unused private field -> serialVersion{k} in class -> C{k}", "true"),
    (["name_007_vague_name"], "DEAD-005", "3", "MINOR", "Unused private field -> total in class -> C{k}", "true"),
    (["smell_011_magic_number"], "DEAD-001", "5", "MAJOR", "Unreachable statement after 'return' in method -> run", "true"),
    (["smell_013_concat_in_loop"], "SMELL-011", "5", "MINOR", "Magic number '9' in method -> run", "true"),
    (["sec_002_sql_injection"], "SMELL-011", "4", "MINOR", "Magic number '2' in method -> run", "true"),
    (["sec_004_insecure_random", "sec_011_thread_sleep"], "SMELL-011", "4", "MINOR", "Magic number '{s}' in method -> run", "s > 1"),
    (["smell_007_god_class"], "SMELL-001", "2", "MAJOR", "Large class detected -> C{k} ({k % 25} methods)", "k % 25 > 10"),
    (["smell_007_god_class"], "SMELL-006", "2", "MAJOR", "Too many fields in class -> C{k} ({s} fields)", "s > 15"),
    (["smell_005_deep_nesting"], "MET-002", "3", "MINOR", "High cognitive complexity (21) in method -> run", "k % 7 = 6"),
    (["met_001_cyclomatic"], "MET-002", "3", None, "High cognitive complexity ({k % 60}) in method -> run", "k % 60 > 15"),
    (["met_001_cyclomatic"], "SMELL-003", "3", "MAJOR", "Long method detected -> run ({3 * (k % 60) + 2} lines)", "3 * (k % 60) + 2 > 30"),
    (["met_001_cyclomatic"], "SMELL-009", "3", "MINOR", "Feature Envy in method -> run (uses external data more than own)", "2 * (k % 60) > 5"),
    (["met_002_cognitive"], "MET-001", "3", "MINOR", "Moderate cyclomatic complexity (11) in method -> run", "k % 11 = 10"),
    (["met_002_cognitive"], "SMELL-005", "3", "MAJOR", "Deeply nested code in method -> run (depth: {k % 11})", "k % 11 > 3"),
]
# Code lines of files that can be large.
CODE = {"smell_003_long_method": "s + 4", "smell_006_many_fields": "s + 5", "smell_007_god_class": "s + 2 * (k % 25) + 2", "met_001_cyclomatic": "3 * (k % 60) + 4"}

# Printed bodies whose words and lines don't depend on k and s but for names: (case, line, method, complexity, body).
BODIES = [
    ("smell_004_empty_catch", "3", "'run'", 2, "{\ntry {\no.go();\n} catch (A e) {\n// }\n}\n}"),
    ("smell_006_many_fields", "s + 3", "'go'", 1, "{\nint local = 1;\n}"),
    *[("smell_008_data_class", str(2 + i), f"'get{i}'", 1, "{\nreturn 1;\n}") for i in range(1, 5)],
    ("smell_009_feature_envy", "4", "'run'", 1, "{\n" + "o.go();\n" * 8 + "}"),
    ("smell_011_magic_number", "3", "'run'", 1, '{\nreturn s;\nreturn "x9" + 0 + 1.0 + 100L + 0xFF + 1_000;\n}'),
    ("smell_012_generic_catch", "3", "'run'", 2, "{\ntry {\no.go();\n} catch (IOException e) {\no.log(e);\n}\n}"),
    ("smell_013_concat_in_loop", "3", "'run'", 2, "{\nx += 1;\nfor (int i = 0; i < 9; i++) {\nt += o.name();\n}\n}"),
    ("smell_014_switch_no_default", "3", "'run'", 3, "{\nswitch(o.kind()) {\ncase 1:\no.go();\nbreak;\ndefault:\no.stop();\n}\n}"),
    ("smell_016_null_return", "3", "concat('m', k)", 1, "{\no.go();\nreturn null;\n}"),
    ("smell_017_empty_method", "3", "'run'", 1, "{\n// nothing; { }\n}"),
    ("dead_001_unreachable", "3", "'run'", 2, "{\nif (o.bad())\nreturn;\no.go();\no.stop();\no.first();\no.second();\n}"),
    ("dead_002_unused_local", "3", "'run'", 1, "{\nint v = 0, w = 1;\nList<String> names = o.names(w);\no.use(names);\n}"),
    ("dead_004_unused_private_method", "5", "'run'", 1, "{\nthis.m();\n}"),
    ("dead_005_unused_private_field", "5", "'run'", 1, "{\no.f = used;\n}"),
    ("dead_006_unused_param", "3", "'run'", 1, "{\no.go(() -> {\nreturn p;\n});\n}"),
    ("sec_002_sql_injection", "3", "'run'", 1, '{\nq("Select t " + o.id() + "x", 1 + 2);\n}'),
    ("sec_003_system_exit", "3", "'run'", 1, "{\nmy.System.exit(1);\n}"),
    ("sec_004_insecure_random", "3", "'run'", 1, "{\no.use(new Random(s));\n}"),
    ("sec_005_resource_leak", "3", "'run'", 1, "{\ntry (A a = o.open()) {\no.use(new StringReader(p));\n} finally {\no.use(new Scanner(p));\n}\n}"),
    ("sec_006_weak_hash", "3", "'run'", 1, '{\no.use(Digest.getInstance("MD5"));\n}'),
    ("sec_007_ldap_injection", "3", "'run'", 1, '{\nString f = "(ou=" + o.id();\n}'),
    ("sec_008_path_traversal", "3", "'run'", 1, '{\nString f = file + "..";\n}'),
    ("sec_009_command_exec", "3", "'run'", 1, "{\nruntime.exec(c);\n}"),
    ("sec_010_stack_trace", "3", "'run'", 1, "{\ne.printStack();\n}"),
    ("sec_011_thread_sleep", "3", "'run'", 1, "{\nunit.sleep(s);\n}"),
    ("sec_012_hardcoded_ip_literal", "3", "'run'", 1, '{\no.to(" 10.s.0.k ");\n}'),
    ("sec_013_deserialisation", "3", "'run'", 1, "{\no.use(new DataInputStream(in));\n}"),
    ("name_003_variable_camel", "3", "'run'", 1, "{\nint not_good = 1;\n}"),
    ("name_006_single_letter", "3", "'run'", 2, "{\nfor (byte b : o.all()) {\n}\n}"),
]


def counted(body: str) -> tuple[str, str]:
    """Words and lines of a body."""
    return str(len(re.split(r"\s+|[;{}()\[\],.]", body.rstrip(" \n;{}()[],.")))), str(body.count("\n") + 1)


# (case, line, method, words, lines, complexity) of all bodies; of repeated statements the separators are counted as in ``audit_queries``.
METHODS = [(case, line, name, *counted(body), str(cc)) for case, line, name, cc, body in BODIES] + [
    ("smell_003_long_method", "3", "'run'", "5 * s + 1", "s + 2", "1"),
    ("smell_005_deep_nesting", "3", "'run'", "6 * (k % 7) + 4", "2 * (k % 7) + 3", "1 + k % 7"),
    ("met_002_cognitive", "3", "'run'", "6 * (k % 11) + 4", "2 * (k % 11) + 3", "1 + k % 11"),
    ("met_001_cyclomatic", "3", "'run'", "16 * (k % 60) - 3", "3 * (k % 60) + 2", "1 + k % 60"),
]
# What makes bodies of three and more statements equal: (line, key, condition).
COPIES = {
    "smell_003_long_method": ("3", "s", "s >= 3"), "smell_009_feature_envy": ("4", "0", "true"), "dead_001_unreachable": ("3", "0", "true"),
    "met_001_cyclomatic": ("3", "k % 60", "k % 60 >= 3"),
}


def full_audit_sql() -> str:
    n = len(CASES)
    file = "concat('P', k, '.java') AS file_name"
    parts = [
        f"SELECT file_name, '{case.rule_id}' AS rule_id, line_number, severity, message FROM ({case.oracle(f'k % {n} = {i}')})" for i, case in enumerate(CASES.values())
    ]
    for keys, rule, line, severity, message, where in ALSO:
        shown = BAND if severity is None else f"'{severity}'"
        parts.append(f"SELECT {file}, '{rule}', CAST({line} AS INTEGER), {shown}, {say(message)} FROM {PART} WHERE {of(*keys)} AND {where}")
    for key, first in (("smell_001_large_class", "3"), ("smell_007_god_class", "3 + s")):
        parts.append(
            "SELECT file_name, 'SMELL-017', CAST(first + i AS INTEGER), 'MINOR', concat('Empty method body -> m', i + 1) FROM "
            f"(SELECT {file}, {first} AS first, unnest(range(k % 25)) AS i FROM {PART} WHERE {of(key)})"
        )
    for key, code in CODE.items():
        parts.append(
            f"SELECT file_name, 'MET-004', CAST(1 AS INTEGER), 'MINOR', concat('Low comment-to-code ratio in ', file_name, ' (', {PERCENT}, '%)') FROM "
            f"(SELECT {file}, 2 AS comments, {code} AS code FROM {PART} WHERE {of(key)}) WHERE code > 50 AND 2.0 / code < 0.1"
        )
    measured = " UNION ALL ".join(
        f"SELECT {file}, CAST({line} AS INTEGER) AS line_number, {name} AS name, 85 AS grade_a, 65 AS grade_b, {index_sql(words, lines, cc)} AS mi FROM {PART} WHERE {of(case)}"
        for case, line, name, words, lines, cc in METHODS
    )
    low = LOW_INDEX.replace(") in method -> run')", ") in method -> ', name)")
    parts.append(
        f"SELECT file_name, 'MET-005', line_number, CASE grade WHEN 'B' THEN 'MINOR' ELSE 'MAJOR' END, {low} FROM (SELECT *, {GRADED} AS grade FROM ({measured})) WHERE grade <> 'A'"
    )
    items = " UNION ALL ".join(
        f"SELECT concat('P', k, '.java') AS path, concat('P', k, '.java') AS base, 'run' AS label, {line} AS line, concat('{key} ', {same}) AS hash FROM {PART} WHERE {of(key)} AND {where}"
        for key, (line, same, where) in COPIES.items()
    )
    parts.append(f"SELECT path, 'DUP-001', CAST(line_number AS INTEGER), severity, message FROM ({clones_sql(items)})")
    return " UNION ALL ".join(parts)


def queries() -> dict:
    return {"full_audit": full_audit}


def oracles() -> dict[str, str]:
    return {"full_audit": full_audit_sql()}
