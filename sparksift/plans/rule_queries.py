"""One query per rule on planted Java files, with the answer stated from the columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import AuditConfig
from ..sources.tables import table
from .audit import rule_findings
from .planted import java, method, planted, repeat, when

PART = "(SELECT p_partkey AS k, p_size AS s FROM part)"


@dataclass(frozen=True)
class Case:
    """A rule, the files it reads, and its expected findings as SQL over ``k`` and ``s``."""

    rule_id: str
    content: str
    severity: str
    message: str
    line: str
    where: str

    def query(self, cfg: AuditConfig = AuditConfig()) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = rule_findings(planted(table(spark, sf_dir, "part"), self.content), self.rule_id, cfg)
            return found.select("file_name", "line_number", "severity", "message")

        return run

    def oracle(self, among: str = "true") -> str:
        return (
            f"SELECT concat('P', k, '.java') AS file_name, CAST({self.line} AS INTEGER) AS line_number, "
            f"{self.severity} AS severity, {self.message} AS message FROM {PART} WHERE ({self.where}) AND {among}"
        )


MAJOR, MINOR, CRITICAL = "'MAJOR'", "'MINOR'", "'CRITICAL'"
CALL = "'        o.go();'"
NESTED = lambda n: (
    repeat(n, "concat(repeat('    ', i + 1), 'if (a) {')"), "'        o.go();'", repeat(n, "'        }'")
)


def loop_of(body: str) -> tuple[str, str, str]:
    """A loop of one of four kinds; the rules leave do loops out."""
    head = (
        "element_at(array('        for (int i = 0; i < 9; i++) {', '        for (Svc q : o.all()) {', "
        "'        while (o.more()) {', '        do {'), cast(k % 4 as int) + 1)"
    )
    return head, body, "if(k % 4 = 3, '        } while (o.more());', '        }')"


def by(k: str, *choices: str) -> str:
    """SQL that is valid in both engines: the choice by a zero-based number."""
    cases = " ".join(f"WHEN {n} THEN {c}" for n, c in enumerate(choices))
    return f"CASE {k} {cases} END"


CASES: dict[str, Case] = {
    "smell_001_large_class": Case(
        "SMELL-001", java(repeat("k % 25", "concat('    void m', i, '() { }')")), MAJOR,
        "concat('Large class detected -> C', k, ' (', k % 25, ' methods)')", "2", "k % 25 > 10",
    ),
    "smell_002_many_params": Case(
        "SMELL-002",
        java("concat('    void m', k, '(', array_join(" + repeat("k % 7", "concat('Map<String, List<A>> p', i)") + ", ', '), ') {')", "'    }'"),
        MINOR, "concat('Too many parameters in method -> m', k, ' (', k % 7, ' params)')", "3", "k % 7 > 3",
    ),
    "smell_003_long_method": Case(
        "SMELL-003", method(repeat("s", "concat('        int v', i, ' = 0;')")), MAJOR,
        "concat('Long method detected -> run (', s + 2, ' lines)')", "3", "s + 2 > 30",
    ),
    "smell_004_empty_catch": Case(
        "SMELL-004",
        method("'        try {'", "'            o.go();'", "'        } catch (A e) {'", "'            // }'",
               when("k % 3 > 0", "'            o.log(e);'"), "'        }'"),
        MAJOR, "'Empty catch block detected'", "6", "k % 3 = 0",
    ),
    "smell_005_deep_nesting": Case(
        "SMELL-005", method(*NESTED("k % 7")), MAJOR,
        "concat('Deeply nested code in method -> run (depth: ', k % 7, ')')", "3", "k % 7 > 3",
    ),
    "smell_006_many_fields": Case(
        "SMELL-006", java(repeat("s", "concat('    int f', i, ', g', i, ' = 1;')"), "'    void go() { int local = 1; }'"), MAJOR,
        "concat('Too many fields in class -> C', k, ' (', s, ' fields)')", "2", "s > 15",
    ),
    "smell_007_god_class": Case(
        "SMELL-007", java(repeat("s", "concat('    int f', i, ';')"), repeat("k % 25", "concat('    void m', i, '() { }')")),
        CRITICAL, "concat('God Class detected -> C', k, ' (', k % 25, ' methods, ', s, ' fields)')", "2", "k % 25 > 10 AND s > 15",
    ),
    "smell_008_data_class": Case(
        "SMELL-008",
        java(repeat("3 + k % 3", "concat('    int get', i, '() { return 1; }')"), when("k % 2 = 0", "'    void work() { }'")),
        MINOR, "concat('Data Class detected -> C', k, ' (only getters/setters)')", "2", "3 + k % 3 >= 4 AND k % 2 = 1",
    ),
    "smell_009_feature_envy": Case(
        "SMELL-009",
        java("'    int f;'", "'    void run(Svc o) {'", repeat("k % 12", "'        o.go();'"), repeat("k % 4", "'        x = f;'"), "'    }'"),
        MINOR, "'Feature Envy in method -> run (uses external data more than own)'", "4", "k % 12 > 5 AND k % 12 > 2 * (k % 4)",
    ),
    "smell_010_boolean_param": Case(
        "SMELL-010",
        java("concat('    void run(', if(k % 2 = 0, 'boolean flag', 'int flag'), ', boolean[] many, ', "
             "if(k % 3 = 0, 'final Boolean other', 'String other'), ') {')", "'    }'"),
        MINOR, "concat('Boolean parameter ''', CASE WHEN k % 2 = 0 THEN 'flag' ELSE 'other' END, ''' in method -> run')", "3",
        "k % 2 = 0 OR k % 3 = 0",
    ),
    "smell_011_magic_number": Case(
        "SMELL-011", method("concat('        return ', s, ';')", "'        return \"x9\" + 0 + 1.0 + 100L + 0xFF + 1_000;'"), MINOR,
        "concat('Magic number ''', s, ''' in method -> run')", "4", "s > 1",
    ),
    "smell_012_generic_catch": Case(
        "SMELL-012",
        method("'        try {'", "'            o.go();'",
               "concat('        } catch (', element_at(array('Exception', 'Throwable', 'IOException'), cast(k % 3 as int) + 1), ' e) {')",
               "'            o.log(e);'", "'        }'"),
        MINOR, f"concat('Catching generic ', {by('k % 3', chr(39) + 'Exception' + chr(39), chr(39) + 'Throwable' + chr(39))}, ' is too broad')",
        "6", "k % 3 < 2",
    ),
    "smell_013_concat_in_loop": Case(
        "SMELL-013",
        method("'        x += 1;'", *loop_of(
            "element_at(array('            t += o.name();', '            o.put(\"a\" + o.name());', '            o.put(1 + 2);'), cast(k % 3 as int) + 1)")),
        "CASE k % 3 WHEN 0 THEN 'MAJOR' ELSE 'MINOR' END",
        "concat('String ', CASE k % 3 WHEN 0 THEN 'concatenation with ''+=''' ELSE 'literal concatenation with ''+''' END, ' inside a loop in method -> run')",
        "6", "k % 3 < 2 AND k % 4 < 3",
    ),
    "smell_014_switch_no_default": Case(
        "SMELL-014",
        method("'        switch (o.kind()) {'", "'            case 1:'", "'                o.go();'", "'                break;'",
               when("k % 2 = 1", "'            default:'"), when("k % 2 = 1", "'                o.stop();'"), "'        }'"),
        MINOR, "'switch statement missing ''default'' case'", "4", "k % 2 = 0",
    ),
    "smell_015_raw_type": Case(
        "SMELL-015",
        java("concat('    private final ', element_at(array('List', 'java.util.Map', 'List<String>', 'Set[]', 'String'), cast(k % 5 as int) + 1), ' f', k, ' = null;')"),
        MAJOR,
        "concat('Raw type usage -> ''', CASE k % 5 WHEN 0 THEN 'List' ELSE 'Map' END, ''' used without type parameter in field ''f', k, '''')",
        "3", "k % 5 < 2",
    ),
    "smell_016_null_return": Case(
        "SMELL-016",
        java("concat('    public static ', element_at(array('String', 'Map<String, List<A>>', 'Void', 'int[]'), cast(k % 4 as int) + 1), ' m', k, '() {')",
             "'        o.go();'", "if(k % 3 = 0, '        return null;', '        return made(null);')", "'    }'"),
        MAJOR,
        f"concat('Returning null from method -> ''m', k, ''' (return type: ', {by('k % 4', chr(39) + 'String' + chr(39), chr(39) + 'Map<String, List<A>>' + chr(39), chr(39) + chr(39), chr(39) + 'int[]' + chr(39))}, ')')",
        "5", "k % 3 = 0 AND k % 4 <> 2",
    ),
    "smell_017_empty_method": Case(
        "SMELL-017", method(when("k % 4 > 0", CALL), "'        // nothing; { }'"), MINOR, "'Empty method body -> run'", "3", "k % 4 = 0"
    ),
    "dead_001_unreachable": Case(
        "DEAD-001",
        method("'        if (o.bad()) return;'", "'        o.go();'",
               "element_at(array('        return;', '        throw o.error();', '        o.stop();'), cast(k % 3 as int) + 1)",
               "'        o.first();'", "'        o.second();'"),
        MAJOR, "concat('Unreachable statement after ''', CASE k % 3 WHEN 0 THEN 'return' ELSE 'throw' END, ''' in method -> run')",
        "7", "k % 3 < 2",
    ),
    "dead_002_unused_local": Case(
        "DEAD-002",
        method("concat('        int v', k, ' = 0, w = 1;')", "'        List<String> names = o.names(w);'",
               "if(k % 3 = 0, '        o.use(names);', concat('        o.use(v', k, ', names);'))"),
        MINOR, "concat('Unused variable -> v', k, ' in method -> run')", "3", "k % 3 = 0",
    ),
    "dead_003_unused_import": Case(
        "DEAD-003",
        "concat_ws('\\n', 'package p;', 'import java.util.*;', concat('import a.b.T', k, ';'), 'import static a.b.Util.help;', "
        "'class C {', if(k % 2 = 0, concat('    List<T', k, '> all;'), '    int all;'), '    int n = help;', '}')",
        MINOR, "concat('Unused import -> a.b.T', k)", "3", "k % 2 = 1",
    ),
    "dead_004_unused_private_method": Case(
        "DEAD-004",
        java("concat('    private void m', k, '() {')", "'    }'", "'    void run(Svc o) {'",
             "if(k % 3 = 0, concat('        o.on(this::m', k, ');'), concat('        this.m', k, '();'))", "'    }'"),
        MAJOR, "concat('Unused private method -> m', k, ' in class -> C', k)", "3", "k % 3 = 0",
    ),
    "dead_005_unused_private_field": Case(
        "DEAD-005",
        java("concat('    private String f', k, ' = null, used;')", "'    class In {'",
             "if(k % 3 = 0, concat('        void run(Svc o) { o.f', k, ' = used; }'), concat('        void run(Svc o) { f', k, ' = used; }'))", "'    }'"),
        MINOR, "concat('Unused private field -> f', k, ' in class -> C', k)", "3", "k % 3 = 0",
    ),
    "dead_006_unused_param": Case(
        "DEAD-006",
        java("concat('    void run(int p', k, ', String args) {')",
             "if(k % 4 = 0, concat('        o.p', k, '();'), concat('        o.go(() -> { return p', k, '; });'))", "'    }'",
             "concat('    abstract void none(int q', k, ');')"),
        MINOR, "concat('Unused parameter ''p', k, ''' in method -> run')", "3", "k % 4 = 0",
    ),
    "sec_001_hardcoded_secret": Case(
        "SEC-001",
        java("concat('    String ', element_at(array('dbPassword', 'API_KEY', 'title'), cast(k % 3 as int) + 1), k, ' = \"x', s, '\";')",
             "'    String secret = load(\"x\"), token;'"),
        CRITICAL, "concat('Hardcoded sensitive value -> ', CASE k % 3 WHEN 0 THEN 'dbPassword' ELSE 'API_KEY' END, k)", "3", "k % 3 < 2",
    ),
    "sec_002_sql_injection": Case(
        "SEC-002",
        method("concat('        q(\"', element_at(array('Select', 'INSERT', 'update', 'delete', 'drop', 'alter', 'truncate', 'call'), cast(k % 8 as int) + 1), ' t', s, ' \" + o.id() + \"x\", 1 + 2);')"),
        CRITICAL,
        f"concat('Possible SQL Injection -> \"', {by('k % 8', *[chr(39) + w + chr(39) for w in ('Select', 'INSERT', 'update', 'delete', 'drop', 'alter', 'truncate')])}, ' t', s, ' \" + o.id()')",
        "4", "k % 8 < 7",
    ),
    "sec_003_system_exit": Case(
        "SEC-003", method("element_at(array('        System.exit(1);', '        my.System.exit(1);', '        exit(1);'), cast(k % 3 as int) + 1)"),
        MAJOR, "'System.exit() usage detected'", "4", "k % 3 = 0",
    ),
    "sec_004_insecure_random": Case(
        "SEC-004", method("concat('        o.use(new ', if(k % 2 = 0, 'Random', 'SecureRandom'), '(', s, '));')"), MAJOR,
        "'Insecure random number generator -> java.util.Random'", "4", "k % 2 = 0",
    ),
    "sec_005_resource_leak": Case(
        "SEC-005",
        method("if(k % 3 = 0, '        try (A a = o.open()) {', '        try {')",
               "concat('            o.use(new ', element_at(array('FileReader', 'Socket', 'Scanner', 'StringReader'), cast(k % 4 as int) + 1), '(p));')",
               "'        } finally {'", "'            o.use(new Scanner(p));'", "'        }'"),
        MAJOR,
        f"concat('Potential resource leak -> ', {by('k % 4', *[chr(39) + w + chr(39) for w in ('FileReader', 'Socket', 'Scanner')])}, ' not in try-with-resources')",
        "5", "k % 3 > 0 AND k % 4 < 3",
    ),
    "sec_006_weak_hash": Case(
        "SEC-006", method("concat('        o.use(Digest.getInstance(\"', element_at(array('MD5', 'sha-1', 'SHA-256', 'Md5'), cast(k % 4 as int) + 1), '\"));')"),
        CRITICAL, "concat('Weak cryptographic algorithm used -> ', CASE k % 4 WHEN 0 THEN 'MD5' ELSE 'sha-1' END)", "4", "k % 4 < 2",
    ),
    "sec_007_ldap_injection": Case(
        "SEC-007", method("concat('        String f = \"', element_at(array('(cn=', '(uid=', '(ou='), cast(k % 3 as int) + 1), '\" + o.id();')"),
        CRITICAL, "concat('Possible LDAP Injection -> \"', CASE k % 3 WHEN 0 THEN '(cn=' ELSE '(uid=' END, '\" + o.id()')", "4", "k % 3 < 2",
    ),
    "sec_008_path_traversal": Case(
        "SEC-008", method("concat('        String f = ', if(k % 2 = 0, 'file', 'name'), ' + \"', if(k % 3 = 0, '..', if(k % 3 = 1, '/', '-')), '\";')"),
        CRITICAL, "concat('Possible Path Traversal -> file + \"', CASE k % 3 WHEN 0 THEN '..' ELSE '/' END, '\"')", "4", "k % 2 = 0 AND k % 3 < 2",
    ),
    "sec_009_command_exec": Case(
        "SEC-009", method("element_at(array('        Runtime.getRuntime().exec(c);', '        runtime.exec(c);', '        db.exec(Runtime.name());'), cast(k % 3 as int) + 1)"),
        CRITICAL, "'Runtime.exec() usage - potential command injection'", "4", "k % 3 < 2",
    ),
    "sec_010_stack_trace": Case(
        "SEC-010", method("element_at(array('        e.printStackTrace();', '        printStackTrace();', '        e.printStack();'), cast(k % 3 as int) + 1)"),
        MAJOR, "'printStackTrace() detected - stack trace may be exposed'", "4", "k % 3 < 2",
    ),
    "sec_011_thread_sleep": Case(
        "SEC-011", method("concat('        ', if(k % 2 = 0, 'Thread', 'unit'), '.sleep(', s, ');')"), MAJOR,
        "'Thread.sleep() detected in production code'", "4", "k % 2 = 0",
    ),
    "sec_012_hardcoded_ip_literal": Case(
        "SEC-012", method("concat('        o.to(\" ', if(k % 5 = 0, '127', '10'), '.', s, '.0.', k, ' \");')"), MAJOR,
        "concat('Hardcoded IP address -> \"10.', s, '.0.', k, '\"')", "4", "k % 5 <> 0 AND k < 1000",
    ),
    "sec_013_deserialisation": Case(
        "SEC-013", method("concat('        o.use(new ', if(k % 2 = 0, 'ObjectInputStream', 'DataInputStream'), '(in));')"), CRITICAL,
        "'Unsafe deserialization -> ObjectInputStream usage detected'", "4", "k % 2 = 0",
    ),
    "name_001_class_pascal": Case(
        "NAME-001",
        java(head="concat('final class ', element_at(array('Good', 'bad', 'Not_good', 'ALLUPPER'), cast(k % 4 as int) + 1), k, ' {')"), MINOR,
        f"concat('Class name ''', {by('k % 4', chr(39) + chr(39), *[chr(39) + w + chr(39) for w in ('bad', 'Not_good', 'ALLUPPER')])}, k, ''' does not follow PascalCase convention')",
        "2", "k % 4 > 0",
    ),
    "name_002_method_camel": Case(
        "NAME-002", java("concat('    void ', element_at(array('good', 'Bad', 'not_good'), cast(k % 3 as int) + 1), k, '() {')", "'    }'"), MINOR,
        "concat('Method name ''', CASE k % 3 WHEN 1 THEN 'Bad' ELSE 'not_good' END, k, ''' does not follow camelCase convention')",
        "3", "k % 3 > 0",
    ),
    "name_003_variable_camel": Case(
        "NAME-003",
        method("concat('        int ', element_at(array('good', 'Bad', 'not_good'), cast(k % 3 as int) + 1), k, ' = 1;')"), MINOR,
        "concat('Variable ''', CASE k % 3 WHEN 1 THEN 'Bad' ELSE 'not_good' END, k, ''' does not follow camelCase convention')",
        "4", "k % 3 > 0",
    ),
    "name_004_param_camel": Case(
        "NAME-004", java("concat('    void run(int X, List<String> ', if(k % 2 = 0, 'Bad', 'good'), k, ', int also_bad) {')", "'    }'"), MINOR,
        "concat('Parameter ''', CASE k % 2 WHEN 0 THEN concat('Bad', k) ELSE 'also_bad' END, ''' in method ''run'' does not follow camelCase')",
        "3", "true",
    ),
    "name_005_constant_upper": Case(
        "NAME-005",
        java("concat('    private static final long ', element_at(array('MAX_', 'serialVersion', 'Max_'), cast(k % 3 as int) + 1), k, ' = 1L;')",
             "concat('    static int lower', k, ' = 1;')"),
        MINOR, "concat('Constant ''', CASE k % 3 WHEN 1 THEN 'serialVersion' ELSE 'Max_' END, k, ''' does not follow UPPER_SNAKE_CASE convention')",
        "3", "k % 3 > 0",
    ),
    "name_006_single_letter": Case(
        "NAME-006", method("concat('        for (byte ', element_at(array('i', 'b', 'x', 'Q'), cast(k % 4 as int) + 1), ' : o.all()) {')", "'        }'"), MINOR,
        "concat('Single-letter variable name ''', CASE k % 4 WHEN 1 THEN 'b' ELSE 'Q' END, ''' is not descriptive')", "4", "k % 2 = 1",
    ),
    "name_007_vague_name": Case(
        "NAME-007", java("concat('    private int ', element_at(array('temp', 'Data', 'total', 'lst'), cast(k % 4 as int) + 1), ';')"), MINOR,
        f"concat('Non-descriptive variable name ''', {by('k % 4', *[chr(39) + w + chr(39) for w in ('temp', 'Data', 'total', 'lst')])}, '''')",
        "3", "k % 4 <> 2",
    ),
    "name_008_exception_suffix": Case(
        "NAME-008",
        java(head="concat('class Fail', k, if(k % 2 = 0, '', 'Exception'), ' extends ', element_at(array('a.b.IOException', 'Error', 'Base<RuntimeException>'), cast(k % 3 as int) + 1), ' implements A {')"),
        MINOR, "concat('Exception class ''Fail', k, ''' does not end with ''Exception''')", "2", "k % 2 = 0 AND k % 3 < 2",
    ),
    "name_009_test_name": Case(
        "NAME-009",
        java("if(k % 2 = 0, '    @Test', '    @Ignored(\"Test\")')",
             "concat('    public void ', element_at(array('checks', 'shouldWork', 'it_whenSet'), cast(k % 3 as int) + 1), k, '() {')", "'    }'"),
        MINOR, "concat('Test method ''checks', k, ''' does not follow a descriptive naming convention')", "3", "k % 2 = 0 AND k % 3 = 0",
    ),
    "met_001_cyclomatic": Case(
        "MET-001", method(repeat("k % 60", "'        if (o.ok()) { o.go(); }'")),
        "CASE WHEN 1 + k % 60 > 50 THEN 'CRITICAL' WHEN 1 + k % 60 > 20 THEN 'MAJOR' ELSE 'MINOR' END",
        "concat(CASE WHEN 1 + k % 60 > 50 THEN 'Very high' WHEN 1 + k % 60 > 20 THEN 'High' ELSE 'Moderate' END, ' cyclomatic complexity (', 1 + k % 60, ') in method -> run')",
        "3", "1 + k % 60 > 10",
    ),
    "met_002_cognitive": Case(
        "MET-002", method(*NESTED("k % 11")),
        "CASE WHEN (k % 11) * (k % 11 + 1) / 2 > 45 THEN 'CRITICAL' WHEN (k % 11) * (k % 11 + 1) / 2 > 30 THEN 'MAJOR' ELSE 'MINOR' END",
        "concat('High cognitive complexity (', CAST((k % 11) * (k % 11 + 1) / 2 AS BIGINT), ') in method -> run')",
        "3", "(k % 11) * (k % 11 + 1) / 2 > 15",
    ),
    "doc_001_missing_doc": Case(
        "DOC-001",
        java("if(k % 2 = 0, '    /* plain { */', '    /** Told. } */')", "concat('    ', if(k % 5 = 0, 'protected', 'public'), ' void m', k, '() {')", "'    }'"),
        MINOR, "concat('Missing Javadoc on public method -> m', k)", "4", "k % 2 = 0 AND k % 5 > 0",
    ),
}


def of_case(key: str, choice: str) -> str:
    """SQL: the entry of the case that a part's file is written by."""
    cases = " ".join(f"WHEN {n} THEN {getattr(case, choice)}" for n, case in enumerate(CASES.values()))
    return f"CASE {key} % {len(CASES)} {cases} END"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: case.query() for key, case in CASES.items()}


def oracles() -> dict[str, str]:
    return {key: case.oracle() for key, case in CASES.items()}
