"""Queries for sources, structural facts, metrics and whole-text operators, with their oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions import text as tx
from ..operators import text_rules as T
from ..operators.clones import clone_findings, clone_groups, method_items, stored_items
from ..operators.findings import findings_dedup
from ..operators.members import class_rollup, members, methods
from ..operators.rules import file_rules, with_maintainability
from ..operators.tokens import rejects, tokens
from ..session import ensure_checkpoint_dir
from ..sources.files import scan_sources, uploaded_sources
from ..sources.tables import table
from .planted import java, method, planted, repeat, spread, when
from .rule_queries import NESTED, PART

Query = Callable[[SparkSession, str], DataFrame]
FILE = "concat('P', k, '.java') AS file_name"


def file_name() -> Column:
    return F.col("path").alias("file_name")


def on_part(content: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(planted(table(spark, sf_dir, "part"), content))


def on_documents(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(table(spark, sf_dir, "documents"))


# Sources -----------------------------------------------------------------


def write_files(named: DataFrame, folder: str) -> None:
    """Writes (name, content) as files below a folder that all executors share, one folder for each first letter of a name."""

    def run(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        for row in rows:
            store.create_dir(f"{base}/{row.name[0]}", recursive=True)
            with store.open_output_stream(f"{base}/{row.name[0]}/{row.name}") as out:
                out.write(bytes(row.content))

    named.foreachPartition(run)


# Of four parts one is a source, one has a byte that is no UTF-8, and two have other suffixes.
SCAN_NAME = "concat(element_at(array('A', 'B', 'C', 'D'), cast(k % 4 as int) + 1), k, element_at(array('.java', '.java', '.JAVA', '.txt'), cast(k % 4 as int) + 1))"


def scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write parts as a tree of files, whole bytes and suffixes of both cases, and scan the tree for sources."""
    folder = f"{ensure_checkpoint_dir(spark)}/scan-{uuid.uuid4()}"
    parts = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("text")), "k")
    odd = F.when(F.col("k") % 4 == 1, F.lit(b"\xe9")).otherwise(F.lit(b""))
    write_files(parts.select(F.expr(SCAN_NAME).alias("name"), F.concat(F.encode("text", "UTF-8"), odd, F.encode(F.lit("\n"), "UTF-8")).alias("content")), folder)
    return scan_sources(spark, folder).select(
        F.substring_index("path", "/", -2).alias("place"), "file_name", F.sha2(F.encode("content", "UTF-8"), 256).alias("content_sha256"),
        F.length("content").alias("n_chars"),
    )


def upload_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    suffix = F.when(k % 3 == 0, ".java").when(k % 3 == 1, ".JAVA").otherwise(".txt")
    uploads = table(spark, sf_dir, "part").select(
        F.concat(F.lit("F"), (k % 700).cast("string"), suffix).alias("name"), F.col("p_name").alias("content"),
        k.alias("upload_ord"),
    )
    return uploaded_sources(uploads).select("file_name", "content", "upload_ord")


TOKEN_FILE = java(repeat("k % 9", "concat('    int v', i, ' = ', s, '; // {')"))
REJECT_FILE = java("'    void run() {'", when("k % 5 <> 0", "'    }'"), when("k % 5 = 1", "'    )'"))


def token_counts(files: DataFrame) -> DataFrame:
    kind = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return tokens(files).groupBy("path").agg(
        F.count("*").alias("n_tokens"), kind("i").alias("n_identifiers"), kind("k").alias("n_keywords"),
        kind("n").alias("n_numbers"), F.max("line").alias("last_line"), F.max("lvl").alias("deepest"),
    ).select(file_name(), "n_tokens", "n_identifiers", "n_keywords", "n_numbers", "last_line", "deepest")


# Structural facts --------------------------------------------------------

CLASS_FILE = java(
    repeat("s % 6", "concat('    private int f', i, ' = ', i, ', g', i, ';')"),
    repeat("k % 3", "concat('    C', k, '(', repeat('int a, ', i), 'int z) { }')"),
    repeat("k % 7", "concat('    abstract List<A> m', i, '(int a);')"),
    "'    static class In { void x() { int local = 1; } }'",
    head="concat('public class C', k, '<T extends A', repeat('<B', cast(k % 7 as int)), repeat('>', cast(k % 7 as int)), '> extends a.Base', s, "
    "repeat('<T', cast(k % 7 + 1 as int)), repeat('>', cast(k % 7 + 1 as int)), ' implements A, b.B<T> {')",
)


def class_profiles(files: DataFrame) -> DataFrame:
    return class_rollup(tokens(files)).select(
        file_name(), "class_name", "n_methods", "n_fields", "n_constructors",
        F.array_join("extended", ",").alias("extends"), F.array_join("implemented", ",").alias("implements"),
    )


METHOD_FILE = java(
    "concat('    ', element_at(array('public ', 'protected static ', '@A private final ', ''), cast(k % 4 as int) + 1), "
    "element_at(array('void', 'int[]', 'Map<String, List<A>>'), cast(k % 3 as int) + 1), ' m', k, '(', "
    "array_join(" + repeat("k % 5", "concat('final int[] a', i)") + ", ', '), ') {')",
    repeat("s", "'        o.go();'"), "'    }'", "concat('    abstract <T extends A', repeat('<B', cast(k % 7 as int)), repeat('>', cast(k % 7 as int)), '> T none(T t);')",
)


def method_profiles(files: DataFrame) -> DataFrame:
    found = with_maintainability(methods(tokens(files)))
    lines = F.when(F.col("has_body"), F.col("body_lines")).otherwise(0).cast("int")
    return found.select(
        file_name(), "name", "visibility", "return_type", F.col("n_params").cast("int").alias("n_params"), lines.alias("body_lines")
    )


NAMES_FILE = method(
    "concat('        use(a', k % 3, ', b.c, d(), this.e);')", "'        Foo.Bar y = (Foo) x;'", repeat("k % 4", "'        y = x;'")
)
CALLS_FILE = method(repeat("k % 4", "'        svc.go(new Box(1));'"), repeat("k % 3", "'        run();'"), "'        this.end();'")
TYPES_FILE = java("concat('    private List<T', k % 3, '> f = new Box();')", when("k % 2 = 0", "'    void m(int a, Foo[] b) throws Bad { x = b instanceof Baz; }'"))


def uses(flag: str, *extra: str) -> Callable[[DataFrame], DataFrame]:
    def build(files: DataFrame) -> DataFrame:
        found = tokens(files).filter(flag).groupBy("path", F.col("tok").alias("name"), *[F.col(c) for c in extra])
        return found.agg(F.count("*").alias("n")).select(file_name(), "name", *extra, "n")

    return build


def call_uses(files: DataFrame) -> DataFrame:
    found = tokens(files).filter("is_call").groupBy("path", F.col("tok").alias("name"), F.col("is_scoped_call").alias("scoped"))
    return found.agg(F.count("*").alias("n")).select(file_name(), "name", F.col("scoped").cast("int").alias("scoped"), "n")


# Metrics -----------------------------------------------------------------

LINE_FILE = (
    "concat_ws('\\n', " + ", ".join([
        repeat("k % 5", "'  // note'"), when("k % 2 = 0", "'/* open'"), when("k % 2 = 0", "'  '"), when("k % 2 = 0", "' done */ x'"),
        repeat("k % 3", "'\\t'"), repeat("s", "'x = 1; // y'"),
    ]) + ")"
)
COMMENTS, BLANKS = "(k % 5 + CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END)", "(k % 3 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)"


def line_profiles(files: DataFrame) -> DataFrame:
    return files.select(file_name(), tx.line_profile(F.col("content")).alias("p")).select("file_name", "p.total", "p.code", "p.comment", "p.blank")


def comment_ratios(files: DataFrame) -> DataFrame:
    return files.select(file_name(), F.round(tx.comment_ratio(tx.line_profile(F.col("content"))), 6).alias("ratio"))


BRANCH_FILE = method(
    repeat("k % 5", "'        if (a) x = 1; else x = 2;'"), repeat("k % 3", "'        for (int i = 0; i < n; i++) { go(); }'"),
    when("k % 4 = 0", "'        do { go(); } while (a);'"), when("k % 4 = 1", "'        while (a) { go(); }'"),
    "'        switch (x) {'", repeat("k % 6", "concat('            case ', i, ': break;')"), "'            default: go();'", "'        }'",
    when("k % 2 = 0", "'        try { go(); } catch (A e) { go(); }'"), repeat("s % 4", "'        y = a && b || c ? 1 : 2;'"),
)
BRANCHES = (
    "1 + k % 5 + k % 3 + CASE WHEN k % 4 < 2 THEN 1 ELSE 0 END + k % 6 + 1 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + 2 * (s % 4)"
)

COGNITIVE_FILE = method(
    *NESTED("k % 8"),
    when("k % 3 = 0", "'        while (a) { if (b && c) { x(); } else { y(); } }'"),
    when("k % 5 = 0", "'        try { a(); } catch (E e) { if (b) { c(); } }'"),
    when("k % 4 = 0", "'        int z = a ? 1 : 2;'"),
    when("k % 7 = 0", "'        switch (a) { case 1: if (b) { c(); } }'"),
    when("k % 6 = 0", "'        if (a) { b(); } else if (c && d) { e(); } else { if (f) { g(); } }'"),
    when("k % 9 = 0", "'        outer: for (;;) { continue outer; }'"),
    when("k % 9 = 1", "'        for (;;) { if (a) { x = b ? 1 : 2; } break outer; }'"),
)
COGNITIVE = (
    "(k % 8) * (k % 8 + 1) / 2 + CASE WHEN k % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 3 ELSE 0 END "
    "+ CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 2 ELSE 0 END "
    # A loop under a label is not looked into. In the other one: the loop 1, the if 2, a ternary under three blocks 6, the break 1.
    "+ CASE WHEN k % 9 = 1 THEN 10 ELSE 0 END"
)


def measure(column: str, *, cast: str = "int") -> Callable[[DataFrame], DataFrame]:
    def build(files: DataFrame) -> DataFrame:
        found = methods(tokens(files), with_text=False)
        return found.select(file_name(), "name", F.col(column).cast(cast).alias(column))

    return build


WORDS = r"\s+|[;{}()\[\],.]"
DOC_LINES = "len(string_split(regexp_replace(text, '\\n+$', ''), chr(10)))"
DOC_BODY = r"regexp_replace(text, '(?:\s+|[;{}()\[\],.])+$', '')"
DOC_WORDS = rf"len(regexp_split_to_array({DOC_BODY}, '{WORDS}'))"
DOC_MI = (
    "SELECT doc_id, source, lines, words, greatest(0.0, least(171.0, 171.0 - 5.2 * ln(greatest(1.0, words * ln(words) / ln(2))) - 0.23 "
    "- 16.2 * ln(lines))) / 171.0 * 100.0 AS mi FROM (SELECT doc_id, source, "
    f"CAST({DOC_LINES} AS INTEGER) AS lines, CAST({DOC_WORDS} AS INTEGER) AS words FROM documents)"
)
NORMAL = (
    r"regexp_replace(regexp_replace(text, '//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|\s+', ' ', 'g'), "
    r"'^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
)
GRADE = "CASE WHEN mi >= 85 THEN 'A' WHEN mi >= 65 THEN 'B' ELSE 'C' END"


def document_measures(documents: DataFrame) -> DataFrame:
    found = T.text_maintainability(T.document_files(documents))
    return found.select(
        F.substring_index("path", "/", -1).cast("long").alias("doc_id"), F.col("body_lines").alias("lines"),
        F.col("body_words").alias("words"), F.round("mi", 6).alias("mi"),
    )


def document_grades(documents: DataFrame) -> DataFrame:
    found = T.text_maintainability(T.document_files(documents))
    return found.select(
        F.substring_index("path", "/", -1).cast("long").alias("doc_id"), tx.maintainability_grade(F.col("mi")).alias("grade")
    )


SHOWN = ["path", "line_number", "severity", "message"]
FEW_LINES = AuditConfig(max_file_loc=30, min_commented_loc=25)


def doc_findings(build: Callable[[DataFrame], DataFrame]) -> Query:
    return on_documents(lambda d: findings_dedup(build(T.document_files(d))).select(*SHOWN))


LINES_OF_DOCS = (
    "SELECT path, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_number FROM "
    "(SELECT concat(source, '/', doc_id) AS path, string_split(text, chr(10)) AS l FROM documents)"
)
# Words that are given a quoted text and hold a sensitive term; whole runs of digits and dots that begin with an address of their own.
SECRET_LIST = (
    "list_filter(regexp_extract_all(line, '([A-Za-z0-9_]+)[ \t]*=[ \t]*\"[^\"]*\"', 1), lambda w: regexp_matches(lower(w), "
    "'password|passwd|pwd|pass|secret|apikey|api_key|token|credentials|privatekey|private_key'))"
)
ADDRESS_LIST = (
    r"list_transform(list_filter(regexp_extract_all(line, '[0-9.]+'), lambda r: regexp_full_match(r, '[0-9]{1,3}(\.[0-9]{1,3}){3}(\.|\.\..*)?')), "
    r"lambda r: regexp_extract(r, '^[0-9]{1,3}(\.[0-9]{1,3}){3}'))"
)


def matches_sql(found: str) -> str:
    """(path, line_number, m, nth) of the list that an expression finds in a line."""
    return (
        "SELECT path, line_number, unnest(ms) AS m, unnest(range(len(ms))) AS nth FROM "
        f"(SELECT path, line_number, {found} AS ms FROM ({LINES_OF_DOCS}))"
    )


def first_match_sql(found: str, severity: str, message: str, where: str = "true") -> str:
    return (
        f"SELECT path, CAST(line_number AS INTEGER) AS line_number, '{severity}' AS severity, {message} AS message FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY path, line_number ORDER BY nth) AS r FROM ({matches_sql(found)}) WHERE {where}) WHERE r = 1"
    )


OUTSIDE = "m NOT LIKE '127.%' AND m <> '0.0.0.0'"
SECRETS = first_match_sql(SECRET_LIST, "CRITICAL", "concat('Hardcoded sensitive value -> ', m)")
ADDRESSES = first_match_sql(ADDRESS_LIST, "MAJOR", "concat('Hardcoded IP address -> \"', m, '\"')", OUTSIDE)


def clones_sql(items: str) -> str:
    """Clone findings over ``items(path, label, line, hash)``."""
    order = "substr(md5(path), 1, 3), path"
    return (
        "SELECT path, line AS line_number, 'MAJOR' AS severity, concat('Duplicate code block in method ''', label, ''' ', CASE n "
        "WHEN 1 THEN concat('(duplicated in ', second, ')') WHEN 2 THEN concat('(duplicated from ', first, ')') "
        "ELSE concat('(', n, ' copies found across files)') END) AS message FROM (SELECT *, "
        f"row_number() OVER (PARTITION BY hash ORDER BY {order}) AS n, count(*) OVER (PARTITION BY hash) AS copies, "
        f"first_value(concat(base, ':', label)) OVER (PARTITION BY hash ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first, "
        f"nth_value(concat(base, ':', label), 2) OVER (PARTITION BY hash ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second "
        f"FROM ({items})) WHERE copies > 1"
    )


DOC_ITEMS = (
    f"SELECT concat(source, '/', doc_id) AS path, CAST(doc_id AS VARCHAR) AS base, CAST(doc_id AS VARCHAR) AS label, "
    f"1 AS line, sha256({NORMAL}) AS hash FROM documents"
)
CLONE_FILE = java(
    "concat('    void m', k, '(Svc o) {')", repeat("s % 5 + 1", "concat('        o.go(', s, ');')"), when("k % 2 = 0", "'        '"), "'    }'"
)
METHOD_ITEMS = (
    f"SELECT concat('P', k, '.java') AS path, concat('P', k, '.java') AS base, concat('m', k) AS label, 3 AS line, s AS hash FROM {PART} WHERE s % 5 + 1 >= 3"
)

QUERIES: dict[str, tuple[Query, str | None]] = {
    "scan_sources": (
        scan_query,
        "SELECT concat(letter, '/', name) AS place, name AS file_name, sha256(content) AS content_sha256, CAST(length(content) AS INTEGER) AS n_chars FROM "
        "(SELECT letter, concat(letter, p_partkey, '.java') AS name, concat(p_name, mark, chr(10)) AS content FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'A' ELSE 'B' END AS letter, "
        "CASE p_partkey % 4 WHEN 1 THEN chr(65533) ELSE '' END AS mark FROM part WHERE p_partkey % 4 < 2))",
    ),
    "source_upload_filter": (
        upload_query,
        "SELECT name AS file_name, content, upload_ord FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY upload_ord DESC) AS r FROM "
        "(SELECT concat('F', p_partkey % 700, CASE p_partkey % 3 WHEN 0 THEN '.java' WHEN 1 THEN '.JAVA' ELSE '.txt' END) AS name, "
        "p_name AS content, p_partkey AS upload_ord FROM part) WHERE lower(name) LIKE '%.java') WHERE r = 1",
    ),
    "source_tokens": (
        on_part(TOKEN_FILE, token_counts),
        f"SELECT {FILE}, 4 + 5 * (k % 9) AS n_tokens, 1 + k % 9 AS n_identifiers, 1 + k % 9 AS n_keywords, k % 9 AS n_numbers, "
        f"CAST(3 + k % 9 AS INTEGER) AS last_line, CAST(1 AS INTEGER) AS deepest FROM {PART}",
    ),
    "source_rejects": (
        on_part(REJECT_FILE, lambda files: rejects(files).select(file_name(), "reason")),
        f"SELECT {FILE}, CASE k % 5 WHEN 0 THEN 'bracket left open' ELSE 'closing bracket without an opening one' END AS reason "
        f"FROM {PART} WHERE k % 5 < 2",
    ),
    "class_profile": (
        on_part(CLASS_FILE, class_profiles),
        f"SELECT {FILE}, concat('C', k) AS class_name, CAST(k % 7 AS INTEGER) AS n_methods, CAST(s % 6 AS INTEGER) AS n_fields, "
        f"CAST(k % 3 AS INTEGER) AS n_constructors, concat('Base', s) AS extends, 'A,B' AS implements FROM {PART} UNION ALL "
        f"SELECT {FILE}, 'In', 1, 0, 0, '', '' FROM {PART}",
    ),
    "method_profile": (
        on_part(METHOD_FILE, method_profiles),
        f"SELECT {FILE}, concat('m', k) AS name, CASE k % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'protected' WHEN 2 THEN 'private' ELSE '' END AS visibility, "
        "CASE k % 3 WHEN 0 THEN 'void' WHEN 1 THEN 'int[]' ELSE 'Map<String, List<A>>' END AS return_type, CAST(k % 5 AS INTEGER) AS n_params, "
        f"CAST(s + 2 AS INTEGER) AS body_lines FROM {PART} UNION ALL SELECT {FILE}, 'none', '', 'T', 1, 0 FROM {PART}",
    ),
    "name_uses": (
        on_part(NAMES_FILE, uses("is_name_use")),
        f"SELECT {FILE}, concat('a', k % 3) AS name, 1 AS n FROM {PART} UNION ALL SELECT {FILE}, 'b', 1 FROM {PART} "
        f"UNION ALL SELECT {FILE}, 'x', 1 + k % 4 FROM {PART} UNION ALL SELECT {FILE}, 'y', k % 4 FROM {PART} WHERE k % 4 > 0",
    ),
    "call_uses": (
        on_part(CALLS_FILE, call_uses),
        f"SELECT {FILE}, 'go' AS name, CAST(1 AS INTEGER) AS scoped, k % 4 AS n FROM {PART} WHERE k % 4 > 0 UNION ALL "
        f"SELECT {FILE}, 'run', 0, k % 3 FROM {PART} WHERE k % 3 > 0 UNION ALL SELECT {FILE}, 'end', 1, 1 FROM {PART}",
    ),
    "type_uses": (
        on_part(TYPES_FILE, uses("is_type_use")),
        f"SELECT {FILE}, 'List' AS name, 1 AS n FROM {PART} UNION ALL SELECT {FILE}, concat('T', k % 3), 1 FROM {PART} UNION ALL "
        f"SELECT {FILE}, 'Box', 1 FROM {PART} UNION ALL SELECT {FILE}, unnest(['Foo', 'Bad', 'Baz']), 1 FROM {PART} WHERE k % 2 = 0",
    ),
    "line_profile": (
        on_part(LINE_FILE, line_profiles),
        f"SELECT {FILE}, CAST(s + {COMMENTS} + {BLANKS} AS INTEGER) AS total, s AS code, CAST({COMMENTS} AS INTEGER) AS comment, "
        f"CAST({BLANKS} AS INTEGER) AS blank FROM {PART}",
    ),
    "line_profile_documents": (
        on_documents(lambda d: d.select("doc_id", tx.line_profile(F.col("text")).alias("p")).select("doc_id", "p.total", "p.blank")),
        r"SELECT doc_id, CAST(len(l) AS INTEGER) AS total, CAST(len(list_filter(l, lambda x: regexp_full_match(x, '[\x00-\x20]*'))) AS INTEGER) AS blank "
        r"FROM (SELECT doc_id, string_split(regexp_replace(text, '\n+$', ''), chr(10)) AS l FROM documents)",
    ),
    "comment_ratio": (
        on_part(LINE_FILE, comment_ratios), f"SELECT {FILE}, round(CAST({COMMENTS} AS DOUBLE) / s, 6) AS ratio FROM {PART}"
    ),
    "cyclomatic": (
        on_part(BRANCH_FILE, measure("cc")), f"SELECT {FILE}, 'run' AS name, CAST({BRANCHES} + s % 4 AS INTEGER) AS cc FROM {PART}"
    ),
    "cyclomatic_mi": (
        on_part(BRANCH_FILE, measure("cc_no_ternary")),
        f"SELECT {FILE}, 'run' AS name, CAST({BRANCHES} AS INTEGER) AS cc_no_ternary FROM {PART}",
    ),
    "cognitive": (
        on_part(COGNITIVE_FILE, measure("cognitive")),
        f"SELECT {FILE}, 'run' AS name, CAST({COGNITIVE} AS INTEGER) AS cognitive FROM {PART}",
    ),
    "maintainability": (
        on_documents(document_measures), f"SELECT doc_id, lines, words, round(mi, 6) AS mi FROM ({DOC_MI})"
    ),
    "mi_grade": (on_documents(document_grades), f"SELECT doc_id, {GRADE} AS grade FROM ({DOC_MI})"),
    "normalise_code": (
        on_documents(lambda d: d.select("doc_id", tx.normalise_code(F.col("text")).alias("normal"))),
        f"SELECT doc_id, {NORMAL} AS normal FROM documents",
    ),
    "content_hash": (
        on_documents(lambda d: d.select("doc_id", tx.content_hash(F.col("text")).alias("hash"))),
        f"SELECT doc_id, sha256({NORMAL}) AS hash FROM documents",
    ),
    "truncate_text": (
        on_documents(lambda d: d.select("doc_id", tx.truncate_text(F.col("text"), 80).alias("short"))),
        "SELECT doc_id, CASE WHEN length(text) > 80 THEN concat(substring(text, 1, 80), '...') ELSE text END AS short FROM documents",
    ),
    "escape_html": (
        lambda spark, sf_dir: table(spark, sf_dir, "pages").select("page_id", tx.escape_html(F.col("html")).alias("escaped")),
        "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages",
    ),
    "sec_001_hardcoded_secret_documents": (doc_findings(T.secret_findings), SECRETS),
    "sec_012_hardcoded_ip": (doc_findings(T.address_findings), ADDRESSES),
    "met_003_large_file": (
        doc_findings(lambda files: file_rules(files, FEW_LINES, {"MET-003"})),
        "SELECT concat(source, '/', doc_id) AS path, CAST(1 AS INTEGER) AS line_number, 'MAJOR' AS severity, "
        "concat('Large file -> ', doc_id, ' (', code, ' code lines)') AS message FROM (SELECT *, len(list_filter(string_split(text, chr(10)), "
        r"lambda x: NOT regexp_full_match(x, '[\x00-\x20]*'))) AS code FROM documents) WHERE code > 30",
    ),
    "met_004_low_comments": (
        on_part(LINE_FILE, lambda files: findings_dedup(file_rules(files, FEW_LINES, {"MET-004"})).select(
            "file_name", "line_number", "severity", "rule_id")),
        f"SELECT {FILE}, CAST(1 AS INTEGER) AS line_number, 'MINOR' AS severity, 'MET-004' AS rule_id FROM {PART} "
        f"WHERE s > 25 AND CAST({COMMENTS} AS DOUBLE) / s < 0.1",
    ),
    "met_005_low_mi": (
        on_documents(lambda d: T.low_maintainability(T.document_files(d)).select(
            "path", "severity", "grade", F.round("mi", 6).alias("mi"))),
        f"SELECT concat(source, '/', doc_id) AS path, CASE WHEN grade = 'B' THEN 'MINOR' ELSE 'MAJOR' END AS severity, grade, round(mi, 6) AS mi "
        f"FROM (SELECT *, {GRADE} AS grade FROM ({DOC_MI})) WHERE grade <> 'A'",
    ),
    "dup_001_clone": (doc_findings(T.text_clones), clones_sql(DOC_ITEMS)),
    "dup_001_clone_groups": (
        on_documents(lambda d: clone_groups(T.text_items(T.document_files(d)))),
        f"SELECT sha256({NORMAL}) AS hash, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    ),
    "dup_001_clone_methods": (
        on_part(CLONE_FILE, lambda files: findings_dedup(clone_findings(stored_items(method_items(members(tokens(files)))))).select(*SHOWN)),
        clones_sql(METHOD_ITEMS),
    ),
}


def queries() -> dict[str, Query]:
    return {key: run for key, (run, _) in QUERIES.items()}


def oracles() -> dict[str, str]:
    return {key: sql for key, (_, sql) in QUERIES.items() if sql}
