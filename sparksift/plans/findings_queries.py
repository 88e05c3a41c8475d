"""Queries of the findings algebra, run on the findings of the text rules over all documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import RULES
from ..config import AuditConfig
from ..functions.text import null_to_dash
from ..operators import findings as A
from ..operators.text_rules import document_files, text_audit
from ..session import ensure_checkpoint_dir
from ..sources.files import EXPORT, write_csv, write_json
from ..sources.tables import table
from .fact_queries import ADDRESS_LIST, DOC_ITEMS, OUTSIDE, SECRET_LIST, Query, clones_sql, matches_sql


CONFIG = AuditConfig(max_file_loc=30, min_commented_loc=25)
STRICT = AuditConfig(max_file_loc=60, min_commented_loc=10, min_comment_ratio=0.05)


def raw_findings(spark: SparkSession, sf_dir: str, cfg: AuditConfig = CONFIG) -> DataFrame:
    return text_audit(document_files(table(spark, sf_dir, "documents")), cfg)


def on_findings(build: Callable[[DataFrame], DataFrame], cfg: AuditConfig = CONFIG) -> Query:
    return lambda spark, sf_dir: build(A.findings_dedup(raw_findings(spark, sf_dir, cfg)))


def by_source(build: Callable[[DataFrame], DataFrame]) -> Query:
    """Scores per source; a source without findings is in the result too."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = A.findings_dedup(raw_findings(spark, sf_dir)).withColumn("source", F.substring_index("path", "/", 1))
        sources = table(spark, sf_dir, "documents").select("source").distinct()
        return build(A.health(found, "source", population=sources))

    return run


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: counts, score, grade and verdict per source."""
    return by_source(A.quality_gate)(spark, sf_dir)


# The same findings in SQL ------------------------------------------------


def fixed(rule_id: str, blank: str = "") -> str:
    """Type, rule, category and advice of a rule as SQL columns."""
    rule = RULES[rule_id]
    advice = rule.suggestion.replace("{}", blank).replace("'", "''")
    return f"'{rule.type}' AS type, '{rule_id}' AS rule_id, '{rule.category}' AS category, '{advice}' AS suggestion, {rule.rank} AS rank"


def found_sql(cfg: AuditConfig = CONFIG) -> str:
    """All findings before de-duplication."""
    code = (
        "SELECT concat(source, '/', doc_id) AS path, doc_id, len(list_filter(string_split(text, chr(10)), "
        r"lambda x: NOT regexp_full_match(x, '[\x00-\x20]*'))) AS code FROM documents"
    )
    parts = [
        f"SELECT path, line_number, 'CRITICAL' AS severity, concat('Hardcoded sensitive value -> ', m) AS message, nth, {fixed('SEC-001')} FROM ({matches_sql(SECRET_LIST)})",
        f"SELECT path, line_number, 'MAJOR', concat('Hardcoded IP address -> \"', m, '\"'), nth, {fixed('SEC-012')} FROM ({matches_sql(ADDRESS_LIST)}) "
        f"WHERE {OUTSIDE}",
        f"SELECT path, line_number, severity, message, 0, {fixed('DUP-001')} FROM ({clones_sql(DOC_ITEMS)})",
        f"SELECT path, 1, 'MAJOR', concat('Large file -> ', doc_id, ' (', code, ' code lines)'), 0, {fixed('MET-003', str(cfg.max_file_loc))} "
        f"FROM ({code}) WHERE code > {cfg.max_file_loc}",
        f"SELECT path, 1, 'MINOR', concat('Low comment-to-code ratio in ', doc_id, ' (0.0%)'), 0, {fixed('MET-004', f'{cfg.min_comment_ratio * 100:.0f}%')} "
        f"FROM ({code}) WHERE code > {cfg.min_commented_loc}",
    ]
    return (
        "SELECT type, message, severity, split_part(path, '/', 2) AS file_name, CAST(line_number AS INTEGER) AS line_number, rule_id, category, "
        "suggestion, path, split_part(path, '/', 1) AS source, rank, nth FROM (" + " UNION ALL ".join(parts) + ")"
    )


def kept_sql(cfg: AuditConfig = CONFIG) -> str:
    return (
        "SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY path, line_number, type, rule_id ORDER BY rank, nth) AS r "
        f"FROM ({found_sql(cfg)})) WHERE r = 1"
    )


KEPT = kept_sql()
ROW = ["path", "line_number", "rule_id", "type", "category", "severity", "message"]
COLUMNS = ", ".join(ROW)
COUNTS = (
    "SELECT s.source, count(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS critical, count(CASE WHEN severity = 'MAJOR' THEN 1 END) AS major, "
    "count(CASE WHEN severity = 'MINOR' THEN 1 END) AS minor, count(severity) AS total FROM (SELECT DISTINCT source FROM documents) s "
    f"LEFT JOIN ({KEPT}) f ON s.source = f.source GROUP BY s.source"
)
SCORE = "CAST(greatest(0, 100 - critical * 10 - major * 3 - minor) AS INTEGER)"
GRADES = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END"
SCORED = f"SELECT *, {GRADES} AS grade FROM (SELECT *, {SCORE} AS score FROM ({COUNTS}))"
VERDICT = "CASE WHEN critical > 0 THEN 'FAIL' WHEN major > 0 THEN 'WARN' ELSE 'PASS' END"
SHOWN_TEXT = "lower(concat(severity, rule_id, type, file_name, line_number, message, suggestion))"
# Findings without a rule and without advice, as the short form of a finding makes them.
BARE = "CASE WHEN severity = 'MINOR' THEN NULL ELSE {0} END"
LINE = (
    "concat('[ ', severity, ' ] ', CASE WHEN rule_id IS NOT NULL THEN concat('[', rule_id, '] ') ELSE '' END, type, ' | ', file_name, ' | Line ', "
    "line_number, ' -> ', message, CASE WHEN suggestion IS NOT NULL THEN concat(chr(10), '   Fix: ', suggestion) ELSE '' END)"
)


def stripped(found: DataFrame) -> DataFrame:
    """Minor findings lose rule and advice."""
    bare = {c: F.when(F.col("severity") != "MINOR", F.col(c)) for c in ("rule_id", "suggestion")}
    return found.withColumns(bare)


STRIPPED = f"SELECT * REPLACE ({BARE.format('rule_id')} AS rule_id, {BARE.format('suggestion')} AS suggestion) FROM ({KEPT})"


def written_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/json-{uuid.uuid4()}"
    write_json(A.findings_dedup(raw_findings(spark, sf_dir)), folder)
    schema = (
        "type string, message string, severity string, fileName string, lineNumber int, ruleId string, category string, "
        "suggestion string, deduplicationKey string"
    )
    return spark.read.schema(schema).json(folder)


def written_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4()}"
    write_csv(stripped(A.findings_dedup(raw_findings(spark, sf_dir))), folder)
    schema = ", ".join(f"{c} string" for c in EXPORT)
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True).csv(folder)


def payload_rows(found: DataFrame) -> DataFrame:
    """The nested documents, their parts shown as texts that both engines can write."""
    return A.summary_payload(found).select(
        "path", "summary.total", "summary.critical", "summary.major", "summary.minor", "summary.score", "summary.grade",
        F.expr("array_join(transform(map_entries(byType), e -> concat(e.key, '=', e.value)), ',')").alias("by_type"),
        F.expr("array_join(transform(defects, d -> concat(d.line, ':', d.ruleId, ':', d.severity, ':', d.message)), '|')").alias("defects"),
    )


PAYLOAD = (
    f"SELECT path, total, critical, major, minor, score, {GRADES} AS grade, by_type, defects FROM (SELECT *, {SCORE} AS score FROM "
    "(SELECT path, count(*) AS total, count(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS critical, count(CASE WHEN severity = 'MAJOR' THEN 1 END) AS major, "
    "count(CASE WHEN severity = 'MINOR' THEN 1 END) AS minor, "
    f"string_agg(concat(line_number, ':', rule_id, ':', severity, ':', message), '|' ORDER BY line_number, rank, nth, severity, rule_id) AS defects FROM ({KEPT}) GROUP BY path)) "
    "JOIN (SELECT path, string_agg(concat(type, '=', n), ',' ORDER BY type) AS by_type FROM "
    f"(SELECT path, type, count(*) AS n FROM ({KEPT}) GROUP BY path, type) GROUP BY path) USING (path)"
)


def counted(column: str) -> tuple[Query, str]:
    return on_findings(lambda f: A.count_by(f, column)), f"SELECT {column}, count(*) AS n FROM ({KEPT}) GROUP BY {column}"


def rows(build: Callable[[DataFrame], DataFrame], where: str, cfg: AuditConfig = CONFIG) -> tuple[Query, str]:
    return on_findings(lambda f: build(f).select(*ROW), cfg), f"SELECT {COLUMNS} FROM ({kept_sql(cfg)}) WHERE {where}"


QUERIES: dict[str, tuple[Query, str | None]] = {
    "findings_union": (
        lambda spark, sf_dir: raw_findings(spark, sf_dir).select(*ROW), f"SELECT {COLUMNS} FROM ({found_sql()})"
    ),
    "findings_dedup": rows(lambda f: f, "true"),
    "filter_severity": rows(lambda f: A.filter_severity(f, "critical"), "severity = 'CRITICAL'"),
    "filter_category": rows(lambda f: A.filter_category(f, "SECURITY"), "category = 'SECURITY'"),
    "filter_file": rows(lambda f: A.filter_file(f, "22"), "file_name = '22'"),
    "filter_search": rows(
        lambda f: A.filter_search(f, "ADDRESS -> \"1", "MAJOR", "Security"),
        f"contains({SHOWN_TEXT}, 'address -> \"1') AND severity = 'MAJOR' AND type = 'Security'",
    ),
    "count_per_file": counted("file_name"),
    "count_per_category": counted("category"),
    "count_per_severity": counted("severity"),
    "count_per_type": counted("type"),
    "severity_counts": (
        on_findings(A.severity_counts),
        "SELECT count(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS critical, count(CASE WHEN severity = 'MAJOR' THEN 1 END) AS major, "
        f"count(CASE WHEN severity = 'MINOR' THEN 1 END) AS minor, count(*) AS total FROM ({KEPT})",
    ),
    "summary_rollup": (
        on_findings(A.summary_rollup),
        f"SELECT 'total' AS level, 'TOTAL' AS key, count(*) AS n FROM ({KEPT}) UNION ALL SELECT 'severity', severity, count(*) FROM ({KEPT}) GROUP BY severity "
        f"UNION ALL SELECT 'category', category, count(*) FROM ({KEPT}) GROUP BY category UNION ALL SELECT 'file', file_name, count(*) FROM ({KEPT}) GROUP BY file_name",
    ),
    "severity_share": (
        on_findings(lambda f: A.severity_share(f).withColumn("share", F.round("share", 6))),
        f"SELECT severity, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM ({KEPT})), 6) AS share FROM ({KEPT}) GROUP BY severity",
    ),
    "relative_bar": (
        on_findings(lambda f: A.relative_bar(f, "file_name")),
        f"SELECT file_name, n, round(CAST(n * 100 AS DOUBLE) / (SELECT max(n) FROM (SELECT count(*) AS n FROM ({KEPT}) GROUP BY file_name)), 1) AS width "
        f"FROM (SELECT file_name, count(*) AS n FROM ({KEPT}) GROUP BY file_name)",
    ),
    "health_score": (
        by_source(lambda h: h.select("source", "critical", "major", "minor", "score")),
        f"SELECT source, critical, major, minor, score FROM ({SCORED})",
    ),
    "health_grade": (by_source(lambda h: h.select("source", "grade")), f"SELECT source, grade FROM ({SCORED})"),
    "quality_gate": (
        source_health, f"SELECT source, critical, major, minor, total, score, grade, {VERDICT} AS verdict FROM ({SCORED})"
    ),
    "infer_category": (
        on_findings(lambda f: f.select("path", "line_number", "type", A.infer_category(
            F.when(F.col("line_number") % 2 == 0, F.col("type"))).alias("inferred"))),
        "SELECT path, line_number, type, CASE CASE WHEN line_number % 2 = 0 THEN type END WHEN 'Security' THEN 'SECURITY' WHEN 'Dead Code' THEN 'DEAD_CODE' "
        f"WHEN 'Metrics' THEN 'METRICS' WHEN 'Naming' THEN 'NAMING' WHEN 'Duplication' THEN 'DUPLICATION' ELSE 'CODE_SMELL' END AS inferred FROM ({KEPT})",
    ),
    "finding_line": (
        on_findings(lambda f: stripped(f).select(A.finding_line().alias("line"))), f"SELECT {LINE} AS line FROM ({STRIPPED})"
    ),
    "order_findings": (
        on_findings(lambda f: A.order_findings(f, "line", ascending=False).select(*ROW)),
        f"SELECT {COLUMNS} FROM ({KEPT}) ORDER BY line_number DESC, path, rule_id",
    ),
    "facet_values": (
        on_findings(A.facet_values),
        f"SELECT DISTINCT 'type' AS facet, type AS value FROM ({KEPT}) UNION ALL SELECT DISTINCT 'file', file_name FROM ({KEPT})",
    ),
    "null_to_dash": (
        on_findings(lambda f: stripped(f).select(
            "path", "line_number", *[null_to_dash(F.col(c)).alias(c) for c in ("rule_id", "suggestion")])),
        f"SELECT path, line_number, coalesce(rule_id, '-') AS rule_id, coalesce(suggestion, '-') AS suggestion FROM ({STRIPPED})",
    ),
    "write_json": (
        written_json,
        "SELECT type, message, severity, file_name AS \"fileName\", line_number AS \"lineNumber\", rule_id AS \"ruleId\", category, suggestion, "
        f"concat(file_name, ':', line_number, ':', type, ':', rule_id) AS \"deduplicationKey\" FROM ({KEPT})",
    ),
    "write_csv": (
        written_csv,
        "SELECT severity, coalesce(rule_id, '-') AS rule_id, type, file_name, CAST(line_number AS VARCHAR) AS line_number, message, "
        f"coalesce(suggestion, '-') AS suggestion FROM ({STRIPPED})",
    ),
    "summary_payload": (on_findings(payload_rows), PAYLOAD),
    "apply_toggles": rows(
        lambda f: A.apply_toggles(f, CONFIG.with_(enable_metrics=False).enabled_analyzers()), "category <> 'METRICS'"
    ),
    "apply_thresholds": rows(lambda f: f, "true", STRICT),
}


def queries() -> dict[str, Query]:
    return {key: run for key, (run, _) in QUERIES.items()}


def oracles() -> dict[str, str]:
    return {key: sql for key, (_, sql) in QUERIES.items() if sql}
