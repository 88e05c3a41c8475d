"""The findings table and its algebra: union, de-duplication, filters, counts, scores, rendering."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import CATEGORY_OF_TYPE, RULES, advice
from ..functions.sql import quote, say
from ..functions.text import null_to_dash

SCHEMA = (
    "type string, message string, severity string, file_name string, line_number int, rule_id string, "
    "category string, suggestion string, path string, ord struct<rank:int,node:bigint,step:int>"
)
COLUMNS = ["type", "message", "severity", "file_name", "line_number", "rule_id", "category", "suggestion", "path", "ord"]


def hit(
    rule_id: str,
    condition: str,
    severity: str,
    message: str,
    line: str,
    node: str,
    step: str = "0",
    suggestion: str | None = None,
) -> str:
    """SQL for one candidate finding of a row; null unless the condition holds.

    ``message`` is a template with expressions in braces. ``severity`` is one of
    the three words or an expression.
    """
    rule = RULES[rule_id]
    fields = {
        "type": quote(rule.type),
        "message": say(message),
        "severity": quote(severity) if severity.isupper() and severity.isalpha() else severity,
        "line_number": f"CAST({line} AS INT)",
        "rule_id": quote(rule_id),
        "category": quote(rule.category),
        "suggestion": suggestion or advice(rule_id),
        "ord": f"named_struct('rank', {rule.rank}, 'node', CAST({node} AS BIGINT), 'step', CAST({step} AS INT))",
    }
    struct = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return f"CASE WHEN coalesce({condition}, false) THEN named_struct({struct}) END"


def found_array(hits: Iterable[str] = (), many: Iterable[str] = ()) -> str:
    """SQL for all findings of a row: ``hits`` are single candidates, ``many`` are arrays of findings."""
    arrays = [f"array_compact(array({', '.join(hits)}))"] if hits else []
    arrays += many
    return arrays[0] if len(arrays) == 1 else "concat(" + ", ".join(arrays) + ")"


def exploded(rows: DataFrame, found: str) -> DataFrame:
    """Rows with an array of findings, as a table of findings."""
    return rows.selectExpr("path", f"explode({found}) AS f").selectExpr(
        "f.type", "f.message", "f.severity", "substring_index(path, '/', -1) AS file_name", "f.line_number", "f.rule_id",
        "f.category", "f.suggestion", "path", "f.ord",
    )


def emit(rows: DataFrame, hits: Iterable[str] = (), many: Iterable[str] = ()) -> DataFrame:
    """All findings of one grain in a single pass over its rows."""
    return exploded(rows, found_array(hits, many))


def findings_union(parts: Iterable[DataFrame]) -> DataFrame:
    """All findings in one table; every part has the columns in the order ``emit`` gives them."""
    return reduce(DataFrame.union, parts)


def dedup_key(key: str = "path") -> Column:
    return F.concat_ws(":", F.col(key), F.col("line_number").cast("string"), F.col("type"), F.coalesce(F.col("rule_id"), F.lit("null")))


def findings_dedup(findings: DataFrame, key: str = "path") -> DataFrame:
    """The first finding per file, line, type and rule.

    A minimum over (emission order, row) combines before the shuffle, so a file
    holding a large share of all findings does not gather in one task first.
    ``key="file_name"`` merges equally named files, as the compatibility mode.
    """
    rest = [c for c in COLUMNS if c not in {key, "line_number", "type", "rule_id", "path", "ord"}]
    keys = [key, "line_number", "type", "rule_id"]
    first = F.min(F.struct("path", "ord", *rest)).alias("first")
    kept = findings.groupBy(*keys).agg(first)
    back = {c: F.col(f"first.{c}") for c in COLUMNS if c not in keys}
    return kept.select(*[back[c].alias(c) if c in back else F.col(c) for c in COLUMNS])


# Filters -----------------------------------------------------------------


def filter_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(F.upper("severity") == severity.upper())


def filter_category(findings: DataFrame, category: str) -> DataFrame:
    return findings.filter(F.col("category") == category)


def filter_file(findings: DataFrame, file_name: str) -> DataFrame:
    return findings.filter(F.col("file_name") == file_name)


def filter_search(
    findings: DataFrame, text: str = "", severity: str = "", type_: str = "", file_name: str = ""
) -> DataFrame:
    """Rows whose shown text contains ``text`` in any case and whose fields equal the rest; empty means any."""
    shown = F.concat(
        "severity", null_to_dash(F.col("rule_id")), "type", "file_name", F.col("line_number").cast("string"), "message",
        null_to_dash(F.col("suggestion")),
    )
    out = findings
    if text:
        out = out.filter(F.lower(shown).contains(text.lower()))
    for column, value in (("severity", severity), ("type", type_), ("file_name", file_name)):
        if value:
            out = out.filter(F.col(column) == value)
    return out


def apply_toggles(findings: DataFrame, analyzers: list[str]) -> DataFrame:
    """Findings of the rules governed by the analyzers that are switched on."""
    on = [rule.rule_id for rule in RULES.values() if rule.analyzer in analyzers]
    return findings.filter(F.col("rule_id").isin(on))


# Counts ------------------------------------------------------------------


def count_by(findings: DataFrame, column: str) -> DataFrame:
    return findings.groupBy(column).agg(F.count("*").alias("n"))


def _count_severity(name: str) -> Column:
    return F.count(F.when(F.col("severity") == name.upper(), 1)).alias(name)


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    parts = [_count_severity(s) for s in ("critical", "major", "minor")]
    return findings.groupBy(*by).agg(*parts, F.count("*").alias("total"))


def summary_rollup(findings: DataFrame) -> DataFrame:
    """Grand total, per severity, per category and per file in one pass over grouping sets."""
    columns = ["severity", "category", "file_name"]
    sets = [[], ["severity"], ["category"], ["file_name"]]
    rolled = findings.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(
        F.count("*").alias("n"), F.grouping_id(*columns).alias("gid")
    )
    level = F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "severity").when(F.col("gid") == 5, "category").otherwise("file")
    key = F.coalesce("severity", "category", "file_name", F.lit("TOTAL"))
    return rolled.select(level.alias("level"), key.alias("key"), "n")


def severity_share(findings: DataFrame) -> DataFrame:
    """Percent of all findings per severity; at most one row per severity reaches the total."""
    counts = count_by(findings, "severity")
    total = counts.agg(F.sum("n").alias("total")).select("total").scalar()
    return counts.select("severity", "n", (F.col("n") * 100.0 / total).alias("share"))


def relative_bar(findings: DataFrame, column: str) -> DataFrame:
    """Count per group and its percentage of the largest group, to one decimal."""
    counts = count_by(findings, column)
    largest = counts.agg(F.max("n").alias("m")).select("m").scalar()
    return counts.select(column, "n", F.round(F.col("n") * 100.0 / largest, 1).alias("width"))


# Scores ------------------------------------------------------------------


def health_score(critical: Column, major: Column, minor: Column) -> Column:
    # 10, 3 and 1 points off per finding.
    return F.greatest(F.lit(0), F.lit(100) - critical * 10 - major * 3 - minor).cast("int")


def health_grade(score: Column) -> Column:
    # Lower bounds of the grades.
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 55, "C").when(score >= 35, "D").otherwise("F")


def health(findings: DataFrame, *by: str, population: DataFrame | None = None) -> DataFrame:
    """Counts, score and grade per group.

    ``population`` lists all groups, so that one without findings scores 100.
    """
    counts = severity_counts(findings, *by)
    if population is not None:
        counts = population.select(*by).distinct().join(counts, list(by), "left").fillna(
            0, subset=["critical", "major", "minor", "total"]
        )
    score = health_score(F.col("critical"), F.col("major"), F.col("minor"))
    return counts.withColumn("score", score).withColumn("grade", health_grade(F.col("score")))


def quality_gate(counts: DataFrame) -> DataFrame:
    verdict = F.when(F.col("critical") > 0, "FAIL").when(F.col("major") > 0, "WARN").otherwise("PASS")
    return counts.withColumn("verdict", verdict)


def infer_category(type_: Column) -> Column:
    out = F.lit("CODE_SMELL")
    for name, category in CATEGORY_OF_TYPE.items():
        out = F.when(type_ == name, category).otherwise(out)
    return out


# Rendering ---------------------------------------------------------------


def finding_line() -> Column:
    """The finding as report text: one line, and a second one when there is advice."""
    rule = F.when(F.col("rule_id").isNotNull(), F.concat(F.lit("["), F.col("rule_id"), F.lit("] "))).otherwise("")
    fix = F.when(F.col("suggestion").isNotNull(), F.concat(F.lit("\n   Fix: "), F.col("suggestion"))).otherwise("")
    return F.concat(
        F.lit("[ "), F.col("severity"), F.lit(" ] "), rule, F.col("type"), F.lit(" | "), F.col("file_name"),
        F.lit(" | Line "), F.col("line_number").cast("string"), F.lit(" -> "), F.col("message"), fix,
    )


SORTABLE = {
    "severity": "severity", "rule": "rule_id", "type": "type", "file": "file_name", "line": "line_number",
    "message": "message",
}


def order_findings(findings: DataFrame, by: str, ascending: bool = True) -> DataFrame:
    """A global sort by one shown column; numbers as numbers, text as text, ties by file, line, rule and order."""
    column = F.col(SORTABLE[by])
    return findings.orderBy(column.asc() if ascending else column.desc(), "path", "line_number", "rule_id", "ord")


def facet_values(findings: DataFrame) -> DataFrame:
    """Distinct types and files, the choices offered by the filters."""
    facets = F.explode(
        F.array(
            F.struct(F.lit("type").alias("facet"), F.col("type").alias("value")),
            F.struct(F.lit("file").alias("facet"), F.col("file_name").alias("value")),
        )
    )
    return findings.select(facets.alias("f")).select("f.facet", "f.value").distinct()


def summary_payload(findings: DataFrame, key: str = "path") -> DataFrame:
    """The nested result, one JSON document per file.

    The counts by file are the documents themselves. A single document over a
    whole corpus would put every finding into one task, so none is built.
    """
    item = F.struct(
        "line_number", "ord", "severity", null_to_dash(F.col("rule_id")).alias("ruleId"), "type", "message",
        null_to_dash(F.col("suggestion")).alias("suggestion"),
    )
    per_type = findings.groupBy(key, "type").agg(
        *[_count_severity(s) for s in ("critical", "major", "minor")],
        F.count("*").alias("n"),
        F.collect_list(item).alias("items"),
    )
    totals = {s: F.sum(s).alias(s) for s in ("critical", "major", "minor")}
    nested = per_type.groupBy(key).agg(
        F.sum("n").alias("total"),
        *totals.values(),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("byType"),
        F.sort_array(F.flatten(F.collect_list("items"))).alias("items"),
    )
    score = health_score(F.col("critical"), F.col("major"), F.col("minor"))
    defects = F.transform(
        "items",
        lambda x: F.struct(
            x["severity"].alias("severity"), x["ruleId"].alias("ruleId"), x["type"].alias("type"),
            x["line_number"].alias("line"), x["message"].alias("message"), x["suggestion"].alias("suggestion"),
        ),
    )
    return nested.withColumn("score", score).select(
        key,
        F.struct("total", "critical", "major", "minor", "score", health_grade(F.col("score")).alias("grade")).alias("summary"),
        "byType",
        defects.alias("defects"),
    )
