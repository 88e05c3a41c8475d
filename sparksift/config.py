"""Thresholds and switches of an audit run.

Rules put a threshold into their SQL as it stands in the settings: a number of ``AuditConfig``, or
a column of ``ProjectLimits``, which gives every file the thresholds of its project.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Names in a settings file of the fields below, and its settings for other parts, with their types.
NAMES = {
    "maxParameters": "max_parameters",
    "maxMethodLines": "max_method_lines",
    "maxClassMethods": "max_class_methods",
    "maxNestingDepth": "max_nesting_depth",
    "maxClassFields": "max_class_fields",
    "complexityMinor": "complexity_minor",
    "complexityMajor": "complexity_major",
    "complexityCritical": "complexity_critical",
    "cognitiveComplexityThreshold": "cognitive_threshold",
    "maxFileLOC": "max_file_loc",
    "minCommentRatio": "min_comment_ratio",
    "maintainabilityGradeA": "maintainability_grade_a",
    "maintainabilityGradeB": "maintainability_grade_b",
    "enableCodeSmells": "enable_code_smells",
    "enableDeadCode": "enable_dead_code",
    "enableSecurity": "enable_security",
    "enableMetrics": "enable_metrics",
    "enableNaming": "enable_naming",
    "enableDuplication": "enable_duplication",
}
OTHER_PARTS = {"minDuplicateTokens": "int", "outputDirectory": "str", "jsonReportName": "str", "htmlReportName": "str"}


def fits(value: object, kind: str) -> bool:
    """Whether a JSON value is of the kind; a whole number is a fraction too, a switch is no number."""
    if kind == "bool" or isinstance(value, bool):
        return kind == "bool" and isinstance(value, bool)
    if kind == "float":
        return isinstance(value, (int, float)) and math.isfinite(value)
    return isinstance(value, int if kind == "int" else str)


@dataclass(frozen=True)
class AuditConfig:
    # Default thresholds of the rules.
    max_parameters: int = 3
    max_method_lines: int = 30
    max_class_methods: int = 10
    max_nesting_depth: int = 3
    max_class_fields: int = 15
    complexity_minor: int = 10
    complexity_major: int = 20
    complexity_critical: int = 50
    cognitive_threshold: int = 15
    max_file_loc: int = 500
    min_comment_ratio: float = 0.1
    min_commented_loc: int = 50
    maintainability_grade_a: int = 85
    maintainability_grade_b: int = 65
    enable_code_smells: bool = True
    enable_dead_code: bool = True
    enable_security: bool = True
    enable_metrics: bool = True
    enable_naming: bool = True
    enable_duplication: bool = True

    def with_(self, **changes) -> "AuditConfig":
        return replace(self, **changes)

    def limited(self, rows: DataFrame) -> DataFrame:
        """Rows with what the thresholds need: nothing here."""
        return rows

    def enabled_analyzers(self) -> list[str]:
        switches = {
            "smell": self.enable_code_smells,
            "dead": self.enable_dead_code,
            "security": self.enable_security,
            "naming": self.enable_naming,
            "duplication": self.enable_duplication,
            "metrics": self.enable_metrics,
        }
        return [name for name, on in switches.items() if on]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str | None) -> "AuditConfig":
        """Settings from a JSON object; no text at all means the defaults.

        Names are those of the fields or the spelled ones of a settings file
        (``NAMES``); the settings of its other parts are accepted and have no
        effect here. An unreadable object, an unknown name or a value of
        another type falls back to the defaults as a whole, so nothing but
        numbers and switches ever reaches a rule.
        """
        if not text:
            return cls()
        try:
            values = json.loads(text)
        except ValueError:
            return cls()
        if not isinstance(values, dict):
            return cls()
        types, chosen = {f.name: f.type for f in fields(cls)}, {}
        for name, value in values.items():
            if name in OTHER_PARTS:
                if not fits(value, OTHER_PARTS[name]):
                    return cls()
                continue
            field = NAMES.get(name, name)
            if field not in types or not fits(value, types[field]):
                return cls()
            chosen[field] = float(value) if types[field] == "float" else value
        return cls(**chosen)


# Thresholds that may differ by project.
LIMITS = [f.name for f in fields(AuditConfig) if not f.name.startswith("enable_")]
# A limits table of more rows is joined by a shuffle.
MOST_BROADCAST = 10_000


class ProjectLimits:
    """Thresholds by project, with the interface of ``AuditConfig`` that rules use.

    ``limits(prefix, ...)`` has a row per project: the folder its files lie below (``""`` for all
    files), and any of the thresholds. Of several prefixes the longest counts, as a whole; what it leaves
    null or out, and files of no project, have the thresholds of ``base``. Of rows with one prefix the greatest counts.
    """

    def __init__(self, limits: DataFrame, files: DataFrame, base: AuditConfig = AuditConfig()):
        self.base = base
        given = [name for name in LIMITS if name in limits.columns]
        table = limits.filter("prefix IS NOT NULL").select(F.rtrim("prefix", F.lit("/")).alias("prefix"), *given)
        if table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
            table = F.broadcast(table)
        # all folders a file lies in, and the file itself: an equi-join instead of a comparison of each path with each prefix
        steps = "concat(array(''), transform(sequence(1, size(split(path, '/'))), n -> array_join(slice(split(path, '/'), 1, n), '/')))"
        paths = files.select("path").distinct()
        of_project = paths.select("path", F.explode(F.expr(steps)).alias("prefix")).join(table, "prefix")
        longest = of_project.groupBy("path").agg(F.max(F.struct(F.length("prefix").alias("size"), *given)).alias("own"))
        values = [
            F.coalesce(F.col(f"own.{name}"), F.lit(getattr(base, name))).alias(name) if name in given else F.lit(getattr(base, name)).alias(name)
            for name in LIMITS
        ]
        self.of_path = paths.join(longest, "path", "left").select("path", F.struct(*values).alias("limits"))

    def __getattr__(self, name: str) -> str:
        if name not in LIMITS:
            raise AttributeError(name)
        return f"limits.{name}"

    def limited(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.of_path, "path")

    def enabled_analyzers(self) -> list[str]:
        return self.base.enabled_analyzers()
