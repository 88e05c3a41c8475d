"""A full audit: sources to findings, every fact computed once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..catalog import RULES
from ..config import AuditConfig, ProjectLimits
from ..operators import rules as R
from ..operators.clones import clone_findings, method_items, stored_items
from ..operators.findings import SCHEMA, apply_toggles, findings_dedup, findings_union
from ..operators.long_files import LONG_FILE, PART_TOKENS, long_tokens
from ..operators.members import members
from ..operators.mending import mended
from ..operators.tokens import marked_tokens, rejects, sized_parts, text_parts, tokens
from ..session import ensure_checkpoint_dir
from ..storage import Scratch

# Which function yields which rules: of members, and of tokens.
MEMBER_GRAINS = {
    R.class_rules: {"SMELL-001", "SMELL-006", "SMELL-007", "SMELL-008", "NAME-001", "NAME-008"},
    R.method_rules: {
        "SMELL-002", "SMELL-003", "SMELL-005", "SMELL-010", "SMELL-016", "SMELL-017", "NAME-002", "NAME-004", "NAME-009",
        "MET-001", "MET-002", "MET-005", "DOC-001",
    },
}
CLONES = {"DUP-001"}
PRINTED = {"SMELL-003", "MET-005", "DUP-001"}
GRAINS = {
    R.body_rules: {"SMELL-011", "SMELL-013"},
    R.exit_rules: {"DEAD-001"},
    R.block_rules: {"SMELL-004", "SMELL-012", "SMELL-014"},
    R.variable_rules: {"SMELL-015", "SEC-001", "NAME-003", "NAME-005", "NAME-006", "NAME-007"},
    R.expression_rules: {
        "SEC-003", "SEC-004", "SEC-005", "SEC-006", "SEC-009", "SEC-010", "SEC-011", "SEC-012", "SEC-013",
    },
    R.local_rules: {"DEAD-002", "DEAD-006"},
    R.private_rules: {"DEAD-004", "DEAD-005"},
    R.envy_rules: {"SMELL-009"},
    R.import_rules: {"DEAD-003"},
    R.layout_rules: {"MET-003", "MET-004"},
    R.sum_rules: {"SEC-002", "SEC-007", "SEC-008"},
}


def found_by_file(
    facts: DataFrame | list[DataFrame], only: set[str], cfg: AuditConfig | ProjectLimits, scratch: Scratch | None = None
) -> tuple[list[DataFrame], DataFrame | None]:
    """Findings of the wanted rules that look at one file, and the items of the clone rule, which compares all files, if it is wanted.

    Each table of facts holds whole files. Classes, methods and clones are all made from members. With ``scratch`` these are
    stored, and made from the tokens once.
    """
    tables = facts if isinstance(facts, list) else [facts]
    parts = [grain(table, cfg, ids & only) for table in tables for grain, ids in GRAINS.items() if ids & only]
    if not only & CLONES.union(*MEMBER_GRAINS.values()):
        return parts, None
    declared = reduce(DataFrame.unionByName, [members(table, bool(only & PRINTED)) for table in tables])
    declared = scratch.stored(declared) if scratch else declared
    parts += [grain(declared, cfg, ids & only) for grain, ids in MEMBER_GRAINS.items() if ids & only]
    return parts, method_items(declared) if CLONES & only else None


def findings_of(
    facts: DataFrame | list[DataFrame], only: set[str], cfg: AuditConfig | ProjectLimits, scratch: Scratch | None = None
) -> DataFrame:
    """Findings of the wanted rules, before de-duplication."""
    parts, items = found_by_file(facts, only, cfg, scratch)
    if items is not None:
        parts.append(clone_findings(items.filter("hash IS NOT NULL") if scratch else stored_items(items)))
    return findings_union(parts)


def rule_findings(files: DataFrame, rule_id: str, cfg: AuditConfig | ProjectLimits = AuditConfig()) -> DataFrame:
    """De-duplicated findings of one rule, as one lazy plan; each file is one part, and files with unbalanced brackets have none."""
    return findings_dedup(findings_of(tokens(files), {rule_id}, cfg))


FACTS_PREFIX = "sparksift_tokens_"


def written(facts: DataFrame, buckets: int, name: str, *by: str) -> None:
    """Appends facts, hashed into ``buckets`` by the columns, to a table in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(facts.sparkSession)}/{name}"
    facts.write.format("parquet").mode("append").option("path", folder).bucketBy(buckets, *by).saveAsTable(name)


def stored_facts(files: DataFrame, name: str, long_file: int = LONG_FILE, part_tokens: int = PART_TOKENS) -> list[DataFrame]:
    """The token facts of all files, in one or two tables.

    The first table is bucketed by path: each grain reads its own columns, already partitioned by path, so no grain
    shuffles tokens. Files whose brackets don't balance leave their path there and are
    added once ``mended``. Files of more than ``long_file`` bytes go to a second table bucketed by path and part, if there are any.
    """
    spark, buckets = files.sparkSession, sized_parts(files)
    files = files.select("path", "content")
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    seen = Observation()
    counted = files.observe(seen, F.count(F.when(size > long_file, 1)).alias("n_long"))
    written(marked_tokens(counted.filter(size <= long_file), buckets), buckets, name, "path")
    broken = spark.table(name).filter("reject IS NOT NULL").select("path").distinct()
    if not broken.isEmpty():
        # held apart from the table that is added to
        paths = Scratch(spark).stored(broken)
        again = mended(files.filter(size <= long_file).join(paths, "path", "left_semi"))
        written(tokens(again, buckets).withColumn("reject", F.lit(None).cast("string")), buckets, name, "path")
    tables = [spark.table(name)]
    if seen.get["n_long"]:
        scratch, long_name = Scratch(spark), f"{name}_long"
        long_files = files.filter(size > long_file)
        facts, unbalanced = long_tokens(long_files, scratch, part_tokens=part_tokens)
        written(facts, buckets, long_name, "path", "part")
        unbalanced = scratch.stored(unbalanced)
        if not unbalanced.isEmpty():
            again, _ = long_tokens(mended(long_files.join(unbalanced, "path", "left_semi")), scratch, part_tokens=part_tokens)
            written(again, buckets, long_name, "path", "part")
        scratch.drop_all()
        tables.append(spark.table(long_name))
    return tables


def drop_facts(spark: SparkSession, name: str) -> None:
    """Drops the tables of a run and empties their folders, which external tables would leave."""
    for table in (name, f"{name}_long"):
        if spark.catalog.tableExists(table):
            spark.sql(f"DROP TABLE {table}")
            spark.range(0).write.mode("overwrite").parquet(f"{ensure_checkpoint_dir(spark)}/{table}")


def audit(
    files: DataFrame, cfg: AuditConfig = AuditConfig(), key: str = "path", facts_name: str | None = None, limits: DataFrame | None = None,
    long_file: int = LONG_FILE, part_tokens: int = PART_TOKENS, scratch: Scratch | None = None,
) -> DataFrame:
    """De-duplicated findings of all rules that are switched on.

    A dozen grains read the token facts, so these are computed and written once,
    into tables that stay until ``drop_facts``; ``audit_run`` sees to that.
    Files with unbalanced brackets are audited as far as they can be read, see ``mending``; ``coverage`` lists them.
    ``limits`` are thresholds by project, see ``ProjectLimits``.
    """
    on = cfg.enabled_analyzers()
    only = {r.rule_id for r in RULES.values() if r.analyzer in on}
    facts = stored_facts(files, facts_name or FACTS_PREFIX + uuid.uuid4().hex, long_file, part_tokens)
    chosen = cfg if limits is None else ProjectLimits(limits, files, cfg)
    return apply_toggles(findings_dedup(findings_of(facts, only, chosen, scratch or Scratch(files.sparkSession)), key), on)


# Bytes of text in a part; its facts take some fifty times that.
PART_BYTES = 4 << 20


def audit_rounds(
    files: DataFrame, scratch: Scratch, rounds: int | None = None, cfg: AuditConfig = AuditConfig(), key: str = "path", limits: DataFrame | None = None
) -> DataFrame:
    """The findings of ``audit``, for a corpus whose token facts would not fit on disk at once, nor into the buckets of one table.

    The text is written once, dealt into rounds by path; each round is audited and its facts are dropped. Findings on
    one file and the narrow items of the clone rule are kept, and clones are found over all rounds in the end. The number of
    rounds follows from the size of the text, unless it is given. What is stored goes with ``scratch``.
    """
    spark = files.sparkSession
    on = cfg.enabled_analyzers()
    only = {r.rule_id for r in RULES.values() if r.analyzer in on}
    if rounds is None:
        total = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        rounds = -(-total // (PART_BYTES * text_parts(files))) or 1
    texts = scratch.path("texts")
    files.select("path", "content", F.pmod(F.xxhash64("path"), F.lit(rounds)).alias("round")).write.partitionBy("round").parquet(texts)
    dealt = spark.read.schema("path string, content string, round int").parquet(texts)
    found_path, items_path, items = scratch.path("findings"), scratch.path("items"), None
    for number in range(rounds):
        batch, own, name = dealt.filter(F.col("round") == number).drop("round"), Scratch(spark), FACTS_PREFIX + uuid.uuid4().hex
        chosen = cfg if limits is None else ProjectLimits(limits, batch, cfg)
        parts, items = found_by_file(stored_facts(batch, name), only, chosen, own)
        findings_union(parts).write.mode("append").parquet(found_path)
        if items is not None:
            items.filter("hash IS NOT NULL").write.mode("append").parquet(items_path)
        drop_facts(spark, name)
        own.drop_all()
    found = spark.read.schema(SCHEMA).parquet(found_path)
    if items is not None:
        found = findings_union([found, clone_findings(spark.read.schema(items.schema).parquet(items_path))])
    return apply_toggles(findings_dedup(found, key), on)


@contextmanager
def audit_run(files: DataFrame, cfg: AuditConfig = AuditConfig(), key: str = "path", limits: DataFrame | None = None) -> Iterator[DataFrame]:
    """``with audit_run(files) as findings:`` the findings, whose stored facts are gone afterwards."""
    name, scratch = FACTS_PREFIX + uuid.uuid4().hex, Scratch(files.sparkSession)
    try:
        yield audit(files, cfg, key, name, limits, scratch=scratch)
    finally:
        drop_facts(files.sparkSession, name)
        scratch.drop_all()


def coverage(files: DataFrame) -> DataFrame:
    """(path, reason) of every file that the token rules saw only after mending, or not at all: none drops out of an audit unnoticed.

    ``reason`` is that of ``rejects``, or that the file has no text.
    """
    empty = files.filter("content IS NULL").selectExpr("path", "'no text' AS reason")
    return rejects(files.filter("content IS NOT NULL")).unionByName(empty)


__all__ = ["audit", "audit_rounds", "audit_run", "coverage", "drop_facts", "findings_of", "rejects", "rule_findings"]
