"""Audit of uploaded sets as they arrive: each micro-batch is one set, audited on its own.

As with uploads by hand, findings never mix between sets, so no state is kept
between batches and a clone is one within its set.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import AuditConfig
from ..plans.audit import audit_run
from ..sources.files import as_text


def arriving_sources(spark: SparkSession, folder: str, suffix: str = ".java") -> DataFrame:
    """A stream of the files that appear below a folder."""
    found = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}")
        .load(folder)
    )
    return found.select("path", as_text(F.col("content")).alias("content"))


def audit_arrivals(
    sources: DataFrame, sink: str, checkpoint: str, run: Callable[[DataFrame], DataFrame] | None = None,
    cfg: AuditConfig = AuditConfig(),
) -> StreamingQuery:
    """Start writing the findings of every batch below ``sink``, one folder per batch.

    A batch that is run again after a failure overwrites its own folder, so
    nothing is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with nullcontext(run(batch)) if run else audit_run(batch, cfg) as findings:
            findings.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return sources.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
