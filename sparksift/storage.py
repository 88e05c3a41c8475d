"""Tables in the shared checkpoint folder, for what is read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import ensure_checkpoint_dir


class Scratch:
    """Tables in the shared checkpoint folder that end lineage like checkpoints, and whose files go as soon as they are superseded.

    A loop that stores each round would otherwise keep all rounds on disk to the end of the session.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.named: list[str] = []

    def stored(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(found)] = (found, path)
        return found

    def path(self, name: str) -> str:
        """A folder to write to by hand; it goes with the others."""
        self.named.append(f"{self.folder}/{name}")
        return self.named[-1]

    def drop(self, *tables: DataFrame | None) -> None:
        """Empties tables that nothing reads any more; others, and None, are left alone."""
        for found in tables:
            if id(found) in self.paths:
                _, path = self.paths.pop(id(found))
                self.spark.range(0).write.mode("overwrite").parquet(path)

    def drop_all(self) -> None:
        self.drop(*(found for found, _ in list(self.paths.values())))
        while self.named:
            self.spark.range(0).write.mode("overwrite").parquet(self.named.pop())
