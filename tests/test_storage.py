"""Stored tables and what is left of them."""

from sparksift.storage import Scratch


def test_superseded_tables_leave_no_rows(spark):
    scratch = Scratch(spark)
    first = scratch.stored(spark.range(100))
    second = scratch.stored(first.filter("id < 10"))
    scratch.drop(first, None, spark.range(3))
    assert second.count() == 10 and spark.read.parquet(f"{scratch.folder}/1").count() == 0
