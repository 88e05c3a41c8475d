"""Java texts rendered from the rows of ``part``, one file per row.

``k`` is the part key and ``s`` the size. What a rule must find in a file is a
plain function of these two columns, so an oracle that never parses anything
can state it. Texts grow with no more than ``s`` (50 at most), whatever the
size of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Brackets in comments and strings must not count as structure.
PREAMBLE = "'/* { ( \" */ // } )'"


def repeat(n: str, body: str) -> str:
    """SQL for ``n`` lines; ``i`` runs from 1 to n inside ``body``."""
    return f"if(({n}) > 0, transform(sequence(1, cast(({n}) as int)), i -> {body}), cast(array() as array<string>))"


def when(condition: str, line: str) -> str:
    return f"if({condition}, {line}, null)"


def java(*lines: str, head: str = "concat('class C', k, ' {')") -> str:
    """A class file: the preamble on line 1, the class on line 2, members from line 3."""
    return "concat_ws('\\n', " + ", ".join([PREAMBLE, head, *lines, "'}'"]) + ")"


def method(*lines: str, head: str = "'    void run(Svc o) {'") -> str:
    """A class with one method: its header on line 3, its statements from line 4."""
    return java(head, *lines, "'    }'")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has: a table of few row groups would be read, and all texts rendered, in as few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def planted(part: DataFrame, content: str) -> DataFrame:
    rows = spread(part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s")), "k")
    return rows.select(F.expr("concat('P', k, '.java')").alias("path"), F.expr(content).alias("content"))
