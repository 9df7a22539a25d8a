"""Numbers for rows that no single task has to count.

Spark's row_number over a window sends a whole group to one task.  Here a
group is counted by *stretches* of rows that lie together in the input: first
the rows of each stretch, then the stretches of each group, so a group that
holds a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRETCH_BITS = 14


def ranked(rows: DataFrame, by: list[str], order: str, stretch: Column, name: str) -> DataFrame:
    """Adds ``name``: ranks from 0 within ``by`` (no nulls) in the order of ``order``.

    ``stretch`` numbers ranges of ``order`` that each hold few rows.
    """
    rows = rows.withColumn("_stretch", stretch)
    counts = rows.groupBy(*by, "_stretch").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, "_stretch", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*by, "_stretch").orderBy(order)) - 1
    return rows.withColumn("_w", within).join(counts, [*by, "_stretch"]).withColumn(name, F.col("_before") + F.col("_w")).drop("_before", "_w", "_stretch")


def copies(rows: DataFrame, by: list[str], row: str, name: str = "copy") -> DataFrame:
    """Adds ``name``: the place of each row among those that are equal in ``by`` (no nulls).

    ``row``: a number of each row from monotonically_increasing_id, kept in a
    written table.  Which of several equal rows gets which number can differ
    between runs; as they are equal, no result does.
    """
    return ranked(rows, by, row, F.shiftright(row, STRETCH_BITS), name)
