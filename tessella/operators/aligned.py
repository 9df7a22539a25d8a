"""Tables without strokes: lines whose words stand apart, above gutters that they share.

Words have doc_id, page_no, word_no, text, x0, x1, top and bottom.  A line of
prose is one segment; a line of a table is several.  Neighbouring lines of
several segments form a region, and the stretches of its width that no word
touches are the gutters between its columns.  All of it is windows over a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.geometry import LINE_GAP, PAGE

# fixed values, in points: what parts segments, gutters and regions
SEGMENT = 12.0
GUTTER = 6.0
APART = 30.0
LINES = 3


def _runs(rows: DataFrame, by: tuple[str, ...], low: str, high: str, gap: float, name: str) -> DataFrame:
    """Adds ``name``: numbers from 1 of stretches of ``by`` whose intervals (low, high) lie no further apart than ``gap``."""
    order = Window.partitionBy(*by).orderBy(low, high, "word_no")
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.withColumn("starts", F.coalesce(F.col(low) > reach + gap, F.lit(True)).cast("int"))
    return starts.withColumn(name, F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def _lines(words: DataFrame) -> DataFrame:
    """Adds ``line``: words whose tops form a chain of small steps."""
    order = Window.partitionBy(*PAGE).orderBy("top", "x0", "word_no")
    starts = F.coalesce(F.col("top") - F.lag("top").over(order) > LINE_GAP, F.lit(True)).cast("int")
    return words.withColumn("starts", starts).withColumn("line", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def _in_regions(lined: DataFrame) -> DataFrame:
    """Words of lines of two segments and more, with ``region``: one while such lines follow each other closely.

    Windows over a page tell each word of the line before, so words stay with their page and no line is joined back.
    """
    parts = _runs(lined, (*PAGE, "line"), "x0", "x1", SEGMENT, "_segment")
    line, along = Window.partitionBy(*PAGE, "line"), Window.partitionBy(*PAGE, "line").orderBy("x0", "x1", "word_no")
    lines = parts.withColumns({"_segments": F.max("_segment").over(line), "_top": F.min("top").over(line), "_bottom": F.max("bottom").over(line), "_first": F.row_number().over(along) == 1})
    down = Window.partitionBy(*PAGE).orderBy("line")
    above = lambda c: F.first(c).over(down.rangeBetween(-1, -1))
    follows = (above("_segments") > 1) & (F.col("_top") - above("_bottom") <= APART)
    marked = lines.withColumn("_starts", (F.col("_first") & ~F.coalesce(follows, F.lit(False))).cast("int"))
    marked = marked.withColumn("region", F.sum("_starts").over(down.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.where("_segments > 1").select(*lined.columns, "region")


def table_cells(words: DataFrame, lines: int = LINES) -> DataFrame:
    """(page, table_no, r, c, x0, top, x1, bottom, text) of tables that only the places of words show.

    A region of fewer than ``lines`` lines, of one column, or with a column that
    fewer than half of its lines fill is no table.  A cell without words has no
    row; the words of a cell come from left to right.  Words without a place or
    text are left out.
    """
    there = words.where("text <> '' AND x0 IS NOT NULL AND x1 IS NOT NULL AND top IS NOT NULL AND bottom IS NOT NULL")
    found = _runs(_in_regions(_lines(there)), (*PAGE, "region"), "x0", "x1", GUTTER, "column")
    region = Window.partitionBy(*PAGE, "region")
    cells = found.groupBy(*PAGE, "region", "line", "column").agg(
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.array_sort(F.collect_list(F.struct("x0", "word_no", "text"))).alias("w")
    )
    filled = F.count("*").over(Window.partitionBy(*PAGE, "region", "column"))
    n_lines = F.size(F.collect_set("line").over(region))
    cells = cells.withColumn("n_lines", n_lines).withColumn("filled", filled)
    cells = cells.withColumn("least", F.min("filled").over(region)).withColumn("columns", F.max("column").over(region))
    cells = cells.where((F.col("n_lines") >= lines) & (F.col("columns") > 1) & (2 * F.col("least") >= F.col("n_lines")))
    rank = lambda by, order: (F.dense_rank().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("int")
    return cells.select(
        *PAGE, rank(PAGE, "region").alias("table_no"), rank((*PAGE, "region"), "line").alias("r"), (F.col("column") - 1).cast("int").alias("c"), "x0", "top", "x1", "bottom", _joined(F.col("w")).alias("text")
    )


def _joined(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")
