"""Cells as paragraphs of runs: pieces of text, each in one font.

Words go to cells by bands, lines and font changes are windows over a cell, and
only the decision whether a line goes on the one before, which reads the text so
far, is a fold over the few lines of a cell.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.functions import wrap
from tessella.functions.runs import RUN
from tessella.operators.geometry import LINE_GAP, PAGE, joined_words, words_in_rects

CELL = ("doc_id", "page_no", "cell_id")


def run_lines(cells: DataFrame, words: DataFrame) -> DataFrame:
    """(cell, line, runs, top, bottom, x0, x1): the visual lines of each cell, their words parted where the font changes."""
    rects = cells.select(*PAGE, F.col("cell_id").alias("rect_id"), "x0", "x1", "top", "bottom")
    inside = words_in_rects(words, rects).withColumnRenamed("rect_id", "cell_id").withColumn("middle", F.round((F.col("top") + F.col("bottom")) / 2, 1))
    down = Window.partitionBy(*CELL).orderBy("middle", "x0", "word_no")
    apart = F.coalesce(F.col("middle") - F.lag("middle").over(down) > LINE_GAP * 1.5, F.lit(True)).cast("int")
    lined = inside.withColumn("starts", apart).withColumn("line", F.sum("starts").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*CELL, "line").orderBy("x0", "top", "word_no")
    font = F.struct(F.round(F.coalesce("size", F.lit(0.0)), 1).alias("size"), F.coalesce("fontname", F.lit("")).alias("name"))
    lined = lined.withColumn("font", font).withColumn("pos", F.row_number().over(along))
    changes = F.coalesce(F.col("font") != F.lag("font").over(along), F.lit(True)).cast("int")
    parts = lined.withColumn("starts", changes).withColumn("run", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    items = F.array_sort(F.collect_list(F.struct("pos", "text", "x0", "x1")))
    runs = parts.groupBy(*CELL, "line", "run", "font").agg(items.alias("items"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    runs = runs.withColumn("text", F.trim(joined_words(F.col("items")))).where("text <> ''")
    size, name = F.when(F.col("font.size") != 0, F.col("font.size")), F.when(F.col("font.name") != "", F.col("font.name"))
    one = F.struct("run", F.struct(F.col("text"), size.alias("font_size"), name.alias("font_name")).cast(RUN).alias("r"))
    ends = (F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return runs.groupBy(*CELL, "line").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["r"]).alias("runs"), *ends)


def _met(left: list[dict], right: list[dict]) -> list[dict]:
    """One list of runs of two: those that meet become one, in the font of the first that has it."""
    a, b = left[-1], right[0]
    one = {"text": wrap.join(a["text"], b["text"]), "font_size": a["font_size"] or b["font_size"], "font_name": a["font_name"] or b["font_name"]}
    return [*left[:-1], one, *right[1:]]


def _paragraphs(lines: list[dict], right: float | None) -> list[list[dict]]:
    done: list[list[dict]] = []
    last = None
    for line in lines:
        runs = [dict(r) for r in line["runs"]]
        if last is not None:
            text = "".join(r["text"] for r in done[-1])
            before = {"text": text, "align": None, "font_size": next((r["font_size"] for r in reversed(done[-1]) if r["font_size"]), None)}
            after = {k: line[k] for k in ("top", "bottom", "x0", "x1")} | {"text": "".join(r["text"] for r in runs), "align": None, "font_size": next((r["font_size"] for r in runs if r["font_size"]), None)}
            if wrap.is_wrap(before, last, after, right):
                done[-1] = _met(done[-1], runs)
                last = line
                continue
        done.append(runs)
        last = line
    return done


_RUN = T.StructType([T.StructField("text", T.StringType()), T.StructField("font_size", T.DoubleType()), T.StructField("font_name", T.StringType())])


@F.arrow_udf(T.ArrayType(T.ArrayType(_RUN)))
def _folded(lines: pa.Array, right: pa.Array) -> pa.Array:
    folded = [_paragraphs(cell or [], r) for cell, r in zip(lines.to_pylist(), right.to_pylist(), strict=True)]
    return pa.array(folded, pa.list_(pa.list_(pa.struct([("text", pa.string()), ("font_size", pa.float64()), ("font_name", pa.string())]))))


def cell_paragraphs(cells: DataFrame, words: DataFrame) -> DataFrame:
    """``cells`` (page, cell_id, x0, top, x1, bottom) with ``paragraphs``: arrays of runs, wrapped lines joined.

    Where a wrapped line meets the next, the two runs become one in the first
    one's font.  A cell without words has no paragraphs; words without text make
    no runs.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line", "runs", "top", "bottom", "x0", "x1")))
    lines = run_lines(cells, words).groupBy(*CELL).agg(ordered.alias("_lines"))
    return cells.join(lines.hint("merge"), [*CELL], "left").withColumn("paragraphs", _folded("_lines", "x1")).drop("_lines")
