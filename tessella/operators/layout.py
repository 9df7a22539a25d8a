"""Tables, rules and images of a page, and what a document's blocks add up to.

Tables come as rectangles (doc_id, page_no, table_id, rect_no, x0, top, x1,
bottom); everything is an aggregate or a join on the page, but for merging
cells under wide words, which changes the grid it reads and is a fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.numbers import area, horizontal_align, overlap_of_first, render_dpi, upper_median
from tessella.operators.geometry import BAND, PAGE, aligned_columns, banded, bin_of, centre, distinct_within, has_drawn_grid, joined_words

TABLE = (*PAGE, "table_id")


# ---------------------------------------------------------------- grids and cells


def grids(rects: DataFrame) -> DataFrame:
    """vx and hy of each table: its different edges to a tenth, in order."""
    edges = lambda a, b: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.round(a, 1), F.round(b, 1))))))
    return rects.groupBy(*TABLE).agg(edges("x0", "x1").alias("vx"), edges("top", "bottom").alias("hy"))


def grid_cells(rects: DataFrame) -> DataFrame:
    """Anchor cells: r, c, rowspan, colspan and box.

    A rectangle over several bands is a merged cell; one that reaches the
    bottom goes on to the last row.  Of two with one anchor the first counts.
    """
    both = rects.join(grids(rects).hint("merge"), list(TABLE)).where((F.size("vx") > 1) & (F.size("hy") > 1))
    at = both.withColumns({"c": bin_of(F.col("x0") + 0.5, F.col("vx")), "c1": bin_of(F.col("x1") - 0.5, F.col("vx")), "r": bin_of(F.col("top") + 0.5, F.col("hy")), "r1": bin_of(F.col("bottom") - 0.5, F.col("hy"))}).where("c IS NOT NULL AND r IS NOT NULL AND c1 IS NOT NULL AND r1 IS NOT NULL")
    low = F.abs(F.col("bottom") - F.element_at("hy", -1)) < 1.0
    at = at.withColumn("rowspan", F.when(low, F.size("hy") - 1 - F.col("r")).otherwise(F.col("r1") - F.col("r") + 1)).withColumn("colspan", F.col("c1") - F.col("c") + 1)
    first = F.row_number().over(Window.partitionBy(*TABLE, "r", "c").orderBy("rect_no"))
    edge = lambda a, k: F.get(a, k)
    at = at.withColumn("_n", first).where("_n = 1")
    return at.select(*TABLE, "r", "c", "rowspan", "colspan", edge("vx", F.col("c")).alias("x0"), edge("vx", F.col("c1") + 1).alias("x1"), edge("hy", F.col("r")).alias("top"), edge("hy", F.col("r1") + 1).alias("bottom"))


def cell_texts(cells: DataFrame, words: DataFrame) -> DataFrame:
    """Text, font and alignment of each cell, from the words whose centre is in it.

    The font is the most frequent, the first met of equal ones; each visual
    line votes for an alignment by its room on both sides.
    """
    cx, cy = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.top") + F.col("w.bottom")) / 2
    on = [F.col(f"k.{p}") == F.col(f"w.{p}") for p in (*PAGE, "band")] + [cx >= F.col("k.x0"), cx < F.col("k.x1"), cy >= F.col("k.top"), cy < F.col("k.bottom")]
    key = [*TABLE, "r", "c"]
    by_height = words.withColumn("band", F.floor(centre()[1] / BAND))
    met = banded(cells, F.col("top"), F.col("bottom")).alias("k").join(by_height.alias("w").hint("merge"), on).select(*[F.col(f"k.{c}").alias(c) for c in key], *[F.col(f"k.{c}").alias(f"k_{c}") for c in ("x0", "x1", "top", "bottom")], *[F.col(f"w.{c}").alias(c) for c in ("word_no", "text", "x0", "x1", "top", "bottom", "size", "fontname")])
    lines = met.groupBy(*key, F.round("top").alias("line")).agg(F.min("x0").alias("a"), F.max("x1").alias("b"), F.min("k_x0").alias("l"), F.max("k_x1").alias("r_"), joined_words(F.array_sort(F.collect_list(F.struct("x0", "top", "text", "x1")))).alias("t"))
    left, right = F.col("a") - F.col("l"), F.col("r_") - F.col("b")
    lines = lines.withColumn("vote", F.when(right > left * 2.5, "left").when(left > right * 2.5, "right").otherwise("center"))
    ballot = lines.groupBy(*key, "vote").agg(F.count("*").alias("n"), F.min("line").alias("at")).groupBy(*key).agg(F.max_by("vote", F.struct("n", -F.col("at"))).alias("align"))
    texts = lines.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("text"))
    fonts = met.groupBy(*key, F.round(F.coalesce("size", F.lit(0.0)), 1).alias("s"), F.coalesce("fontname", F.lit("")).alias("f")).agg(F.count("*").alias("n"), F.min("word_no").alias("at"))
    fonts = fonts.groupBy(*key).agg(F.max_by(F.struct("s", "f"), F.struct("n", -F.col("at"))).alias("font"))
    above, below = F.min("top") - F.min("k_top"), F.max("k_bottom") - F.max("bottom")
    boxes = met.groupBy(*key).agg(F.when(below > above * 2.5, "top").when(above > below * 2.5, "bottom").otherwise("center").alias("valign"), F.min("x0").alias("text_x0"), F.max("x1").alias("text_x1"))
    out = cells
    for part in (texts, ballot, fonts, boxes):
        out = out.join(part.hint("merge"), key, "left")
    return out.select(*cells.columns, F.coalesce("text", F.lit("")).alias("text"), F.nullif(F.col("font.s"), F.lit(0.0)).alias("font_size"), F.nullif(F.col("font.f"), F.lit("")).alias("font_name"), F.coalesce("align", F.lit("left")).alias("align"), F.coalesce("valign", F.lit("top")).alias("valign"), "text_x0", "text_x1")


def spanning_words(words: DataFrame, grid: DataFrame, cover: float) -> DataFrame:
    """Of each table row (r) the words over several columns, from a to b, with the edge that b ends at.

    Such a word covers at least 0.15 of its outer columns and half of ``cover`` of those between.
    """
    w = words.select(*PAGE, "word_no", *[F.col(c).alias(f"w_{c}") for c in ("x0", "x1", "top", "bottom")])
    first, last = (lambda e: F.get(e, F.lit(0))), (lambda e: F.element_at(e, -1))
    inside = (F.col("w_x1") >= first("vx")) & (F.col("w_x0") <= last("vx")) & (F.col("w_bottom") >= first("hy")) & (F.col("w_top") <= last("hy"))
    once = F.col("band") == F.greatest(F.floor(F.col("w_top") / BAND), F.floor(first("hy") / BAND))  # the first of the bands that both lie in
    met = banded(w, F.col("w_top"), F.col("w_bottom")).join(banded(grid.where((F.size("vx") > 2) & (F.size("hy") > 1)), first("hy"), last("hy")).hint("merge"), [*PAGE, "band"]).where(once & inside)
    met = met.withColumns({"r": bin_of((F.col("w_top") + F.col("w_bottom")) / 2, F.col("hy")), "a": bin_of(F.col("w_x0") + 0.5, F.col("vx")), "b": bin_of(F.col("w_x1") - 0.5, F.col("vx"))}).where("r IS NOT NULL AND b > a")

    def share(k: Column) -> Column:
        left, right = F.get("vx", k), F.get("vx", k + 1)
        return (F.least("w_x1", right) - F.greatest("w_x0", left)) / F.greatest(right - left, F.lit(1e-6))

    between = F.forall(F.slice(F.sequence("a", "b"), F.lit(2), F.col("b") - F.col("a") - 1), lambda k: share(k) >= cover * 0.5)
    return met.where((share(F.col("a")) >= 0.15) & (share(F.col("b")) >= 0.15) & between).select(*TABLE, "r", "word_no", "a", "b", F.get("vx", F.col("b") + 1).alias("edge"))


def merged_under_words(cells: DataFrame, words: DataFrame, grid: DataFrame, cover: float = 0.55) -> DataFrame:
    """Cells after words that span several columns have merged them under the leftmost.

    A merge is refused if it would swallow other text or a tall cell.  Words
    come in their order and each reads the row the last one left; rows do not
    act on each other, so a row is the unit, and rows without such words pass
    as they are.
    """
    names, row = cells.columns, [*TABLE, "r"]
    wide = spanning_words(words, grid, cover).groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("word_no", "a", "b", "edge"))).alias("wide"))
    held = F.struct(*[F.col(f"`{c}`") for c in names])
    rows = cells.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("c", held.alias("cell")))).alias("held")).join(wide.hint("merge"), row, "left")
    cell = lambda f: F.transform("held", lambda k: k["cell"][f])
    busy = rows.where("wide IS NOT NULL").select("held", *[cell(f).alias(f) for f in ("c", "colspan", "rowspan", "x1")], F.transform("held", lambda k: F.regexp_replace(F.coalesce(k["cell"]["text"], F.lit("")), r"^\s+|\s+$", "")).alias("text"), "wide")
    united = busy.mapInArrow(_united, f"held {rows.schema['held'].dataType.simpleString()}, kept array<struct<k:int,colspan:int,x1:double>>")
    changed = united.select("held", F.explode("kept").alias("n")).select(F.get("held", F.col("n.k"))["cell"].alias("cell"), "n")
    put = {"colspan": F.col("n.colspan").cast(cells.schema["colspan"].dataType), "x1": F.col("n.x1")}
    changed = changed.select(*[put[c].alias(c) if c in put else F.col("cell")[c].alias(c) for c in names])
    same = rows.where("wide IS NULL").select(F.explode("held").alias("h")).select("h.cell.*")
    return same.unionByName(changed)


_KEPT = pa.list_(pa.struct([("k", pa.int32()), ("colspan", pa.int32()), ("x1", pa.float64())]))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row of a table the cells that its wide words leave, by place, with their new widths and right edges."""
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("c", "colspan", "rowspan", "x1", "text", "wide")]
        kept = []
        for start, width, height, right, text, wide in zip(*columns, strict=True):
            stop = [a + n for a, n in zip(start, width, strict=True)]
            at = [-1] * max(*stop, *(w["b"] + 1 for w in wide))
            for k, (a, b) in enumerate(zip(start, stop, strict=True)):
                at[a:b] = [k] * (b - a)
            for w in wide:
                own = at[w["a"]]
                if own < 0:
                    continue
                end = max(stop[own], w["b"] + 1)
                others = set(at[start[own] : end]) - {-1, own}
                if any(height[k] > 1 or text[k] not in ("", text[own]) for k in others):
                    continue
                right[own] = w["edge"] if w["b"] + 1 > stop[own] else right[own]
                at = [-1 if k in others else k for k in at]
                at[start[own] : end], stop[own] = [own] * (end - start[own]), end
            kept.append([{"k": k, "colspan": stop[k] - start[k], "x1": right[k]} for k in sorted(set(at) - {-1})])
        yield pa.RecordBatch.from_arrays([batch.column("held"), pa.array(kept, _KEPT)], names=["held", "kept"])


# ---------------------------------------------------------------- is it a table


def fill_counts(cells: DataFrame) -> DataFrame:
    """Per table: anchors, filled ones, and how many rows and columns have two or more."""
    full = (F.trim("text") != "").cast("int")
    rows = cells.groupBy(*TABLE, "r").agg(F.sum(full).alias("n")).groupBy(*TABLE).agg(F.count_if(F.col("n") >= 2).alias("strong_rows"), F.count_if(F.col("n") == 0).alias("empty_rows"))
    cols = cells.groupBy(*TABLE, "c").agg(F.sum(full).alias("n")).groupBy(*TABLE).agg(F.count_if(F.col("n") >= 2).alias("strong_cols"))
    size = F.length(F.trim("text"))
    whole = cells.groupBy(*TABLE).agg(F.count("*").alias("anchors"), F.sum(full).alias("filled"), F.count_if((full == 1) & (size <= 1)).alias("tiny"), F.count_if((full == 1) & (size <= 2)).alias("short"), F.count_if(size > 36).alias("long"), F.avg(F.when(full == 1, size)).alias("avg_len"))
    return whole.join(rows.hint("merge"), list(TABLE)).join(cols.hint("merge"), list(TABLE))


def text_gaps(cells: DataFrame) -> DataFrame:
    """Per table the gaps between the texts of neighbouring filled cells in a row."""
    row = Window.partitionBy(*TABLE, "r").orderBy("c")
    gap = F.lead("text_x0").over(row) - F.col("text_x1")
    filled = cells.where((F.trim("text") != "") & F.col("text_x0").isNotNull())
    return filled.withColumn("gap", gap).where("gap IS NOT NULL").groupBy(*TABLE).agg(F.collect_list("gap").alias("gaps"))


# Between which bounds a measure of a form lies, each bound included.
FORM_BOUNDS = {
    "rows": (2, 25), "cols": (2, 6), "cells": (None, 40), "filled": (4, None), "strong_cols": (2, None), "strong_rows": (2, None),
    "empty": (None, 0.65), "tiny": (None, 0.2), "n_words": (4, None), "split_words": (None, 1), "aligned": (2, None), "spare_cols": (None, 0),
}
# Of forms with three columns and more, the most empty cells and short texts.
WIDE_FORM_BOUNDS = {"empty": (None, 0.55), "short": (None, 0.45)}
# The least middle gap, and what share of gaps below which width makes a text of it.
FORM_GAP, TIGHT_GAP, TIGHT_SHARE = 18.0, 12.0, 0.4
# Above which share of empty rows the middle gap must be how wide.
SPARSE_ROWS, SPARSE_GAP = 0.35, 40.0
# Two columns of texts longer than this on average, half of them long, in fewer strong rows, are prose.
PROSE_LENGTH, PROSE_SHARE, PROSE_ROWS = 48, 0.5, 3


def within(bounds: dict) -> Column:
    """Whether all measures are there and within their bounds."""
    held = [F.col(m) >= low for m, (low, _) in bounds.items() if low is not None] + [F.col(m) <= high for m, (_, high) in bounds.items() if high is not None]
    return F.forall(F.array(*held), lambda x: F.coalesce(x, F.lit(False)))


def form_measures(cells: DataFrame, grid: DataFrame, words: DataFrame) -> DataFrame:
    """What the bounds of forms speak of, one row a table."""
    first, last = (lambda e: F.get(e, F.lit(0)) - 1), (lambda e: F.element_at(e, -1) + 1)
    x, y = centre()
    placed = words.select(*PAGE, F.col("x0").alias("w_x0"), x.alias("w_x"), y.alias("w_y"))
    inside = F.col("w_x").between(first("vx"), last("vx")) & F.col("w_y").between(first("hy"), last("hy"))
    met = banded(placed, F.col("w_y"), F.col("w_y")).join(banded(grid, first("hy"), last("hy")).hint("merge"), [*PAGE, "band"]).where(inside)
    seen = met.groupBy(*TABLE).agg(F.count("*").alias("n_words"), aligned_columns(F.collect_list("w_x0")).alias("aligned"))
    of_filled = lambda c: F.col(c) / F.greatest("filled", F.lit(1))
    t = grid.select(*TABLE, (F.size("vx") - 1).alias("cols"), (F.size("hy") - 1).alias("rows")).join(fill_counts(cells).hint("merge"), list(TABLE)).join(text_gaps(cells).hint("merge"), list(TABLE), "left").join(seen.hint("merge"), list(TABLE), "left")
    t = t.withColumns({"gaps": F.coalesce("gaps", F.array().cast("array<double>")), "n_words": F.coalesce("n_words", F.lit(0)), "aligned": F.coalesce("aligned", F.lit(0))})
    return t.withColumns({
        "cells": F.col("rows") * F.col("cols"),
        "empty": (F.col("anchors") - F.col("filled")) / F.greatest("anchors", F.lit(1)),
        "tiny": of_filled("tiny"), "short": of_filled("short"), "long": of_filled("long"),
        "split_words": F.col("filled") - F.col("n_words"),
        "spare_cols": F.col("cols") - F.greatest(F.col("aligned") + 1, F.floor(F.col("aligned") * 1.5) + 1),
        "empty_rows": F.col("empty_rows") / F.greatest("rows", F.lit(1)),
        "middle": upper_median(F.col("gaps")),
        "tight": F.size(F.filter("gaps", lambda g: g < TIGHT_GAP)) / F.greatest(F.size("gaps"), F.lit(1)),
    })


def plausible_forms(cells: DataFrame, grid: DataFrame, words: DataFrame) -> DataFrame:
    """Whether a table without drawn lines looks like a form and not like prose."""
    sure = lambda x: F.coalesce(x, F.lit(False))
    spaced = (F.size("gaps") == 0) | sure((F.col("middle") >= FORM_GAP) & (F.col("tight") < TIGHT_SHARE))
    filled_out = sure(F.col("empty_rows") <= SPARSE_ROWS) | sure(F.col("middle") >= SPARSE_GAP)
    prose = (F.col("cols") == 2) & sure(F.col("avg_len") > PROSE_LENGTH) & (F.col("strong_rows") < PROSE_ROWS) & sure(F.col("long") >= PROSE_SHARE)
    form = within(FORM_BOUNDS) & ((F.col("cols") < 3) | within(WIDE_FORM_BOUNDS)) & spaced & filled_out & ~prose
    return form_measures(cells, grid, words).select(*TABLE, (F.col("filled") > 0).alias("has_text"), form.alias("plausible"))


def accepted(plausible: DataFrame, drawn: DataFrame) -> DataFrame:
    """Tables to keep: with text, and drawn or plausible.  drawn: vertical and horizontal stroke counts."""
    both = plausible.join(drawn.hint("merge"), list(TABLE), "left")
    grid = F.coalesce(has_drawn_grid(F.col("vertical"), F.col("horizontal")), F.lit(False))
    return both.select(*TABLE, (F.col("has_text") & (grid | F.col("plausible"))).alias("accepted"))


# ---------------------------------------------------------------- strokes, borders, rules, images


def strokes(lines: DataFrame, edges: DataFrame, rects: DataFrame, *, thick: float = 3.75, long: float = 40.0) -> DataFrame:
    """Lines, edges and rectangles so thin that they are drawn as lines."""
    box = [*PAGE, "x0", "top", "x1", "bottom"]
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("bottom") - F.col("top"))
    thin = rects.where(((w >= long) & (h <= thick)) | ((h >= long) & (w <= thick)))
    return lines.select(*box).unionByName(edges.select(*box)).unionByName(thin.select(*box))


def stroke_counts(boxes: DataFrame, drawn: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Different upright and level strokes that cross each table's box; tables that no stroke comes near have no row."""
    s = drawn.select(*PAGE, *[F.col(c).alias(f"s_{c}") for c in ("x0", "top", "x1", "bottom")])
    upright, level = F.abs(F.col("s_x0") - F.col("s_x1")) < 0.75, F.abs(F.col("s_top") - F.col("s_bottom")) < 0.75
    x, y = (F.col("s_x0") + F.col("s_x1")) / 2, (F.col("s_top") + F.col("s_bottom")) / 2
    tall = F.least(F.greatest("s_top", "s_bottom"), F.col("bottom")) - F.greatest(F.least("s_top", "s_bottom"), F.col("top"))
    wide = F.least(F.greatest("s_x0", "s_x1"), F.col("x1")) - F.greatest(F.least("s_x0", "s_x1"), F.col("x0"))
    v = upright & x.between(F.col("x0") - tolerance, F.col("x1") + tolerance) & (tall >= F.greatest(F.lit(8.0), (F.col("bottom") - F.col("top")) * 0.15))
    h = ~upright & level & y.between(F.col("top") - tolerance, F.col("bottom") + tolerance) & (wide >= F.greatest(F.lit(12.0), (F.col("x1") - F.col("x0")) * 0.15))
    low, high = F.least("s_top", "s_bottom"), F.greatest("s_top", "s_bottom")
    once = F.col("band") == F.greatest(F.floor(low / BAND), F.floor((F.col("top") - tolerance) / BAND))  # the first of the bands that both lie in
    met = banded(boxes, F.col("top") - tolerance, F.col("bottom") + tolerance).join(banded(s, low, high).hint("merge"), [*PAGE, "band"]).where(once)
    met = met.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.when(v, x))).alias("v"), F.array_sort(F.collect_list(F.when(h, y))).alias("h"))
    return met.select(*TABLE, F.size(distinct_within(F.col("v"), tolerance)).alias("vertical"), F.size(distinct_within(F.col("h"), tolerance)).alias("horizontal"))


def table_borders(boxes: DataFrame, lines: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Widest outer and inner line of each table, and whether any is dashed; half a point without lines.  Lines have top <= bottom."""
    n = lines.select(*PAGE, *[F.col(c).alias(f"l_{c}") for c in ("x0", "top", "x1", "bottom", "linewidth", "dashed")])
    within = (F.col("l_x0") >= F.col("x0") - tolerance) & (F.col("l_x1") <= F.col("x1") + tolerance) & (F.col("l_top") >= F.col("top") - tolerance) & (F.col("l_bottom") <= F.col("bottom") + tolerance)
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance
    upright = F.abs(F.col("l_x0") - F.col("l_x1")) < 0.5
    outer = F.when(upright, near("l_x0", "x0") | near("l_x0", "x1")).otherwise(near("l_top", "top") | near("l_bottom", "bottom"))
    width = F.when((F.col("l_linewidth") > 0), F.col("l_linewidth")).otherwise(0.5)
    n = n.withColumn("band", F.floor(F.col("l_top") / BAND))
    found = banded(boxes, F.col("top") - tolerance, F.col("bottom") + tolerance).join(n.hint("merge"), [*PAGE, "band"]).where(within).groupBy(*TABLE).agg(F.max(F.when(outer, width)).alias("o"), F.max(F.when(~outer, width)).alias("i"), F.bool_or(F.coalesce("l_dashed", F.lit(False))).alias("d"))
    out = boxes.select(*TABLE).distinct().join(found.hint("merge"), list(TABLE), "left")
    edge = F.coalesce("o", "i", F.lit(0.5))
    return out.select(*TABLE, edge.alias("outer"), F.coalesce(F.col("i"), edge).alias("inner"), F.coalesce("d", F.lit(False)).alias("dashed"))


def rules_outside(rules: DataFrame, tables: DataFrame, pad: float = 1.0) -> DataFrame:
    """Rules (top, x0, x1, thickness) whose middle lies in no table."""
    t = tables.select(*[F.col(c).alias(f"t_{c}") for c in (*PAGE, "x0", "top", "x1", "bottom")])
    t = banded(t, F.col("t_top") - pad, F.col("t_bottom") + pad)
    x, y = (rules["x0"] + rules["x1"]) / 2, rules["top"] + rules["thickness"] / 2
    inside = x.between(t["t_x0"] - pad, t["t_x1"] + pad) & y.between(t["t_top"] - pad, t["t_bottom"] + pad)
    return rules.join(t.hint("merge"), [rules[p] == t[f"t_{p}"] for p in PAGE] + [F.floor(y / BAND) == t["band"], inside], "left_anti")


def page_images(images: DataFrame, tables: DataFrame, page_area: float, *, most: int = 15) -> DataFrame:
    """A page's images outside its tables, not tiny and not the page itself, in reading order."""
    t = tables.select(*[F.col(c).alias(f"t_{c}") for c in (*PAGE, "x0", "top", "x1", "bottom")])
    t = banded(t, F.col("t_top"), F.col("t_bottom"))
    box = tuple(images[c] for c in ("x0", "top", "x1", "bottom"))
    other = tuple(t[f"t_{c}"] for c in ("x0", "top", "x1", "bottom"))
    middle = F.floor((images["top"] + images["bottom"]) / 2 / BAND)  # what covers over half of an image covers its middle
    kept = images.join(t.hint("merge"), [images[p] == t[f"t_{p}"] for p in PAGE] + [middle == t["band"], overlap_of_first(box, other) > 0.5], "left_anti")
    own = tuple(F.col(c) for c in ("x0", "top", "x1", "bottom"))
    kept = kept.where((F.col("x1") - F.col("x0") > 1) & (F.col("bottom") - F.col("top") > 1) & (area(own) >= 1600.0) & (area(own) / page_area <= 0.85))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.round("top", 1), F.round("x0", 1), "image_no"))
    return kept.withColumn("place", place.cast("long")).where(F.col("place") <= most)


def sharp_enough(px_w: Column, px_h: Column, w: Column, h: Column) -> Column:
    """Whether an image's own pixels do for its place on the page."""
    dpi = render_dpi(w, h)
    dense = (px_w / w >= 1.2) & (px_h / h >= 1.2)
    like = (px_w >= w * dpi / 72 * 0.9) & (px_h >= h * dpi / 72 * 0.9)
    return F.coalesce((w > 1) & (h > 1) & (px_w >= 2) & (px_h >= 2) & (dense | like), F.lit(False))


def ocr_lines(found: DataFrame, page_width: float, *, scale_x: float = 1.0, scale_y: float = 1.0, least: float = 35.0) -> DataFrame:
    """Lines of recognised words (block_num, par_num, line_num, text, conf, left, top, width, height)."""
    words = found.where((F.trim("text") != "") & (F.col("conf") >= least) & (F.col("width") > 0) & (F.col("height") > 0))
    key = [*PAGE, "block_num", "par_num", "line_num"]
    items = F.array_sort(F.collect_list(F.struct(F.col("left").alias("x0"), F.trim("text").alias("text"))))
    rows = words.groupBy(*key).agg(items.alias("w"), (F.min("left") * scale_x).alias("x0"), (F.max(F.col("left") + F.col("width")) * scale_x).alias("x1"), (F.min("top") * scale_y).alias("top"), (F.max(F.col("top") + F.col("height")) * scale_y).alias("bottom"))
    wide = r"[\u4e00-\u9fff\u3400-\u4dbf\u3000-\u303f\uff00-\uffef]"
    close = lambda s, x: F.when(s == "", x["text"]).when(F.right(s, F.lit(1)).rlike(wide) & F.substring(x["text"], 1, 1).rlike(wide), F.concat(s, x["text"])).otherwise(F.concat(s, F.lit(" "), x["text"]))
    text = F.trim(F.aggregate("w", F.lit(""), close))
    size = F.greatest(F.round((F.col("bottom") - F.col("top")) * 0.75, 1), F.lit(8.0))
    return rows.select(*key, text.alias("text"), "x0", "x1", "top", "bottom", size.alias("font_size"), horizontal_align(F.col("x0"), F.col("x1"), F.lit(page_width)).alias("align"))


# ---------------------------------------------------------------- documents


def content_warnings(counts: DataFrame) -> DataFrame:
    """What is worth telling of a document (doc_id, pages, tables, texts, images, ocr)."""
    none = (F.col("tables") == 0) & (F.col("texts") == 0)
    empty = (F.col("pages") == 0) | (none & (F.col("images") == 0))
    found = F.array(F.when(empty, "empty").when(none & (F.col("images") > 0), "image_only"), F.when(F.coalesce("ocr", F.lit(False)) & (F.col("pages") > 0), "ocr_applied"))
    return counts.select("doc_id", F.array_compact(found).alias("warnings"))


def batch_totals(parts: DataFrame) -> DataFrame:
    """Per batch: files, bytes, counts, and the different warnings and engines in order."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("size_bytes", "pages", "tables", "images", "lines")]
    return parts.groupBy("batch_id").agg(F.count("*").alias("files"), *sums, F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("warnings"), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"))


def paired_pages(pages: DataFrame) -> DataFrame:
    """First pages two by two: upper and lower half of a sheet (pair_id, position 0 or 1, path)."""
    return pages.groupBy("pair_id").agg(F.max(F.when(F.col("position") == 0, F.col("path"))).alias("upper"), F.max(F.when(F.col("position") == 1, F.col("path"))).alias("lower"))
