"""Queries for pages: a form on each page, with its words, strokes, fills, rules and images.

Every part is a page with a table of three rows and three columns.  In one of
three the first cell spans two columns; one of five has two words only; every
second has drawn lines.  What comes out is known from the number of the part,
which is what the SQL says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.numbers import upper_median
from tessella.operators import geometry, layout
from tessella.plans import tables as t
from tessella.plans.registry import query

LEFT, TOP, WIDE, TALL = 50.0, 100.0, 100.0, 20.0


def _pages(spark, sf_dir) -> DataFrame:
    return t.dealt(t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id")), "doc_id").select("doc_id", F.lit(0).alias("page_no"))


def _rows(pages: DataFrame, fields: str, *values: tuple) -> DataFrame:
    """Rows of literals for each page."""
    names = [x.split()[0] for x in fields.split(", ")]
    items = F.array(*[F.struct(*[F.lit(v).cast(x.split()[1]).alias(n) for v, n, x in zip(row, names, fields.split(", "), strict=True)]) for row in values])
    return pages.select("doc_id", "page_no", F.explode(items).alias("x")).select("doc_id", "page_no", "x.*")


def _box(r: int, c: int, wide: int = 1) -> tuple:
    return LEFT + WIDE * c, TOP + TALL * r, LEFT + WIDE * (c + wide), TOP + TALL * (r + 1)


_BOX = "x0 double, top double, x1 double, bottom double"
_CELLS = [(r, c) for r in range(3) for c in range(3)]


def _rects(spark, sf_dir) -> DataFrame:
    pages = _pages(spark, sf_dir)
    plain = _rows(pages.where("doc_id % 3 <> 0"), f"table_id int, rect_no int, {_BOX}", *[(0, 3 * r + c, *_box(r, c)) for r, c in _CELLS])
    merged = _rows(pages.where("doc_id % 3 = 0"), f"table_id int, rect_no int, {_BOX}", *[(0, 3 * r + c, *_box(r, c, 2 if (r, c) == (0, 0) else 1)) for r, c in _CELLS if (r, c) != (0, 1)])
    return plain.unionByName(merged)


def _words(spark, sf_dir) -> DataFrame:
    rows = _rows(_pages(spark, sf_dir), f"word_no long, text string, {_BOX}", *[(3 * r + c, f"r{r}c{c}", x0 + 10, top + 4, x0 + 40, top + 14) for r, c in _CELLS for x0, top, _, _ in [_box(r, c)]])
    rows = rows.where((F.col("doc_id") % 5 != 0) | F.col("word_no").isin(0, 8)).where((F.col("doc_id") % 3 != 0) | (F.col("word_no") != 1))
    return rows.withColumn("size", F.lit(10.0)).withColumn("fontname", F.when(F.col("word_no") % 2 == 0, "Song").otherwise("Hei"))


def _lines(spark, sf_dir) -> DataFrame:
    """Outer lines two points wide, inner ones one; nothing between the cells that a merged one covers."""
    right, low = LEFT + 3 * WIDE, TOP + 3 * TALL
    level = [(k, LEFT, TOP + TALL * k, right, TOP + TALL * k, 2.0 if k in (0, 3) else 1.0, "black", False) for k in range(4)]
    upright = [(4 + k, LEFT + WIDE * k, TOP, LEFT + WIDE * k, low, 2.0 if k in (0, 3) else 1.0, "black", k == 1) for k in range(4)]
    return _rows(_pages(spark, sf_dir).where("doc_id % 2 = 0"), f"line_no int, {_BOX}, linewidth double, color string, dashed boolean", *level, *upright)


def _tables(spark, sf_dir) -> DataFrame:
    return _rows(_pages(spark, sf_dir), f"table_id int, {_BOX}", (0, LEFT, TOP, LEFT + 3 * WIDE, TOP + 3 * TALL))


def _cells(spark, sf_dir) -> DataFrame:
    return layout.grid_cells(_rects(spark, sf_dir)).withColumn("cell_id", F.col("r") * 3 + F.col("c"))


def _filled(spark, sf_dir) -> DataFrame:
    return layout.cell_texts(layout.grid_cells(_rects(spark, sf_dir)), _words(spark, sf_dir))


PAGES = "pages_ AS (SELECT p_partkey AS doc_id FROM part)"
GRID = "grid AS (SELECT doc_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CASE WHEN doc_id % 3 = 0 AND r = 0 AND c = 0 THEN 2 ELSE 1 END AS span FROM pages_, range(3) a(r), range(3) b(c) WHERE NOT (doc_id % 3 = 0 AND r = 0 AND c = 1))"
TEXTS = "texts AS (SELECT *, CASE WHEN doc_id % 5 <> 0 OR r + c = 0 OR r + c = 4 THEN 'r' || r || 'c' || c ELSE '' END AS text FROM grid)"

# ---------------------------------------------------------------- grids, cells, texts


@query("SELECT doc_id, r, c, span AS colspan, 1 AS rowspan, 50.0::DOUBLE + 100 * c AS x0, 50.0::DOUBLE + 100 * (c + span) AS x1 FROM grid", using=(PAGES, GRID))
def table_cells(spark, sf_dir):
    return layout.grid_cells(_rects(spark, sf_dir)).select("doc_id", "r", "c", "colspan", "rowspan", "x0", "x1")


@query("SELECT doc_id, '50.0,150.0,250.0,350.0' AS xs FROM pages_", using=(PAGES,))
def table_grid_lines(spark, sf_dir):
    return geometry.grid_lines(_rects(spark, sf_dir)).select("doc_id", F.array_join(F.transform("xs", lambda x: x.cast("string")), ",").alias("xs"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN NULL WHEN p_size < 20 THEN 0 WHEN p_size < 30 THEN 1 ELSE 2 END AS bin FROM part")
def interval_bins(spark, sf_dir):
    bounds = F.array(*[F.lit(float(x)) for x in (10, 20, 30, 40)])
    return t.table(spark, sf_dir, "part").select("p_partkey", geometry.bin_of(F.col("p_size").cast("double"), bounds).alias("bin"))


@query("SELECT doc_id, r, c, text, CASE WHEN text <> '' THEN 10.0::DOUBLE END AS font_size, CASE WHEN text <> '' THEN CASE WHEN (3 * r + c) % 2 = 0 THEN 'Song' ELSE 'Hei' END END AS font_name, 'left' AS align, CASE WHEN text = '' THEN 'top' ELSE 'center' END AS valign FROM texts", using=(PAGES, GRID, TEXTS))
def table_texts(spark, sf_dir):
    return _filled(spark, sf_dir).select("doc_id", "r", "c", "text", "font_size", "font_name", "align", "valign")


@query("SELECT doc_id, count(*) AS anchors, count(*) FILTER (WHERE text <> '') AS filled, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 3 END::BIGINT AS strong_rows, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 3 END::BIGINT AS strong_cols FROM texts GROUP BY doc_id", using=(PAGES, GRID, TEXTS))
def table_fill_counts(spark, sf_dir):
    return layout.fill_counts(_filled(spark, sf_dir)).select("doc_id", "anchors", "filled", "strong_rows", "strong_cols")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 6 END AS n, 70.0::DOUBLE AS middle FROM pages_ WHERE doc_id % 5 <> 0", using=(PAGES,))
def table_text_gaps(spark, sf_dir):
    return layout.text_gaps(_filled(spark, sf_dir)).select("doc_id", F.size("gaps").alias("n"), upper_median(F.col("gaps")).alias("middle"))


@query("SELECT doc_id, doc_id % 2 = 0 OR doc_id % 5 <> 0 AS accepted, doc_id % 5 <> 0 AS plausible FROM pages_", using=(PAGES,))
def tables_accepted(spark, sf_dir):
    rects, words = _rects(spark, sf_dir), _words(spark, sf_dir)
    forms = layout.plausible_forms(_filled(spark, sf_dir), layout.grids(rects), words)
    none = _rows(_pages(spark, sf_dir).where("false"), _BOX, (0.0, 0.0, 0.0, 0.0))
    drawn = layout.stroke_counts(_tables(spark, sf_dir), layout.strokes(_lines(spark, sf_dir), none, none))
    return layout.accepted(forms, drawn).join(forms, ["doc_id", "page_no", "table_id"]).select("doc_id", "accepted", "plausible")


@query("SELECT doc_id, 4 AS vertical, 4 AS horizontal, true AS grid FROM pages_ WHERE doc_id % 2 = 0", using=(PAGES,))
def table_strokes(spark, sf_dir):
    """Lines, the same as edges again, and rectangles so thin that they are lines."""
    pages, lines = _pages(spark, sf_dir), _lines(spark, sf_dir)
    thin = _rows(pages.where("doc_id % 2 = 0"), _BOX, (LEFT, TOP + 0.5, LEFT + 200, TOP + 1.5), (LEFT, TOP, LEFT + 200, TOP + 50))
    found = layout.stroke_counts(_tables(spark, sf_dir), layout.strokes(lines, lines, thin))
    return found.select("doc_id", "vertical", "horizontal", geometry.has_drawn_grid(F.col("vertical"), F.col("horizontal")).alias("grid"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2.0 ELSE 0.5 END::DOUBLE AS outer_, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS inner_, doc_id % 2 = 0 AS dashed FROM pages_", using=(PAGES,))
def table_line_widths(spark, sf_dir):
    found = layout.table_borders(_tables(spark, sf_dir), _lines(spark, sf_dir))
    return found.select("doc_id", F.col("outer").alias("outer_"), F.col("inner").alias("inner_"), "dashed")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 32 ELSE 36 END::BIGINT AS edges, CASE WHEN doc_id % 3 = 0 THEN 43 ELSE 48 END::DOUBLE AS width FROM pages_ WHERE doc_id % 2 = 0", using=(PAGES,))
def cell_edges(spark, sf_dir):
    found = geometry.cell_borders(_cells(spark, sf_dir), _lines(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.count("*").alias("edges"), F.sum("width").alias("width"))


@query("SELECT doc_id, r * 3 + c AS cell_id, CASE WHEN r = 1 THEN 'blue' ELSE 'red' END AS color FROM grid WHERE r = 1 OR (r = 0 AND c = 0)", using=(PAGES, GRID))
def cell_colours(spark, sf_dir):
    """A fill of one cell, a larger one of a row, one that covers too little, and the large one again."""
    row = (LEFT, TOP + TALL, LEFT + 3 * WIDE, TOP + 2 * TALL)
    fills = _rows(_pages(spark, sf_dir), f"fill_no int, {_BOX}, color string", (0, LEFT, TOP, LEFT + 2 * WIDE - 90, TOP + TALL, "red"), (1, *row, "blue"), (2, *row, "green"), (3, LEFT, TOP + 2 * TALL, LEFT + 40, TOP + 3 * TALL, "grey"))
    return geometry.cell_fills(_cells(spark, sf_dir), fills).select("doc_id", "cell_id", "color")


@query("SELECT doc_id, r, c, CASE WHEN r = 2 AND c = 0 THEN 2 ELSE span END AS colspan FROM grid WHERE NOT (r = 2 AND c = 1)", using=(PAGES, GRID))
def cells_merged(spark, sf_dir):
    """A word over two empty columns merges them; one over a column with text does not."""
    rects = _rects(spark, sf_dir)
    cells = layout.grid_cells(rects).withColumn("text", F.when((F.col("r") == 1) & (F.col("c") == 1), "x").when((F.col("r") == 1) & (F.col("c") == 0), "y").otherwise(""))
    words = _rows(_pages(spark, sf_dir), f"word_no long, {_BOX}", (0, LEFT + 20, TOP + 44, LEFT + 180, TOP + 54), (1, LEFT + 20, TOP + 24, LEFT + 180, TOP + 34))
    return layout.merged_under_words(cells, words, layout.grids(rects)).select("doc_id", "r", "c", "colspan")


# ---------------------------------------------------------------- rules, images, tables found


@query("SELECT doc_id, top::DOUBLE AS top FROM pages_, (VALUES (50), (200)) v(top)", using=(PAGES,))
def rules_between_tables(spark, sf_dir):
    rules = _rows(_pages(spark, sf_dir), "top double, x0 double, x1 double, thickness double", (50.0, 60.0, 300.0, 1.0), (110.0, 60.0, 300.0, 1.0), (200.0, 60.0, 300.0, 1.0), (160.5, 60.0, 300.0, 0.5))
    return layout.rules_outside(rules, _tables(spark, sf_dir)).select("doc_id", "top")


@query("SELECT doc_id, rule_no::BIGINT AS rule_no FROM pages_, (VALUES (0), (3), (4)) v(rule_no)", using=(PAGES,))
def rules_kept(spark, sf_dir):
    rules = _rows(_pages(spark, sf_dir), "rule_no long, top double, x0 double, x1 double", (0, 50.0, 60.0, 300.0), (1, 51.0, 61.0, 301.0), (2, 51.4, 59.0, 299.0), (3, 51.2, 160.0, 300.0), (4, 52.0, 60.0, 300.0))
    return geometry.kept_rules(rules).select("doc_id", "rule_no")


@query("SELECT doc_id, strategy, find_no FROM pages_, (VALUES (0, 0), (1, 1), (2, 0)) v(strategy, find_no)", using=(PAGES,))
def tables_kept(spark, sf_dir):
    """What overlaps a kept one, is tiny or comes after half of the page is covered goes."""
    found = _rows(_pages(spark, sf_dir), f"strategy int, find_no int, {_BOX}", (0, 0, 0.0, 0.0, 100.0, 100.0), (1, 0, 10.0, 10.0, 90.0, 90.0), (1, 1, 0.0, 200.0, 100.0, 250.0), (1, 2, 300.0, 0.0, 310.0, 100.0), (2, 0, 0.0, 300.0, 200.0, 500.0), (3, 0, 300.0, 300.0, 400.0, 400.0))
    return geometry.kept_tables(found, 80_000.0).select("doc_id", "strategy", "find_no")


@query("SELECT doc_id, image_no, place::BIGINT AS place FROM pages_, (VALUES (5, 1), (2, 2), (0, 3)) v(image_no, place)", using=(PAGES,))
def images_placed(spark, sf_dir):
    """Outside tables, neither tiny nor the page itself, by top and left edge."""
    found = _rows(_pages(spark, sf_dir), f"image_no int, {_BOX}", (0, 300.0, 400.0, 400.0, 500.0), (1, 60.0, 105.0, 200.0, 155.0), (2, 100.0, 400.0, 200.0, 500.0), (3, 10.0, 10.0, 40.0, 40.0), (4, 0.0, 0.0, 595.0, 842.0), (5, 60.0, 20.0, 160.0, 90.0))
    return layout.page_images(found, _tables(spark, sf_dir), 595.0 * 842.0).select("doc_id", "image_no", "place")


@query("SELECT p_partkey, p_size >= 24 AS sharp FROM part WHERE p_size > 0")
def images_sharp(spark, sf_dir):
    s = F.col("p_size")
    return t.table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", layout.sharp_enough(s * 5, s * 5, F.lit(100.0), F.lit(100.0)).alias("sharp"))


# ---------------------------------------------------------------- blocks


def _blocks(spark, sf_dir) -> list[DataFrame]:
    pages = _pages(spark, sf_dir)
    fields = "block_no int, kind string, top double, bottom double"
    return [_rows(pages, fields, (0, "text", 10.0, 20.0), (1, "text", 100.0, 110.0), (2, "text", 103.0, 112.0)), _rows(pages.where("doc_id % 2 = 0"), fields, (3, "table", 100.0, 160.0)), _rows(pages, fields, (4, "image", 5.0, 8.0))]


@query("SELECT doc_id, block_no, row_number() OVER (PARTITION BY doc_id ORDER BY top, kind_no, block_no) AS place FROM (SELECT doc_id, block_no, top, kind_no FROM pages_, (VALUES (0, 10, 0), (1, 100, 0), (2, 103, 0), (3, 100, 1), (4, 5, 2)) v(block_no, top, kind_no) WHERE doc_id % 2 = 0 OR block_no <> 3)", using=(PAGES,))
def blocks_in_order(spark, sf_dir):
    return geometry.interleaved(*_blocks(spark, sf_dir)).select("doc_id", "block_no", "place")


@query("SELECT doc_id, 1::BIGINT AS pages, 3::BIGINT AS texts, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS tables, 1::BIGINT AS images, 0::BIGINT AS lines FROM pages_", using=(PAGES,))
def blocks_counted(spark, sf_dir):
    whole = geometry.interleaved(*_blocks(spark, sf_dir))
    return geometry.count_blocks(whole).select("doc_id", "pages", "texts", "tables", "images", "lines")


@query("SELECT doc_id, block_no::INT AS block_no, CASE block_no WHEN 0 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END ELSE 1 END AS row_no FROM pages_, range(5) v(block_no) WHERE doc_id % 2 = 0 OR block_no <> 3", using=(PAGES,))
def blocks_side_by_side(spark, sf_dir):
    far = geometry.interleaved(*_blocks(spark, sf_dir)).withColumn("top", F.when(F.col("kind") == "image", 500.0).otherwise(F.col("top"))).withColumn("bottom", F.when(F.col("kind") == "image", 520.0).otherwise(F.col("bottom")))
    return geometry.visual_rows(far.select("doc_id", "page_no", "block_no", "kind", "top", "bottom")).select("doc_id", "block_no", "row_no")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'image_only,ocr_applied' WHEN 2 THEN 'ocr_applied' ELSE '' END AS warnings FROM pages_", using=(PAGES,))
def document_warnings(spark, sf_dir):
    k = F.col("doc_id") % 4
    counts = _pages(spark, sf_dir).select("doc_id", F.when(k == 0, 0).otherwise(2).alias("pages"), F.lit(0).alias("tables"), F.when(k >= 2, 3).otherwise(0).alias("texts"), F.when(k == 1, 1).otherwise(0).alias("images"), k.isin(1, 2).alias("ocr"))
    return layout.content_warnings(counts).select("doc_id", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT o_custkey AS batch, count(*) AS files, CAST(sum(o_orderkey) AS BIGINT) AS bytes, array_to_string(list_sort(list(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END)), ',') AS warnings, array_to_string(list_sort(list(DISTINCT 'e' || (o_orderkey % 3))), ',') AS engines FROM orders GROUP BY o_custkey")
def batches_totalled(spark, sf_dir):
    k = F.col("o_orderkey")
    parts = t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), k.alias("size_bytes"), F.lit(1).alias("pages"), F.lit(0).alias("tables"), F.lit(0).alias("images"), F.lit(0).alias("lines"), F.array(F.when(k % 2 == 0, "a").otherwise("b")).alias("warnings"), F.concat(F.lit("e"), k % 3).alias("engine"))
    return layout.batch_totals(parts).select(F.col("batch_id").alias("batch"), "files", F.col("size_bytes").alias("bytes"), F.array_join("warnings", ",").alias("warnings"), "engines")


@query("SELECT doc_id, 'up' || doc_id AS upper_, CASE WHEN doc_id % 2 = 0 THEN 'down' END AS lower_ FROM pages_", using=(PAGES,))
def sheets_paired(spark, sf_dir):
    rows = _rows(_pages(spark, sf_dir), "position int, path string", (0, "up"), (1, "down")).where("position = 0 OR doc_id % 2 = 0")
    rows = rows.select(F.col("doc_id").alias("pair_id"), "position", F.when(F.col("position") == 0, F.concat("path", F.col("doc_id").cast("string"))).otherwise(F.col("path")).alias("path"))
    return layout.paired_pages(rows).select(F.col("pair_id").alias("doc_id"), F.col("upper").alias("upper_"), F.col("lower").alias("lower_"))


@query("SELECT doc_id, line_num, text, x0::DOUBLE AS x0, x1::DOUBLE AS x1, size::DOUBLE AS font_size FROM pages_, (VALUES (0, 'one two', 20, 120, 15.0), (1, '汉字x', 20, 80, 8.0)) v(line_num, text, x0, x1, size)", using=(PAGES,))
def recognised_lines(spark, sf_dir):
    """Lines of recognised words: weak, blank and flat ones go, Chinese characters close up."""
    fields = "block_num int, par_num int, line_num int, text string, conf double, left double, top double, width double, height double"
    found = _rows(_pages(spark, sf_dir), fields, (0, 0, 0, " two", 90.0, 35.0, 10.0, 25.0, 10.0), (0, 0, 0, "one", 35.0, 10.0, 10.0, 20.0, 10.0), (0, 0, 0, "weak", 20.0, 90.0, 10.0, 20.0, 10.0), (0, 0, 1, "汉", 80.0, 10.0, 40.0, 10.0, 5.0), (0, 0, 1, "字x", 80.0, 20.0, 40.0, 20.0, 5.0), (0, 0, 1, " ", 99.0, 50.0, 40.0, 10.0, 5.0), (0, 0, 1, "flat", 99.0, 70.0, 40.0, 10.0, 0.0))
    return layout.ocr_lines(found, 595.0, scale_x=2.0, scale_y=2.0).select("doc_id", "line_num", "text", "x0", "x1", "font_size")
