"""Tables, rules, images and documents' totals on hand-built pages."""

from pyspark.sql import functions as F

from tessella.operators import layout

RECT = "doc_id long, page_no int, table_id int, rect_no int, x0 double, top double, x1 double, bottom double"
WORD = "doc_id long, page_no int, word_no long, text string, x0 double, x1 double, top double, bottom double, size double, fontname string"


def grid(spark, cols, rows, skip=()):
    out = [(1, 0, 0, r * len(cols) + c, float(cols[c]), float(rows[r]), float(cols[c + 1]), float(rows[r + 1])) for r in range(len(rows) - 1) for c in range(len(cols) - 1) if (r, c) not in skip]
    return out


def words(spark, items):
    return spark.createDataFrame([(1, 0, k, t, float(a), float(b), float(y), float(y) + 10, 10.0, "F") for k, (t, a, b, y) in enumerate(items)], WORD)


def test_grid_with_spans(spark):
    rows = grid(spark, [0, 50, 100, 150], [0, 20, 40, 60], skip={(0, 0), (1, 0)}) + [(1, 0, 0, 99, 0.0, 0.0, 50.0, 40.0)]
    cells = {(c.r, c.c): (c.rowspan, c.colspan) for c in layout.grid_cells(spark.createDataFrame(rows, RECT)).collect()}
    assert cells[0, 0] == (2, 1) and cells[2, 0] == (1, 1) and len(cells) == 8


def form(spark):
    rects = spark.createDataFrame(grid(spark, [0, 150, 300], [0, 20, 40, 60]), RECT)
    items = [("Name", 2, 30, 4), ("Ada", 200, 230, 4), ("Street", 2, 40, 24), ("Long", 200, 230, 24), ("Lane", 233, 260, 24), ("City", 2, 30, 44), ("Rome", 200, 230, 44)]
    return rects, words(spark, items)


def test_cell_texts_and_forms(spark):
    rects, w = form(spark)
    cells = layout.cell_texts(layout.grid_cells(rects), w).cache()
    got = {(c.r, c.c): (c.text, c.align) for c in cells.collect()}
    assert got[1, 1] == ("Long Lane", "center") and got[0, 0] == ("Name", "left")
    gaps = layout.text_gaps(cells).first().gaps
    assert sorted(gaps) == [160.0, 170.0, 170.0]
    ok = layout.plausible_forms(cells, layout.grids(rects), w)
    assert ok.first().plausible
    drawn = spark.createDataFrame([(1, 0, 0, 0, 0)], "doc_id long, page_no int, table_id int, vertical int, horizontal int")
    assert layout.accepted(ok, drawn).first().accepted
    prose = words(spark, [(f"w{k}", 30 * (k % 10), 30 * (k % 10) + 28, 20 * (k // 10) + 4) for k in range(30)])
    cells = layout.cell_texts(layout.grid_cells(rects), prose)
    assert not layout.plausible_forms(cells, layout.grids(rects), prose).first().plausible


def test_wide_word_merges_cells(spark):
    rects = spark.createDataFrame(grid(spark, [0, 100, 200, 300], [0, 20, 40]), RECT)
    w = words(spark, [("heading", 5, 280, 4), ("a", 10, 20, 24), ("b", 110, 120, 24)])
    cells = layout.cell_texts(layout.grid_cells(rects), w.where("word_no > 0"))
    merged = {(c.r, c.c): c.colspan for c in layout.merged_under_words(cells, w, layout.grids(rects)).collect()}
    assert merged == {(0, 0): 3, (1, 0): 1, (1, 1): 1, (1, 2): 1}


def test_strokes_and_borders(spark):
    box = "doc_id long, page_no int, x0 double, top double, x1 double, bottom double"
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 0.0), (1, 0, 0.0, 50.0, 100.0, 50.0), (1, 0, 0.0, 0.5, 100.0, 0.5)], box)
    rects = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.5, 50.0), (1, 0, 20.0, 0.0, 60.0, 50.0)], box)
    drawn = layout.strokes(lines, lines.where("false"), rects)
    boxes = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 100.0, 50.0)], "doc_id long, page_no int, table_id int, x0 double, top double, x1 double, bottom double")
    assert tuple(layout.stroke_counts(boxes, drawn).first())[-2:] == (1, 2)
    ruled = lines.withColumns({"linewidth": F.lit(2.0), "dashed": F.col("top") > 10})
    assert tuple(layout.table_borders(boxes, ruled).first())[-3:] == (2.0, 2.0, True)
    assert tuple(layout.table_borders(boxes, ruled.where("false")).first())[-3:] == (0.5, 0.5, False)
    rules = spark.createDataFrame([(1, 0, 25.0, 10.0, 90.0, 1.0), (1, 0, 80.0, 10.0, 90.0, 1.0)], "doc_id long, page_no int, top double, x0 double, x1 double, thickness double")
    assert [r.top for r in layout.rules_outside(rules, boxes).collect()] == [80.0]
    images = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 50.0, 50.0), (1, 0, 1, 200.0, 90.0, 260.0, 150.0), (1, 0, 2, 200.0, 60.0, 210.0, 70.0), (1, 0, 3, 150.0, 89.98, 195.0, 150.0)], "doc_id long, page_no int, image_no int, x0 double, top double, x1 double, bottom double")
    assert [r.image_no for r in layout.page_images(images, boxes, 100_000.0).orderBy("place").collect()] == [3, 1]


def test_documents(spark):
    counts = spark.createDataFrame([(1, 0, 0, 0, 0, True), (2, 1, 0, 0, 3, False), (3, 1, 1, 0, 0, True)], "doc_id long, pages int, tables int, texts int, images int, ocr boolean")
    assert {r.doc_id: r.warnings for r in layout.content_warnings(counts).collect()} == {1: ["empty"], 2: ["image_only"], 3: ["ocr_applied"]}
    parts = spark.createDataFrame([("b", 5, 1, 0, 0, 2, ["x"], "e2"), ("b", 6, 1, 1, 0, 1, ["a", "x"], "e1")], "batch_id string, size_bytes long, pages int, tables int, images int, lines int, warnings array<string>, engine string")
    assert tuple(layout.batch_totals(parts).first()) == ("b", 2, 11, 2, 1, 0, 3, ["a", "x"], "e1,e2")
    pages = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "pair_id int, position int, path string")
    assert {r.pair_id: (r.upper, r.lower) for r in layout.paired_pages(pages).collect()} == {1: ("a", "b"), 2: ("c", None)}
    ocr = spark.createDataFrame([(1, 0, 1, 1, 1, "你", 90.0, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 1, 1, "好", 90.0, 12.0, 0.0, 10.0, 10.0), (1, 0, 1, 1, 1, "ok", 20.0, 30.0, 0.0, 10.0, 10.0), (1, 0, 1, 1, 2, "a", 90.0, 0.0, 20.0, 10.0, 20.0), (1, 0, 1, 1, 2, "b", 90.0, 20.0, 20.0, 10.0, 20.0)], "doc_id long, page_no int, block_num int, par_num int, line_num int, text string, conf double, left double, top double, width double, height double")
    assert [(r.text, r.font_size) for r in layout.ocr_lines(ocr, 600.0).orderBy("line_num").collect()] == [("你好", 8.0), ("a b", 15.0)]
