"""Queries on what is drawn from the tables: order sheets as strokes, texts as words on pages, vectors as images.

Each order is a page.  Its first table has a row for each of its line items, as
high as the quantity says, and as many columns, as wide, as the customer's
number says; in one order of five the first two cells of the first row are one.
Every second order has another table of two columns further down.  Lines are
drawn in pieces that do not quite touch and do not quite agree on their place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import media, pdf
from tessella.functions.let import let
from tessella.operators import aligned, cellruns, pixels, strokes
from tessella.plans import tables as t
from tessella.plans.registry import query
from tessella.sources import docx


def order_rows(spark, sf_dir) -> DataFrame:
    """A row for each line of each table: page, table, row, its height and place, columns."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    items = t.dealt(t.table(spark, sf_dir, "lineitem"), "l_orderkey", 50_000).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", (12 + F.floor("l_quantity") % 9).cast("long").alias("high"))
    items = items.withColumn("r", F.row_number().over(by) - 1).withColumn("low", F.sum("high").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("high").over(Window.partitionBy("l_orderkey")))
    items = items.withColumn("rows", F.count("*").over(Window.partitionBy("l_orderkey")))
    both = items.join(t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = lambda no, y, columns, first: F.struct(F.lit(no).alias("t"), y.cast("long").alias("y"), columns.cast("long").alias("columns"), first.cast("long").alias("first"))
    one, two = kind(0, F.lit(100), 2 + F.col("o_custkey") % 3, F.col("o_custkey")), kind(1, 130 + F.col("all"), F.lit(2), F.lit(2))
    out = both.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), "r", "rows", "high", "low", F.explode(F.when(F.col("l_orderkey") % 2 == 0, F.array(one, two)).otherwise(F.array(one))).alias("k"))
    return out.select("doc_id", "page_no", "r", "rows", "k.*", (F.col("k.y") + F.col("low") - F.col("high")).alias("top"), (F.col("k.y") + F.col("low")).alias("bottom"))


def _drawn(r: np.ndarray, rows: np.ndarray, t: np.ndarray, columns: np.ndarray, first: np.ndarray, merged: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The strokes of rows of tables: whose they are, and x0, x1, top and bottom.

    Column widths are chosen by ``first``; the second table lies further right.
    Each column has an upright stroke at its left and a level one above, and
    below the last row; the upright one within merged cells is left out.
    """
    own = np.repeat(np.arange(len(r)), columns + 1)
    c = np.arange(len(own)) - np.repeat(np.cumsum(columns + 1) - columns - 1, columns + 1)
    wide = 40 + 10 * np.fmod(first[own] + c, 4)
    before = np.cumsum(wide) - wide
    x = (50 + 400 * t[own] + before - before[np.cumsum(columns + 1) - columns - 1][own]).astype(float)
    end = x + wide - np.where(c + 1 < columns[own], 2, 0)
    lean, down = x + 0.25 * ((r[own] + c) % 2), 0.5 * (c % 2)
    inner = c < columns[own]
    upright, under = ~(merged[own] & (c == 1)), inner & (r == rows - 1)[own]

    def level(which: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        place = y[own[which]] + down[which]
        return own[which], x[which], end[which], place, place + 1

    parts = ((own[upright], lean[upright], lean[upright], top[own[upright]], bottom[own[upright]]), level(inner, top), level(under, bottom))
    whose, *box = (np.concatenate(p) for p in zip(*parts, strict=True))
    return whose, box


def order_cells(spark, sf_dir) -> DataFrame:
    """The cells of the tables that the strokes of order sheets draw; a row without a height draws what can be placed."""
    place = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    merged = ((F.col("doc_id") % 5 == 0) & (F.col("t") == 0) & (F.col("r") == 0)).alias("merged")
    rows = order_rows(spark, sf_dir).where("columns IS NOT NULL").select("doc_id", "page_no", "r", "rows", "t", "columns", "first", merged, place("top"), place("bottom"))
    return strokes.table_cells(rows, reads=("r", "rows", "t", "columns", "first", "merged", "top", "bottom"), draws=_drawn)


DRAWN = """items AS (SELECT l_orderkey, o_custkey, row_number() OVER w - 1 AS r, 12 + CAST(floor(l_quantity) AS BIGINT) % 9 AS high, sum(12 + CAST(floor(l_quantity) AS BIGINT) % 9) OVER w AS low,
    sum(12 + CAST(floor(l_quantity) AS BIGINT) % 9) OVER (PARTITION BY l_orderkey) AS total, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)),
sheets AS (SELECT l_orderkey AS doc_id, 0 AS t, r, n, 100 + low - high AS top, 100 + low AS bottom, 2 + o_custkey % 3 AS k, o_custkey AS f FROM items
  UNION ALL SELECT l_orderkey, 1, r, n, 130 + total + low - high, 130 + total + low, 2, 2 FROM items WHERE l_orderkey % 2 = 0),
lefts AS (SELECT DISTINCT doc_id, t, k, n, c, 50 + 400 * t + coalesce(list_sum(list_transform(range(0, c), lambda i: 40 + 10 * ((f + i) % 4))), 0) AS x FROM sheets, range(0, 5) AS q(c) WHERE c <= k),
uprights AS (SELECT doc_id, t, c, any_value(x) + avg(0.25 * ((r + c) % 2)) AS x FROM lefts, range(0, (SELECT max(n) FROM sheets)) AS q(r) WHERE r < n AND NOT (doc_id % 5 = 0 AND t = 0 AND r = 0 AND c = 1) GROUP BY doc_id, t, c),
shift AS (SELECT doc_id, t, k, 0.5 + 0.5 * (k // 2) / k AS dy FROM sheets GROUP BY ALL),
boxes AS (SELECT s.doc_id, s.t, s.r, s.top + dy AS top, s.bottom + dy AS bottom, a.c, a.x AS x0, b.x AS x1
  FROM sheets s JOIN shift USING (doc_id, t) JOIN uprights a ON a.doc_id = s.doc_id AND a.t = s.t AND NOT (s.doc_id % 5 = 0 AND s.t = 0 AND s.r = 0 AND a.c = 1)
  JOIN uprights b ON b.doc_id = s.doc_id AND b.t = s.t AND b.c = a.c + CASE WHEN s.doc_id % 5 = 0 AND s.t = 0 AND s.r = 0 AND a.c = 0 THEN 2 ELSE 1 END),
drawn AS (SELECT * FROM boxes QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY t) - 1 AS table_no FROM drawn)"""


@query("SELECT doc_id, CAST(table_no AS INT) AS table_no, round(x0, 4) AS x0, round(top, 4) AS top, round(x1, 4) AS x1, round(bottom, 4) AS bottom FROM numbered", using=(DRAWN,))
def stroke_cells(spark, sf_dir):
    """Every cell of every table that the strokes of order sheets draw."""
    found = order_cells(spark, sf_dir)
    return found.select("doc_id", "table_no", *[F.round(c, 4).alias(c) for c in ("x0", "top", "x1", "bottom")])


@query("SELECT doc_id, CAST(table_no AS INT) AS table_no, round(min(x0), 4) AS x0, round(min(top), 4) AS top, round(max(x1), 4) AS x1, round(max(bottom), 4) AS bottom, count(*) AS cells FROM numbered GROUP BY doc_id, table_no", using=(DRAWN,))
def stroke_tables(spark, sf_dir):
    """The box and the number of cells of every table of order sheets."""
    found = strokes.table_boxes(order_cells(spark, sf_dir))
    return found.select("doc_id", "table_no", *[F.round(c, 4).alias(c) for c in ("x0", "top", "x1", "bottom")], "cells")


def set_words(spark, sf_dir) -> DataFrame:
    """Texts set in lines of ten words, a page each; of every third the first twelve words stand in four rows and three columns above."""
    split = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = t.dealt(t.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 2_000).select("doc_id", F.posexplode(split).alias("pos", "text"))
    wide = (5 * F.least(F.length("text"), F.lit(20))).cast("double")
    d = d.withColumn("wide", wide).withColumn("grid", (F.col("doc_id") % 3 == 0) & (F.col("pos") < 12))
    line = F.floor(F.col("pos") / 10)
    before = F.coalesce(F.sum(F.col("wide") + 3).over(Window.partitionBy("doc_id", "grid", line).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x0 = F.when(F.col("grid"), 60.0 + 150 * (F.col("pos") % 3)).otherwise(50 + before)
    top = F.when(F.col("grid"), 40.0 + 18 * F.floor(F.col("pos") / 3)).otherwise(150.0 + 14 * line)
    placed = d.withColumn("x0", x0).withColumn("top", top.cast("double"))
    return placed.select("doc_id", F.lit(0).alias("page_no"), F.col("pos").cast("long").alias("word_no"), "text", "x0", (F.col("x0") + F.col("wide")).alias("x1"), "top", (F.col("top") + 10).alias("bottom"))


@query(r"""SELECT doc_id, 0 AS table_no, CAST(i // 3 AS INT) AS r, CAST(i % 3 AS INT) AS c, w[i + 1] AS text, CAST(60 + 150 * (i % 3) AS DOUBLE) AS x0, CAST(40 + 18 * (i // 3) AS DOUBLE) AS top
FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id % 3 = 0), range(0, 12) AS q(i)
WHERE i < len(w) AND len(w) >= 8 AND NOT (i % 3 = 0 AND i = len(w) - 1)""")
def word_tables(spark, sf_dir):
    """Cells of the tables that the places of words show; prose has none, and a word alone on a line is in none."""
    return aligned.table_cells(set_words(spark, sf_dir)).select("doc_id", "table_no", "r", "c", "text", "x0", "top")


#: So many characters are looked at first, up to the last space; a text that has too few plain words among them is looked at whole.
FIRST = 256


def _plain_words() -> Column:
    """The first six words of a text that have one to eight letters, without what is no letter."""
    text, space = F.coalesce("text", F.lit("")), r"\x20\x09-\x0D"
    plain = lambda part: F.slice(F.filter(F.split(F.regexp_replace(part, f"[^A-Za-z{space}]+", ""), f"[{space}]+"), lambda w: F.length(w).between(1, 8)), 1, 6)
    first = plain(F.regexp_replace(F.substring(text, 1, FIRST), f"[^{space}]*\\z", ""))
    return let(first, lambda found: F.when(F.size(found) == 6, found).otherwise(plain(text)))


def set_cells(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Six words of each text in a cell, three to a line, in two fonts; in every second the first line reaches the cell's edge."""
    documents = t.table(spark, sf_dir, "documents")
    d = documents.select("doc_id", F.lit(0).alias("page_no"), _plain_words().alias("w")).where("size(w) = 6").repartition(t.joinable(spark, documents, 2_000), "doc_id")
    tight = F.col("doc_id") % 2 == 0
    cells = d.select("doc_id", "page_no", F.lit(0).alias("cell_id"), F.lit(40.0).alias("x0"), F.lit(20.0).alias("top"), F.when(tight, 250.0).otherwise(400.0).alias("x1"), F.lit(80.0).alias("bottom"))
    at = d.select("doc_id", "page_no", F.posexplode("w").alias("pos", "text"))
    x0 = 50.0 + 60 * (F.col("pos") % 3)
    x1 = F.when(tight & (F.col("pos") == 2), 248.0).otherwise(x0 + 5 * F.length("text"))
    top = 30.0 + 12 * F.floor(F.col("pos") / 3)
    words = at.select("doc_id", "page_no", F.col("pos").cast("long").alias("word_no"), "text", x0.alias("x0"), x1.alias("x1"), top.cast("double").alias("top"), (top + 10).cast("double").alias("bottom"), F.lit(10.0).alias("size"), F.when(F.col("pos").isin(0, 5), "Song").otherwise("Hei").alias("fontname"))
    return cells, words


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Song:' || w[1] || '|Hei:' || array_to_string(w[2:5], ' ') || '|Song:' || w[6]
ELSE 'Song:' || w[1] || '|Hei:' || w[2] || ' ' || w[3] || '/Hei:' || w[4] || ' ' || w[5] || '|Song:' || w[6] END AS runs
FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: regexp_replace(x, '[^A-Za-z]', '', 'g')), lambda x: length(x) BETWEEN 1 AND 8)[1:6] AS w FROM documents) WHERE len(w) = 6""")
def cell_runs(spark, sf_dir):
    """Cells as paragraphs of runs, wrapped lines joined."""
    found = cellruns.cell_paragraphs(*set_cells(spark, sf_dir))
    said = F.transform("paragraphs", lambda p: F.array_join(F.transform(p, lambda r: F.concat(r["font_name"], F.lit(":"), r["text"])), "|"))
    return found.select("doc_id", F.array_join(said, "/").alias("runs"))


@query(r"""SELECT doc_id, 'Song/20:' || w[1] || CASE WHEN doc_id % 2 = 0 THEN '|Hei/20:' || array_to_string(w[2:5], ' ') ELSE '|Hei/20:' || w[2] || ' ' || w[3] || chr(10) || 'Hei/20:' || w[4] || ' ' || w[5] END || '|Song/20:' || w[6]
|| ' [top,' || 8 * (1 + doc_id % 3) || ',auto,single right,' || 4 * greatest(length(w[1]), length(w[2])) || CASE WHEN length(w[1]) >= length(w[2]) THEN ',auto,single' ELSE ',FF0000,dashed' END || ']' AS first,
'Hei/24:' || w[2] || ' [left,' || 4 * greatest(length(w[1]), length(w[2])) || CASE WHEN length(w[1]) >= length(w[2]) THEN ',auto,single' ELSE ',FF0000,dashed' END || ']' AS second
FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: regexp_replace(x, '[^A-Za-z]', '', 'g')), lambda x: length(x) BETWEEN 1 AND 8)[1:6] AS w FROM documents) WHERE len(w) = 6""")
def docx_rich_cells(spark, sf_dir):
    """Word tables read back: runs in cells, and the wider of two lines at the edge that two cells share."""
    cells, words = set_cells(spark, sf_dir)
    runs = cellruns.cell_paragraphs(cells, words).select("doc_id", "paragraphs")
    texts = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word_no", "text"))).alias("w"))
    word = lambda k: F.get("w", F.lit(k))["text"]
    edge = lambda width, color, dashed: F.struct(width.cast("double").alias("width"), F.lit(color).cast("string").alias("color"), F.lit(dashed).alias("dashed"))
    side = lambda **e: F.struct(*[e[s].alias(s) if s in e else F.lit(None).cast(docx.EDGE).alias(s) for s in docx.SIDES])
    base = lambda c, **more: F.struct(F.lit(0).alias("r"), F.lit(c).alias("c"), *[v.alias(n) for n, v in more.items()])
    none = F.lit(None)
    first = base(0, text=none.cast("string"), font_size=none.cast("double"), font_name=none.cast("string"), paragraphs=F.col("paragraphs"), borders=side(top=edge(1 + F.col("doc_id") % 3, None, False), right=edge(F.length(word(0)) / 2, None, False)))
    second = base(1, text=word(1), font_size=F.lit(12.0), font_name=F.lit("Hei"), paragraphs=none.cast(runs.schema["paragraphs"].dataType), borders=side(left=edge(F.length(word(1)) / 2, "FF0000", True)))
    blocks = runs.join(texts.hint("merge"), "doc_id").select("doc_id", F.lit(0).alias("page_no"), F.lit(0).alias("row_no"), F.lit(0).alias("block_no"), F.lit("table").alias("kind"), F.array(first, second).alias("cells"))
    read = docx.written(blocks).select("doc_id", docx.cells_read("content").alias("c"))
    return read.select("doc_id", F.get("c", F.lit(0)).alias("first"), F.get("c", F.lit(1)).alias("second"))


def vector_images(spark, sf_dir, *, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pixels and sizes of vectors as images of eight by eight, or 16 by 4; some pixels are half or fully transparent."""
    vectors = t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    vectors = vectors.repartition(t.joinable(spark, vectors), "vec_id") if dealt else vectors
    v = vectors.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("k", "value"))
    wide = F.when(F.col("image_id") % 2 == 0, 8).otherwise(16)
    byte = F.least(F.greatest(F.floor(F.col("value").cast("double") * 256) + 128, F.lit(0)), F.lit(255)).cast("int")
    alpha = F.when(F.col("image_id") % 5 > 0, 255).otherwise(F.when(byte % 4 == 0, 0).otherwise(byte)).cast("int")
    px = v.select("image_id", (F.col("k") % wide).cast("int").alias("x"), F.floor(F.col("k") / wide).cast("int").alias("y"), byte.alias("r"), ((byte * 3) % 256).alias("g"), (255 - byte).alias("b"), alpha.alias("a"))
    sizes = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.when(F.col("vec_id") % 2 == 0, 8).otherwise(16).alias("width"), F.when(F.col("vec_id") % 2 == 0, 8).otherwise(4).alias("height"), (F.col("vec_id") % 10).cast("int").alias("orientation"))
    return px, sizes


IMAGES = """values_ AS (SELECT vec_id AS image_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS k, CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 16 END AS wide FROM embeddings),
bytes AS (SELECT *, CAST(least(greatest(floor(v::DOUBLE * 256) + 128, 0), 255) AS INT) AS r FROM values_),
px AS (SELECT image_id, k % wide AS x, k // wide AS y, wide, 64 // wide AS tall, r, r * 3 % 256 AS g, 255 - r AS b, CASE WHEN image_id % 5 > 0 THEN 255 WHEN r % 4 = 0 THEN 0 ELSE r END AS a FROM bytes)"""


def exif_files(spark, sf_dir) -> DataFrame:
    """Vectors as EXIF data: as many entries before the orientation as the number says, in either byte order, alone, in JPEG or in PNG."""
    v, little = F.col("vec_id"), F.col("vec_id") % 2 == 0

    def number(value: Column, size: int) -> Column:
        digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
        return F.when(little, F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])).otherwise(digits)

    def entry(tag: Column, value: Column) -> Column:
        return F.concat(number(tag, 2), number(F.lit(3), 2), number(F.lit(1), 4), number(value, 2), F.lit("0000"))

    gap, fillers = v % 3, v % 4
    filler = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), fillers), lambda k: F.when(k < fillers, entry(256 + k, F.lit(6))).otherwise("")), "")
    directory = F.concat(number(fillers + 1, 2), filler, F.when(v % 11 == 0, entry(F.lit(0x0113), F.lit(5))).otherwise(entry(F.lit(0x0112), v % 10)), F.lit("00000000"))
    order = F.when(little, "49492A00").otherwise("4D4D002A")
    exif = F.concat(order, number(8 + gap, 4), F.repeat(F.lit("AA"), gap.cast("int")), directory)
    wrapped = F.when(v % 5 == 1, F.concat(F.lit("FFD8FFE1FFFF"), F.hex(F.lit("Exif")), F.lit("0000"), exif, F.lit("FFD9"))).when(v % 5 == 2, F.concat(F.lit("89504E470D0A1A0A00000040"), F.hex(F.lit("eXIf")), exif)).when(v % 5 == 3, F.substring(exif, 1, 24)).otherwise(exif)
    return t.table(spark, sf_dir, "embeddings").select("vec_id", F.unhex(wrapped).alias("data"))


@query("SELECT vec_id, CAST(CASE WHEN vec_id % 5 = 3 OR vec_id % 11 = 0 OR vec_id % 10 NOT BETWEEN 1 AND 8 THEN 1 ELSE vec_id % 10 END AS INT) AS orientation FROM embeddings")
def exif_orientations(spark, sf_dir):
    """One file in five is cut off before the tag's value."""
    return exif_files(spark, sf_dir).select("vec_id", media.exif_orientation(F.col("data")).alias("orientation"))


@query("""SELECT image_id, CAST(CASE WHEN o IN (2, 3) THEN wide - 1 - x WHEN o IN (5, 8) THEN y WHEN o IN (6, 7) THEN tall - 1 - y ELSE x END AS INT) AS x,
CAST(CASE WHEN o IN (3, 4) THEN tall - 1 - y WHEN o IN (5, 6) THEN x WHEN o IN (7, 8) THEN wide - 1 - x ELSE y END AS INT) AS y, r, a FROM (SELECT *, image_id % 10 AS o FROM px)""", using=(IMAGES,))
def images_turned(spark, sf_dir):
    """Vectors as images, shown as their orientation says."""
    px, sizes = vector_images(spark, sf_dir)
    return pixels.turned(px, sizes).select("image_id", "x", "y", "r", "a")


@query(
    """SELECT image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(CASE WHEN a IN (0, 255) THEN r ELSE least(255 * r // greatest(a, 1), 255) END AS INT) AS r, CAST(CASE WHEN a IN (0, 255) THEN g ELSE least(255 * g // greatest(a, 1), 255) END AS INT) AS g,
    CAST(CASE WHEN a IN (0, 255) THEN b ELSE least(255 * b // greatest(a, 1), 255) END AS INT) AS b, CAST(a AS INT) AS a FROM lowered""",
    using=(
        IMAGES,
        "pairs AS (SELECT * FROM (VALUES (8, 5), (16, 5), (4, 1)) AS p(o, n))",
        """taps AS (SELECT o, n, t, i, (i - (t + 0.5) * o / n + 0.5) / (o / n::DOUBLE) AS d FROM pairs, range(0, 5) AS q(t), range(0, 16) AS q2(i)
        WHERE t < n AND i < o AND i >= floor((t + 0.5) * o / n - 3.0 * o / n + 0.5) AND i < floor((t + 0.5) * o / n + 3.0 * o / n + 0.5))""",
        "raw AS (SELECT *, CASE WHEN abs(d) >= 3 THEN 0 WHEN d = 0 THEN 1 ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) END AS w FROM taps)",
        "weights AS (SELECT o, n, t, i, CAST(round(w / sum(w) OVER (PARTITION BY o, n, t) * 4194304) AS BIGINT) AS k FROM raw)",
        "heavy AS (SELECT image_id, x, y, wide, tall, a, (r * a + 127) // 255 AS r, (g * a + 127) // 255 AS g, (b * a + 127) // 255 AS b FROM px)",
        *(
            f"""{name} AS (SELECT image_id, {out}, tall, {", ".join(f"least(greatest((sum({c} * k)::BIGINT + 2097152) >> 22, 0), 255) AS {c}" for c in "rgba")}
        FROM {source} JOIN weights ON o = {old} AND n = CASE WHEN {old} = 4 THEN 1 ELSE 5 END AND i = {at} GROUP BY image_id, tall, t, {other})"""
            for name, source, old, at, other, out in (("narrowed", "heavy", "wide", "x", "y", "t AS x, y"), ("lowered", "narrowed", "tall", "y", "x", "x, t AS y"))
        ),
    ),
)
def images_resampled(spark, sf_dir):
    """Vectors as images, made to fit into five pixels a side."""
    px, sizes = vector_images(spark, sf_dir)
    return pixels.resampled(px, sizes, 5)


def _pictures(spark, sf_dir) -> DataFrame:
    """Vectors as images in two colours' places more than a byte needs: channels of 32 steps."""
    px, _ = vector_images(spark, sf_dir, dealt=True)
    return px.withColumns({c: (F.floor(F.col(c) / 8) * 8).cast("int") for c in ("r", "g", "b")}).withColumn("a", F.lit(255))


def _palette_sql(levels: int) -> tuple[str, ...]:
    """Median cut level by level, as the operator describes it, over rows of colours."""
    parts = ["h0 AS MATERIALIZED (SELECT image_id, r // 8 * 8 AS r, g // 8 * 8 AS g, b // 8 * 8 AS b, count(*) AS n, 0 AS box FROM px GROUP BY ALL)"]
    for k in range(levels):
        parts += [
            f"""s{k} AS (SELECT *, max(r) OVER w - min(r) OVER w AS dr, max(g) OVER w - min(g) OVER w AS dg, max(b) OVER w - min(b) OVER w AS db, sum(n) OVER w AS total FROM h{k} WINDOW w AS (PARTITION BY image_id, box))""",
            f"v{k} AS (SELECT *, CASE WHEN dg >= dr AND dg >= db THEN g WHEN dr >= db THEN r ELSE b END AS v FROM s{k})",
            f"c{k} AS (SELECT *, sum(n) OVER (PARTITION BY image_id, box ORDER BY v RANGE UNBOUNDED PRECEDING) AS upto, min(v) OVER (PARTITION BY image_id, box) AS low FROM v{k})",
            f"h{k + 1} AS MATERIALIZED (SELECT image_id, r, g, b, n, 2 * box + CASE WHEN v > low AND 2 * (upto - m) >= total THEN 1 ELSE 0 END AS box FROM (SELECT *, sum(n) OVER (PARTITION BY image_id, box, v) AS m FROM c{k}))",
        ]
    parts.append(f"palette AS (SELECT image_id, box, sum(r * n) // sum(n) AS pr, sum(g * n) // sum(n) AS pg, sum(b * n) // sum(n) AS pb FROM h{levels} GROUP BY ALL)")
    return tuple(parts)


@query(
    """SELECT image_id, r, g, b, n, CAST(pr AS INT) AS pr, CAST(pg AS INT) AS pg, CAST(pb AS INT) AS pb FROM h3 JOIN palette USING (image_id)
    QUALIFY row_number() OVER (PARTITION BY image_id, r, g, b ORDER BY (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), palette.box) = 1""",
    using=(IMAGES, *_palette_sql(3)),
)
def images_palettes(spark, sf_dir):
    """Each colour of vectors as images with the nearest of eight that median cuts find."""
    colours = pixels.histogram(_pictures(spark, sf_dir))
    return pixels.nearest(colours, pixels.palette(colours, 3)).select("image_id", "r", "g", "b", "n", "pr", "pg", "pb")


def moving(spark, sf_dir) -> DataFrame:
    """Vectors of one label as the frames of one picture of eight by eight; a frame leaves out what it does not change."""
    v = t.table(spark, sf_dir, "embeddings").where("vec_id % 10 < 6").select(F.floor(F.col("vec_id") / 10).alias("image_id"), (F.col("vec_id") % 10).cast("int").alias("frame"), F.posexplode("embedding").alias("k", "value"))
    byte = F.least(F.greatest(F.floor(F.col("value").cast("double") * 256) + 128, F.lit(0)), F.lit(255)).cast("int")
    px = v.select("image_id", "frame", (F.col("k") % 8).cast("int").alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"), byte.alias("r"), ((byte * 3) % 256).alias("g"), (255 - byte).alias("b"), F.lit(255).alias("a"))
    return px.where("r % 3 > 0 OR frame = 0")


_COMPOSED = {
    "sql": """SELECT image_id, CAST(frame AS INT) AS frame, CAST(x AS INT) AS x, CAST(y AS INT) AS y, r, CAST(a AS INT) AS a FROM (
      SELECT f.image_id, f.frame, q.k % 8 AS x, q.k // 8 AS y, coalesce(last_value(CASE WHEN s.frame % 3 < 2 OR s.frame = f.frame THEN s.r END IGNORE NULLS) OVER (PARTITION BY f.image_id, f.frame, q.k ORDER BY s.frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS r,
        CASE WHEN max(CASE WHEN s.frame % 3 < 2 OR s.frame = f.frame THEN 1 END) OVER (PARTITION BY f.image_id, f.frame, q.k) = 1 THEN 255 ELSE 0 END AS a, row_number() OVER (PARTITION BY f.image_id, f.frame, q.k ORDER BY s.frame DESC NULLS LAST) AS n
      FROM frames_ f CROSS JOIN range(0, 64) AS q(k) LEFT JOIN shown s ON s.image_id = f.image_id AND s.k = q.k AND s.frame <= f.frame AND s.frame > f.cleared) WHERE n = 1""",
    "using": (
        "shown AS (SELECT vec_id // 10 AS image_id, vec_id % 10 AS frame, k, r FROM (SELECT vec_id, unnest(range(len(embedding))) AS k, CAST(least(greatest(floor(unnest(embedding)::DOUBLE * 256) + 128, 0), 255) AS INT) AS r FROM embeddings WHERE vec_id % 10 < 6) WHERE r % 3 > 0 OR vec_id % 10 = 0)",
        "frames_ AS (SELECT vec_id // 10 AS image_id, vec_id % 10 AS frame, CASE WHEN vec_id % 10 > 4 THEN 4 ELSE -1 END AS cleared FROM embeddings WHERE vec_id % 10 < 6)",
    ),
}


def _whole_frames(spark, sf_dir) -> DataFrame:
    px = moving(spark, sf_dir)
    frame = F.col("vec_id") % 10
    frames = t.table(spark, sf_dir, "embeddings").where("vec_id % 10 < 6").select(
        F.floor(F.col("vec_id") / 10).alias("image_id"), frame.cast("int").alias("frame"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.when(frame == 4, "background").when(frame % 3 == 2, "previous").otherwise("none").alias("disposal")
    )
    return pixels.composed(px, frames)


@query(**_COMPOSED)
def images_composed(spark, sf_dir):
    """Whole frames of moving pictures: every third frame is taken back after it was shown, and after the fifth all is cleared."""
    return _whole_frames(spark, sf_dir).select("image_id", "frame", "x", "y", "r", "a")


@query(**_COMPOSED)
def images_animated(spark, sf_dir):
    """The same frames written as animated PNG files and read back."""
    packed = pixels.to_apng(_whole_frames(spark, sf_dir).withColumn("delay_ms", 40 + F.col("frame")))
    return pixels.from_apng(packed).where("delay_ms = 40 + frame").select("image_id", "frame", "x", "y", "r", "a")


@query(
    """SELECT image_id, 3::BIGINT AS kind, count(DISTINCT (pr, pg, pb)) AS colours, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * (pr + 2 * pg + 3 * pb)) AS BIGINT) AS total FROM (SELECT image_id, r, g, b, n, pr, pg, pb FROM h3 JOIN palette USING (image_id)
    QUALIFY row_number() OVER (PARTITION BY image_id, r, g, b ORDER BY (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), palette.box) = 1) GROUP BY image_id""",
    using=(IMAGES, *_palette_sql(3)),
)
def images_indexed(spark, sf_dir):
    """Vectors as images in eight colours, written as PNG files with a palette and read back."""
    packed = pixels.to_png(pixels.quantised(_pictures(spark, sf_dir), 3), palettes=True)
    kinds = packed.select("image_id", F.conv(F.hex(F.substring("content", 26, 1)), 16, 10).cast("long").alias("kind"))
    # pixels of one colour are counted before they meet, so few rows of an image are shuffled
    colours = pixels.from_png(packed).groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))
    back = colours.groupBy("image_id").agg(F.count("*").alias("colours"), F.sum("n").alias("n"), F.sum(F.expr("n * (r + 2 * g + 3 * b)")).cast("long").alias("total"))
    return back.join(kinds.hint("merge"), "image_id").select("image_id", "kind", "colours", "n", "total")


_SPACES = ("/DeviceGray", "/DeviceRGB", "/DeviceCMYK", "/Indexed")


def image_streams(spark, sf_dir) -> DataFrame:
    """Vectors as embedded images in four colour spaces, in turn plain and as hexadecimal text."""
    v = F.col("vec_id")
    byte = lambda x: F.least(F.greatest(F.floor(x.cast("double") * 256) + 128, F.lit(0)), F.lit(255))
    digits = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(byte(x).cast("long")), 2, "0")), "")
    colours = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.concat(*[F.lpad(F.hex(c), 2, "0") for c in (i, 255 - i, i * 7 % 256)])), ""))
    plain, side = F.floor(v / 4) % 2 == 0, lambda *sizes: F.element_at(F.array(*map(F.lit, sizes)), (v % 4 + 1).cast("int"))
    space = F.array(side(*_SPACES))
    return t.table(spark, sf_dir, "embeddings").select(
        v.alias("image_id"), F.when(plain, F.unhex(digits)).otherwise(F.encode(F.concat(digits, F.lit(">")), "UTF-8")).alias("data"), pdf.filter_names(F.when(~plain, F.array(F.lit("/ASCIIHexDecode")))).alias("filters"),
        side(8, 7, 4, 8).alias("width"), side(8, 3, 4, 8).alias("height"), F.lit(8).alias("bits"), pdf.colour_kind(space).alias("kind"), (v % 13 == 12).alias("mask"), F.lit(1).alias("predictor"), colours.alias("colours"),
    )


@query(
    """SELECT image_id, CAST(p % w AS INT) AS x, CAST(p // w AS INT) AS y, CAST(CASE kind WHEN 2 THEN n - (c0 * n + 127) // 255 ELSE c0 END AS INT) AS r,
    CAST(CASE kind WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN n - (c1 * n + 127) // 255 ELSE 255 - c0 END AS INT) AS g, CAST(CASE kind WHEN 0 THEN c0 WHEN 1 THEN c2 WHEN 2 THEN n - (c2 * n + 127) // 255 ELSE c0 * 7 % 256 END AS INT) AS b, 255 AS a FROM spots""",
    using=(
        "raw AS (SELECT vec_id AS image_id, vec_id % 4 AS kind, list_transform(embedding, lambda v: CAST(least(greatest(floor(v::DOUBLE * 256) + 128, 0), 255) AS INT)) AS s FROM embeddings WHERE vec_id % 13 <> 12)",
        "sized AS (SELECT *, CASE kind WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 1 END AS step, CASE kind WHEN 1 THEN 7 WHEN 2 THEN 4 ELSE 8 END AS w, CASE kind WHEN 1 THEN 21 WHEN 2 THEN 16 ELSE 64 END AS places FROM raw)",
        "spots AS (SELECT image_id, kind, w, p, s[p * step + 1] AS c0, s[p * step + 2] AS c1, s[p * step + 3] AS c2, 255 - s[p * step + 4] AS n FROM (SELECT *, unnest(range(places)) AS p FROM sized WHERE len(s) >= places * step))",
    ),
)
def images_embedded(spark, sf_dir):
    """Image streams as documents embed them, as pixels; one in thirteen is a mask and has none."""
    return pixels.from_streams(image_streams(spark, sf_dir))
