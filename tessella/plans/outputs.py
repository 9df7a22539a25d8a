"""Queries for what is written and looked up: Word files, images as pixels, runs, PDF names, jobs, archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import blocks, formatters, media, pdf, runs
from tessella.operators import geometry, limits, packages, pixels, records
from tessella.plans import tables as t
from tessella.plans.pages import PAGES, _pages, _rows
from tessella.plans.registry import query
from tessella.plans.rules import _picked, _sql_cases, _sql_picked
from tessella.sources import docx

# ---------------------------------------------------------------- Word files

_BLOCKS = "block_no int, kind string, text string, align string, font_size double, x0 double, x1 double, width double, top double, bottom double"
_LAYOUT = (
    (0, "text", "Title of all", "center", 14.0, 200.0, 300.0, None, 50.0, 64.0),
    (1, "text", "right", "left", None, 300.0, 350.0, None, 200.0, 210.0),
    (2, "text", "left", "left", None, 60.0, 90.0, None, 201.0, 211.0),
    (3, "line", None, None, None, 60.0, 400.0, None, 250.0, 251.0),
    (4, "table", None, None, None, 60.0, None, None, 66.0, 120.0),
)


def _layout(spark, sf_dir):
    return _rows(_pages(spark, sf_dir), _BLOCKS, *_LAYOUT).where("block_no <> 3 OR doc_id % 2 = 0")


@query("SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n, md5(coalesce(text, '')) AS digest, 4::BIGINT AS files FROM documents")
def docx_round_trip(spark, sf_dir):
    """Every whole text as a Word file, a paragraph for each line, and read back."""
    lines = t.dealt(t.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 2_000).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("row_no", "text"))
    whole = docx.written(lines.select("doc_id", F.lit(0).alias("page_no"), "row_no", F.col("row_no").alias("block_no"), F.lit("text").alias("kind"), "text"))
    read = whole.select("doc_id", "files", docx.paragraphs("content").alias("p"))
    return read.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "\n").cast("binary")).alias("digest"), "files")


@query("SELECT doc_id, 'Title of all||head|l||r|left' || chr(9) || 'right' || CASE WHEN doc_id % 2 = 0 THEN '|' ELSE '' END AS parts FROM pages_", using=(PAGES,))
def docx_layout(spark, sf_dir):
    """A title, a close table with a wide and a tall cell below it, two texts side by side, a rule."""
    cell = lambda r, c, tall, wide, text: F.struct(*[F.lit(v).cast(kind).alias(n) for n, v, kind in (("r", r, "int"), ("c", c, "int"), ("rowspan", tall, "int"), ("colspan", wide, "int"), ("text", text, "string"), ("align", "center", "string"), ("valign", "center", "string"), ("bg_color", "EEEEEE", "string"))])
    rows = geometry.visual_rows(_layout(spark, sf_dir))
    rows = rows.withColumn("cells", F.when(F.col("kind") == "table", F.array(cell(0, 0, 1, 2, "head"), cell(1, 0, 2, 1, "l"), cell(2, 1, 1, 1, "r"))))
    # A row's number follows its first block; tables stand where their top says.
    first = rows.groupBy("doc_id", "page_no", "row_no").agg(F.min("top").alias("_top"))
    placed = rows.join(first.hint("merge"), ["doc_id", "page_no", "row_no"]).withColumn("row_no", F.dense_rank().over(geometry.Window.partitionBy("doc_id", "page_no").orderBy("_top", "row_no")))
    return docx.written(placed).select("doc_id", F.array_join(docx.paragraphs("content"), "|").alias("parts"))


@query(
    "SELECT doc_id, block_no, CASE block_no WHEN 4 THEN 160.0 WHEN 3 THEN 400.0 WHEN 2 THEN 90.0 WHEN 1 THEN 350.0 ELSE 300.0 END::DOUBLE AS right_, CASE block_no WHEN 0 THEN 150.0 WHEN 1 THEN 250.0 ELSE 10.0 END::DOUBLE AS indent, block_no = 0 AS title, CASE block_no WHEN 0 THEN 64.0 WHEN 1 THEN 210.0 WHEN 2 THEN 211.0 WHEN 3 THEN 251.0 ELSE 120.0 END::DOUBLE AS low FROM pages_, range(5) v(block_no) WHERE block_no <> 3 OR doc_id % 2 = 0",
    using=(PAGES,),
)
def block_edges(spark, sf_dir):
    c, columns = F.col, F.when(F.col("kind") == "table", F.array(F.lit(40.0), F.lit(60.0)))
    return _layout(spark, sf_dir).select(
        "doc_id", c("block_no").cast("long").alias("block_no"), blocks.right_edge(c("kind"), c("x0"), c("x1"), c("width"), columns).alias("right_"), blocks.indent(blocks.left_edge(c("x0")), F.lit(50.0)).alias("indent"),
        blocks.title_like(c("kind"), c("align"), c("font_size"), c("text")).alias("title"), blocks.lower_edge(c("top"), c("bottom")).alias("low"),
    )


# ---------------------------------------------------------------- images

SIDE = 8
PIXELS = f"pixels AS (SELECT p_partkey AS image_id, CAST(i % {SIDE} AS INT) AS x, CAST(i // {SIDE} AS INT) AS y, CASE WHEN i % {SIDE} BETWEEN 2 AND 5 AND i // {SIDE} BETWEEN 2 AND 5 THEN CAST((p_partkey * 7 + i) % 256 AS INT) ELSE CAST(p_size AS INT) END AS r, CAST(p_size AS INT) AS g, CAST(p_size * 2 AS INT) AS b, CASE WHEN i = 27 THEN 128 ELSE 255 END AS a FROM part, range({SIDE * SIDE}) v(i))"
FAR = "SELECT image_id, x, y, CASE WHEN abs(r - key_r) <= 39 THEN 0 WHEN abs(r - key_r) < 103 THEN CAST(round_even(255.0::DOUBLE * (abs(r - key_r) - 39) / 64, 0) AS INT) ELSE 255 END AS mask, a FROM pixels JOIN (SELECT p_partkey AS k, p_size AS key_r FROM part) ON k = image_id"


def _images(spark, sf_dir):
    """A flat ground by the part's size with a square of other reds on it; one pixel is half transparent."""
    i, size = F.col("i"), F.col("p_size").cast("int")
    x, y = (i % SIDE).cast("int"), F.floor(i / SIDE).cast("int")
    rows = t.dealt(t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), "p_size"), "image_id").select("image_id", "p_size", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("i"))
    red = F.when(x.between(2, 5) & y.between(2, 5), ((F.col("image_id") * 7 + i) % 256).cast("int")).otherwise(size)
    return rows.select("image_id", x.alias("x"), y.alias("y"), red.alias("r"), size.alias("g"), (size * 2).alias("b"), F.when(i == 27, 128).otherwise(255).alias("a"))


def _image_sizes(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))


@query("SELECT image_id, count(DISTINCT (r, g, b, a)) AS colours FROM pixels GROUP BY image_id", using=(PIXELS,))
def image_colours(spark, sf_dir):
    return pixels.unique_colours(_images(spark, sf_dir))


@query("SELECT p_partkey AS image_id, p_size AS key_r, p_size AS key_g, p_size * 2 AS key_b FROM part")
def image_background(spark, sf_dir):
    return pixels.corner_background(_images(spark, sf_dir), _image_sizes(spark, sf_dir))


@query(f"SELECT image_id, CAST(sum(floor((a * mask + 127) / 255)) AS BIGINT) AS alpha, count(*) FILTER (WHERE mask = 0) AS gone FROM ({FAR}) GROUP BY image_id", using=(PIXELS,))
def image_transparent(spark, sf_dir):
    images = _images(spark, sf_dir)
    found = pixels.without_background(images, pixels.corner_background(images, _image_sizes(spark, sf_dir)))
    return found.groupBy("image_id").agg(F.sum("a").cast("long").alias("alpha"), F.count_if(F.col("a") == 0).alias("gone"))


@query("SELECT image_id, CAST(sum(CASE WHEN a = 255 THEN r ELSE floor((r * a + 255 * (255 - a) + 127) / 255) END) AS BIGINT) AS red, 64::BIGINT AS opaque FROM pixels GROUP BY image_id", using=(PIXELS,))
def image_flattened(spark, sf_dir):
    found = pixels.flattened(_images(spark, sf_dir))
    return found.groupBy("image_id").agg(F.sum("r").cast("long").alias("red"), F.count_if(F.col("a") == 255).alias("opaque"))


@query("SELECT image_id, count(*) AS n, CAST(sum(r * (x + 1) + g * (y + 1) + b * 3 + a) AS BIGINT) AS total, 8::BIGINT AS width, 8::BIGINT AS height FROM pixels GROUP BY image_id", using=(PIXELS,))
def image_round_trip(spark, sf_dir):
    """Pixels to PNG and back, with the size that the header states."""
    packed = pixels.to_png(_images(spark, sf_dir))
    back = pixels.from_png(packed).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.expr("r * (x + 1) + g * (y + 1) + b * 3 + a")).cast("long").alias("total"))
    size = pixels.header_size(F.col("content"))
    return back.join(packed.select("image_id", size["width"].alias("width"), size["height"].alias("height")).hint("merge"), "image_id")


_PRESETS = ("high", " Balanced ", "STRONG", "", "best")


@query(f"SELECT p_partkey, {_sql_cases('p_partkey', (90, 82, 72, 82, 'NULL'))} AS jpeg, {_sql_cases('p_partkey', (256, 192, 128, 192, 'NULL'))} AS gif, {_sql_cases('p_partkey', (0, 0, 2560, 0, 'NULL'))} AS side, {_sql_cases('p_partkey', ('true', 'true', 'false', 'true', 'false'))} AS alpha FROM part")
def image_presets(spark, sf_dir):
    p = media.preset(_picked("p_partkey", _PRESETS))
    mode = _picked("p_partkey", ("RGBA", "LA", "RGB", "P", "P"))
    return t.table(spark, sf_dir, "part").select("p_partkey", p["jpeg_quality"].alias("jpeg"), p["gif_colors"].alias("gif"), p["max_side"].alias("side"), pixels.has_alpha(mode, F.col("p_partkey") % 5 == 3).alias("alpha"))


# ---------------------------------------------------------------- runs and names

_RUN = "struct<text:string,font_size:double,font_name:string>"


def _run(text, size, name):
    return F.struct(text.alias("text"), F.lit(size).cast("double").alias("font_size"), F.lit(name).cast("string").alias("font_name")).cast(_RUN)


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a|b' || p_partkey || ' c|d' WHEN 1 THEN 'a|b' || p_partkey || 'x|d' WHEN 2 THEN 'c|d' ELSE 'a|b' || p_partkey END AS merged, CASE p_partkey % 4 WHEN 2 THEN 9 WHEN 3 THEN NULL ELSE 9 END::DOUBLE AS size, CASE WHEN p_partkey % 4 = 2 THEN '' WHEN p_partkey % 4 = 1 THEN 'ab' || p_partkey || '-' ELSE 'ab' || p_partkey END || chr(10) || chr(10) || 'z' AS lines FROM part")
def runs_merged(spark, sf_dir):
    """Runs that meet are joined as wrapped lines: with a space, without a hyphen; empty ones go."""
    k = F.col("p_partkey")
    left = F.array(_run(F.lit("a"), 12, "Hei"), _run(F.concat(F.lit("b"), k.cast("string"), F.when(k % 4 == 1, "-").otherwise("")), None, ""), _run(F.lit(""), 7, "x"))
    right = F.array(_run(F.lit(None).cast("string"), 8, "y"), _run(F.when(k % 4 == 1, "x").otherwise("c"), 9, "Song"), _run(F.lit("d"), 10, "Song"))
    left, right = F.when(k % 4 == 2, F.array().cast(f"array<{_RUN}>")).otherwise(left), F.when(k % 4 == 3, F.array().cast(f"array<{_RUN}>")).otherwise(right)
    merged = runs.merged(left, right)
    lines = runs.paragraphs_text(F.array(left, F.array().cast(f"array<{_RUN}>"), F.array(_run(F.lit("z"), None, None))))
    return t.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(merged, lambda r: r["text"]), "|").alias("merged"), F.get(merged, F.when(k % 4 == 2, 0).otherwise(1))["font_size"].alias("size"), lines.alias("lines"))


_SPACES = ("/DeviceRGB", "PSLiteral(DeviceGray)", "/ICCBased", "[/Indexed /DeviceCMYK]", " Pattern ", "/CalGray")
_NAMES = ("DeviceRGB", "DeviceGray", "ICCBased", "DeviceCMYK", "Pattern", "CalGray")
_KINDS = ("rgb", "gray", "rgb", "cmyk", "pattern", "gray")
_FAULTS = ("File has not been decrypted", "wrong Password", "no such file")


@query(f"SELECT p_partkey, {_sql_picked('p_partkey', _NAMES)} AS name, {_sql_picked('p_partkey', _KINDS)} AS kind, 'FlateDecode,{_NAMES[0]}' AS filters, CASE WHEN p_partkey % 3 < 2 THEN 'PDF is password-protected; please decrypt it first' ELSE 'Cannot open PDF: no such file' END AS fault FROM part")
def pdf_names(spark, sf_dir):
    space = _picked("p_partkey", _SPACES)
    return t.table(spark, sf_dir, "part").select("p_partkey", pdf.object_name(space).alias("name"), pdf.colour_kind(F.array(space, F.lit("/DeviceCMYK"))).alias("kind"), F.array_join(pdf.filter_names(F.array(F.lit("/FlateDecode"), F.lit("/DeviceRGB"))), ",").alias("filters"), pdf.open_error(_picked("p_partkey", _FAULTS)).alias("fault"))


@query(f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)}, true)' for x in formatters.LANGUAGES)}) v(language, valid)")
def language_samples(spark, sf_dir):
    """Every sample is well formed in its language."""
    rows = formatters.samples(spark)
    checked = [rows.where(F.col("language") == x).select("language", formatters.validate_code(F.col("sample"), lang=x)["valid"].alias("valid")) for x in formatters.LANGUAGES]
    out = checked[0]
    for c in checked[1:]:
        out = out.unionByName(c)
    return out


# ---------------------------------------------------------------- jobs, archives, clean-up

_ACTIONS = ("create", "start", "finish", "fail", "download")
JOBS = "jobs AS (SELECT user_id, arg_max(a, (ts, event_id)) FILTER (WHERE a <> 'download') AS last_, arg_max(a, (ts, event_id)) FILTER (WHERE a IN ('finish', 'fail', 'download')) AS last_file, arg_max(a, (ts, event_id)) AS last_any, count(*) FILTER (WHERE a = 'download') > 0 AS got, max(ts) FILTER (WHERE a = 'fail') IS NOT NULL AS failed FROM (SELECT *, ['create', 'start', 'finish', 'fail', 'download'][event_id % 5 + 1] AS a FROM events) GROUP BY user_id)"


@query("SELECT user_id, CASE last_ WHEN 'create' THEN 'queued' WHEN 'start' THEN 'running' WHEN 'finish' THEN 'done' WHEN 'fail' THEN 'error' END AS status, CASE last_ WHEN 'create' THEN 0.0 WHEN 'start' THEN 0.05 WHEN 'finish' THEN 1.0 WHEN 'fail' THEN 1.0 END::DOUBLE AS progress, CASE last_any WHEN 'create' THEN '' WHEN 'start' THEN 'running' WHEN 'finish' THEN 'done' WHEN 'fail' THEN 'error' ELSE 'downloaded' END AS message, CASE WHEN failed THEN 'error' END AS error, coalesce(last_ = 'finish' AND last_file = 'finish' AND NOT got, false) AS has_result FROM jobs", using=(JOBS,))
def job_lifecycles(spark, sf_dir):
    """Events as actions on the job of their user, merged to its state."""
    e = t.table(spark, sf_dir, "events")
    actions = e.select("user_id", "event_id", F.col("ts").alias("at"), _picked("event_id", _ACTIONS).alias("action"), F.lit("").alias("error"), F.concat(F.lit("out/"), "event_id").alias("output_path"))
    state = limits.latest_state(limits.job_changes(actions), key="user_id", time="at", order="event_id", fields=("status", "progress", "message", "error", "output_path", "downloaded_at"))
    return state.select("user_id", "status", "progress", "message", "error", limits.has_result(F.col("status"), F.col("output_path"), F.col("downloaded_at")).alias("has_result"))


@query("SELECT id, tool, input_rel FROM records WHERE created_at >= TIMESTAMP '2001-01-01' - INTERVAL 2000 DAY UNION ALL SELECT -id, tool, input_rel FROM records WHERE input_rel <> '' AND id % 4 <> 0", using=(t.RECORDS,))
def records_archived(spark, sf_dir):
    """Old records go as new ones come; what has no name or no safe path is left out."""
    old = t.records(spark, sf_dir)
    new = old.withColumn("id", -F.col("id")).withColumn("original_name", F.when(F.col("id") % 4 != 0, F.col("original_name")))
    return records.archived(old, new, t.NOW, 2000).select("id", "tool", "input_rel")


@query("SELECT DISTINCT input_rel || e AS path FROM records, (VALUES (''), ('.preview.pdf')) v(e) WHERE input_rel <> '' AND id % 3 = 0", using=(t.RECORDS,))
def records_files(spark, sf_dir):
    rows = t.records(spark, sf_dir).where("id % 3 = 0")
    return records.files_of(rows.withColumn("output_rel", F.lit("../outside")))


@query("SELECT count(*) AS kept, count(*) FILTER (WHERE expires_at > '2001-01-01T00:00:00Z') AS forced FROM packages", using=(t.PACKAGES,))
def packages_cleaned(spark, sf_dir):
    p = t.packages(spark, sf_dir)
    return packages.cleaned(p, t.NOW).agg(F.count("*").alias("kept")).join(packages.cleaned(p, t.NOW, force=True).agg(F.count("*").alias("forced")))
