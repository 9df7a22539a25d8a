"""Word documents from blocks, and their paragraphs back.

Every block becomes its XML by column expressions; rows, pages and documents
are put together by aggregation, and only the packing of a document's parts
into one file runs in Python.

Blocks have doc_id, page_no, row_no (``geometry.visual_rows``), block_no and
kind (text, image, line, table); of the other columns what is missing is null:
text, align, font_size, font_name, x0, x1, top, bottom, width, height, content
(an image's PNG), color (a line's), and a table's col_widths, border_outer,
border_inner, border_color, border_dashed and cells.  A cell's text has one font
unless it has paragraphs of runs; a table whose cells have borders of their own
has no others.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.functions.blocks import indent, left_edge, lower_edge, title_like
from tessella.functions.let import let
from tessella.functions.numbers import soft_gap
from tessella.functions.runs import RUN, filled
from tessella.functions.text import font_family, is_bold
from tessella.sources.files import zipped

EDGE = "struct<width:double,color:string,dashed:boolean>"
SIDES = ("top", "left", "bottom", "right")
CELL_FIELDS = {"r": "int", "c": "int", "rowspan": "int", "colspan": "int", "text": "string", "align": "string", "valign": "string", "bg_color": "string", "font_size": "double", "font_name": "string", "paragraphs": f"array<array<{RUN}>>", "borders": f"struct<{','.join(f'{s}:{EDGE}' for s in SIDES)}>"}
CELL = f"struct<{','.join(f'{n}:{t}' for n, t in list(CELL_FIELDS.items())[:8])}>"
RICH_CELL = f"struct<{','.join(f'{n}:{t}' for n, t in CELL_FIELDS.items())}>"
FIELDS = {"text": "string", "align": "string", "font_size": "double", "font_name": "string", "x0": "double", "x1": "double", "top": "double", "bottom": "double", "width": "double", "height": "double", "content": "binary", "color": "string", "col_widths": "array<double>", "border_outer": "double", "border_inner": "double", "border_color": "string", "border_dashed": "boolean", "cells": f"array<{RICH_CELL}>"}

# Namespaces, part names and types of the file format; default font size, gap below a title.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
TYPES = f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELATIONS = f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">'
ROOT_RELATIONS = f'{RELATIONS}<Relationship Id="rId1" Type="{REL}/officeDocument" Target="word/document.xml"/></Relationships>'
DOCUMENT = f'{HEAD}<w:document xmlns:w="{W}" xmlns:r="{REL}" xmlns:wp="{DRAWING}/wordprocessingDrawing" xmlns:a="{DRAWING}/main" xmlns:pic="{DRAWING}/picture"><w:body>'
BREAK = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
FONT_SIZE = 10.5
LINE_WIDTH = 0.5
AFTER_TITLE = 1.0
SHEET = (595.27, 841.89)
EMU = 12700


def _xml(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _units(points: Column, each: int) -> Column:
    return F.bround(F.coalesce(points, F.lit(0.0)) * each).cast("long")


def escaped(text: Column) -> Column:
    """Text as XML; what XML cannot hold goes."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    for raw, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(raw), F.lit(put))
    return out


def run(text: Column, size: Column, name: Column) -> Column:
    """A run; line breaks stay breaks."""
    font = _xml('<w:rFonts w:ascii="', escaped(font_family(name)), '" w:hAnsi="', escaped(font_family(name)), '" w:eastAsia="', escaped(font_family(name)), '"/>', F.when(is_bold(name), "<w:b/>"), '<w:sz w:val="', _units(F.coalesce(F.nullif(size, F.lit(0.0)), F.lit(FONT_SIZE)), 2), '"/>')
    broken = F.replace(escaped(text), F.lit("\n"), F.lit('</w:t><w:br/><w:t xml:space="preserve">'))
    return _xml("<w:r><w:rPr>", font, '</w:rPr><w:t xml:space="preserve">', broken, "</w:t></w:r>")


def picture(b: Column, page: Column) -> Column:
    size = _xml('cx="', _units(b["width"], EMU), '" cy="', _units(b["height"], EMU), '"')
    number = _xml('id="', page * 10_000 + b["block_no"] + 1, '" name="', _image_name(page, b["block_no"]), '"')
    shape = _xml('<pic:pic><pic:nvPicPr><pic:cNvPr ', number, '/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="', _image_name(page, b["block_no"]), '"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext ', size, '/></a:xfrm><a:prstGeom prst="rect"/></pic:spPr></pic:pic>')
    return _xml("<w:r><w:drawing><wp:inline><wp:extent ", size, "/><wp:docPr ", number, f'/><a:graphic><a:graphicData uri="{DRAWING}/picture">', shape, "</a:graphicData></a:graphic></wp:inline></w:drawing></w:r>")


def _image_name(page: Column, block: Column) -> Column:
    return F.concat(F.lit("image"), page.cast("string"), F.lit("_"), block.cast("string"))


def _left(points: Column) -> Column:
    return F.when(points > 0.5, _xml('<w:ind w:left="', _units(points, 20), '"/>'))


def _aligned(align: Column) -> Column:
    return _xml('<w:jc w:val="', F.when(align.isin("center", "right"), align).otherwise("left"), '"/>')


def _rule(b: Column, margin: Column, before: Column) -> Column:
    """A line is the lower border of an empty paragraph."""
    edge = _xml('<w:pBdr><w:bottom w:val="single" w:sz="4" w:space="1" w:color="', escaped(F.coalesce(b["color"], F.lit("000000"))), '"/></w:pBdr>')
    return _xml("<w:p><w:pPr>", edge, '<w:spacing w:before="', _units(before, 20), '" w:after="0"/>', _left(indent(left_edge(b["x0"]), margin)), "</w:pPr></w:p>")


def _spacer(points: Column) -> Column:
    return F.when(points > 0.5, _xml('<w:p><w:pPr><w:spacing w:before="0" w:after="0" w:line="', _units(points, 20), '" w:lineRule="exact"/></w:pPr></w:p>'))


def _span(cell: Column, name: str) -> Column:
    return F.greatest(F.coalesce(cell[name], F.lit(1)), F.lit(1))


def _edge_xml(side: str, width: Column, color: Column, dashed: Column) -> Column:
    return _xml(f'<w:{side} w:val="', F.when(F.coalesce(dashed, F.lit(False)), "dashed").otherwise("single"), '" w:sz="', _units(width, 8), '" w:space="0" w:color="', escaped(F.coalesce(color, F.lit("auto"))), '"/>')


def settled(cells: Column) -> Column:
    """Cells with the borders that show: of two neighbours that share an edge the wider line wins, of equal ones that of the left or upper cell."""

    def side(x: Column, name: str) -> Column:
        across, ahead = name in ("left", "right"), name in ("right", "bottom")
        at, span, other_at, other_span = ("c", "colspan", "r", "rowspan") if across else ("r", "rowspan", "c", "colspan")
        facing = {"left": "right", "right": "left", "top": "bottom", "bottom": "top"}[name]

        def beside(y: Column) -> Column:
            touch = y[at] == x[at] + _span(x, span) if ahead else y[at] + _span(y, span) == x[at]
            return touch & (y[other_at] < x[other_at] + _span(x, other_span)) & (x[other_at] < y[other_at] + _span(y, other_span))

        rank = lambda e, own: F.struct(F.coalesce(e["width"], F.lit(0.0)).alias("width"), F.lit(own).alias("first"), e.alias("edge"))
        theirs = F.transform(F.filter(cells, beside), lambda y: rank(y["borders"][facing], 0 if ahead else 1))
        best = F.array_max(F.filter(F.concat(F.array(rank(x["borders"][name], 1 if ahead else 0)), theirs), lambda e: e["width"] > 0))
        return best["edge"].alias(name)

    drawn = F.exists(cells, lambda x: x["borders"].isNotNull())
    fields = [n for n in CELL_FIELDS if n != "borders"]
    full = F.transform(cells, lambda x: F.struct(*[x[n].alias(n) for n in fields], F.struct(*[side(x, name) for name in SIDES]).alias("borders")).cast(RICH_CELL))
    return F.when(drawn, full).otherwise(cells)


def _cell_paragraphs(x: Column) -> Column:
    """The paragraphs of a cell: runs in their own fonts, or the cell's where they have none; else its text."""
    look = _xml('<w:p><w:pPr><w:spacing w:before="0" w:after="0"/>', _aligned(x["align"]), "</w:pPr>")
    one = _xml(look, run(x["text"], x["font_size"], x["font_name"]), "</w:p>")
    runs = lambda p: F.array_join(F.transform(filled(p), lambda r: run(r["text"], F.coalesce(r["font_size"], x["font_size"]), F.coalesce(r["font_name"], x["font_name"]))), "")
    many = F.array_join(F.transform(x["paragraphs"], lambda p: _xml(look, runs(p), "</w:p>")), "")
    return F.when(F.coalesce(F.size(x["paragraphs"]), F.lit(0)) > 0, many).otherwise(one)


def table(b: Column, margin: Column) -> Column:
    """A table of its anchors: wide cells span columns, tall ones are continued row by row."""
    return let(settled(F.array_sort(F.coalesce(b["cells"], F.array().cast(f"array<{RICH_CELL}>")), lambda x, y: F.when(x["r"] == y["r"], x["c"] - y["c"]).otherwise(x["r"] - y["r"]))), lambda cells: _table(b, cells, margin))


def _table(b: Column, cells: Column, margin: Column) -> Column:
    rows = F.aggregate(cells, F.lit(0), lambda n, x: F.greatest(n, x["r"] + _span(x, "rowspan")))
    columns = F.aggregate(cells, F.lit(0), lambda n, x: F.greatest(n, x["c"] + _span(x, "colspan")))
    widths = F.coalesce(b["col_widths"], F.transform(F.sequence(F.lit(1), F.greatest(columns, F.lit(1))), lambda _: F.lit(60.0)))

    def cell(x: Column, r: Column) -> Column:
        first = x["r"] == r
        last = r == x["r"] + _span(x, "rowspan") - 1
        span = F.when(_span(x, "colspan") > 1, _xml('<w:gridSpan w:val="', _span(x, "colspan"), '"/>'))
        merge = F.when(_span(x, "rowspan") > 1, F.when(first, '<w:vMerge w:val="restart"/>').otherwise("<w:vMerge/>"))
        shown = {"top": first, "left": F.lit(True), "bottom": last, "right": F.lit(True)}
        edges = _xml(*[F.when(shown[side] & (x["borders"][side]["width"] > 0), _edge_xml(side, x["borders"][side]["width"], x["borders"][side]["color"], x["borders"][side]["dashed"])) for side in SIDES])
        borders = F.when(edges != "", _xml("<w:tcBorders>", edges, "</w:tcBorders>"))
        shade = F.when(F.coalesce(x["bg_color"], F.lit("")) != "", _xml('<w:shd w:val="clear" w:color="auto" w:fill="', escaped(x["bg_color"]), '"/>'))
        place = _xml('<w:vAlign w:val="', F.when(x["valign"].isin("center", "bottom"), x["valign"]).otherwise("top"), '"/>')
        empty = _xml('<w:p><w:pPr><w:spacing w:before="0" w:after="0"/>', _aligned(x["align"]), "</w:pPr></w:p>")
        return _xml("<w:tc><w:tcPr>", span, merge, borders, shade, place, "</w:tcPr>", F.when(first, _cell_paragraphs(x)).otherwise(empty), "</w:tc>")

    covering = lambda r: F.array_sort(F.filter(cells, lambda x: (x["r"] <= r) & (r < x["r"] + _span(x, "rowspan"))), lambda x, y: x["c"] - y["c"])
    line = lambda r: _xml("<w:tr>", F.array_join(F.transform(covering(r), lambda x: cell(x, r)), ""), "</w:tr>")
    body = F.array_join(F.transform(F.sequence(F.lit(0), rows - 1), line), "")
    grid = F.array_join(F.transform(widths, lambda w: _xml('<w:gridCol w:w="', _units(w, 20), '"/>')), "")
    right = indent(left_edge(b["x0"]), margin)
    shift = F.when(right > 0.5, _xml('<w:tblInd w:w="', _units(right, 20), '" w:type="dxa"/>'))
    uniform = _xml("<w:tblBorders>", *[_edge_xml(side, F.coalesce(b[f"border_{kind}"], F.lit(LINE_WIDTH)), b["border_color"], b["border_dashed"]) for side, kind in (*((s, "outer") for s in SIDES), ("insideH", "inner"), ("insideV", "inner"))], "</w:tblBorders>")
    own = F.exists(cells, lambda x: x["borders"].isNotNull())
    return F.when(rows > 0, _xml("<w:tbl><w:tblPr>", shift, F.when(~own, uniform), "</w:tblPr><w:tblGrid>", grid, "</w:tblGrid>", body, "</w:tbl>"))


def row_xml(blocks: Column, page: Column, margin: Column, gap: Column, after_title: Column) -> Column:
    """What stands side by side, as one paragraph with tab stops; tables and lines by themselves."""
    soft = F.coalesce(soft_gap(gap), F.lit(0.0))
    one, only = F.element_at(blocks, 1), F.size(blocks) == 1
    inline = lambda b: F.when(b["kind"] == "image", F.when(b["content"].isNotNull(), picture(b, page)).otherwise("")).otherwise(run(b["text"], b["font_size"], b["font_name"]))
    beside = F.filter(blocks, lambda b: ~b["kind"].isin("line", "table"))
    rules = F.filter(blocks, lambda b: b["kind"] == "line")
    apart = F.array_join(F.transform(rules, lambda b, i: _rule(b, margin, F.when((i == 0) & (F.size(beside) == 0), soft).otherwise(0.0))), "")
    base = indent(left_edge(F.get(beside, F.lit(0))["x0"]), margin)
    stops = F.array_join(F.transform(F.slice(beside, F.lit(2), F.greatest(F.size(beside), F.lit(1))), lambda b: F.when(indent(left_edge(b["x0"]), margin) > base + 1, _xml('<w:tab w:val="left" w:pos="', _units(indent(left_edge(b["x0"]), margin), 20), '"/>')).otherwise("")), "")
    tabs = F.when(stops != "", _xml("<w:tabs>", stops, "</w:tabs>"))
    shared = _xml("<w:p><w:pPr>", tabs, '<w:spacing w:before="', _units(soft, 20), '" w:after="0"/>', _left(base), '<w:jc w:val="left"/></w:pPr>', F.array_join(F.transform(beside, inline), "<w:r><w:tab/></w:r>"), "</w:p>")
    alone = _xml('<w:p><w:pPr><w:spacing w:before="', _units(soft, 20), '" w:after="0"/>', F.when(F.coalesce(one["align"], F.lit("left")) == "left", _left(indent(left_edge(one["x0"]), margin))), _aligned(one["align"]), "</w:pPr>", inline(one), "</w:p>")
    tabled = _xml(_spacer(F.when(after_title, AFTER_TITLE).otherwise(soft)), table(one, margin))
    return F.when(only & (one["kind"] == "table"), tabled).when(F.size(beside) == 0, apart).when(only, alone).otherwise(_xml(shared, apart))


def written(blocks: DataFrame, margins: DataFrame | None = None, *, page_breaks: bool = True) -> DataFrame:
    """doc_id, files (parts of the package) and content: one Word file for each document.

    ``margins`` (doc_id, left, right, top, bottom in points) is what
    ``geometry.page_margins`` gives; without it they are 50.4.  Images without
    content are left out.  A document is one file and is put together whole.
    """
    if "cells" in blocks.columns:  # what cells lack is null
        has = blocks.schema["cells"].dataType.elementType.names
        whole = F.transform("cells", lambda x: F.struct(*[(x[n] if n in has else F.lit(None)).cast(t).alias(n) for n, t in CELL_FIELDS.items()]))
        blocks = blocks.withColumn("cells", whole)
    b = blocks.select("doc_id", "page_no", "row_no", "block_no", "kind", *[(F.col(n) if n in blocks.columns else F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()])
    body = F.struct("block_no", "kind", *FIELDS)
    placed = F.struct(left_edge(F.col("x0")).alias("at"), F.col("block_no").alias("no"), body.alias("b"))
    title = title_like(F.col("kind"), F.col("align"), F.col("font_size"), F.col("text"))
    rows = b.groupBy("doc_id", "page_no", "row_no").agg(F.collect_list(placed).alias("p"), F.min(F.coalesce("top", F.lit(0.0))).alias("top"), F.max(lower_edge(F.col("top"), F.col("bottom"))).alias("low"), (F.bool_and(title) & (F.count("*") == 1)).alias("title"))
    order = lambda x, y: F.when((x["at"] < y["at"]) | ((x["at"] == y["at"]) & (x["no"] < y["no"])), -1).when((x["at"] == y["at"]) & (x["no"] == y["no"]), 0).otherwise(1)
    before = Window.partitionBy("doc_id", "page_no").orderBy("row_no")
    rows = rows.withColumn("blocks", F.transform(F.array_sort("p", order), lambda x: x["b"])).withColumn("gap", F.greatest(F.lit(0.0), F.col("top") - F.lag("low").over(before))).withColumn("after", F.coalesce(F.lag("title").over(before), F.lit(False)))
    sides = ("left", "right", "top", "bottom")
    xml = row_xml(F.col("blocks"), F.col("page_no"), F.col("m_left"), F.col("gap"), F.col("after"))
    if margins is None:
        rows = rows.withColumns({f"m_{s}": F.lit(50.4) for s in sides})
    else:
        m = margins.select("doc_id", *[F.col(s).alias(f"m_{s}") for s in sides])
        rows = rows.join(m.hint("merge"), "doc_id", "left").fillna(50.4, [f"m_{s}" for s in sides])
    images = F.transform(F.filter("blocks", lambda x: (x["kind"] == "image") & x["content"].isNotNull()), lambda x: F.struct(_image_name(F.col("page_no"), x["block_no"]).alias("name"), x["content"].alias("content")))
    pages = rows.select("doc_id", "page_no", "row_no", xml.alias("xml"), images.alias("images"), *[f"m_{s}" for s in sides])
    # the parts of each level are sorted once; pictures stay with their document, so nothing is joined
    whole = lambda no: F.array_sort(F.collect_list(F.struct(no, F.coalesce("xml", F.lit("")).alias("xml"), "images"))).alias("parts")
    put = lambda between: (F.array_join(F.transform("parts", lambda x: x["xml"]), between).alias("xml"), F.flatten(F.transform("parts", lambda x: x["images"])).alias("images"))
    first = [F.first(f"m_{s}").alias(f"m_{s}") for s in sides]
    pages = pages.groupBy("doc_id", "page_no").agg(whole("row_no"), *first).select("doc_id", "page_no", *put(""), *[f"m_{s}" for s in sides])
    docs = pages.groupBy("doc_id").agg(whole("page_no"), *first).select("doc_id", *put(BREAK if page_breaks else ""), *[f"m_{s}" for s in sides])
    section = _xml(f'<w:sectPr><w:pgSz w:w="{round(SHEET[0] * 20)}" w:h="{round(SHEET[1] * 20)}"/><w:pgMar', *[p for s in sides for p in (f' w:{s}="', _units(F.col(f"m_{s}"), 20), '"')], "/></w:sectPr></w:body></w:document>")
    links = F.array_join(F.array_sort(F.transform("images", lambda x: _xml('<Relationship Id="', x["name"], f'" Type="{REL}/image" Target="media/', x["name"], '.png"/>'))), "")
    part = lambda k, entry, content: F.struct(F.lit(k).alias("idx"), entry.alias("entry"), content.cast("binary").alias("content"))
    fixed = (("[Content_Types].xml", F.lit(TYPES)), ("_rels/.rels", F.lit(ROOT_RELATIONS)), ("word/document.xml", _xml(DOCUMENT, F.col("xml"), section)), ("word/_rels/document.xml.rels", _xml(RELATIONS, links, "</Relationships>")))
    media = F.transform("images", lambda x: part(4, _xml("word/media/", x["name"], ".png"), x["content"]))
    parts = docs.select("doc_id", F.inline(F.concat(F.array(*[part(k, F.lit(entry), content) for k, (entry, content) in enumerate(fixed)]), media)))
    return zipped(parts, group="doc_id")


@F.arrow_udf(T.ArrayType(T.StringType()))
def paragraphs(content: pa.Array) -> pa.Array:
    """The paragraphs of Word files, those of cells too, with tabs and line breaks; null for other files."""
    marks = {f"{{{W}}}tab": "\t", f"{{{W}}}br": "\n"}

    def read(data):
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
            return None
        runs = lambda p: (x for r in p.iter(f"{{{W}}}r") for x in r)
        return ["".join(x.text or "" if x.tag == f"{{{W}}}t" else marks.get(x.tag, "") for x in runs(p)) for p in root.iter(f"{{{W}}}p")]

    return pa.array(map(read, content.to_pylist()), pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def cells_read(content: pa.Array) -> pa.Array:
    """The cells of the tables of Word files in order: runs as ``font/size:text`` joined by |, paragraphs by line feeds, then edges as side, eighths of a point, colour, style."""
    at = lambda name: f"{{{W}}}{name}"

    def font(r) -> str:
        fonts, size = r.find(f"{at('rPr')}/{at('rFonts')}"), r.find(f"{at('rPr')}/{at('sz')}")
        return f"{fonts.get(at('ascii'))}/{size.get(at('val'))}:" + "".join(x.text or "" for x in r.iter(at("t")))

    def cell(tc) -> str:
        edges = tc.find(f"{at('tcPr')}/{at('tcBorders')}")
        drawn = [",".join((e.tag.split("}")[1], e.get(at("sz")), e.get(at("color")), e.get(at("val")))) for e in (edges if edges is not None else ())]
        return "\n".join("|".join(font(r) for r in p.iter(at("r"))) for p in tc.iter(at("p"))) + " [" + " ".join(drawn) + "]"

    def read(data):
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
            return None
        return [cell(tc) for tc in root.iter(at("tc"))]

    return pa.array(map(read, content.to_pylist()), pa.list_(pa.string()))
