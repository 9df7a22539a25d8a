"""Media types by their first bytes, catalogs, size arithmetic and SVG minifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Signatures as hexadecimal, presets and format names.
SIGNATURES = (("FFD8FF", "jpeg"), ("89504E470D0A1A0A", "png"), ("474946383761", "gif"), ("474946383961", "gif"))
MORE_SIGNATURES = (("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("00000100", "ico"), ("00000200", "ico"))
EXTENSIONS = ((r"\.(jpg|jpeg|jpe|jfif)$", "jpeg"), (r"\.png$", "png"), (r"\.gif$", "gif"))
MORE_EXTENSIONS = ((r"\.webp$", "webp"), (r"\.bmp$", "bmp"), (r"\.tiff?$", "tiff"), (r"\.(ico|cur)$", "ico"))
ALIASES = {"jpg": "jpeg", "jpe": "jpeg", "jfif": "jpeg", "tif": "tiff", "icon": "ico"}
OUTPUT_FORMATS = ("jpeg", "png", "webp", "gif", "bmp", "tiff", "ico")
# Preset: JPEG quality, JPEG subsampling, PNG palette, PNG colours, GIF colours, longest side (0: as it is).
PRESETS = {"high": (90, 0, False, 256, 256, 0), "balanced": (82, 2, True, 256, 192, 0), "strong": (72, 2, True, 192, 128, 2560)}
KNOBS = ("jpeg_quality", "jpeg_subsampling", "png_quantize", "png_colors", "gif_colors", "max_side")
SVG_START = r"(?is)^\x{FEFF}?\s*(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)*(<!DOCTYPE[^>]*>\s*)?<svg[\s>]"


def _head(data: Column, size: int) -> Column:
    return F.hex(F.substring(data, 1, size))


def _is_svg(data: Column) -> Column:
    return F.coalesce(F.decode(F.substring(data, 1, 4096), "ISO-8859-1").rlike(SVG_START.replace(r"\x{FEFF}", "(ï»¿)")), F.lit(False))


def _sniff(data: Column, name: Column, signatures, extensions, webp: bool, svg: str | None) -> Column:
    head, low = _head(data, 16), F.lower(F.coalesce(name, F.lit("")))
    out = F.when(F.coalesce(F.octet_length(data), F.lit(0)) == 0, F.lit(None))
    for mark, kind in signatures:
        out = out.when(head.startswith(mark), F.lit(kind))
    if webp:
        out = out.when(head.rlike("^52494646.{8}57454250"), F.lit("webp"))
    out = out.when(_is_svg(data), F.lit(svg))
    for pattern, kind in extensions:
        out = out.when(low.rlike(pattern), F.lit(kind))
    if svg:
        out = out.when(low.endswith(".svg") & ~head.startswith("1F8B"), F.lit(svg))
    return out


def detect_format(data: Column, name: Column) -> Column:
    """jpeg, png, gif or svg, by content and then by name; null for others and for packed SVG."""
    return _sniff(data, name, SIGNATURES, EXTENSIONS, False, "svg")


def detect_raster(data: Column, name: Column) -> Column:
    """The same for raster formats only; SVG gives null."""
    return _sniff(data, name, SIGNATURES + MORE_SIGNATURES, EXTENSIONS + MORE_EXTENSIONS, True, None)


def normalized_target(name: Column) -> Column:
    """A format to write, aliases resolved; null if there is none of that name."""
    low = F.lower(F.trim(name))
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    known = F.coalesce(F.try_element_at(table, low), low)
    return F.when(known.isin(*OUTPUT_FORMATS), known)


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, f) for k, f in enumerate(OUTPUT_FORMATS)], "pos int, format string")


def preset(name: Column) -> Column:
    """Struct of encoder settings by the name of a preset; blank means balanced, an unknown name gives null."""
    low = F.lower(F.trim(F.coalesce(F.nullif(name, F.lit("")), F.lit("balanced"))))
    return F.coalesce(*[F.when(low == k, F.struct(*[F.lit(v).alias(n) for n, v in zip(KNOBS, values, strict=True)])) for k, values in PRESETS.items()])


def resized(width: Column, height: Column, most: int) -> Column:
    """Width and height with the long side at most ``most``; 0 changes nothing."""
    long = F.greatest(width, height)
    scale = F.lit(float(most)) / long
    side = lambda x: F.greatest(F.lit(1), F.bround(x * scale)).cast("long")
    if most <= 0:
        return F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))
    return F.struct(F.when(long <= most, width).otherwise(side(width)).cast("long").alias("width"), F.when(long <= most, height).otherwise(side(height)).cast("long").alias("height"))


def minify_svg(text: Column, *, comments: bool = False) -> Column:
    """SVG without needless white space; the text itself if that is no longer.  Width and height from the root."""
    out = F.trim(F.regexp_replace(text, "^\ufeff", ""))
    rules = [] if comments else [(r"(?s)<!--.*?-->", "")]
    rules += [(r">\s+<", "><"), (r"[\r\n]+", " "), (r"[ \t]{2,}", " "), (r"\s*=\s*", "="), (r"\s+/>", "/>"), (r"<\s+", "<"), (r"\s+>", ">")]
    for pattern, put in rules:
        out = F.regexp_replace(out, pattern, put)
    out = F.trim(out)
    size = lambda name: F.nullif(F.regexp_extract(out, rf"(?i)<svg\b[^>]*\b{name}\s*=\s*[\"']([\d.]+)", 1), F.lit("")).try_cast("double")
    better = F.octet_length(out) < F.octet_length(text)
    return F.struct(F.when(better, out).otherwise(text).alias("result"), better.alias("smaller"), size("width").alias("width"), size("height").alias("height"))


def least_candidate(candidates: Column) -> Column:
    """The shortest of an array of (bytes, name); of equal ones the first."""
    placed = F.transform(candidates, lambda c, i: F.struct(F.octet_length(c["data"]).alias("n"), i.alias("i"), c["name"].alias("name")))
    return F.array_min(placed)["name"]


# ---------------------------------------------------------------- orientation

# The tag that holds the orientation, the size of a directory's entry, the mark before EXIF data in JPEG and PNG files.
ORIENTATION_TAG, ENTRY_BYTES = 0x0112, 12
EXIF_MARKS = (("FFD8FF", "Exif\0\0"), ("89504E470D0A1A0A", "eXIf"))


def exif_block(data: Column, within: int = 1 << 20) -> Column:
    """The EXIF data of a JPEG, PNG or TIFF file or of itself, from its byte order on; null without any in the first ``within`` bytes."""
    head, text = _head(data, 8), F.decode(F.substring(data, 1, within), "ISO-8859-1")
    at = F.when(head.startswith("49492A00") | head.startswith("4D4D002A"), 1)
    for signature, mark in EXIF_MARKS:
        found = F.instr(text, mark)
        at = at.when(head.startswith(signature) & (found > 0), found + len(mark))
    return F.substr(data, at)


def exif_orientation(data: Column) -> Column:
    """How an image wants to be turned, 1 to 8, by the first directory of its EXIF data; 1 where that says nothing usable."""
    block = exif_block(data)
    little = _head(block, 2) == "4949"

    def number(at: Column, size: int) -> Column:
        digits = F.hex(F.substr(block, at + 1, F.lit(size)))
        turned = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
        return F.when(F.length(digits) == 2 * size, F.conv(F.when(little, turned).otherwise(digits), 16, 10).cast("long"))

    start = number(F.lit(4), 4)
    start = F.when(start < F.length(block), start.cast("int"))
    count = number(start, 2).cast("int")
    places = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: start + 2 + ENTRY_BYTES * k))
    value = number(F.get(F.filter(places, lambda p: number(p, 2) == ORIENTATION_TAG), F.lit(0)) + 8, 2)
    return F.coalesce(F.when(value.between(1, 8), value), F.lit(1)).cast("int")
