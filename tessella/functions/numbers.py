"""Numbers, colours, page ranges and small geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def env_int(raw: Column, default: int, *, low: int = 1, high: int = 64) -> Column:
    """An integer setting: the default where it is no number, within bounds."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(F.trim(raw).try_cast("int"), F.lit(default))))


def env_bool(raw: Column, default: bool = False) -> Column:
    t = F.lower(F.trim(raw))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(default)).otherwise(t.isin("1", "true", "yes", "on"))


def bounded_int(raw: Column, low: int, high: int, default: int | None = None) -> Column:
    """Struct of value and error of a number that must lie within bounds."""
    blank = F.trim(F.coalesce(raw, F.lit(""))) == ""
    n = F.trim(raw).try_cast("int")
    error = F.when(blank, F.lit(None if default is not None else "missing")).when(n.isNull(), "not a number").when((n < low) | (n > high), "out of range")
    return F.struct(F.when(error.isNull(), F.when(blank, F.lit(default)).otherwise(n)).alias("value"), error.alias("error"))


def upper_median(values: Column) -> Column:
    """The middle value, of two the larger; null of none."""
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), F.floor(F.size(values) / 2).cast("int") + 1))


def page_range(spec: Column, total: Column) -> Column:
    """``1-3,5`` as different 0-based pages in the order given; null or blank means all.

    ``error`` says what is wrong: syntax, order or range.
    """
    parts = F.transform(F.split(F.translate(F.coalesce(spec, F.lit("")), "，", ","), ","), lambda x: F.trim(x))
    parts = F.filter(parts, lambda p: p != "")
    shaped = F.forall(parts, lambda p: p.rlike(r"^[0-9]{1,9}(\s*-\s*[0-9]{1,9})?$"))
    lo = lambda p: F.regexp_extract(p, r"^([0-9]+)", 1).try_cast("int")
    hi = lambda p: F.regexp_extract(p, r"([0-9]+)$", 1).try_cast("int")
    ordered = F.forall(parts, lambda p: lo(p) <= hi(p))
    inside = F.forall(parts, lambda p: (lo(p) >= 1) & (hi(p) <= total))
    error = F.when(~shaped, "syntax").when(~ordered, "order").when(~inside, "range")
    # An item that is wrong must not reach sequence(), whatever the order of evaluation.
    bounded = lambda p: F.sequence(F.least(F.greatest(lo(p), F.lit(1)), total), F.greatest(F.least(F.greatest(lo(p), F.lit(1)), total), F.least(hi(p), total)))
    pages = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.transform(bounded(p), lambda k: k - 1))))
    every = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    return F.struct(F.when(error.isNull(), F.when(F.size(parts) == 0, every).otherwise(pages)).alias("pages"), error.alias("error"))


def rgb_hex(channels: Column) -> Column:
    """RRGGBB of one, three or more shares between 0 and 1; null for others."""
    one = lambda c: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.bround(c * 255).cast("int")))), 2, "0")
    grey = one(F.get(channels, F.lit(0)))
    return F.when(F.size(channels) == 1, F.concat(grey, grey, grey)).when(F.size(channels) >= 3, F.array_join(F.transform(F.slice(channels, 1, 3), one), ""))


NAMED = {"white": "ffffff", "black": "000000"}


def parse_colour(text: Column) -> Column:
    """#rgb, #rrggbb, rgb(r, g, b), white or black as an array of three numbers; null if it is none."""
    t = F.lower(F.trim(F.coalesce(text, F.lit("#ffffff"))))
    table = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    short = F.regexp_replace(F.regexp_extract(t, r"^#([0-9a-f]{3})$", 1), "(.)", "$1$1")
    full = F.regexp_extract(t, r"^#([0-9a-f]{6})$", 1)
    digits = F.coalesce(F.try_element_at(table, t), F.nullif(full, F.lit("")), F.nullif(short, F.lit("")))
    from_hex = F.transform(F.array(F.lit(1), F.lit(3), F.lit(5)), lambda k: F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("int"))
    call = r"^rgb\(\s*(-?[0-9]{1,6})\s*,\s*(-?[0-9]{1,6})\s*,\s*(-?[0-9]{1,6})\s*\)$"
    given = F.array(*[F.greatest(F.lit(0), F.least(F.lit(255), F.regexp_extract(t, call, k).try_cast("int"))) for k in (1, 2, 3)])
    return F.when(digits.isNotNull(), from_hex).when(t.rlike(call), given)


def colour_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double")), F.lit(0.0), lambda s, x: s + x))


def scaled_timeout(size: Column, *, base: int = 180, most: int = 600) -> Column:
    """Seconds for a file: the base and 15 for each MiB above two."""
    return F.least(F.lit(base) + F.floor(F.greatest(F.lit(0.0), size / 1048576 - 2) * 15), F.lit(most)).cast("long")


def overlap_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Common area of two boxes (x0, top, x1, bottom)."""
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def area(a: tuple[Column, ...]) -> Column:
    return F.greatest(F.lit(0.0), a[2] - a[0]) * F.greatest(F.lit(0.0), a[3] - a[1])


def overlap_of_first(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.when(area(a) > 0, overlap_area(a, b) / area(a)).otherwise(0.0)


def overlap_of_smaller(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, overlap_area(a, b) / least).otherwise(0.0)


def horizontal_align(x0: Column, x1: Column, width: Column) -> Column:
    """left, center or right of a text span on a page."""
    left, right, middle = F.greatest(x0, F.lit(0.0)), F.greatest(width - x1, F.lit(0.0)), (x0 + x1) / 2 / width
    uneven = F.abs(left - right)
    even = (uneven <= F.greatest(width * 0.12, F.lit(18.0))) | ((middle > 0.38) & (middle < 0.62))
    inset = (left > width * 0.18) | (uneven <= width * 0.12)
    wide = F.greatest(x1 - x0, F.lit(1.0)) / width >= 0.7
    return F.when((width <= 0) | wide, "left").when(even & inset, "center").when((left > right * 2) & (left / width > 0.45), "right").otherwise("left")


def image_align(x0: Column, size: Column, width: Column) -> Column:
    """left, center or right of an image on a page."""
    left, right = F.greatest(x0, F.lit(0.0)), F.greatest(width - x0 - size, F.lit(0.0))
    even = F.abs(left - right) <= F.greatest(width * 0.08, F.lit(12.0))
    return F.when((width <= 0) | (size <= 0), "left").when((size / width >= 0.85) | even, "center").when((left > right * 2) & (left / width > 0.2), "right").otherwise("left")


def soft_gap(gap: Column) -> Column:
    """Vertical gaps pressed together: none below 6, as they are up to 18, then a quarter, 28 at most."""
    return F.when(gap < 6, 0.0).when(gap <= 18, F.least(gap, F.lit(28.0))).otherwise(F.least(12 + (gap - 18) * 0.25, F.lit(28.0)))


def render_dpi(width: Column, height: Column, base: int = 220, most: int = 3500) -> Column:
    """Resolution at which the long edge of a page stays within ``most`` pixels, 96 at least."""
    dpi = max(72, base)
    edge = F.greatest(width * dpi / 72, height * dpi / 72, F.lit(1.0))
    return F.when(edge <= most, F.lit(dpi)).otherwise(F.greatest(F.lit(96), F.floor(F.lit(most) / edge * dpi))).cast("long")


def scale_to_fit(w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    """The one scale at which a box fits; null without a size."""
    return F.when((w > 0) & (h > 0), F.least(to_w / w, to_h / h))


# An A4 sheet in points and the margin kept on it.
A4 = (595.28, 841.89)
MARGIN = 18.0


def half_page(w: Column, h: Column, left: Column, bottom: Column, *, top: bool) -> Column:
    """Affine matrix that centres a page box in the upper or lower half of an A4 sheet; null without a size."""
    half = A4[1] / 2
    room_w, room_h = A4[0] - 2 * MARGIN, half - MARGIN
    s = F.when((w > 0) & (h > 0), F.least(room_w / w, room_h / h))
    x, y = MARGIN + (room_w - w * s) / 2, (half if top else 0.0) + (room_h - h * s) / 2
    return F.struct(s.alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), s.alias("d"), (x - s * left).alias("e"), (y - s * bottom).alias("f"))


def size_statistics(before: Column, after: Column) -> Column:
    """saved bytes, ratio to four places and percent saved to one, half even on exact decimals."""
    b, a = before.cast("decimal(20,0)"), after.cast("decimal(20,0)")
    ratio = F.when(b > 0, F.bround((a / b).cast("decimal(30,12)"), 4))
    percent = F.when(b > 0, F.bround(((b - a) * 100 / b).cast("decimal(30,12)"), 1))
    return F.struct((before - after).cast("long").alias("saved"), ratio.cast("double").alias("ratio"), percent.cast("double").alias("percent"))
