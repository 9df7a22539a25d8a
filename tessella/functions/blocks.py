"""Blocks of a page: edges, indents and titles.  A kind is text, image, line or table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def left_edge(x0: Column) -> Column:
    return F.coalesce(x0, F.lit(0.0))


def right_edge(kind: Column, x0: Column, x1: Column, width: Column, col_widths: Column) -> Column:
    """Images are as wide as their width, tables as their columns together."""
    columns = F.aggregate(F.coalesce(col_widths, F.array().cast("array<double>")), F.lit(0.0), lambda s, w: s + w)
    return F.when(kind == "image", left_edge(x0) + F.coalesce(width, F.lit(0.0))).when(kind == "table", left_edge(x0) + columns).otherwise(F.coalesce(x1, F.lit(0.0)))


def lower_edge(top: Column, bottom: Column) -> Column:
    """The bottom, or the top of what has none."""
    return F.coalesce(F.nullif(bottom, F.lit(0.0)), top, F.lit(0.0))


def indent(x: Column, margin: Column) -> Column:
    """How far right of the margin a place is."""
    return F.greatest(F.lit(0.0), x - margin)


def title_like(kind: Column, align: Column, size: Column, text: Column) -> Column:
    """Centred text in a large font or of 4 to 40 characters."""
    n = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.coalesce((kind == "text") & (align == "center") & ((F.coalesce(size, F.lit(0.0)) >= 12) | n.between(4, 40)), F.lit(False))
