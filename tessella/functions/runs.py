"""Text runs: pieces of a paragraph, each in one font.

A run is a struct of text, font_size and font_name; a paragraph is an array of
runs.  Null and empty runs carry nothing and go.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.let import let
from tessella.functions.text import soft_join

RUN = "struct<text:string,font_size:double,font_name:string>"


def filled(runs: Column) -> Column:
    """The runs that have text."""
    return F.filter(F.coalesce(runs, F.array().cast(f"array<{RUN}>")), lambda r: F.coalesce(F.length(r["text"]) > 0, F.lit(False)))


def runs_text(runs: Column) -> Column:
    return F.array_join(F.transform(filled(runs), lambda r: r["text"]), "")


def paragraphs_text(paragraphs: Column) -> Column:
    """Paragraphs as lines; an empty one is an empty line."""
    return F.array_join(F.transform(paragraphs, runs_text), "\n")


def merged(left: Column, right: Column) -> Column:
    """One run list of two: the runs that meet become one, joined as a wrapped line is.

    It has the font of the left one, or what the right one has where that is missing.
    """

    def meet(a: Column, b: Column) -> Column:
        z, s = F.element_at(a, -1), F.element_at(b, 1)
        size = F.coalesce(F.nullif(z["font_size"], F.lit(0.0)), s["font_size"])
        name = F.coalesce(F.nullif(z["font_name"], F.lit("")), s["font_name"])
        one = F.struct(soft_join(z["text"], s["text"]).alias("text"), size.alias("font_size"), name.alias("font_name")).cast(RUN)
        return F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(one), F.slice(b, F.lit(2), F.size(b)))

    return let(filled(left), lambda a: let(filled(right), lambda b: F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).otherwise(meet(a, b))))
