"""Names inside PDF objects and messages about files that do not open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour space names, the first found counts; parts of names that tell a kind; signs of a lock.
SPACES = ("DeviceRGB", "DeviceGray", "DeviceCMYK", "ICCBased", "Indexed", "CalRGB", "CalGray")
KINDS = (("cmyk", "cmyk"), ("gray|grey", "gray"), ("rgb|icc", "rgb"), ("index", "indexed"))
LOCKED = "password|encrypt|crypt"


def object_name(value: Column) -> Column:
    """A name without its slash; a colour space in other words is its plain name; null gives an empty one."""
    bare = F.regexp_replace(F.coalesce(value, F.lit("")), "^/", "")
    return F.coalesce(*[F.when(F.contains(bare, F.lit(s)), F.lit(s)) for s in SPACES], F.trim(bare))


def colour_kind(space: Column) -> Column:
    """cmyk, gray, rgb, indexed or the name itself, of an array whose first item names the space."""
    name = F.lower(object_name(F.get(space, F.lit(0))))
    return F.coalesce(*[F.when(name.rlike(part), F.lit(kind)) for part, kind in KINDS], name)


def filter_names(filters: Column) -> Column:
    """The names of a stream's filters; none of null."""
    return F.coalesce(F.transform(filters, object_name), F.array().cast("array<string>"))


def open_error(message: Column) -> Column:
    """What to tell about a file that does not open."""
    text = F.coalesce(message, F.lit(""))
    return F.when(F.lower(text).rlike(LOCKED), "PDF is password-protected; please decrypt it first").otherwise(F.concat(F.lit("Cannot open PDF: "), text))
