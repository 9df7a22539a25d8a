"""Amounts of money in the capital Chinese numerals of cheques, without a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.let import let

# The numerals and units of the notation.
DIGITS = ("零", "壹", "贰", "叁", "肆", "伍", "陆", "柒", "捌", "玖")
PLACES = ("仟", "佰", "拾", "")
SECTIONS = ("兆", "亿", "万", "")
LARGEST = "9999999999999999.99"


def normalized(raw: Column) -> Column:
    """ASCII digits without separators, currency signs and one leading plus."""
    clean = F.translate(F.trim(F.coalesce(raw, F.lit(""))), "０１２３４５６７８９．", "0123456789.")
    return F.regexp_replace(F.regexp_replace(clean, r"(?U)[\s,，￥¥元]", ""), r"^\+", "")


def _digit(d: Column) -> Column:
    return F.substring(F.lit("".join(DIGITS)), d.cast("int") + 1, F.lit(1))


def _section(four: Column) -> Column:
    """Four decimal digits with their places; zeros between digits become one, others nothing."""
    spelled = F.concat(*[F.when(F.substring(four, k + 1, 1) == "0", DIGITS[0]).otherwise(F.concat(_digit(F.substring(four, k + 1, 1)), F.lit(p))) for k, p in enumerate(PLACES)])
    return F.regexp_replace(F.regexp_replace(spelled, "零+", "零"), "^零|零$", "")


def _whole(sixteen: Column) -> Column:
    """Sixteen digits, section by section.

    A section after the first gets a zero before it if the section above it is
    empty or if it has no thousands.
    """
    fours = F.transform(F.sequence(F.lit(0), F.lit(len(SECTIONS) - 1)), lambda k: F.struct(k.alias("k"), F.substring(sixteen, k * 4 + 1, F.lit(4)).alias("four"), F.substring(sixteen, F.lit(1), k * 4).alias("above")))
    units = F.array(*[F.lit(u) for u in SECTIONS])

    def part(x: Column) -> Column:
        zero = x["above"].rlike("[1-9]") & (x["above"].endswith("0000") | x["four"].startswith("0"))
        return F.when(x["four"] != "0000", F.concat(F.when(zero, DIGITS[0]).otherwise(""), _section(x["four"]), F.get(units, x["k"]))).otherwise("")

    return F.when(sixteen == "0" * 16, DIGITS[0]).otherwise(F.array_join(F.transform(fours, part), ""))


def to_capital_money(raw: Column, *, prefix: bool = True) -> Column:
    """A text or number as money text: struct of result, amount, yuan, jiao, fen and error.

    Rounds half up to two places.  ``error``: empty, negative, invalid or too large.
    """

    def checked(x: Column) -> Column:
        clean, value = x["clean"], x["value"]
        error = (
            F.when(clean == "", "empty")
            .when(clean.startswith("-"), "negative")
            .when(~clean.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") | value.isNull(), F.when(clean.rlike(r"^[0-9]{17,}(\.[0-9]*)?$"), "too large").otherwise("invalid"))
            .when(value > F.lit(LARGEST).cast("decimal(38,18)"), "too large")
        )
        return let(error, lambda e: F.struct(e.alias("error"), F.when(e.isNull(), F.round(value, 2).cast("decimal(20,2)")).alias("cents")))

    def spelled(x: Column) -> Column:
        jiao, fen = F.substring(x["digits"], 17, 1), F.substring(x["digits"], 18, 1)
        tail = (
            F.when((jiao == "0") & (fen == "0"), "整")
            .when(jiao == "0", F.concat(F.lit("零"), _digit(fen), F.lit("分")))
            .when(fen == "0", F.concat(_digit(jiao), F.lit("角")))
            .otherwise(F.concat(_digit(jiao), F.lit("角"), _digit(fen), F.lit("分")))
        )
        result = F.concat(F.lit("人民币" if prefix else ""), _whole(F.substring(x["digits"], 1, 16)), F.lit("元"), tail)
        return F.struct(F.when(x["error"].isNull(), result).alias("result"), x["cents"].cast("string").alias("amount"), F.floor(x["cents"]).cast("long").alias("yuan"), jiao.cast("long").alias("jiao"), fen.cast("long").alias("fen"), x["error"].alias("error"))

    read = let(normalized(raw.cast("string")), lambda c: F.struct(c.alias("clean"), c.try_cast("decimal(38,18)").alias("value")))
    digits = let(let(read, checked), lambda x: F.struct(x["error"], x["cents"], F.lpad(F.regexp_replace(x["cents"].cast("string"), r"\.", ""), 18, "0").alias("digits")))
    return let(digits, spelled)
