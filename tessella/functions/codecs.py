"""Base64 and Unicode-escape codecs as column expressions.

Only the repeated un-escape of Unicode needs a Python worker, since no built-in
replaces a match by a function of it; it runs as an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.let import let

CHARSETS = ("utf-8", "utf-16", "latin-1", "ascii")
STYLES = ("backslash_u", "u_plus", "html_entity", "percent_u")
MODES = ("auto", "backslash_u", "percent_u", "u_plus", "html_entity")
_WHITE = r"(?U)[\s\x1C-\x1F]+"


def _choice(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}")
    return value


def _bytes_of(text: Column, charset: str) -> Column:
    """Bytes of a text; null where the charset cannot hold it."""
    if charset == "utf-8":
        return text.cast("binary")
    if charset == "utf-16":  # byte order mark, then little endian
        return F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))
    top = r"^[\x00-\x7F]*$" if charset == "ascii" else r"^[\x00-\xFF]*$"
    return F.when(text.rlike(top), F.encode(text, "ISO-8859-1"))


# ---------------------------------------------------------------- Base64


def base64_text(data: Column) -> Column:
    """Standard Base64 of bytes on one line."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def encode_base64(text: Column, *, charset: str = "utf-8", variant: str = "standard", wrap: int = 0, binary: bool = False) -> Column:
    """Base64 of a text, or of bytes, as a struct with its counts; null result where the charset cannot hold the text."""
    _choice(charset, CHARSETS, "charset"), _choice(variant, ("standard", "urlsafe"), "variant")
    if wrap < 0:
        raise ValueError("wrap must be >= 0")
    data = text if binary else _bytes_of(text, charset)
    flat = base64_text(data)
    if variant == "urlsafe":
        flat = F.translate(flat, "+/", "-_")

    def whole(flat: Column) -> Column:
        return F.struct(
            (F.regexp_replace(flat, f"(.{{{wrap}}})(?!$)", "$1\n") if wrap else flat).alias("result"),
            F.octet_length(data).cast("long").alias("input_bytes"),
            (F.lit(None) if binary else F.length(text)).cast("long").alias("input_chars"),
            F.length(flat).cast("long").alias("output_chars"),
        )

    return let(flat, whole)


def decode_base64(text: Column, *, charset: str | None = "utf-8", variant: str = "standard", strict: bool = False) -> Column:
    """Base64 to text and hexadecimal bytes.

    Not strict: the alphabet follows what is seen, characters outside it are
    passed over, and padding is repaired.  ``error`` says why there are no bytes.
    """
    _choice(variant, ("standard", "urlsafe"), "variant")
    if charset is not None:
        _choice(charset, CHARSETS, "charset")
    if strict:
        used = lambda clean: F.lit(variant)
    elif variant == "standard":
        used = lambda clean: F.when(clean.rlike("[-_]"), "urlsafe").otherwise("standard")
    else:
        used = lambda clean: F.when(clean.rlike("[+/]"), "standard").otherwise("urlsafe")
    shape = r"^[A-Za-z0-9_-]+={0,2}$" if variant == "urlsafe" else r"^[A-Za-z0-9+/]+={0,2}$"

    def alphabet(x: Column) -> Column:
        only = F.when(x["used"] == "urlsafe", F.translate(x["clean"], "-_+/", "+/")).otherwise(F.translate(x["clean"], "-_", ""))
        return F.regexp_replace(F.regexp_replace(only, "=.*$", ""), "[^A-Za-z0-9+/]", "")

    def decoded(raw: Column) -> Column:
        if charset is None:
            return F.lit(None).cast("string")
        if charset == "utf-8":
            return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
        if charset == "utf-16":
            little = F.hex(F.substring(raw, 1, 2)) == "FFFE"
            even = F.octet_length(raw) % 2 == 0
            return F.when(even, F.decode(F.when(little, F.substring(raw, F.lit(3), F.octet_length(raw))).otherwise(raw), "UTF-16LE"))
        if charset == "ascii":
            return F.when(~F.hex(raw).rlike("^(..)*[89A-F]."), raw.cast("string"))
        return F.decode(raw, "ISO-8859-1")

    def with_body(x: Column) -> Column:
        bad = F.length(x["body"]) % 4 == 1
        if strict:
            bad = bad | ~x["clean"].rlike(shape)
        padded = F.rpad(x["body"], (F.ceil(F.length(x["body"]) / 4) * 4).cast("int"), "=")
        raw = F.when((x["clean"] != "") & ~bad, F.unbase64(padded))
        return F.struct(x["clean"].alias("clean"), x["used"].alias("used"), bad.alias("bad"), raw.alias("raw"))

    def result(x: Column) -> Column:
        bad = x["bad"] | (x["raw"].isNotNull() & x["text"].isNull()) if strict and charset else x["bad"]
        return F.struct(
            F.coalesce(x["text"], F.lit("")).alias("result"),
            F.lower(F.hex(x["raw"])).alias("raw_hex"),
            F.octet_length(x["raw"]).cast("long").alias("raw_bytes"),
            x["used"].alias("variant"),
            x["text"].isNotNull().alias("text_ok"),
            F.pmod(-F.length(x["clean"]), F.lit(4)).cast("long").alias("padding_added"),
            F.when(x["clean"] == "", "empty input").when(bad, "invalid Base64").alias("error"),
        )

    clean = F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE, "")
    seen = let(clean, lambda c: F.struct(c.alias("clean"), used(c).alias("used")))
    body = let(seen, lambda x: F.struct(x["clean"].alias("clean"), x["used"].alias("used"), alphabet(x).alias("body")))
    raw = let(body, with_body)
    return let(let(raw, lambda x: F.struct(x["clean"], x["used"], x["bad"], x["raw"], decoded(x["raw"]).alias("text"))), result)


def probe_base64(text: Column) -> Column:
    """Whether a text looks like Base64, and why not."""
    return let(F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE, ""), _probed)


def _probed(clean: Column) -> Column:
    reason = F.when(clean == "", "empty").when(~clean.rlike(r"^[A-Za-z0-9+/_-]+={0,2}$"), "invalid_alphabet").when(F.length(clean) % 4 == 1, "bad_length")
    return F.struct(reason.isNull().alias("looks_like"), reason.alias("reason"), F.length(clean).cast("long").alias("length"), clean.rlike("[-_]").alias("urlsafe_chars"), clean.rlike("[+/]").alias("standard_chars"))


# ---------------------------------------------------------------- Unicode escapes

# The escape families.
FAMILIES = {
    "backslash_u": (r"\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})", r"\\u\{([0-9a-fA-F]{1,8})\}"),
    "double_backslash_u": (r"\\\\u([0-9a-fA-F]{4})|\\\\U([0-9a-fA-F]{8})", r"\\\\u\{([0-9a-fA-F]{1,8})\}"),
    "percent_u": (r"%u([0-9a-fA-F]{4})",),
    "u_plus": (r"\bU\+([0-9a-fA-F]{1,6})\b",),
    "html_entity": (r"(?i)&#x([0-9a-f]{1,6});", r"&#([0-9]{1,7});"),
}


def code_point(char: Column) -> Column:
    """Code point of a one-character string."""
    return F.conv(F.hex(F.encode(char, "UTF-32")), 16, 10).cast("int")


def char_of(point: Column) -> Column:
    """The character of a code point; null beyond the last one and for surrogates."""
    ok = (point >= 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))


def encode_unicode(text: Column, *, style: str = "backslash_u", uppercase: bool = False) -> Column:
    """Every character beyond ASCII as an escape of the given style."""
    _choice(style, STYLES, "style")

    def one(char: Column) -> Column:
        digits = F.hex(code_point(char).cast("long"))
        digits = digits if uppercase else F.lower(digits)
        small = F.length(digits) <= 4
        four, eight = F.lpad(digits, 4, "0"), F.lpad(digits, 8, "0")
        if style == "u_plus":
            escaped = F.concat(F.lit("U+"), F.when(small, four).otherwise(digits))
        elif style == "html_entity":
            escaped = F.concat(F.lit("&#x"), digits, F.lit(";"))
        else:
            escaped = F.when(small, F.concat(F.lit("%u" if style == "percent_u" else "\\u"), four)).otherwise(F.concat(F.lit("\\U"), eight))
        return F.when(F.octet_length(char) == 1, char).otherwise(escaped)

    joined = F.array_join(F.transform(F.split(text, ""), one), "")
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return let(joined, lambda result: F.struct(result.alias("result"), wide.cast("long").alias("escaped_chars"), F.length(text).cast("long").alias("input_chars"), F.length(result).cast("long").alias("output_chars")))


def probe_unicode(text: Column) -> Column:
    """How often each family occurs, and which do."""
    body = F.coalesce(text, F.lit(""))
    counts = [sum((F.regexp_count(body, F.lit(p)) for p in patterns[1:]), F.regexp_count(body, F.lit(patterns[0]))).cast("long").alias(name) for name, patterns in FAMILIES.items()]
    found = F.array_compact(F.array(*[F.when(c > 0, F.lit(name)) for c, name in zip(counts, FAMILIES, strict=True)]))
    return F.struct(F.struct(*counts).alias("counts"), found.alias("detected"), (F.size(found) > 0).alias("likely"))


def _unescape(match: re.Match, base: int = 16) -> str:
    point = int(next(g for g in match.groups() if g is not None), base)
    if point > 0x10FFFF:
        raise ValueError(f"no such code point: U+{point:X}")
    return chr(point)


def _passes(mode: str):
    """(pattern, replacement) of one pass, in order."""
    compiled = {name: [re.compile(p) for p in patterns] for name, patterns in FAMILIES.items()}
    word, braces = compiled["backslash_u"]
    hexa, decimal = compiled["html_entity"]
    steps = {
        "backslash_u": [(braces, _unescape), (word, _unescape)],
        "percent_u": [(compiled["percent_u"][0], _unescape)],
        "u_plus": [(compiled["u_plus"][0], _unescape)],
        "html_entity": [(hexa, _unescape), (decimal, lambda m: _unescape(m, 10))],
    }
    if mode != "auto":
        return steps[mode]
    # A doubled backslash first becomes a single one; what follows decodes it.
    peel = [(p, lambda m: m[0][1:]) for p in reversed(compiled["double_backslash_u"])]
    return [*peel, *(s for name in ("backslash_u", "percent_u", "u_plus", "html_entity") for s in steps[name])]


def unescape_text(text: str, mode: str = "auto", max_passes: int = 3) -> tuple[str | None, int, int, str | None]:
    """(text, replacements, passes, error); pairs of surrogates are joined, lone ones are an error."""
    total, done, steps = 0, 0, _passes(mode)
    out = text
    try:
        while done < max_passes:
            done += 1
            before, n = out, 0
            for pattern, put in steps:
                out, k = pattern.subn(put, out)
                n += k
            total += n
            if not n or out == before:
                break
        return out.encode("utf-16", "surrogatepass").decode("utf-16"), total, done, None
    except (ValueError, UnicodeError) as error:
        return None, total, done, str(error)


def decode_unicode(text: Column, *, mode: str = "auto", max_passes: int = 3) -> Column:
    """Un-escapes a text until nothing changes, at most ``max_passes`` times."""
    _choice(mode, MODES, "mode")
    if not 1 <= max_passes <= 10:
        raise ValueError("max_passes must be between 1 and 10")

    @F.pandas_udf("result string, replacements long, passes long, error string, changed boolean")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = [(None, 0, 0, "no input", False) if v is None else (*(r := unescape_text(v, mode, max_passes)), r[0] is not None and r[0] != v) for v in values]
        return pd.DataFrame(rows, columns=["result", "replacements", "passes", "error", "changed"])

    return run(text)
