"""Text rules as column expressions: CJK-aware spacing, soft joins, safe names, paths and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.let import let

# Character classes of the layout rules.
CJK = r"\u3000-\u303f\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef"
CJK_PUNCT = "，。！？；：、…—·「」『』【】《》（）'［］｛｝～\u2018\u2019\u201c\u201d"
CLOSERS_BY_CJK = ".,;:!?)]}"
SENTENCE_ENDS = "。！？；：.!?;…"
OPENERS, CLOSERS = "([{<", ")]}>.,;:!?"
LIST_START = r"^\s*(?:\d{1,3}[、.．)）]|[（(]\d{1,3}[)）]|[一二三四五六七八九十百]+[、.．]|[•·▪◦●○◆◇■□])"
ODD_SPACE = r"[\u00a0\u2000-\u200b\u202f\u205f\u3000]+"


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[{CJK}]"), F.lit(False))


def _first(text: Column) -> Column:
    return F.substring(text, 1, 1)


def _last(text: Column) -> Column:
    return F.right(text, F.lit(1))


def _in(chars: str, c: Column) -> Column:
    return (c != "") & F.contains(F.lit(chars), c)


def _cjk_like(c: Column) -> Column:
    """A CJK character or a mark that sits close to one."""
    return has_cjk(c) | _in(CJK_PUNCT + CLOSERS_BY_CJK, c)


def _alnum(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]") & ~has_cjk(c)


def normalize_spacing(text: Column) -> Column:
    """Odd spaces become plain ones; none between CJK, by CJK marks, digits and short Latin codes."""
    punct = CJK_PUNCT.replace("[", r"\[").replace("]", r"\]")
    # One alternation does a pass over text that the separate rules would make in turn; three passes settle chains.
    rules = [
        (rf"(?<=[{CJK}]) +(?=[{CJK}])", ""),
        (rf" +(?=[{punct}])", ""),
        (rf"(?<=[{punct}]) +", ""),
        (rf"(?<=[{CJK}]) +(?=\d)|(?<=\d) +(?=[{CJK}])", ""),
        (rf"(?<=[{CJK}]) +([A-Za-z]{{1,4}})(?![A-Za-z])", "$1"),
        (rf"(?<![A-Za-z])([A-Za-z]{{1,4}}) +(?=[{CJK}])", "$1"),
    ]
    out = F.regexp_replace(text, ODD_SPACE, " ")
    settled = out
    for _ in range(3):
        for pattern, put in rules:
            settled = F.regexp_replace(settled, pattern, put)
    # Most texts have neither CJK nor its marks and skip the passes.
    return F.regexp_replace(F.when(out.rlike(f"[{CJK}{punct}]"), settled).otherwise(out), " {2,}", " ")


def ends_sentence(text: Column) -> Column:
    return _in(SENTENCE_ENDS, _last(F.rtrim(F.coalesce(text, F.lit("")))))


def starts_list_item(text: Column) -> Column:
    return F.coalesce(text.rlike(LIST_START), F.lit(False))


def looks_full_line(text: Column) -> Column:
    """Long enough to be a wrapped line and no label."""
    t = F.trim(F.coalesce(text, F.lit("")))
    cjk = F.regexp_count(t, F.lit(f"[{CJK}]"))
    return F.when(t.endswith("-") & (F.length(t) >= 4), True).when(cjk > 0, (cjk >= 12) | (F.length(t) >= 18)).otherwise(F.length(t) >= 36)


def soft_join(left: Column, right: Column, *, normalized: bool = False) -> Column:
    """Two fragments of one wrapped line as one: hyphens close up, CJK stays tight, Latin gets a space."""
    clean = (lambda c: c) if normalized else normalize_spacing

    def joined(a: Column, b: Column) -> Column:
        z, s = _last(a), _first(b)
        hyphen = a.endswith("-") & s.rlike(r"\p{L}") & ~has_cjk(s)
        tight = (_cjk_like(z) & (_cjk_like(s) | s.rlike(r"[\p{L}\p{N}]"))) | _cjk_like(s) | _in(OPENERS, s) | _in(CLOSERS, z)
        whole = F.when(hyphen, F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)).when(tight, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))
        return F.when(a == "", b).when(b == "", a).otherwise(whole if normalized else let(whole, normalize_spacing))

    # each side is cleaned once, however often it is named
    return let(F.rtrim(clean(F.coalesce(left, F.lit("")))), lambda a: let(F.ltrim(clean(F.coalesce(right, F.lit("")))), lambda b: joined(a, b)))


def normalize_newlines(text: Column) -> Column:
    """Line breaks of wrapping go; those after a sentence or before a list item stay.

    A break is judged by the last mark before it, which is the line break itself
    after a blank line, and by the line that follows; so all breaks of a text
    are judged at once.
    """
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), normalize_spacing)

    def joined(lines: Column) -> Column:
        ends = F.transform(lines, lambda line, i: F.when((F.ltrim(line) == "") & (i > 0), "\n").otherwise(_last(F.rtrim(line))))
        starts = F.transform(lines, lambda line: F.ltrim(line))
        before = F.concat(F.array(F.lit("")), F.slice(ends, F.lit(1), F.size(ends) - 1))

        def seam(z: Column, b: Column) -> Column:
            """What a break becomes: a line break, nothing in place of a hyphen (-), nothing, or a space."""
            s = _first(b)
            soft = (z != "") & (b != "") & ~_in(SENTENCE_ENDS, z) & ~starts_list_item(b)
            hyphen = (z == "-") & s.rlike(r"\p{L}") & ~has_cjk(s)
            tight = (_cjk_like(z) & (_cjk_like(s) | s.rlike(r"[\p{L}\p{N}]"))) | _cjk_like(s) | _in(OPENERS, s) | _in(CLOSERS, z)
            return F.when(~soft, "\n").when(hyphen, "-").when(tight, "").otherwise(" ")

        return let(F.zip_with(before, starts, seam), lambda seams: laid(lines, starts, seams))

    def laid(lines: Column, starts: Column, seams: Column) -> Column:
        after = F.concat(F.slice(seams, F.lit(2), F.size(seams) - 1), F.array(F.lit("end")))
        bodies = F.concat(F.slice(lines, 1, 1), F.slice(starts, F.lit(2), F.size(starts) - 1))
        rows = F.arrays_zip(seams.alias("seam"), after.alias("after"), bodies.alias("body"))

        def piece(row: Column, i: Column) -> Column:
            # a last line that was joined keeps its spaces, as nothing follows that would close them up
            whole = (row["after"] == "end") & ((i == 0) | (row["seam"] != "\n"))
            body = F.when(whole, row["body"]).otherwise(F.rtrim(row["body"]))
            cut = F.when(row["after"] == "-", F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
            return F.when((i == 0) | (row["seam"] == "-"), cut).otherwise(F.concat(row["seam"], cut))

        return F.array_join(F.transform(rows, piece), "")

    return let(lines, joined)


# ---------------------------------------------------------------- names, paths, headers


def _base_name(name: Column) -> Column:
    return F.element_at(F.split(F.coalesce(name, F.lit("")), "/"), -1)


def _parts(name: Column) -> tuple[Column, Column]:
    """Stem and extension; leading dots start no extension."""
    base = _base_name(name)
    ext = F.when(base.rlike(r"^\.*[^.].*\.[^.]*$|^\.*[^.]\.[^.]*$"), F.regexp_extract(base, r"(\.[^.]*)$", 1)).otherwise("")
    return F.substring(base, F.lit(1), F.length(base) - F.length(ext)), ext


def safe_stem(name: Column, *, default: str = "output", most: int = 80) -> Column:
    """The name without folder and extension, of word characters, dots and hyphens."""
    stem = F.regexp_replace(_parts(name)[0], r"(?U)[^\w\u4e00-\u9fff.\-]+", "_")
    stem = F.regexp_replace(stem, r"^[._]+|[._]+$", "")
    return F.substring(F.when(stem == "", F.lit(default)).otherwise(stem), 1, most)


def safe_name(name: Column, *, default: str = "file", stem: int = 80, suffix: int = 12) -> Column:
    """A safe stem and the extension's word characters, each cut to a length."""
    ext = F.substring(F.regexp_replace(_parts(name)[1], r"(?U)[^\w.]", ""), 1, suffix)
    return F.concat(safe_stem(name, default=default, most=stem), ext)


def ascii_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r'[^ -~]|[\\";]', "_"), "_+", "_")


def percent_encoded(text: Column) -> Column:
    """RFC 5987 value: only letters, digits and -._~ stay."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def content_disposition(name: Column, *, kind: str = "inline") -> Column:
    return F.concat(F.lit(f'{kind}; filename="'), ascii_name(name), F.lit("\"; filename*=UTF-8''"), percent_encoded(name))


def root_path(raw: Column) -> Column:
    """A prefix with a leading and no trailing slash; blank for the root."""
    bare = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "^/+|/+$", "")
    return F.when(bare == "", "").otherwise(F.concat(F.lit("/"), bare))


def join_url(root: Column, path: Column) -> Column:
    return F.concat(root_path(root), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def rule_errors(text: Column, rules: dict[str, Column]) -> Column:
    """Names of the broken rules; ``rules`` gives for each whether it holds."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


# Passwords that everybody tries.
WEAK = ("admin", "admin123", "password", "123456", "12345678", "changeme", "secret", "test", "root", "qwerty")


def password_errors(password: Column, least: int = 10) -> Column:
    """Names of the rules that a password breaks."""
    p = F.coalesce(password, F.lit(""))
    letter, digit, mark = p.rlike(r"[A-Za-z\u4e00-\u9fff]"), p.rlike(r"\d"), p.rlike(r"[^A-Za-z0-9\u4e00-\u9fff]")
    return rule_errors(p, {"too short": F.length(p) >= least, "common": ~F.lower(p).isin(*WEAK), "digits only": ~p.rlike(r"^\d+$"), "needs a digit or symbol": ~letter | digit | mark, "needs a letter": letter | ~digit})


def secret_errors(secret: Column, least: int = 16) -> Column:
    s = F.coalesce(secret, F.lit(""))
    return rule_errors(s, {"too short": F.length(s) >= least, "weak": ~F.lower(s).isin(*WEAK, "test-secret")})


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern that is found."""
    out = None
    for pattern, name in rules:
        out = (F if out is None else out).when(text.rlike(pattern), F.lit(name))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


# Families by a part of an embedded font's name.
FAMILIES = {"simsun": "宋体", "simhei": "黑体", "microsoftyahei": "微软雅黑", "stsong": "华文宋体", "stxihei": "华文细黑", "stkaiti": "华文楷体", "kaiti": "楷体", "fangsong": "仿宋"}


def font_family(name: Column, default: str = "宋体") -> Column:
    """The family an embedded font stands for, without its subset prefix."""
    bare = F.when(F.contains(name, F.lit("+")), F.regexp_extract(name, r"^[^+]*\+(.*)$", 1)).otherwise(name)
    out = F.when(F.coalesce(name, F.lit("")) == "", F.lit(default))
    for part, family in FAMILIES.items():
        out = out.when(F.contains(F.lower(bare), F.lit(part)), F.lit(family))
    return out.otherwise(bare)


def is_bold(name: Column) -> Column:
    return F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit("bold"))


def text_statistics(text: Column) -> Column:
    """chars, chars_no_ws, lines and words (CJK characters and runs of ASCII word characters)."""
    t = F.coalesce(text, F.lit(""))
    unified = F.regexp_replace(t, r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", "\n")
    lines = F.when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(unified, "\n$", ""), "\n")))
    words = F.regexp_count(t, F.lit(r"[一-鿿]")) + F.regexp_count(t, F.lit("[A-Za-z0-9_]+"))
    return F.struct(F.length(t).cast("long").alias("chars"), F.length(F.regexp_replace(t, r"(?U)[\s\x1C-\x1F]+", "")).cast("long").alias("chars_no_ws"), lines.cast("long").alias("lines"), words.cast("long").alias("words"))
