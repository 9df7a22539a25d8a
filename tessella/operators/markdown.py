"""Markdown to sanitised HTML: texts into lines, lines into blocks, blocks into HTML.

A text stays one row with an array of its blocks, so nothing is shuffled.  Which
lines belong together depends on the lines before and is found by one pass over
them in a worker, many texts at a time.  Marks within a line are column
expressions: code, tags and links are taken out first, so that emphasis and
quotes never touch them.

Not done: paragraphs within list items, reference links, footnotes, nested
tables.  Private characters U+E000 are dropped, as one marks what was taken out.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.let import let

#: Longer texts are an error of ``rendered``, unless it is told otherwise.
MOST_CHARS = 512 * 1024

# What may stay in the HTML.
TAGS = "a abbr acronym b blockquote br code dd del details div dl dt em h1 h2 h3 h4 h5 h6 hr i img ins kbd li ol p pre samp span strong sub summary sup table tbody td th thead tr ul var".split()
ATTRIBUTES = "align alt class colspan height href id name rel rowspan src title width".split()
SCHEMES = "http https mailto data".split()

# what . and $ are to Java's expressions
_ANY, _END = r"[^\n\r\x85\u2028\u2029]", r"(?=[\x85\u2028\u2029]?\Z)"
_FENCE = re.compile(rf"(`{{3,}}|~{{3,}}) *([\w#.+-]*) *{_END}", re.ASCII)
_QUOTES = re.compile(r"(?: {0,3}> ?)*")
_RULE = re.compile(rf" {{0,3}}(?:-(?: {{0,2}}-){{2,}}|_(?: {{0,2}}_){{2,}}|\*(?: {{0,2}}\*){{2,}}) {{0,2}}{_END}")
_ITEM = re.compile(rf"( *)([*+-]|[0-9]+\.) +({_ANY}*){_END}")
_HEADING = re.compile(rf"(#{{1,6}})({_ANY}*?)#*\s*{_END}", re.ASCII)
_DELIMITER = re.compile(rf" *+\|? *:?-+:? *(?:\| *:?-+:? *)*\|? *{_END}")
_UNDERLINE = re.compile(rf"(?:=+|-+) *{_END}")

_HOLE = "\ue000"
_LINK = r"""!?\[[^\]\n]*\]\([^()\s]*(?:\s+"[^"\n]*")?\)"""
_TAKEN = "|".join((r"(`+)(?!`)[\s\S]+?(?<!`)\1(?!`)", r"\\[\\`*_{}\[\]()#+.!|>~-]", _LINK, r"<(?:https?|mailto):[^\s<>]+>", r"""</?[A-Za-z][^\s>/]*(?:[^>"']|"[^"]*"|'[^']*')*>"""))
_ATTRIBUTE = r"""(?i)\b[a-z][a-z0-9-]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
_SAFE = rf"(?i)^(?:(?:{'|'.join(SCHEMES)}):|[^:&]*$|[^:&]*[/?#])"


#: A text to try the renderer on.
SAMPLE = """# Sheet

Plain words, **strong** ones and *stressed* ones, a [place](https://example.org) and `code`.

| mark | meaning |
|------|---------|
| `#`  | heading |
| `>`  | quote   |

- one
- two
    1. first
    2. second

> What was said.

```python
print("done")
```

---
"""


def sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("sample", SAMPLE)], "name string, text string")


def _replaced(text: Column, holds: str, pattern: str, put: str) -> Column:
    """Text with a pattern replaced; only a text that holds what the pattern needs is searched for it."""
    return let(text, lambda t: F.when(t.contains(holds), F.regexp_replace(t, pattern, put)).otherwise(t))


def escaped(text: Column) -> Column:
    """Text with the characters of markup as entities; entities stay."""
    out = _replaced(text, "&", r"&(?!#?\w+;)", "&amp;")
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _emphasis(text: Column) -> Column:
    for holds, pattern, put in (("**", r"\*\*(?=\S)(.+?)(?<=\S)\*\*", "<strong>$1</strong>"), ("__", r"(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)", "<strong>$1</strong>"), ("*", r"\*(?=\S)(.+?)(?<=\S)\*", "<em>$1</em>"), ("_", r"(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)", "<em>$1</em>")):
        text = _replaced(text, holds, f"(?s){pattern}", put)
    return text


def _typographic(text: Column) -> Column:
    for marks, put in (("---", "—"), ("--", "–"), ("...", "…")):
        text = F.replace(text, F.lit(marks), F.lit(put))
    for mark, pattern, opens, closes in (('"', r'(^|[\s(\[])"', "$1“", "”"), ("'", r"(^|[\s(\[“])'", "$1‘", "’")):
        text = F.replace(_replaced(text, mark, pattern, opens), F.lit(mark), F.lit(closes))
    return text


def _quoted(value: Column) -> Column:
    return F.replace(escaped(value), F.lit('"'), F.lit("&quot;"))


def _tag(piece: Column) -> Column:
    """A tag as it may stay: its name and safe attributes; nothing of a tag that may not."""
    name = F.lower(F.regexp_extract(piece, r"^</?([A-Za-z0-9]+)", 1))

    def kept(a: Column) -> Column:
        key, value = F.lower(F.regexp_extract(a, r"^([\w-]+)", 1)), F.regexp_replace(F.regexp_extract(a, r"=\s*([\s\S]*)$", 1), r"""^["']|["']$""", "")
        fine = key.isin(*ATTRIBUTES) & (~key.isin("href", "src") | F.regexp_replace(value, r"[\s\x00-\x1f]", "").rlike(_SAFE))
        return F.when(fine, F.concat(F.lit(" "), key, F.lit('="'), _quoted(value), F.lit('"'))).otherwise("")

    attributes = F.array_join(F.transform(F.regexp_extract_all(piece, F.lit(_ATTRIBUTE), F.lit(0)), kept), "")
    return F.when(~name.isin(*TAGS), "").when(piece.startswith("</"), F.concat(F.lit("</"), name, F.lit(">"))).otherwise(F.concat(F.lit("<"), name, attributes, F.lit(">")))


def _anchor(url: Column, body: Column, title: Column) -> Column:
    about = F.when(title != "", F.concat(F.lit(' title="'), _quoted(title), F.lit('"'))).otherwise("")
    at = F.when(url.rlike(_SAFE), F.concat(F.lit(' href="'), _quoted(url), F.lit('"'), about, F.lit(' rel="nofollow" target="_blank"'))).otherwise(about)
    return F.concat(F.lit("<a"), at, F.lit(">"), body, F.lit("</a>"))


def _put_back(piece: Column) -> Column:
    """The HTML of something that was taken out: code, escaped character, image, link, address or tag."""
    link = r"""^!?\[([^\]\n]*)\]\(([^()\s]*)(?:\s+"([^"\n]*)")?\)$"""
    words, url, title = (F.regexp_extract(piece, link, k) for k in (1, 2, 3))
    source = F.when(url.rlike(_SAFE), F.concat(F.lit(' src="'), _quoted(url), F.lit('"'))).otherwise("")
    image = F.concat(F.lit('<img alt="'), _quoted(words), F.lit('"'), source, F.when(title != "", F.concat(F.lit(' title="'), _quoted(title), F.lit('"'))).otherwise(""), F.lit(">"))
    address = F.regexp_replace(piece, "^<|>$", "")
    code = F.replace(F.regexp_replace(F.regexp_replace(piece, r"^`+|`+$", ""), r"^\s+|\s+$", ""), F.lit("&"), F.lit("&amp;"))
    return (
        F.when(piece.startswith("`"), F.concat(F.lit("<code>"), escaped(code), F.lit("</code>")))
        .when(piece.startswith("\\"), escaped(F.substr(piece, F.lit(2))))
        .when(piece.startswith("!"), image)
        .when(piece.startswith("["), _anchor(url, _emphasis(escaped(words)), title))
        .when(piece.rlike("^<(?:https?|mailto):"), _anchor(address, escaped(address), F.lit("")))
        .otherwise(_tag(piece))
    )


def inline(text: Column) -> Column:
    """The HTML of marks within a text; a line end is a break."""

    def whole(t: Column) -> Column:
        some = t.contains("`") | t.contains("\\") | t.contains("[") | t.contains("<")  # one of them is in whatever is taken out
        taken = F.transform(F.regexp_extract_all(t, F.lit(_TAKEN), F.lit(0)), _put_back)
        rest = _emphasis(_typographic(escaped(F.when(some, F.regexp_replace(t, _TAKEN, _HOLE)).otherwise(t))))
        joined = lambda r: F.array_join(F.zip_with(F.split(r, _HOLE), taken, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
        return let(F.replace(rest, F.lit("\n"), F.lit("<br>\n")), lambda r: F.when(some, joined(r)).otherwise(r))

    return let(F.replace(text, F.lit(_HOLE), F.lit("")), whole)


# ---------------------------------------------------------------- lines and blocks


def _lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", "    ").split("\n")


def _fences(lines: list[str]) -> dict[int, str]:
    """Where code opens and closes by line number.  A fence that nothing closes is text."""
    marks = [(no, *m.groups()) for no, line in enumerate(lines) if line[:1] in ("`", "~") and (m := _FENCE.match(line))]
    last = {mark: no for no, mark, language in marks if not language}
    found, open_mark = {}, None
    for no, mark, language in marks:
        if open_mark is None and last.get(mark, -1) > no:
            found[no], open_mark = "open", mark
        elif not language and mark == open_mark:
            found[no], open_mark = "close", None
    return found


def _parts(lines: list[str]) -> list[list[tuple[str, int, str | None, str | None]]]:
    """Lines that show, as what is left of the line, quote marks before it, fence and what it is alone.

    A part starts after a blank line, and at and after whatever stands alone.
    """
    fences, parts, inside, before, after_blank = _fences(lines), [], False, None, True
    for no, line in enumerate(lines):
        fence = fences.get(no)
        if inside or fence:
            inside, rest, own, alone = fence != "close", line, 0, "fence"
        else:
            prefix = _QUOTES.match(line)[0]
            rest, own = line[len(prefix) :], prefix.count(">")
            if not rest.strip(" "):
                before, after_blank = None, True
                continue
            alone = "rule" if _RULE.match(rest) else "heading" if _HEADING.match(rest) else None
        if after_blank or alone in ("rule", "heading") or fence == "open" or (before and alone != "fence"):
            parts.append([])
        parts[-1].append((rest, own, fence, alone))
        before, after_blank = alone, False
    return parts


def _kind(rests: list[str]) -> str:
    """What the first line says that the lines of a part are."""
    head, second = rests[0], rests[1] if len(rests) > 1 else ""
    indented = head.startswith("    ")
    if not indented and _ITEM.match(head):
        return "list"
    if "|" in head and "|" in second and _DELIMITER.match(second):
        return "table"
    return "code" if indented else "setext" if _UNDERLINE.match(second) else "paragraph"


def _blocks_of(text: str) -> list[tuple[str, int, list[tuple[str, str | None]]]]:
    """Kind, quote depth and lines (what is left of them, and fence) of each block.

    Kinds are heading, rule, fence, code, list, table and paragraph.  Between
    blank lines the first line says what the following ones are, until a
    heading or rule.
    """
    found, known = [], None
    for part in _parts(_lines_of(text)):
        whole, depth = part[0][3] or _kind([line[0] for line in part[:2]]), 0
        for place, (rest, own, fence, _) in enumerate(part):
            depth = max(depth, own)
            # an underlined line is a heading of its own; what follows it in the part is a paragraph
            kind = whole if whole != "setext" else "heading" if place < 2 else "paragraph"
            # indented lines after a list go on with it
            if kind != "code":
                known = kind
            elif known == "list":
                kind = "list"
            if not (found and found[-1][:2] == (kind, depth) and (place or kind in ("list", "code"))):
                found.append((kind, depth, []))
            found[-1][2].append((rest, fence))
    return found


def _items(rests: list[str]) -> list[tuple[str, str, str]]:
    """List items: the tags before, their text and the tags after; lines that are no item belong to the one before."""
    found: list[tuple[int, str, list[str]]] = []
    for rest in rests:
        if m := _ITEM.match(rest):
            found.append((len(m[1]) // 4, "ol" if m[2][0].isdigit() else "ul", [m[3]]))
        elif found:
            found[-1][2].append(rest.strip(" "))
        else:
            found.append((0, "ul", [rest.strip(" ")]))
    out, stack = [], []
    for (raw, tag, words), (next_raw, next_tag, _) in zip(found, [*found[1:], (None, None, None)], strict=True):
        level, opened, closed = min(raw, len(stack) - 1) if len(stack) > raw else len(stack), "", []
        if level == len(stack):
            stack.append(tag)
            opened = f"<{tag}>\n"
        upcoming = -1 if next_raw is None else min(next_raw, len(stack))
        if upcoming == len(stack):
            out.append((opened, "\n".join(words), "\n"))
            continue
        closed.append("</li>")
        while len(stack) - 1 > upcoming:
            closed.append(f"</{stack.pop()}>" + ("</li>" if stack else ""))
        if stack and next_tag is not None and stack[-1] != next_tag:
            closed.append(f"</{stack.pop()}>")
        out.append((opened, "\n".join(words), "\n".join(closed).replace("></li>", ">\n</li>")))
    return out


def _heading(lines: list[str], seen: dict[str, int]) -> tuple[int, str, str]:
    """Level, mark and title of a heading; marks that are seen again are numbered."""
    if m := _HEADING.match(lines[0]):
        level, title = len(m[1]), m[2].strip(" ")
    else:
        level, title = 1 if len(lines) > 1 and lines[1].startswith("=") else 2, lines[0].strip(" ")
    slug = re.sub(r"(?a)[\s-]+", "-", re.sub(r"(?a)[^a-z0-9_\s-]", "", title.lower()).strip(" "))
    again = seen.get(slug, 1 if slug == "" else 0)
    seen[slug] = again + 1
    return level, f"{slug}_{again}" if again else slug, title


_ITEM_TYPE = T.StructType([T.StructField(c, T.StringType()) for c in ("opened", "text", "closed")])
_BLOCK_TYPE = T.StructType([
    *(T.StructField(c, kind()) for c, kind in (("kind", T.StringType), ("depth", T.IntegerType), ("opens", T.IntegerType), ("closes", T.IntegerType), ("level", T.IntegerType), ("mark", T.StringType), ("head", T.StringType), ("body", T.StringType))),
    T.StructField("rows", T.ArrayType(T.StringType())), T.StructField("items", T.ArrayType(_ITEM_TYPE)),
])


def _records(text: str) -> list[tuple]:
    """The blocks of a text as ``_BLOCK_TYPE``: the mark is a fence's language too, and the body a heading's title."""
    found, out, seen = _blocks_of(text), [], {}
    depths = [0, *(depth for _, depth, _ in found), 0]
    for k, (kind, depth, lines) in enumerate(found, 1):
        rests = [rest for rest, _ in lines]
        level, mark, body, rows, items = None, None, None, [], []
        if kind == "heading":
            level, mark, body = _heading(rests, seen)
        elif kind == "fence":
            mark, body = _FENCE.match(rests[0])[2], "\n".join(rest for rest, fence in lines if fence is None)
        elif kind == "table":
            rows = rests[2:]
        elif kind == "list":
            items = _items(rests)
        else:
            body = "\n".join(rests)
        out.append((kind, depth, max(0, depth - depths[k - 1]), max(0, depth - depths[k + 1]), level, mark, rests[0] if kind == "table" else None, body, rows, items))
    return out


def _listed(lists: list[list], of: T.DataType) -> pa.Array:
    """Lists of values or records as an array, records field by field."""
    ends, flat = [0], []
    for one in lists:
        flat += one
        ends.append(len(flat))
    if isinstance(of, T.StructType):
        columns = list(zip(*flat, strict=True)) or [()] * len(of)
        fields = [_listed(c, f.dataType.elementType) if isinstance(f.dataType, T.ArrayType) else pa.array(c, _ARROW[type(f.dataType)]) for c, f in zip(columns, of, strict=True)]
        values = pa.StructArray.from_arrays(fields, names=of.names)
    else:
        values = pa.array(flat, _ARROW[type(of)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


_ARROW = {T.StringType: pa.string(), T.IntegerType: pa.int32()}


@F.arrow_udf(T.ArrayType(_BLOCK_TYPE))
def _parsed(texts: pa.Array) -> pa.Array:
    """The blocks of each text in order; a null text has none."""
    return _listed([[] if text is None else _records(text) for text in texts.to_pylist()], _BLOCK_TYPE)


_parsed = _parsed.asNondeterministic()  # else each reader of the blocks would parse its text again


def _cells(line: Column, tag: str, align: Column | None = None) -> Column:
    bare = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    cells = F.transform(F.split(bare, r"(?<!\\)\|"), lambda c: F.concat(F.lit(f"<{tag}>"), inline(F.trim(c)), F.lit(f"</{tag}>")))
    return F.concat(F.lit("<tr>\n"), F.array_join(cells, "\n"), F.lit("\n</tr>"))


def _html(block: Column) -> Column:
    """The HTML of a block, without the quotes around it."""
    body, level = block["body"], block["level"]
    code = lambda t: escaped(F.replace(t, F.lit("&"), F.lit("&amp;")))
    shown = F.when(block["mark"] != "", F.concat(F.lit('<code class="language-'), block["mark"], F.lit('">'))).otherwise("<code>")
    fenced = F.concat(F.lit("<pre>"), shown, code(body), F.lit("\n</code></pre>"))
    indented = F.concat(F.lit("<pre><code>"), code(F.regexp_replace(body, r"(?m)^ {4}", "")), F.lit("\n</code></pre>"))
    rows = F.transform(block["rows"], lambda r: F.concat(_cells(r, "td"), F.lit("\n")))
    table = F.concat(F.lit("<table>\n<thead>\n"), _cells(block["head"], "th"), F.lit("\n</thead>\n<tbody>\n"), F.array_join(rows, ""), F.lit("</tbody>\n</table>"))
    heading = F.concat(F.lit("<h"), level, F.lit(' id="'), block["mark"], F.lit('">'), inline(body), F.lit("</h"), level, F.lit(">"))
    items = F.transform(block["items"], lambda k: F.concat(k["opened"], F.lit("<li>"), inline(k["text"]), k["closed"]))
    listed = F.regexp_replace(F.array_join(items, "\n"), "\n\n+", "\n")
    kind = block["kind"]
    paragraph = F.concat(F.lit("<p>"), inline(F.trim(body)), F.lit("</p>"))
    return F.when(kind == "heading", heading).when(kind == "rule", "<hr>").when(kind == "fence", fenced).when(kind == "code", indented).when(kind == "table", table).when(kind == "list", listed).otherwise(paragraph)


def blocks(texts: DataFrame, *, key: str, text: str) -> DataFrame:
    """key, block, kind, depth and html of each block of each text, however long; a null text has none."""
    found = texts.select(F.col(key).alias("key"), F.posexplode(_parsed(F.col(text))).alias("block", "b"))
    return found.select("key", (F.col("block") + 1).cast("long").alias("block"), "b.kind", "b.depth", _html(F.col("b")).alias("html"))


def rendered(texts: DataFrame, *, key: str, text: str, most_chars: int | None = MOST_CHARS) -> DataFrame:
    """key, html and error of each text: quotes opened and closed around their blocks.

    A null text is an error, and one of over ``most_chars``, unless that is
    None; an empty one gives an empty html.
    """
    long = F.lit(False) if most_chars is None else F.coalesce(F.length(text) > most_chars, F.lit(False))
    error = F.when(F.col(text).isNull(), "no input").when(long, "input too long")
    times = lambda t, n: F.repeat(F.lit(t), n)
    quoted = lambda b: F.concat(times("<blockquote>\n", b["opens"]), _html(b), times("\n</blockquote>", b["closes"]))
    out = texts.select(F.col(key).alias("key"), error.alias("error"), _parsed(F.when(~long, F.col(text))).alias("blocks"))
    return out.select(F.col("key").alias(key), F.when(F.col("error").isNull(), F.array_join(F.transform("blocks", quoted), "\n")).alias("html"), "error")
