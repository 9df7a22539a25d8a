"""Page geometry on positioned words and strokes.

Words have doc_id, page_no, word_no, text, x0, x1, top, bottom, size and
fontname.  Range joins go through bands of the vertical axis, so both sides
meet by an equality and only rows of one band are compared.  Joins of rows that
grow on their way are merge joins by hint, as Spark takes them for as few as the
file held and would send them to every executor through the driver.  What
depends on the rows taken so far is an ordered fold over one page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.functions import wrap
from tessella.functions.numbers import area, horizontal_align, overlap_area, overlap_of_smaller
from tessella.operators.folds import placed, whole_keys, whole_places

PAGE = ("doc_id", "page_no")
BAND = 20.0
LINE_GAP = 3.0
SEGMENT_GAP = 40.0
ROW_TOLERANCE = 10.0


def centre(word: DataFrame | None = None) -> tuple[Column, Column]:
    return (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2


def banded(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """One row for each band between two heights."""
    return rows.withColumn("band", F.explode(F.sequence(F.floor(low / BAND), F.floor(high / BAND))))


def words_in_rects(words: DataFrame, rects: DataFrame, pad: float = 1.0) -> DataFrame:
    """Each rectangle (rect_id) with the words whose centre lies in it, edges and ``pad`` included."""
    r = rects.select(*PAGE, "rect_id", *[F.col(c).alias(f"r_{c}") for c in ("x0", "x1", "top", "bottom")])
    r = banded(r, F.col("r_top") - pad, F.col("r_bottom") + pad)
    cx, cy = centre()
    w = words.withColumn("cx", cx).withColumn("cy", cy).withColumn("band", F.floor(F.col("cy") / BAND))
    inside = F.col("cx").between(F.col("r_x0") - pad, F.col("r_x1") + pad) & F.col("cy").between(F.col("r_top") - pad, F.col("r_bottom") + pad)
    return w.join(r.hint("merge"), [*PAGE, "band"]).where(inside).select("rect_id", *words.columns)


def words_outside_rects(words: DataFrame, rects: DataFrame, pad: float = 1.0) -> DataFrame:
    """Words whose centre lies in none of their page's rectangles; an anti join by band."""
    r = rects.select(*PAGE, *[F.col(c).alias(f"r_{c}") for c in ("x0", "x1", "top", "bottom")])
    r = banded(r, F.col("r_top") - pad, F.col("r_bottom") + pad)
    cx, cy = centre()
    w = words.withColumn("cx", cx).withColumn("cy", cy).withColumn("band", F.floor(F.col("cy") / BAND))
    on = [w[c] == r[c] for c in (*PAGE, "band")]
    inside = w["cx"].between(r["r_x0"] - pad, r["r_x1"] + pad) & w["cy"].between(r["r_top"] - pad, r["r_bottom"] + pad)
    return w.join(r.hint("merge"), [*on, inside], "left_anti").select(*words.columns)


def bin_of(value: Column, bounds: Column) -> Column:
    """Index of the half-open interval a value is in; beyond the last bound the last one, before the first none."""
    return F.when(value < F.get(bounds, F.lit(0)), F.lit(None)).otherwise(F.least(F.size(F.filter(bounds, lambda b: b <= value)) - 1, F.size(bounds) - 2))


def grid_lines(rects: DataFrame) -> DataFrame:
    """Different left and right edges of a page's rectangles, to a tenth, in order."""
    edges = rects.select(*PAGE, F.explode(F.array("x0", "x1")).alias("x"))
    return edges.groupBy(*PAGE).agg(F.sort_array(F.collect_set(F.round("x", 1))).alias("xs"))


# ---------------------------------------------------------------- borders and fills


def cell_borders(cells: DataFrame, lines: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """For each edge of each cell the line that covers most of it; of equal ones the thicker.

    cells: cell_id, x0, x1, top, bottom.  lines: line_no, x0, x1, top, bottom, linewidth, color, dashed.
    """
    ln = lines.where("linewidth IS NOT NULL").select(*PAGE, *[F.col(c).alias(f"l_{c}") for c in ("line_no", "x0", "x1", "top", "bottom", "linewidth", "color", "dashed")])
    c, n = banded(cells, F.col("top") - tolerance, F.col("bottom") + tolerance), banded(ln, F.least("l_top", "l_bottom") - tolerance, F.greatest("l_top", "l_bottom") + tolerance)
    upright = F.abs(F.col("l_x0") - F.col("l_x1")) < 0.5
    tall = F.least(F.greatest("l_top", "l_bottom"), F.col("bottom")) - F.greatest(F.least("l_top", "l_bottom"), F.col("top"))
    wide = F.least(F.greatest("l_x0", "l_x1"), F.col("x1")) - F.greatest(F.least("l_x0", "l_x1"), F.col("x0"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance
    edges = F.array_compact(F.array(F.when(upright & near("l_x0", "x0"), "left"), F.when(upright & near("l_x0", "x1"), "right"), F.when(~upright & near("l_top", "top"), "top"), F.when(~upright & near("l_top", "bottom"), "bottom")))
    met = c.join(n.hint("merge"), [*PAGE, "band"]).withColumn("overlap", F.when(upright, tall).otherwise(wide)).where("overlap > 0")
    met = met.withColumn("edge", F.explode(edges)).dropDuplicates([*PAGE, "cell_id", "edge", "l_line_no"])
    best = F.struct("overlap", "l_linewidth", -F.col("l_line_no"))
    return met.groupBy(*PAGE, "cell_id", "edge").agg(F.max_by(F.struct(F.col("l_linewidth").alias("width"), F.col("l_color").alias("color"), F.col("l_dashed").alias("dashed")), best).alias("b")).select(*PAGE, "cell_id", "edge", "b.*")


def cell_fills(cells: DataFrame, fills: DataFrame) -> DataFrame:
    """The colour of the largest filled box that covers at least half of a cell; of equal ones the first."""
    f = fills.select(*PAGE, *[F.col(c).alias(f"f_{c}") for c in ("fill_no", "x0", "x1", "top", "bottom", "color")])
    c, n = banded(cells, F.col("top"), F.col("bottom")), banded(f, F.col("f_top"), F.col("f_bottom"))
    own = tuple(F.col(x) for x in ("x0", "top", "x1", "bottom"))
    box = tuple(F.col(f"f_{x}") for x in ("x0", "top", "x1", "bottom"))
    met = c.join(n.hint("merge"), [*PAGE, "band"]).where((area(own) > 0) & (overlap_area(own, box) >= area(own) * 0.5))
    return met.groupBy(*PAGE, "cell_id").agg(F.max_by("f_color", F.struct(area(box), -F.col("f_fill_no"))).alias("color"))


def has_drawn_grid(vertical: Column, horizontal: Column) -> Column:
    return ((vertical >= 2) & (horizontal >= 2)) | ((vertical >= 3) & (horizontal >= 1)) | ((horizontal >= 3) & (vertical >= 1))


def count_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of each kind and pages of every document."""
    return blocks.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"), *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("text", "table", "image", "line")])


# ---------------------------------------------------------------- folds


def distinct_within(values: Column, tolerance: float, *, inclusive: bool = True) -> Column:
    """Values in order, without those within a tolerance of one already kept."""
    near = (lambda a, b: F.abs(a - b) <= tolerance) if inclusive else (lambda a, b: F.abs(a - b) < tolerance)
    return F.aggregate(values, F.array().cast("array<double>"), lambda kept, x: F.when(F.exists(kept, lambda k: near(k, x)), kept).otherwise(F.concat(kept, F.array(x))))


def aligned_columns(xs: Column, gap: float = 18.0) -> Column:
    """Clusters of left edges; a cluster holds what lies within ``gap`` of its first."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("anchor"))
    step = lambda s, x: F.when(s["anchor"].isNull() | (x - s["anchor"] > gap), F.struct((s["n"] + 1).alias("n"), x.alias("anchor"))).otherwise(s)
    return F.aggregate(F.array_sort(xs), start, step, lambda s: s["n"])


def _same(a: np.ndarray) -> np.ndarray:
    """Whether a value equals the one before it; the first does not."""
    return np.concatenate([[False], a[1:] == a[:-1]])


def _lines(batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """Numbers of lines of words in order: whether a page starts, top and bottom; a page may go on in the next batch.

    Words of one extent that follow each other are taken together: once one has
    joined a line without changing it, so do the others.
    """
    number, high, low, last = -1, 0.0, 0.0, 0.0
    for new, top, bottom in batches:
        starts = np.flatnonzero(new | ~_same(top) | ~_same(bottom))
        sizes = np.diff(np.append(starts, len(top)))
        out = []
        for first, t, b, size in zip(new[starts].tolist(), top[starts].tolist(), bottom[starts].tolist(), sizes.tolist(), strict=True):
            if first:
                number = -1
            while size:
                off = abs((t + b) / 2 - (high + low) / 2)
                touching = b >= high - 0.5 and t <= low + 0.5
                settled = False
                if number >= 0 and (off <= LINE_GAP * 1.5 or (touching and off <= max(LINE_GAP * 2.5, 8.0)) or (t - last <= LINE_GAP and off <= 12.0)):
                    settled = last == b and high <= t and low >= b
                    high, low = min(high, t), max(low, b)
                else:
                    number, high, low = number + 1, t, b
                last = b
                taken = size if settled else 1
                out.append((number, taken))
                size -= taken
        numbers, counts = (np.array(x, dtype=np.int32) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int32),) * 2
        yield np.repeat(numbers, counts)


@F.pandas_udf(T.IntegerType())
def _line_numbers(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``_lines``; place is 1 where a page starts."""
    for numbers in _lines((place.to_numpy() == 1, top.to_numpy(float), bottom.to_numpy(float)) for place, top, bottom in batches):
        yield pd.Series(numbers)


_line_numbers = _line_numbers.asNondeterministic()  # it reads rows in their order, so nothing may be filtered below it


def numbered_lines(words: DataFrame) -> DataFrame:
    """Adds ``line_no``: words of a page that share a visual line, top to bottom.

    Words come by the height of their middle and then from left to right; each
    joins the current line or starts the next.  The line's extent and its last
    word are the state of the fold.  Words without a place are lines of their
    own.  Where words lie by their page, or by a part of it, they stay there.
    """
    _, cy = centre()
    ordered = placed(words.withColumn("_y", F.round(cy, 1)), PAGE, ("_y", "x0", "word_no"))
    return ordered.withColumn("line_no", _line_numbers("_place", F.col("top").cast("double"), F.col("bottom").cast("double"))).drop("_y", "_place")


def with_segments(lined: DataFrame, gap: float = SEGMENT_GAP) -> DataFrame:
    """Adds ``seg_no``: a line breaks where the gap to the word on the left is wide."""
    line = Window.partitionBy(*PAGE, "line_no").orderBy("x0", "top", "word_no")
    wide = F.coalesce((F.col("x0") - F.lag("x1").over(line)) > gap, F.lit(False)).cast("int")
    return lined.withColumn("_wide", wide).withColumn("seg_no", F.sum("_wide").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_wide")


@F.arrow_udf(T.StringType())
def joined_words(items: pa.Array) -> pa.Array:
    """Text of each array of words in order (struct of text, x0, x1): spaces by script and gap."""
    return pa.array([None if words is None else wrap.gap_join(words) for words in items.to_pylist()], pa.string())


joined_words = joined_words.asNondeterministic()  # else a filter on the text would join each line twice


def text_blocks(words: DataFrame, page_width: float) -> DataFrame:
    """One block for each segment: text, box, the most frequent font (the first seen of equal ones) and alignment."""
    segs = with_segments(numbered_lines(words))
    keys = [*PAGE, "line_no", "seg_no"]
    order = Window.partitionBy(*keys).orderBy("x0", "top", "word_no")
    segs = segs.withColumn("_pos", F.row_number().over(order)).withColumn("_size", F.round(F.coalesce("size", F.lit(0.0)), 1)).withColumn("_font", F.coalesce("fontname", F.lit("")))
    fonts = segs.groupBy(*keys, "_size", "_font").agg(F.count("*").alias("_n"), F.min("_pos").alias("_at"))
    fonts = fonts.groupBy(*keys).agg(F.max_by(F.struct("_size", "_font"), F.struct("_n", -F.col("_at"))).alias("f"))
    found = segs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "text", "x0", "x1"))).alias("items"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    out = found.join(fonts.hint("merge"), keys).withColumn("text", F.trim(joined_words(F.col("items")))).where("text <> ''")
    return out.select(*keys, "text", "top", "bottom", "x0", "x1", F.when(F.col("f")["_size"] != 0, F.col("f")["_size"]).alias("font_size"), F.when(F.col("f")["_font"] != "", F.col("f")["_font"]).alias("font_name"), horizontal_align(F.col("x0"), F.col("x1"), F.lit(page_width)).alias("align"))


_BLOCK = {"text": "string", "top": "double", "bottom": "double", "x0": "double", "x1": "double", "font_size": "double", "font_name": "string", "align": "string"}


class SetWords(NamedTuple):
    """Words and their places, by column."""

    number: np.ndarray
    text: list[str]
    x0: np.ndarray
    x1: np.ndarray
    top: np.ndarray
    bottom: np.ndarray
    size: np.ndarray
    font: np.ndarray


def _unwrapped(rows: list[dict], page_right: float | None) -> list[dict]:
    """The blocks of a page in order, wrapped lines joined, with ``block_no``."""
    done, cur, last, calm = [], None, None, False

    def end() -> None:
        if cur is not None:
            done.append({**cur, "text": cur["text"] if calm else wrap.spaced(cur["text"]), "block_no": len(done)})

    for nxt in rows:
        if cur is not None and wrap.is_wrap(cur, last, nxt, page_right):
            text, calm = wrap.appended(cur["text"], nxt["text"], calm)
            cur = cur | {"text": text, "bottom": nxt["bottom"], "x0": min(cur["x0"], nxt["x0"]), "x1": max(cur["x1"], nxt["x1"]), "font_size": cur["font_size"] or nxt["font_size"], "font_name": cur["font_name"] or nxt["font_name"]}
        else:
            end()
            cur, calm = nxt, wrap.settled(nxt["text"])
        last = nxt
    end()
    return done


def paragraphs(blocks: DataFrame, *, page_right: float | None = None, order: tuple[str, ...] = ("line_no", "seg_no")) -> DataFrame:
    """Blocks of a page, wrapped lines joined.

    What is decided at a break reads the text so far but the box of the last
    line only, so each page is folded in order; a page is one small group.
    """
    fields = list(_BLOCK)
    kinds = dict(blocks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, pages in whole_keys(batches, PAGE):
            rows = whole.select([*PAGE, *fields]).to_pylist()
            out = [block for a, b in pages for block in _unwrapped(rows[a:b], page_right)]
            types = {**{f.name: f.type for f in whole.schema}, "block_no": pa.int32()}
            names = [*PAGE, "block_no", *fields]
            yield pa.RecordBatch.from_arrays([pa.array([block[n] for block in out], types[n]) for n in names], names=names)

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in PAGE), "block_no int", *(f"{c} {kinds[c]}" for c in fields)])
    return blocks.repartition(*PAGE).sortWithinPartitions(*PAGE, *order).mapInArrow(run, schema)


#: So many characters of texts are set and read together.
CHARS = 1 << 21


def _coded(values: np.ndarray) -> tuple[list, np.ndarray]:
    """The different values, and which of them each is."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _tenths(values: np.ndarray) -> np.ndarray:
    """Numbers to one digit as Spark rounds them, halves away from zero by what is written."""
    one, where = _coded(values)
    return np.array([float(Decimal(repr(v)).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in one])[where]


def _aligned(x0: np.ndarray, x1: np.ndarray, width: float) -> np.ndarray:
    """``horizontal_align`` of arrays on a page that has a width."""
    left, right, middle = np.maximum(x0, 0.0), np.maximum(width - x1, 0.0), (x0 + x1) / 2 / width
    uneven = np.abs(left - right)
    even = (uneven <= max(width * 0.12, 18.0)) | ((middle > 0.38) & (middle < 0.62))
    inset = (left > width * 0.18) | (uneven <= width * 0.12)
    wide = np.maximum(x1 - x0, 1.0) / width >= 0.7
    return np.select([wide, even & inset, (left > right * 2) & (left / width > 0.45)], ["left", "center", "right"], "left")


def _read_blocks(first: np.ndarray, own: np.ndarray, words: SetWords, page_width: float) -> Iterator[list[dict]]:
    """The blocks of each page, as ``text_blocks`` gives them, of words that are set."""
    page = (np.cumsum(first) - 1)[own]
    # by the height of their middle, then from left to right
    order = np.lexsort((words.number, words.x0, _tenths((words.top + words.bottom) / 2), page))
    new = np.ones(len(order), bool)
    new[1:] = page[order][1:] != page[order][:-1]
    line = np.empty(len(order), np.int64)
    line[order] = next(_lines(iter([(new, words.top[order], words.bottom[order])]))) + (np.cumsum(new) - 1) * (len(order) + 1)
    order = np.lexsort((words.number, words.top, words.x0, line))
    line, page, x0, x1, top, bottom = (c[order] for c in (line, page, words.x0, words.x1, words.top, words.bottom))
    starts = np.ones(len(order), bool)
    starts[1:] = (line[1:] != line[:-1]) | (x0[1:] - x1[:-1] > SEGMENT_GAP)
    at = np.flatnonzero(starts)
    # the most frequent font, the first seen of equal ones
    fonts, font = _coded(words.font[order])
    sizes, size = _coded(_tenths(words.size[order]))
    kinds = len(fonts) * len(sizes)
    kind, seen, count = np.unique((np.cumsum(starts) - 1) * kinds + size.astype(np.int64) * len(fonts) + font, return_index=True, return_counts=True)
    best = np.lexsort((seen, -count, kind // kinds))
    block = kind[best] // kinds
    kind = kind[best[np.append(True, block[1:] != block[:-1])]] % kinds
    text = [words.text[k] for k in order.tolist()]
    gap = np.append(0.0, x0[1:] - x1[:-1])
    apart = np.where(starts | ~(gap > 1.0), 0, np.where(gap > 8.0, 2, 1))
    marks = ("", wrap.NARROW, " ")
    spaced = [marks[k] + w for k, w in zip(apart.tolist(), text, strict=True)]
    hard = np.logical_or.reduceat(np.fromiter((not w or wrap.NARROW in w for w in text), bool, len(text)), at).tolist()
    left, right = np.minimum.reduceat(x0, at), np.maximum.reduceat(x1, at)
    boxes = zip(np.minimum.reduceat(top, at).tolist(), np.maximum.reduceat(bottom, at).tolist(), left.tolist(), right.tolist(), [sizes[k // len(fonts)] for k in kind.tolist()], [fonts[k % len(fonts)] for k in kind.tolist()], _aligned(left, right, page_width).tolist(), strict=True)
    ends, pages, held, last = [*at[1:].tolist(), len(text)], page[at].tolist(), [], 0
    for of, a, b, hard_one, (y0, y1, l, r, size_of, font_of, align) in zip(pages, at.tolist(), ends, hard, boxes, strict=True):
        while last < of:
            yield held
            held, last = [], last + 1
        joined = None if hard_one else wrap.easily_joined("".join(spaced[a:b]))
        if joined is None:
            joined = wrap.gap_joined(text[a:b], x0[a:b].tolist(), x1[a:b].tolist()).strip(" ")
        if joined:
            held.append({"text": joined, "top": y0, "bottom": y1, "x0": l, "x1": r, "font_size": size_of or None, "font_name": font_of or None, "align": align})
    yield held


def set_paragraphs(rows: DataFrame, *, text: str, sets: Callable[[list[str]], tuple[np.ndarray, SetWords]], page_width: float, page_right: float | None = None) -> DataFrame:
    """``paragraphs`` of the ``text_blocks`` of pages whose words are set by a rule from the text of their rows.

    ``sets`` gives the row and the place of each word of texts, so only texts
    are sorted and travel to the workers, and of words there are never more at
    a time than some texts have.  Rows that are dealt by a column of their page
    are not shuffled again.
    """
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in PAGE), "block_no int", *(f"{c} {kind}" for c, kind in _BLOCK.items())])
    types = [pa.string() if kind == "string" else pa.float64() for kind in _BLOCK.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, first in whole_places(batches, 1):
            texts, at = [t or "" for t in whole.column(text).to_pylist()], np.flatnonzero(first)
            done = np.cumsum([len(t) for t in texts])[np.append(at[1:], len(first)) - 1] // CHARS
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(done)) + 1):
                a, b = at[part[0]], at[part[-1] + 1] if part[-1] + 1 < len(at) else len(first)
                pages = [_unwrapped(page, page_right) for page in _read_blocks(first[a:b], *sets(texts[a:b]), page_width)]
                of = pa.array(np.repeat(at[part[: len(pages)]], [len(page) for page in pages]))
                fields = [pa.array([block[c] for page in pages for block in page], kind) for c, kind in zip(_BLOCK, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(whole.column(c).take(of).combine_chunks() for c in PAGE), pa.array([k for page in pages for k in range(len(page))], pa.int32()), *fields], names=[*PAGE, "block_no", *_BLOCK])

    return placed(rows.select(*PAGE, text), PAGE, ()).mapInArrow(run, schema)


def kept_rules(rules: DataFrame) -> DataFrame:
    """Horizontal rules from top to bottom, without near repeats of one already kept."""
    item = "struct<top:double,x0:double,x1:double,rule_no:bigint>"
    pages = rules.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("top", "x0", "x1", "rule_no").cast(item))).alias("r"))
    same = lambda k, x: (F.abs(k["top"] - x["top"]) < 1.5) & (F.abs(k["x0"] - x["x0"]) < 2) & (F.abs(k["x1"] - x["x1"]) < 2)
    kept = F.aggregate("r", F.array().cast(f"array<{item}>"), lambda kept, x: F.when(F.exists(kept, lambda k: same(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
    return pages.select(*PAGE, F.explode(kept).alias("k")).select(*PAGE, F.col("k")["rule_no"].alias("rule_no"))


def kept_tables(candidates: DataFrame, page_area: float, reject: float = 0.45) -> DataFrame:
    """Non-maximum suppression: candidates by strategy and find order.

    One goes if it covers much of one kept, or is tiny; later strategies are
    not tried once those kept cover over half of the page.
    """
    item = "struct<strategy:int,find_no:int,x0:double,top:double,x1:double,bottom:double>"
    pages = candidates.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("strategy", "find_no", "x0", "top", "x1", "bottom").cast(item))).alias("c"))
    box = lambda k: tuple(k[f] for f in ("x0", "top", "x1", "bottom"))
    covered = lambda kept, s: F.aggregate(F.filter(kept, lambda k: k["strategy"] < s), F.lit(0.0), lambda t, k: t + area(box(k)))

    def step(kept: Column, x: Column) -> Column:
        tiny = (x["x1"] - x["x0"] < 20) | (x["bottom"] - x["top"] < 10)
        meets = F.exists(kept, lambda k: overlap_of_smaller(box(x), box(k)) >= reject)
        return F.when(tiny | meets | (covered(kept, x["strategy"]) > page_area * 0.5), kept).otherwise(F.concat(kept, F.array(x)))

    return pages.select(*PAGE, F.explode(F.aggregate("c", F.array().cast(f"array<{item}>"), step)).alias("k")).select(*PAGE, "k.*")


def interleaved(*parts: DataFrame) -> DataFrame:
    """Blocks of all kinds by their top; of equal ones by kind and place.  Each part has a block_no."""
    ranked = [p.withColumn("source_rank", F.lit(k)) for k, p in enumerate(parts)]
    out = ranked[0]
    for p in ranked[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("top", "source_rank", "block_no"))
    return out.withColumn("place", place.cast("long"))


def page_margins(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """Margins of a document by the box of all its blocks, each between half an inch and two."""
    clamp = lambda x: F.greatest(F.lit(36.0), F.least(x, F.lit(144.0)))
    box = blocks.groupBy("doc_id").agg(F.min(F.when(F.col("x1") > F.col("x0"), F.col("x0"))).alias("l"), F.max(F.when(F.col("x1") > F.col("x0"), F.col("x1"))).alias("r"), F.min(F.when(F.col("bottom") > F.col("top"), F.col("top"))).alias("t"), F.max(F.when(F.col("bottom") > F.col("top"), F.col("bottom"))).alias("b"))
    left, right = clamp(F.col("l")), clamp(F.lit(width) - F.col("r"))
    even = F.abs(left - right) < 12.0
    return box.select("doc_id", F.when(even, (left + right) / 2).otherwise(left).alias("left"), F.when(even, (left + right) / 2).otherwise(right).alias("right"), clamp(F.coalesce("t", F.lit(50.4))).alias("top"), clamp(F.lit(height) - F.coalesce("b", F.lit(height - 50.4))).alias("bottom"))


def visual_rows(blocks: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Adds ``row_no``: blocks side by side; a table has a row of its own.

    A row starts at the first free block.  The next block in ring order whose
    middle lies near the row's joins it, until there is none; near is within
    ``tolerance``, or within twice that where the two meet.  Blocks lie sorted
    by their middles, so only those within reach are looked at.  What a row
    takes is lost to later ones: each page is one ordered group.  A block
    without a bottom, or with one of 0, has no height.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields) + ", row_no int"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, pages in whole_keys(batches, PAGE):
            top, end = (whole.column(c).cast("float64").to_numpy(zero_copy_only=False) if whole.num_rows else np.zeros(0) for c in ("top", "bottom"))
            end = np.where((end == 0) | np.isnan(end), top, end)
            table = np.array([k == "table" for k in whole.column("kind").to_pylist()], dtype=bool)
            row_no = np.concatenate([_page_rows(top[a:b], end[a:b], table[a:b], tolerance) for a, b in pages])
            yield from whole.append_column("row_no", pa.array(row_no.astype(np.int32))).combine_chunks().to_batches()

    return blocks.repartition(*PAGE).sortWithinPartitions(*PAGE, "block_no").mapInArrow(number, schema)


def _page_rows(top: np.ndarray, end: np.ndarray, table: np.ndarray, tolerance: float) -> np.ndarray:
    """The row of each block of one page."""
    middle = (top + end) / 2
    by_middle = np.argsort(middle, kind="stable")
    heights = middle[by_middle]
    row_no, rows = np.full(len(top), -1), 0

    def beside(low: float, high: float) -> np.ndarray:
        at = (low + high) / 2
        a, b = np.searchsorted(heights, (at - 2 * tolerance - 1e-6, at + 2 * tolerance + 1e-6))
        near = by_middle[a:b]
        near = near[(row_no[near] < 0) & ~table[near]]
        off, meets = np.abs(middle[near] - at), (end[near] >= low - 1) & (top[near] <= high + 1)
        return near[off <= np.where(meets, 2 * tolerance, tolerance)]

    for seed in range(len(top)):
        if row_no[seed] >= 0:
            continue
        row_no[seed], last, low, high = rows, -1, top[seed], end[seed]
        while not table[seed] and len(near := beside(low, high)):
            last = min(near, key=lambda k: (k <= last, k))
            row_no[last], low, high = rows, min(low, top[last]), max(high, end[last])
        rows += 1
    return row_no
