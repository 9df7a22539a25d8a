import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import aligned, cellruns, pixels
from tessella.sources import docx

WORDS = "doc_id long, page_no int, word_no long, text string, x0 double, x1 double, top double, bottom double"


def line(page, top, *parts):
    """Words of one line: (x0, text with single spaces)."""
    out = []
    for x0, text in parts:
        for word in text.split(" "):
            out.append((page, 0, len(out) + int(top * 100), word, float(x0), x0 + 5.0 * len(word), float(top), top + 10.0))
            x0 += 5 * len(word) + 3
    return out


def found(spark, rows):
    got = aligned.table_cells(spark.createDataFrame(rows, WORDS).repartition(3)).collect()
    return {(r.doc_id, r.table_no, r.r, r.c): r.text for r in got}


def test_labels_and_values_are_a_table_and_prose_is_none(spark):
    rows = [w for k in range(6) for w in line(1, 20 + 14 * k, (50, "running prose of many words that fill the whole of a line"))]
    rows += [w for k, (a, b) in enumerate([("Name", "Ada Byron"), ("Born on", "10 December"), ("Town", "London"), ("Trade", "sums")]) for w in line(1, 120 + 16.0 * k + k % 2, (50, a), (200, b))]
    rows += [w for k in range(3) for w in line(1, 300 + 14 * k, (50, "more prose below the table"))]
    rows += [w for k in range(2) for w in line(2, 20 + 14 * k, (50, "two lines"), (200, "are too few"))]
    rows += [w for k in range(4) for w in line(3, 20 + 14 * k, *([(50, "a"), (120, "b"), (300, "c")] if k % 2 else [(50, "a"), (300, "c d")]))]
    rows += [w for k in range(5) for w in line(4, 20 + 14 * k, (50 + 30 * k, "steps"), (190 + 30 * k, "down"))]
    rows += [(5, 0, 1, None, 1.0, 2.0, 3.0, 4.0), (5, 0, 2, "x", None, 2.0, 3.0, 4.0)]
    got = found(spark, rows)
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 0, r, c): v for r, row in enumerate([("Name", "Ada Byron"), ("Born on", "10 December"), ("Town", "London"), ("Trade", "sums")]) for c, v in enumerate(row)}
    assert {k[0] for k in got} == {1, 3}
    assert {k[2:]: v for k, v in got.items() if k[0] == 3} == {(0, 0): "a", (0, 2): "c d", (1, 0): "a", (1, 1): "b", (1, 2): "c", (2, 0): "a", (2, 2): "c d", (3, 0): "a", (3, 1): "b", (3, 2): "c"}


def test_regions_far_apart_are_two_tables(spark):
    rows = [w for k in (0, 1, 2, 10, 11, 12) for w in line(1, 20 + 16 * k, (50, f"row {k}"), (200, "x"))]
    assert {k[:3] for k in found(spark, rows)} == {(1, t, r) for t in (0, 1) for r in (0, 1, 2)}
    assert found(spark, rows[:0]) == {}


def picture(seed, wide, tall):
    draw = np.random.default_rng(seed)
    out = draw.integers(0, 256, (tall, wide, 4))
    out[..., 3] = draw.choice([0, 120, 255], (tall, wide))
    return out


def pixel_rows(image_id, image):
    return [(image_id, x, y, *map(int, image[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])]


def plain_axis(image, new):
    """Rows of an array resampled to ``new`` rows, weights as floats."""
    old, out = image.shape[0], []
    scale = old / new
    wide = max(scale, 1.0)
    for t in range(new):
        centre = (t + 0.5) * scale
        at = range(max(0, math.floor(centre - 3 * wide + 0.5)), min(old, math.floor(centre + 3 * wide + 0.5)))
        d = [(i - centre + 0.5) / wide for i in at]
        w = np.array([np.sinc(x) * np.sinc(x / 3) if abs(x) < 3 else 0 for x in d])
        out.append(np.tensordot(w / w.sum(), image[list(at)].astype(float), axes=1))
    return np.clip(np.floor(np.array(out) + 0.5), 0, 255)


def test_resampling_equals_a_loop(spark):
    images = {1: picture(1, 23, 9), 2: picture(2, 7, 31), 3: picture(3, 6, 6), 4: picture(4, 300, 1)}
    images[1][..., 3] = 255
    rows = [r for k, im in images.items() for r in pixel_rows(k, im)]
    sizes = spark.createDataFrame([(k, im.shape[1], im.shape[0]) for k, im in images.items()], "image_id long, width int, height int")
    got = pixels.resampled(spark.createDataFrame(rows, pixels.PIXEL).repartition(5), sizes, 8).collect()
    for k, (w, h) in {1: (8, 3), 2: (2, 8), 3: (6, 6), 4: (8, 1)}.items():
        out = np.full((h, w, 4), -1)
        for r in got:
            if r.image_id == k:
                out[r.y, r.x] = (r.r, r.g, r.b, r.a)
        im = images[k].astype(float)
        if (w, h) != im.shape[1::-1]:
            im[..., :3] = np.floor((im[..., :3] * im[..., 3:] + 127) / 255)
            im = plain_axis(plain_axis(im.transpose(1, 0, 2), w).transpose(1, 0, 2), h)
            a = im[..., 3:]
            im[..., :3] = np.where((a == 0) | (a == 255), im[..., :3], np.minimum(255, np.floor(255 * im[..., :3] / np.maximum(a, 1))))
        assert (out[..., 3] >= 0).all()
        solid = im[..., 3] > 40
        assert (np.abs(out[..., 3] - im[..., 3]) <= 1).all() and (np.abs(out - im)[solid] <= 8).all() and np.abs(out - im)[solid].mean() < 0.5
    assert len(got) == 24 + 16 + 36 + 8


def test_sizes_that_fit(spark):
    sizes = spark.createDataFrame([(1, 4000, 1), (2, 10, 30), (3, 5, 5)], "image_id long, width int, height int")
    got = {r.image_id: (r.new_width, r.new_height) for r in pixels.fitted_sizes(sizes, 15).collect()}
    assert got == {1: (15, 1), 2: (5, 15), 3: (5, 5)}
    assert all(r.width == r.new_width for r in pixels.fitted_sizes(sizes, 0).collect())


def test_eight_orientations(spark):
    image = np.arange(6 * 4).reshape(2, 3, 4)
    want = {1: image, 2: image[:, ::-1], 3: image[::-1, ::-1], 4: image[::-1], 5: image.transpose(1, 0, 2), 6: np.rot90(image, -1), 7: np.rot90(image, 2).transpose(1, 0, 2), 8: np.rot90(image, 1), 9: image, 0: image}
    sizes = spark.createDataFrame([(k, 3, 2, k if k else None) for k in want], "image_id long, width int, height int, orientation int")
    rows = spark.createDataFrame([r for k in want for r in pixel_rows(k, image)], pixels.PIXEL)
    got = {(r.image_id, r.x, r.y): r.r for r in pixels.turned(rows, sizes).collect()}
    assert got == {(k, x, y): int(im[y, x, 0]) for k, im in want.items() for y in range(im.shape[0]) for x in range(im.shape[1])}


def plain_cut(counts, levels):
    boxes = [counts]
    for _ in range(levels):
        halves = []
        for box in boxes:
            spread = [max(c[i] for c in box) - min(c[i] for c in box) for i in range(3)]
            axis = 1 if spread[1] >= max(spread[0], spread[2]) else 0 if spread[0] >= spread[2] else 2
            total, low = sum(box.values()), min(c[axis] for c in box)
            upper = {c for c in box if c[axis] > low and 2 * sum(n for q, n in box.items() if q[axis] < c[axis]) >= total}
            halves += [h for h in ({c: n for c, n in box.items() if c not in upper}, {c: n for c, n in box.items() if c in upper}) if h]
        boxes = halves
    return [tuple(sum(c[i] * n for c, n in b.items()) // sum(b.values()) for i in range(3)) for b in boxes]


def test_palettes_equal_a_loop_and_keep_errors_small(spark):
    images = {1: picture(8, 20, 20), 2: np.full((4, 4, 4), 255), 3: picture(9, 3, 1)}
    images[1][..., :3] = images[1][..., :3] // 16 * 16
    df = spark.createDataFrame([r for k, im in images.items() for r in pixel_rows(k, im)], pixels.PIXEL).repartition(4)
    table = {}
    for r in pixels.palette(pixels.histogram(df), 4).orderBy("image_id", "box").collect():
        table.setdefault(r.image_id, []).append((r.pr, r.pg, r.pb))
    for k, im in images.items():
        counts = {}
        for *c, a in im.reshape(-1, 4).tolist():
            if a:
                counts[tuple(c)] = counts.get(tuple(c), 0) + 1
        assert table.get(k, []) == (plain_cut(counts, 4) if counts else []), k
    assert table[2] == [(255, 255, 255)] and len(table[1]) == 16
    got = pixels.quantised(df, 4).collect()
    assert len(got) == df.count()
    for r in got:
        c, a = images[r.image_id][r.y, r.x, :3], images[r.image_id][r.y, r.x, 3]
        assert r.a == a and (r.r, r.g, r.b) == (min(table[r.image_id], key=lambda p: sum((int(u) - v) ** 2 for u, v in zip(c, p, strict=True))) if a else (0, 0, 0))


@pytest.mark.parametrize("seed", [1, 2])
def test_frames_equal_a_loop(spark, seed):
    draw = random.Random(seed)
    drawn, frames, want = [], [], []
    for image in range(4):
        canvas = np.zeros((3, 4, 4), dtype=int)
        for frame in range(7):
            disposal = draw.choice(["none", "none", "previous", "background"])
            frames.append((image, frame, 4, 3, disposal))
            before = canvas.copy()
            for y in range(3):
                for x in range(4):
                    if draw.random() < 0.4:
                        px = (draw.randrange(256), draw.randrange(256), draw.randrange(256), draw.choice([0, 255]))
                        drawn.append((image, frame, x, y, *px))
                        if px[3]:
                            canvas[y, x] = px
            want += [(image, frame, x, y, *map(int, canvas[y, x])) for y in range(3) for x in range(4)]
            if disposal == "previous":
                canvas = before
            elif disposal == "background":
                canvas = np.zeros((3, 4, 4), dtype=int)
    px = spark.createDataFrame(drawn, "image_id long, frame int, x int, y int, r int, g int, b int, a int")
    whole = pixels.composed(px, spark.createDataFrame(frames, "image_id long, frame int, width int, height int, disposal string"))
    assert sorted(map(tuple, whole.collect())) == sorted(want)
    kept = {}
    for r in pixels.differences(whole).orderBy("frame").collect():
        kept.setdefault((r.image_id, r.x, r.y), []).append(r)
    for image, frame, x, y, *px in want:
        assert [list(r[4:]) for r in kept[image, x, y] if r.frame <= frame][-1] == px
    assert whole.where(F.col("a") > 0).count() > 50


def test_cells_are_paragraphs_of_runs(spark):
    cells = [(1, 0, k, 40.0 + 300 * k, 20.0, 300.0 + 300 * k, 200.0) for k in range(3)]

    def word(no, text, x0, x1, top, size, font):
        return (1, 0, no, text, float(x0), float(x1), float(top), top + 10.0, size, font)

    words = [
        word(0, "Terms", 50, 90, 30, 12.0, "Bold"), word(1, "apply", 95, 130, 30, 12.0, "Bold"), word(2, "to", 140, 150, 30, 10.0, "Text"), word(3, "every-", 250, 295, 30, 10.0, "Text"),
        word(4, "one", 50, 70, 42, 10.0, "Text"), word(5, "here.", 75, 100, 42.4, 10.0, "Text"),
        word(6, "Next", 50, 80, 54, None, None), word(7, "", 90, 95, 54, 9.0, "Other"), word(8, None, 97, 99, 54, 9.0, "Other"),
        word(9, "B", 380, 385, 40, 10.0, "Text"), word(10, "A", 350, 355, 40, 10.0, "Text"), word(11, "C", 350, 355, 120, 10.0, "Text"),
    ]
    got = cellruns.cell_paragraphs(
        spark.createDataFrame(cells, "doc_id long, page_no int, cell_id int, x0 double, top double, x1 double, bottom double"),
        spark.createDataFrame(words, WORDS + ", size double, fontname string").repartition(3),
    )
    runs = {r.cell_id: [[tuple(x) for x in p] for p in r.paragraphs] for r in got.collect()}
    assert runs[0] == [[("Terms apply", 12.0, "Bold"), ("to everyone here.", 10.0, "Text")], [("Next", None, None)]]
    assert runs[1] == [[("A B", 10.0, "Text")], [("C", 10.0, "Text")]]
    assert runs[2] == []


def test_the_wider_line_wins_at_a_shared_edge(spark):
    draw = random.Random(3)
    places = [(0, 0, 1, 2), (0, 2, 2, 1), (1, 0, 2, 1), (1, 1, 1, 1), (2, 1, 1, 2)]  # r, c, rowspan, colspan
    facing = {"top": "bottom", "bottom": "top", "left": "right", "right": "left"}

    def lines(p):
        r, c, tall, wide = p
        return {"top": {("h", r, k) for k in range(c, c + wide)}, "bottom": {("h", r + tall, k) for k in range(c, c + wide)}, "left": {("v", c, k) for k in range(r, r + tall)}, "right": {("v", c + wide, k) for k in range(r, r + tall)}}

    for _ in range(4):
        own = {p: {s: (draw.choice([0.5, 1.0, 2.0]), f"{k}{s}", False) if draw.random() < 0.7 else None for s in docx.SIDES} for k, p in enumerate(places)}
        df = spark.createDataFrame([([(*p, "t", None, None, None, None, None, None, tuple(own[p][s] for s in docx.SIDES)) for p in places],)], f"cells array<{docx.RICH_CELL}>")
        got = {(x.r, x.c): x.borders for x in df.select(docx.settled(F.col("cells")).alias("cells")).first().cells}
        for p in places:
            for s in docx.SIDES:
                rivals = [(own[q][facing[s]], q) for q in places if q != p and lines(q)[facing[s]] & lines(p)[s]] + [(own[p][s], p)]
                best = [(e[0], q == p if s in ("right", "bottom") else q != p, e) for e, q in rivals if e]
                shown = got[p[:2]][s]
                if not best:
                    assert shown is None
                else:
                    top = max(b[:2] for b in best)
                    assert tuple(shown) in [b[2] for b in best if b[:2] == top]


def test_word_tables_without_cells_or_borders(spark):
    rows = [(1, 0, 0, 0, "table", []), (2, 0, 0, 0, "table", None), (3, 0, 0, 0, "table", [(0, 0, "a\nb")]), (3, 0, 1, 1, "text", None)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, row_no int, block_no int, kind string, cells array<struct<r:int,c:int,text:string>>")
    got = {r.doc_id: r.c for r in docx.written(df).select("doc_id", docx.cells_read("content").alias("c")).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 1 and got[3][0].endswith(":ab []")
