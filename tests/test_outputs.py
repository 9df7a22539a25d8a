"""Word files, pixels, runs and job changes on small cases."""

import io
import struct
import zipfile
import zlib
from datetime import datetime
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import runs
from tessella.operators import limits, pixels
from tessella.sources import docx

BLOCK = "doc_id int, page_no int, row_no int, block_no int, kind string, text string, align string, x0 double, top double, bottom double, width double, height double, content binary"


def package(row):
    return zipfile.ZipFile(io.BytesIO(row["content"]))


def test_docx_parts(spark):
    rows = [
        (1, 0, 0, 0, "text", "a < b & c\x07\nd", "center", 50.4, 10.0, 20.0, None, None, None),
        (1, 0, 1, 1, "image", None, None, 70.4, 40.0, 60.0, 20.0, 10.0, b"\x89PNG"),
        (1, 0, 1, 2, "image", None, None, 90.4, 40.0, 60.0, 20.0, 10.0, None),
        (1, 1, 0, 3, "text", "汉字", "left", 60.4, 10.0, 20.0, None, None, None),
        (2, 0, 0, 0, "line", None, None, 60.4, 10.0, 11.0, None, None, None),
        (3, 0, 0, 0, "text", None, None, None, None, None, None, None, None),
    ]
    found = {r["doc_id"]: r for r in docx.written(spark.createDataFrame(rows, BLOCK)).collect()}
    assert set(found) == {1, 2, 3}
    names = package(found[1]).namelist()
    assert names[:4] == ["[Content_Types].xml", "_rels/.rels", "word/document.xml", "word/_rels/document.xml.rels"] and names[4:] == ["word/media/image0_1.png"]
    for r in found.values():
        for name in r and package(r).namelist():
            if not name.endswith(".png"):
                ElementTree.fromstring(package(r).read(name))
    body = package(found[1]).read("word/document.xml").decode()
    assert body.count('<w:br w:type="page"/>') == 1 and body.count("<w:tab/>") == 1 and 'w:left="400"' in body and 'r:embed="image0_1"' in body and "image0_2" not in body
    assert "<w:pBdr>" in package(found[2]).read("word/document.xml").decode()
    read = docx.written(spark.createDataFrame(rows, BLOCK)).select("doc_id", docx.paragraphs("content").alias("p")).collect()
    assert {r["doc_id"]: r["p"] for r in read} == {1: ["a < b & c\nd", "\t", "\n", "汉字"], 2: [""], 3: [""]}
    assert docx.written(spark.createDataFrame([], BLOCK)).count() == 0
    bad = spark.createDataFrame([(b"no zip",), (None,), (b"",)], "content binary")
    assert [r[0] for r in bad.select(docx.paragraphs("content")).collect()] == [None] * 3


def test_merged_cells(spark):
    cells = [(1, 0, 2, 1, "l", None, None, None), (0, 0, 1, 2, "h", "center", "bottom", "FF0000"), (1, 1, 1, 1, "r", None, None, None), (2, 1, 1, 1, None, None, None, None)]
    rows = spark.createDataFrame([(1, 0, 0, 0, "table", cells, [30.0, 40.0])], f"doc_id int, page_no int, row_no int, block_no int, kind string, cells array<{docx.CELL}>, col_widths array<double>")
    body = package(docx.written(rows).first()).read("word/document.xml").decode()
    assert body.count("<w:tr>") == 3 and body.count("<w:tc>") == 5 and 'w:gridSpan w:val="2"' in body and body.count('<w:vMerge w:val="restart"/>') == 1 and body.count("<w:vMerge/>") == 1
    assert 'w:gridCol w:w="600"' in body and 'w:fill="FF0000"' in body


def filtered(image, kinds):
    """A PNG whose rows have the filters named, made by their definition."""
    height, width, step = image.shape
    out, flat = b"", image.reshape(height, width * step).astype(int)
    for y, kind in enumerate(kinds):
        row = []
        for i in range(width * step):
            a = flat[y][i - step] if i >= step else 0
            b = flat[y - 1][i] if y else 0
            c = flat[y - 1][i - step] if y and i >= step else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            row.append((flat[y][i] - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        out += bytes([kind]) + bytes(int(v) for v in row)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[step], 0, 0, 0)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return pixels.PNG_HEAD + part(b"IHDR", head) + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_png_filters(spark, step):
    image = np.random.default_rng(step).integers(0, 256, (5, 4, step))
    files = spark.createDataFrame([(1, filtered(image, [0, 1, 2, 3, 4])), (2, b"none"), (3, None)], "image_id long, content binary")
    found = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in pixels.from_png(files).collect()}
    assert len(found) == 20
    for (x, y), got in found.items():
        v = [int(k) for k in image[y][x]]
        assert got == ((v[0], v[1], v[2]) if step >= 3 else (v[0],) * 3) + ((v[-1] if step in (2, 4) else 255),)


def test_backgrounds(spark):
    rows = [(1, x, y, 10 * x, 5, 6, 0 if (x, y) == (0, 0) else 255) for x in range(3) for y in range(2)]
    sizes = spark.createDataFrame([(1, 3, 2), (2, 4, 4)], "image_id long, width int, height int")
    found = {r["image_id"]: (r["key_r"], r["key_g"], r["key_b"]) for r in pixels.corner_background(spark.createDataFrame(rows, pixels.PIXEL), sizes).collect()}
    spots = [(0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 1), (1, 1), (2, 1)]
    reds = sorted(10 * x for x, y in spots if (x, y) != (0, 0))
    assert found == {1: (reds[len(reds) // 2], 5, 6), 2: (255, 255, 255)}
    sharp = spark.range(256).select(pixels.ramp(F.col("id").cast("int"), 0, soft=False).alias("a")).collect()
    assert [r[0] for r in sharp][:2] == [0, 255] and sharp[-1][0] == 255


def test_runs(spark):
    run = lambda t, s, n: {"text": t, "font_size": s, "font_name": n}
    rows = [([run("wor-", 10.0, "A")], [run("ds", 12.0, "B"), run("end", 9.0, "C")]), (None, [run("x", 1.0, "A")]), ([run("", 1.0, "A"), None], []), ([run("汉", 0.0, "")], [run("字", 12.0, "B")])]
    df = spark.createDataFrame(rows, f"a array<{runs.RUN}>, b array<{runs.RUN}>")
    found = [[tuple(r) for r in x["m"]] for x in df.select(runs.merged(F.col("a"), F.col("b")).alias("m")).collect()]
    assert found == [[("words", 10.0, "A"), ("end", 9.0, "C")], [("x", 1.0, "A")], [], [("汉字", 12.0, "B")]]


def test_job_changes(spark):
    steps = [(1, 1, "create"), (1, 2, "start"), (1, 3, "finish"), (2, 1, "create"), (2, 2, "start"), (2, 3, "fail"), (3, 1, "create"), (3, 2, "finish"), (3, 3, "download")]
    rows = [(k, n, a, datetime(2024, 1, 1, 0, n), "broken" if a == "fail" else None, "out" if a == "finish" else None) for k, n, a in steps]
    actions = spark.createDataFrame(rows, "id int, n int, action string, at timestamp, error string, output_path string")
    state = limits.latest_state(limits.job_changes(actions), key="id", time="at", order="n", fields=("status", "progress", "message", "error", "output_path", "downloaded_at"))
    found = {r["id"]: (r["status"], r["message"], r["error"], r["has"]) for r in state.withColumn("has", limits.has_result(F.col("status"), F.col("output_path"), F.col("downloaded_at"))).collect()}
    assert found == {1: ("done", "done", None, True), 2: ("error", "error", "broken", False), 3: ("done", "downloaded", None, False)}
