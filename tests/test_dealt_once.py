"""Cases of the third round's findings on growth: rows are dealt once, and what stays together is not shuffled again."""

import io
import random
import re
import zipfile

from pyspark.sql import functions as F

from tessella.operators import geometry
from tessella.plans import catalog as base
from tessella.plans import drawn
from tessella.sources import docx

FOLDER = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_become_word_files_after_one_exchange(spark):
    plan = _plan(base.queries()["docx_round_trip"](spark, FOLDER))
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Union" not in plan


def test_pictures_stay_with_their_document(spark):
    rows = [(1, 0, 0, 0, "image", b"\x89a"), (1, 0, 1, 1, "image", None), (1, 1, 0, 0, "image", b"\x89b"), (1, 1, 0, 1, "text", None), (2, 0, 0, 0, "text", None)]
    blocks = spark.createDataFrame(rows, "doc_id long, page_no int, row_no int, block_no int, kind string, content binary").withColumn("text", F.lit("t"))
    margins = spark.createDataFrame([(2, 1.0, 2.0, 3.0, 4.0)], "doc_id long, left double, right double, top double, bottom double")
    for sides, own in ((None, 'w:left="1008"'), (margins, 'w:left="20"')):
        got = {r.doc_id: (r.files, zipfile.ZipFile(io.BytesIO(r.content))) for r in docx.written(blocks, sides).collect()}
        one, two = got[1][1], got[2][1]
        assert got[1][0] == 6 and [(n, one.read(n)) for n in one.namelist() if "media" in n] == [("word/media/image0_0.png", b"\x89a"), ("word/media/image1_0.png", b"\x89b")]
        assert one.read("word/_rels/document.xml.rels").count(b"Target=") == 2 and one.read("word/document.xml").count(b"<w:drawing>") == 2
        assert got[2][0] == 4 and own in two.read("word/document.xml").decode()


def test_plain_words_are_found_however_far_in(spark, monkeypatch):
    texts = ["one two three four five six seven", "1 2 3 " * 200 + "a, b. c! d? e; \u00e9f g", "x" * 300 + " a b c d e f", "a b c d e " + "longerthaneight " * 40 + "f\tg", "a b c d e", "", None, "  a\nb  c\vd e\u00a0e2 f g" + " h" * 200, "a b c d e " + "y" * 246 + "z f"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    got = [r.w for r in df.select(drawn._plain_words().alias("w")).collect()]
    assert got == [[w for x in re.split("[ \t-\r]+", text or "") for w in [re.sub("[^A-Za-z]", "", x)] if 1 <= len(w) <= 8][:6] for text in texts]


def test_lines_of_cells_are_joined_once(spark):
    plan = _plan(base.queries()["cell_runs"](spark, FOLDER))
    assert plan.count("ArrowEvalPython [joined_words") == 1 and plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
    assert "Broadcast" not in _plan(base.queries()["docx_rich_cells"](spark, FOLDER))


def test_words_of_one_extent_are_numbered_as_one_by_one(spark):
    def fold(words):
        number, high, low, last, out = -1, 0.0, 0.0, 0.0, []
        for t, b in words:
            off, touching = abs((t + b) / 2 - (high + low) / 2), b >= high - 0.5 and t <= low + 0.5
            if number >= 0 and (off <= 4.5 or (touching and off <= 8.0) or (t - last <= 3.0 and off <= 12.0)):
                high, low = min(high, t), max(low, b)
            else:
                number, high, low = number + 1, t, b
            last = b
            out.append(number)
        return out

    draw = random.Random(3)
    pages = {(d, p): [(y := draw.choice([0.0, 3.0, 5.5, 9.0, 14.0, 40.0]) + 0.5 * k, y + draw.choice([2.0, 10.0, 30.0])) for k in range(draw.randint(1, 30)) for _ in range(draw.choice([1, 1, 4]))] for d in range(30) for p in range(2)}
    pages = {k: [w for w in ws for _ in range(draw.choice([1, 3]))] for k, ws in pages.items()}
    rows = [(d, p, n, float(n), t, b) for (d, p), ws in pages.items() for n, (t, b) in enumerate(sorted(ws, key=lambda w: round((w[0] + w[1]) / 2, 1)))]
    wanted = {k: fold([r[4:] for r in rows if r[:2] == k]) for k in pages}
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = geometry.numbered_lines(spark.createDataFrame(rows, "doc_id long, page_no int, word_no long, x0 double, top double, bottom double").withColumn("x1", F.col("x0"))).orderBy("doc_id", "page_no", "word_no").collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {k: [r.line_no for r in got if (r.doc_id, r.page_no) == k] for k in pages} == wanted


def test_words_lie_by_their_text_until_lines_are_numbered(spark):
    plan = _plan(base.queries()["word_segments"](spark, FOLDER))
    assert "MapInArrow" not in plan and plan.count("Exchange") == 3 and "text" not in re.search(r"ArrowEvalPython.*", plan).group()


def test_words_stay_with_their_page_until_tables_are_found(spark):
    plan = _plan(base.queries()["word_tables"](spark, FOLDER))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_colours_of_pictures_are_counted_before_they_meet(spark):
    plan = _plan(base.queries()["images_indexed"](spark, FOLDER))
    assert "distinct" not in plan and "REPARTITION_BY_COL" not in plan
