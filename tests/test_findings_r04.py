"""Cases that the review of the fourth round found: texts that are null, empty or very long, and steps that wrote too much or took too long."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import wrap
from tessella.operators import folds, geometry, markdown, strokes
from tessella.plans import catalog as base
from tessella.plans import drawn, tables

ODD = [None, "", " ", "\n", "\r\n", "a", "ab", "abc", "é\n€ 😀", "?>~ÿ" * 40, "x" * 48, "x" * 49, "a\x00b", "\ufeffb", "\ufffd", "plain words\n" * 3000]


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(str(d / "documents.parquet"))
    return str(d)


def by_sql(name: str, sf_dir: str, *tables: str) -> list[tuple]:
    db = duckdb.connect()
    for table in tables:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet/*.parquet'")
    return sorted(db.execute(base.oracle_sql()[name]).fetchall(), key=repr)


@pytest.mark.parametrize("name", ["base64_round_trip", "base64_encoded", "unicode_round_trip"])
def test_odd_texts_come_back_as_they_were(spark, odd_texts, name):
    assert sorted(map(tuple, base.queries()[name](spark, odd_texts).collect()), key=repr) == by_sql(name, odd_texts, "documents")


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("long")
    rows = [(1, "some words 12 of a line\n" * 12_000), (2, None), (3, ""), (4, "one\n\n two"), (5, "\n".join(f"line {k % 7}" for k in range(60)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(d / "documents.parquet"))
    return str(d)


@pytest.mark.parametrize("name", ["markdown_blocks", "markdown_html"])
def test_texts_of_any_length_are_read_whole(spark, long_texts, name):
    assert sorted(map(tuple, base.queries()[name](spark, long_texts).collect()), key=repr) == by_sql(name, long_texts, "documents")


@pytest.mark.parametrize("name", ["markdown_html", "markdown_blocks"])
def test_texts_are_shuffled_once_and_their_lines_never(spark, name):
    plan = base.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Window" not in plan and "Join" not in plan
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") + (name == "markdown_blocks")  # the blocks of a kind are counted once more


LINES = {
    "code in two kinds of fence": ("~~~\n```\n~~~\n```", "<pre><code>```\n</code></pre>\n<p>```</p>"),
    "a line separator ends no line": ("# a\u2028b\n\n- c\u2028\nd", "<p># a\u2028b</p>\n<ul>\n<li>c<br>\nd</li>\n</ul>"),
    "rules of marks that are far apart": ("-  -  -\n-   - -", "<hr>\n<ul>\n<li>- -</li>\n</ul>"),
    "quotes within a list": ("- a\n> b\n\n> c", "<ul>\n<li>a</li>\n</ul>\n<blockquote>\n<ul>\n<li>b</li>\n</ul>\n<p>c</p>\n</blockquote>"),
    "code after a list": ("    x\n\n- a\n\n    b", "<pre><code>x\n</code></pre>\n<ul>\n<li>a<br>\nb</li>\n</ul>"),
    "headings of no letters": ("# !\n# ?\n# a\n# a", '<h1 id="_1">!</h1>\n<h1 id="_2">?</h1>\n<h1 id="a">a</h1>\n<h1 id="a_1">a</h1>'),
}


def test_lines_of_markdown_come_out_as_by_windows(spark):
    """What the windows over lines gave that were there before, for cases that the other tests leave out."""
    df = spark.createDataFrame([(k, v[0]) for k, v in LINES.items()], "k string, t string")
    assert {r.k: r.html for r in markdown.rendered(df, key="k", text="t").collect()} == {k: v[1] for k, v in LINES.items()}


@pytest.mark.parametrize("name", ["stroke_cells", "stroke_tables"])
def test_pages_of_strokes_are_sorted_once_and_only_their_rows_travel(spark, name):
    plan = base.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert plan.count("MapInArrow") == 1 and "Aggregate" not in below
    # strokes were exploded from rows, and windows over them found edges, crossings and corners
    assert len(re.findall(r"row_number\(\) windowspecdefinition\(doc_id", below)) == 1 and below.count("Generate explode") == 1


def test_rows_that_draw_strokes_give_the_cells_of_the_strokes(spark):
    c = [np.array(x) for x in ([0, 1, 2, 0, 1, 0, 0], [3, 3, 3, 2, 2, 1, 1], [0, 0, 0, 1, 1, 0, 0], [4, 4, 4, 2, 2, 3, 0], [7, 7, 7, 2, 2, -5, 1], [True, False, False, False, False, False, False])]
    top, bottom = np.array([100.0, 115, 130, 200, 212, 100, 100]), np.array([115.0, 130, 150, 212, np.nan, 120, 120])
    own, box = drawn._drawn(*c, top, bottom)
    page = np.array([1, 1, 1, 1, 1, 2, 3])
    drawn_rows = [(int(page[k]), 0, *(None if np.isnan(b[j]) else float(b[j]) for b in box)) for j, k in enumerate(own)]
    plain = strokes.table_cells(spark.createDataFrame(drawn_rows, "doc_id long, page_no int, x0 double, x1 double, top double, bottom double"))
    rows = list(zip(page.tolist(), [0] * 7, *(x.tolist() for x in c), top.tolist(), bottom.tolist(), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, page_no int, r long, rows long, t int, columns long, first long, merged boolean, top double, bottom double")
    got = strokes.table_cells(df, reads=tuple(df.columns[2:]), draws=drawn._drawn)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() == 11 + 2 + 3


@pytest.mark.parametrize("size", [1, 3, 1000])
@pytest.mark.parametrize("least", [1, 4, 1000])
def test_places_are_whole_however_batches_fall(size, least):
    rows = pa.table({"v": list(range(9)), "_place": [1, 2, 3, 4, 1, 1, 2, 3, 1]})
    got = [(t.column("v").to_pylist(), first.tolist()) for t, first in folds.whole_places(iter(rows.to_batches(size)), least)]
    assert [v for part, _ in got for v in part] == list(range(9)) and all(first[0] for _, first in got)
    assert [f for _, first in got for f in first] == [p == 1 for p in rows.column("_place").to_pylist()]
    assert least == 1000 or len(got) > 1


def test_paragraphs_of_texts_need_one_shuffle_and_no_rows_of_words(spark):
    plan = base.queries()["page_paragraphs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1 and "Join" not in plan and "Generate" not in plan


@pytest.mark.parametrize("chars", [40, geometry.CHARS])
def test_paragraphs_of_set_pages_are_those_of_their_words(spark, odd_texts, monkeypatch, chars):
    monkeypatch.setattr(geometry, "CHARS", chars)
    texts = [("It's a long line of words, (set) in ten columns. " * 7, 1), ("汉字 很多 的 一 行 it' s l'homme 12 字 and\nmore \n words x- y\n\n" * 3, 2), ("", 3), (None, 4), ("a  b   c", 5), ("twin " * 9, 6), ("twin too " * 15, 6), ("x\x01y z " * 12, 7), ("1. one line of words that is full up to its end and 2) two", 8)]
    docs = spark.createDataFrame([(k, 0, t) for t, k in texts], "doc_id long, page_no int, text string").union(spark.read.parquet(f"{odd_texts}/documents.parquet").selectExpr("doc_id + 100", "0", "text"))
    got = geometry.set_paragraphs(docs, text="text", sets=tables.set_words, page_width=595.0, page_right=595.0)
    # two texts of one page are set over each other, so their words come in either order
    apart = docs.where("doc_id <> 6")
    apart.select("doc_id", "text").write.mode("overwrite").parquet(f"{odd_texts}/apart/documents.parquet")
    wanted = geometry.paragraphs(geometry.text_blocks(tables.words(spark, f"{odd_texts}/apart"), 595.0), page_right=595.0)
    assert got.dtypes == wanted.dtypes
    assert sorted(map(tuple, got.where("doc_id <> 6").collect())) == sorted(map(tuple, wanted.collect()))
    assert sum(r.text.count("twin") for r in got.where("doc_id = 6").collect()) == 24


def test_plain_lines_are_joined_as_word_by_word():
    draw = random.Random(4)
    bits = ["a", "word", "it's", "'", "汉", "-", "(x", "y)", ">", "<", ",", "1", "\n", "é", "·", ".", "\t", "\xa0", "_", '"', "²"]
    easy = 0
    for _ in range(4000):
        words, line, x = [], "", 0.0
        for k in range(draw.randrange(1, 7)):
            gap = draw.choice([0, 0.5, 2, 8, 8.5, 50])
            text, x = "".join(draw.choice(bits) for _ in range(draw.choice([1, 1, 2]))), x + gap
            line += ("" if not k or gap <= 1 else wrap.NARROW if gap <= 8 else " ") + text
            words.append({"text": text, "x0": x, "x1": x})
        joined = wrap.easily_joined(line)
        easy += joined is not None
        assert joined in (None, wrap.gap_join(words))
    assert easy > 1000


def test_marks_are_searched_only_where_they_can_be(spark):
    cases = {"plain": "plain", "a...b -- c --- d": "a…b – c — d", "\"a\" ('b') it's": "“a” (‘b’) it’s", "a & b &amp; `c`": "a &amp; b &amp; <code>c</code>", "**a** _b_ __c__ *d*\n": "<strong>a</strong> <em>b</em> <strong>c</strong> <em>d</em><br>\n", "\\*a\\* [x](u)": '*a* <a href="u" rel="nofollow" target="_blank">x</a>', "a < b": "a &lt; b"}
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", markdown.inline(F.col("t")).alias("h"))
    assert {r.t: r.h for r in df.collect()} == cases | {None: None}
