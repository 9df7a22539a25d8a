"""Codecs, money, numbers and text rules on golden values."""

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import codecs, formatters, media, money, numbers, text, wrap


def one(spark, column, **values):
    """A column expression over one row of string values."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("r")).first().r


def many(spark, column, values, ddl="v string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, {ddl}")
    return [r.r for r in df.select("k", column.alias("r")).orderBy("k").collect()]


MONEY = [("0", "零元整"), ("0.00", "零元整"), ("0.01", "零元零壹分"), ("0.05", "零元零伍分"), ("0.10", "零元壹角"), ("1", "壹元整"), ("10", "壹拾元整"), ("11", "壹拾壹元整"), ("20", "贰拾元整"), ("100", "壹佰元整"), ("101", "壹佰零壹元整"), ("1001", "壹仟零壹元整"), ("1101", "壹仟壹佰零壹元整"), ("10000", "壹万元整"), ("10001", "壹万零壹元整"), ("100000000", "壹亿元整"), ("1,234.56", "壹仟贰佰叁拾肆元伍角陆分"), ("￥100", "壹佰元整"), ("¥1 000.50", "壹仟元伍角"), ("1.005", "壹元零壹分"), ("１２．３", "壹拾贰元叁角"), ("100010000", "壹亿零壹万元整"), ("1000000001", "壹拾亿零壹元整"), ("9999999999999999.99", "玖仟玖佰玖拾玖兆玖仟玖佰玖拾玖亿玖仟玖佰玖拾玖万玖仟玖佰玖拾玖元玖角玖分")]


def test_money(spark):
    found = many(spark, money.to_capital_money(F.col("v"), prefix=False), [m for m, _ in MONEY])
    assert [r.result for r in found] == [w for _, w in MONEY] and not any(r.error for r in found)
    assert one(spark, money.to_capital_money(F.col("v")), v="7").result == "人民币柒元整"
    bad = many(spark, money.to_capital_money(F.col("v")), ["", None, "-1", "abc", "1.2.3", "nan", "99999999999999999", "9999999999999999.995"])
    assert [r.error for r in bad] == ["empty", "empty", "negative", "invalid", "invalid", "invalid", "too large", "too large"] and not any(r.result for r in bad)


def test_base64(spark):
    texts = ["中文 Base64", "", "a" * 100, "é\n€", "hi"]
    for variant, coder in (("standard", base64.b64encode), ("urlsafe", base64.urlsafe_b64encode)):
        found = many(spark, codecs.encode_base64(F.col("v"), variant=variant), texts)
        assert [r.result for r in found] == [coder(t.encode()).decode() for t in texts]
    wrapped = one(spark, codecs.encode_base64(F.col("v"), wrap=64), v="a" * 100).result
    assert [len(x) for x in wrapped.split("\n")] == [64, 64, 8]
    for charset in ("utf-16", "latin-1"):
        assert one(spark, codecs.encode_base64(F.col("v"), charset=charset), v="né").result == base64.b64encode("né".encode(charset)).decode()
    assert one(spark, codecs.encode_base64(F.col("v"), charset="ascii"), v="né").result is None
    plain = lambda v, **o: one(spark, codecs.decode_base64(F.col("v"), **o), v=v)
    assert plain("5Lit 5paH\n").result == "中文" and plain("aGk").result == "hi" and plain("aGk").padding_added == 1
    raw = plain(base64.b64encode(b"\x00\xff\xfe").decode())
    assert (raw.raw_hex, raw.text_ok, raw.result, raw.error) == ("00fffe", False, "", None)
    assert plain("-_8=").raw_hex == "fbff" and plain("@@@not-base64@@@", strict=True).error and plain("  ").error == "empty input" and plain("aGk=", strict=True).result == "hi"
    assert plain(base64.b64encode("né".encode("utf-16")).decode(), charset="utf-16").result == "né"
    probes = many(spark, codecs.probe_base64(F.col("v")), ["", "SGVsbG8=", "hello world!!!", "abcde"])
    assert [p.reason for p in probes] == ["empty", None, "invalid_alphabet", "bad_length"]


def test_unicode_golden(spark):
    cases = [(r"\u4f60\u597d", "auto", "你好"), (r"\\u4e2d\\u6587", "auto", "中文"), (r"\u{4e2d}\U00004e2d", "auto", "中中"), ("%u4F60%u597D", "percent_u", "你好"), ("U+4E2D U+6587", "u_plus", "中 文"), ("&#x4f60;&#x597d;", "html_entity", "你好"), ("&#20013;&#25991;", "html_entity", "中文"), ("已经是中文", "auto", "已经是中文"), (r"\ud83d\ude00", "auto", "😀")]
    for raw, mode, wanted in cases:
        r = one(spark, codecs.decode_unicode(F.col("v"), mode=mode), v=raw)
        assert r.result == wanted and r.changed == (raw != wanted)
    assert one(spark, codecs.decode_unicode(F.col("v")), v=r"\U00110000").error and one(spark, codecs.decode_unicode(F.col("v")), v=r"\ud83d").error
    with pytest.raises(ValueError, match="mode"):
        codecs.decode_unicode(F.col("v"), mode="nope")
    encode = lambda v, **o: one(spark, codecs.encode_unicode(F.col("v"), **o), v=v)
    assert encode("A中B").result == r"A\u4e2dB" and encode("A中B").escaped_chars == 1
    assert encode("中", style="u_plus", uppercase=True).result == "U+4E2D" and encode("中", style="html_entity").result == "&#x4e2d;" and encode("中😀", style="percent_u", uppercase=True).result == r"%u4E2D\U0001F600"
    p = one(spark, codecs.probe_unicode(F.col("v")), v=r"\u4e2d %u4e2d U+4E2D &#x4e2d; \\u4e2d")
    assert p.likely and set(p.detected) == {"backslash_u", "double_backslash_u", "percent_u", "u_plus", "html_entity"}


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\\%&U"), max_size=40))
def test_unescape_inverts_escape(value):
    escaped = "".join(c if ord(c) < 128 else f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}" for c in value)
    assert codecs.unescape_text(escaped, "backslash_u")[0] == value


SPACING = [("你 好 世 界", "你好世界"), ("你好 ， 世界", "你好，世界"), ("第 1 章", "第1章"), ("版本 V2", "版本V2"), ("使用 Python 语言", "使用 Python 语言"), ("hello  world", "hello world"), ("这是一段话。 下一句", "这是一段话。下一句"), ("安装 、 调试", "安装、调试"), ("姓名\u3000\u3000张三", "姓名张三")]


def test_spacing(spark):
    assert many(spark, text.normalize_spacing(F.col("v")), [a for a, _ in SPACING]) == [b for _, b in SPACING]
    assert [wrap.spaced(a) for a, _ in SPACING] == [b for _, b in SPACING]
    joins = [("你好", "世界", "你好世界"), ("hello", "world", "hello world"), ("exam-", "ple", "example"), ("", "x", "x"), ("a", "", "a"), ("第", "1", "第1"), ("x (", "y", "x (y"), ("end.", "Next", "end.Next")]
    for a, b, wanted in joins[:6]:
        assert one(spark, text.soft_join(F.col("a"), F.col("b")), a=a, b=b) == wanted == wrap.join(a, b)
    lines = [("你好\n世界", "你好世界"), ("结束。\n下一句", "结束。\n下一句"), ("a\r\nb", "a b"), ("x\n1、y", "x\n1、y"), ("one", "one")]
    assert many(spark, text.normalize_newlines(F.col("v")), [a for a, _ in lines]) == [b for _, b in lines]


def test_column_and_worker_joins_agree(spark):
    draw = random.Random(2)
    parts = ["你好", "world", "V2", "，", "3", "a-", "(", ")", "end.", " x", "長い", "'q'"]
    pairs = [(draw.choice(parts) + draw.choice(parts), draw.choice(parts) + draw.choice(parts)) for _ in range(150)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    found = [r.r for r in df.select("k", text.soft_join(F.col("a"), F.col("b")).alias("r")).orderBy("k").collect()]
    assert found == [wrap.join(a, b) for a, b in pairs]


def test_names_and_paths(spark):
    raw = ["/a/b/报告 v1 (final).pdf", ".bashrc", "..", None, "x" * 120 + ".tar.gz", "a/b/", "日本.d!oc"]
    assert many(spark, text.safe_stem(F.col("v")), raw) == ["报告_v1_final", "bashrc", "output", "output", "x" * 80, "output", "日本"]
    assert many(spark, text.safe_name(F.col("v")), raw) == ["报告_v1_final.pdf", "bashrc", "file", "file", "x" * 80 + ".gz", "file", "日本.doc"]
    assert one(spark, text.content_disposition(F.col("v")), v="é a*b~.txt") == "inline; filename=\"_ a*b~.txt\"; filename*=UTF-8''%C3%A9%20a%2Ab~.txt"
    assert many(spark, text.root_path(F.col("v")), ["", "/", "x/", "/x/y"]) == ["", "", "/x", "/x/y"]
    assert one(spark, text.join_url(F.col("v"), F.lit("p")), v="/r/") == "/r/p"
    assert many(spark, text.password_errors(F.col("v")), ["Abcdef12345!", "short1", "12345678901", "abcdefghijkl"]) == [[], ["too short"], ["digits only", "needs a letter"], ["needs a digit or symbol"]]
    assert many(spark, text.font_family(F.col("v")), ["ABCDEF+SimSun-Bold", None, "Arial"]) == ["宋体", "宋体", "Arial"]
    stats = one(spark, text.text_statistics(F.col("v")), v="ab 中文\u2028x_1\r\n")
    assert (stats.chars, stats.chars_no_ws, stats.lines, stats.words) == (11, 7, 2, 4)


def test_page_ranges(spark):
    cases = [(None, 3, [0, 1, 2], None), ("1,3", 5, [0, 2], None), ("1-2,5", 5, [0, 1, 4], None), ("3,1,3", 5, [2, 0], None), ("0", 5, None, "range"), ("6", 5, None, "range"), ("3-1", 5, None, "order"), ("abc", 5, None, "syntax"), ("1-", 5, None, "syntax")]
    df = spark.createDataFrame([(k, s, n) for k, (s, n, _, _) in enumerate(cases)], "k int, s string, n int")
    found = df.select("k", numbers.page_range(F.col("s"), F.col("n")).alias("r")).orderBy("k").collect()
    assert [(r.r.pages, r.r.error) for r in found] == [(p, e) for _, _, p, e in cases]


def test_numbers(spark):
    assert many(spark, numbers.env_int(F.col("v"), 7, low=1, high=16), ["3", "x", None, "99", "-4"]) == [3, 7, 7, 16, 1]
    assert many(spark, numbers.env_bool(F.col("v")), ["1", " TRUE ", "no", "", None, "on"]) == [True, True, False, False, False, True]
    assert many(spark, numbers.upper_median(F.col("v")), [[4, 1, 3, 2], [5], [], [3, 1, 2]], "v array<int>") == [3, 5, None, 2]
    assert many(spark, numbers.parse_colour(F.col("v")), ["#fff", "#0a0B0c", "rgb(1, 300,-2)", "black", None, "teal", "fff"]) == [[255] * 3, [10, 11, 12], [1, 255, 0], [0] * 3, [255] * 3, None, None]
    assert many(spark, numbers.rgb_hex(F.col("v")), [[0.5], [1.0, 0.0, 0.2], []], "v array<double>") == ["808080", "FF0033", None]
    s = spark.range(1).select(numbers.size_statistics(F.lit(1000), F.lit(333)).alias("r")).first().r
    assert (s.saved, s.ratio, s.percent) == (667, 0.333, 66.7)
    align = lambda a, b: spark.range(1).select(numbers.horizontal_align(F.lit(a), F.lit(b), F.lit(600.0)).alias("r")).first().r
    assert [align(50.0, 550.0), align(250.0, 350.0), align(450.0, 580.0), align(40.0, 200.0)] == ["left", "center", "right", "left"]


def test_formatters(spark):
    run = lambda v, **o: one(spark, formatters.format_code(F.col("v"), **o), v=v)
    assert run('{"b":2,"a":1}', lang="json", mode="minify", sort_keys=True).result == '{"a":1,"b":2}'
    r = run('{"b": 1.0, "a": [1, 12345678901234567890], "a": null}', lang="json")
    assert (r.result, r.kind) == ('{\n  "b": 1.0,\n  "a": null\n}', "object")
    bad = run('{"a":\n x}', lang="json")
    assert bad.error and (bad.line, bad.col) == (2, 2) and run(" ", lang="js").error == "no input"
    assert run("<a><b>x</b><c/></a>", lang="xml").result == '<?xml version="1.0" ?>\n<a>\n  <b>x</b>\n  <c/>\n</a>\n' and run("<a>", lang="xml").error
    assert run('if(a){b("{;}");}// c', lang="js").result == 'if(a) {\n  b("{;}");\n}\n// c\n'
    assert run("int  a = 1 ;\nreturn  a ;", lang="c", mode="minify").result == "int a=1;return a;"
    assert run("a{b:c;d : e}", lang="css").result == "a {\n  b:c;\n  d : e;\n}\n".replace("e;\n}", "e\n}")
    assert run("a { b : c ; d : e ; }", lang="css", mode="minify").result == "a{b:c;d:e}"
    assert run("<div><p>x</p><br></div>", lang="html").result == "<div>\n  <p>\n    x\n  </p>\n  <br />\n</div>\n"
    assert run("select a from t where b and c", lang="sql").result == "SELECT a\nFROM t\nWHERE b\n  AND c\n"
    assert run("if x:\n\ty\n\n\n\n\tz", lang="py", indent=2).result == "if x:\n  y\n\n  z\n"
    with pytest.raises(ValueError, match="unknown"):
        formatters.format_code(F.col("v"), lang="cobol")


def test_media(spark):
    rows = [(bytearray(b"\xff\xd8\xff123"), "x.png"), (bytearray(b"\x89PNG\r\n\x1a\nz"), ""), (bytearray(b"GIF89a"), None), (bytearray(b"<?xml version='1.0'?>\n<svg width='3.5'>"), ""), (bytearray(b"zz"), "a.JPG"), (bytearray(b""), "a.png"), (bytearray(b"RIFF1234WEBPVP8"), ""), (bytearray(b"\x1f\x8bzz"), "a.svgz")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, d binary, n string")
    found = df.select("k", media.detect_format(F.col("d"), F.col("n")).alias("a"), media.detect_raster(F.col("d"), F.col("n")).alias("b")).orderBy("k").collect()
    assert [r.a for r in found] == ["jpeg", "png", "gif", "svg", "jpeg", None, None, None]
    assert [r.b for r in found] == ["jpeg", "png", "gif", None, "jpeg", None, "webp", None]
    svg = one(spark, media.minify_svg(F.col("v")), v='<svg  width = "10">\n  <!-- c -->\n <g /> </svg>')
    assert (svg.result, svg.width, svg.height) == ('<svg width="10"><g/></svg>', 10.0, None)
    assert many(spark, media.normalized_target(F.col("v")), ["JPG", " tif", "svg"]) == ["jpeg", "tiff", None]
