"""Records, packages, catalog, limits, geometry, sources and streams against plain Python."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.functions import wrap
from tessella.operators import catalog, geometry, limits, packages, records
from tessella.sources import files, gated, settings
from tessella.streaming import state

NOW = datetime(2024, 6, 1, 12)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- records and packages


def record_rows(spark):
    rows = [("a", "pdf", "A.pdf", datetime(2024, 5, 1), "x/1", 10), ("b", "", "B.pdf", datetime(2024, 5, 31), "x/2", 20), ("c", None, "c", datetime(2024, 5, 31), "../x", None), ("d", "unknown", "D", None, "", 5)]
    return spark.createDataFrame(rows, "id string, tool string, original_name string, created_at timestamp, input_rel string, input_bytes long")


def test_records(spark):
    r = record_rows(spark)
    assert [x[0] for x in rows_of(records.latest(r, 0))] == ["c"] and [x[0] for x in rows_of(records.latest(r, 50))] == ["c", "b", "a", "d"]
    assert [x[0] for x in rows_of(records.search(r, q=" PDF ", limit=1))] == [] and {x[0] for x in rows_of(records.search(r, q="pdf"))} == {"a", "b"}
    assert dict(rows_of(records.counts_by_tool(r))) == {"pdf": 1, "unknown": 3}
    assert rows_of(records.totals(r)) == [(4, 35)] and rows_of(records.totals(r.where("false"))) == [(0, 0)]
    there = spark.createDataFrame([("x/1",), ("../x",), ("x/9",)], "path string")
    assert {x.id: x.file_exists for x in records.with_presence(r, there).collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert {x[0] for x in rows_of(records.purged(r, NOW, 5))} == {"a", "d"} and {x[0] for x in rows_of(records.retained(r, NOW, 5))} == {"b", "c"}
    ids = spark.createDataFrame([("a",), ("zz",), ("a",)], "id string")
    assert rows_of(records.found(r, ids)) == [(1,)] and records.without(r, ids).count() == 3
    new = r.where("id = 'a'").unionByName(r.where("id = 'b'").withColumn("id", F.lit("n")))
    assert records.inserted_or_ignored(r, new).count() == 5
    packed = records.packed_extra(r.withColumn("pages", F.lit(3)))
    assert {x.id: x.extra["pages"] for x in records.unpacked_extra(packed).collect()} == dict.fromkeys("abcd", "3")
    assert spark.range(1).select(records.ordered_ids(F.array(F.lit(" b"), F.lit("a"), F.lit("b"), F.lit(" "))).alias("r")).first().r == ["b", "a"]


def package_rows(spark):
    rows = [("p1", "000001", "Alpha", "x", 1, "2024-05-02T00:00:00Z", "2024-06-02T00:00:00Z", 1, 0, ""), ("p2", "000002", "b", "x", 2, "2024-05-01T00:00:00Z", "2024-06-01T12:00:00Z", 0, 9, ""), ("p3", "000003", "c", "x", 3, "2024-04-01T00:00:00Z", "", 2, 2, "alpha"), ("p4", "000004", "d", "y", 4, "2024-03-01T00:00:00Z", "2024-06-02T00:00:00Z", 2, 2, ""), ("p5", "000005", "e", "y", 4, "2024-02-01T00:00:00Z", "2024-06-02T00:00:00Z", 0, 2, "")]
    return spark.createDataFrame(rows, "id string, code string, original_name string, stored_rel string, size_bytes long, created_at string, expires_at string, max_downloads int, download_count int, note string")


def test_packages(spark):
    p = package_rows(spark).withColumn("file_exists", F.col("stored_rel") == "x")
    got = {r.id: (r.expired, r.exhausted, r.available, r.downloads_left, r.seconds_remaining) for r in packages.with_state(p, NOW).collect()}
    assert got == {"p1": (False, False, True, 1, 43200), "p2": (True, False, False, None, 0), "p3": (True, True, False, 0, None), "p4": (False, True, False, 0, 43200), "p5": (False, False, True, None, 43200)}
    s = packages.with_state(p, NOW)
    ids = lambda **o: [r.id for r in packages.listing(s, **o).collect()]
    assert ids() == ["p1", "p2", "p3", "p4", "p5"] and ids(q="ALPHA") == ["p1", "p3"] and ids(status="expired") == ["p2", "p3"] and ids(status="exhausted") == ["p4"] and ids(status="available") == ["p1"] and ids(status="missing") == ["p4", "p5"] and ids(q="it's \\") == []
    asked = spark.createDataFrame([(1, " 000 001"), (2, "000001"), (3, "000002"), (4, "000009"), (5, "abc"), (6, "000004"), (7, "000005"), (8, None)], "claim_no int, code string")
    out = packages.claims(p, asked, NOW)
    assert {r.claim_no: r.error for r in out.collect()} == {1: None, 2: "exhausted", 3: "expired", 4: "invalid", 5: "invalid", 6: "exhausted", 7: "missing", 8: "invalid"}
    assert {r.id: r.download_count for r in packages.after_claims(p, out).collect()} == {"p1": 1, "p2": 9, "p3": 2, "p4": 2, "p5": 2}
    assert {r.id for r in packages.unexpired(p, NOW).collect()} == {"p1", "p4", "p5"}
    codes = packages.fresh_codes(spark.range(300).select(F.col("id").cast("string").alias("id")), p).collect()
    assert len({r.code for r in codes}) == 300 and all(len(r.code) == 6 for r in codes)
    raw = spark.createDataFrame([("n", "1", "o", "s", 1, "t", 999, 5000, "x" * 300)], "id string, code string, original_name string, stored_rel string, size_bytes long, content_type string, ttl_hours int, max_downloads int, note string")
    made = packages.new_package(raw, NOW).first()
    assert (made.expires_at, made.max_downloads, len(made.note)) == ("2024-06-08T12:00:00Z", 1000, 200)


def test_catalog(spark):
    t = spark.createDataFrame([(0, "a", "A", "x", "c1", True), (1, "b", "B", "y", "c1", None), (2, "c", "C", "z", "??", False), (3, "a", "again", "", "c2", False)], "pos int, slug string, name string, description string, category string, featured boolean")
    c = spark.createDataFrame([("c1", "One"), ("c2", "Two"), ("c3", "Three")], "id string, name string")
    first = catalog.union_first(t.where("pos > 0"), t.where("pos = 0"))
    assert {r.slug: r.name for r in first.collect()} == {"a": "again", "b": "B", "c": "C"}
    off = spark.createDataFrame([("b",)], "slug string")
    assert {r.slug for r in catalog.enabled(t.where("pos < 3"), off).collect()} == {"c"} and {r.slug for r in catalog.featured(t, off).collect()} == {"a"}
    nested = {r.category: [x.slug for x in r.tools] for r in catalog.by_category(c, t.where("pos < 3")).collect()}
    assert nested == {"c1": ["a", "b"], "_other": ["c"]}
    assert {r.id: r.n_tools for r in catalog.navigation(c, t.where("pos < 3")).collect()} == {"c1": 2, "c2": 0, "c3": 0}
    flags = spark.createDataFrame([("a", True), ("b", False)], "slug string, enabled boolean")
    updates = spark.createDataFrame([("a", False), ("zz", True)], "slug string, enabled boolean")
    after = catalog.with_override(flags, updates)
    assert catalog.flag_map(after).first().flags == {"a": False, "b": False}
    assert settings.flags_json(after).first().json == '{"version":1,"disabled":["a","b"]}'
    path = spark.createDataFrame([("/tools/Old/x?y",), ("/tools/",), ("/other/a",)], "p string").select(catalog.slug_of_path(F.col("p"), {"Old": "new"}).alias("s"), catalog.is_public_convert(F.lit("/tools/a/convert"), F.lit("post")).alias("q")).collect()
    assert [r.s for r in path] == ["new", None, None] and path[0].q
    recent = spark.createDataFrame([("b", 0)], "slug string, recent_rank int")
    assert [r.slug for r in catalog.palette(t.where("pos < 3"), recent).collect()] == ["b", "a", "c"]


# ---------------------------------------------------------------- folds


def test_rate_limit_matches_a_loop(spark):
    draw = random.Random(1)
    hits = [(draw.choice("xyz"), float(draw.randint(0, 300)), k) for k in range(400)]
    df = spark.createDataFrame(hits, "key string, t double, item long")
    found = {r.item: (r.allowed, r.remaining) for r in limits.rate_limit(df, key="key", time="t", item="item", limit=3, window=20.0).collect()}
    held, wanted = {}, {}
    for key, t, k in sorted(hits, key=lambda h: (h[1], h[2])):
        mine = [x for x in held.get(key, []) if x >= t - 20.0]
        ok = len(mine) < 3
        held[key] = mine + [t] * ok
        wanted[k] = (ok, max(0, 3 - len(held[key])))
    assert found == wanted
    free = limits.rate_limit(df, key="key", time="t", item="item", limit=0, window=1.0).collect()
    assert all(r.allowed and r.remaining == -1 for r in free)


def test_lockouts(spark):
    rows = [("k", float(t), n, f) for n, (t, f) in enumerate([(0, True), (1, True), (2, False), (3, True), (4, True), (5, True), (6, True), (14, False), (16, True)])]
    got = limits.lockouts(spark.createDataFrame(rows, "key string, t double, item long, failed boolean"), key="key", time="t", item="item", failed="failed", max_failures=3, window=60.0, lockout=10.0).orderBy("item").collect()
    assert [r.sets_lock for r in got] == [False] * 5 + [True] + [False] * 3 and [r.locked for r in got] == [False] * 6 + [True, True, False]


def test_jobs(spark):
    rows = [("j", 1, 1, "queued", None), ("j", 2, 2, "done", 0.5), ("j", 2, 3, None, 1.0)]
    last = limits.latest_state(spark.createDataFrame(rows, "job string, ts int, n int, status string, progress double"), key="job", time="ts", order="n", fields=("status", "progress")).first()
    assert (last.status, last.progress, last.created_at, last.updated_at) == ("done", 1.0, 1, 2)
    jobs = spark.createDataFrame([("a", "done", NOW, NOW), ("b", "running", datetime(2020, 1, 1), None), ("c", "error", datetime(2024, 6, 1, 10), None), ("d", "done", NOW, None)], "job string, status string, updated_at timestamp, downloaded_at timestamp")
    assert {r.job for r in jobs.where(limits.reclaimable(F.lit(datetime(2024, 6, 1, 12, 1)))).collect()} == {"a", "c"}
    assert spark.range(1).select(limits.client_key(F.lit(" 1.2.3.4 , x"), F.lit("h")).alias("r")).first().r == "1.2.3.4"


# ---------------------------------------------------------------- geometry


def word(n, text, x0, x1, top, size=10.0, font="F", height=12.0):
    return (1, 0, n, text, float(x0), float(x1), float(top), float(top) + height, size, font)


WORD = "doc_id long, page_no int, word_no long, text string, x0 double, x1 double, top double, bottom double, size double, fontname string"


def test_lines_and_blocks(spark):
    words = [word(0, "10", 72, 84, 102.5), word(1, "、进入", 86, 120, 100), word(2, "right", 400, 440, 101, 14.0, "B"), word(3, "next", 72, 100, 130), word(4, "line", 103, 120, 130)]
    blocks = geometry.text_blocks(spark.createDataFrame(words, WORD), 600.0).orderBy("line_no", "seg_no").collect()
    assert [b.text for b in blocks] == ["10、进入", "right", "next line"] and blocks[1].font_size == 14.0 and blocks[0].x1 == 120.0


def test_gap_join():
    glyphs = lambda *p: [{"text": t, "x0": a, "x1": b} for t, a, b in p]
    assert wrap.gap_join(glyphs(("你", 0, 12), ("好", 14, 26), ("，", 27, 33), ("世", 34, 46), ("界", 48, 60))) == "你好，世界"
    assert wrap.gap_join(glyphs(("第", 0, 12), ("1", 13, 20), ("章", 21, 33))) == "第1章"
    assert wrap.gap_join(glyphs(("a", 0, 5), ("b", 8, 12), ("(c", 20, 30), ("d", 30.5, 40))) == "a b(cd"


def test_paragraphs(spark):
    body = "这是一段比较长的中文句子用于测试软换行合并是否生效"
    rows = [(1, 0, 0, 0, body, 10.0, 22.0, 50.0, 500.0, 11.0, "F", "left"), (1, 0, 1, 0, "后续内容继续写下去", 24.0, 36.0, 50.0, 300.0, 11.0, "F", "left"), (1, 0, 2, 0, "标题", 60.0, 72.0, 50.0, 90.0, 16.0, "F", "left")]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, line_no int, seg_no int, text string, top double, bottom double, x0 double, x1 double, font_size double, font_name string, align string")
    got = geometry.paragraphs(df, page_right=510.0).orderBy("block_no").collect()
    assert [r.text for r in got] == [body + "后续内容继续写下去", "标题"] and got[0].bottom == 36.0


def test_borders_fills_and_folds(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 100.0, 50.0)], "doc_id long, page_no int, cell_id int, x0 double, top double, x1 double, bottom double")
    lines = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 0.0, 50.0, 1.0, "A", False), (1, 0, 1, 0.5, 0.0, 0.5, 50.0, 2.0, "B", True), (1, 0, 2, 10.0, 50.5, 90.0, 50.5, 1.0, "C", False), (1, 0, 3, 0.0, 25.0, 100.0, 25.0, 9.0, "D", False)], "doc_id long, page_no int, line_no int, x0 double, top double, x1 double, bottom double, linewidth double, color string, dashed boolean")
    assert {r.edge: r.color for r in geometry.cell_borders(cells, lines).collect()} == {"left": "B", "bottom": "C"}
    fills = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 40.0, 50.0, "small"), (1, 0, 1, 0.0, 0.0, 60.0, 50.0, "half")], "doc_id long, page_no int, fill_no int, x0 double, top double, x1 double, bottom double, color string")
    assert [r.color for r in geometry.cell_fills(cells, fills).collect()] == ["half"]
    value = lambda c: spark.range(1).select(c.alias("r")).first().r
    array = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert value(geometry.aligned_columns(array(0, 10, 18, 19, 37, 38))) == 3 and value(geometry.distinct_within(array(5, 6, 9, 7), 2.0)) == [5.0, 9.0]
    assert [value(geometry.bin_of(F.lit(v), array(0, 100, 200))) for v in (-1.0, 0.0, 100.0, 500.0)] == [None, 0, 1, 1]
    rules = spark.createDataFrame([(1, 0, 0, 10.0, 0.0, 50.0), (1, 0, 1, 11.0, 1.0, 51.0), (1, 0, 2, 12.0, 0.0, 50.0)], "doc_id long, page_no int, rule_no long, top double, x0 double, x1 double")
    assert sorted(r.rule_no for r in geometry.kept_rules(rules).collect()) == [0, 2]
    boxes = spark.createDataFrame([(1, 0, 0, 0, 0.0, 0.0, 100.0, 100.0), (1, 0, 0, 1, 10.0, 10.0, 90.0, 90.0), (1, 0, 0, 2, 0.0, 0.0, 10.0, 5.0), (1, 0, 1, 0, 200.0, 0.0, 300.0, 100.0), (1, 0, 2, 0, 400.0, 0.0, 500.0, 100.0)], "doc_id long, page_no int, strategy int, find_no int, x0 double, top double, x1 double, bottom double")
    assert sorted((r.strategy, r.find_no) for r in geometry.kept_tables(boxes, 30_000.0).collect()) == [(0, 0), (1, 0)]
    blocks = spark.createDataFrame([(1, 0, 0, "text", 0.0, 10.0), (1, 0, 1, "table", 2.0, 12.0), (1, 0, 2, "image", 8.0, 20.0), (1, 0, 3, "text", 60.0, 70.0)], "doc_id long, page_no int, block_no int, kind string, top double, bottom double")
    assert [r.row_no for r in geometry.visual_rows(blocks).orderBy("block_no").collect()] == [0, 1, 0, 2]
    assert [r.kind for r in geometry.interleaved(blocks.where("kind = 'text'"), blocks.where("kind <> 'text'")).orderBy("place").collect()] == ["text", "table", "image", "text"]
    assert rows_of(geometry.count_blocks(blocks)) == [(1, 1, 2, 1, 1, 0)]


# ---------------------------------------------------------------- sources and streams


def test_settings(spark, tmp_path):
    (tmp_path / ".env").write_text("# no\nexport A=1 # tail\nB = \"x # y\" z\nA=2\nC='q'\nbad line\nD=\n")
    lines = settings.read_dotenv(spark, f"file://{tmp_path}/.env")
    assert dict(rows_of(settings.dotenv(lines))) == {"A": "2", "B": "x # y", "C": "q", "D": ""}
    old = spark.createDataFrame([("A", "0"), ("Z", "9")], "key string, value string")
    assert dict(rows_of(settings.dotenv(lines, old)))["A"] == "0" and dict(rows_of(settings.dotenv(lines, old, override=True)))["A"] == "2"
    known = spark.createDataFrame([("a",), ("b",), ("new",)], "slug string")
    text = spark.createDataFrame([('{"disabled": ["A ", "x"]}',), ('{"tools": {"b": "Off", "old": "0", "c": "yes"}}',), ("not json",)], "json string")
    assert {r.slug for r in settings.disabled_slugs(text, known, {"old": "new"}).collect()} == {"a", "b", "new"}


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"12345")
    (tmp_path / "y.json").write_text('[{"id": "1", "n": 2}, {"id": "2"}]')
    listed = files.listing(spark, f"file://{tmp_path}")
    assert {(r.path, r.length) for r in listed.collect()} >= {("d/x.bin", 5)} and records.stored_bytes(listed).first().files == 2
    assert files.json_records(spark, f"file://{tmp_path}/y.json", "id string, n int").count() == 2
    rows = spark.createDataFrame([("b", 0, "s", bytearray(b"0")), ("b", 1, "s", bytearray(b"1")), ("b", 2, "t", bytearray(b"2"))], "batch_id string, idx int, stem string, content binary")
    packed = files.zipped(files.entry_names(rows))
    assert packed.select(files.zip_entries("content").alias("n")).first().n == ["s.docx", "s_2.docx", "t.docx"]
    assert not packed.select(files.has_macros(F.col("content")).alias("m")).first().m


def test_missing_engines_are_named():
    for engine in gated.ENGINES.values():
        if engine.missing():
            with pytest.raises(gated.Unavailable, match=engine.name):
                engine.require()


def test_migration(spark):
    texts = [('[{"id": "a", "tool": "t", "input_bytes": 3.7, "created_at": "2024-01-02T03:04:05", "pages": 4}, 7, "x", null, {"id": "b", "input_bytes": "many", "created_at": "soon"}]',), ('{"id": "c"}',), ("[oops",), (None,), ('[{"id": "a", "tool": "u"}]',), ("[]",)]
    legacy = records.legacy_records(spark.createDataFrame(texts, "text string"), "text")
    assert legacy.where("id NOT IN ('a', 'b')").count() == 0
    empty = legacy.limit(0)
    got = {r.id: (r.tool, r.created_at, r.input_bytes, r.extra) for r in records.migrated(empty, legacy).collect()}
    assert got == {"a": ("t", datetime(2024, 1, 2, 3, 4, 5), 3, {"pages": "4"}), "b": ("", None, 0, {})}
    held = legacy.where("tool = 'u'")
    assert records.migrated(held, legacy).count() == 1
