"""Cases that the review of the third round found: tables of many times the size, and keys that are not unique there."""

import re
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import formatters, wrap
from tessella.operators import folds, geometry, packages, pixels
from tessella.plans import catalog as base
from tessella.plans import rules, tables
from tessella.streaming import replay, state
from tessella.streaming.replay import replayed

NOW = datetime(2024, 6, 1, 12)


def test_packages_of_one_code_do_not_use_up_each_others_claims(spark):
    rows = [(k, "000001", "2024-06-02T00:00:00Z", 2, 0, True) for k in (1, 2, 3)]
    p = spark.createDataFrame(rows, "id long, code string, expires_at string, max_downloads int, download_count int, file_exists boolean")
    out = packages.claims(p, spark.createDataFrame([(1, "000001"), (2, "000001"), (3, "000001")], "claim_no int, code string"), NOW)
    assert sorted((r.claim_no, r.package_id, r.error) for r in out.collect()) == [(c, k, "exhausted" if c == 3 else None) for c in (1, 2, 3) for k in (1, 2, 3)]
    assert {r.id: r.download_count for r in packages.after_claims(p, out).collect()} == {1: 2, 2: 2, 3: 2}


def test_codes_that_run_out_leave_the_last_ids_without_one(spark):
    taken = spark.range(999_990).selectExpr("lpad(cast(id as string), 6, '0') AS code")
    ids = spark.range(25).selectExpr("cast(id as string) AS id")
    got = packages.fresh_codes(ids, taken, strict=False).collect()
    order = [r.id for r in ids.orderBy(F.substring(F.md5("id"), 1, 3), "id").collect()]
    assert {r.id for r in got} == set(order[:10]) and sorted(r.code for r in got) == [str(k) for k in range(999_990, 1_000_000)]
    assert packages.fresh_codes(ids, spark.range(1_000_000).selectExpr("lpad(cast(id as string), 6, '0') AS code"), strict=False).count() == 0
    with pytest.raises(ValueError):
        packages.fresh_codes(ids, taken)


def test_reindenting_takes_no_table_a_text():
    text = "def f():\n\n\n\n\tif x:\r\n\t\treturn 1   \n"
    assert formatters.reindent(text, 4, 4) == "def f():\n\n    if x:\n        return 1\n"
    assert formatters.reindent(" a\u3000\n   b\x0b\n  \n\n\nc", 2, 2) == "  a\n      b\n\nc\n" and formatters.reindent("", 2, 2) == ""
    start = datetime.now()
    for _ in range(2000):
        formatters.reindent(text, 4, 4)
    assert (datetime.now() - start).total_seconds() < 2  # a pandas frame for each text took 3 ms


def test_notes_of_new_packages_cost_no_more_with_larger_numbers(spark, tmp_path):
    spark.createDataFrame([(k, f"c{k}") for k in (3, 199, 200, 201, 250_000_000)], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.id: len(r.note) for r in rules.packages_new(spark, str(tmp_path)).select("id", "note").collect()}
    assert got == {3: 3, 199: 199, 200: 200, 201: 200, 250_000_000: 200}


def _strategy(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["table_cells", "table_texts", "table_text_gaps", "table_fill_counts", "tables_accepted", "cell_edges", "cell_colours", "cells_merged", "rules_between_tables", "table_line_widths", "images_placed", "image_background", "image_transparent"])
def test_rows_that_grow_are_not_broadcast(spark, name):
    assert "Broadcast" not in _strategy(base.queries()[name](spark, "/root/testdata/sf0.001"))


def test_rows_are_dealt_to_tasks_by_their_number(spark):
    rows = spark.range(25).select(F.col("id").alias("k"))
    assert tables.dealt(rows, "k", 10).rdd.getNumPartitions() == 3 and tables.dealt(rows, "k").rdd.getNumPartitions() == 1
    assert tables.dealt(rows.limit(0), "k").count() == 0


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_keys_are_whole_however_batches_fall(size):
    rows = pa.table({"k": [1, 1, 1, 1, 2, 3, 3, 3, 4], "v": list(range(9))})
    got = [[t.column("v").to_pylist()[a:b] for a, b in runs] for t, runs in folds.whole_keys(iter(rows.to_batches(size)), ("k",))]
    assert [x for part in got for x in part] == [[0, 1, 2, 3], [4], [5, 6, 7], [8]]


def test_pages_and_images_need_no_group_of_pandas_each(spark):
    blocks = spark.createDataFrame([(1, 0, 0, "text", 0.0, 10.0), (2, 0, 0, "text", 5.0, None), (2, 0, 1, "table", None, 9.0), (2, 0, 2, None, 8.0, 0.0)], "doc_id long, page_no int, block_no int, kind string, top double, bottom double")
    rows = geometry.visual_rows(blocks)
    assert sorted((r.doc_id, r.block_no, r.row_no) for r in rows.collect()) == [(1, 0, 0), (2, 0, 0), (2, 1, 1), (2, 2, 0)]
    px = [(k, x, y, k, x, y % 256, 255 - x) for k in range(5) for x in range(2 + k) for y in range(300 if k == 4 else 2)]
    packed = pixels.to_png(spark.createDataFrame(px, pixels.PIXEL))
    assert sorted(map(tuple, pixels.from_png(packed).collect())) == sorted(px)
    assert not any("FlatMapGroups" in _strategy(df) for df in (rows, packed))


def test_long_paragraphs_are_joined_at_their_end():
    for line in ("a plain line of words that goes on and on", "汉字很多的一行没有空格也没有别的东西，还有逗号", "mixed 汉字 line with 12 字 and more words in it"):
        one = two = line
        for _ in range(60):
            one, two = wrap.join(one, line), wrap.joined(two, line)
        assert one == two
    start = datetime.now()
    text = line = "a plain line of words that goes on and on"
    for _ in range(5000):
        text = wrap.joined(text, line)
    assert (datetime.now() - start).total_seconds() < 5  # all of the text was spaced anew for each line


@pytest.mark.parametrize("name", ["stroke_cells", "stroke_tables"])
def test_strokes_stay_with_their_page(spark, name):
    plan = base.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id", plan)) == (name == "stroke_tables") and plan.count("FileScan parquet") == 2


@pytest.mark.parametrize("name", ["rate_limited_busy", "lockouts_busy"])
def test_busy_keys_are_cut_without_reading_a_window_for_each_row(spark, name):
    plan = base.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())" in plan
    assert not re.search(r"specifiedwindowframe\(RangeFrame, (?!unboundedpreceding)", plan)


def test_archives_are_packed_many_at_a_time(spark):
    packed = base.queries()["zip_entries"](spark, "/root/testdata/sf0.001")
    assert "FlatMapGroups" not in _strategy(packed)


def test_lines_are_joined_in_a_short_expression(spark):
    from tessella.functions import text

    df = spark.createDataFrame([("exam-", "ple"), ("汉字 ", "汉字"), (None, "x"), ("a", None), ("a  b", "c")], "a string, b string").select(text.soft_join(F.col("a"), F.col("b")).alias("t"))
    assert [r.t for r in df.collect()] == ["example", "汉字汉字", "x", "a", "a b c"]
    assert len(df._jdf.queryExecution().analyzed().toString()) < 20_000


@pytest.mark.parametrize("name", ["rate_limited_replay", "lockouts_replay"])
def test_replays_call_and_time_once_a_bucket_of_keys(spark, tmp_path, monkeypatch, name):
    counts = []

    def watched(rows, stream, *, time):
        rows.write.parquet(f"file://{tmp_path}/in")
        with state.state_store(spark):
            run = stream(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
            run.awaitTermination()
        counts.extend(p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in run.recentProgress)
        return replayed(rows, stream, time=time, slices=1)

    monkeypatch.setattr(base, "replayed", watched)
    found = base.queries()[name](spark, "/root/testdata/sf0.01")
    wanted = base.queries()[name.removesuffix("_replay")](spark, "/root/testdata/sf0.01").select(found.columns)
    assert found.count() == 10_000 and found.exceptAll(wanted).isEmpty()
    assert 0 < max(counts) <= 4  # one for each of 150 keys before


def test_a_replay_has_no_more_partitions_of_state_than_its_rows_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(replay, "STATE_ROWS", 50)
    old = spark.conf.get(state.PARTITIONS)
    spark.conf.set(state.PARTITIONS, "40")
    try:
        rows = spark.range(300).selectExpr("cast(id % 7 AS string) AS key", "cast(id + 1 AS double) AS t", "id AS item", "true AS failed")
        assert replayed(rows, lambda s: state.locked(s, max_failures=3, window=90.0, lockout=9.0), time="t", slices=1).count() == 300
        assert spark.conf.get(state.PARTITIONS) == "40"
    finally:
        spark.conf.set(state.PARTITIONS, old)
    assert len([p for p in (tmp_path / "state/state/0").iterdir() if p.name.isdigit()]) == max(6, spark.sparkContext.defaultParallelism)
