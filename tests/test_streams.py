"""Streams with state that expires, against their batch forms and exact cases."""

import random

import pytest

from tessella.operators import limits
from tessella.streaming import state
from tessella.streaming.replay import replayed

HIT = "key string, t double, item long, failed boolean"


def drained(spark, stream, folder, mode="append"):
    """Runs a stream over what has come so far and returns the rows that this gave."""
    got = []
    with state.state_store(spark):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/ck").foreachBatch(lambda d, _: got.extend(d.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
    return got


def test_replays_equal_the_batch_forms(spark):
    draw = random.Random(4)
    rows = [(draw.choice("ab"), float(draw.randint(1, 4000)), k, draw.random() < 0.7 or None) for k in range(300)]
    df = spark.createDataFrame(rows, HIT)
    found = replayed(df, lambda s: state.limited(s, limit=3, window=90.0), time="t", slices=2)
    wanted = limits.rate_limit(df, key="key", time="t", item="item", limit=3, window=90.0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    found = replayed(df, lambda s: state.locked(s, max_failures=3, window=120.0, lockout=200.5), time="t", slices=2)
    wanted = limits.lockouts(df, key="key", time="t", item="item", failed="failed", max_failures=3, window=120.0, lockout=200.5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    assert replayed(df.where("false"), lambda s: state.limited(s, limit=3, window=90.0), time="t", slices=1).count() == 0


def test_a_limiter_carries_on(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.createDataFrame([("k", 30.0, 3, False), ("j", 30.0, 4, False), ("k", 70.0, 5, False)], HIT).coalesce(1).write.parquet(path)
    before = spark.createDataFrame([("k", 0.0), ("k", 20.0)], "key string, t double")
    stream = state.limited(spark.readStream.schema(HIT).parquet(path), limit=2, window=60.0, initial=before)
    assert {(r["item"], r.allowed, r.remaining, r.retry_after) for r in drained(spark, stream, tmp_path)} == {(3, False, 0, 31), (4, True, 1, 0), (5, True, 0, 0)}


@pytest.mark.parametrize("idle", [50.0, 5000.0])
def test_jobs_expire(spark, tmp_path, idle):
    path, schema = f"file://{tmp_path}/in", "job string, t double, item long, status string"
    seen = []
    for rows in ([("a", 9.0, 1, "queued"), ("a", 9.0, 2, "running"), ("b", 10.0, 3, "queued")], [("b", 9 + idle, 4, "done")], [("c", 10 + idle, 5, "queued")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = state.job_states(spark.readStream.schema(schema).parquet(path), ttl=100.0, late="0 seconds")
        seen.append({(r.job, r.status) for r in drained(spark, stream, tmp_path, "update")})
    gone = {("a", "reclaimed")} if idle > 100 else set()
    assert seen[0] == {("a", "running"), ("b", "queued")}
    assert set().union(*seen[1:]) == {("b", "done"), ("c", "queued")} | gone
