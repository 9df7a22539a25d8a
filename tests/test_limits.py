"""Limits of busy keys, cut into stretches, against the fold of whole keys."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import limits


def hits(seed, n, span, keys):
    draw = random.Random(seed)
    times = [float(draw.choice((draw.randint(0, span), draw.randint(0, span // 10)))) if draw.random() < 0.8 else draw.uniform(0, span) for _ in range(n)]
    return [(draw.choice(keys), t, k, draw.random() < 0.7 or None) for k, t in enumerate(times)]


@pytest.mark.parametrize(("seed", "span", "limit", "window"), [(1, 3000, 3, 20.0), (2, 3000, 1, 7.5), (3, 40000, 2, 30.0), (4, 300, 5, 1.0), (5, 9000, 12, 60.0)])
def test_spread_limits_equal_the_fold(spark, seed, span, limit, window):
    df = spark.createDataFrame(hits(seed, 1200, span, ("hot", "hot", "hot", "x", None)), "key string, t double, item long, failed boolean")
    asked = dict(key="key", time="t", item="item")
    for op, more in ((limits.rate_limit, dict(limit=limit, window=window)), (limits.lockouts, dict(failed="failed", max_failures=limit + 1, window=window, lockout=window * 1.7)), (limits.lockouts, dict(failed="failed", max_failures=limit, window=window, lockout=window / 3))):
        whole, parts = op(df, **asked, **more), op(df, **asked, **more, spread=True)
        assert whole.columns == parts.columns
        assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))


def test_a_hot_key_is_dealt_to_many_parts(spark):
    k = F.col("id")
    at = F.when(k % 500 < 5, F.floor(k / 500) * 5000).otherwise(k * 10 + k % 7).cast("double")
    rows = spark.range(20000).select(F.lit("unknown").alias("key"), at.alias("_t"), k.alias("item"), F.lit(True).alias("_bad"))
    cut = limits._stretches(rows, key="key", item="item", window=30.0, horizon=30.0, most=4)
    sizes = [r["count"] for r in cut.groupBy("_folded", "_part").count().collect()]
    assert sum(sizes) == 20000 and len(sizes) > 100 and max(sizes) < 200
    empty = limits.rate_limit(rows.where("false").withColumnRenamed("_t", "t"), key="key", time="t", item="item", limit=4, window=30.0, spread=True)
    assert empty.count() == 0
