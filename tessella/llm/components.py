"""Connected components of a graph that no machine needs to hold.

Alternating large-star and small-star steps (Kiveris et al. 2014).  A node of
any degree is met in parts, and each round is written before the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.workspace import Workspace


def with_minimum(rows: DataFrame, key: str, value: Column, spread: Column, name: str) -> DataFrame:
    """Adds the least value of each key; no task takes a key with many rows whole.

    Rows are dealt by the key and a hash of ``spread``.  Each part's least is
    found first, then the key's, which goes back to the parts there are: as
    many as shuffle partitions at most.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    low = dealt.groupBy(key, "_part").agg(F.min(value).alias("_low")).groupBy(key).agg(F.min("_low").alias(name), F.collect_list("_part").alias("_parts"))
    return dealt.join(low.select(key, name, F.explode("_parts").alias("_part")), [key, "_part"]).drop("_part")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = with_minimum(both, "a", F.col("b"), F.col("b"), "m").where("b > a")
    return met.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    met = with_minimum(down, "a", F.col("b"), F.col("b"), "m")
    across = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.unionByName(met.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) of all nodes but the roots; root: the smallest node of the component.

    edges: (a, b); loops and repeats do no harm.
    """
    edges = work.keep(edges.where("a <> b").distinct(), "edges0")
    state, turn = None, 0
    while True:
        turn += 1
        edges = work.keep(_small_star(_large_star(edges)), f"edges{turn}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(now)
