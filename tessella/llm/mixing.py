"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end; the line
is cut into blocks of ``BLOCK`` words.  The mix is a schedule of slots: the
point of slot k in the golden-ratio sequence, mapped through the cumulative
shares, names its source, and the slot's rank within the source is the block
it takes, starting over when the line is used up.  The sequence is off by a
few slots at most; slots beyond a source's quota go to sources that are short,
and a source's last slot is cut to the word.  The schedule is then joined with
the blocks, and what the slots take of each document is added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.ranks import copies, ranked
from tessella.llm.workspace import Workspace

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 1024
BUCKET_ROWS = 512  # rows of a bucket, about; the number of buckets follows the rows
STRETCH = 1 << 14
_GOLDEN = 1327217885  # the odd number next to 2^31 times the golden ratio's fraction
_ROUND = 1 << 31


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Plan:
    """What each source gives; one entry a source, null last."""

    names: list
    sizes: list[int]
    targets: list[float]
    block: int

    @property
    def quotas(self) -> list[int]:
        """Whole words to take of each source."""
        return [min(MOST * s, round(t)) for s, t in zip(self.sizes, self.targets, strict=True)]

    @property
    def blocks(self) -> list[int]:
        return [-(-s // self.block) for s in self.sizes]

    @property
    def slots(self) -> list[int]:
        """Slots of each source: whole passes over its blocks, then a part of one."""
        out = []
        for size, quota, blocks in zip(self.sizes, self.quotas, self.blocks, strict=True):
            passes, rest = divmod(quota, size) if size else (0, 0)
            out.append(passes * blocks + -(-rest // self.block))
        return out


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> list[float]:
    """Shares by weight; what a source has above its ``most`` times size is shared again among the others."""
    n = len(sizes)
    weight = [weights[k % len(weights)] for k in range(n)]
    out, open_, left = [0.0] * n, list(range(n)), share * sum(sizes)
    while open_:
        unit = left / sum(weight[k] for k in open_)
        above = [k for k in open_ if unit * weight[k] > most * sizes[k]]
        if not above:
            for k in open_:
                out[k] = unit * weight[k]
            break
        for k in above:
            out[k] = float(most * sizes[k])
            left -= out[k]
        open_ = [k for k in open_ if k not in set(above)]
    return out


def plan(rows: DataFrame, weights: tuple[int, ...], share: float, block: int) -> tuple[Plan, int]:
    """Sources by code point, null last, and the number of rows.  The driver gets one row a source."""
    found = [(r[0], int(r[1]), r[2]) for r in rows.groupBy("source").agg(F.sum("size"), F.count("*")).collect()]
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [s for _, s, _ in found]
    return Plan([n for n, _, _ in found], sizes, targets(sizes, weights, share), block), sum(n for _, _, n in found)


def schedule(spark: SparkSession, p: Plan, work: Workspace) -> DataFrame:
    """(k, sid, rank) of every slot; each source has exactly its number of slots."""
    slots = p.slots
    total = sum(slots)
    edges = np.cumsum(np.array(slots, dtype=np.float64)) / max(total, 1)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.asarray(batch.column(0))
            point = ((k % _ROUND) * _GOLDEN + k // _ROUND) % _ROUND / _ROUND
            sid = np.minimum(np.searchsorted(edges, point, side="right"), len(edges) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sid.astype(np.int32))], names=["k", "sid"])

    stretch = F.floor(F.col("k") / STRETCH)
    drawn = ranked(spark.range(total).mapInArrow(named, "k long, sid int"), ["sid"], "k", stretch, "rank")
    quotas = spark.createDataFrame(list(enumerate(slots)), "sid int, slots long")
    drawn = work.keep(drawn.join(quotas, "sid").withColumn("over", F.col("rank") >= F.col("slots")).select("k", "sid", "rank", "over"), "drawn")
    kept = drawn.where("NOT over").select("k", "sid", "rank")
    # Surplus slots, in order, fill up the sources that are short.
    got = {r[0]: r[1] for r in kept.groupBy("sid").count().collect()}
    short = [(s, got.get(s, 0), n - got.get(s, 0)) for s, n in enumerate(slots) if n > got.get(s, 0)]
    if not short:
        return kept
    sids, have = np.array([s for s, _, _ in short], dtype=np.int32), np.array([h for _, h, _ in short])
    ends = np.cumsum([n for _, _, n in short])
    begins = np.concatenate(([0], ends[:-1]))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(1))
            inside = np.flatnonzero(v < ends[-1])
            v = v[inside]
            at = np.searchsorted(ends, v, side="right")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(inside)), pa.array(sids[at]), pa.array(have[at] + v - begins[at])], names=["k", "sid", "rank"])

    spare = ranked(drawn.where("over").select("k", F.lit(0).alias("all")), ["all"], "k", stretch, "v").select("k", "v")
    return kept.unionByName(spare.mapInArrow(filled, "k long, sid int, rank long"))


def _placed(rows: DataFrame, n: int) -> DataFrame:
    """Each document's place on its source's shuffled line, by sums per bucket and then within a bucket.

    n: number of rows.  Rows that are equal have hashes of their own, by their
    place among each other, so no bucket holds all copies of a text.
    """
    bits = max(0, (n // BUCKET_ROWS).bit_length())
    bucket = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("h", F.xxhash64("doc_id", "body", "copy", F.lit(11))).withColumn("bucket", bucket)
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("sid", "bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    order = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "body", "copy")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).withColumn("rn", F.row_number().over(order))
    return rows.join(sums, ["sid", "bucket"]).withColumn("start", F.col("_before") + F.col("upto") - F.col("size")).select("doc_id", "key", "body", "copy", "sid", "bucket", "rn", "size", "start")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """What the mix takes of every document.

    Returns doc_id, size (words), source_size, target (words asked of its
    source), taken (words of it in the mix, repeats counted), first_slot (the
    first slot that takes some of it, or null), source, key (the id, or a hash
    of the text where that is null), body (a hash of the text) and copy (the
    row's place among those equal in key, body and source).  A source gives its
    target rounded to whole words.

    Nulls and empty texts have no words and are taken 0 words of; a null source
    is a source, the last.  Repeated rows are documents of their own and are
    spread over the line.  Empty table: no rows.  Very long texts are cut at
    block ends like any other; only their word count leaves the scan.  Only
    ``doc_id``, ``text`` and ``source`` are read, so further columns of any
    name do no harm.  The driver gets one row a source, no document.
    """
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "mix")
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64(body).alias("body"), F.coalesce("doc_id", F.xxhash64(body)).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = work.keep(rows, "sizes")
    p, n = plan(rows, weights, share, block)
    listed = spark.createDataFrame([(k, *x) for k, x in enumerate(zip(p.names, p.sizes, p.targets, p.quotas, p.blocks, strict=True))], "sid int, source string, source_size long, target double, quota long, blocks long")
    rows = rows.join(listed.select("sid", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = work.keep(_placed(copies(rows, ["sid", "key", "body"], "row"), n), "placed")
    slots = schedule(spark, p, work).join(listed.select("sid", "source_size", "quota", "blocks"), "sid")
    # A slot takes all of its block, but for the words beyond the source's quota.
    passes = F.floor(F.col("rank") / F.col("blocks"))
    number = F.col("rank") - passes * F.col("blocks")
    slots = slots.select("k", "sid", number.cast("long").alias("q"), (F.col("quota") - passes * F.col("source_size") - number * block).alias("most"))
    end = F.col("start") + F.col("size")
    parts = placed.where("size > 0").withColumn("q", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    lo, hi = F.greatest(F.col("start") - F.col("q") * block, F.lit(0)), F.least(end - F.col("q") * block, F.lit(block))
    parts = parts.select("sid", "bucket", "rn", "q", lo.alias("lo"), hi.alias("hi"))
    words = F.least("hi", "most") - F.least("lo", "most")
    taken = parts.join(slots, ["sid", "q"]).select("sid", "bucket", "rn", "k", words.alias("n")).where("n > 0")
    taken = taken.groupBy("sid", "bucket", "rn").agg(F.sum("n").alias("taken"), F.min("k").alias("first_slot"))
    out = placed.join(taken, ["sid", "bucket", "rn"], "left").join(listed, "sid")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "source", "key", "body", "copy")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each; see ``mix`` for nulls, ties, repeats, empty tables and long texts."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key", "body", "copy")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, in whole documents.

    A document is repeated by its taken words over its size, rounded, so none
    to twice; one without words (null or empty text) stays once, as it weighs
    nothing.  Rows that are equal in id, text and source are repeated as often
    as the mix takes them together, on average over the copies, each rounded
    by itself.  Rows without an id are known by their text.  Empty table: no
    rows.  All columns come back as they were, whatever their names.
    """
    copies_ = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size")).cast("int"))
    known = mix(docs, **options).groupBy("key", "body", "source")
    times = known.agg(F.round(F.avg(copies_)).cast("int").alias("times")).where("times > 0")
    body = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"), F.coalesce("doc_id", F.xxhash64(body)).alias("a"), F.xxhash64(body).alias("b"), F.col("source").alias("c"))
    out = whole.join(times, (F.col("a") == F.col("key")) & (F.col("b") == F.col("body")) & F.col("c").eqNullSafe(F.col("source")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
