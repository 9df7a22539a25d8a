"""Sharding over fixed virtual slots.

Every record hashes into one of ``SLOTS`` virtual slots by its id, for good.
Bytes are added up per slot, and a slot map gives each slot to a shard, the
heaviest slot first to the lightest shard.  Rebalancing edits the map: it moves
as few slots as bring the shards back together, and each edit is a new version
beside the old ones.  Records never move between slots.

The hash takes the record's id and, of rows that are equal in id and text, the
place among them, so a row repeated a million times does not fill one slot.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.ranks import copies
from tessella.llm.workspace import Workspace

SLOTS = 8192
SHARDS = 40
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """A version of the slot-to-shard map; of a size that SLOTS bounds."""

    shards: int
    owner: tuple[int, ...]
    version: int = 1
    moved: tuple[int, ...] = field(default=(), compare=False)

    @classmethod
    def fit(cls, weights: list[int], shards: int) -> SlotMap:
        """Heaviest slot first, each to the lightest shard; of equal ones to the smaller number."""
        owner = [0] * len(weights)
        heap = [(0, s) for s in range(shards)]
        for slot in sorted(range(len(weights)), key=lambda k: (-weights[k], k)):
            load, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (load + weights[slot], shard))
        return cls(shards, tuple(owner))

    def loads(self, weights: list[int]) -> list[int]:
        total = [0] * self.shards
        for slot, shard in enumerate(self.owner):
            total[shard] += weights[slot]
        return total

    def rebalance(self, weights: list[int], shards: int | None = None, slack: float = 0.01) -> SlotMap:
        """The next version: slots leave shards that are gone or above the mean by ``slack``, and only those."""
        shards = shards or self.shards
        owner = list(self.owner)
        mean = sum(weights) / shards
        load, of = [0] * shards, [[] for _ in range(shards)]
        homeless = []
        for slot, shard in enumerate(owner):
            if shard < shards:
                load[shard] += weights[slot]
                of[shard].append(slot)
            else:
                homeless.append(slot)
        for shard in range(shards):
            own = sorted(of[shard], key=lambda k: (weights[k], k))
            while own and load[shard] > mean * (1 + slack):
                fit = [k for k in own if load[shard] - weights[k] >= mean * (1 - slack)]
                if not fit:
                    break
                slot = fit[-1]
                own.remove(slot)
                load[shard] -= weights[slot]
                homeless.append(slot)
        heap = [(x, s) for s, x in enumerate(load)]
        heapq.heapify(heap)
        for slot in sorted(homeless, key=lambda k: (-weights[k], k)):
            x, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (x + weights[slot], shard))
        moved = tuple(k for k, (a, b) in enumerate(zip(self.owner, owner, strict=True)) if a != b)
        return SlotMap(shards, tuple(owner), self.version + 1, moved)

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map's table."""
        rows = [(self.version, self.shards, slot, shard) for slot, shard in enumerate(self.owner)]
        spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int").coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the newest by default."""
        table = spark.read.parquet(path)
        version = version or table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == version).select("shards", "virtual_slot", "shard").collect()
        return cls(rows[0][0], tuple(s for _, _, s in sorted(rows, key=lambda r: r[1])), version)


def stored(spark: SparkSession, path: str) -> SlotMap | None:
    """The newest version at a path, if there is one."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return SlotMap.load(spark, path) if target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target) else None


def records(docs: DataFrame, work: Workspace, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy (place among rows of equal id and text) and virtual slot of each row, as a table."""
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.coalesce("doc_id", F.xxhash64(body)).alias("key"), F.xxhash64(body).alias("body"))
    rows = work.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    rows = copies(rows, ["key", "body"], "row")
    slot = F.pmod(F.xxhash64("key", "copy"), F.lit(slots)).cast("int")
    return work.keep(rows.select("doc_id", "size", "text_crc32", "body", "copy", slot.alias("virtual_slot")), "records")


def slot_weights(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; the driver gets at most ``slots`` rows."""
    size, count = [0] * slots, [0] * slots
    for slot, b, n in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect():
        size[slot], count[slot] = b, n
    return size, count


def place(rows: DataFrame, fitted: SlotMap, counts: list[int]) -> DataFrame:
    """Shard and place of each of ``records`` by a version of the map; counts: rows of each virtual slot."""
    base, filled = [], [0] * fitted.shards
    for slot, owner in enumerate(fitted.owner):
        base.append((slot, owner, filled[owner]))
        filled[owner] += counts[slot]
    table = rows.sparkSession.createDataFrame(base, "virtual_slot int, shard int, base long")
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "body", "copy")) - 1
    out = rows.withColumn("place", within).join(F.broadcast(table), "virtual_slot")  # the map has one row a slot
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(fitted.version).alias("map_version"))


def shard(docs: DataFrame, *, shards: int = SHARDS, slots: int = SLOTS, store: str | None = None, use: int | None = None) -> DataFrame:
    """Every row of docs with its shard and its place there.

    Returns doc_id, size (UTF-8 bytes and 16 more), text_crc32, law (``bytes``:
    shards are of nearly equal size), shard, slot (the row's place in its
    shard, without gaps from 0, by virtual slot and then doc_id), grown_shard
    (null: this law has none), virtual_slot and map_version.

    ``store``: a path that keeps the slot map, by default one in the run's
    workspace.  Where it has no version yet, one is fitted and saved; else the
    newest is rebalanced to ``shards`` and saved as the next version, and only
    the slots it moves change shards.  ``use``: place rows by this stored
    version as it is, without a new one.  Shards always come from the version
    read back from the store.

    Nulls and empty texts: no bytes.  A row without an id is placed by its
    text.  Ties and repeated rows: rows equal in id and text are told apart by
    their place among each other and spread over slots.  Empty table: no rows,
    and a map of empty slots.  Very long texts: a text is weighed whole and
    never leaves the scan.  Only ``doc_id`` and ``text`` are read, so further
    columns of any name do no harm.
    """
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "shard")
    rows = records(docs.select("doc_id", "text"), work, slots)
    weights, counts = slot_weights(rows, slots)
    path = store or f"{work.path}/map"
    if use is None:
        known = stored(spark, path)
        made = known.rebalance(weights, shards) if known else SlotMap.fit(weights, shards)
        made.save(spark, path)
        use = made.version
    return place(rows, SlotMap.load(spark, path, use), counts)


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by a stored slot map; see ``shard`` for nulls, ties, repeats, empty tables and long texts.

    This law scatters groups of equal texts, as a row's id places it.
    """
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
