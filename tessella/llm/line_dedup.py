"""Line dedup that can be taken back.

The state is three tables: ``references`` (a row for each key and document),
``refcounts`` (exact counts and the largest document of each key) and
``filters`` (a cuckoo filter per shard, of the keys that ``min_docs`` or more
documents hold).  Inserting or deleting documents writes only what changes: new
references or the ids that went, fresh counts of the keys they hold, and the
filters of the shards in which a key crossed the limit; a Bloom filter could
not forget.  The newest version of a count or filter is the one that counts,
and every COMPACT versions the tables are written anew.

A scan of references first asks the filters, which removes nearly all keys that
repeat too little, and then the exact counts, so a false positive costs time
only.  Filters go to the tasks by broadcast while all of them together are no
larger than ``FILTER_BYTES``; beyond that references are dealt by shard and meet
their shard's filter there.  The few keys with very many references skip the
filters, which they would pass, and meet their counts by broadcast, so that no
task gets all references of one line.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.kernel import mix, runs, string_buffers
from tessella.llm.workspace import Workspace

LEAST_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 1 << 17  # keys of a filter, about; the number of shards follows the keys
FILTER_BYTES = 32 << 20
HEAVY = 100_000  # references above which a key may skip the filters
HEAVY_KEYS = 8192  # at most so many keys do
DEALT_ROWS = 1 << 22  # references that meet one copy of a filter, about
COMPACT = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


# ---------------------------------------------------------------- cuckoo filter


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; ``add`` and ``remove`` 64-bit keys, ``contains`` many at once."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = table if table is not None else np.zeros((buckets, self.SLOTS), dtype=np.uint16)

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        buckets = 4
        while buckets * cls.SLOTS * 0.84 < n:
            buckets *= 2
        return cls(buckets)

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        made = cls.for_keys(len(keys))
        while not made.add_many(keys):
            made = cls(made.buckets * 2)
        return made

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, dtype=np.uint16).reshape(-1, cls.SLOTS).copy()
        return cls(len(table), table)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.int64).view(np.uint64))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        one = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, one, one ^ self._step(prints)

    def _step(self, prints: np.ndarray) -> np.ndarray:
        return (mix(prints.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(keys)
        return (self.table[one] == prints[:, None]).any(axis=1) | (self.table[two] == prints[:, None]).any(axis=1)

    def add(self, key: int) -> bool:
        """False if there is no room; the filter is then as good as before but for the key last moved."""
        prints, one, two = self._places(np.array([key]))
        mark, at = prints[0], int(one[0])
        for place in (at, int(two[0])):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return True
        draw = random.Random(key)
        for _ in range(self.KICKS):
            slot = draw.randrange(self.SLOTS)
            mark, self.table[at, slot] = self.table[at, slot], mark
            at ^= int(self._step(np.array([mark]))[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def add_many(self, keys: np.ndarray) -> bool:
        """Adds all keys at once where there is room, and by moving others where there is not; False if that fails."""
        prints, *places = self._places(np.asarray(keys, dtype=np.int64))
        todo = np.arange(len(prints))
        for place in places:
            todo = todo[np.argsort(place[todo], kind="stable")]
            at = place[todo]
            head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else at
            rank = np.arange(len(at)) - np.repeat(head, np.diff(np.concatenate((head, [len(at)]))))
            free = self.table[at] == 0
            fits = rank < free.sum(axis=1)
            slot = (np.cumsum(free[fits], axis=1) > rank[fits][:, None]).argmax(axis=1)
            self.table[at[fits], slot] = prints[todo[fits]]
            todo = todo[~fits]
        return all(self.add(int(keys[k])) for k in todo)

    def remove(self, key: int) -> bool:
        """Forget one insertion of a key that is in."""
        prints, one, two = self._places(np.array([key]))
        for place in (int(one[0]), int(two[0])):
            held = np.flatnonzero(self.table[place] == prints[0])
            if len(held):
                self.table[place, held[0]] = 0
                return True
        return False


# ---------------------------------------------------------------- keys of lines


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line of a run, and each text's first line; an empty text has one empty line."""
    cut = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate((offsets[:-1], cut + 1)), kind="stable")
    end = np.sort(np.concatenate((offsets[1:], cut)), kind="stable")
    # A line that ends with its text's last byte starts before the next text does.
    first = np.searchsorted(cut, offsets) + np.arange(len(offsets))
    return start, end, first


def line_keys(buf: np.ndarray, offsets: np.ndarray, least: int = LEAST_CHARS):
    """(line number in the run, key) of lines with a key of ``least`` code points or more, with the spans."""
    start, end, first = line_spans(buf, offsets)
    solid = np.flatnonzero(~_SPACE[buf])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    full = np.flatnonzero(b > a)
    lo, hi = solid[a[full]], solid[b[full] - 1] + 1
    chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    long = chars[hi] - chars[lo] >= least
    lines, lo, hi = full[long], lo[long], hi[long]
    low = _LOWER[buf].tobytes()
    keys = [hashlib.blake2b(low[s:e], digest_size=16).digest() for s, e in zip(lo.tolist(), hi.tolist(), strict=True)]
    return start, end, first, lines, np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)


_REFERENCE_DDL = "k1 long, k2 long, doc_id long, body long"
_REFERENCE = ("k1", "k2", "doc_id", "body")


def _references(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column(0), batch.column(2)
            for a, _, buf, offs in runs(batch.column(1)):
                _, _, first, lines, keys = line_keys(buf, offs, least)
                if not len(keys):
                    continue
                text = np.searchsorted(first, lines, side="right") - 1
                once = np.unique(np.column_stack((text, keys)), axis=0)
                at = pa.array(a + once[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array(once[:, 1]), pa.array(once[:, 2]), ids.take(at), bodies.take(at)], names=list(_REFERENCE))

    return rows


def _body(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def references(docs: DataFrame, text: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """(k1, k2, doc_id, body): each key of each row of docs once; body: a hash of the text."""
    return docs.select("doc_id", F.col(text), _body(text)).mapInArrow(_references(least), _REFERENCE_DDL)


# ---------------------------------------------------------------- the index


def _filter_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard -> a filter for each shard."""
    held: dict[int, list] = {}

    def emit(shard):
        data = CuckooFilter.build(np.concatenate(held.pop(shard))).to_bytes()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([data], pa.binary())], names=["shard", "filter"])

    for batch in batches:
        shards, keys = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for shard in np.unique(shards):
            for old in [s for s in held if s != shard]:
                yield emit(old)
            held.setdefault(int(shard), []).append(keys[shards == shard])
    for shard in list(held):
        yield emit(shard)


def _edit_filter(key, pdf):
    """Insert into and delete from one shard's filter what has crossed the limit."""
    import pandas as pd

    old = pdf["filter"].dropna()
    rows = pdf[pdf["filter"].isna()]
    made = CuckooFilter.from_bytes(old.iloc[0]) if len(old) else CuckooFilter.for_keys(len(rows))
    full = not made.add_many(rows.loc[rows["up"] == 1, "k1"].to_numpy(dtype=np.int64))
    for k in rows.loc[rows["up"] == -1, "k1"]:
        made.remove(int(k))
    return pd.DataFrame([(key[0], made.to_bytes(), full)], columns=["shard", "filter", "full"])


def _ask_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, salt), the filter first -> the references that it lets through."""
    at, known = None, None
    for batch in batches:
        shard, salt = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
            part = batch.slice(lo, hi - lo)
            if (shard[lo], salt[lo]) != at:
                at, known = (shard[lo], salt[lo]), None
                if part.column(2)[0].is_valid:
                    known, part = CuckooFilter.from_bytes(part.column(2)[0].as_py()), part.slice(1)
            if known is not None and part.num_rows:
                yield part.filter(pa.array(known.contains(np.asarray(part.column(3))))).select(list(_REFERENCE))


class LineIndex:
    """Exact reference counts of line keys, with a cuckoo filter per shard before them."""

    def __init__(self, spark: SparkSession, *, min_docs: int = MIN_DOCS, least: int = LEAST_CHARS, shard_keys: int = SHARD_KEYS):
        self.spark, self.min_docs, self.least, self.shard_keys = spark, min_docs, least, shard_keys
        self.work = Workspace(spark, "lines")
        self.version, self.shards = 0, 1
        self._held: list[tuple[int, DataFrame]] = []  # references, by the version that inserted them
        self._gone: list[tuple[int, DataFrame]] = []  # doc_id, or without one _text, by the version that deleted them
        self._counted: list[tuple[int, DataFrame]] = []
        self._filtered: list[tuple[int, DataFrame]] = []

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.work.keep(df, f"{name}-{self.version}")

    @staticmethod
    def _versions(parts: list[tuple[int, DataFrame]]) -> DataFrame:
        out = None
        for version, part in parts:
            part = part.withColumn("_v", F.lit(version))
            out = part if out is None else out.unionByName(part)
        return out

    @property
    def references(self) -> DataFrame:
        held = self._versions(self._held)
        if self._gone:
            gone = self._versions(self._gone).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of"), F.col("_v").alias("_when"))
            held = held.withColumn("_text", self._text_of()).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_of")) & (F.col("_v") < F.col("_when")), "left_anti")
        return held.select(*_REFERENCE)

    @staticmethod
    def _text_of() -> Column:
        """What tells rows without an id apart."""
        return F.when(F.col("doc_id").isNull(), F.col("body"))

    def _newest(self, parts: list[tuple[int, DataFrame]], key: list[str]) -> DataFrame:
        if len(parts) == 1:
            return parts[0][1]
        rest = [c for c in parts[0][1].columns if c not in key]
        return self._versions(parts).groupBy(*key).agg(F.max_by(F.struct(*rest), "_v").alias("_r")).select(*key, "_r.*")

    @property
    def refcounts(self) -> DataFrame:
        return self._newest(self._counted, ["k1", "k2"]).where("refs > 0")

    @property
    def filters(self) -> DataFrame:
        return self._newest(self._filtered, ["shard"])

    @staticmethod
    def _count(rows: DataFrame) -> DataFrame:
        """Documents of each key: different ids, and of rows without one different texts."""
        each = rows.groupBy("k1", "k2", "doc_id", LineIndex._text_of().alias("_text")).agg(F.lit(1).alias("_one"))
        return each.groupBy("k1", "k2").agg(F.count("*").alias("refs"), F.max("doc_id").alias("last"))

    def _shard(self) -> Column:
        return F.pmod("k1", F.lit(self.shards))

    def _build_filters(self) -> None:
        many = self.refcounts.where(F.col("refs") >= self.min_docs)
        self.shards = max(1, -(-many.count() // self.shard_keys))
        rows = many.select(self._shard().alias("shard"), "k1").repartition("shard").sortWithinPartitions("shard")
        self._filtered = [(self.version, self._keep(rows.mapInArrow(_filter_of, "shard long, filter binary"), "filters"))]

    def insert(self, docs: DataFrame, text: str = "text") -> None:
        """Add documents; what is written follows what is added.

        A reference that is held already is not counted again, so documents may
        be inserted more than once and a job that failed be run again.
        """
        self.version += 1
        new = references(docs, text, self.least)
        first = not self._held
        if not first:
            new = self._keep(new.withColumn("_text", self._text_of()), "read")
            old = self.references.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("doc_id").alias("_id"), F.col("body").alias("_body"), self._text_of().alias("_of"))
            key = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("_id"))
            counted = new.join(old, key & F.col("_text").eqNullSafe(F.col("_of")), "left_anti").select(*_REFERENCE)
            new = new.join(old, key & F.col("body").eqNullSafe(F.col("_body")), "left_anti").select(*_REFERENCE)
        new = self._keep(new, "inserted")
        own = self._count(new if first else counted)
        self._held.append((self.version, new))
        if first:
            self._counted = [(self.version, self._keep(own, "counted"))]
            self._build_filters()
            return
        before = self.refcounts.select("k1", "k2", F.col("refs").alias("was"), F.col("last").alias("_last"))
        fresh = own.join(before, ["k1", "k2"], "left").select("k1", "k2", (F.col("refs") + F.coalesce("was", F.lit(0))).alias("refs"), F.greatest("last", "_last").alias("last"), F.coalesce("was", F.lit(0)).alias("was"))
        self._changed(self._keep(fresh, "fresh"))

    def delete(self, ids: DataFrame, text: str | None = None) -> None:
        """Take documents out again: ids has their doc_id; those not in are passed over.

        With ``text``, rows without an id are taken out by that column's text;
        without it they stay.
        """
        self.version += 1
        known = ids.select("doc_id", (_body(text) if text else F.lit(None).cast("long")).alias("body"))
        known = known.where("doc_id IS NOT NULL OR body IS NOT NULL").select("doc_id", self._text_of().alias("_text"))
        ids = self._keep(known.distinct(), "ids")
        out = ids.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of"))
        held = self.references.withColumn("_text", self._text_of())
        gone = self._keep(self._count(held.join(out, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_of")), "left_semi")), "gone")
        self._gone.append((self.version, ids))
        less = gone.select("k1", "k2", F.col("refs").alias("less"), F.col("last").alias("_last"))
        touched = self.refcounts.join(less, ["k1", "k2"])
        # Only where the largest document went, another one has to be looked for.
        lost = touched.where("last = _last").select("k1", "k2")
        found = self.references.join(lost, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.max("doc_id").alias("_next"))
        last = F.when(F.col("last") == F.col("_last"), F.col("_next")).otherwise(F.col("last"))
        fresh = touched.join(found, ["k1", "k2"], "left").select("k1", "k2", (F.col("refs") - F.col("less")).alias("refs"), last.alias("last"), F.col("refs").alias("was"))
        self._changed(self._keep(fresh, "fresh"))

    def _changed(self, fresh: DataFrame) -> None:
        """Counts of the keys in fresh are new: a version of them, and of the filters of keys that crossed the limit."""
        now, was = F.col("refs") >= self.min_docs, F.col("was") >= self.min_docs
        crossed = fresh.where(now != was).select(self._shard().alias("shard"), "k1", F.when(now, 1).otherwise(-1).alias("up"))
        old = self.filters.join(crossed.select("shard").distinct(), "shard", "left_semi")
        edits = crossed.select("shard", "k1", "up", F.lit(None).cast("binary").alias("filter")).unionByName(old.select("shard", F.lit(None).cast("long").alias("k1"), F.lit(None).cast("int").alias("up"), "filter"))
        made = self._keep(edits.groupBy("shard").applyInPandas(_edit_filter, "shard long, filter binary, full boolean"), "edited")
        self._counted.append((self.version, fresh.drop("was")))
        if made.where("full").isEmpty():
            self._filtered.append((self.version, made.drop("full")))
        else:
            self._build_filters()
        if len(self._counted) > COMPACT:
            self._held, self._gone = [(self.version, self._keep(self.references, "held"))], []
            self._counted = [(self.version, self._keep(self.refcounts, "counted"))]
            self._build_filters()

    def _pruned(self, rows: DataFrame, total: int) -> DataFrame:
        """References that the filters let through; total: how many there are."""
        if (self.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) <= FILTER_BYTES:
            shards = self.shards
            known = self.spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in self.filters.collect()})

            def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                filters = {s: CuckooFilter.from_bytes(b) for s, b in known.value.items()}
                for batch in batches:
                    keys = np.asarray(batch.column(0))
                    shard = keys % shards
                    out = np.zeros(len(keys), dtype=bool)
                    for s in np.unique(shard):
                        if int(s) in filters:
                            mine = np.flatnonzero(shard == s)
                            out[mine] = filters[int(s)].contains(keys[mine])
                    yield batch.filter(pa.array(out))

            return rows.select(*_REFERENCE).mapInArrow(ask, _REFERENCE_DDL)
        salts = max(1, -(-total // (self.shards * DEALT_ROWS)))
        asked = rows.select(self._shard().alias("shard"), F.pmod("k2", F.lit(salts)).alias("salt"), F.lit(None).cast("binary").alias("filter"), *_REFERENCE)
        known = self.filters.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "filter", *[F.lit(None).cast("long").alias(c) for c in _REFERENCE])
        dealt = asked.unionByName(known).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
        return dealt.mapInArrow(_ask_dealt, _REFERENCE_DDL)

    def dropped(self) -> DataFrame:
        """(doc_id, body, keys): the keys that lose their lines in a document."""
        many = self.refcounts.where((F.col("refs") >= self.min_docs) & F.col("last").isNotNull()).select("k1", "k2", "last", "refs")
        total = self.references.count()
        heavy = F.col("refs") > max(HEAVY, total // HEAVY_KEYS)
        known = F.broadcast(many.where(heavy).drop("refs"))  # at most HEAVY_KEYS rows, as they share all references
        hits = self.references.join(known, ["k1", "k2"])
        rest = self._pruned(self.references.join(known, ["k1", "k2"], "left_anti"), total)
        hits = hits.select(*_REFERENCE, "last").unionByName(rest.join(many.where(~heavy).drop("refs"), ["k1", "k2"]))
        hits = hits.where(~F.col("doc_id").eqNullSafe(F.col("last")))
        return hits.groupBy("doc_id", "body").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))  # no more than the text has lines


def _render(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column(2)
            marks, places = string_buffers(drops)
            for a, b, buf, offs in runs(batch.column(1)):
                start, end, first, lines, keys = line_keys(buf, offs, least)
                gone = np.zeros(len(start), dtype=bool)
                at = np.searchsorted(lines, first)
                for i in range(b - a):
                    lo, hi = places[a + i], places[a + i + 1]
                    if lo == hi or at[i] == at[i + 1]:
                        continue
                    own = {marks[k : k + 16].tobytes() for k in range(lo, hi, 16)}
                    mine = slice(at[i], at[i + 1])
                    gone[lines[mine]] = [k.tobytes() in own for k in keys[mine]]
                data = buf.tobytes()
                kept, dropped = [], []
                for i in range(b - a):
                    flags = gone[first[i] : first[i + 1]]
                    dropped.append(int(flags.sum()))
                    if dropped[-1]:
                        stay = np.flatnonzero(~flags) + first[i]
                        kept.append(b"\n".join(data[start[k] : end[k]] for k in stay))
                    else:
                        kept.append(data[offs[i] : offs[i + 1]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(dropped, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return rows


def _pack(column: str):
    """Keys as the bytes the scan compares: two little-endian longs each."""
    swap = lambda x: F.array_join(F.transform(F.sequence(F.lit(15), F.lit(1), F.lit(-2)), lambda i: F.substring(F.lpad(F.hex(x), 16, "0"), i, F.lit(2))), "")
    return F.unhex(F.array_join(F.transform(column, lambda k: F.concat(swap(k["k1"]), swap(k["k2"]))), ""))


def drop_repeated_lines(docs: DataFrame, *, text: str = "text", min_docs: int = MIN_DOCS, least: int = LEAST_CHARS, index: LineIndex | None = None) -> DataFrame:
    """Texts without the lines that many documents hold, which stay only in the largest doc_id.

    Returns doc_id, n_lines, n_dropped and kept, a row for each row.  Null
    counts as the empty text, which has one empty line.  A document that loses
    all its lines is left empty.  Rows that share an id are one document when
    documents are counted, and all of them keep the line if the id is the
    largest.  Rows without an id are documents by their text; they keep a line
    only if no row with an id holds it.  Repeated rows are treated alike.
    Empty table: no rows.  Very long texts are split whole; memory follows the
    longest text.  Only ``doc_id`` and the text are read, so further columns of
    any name do no harm.  ``index``: one that has these documents (and others,
    perhaps) already.
    """
    if index is None:
        index = LineIndex(docs.sparkSession, min_docs=min_docs, least=least)
        index.insert(docs, text)
    drops = index.work.keep(index.dropped().select(F.col("doc_id").alias("_d"), F.col("body").alias("_b"), _pack("keys").alias("keys")), f"dropped-{index.version}")
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), _body(text).alias("body"))
    out = rows.join(drops, (F.col("body") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").select("doc_id", "text", "keys")
    return out.mapInArrow(_render(index.least), "doc_id long, n_lines long, n_dropped long, kept string")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents; see ``drop_repeated_lines`` for nulls, ties, repeats, empty tables and long texts."""
    out = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP1_SQL = f"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, md5(coalesce(text, '')) AS body, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, body, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
keyed AS (SELECT r, doc_id, body, pos, line, {_KEY} AS key FROM lines),
many AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN body END) >= 3),
marked AS (SELECT k.*, m.last IS NOT NULL AND k.doc_id IS DISTINCT FROM m.last AS gone FROM keyed k LEFT JOIN many m ON k.key = m.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""
