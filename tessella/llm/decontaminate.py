"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document has as many words as the item it is held against (a
shorter document is one window).  Its fingerprint is the 64-bit SimHash of its
five-word shingles, each weighted by its count.  Multi-index Hamming blocks
find every item whose fingerprint lies within ``RADIUS`` bits: with eight
blocks of eight bits, two fingerprints that differ in at most 23 bits differ in
at most two bits of some block, and each block's table lists the items within
two bits of each value.  Candidates are then verified by the exact weighted
Jaccard similarity of their shingles.

A window that shares no shingle with any item has similarity 0 with all, so
only windows around a shared shingle are fingerprinted; this skips no match.

Items of at most ``ITEM_BYTES`` of text together are broadcast, and one scan of
the documents finds all.  A larger benchmark is cut into blocks of about that
size; a join on shared shingles tells which documents each block has to be held
against, and each block then meets those documents in as many tasks as they
need, so the documents are read twice however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.kernel import SHINGLE, Words, gram_of, grams, runs, words
from tessella.llm.workspace import Workspace

RADIUS = 23
BLOCKS = 8
NEAR = 2
ITEM_BYTES = 4 << 20
THRESHOLD = 0.8
DEALT_DOCS = 20_000  # documents that meet one copy of a block, about
MAP_BITS, MAP_PARTS = 27, 4096  # a bit for each shingle of a large benchmark, by its lowest bits: 16 MiB

_U = np.uint64
_BITS = np.arange(64, dtype=np.uint64)


def simhash(weights: np.ndarray, hashes: np.ndarray) -> np.uint64:
    """SimHash of weighted shingle hashes; a tied bit is 0."""
    bits = ((hashes[:, None] >> _BITS) & _U(1)).astype(np.int64) * 2 - 1
    total = (bits * weights[:, None]).sum(axis=0)
    return np.bitwise_or.reduce(np.where(total > 0, _U(1) << _BITS, _U(0)))


def window_simhashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of ``size`` shingles, each occurrence counting once."""
    bits = ((hashes[:, None] >> _BITS) & _U(1)).astype(np.int32) * 2 - 1
    sums = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    total = sums[size:] - sums[:-size]
    return np.bitwise_or.reduce(np.where(total > 0, _U(1) << _BITS, _U(0)), axis=1)


class HammingIndex:
    """Items by fingerprint, found within ``RADIUS`` bits without a miss."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        ones = np.array([bin(x).count("1") for x in range(256)])
        values = np.arange(256)
        self.tables = []
        for b in range(BLOCKS):
            block = ((prints >> _U(8 * b)) & _U(255)).astype(np.int64)
            by = [np.flatnonzero(block == v) for v in values]
            near = [np.concatenate([by[u] for u in values[ones[values ^ v] <= NEAR]]) for v in values]
            self.tables.append(near)

    def search(self, probe: np.uint64) -> np.ndarray:
        """Items within the radius of one fingerprint."""
        found = np.unique(np.concatenate([self.tables[b][(int(probe) >> (8 * b)) & 255] for b in range(BLOCKS)]))
        return found[np.bitwise_count(self.prints[found] ^ probe) <= RADIUS]


def weighted_jaccard(a: dict[int, int], b: dict[int, int]) -> float:
    both = sum(min(n, b.get(h, 0)) for h, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both)


def _counts(hashes: np.ndarray) -> dict[int, int]:
    keys, n = np.unique(hashes, return_counts=True)
    return dict(zip(keys.tolist(), n.tolist(), strict=True))


@dataclass
class _Sized:
    """Items of one number of words."""

    ids: list
    bags: list[dict[int, int]]
    index: HammingIndex


class ItemIndex:
    """A block of benchmark items, ready to be held against documents."""

    def __init__(self, items: list[tuple[int, str]]):
        column = pa.array([t or "" for _, t in items], pa.string())
        by_size: dict[int, list] = {}
        sizes_of: dict[int, set[int]] = {}
        self.grams: dict[int, np.ndarray] = {}
        for a, _, buf, offs in runs(column):
            w = words(buf, offs)
            for k in range(len(offs) - 1):
                h = w.hash[w.first[k] : w.first[k + 1]]
                if not len(h):
                    continue
                g = min(SHINGLE, len(h))
                sh = np.array([gram_of(h[i : i + g]) for i in range(len(h) - g + 1)])
                by_size.setdefault(len(h), []).append((items[a + k][0], sh))
                for x in np.unique(sh).tolist():
                    sizes_of.setdefault((g, x), set()).add(len(h))
        self.sized = {}
        for size, found in by_size.items():
            bags = [_counts(sh) for _, sh in found]
            prints = np.array([simhash(np.array(list(b.values())), np.array(list(b), dtype=np.uint64)) for b in bags], dtype=np.uint64)
            self.sized[size] = _Sized([i for i, _ in found], bags, HammingIndex(prints))
        self.sizes_of = sizes_of
        self.lookup = {}
        for g in sorted({g for g, _ in sizes_of}):
            keys = np.sort(np.array([x for k, x in sizes_of if k == g], dtype=np.uint64))
            room = np.zeros(1 << 22, dtype=bool)
            room[(keys & _U((1 << 22) - 1)).astype(np.int64)] = True
            self.lookup[g] = (keys, room)

    def matches(self, w: Words, threshold: float) -> list[tuple[int, int, int, float, int, int]]:
        """(text, item, window's first word, similarity, window's words, differing bits), the best window of each pair."""
        out = []
        for g, (keys, room) in self.lookup.items():
            h, ok = grams(w, g)
            maybe = np.flatnonzero(ok & room[(h & _U((1 << 22) - 1)).astype(np.int64)])
            at = np.searchsorted(keys, h[maybe])
            hits = maybe[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == h[maybe])]
            if not len(hits):
                continue
            owner = np.searchsorted(w.first, hits, side="right") - 1
            for text in np.unique(owner):
                lo, hi = int(w.first[text]), int(w.first[text + 1])
                mine = hits[owner == text]
                sizes = {s for p in mine for s in self.sizes_of[(g, int(h[p]))]}
                for size in sizes:
                    long = min(size, hi - lo)
                    per = long - g + 1
                    base = mine[[size in self.sizes_of[(g, int(h[p]))] for p in mine]]
                    cover = np.zeros(hi - lo - long + 2, dtype=np.int64)
                    np.add.at(cover, np.maximum(base - lo - per + 1, 0), 1)
                    np.add.at(cover, np.minimum(base - lo, hi - lo - long) + 1, -1)
                    starts = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                    out += self._verify(text, lo, starts, h, per, long, self.sized[size], threshold)
        best: dict[tuple, tuple] = {}
        for row in out:
            if row[:2] not in best or (row[3], -row[2]) > (best[row[:2]][3], -best[row[:2]][2]):
                best[row[:2]] = row
        return list(best.values())

    def _verify(self, text, lo, starts, h, per, long, sized: _Sized, threshold):
        out = []
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            if not len(part):
                continue
            span = h[lo + part[0] : lo + part[-1] + per]
            prints = window_simhashes(span, per)
            for probe in np.unique(prints):
                for item in sized.index.search(probe).tolist():
                    bag = sized.bags[item]
                    keys = np.sort(np.array(list(bag), dtype=np.uint64))
                    # At most as many shingles of a window can be shared as it has in the item at all.
                    inside = np.concatenate(([0], np.cumsum(np.isin(span, keys))))
                    least = threshold / (1 + threshold) * (per + sum(bag.values()))
                    for k in np.flatnonzero((prints == probe) & (inside[per:] - inside[:-per] >= least - 1e-9)).tolist():
                        found = weighted_jaccard(_counts(span[k : k + per]), bag)
                        if found >= threshold:
                            out.append((int(text), sized.ids[item], int(part[0] + k), found, long, int(np.bitwise_count(probe ^ sized.index.prints[item]))))
        return out


_DDL = "doc_id long, item_id long, similarity double, window_start long, window_words long, bits long"
_NAMES = [x.split()[0] for x in _DDL.split(", ")]


def _held_against(items: ItemIndex, ids: pa.Array, texts: pa.Array, threshold: float) -> Iterator[pa.RecordBatch]:
    for a, _, buf, offs in runs(texts):
        found = items.matches(words(buf, offs), threshold)
        if found:
            text, item, start, similarity, long, bits = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([a + t for t in text])), pa.array(item, pa.int64()), pa.array(similarity, pa.float64()), pa.array(start, pa.int64()), pa.array(long, pa.int64()), pa.array(bits, pa.int64())], names=_NAMES)


def _scan(index, threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _held_against(index.value, batch.column(0), batch.column(1), threshold)

    return rows


# ---------------------------------------------------------------- a benchmark of any size


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, g, shingle) of items (block, text), each once a batch; g: words of the shingle."""
    for batch in batches:
        blocks = np.asarray(batch.column(0))
        for a, b, buf, offs in runs(batch.column(1)):
            w = words(buf, offs)
            counts = np.diff(w.first)
            rows = []
            for g in range(1, SHINGLE + 1):
                h, ok = grams(w, g)
                at = np.flatnonzero(ok)
                owner = np.searchsorted(w.first, at, side="right") - 1
                mine = (counts[owner] == g) | ((g == SHINGLE) & (counts[owner] > g))
                rows.append(np.column_stack((blocks[a:b][owner[mine]], np.full(mine.sum(), g), h[at[mine]].view(np.int64))))
            once = np.unique(np.concatenate(rows), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1].astype(np.int32)), pa.array(once[:, 2])], names=["block", "g", "shingle"])


def _map_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, place) sorted by part -> the bits of each part."""
    size = (1 << MAP_BITS) // MAP_PARTS
    at, bits = None, None

    def emit():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])

    for batch in batches:
        part, place = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for p in np.unique(part):
            if p != at:
                if bits is not None:
                    yield emit()
                at, bits = int(p), np.zeros(size, dtype=bool)
            bits[place[part == p]] = True
    if bits is not None:
        yield emit()


def _maybe_shared(shared_map):
    """Rows (id, body, text) -> (id, body, g, shingle) of shingles that an item may have, each once a text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << MAP_BITS) // MAP_PARTS
        known = np.zeros((MAP_PARTS, size // 8), dtype=np.uint8)
        for part, bits in shared_map.value.items():
            known[part] = np.frombuffer(bits, dtype=np.uint8)
        known = known.ravel()
        for batch in batches:
            for a, _, buf, offs in runs(batch.column(2)):
                w = words(buf, offs)
                for g in range(1, SHINGLE + 1):
                    h, ok = grams(w, g)
                    low = (h & _U((1 << MAP_BITS) - 1)).astype(np.int64)
                    at = np.flatnonzero(ok & ((known[low >> 3] >> (7 - (low & 7))) & 1).astype(bool))
                    if not len(at):
                        continue
                    owner = np.searchsorted(w.first, at, side="right") - 1
                    once = np.unique(np.column_stack((owner, h[at].view(np.int64))), axis=0)
                    rows_ = pa.array(a + once[:, 0])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows_), batch.column(1).take(rows_), pa.array(np.full(len(once), g, dtype=np.int32)), pa.array(once[:, 1])], names=["id", "body", "g", "shingle"])

    return rows


def _meet(threshold: float):
    """Rows (block, salt, item_id, doc_id, text) sorted by (block, salt), a block's items first -> matches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, items, index = None, [], None
        for batch in batches:
            block, salt, is_doc = (np.asarray(batch.column(i)) for i in (0, 1, 2))
            change = np.flatnonzero((block[1:] != block[:-1]) | (salt[1:] != salt[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(block)], strict=True):
                part = batch.slice(lo, hi - lo)
                if (block[lo], salt[lo]) != at:
                    at, items, index = (block[lo], salt[lo]), [], None
                if not is_doc[lo]:
                    items += zip(part.column(3).to_pylist(), part.column(5).to_pylist(), strict=True)
                    continue
                index = index or ItemIndex(items)
                yield from _held_against(index, part.column(4), part.column(5), threshold)

    return rows


def _key() -> list[Column]:
    body = F.xxhash64(F.coalesce("text", F.lit("")))
    return [F.coalesce("doc_id", body).alias("id"), body.alias("body")]


def _dealt(docs: DataFrame, items: DataFrame, size: int, threshold: float) -> DataFrame:
    """Matches for items of more than ITEM_BYTES together."""
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "leaks")
    blocks = -(-size // ITEM_BYTES)
    items = work.keep(items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"), "item_id", "text"), "items")
    shingles = work.keep(items.select("block", "text").mapInArrow(_item_shingles, "block long, g int, shingle long").distinct(), "shingles")
    place = F.col("shingle").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    width = (1 << MAP_BITS) // MAP_PARTS
    places = shingles.select((place / width).cast("int").alias("part"), F.pmod(place, F.lit(width)).cast("int").alias("place")).distinct()
    parts = places.repartition("part").sortWithinPartitions("part").mapInArrow(_map_parts, "part int, bits binary")
    shared = spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in parts.collect()})  # at most 2^MAP_BITS bits
    keyed = docs.select(*_key(), "text", "doc_id")
    asked = keyed.select("id", "body", "text").mapInArrow(_maybe_shared(shared), "id long, body long, g int, shingle long")
    pairs = work.keep(asked.join(shingles, ["g", "shingle"]).select("id", "body", "block").distinct(), "pairs")
    salts = pairs.groupBy("block").agg(F.ceil(F.count("*") / F.lit(DEALT_DOCS)).cast("long").alias("salts"))
    salts = work.keep(salts, "salts")
    none = F.lit(None).cast("long")
    of_items = items.join(salts, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("is_doc"), "item_id", none.alias("doc_id"), "text")
    of_docs = keyed.join(pairs.join(salts, "block"), ["id", "body"]).select("block", F.pmod("body", "salts").alias("salt"), F.lit(True).alias("is_doc"), none.alias("item_id"), "doc_id", "text")
    met = of_items.unionByName(of_docs).repartition("block", "salt").sortWithinPartitions("block", "salt", "is_doc")
    return met.mapInArrow(_meet(threshold), _DDL)


# ---------------------------------------------------------------- the operator


def _bytes(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _shared_index(items: DataFrame):
    """The items of a small benchmark, broadcast."""
    return items.sparkSession.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in items.collect()]))


def contaminated(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and a benchmark item found in it, with the best window.

    Only ``doc_id, text`` of docs and ``item_id, text`` of items are read, so
    further columns of any name do no harm.  Null, empty and word-free texts
    match nothing.  Items of fewer than five words are compared by the one run
    of all their words.  Repeated rows each give a row of their own; of equal
    windows (ties) the first counts.  An empty table on either side: no rows.
    Very long texts are read whole; memory follows the longest one.  A row
    without an id gives rows without one.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    size = _bytes(items)
    if size > ITEM_BYTES:
        return _dealt(docs, items, size, threshold)
    return docs.mapInArrow(_scan(_shared_index(items), threshold), _DDL)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each leaked item of each document; see ``contaminated`` for nulls, ties, repeats, empty tables and long texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _keep(index, threshold: float, at: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ItemIndex = index.value
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for a, _, buf, offs in runs(batch.column(at)):
                clean[[a + m[0] for m in items.matches(words(buf, offs), threshold)]] = False
            yield batch.filter(pa.array(clean))

    return rows


def clean_documents(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns as they were.

    Nulls, ties, repeats, empty tables and long texts as in ``contaminated``.
    A row is judged by its text: of rows that share an id but differ in text
    only those go that hold an item, whatever the size of the benchmark.
    """
    items = items.select("item_id", "text")
    size = _bytes(items)
    if size <= ITEM_BYTES:
        return docs.mapInArrow(_keep(_shared_index(items), threshold, docs.columns.index("text")), docs.schema)
    row_key = F.xxhash64(*_key()).alias("id")  # of id and text, so that equal texts are spread by their ids
    known = docs.select(row_key.alias("doc_id"), "text")
    gone = _dealt(known, items, size, threshold).select("doc_id").distinct()
    whole = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"), row_key)
    return whole.join(gone, F.col("id") == F.col("doc_id"), "left_anti").select("row.*")
