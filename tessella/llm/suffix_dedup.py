"""Suffix-array dedup: remove every byte covered by a repeated long string.

Method: two-stage suffix sorting.  Of the suffixes that matter, only those
smaller than their successor are sorted directly; all others are induced by
scanning the first-byte buckets in order.  Adjacent common prefixes then tell
which strings of ``SPAN`` bytes occur more than once.

How the sort is spread over a cluster: every ``SPAN``-byte string is owned by
one *anchor*, the leftmost smallest hash among its ``GRAM``-byte substrings.
Equal strings have equal anchors at equal places, so strings can be compared
within the group of their anchor alone.  Strings owned by one occurrence of an
anchor start at adjacent bytes and travel as one *segment*.  An anchor that
occurs once is unique; the segments of all others go to the sort, each distinct
one once with its count.  A group of more than ``HOT`` distinct segments is
first split by ``SLICES`` ranges of string offsets and the content common to
such a range, and equal contents are merged with their counts before they
shuffle, so a passage that a third of all texts hold leaves a few short rows.
A group that still holds more than ``GROUP_BYTES`` is split once more, by
single strings, and equal strings are merged likewise, so no task sorts more
than that at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.kernel import list_array, mix, prefix_hash, runs, span_hash, string_buffers, _Powers
from tessella.llm.workspace import Workspace

SPAN = 200
GRAM = 64
HOT = 4096
SLICE = 17
BATCH = 1 << 20  # bytes that are sorted together, about
GROUP_BYTES = 2 << 20
ROWS = 8192  # suffixes whose bytes are gathered together

_U = np.uint64
_LOW = _U((1 << 24) - 1)
_SPREAD = _U(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- anchors


def _windows_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    step, low = 1, values
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = width - step
    return np.minimum(low[: len(low) - rest], low[rest:])


def anchors(buf: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """Segments of a run of texts: (anchor hash, segment hash, text, first string, strings, anchor's place in the first string)."""
    empty = np.zeros(0, dtype=np.int64)
    n = len(buf)
    if n < span:
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty
    sums = prefix_hash(buf)
    _, down = _Powers.upto(n + 1)
    grams = sums[gram:] - sums[:-gram]
    grams *= down[: len(grams)]
    width = span - gram + 1
    owner = np.empty(n - span + 1, dtype=np.int64)
    piece = 1 << 23  # the place within a piece fits the low 24 bits
    for at in range(0, len(owner), piece):
        part = grams[at : min(at + piece + width - 1, len(grams))] * _SPREAD
        part &= ~_LOW
        part |= np.arange(len(part), dtype=np.uint64)
        low = _windows_minimum(part, width)[:piece]
        owner[at : at + len(low)] = (low & _LOW).astype(np.int64) + at
    inside = np.ones(len(owner), dtype=bool)
    for cut in offsets[1:-1]:
        inside[max(0, cut - span + 1) : cut] = False
    string = np.flatnonzero(inside)
    if not len(string):
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty
    owner = owner[string]
    head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    tail = np.concatenate((head[1:], [len(string)])) - 1
    first, last, place = string[head], string[tail], owner[head]
    left = place - first
    key = mix(grams[place])
    content = span_hash(sums, first, last + span) ^ mix(left.astype(np.uint64) + _U(1))
    text = np.searchsorted(offsets, first, side="right") - 1
    return key, content, text, first - offsets[text], last - first + 1, left


_ANCHOR_DDL = "id long, body long, anchor long, seg long, lo int, n int, left int"


def _anchor_rows(span: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = (np.asarray(batch.column(i)) for i in (0, 1))
            for a, _, buf, offs in runs(batch.column(2)):
                key, content, text, lo, n, left = anchors(buf, offs, span, gram)
                if len(key):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a + text]), pa.array(bodies[a + text]), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(left.astype(np.int32))],
                        names=["id", "body", "anchor", "seg", "lo", "n", "left"],
                    )

    return rows


# ---------------------------------------------------------------- two-stage sort


def two_stage_order(text: np.ndarray, limit: np.ndarray, group: np.ndarray, need: np.ndarray, depth: int) -> np.ndarray:
    """Order of the needed suffixes, by group and then by their first ``depth`` bytes.

    text: all segments end to end.  limit: for each byte the end of its
    segment.  group: for each byte the group of its segment.  need: whether the
    suffix from a byte is asked for; a needed suffix has at least ``depth``
    bytes.  Returns the starts of the needed suffixes, with such others as the
    induction passed through, in order.
    """
    n = len(text)
    here = np.arange(n)
    last = here + 1 == limit
    # A suffix is smaller than its successor if its first byte that differs from the next one is smaller.
    change = np.ones(n, dtype=bool)
    change[:-1] = (text[:-1] != text[1:]) | last[:-1]
    where = np.flatnonzero(change)
    run = where[np.searchsorted(where, here)]
    following = text[np.minimum(run + 1, n - 1)]
    smaller = ~last[run] & (text[run] < following)
    # Needed: those asked for, and what they are induced from.
    wanted = need.copy()
    stop = np.flatnonzero(smaller | last)
    chain = np.searchsorted(stop, here[need & ~smaller])
    ends = stop[np.minimum(chain, len(stop) - 1)]
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, here[need & ~smaller], 1)
    np.add.at(mark, ends + 1, -1)
    wanted |= np.cumsum(mark[:-1]) > 0
    # First stage: sort the smaller ones; the last byte of a segment has no successor and is sorted with them.
    direct = np.flatnonzero(wanted & (smaller | last))
    order = _direct_sort(text, limit, group, direct, depth)
    # Second stage: induce the rest, one bucket of first bytes after the other.
    induced = wanted & ~smaller & ~last
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    first = text[order]
    by_byte = order[np.argsort(first, kind="stable")]
    cuts = np.searchsorted(text[by_byte], np.arange(257))

    def push(found: np.ndarray, at: int) -> None:
        found = found[found > 0] - 1
        found = found[induced[found] & (limit[found] == limit[np.minimum(found + 1, n - 1)])]
        if len(found):
            byte = text[found]
            for b in np.unique(byte):
                if b >= at:
                    heads[b].append(found[byte == b])

    out = []
    for byte in range(256):
        small = by_byte[cuts[byte] : cuts[byte + 1]]
        ends_here = last[small]
        # A suffix of one byte comes before all longer ones of its group and bucket.
        lone, small = small[ends_here], small[~ends_here]
        pieces, done = heads[byte], []
        if len(lone):
            pieces = [*pieces, lone] if not pieces else [lone, *pieces]
        while pieces:
            wave = np.concatenate(pieces)
            wave = wave[np.argsort(group[wave], kind="stable")]
            heads[byte] = []
            done.append(wave)
            push(wave, byte)
            pieces = heads[byte]
        if len(small):
            push(small, byte + 1)
            done.append(small)
        if done:
            bucket = np.concatenate(done)
            out.append(bucket[np.argsort(group[bucket], kind="stable")])
    if not out:
        return np.zeros(0, dtype=np.int64)
    whole = np.concatenate(out)
    return whole[np.argsort(group[whole], kind="stable")]


def _direct_sort(text, limit, group, starts, depth) -> np.ndarray:
    """Sort suffixes by group and their first ``depth`` bytes; what lies past a segment is the smallest."""
    if not len(starts):
        return starts
    wide = np.zeros((len(starts), depth + 4), dtype=np.uint8)
    number = group[starts].astype(">u4")
    wide[:, :4] = number.view(np.uint8).reshape(-1, 4)
    for k in range(0, len(starts), ROWS):
        part = starts[k : k + ROWS]
        at = part[:, None] + np.arange(depth)[None, :]
        inside = at < limit[part][:, None]
        np.minimum(at, len(text) - 1, out=at)
        wide[k : k + ROWS, 4:] = np.where(inside, text[at], 0)
    return starts[np.argsort(wide.view(f"S{depth + 4}").ravel(), kind="stable")]


def common_prefixes(text: np.ndarray, limit: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, at most ``depth``."""
    shared = np.zeros(len(order), dtype=np.int64)
    a, b = order[:-1], order[1:]
    most = np.minimum(np.minimum(limit[a] - a, limit[b] - b), depth)
    open_ = np.flatnonzero(most > 0)
    count = np.zeros(len(a), dtype=np.int64)
    step = 8
    while len(open_):
        at = count[open_][:, None] + np.arange(step)[None, :]
        ok = at < most[open_][:, None]
        x = np.minimum(a[open_][:, None] + at, len(text) - 1)
        y = np.minimum(b[open_][:, None] + at, len(text) - 1)
        same = ok & (text[x] == text[y])
        run = np.where(same.all(axis=1), step, np.argmin(same, axis=1))
        count[open_] += run
        open_ = open_[(run == step) & (count[open_] < most[open_])]
    shared[1:] = count
    return shared


def repeated_strings(text: np.ndarray, offsets: np.ndarray, group: np.ndarray, count: np.ndarray, span: int) -> np.ndarray:
    """For each byte of the segments, whether the string of ``span`` bytes from it occurs again in its group.

    offsets: starts of the segments and the end; group, count: of each segment.
    """
    lengths = np.diff(offsets)
    limit = np.repeat(offsets[1:], lengths)
    owner = np.repeat(group, lengths)
    need = limit - np.arange(len(text)) >= span
    order = two_stage_order(text, limit, owner, need, span)
    order = order[need[order]]
    out = np.zeros(len(text), dtype=bool)
    if not len(order):
        return out
    shared = common_prefixes(text, limit, order, span)
    new = (shared < span) | np.concatenate(([True], owner[order[1:]] != owner[order[:-1]]))
    run = np.cumsum(new) - 1
    many = np.bincount(run, weights=np.repeat(count, lengths)[order])
    out[order] = many[run] >= 2
    return out


def _flag_runs(flags: np.ndarray) -> np.ndarray:
    """[start, end) pairs of the true runs, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge.astype(np.int32)


def _sort_groups(span: int):
    """Rows (key, chash, m, content) sorted by key -> (key, chash, marks): runs of repeated strings of each content."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        keys, hashes, counts = (rows.column(i).combine_chunks() for i in range(3))
        buf, offs = string_buffers(rows.column(3))
        text, offsets = buf[offs[0] : offs[-1]], offs - offs[0]
        _, group = np.unique(np.asarray(keys), return_inverse=True)
        flags = repeated_strings(text, offsets, group.astype(np.int64), np.asarray(counts), span)
        marks = [_flag_runs(flags[offsets[i] : offsets[i + 1] - span + 1]) for i in range(len(offsets) - 1)]
        sizes = np.concatenate(([0], np.cumsum([len(m) for m in marks])))
        return pa.RecordBatch.from_arrays([keys, hashes, list_array(np.concatenate(marks), sizes, pa.int32())], names=["key", "chash", "marks"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            step = max(1, batch.num_rows * BATCH // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                part = pa.Table.from_batches([batch.slice(at, step)])
                held = part if held is None else pa.concat_tables([held, part])
                if held.nbytes < BATCH:
                    continue
                key = np.asarray(held.column(0).combine_chunks())
                last = len(key) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
                if last:  # the last key may go on
                    yield solve(held.slice(0, last))
                    held = held.slice(last)
        if held is not None and held.num_rows:
            yield solve(held)

    return rows


# ---------------------------------------------------------------- segments' content


def _signed(data: bytes, key: bytes = b"") -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=key).digest(), "little", signed=True)


def _packer(ddl: str, kinds: list[pa.DataType]):
    names = [x.split()[0] for x in ddl.split(", ")]
    return lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


_CONTENT_DDL = "anchor long, seg long, key long, chash long, base int, m long, size int, content binary"
_CONTENT_KINDS = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int32(), pa.binary()]


def _contents(span: int, hot: bool):
    """Rows of (id, body, text, list of segments) -> content rows; those of a hot anchor by slices of string offsets.

    Rows that repeat id and text give their contents once; a repeat that is
    missed does no harm, as it only raises a count that is above 1 already.
    """
    pack = _packer(_CONTENT_DDL, _CONTENT_KINDS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids, bodies = (batch.column(i).to_pylist() for i in (0, 1))
            buf, offs = string_buffers(batch.column(2))
            out: list[tuple] = []
            size = 0
            for i in range(batch.num_rows):
                if (ids[i], bodies[i]) in seen:
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add((ids[i], bodies[i]))
                text = buf[offs[i] : offs[i + 1]]
                for s in batch.column(3)[i].as_py():
                    lo, n, left = s["lo"], s["n"], s["left"]
                    if not hot:
                        out.append((s["anchor"], s["seg"], s["anchor"], s["seg"], 0, s["m"], n - 1 + span, text[lo : lo + n - 1 + span].tobytes()))
                        size += n + span
                    else:
                        # String k of the segment starts left - k bytes before the anchor.
                        for r in range((left - n + 1) // SLICE, left // SLICE + 1):
                            k0, k1 = max(0, left - (r + 1) * SLICE + 1), min(n - 1, left - r * SLICE)
                            if k0 > k1:
                                continue
                            core = lo + left - r * SLICE
                            shared = text[core : core - SLICE + 1 + span].tobytes()
                            content = text[lo + k0 : lo + k1 + span].tobytes()
                            out.append((s["anchor"], s["seg"], _signed(shared, f"{s['anchor']}:{r}".encode()), _signed(content, str(left - k0).encode()), k0, s["m"], len(content), content))
                            size += len(content)
                    if size > 1 << 22:
                        yield pack(out)
                        out, size = [], 0
            if out:
                yield pack(out)

    return rows


_STRING_DDL = "key long, chash long, k int, string long, m long, content binary"


def _strings(span: int):
    """Rows of (key, chash, m, content) -> a row for each string of a content."""
    pack = _packer(_STRING_DDL, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for key, chash, m, content in zip(*(batch.column(i).slice(at, 256).to_pylist() for i in range(4)), strict=True):
                    for k in range(len(content) - span + 1):
                        string = content[k : k + span]
                        out.append((key, chash, k, _signed(string), m, string))
                if out:
                    yield pack(out)

    return rows


# ---------------------------------------------------------------- the operator


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = string_buffers(batch.column(1))
        flat = batch.column(2).flatten()
        begin, end = (np.asarray(flat.field(i)) for i in (0, 1))
        place = np.concatenate(([0], np.cumsum(np.asarray(batch.column(2).value_lengths().fill_null(0)))))
        removed, spans, kept = [], [], []
        for i in range(batch.num_rows):
            text, own = buf[offs[i] : offs[i + 1]], slice(place[i], place[i + 1])
            if place[i] == place[i + 1]:
                removed.append(0), spans.append(0), kept.append(text.tobytes())
                continue
            change = np.zeros(len(text) + 1, dtype=np.int64)
            np.add.at(change, begin[own], 1)
            np.add.at(change, end[own], -1)
            gone = np.cumsum(change[:-1]) > 0
            removed.append(int(gone.sum())), spans.append(len(_flag_runs(gone)) // 2), kept.append(text[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def _sorted_marks(pieces: DataFrame, span: int) -> DataFrame:
    """(key, chash, marks) of contents that hold a repeated string."""
    dealt = pieces.select("key", "chash", "m", "content").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_sort_groups(span), "key long, chash long, marks array<int>").where(F.size("marks") > 0).distinct()


def remove_repeats(docs: DataFrame, *, text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Texts without the bytes that lie in a repeated string of ``span`` bytes.

    Returns doc_id, n_bytes, n_removed, n_spans and kept (binary; a cut can
    fall inside a character).  A null text counts as empty and an empty one
    stays as it is.  Rows that repeat an id or a whole text are occurrences of
    their own, so both copies go; a row without an id is known by its text.
    Of overlapping repeats (ties) all bytes go.  Empty table: no rows.  A very
    long text is read whole, and memory follows the longest one.  Only
    ``doc_id`` and ``text`` are read, so further columns of any name do no harm.
    """
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "suffix")
    docs = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("id"), F.xxhash64("text").alias("body"), "text", "doc_id")
    found = work.keep(keyed.select("id", "body", "text").mapInArrow(_anchor_rows(span, gram), _ANCHOR_DDL), "anchors")
    repeated = work.keep(found.groupBy("anchor").agg(F.count("*").alias("total")).where("total > 1").select("anchor"), "repeated")
    seen = work.keep(found.join(repeated, "anchor"), "seen")
    work.drop("anchors")

    segments = work.keep(seen.groupBy("anchor", "seg").agg(F.count("*").alias("m"), F.min(F.struct("id", "body", "lo", "n", "left")).alias("at")).select("anchor", "seg", "m", "at.*"), "segments")
    hot = work.keep(segments.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("anchor", F.lit(True).alias("hot")), "hot")
    segments = segments.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    own = F.struct("anchor", "seg", "m", "lo", "n", "left")  # of a text: no more than it has bytes
    wanted = segments.groupBy("id", "body").agg(F.collect_list(F.when(~F.col("hot"), own)).alias("cool"), F.collect_list(F.when(F.col("hot"), own)).alias("warm"))
    asked = keyed.select("id", "body", "text").join(wanted, ["id", "body"])
    cool = work.keep(asked.where(F.size("cool") > 0).select("id", "body", "text", "cool").mapInArrow(_contents(span, False), _CONTENT_DDL), "cool")
    if hot.isEmpty():
        pieces, parts = cool, cool
    else:
        warm = work.keep(asked.where(F.size("warm") > 0).select("id", "body", "text", "warm").mapInArrow(_contents(span, True), _CONTENT_DDL), "warm")
        merged = warm.groupBy("key", "chash").agg(F.sum("m").alias("m"), F.first("size").alias("size"), F.first("content").alias("content"))
        pieces = work.keep(cool.select("key", "chash", "m", "size", "content").unionByName(merged), "pieces")
        parts = cool.unionByName(warm)
    parts = parts.select("anchor", "seg", "key", "chash", "base").distinct()
    large = work.keep(pieces.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > GROUP_BYTES).select("key"), "large")
    if large.isEmpty():
        marks = work.keep(_sorted_marks(pieces, span), "marks")
    else:
        strings = work.keep(pieces.join(large, "key", "left_semi").select("key", "chash", "m", "content").mapInArrow(_strings(span), _STRING_DDL), "strings")
        single = strings.groupBy("string").agg(F.sum("m").alias("m"), F.first("content").alias("content")).select(F.col("string").alias("key"), F.col("string").alias("chash"), "m", "content")
        small = pieces.join(large, "key", "left_anti")
        marks = work.keep(_sorted_marks(small, span).unionByName(_sorted_marks(single, span)), "marks")
        inner = strings.select("key", "chash", "k", "string").distinct()
        split = parts.join(inner, ["key", "chash"]).select("anchor", "seg", F.col("string").alias("key"), F.col("string").alias("chash"), (F.col("base") + F.col("k")).alias("base"))
        parts = parts.join(large, "key", "left_anti").select("anchor", "seg", "key", "chash", "base").unionByName(split)
    pairs = F.transform(F.sequence(F.lit(0), F.size("marks") - 2, F.lit(2)), lambda i: F.struct((F.element_at("marks", i + 1) + F.col("base")).alias("s"), (F.element_at("marks", i + 2) + F.col("base")).alias("e")))
    hits = parts.join(marks, ["key", "chash"]).select("anchor", "seg", F.explode(pairs).alias("p")).groupBy("anchor", "seg").agg(F.collect_set("p").alias("cuts"))
    hits = work.keep(hits, "hits")  # a table, so that Spark can split an anchor that very many texts hold

    cuts = seen.select("id", "body", "anchor", "seg", "lo").join(hits, ["anchor", "seg"])
    cuts = cuts.select("id", "body", F.explode(F.transform("cuts", lambda p: F.struct((F.col("lo") + p["s"]).alias("s"), (F.col("lo") + p["e"] - 1 + span).alias("e")))).alias("c"))
    cuts = work.keep(cuts.groupBy("id", "body").agg(F.collect_set("c").alias("cuts")), "cuts")
    out = keyed.join(cuts, ["id", "body"], "left").select("doc_id", "text", "cuts")
    return out.mapInArrow(_render, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix dedup of all documents; see ``remove_repeats`` for nulls, ties, repeats, empty tables and long texts."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
