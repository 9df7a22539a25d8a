"""N-gram Jaccard join by chosen paths.

Each text is the set of its five-word shingles.  A run of the join splits the
sets recursively: at a node every set follows the shared token it samples, the
one with the smallest hash under the node's hash function, so two sets of
similarity s stay together with probability s.  A node of at most ``LEAF``
sets is a leaf and is compared by brute force; one still larger after
``DEPTH`` splits is compared block by block.  ``runs_for`` gives the number of
runs that reach the target recall at the threshold.

Texts with equal shingle sets form one class and take part once.  In a leaf,
pairs that an earlier run has already put into one leaf are left out, and so
are those whose sizes, or whose shingles counted by bucket, show that they
cannot reach the threshold; these bounds never drop a pair at the threshold.
Only then do the shingle sets of those left travel to the leaf for exact similarities.  A leaf returns one row
per set (links found, and one edge towards the smallest set it is connected
to), never its pairs; groups of linked sets come from these edges.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.components import connected, with_minimum
from tessella.llm.kernel import list_array, mix, runs, shingles, words
from tessella.llm.workspace import Workspace

THRESHOLD = 0.8
DEPTH = 3
LEAF = 256
RECALL = 0.999
BUCKETS = 256  # of the shingles of a set, by their lowest bits, whose counts bound what two sets share

_U = np.uint64


def runs_for(threshold: float, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold is found with the given probability, even in the deepest leaf."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def text_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingles of all texts of a run, their offsets)."""
    for a, _, buf, offs in runs(column):
        h, so = shingles(words(buf, offs))
        parts = [np.unique(h[so[i] : so[i + 1]]) for i in range(len(so) - 1)]
        yield a, (np.concatenate(parts) if parts else h), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def _set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def bucket_counts(values: np.ndarray) -> np.ndarray:
    """Shingles of a set in each bucket; nothing is cut off, as a byte that is full makes all of them 255."""
    counts = np.bincount((values & _U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return (counts if counts.max() < 255 else np.full(BUCKETS, 255)).astype(np.uint8)


def reachable(counts: np.ndarray, n: np.ndarray, due: np.ndarray, threshold: float) -> np.ndarray:
    """The pairs of ``due`` (symmetric) whose bucket counts leave room for the threshold; sets with full counts pass."""
    out = np.zeros_like(due)
    full = counts[:, 0] == 255
    a, b = np.nonzero(np.triu(due))
    for at in range(0, len(a), 4096):
        i, j = a[at : at + 4096], b[at : at + 4096]
        most = np.minimum(counts[i], counts[j]).sum(axis=1, dtype=np.int64)
        keep = full[i] | full[j] | (most * (1 + threshold) >= threshold * (n[i] + n[j]) - 1e-6)
        out[i[keep], j[keep]] = out[j[keep], i[keep]] = True
    return out


def _signatures(functions: int):
    factor = mix(np.arange(1, functions + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for a, values, offs in text_sets(text):
                n = np.diff(offs)
                has = np.flatnonzero(n)
                sig = np.zeros((len(n), functions), dtype=np.uint64)
                if len(has):
                    for f in range(functions):
                        sig[has, f] = np.minimum.reduceat(values * factor[f], offs[:-1][has])
                keys = [_set_key(values[offs[i] : offs[i + 1]]) if n[i] else hashlib.blake2b(b"text:" + (text[a + i].as_py() or "").encode(), digest_size=16).digest() for i in range(len(n))]
                pairs = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
                counts = [bucket_counts(values[offs[i] : offs[i + 1]]).tobytes() for i in range(len(n))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(n)), batch.column(2).slice(a, len(n)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n.astype(np.int32)), list_array(mix(sig).view(np.int64).ravel(), np.arange(len(n) + 1) * functions, pa.int64()), pa.array(counts, pa.binary())], names=["id", "body", "k1", "k2", "n", "sig", "counts"]
                )

    return rows


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, values, offs in text_sets(batch.column(1)):
            n = len(offs) - 1
            sets = [values[offs[i] : offs[i + 1]].tobytes() for i in range(n)]
            pairs = np.frombuffer(b"".join(_set_key(np.frombuffer(s, dtype=np.uint64)) for s in sets), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(sets, pa.binary())], names=["id", "k1", "k2", "tokens"])


# ---------------------------------------------------------------- leaves


def _by_leaf(solve: Callable[[list[dict]], list[tuple]], names: list[str], kinds: list[pa.DataType]):
    """Rows sorted by (leaf, i, j) -> what ``solve`` makes of each leaf's rows."""

    def emit(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["leaf"], row["i"], row["j"]) != (held[0]["leaf"], held[0]["i"], held[0]["j"]):
                    out += solve(held)
                    held = []
                    if len(out) > 2000:
                        yield emit(out)
                        out = []
                held.append(row)
        if held:
            out += solve(held)
        if out:
            yield emit(out)

    return rows


def _due(rows: list[dict], threshold: float) -> np.ndarray:
    """Pairs this leaf has to decide: across its two blocks, first met in this run, and near enough in size."""
    run = rows[0]["r"]
    n = np.array([r["n"] for r in rows], dtype=np.float64)
    due = np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9
    if run:
        earlier = np.array([r["leaves"][:run] for r in rows], dtype=np.int64)
        for k in range(run):
            due &= (earlier[:, k][:, None] != earlier[:, k][None, :]) | (earlier[:, k][:, None] == 0)
    if rows[0]["i"] != rows[0]["j"]:
        block = np.array([r["block"] for r in rows])
        due &= block[:, None] != block[None, :]
    np.fill_diagonal(due, False)
    return due


def _plausible(threshold: float):
    def solve(rows: list[dict]) -> list[tuple]:
        if len(rows) < 2:
            return []
        counts = np.frombuffer(b"".join(r["counts"] for r in rows), dtype=np.uint8).reshape(len(rows), BUCKETS)
        due = reachable(counts, np.array([r["n"] for r in rows]), _due(rows, threshold), threshold)
        return [(r["leaf"], r["i"], r["j"], r["r"], r["block"], r["node"], r["n"], r["members"], r["leaves"]) for r, any_ in zip(rows, due.any(axis=1), strict=True) if any_]

    return solve


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted distinct sets."""
    n = len(sets)
    both = np.zeros((n, n), dtype=np.float32)
    if n <= 12:
        for i in range(n):
            for j in range(i):
                both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return both
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[token] > 1
    owner, token = owner[shared], token[shared]
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    top = int(token[-1]) + 1 if len(token) else 0
    for at in range(0, top, 2048):
        lo, hi = np.searchsorted(token, (at, at + 2048))
        part = np.zeros((n, min(2048, top - at)), dtype=np.float32)
        part[owner[lo:hi], token[lo:hi] - at] = 1
        both += part @ part.T
    return both


def _verify(threshold: float):
    def solve(rows: list[dict]) -> list[tuple]:
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r["tokens"], dtype=np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        both = overlaps(sets).astype(np.float64)
        union = sizes[:, None] + sizes[None, :] - both
        linked = _due(rows, threshold) & (both >= threshold * union - 1e-9)
        members = np.array([r["members"] for r in rows], dtype=np.int64)
        node = np.array([r["node"] for r in rows], dtype=np.int64)
        docs, classes = linked @ members, linked.sum(axis=1)
        # The smallest set each one is connected to within the leaf.
        root = node.copy()
        while True:
            low = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (low == root).all():
                break
            root = low
        return [(int(node[k]), int(docs[k]), int(classes[k]), int(root[k])) for k in np.flatnonzero(classes)]

    return solve


_SPREAD_COLUMNS = ("leaf", "i", "j")


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition(*_SPREAD_COLUMNS).sortWithinPartitions(*_SPREAD_COLUMNS)


# ---------------------------------------------------------------- the operator


def _leaves(paths: DataFrame, work: Workspace, leaf: int) -> DataFrame:
    """(node, r, leaf, c) of all leaves with more than one set; c: the sets in it."""
    active, done = paths, None
    for depth in range(1, DEPTH + 1):
        key = F.col(f"p{depth}")
        sizes = active.groupBy(key.alias("leaf")).agg(F.count("*").alias("c")).where("c > 1")
        sizes = work.keep(sizes, f"sizes{depth}")  # a table, so that Spark can split a large node
        met = active.withColumn("leaf", key).join(sizes, "leaf")
        if depth < DEPTH:
            met = work.keep(met, f"level{depth}")
        here = (met if depth == DEPTH else met.where(F.col("c") <= leaf)).select("node", "r", "leaf", "c")
        done = here if done is None else done.unionByName(here)
        if depth < DEPTH:
            active = met.where(F.col("c") > leaf).drop("leaf", "c")
            if active.isEmpty():
                break
    return done


def _grouped(docs: DataFrame, *, text: str, threshold: float, leaf: int, recall: float) -> DataFrame:
    """What near_duplicates returns, with body (the text's hash), the key k1, k2 of its set, and first: whether the set is its group's first by id and key."""
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "jaccard")
    times = runs_for(threshold, DEPTH, recall)
    functions = times * DEPTH
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.coalesce("doc_id", F.xxhash64(body)).alias("id"), body.alias("text"), F.xxhash64(body).alias("body"))
    signed = work.keep(keyed.mapInArrow(_signatures(functions), "id long, body long, k1 long, k2 long, n int, sig array<long>, counts binary"), "signed")
    classes = work.keep(signed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("members"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("counts").alias("counts")).withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so numbers stay

    def step(r: Column, d: int) -> Column:
        return F.element_at("sig", r * DEPTH + d + 1)

    sets = classes.where("n > 0").select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("r"))
    r = F.col("r")
    paths = sets.withColumn("p1", F.xxhash64("r", step(r, 0))).withColumn("p2", F.xxhash64("p1", step(r, 1))).withColumn("p3", F.xxhash64("p2", step(r, 2))).drop("sig")
    leaves = _leaves(work.keep(paths, "paths"), work, leaf)
    mine = leaves.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("r", F.struct("leaf", "c").alias("at")))).alias("by"))
    every = F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda k: F.coalesce(F.element_at("by", k)["leaf"], F.lit(0)))
    mine = work.keep(mine.withColumn("leaves", every).join(classes.select("node", "n", "members", "counts"), "node"), "members")
    at = mine.select("node", "n", "members", "counts", "leaves", F.explode("by").alias("r", "at")).withColumn("leaf", F.col("at")["leaf"])
    blocks = F.ceil(F.col("at")["c"] / F.lit(leaf)).cast("int")
    at = at.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("at", "blocks", "other")
    columns = "leaf long, i int, j int, r int, block int, node long, n int, members long, leaves array<long>"
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    names = ["leaf", "i", "j", "r", "block", "node", "n", "members", "leaves"]
    open_ = work.keep(_dealt(at).mapInArrow(_by_leaf(_plausible(threshold), names, kinds), columns), "plausible")

    asked = open_.select("node").distinct().join(classes.select("node", "rep", "k1", "k2"), "node")
    texts = keyed.select("id", "text").join(asked.select(F.col("rep").alias("id")).distinct(), "id")
    tokens = texts.mapInArrow(_shingle_sets, "id long, k1 long, k2 long, tokens binary").withColumnRenamed("id", "rep").dropDuplicates(["rep", "k1", "k2"])
    tokens = work.keep(tokens.join(asked, ["rep", "k1", "k2"]).select("node", "tokens"), "tokens")
    full = open_.join(tokens, "node")
    found = work.keep(_dealt(full).mapInArrow(_by_leaf(_verify(threshold), ["node", "docs", "sets", "root"], [pa.int64()] * 4), "node long, docs long, sets long, root long"), "links")

    links = found.groupBy("node").agg(F.sum("docs").alias("docs"), F.sum("sets").alias("sets"))
    groups = connected(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), work)
    ends = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    named = ends.join(classes.select("node", "rep", "k1", "k2"), "node")
    lows = work.keep(with_minimum(named, "root", F.struct("rep", "k1", "k2"), F.col("node"), "low").select("node", "low"), "lows")
    known = classes.select("node", "k1", "k2", "rep", "members").join(links, "node", "left").join(lows, "node", "left")
    first = F.col("low").isNull() | ((F.col("low.k1") == F.col("k1")) & (F.col("low.k2") == F.col("k2")))
    known = known.select("k1", "k2", F.coalesce("low.rep", "rep").alias("class_id"), (F.coalesce("docs", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("sets", F.lit(0)).alias("n_class_links"), F.col("rep").alias("copy_of"), F.col("members").alias("n_copies"), first.alias("first"))
    return signed.select(F.col("id").alias("doc_id"), "body", "k1", "k2").join(known, ["k1", "k2"])


def near_duplicates(docs: DataFrame, *, text: str = "text", threshold: float = THRESHOLD, leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """One row per document: its group of linked documents and its number of links.

    Returns doc_id; class_id, the smallest id among the documents that links
    connect to it, itself included; n_links, how many other documents have
    similarity at least ``threshold`` to it; n_class_links, the same counted in
    different shingle sets; copy_of, the smallest id with an equal set; n_copies,
    documents with that set.

    A text of one to four words has one shingle, all its words.  Texts without
    words (null, empty, punctuation) are alike only if equal, null as empty.  A
    row without an id gets one from its text.  Repeated rows are copies of each
    other; rows that share an id but differ in text are documents of their own.
    Only ``doc_id`` and the text are read.
    """
    found = _grouped(docs, text=text, threshold=threshold, leaf=leaf, recall=recall)
    return found.select("doc_id", "class_id", "n_links", "n_class_links", "copy_of", "n_copies")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs but for all documents of a group except the one with the smallest id.

    Of rows of a group that repeat that id, as of a null id and an equal text,
    one stays.  Rows of different groups stay though they share an id.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    found = _grouped(docs, text="text", threshold=threshold, leaf=LEAF, recall=RECALL)
    keep = found.where("first AND doc_id = copy_of").groupBy("k1", "k2").agg(F.min("doc_id").alias("a"), F.min("body").alias("b")).drop("k1", "k2")
    whole = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"), F.coalesce("doc_id", F.xxhash64(body)).alias("a"), F.xxhash64(body).alias("b"))
    return whole.join(keep, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]).select("row.*")
