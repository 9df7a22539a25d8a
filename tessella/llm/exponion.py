"""Centroid clustering of integer vectors by exponion search.

Every vector carries its centroid, an upper bound of the distance to it and a
lower bound of the distance to any other.  When centroids move, bounds widen by
the moves.  A vector whose upper bound lies below both its lower bound and half
the way from its centroid to the next one stays unread.  Any other measures
only centroids inside a ball around its own, found in a list of the distances
between centroids that is sorted once a round.  The radius is inclusive and
bounds must be strictly apart, so a centroid at the same distance is always
measured and ties go to the smaller number.

Vectors are integers and squared distances exact: in 53-bit floats where these
hold every sum, else in Python's integers.  Bounds are rounded outwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.workspace import Workspace

DIM = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
#: The product of clusters and components that the driver holds for the centroids.
DRIVER_CELLS = 1 << 24

_UP, _DOWN = 1 + 1e-12, 1 - 1e-12
_STATE = "id long, v array<long>, cluster int, upper double, lower double"
_RESULT = "id long, cluster int, distance long"


def integer_vectors(vectors: DataFrame, row_id: str = "vec_id", column: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, v) of the vectors with exactly ``dim`` components, none null or non-finite: floor(scale * x) of each, x as double."""
    as_double = F.transform(F.col(column), lambda x: x.cast("double"))
    finite = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter((F.size(column) == dim) & finite)
    return kept.select(F.col(row_id).cast("long").alias("id"), F.transform(as_double, lambda x: F.floor(x * scale)).alias("v"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` (int64) to rows of ``c`` (int64 or Python's integers), in a float or object array."""
    top = max((abs(int(m)) for a in (x, c) if a.size for m in (a.min(), a.max())), default=0)
    if 4 * x.shape[1] * top * top < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)
    x, c = x.astype(object), c.astype(object)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def own_squares(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``x`` to its own centroid."""
    out = np.zeros(len(x), dtype=object)
    for k in np.unique(cluster):
        at = np.flatnonzero(cluster == k)
        out[at] = squares(x[at], c[k : k + 1])[:, 0].astype(object)
    return out


@dataclass
class Centroids:
    """The centroids of a round, their sorted mutual distances, and how far each has moved since the last."""

    values: np.ndarray  # clusters x components
    order: np.ndarray  # for each centroid all others by distance, itself first
    apart: np.ndarray  # those distances, rounded down
    near: np.ndarray  # distance to the nearest other, infinite for a lone one
    moved: np.ndarray  # rounded up
    others_moved: np.ndarray  # the largest move of any other

    @classmethod
    def of(cls, values: list[list[int]], before: list[list[int]] | None = None) -> Centroids:
        c = np.array(values, dtype=np.int64).reshape(len(values), -1)
        k = len(c)
        between = np.sqrt(squares(c, c).astype(np.float64)) * _DOWN
        np.fill_diagonal(between, -1.0)
        order = np.argsort(between, axis=1, kind="stable")
        apart = np.take_along_axis(between, order, axis=1)
        near = apart[:, 1] if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k)
        if before is not None:
            moved = np.sqrt(own_squares(c, np.array(before, dtype=np.int64), np.arange(k)).astype(np.float64)) * _UP
        top = np.sort(moved)
        others = np.where(moved == top[-1], top[-2], top[-1]) if k > 1 else np.zeros(k)
        if k > 1 and (moved == top[-1]).sum() > 1:
            others = np.full(k, top[-1])
        return cls(c, order, apart, near, moved, others)


def search(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, new bounds, and how many centroids it measured."""
    cluster, measured = cluster.copy(), np.zeros(len(x), dtype=np.int64)
    upper = (upper + c.moved[cluster]) * _UP
    lower = lower * _DOWN - c.others_moved[cluster] * _UP
    safe = np.maximum(lower, c.near[cluster] / 2 * _DOWN)
    at = np.flatnonzero(~(upper < safe))
    upper[at] = np.sqrt(own_squares(x[at], c.values, cluster[at]).astype(np.float64)) * _UP
    measured[at] = 1
    at = at[~(upper[at] < safe[at])]
    radius = (2 * upper[at] + c.near[cluster[at]]) * _UP
    was = cluster[at]
    for own in np.unique(was):
        mine = np.flatnonzero(was == own)
        inside = np.searchsorted(c.apart[own], radius[mine], side="right")
        ring = np.minimum(1 << np.ceil(np.log2(inside)).astype(np.int64), len(c.values))
        for size in np.unique(ring):
            rows, some = at[mine[ring == size]], np.sort(c.order[own][:size])
            d = squares(x[rows], c.values[some])
            best = np.argmin(d, axis=1)
            line = np.arange(len(rows))
            cluster[rows] = some[best]
            upper[rows] = np.sqrt(d[line, best].astype(np.float64)) * _UP
            if size > 1:
                d = d.astype(np.float64)
                d[line, best] = np.inf
                lower[rows] = np.sqrt(d.min(axis=1)) * _DOWN
            else:
                lower[rows] = np.inf
            measured[rows] += size
    return cluster, upper, lower, measured


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _step(state: DataFrame, c: Centroids, last: bool) -> DataFrame:
    """Assigns every vector once more; the last step returns exact distances instead of bounds."""
    dim = c.values.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b["v"], dim)
            cluster, upper, lower, _ = search(x, b["cluster"].to_numpy(), b["upper"].to_numpy(), b["lower"].to_numpy(), c)
            number = pa.array(cluster.astype(np.int32))
            if last:
                far = pa.array([int(d) for d in own_squares(x, c.values, cluster)], type=pa.int64())
                yield pa.RecordBatch.from_arrays([b["id"], number, far], names=["id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([b["id"], b["v"], number, pa.array(upper), pa.array(lower)], names=["id", "v", "cluster", "upper", "lower"])

    return state.mapInArrow(run, _RESULT if last else _STATE)


@dataclass
class Clustering:
    """``members`` (id, cluster, distance) is a written table; ``centroids`` those of the last assignment."""

    members: DataFrame
    centroids: list[list[int]]
    moves: list[float]  # the longest move of a centroid in each round


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> Clustering:
    """Clusters integer vectors (id, v), all of one length, around ``clusters`` centroids.

    The first centroids are the vectors with the smallest SHA-256 of
    ``seed:id``; rows with equal ids go by their vectors, rows without an id
    come last.  Fewer vectors than ``clusters`` make fewer centroids, and an
    empty table none.  Equal vectors and repeated rows share a cluster, and
    each counts.  A centroid is the componentwise floor of its vectors' mean;
    one that no vector chooses stays where it is.  A sum or squared distance
    beyond 64 bits raises an error, as Spark's own sums do.

    A round is one scan that assigns and one aggregation with partial sums, so
    a hot vector costs what any other does.  The driver holds centroids only,
    at most ``DRIVER_CELLS`` numbers.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "exponion")
    start = vectors.select("id", "v", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    state = work.keep(start, "0")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    seeds = state.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()
    now, moves = [list(r["v"]) for r in seeds], []
    if len(now) * len(now[0] if now else ()) > DRIVER_CELLS:
        raise ValueError(f"{len(now)} centroids of {len(now[0])} components are more than the driver should hold")
    if not now:
        return Clustering(work.keep(spark.createDataFrame([], _RESULT), "members"), [], [])
    before = None
    for k in range(rounds):
        state = work.keep(_step(state, Centroids.of(now, before), last=False), str(k + 1))
        work.drop(str(k))
        sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(len(now[0]))]
        found = {r["cluster"]: [r[f"s{i}"] // r["n"] for i in range(len(now[0]))] for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()}
        before, now = now, [found.get(j, old) for j, old in enumerate(now)]
        moves.append(max(sum((p - q) ** 2 for p, q in zip(a, b, strict=True)) for a, b in zip(before, now, strict=True)) ** 0.5)
    members = work.keep(_step(state, Centroids.of(now, before), last=True), "members")
    work.drop(str(rounds))
    return Clustering(members, now, moves)


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` with its cluster after five rounds, its distance, and the sums of distances."""
    found = cluster(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    inertia = {r["cluster"]: r["s"] for r in found.members.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    facts = [(k, inertia[k], sum(inertia.values()), digests[k]) for k in sorted(inertia)]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.members.join(F.broadcast(about), "cluster")  # one row a cluster
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same rounds as plain SQL over all pairs of vectors and centroids."""
    nearest = """
    a{k} AS MATERIALIZED (
      SELECT rid, arg_min(cluster, d * 64 + cluster) AS cluster, min(d) AS distance
      FROM (SELECT x.rid, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT AS d FROM kept x, c{k} c)
      GROUP BY rid)"""
    means = """
    m{k} AS (SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{k} JOIN kept USING (rid), range(1, 65) AS r(i) GROUP BY cluster, i),
    g{k} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m{k} GROUP BY cluster),
    c{n} AS MATERIALIZED (SELECT c.cluster, coalesce(g.v, c.v) AS v FROM c{k} c LEFT JOIN g{k} g USING (cluster))"""
    parts = [
        """WITH kept AS MATERIALIZED (
      SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS MATERIALIZED (
      SELECT (row_number() OVER (ORDER BY h NULLS LAST, v) - 1)::INTEGER AS cluster, v
      FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT 40))"""
    ]
    for k in range(ROUNDS):
        parts += [nearest.format(k=k), means.format(k=k, n=k + 1)]
    parts.append(nearest.format(k=ROUNDS))
    return ",".join(parts) + f"""
    SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
           sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{ROUNDS} a JOIN kept USING (rid) JOIN c{ROUNDS} c USING (cluster)"""


OP11_SQL = _sql()
