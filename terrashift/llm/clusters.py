"""Centroid clustering of vectors on an integer grid, with Hamerly's bounds.

Vectors are turned into integers once. Each keeps, from round to round, its cluster, one upper bound of
the distance to its own centroid and one lower bound of the distance to the second nearest. Between
rounds the upper bound grows by how far the own centroid moved, the lower one shrinks by how far any
other did. A vector whose upper bound is below its lower one, or below half the distance of its centroid
to the next, keeps its cluster unseen; else the upper bound is made tight, and if that doesn't settle it
the vector is scanned against all centroids, in exact integers, ties to the smaller number. Bounds carry
a margin for what rounding could do, so they decide nothing that the scan would decide otherwise.

A round is one pass over a table in the shared folder, which is written anew with its bounds, and one
sum over what was written, combined in each task; a lost executor costs a rerun of its tasks. The driver
sees ``k`` sums a round and gives out ``k`` centroids, however many vectors there are; sums are decimals
and exact. Tables that no later round reads are deleted.

Defined results: vectors with another number of components, with a null or non-finite one, or without
any are left out, and so are those with a component beyond ``LARGEST`` once scaled, as their squared
distances don't fit a long; repeated rows are vectors each; a null id is assigned like others, and begins
a centroid after all others only; with fewer vectors than ``k`` there are so many centroids; an empty
table gives an empty table; other columns are ignored. A sum that a long can't hold is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.llm.common import discard, materialize, workspace, written

#: Components within this give squared distances below 2^62 for 64 of them.
LARGEST = 2**27
#: Dot products of components within this are exact in doubles for 64 of them.
_IN_DOUBLES = 2**23
#: By how much bounds give way, relative and absolute: far more than the rounding of roots and sums.
_MARGIN = 1e-9

_STATE = "vec_id long, ints binary, cluster int, upper double, lower double"


def grid(vectors: DataFrame, scale: int, size: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, ints) of the vectors that count: floor(scale * x) of each component."""
    v = F.col(f"`{vector}`")
    number = lambda x: x.cast("double")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) * scale <= F.lit(float(LARGEST - 1))))
    kept = vectors.filter(v.isNotNull() & (F.size(v) == size)).filter(F.coalesce(fine, F.lit(False)))
    return kept.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(number(x) * scale).cast("int")).alias("ints"))


def starts(points: DataFrame, k: int, seed: int, size: int) -> np.ndarray:
    """The first centroids: the vectors whose ``seed:id`` has the smallest SHA-256, equal ones in order of their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = points.select(key.alias("key"), "ints").orderBy(F.col("key").asc_nulls_last(), "ints").limit(k).collect()  # k rows
    return np.array([r.ints for r in rows], np.int64).reshape(len(rows), size)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all centroids."""
    small = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= _IN_DOUBLES and x.shape[1] <= 64
    both = np.rint(x.astype(float) @ centroids.T.astype(float)).astype(np.int64) if small else x @ centroids.T
    return (x * x).sum(axis=1)[:, None] - 2 * both + (centroids * centroids).sum(axis=1)


def _own_distances(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    d = x - centroids[cluster]
    return (d * d).sum(axis=1)


def _up(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float)) * (1 + _MARGIN) + _MARGIN


def _down(squares: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(squares.astype(float)) * (1 - _MARGIN) - _MARGIN, 0)


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to the nearest other, never too much."""
    if len(centroids) < 2:
        return np.full(len(centroids), np.inf)
    d = squared_distances(centroids, centroids).astype(float)
    np.fill_diagonal(d, np.inf)
    return np.maximum(np.sqrt(d.min(axis=1)) / 2 * (1 - _MARGIN) - _MARGIN, 0)


def drifts(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and how far any other than it did; never too little."""
    moved = _up(((old - new) ** 2).sum(axis=1))
    other = np.zeros(len(moved))
    for j in range(len(moved)):
        other[j] = np.delete(moved, j).max(initial=0.0)
    return moved, other


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, gaps: np.ndarray) -> int:
    """Bring clusters and loosened bounds up to date, in place; the number of vectors that were scanned in full.

    A cluster of -1 is one not known yet.
    """
    at = np.flatnonzero((cluster < 0) | (upper >= np.maximum(lower, gaps[cluster])))
    known = at[cluster[at] >= 0]
    if len(known):  # a tight upper bound settles some
        upper[known] = _up(_own_distances(x[known], centroids, cluster[known]))
        at = at[(cluster[at] < 0) | (upper[at] >= np.maximum(lower[at], gaps[cluster[at]]))]
    if len(at):
        d = squared_distances(x[at], centroids)
        best = d.argmin(axis=1)  # the first of equal ones
        cluster[at] = best
        upper[at] = _up(d[np.arange(len(at)), best])
        if d.shape[1] > 1:
            d[np.arange(len(at)), best] = np.iinfo(np.int64).max
            lower[at] = _down(d.min(axis=1))
        else:
            lower[at] = np.inf
    return len(at)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Components of packed vectors, a row each."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view("<i4").reshape(len(column), size).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        flat = batch.column("ints").flatten().to_numpy(zero_copy_only=False).astype("<i4")
        rows = flat.reshape(n, size).view(f"V{4 * size}").ravel()
        columns = [batch.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(np.full(n, -1, np.int32)), pa.array(np.full(n, np.inf)), pa.array(np.zeros(n))]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "ints", "cluster", "upper", "lower"])


def _round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, moved: np.ndarray, other: np.ndarray) -> Iterator[pa.RecordBatch]:
    gaps = half_gaps(centroids)
    for batch in batches:
        x = _matrix(batch.column("ints"), centroids.shape[1])
        cluster, upper, lower = (batch.column(c).to_numpy().copy() for c in ("cluster", "upper", "lower"))
        upper += np.where(cluster >= 0, moved[cluster], 0)
        lower = np.maximum(lower - np.where(cluster >= 0, other[cluster], 0), 0)
        reassign(x, cluster, upper, lower, centroids, gaps)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("ints"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)], names=["vec_id", "ints", "cluster", "upper", "lower"])


def _sums(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """Count and sums of each cluster in this task; a task's sums fit a long, as 2^36 vectors would."""
    counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
    for batch in batches:
        cluster, x = batch.column("cluster").to_numpy(), _matrix(batch.column("ints"), size)
        order = np.argsort(cluster, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(cluster[order]) > 0))) if len(order) else order
        sums[cluster[order][first]] += np.add.reduceat(x[order], first, axis=0) if len(order) else 0
        counts += np.bincount(cluster, minlength=k)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])


def _distances(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cluster = batch.column("cluster").to_numpy()
        d = _own_distances(_matrix(batch.column("ints"), centroids.shape[1]), centroids, cluster)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d)], names=["vec_id", "cluster", "distance"])


def _exact(total: Column) -> Column:
    return F.sum(total.cast("decimal(38,0)"))


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The exact floors of the means of all clusters; an empty cluster's centroid stays."""
    k, size = centroids.shape
    parts = state.select("cluster", "ints").mapInArrow(lambda b: _sums(b, k, size), "cluster int, n long, sums array<bigint>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[_exact(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)]).collect()  # k rows
    out = centroids.copy()
    for r in rows:
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(size)]
    return out


def assign(
    vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, size: int = 64, seed: int = 2, vec_id: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that counts, the centroids), after ``rounds`` moves of the centroids.

    ``size`` is 64 at most.
    """
    points = grid(vectors, scale, size, vec_id, vector)
    centroids = starts(points, k, seed, size)
    if not len(centroids):
        return points.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), np.zeros((0, size), np.int64)
    spark, path = vectors.sparkSession, workspace(vectors.sparkSession, "clusters")
    state = written(points.mapInArrow(lambda b: _packed(b, size), _STATE), f"{path}/start")
    moved = other = np.zeros(len(centroids))
    for turn in range(rounds + 1):
        now, m, o = centroids, moved, other
        state = written(state.mapInArrow(lambda b, now=now, m=m, o=o: _round(b, now, m, o), _STATE), f"{path}/{turn}")
        discard(spark, f"{path}/{turn - 1 if turn else 'start'}")
        if turn < rounds:
            centroids = moved_centroids(state, now)
            moved, other = drifts(now, centroids)
    final = centroids
    found = materialize(state.select("vec_id", "ints", "cluster").mapInArrow(lambda b: _distances(b, final), "vec_id long, cluster int, distance long"), "clusters")
    discard(spark, path)
    return found, centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the summed distance of its cluster and of all, and a hash of its centroid."""
    own = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(_exact(F.col("distance")).alias("d")).collect()}  # k rows
    fits = lambda n: n if n < 2**63 else None
    hashed = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(i, fits(own[i]), fits(sum(own.values())), hashed(c)) for i, c in enumerate(centroids.tolist()) if i in own]
    table = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
