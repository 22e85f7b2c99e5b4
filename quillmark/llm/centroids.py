"""Clustering around centroids by exact integer distances, with Elkan's bounds.

A vector's components become integers once. Each round assigns every vector to its nearest centroid, then moves the centroids. With every vector stay its cluster, an upper bound of
the distance to its centroid and a lower bound of the distance to each centroid. When centroids move, bounds give way by as much; a distance is computed only where
neither a lower bound nor half the distance between two centroids shows that the other centroid is farther. Bounds are rounded away from the truth and have to be strictly
apart, so ties are always decided by integers.

Vectors stay where they are: a round writes the table anew, and of each task only the sums of its clusters are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import drop_stored, stored

#: Components of a vector, clusters, rounds, factor before the floor, and what the vectors' numbers are hashed with to choose the first centroids.
SIZE, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2"
#: Largest component of a kept vector: beyond it a squared distance may not fit 64 bits. Up to EXACT all products and sums of distances are exact in doubles.
LARGEST, EXACT = 1 << 27, 1 << 22
_EPS = 2.0**-50


def above(x: np.ndarray) -> np.ndarray:
    """At least what the rounded ``x`` (not negative) stands for."""
    return x * (1 + _EPS)


def below(x: np.ndarray) -> np.ndarray:
    """At most what the rounded ``x`` stands for, and not negative, in 32 bits."""
    x = np.maximum(x * (1 - _EPS), 0.0)
    out = x.astype(np.float32)
    return np.where(out > x, np.nextafter(out, np.float32(0)), out)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exactly."""
    gap = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", gap, gap)


def squared_all(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each centroid, exactly: by products of doubles where none can be rounded."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) > EXACT:
        return np.stack([squared(x, c) for c in centroids], axis=1)
    a, b = x.astype(np.float64), centroids.astype(np.float64)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


class Moves:
    """Centroids of a round, how far they are from each other, and how far they have moved since the last one."""

    def __init__(self, centroids: np.ndarray, old: np.ndarray | None):
        self.centroids = centroids
        k = len(centroids)
        self.half = below(0.5 * np.sqrt(squared_all(centroids, centroids).astype(np.float64))).astype(np.float64)
        apart = self.half + np.where(np.eye(k, dtype=bool), np.inf, 0.0)
        self.nearest = apart.min(axis=1, initial=np.inf)
        self.moved = None if old is None else above(np.sqrt(squared(centroids, old).astype(np.float64)))


def assign(moves: Moves, x: np.ndarray, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster, upper bound and lower bounds of each row under new centroids from those under the old ones, and the distances that were computed."""
    c, n, k = moves.centroids, len(x), len(moves.centroids)
    if cluster is None:
        d = squared_all(x, c)
        best = d.argmin(axis=1)  # the smaller number of equals
        root = np.sqrt(d.astype(np.float64))
        return best, above(root[np.arange(n), best]), below(root), n * k
    cluster, upper, lower = cluster.copy(), above(upper + moves.moved[cluster]), below(lower - moves.moved)
    rows = np.flatnonzero(~(upper < moves.nearest[cluster]))
    maybe = lambda r, at: ~((upper[r, None] < lower[r]) | (upper[r, None] < moves.half[at]))
    others = lambda r: maybe(r, cluster[r]) & (np.arange(k) != cluster[r, None])
    rows = rows[others(rows).any(axis=1)]
    best = squared(x[rows], c[cluster[rows]])  # bounds as near as they get, then once more
    root, computed = np.sqrt(best.astype(np.float64)), len(rows)
    upper[rows], lower[rows, cluster[rows]] = above(root), below(root)
    open_ = others(rows)
    for j in np.flatnonzero(open_.any(axis=0)).tolist():
        at = np.flatnonzero(open_[:, j])
        r = rows[at]
        now = (cluster[r] != j) & ~(upper[r] < lower[r, j]) & ~(upper[r] < moves.half[cluster[r], j])  # a nearer one may have been found meanwhile
        at, r = at[now], r[now]
        d = squared(x[r], c[j])
        computed += len(r)
        root = np.sqrt(d.astype(np.float64))
        lower[r, j] = below(root)
        nearer = (d < best[at]) | ((d == best[at]) & (j < cluster[r]))
        at, r = at[nearer], r[nearer]
        cluster[r], best[at], upper[r] = j, d[nearer], above(root[nearer])
    return cluster, upper, lower, computed


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = SIZE) -> DataFrame:
    """(vec_id, q) of the vectors with exactly ``size`` components, none null or without a finite value; q are their floors after scaling, as long."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where((F.size(v) == size) & finite)
    return rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("q"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors of the smallest hashes of their numbers, in this order; of equal numbers the smaller vector comes first, and a null number is hashed as an empty text."""
    hashed = kept.select(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "q")
    return np.array([r.q for r in hashed.orderBy("h", "q").limit(clusters).collect()], np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * width).astype(np.int32)), pa.py_buffer(data)])


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = array.buffers()
    wide = pa.types.is_large_binary(array.type)
    first = int(np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset])
    return np.frombuffer(data, kind, len(array) * width, first).reshape(len(array), width)


_STATE = "vec_id long, q binary, cluster int, upper double, lower binary, distance long"


def _first(shared, size: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten(), np.int64).reshape(-1, size)
                if np.abs(x).max() > LARGEST:
                    raise ValueError(f"a component exceeds {LARGEST // SCALE}: squared distances may not fit 64 bits")
                yield _state(batch.column(0), x.astype(np.int32), shared.value, None, None, None)

    return run


def _next(shared, size: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                moves = shared.value
                x = _matrix(batch.column(1), "<i4", size)
                yield _state(batch.column(0), x, moves, np.asarray(batch.column(2), np.int64), np.asarray(batch.column(3)), _matrix(batch.column(4), "<f4", len(moves.centroids)))

    return run


def _state(ids: pa.Array, x: np.ndarray, moves: Moves, cluster, upper, lower) -> pa.RecordBatch:
    cluster, upper, lower, _ = assign(moves, x, cluster, upper, lower)
    distance = squared(x, moves.centroids[cluster])
    return pa.RecordBatch.from_arrays([ids, _binary(x), pa.array(cluster.astype(np.int32)), pa.array(upper), _binary(lower.astype("<f4")), pa.array(distance)], ["vec_id", "q", "cluster", "upper", "lower", "distance"])


def _sums(clusters: int, size: int):
    """Of each task, the rows and component sums of its clusters: (cluster, place, total), the rows at place -1."""

    def run(batches):
        total = np.zeros((clusters, size + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                cluster, x = np.asarray(batch.column(0), np.int64), _matrix(batch.column(1), "<i4", size)
                order = np.argsort(cluster, kind="stable")
                own, begin = np.unique(cluster[order], return_index=True)
                total[own, 1:] += np.add.reduceat(x[order].astype(np.int64), begin, axis=0)
                total[own, 0] += np.bincount(cluster, minlength=clusters)[own]
        own = np.flatnonzero(total[:, 0])
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, size + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, size), len(own)).astype(np.int32)), pa.array(total[own].reshape(-1))], ["cluster", "place", "total"])

    return run


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; a cluster without vectors keeps its centroid."""
    k, size = centroids.shape
    sums = state.select("cluster", "q").mapInArrow(_sums(k, size), "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals = {(r.cluster, r.place): int(r.total) for r in sums.collect()}  # one for each cluster and component
    return np.array([[totals[j, i] // totals[j, -1] for i in range(size)] if (j, -1) in totals else centroids[j].tolist() for j in range(k)], np.int64)


def clusters_of(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector after ``rounds`` moves of the centroids.

    Vectors of another size, with a null or a value that isn't finite are left out; null keys and repeated rows have their own rows and count as often as they occur. With fewer
    vectors than clusters each of them is a centroid; an empty table gives no rows; other columns don't matter. A component beyond LARGEST / SCALE is an error. Of equally
    near centroids the one of the smaller number is taken. A round's table goes when the next one is there.
    """
    spark = vectors.sparkSession
    kept = integers(vectors, key, vector, size)
    centroids, old, state = first_centroids(kept, clusters), None, None
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for i in range(rounds + 1):
        shared = spark.sparkContext.broadcast(Moves(centroids, old))
        step = kept.mapInArrow(_first(shared, size), _STATE) if state is None else state.mapInArrow(_next(shared, size), _STATE)
        now = stored(step if i < rounds else step.select("vec_id", "cluster", "distance"), "clusters")
        if state is not None:
            drop_stored(state)
        state = now
        if i < rounds:
            old, centroids = centroids, moved(state, centroids)
    per = {r.cluster: int(r.total) for r in state.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # one for each cluster
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    ends = spark.createDataFrame([(j, t, sum(per.values()), digest[j]) for j, t in per.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
