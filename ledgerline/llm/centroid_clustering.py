"""Centroid clustering in exact integers, with a table of distances to fixed pivots (LAESA).

The distances of each vector to a few fixed pivots are computed once and stored with it. In each round only the centroids are measured against
the pivots; for a vector, the largest difference between its and a centroid's distance to the same pivot is a lower bound of
their distance. Centroids whose bound is above the best distance found so far are left out, all others get the exact one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F, types as T

from .common import picked, staged

SCALE = 256
#: Components are cut to this range, so that distances fit 64 bits.
LARGEST = 1 << 26
#: More than square roots and differences of doubles can be off, relative to the distances.
ROUNDING = 1e-12


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64) -> DataFrame:
    """(vec_id, vector): vectors of ``dims`` components, all finite, as floor(256 * x); all other rows go."""
    kept = picked(vectors, vec_id=id_col, vector=vector_col)
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("vector", lambda x: F.floor(F.least(F.lit(float(LARGEST)), F.greatest(F.lit(float(-LARGEST)), x.cast("double") * SCALE))).cast("long"))
    return kept.filter((F.size("vector") == dims) & finite).select("vec_id", whole.alias("vector"))


def first_centroids(kept: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors with the least hashes of ``seed:id``; equal hashes are ordered by the vectors, a null id hashes as an empty one."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(hashed.alias("hash"), "vector").orderBy("hash", "vector").limit(clusters).collect()  # as many rows as clusters
    return np.array([r["vector"] for r in rows], np.int64)


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` different ones of a few points: the first, then always that farthest from those taken."""
    taken, away = [0], squared(points, points[0])
    while len(taken) < n and away.max() > 0:
        taken.append(int(away.argmax()))
        away = np.minimum(away, squared(points, points[taken[-1]]))
    return points[taken]


def squared(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    apart = vectors - others
    return np.einsum("ij,ij->i", apart, apart)


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, exact distances computed); ties go to the smaller number.

    ``to_pivots``: squared distances of the vectors to the pivots. Centroids are visited by rising bound.
    """
    own = np.sqrt(to_pivots.astype(np.float64))
    theirs = np.sqrt(np.array([squared(pivots, c) for c in centroids]).astype(np.float64))
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(own[:, p, None] - theirs[None, :, p]), out=bound)
    bound -= ROUNDING * (own.max(axis=1, keepdims=True) + theirs.max())
    order = np.argsort(bound, axis=1, kind="stable")
    cluster = order[:, 0].copy()
    best, computed = squared(vectors, centroids[cluster]), len(vectors)
    alive = np.arange(len(vectors))
    for k in range(1, len(centroids)):
        c = order[alive, k]
        near = bound[alive, c] <= np.sqrt(best[alive].astype(np.float64)) * (1 + ROUNDING)
        alive, c = alive[near], c[near]
        if not len(alive):
            break
        d = squared(vectors[alive], centroids[c])
        computed += len(alive)
        better = (d < best[alive]) | ((d == best[alive]) & (c < cluster[alive]))
        best[alive[better]], cluster[alive[better]] = d[better], c[better]
    return cluster, best, computed


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.ravel()))


def pivot_table(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The kept vectors with their squared distances to the pivots, written once."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("vector"), pivots.shape[1])
            far = np.stack([squared(v, p) for p in pivots], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(far)], names=["vec_id", "vector", "to_pivots"])

    schema = T.StructType([*kept.schema.fields, T.StructField("to_pivots", T.ArrayType(T.LongType()))])
    return staged(kept.mapInArrow(measured, schema), "pivots")


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors; those without vectors stay.

    Each task adds up its vectors by cluster, so that one row for each task and cluster is shuffled.
    """
    k, dims = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            v = _matrix(b.column("vector"), dims)
            cluster, _, _ = nearest(v, _matrix(b.column("to_pivots"), len(pivots)), centroids, pivots)
            n += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, v)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), _lists(sums[some])], names=["cluster", "n", "sums"])

    parts = table.select("vector", "to_pivots").mapInArrow(summed, "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums")).collect()  # a row for each cluster
    out = centroids.copy()
    for r in totals:
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dims = centroids.shape[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, best, _ = nearest(_matrix(b.column("vector"), dims), _matrix(b.column("to_pivots"), len(pivots)), centroids, pivots)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    schema = T.StructType([table.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return table.mapInArrow(each, schema)


def centroid_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, clusters: int = 40, rounds: int = 5, pivots: int = 16, seed: str = "2"
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, and the final centroid itself.

    A vector that is null, or not of ``dims`` components, or holds a null, NaN or infinity isn't kept. Components beyond 2**18
    count as 2**18. Rows that repeat an id are vectors of their own; a null id is kept. With fewer vectors than clusters there are as many
    clusters as vectors; equal first centroids leave the later ones empty, since ties go to the smaller number. An empty table gives no
    rows. Extra columns are ignored.
    """
    kept = integers(vectors, id_col, vector_col, dims)
    centroids = first_centroids(kept, clusters, seed)
    spark = vectors.sparkSession
    extra = "cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    if not len(centroids):
        none = kept.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).filter("false")
        return none.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in extra.split(", "))])
    anchors = far_apart(centroids, pivots)
    table = pivot_table(kept, anchors)
    for _ in range(rounds):
        centroids = moved(table, centroids, anchors)
    placed = staged(assigned(table, centroids, anchors), "clusters")
    sums = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each cluster
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [Row(c, s, sum(sums.values()), digest(centroids[c].tolist()), centroids[c].tolist()) for c, s in sums.items()]
    return placed.join(F.broadcast(spark.createDataFrame(rows, f"cluster int, {extra}")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
