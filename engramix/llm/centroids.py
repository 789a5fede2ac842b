"""Centroid clustering (operator 11): Lloyd's rounds over integer vectors with block-norm screening.

A vector is cut into ``SEGMENTS`` segments, whose Euclidean norms are computed once and stored
beside it: the compressed vector. With the Cauchy-Schwarz inequality on every segment,
|v|^2 + |c|^2 - 2 * sum of |v_s| |c_s| is a lower bound of the squared distance of v and c. A vector's
exact distance to the centroid of the least bound is an upper bound of its nearest distance; only
centroids whose lower bound does not exceed it receive exact integer distances.

The kept vectors are written once as integers with their norms. In each round every task holds the
centroids (k times d integers, the parameters bound them), assigns its vectors and emits one row of sums per
cluster and task; Spark adds these up by cluster and component, so the driver receives k times (d + 1) numbers.

Kept are vectors of ``dims`` components, none null or non-finite; other rows (null vectors too) are not in the
result. Components saturate at ``SATURATION``. Repeated rows and equal ids are vectors of their own. Vectors
with a null id take part, and come last among the starting centroids; equal hashes are told apart by
components. Fewer vectors than ``k`` give as many centroids; empty clusters keep their centroid; empty
tables give empty results. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_package
from .vectors import finite, integers, matrix

SEGMENTS = 8
#: Beyond this an inertia is not a long; it is given as this.
MOST = (1 << 63) - 1


@dataclass
class Clustering:
    """``rows``: id, cluster, distance. ``centroids`` (k, d); ``inertias`` by cluster."""

    rows: DataFrame
    centroids: np.ndarray
    inertias: list[int]

    def centroid_rows(self) -> DataFrame:
        """cluster, centroid, cluster_inertia, inertia and centroid_sha256; one row per centroid."""
        cap = lambda n: min(n, MOST)
        whole = cap(sum(self.inertias))
        rows = [
            (i, [int(x) for x in c], cap(n), whole, hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest())
            for i, (c, n) in enumerate(zip(self.centroids, self.inertias, strict=True))
        ]
        kind = "cluster int, centroid array<bigint>, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return self.rows.sparkSession.createDataFrame(rows, kind)


def segment_norms(v: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The Euclidean norms of a matrix' column segments, ``(n, segments)``."""
    starts = np.arange(0, v.shape[1], -(-v.shape[1] // segments))
    return np.sqrt(np.add.reduceat(np.square(v.astype(np.float64)), starts, axis=1))


def screened(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (ties: the smaller number), its squared
    distance, and how many exact distances were computed."""
    c_norms = segment_norms(centroids, norms.shape[1])
    size = np.square(norms).sum(1)[:, None] + np.square(c_norms).sum(1)[None, :]
    # Rounding errors of the doubles are far below the slack.
    bounds = size - 2 * norms @ c_norms.T - 1e-9 * size
    cluster = bounds.argmin(1)
    best = np.square(v - centroids[cluster]).sum(1)
    exact = len(v)
    for c, centroid in enumerate(centroids):
        at = np.flatnonzero((bounds[:, c] <= best) & (cluster != c))
        if not len(at):
            continue
        exact += len(at)
        distance = np.square(v[at] - centroid).sum(1)
        nearer = (distance < best[at]) | ((distance == best[at]) & (c < cluster[at]))
        best[at[nearer]], cluster[at[nearer]] = distance[nearer], c
    return cluster, best, exact


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            v = matrix(batch.column(1), centroids.shape[1])
            norms = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
            yield batch, v, *screened(v, norms, centroids)[:2]


def compressed(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """The kept vectors, written: ``id``, ``v`` (integers) and ``norms`` of their segments."""
    width = -(-dims // SEGMENTS)
    v = F.col("v")
    norm = lambda s: F.sqrt(F.aggregate(F.slice(v, s, F.lit(width)), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    kept = vectors.filter(finite(F.col(vec_col)) & (F.size(vec_col) == dims))
    kept = kept.select(F.col(id_col).alias("id"), integers(F.col(vec_col), scale).alias("v"))
    return materialize(kept.withColumn("norms", F.transform(F.array(*[F.lit(s) for s in range(1, dims + 1, width)]), norm)))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hex sha256 of ``seed:id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor(sum / count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for _, v, cluster, _ in _assigned(batches, centroids):
            np.add.at(sums[:, :-1], cluster, v)
            sums[:, -1] += np.bincount(cluster, minlength=len(centroids))
        at = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = kept.mapInArrow(run, "cluster int, sums array<bigint>")
    totals = parts.select("cluster", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(F.sum("part").alias("total")).collect()
    sums = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
    for cluster, place, total in totals:
        sums[cluster, place] = total
    filled = sums[:, -1] > 0
    out = centroids.copy()
    out[filled] = sums[filled, :-1] // sums[filled, -1:]
    return out


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding"
) -> Clustering:
    """The clustering of all kept vectors after ``rounds`` rounds and a last assignment."""
    spark = vectors.sparkSession
    ship_package(spark)
    key = vectors.schema[id_col].dataType.simpleString()
    kept = compressed(vectors, id_col, vec_col, dims, scale)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return Clustering(spark.createDataFrame([], f"`{id_col}` {key}, cluster int, distance bigint"), np.zeros((0, dims), np.int64), [])
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    final = centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, distance in _assigned(batches, final):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    rows = materialize(kept.mapInArrow(run, f"id {key}, cluster int, distance bigint"))
    inertias = [0] * len(final)
    for cluster, total in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect():
        inertias[cluster] = int(total)
    return Clustering(rows.withColumnRenamed("id", id_col), final, inertias)
