"""Centroid clustering over integer vectors, with distances read from scalar lookup tables.

Each component becomes the integer floor(64 x).  In each round a task tabulates, for each dimension, the squared
difference between each integer value that occurs in its batch and each centroid; a vector's distances are then
NumPy gathers from the tables, and sums.  A table has at most as many rows as its batch, whatever the values are.
Tasks send a count and a sum for each centroid, which Spark adds up in decimals; only centroids come to the driver
(``k`` times ``dims`` numbers).  All arithmetic is exact, so the result depends neither on partitions nor on
retried tasks; each round is a job of its own over a written table.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are left out;
scaled components beyond 2**27 count as that bound, so that squared distances fit 64 bits.  Rows with equal or
null ids are vectors of their own; seeds with equal hashes are ordered by their components, null ids come last.  With
fewer than ``k`` vectors there are that many centroids; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BOUND = 2**27


@dataclass(frozen=True)
class ClusterConfig:
    k: int = 16
    rounds: int = 3
    dims: int = 64
    scale: int = 64
    salt: str = "1:"


def integer_vectors(embeddings: DataFrame, config: ClusterConfig = ClusterConfig()) -> DataFrame:
    """(vec_id, v): the usable vectors with integer components."""
    usable = (F.size("embedding") == config.dims) & F.forall("embedding", lambda x: F.coalesce(
        F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x.cast("double")))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-float(BOUND)), F.least(
        F.lit(float(BOUND)), x.cast("double") * config.scale))).cast("int"))
    return embeddings.where(F.coalesce(usable, F.lit(False))).select("vec_id", whole.alias("v"))


def seeds(vectors: DataFrame, config: ClusterConfig = ClusterConfig()) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids, in that order."""
    digest = F.sha2(F.concat(F.lit(config.salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "v").limit(config.k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), config.dims)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (rows of ``x`` by centroids), by a table for each dimension over the values that occur in it."""
    out = np.zeros((len(x), len(centroids)), np.int64)
    for d in range(x.shape[1]):
        values, place = np.unique(x[:, d], return_inverse=True)
        table = (values.astype(np.int64)[:, None] - centroids[None, :, d]) ** 2
        out += table[place]
    return out


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten(), np.int32).reshape(batch.num_rows, dims)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """Rows (cluster, pos, n, total) of the vectors nearest to each centroid."""
    k, dims = centroids.shape

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            x = _matrix(b, dims)
            nearest = distances(x, centroids).argmin(axis=1)
            count += np.bincount(nearest, minlength=k)
            for c in np.unique(nearest):
                total[c] += x[nearest == c].sum(axis=0, dtype=np.int64)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(
            list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, total array<long>")
    return parts.select("cluster", "n", F.posexplode("total").alias("pos", "total")).groupBy("cluster", "pos").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()


def fit(vectors: DataFrame, config: ClusterConfig = ClusterConfig()) -> np.ndarray:
    """The centroids after ``rounds`` rounds; a centroid without vectors stays where it is."""
    centroids = seeds(vectors, config)
    for _ in range(config.rounds if len(centroids) else 0):
        found = centroids.copy()
        for r in _sums(vectors, centroids):
            found[r["cluster"], r["pos"]] = int(r["total"]) // int(r["n"])
        centroids = found
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) for every vector; of equally near centroids, the first."""
    dims = centroids.shape[1]

    def run(batches):
        for b in batches:
            away = distances(_matrix(b, dims), centroids)
            nearest = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(nearest, pa.int32()), pa.array(
                away[np.arange(len(away)), nearest])], ["vec_id", "cluster", "distance"])

    kind = dict(vectors.dtypes)["vec_id"]
    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster(embeddings: DataFrame, config: ClusterConfig = ClusterConfig()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per usable vector."""
    spark = embeddings.sparkSession
    vectors = written(integer_vectors(embeddings, config), "cluster-vectors")
    centroids = fit(vectors, config)
    if not len(centroids):
        return vectors.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    placed = written(assign(vectors, centroids), "cluster-placed")
    away = {r["cluster"]: int(r["away"]) for r in placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("away")).collect()}  # at most k rows
    total = sum(away.values())
    rows = [(c, n, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in away.items()]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
