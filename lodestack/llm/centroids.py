"""Operator 12, centroid clustering: Lloyd's algorithm whose every assignment is exact, at the price of a float32 product.

Vectors become integers. A task screens its vectors with one float32 matrix product: |c|^2 - 2 x.c orders the centroids of x,
and the classic bound of a dot product's rounding error (gamma(d) * |x| * |c|, whatever the order of the sums) turns each value
into an interval that holds the true one. A centroid whose interval begins above the lowest end is out. Where more than one stays,
their distances are computed with integers, ties to the lowest number. So the result is that of exact arithmetic, and only
vectors that lie between centroids pay for it.

A round adds up each task's vectors by centroid (k rows a task), which Spark sums by centroid and component in decimals; the driver
holds k centroids. The integers are written once and read in each round, so a lost executor costs its own tasks.

Defined results: only vectors of exactly `dims` components take part, none of them null, non-finite, or 2**27 or more in size once scaled.
Repeated rows are vectors of their own; of rows that share an id the smaller vector comes first as a centroid. A null id hashes
as an empty one and is carried along. Fewer vectors than k give fewer centroids; an empty table gives no rows; centroids that lose
all vectors stay where they are; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .whole_vectors import kept, matrix

UNIT = 2.0**-24  # of float32


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) ends, in float64, of |c|^2 - 2 x.c for integer rows x and c."""
    xf, cf = x.astype(np.float32), c.astype(np.float32)
    dots = (xf @ cf.T).astype(np.float64)
    norms = (c.astype(np.float64) ** 2).sum(axis=1)
    sizes = np.sqrt((xf.astype(np.float64) ** 2).sum(axis=1))
    steps = (x.shape[1] + 2) * UNIT  # both roundings to float32, the product, and the sums
    gamma = steps / (1 - steps)
    value = norms - 2 * dots
    # The bound itself is rounded, in float64: 1e-6 and 2**-48 are far more than that costs.
    error = 2 * gamma * np.outer(sizes, np.sqrt(norms)) * (1 + 1e-6) + 2.0**-48 * (norms + 2 * np.abs(dots))
    return value - error, value + error


def nearest(x: np.ndarray, c: np.ndarray, at_once: int = 4096) -> tuple[np.ndarray, int]:
    """The nearest centroid of each row, ties to the lower number, and how many rows took exact distances."""
    best, exact = np.empty(len(x), np.int64), 0
    for at in range(0, len(x), at_once):
        part = x[at : at + at_once]
        low, high = intervals(part, c)
        stays = low <= high.min(axis=1)[:, None]
        best[at : at + len(part)] = stays.argmax(axis=1)  # the only one, or to be decided
        open_rows = np.flatnonzero(stays.sum(axis=1) > 1)
        exact += len(open_rows)
        if len(open_rows):
            far = np.full((len(open_rows), len(c)), np.iinfo(np.int64).max)
            for j in range(len(c)):
                own = np.flatnonzero(stays[open_rows, j])
                far[own, j] = ((part[open_rows[own]] - c[j]) ** 2).sum(axis=1)
            best[at + open_rows] = far.argmin(axis=1)
    return best, exact


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                of, _ = nearest(x, centroids)
                order = np.argsort(of, kind="stable")
                there, starts = np.unique(of[order], return_index=True)
                sums[there] += np.add.reduceat(x[order], starts)
                counts += np.bincount(of, minlength=k)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(counts[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    by_task = vectors.select("v").mapInArrow(work, "cluster int, n long, total array<long>")
    each = by_task.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("x"))
    out = centroids.copy()
    for r in each.collect():  # k * dims rows
        out[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
    return out


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors (id, v array<int>) -> (id, cluster, distance): the nearest centroid and the squared distance to it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                of, _ = nearest(x, centroids)
                far = ((x - centroids[of]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"])

    return vectors.select("id", "v").mapInArrow(work, "id long, cluster int, distance long")


def cluster(table: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(assign's rows, centroids (k, dims) in int64) after `rounds` rounds from k vectors drawn by the hash of their ids."""
    vectors = written(kept(table, id_col, vector_col, scale).where(F.size("v") == dims).select("id", "v"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = matrix(vectors.orderBy(drawn, "v").limit(k).select("v").toArrow()["v"].combine_chunks())
    if not len(centroids):
        return table.sparkSession.createDataFrame([], "id long, cluster int, distance long"), np.zeros((0, dims), np.int64)
    for _ in range(rounds):
        centroids = _moved(vectors, centroids)
    return assign(vectors, centroids), centroids


def digests(table: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept row."""
    rows, centroids = cluster(table, **options)
    rows = written(rows)
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    told = [(j, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    of_cluster = table.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of_cluster), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
