"""Operator 1, approximate nearest neighbours over shifted space-filling curves.

Vectors are projected (principal axes of a bounded sample, turned and shifted at random anew for each of `orderings`
orderings), cut to a few bits an axis and numbered along a Hilbert curve. Spark range-partitions the (ordering, key)
rows, and counts per partition give each row its rank in its ordering. A query's candidates are the rows within `window`
ranks of it in any ordering. Rows are grouped into blocks of consecutive ranks, of at most `block` rows; a query visits
every block that its window touches, keeps each block's nearest by exact distance, and what the windows of all orderings
found is merged and ranked by exact distance, ties to the smaller id.

The window is not guessed: for a bounded number of queries the exact neighbours are found by one pass over all vectors,
and the window is the rank distance (in the best ordering) that holds `recall` of them. More orderings need a smaller window each: of 1, 2,
4 ... orderings those are searched that make the fewest pairs. The window is small where vectors have structure and grows with the table where
they have none, as it must: there one ordering stays, whose windows reach most of the table, and a warning tells the figures.

Equal vectors are searched once: of equal vectors only the k + 1 smallest ids can be in any answer, and queries with equal
vectors share one search.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part, nor do rows without id; repeated rows count once; rows that share an id but not the vector are rows of their own, as queries
(each with its own ranks) and as answers, but none is an answer to a query with its id; fewer candidates than k give fewer rows; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, fan_out, written

FOUND = "q long, uid long, id long, score double"


def usable(vector: Column) -> Column:
    """True for vectors that take part, but for their length."""
    sound = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """x: (points, axes) integers below 2**bits -> place along the Hilbert curve (Skilling's transform), up to 63 bits."""
    x = np.ascontiguousarray(x.T).astype(U64)
    axes, one = len(x), U64(1)
    for b in range(bits - 1, 0, -1):
        q, p = U64(1 << b), U64((1 << b) - 1)
        for i in range(axes):
            high = (x[i] & q) != 0
            swap = np.where(high, U64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & U64(1 << b)) != 0, U64((1 << b) - 1), U64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << one | (x[i] >> U64(b)) & one
    return key.astype(np.int64)


class Curves:
    """Projections of all orderings, fitted on a sample of vectors (rows)."""

    def __init__(self, sample: np.ndarray, orderings: int, axes: int = 15, bits: int = 4, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bits, dim = bits, sample.shape[1]
        axes = min(axes, dim)
        self.mean = sample.mean(axis=0)
        _, _, main = np.linalg.svd(sample - self.mean, full_matrices=False)
        main = main[: min(len(main), max(axes, 24))].T
        self.maps, self.low, self.scale = [], [], []
        for _ in range(orderings):
            turned = main @ np.linalg.qr(rng.normal(size=(main.shape[1], main.shape[1])))[0][:, :axes]
            y = (sample - self.mean) @ turned
            low, high = np.quantile(y, 0.001, axis=0), np.quantile(y, 0.999, axis=0)
            side = max(float((high - low).max()), 1e-30) * 1.3
            self.maps.append(turned)
            self.low.append(low - side * rng.uniform(0, 0.3 / 1.3, turned.shape[1]))
            self.scale.append((1 << bits) / side)

    def keys(self, v: np.ndarray) -> Iterator[np.ndarray]:
        for m, low, scale in zip(self.maps, self.low, self.scale, strict=True):
            y = ((v - self.mean) @ m - low) * scale
            yield hilbert(np.clip(y, 0, (1 << self.bits) - 1).astype(np.int64), self.bits)


def _matrix(column) -> np.ndarray:
    """A column of equally long lists as float64 rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _nearest(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, at_once: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, candidate rows, distances) of each query's k nearest; ties to smaller ids. Distances are exact sums."""
    mid = v.mean(axis=0)
    cv = v - mid
    norms = (cv * cv).sum(axis=1)
    some = min(len(v), k + 16)
    for at in range(0, len(q), at_once):
        near = norms - 2 * ((q[at : at + at_once] - mid) @ cv.T)
        picked = np.argpartition(near, some - 1, axis=1)[:, :some] if some < len(v) else np.broadcast_to(np.arange(len(v)), near.shape)
        for i, rows in enumerate(picked):
            # whatever is as near as the last one picked, up to rounding, is compared too
            edge = near[i, rows].max()
            if some < len(v) and np.count_nonzero(near[i] <= edge + 1e-9 * (1 + abs(edge))) > some:
                rows = np.flatnonzero(near[i] <= edge + 1e-9 * (1 + abs(edge)))
            d = np.sqrt(((v[rows] - q[at + i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[rows], d))[:k]
            yield at + i, rows[best], d[best]


def _found(parts: list[tuple]) -> pa.RecordBatch:
    q, uid, i, d = (np.concatenate(x) if x else np.zeros(0) for x in zip(*parts, strict=True)) if parts else (np.zeros(0),) * 4
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(uid.astype(np.int64)), pa.array(i.astype(np.int64)), pa.array(d.astype(np.float64))], names=["q", "uid", "id", "score"])


def _exact(vectors: DataFrame, qs: np.ndarray, qv: np.ndarray, k: int) -> DataFrame:
    """The k nearest vectors of a bounded number of queries, by one pass over all vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, ids, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            if len(v):
                yield _found([(np.full(len(rows), qs[i]), uid[rows], ids[rows], d) for i, rows, d in _nearest(qv, v, ids, k)])

    return _merged(vectors.select("uid", "id", "v").mapInArrow(work, FOUND), k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("q").orderBy("score", "id")
    return found.dropDuplicates(["q", "uid"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(table: DataFrame, is_query: Column, k: int = 10, orderings: int = 16, recall: float = 0.98, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 4096, judged: int = 128) -> DataFrame:
    """query_id, rank (from 1), id_col and score (Euclidean distance) of each query's k nearest rows found.

    The curves are fitted on at most sample_rows vectors, the window on at most `judged` distinct queries; every
    row is indexed and every query is searched.
    """
    spark = table.sparkSession
    given = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = given.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    result = f"query_id long, rank int, {id_col} long, score double"
    if lengths is None:
        return spark.createDataFrame([], result)
    given = given.where(F.size("v") == lengths["n"]).withColumn("uid", F.xxhash64("id", "v"))
    once = given.groupBy("uid").agg(F.first("id").alias("id"), F.first("v").alias("v"), F.max("asks").alias("asks"))
    asking = written(once.where("asks").select("id", "v"))
    vectors = written(once.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1).select("uid", "id", "v"))
    queries = written(asking.select("v").distinct().withColumn("q", F.monotonically_increasing_id()))  # q stands for all queries with its vector
    sample = _matrix(pa.chunked_array([vectors.select("v").limit(sample_rows).toArrow()["v"].combine_chunks()]))
    curves = Curves(sample, orderings)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, v = batch.num_rows, _matrix(batch.column(2))
            for o, key in enumerate(curves.keys(v) if n else ()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, o, np.int32)), pa.array(key), batch.column(0), batch.column(1)], names=["o", "key", "uid", "asks"])

    both = vectors.select("uid", F.lit(False).alias("asks"), "v").unionByName(queries.select(F.col("q").alias("uid"), F.lit(True).alias("asks"), "v"))
    keyed = written(both.mapInArrow(number, "o int, key long, uid long, asks boolean"))
    in_order = keyed.repartitionByRange(fan_out(keyed, 4 << 20), "o", "key", "uid").sortWithinPartitions("o", "key", "uid")
    placed = written(in_order.select("o", "uid", "asks", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")))
    counts = placed.groupBy("o", "p").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    before = F.sum("n").over(Window.partitionBy("o").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("o", "p", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    # A row for each partition and ordering: bounded by the number of partitions.
    ranked = placed.join(F.broadcast(starts), ["o", "p"]).select("o", "uid", "asks", (F.col("i") + F.col("shift")).alias("r"))

    some = queries.orderBy(F.xxhash64("q"), "q").limit(judged).toArrow()
    if not some.num_rows:
        return spark.createDataFrame([], result)
    true = _exact(vectors, some["q"].to_numpy(), _matrix(some["v"]), k + 1).where("score > 0").select("q", F.col("uid").alias("c"))
    true = F.broadcast(written(true))  # at most judged * (k + 1) rows
    asked = F.broadcast(written(ranked.where("asks").join(F.broadcast(true.select("q").distinct()), F.col("uid") == F.col("q"), "left_semi").select("o", F.col("uid").alias("q"), F.col("r").alias("rq"))))
    numbers = [m for m in (1, 2, 4, 8, 16, 32, 64) if m < orderings] + [orderings]
    gap = F.abs(F.col("r") - F.col("rq"))
    gaps = ranked.where("not asks").join(true, F.col("uid") == F.col("c")).join(asked, ["o", "q"]).groupBy("q", "c").agg(*[F.min(F.when(F.col("o") < m, gap)).alias(f"g{m}") for m in numbers])
    widths = gaps.agg(*[F.percentile(f"g{m}", F.lit(recall)).alias(f"g{m}") for m in numbers]).first()
    n_rows = vectors.count()
    share = lambda w: min(w, n_rows) * (2 - min(w, n_rows) / n_rows)  # noqa: E731  ranks within w of a rank, on average
    pairs, used, window = min((m * share(w), m, w) for m in numbers for w in [int(widths[f"g{m}"] or 0) + 1])
    if 2 * pairs > n_rows:
        warnings.warn(f"little structure to search by: {used} of {orderings} orderings with windows of {window} ranks hold {pairs:.0f} rows for each query, the table {n_rows}", stacklevel=2)
    ranked = ranked.where(F.col("o") < used)
    size = max(64, min(block, window))

    homes = ranked.where("not asks").groupBy("uid").agg(F.collect_list(F.struct("o", F.floor(F.col("r") / size).alias("b"))).alias("at"))  # one for each ordering
    left = vectors.join(homes, "uid").select("uid", "id", "v", F.explode("at").alias("at")).select("at.o", "at.b", "uid", "id", "v")
    visits = ranked.where("asks").select("o", F.col("uid").alias("q"), F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("r") - window) / size), F.floor((F.col("r") + window) / size))).alias("b"))
    right = visits.groupBy("q").agg(F.collect_list(F.struct("o", "b")).alias("at")).join(queries, "q").select("q", "v", F.explode("at").alias("at")).select("at.o", "at.b", "q", "v")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = []
        if a.num_rows and b.num_rows:
            uid, ids, v, qs = a["uid"].to_numpy(), a["id"].to_numpy(), _matrix(a["v"]), b["q"].to_numpy()
            parts = [(np.full(len(rows), qs[i]), uid[rows], ids[rows], d) for i, rows, d in _nearest(_matrix(b["v"]), v, ids, k + 1)]
        return pa.Table.from_batches([_found(parts)])

    found = left.groupBy("o", "b").cogroup(right.groupBy("o", "b")).applyInArrow(compare, FOUND)
    nearest = written(_merged(found, k + 1).select("q", "id", "score"))
    own = asking.join(queries, "v").select(F.col("id").alias("query_id"), "q")
    told = own.join(nearest, "q").where("id <> query_id")
    return told.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "q").orderBy("score", "id"))).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
