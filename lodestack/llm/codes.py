"""Operator 11, vector code compression: a product quantiser trained with exact integers.

Vectors become integers and are cut into equal consecutive parts. `train` writes them once as blocks: of each part and
each position in it one NumPy column of at most BLOCK values. A round of Lloyd's algorithm is one RDD treeAggregate over the
blocks: distances to all entries of a codebook accumulate position by position, np.add.at adds each part to the
sum and count of its nearest entry in int64 tensors, and the tensors (parts x entries x width, whatever the number of
vectors) merge through a reduction tree. `encode` then gives each vector its codes.

Sums are exact, so neither the order of rows nor a repeated task changes a result. int64 sums hold as long as an entry's
vectors times their largest component stay below 2**63.

Defined results: vectors that are null, empty, or that hold null, non-finite or components of 2**27 or more once scaled take no
part; nor do those of another length than the smallest id's among the vectors whose length the parts divide. Repeated rows are
vectors of their own; of rows that share an id the smaller vector comes first into the codebooks. A null id comes after all others and
is carried along. Fewer vectors than entries give fewer entries. An empty table gives no rows. Other columns are ignored,
whatever their names.
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

BLOCK, TILE = 4096, 256


def squared(columns: np.ndarray, entries: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """columns (width, n), entries (width, m) -> (rows, distances (rows, m)) tile by tile, exact."""
    largest = 2 * max(int(np.abs(columns).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.int32 if largest * largest * len(columns) < 1 << 31 else np.int64
    columns, entries = columns.astype(kind), entries.astype(kind)
    n, m = columns.shape[1], entries.shape[1]
    for at in range(0, n, TILE):
        rows = slice(at, min(n, at + TILE))
        total, step = np.zeros((rows.stop - at, m), kind), np.empty((rows.stop - at, m), kind)
        for x, c in zip(columns[:, rows], entries, strict=True):
            np.subtract(x[:, None], c[None, :], out=step)
            np.multiply(step, step, out=step)
            total += step
        yield rows, total


def nearest(columns: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower) and squared distance of each column of a part."""
    best, far = np.empty(columns.shape[1], np.int64), np.empty(columns.shape[1], np.int64)
    for rows, d in squared(columns, entries):
        best[rows] = d.argmin(axis=1)
        far[rows] = d[np.arange(len(d)), best[rows]]
    return best, far


def parted(v: np.ndarray, parts: int) -> np.ndarray:
    """(n, length) -> (parts, width, n), each position of a part a column of its own."""
    return np.ascontiguousarray(v.T).reshape(parts, -1, len(v))


def _blocks(vectors: DataFrame, parts: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(0))
            for at in range(0, batch.num_rows, BLOCK):
                data = parted(v[at : at + BLOCK], parts).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([data.tobytes()], pa.binary()), pa.array([data.shape[2]], pa.int32())], names=["data", "n"])

    return written(vectors.select("v").mapInArrow(work, "data binary, n int"))


def _merge(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, depth: int = 2) -> np.ndarray:
    """vectors (id, v array<int>, all of one length) -> codebooks (parts, width, entries), int64."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"]
    if not len(first):
        return np.zeros((parts, 0, 0), np.int64)
    books = parted(matrix(first.combine_chunks()), parts)
    width, m = books.shape[1:]
    blocks, sc = _blocks(vectors, parts).rdd, vectors.sparkSession.sparkContext
    for _ in range(rounds):
        told = sc.broadcast(books)  # parts * width * entries integers, whatever the table's size

        def add(total: tuple | None, row, told=told) -> tuple:
            sums, counts = total or (np.zeros((parts, m, width), np.int64), np.zeros((parts, m), np.int64))
            for p, columns in enumerate(np.frombuffer(row.data, "<i4").reshape(parts, width, row.n)):
                codes, _ = nearest(columns, told.value[p])
                np.add.at(sums[p], codes, columns.T.astype(np.int64))
                np.add.at(counts[p], codes, 1)
            return sums, counts

        sums, counts = blocks.treeAggregate(None, add, _merge, depth)
        moved = np.floor_divide(sums, np.maximum(counts, 1)[:, :, None]).transpose(0, 2, 1)  # rounds down, also below zero
        books = np.where((counts > 0)[:, None, :], moved, books)
        told.unpersist()
    return books


def encode(vectors: DataFrame, books: np.ndarray, label_type: str = "int") -> DataFrame:
    """(id, label, codes array<int>, error): the index of each part's nearest entry, and the squared distances summed."""
    schema = f"id long, label {label_type}, codes array<int>, error long"
    if not books.size:
        return vectors.sparkSession.createDataFrame([], schema)
    told, parts = vectors.sparkSession.sparkContext.broadcast(books), len(books)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [nearest(c, b) for c, b in zip(parted(matrix(batch.column(2)), parts), told.value, strict=True)]
            codes = np.stack([x[0] for x in found], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(sum(x[1] for x in found))], names=["id", "label", "codes", "error"])

    return vectors.select("id", "label", "v").mapInArrow(work, schema)


def compress(table: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> tuple[DataFrame, np.ndarray]:
    """(encode's rows, codebooks) of a table of vectors."""
    if not 0 < entries <= 256:
        raise ValueError("an index must fit into a byte")
    vectors = kept(table, id_col, vector_col, scale, label_col).where(F.size("v") % parts == 0)
    length = vectors.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).first()
    vectors = vectors.where(F.size("v") == (length[0] if length else 0))
    books = train(vectors, parts, entries, rounds)
    return encode(vectors, books, vectors.schema["label"].dataType.simpleString()), books


def digests(table: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept row."""
    rows, books = compress(table, **options)
    rows = written(rows)
    entries = books.transpose(0, 2, 1).ravel()
    sha = hashlib.sha256(",".join(map(str, entries.tolist())).encode()).hexdigest()
    # Spark sums before it shuffles, and splits a label with very many rows when it joins the sums back.
    of_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    code = F.lower(F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0"))))
    return rows.join(of_label, F.col("label").eqNullSafe(F.col("same"))).select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
