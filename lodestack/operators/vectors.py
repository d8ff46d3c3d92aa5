"""The vector table: exact top-k for one and for many queries, upserts and deletes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embedding import EmbeddingProvider, embedded
from ..functions.identifiers import vector_id
from ..functions.vectors import cosine_to, similarity
from ..schema import Scope

#: Queries that a task compares at a time, and those that share a copy of the vectors.
BLOCK, COLUMN = 1024, 8192


def scan(vectors: DataFrame, scope: Scope, document_id: str | None = None, limit: int = 10_000) -> DataFrame:
    rows = vectors.where(scope.of_vectors())
    return (rows.where(F.col("document_id") == document_id) if document_id else rows).orderBy("vector_id").limit(max(1, limit))


def top_k(vectors: DataFrame, query: list[float], k: int, scope: Column | None = None, least: float = 0.0, id_col: str = "vector_id", vector_col: str = "vector") -> DataFrame:
    """The k most similar rows of the scope with similarity (clamped to [0, 1]), distance and rank.

    The similarity is a sum of products with literals in generated code; each task keeps k rows, and one task merges
    them.
    """
    rows = vectors if scope is None else vectors.where(scope)
    raw = rows.withColumn("__raw", cosine_to(F.col(vector_col), query)).where(similarity(F.col("__raw")) >= least)
    best = raw.orderBy(F.desc("__raw"), F.col(id_col)).limit(k)
    sim = similarity(F.col("__raw"))
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("__raw"), F.col(id_col))))  # k rows
    return ranked.withColumn("similarity", sim).withColumn("distance", 1 - sim).drop("__raw")


def quantised(vector: Column) -> Column:
    """A vector as bytes, its largest component 127: an array<byte> with nearly the same direction, a quarter of the size."""
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return F.transform(vector, lambda x: F.round(F.coalesce(F.try_divide(x.cast("double") * 127, largest), F.lit(0.0))).cast("byte"))


def top_k_overfetched(vectors: DataFrame, query: list[float], k: int, scope: Column | None = None, least: float = 0.0, over: int = 4, id_col: str = "vector_id", vector_col: str = "vector", code_col: str = "code") -> DataFrame:
    """top_k by a scan of the quantised column, which fetches `over` times k rows, and an exact ranking of these alone.

    The scan reads ids and codes; whole vectors are read of the fetched ids, which are sent to all tasks (k * over of them).
    """
    near = top_k(vectors, query, max(k, k * over), scope, 0.0, id_col, code_col).select(id_col)
    return top_k(vectors.join(F.broadcast(near), id_col, "left_semi"), query, k, scope, least, id_col, vector_col)


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    """A column of lists as rows of length one; zero rows stay zero, and so do lists that are null, of another length, or hold nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dims))
    there = np.flatnonzero(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1) == dims)
    if len(there) and dims:
        out[there] = column.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    out[~np.isfinite(out).all(axis=1)] = 0
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n, n, 1)


class _Best:
    """The k best (similarity, id) of each of a number of queries so far; equal similarities by the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: pa.Array, k: int, exclude_own: bool):
        self.ids, self.k, self.exclude = ids, k, exclude_own
        lengths = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(int)
        self.groups = [(d, rows := np.flatnonzero(lengths == d), _rows(vectors.take(pa.array(rows)), d)) for d in np.unique(lengths).tolist()]
        self.s, self.i = np.full((len(ids), 0), -2.0), np.full((len(ids), 0), -1)

    def add(self, own: np.ndarray, vectors: pa.Array, at_once: int = 2048) -> None:
        for at in range(0, len(own), at_once):
            names, some = own[at : at + at_once], vectors.slice(at, at_once)
            s = np.zeros((len(self.ids), len(names)))
            for d, rows, unit in self.groups:
                s[rows] = unit @ _rows(some, d).T
            if self.exclude:
                s[names[None, :] == self.ids[:, None]] = -2.0
            s, i = np.hstack((self.s, s)), np.hstack((self.i, np.broadcast_to(names, s.shape)))
            order = np.lexsort((i, -s.round(12)), axis=1)[:, : self.k]
            self.s, self.i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def told(self) -> pa.RecordBatch:
        keep = self.s.ravel() > -1.5
        q = np.repeat(self.ids, self.s.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(q[keep], pa.int64()), pa.array(self.i.ravel()[keep].astype(np.int64)), pa.array(self.s.ravel()[keep])], names=["query_id", "id", "raw"])


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vector_id", vector_col: str = "vector", query_id_col: str = "query_id", exclude_own: bool = False, block: int = BLOCK, cell_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, id, similarity) of each query's k most similar rows: exact, all rows against a stated set of queries.

    Up to `block` queries are sent to every task, and one pass over the vectors keeps k rows a query and task. More queries make a
    grid: its columns are some COLUMN queries and its rows parts of the vectors, both dealt by hash, so that a cell holds at most about
    COLUMN queries and cell_bytes of vectors, and compares `block` queries at a time. Vectors are shuffled once a column, queries once a row of the
    grid, k rows a query and cell after it; nothing but two counts passes through the driver. Queries without an id, and rows that are null, take no part.
    """
    asked = queries.select(F.col(query_id_col).cast("long").alias("q"), F.col(vector_col).alias("v")).where("q is not null")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    schema = "query_id long, id long, raw double"
    n = asked.count()
    if n <= block:
        told = asked.toArrow()
        ids, v = told["q"].to_numpy(), told["v"].combine_chunks()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(ids, v, k, exclude_own)
            for batch in batches:
                best.add(batch.column(0).to_numpy(), batch.column(1))
            yield best.told()

        found = rows.mapInArrow(work, schema)
    else:
        size = rows.agg(F.sum(F.size("v"))).first()[0] or 0
        columns = -(-n // max(block, COLUMN))
        # At least as many cells as tasks can run: more rows of the grid cost copies of queries, not of vectors.
        parts = max(-(-8 * size // cell_bytes), -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // columns))
        cells = lambda c, name: F.explode(F.sequence(F.lit(0), F.lit(c - 1))).alias(name)
        left = rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int").alias("i"), cells(columns, "j"))
        right = asked.select("q", "v", cells(parts, "i"), F.pmod(F.xxhash64("q", "v"), F.lit(columns)).cast("int").alias("j"))

        def cell(a: pa.Table, b: pa.Table) -> pa.Table:
            own, v, told = a["id"].to_numpy(), a["v"].combine_chunks(), []
            for at in range(0, max(1, b.num_rows), block):
                some = b.slice(at, block)
                best = _Best(some["q"].to_numpy(), some["v"].combine_chunks(), k, exclude_own)
                if some.num_rows:
                    best.add(own, v)
                told.append(best.told())
            return pa.Table.from_batches(told)

        found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("raw", 12).desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), similarity(F.col("raw")).alias("similarity"))


def records(chunks: DataFrame, scope: Scope) -> DataFrame:
    """Vector rows without vectors: embeddable chunks with text, their ids and metadata as sorted JSON."""
    put = chunks.where("is_embeddable and trim(text) <> ''").withColumns({"tenant_id": F.lit(scope.tenant_id), "app_id": F.lit(scope.app_id), "collection_id": F.lit(scope.collection_id or "")})
    # What a chunk's own metadata says comes over what is told of every chunk.
    names = ("boundary_type", "boundary_value", "chunk_role", "parent_chunk_id", "section_index", "strategy", "token_count")
    told = F.to_json(F.struct(*names))
    if "metadata" in chunks.columns:
        own_entries = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
        told = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.map_filter(F.from_json(told, "map<string,string>"), lambda key, _: ~F.map_contains_key(own_entries, key)), own_entries)))))
    own = vector_id(F.col("tenant_id"), F.col("app_id"), F.col("collection_id"), F.col("document_id"), F.col("chunk_id"))
    return put.select(own.alias("vector_id"), "text", "tenant_id", "app_id", "collection_id", "document_id", "chunk_id", F.col("chunk_index").cast("int").alias("chunk_index"), told.alias("metadata"))


def embed_records(rows: DataFrame, provider: EmbeddingProvider, profile_id: str | None = None) -> DataFrame:
    done = embedded(rows, provider, "text", "vector")
    return done.withColumns({"vector": F.col("vector").cast("array<float>"), "vector_dimension": F.size("vector"), "embedding_profile_id": F.lit(profile_id).cast("string"), "embedding_model": F.lit(provider.model)})


def upsert(table: DataFrame, rows: DataFrame, key: str = "vector_id", order: Column | None = None) -> DataFrame:
    """table with rows in place of those of the same key; of rows with one key the last in `order` counts."""
    put = rows
    if order is not None:
        put = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("__n = 1").drop("__n")
    return table.join(put.select(key), key, "left_anti").select(*table.columns).unionByName(put.select(*table.columns))


def delete_document(vectors: DataFrame, scope: Scope, document_id: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, a row with the exact number of those that go)."""
    gone = scope.of_vectors() & (F.col("document_id") == document_id)
    return vectors.where(~F.coalesce(gone, F.lit(False))), vectors.where(gone).agg(F.count("*").alias("deleted"))
