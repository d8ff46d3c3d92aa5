"""Embedding providers: a protocol, and a deterministic local one that hashes tokens."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: What vectors are for, as providers name it.
DOCUMENT, QUERY = "RETRIEVAL_DOCUMENT", "RETRIEVAL_QUERY"


class EmbeddingProvider(Protocol):
    """Turns texts into vectors of `dimensions` numbers; must be picklable, since executors call it.

    One with a true attribute `by_task` embeds documents and queries differently: its embed takes the task as a second argument.
    """

    model: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Each token adds a sign to one of `dimensions` places, by its CRC; vectors have length one, or are zero."""

    def __init__(self, dimensions: int = 384):
        self.dimensions, self.model = dimensions, f"local-hashing-{dimensions}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        words = [text.lower().split() for text in texts]
        hashes = np.fromiter((zlib.crc32(token.encode()) for w in words for token in w), np.int64)
        row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        at, sign = row * self.dimensions + (hashes >> 1) % self.dimensions, np.where(hashes & 1, 1.0, -1.0)
        out = np.bincount(at, sign, len(texts) * self.dimensions).reshape(len(texts), self.dimensions)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm, norm, 1)).tolist()


def checked(provider: EmbeddingProvider, texts: list[str], task: str = DOCUMENT) -> list[list[float]]:
    """embed(), with its result held against the contract: one vector of numbers for each text, all of the told length."""
    vectors = provider.embed(texts, task) if getattr(provider, "by_task", False) else provider.embed(texts)
    if not isinstance(vectors, list) or len(vectors) != len(texts):
        raise ValueError(f"{provider.model}: {len(texts)} texts, {len(vectors) if isinstance(vectors, list) else 'no'} vectors")
    for v in vectors:
        if len(v) != provider.dimensions:
            raise ValueError(f"{provider.model}: a vector of {len(v)} numbers, not {provider.dimensions}")
    return vectors


def with_retries(call: Callable[[], list], transient: Callable[[Exception], bool], sleep: Callable[[float], None], tries: int = 5, first: float = 2.0, most: float = 30.0) -> list:
    """call(), again after 2, 4, 8 ... seconds (at most `most`) while its error is transient."""
    for n in range(tries):
        try:
            return call()
        except Exception as e:
            if n + 1 == tries or not transient(e):
                raise
            sleep(min(most, first * 2**n))
    raise ValueError("tries must be positive")


def passing(error: Exception) -> bool:
    """A provider's error that may pass: it says so itself, or is one of the network."""
    return bool(getattr(error, "transient", isinstance(error, (ConnectionError, TimeoutError))))


def embedded(df: DataFrame, provider: EmbeddingProvider, text_col: str = "text", out_col: str = "vector", batch: int = 100, task: str = DOCUMENT) -> DataFrame:
    """df with the vectors of its texts, embedded in batches on the executors; batches are tried again while errors are passing."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    target = StructType([*df.schema.fields, StructField(out_col, ArrayType(DoubleType()))])
    schema, at = to_arrow_schema(target), df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, vectors = [t or "" for t in rows.column(at).to_pylist()], []
            for k in range(0, len(texts), batch):
                vectors += with_retries(lambda some=texts[k : k + batch]: checked(provider, some, task), passing, time.sleep)
            yield pa.RecordBatch.from_arrays([*(rows.column(i).cast(schema.field(i).type) for i in range(rows.num_columns)), pa.array(vectors, schema.field(out_col).type)], schema=schema)

    return df.mapInArrow(work, target)
