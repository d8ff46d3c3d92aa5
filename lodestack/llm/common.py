"""What the training-data operators share: word splitting, written intermediate tables, and fan-out by size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import own_dir, written

__all__ = ["own_dir", "written"]

#: A word is `[^\x20\x09-\x0D]+`; these six characters separate words.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = "[\\x20\\x09-\\x0D]+"
#: bytes.translate table that lower-cases A-Z and leaves every other byte of UTF-8 as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fan_out(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Partitions to deal df's data into: as many as the session's shuffle partitions, more where the input's size asks for it.

    The size is that of the tables that df reads, as Spark estimates it; leaves of unknown size do not count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    size = sum(s for s in sizes if s < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // bytes_each, 1 << 17))


def bounded_batches(df: DataFrame, rows: int = 1000, size: int = 16 << 20) -> DataFrame:
    """df, with Arrow batches of at most `rows` rows and about `size` bytes from now on in its session: long texts make large batches.

    Spark reads both settings when a plan runs, so they cannot be set for one plan alone; they are lowered, never raised.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < int(conf.get(key).rstrip("b")) <= most:
            conf.set(key, most)
    return df


def words_of(text):
    """Column of the words of a text column; null and blank texts have none. Built-in functions only."""
    cut = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, WS_RUN))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (the public SplitMix64 one), so that sums and products of hashes spread evenly."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """word (bytes) -> its 64-bit hash, kept for words seen so far; cleared when it holds too many, so memory is bounded."""

    MOST = 150_000

    def __init__(self):
        import xxhash

        super().__init__()
        self._hash = xxhash.xxh64_intdigest

    def __missing__(self, word):
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = self._hash(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))
