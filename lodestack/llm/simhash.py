"""Operator 3, SimHash near-dedup: fingerprints, bit-sliced comparison, and the components of near fingerprints.

Fingerprints within `radius` bits are found exactly. The 64 bits are cut into b blocks; two fingerprints that differ in
at most `radius` bits agree in at least b - radius blocks, so each distinct fingerprint is filed once under each choice
of b - radius blocks, and b grows with the number of distinct fingerprints so that files stay small. Inside a file the
fingerprints lie in bit planes: word i of plane p holds bit p of 64 fingerprints. One fingerprint is compared to 64 at
a time: XOR with a plane gives a difference bit for each lane, carry-save counters add it up with AND and XOR, lanes
whose counter overflows are past the radius, and a block is abandoned once all its lanes are. A file with more than
`tile` fingerprints is cut into tiles and each pair of tiles becomes a group of its own, so no group is large. A group
tells a spanning forest of its links, not all pairs; `components` joins the forests.

Defined results: null and blank texts have fingerprint zero and link like any other; a text of fewer than three words
has its whole word sequence as its one shingle; repeated rows each get a row; a row without doc_id links
like any other and gets the component of its fingerprint; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, bounded_batches, fan_out, written
from .components import components

ALL = U64(0xFFFFFFFFFFFFFFFF)


def simhash(text: str | None, shingle: int = 3) -> int:
    """Bit b is set if it is set in over half of the XXH64 (seed 42) of the text's word shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    flat, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    pieces = [flat[a:b] for a, b in zip(starts, (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), U64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long."""
    return _fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("key"))).select("doc_id", "fp")


def _fingerprints(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text, key) -> (doc_id, key, fp)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py()) for t in batch.column(1)], U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "key", "fp"])

    return bounded_batches(docs).mapInArrow(work, "doc_id long, key long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """fps: (words, 64) fingerprints -> (64, words): lane j of word i of plane p is bit p of fps[i, j]."""
    out = np.empty((64, len(fps)), U64)
    for at in range(0, len(fps), 2048):
        part = np.ascontiguousarray(fps[at : at + 2048].astype("<u8"))
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 64, 8), axis=2, bitorder="little")  # word, lane, bit
        out[:, at : at + len(part)] = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little").view("<u8")[:, :, 0]
    return out


def near_pairs(fps: np.ndarray, group: np.ndarray, radius: int = 3, at_once: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a, b), b < a, of the same group (rows of a group are adjacent) within radius bits."""
    if not len(fps):
        return
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(fps)))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(sizes):
        return
    n_words = -(-sizes // 64)
    first_word = np.concatenate(([0], np.cumsum(n_words)[:-1]))
    of_word = np.repeat(np.arange(len(sizes)), n_words)
    lane0 = starts[of_word] + 64 * (np.arange(n_words.sum()) - first_word[of_word])
    rows = lane0[:, None] + np.arange(64)
    there = rows < (starts + sizes)[of_word][:, None]
    planes = bit_planes(fps[np.where(there, rows, 0)])
    absent = ~np.ascontiguousarray(np.packbits(there, axis=1, bitorder="little")).view("<u8")[:, 0]
    counters = max(1, radius.bit_length())
    member = np.repeat(np.arange(len(sizes)), sizes)
    query = np.arange(len(member)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[member]
    pairs = np.concatenate(([0], np.cumsum(n_words[member])))
    lo = 0
    while lo < len(member):
        hi = max(lo + 1, int(np.searchsorted(pairs, pairs[lo] + at_once, "right")) - 1)
        per = n_words[member[lo:hi]]
        q = np.repeat(query[lo:hi], per)
        w = np.arange(pairs[hi] - pairs[lo]) - np.repeat(pairs[lo:hi] - pairs[lo], per) + np.repeat(first_word[member[lo:hi]], per)
        lo = hi
        keep = lane0[w] < q  # only lanes before the query
        q, w = q[keep], w[keep]
        value, count, over = fps[q], [np.zeros(len(q), U64) for _ in range(counters)], absent[w].copy()
        for p in range(64):
            carry = planes[p][w] ^ (U64(0) - ((value >> U64(p)) & U64(1)))
            for i in range(counters):
                count[i], carry = count[i] ^ carry, count[i] & carry
            over |= carry
            if p % 8 == 7 and len(q):
                alive = over != ALL
                if 4 * np.count_nonzero(alive) < 3 * len(q):  # abandon blocks whose lanes are all past the radius
                    q, w, value, over, count = q[alive], w[alive], value[alive], over[alive], [c[alive] for c in count]
        hit = np.flatnonzero(over != ALL)
        i, lane = np.nonzero(np.unpackbits((~over[hit]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a, b = q[hit[i]], lane0[w[hit[i]]] + lane
        ok = (b < a) & (np.bitwise_count(fps[a] ^ fps[b]) <= radius)
        yield a[ok], b[ok]


def _forest(fps: np.ndarray, group: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smaller node) that connect what near_pairs connects."""
    names, of = np.unique(node, return_inverse=True)
    root = np.arange(len(names))
    for a, b in near_pairs(fps, group, radius):
        a, b = of[a], of[b]
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def n_blocks(n: int, radius: int) -> int:
    """Blocks to cut 64 bits into so that n evenly spread fingerprints lie in files of about 64 or fewer."""
    b = radius + 1
    while n >> (64 * (b - radius) // b) > 64 and b < radius + 5:
        b += 1
    return b


def _masks(b: int, radius: int) -> list[int]:
    cuts = [64 * i // b for i in range(b + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(b)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(blocks, b - radius)]


def links(distinct: DataFrame, radius: int = 3, tile: int = 1024) -> DataFrame:
    """distinct: (fp, first), one row for each fingerprint -> edges (u, v) between the firsts that connect near ones."""
    masks = _masks(n_blocks(distinct.count(), radius), radius)
    filed = distinct.select("fp", "first", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("f")).select("fp", "first", "f.t", "f.key")
    large = filed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("t", "key", F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("tiles"))
    dealt = filed.join(large, ["t", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = dealt.withColumn("own", own).select("fp", "first", "t", "key", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).select("fp", "first", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        c = {n: t[n].to_numpy() for n in t.column_names}
        order = np.lexsort((c["first"], c["j"], c["i"], c["key"], c["t"]))
        g = {n: c[n][order] for n in c}
        new = np.zeros(len(order), np.int64)
        for n in ("t", "key", "i", "j"):
            new[1:] |= g[n][1:] != g[n][:-1]
        u, v = _forest(g["fp"].view(U64), np.cumsum(new), g["first"], radius)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return tiled.repartition(fan_out(distinct, 1 << 20), "t", "key", "i", "j").mapInArrow(work, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", tile: int = 1024) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that a chain of links reaches, null where no row has one.

    Fingerprints are what is linked, so those of rows without doc_id link others too.
    """
    fps = written(fingerprints(docs, id_col, text_col))
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp", F.col("fp").alias("first")), radius, tile))
    rooted = written(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    labels = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """Of each component the row with the smallest (doc_id, fingerprint, text), rows without doc_id last.

    Rows alike in doc_id and text are one document: all of them stay, or one of them if not `repeats`. Of rows without doc_id,
    one stays. Nodes are fingerprints here, so that those of rows without doc_id link too, and rows that share an id are told
    apart. Other columns are carried along, whatever their names.
    """
    text = F.col(f"`{text_col}`").cast("string")
    fps = written(_fingerprints(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "key")).alias("first")
    distinct = written(fps.groupBy("fp").agg(first))
    roots = components(links(distinct.select("fp", F.col("fp").alias("first")), radius))
    labels = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("component"), "first")
    stay = written(labels.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.key").alias("__key")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")
    keyed = docs.select(row, F.col(f"`{id_col}`").cast("long").alias("__id"), F.xxhash64(text).alias("__key"))
    kept = keyed.join(stay.where("__id is not null"), ["__id", "__key"], "left_semi")
    single = keyed.where("__id is null").join(stay.where("__id is null").select("__key"), "__key", "left_semi")
    if not repeats:
        # Only rows that come again are grouped; the others need no shuffle of their texts.
        again = written(fps.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).count().where("count > 1").drop("count"))
        several = kept.join(again, ["__id", "__key"], "left_semi").groupBy("__id", "__key").agg(F.first("r").alias("r"))
        kept = kept.join(again, ["__id", "__key"], "left_anti").select("r").unionByName(several.select("r"))
    return kept.select("r.*").unionByName(single.groupBy("__key").agg(F.first("r").alias("r")).select("r.*"))
