"""Operator 5, byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A text is cut into pieces by the vocabulary's pattern. In a piece, leaf i of a segment tree holds (rank of the pair that
starts at symbol i, i), and every inner node the smaller of its children, so the root is the leftmost pair of lowest
rank. A merge changes three leaves (the merged pair, its left neighbour and the symbol that is gone) and the nodes
above them; it goes on until the root is empty. Pieces seen for the first time in a batch are merged together: pieces of
a size class lie in one array with a row each, and each step merges the root pair of every row. Few or very long pieces
go through the same tree one by one. Results are kept for a bounded number of pieces.

Decoding joins the tokens' bytes and reads them as UTF-8, with U+FFFD for bytes that are none.

Defined results: a null text is an empty one and has no tokens; the special token's string in a text gives its id, as the
tokenizers library has it; null ids decode to an empty text; unknown ids raise.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

NONE = np.iinfo(np.int64).max
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose results a worker keeps, and characters that it works on together.
KEPT, AT_ONCE = 220_000, 1_500_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next above 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Merges:
    """(left id, right id) -> rank, and rank -> the merged id, as arrays and as a dict."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int]):
        left, right = np.array(pairs, np.int64).reshape(-1, 2).T
        key = left << 32 | right
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), np.array(made, np.int64)
        self.of = dict(zip(pairs, range(len(pairs)), strict=True))
        self.made_list = made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where a pair does not merge or where right is negative."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], NONE)


def merge_one(symbols: list[int], merges: Merges) -> list[int]:
    """The tokens of one piece: scalar segment tree, for any length."""
    n = len(symbols)
    size = 1 << max(1, (n - 1).bit_length())
    ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    empty = (NONE, 0)
    rank = lambda i: (r, i) if 0 <= i and (j := after[i]) < n and (r := merges.of.get((ids[i], ids[j]))) is not None else empty
    tree = [empty] * size + [rank(i) for i in range(n)] + [empty] * (size - n)
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(i: int, value: tuple[int, int]) -> None:
        node = size + i
        tree[node] = value
        while node > 1:
            node >>= 1
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                break
            tree[node] = low

    while tree[1] != empty:
        r, i = tree[1]
        gone = after[i]
        ids[i], ids[gone] = merges.made_list[r], -1
        after[i] = after[gone]
        if after[gone] < n:
            before[after[gone]] = i
        update(gone, empty)
        update(i, rank(i))
        if before[i] >= 0:
            update(before[i], rank(before[i]))
    return [x for x in ids if x >= 0]


def merge_many(symbols: np.ndarray, merges: Merges) -> np.ndarray:
    """symbols: (pieces, size), size a power of two, -1 behind the end -> tokens, -1 where a symbol was merged away."""
    n, size = symbols.shape
    ids = np.hstack((symbols, np.full((n, 1), -1)))  # slot `size` is the end
    slots = np.arange(size)
    after = np.where(np.hstack((symbols[:, 1:], np.full((n, 1), -1))) >= 0, slots + 1, size)
    before = np.hstack((np.broadcast_to(slots - 1, (n, size)), np.zeros((n, 1), np.int64)))
    tree = np.full((n, 2 * size), NONE)
    rank = merges.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, size - 1)
    tree[:, size:-1] = np.where(rank < NONE, rank * size + slots[:-1], NONE)
    level = size
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        root = tree[rows, 1]
        i = root % size
        gone = after[rows, i]
        then = after[rows, gone]
        ids[rows, i], ids[rows, gone] = merges.made[root // size], -1
        after[rows, i] = then
        before[rows, then] = i  # slot `size` takes what has no place
        left = before[rows, i]
        there = left >= 0
        tree[rows, size + gone] = NONE
        r = merges.rank(ids[rows, i], ids[rows, then])
        tree[rows, size + i] = np.where(r < NONE, r * size + i, NONE)
        at, left = rows[there], left[there]
        r = merges.rank(ids[at, left], ids[at, i[there]])
        tree[at, size + left] = np.where(r < NONE, r * size + left, NONE)
        row, node = np.concatenate((rows, rows, at)), np.concatenate((gone, i, left)) + size
        for _ in range(size.bit_length() - 1):
            node >>= 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        rows = rows[tree[rows, 1] < NONE]
    return ids[:, :size]


class BpeTokenizer:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str, kept: int = KEPT):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, names = spec["model"]["vocab"], byte_symbols()
        back = {c: b for b, c in enumerate(names)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.first = np.array([vocab[c] for c in names], np.int64)
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.pieces = regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.own = list(range(len(self.token_bytes)))  # one int object for each token, shared by all pieces
        self.most = kept
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[tuple[int, ...]] = []
        for token, i in self.special.items():
            self.known["\0" + token], _ = len(self.ids), self.ids.append((i,))

    def learn(self, pieces: Iterable[str]) -> None:
        """Tokens of pieces not known yet, merged together by size class."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")
            classes.setdefault(max(1, (len(b) - 1).bit_length()), []).append((p, b))
        for k, found in classes.items():
            size = 1 << k
            for at in range(0, len(found), step := max(1, (1 << 20) >> k)):
                some = found[at : at + step]
                if len(some) < 16 or size > 1 << 12:
                    self.keep((p, merge_one(self.first[list(b)].tolist(), self.merges)) for p, b in some)
                    continue
                sizes = np.fromiter((len(b) for _, b in some), np.int64, len(some))
                symbols = np.full((len(some), size), -1, np.int64)
                symbols[np.arange(size) < sizes[:, None]] = self.first[np.frombuffer(b"".join(b for _, b in some), np.uint8)]
                done = merge_many(symbols, self.merges)
                flat, ends = done[done >= 0].tolist(), np.cumsum((done >= 0).sum(axis=1)).tolist()
                self.keep((p, flat[a:b]) for (p, _), a, b in zip(some, [0, *ends], ends, strict=False))

    def keep(self, found: Iterable[tuple[str, list[int]]]) -> None:
        for p, ids in found:
            self.known[p] = len(self.ids)
            self.ids.append(tuple(map(self.own.__getitem__, ids)))

    def cut(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is a special token, part) in order. Long parts are cut before single spaces, where a piece always begins."""
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                yield True, part
                continue
            while len(part) > AT_ONCE:
                at = part.find(" ", AT_ONCE // 2)
                while 0 < at < len(part) - 1 and (part[at - 1].isspace() or part[at + 1].isspace()):
                    at = part.find(" ", at + 1)
                if not 0 < at < len(part) - 1:
                    break
                yield False, part[:at]
                part = part[at:]
            if part:
                yield False, part

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Token ids of each text, in order."""
        waiting: list[tuple[bool, list[str]]] = []  # (ends a text, pieces)
        chars = 0
        carried: list[int] = []

        def flush() -> Iterator[list[int]]:
            nonlocal carried
            if len(self.known) > self.most:
                self.forget()
            self.learn(sorted(set().union(*(p for _, p in waiting)) - self.known.keys()))
            for ends, pieces in waiting:
                for k in map(self.known.__getitem__, pieces):
                    carried.extend(self.ids[k])
                if ends:
                    yield carried
                    carried = []
            waiting.clear()

        for text in texts:
            for special, part in self.cut(text or ""):
                waiting.append((False, ["\0" + part] if special else self.pieces(part)))
                chars += len(part)
                if chars >= AT_ONCE:
                    yield from flush()
                    chars = 0
            waiting.append((True, []))
        yield from flush()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> BpeTokenizer:
    """One for each worker process and vocabulary."""
    return BpeTokenizer(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids) for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            flat, sizes = [], []
            for ids in own.encode(t.as_py() for t in batch.column(1)):
                flat.append(np.array(ids, np.int32))
                sizes.append(len(ids))
            offsets = pa.array([*accumulate(sizes, initial=0)], pa.int32())
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, values)], names=[id_col, "n_tokens", "ids"])

    plain = bounded_batches(docs).select(F.col(id_col), F.col(text_col).cast("string"))
    return plain.mapInArrow(work, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) for each row of token ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x.as_py() or ()) for x in batch.column(1)], pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(work, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them; encoded and decoded in one pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        names = [str(i) for i in range(len(own.token_bytes))]
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in own.encode(t.as_py() for t in batch.column(1)):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
