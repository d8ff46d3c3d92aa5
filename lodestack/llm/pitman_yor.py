"""Operator 2, language-model scoring with a hierarchical Pitman-Yor model of words given the word before.

Each context word has a restaurant; its customers are the words that follow it in training texts, and each of its tables
sends one customer to the parent that all contexts share, the root restaurant of single words, whose own parent is
uniform over the known words and one unknown. Seatings are sampled by Gibbs: given a Gamma(strength / discount + tables)
variable of its restaurant, the numbers of tables of different words are independent, and each is drawn from its exact
conditional distribution (seating.py), whatever the number of customers. Predictive probabilities are averaged
over samples of the contexts' and of the root's seating, and a text's score is the sum of their log10. Discounts are estimated
from the counts of counts and kept between 0.3 and 0.95; strengths are 1.

Nothing of vocabulary size is gathered in one place. Texts become (context, word, document, count) entries, packed as
arrays, and go to the part of their context; restaurants of very common contexts (found on a bounded sample, at most 1 /
HOT of them; this only lays out the work) are spread over parts by word. In each round every part tells the owners
of its words how many tables they have, owners go on seating the root restaurant and answer with several samples of it, and the
part goes on sampling. Each part then scores the entries of its contexts, and sums per document meet in a last, small shuffle.

Beside the discounts, the approximations are those of sampling in parts: during a round a part knows the root's seating and
the other parts' tables of spread restaurants as of the round before, and an owner knows the root's other tables so (in the
first round it takes its words to be like the others). Contexts are one word long. Words and pairs are told apart by 64-bit
hashes.

Defined results: a null text is an empty one (its end token counts); rows that share an id are documents of their own;
a row without id is in the fold of the empty string; no training documents leave every word unknown; an empty table
gives no rows; other columns are ignored; a text of any length is scored whole. Samples are seeded by part, and there are as many parts as the
size of the tables asks for, so reruns over the same files agree, whatever the number of shuffle partitions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, WordHashes, bounded_batches, mixed, words_of, written
from .seating import draw, reseat

__all__ = ["held_out", "reseat", "score"]

START, END = 0x5EED5EED00000001, 0x5EED5EED00000002
HOT = 0.001
TOKENS, DOCS = 2_000_000, 400_000
ENTRIES, NAMES, ASK, REPLY, STATE, SUMS = range(6)
DEALT = "part long, kind int, data binary"
ARROW = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def held_out(doc_id: Column) -> Column:
    """One fold in five: crc32 of the id as text leaves the remainder 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def pack(*arrays) -> bytes:
    """Arrays and numbers as bytes: the type and length of each, then its values, compressed."""
    import zstandard

    out = []
    for a in arrays:
        a = np.ascontiguousarray(_small(np.atleast_1d(a)))
        out += [struct.pack("<3sQ", a.dtype.str[1:].encode(), len(a)), a.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<3sQ", data, at)
        dtype = np.dtype("<" + kind.rstrip(b"\0").decode())
        out.append(np.frombuffer(data, dtype, n, at + 11))
        at += 11 + n * dtype.itemsize
    return out


def _small(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    if a.dtype.kind == "i" and len(a) and a.min() >= 0:
        return a.astype(np.min_scalar_type(int(a.max())))
    return a


def _rows(found: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([x[i] for x in found], t.type) for i, t in enumerate(ARROW)], schema=ARROW)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U64(13)) % U64(parts)).astype(np.int64)


def entry_blobs(first: int, docs: list[tuple], parts: int, hot: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """docs: (id, is training, word hashes) -> packed entries for each part, and the documents' names for one."""
    docs = sorted(docs, key=lambda d: not d[1])
    n_train, sizes = sum(d[1] for d in docs), np.array([len(d[2]) + 1 for d in docs])
    ends = np.cumsum(sizes)
    w = np.empty(ends[-1], U64)
    for (_, _, h), end in zip(docs, ends.tolist(), strict=True):
        w[end - 1 - len(h) : end - 1] = h
        w[end - 1] = END
    names, at = np.unique(np.append(w, U64(START)), return_inverse=True)
    wi = at[:-1].astype(U64)
    ui = np.empty_like(wi)
    ui[1:] = wi[:-1]
    ui[np.append(0, ends[:-1])] = at[-1]
    doc = np.repeat(np.arange(len(docs), dtype=U64), sizes)
    if len(names) < 1 << 22 and len(docs) < 1 << 20:
        key = ui << U64(42) | wi << U64(20) | doc
        key.sort()
        ui, wi, doc = key >> U64(42), key >> U64(20) & U64((1 << 22) - 1), key & U64((1 << 20) - 1)
        del key
    else:  # a very long text
        order = np.lexsort((doc, wi, ui))
        ui, wi, doc = ui[order], wi[order], doc[order]
    at = np.flatnonzero(np.append(True, (ui[1:] != ui[:-1]) | (wi[1:] != wi[:-1]) | (doc[1:] != doc[:-1])))
    count = np.diff(np.append(at, len(ui)))
    ui, wi, doc = (x[at].astype(np.int64) for x in (ui, wi, doc))
    part = _part(names, parts)[ui]
    spread = np.isin(names, hot)[ui]
    part[spread] = _part(mixed(names[ui[spread]] * U64(3) + names[wi[spread]]), parts)
    order = np.argsort(part.astype(np.int32), kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        rows = order[cuts[p] : cuts[p + 1]]
        if len(rows):
            u = ui[rows]
            new = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
            ws, local = np.unique(wi[rows], return_inverse=True)
            yield p, ENTRIES, pack(first, len(docs), n_train, names[u[new]], np.diff(np.append(new, len(u))), names[ws], local, doc[rows], count[rows])
    yield int(mixed(np.array([first], U64))[0] % U64(parts)), NAMES, pack(first, np.array([d[0] or 0 for d in docs], np.int64), np.array([d[0] is None for d in docs]), n_train, sizes)


class Part:
    """The pairs of one part: c customers and t tables of word wi in restaurant ui, and where documents hold them."""

    def __init__(self, part: int, blobs: list[bytes], hot: np.ndarray, parts: int):
        self.part, self.parts = part, parts
        self.found, us, ws, pairs, trained = [], [], [], [], []
        for data in blobs:
            first, n_docs, n_train, u, runs, w, local, doc, count = unpack(data)
            self.found.append((int(first[0]), int(n_docs[0]), doc, count))
            us.append(np.repeat(u, runs))
            ws.append(w[local])
            pairs.append(mixed(us[-1] * U64(0x9E3779B97F4A7C15) + ws[-1]))
            trained.append(np.where(doc < n_train, count, 0).astype(np.float32))

        def joined(x: list, t=U64) -> np.ndarray:
            """x as one array; x itself is emptied, since a part's entries fill much of a worker's memory."""
            out = np.concatenate(x) if x else np.zeros(0, t)
            x.clear()
            return out

        _, at, self.pair = np.unique(joined(pairs), return_index=True, return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        self.us, self.ui = np.unique(joined(us)[at], return_inverse=True)
        self.ws, self.wi = np.unique(joined(ws)[at], return_inverse=True)
        self.c = np.bincount(self.pair, joined(trained, float), len(at)).astype(np.int64)
        self.t = np.minimum(self.c, 1)
        self.owner = _part(self.ws, parts)
        self.hot = np.flatnonzero(np.isin(self.us, hot))
        self.hot_owner = _part(self.us[self.hot], parts)
        self.cu, self.bases = np.bincount(self.ui, self.c, len(self.us)), []
        self.roots, self.known = np.zeros(len(self.ws), np.int64), (0, 0)  # as owners told last
        self.other_tables = np.zeros(len(self.us))  # of hot restaurants, in other parts

    def tables(self) -> np.ndarray:
        return np.bincount(self.ui, self.t, len(self.us)) + self.other_tables

    def ask(self, first: bool) -> Iterator[tuple[int, int, bytes]]:
        """To each owner: words, their customers and tables here and at the root, and this part's share of hot restaurants."""
        cw, tw, tu = np.bincount(self.wi, self.c, len(self.ws)).astype(np.int64), np.bincount(self.wi, self.t, len(self.ws)).astype(np.int64), np.bincount(self.ui, self.t, len(self.us)).astype(np.int64)
        cu = np.bincount(self.ui, self.c, len(self.us)).astype(np.int64)
        ones, twos = int((self.c == 1).sum()), int((self.c == 2).sum())
        for p in range(self.parts):
            w, h = self.owner == p, self.hot[self.hot_owner == p]
            yield p, ASK, pack(self.part, self.ws[w], cw[w], tw[w], self.roots[w], self.us[h], cu[h], tu[h], (ones, twos), self.known)
        if not first:
            yield self.part, STATE, pack(self.t[self.c > 1])

    def hear(self, replies: list[bytes]) -> None:
        """Owners' answers: customers and samples of the root seating of this part's words, totals, and hot restaurants."""
        cw, tw = (np.zeros(len(self.ws), np.int64) for _ in range(2))
        totals, roots, own = 0.0, None, np.bincount(self.ui, self.t, len(self.us))
        for data in replies:
            p, c, t, hcu, htu, sums, tables, pairs, *rw = unpack(data)
            w, h = self.owner == p, self.hot[self.hot_owner == p]
            roots = np.zeros((len(rw), len(self.ws)), np.int64) if roots is None else roots
            cw[w], tw[w], roots[:, w] = c, t, np.reshape(rw, (len(rw), -1))
            self.cu[h], self.other_tables[h] = hcu, htu - own[h]
            totals = totals + np.concatenate((sums, tables)).astype(float)
        self.n, self.v, customers, ones, twos, *tables = totals.tolist()
        self.d, self.d0 = discount(*pairs.astype(float)), discount(ones, twos)
        self.cw, self.roots, self.known = cw, roots[-1], (int(self.v), int(tables[-1]))
        self.bases = [(tw - self.d0 * r + (1 + self.d0 * all_tables) / (self.v + 1)) / (1 + customers) for r, all_tables in zip(roots, tables, strict=True)]

    def sweep(self, rng: np.random.Generator, k: int = 0) -> None:
        """Reseat every word that has two customers or more in a restaurant, under the k-th sample of the root."""
        x = rng.standard_gamma(1 / self.d + self.tables())
        several = np.flatnonzero(self.c > 1)
        z = self.d * x[self.ui[several]] * self.bases[k % len(self.bases)][self.wi[several]]
        self.t[several] = draw(self.c[several], np.log(z), self.d, rng)

    def predict(self, k: int = 0) -> np.ndarray:
        tables = self.tables()[self.ui]
        return (self.c - self.d * self.t + (1 + self.d * tables) * self.bases[k % len(self.bases)][self.wi]) / (1 + self.cu[self.ui])


def discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.3, 0.95)) if ones else 0.5


def _own(part: int, parts: int, asks: list[bytes], samples: int, turn: int) -> Iterator[tuple[int, int, bytes]]:
    """An owner's turn: customers and tables of its words, samples of their seating at the root, and an answer to each part."""
    asks = sorted((unpack(x) for x in asks), key=lambda x: int(x[0][0]))
    ws, at = np.unique(np.concatenate([x[1] for x in asks]), return_inverse=True)
    add = lambda k: np.bincount(at, np.concatenate([x[k] for x in asks]), len(ws)).astype(np.int64)
    cw, tw, root = add(2), add(3), np.zeros(len(ws), np.int64)
    root[at] = np.concatenate([x[4] for x in asks])
    began = int(root.sum())
    root = np.clip(root, np.minimum(tw, 1), tw)
    hs, hat = np.unique(np.concatenate([x[5] for x in asks]), return_inverse=True)
    hc, ht = (np.bincount(hat, np.concatenate([x[k] for x in asks]), len(hs)).astype(np.int64) for k in (6, 7))
    ones, twos = int((tw == 1).sum()), int((tw == 2).sum())
    d, known = discount(ones, twos), int((cw > 0).sum())
    words, tables = (int(x) for x in asks[0][9])  # all owners', as of the last round
    several, rng, roots = np.flatnonzero(tw > 1), np.random.default_rng((part, turn, 1)), []
    for k in range(2 + samples):
        all_tables = root.sum() + tables - began if words else root.sum() * parts
        x = rng.standard_gamma(1 / d + max(0, all_tables))
        root[several] = draw(tw[several], np.full(len(several), np.log(d * x / ((words or known * parts) + 1))), d, rng)
        if k >= 2:
            roots.append(root.copy())
    sums = (int(cw.sum()), known, int(tw.sum()), ones, twos)
    pairs = np.sum([x[8].astype(np.int64) for x in asks], axis=0)
    i = j = 0
    for x in asks:
        w, h = at[i : i + len(x[1])], hat[j : j + len(x[5])]
        i, j = i + len(x[1]), j + len(x[5])
        yield int(x[0][0]), REPLY, pack(part, cw[w], tw[w], hc[h], ht[h], sums, [int(r.sum()) for r in roots], pairs, *(r[w] for r in roots))


def _of(table: pa.Table, kind: int) -> list[bytes]:
    """Messages of a kind, in an order of their own, so that results do not depend on the shuffle's."""
    return sorted(d for k, d in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True) if k == kind)


def by_size(docs: DataFrame) -> int:
    """Parts by the size of the tables read alone: samples are seeded by part, and must not hang on the session's settings.

    Parts of 2 MB, up to 32 of them, then of 8 MB once there are more; a small table is one part, which is sampled without approximation.
    """
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(x for x in (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) if x < 1 << 60)
    return max(1, min(size >> 21, 32), min(size >> 23, 1 << 17))


def score(docs: DataFrame, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, burn_in: int = 2, samples: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row of docs."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held if held is not None else held_out(F.col(id_col)), F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    bounded_batches(docs)
    parts = by_size(docs)
    # A bounded sample, which lays out the work only; at most 1 / HOT words come back.
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sample = written(plain.limit(2000).select(F.explode(words_of(low)).alias("w")).groupBy("w").count())
    least = HOT * (sample.agg(F.sum("count")).first()[0] or 0)
    hot = np.append(WordHashes().of([r["w"].encode("utf-8", "surrogatepass") for r in sample.where(F.col("count") > least).select("w").collect()]), U64(START))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, tokens, seq = WordHashes(), [], 0, 0
        first = lambda: TaskContext.get().partitionId() << 32 | seq
        blobs = lambda: _rows(list(entry_blobs(first(), held, parts, hot))).to_batches()
        for batch in batches:
            for i, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = hashes.of((text.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER).split())
                held.append((i, not out, h))
                tokens += len(h) + 1
                if tokens >= TOKENS or len(held) >= DOCS:
                    yield from blobs()
                    held, tokens, seq = [], 0, seq + 1
        if held:
            yield from blobs()

    def part_of(key: tuple[pa.Scalar, ...], table: pa.Table, heard: pa.Table | None, turn: int) -> tuple[Part, np.random.Generator]:
        p = Part(key[0].as_py(), _of(table, ENTRIES), hot, parts)
        if heard is not None:
            for data in _of(heard, STATE):
                p.t[p.c > 1] = unpack(data)[0]
            p.hear(_of(heard, REPLY))
        return p, np.random.default_rng((p.part, turn, 0))

    def begin(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _rows(list(part_of(key, table, None, 0)[0].ask(True)))

    def own(turn: int):
        def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return _rows([*((key[0].as_py(), STATE, x) for x in _of(table, STATE)), *_own(key[0].as_py(), parts, _of(table, ASK), samples, turn)])

        return work

    def go_on(turn: int):
        def work(key: tuple[pa.Scalar, ...], table: pa.Table, heard: pa.Table) -> pa.Table:
            p, rng = part_of(key, table, heard, turn)
            for k in range(burn_in):
                p.sweep(rng, k)
            return _rows(list(p.ask(False)))

        return work

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table, heard: pa.Table) -> pa.Table:
        """The part's share of each document's sums, for the part that names the documents' batch."""
        p, rng = part_of(key, table, heard, rounds)
        mean = np.zeros(len(p.c))
        for k in range(burn_in + samples):
            p.sweep(rng, k)
            if k >= burn_in:
                mean += p.predict(k) / samples
        logs, bases, known = np.log10(mean), np.log10(p.cw + 0.5)[p.wi], (p.cw > 0)[p.wi]
        out, at = [], 0
        for first, n_docs, doc, n in p.found:
            pair = p.pair[at : at + len(doc)]
            at += len(doc)
            add = lambda x, n=n, pair=pair, doc=doc, n_docs=n_docs: np.bincount(doc, x[pair] * n, n_docs)
            seen = np.unique(doc)
            out.append((first, SUMS, pack(seen.astype(np.int64), add(logs)[seen], add(bases)[seen], add(known)[seen].astype(np.int64), p.n, p.v)))
        return _rows([*out, *((int(unpack(x)[0][0]), NAMES, x) for x in _of(table, NAMES))])

    def total(table: pa.Table) -> pa.Table:
        names = _of(table, NAMES)
        _, ids, none, n_train, sizes = unpack(names[0])
        logs, bases, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        n = v = 0.0
        for data in _of(table, SUMS):
            seen, x, b, k, (n,), (v,) = unpack(data)
            logs[seen] += x
            bases[seen] += b
            known[seen] += k
        sizes = sizes.astype(np.int64)
        return pa.table({"doc_id": pa.array(ids.astype(np.int64), mask=none), "held_out": pa.array(np.arange(len(ids)) >= n_train[0]), "n_tokens": sizes, "n_known": known, "train_tokens": np.full(len(ids), int(n)), "base_score": bases - sizes * np.log10(n + 0.5 * (v + 1)), "score": logs, "perplexity": 10 ** np.minimum(300, -logs / sizes)})

    entries = plain.mapInArrow(count, DEALT)
    heard = entries.groupBy("part").applyInArrow(begin, DEALT).groupBy("part").applyInArrow(own(0), DEALT)
    for turn in range(1, rounds):
        heard = entries.groupBy("part").cogroup(heard.groupBy("part")).applyInArrow(go_on(turn), DEALT).groupBy("part").applyInArrow(own(turn), DEALT)
    sums = entries.groupBy("part").cogroup(heard.groupBy("part")).applyInArrow(finish, DEALT)
    return sums.groupBy("part").applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
