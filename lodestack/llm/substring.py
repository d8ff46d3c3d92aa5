"""Operator 8, substring dedup: words that lie in a long passage which also starts in a document with a smaller id go.

A suffix automaton of all references cannot be broadcast, since it grows with the corpus. So references are cut into
shards that hold only what can match, and passages are streamed through the automaton of their shard:

1. Every window of `length` words picks as its anchor the smallest hash of the `gram`-word sequences in it. Equal
   windows pick equal anchors. A run of consecutive windows with one anchor is a passage, known by (anchor, hash of its
   words): about one for every two dozen words. A task sends a passage once: further holders in documents with larger ids
   are copies of what is in the shard, so that a passage which many documents share makes a row a task, not one a document.
2. Only anchors that two documents or more have can hold a match. The words of each of their passages are asked for
   once, from the first document that has it.
3. An anchor is a shard. Its passages are streamed in the order of their first documents: matching statistics against the
   suffix automaton of all passages of smaller documents give, for each word, the longest earlier match that ends there;
   where it reaches `length`, the maximal span goes. Then the passage is added to the automaton, unless each of its
   windows matched already, and, if later documents have it too, streamed again for these.
4. Spans are joined to the holders of their passages and by document, and a last pass over the texts cuts them.

All but the automata are Spark's own shuffles, windows and joins, which spill; Python workers stream batches and hold one
document and one anchor's automaton. An anchor with more than `heavy` words of different passages (a boilerplate
with very many continuations) is no shard: its windows are told apart by hash, grouped by Spark, and those of smaller
documents mark the others. That gives the same spans, in any number of tasks.

Words are compared as words in the automata; anchors, passages and heavy windows as 64-bit hashes.

Defined results: a null text has no words; rows that share a doc_id are one document each and take nothing from each
other; a row without doc_id is compared to none and kept whole; an empty table gives no rows; other columns, whatever
their names, are carried along by remove_repeats; a text of any length is one row's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import U64, WordHashes, bounded_batches, mixed, written

B = U64(0x9E3779B97F4A7C15)
B_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK = np.dtype([("anchor", "<i8"), ("content", "<i8"), ("doc", "<i8"), ("key", "<i8"), ("at", "<i4"), ("n", "<i4")])
CHUNKS = "anchor long, content long, doc long, key long, at int, n int, repeat boolean"
#: Passages that a task holds before it sends them on, and an anchor's words beyond which it is split by window.
HELD, HEAVY = 200_000, 100_000


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class Powers:
    """Powers of B and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 12)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate((np.ones(1, U64), np.full(n - 1, B, U64))), dtype=U64)
                self.down = np.cumprod(np.concatenate((np.ones(1, U64), np.full(n - 1, B_INV, U64))), dtype=U64)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours, by doubling."""
    m, have = x, 1
    while have < n:
        step = min(have, n - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return m


def _sums(h: np.ndarray, powers: Powers) -> np.ndarray:
    powers.to(len(h) + 1)
    return np.concatenate((np.zeros(1, U64), np.cumsum(h * powers.up[: len(h)], dtype=U64)))


def chunks_of(h: np.ndarray, length: int, gram: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """h: hashes of a document's words -> anchor, content hash, first window and number of windows of each passage."""
    n = len(h)
    if n < length:
        none = np.zeros(0, U64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    with np.errstate(over="ignore"):
        sums = _sums(h, powers)
        grams = mixed((sums[gram:] - sums[:-gram]) * powers.down[: n - gram + 1])
        anchor = sliding_min(grams, length - gram + 1)
        at = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        n_windows = np.diff(np.append(at, len(anchor)))
        end = at + n_windows + length - 1
        content = mixed(mixed((sums[end] - sums[at]) * powers.down[at]) + n_windows.astype(U64))
    return anchor[at], content, at, n_windows


class SuffixAutomaton:
    """Online suffix automaton over integers; a separator (any integer used once) keeps sequences apart."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.last = [-1], [0], 0

    def add(self, x: int) -> None:
        nxt, link, length = self.next, self.link, self.len
        cur, p = len(nxt), self.last
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and x not in nxt[p]:
            nxt[p][x] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][x]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(x) == q:
                    nxt[p][x] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def matches(self, xs: list[int], least: int) -> list[tuple[int, int]]:
        """For each place of xs where the longest match that ends there has at least `least`, its [start, end)."""
        nxt, link, length = self.next, self.link, self.len
        state = matched = 0
        out: list[tuple[int, int]] = []
        for i, x in enumerate(xs, 1):
            while state and x not in nxt[state]:
                state = link[state]
                matched = length[state]
            if x in nxt[state]:
                state = nxt[state][x]
                matched += 1
            if matched >= least:
                out.append((i - matched, i))
        return out

    def spans(self, xs: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal [start, end) of xs covered by matches of at least `least`, from the matching statistics."""
        return _union(self.matches(xs, least))


class Shard:
    """The passages of one anchor, which come in the order of their first documents."""

    def __init__(self, least: int):
        self.least, self.automaton, self.names, self.seen = least, SuffixAutomaton(), {}, set()
        self.waiting: list[tuple] = []
        self.doc, self.separator, self.empty = None, -1, True

    def stream(self, content: int, doc: int, again: bool, words: list[bytes]) -> Iterator[tuple]:
        """(content, for later holders, start, end) of spans found in passages of smaller documents."""
        if content in self.seen:
            return
        if doc != self.doc:
            yield from self.flush()
            self.doc = doc
        self.seen.add(content)
        xs = [self.names.setdefault(w, len(self.names)) for w in words]
        found = [] if self.empty else self.automaton.matches(xs, self.least)
        for s, e in _union(found):
            yield content, False, s, e
        # Matches of several documents may cover a passage and still leave a window new.
        self.waiting.append((content, again, xs, len(found) <= len(xs) - self.least))

    def flush(self) -> Iterator[tuple]:
        """Adds the passages of the document that is done, and tells what later holders of them match."""
        for _, _, xs, new in self.waiting:
            if new:
                self.empty = False
                for x in xs:
                    self.automaton.add(x)
                self.automaton.add(self.separator)
                self.separator -= 1
        for content, again, xs, _ in self.waiting:
            for s, e in self.automaton.spans(xs, self.least) if again else ():
                yield content, True, s, e
        self.waiting.clear()


def _new(c: np.ndarray, *names: str) -> np.ndarray:
    """True where a row of the sorted c differs from the one before in any of the columns."""
    new = np.ones(len(c), bool)
    if len(c):
        new[1:] = np.logical_or.reduce([c[x][1:] != c[x][:-1] for x in names])
    return new


def _first(new: np.ndarray) -> np.ndarray:
    """The index at which each row's run begins."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def passages(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """texts: (doc, key, text) -> CHUNKS. `repeat`: a smaller document of the same task has the passage too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            c = np.concatenate(held)
            held.clear()
            c = c[np.lexsort((c["at"], c["key"], c["doc"], c["content"], c["anchor"]))]
            repeat = c["doc"] > c["doc"][_first(_new(c, "anchor", "content"))]
            c["anchor"][repeat] = c["content"][repeat] = 0
            return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c[x])) for x in CHUNK.names), pa.array(repeat)], names=[*CHUNK.names, "repeat"])

        for batch in batches:
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                anchor, content, at, n = chunks_of(hashes.of(split_words(text.as_py())), length, gram, powers)
                if len(at):
                    c = np.empty(len(at), CHUNK)
                    c["anchor"], c["content"], c["doc"], c["key"], c["at"], c["n"] = anchor.view(np.int64), content.view(np.int64), doc, key, at, n
                    held.append(c)
                    size += len(c)
                    if size >= HELD:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return texts.where("doc is not null").select("doc", "key", "text").mapInArrow(work, CHUNKS)


def shared(chunks: DataFrame, length: int, heavy: int) -> DataFrame:
    """Passages of anchors that several documents have, with `first` (asked for its words), `later` and `again`."""
    of_anchor, of_content = Window.partitionBy("anchor"), Window.partitionBy("anchor", "content")
    rank = F.row_number().over(of_content.orderBy("doc", "key", "at"))
    told = chunks.where("not repeat").drop("repeat").repartition("anchor").withColumn("first", rank == 1).withColumns({"lowest": F.min("doc").over(of_content), "highest": F.max("doc").over(of_content)})
    told = told.withColumns({"low": F.min("doc").over(of_anchor), "high": F.max("doc").over(of_anchor), "words": F.sum(F.when(F.col("first"), F.col("n") + (length - 1))).over(of_anchor)})
    columns = ("anchor", "content", "doc", "key", "at", "n", "first", (F.col("doc") > F.col("lowest")).alias("later"), (F.col("highest") > F.col("lowest")).alias("again"), (F.col("words") > heavy).alias("heavy"))
    return told.where("low < high").select(*columns)


def _asked(texts: DataFrame, which: DataFrame) -> DataFrame:
    """texts joined with the passages of theirs in `which`: a row for each text that has any."""
    asked = which.groupBy("key").agg(F.collect_set(F.struct("anchor", "content", "doc", "at", "n", "again")).alias("asked"))
    return texts.join(asked, "key")


def _spans_of_heavy(texts: DataFrame, heavy: DataFrame, length: int) -> DataFrame:
    """(key, start, end) of repeated passages of heavy anchors: by the hashes of their windows."""
    names = ("window", "doc", "key", "at")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            window, doc, key, at = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, window))
            window, doc, key, at = window[order], doc[order], key[order], at[order]
            new = np.ones(len(window), bool)
            new[1:] = window[1:] != window[:-1]
            repeat = doc > doc[_first(new)]
            # What a smaller document of this task has too is settled; it need not meet the others of its window.
            window = np.where(repeat, mixed(key.view(U64) + at.astype(U64)).view(np.int64), window)
            held.clear()
            return pa.RecordBatch.from_arrays([*map(pa.array, (window, doc, key, at.astype(np.int32), repeat))], names=[*names, "repeat"])

        for batch in batches:
            for key, text, asked in zip(*(batch.column(x).to_pylist() for x in ("key", "text", "asked")), strict=True):
                at = np.concatenate([np.arange(a["at"], a["at"] + a["n"]) for a in asked])
                with np.errstate(over="ignore"):
                    sums = _sums(hashes.of(split_words(text)), powers)
                    window = mixed((sums[at + length] - sums[at]) * powers.down[at]).view(np.int64)
                held.append((window, np.full(len(at), asked[0]["doc"]), np.full(len(at), key), at))
                size += len(at)
                if size >= HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    windows = _asked(texts, heavy.where("not later")).mapInArrow(work, "window long, doc long, key long, at int, repeat boolean")
    first = F.min("doc").over(Window.partitionBy("window"))
    hit = windows.withColumn("first", first).where("repeat or doc > first").select("key", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    return hit.unionByName(heavy.where("later").select("key", F.col("at").alias("start"), (F.col("at") + F.col("n") + (length - 1)).alias("end")))


def _spans(texts: DataFrame, among: DataFrame, length: int) -> DataFrame:
    """(key, start, end) of repeated passages, by the automata of their anchors."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("again", pa.bool_()), ("words", pa.binary())])
        for batch in batches:
            for key, text, asked in zip(*(batch.column(x).to_pylist() for x in ("key", "text", "asked")), strict=True):
                w = split_words(text)
                yield pa.RecordBatch.from_pylist([a | {"key": key, "words": b" ".join(w[a["at"] : a["at"] + a["n"] + length - 1])} for a in asked], schema=schema)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = anchor = None
        for batch in batches:
            out: list[tuple] = []
            for a, content, doc, again, words in zip(*(batch.column(x).to_pylist() for x in ("anchor", "content", "doc", "again", "words")), strict=True):
                if shard is None or a != anchor:
                    if shard:
                        out += ((anchor, *x) for x in shard.flush())
                    shard, anchor = Shard(length), a
                out += ((anchor, *x) for x in shard.stream(content, doc, again, words.split(b" ")))
            yield _found(out)
        if shard:
            yield _found([(anchor, *x) for x in shard.flush()])

    def _found(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ((),) * 5
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()), strict=True)], names=["anchor", "content", "later", "s", "e"])

    told = _asked(texts, among.where("first")).mapInArrow(answer, "anchor long, content long, doc long, key long, at int, again boolean, words binary")
    found = told.repartition("anchor").sortWithinPartitions("anchor", "doc", "key", "at").mapInArrow(match, "anchor long, content long, later boolean, s int, e int")
    return found.join(among, ["anchor", "content", "later"]).select("key", (F.col("at") + F.col("s")).alias("start"), (F.col("at") + F.col("e")).alias("end"))


def repeat_spans(docs: DataFrame, then: Callable[[pa.RecordBatch, Iterator[tuple]], list], schema: str, length: int = 50, gram: int = 12, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """A row of `schema` for each row of docs: then(its columns by place, (words, [start, end) spans) of each) gives the values."""
    bounded_batches(docs)
    text = F.col(f"`{text_col}`").cast("string")
    number = F.col(f"`{id_col}`").cast("long")
    plain = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    texts = docs.select(F.xxhash64(number, text).alias("key"), number.alias("doc"), text.alias("text"), *(c for c, name in zip(plain, docs.columns, strict=True) if name != text_col))
    chunks = written(passages(texts, length, gram))
    among = written(shared(chunks, length, heavy))
    spans = chunks.where("repeat").select("key", F.col("at").alias("start"), (F.col("at") + F.col("n") + (length - 1)).alias("end"))
    spans = spans.unionByName(_spans(texts, among.where("not heavy"), length))
    if among.where("heavy").limit(1).count():
        spans = spans.unionByName(_spans_of_heavy(texts, among.where("heavy"), length))

    target = to_arrow_schema(StructType.fromDDL(schema))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = ((split_words(t.as_py()), _union([(x["start"], x["end"]) for x in found or () if i is not None])) for i, t, found in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(then(batch, each), target, strict=True)], names=target.names)

    by_text = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return texts.join(by_text, "key", "left").mapInArrow(cut, schema)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    kept, at = [], 0
    for s, e in spans:
        kept += words[at:s]
        at = e
    return kept + words[at:]


def removal_digest(docs: DataFrame, length: int = 50, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space, for each row."""

    def then(batch: pa.RecordBatch, each: Iterator[tuple]) -> list:
        sizes, gone, sha = [], [], []
        for words, spans in each:
            kept = without(words, spans)
            sizes.append(len(words))
            gone.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return [batch.column("doc"), sizes, gone, sha]

    return repeat_spans(docs.select("doc_id", "text"), then, "doc_id long, n_words long, n_removed long, kept_sha256 string", length, heavy=heavy)


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """docs with each text that has repeated words replaced by its kept words, joined by one space; other texts stay as they are."""
    names = list(docs.columns)

    def then(batch: pa.RecordBatch, each: Iterator[tuple]) -> list:
        texts = [b" ".join(without(words, spans)).decode("utf-8", "surrogatepass") if spans else t.as_py() for t, (words, spans) in zip(batch.column("text"), each, strict=True)]
        return [texts if name == text_col else batch.column(f"c{i}") for i, name in enumerate(names)]

    return repeat_spans(docs, then, _ddl(docs), length, id_col=id_col, text_col=text_col, heavy=heavy)


def _ddl(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
