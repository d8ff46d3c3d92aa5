"""Operator 13, HTML extraction by differencing a page with its nearest page.

Pages become lines (`markup`), and of each line a hash. Of pages of one host with equal lines one stands for all. Spark sorts
them by (host, path) over range partitions; counts per partition give each a rank, so the two that may be nearest by path are the ranks
beside it, on whatever host and however large that is. The lines of neighbours are aligned by a longest common subsequence, a bit
vector a line, and each page is paired with the neighbour whose path shares the longer beginning; lines shared with it go.
Neighbours that share 0.8 or more of what they say, by characters, are copies of one article: they tell nothing about what is around
it, and are passed over.

What shared lines cannot tell, the page does. Lines in what it marks as surroundings (navigation, footers, headers outside the
article, sidebars, notices, adverts, forms, comments, hidden parts; by element, role, or words of class and id) go, whether they are
shared or not. Where a page marks its article, only lines in there are text, and shared ones stay, since articles quote the same
lines; else lines in a block that its class calls content are, else all that is left, less the shared lines.

Only hashes of lines are shuffled, and pages only where many have lines to lose.

Defined results: a null or empty page, and one of surroundings alone, has an empty text; pages without a host in their url are
paired with none; repeated rows each get a row, as do rows that share an id or have none; other columns are ignored, whatever their
names; an empty table gives no rows. A row of a table is one line, its cells parted by a space; <br> and white space of any kind,
no-break spaces included, become one space. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fan_out, written
from .markup import ARTICLE, CONTENT, OUT, lines

COPY = 0.8
SHOWN = "k1 long, k2 long, host string, path string, h array<long>, n array<int>, p array<int>"


def chosen(places: list[int]) -> tuple[int, ...]:
    """The places whose lines are the text of a page with these places."""
    return (ARTICLE,) if ARTICLE in places else (CONTENT,) if CONTENT in places else tuple({*places} - {OUT})


def text_of(page: str | None, lost: list[int] | None = None) -> str:
    """The main text of a page, without the lines whose numbers are lost."""
    found = lines(page)
    wanted = chosen([p for _, p in found])
    gone = set(lost or ())
    return "\n\n".join(x for i, (x, p) in enumerate(found) if p in wanted and i not in gone)


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists, as pairs of positions, by bit vectors (a zero marks a place where the row grows).

    Vectors of every isqrt(len(a))-th row are kept, those between are made again on the way back.
    """
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1

    def step(v: int, x: int) -> int:
        m = v & where.get(x, 0)
        return ((v + m) | (v - m)) & full

    each = isqrt(len(a)) + 1
    v, marks = full, [full]
    for i, x in enumerate(a, 1):
        v = step(v, x)
        if i % each == 0:
            marks.append(v)
    out, j, i = [], len(b), len(a)
    while i and j:
        low = (i - 1) // each * each
        rows = [marks[low // each]]
        for x in a[low:i]:
            rows.append(step(rows[-1], x))
        while i > low and j:
            bit = 1 << (j - 1)
            if rows[i - low] & bit:
                j -= 1
            else:
                i -= 1
                if rows[i - low] & bit:
                    j -= 1
                    out.append((i, j))
    return out[::-1]


def _keys(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, k1, k2): k1 and k2 tell different rows apart."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.select("*", F.xxhash64("page_id", "url", "html").alias("k1"), F.xxhash64("html", F.lit(1), "url", "page_id").alias("k2"))


def host(url: Column) -> Column:
    """Without port and user, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)


def _shown(rows: DataFrame) -> DataFrame:
    """Hash, characters and place of each line of each page that has a host."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            read = [lines(x.as_py()) for x in batch.column(4)]
            signed = [[xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x, _ in page] for page in read]
            lists = [pa.array(signed, pa.list_(pa.int64())), pa.array([[len(x) for x, _ in page] for page in read], pa.list_(pa.int32())), pa.array([[p for _, p in page] for page in read], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *lists], names=[x.split()[0] for x in SHOWN.split(", ")])

    with_host = rows.select("k1", "k2", F.coalesce(host(F.col("url")), F.lit("")).alias("host"), F.coalesce(path(F.col("url")), F.lit("")).alias("path"), "html").where("host <> ''")
    return written(bounded_batches(with_host).mapInArrow(work, SHOWN))


def _neighbours(one: DataFrame) -> DataFrame:
    """one: a row for each set of lines of a host -> rows of neighbours by path, as structs a and b."""
    in_order = one.repartitionByRange(fan_out(one, 4 << 20), "host", "path", "s1", "s2").sortWithinPartitions("host", "path", "s1", "s2")
    placed = written(in_order.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i")))
    counts = placed.groupBy("part").agg(F.count("*").alias("n_rows"), F.min("i").alias("first"))
    before = F.coalesce(F.sum("n_rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each partition, so their number bounds both the window and what is broadcast.
    ranked = placed.join(F.broadcast(counts.select("part", (before - F.col("first")).alias("shift"))), "part").withColumn("r", F.col("i") + F.col("shift"))
    row = F.struct("host", "path", "s1", "s2", "h", "n", "p")
    return ranked.select("r", row.alias("a")).join(ranked.select((F.col("r") - 1).alias("r"), row.alias("b")), "r").where("a.host = b.host").select("a", "b")


def lost_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(k1, k2, lost): for pages without a marked article, the numbers of the lines that they share with their nearest page."""
    return _lost(_keys(pages, id_col, url_col, html_col))


def _lost(rows: DataFrame) -> DataFrame:
    shown = _shown(rows).where(F.size("h") > 0).withColumns({"s1": F.xxhash64("h"), "s2": F.hash("h", "p")})
    one = written(shown.groupBy("host", "s1", "s2").agg(F.min_by(F.struct("path", "h", "n", "p"), F.struct("path", "k1", "k2")).alias("x")).select("host", "s1", "s2", "x.*"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs = common(x["h"], y["h"])
                near = sum(1 for _ in takewhile(lambda c: c[0] == c[1], zip(x["path"], y["path"], strict=False)))
                inner = [n for n, p in zip(x["n"], x["p"], strict=True) if p != OUT], [n for n, p in zip(y["n"], y["p"], strict=True) if p != OUT]
                same = sum(x["n"][i] for i, _ in pairs if x["p"][i] != OUT), sum(y["n"][j] for _, j in pairs if y["p"][j] != OUT)
                copies = any(s >= COPY * sum(n) > 0 for s, n in zip(same, inner, strict=True))
                for own, first, at in ((x, 0, [i for i, _ in pairs]), (y, 1, [j for _, j in pairs])):
                    lost = [] if copies or ARTICLE in own["p"] else [i for i in at if own["p"][i] != OUT]
                    told.append((own["host"], own["s1"], own["s2"], not copies, near, first, lost))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True) if told else [[]] * 7, (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int32())), strict=True)], names=["host", "s1", "s2", "differ", "near", "first", "lost"])

    # Of two that are equally near, the page before is the partner.
    judged = _neighbours(one).mapInArrow(work, "host string, s1 long, s2 int, differ boolean, near int, first int, lost array<int>")
    best = judged.groupBy("host", "s1", "s2").agg(F.max_by("lost", F.struct("differ", "near", "first")).alias("lost")).where(F.size("lost") > 0)
    return written(shown.select("k1", "k2", "host", "s1", "s2").join(written(best), ["host", "s1", "s2"]).select("k1", "k2", "lost").dropDuplicates(["k1", "k2"]))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page; n_chars counts code points."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = _keys(pages, id_col, url_col, html_col)
    # Few pages with lines to lose: Spark sends those few to all; many: it shuffles both sides.
    whole = rows.join(_lost(rows), ["k1", "k2"], "left").select("page_id", "url", "html", "lost")
    return bounded_batches(whole).mapInArrow(work, "page_id long, url string, text string, n_chars long")
