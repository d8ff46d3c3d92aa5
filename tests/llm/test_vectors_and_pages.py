"""Vector codes, centroids and HTML extraction against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

VEC = "vec_id long, embedding array<float>, label int, id long, v string, cluster int, n long"


def vectors(spark, data):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in data], VEC).repartition(3)


def hostile(dims, n=300):
    r = np.random.default_rng(5)
    data = [(i, (r.normal(size=dims) * 3).tolist(), (None, 1, 1, 2)[i % 4]) for i in range(n)]
    same = data[0][1]
    return data + [(i, same, 7) for i in range(n, n + 30)] + [(7, same, 1), (7, data[7][1], 1), (None, same, None), (900, None, 1), (901, [math.nan] + same[1:], 1), (902, [None] + same[1:], 1), (903, [math.inf] + same[1:], 1), (904, same[:-1], 1), (905, [], 1), (906, [1e30] + same[1:], 1), (907, [0.0] * dims, 1), (908, [-0.0004] * dims, None)]


def whole(data, dims):
    """Kept rows as (id, integers, label), exactly."""
    ok = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 1 << 17 for x in v)
    return [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v), label) for i, v, label in data if ok(v)]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def lloyd(rows, books, rounds):
    """Exact rounds of Lloyd's algorithm on tuples of integers; ties to the lower entry."""
    for _ in range(rounds):
        own = [[] for _ in books]
        for v in rows:
            own[min(range(len(books)), key=lambda j: (far(v, books[j]), j))].append(v)
        books = [tuple(sum(x) // len(o) for x in zip(*o, strict=True)) if o else b for o, b in zip(own, books, strict=True)]
    return books


def test_vector_codes(spark):
    from lodestack.llm.codes import digests

    data = hostile(8)
    kept = sorted(whole(data, 8), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [lloyd([v[2 * p : 2 * p + 2] for _, v, _ in kept], [v[2 * p : 2 * p + 2] for _, v, _ in kept[:16]], 3) for p in range(4)]
    want, sums = [], {}
    for i, v, label in kept:
        best = [min((far(v[2 * p : 2 * p + 2], b), j) for j, b in enumerate(books[p])) for p in range(4)]
        want.append((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), label))
        sums[label] = sums.get(label, 0) + want[-1][2]
    sha = hashlib.sha256(",".join(str(x) for p in books for b in p for x in b).encode()).hexdigest()
    got = digests(vectors(spark, data), parts=4, entries=16, rounds=3).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, c, e, sums[label], sha) for i, c, e, label in want), key=repr)


def test_vector_codes_of_few_and_of_no_vectors(spark):
    from lodestack.llm.codes import compress, digests

    got = digests(vectors(spark, [(3, [1.0, 2.0, 3.0, 4.0], 1), (1, [1.0, 2.0, 3.0, 5.0], None)])).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 3] and all(r["error"] == 0 for r in got)
    none = digests(vectors(spark, [(3, None, 1)]))
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and none.collect() == []
    with pytest.raises(ValueError):
        compress(vectors(spark, []), entries=257)


def test_vector_codes_of_large_components_are_exact():
    from lodestack.llm.codes import nearest

    r = np.random.default_rng(2)
    columns, entries = r.integers(-(1 << 27), 1 << 27, (16, 40)), r.integers(-(1 << 27), 1 << 27, (16, 9))
    entries[:, 5] = entries[:, 2]
    codes, d = nearest(columns, entries)
    for i in range(40):
        best = min((sum((int(a) - int(b)) ** 2 for a, b in zip(columns[:, i], entries[:, j], strict=True)), j) for j in range(9))
        assert (d[i], codes[i]) == best


def test_centroids(spark):
    from lodestack.llm.centroids import digests

    data = hostile(6)
    kept = whole(data, 6)
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:5]
    books = lloyd([v for _, v, _ in kept], [v for _, v, _ in first], 6)
    best = [(i, *min((far(v, b), j) for j, b in enumerate(books))) for i, v, _ in kept]
    own = {j: sum(d for _, d, k in best if k == j) for j in range(5)}
    sha = [hashlib.sha256(",".join(map(str, b)).encode()).hexdigest() for b in books]
    want = [(i, j, d, own[j], sum(own.values()), sha[j]) for i, d, j in best]
    got = digests(vectors(spark, data), k=5, rounds=6, dims=6).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert digests(vectors(spark, [(1, [1.0] * 5, 1)]), dims=6).collect() == []
    assert [r["distance"] for r in digests(vectors(spark, [(1, [1.0] * 6, 1)]), dims=6).collect()] == [0]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 70), st.integers(1, 9), st.sampled_from([1, 3, 1 << 10, 1 << 20, (1 << 27) - 1]))
def test_screening_never_drops_the_nearest(seed, dims, k, size):
    from lodestack.llm.centroids import intervals, nearest

    r = np.random.default_rng(seed)
    x, c = r.integers(-size, size + 1, (12, dims)), r.integers(-size, size + 1, (k, dims))
    x[3], c[k - 1] = c[0], c[0]  # ties
    x[4] = (c[0] + c[k // 2]) // 2  # between two
    low, high = intervals(x, c)
    best, _ = nearest(x, c)
    for i in range(12):
        true = [sum(int(b) * (int(b) - 2 * int(a)) for a, b in zip(x[i], c[j], strict=True)) for j in range(k)]
        assert all(low[i, j] <= true[j] <= high[i, j] for j in range(k))
        assert best[i] == min(range(k), key=lambda j: (true[j], j))


def test_screening_settles_most_vectors():
    from lodestack.llm.centroids import nearest

    r = np.random.default_rng(1)
    assert nearest(r.integers(-1024, 1024, (5000, 64)), r.integers(-1024, 1024, (8, 64)))[1] < 50


# -- pages -------------------------------------------------------------------------------------------------------------------
@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_common_subsequence(a, b):
    from lodestack.llm.extraction import common

    length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            length[i + 1][j + 1] = length[i][j] + 1 if a[i] == b[j] else max(length[i][j + 1], length[i + 1][j])
    got = common(a, b)
    assert len(got) == length[-1][-1] and all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


CASES = [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b<br>c", "a\n\nb c"), ("<article><h1>T</h1><p>x &amp; y&nbsp; z</p></article><p>rest", "T\n\nx & y z"),
    ("<nav>menu</nav><header>top</header><main><p>a<b>b</b>c</p><aside>s</aside></main><footer>f</footer>", "abc"),
    ("<body class=has-sidebar><div class='post-content'><p>one</p></div><div id=comments><article class=comment>no</article></div></body>", "one"),
    ("<script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no --><p>yes</p><noscript>no</noscript>", "yes"),
    ("<form><main><p>inside a form</p><form>mail <input></form></main></form>", "inside a form"), ("<form>search</form><p>text", "text"),
    ("<article><header><h1>Kept</h1></header><p>body</p><footer>by</footer><div class='share-buttons'>share</div></article>", "Kept\n\nbody"),
    ("<p class='ad'>buy<p>text", "text"), ("<p>a <span hidden>h</span>b<span style='display: none'>i</span></p>", "a b"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2\n\n3"),
    ("<ul><li>a<li>b</ul><p title='a > b'>c", "a\n\nb\n\nc"), ("a < b and <3", "a < b and <3"), ("<p>unclosed <a href='x", "unclosed <a href='x"), ("<div role=navigation>n</div><div aria-hidden=true>x</div>z", "z"),
    ("<p>it&#39;s &copy 5 &unknown; &#x1F600;", "it's © 5 &unknown; \U0001f600"), ("<title>t</title><p>x</p><svg><text>no</text></svg>", "x"), ("<pre>a\n  b</pre>", "a b"), ("<b><p>x</b>y</p>", "xy"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_text_of_a_page(page, text):
    from lodestack.llm.extraction import text_of

    assert text_of(page) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<a href='", "'", '"', ">", "<", "<li>", "<script>", "</script>", "<!--", "-->", "x", "&amp", ";", "<article>", "</article>", "<b>", "</b>", "\x00"]), max_size=40))
def test_any_markup_is_read(parts):
    from lodestack.llm.markup import lines

    assert all(x == x.strip() and x for x, _ in lines("".join(parts)))


def test_long_and_deep_pages_are_read_in_time():
    from lodestack.llm.extraction import common, text_of

    assert text_of("<p>word</p>" * 50_000).count("word") == 50_000
    assert text_of("<div>" * 50_000 + "x") == "x"
    assert text_of("<b>" + "<div>" * 50_000 + "x</b>" * 50_000).startswith("xxx")
    assert text_of("<a " * 50_000 + "x").endswith("x")
    assert text_of("<p title=\"" * 20_000 + ">x") is not None
    assert len(common([1, 2] * 3000, [2, 1] * 3000)) == 5999


PAGES = "page_id long, url string, html string, text string, h long, k1 long, lost string, n string"


def page_of(seed, n=6):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(5000)}" for _ in range(12)) for _ in range(n)]


def pages(spark, data):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in data], PAGES).repartition(3)


def test_extraction_by_differencing(spark):
    """Pages without any marks: lines that come on the nearest page go, all others stay; copies are passed over."""
    from lodestack.llm.extraction import extract

    wrap = lambda body: "".join(f"<p>{x}</p>" for x in ["Home and products", "Call now", *body, "All rights kept"])
    data, want = [], {}
    for i in range(40):
        own = page_of(i)
        data.append((i, f"https://a.example/x/{i:03d}?q={i}", wrap(own)))
        want[i] = "\n\n".join(own)
    copied = page_of(500)
    for i in range(100, 130):  # one article under many addresses, between others
        data.append((i, f"https://a.example/x/020{i}", wrap(copied)))
        want[i] = "\n\n".join(copied)
    alone = page_of(600)
    data += [(200, "https://b.example/", wrap(alone)), (201, None, wrap(alone)), (202, "no address", wrap(alone)), (203, "https://a.example/x/005", None), (None, "https://a.example/x/006", "")]
    for i in (200, 201, 202):
        want[i] = "\n\n".join(["Home and products", "Call now", *alone, "All rights kept"])
    want[203] = want[None] = ""
    twice = page_of(700)
    data += [(300, "https://c.example/1", wrap(twice))] * 2 + [(300, "https://c.example/2", wrap(page_of(701)))]
    marked = page_of(800)
    data += [(400, "https://d.example/1", f"<nav>{wrap(marked)}</nav><article>{wrap(marked)}</article>"), (401, "https://d.example/2", wrap(page_of(801)))]
    want[400], want[401] = "\n\n".join(["Home and products", "Call now", *marked, "All rights kept"]), "\n\n".join(page_of(801))
    got = extract(pages(spark, data)).collect()
    assert len(got) == len(data) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] != 300} == want
    assert sorted(r["text"] for r in got if r["page_id"] == 300) == sorted(["\n\n".join(twice)] * 2 + ["\n\n".join(page_of(701))])


def test_lost_lines_are_those_of_the_nearest_page(spark):
    """Against brute force: partners by the longer common beginning of paths, of the pages beside each in order."""
    from lodestack.llm.extraction import COPY, extract
    from lodestack.llm.markup import lines

    r = random.Random(9)
    data = [(i, f"http://{r.choice('ab')}.example/{r.choice(['news', 'new', 'shop'])}/{r.randrange(50)}/{i}", "".join(f"<p>{x}</p>" for x in sorted(r.sample(["1 one", "2 two", "3 three", "4 four", "5 five"], r.randrange(0, 4))) + page_of(i, r.randrange(0, 5)))) for i in range(120)]
    alike = {}
    for i, url, page in data:  # pages of a host with equal lines are one, at the smallest path
        _, _, host, path = url.split("/", 3)
        if own := tuple(x for x, _ in lines(page)):
            alike.setdefault((host, own), []).append((path, i))
    order = sorted((host, min(group)[0], own, [i for _, i in group]) for (host, own), group in alike.items())
    length = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    got = {x["page_id"]: x["text"].split("\n\n") if x["text"] else [] for x in extract(pages(spark, data)).collect()}
    n_lost = 0
    for k, (host, path, own, ids) in enumerate(order):
        options = []
        for j in (k - 1, k + 1):
            if 0 <= j < len(order) and order[j][0] == host:
                other = order[j][2]
                shared = sum(len(x) for x in set(own) & set(other))  # no line comes twice in a page here
                options.append((not any(shared >= COPY * sum(map(len, x)) for x in (own, other)), length(path, order[j][1]), j == k - 1, other))
        differ = max(options, key=lambda o: o[:3])
        lost = longest(own, differ[3]) if differ[0] else 0
        n_lost += lost
        for i in ids:
            assert len(got[i]) == len(own) - lost and [x for x in own if x in set(got[i])] == got[i]
            assert all(x in differ[3] for x in own if x not in got[i])
    assert n_lost > 20


def test_extraction_of_an_empty_table(spark):
    from lodestack.llm.extraction import extract

    assert extract(pages(spark, [])).collect() == []


# -- queries that share an id, null ids as bridges, names -----------------------------------------------------------------------
def test_queries_that_share_an_id_are_searched_apart(spark):
    from pyspark.sql import functions as F

    from lodestack.llm.ann import search

    data = [(100, [0.0, 1.0]), (100, [5.0, 1.0])] + [(i, [float(i), 1.0]) for i in range(1, 8)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(2)
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in search(frame, F.col("vec_id") == 100, k=5).collect())
    want = []
    for x in (0, 5):
        best = sorted((abs(i - x), i) for i in range(1, 8))[:5]
        want += [(n, i, float(d)) for n, (d, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_fingerprints_without_id_link_others(spark):
    """Against brute force over fingerprints, with a null id in the middle of each chain."""
    from lodestack.llm.simhash import keep_one, near_duplicates, simhash

    r, chains = random.Random(1), []
    while len(chains) < 3:  # a ~ b ~ c, a and c apart
        words = [f"w{r.randrange(900)}" for _ in range(400)]
        texts = [" ".join(words)]
        for _ in range(40):
            words[r.randrange(400)] = f"x{r.randrange(900)}"
            texts.append(" ".join(words))
        bits = [simhash(t) for t in texts]
        found = [(0, j, k) for j in range(1, 40) for k in range(j + 1, 41) if (bits[0] ^ bits[j]).bit_count() <= 3 and (bits[j] ^ bits[k]).bit_count() <= 3 < (bits[0] ^ bits[k]).bit_count()]
        if found:
            chains.append([texts[i] for i in found[0]])
    data = [row for n, (a, b, c) in enumerate(chains) for row in ((10 * n + 2, a), (None, b), (10 * n + 1, c))] + [(None, "alone without an id"), (99, None)]
    want = []
    for i, t in data:
        reached, todo = {simhash(t)}, [simhash(t)]
        while todo:
            x = todo.pop()
            for _, other in data:
                if (y := simhash(other)) not in reached and (x ^ y).bit_count() <= 3:
                    reached.add(y)
                    todo.append(y)
        want.append((i, min((j for j, u in data if j is not None and simhash(u) in reached), default=None)))
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    got = [(x["doc_id"], x["component_id"]) for x in near_duplicates(frame).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and (2, 1) in got and (None, None) in got
    kept = keep_one(frame).collect()
    assert sorted(x["doc_id"] for x in kept if x["doc_id"] is not None) == [1, 11, 21, 99] and len(kept) == 5


def test_columns_with_inner_names_are_carried(spark):
    from lodestack.llm.mixing import mix_table, repeated
    from lodestack.llm.simhash import keep_one

    odd = "doc_id long, text string, source string, __key long, __id string, __size int, __hash int, __copies int, __k int, row int, r int, a.b int"
    names = odd.replace("a.b", "`a.b`")
    data = [(i, f"one two three w{i} w{i * 7} w{i * 11} w{i % 5}", "ab"[i % 2], *range(4, 7), 7, 8, 9, 10, 11, 12) for i in range(40)]
    data = [(*row[:4], str(row[4]), *row[5:]) for row in data]
    frame = spark.createDataFrame(data, names)
    copies = repeated(frame)
    assert copies.columns == frame.columns and {tuple(r) for r in copies.collect()} <= set(data)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mix_table(frame).collect()}
    assert {i: n for i, n in taken.items() if n} == {r["doc_id"]: r["count"] for r in copies.groupBy("doc_id").count().collect()}
    assert keep_one(frame).columns == frame.columns and keep_one(frame).count() == 40


def test_archives_are_written_where_spark_finds_the_folder(spark, tmp_path):
    from lodestack.llm.warc import qualified, write_bundles

    assert qualified(spark, str(tmp_path)).startswith("file:/") and qualified(spark, "hdfs-like:/x".replace("hdfs-like", "file")) == "file:/x"
    index = write_bundles(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), f"{tmp_path}/w").first()
    assert index["path"].startswith("file:/") and (tmp_path / "w").exists()


def test_clustered_vectors_are_found_in_small_windows(spark):
    """No warning: the windows hold less than half of the table; recall against brute force."""
    import warnings

    from pyspark.sql import functions as F

    from lodestack.llm import ann

    r = np.random.default_rng(8)
    centres = r.normal(size=(200, 16)) * 4
    v = (centres[np.arange(4000) % 200] + r.normal(size=(4000, 16)) * 0.05).astype(np.float32)
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>").repartition(4)
    with warnings.catch_warnings():
        warnings.filterwarnings("error", message="little structure")  # there is structure, so nothing is told
        got = ann.search(frame, F.col("vec_id") % 100 == 0, k=10, block=128)
    rows = got.collect()
    want = {q: set(np.lexsort((np.arange(4000), np.where(np.arange(4000) == q, np.inf, ((v.astype(float) - v[q].astype(float)) ** 2).sum(1))))[:10].tolist()) for q in range(0, 4000, 100)}
    hits = sum(x["vec_id"] in want[x["query_id"]] for x in rows)
    assert hits >= 0.95 * 400


def test_scores_do_not_hang_on_shuffle_partitions(spark):
    from lodestack.llm.pitman_yor import score

    from .helpers import docs

    found, key = [], "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        for n in ("2", "7"):
            spark.conf.set(key, n)
            found.append(sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["score"], r["base_score"]) for r in score(docs(spark)).collect()))
    finally:
        spark.conf.set(key, before)
    assert len(found[0]) == len(found[1]) and all(a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-12) and math.isclose(a[4], b[4], rel_tol=1e-12) for a, b in zip(*found, strict=True))
