"""Operators over documents against brute force: quality, SimHash, substring dedup, BPE, licenses."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from .helpers import DDL, docs, empty, prose, rows, words

DATA = [r[:3] for r in rows()]


def grams(w, n):
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


# -- quality rules ------------------------------------------------------------------------------------------------------
def measures(text):
    w, t = words(text), text or ""
    count, covered = Counter(grams(w, 5)), set()
    for i, g in enumerate(grams(w, 5)):
        if count[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if words(x)]
    n_rep = len(covered)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n_rep, len(w) < 10 or 100 * n_rep > 20 * len(w)


def test_quality_measures(spark):
    from lodestack.llm.quality import quality_measures

    got = sorted((r["doc_id"] or -1, *list(r)[1:7]) for r in quality_measures(docs(spark)).collect())
    assert got == sorted((i or -1, *measures(t)) for i, t, _ in DATA)
    assert quality_measures(empty(spark)).count() == 0


def test_quality_filter_agrees_with_measures_and_keeps_columns(spark):
    from lodestack.llm.quality import quality_filter, quality_measures

    kept = quality_filter(docs(spark))
    assert kept.columns == docs(spark).columns
    verdict = [r["doc_id"] for r in quality_measures(docs(spark)).where("kept").collect()]
    assert sorted(map(str, verdict)) == sorted(str(r["doc_id"]) for r in kept.collect())
    assert quality_filter(empty(spark)).count() == 0


@pytest.mark.parametrize("text, rule", [("## ** " * 20, "symbols"), ("WHY NOT SHOUT " * 8 + "so that all may hear it now", "shouting"), ("go go stop stop " + prose(1, 10) + " a a b b c c d d", "stutter")])
def test_rules_name_what_they_reject(spark, text, rule):
    from lodestack.llm.quality import OWN_RULES, cascade, words_of
    from pyspark.sql import functions as F

    order = sorted(OWN_RULES, key=lambda r: r.name != rule)
    got = spark.createDataFrame([(text,)], "t string").withColumn("w", words_of(F.col("t"))).select(cascade(order, F.col("t"), F.col("w"))).first()[0]
    assert got == rule


def test_order_is_by_rejection_per_cost(spark):
    from lodestack.llm.quality import Rule, order_rules
    from pyspark.sql import functions as F

    never, often = Rule("never", lambda t, w: F.lit(False)), Rule("often", lambda t, w: F.size(w) > 1)
    assert [r.name for r in order_rules(docs(spark), (never, often))] == ["often", "never"]
    dear = Rule("dear", lambda t, w: F.size(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.transform(w, lambda x: F.sha2(F.concat(x, i.cast("string")), 512)))))) > 60)
    assert [r.name for r in order_rules(docs(spark), (dear, often))] == ["often", "dear"]


# -- SimHash ------------------------------------------------------------------------------------------------------------------
def slow_simhash(text):
    import xxhash

    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = words(low)
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, radius):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(i)
    return {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in groups.values() for i in g}


def test_simhash_components(spark):
    from lodestack.llm.simhash import keep_one, near_duplicates

    data = [r for r in DATA if len(r[1] or "") < 20_000]
    fps = [slow_simhash(t) for _, t, _ in data]
    want = slow_components([r[0] for r in data], fps, 3)
    frame = docs(spark, [(*r, 1, 2, 3, 4, 5, 6, "w") for r in data])
    got = sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), r["component_id"]) for r in near_duplicates(frame).collect())
    assert got == sorted((str(data[i][0]), fps[i], want[i]) for i in range(len(data)))
    assert near_duplicates(empty(spark)).count() == 0
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(data[i][0] for i in range(len(data)) if data[i][0] is not None and want[i] == data[i][0])


def test_keep_one_chooses_by_row(spark):
    from lodestack.llm.simhash import keep_one

    lone, copied, x, y, z = (prose(70 + i, 300) for i in range(5))
    near = next(t for t in (f"{z} {prose(i, 1 + i % 8)}" for i in range(400)) if 0 < (slow_simhash(z) ^ slow_simhash(t)).bit_count() <= 3)
    data = [(None, lone, "a"), (None, copied, "a"), (None, copied, "b"), (5, x, "a"), (5, y, "a"), (3, y, "a"), (8, z, "a"), (None, near, "a")]
    frame = docs(spark, [(*r, 1, 2, 3, 4, 5, 6, "w") for r in data])
    kept = keep_one(frame)
    assert kept.columns == frame.columns and keep_one(empty(spark)).count() == 0
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == sorted([(-1, lone), (-1, copied), (5, x), (3, y), (8, z)])
    again = docs(spark, [(*r, 1, 2, 3, 4, 5, 6, "w") for r in [*data, (8, z, "b"), (8, z, "b"), (3, y, None)]])
    once = keep_one(again, repeats=False)
    assert once.columns == frame.columns and keep_one(empty(spark), repeats=False).count() == 0
    assert sorted((r["doc_id"] or -1, r["text"]) for r in once.collect()) == sorted([(-1, lone), (-1, copied), (5, x), (3, y), (8, z)])
    assert keep_one(again).where("doc_id = 8").count() == 3


@pytest.mark.parametrize("radius", [1, 3, 7])
def test_bit_sliced_pairs(radius):
    from lodestack.llm.simhash import near_pairs

    r = np.random.default_rng(radius)
    f = r.integers(0, 2**63, 700, dtype=np.uint64)
    for _ in range(3):
        f[:300] ^= np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)
        f[:300] = np.where(r.random(300) < 0.5, f[0], f[:300])
    group = np.r_[np.zeros(450, int), np.arange(250) // 3 + 1]
    got = {(int(a), int(b)) for x, y in near_pairs(f, group, radius, 500) for a, b in zip(x, y, strict=True)}
    assert got == {(i, j) for i in range(700) for j in range(i) if group[i] == group[j] and int(f[i] ^ f[j]).bit_count() <= radius}


def test_tiles_and_large_tables_lose_no_link(spark):
    from lodestack.llm.components import components
    from lodestack.llm.simhash import _masks, links, n_blocks

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) for b in base for _ in range(12)})
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    frame = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, first long")
    want = slow_components(list(range(len(fps))), fps, 3)
    roots = {x["node"]: x["root"] for x in components(links(frame, 3, tile=4)).collect()}
    assert {i: roots.get(i, i) for i in range(len(fps))} == want
    assert [len(_masks(b, 3)) for b in (4, 5, 6)] == [4, 10, 20] and n_blocks(10**6, 3) == 4 < n_blocks(10**9, 3) < n_blocks(10**12, 3)


def test_components_of_a_long_chain_a_star_and_loops(spark):
    from lodestack.llm.components import components

    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 240)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (101, 100)], "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 240)]}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- substring dedup ---------------------------------------------------------------------------------------------------------
def slow_removal(data, length):
    first = {}
    for i, t, _ in sorted((r for r in data if r[0] is not None), key=lambda r: r[0]):
        for g in grams(words(t), length):
            first.setdefault(g, i)
    for i, t, _ in data:
        w, gone = words(t), set()
        for k, g in enumerate(grams(w, length)):
            if i is not None and first[g] < i:
                gone.update(range(k, k + length))
        kept = [x for k, x in enumerate(w) if k not in gone]
        yield i or -1, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_substring_removal(spark):
    from lodestack.llm.substring import removal_digest

    got = sorted((r["doc_id"] or -1, *list(r)[1:]) for r in removal_digest(docs(spark), 50).collect())
    assert got == sorted(slow_removal(DATA, 50))
    assert removal_digest(empty(spark), 50).count() == 0


def test_substring_removal_of_overlapping_passages(spark):
    from lodestack.llm.substring import removal_digest

    r = random.Random(5)
    pool = [prose(i, 90, 10**6).split() for i in range(6)]
    data = []
    for i in range(60):
        parts = []
        for _ in range(3):
            p = r.choice(pool)
            a = r.randrange(40)
            q = p[a : a + r.randrange(30, 90)]
            if r.random() < 0.3:
                q = [*q[:10], "edit", *q[11:]]
            parts += q + ["x"] * r.randrange(3)
        data.append((r.randrange(1, 50), " ".join(parts), "a"))
    data.append((60, "u " * 300, "a"))
    data.append((61, "u " * 120 + "v " * 70, "a"))
    frame = spark.createDataFrame([(*x, 1, 2, 3, 4, 5, 6, "w") for x in data], DDL).repartition(5)
    got = sorted(tuple(x) for x in removal_digest(frame, 50).collect())
    assert got == sorted(slow_removal(data, 50))
    assert sum(x[2] for x in got) > 1000


def test_substring_removal_of_windows_across_a_seam(spark):
    """A and C cover B between them, but not the windows across the seam, which D repeats."""
    from lodestack.llm.substring import removal_digest

    data = []
    for i in range(1, 21):
        w = prose(100 + i, 75, 10**6).split()
        data += [(4 * i + k, " ".join(x), "a") for k, x in enumerate((w[:60], w[15:], w, w[12:62]))]
    frame = spark.createDataFrame([(*x, 1, 2, 3, 4, 5, 6, "w") for x in data], DDL).repartition(5)
    got = sorted(tuple(x) for x in removal_digest(frame, 50).collect())
    assert got == sorted(slow_removal(data, 50))
    assert [x[2] for x in got if x[0] % 4 == 3] == [50] * 20


def test_substring_removal_of_a_hot_passage(spark):
    """A passage with many continuations is one anchor's: split by window (heavy) or not, the spans are the same."""
    from lodestack.llm.substring import removal_digest

    hot = prose(7, 70, 10**6)
    data = [(i + 1, f"{prose(200 + i, 3 + i % 40, 10**6)} {hot} {prose(300 + i % 90, 60, 10**6)}", "a") for i in range(120)]
    data += [(1 + i % 50, f"{hot} {hot}", "a") for i in range(60)]
    frame = spark.createDataFrame([(*x, 1, 2, 3, 4, 5, 6, "w") for x in data], DDL).repartition(6)
    want = sorted(slow_removal(data, 50))
    for heavy in (1, 2000, 10**9):
        assert sorted(tuple(x) for x in removal_digest(frame, 50, heavy).collect()) == want


def test_remove_repeats_keeps_other_texts_and_columns(spark):
    from lodestack.llm.substring import remove_repeats

    frame = docs(spark)
    out = remove_repeats(frame, 50)
    assert out.columns == frame.columns and out.count() == frame.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[12] == "  \n\t " and texts[10] is None and texts[21] == "before after it"


def test_suffix_automaton():
    from lodestack.llm.substring import SuffixAutomaton

    r = random.Random(2)
    for _ in range(60):
        a, b = ([r.randrange(3) for _ in range(25)] for _ in range(2))
        m = SuffixAutomaton()
        for x in a:
            m.add(x)
        covered = {k for s, e in m.spans(b, 4) for k in range(s, e)}
        known = set(grams(a, 4))
        assert covered == {k for i, g in enumerate(grams(b, 4)) if g in known for k in range(i, i + 4)}


# -- BPE -----------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_bpe_equals_the_library(spark, vocabulary):
    from lodestack.llm.bpe import decode, digests, encode
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    want = sorted(((i or -1, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in DATA))
    encoded = encode(docs(spark), vocabulary)
    assert sorted((r["doc_id"] or -1, tuple(r["ids"])) for r in encoded.collect()) == want
    back = sorted((r["doc_id"] or -1, r["text"]) for r in decode(encoded, vocabulary).collect())
    assert back == sorted((i or -1, t or "") for i, t, _ in DATA)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    digest = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests(docs(spark), vocabulary).collect())
    assert digest == sorted((i, len(x), sha(",".join(map(str, x))), sha(library.decode(list(x), skip_special_tokens=False))) for i, x in want)
    assert encode(empty(spark), vocabulary).count() == 0


def test_bpe_trees_agree_on_random_pieces(vocabulary):
    from lodestack.llm.bpe import BpeTokenizer, merge_one
    from tokenizers import Tokenizer

    own, library, r = BpeTokenizer(vocabulary, kept=50), Tokenizer.from_file(vocabulary), random.Random(4)
    texts = ["".join(r.choice("abcdeé ß漢\U0001f600 '\n\t\xa0\x1c.,0½") for _ in range(r.randrange(90))) for _ in range(400)] + ["ab" * 3000]
    got = list(own.encode(texts))
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(x) for x in got] == texts
    piece = "abababcdcdcd" * 5
    assert merge_one(own.first[list(piece.encode())].tolist(), own.merges) == library.encode(piece).ids


# -- licenses -------------------------------------------------------------------------------------------------------------------
def test_license_scan(spark):
    from lodestack.llm import licenses

    mit = dict((n, t) for n, _, t in licenses.TEMPLATES)["mit-grant"]
    half = " ".join(mit.split()[:14])
    edited = " ".join(mit.split()[:27] + ["changed"])
    data = [(1, prose(1, 300) + " " + mit + " " + prose(2, 40)), (2, half), (3, edited), (4, None), (5, "Released under the\n*MIT* license"), (6, "released under"), (1, mit.upper()), (None, mit), (7, prose(9, 5000) + "\nLicensed under CC BY-NC 4.0.\n" + prose(8, 50))]
    frame = spark.createDataFrame([(i, t, "a", 1, 2, 3, 4, 5, 6, "w") for i, t in data], DDL)
    got = sorted((str(r["doc_id"]), r["template"], round(r["containment"], 3)) for r in licenses.scan(frame).collect())
    n = len(licenses.words_of_template(mit)) - 4
    assert got == [("1", "mit-grant", 1.0), ("3", "mit-grant", round((len(licenses.words_of_template(" ".join(mit.split()[:27]))) - 4) / n, 3)), ("5", "mit-notice", 1.0), ("7", "cc-by-nc-4-notice", 1.0), ("None", "mit-grant", 1.0)]
    assert licenses.scan(empty(spark)).count() == 0
    assert (1 - 1 / 6) ** licenses.bands_for(licenses.TEMPLATES, 0.8, 1e-6) <= 1e-6


def test_license_with_inserted_words_at_every_offset(spark):
    from lodestack.llm import licenses

    mit = licenses.words_of_template(dict((n, t) for n, _, t in licenses.TEMPLATES)["mit-grant"])
    n, data, want = len(mit), [], []
    for inserted in (0, 4, 10, 20, 500):
        for offset in range(n):
            i = len(data)
            data.append((i, " ".join([f"a{k}" for k in range(offset)] + mit[: n // 2] + [f"b{k}" for k in range(inserted)] + mit[n // 2 :] + ["end"] * 70)))
            want.append((i, "mit-grant", round(1 - 4 * (inserted > 0) / (n - 4), 6), offset, n + inserted))
    data.append((len(data), " ".join(mit + ["then"] * 9 + mit[: n // 2] + ["b"] + mit[n // 2 :])))
    want.append((len(want), "mit-grant", 1.0, 0, n))
    data += [(-1, " ".join(mit[: n // 2])), (-1, " ".join(mit[n // 2 :]))]  # rows of one id do not add up
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = licenses.scan(frame).collect()
    assert sorted((r["doc_id"], r["template"], round(r["containment"], 6), r["first_word"], r["n_words"]) for r in got) == want


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_license_many_templates(spark, monkeypatch, rows):
    """Hundreds of templates of many lengths that share a passage, broadcast and shuffled: rows as by brute force."""
    from lodestack.llm import licenses

    monkeypatch.setattr(licenses, "BROADCAST_ROWS", rows)
    r = random.Random(10)
    common = prose(99, 12, 5000)
    templates = [(f"t{i}", f"L{i // 3}", f"{prose(i, r.randrange(5, 240), 5000)} {common} {prose(1000 + i, r.randrange(1, 30), 5000)}") for i in range(300)]
    texts = [prose(5000 + i, r.randrange(300), 5000) for i in range(60)]
    data = []
    for i, text in enumerate(texts):
        inside = [templates[r.randrange(300)][2].split() for _ in range(r.randrange(3))]
        for w in inside:
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = "changed"
        data.append((i if i % 7 else None, " ".join([text, *(" ".join(w) + " " + prose(7000 + i, 9, 5000) for w in inside)])))
    data += [(1, common), (2, common * 50), (3, None), data[5], data[5]]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    told = {n: set(grams(licenses.words_of_template(t))) for n, _, t in templates}
    want = {}
    for i, t in data:
        have = set(grams(licenses.words_of_template(t or "")))
        for n, shingles in told.items():
            if len(have & shingles) >= 0.8 * len(shingles):
                want[i, n] = max(want.get((i, n), 0), len(have & shingles) / len(shingles))
    got = licenses.scan(spark.createDataFrame(data, "doc_id long, text string").repartition(3), tuple(templates)).collect()
    assert len(want) > 30 and {(x["doc_id"], x["template"]): x["containment"] for x in got} == pytest.approx(want) and len(got) == len(want)
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame(data, "doc_id long, text string"), (templates[0], templates[0]))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_license_query_against_brute_force(spark):
    from lodestack.llm import licenses, queries

    sf = "/root/testdata/sf0.01"
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    templates = {n: set(grams(licenses.words_of_template(t))) for n, _, t in licenses.TEMPLATES}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        have = set(grams(licenses.words_of_template(r["text"] or "")))
        want |= {(r["doc_id"], n): len(have & t) / len(t) for n, t in templates.items() if len(have & t) >= 0.8 * len(t)}
    got = {(r["doc_id"], r["template"]): r["containment"] for r in queries.QUERIES["op10_license_scan"](spark, sf).collect()}
    assert want and got == pytest.approx(want)
