"""Every query of the engine against its SQL twin in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from lodestack import catalog
from lodestack.functions.embedding import HashingEmbedder
from lodestack.plans import corpus

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    frame = catalog.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        return
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_extraction_parses_every_word(spark, sf):
    got = {r["document_id"]: (r["n_entities"], r["n_relations"]) for r in catalog.QUERIES["s16_extraction"](spark, sf).collect()}
    texts = {str(r["doc_id"]): (r["text"] or "").split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got == {i: (len(w), max(0, len(w) - 1)) for i, w in texts.items()}
    assert max(n for n, _ in got.values()) > 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_hybrid_against_brute_force(spark, sf):
    embedder = HashingEmbedder(64)
    chunks = {r["chunk_id"]: r for r in corpus.chunks(spark, sf).collect()}
    told = {i: r["text"].lower().split() for i, r in chunks.items()}
    pair = {i: (max(w, key=len), w[-1]) for i, w in told.items() if w}  # max() takes the first of the longest
    wanted = min(spark.read.parquet(f"{sf}/benchmark.parquet").collect(), key=lambda r: r["item_id"])["text"]
    query = np.array(embedder.embed([wanted])[0])
    near = {i: float(np.dot(embedder.embed([r["text"]])[0], query)) for i, r in chunks.items()}
    found = sorted(chunks, key=lambda i: (-round(near[i], 9), f"t:a::chunk:{i}"))[:20]
    seeds = {w for i in found for w in pair.get(i, ())}
    reached = seeds | {w for p in pair.values() if set(p) & seeds for w in p}
    related = {i for i, p in pair.items() if set(p) & reached}
    want = {i: (2, 0) for i in related} | {i: (1, n + 1) for n, i in enumerate(found)}
    following = {}
    for r in sorted(chunks.values(), key=lambda r: (r["document_id"], r["chunk_index"])):
        following.setdefault(r["document_id"], []).append(r["chunk_id"])
    after = {a: b for ids in following.values() for a, b in zip(ids, ids[1:])}
    got = catalog.QUERIES["j15_hybrid_retrieval"](spark, sf).collect()
    assert len(got) == len(want) > 20 and len(want) < len(chunks)
    place = lambda r: (r["document_id"], r["chunk_index"], r["next_chunk_id"])
    assert {r["chunk_id"]: (r["part"], *place(r)) for r in got} == {i: (part, chunks[i]["document_id"], chunks[i]["chunk_index"], after.get(i)) for i, (part, _) in want.items()}
    ranked = sorted((r["rank"], near[r["chunk_id"]]) for r in got if r["part"] == 1)
    assert [n for n, _ in ranked] == list(range(1, 21))
    assert all(a >= b - 1e-9 for (_, a), (_, b) in zip(ranked, ranked[1:]))  # sums may differ in the last digit
