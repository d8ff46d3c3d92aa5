"""Ways to answer with less work, against the plain ways: grid, quantised scan, name index, summaries; and documents' states."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions.text import iso_timestamp
from lodestack.operators import context, graph, health, vectors
from lodestack.operators.chunking import ChunkingConfig
from lodestack.plans.engine import Engine
from lodestack.schema import Scope
from lodestack.streaming.jobs import run_available
from lodestack.streaming.states import MOVES, state_store, status_moves


def table(spark, n=400, dims=6, seed=1):
    r = np.random.default_rng(seed)
    rows = [(i, r.integers(-3, 4, dims).astype(float).tolist()) for i in range(n)]  # many ties
    odd = [(9000, None), (9001, [1.0] * (dims - 1)), (9002, [0.0] * dims), (9003, [float("nan")] * dims), (9004, [])]
    return spark.createDataFrame(rows + odd, "vector_id long, vector array<float>").repartition(3), rows


def test_grid_of_queries_equals_brute_force(spark):
    frame, rows = table(spark)
    asked = frame.where("vector_id % 7 = 0 or vector_id > 9000").select(F.col("vector_id").alias("query_id"), "vector")
    got = {}
    for options in ({}, {"block": 9, "cell_bytes": 3000}, {"block": 30}):
        found = vectors.batch_top_k(frame, asked, 4, exclude_own=True, **options).collect()
        got[str(options)] = sorted((r["query_id"], r["rank"], r["vector_id"], round(r["similarity"], 9)) for r in found)
    assert len(set(map(str, got.values()))) == 1
    m = np.array([v for _, v in rows])
    unit = m / np.where(n := np.linalg.norm(m, axis=1, keepdims=True), n, 1)
    by_query = {}
    for q, rank, i, s in got["{}"]:
        by_query.setdefault(q, []).append((rank, i, s))
    for q in (0, 7, 203):
        s = unit @ unit[q]
        others = [(i, float(s[i])) for i in range(len(rows)) if i != q] + [(i, 0.0) for i in (9001, 9002, 9003, 9004)]
        best = sorted(others, key=lambda x: (-round(x[1], 12), x[0]))[:4]
        assert [(i, round(max(0.0, min(1.0, s)), 9)) for i, s in best] == [(i, s) for _, i, s in sorted(by_query[q])]
    assert vectors.batch_top_k(frame, asked.where("query_id < 0"), 4).count() == 0 and vectors.batch_top_k(frame.where("vector_id < 0"), asked, 4, block=5).count() == 0


def test_grid_reads_no_rows_on_the_driver(spark, monkeypatch):
    frame, _ = table(spark)
    asked = frame.select(F.col("vector_id").alias("query_id"), "vector")
    for name in ("toLocalIterator", "toArrow", "toPandas"):
        monkeypatch.setattr(type(frame), name, lambda *a, **k: 1 / 0)
    assert "FlatMapCoGroupsInArrow" in vectors.batch_top_k(frame, asked, 3, block=50)._jdf.queryExecution().toString()


def test_overfetch_finds_the_nearest(spark, tmp_path):
    r = np.random.default_rng(3)
    v = spark.createDataFrame([(i, r.normal(size=32).tolist()) for i in range(2000)], "vector_id long, vector array<float>")
    v.withColumn("code", vectors.quantised(F.col("vector"))).write.parquet(f"{tmp_path}/v")
    coded = spark.read.parquet(f"{tmp_path}/v")
    hits = 0
    for seed in range(20):
        q = np.random.default_rng(100 + seed).normal(size=32).tolist()
        exact = [(x["vector_id"], round(x["similarity"], 12)) for x in vectors.top_k(coded, q, 10).collect()]
        found = [(x["vector_id"], round(x["similarity"], 12)) for x in vectors.top_k_overfetched(coded, q, 10).collect()]
        hits += len(set(exact) & set(found))
    assert hits >= 0.99 * 200
    plan = coded.select("vector_id", "code")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vector_id:bigint,code:array<tinyint>>" in plan
    scan = vectors.top_k(coded, q, 40, None, 0.0, "vector_id", "code").select("vector_id")._jdf.queryExecution().executedPlan().toString()
    assert "vector:array" not in scan and "code:array<tinyint>" in scan


def test_quantised_vectors_without_direction(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([],), (None,), ([1e-30, -2e-30],), ([None, 3.0],)], "v array<float>")
    assert [r[0] for r in rows.select(vectors.quantised(F.col("v"))).collect()] == [[0, 0], [], None, [64, -127], [0, 127]]


def test_names_by_index_equal_a_scan(spark):
    r = random.Random(5)
    names = ["".join(r.choice("abc é") for _ in range(r.randrange(0, 9))) for _ in range(300)] + [None, "", "ab", "a%b_c", "aaaa"]
    entities = spark.createDataFrame([(f"e{i}", n) for i, n in enumerate(names)], "id string, normalized_name string").repartition(3)
    postings = graph.name_postings(entities).cache()
    assert postings.where("length(gram) <> 3").count() == 0
    for wanted in (["abc"], ["abca", "bé"], ["", "  "], ["zzz"], ["aaaa"], ["%b_"], ["c a", "c a", "é"], []):
        got = sorted(x["id"] for x in graph.seeds_of_names_indexed(entities, postings, wanted).collect())
        assert got == sorted(f"e{i}" for i, n in enumerate(names) if n and any(w in n for w in wanted if w.strip()))


def test_summaries_equal_a_recount_after_changes(spark, tmp_path):
    engine, r = Engine(spark, f"file://{tmp_path}/store"), random.Random(2)
    scopes = [Scope("t", "a"), Scope("u", "a", "c")]
    for step in range(7):
        scope, name = r.choice(scopes), f"d{r.randrange(3)}"
        if step % 3 == 2:
            engine.delete(name, scope)
        else:
            text = " ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(5, 90)))
            engine.ingest(spark.createDataFrame([(name, f"{name}.txt", ".txt", text.encode())], "document_id string, filename string, extension string, content binary"), scope, ChunkingConfig(strategy=r.choice(["sliding_window", "parent_child"]), max_tokens=10, overlap_tokens=2, parent_max_tokens=20))
        if step == 4:
            engine.compact(least=2)
    rows = lambda f: sorted(map(tuple, f.collect()), key=repr)
    for scope in scopes:
        nodes, v = engine.table("nodes").where(scope.of_graph()), engine.table("vectors").where(scope.of_vectors())
        chunks = nodes.where("kind = 'chunk'").withColumn("is_embeddable", F.col("properties")["is_embeddable"] == "true")
        assert rows(engine.chunk_stats(scope)) == rows(health.chunk_stats(chunks)) and rows(engine.node_counts(scope)) == rows(nodes.groupBy("kind").count())
        assert rows(engine.embedded_counts(scope)) == rows(v.groupBy("document_id", "embedding_profile_id", "embedding_model", "vector_dimension").count())
    assert "/nodes-summary/" in str(engine.chunk_stats(scopes[0]).inputFiles()) and "/nodes/" not in str(engine.chunk_stats(scopes[0]).inputFiles())


def test_hops_over_bucketed_links_shuffle_no_links(spark):
    r = random.Random(7)
    pairs = {(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(70)}
    edges = spark.createDataFrame([(a, b, "SEMANTIC_RELATION", "USES", "", 1.0) for a, b in pairs] + [("n1", "n2", "MENTIONED_IN", "", "", None)], "src string, dst string, relation string, kind string, description string, confidence double")
    inside = spark.createDataFrame([(f"n{i}",) for i in range(50)], "id string")
    seeds = spark.createDataFrame([("n1",), ("n7",), ("none",)], "id string")
    rows = lambda f: sorted(map(tuple, f.collect()))
    for scope in (None, inside):
        links = graph.adjacency(edges, 4, scope)
        assert rows(graph.traverse(None, seeds, 4, adjacent=links)) == rows(graph.traverse(edges, seeds, 4, scope))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        plan = links.join(seeds.select(F.col("id").alias("a")), "a")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the seeds' own


# -- sinks ---------------------------------------------------------------------------------------------------------------------
def usage_events(spark, *rows):
    return spark.createDataFrame(rows, "event_id string, tenant_id string, app_id string, total_tokens long, other string")


def test_usage_events_count_once(spark, tmp_path, monkeypatch):
    engine, scope = Engine(spark, f"file://{tmp_path}/store"), Scope("t", "a")
    assert engine.record_usage(usage_events(spark, ("1", "t", "a", 5, "x"), ("1", "t", "a", 5, "x"), ("2", "t", "b", 7, "x"), (None, "t", "a", 9, "x"))) == 2
    assert engine.record_usage(usage_events(spark, ("1", "t", "a", 5, "x"), ("2", "t", "b", 7, "x"))) == 0 and engine.versions() == [1]
    with monkeypatch.context() as m:
        m.setattr(engine, "_publish", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            engine.record_usage(usage_events(spark, ("3", "t", "a", 1, "x")))
    assert engine.table("usage").count() == 2
    publish, raced = engine._publish, []

    def race(base, **changed):  # another writer comes first, once
        if not raced:
            raced.append(Engine(spark, engine.root).record_usage(usage_events(spark, ("3", "t", "a", 1, "x"))))
        publish(base, **changed)

    monkeypatch.setattr(engine, "_publish", race)
    assert engine.record_usage(usage_events(spark, ("3", "t", "a", 1, "x"), ("4", "t", "a", 2, "x"))) == 1
    assert sorted((r["event_id"], r["total_tokens"]) for r in engine.usage(scope).collect()) == [("1", 5), ("3", 1), ("4", 2)]


def test_sinks_are_chosen_and_count(spark, tmp_path):
    engine, scope = Engine(spark, f"file://{tmp_path}/store"), Scope("t", "a")
    files = spark.createDataFrame([("d", "d.txt", ".txt", b"Owls hunt mice.")], "document_id string, filename string, extension string, content binary")
    counts = lambda: [engine.table(n).count() for n in ("nodes", "vectors")]
    reports = [engine.ingest(files, scope, sinks=sinks).first() for sinks in ((), ("vectors",), ("graph", "vectors"))]
    told = [(r["graph_records"], r["vector_records"]) for r in reports]
    assert len(set(told)) == 1 and told[0][1] == 1 and engine.versions() == [1, 2]
    assert counts()[1] == 1 and counts()[0] > 1
    engine2 = Engine(spark, f"file://{tmp_path}/other")
    engine2.ingest(files, scope, sinks=("vectors",))
    assert engine2.table("nodes").count() == 0 and engine2.table("vectors").count() == 1
    with pytest.raises(KeyError):
        engine.ingest(files, scope, sinks=("mail",))


def test_blocks_of_retrieval_tell_scores_and_neighbours(spark, tmp_path):
    engine, scope = Engine(spark, f"file://{tmp_path}/store"), Scope("t", "a")
    text = "Owls hunt mice in the orchard at night. " * 3 + "Tides turn every six hours on the coast. " * 3
    engine.ingest(spark.createDataFrame([("d", "d.txt", ".txt", text.encode())], "document_id string, filename string, extension string, content binary"), scope, ChunkingConfig(strategy="parent_child", max_tokens=8, overlap_tokens=0, parent_max_tokens=24))
    blocks = engine.retrieve("owls hunt mice", scope, 2).collect()
    by_source = {b["source"]: b for b in reversed(blocks)}  # the first of each
    assert 0 < by_source["vector"]["score"] <= 1 and by_source["graph_parent"]["score"] == 1.0
    assert json.loads(by_source["vector"]["metadata"])["chunk_role"] == "child"
    around = json.loads(by_source["graph_parent"]["metadata"])
    assert around["document_id"] == "d" and around["element_ids"] and ("next_chunk_id" in around or "previous_chunk_id" in around)


# -- states -------------------------------------------------------------------------------------------------------------------
def test_states_refuse_moves_survive_restarts_and_end_when_stuck(spark, tmp_path):
    def put(*rows):
        frame = spark.createDataFrame(rows, "document_id string, t string, seq long, status string")
        frame.select("document_id", F.to_timestamp("t").alias("at"), "seq", "status").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema("document_id string, at timestamp, seq long, status string").parquet(f"{tmp_path}/in")
        with state_store(spark):
            run_available(status_moves(stream, stuck_s=3600, late="0 seconds"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        return sorted((r["document_id"], str(r["at"])[11:], r["was"], r["status"], r["accepted"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put(("a", "2024-01-01 00:00:02", 3, "indexing"), ("a", "2024-01-01 00:00:00", 1, "uploaded"), ("a", "2024-01-01 00:00:01", 2, "ready"), ("b", "2024-01-01 00:00:00", 4, "indexing"), (None, "2024-01-01 00:00:00", 5, "ready"))
    want = [("a", "00:00:00", None, "uploaded", True, None), ("a", "00:00:01", "uploaded", "ready", False, "uploaded may not become ready"), ("a", "00:00:02", "uploaded", "indexing", True, None), ("b", "00:00:00", None, "indexing", True, None)]
    assert run() == sorted(want, key=str)
    put(("a", "2024-01-01 00:10:00", 6, "ready"), ("a", "2024-01-01 00:11:00", 7, "odd"), ("c", "2024-01-02 00:00:00", 8, "ready"))
    want += [("a", "00:10:00", "indexing", "ready", True, None), ("a", "00:11:00", "ready", "odd", False, "unknown status"), ("b", "01:00:00", "indexing", "failed", True, "stuck"), ("c", "00:00:00", None, "ready", False, "None may not become ready")]
    assert sorted(run(), key=str) == sorted(want, key=str)
    assert all(b in MOVES for to in MOVES.values() for b in to)


# -- small functions --------------------------------------------------------------------------------------------------------
def test_chunk_metadata_overrides(spark):
    kind = "chunk_id string, document_id string, chunk_index long, text string, is_embeddable boolean, boundary_type string, boundary_value string, chunk_role string, parent_chunk_id string, section_index long, strategy string, token_count long, metadata string"
    rows = [("c1", "d", 0, "x", True, "page", "1", "window", None, 0, "s", 3, '{"strategy": "mine", "page": "7"}'), ("c2", "d", 1, "y", True, "page", "1", "window", None, 0, "s", 3, None)]
    told = {r["chunk_id"]: json.loads(r["metadata"]) for r in vectors.records(spark.createDataFrame(rows, kind), Scope("t", "a")).collect()}
    assert (told["c1"]["strategy"], told["c1"]["page"], told["c1"]["chunk_role"]) == ("mine", "7", "window") and told["c2"]["strategy"] == "s"


@pytest.mark.parametrize("said, want", [("2024-01-02T03:04:05Z", 1704164645), ("2024-01-02T03:04:05.25z", 1704164645), ("2024-01-02T05:04:05+02:00", 1704164645), ("2024-01-02 03:04:05", 1704164645), ("soon", None), ("", None), (None, None)])
def test_iso_timestamps(spark, said, want):
    assert spark.range(1).select(F.unix_timestamp(iso_timestamp(F.lit(said).cast("string")))).first()[0] == want


def test_contexts_of_matches_and_lists(spark):
    m = spark.createDataFrame([("c1", 1), ("c2", 2)], "chunk_id string, rank int")
    c = spark.createDataFrame([("c1", "b", 1), ("c1", "a", 2), ("c9", "z", 3)], "chunk_id string, text string, n int")
    assert sorted(map(tuple, context.with_contexts(m, c).select("chunk_id", "rank", "text", "n").collect())) == [("c1", 1, "a", 2), ("c2", 2, None, None)]
    x, y = F.array(*map(F.lit, (3, 1, 3, 2))), F.array(F.lit(1))
    none = F.lit(None).cast("array<int>")
    assert list(spark.range(1).select(context.list_difference(x, y), context.list_intersection(x, y), context.list_difference(x, none), context.list_difference(none, x)).first()) == [[3, 2], [1], [3, 1, 2], []]


def test_nodes_by_kind_ids_and_properties(spark):
    n = spark.createDataFrame([("1", "entity", {"a": "x"}), ("2", "entity", {"a": "y", "b": "z"}), ("3", "chunk", None)], "id string, kind string, properties map<string,string>")
    got = lambda **k: sorted(r["id"] for r in graph.scan_nodes(n, **k).collect())
    assert got() == ["1", "2", "3"] and got(kind="entity", equals={"a": "y"}) == ["2"] and got(ids=["1", "9"]) == ["1"] and got(ids=[]) == [] and got(equals={"b": "z", "a": "x"}) == []


# -- chunking and embedding against brute force -----------------------------------------------------------------------------
def test_semantic_chunks_equal_brute_force(spark, sf):
    """On the smallest tables: sections split into sentences, neighbours embedded, cut at the percentile of the section's distances."""
    import re

    from lodestack.functions.embedding import HashingEmbedder
    from lodestack.operators import chunking
    from lodestack.plans import corpus

    embedder, config = HashingEmbedder(64), ChunkingConfig(strategy="semantic", percentile=80)
    elements = corpus.elements(spark, sf).where("document_id < '2'").cache()
    want = []
    for r in chunking.section_texts(elements).collect():
        said = re.split(r"(?<=[.!?])\s+", " ".join(r["text"].split()))
        units = [" ".join(said[max(0, i - 1) : i + 2]) for i in range(len(said))]
        v = np.array(embedder.embed(units))
        gaps = [1 - float(a @ b) if a.any() and b.any() else 1.0 for a, b in zip(v, v[1:])]
        edge = float(np.percentile(gaps, 80)) if gaps else 0.0
        groups = [[said[0]]]
        for s, g in zip(said[1:], gaps):
            if g > edge + 1e-9:
                groups.append([s])
            elif g > edge - 1e-9 and g != edge:
                groups = None  # too close to tell
                break
            else:
                groups[-1].append(s)
        want.append((r["document_id"], r["section_index"], groups and [" ".join(g) for g in groups]))
    got = {}
    for r in chunking.semantic(elements, config, embedder).orderBy("document_id", "chunk_index").collect():
        got.setdefault((r["document_id"], r["section_index"]), []).append(r["text"])
    clear = [(d, s, g) for d, s, g in want if g]
    assert len(clear) > 0.9 * len(want) > 50 and all(got[d, s] == g for d, s, g in clear)


def test_sentence_windows_of_whole_tables(spark, sf):
    """Every window is whole sentences within the budget, the next begins with at most the overlap of it, and no sentence is lost."""
    from lodestack.operators import chunking
    from lodestack.plans import corpus

    elements = corpus.elements(spark, sf)
    rows = chunking.sliding(elements, ChunkingConfig(max_tokens=60, overlap_tokens=20, sentences=True)).orderBy("document_id", "chunk_index").collect()
    of_section = {}
    for r in rows:
        of_section.setdefault((r["document_id"], r["section_index"]), []).append(r["text"])
    texts = {(r["document_id"], r["section_index"]): r["text"] for r in chunking.section_texts(elements).collect()}
    assert of_section.keys() == {k for k, t in texts.items() if t.split()}
    for key, windows in of_section.items():
        words, ends = texts[key].split(), {0}  # where a window may end: repetitive texts leave several places
        for w in windows:
            own = w.split()
            assert len(own) <= 60
            ends = {k + len(own) for at in ends for k in range(max(0, at - 20), at + 1) if words[k : k + len(own)] == own and k + len(own) > at}
        assert len(words) in ends, key


def test_documents_and_queries_are_embedded_by_task(spark, tmp_path):
    from lodestack.functions.embedding import DOCUMENT, QUERY, HashingEmbedder, checked

    class Tasked(HashingEmbedder):
        by_task = True

        def embed(self, texts, task):
            return super().embed([t if task == DOCUMENT else t.replace("ask", "owls") for t in texts])

    provider = Tasked(32)
    assert checked(provider, ["ask"]) != checked(provider, ["ask"], QUERY) and checked(HashingEmbedder(32), ["ask"]) == checked(HashingEmbedder(32), ["ask"], QUERY)
    engine, scope = Engine(spark, f"file://{tmp_path}/store", provider), Scope("t", "a")
    engine.ingest(spark.createDataFrame([(n, f"{n}.txt", ".txt", t.encode()) for n, t in (("d", "owls"), ("e", "ask"))], "document_id string, filename string, extension string, content binary"), scope, ChunkingConfig(strategy="sliding_window"))
    assert engine.search("ask", scope, 1).first()["text"] == "owls"
