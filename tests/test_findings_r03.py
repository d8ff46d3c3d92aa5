"""What the findings of round 3 say, on small inputs."""

import base64
import hashlib
import json

import pyarrow as pa
from pyspark.sql import functions as F

from lodestack.functions.embedding import HashingEmbedder
from lodestack.functions.model_output import extracted
from lodestack.functions.text import at_most_tokens, collapse, token_count
from lodestack.operators import chunking, graph
from lodestack.operators.chunking import dedupe
from lodestack.operators.vectors import batch_top_k
from lodestack.plans import corpus
from lodestack.sources import files, parsers
from lodestack.storage import written


def test_media_urls_hold_no_line_ends(spark):
    content = bytes(range(200))
    got = spark.createDataFrame([(bytearray(content),)], "c binary").select(files.media_url(F.lit("a.png"), F.lit(None).cast("string"), F.col("c"))).first()[0]
    assert got == "data:image/png;base64," + base64.b64encode(content).decode()


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_reply_is_read_in_one_pass_for_each_array(spark):
    raw = '```json\n{"entities": [{"id": "a", "type": "concept", "name": " A "}, 5, {"id": "a", "type": "task", "name": "again"}, {"id": {"x": 1}, "type": "task", "name": "b"}, {"id": "c", "type": "Task", "name": "C"}], "relations": [{"from_id": "a", "to_id": "c", "type": "uses", "confidence": "7"}, "x", {"source_id": "a", "target_id": "c", "type": "USES"}, {"from_id": "a", "to_id": "?", "type": "uses"}]}\n```'
    read = extracted(spark.createDataFrame([("d", raw), ("e", "[1]")], "document_id string, raw string"), into="x")
    assert "schema_of_variant" not in plan_of(read) and plan_of(read).count("variant_get") == 2
    got = {r["document_id"]: r["x"] for r in read.collect()}
    assert [(e["local_id"], e["entity_type"], e["name"], e["normalized_name"]) for e in got["d"]["entities"]][0] == ("a", "Concept", "A", "a")
    assert ("c", "Task", "C") in [(e["local_id"], e["entity_type"], e["name"]) for e in got["d"]["entities"]] and "again" not in str(got["d"])
    assert [(r["source_id"], r["target_id"], r["confidence"]) for r in got["d"]["relations"]] == [("a", "c", 1.0)]
    assert got["d"]["warning"] is None and got["e"]["warning"] and got["e"]["entities"] == []


def test_the_first_of_equal_chunks_of_a_document_is_found_in_one_pass(spark):
    rows = [("a", "a:0", 0, "h", True), ("a", "a:1", 1, "h", True), ("a", "a:2", 2, "h", False), ("a", "a:3", 3, "g", True), ("b", "b:0", 0, "h", True), ("b", "b:1", 1, "g", False), ("b", "b:2", 2, "g", False)]
    kept = dedupe(spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index long, content_hash string, is_embeddable boolean"))
    assert "Join" not in plan_of(kept) and "Union" not in plan_of(kept)
    assert sorted(r["chunk_id"] for r in kept.collect()) == ["a:0", "a:2", "a:3", "b:0", "b:1", "b:2"]


def test_edges_are_built_without_nodes(spark, sf):
    corpus._BUILT.clear()
    edges = corpus.graph_edges(spark, sf)
    assert sorted(name for _, _, name in corpus._BUILT) == ["chunks", "edges"]
    assert edges.count() == edges.select("src", "dst", "relation", "kind").distinct().count() > 0


def test_small_files_share_a_batch(spark, monkeypatch):
    made = []
    rows = [("a", ".txt", b"one\n\ntwo"), ("b", ".txt", b"three"), ("c", ".json", b'{"b": 1}')]

    class Files:
        """What parse_files asks of a frame: its function is run here, on one batch."""

        def selectExpr(self, *names):
            return self

        def mapInArrow(self, work, schema):
            made.extend(work(iter([pa.RecordBatch.from_pylist([dict(zip(("document_id", "extension", "content"), r)) for r in rows])])))

    parsers.parse_files(Files())
    assert len(made) == 1 and made[0].column("document_id").to_pylist() == ["a", "a", "b", "c"]
    monkeypatch.setattr(parsers, "ROWS", 1)
    made.clear()
    parsers.parse_files(Files())
    assert [b.num_rows for b in made] == [2, 1, 1]


def test_vectors_are_copied_once_for_many_blocks_of_queries(spark):
    rows = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(200)], "vector_id long, vector array<double>")
    found = batch_top_k(rows, rows.select(F.col("vector_id").alias("query_id"), "vector"), 3, block=10)
    assert "sequence(0, 19" not in plan_of(found) and "sequence(0, 0" in found._jdf.queryExecution().logical().toString()
    once = batch_top_k(rows, rows.select(F.col("vector_id").alias("query_id"), "vector"), 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, once.collect()))


def test_sections_are_found_by_one_sort(spark, sf):
    plan = chunking.sections(corpus.elements(spark, sf))._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Sort [") == 2  # one numbers the elements, one is for all of the sections


def test_white_space_is_collapsed_once_a_text(spark):
    cut = spark.createDataFrame([("a",)], "t string").select(chunking.windows(F.col("t"), 3, 1).alias("w"))
    assert plan_of(cut).count("regexp_replace") == 1
    said = ["", " ", "a", " a\tb ", "a b  c", "a\u00a0b\u3000 c\x0bd", "\n a \n\n b\r\nc d e f ", "x" * 9, "a b c d", "a b c\u2003"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", collapse(F.col("t")).alias("c"), token_count(F.col("t")).alias("n"), at_most_tokens(F.col("t"), 3).alias("few"), chunking.windows(F.col("t"), 3, 1).alias("w")).orderBy("i").collect()
    for text, row in zip(said, got, strict=True):
        words = text.split()
        want = [" ".join(words[k : k + 3]) for k in range(0, max(1, len(words) - 1), 2)] if words else []
        assert (row["c"], row["n"], row["few"], row["w"]) == (" ".join(words), len(words), len(words) <= 3, want), text


def test_chunks_are_read_once_for_their_counts(spark, sf):
    from lodestack import catalog

    assert plan_of(catalog.QUERIES["c14_bundle_stats"](spark, sf)).count("Generate posexplode") == 3  # lines for elements, lines and windows for chunks
    rows = [("a", "h", True), ("a", "h", True), ("a", "h", False), ("a", "h", False), ("a", "g", True), ("b", "g", False), ("c", None, True), ("c", None, True)]
    chunks = spark.createDataFrame([(d, f"{d}:{i}", i, h, e) for i, (d, h, e) in enumerate(rows)], "document_id string, chunk_id string, chunk_index long, content_hash string, is_embeddable boolean")
    elements = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",)], "document_id string")
    told = lambda f: sorted(map(tuple, f.collect()))
    assert told(chunking.deduped_stats(elements, chunks)) == told(chunking.stats(elements, chunks, dedupe(chunks)))


def test_parents_are_found_without_a_second_pass(spark):
    rows = [("a", "a:p:0", 0, "parent", None), ("a", "a:c:0", 1, "child", "a:p:0"), ("a", "a:c:1", 2, "child", "a:p:0"), ("a", "a:c:2", 3, "child", "gone"), ("b", "b:c:0", 0, "child", "a:p:0"), ("c", "c:x", 0, None, "c:x")]
    chunks = spark.createDataFrame([(*r, [f"{r[0]}:el:0"]) for r in rows], "document_id string, chunk_id string, chunk_index long, chunk_role string, parent_chunk_id string, source_element_ids array<string>")
    elements = spark.createDataFrame([(d, f"{d}:el:0") for d in "abc"], "document_id string, element_id string")
    edges = graph.structure_edges(chunks, elements, corpus.SCOPE).where("relation = 'PARENT_CHUNK'")
    assert "Join" not in plan_of(edges)
    cut = lambda x: x.removeprefix("t:a::chunk:")
    assert sorted((cut(r["src"]), cut(r["dst"])) for r in edges.collect()) == [("a:c:0", "a:p:0"), ("a:c:1", "a:p:0"), ("c:x", "c:x")]


def test_an_ingest_writes_texts_apart_only_once_as_elements_and_chunks(spark, sf, tmp_path, monkeypatch):
    from lodestack.plans import engine as of

    apart = []
    monkeypatch.setattr(of, "written", lambda df, write=of.written: apart.append(df.columns) or write(df))
    made = of.Engine(spark, str(tmp_path / "store"), HashingEmbedder(8))
    rows = spark.createDataFrame([("a", "one two"), ("b", "three")], "document_id string, text string")
    for _ in range(2):
        told = made.ingest(corpus.files_of(rows, "text"), corpus.SCOPE, corpus.WINDOWS)
    assert sum("text" in columns for columns in apart) == 4  # elements and chunks of each of two ingests
    assert not any("relation" in columns and "description" in columns for columns in apart)
    assert {r["document_id"]: (r["chunks"], r["duplicate_chunks"]) for r in told.collect()} == {"a": (1, 0), "b": (1, 0)}
    assert made.table("nodes").groupBy("kind").count().orderBy("kind").collect() == [("chunk", 2), ("document", 2), ("element", 2)] and made.table("edges").count() == 6


def test_only_a_few_texts_of_a_batch_are_objects(spark, monkeypatch):
    from lodestack.functions import text

    assert text.plain("Ĝis la Ñ! ß đ\u0301 x") == "gis la n ss x"
    seen, whole = [], []

    class Values(list):
        """What the UDF asks of an array."""

        def slice(self, at, n):
            seen.append(n)
            return pa.array(self[at : at + n], pa.string())

        def to_pylist(self):
            whole.append(len(self))

    monkeypatch.setattr(text.F, "arrow_udf", lambda kind: lambda work: work)
    got = text.mapped(Values(["A", None] * 100), str.lower)
    assert got.to_pylist() == ["a", None] * 100 and not whole and seen and max(seen) <= 64


def test_embedding_by_counts_is_the_sum_of_tokens(spark):
    import zlib

    import numpy as np

    texts = ["a b a", "", "x " * 40 + "y", "Ä ß"]
    want = np.zeros((4, 7))
    for i, t in enumerate(texts):
        for token in t.lower().split():
            h = zlib.crc32(token.encode())
            want[i, (h >> 1) % 7] += 1.0 if h & 1 else -1.0
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert HashingEmbedder(7).embed(texts) == (want / np.where(norm, norm, 1)).tolist() and HashingEmbedder(7).embed([]) == []


def test_local_ids_are_resolved_within_their_reply(spark):
    def reply(document, chunk, entities, relations):
        told = [{"id": i, "type": "task", "name": n} for i, n in entities], [{"from_id": s, "to_id": t, "type": "uses", "description": d} for s, t, d in relations]
        return document, chunk, json.dumps(dict(zip(("entities", "relations"), told)))

    many = [(str(i), f"N{i}") for i in range(5 * graph.MANY)]
    rows = [
        reply("a", "c1", [("1", "A"), ("2", "B")], [("1", "2", "first"), ("2", "?", "")]),
        reply("a", "c2", [("1", "B"), ("x", "B"), ("2", "A")], [("2", "1", ""), ("2", "x", "y")]),
        reply("a", "c2", [("1", "C"), ("2", "A")], [("2", "1", ""), ("1", "1", "")]),
        reply("b", "c3", many, [(str(i), str(i + 1), "") for i in range(len(many))]),
    ]
    read = written(extracted(spark.createDataFrame(rows, "document_id string, chunk_id string, raw string"), into="x").select("document_id", "chunk_id", "x.*"))
    edges = graph.semantic_edges(read, corpus.SCOPE)
    assert "Join" not in plan_of(edges)
    got = edges.collect()
    of = {f"t:a::entity:{hashlib.sha256(f'task:{n.lower()}'.encode()).hexdigest()}": n for n in ["A", "B", "C", *(n for _, n in many)]}
    assert sorted((of[e["src"]], e["dst"][11:]) for e in got if e["relation"] == "MENTIONED_IN" and e["dst"] != "t:a::chunk:c3") == [("A", "c1"), ("A", "c2"), ("B", "c1"), ("B", "c2"), ("C", "c2")]
    assert sum(e["dst"] == "t:a::chunk:c3" for e in got) == len(many)
    told = {(of[e["src"]], of[e["dst"]]): e["description"] for e in got if e["relation"] == "SEMANTIC_RELATION"}
    assert told == {("A", "B"): "y", ("A", "C"): "", ("C", "C"): ""} | {(f"N{i}", f"N{i + 1}"): "" for i in range(len(many) - 1)}
    assert sum(e["relation"] == "SEMANTIC_RELATION" for e in got) == len(told)


def test_replies_are_not_dealt_by_the_size_of_their_keys(spark, sf):
    from lodestack.plans import catalog_wide

    assert "REPARTITION_BY_NUM" in catalog_wide.replies_raw(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_names_in_ascii_are_not_made_python_objects(spark, monkeypatch):
    from lodestack.functions import text

    said = ["", " ", " A  b ", "\x1cA\x1d\x1eB\x1f", "a\t\n\x0b\x0c\rB", "a\x7fb\x00C", "Straße", "\ufb01 \u3000X", "\u212a\u00a0K", "\x85a", "x" * 70 + " É"]
    lists = [said, None, [], ["É", "E"], said[::-1], [None, "B"]]
    rows = pa.array([["gone"], *lists], pa.list_(pa.string())).slice(1)
    want = [None if x is None else [None if n is None else text.entity_form(n) for n in x] for x in lists]
    form, seen = text.entity_form, []
    monkeypatch.setattr(text, "entity_form", lambda n: seen.append(n) or form(n))
    assert text.entity_forms(rows).to_pylist() == want and text.entity_forms(rows.slice(0, 0)).to_pylist() == []
    assert seen and not any(n.isascii() for n in seen)
    got = spark.createDataFrame(list(enumerate(lists)), "i int, n array<string>").select("i", text.entity_names(F.col("n")).alias("f")).orderBy("i").collect()
    assert [r["f"] for r in got] == want


def test_totals_of_replies_are_not_written_first(spark, sf, monkeypatch):
    from lodestack.plans import catalog_wide

    monkeypatch.setattr(catalog_wide, "written", None)
    got = catalog_wide.a07_reply_totals(spark, sf).collect()
    assert len(got) == 100 and sum(r["entities"] for r in got) == corpus.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().count()


def test_keys_of_several_parts_are_told_apart(spark):
    told = [("a", "b1:c"), ("ab", "1:c"), ("a", "b1:c"), ("1:a", "b"), ("1", "a:b"), ("1:a", "b")]
    raw = json.dumps({"entities": [{"id": i, "type": "task", "name": i} for i in sorted({x for r in told for x in r})], "relations": [{"from_id": s, "to_id": t, "type": k} for s, t in told for k in ("uses", "calls")]})
    got = extracted(spark.createDataFrame([(raw,)], "raw string")).first()["extracted"]["relations"]
    assert [(r["source_id"], r["target_id"], r["relation_type"]) for r in got] == [(s, t, k) for s, t in dict.fromkeys(told) for k in ("USES", "CALLS")]
