"""The engine's invariants on small tables."""

import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestack.functions import errors, labels, policy, text
from lodestack.functions.embedding import HashingEmbedder, checked, with_retries
from lodestack.functions.model_output import canonical_json, embedding_text, extracted, json_object
from lodestack.functions.vectors import cosine, cosine_to
from lodestack.operators import chunking, config, context, graph, health, registry, vectors
from lodestack.plans.engine import Engine, guarded_cypher, read_only
from lodestack.schema import Scope, pool_scope
from lodestack.sources import files, parsers


def one(spark, column, **values):
    frame = spark.range(1)
    for name, (value, kind) in values.items():
        frame = frame.withColumn(name, F.lit(value).cast(kind) if not isinstance(value, list) else F.array(*map(F.lit, value)).cast(kind))
    return frame.select(column).first()[0]


# -- sources ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name, kind, want", [("a.PDF", None, "ok"), ("a.gif", None, "blocked_image"), ("a.xyz", "image/x", "blocked_content_type"), ("a.md", None, "unsupported_extension"), ("none", None, "unsupported_extension"), (".txt", None, "unsupported_extension"), ("a.tar.jsonl", None, "ok")])
def test_gate(spark, name, kind, want):
    assert one(spark, files.gate(F.col("n"), F.col("k")), n=(name, "string"), k=(kind, "string")) == want


def test_html_rules():
    html = b"stray<h2> Title <b>x</b></h2><p>one <i>two</i><p>three</p><ul><li>item</ul><img alt='pic' src='s.png'><table><tr><th>a<td>b</td></th></tr><tr><td>c</td></tr></table><pre><code>k</code></pre>tail"
    got = [(e["element_type"], e["text"], e.get("level"), e.get("table")) for e in parsers.parse_html(html)]
    assert got[:2] == [("heading", "Title x", 2, None), ("paragraph", "three", None, None)]
    assert ("image", "pic", None, None) in got and ("code", "k", None, None) in got
    assert [t for k, _, _, t in got if k == "table"][0][-1] == ["c"]


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_png", ".png"), data)
    return out.getvalue()


def test_office_parsers():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = archive(word__document_xml=f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Te</w:t><w:t>xt</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>', word__media__i_png=b"x")
    assert [(e["element_type"], e["text"], e.get("level"), e.get("table")) for e in parsers.parse_docx(docx)] == [("heading", "Head", 2, None), ("paragraph", "Text", None, None), ("table", "", None, [["c"]]), ("image", "", None, None)]
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{}</a:t></a:r></a:p><a:p/></p:sld>'
    pptx = archive(ppt__slides__slide10_xml=slide.format("ten"), ppt__slides__slide2_xml=slide.format("two"))
    assert [(e["text"], e["slide_number"]) for e in parsers.parse_pptx(pptx) if e["element_type"] == "paragraph"] == [("two", 1), ("ten", 2)]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    xlsx = archive(xl__workbook_xml=f'<workbook {s}><sheets><sheet name="First"/></sheets></workbook>', xl__sharedStrings_xml=f"<sst {s}><si><t>shared</t></si></sst>", xl__worksheets__sheet1_xml=f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row><row/><row><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    assert [e.get("table") for e in parsers.parse_xlsx(xlsx)] == [None, [["shared", "7"], ["in"]]]


def test_broken_and_unavailable_files_are_rows(spark):
    rows = [("1", ".docx", b"no zip"), ("2", ".doc", b""), ("3", ".zzz", b""), ("4", ".csv", b'a,"b\nc"\n 1 ,2,3'), ("5", ".json", b'{"b":1,"a":"\xc3\xa9"}'), ("6", ".jsonl", b'{"a":1}\n\n{"b":2}'), ("7", ".txt", None), ("8", ".md", b"# T\n\nx\n\n```\ncode\n```")]
    got = parsers.parse_files(spark.createDataFrame(rows, "document_id string, extension string, content binary")).collect()
    status = {r["document_id"]: r["status"].split(":")[0] for r in got}
    assert (status["1"], status["2"], status["3"]) == ("failed", "unavailable", "unsupported") and "7" not in status
    assert next(r["table"] for r in got if r["document_id"] == "4") == [["a", "b\nc"], ["1", "2", "3"]]
    assert next(r["text"] for r in got if r["document_id"] == "5") == '{\n  "a": "é",\n  "b": 1\n}'
    assert [r["order"] for r in got if r["document_id"] == "6"] == [0, 2]
    assert [r["element_type"] for r in got if r["document_id"] == "8"] == ["heading", "paragraph", "code"]


# -- functions ------------------------------------------------------------------------------------------------------------
def test_cosine_edges(spark):
    kind = "array<float>"
    assert one(spark, cosine(F.col("a"), F.col("b")), a=([1.0, 0.0], kind), b=([0.0, 0.0], kind)) == 0
    assert one(spark, cosine(F.col("a"), F.col("b")), a=([1.0, 0.0], kind), b=([1.0], kind)) == 0
    assert one(spark, cosine_to(F.col("a"), [-1.0, 0.0]), a=([2.0, 0.0], kind)) == -1
    assert one(spark, cosine_to(F.col("a"), [0.0, 0.0]), a=([2.0, 0.0], kind)) == 0


@pytest.mark.parametrize("n", [1, 2, 3, 1536])
def test_cosine_to_long_vectors(spark, n):
    v, q = [math.sin(i + 1) for i in range(n)], [math.cos(i * i) for i in range(n)]
    frame = spark.createDataFrame([(v, q), (None, q), ([0.0] * n, q), (v[1:], q)], "v array<double>, q array<double>")
    got = frame.select(cosine_to(F.col("v"), q), cosine(F.col("v"), F.col("q"))).collect()
    assert all(abs(a - b) < 1e-12 for a, b in got) and got[0][0] != 0 and [a for a, _ in got[1:]] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("said, want", [("Đạo đức là gì", False), ("dao duc la gi", True), ("tự tử", True), ("governments", False), ("the government.", True)])
def test_restricted_topics(spark, said, want):
    assert one(spark, policy.restricted_topic(text.policy_text(F.col("t"))), t=(said, "string")) is want


@pytest.mark.parametrize("raw, ground, want", [
    ("plain", True, ("refusal", [])), ("see [1]", True, ("grounded_answer", [1])), ("see [7]", True, ("refusal", [])), ("see [1]", False, ("refusal", [])),
    ('{"decision":"RAG-answer","answer":"x","used_references":[2,true,"2",9]}', True, ("grounded_answer", [2])), ('{"decision":"answer","answer":"x [9]","used_references":[1]}', True, ("refusal", [])),
    ('```json\n{"type":"social","answer":"hi","self_check":"PASS"}\n```', False, ("social", [])), ('{"type":"social","answer":"hi","self_check":"fail"}', False, ("refusal", [])),
    ('{"type":"social","answer":"about religion","self_check":"pass"}', False, ("refusal", [])), ('{"decision":"refuse","answer":"yet [2]"}', True, ("grounded_answer", [2])), (None, True, ("refusal", [])),
])
def test_decisions(spark, raw, ground, want):
    kind, answer, references = one(spark, policy.decision(F.col("r"), F.array(F.lit(1), F.lit(2)), F.col("g")), r=(raw, "string"), g=(ground, "boolean"))
    assert (kind, references) == want and (kind != "grounded_answer" or f"[{references[0]}]" in answer)


def test_model_output(spark):
    replies = lambda raw: extracted(spark.createDataFrame([(raw,)], "raw string")).first()["extracted"]
    raw = '```json\n{"entities":[{"id":"1","type":"concept","name":" \\uff21  b "},{"id":"1","type":"Task","name":"late"},{"id":"2","type":"Alien","name":"x"},5],"relations":[{"from_id":"1","to_id":"1","type":"related_to","confidence":"NaN"},{"source_id":"1","target_id":"1","type":"INVENTED"},{"source_id":"1","target_id":"2","type":"USES"}]}\n```'
    x = replies(raw)
    assert [(e["local_id"], e["entity_type"], e["normalized_name"]) for e in x["entities"]] == [("1", "Concept", "a b")]
    assert [(r["relation_type"], r["confidence"]) for r in x["relations"]] == [("RELATED_TO", 1.0)]
    assert one(spark, F.isnull(json_object(F.col("r"))), r=("[1]", "string")) and replies("nothing")["warning"] and canonical_json({"b": 1, "a": "é"}) == '{"a": "é", "b": 1}'
    assert embedding_text([{"type": "text", "text": " a "}, {"type": "image"}, {"type": "text", "text": "b"}]) == "a\nb" and embedding_text({"text": " "}) is None


def test_errors_and_labels(spark):
    v = lambda k, m: tuple(one(spark, errors.verdict(F.col("k"), F.col("m")), k=(k, "string"), m=(m, "string")))
    assert v("RateLimitError", "daily limit") == ("disable_key", 86400.0, False, True) and v("Odd", "HTTP 401") == ("disable_key", None, True, True) and v(None, None) == ("skip_request", None, True, False)
    assert one(spark, errors.transient(F.col("c"), F.col("m"), F.col("d")), c=(None, "int"), m=("try again", "string"), d=(False, "boolean")) is True
    assert one(spark, errors.model_name(F.col("n")), n=("/models/gemini/x", "string")) == "x"
    assert one(spark, errors.provider_model(F.lit("groq"), F.col("n")), n=("groq/m", "string")) == "groq/m"
    assert one(spark, labels.chunk_label(F.col("i"), F.col("t")), i=(0, "long"), t=("a  b", "string")) == "Chunk 1: a b"
    assert one(spark, text.mask_secret(F.col("s")), s=("abcdefghij", "string")) == "abcd...ghij" and one(spark, text.mask_secret(F.col("s")), s=("abc", "string")) == "...bc"
    assert one(spark, text.redact(F.col("s")), s=("api_key=abc sk-123456789", "string")) == "api_key=[redacted] [redacted]"


def test_embedding_contract():
    class Short(HashingEmbedder):
        def embed(self, texts):
            return super().embed(texts)[:-1]

    with pytest.raises(ValueError):
        checked(Short(8), ["a", "b"])
    waits, calls = [], iter([OSError("429"), OSError("503"), None])

    def call():
        if e := next(calls):
            raise e
        return [1]

    assert with_retries(call, lambda e: True, waits.append) == [1] and waits == [2.0, 4.0]


# -- chunking ------------------------------------------------------------------------------------------------------------
def elements(spark, rows):
    return spark.createDataFrame(rows, "document_id string, `order` long, element_id string, element_type string, text string, page_number int, slide_number int")


def test_sections_split_at_headings_and_boundaries(spark):
    e = elements(spark, [("d", i, f"e{i}", k, t, p, None) for i, (k, t, p) in enumerate([("paragraph", "a", 1), ("paragraph", "b", None), ("paragraph", "c", 2), ("heading", "H", None), ("paragraph", "d", 3), ("heading", "", None), ("heading", "I", 3)])])
    got = [(r["section_index"], r["text"], r["boundary_value"]) for r in chunking.section_texts(e).orderBy("section_index").collect()]
    assert got == [(0, "a\n\nb", "1"), (1, "c", "2"), (2, "H\n\nd", "3"), (4, "I", "3")]


def test_windows_never_cross_pages_and_parents_hold_children(spark):
    words = " ".join(f"w{i}" for i in range(12))
    e = elements(spark, [("d", 0, "e0", "paragraph", "a b c d e", 1, None), ("d", 1, "e1", "paragraph", "f g h i j", 2, None), ("p", 0, "e0", "paragraph", words, None, None)])
    s = chunking.sliding(e, chunking.ChunkingConfig(max_tokens=4, overlap_tokens=1)).where("document_id = 'd'").orderBy("chunk_index").collect()
    assert [r["text"] for r in s] == ["a b c d", "d e", "f g h i", "i j"] and {r["boundary_value"] for r in s} == {"1", "2"}
    c = chunking.parent_child(e.where("document_id = 'p'"), chunking.ChunkingConfig(max_tokens=4, overlap_tokens=1, parent_max_tokens=7)).orderBy("chunk_index").collect()
    parents = {r["chunk_id"]: r["text"] for r in c if not r["is_embeddable"]}
    assert len(parents) == 2 and all(len(t.split()) <= 7 for t in parents.values())
    assert all(r["text"] in parents[r["parent_chunk_id"]] for r in c if r["is_embeddable"])


def test_sentence_windows_hold_budget_and_text():
    said = "One two three. Four five! Six seven eight nine ten eleven. Twelve?"
    got = chunking.sentence_windows(said, 5, 2)
    assert all(len(w.split()) <= 5 for w in got) and set(" ".join(got).split()) == set(said.split())


def test_semantic_chunks_keep_all_text_and_strategies_are_checked(spark):
    e = elements(spark, [("d", 0, "e0", "paragraph", "Owls hunt mice. Owls hunt voles. The tide is high.", None, None)])
    c = chunking.semantic(e, chunking.ChunkingConfig(strategy="semantic", percentile=50), HashingEmbedder(32)).orderBy("chunk_index").collect()
    assert len(c) > 1 and " ".join(r["text"] for r in c) == "Owls hunt mice. Owls hunt voles. The tide is high."
    with pytest.raises(ValueError):
        chunking.chunk(e, chunking.ChunkingConfig(strategy="semantic"))


def test_dedupe_keeps_first_and_leaves_parents(spark):
    rows = [("c1", "d", 1, "h", True), ("c0", "d", 0, "h", True), ("p", "d", 2, "h", False), ("x", "e", 0, "h", True), ("y", "e", 1, "g", True)]
    c = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index long, content_hash string, is_embeddable boolean")
    assert sorted(r["chunk_id"] for r in chunking.dedupe(c).collect()) == ["c0", "p", "x", "y"]
    known = spark.createDataFrame([("g",)], "content_hash string")
    assert sorted(r["chunk_id"] for r in chunking.dedupe(c, ("document_id",), known).collect()) == ["c0", "p", "x"]


# -- vectors, graph, health ------------------------------------------------------------------------------------------------
def test_scopes_differ_by_store(spark):
    rows = [("v1", "t", "a", ""), ("v2", "t", "a", "c"), ("v3", "u", "a", "")]
    f = spark.createDataFrame(rows, "id string, tenant_id string, app_id string, collection_id string")
    got = lambda c: sorted(r["id"] for r in f.where(c).collect())
    assert got(Scope("t", "a").of_vectors()) == ["v1", "v2"] and got(Scope("t", "a").of_graph()) == ["v1"] and got(Scope("t", "a", "c").of_graph()) == ["v2"]
    assert got(pool_scope("tenant_id", "t")) == ["v1", "v2"] and got(pool_scope("tenant_id", None)) == []


def test_upsert_keeps_last(spark):
    old, new = (spark.createDataFrame(x, "vector_id string, n int") for x in ([("a", 1), ("b", 2)], [("b", 3), ("b", 4), ("c", 5)]))
    assert sorted(map(tuple, vectors.upsert(old, new, order=F.col("n")).collect())) == [("a", 1), ("b", 4), ("c", 5)]


def test_traversal_with_cycles_and_clamp(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 9}", "SEMANTIC_RELATION", "USES", "", 1.0) for i in range(9)] + [("n0", "n0", "SEMANTIC_RELATION", "USES", "", 1.0)], "src string, dst string, relation string, kind string, description string, confidence double")
    seeds = spark.createDataFrame([("n0",)], "id string")
    assert {r["id"]: r["hop"] for r in graph.traverse(e, seeds, 99).collect()} == {f"n{i}": min(i, 9 - i) for i in range(9)}
    assert graph.traverse(e, seeds, -1).count() == 1 and graph.relation_map(e, seeds, 2, limit=3).count() == 3 and graph.relation_map(e, seeds, 0).count() == 0


def test_health_profiles_and_conflicts(spark):
    v = spark.createDataFrame([("v1", "d", None, "a/small", 3, "{}"), ("v2", "d", None, "big", 3, '{"k":"1","text":"x"}')], "vector_id string, document_id string, embedding_profile_id string, embedding_model string, vector_dimension int, metadata string")
    st = spark.createDataFrame([("d", 4, 3), ("only", 3, 3)], "document_id string, chunk_count long, embeddable_chunk_count long")
    p = spark.createDataFrame([("1", "P", "small", 3), ("2", "Q", "x/big", 3), ("3", "R", "y/big", 4)], "profile_id string, profile_name string, model_name string, embedding_dimensions int")
    got = {(r["document_id"], r["embedding_model"]): (r["profile_name"], r["missing_count"], r["dimension_status"]) for r in health.report(v, st, p).collect()}
    assert got == {("d", "a/small"): ("P", 2, "ok"), ("d", "big"): (health.POOL, 2, "unknown"), ("only", None): (None, 3, "unknown")}


# -- context, registry, config ----------------------------------------------------------------------------------------------
def test_compaction_budget(spark):
    b = spark.createDataFrame([("q", 0, "a", "A" * 20, "vector"), ("q", 1, "a", "dup", "vector"), ("q", 2, "b", "B" * 20, "vector"), ("q", 3, "c", "C", "vector")], "query_id string, pos int, chunk_id string, text string, source string")
    got = context.compact(b, budget=15, per_block=12).orderBy("reference").collect()
    assert [r["chunk_id"] for r in got] == ["a", "b"] and sum(len(r["text"]) for r in got) == 15


def test_follow_up_questions(spark):
    t = spark.createDataFrame([(1, 0, "user", "What is Spark?"), (1, 1, "assistant", "An engine."), (1, 2, "user", "and why"), (1, 3, "user", "a b c d e f g h")], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r["query"] for r in context.rewritten_queries(t).collect()}
    assert got == {0: "What is Spark?", 2: "What is Spark?\nFollow-up: and why", 3: "a b c d e f g h"}


def test_states_move_independently(spark):
    e = spark.createDataFrame([("d", 1, 1, "indexing", "queued"), ("d", 2, 2, "ready", None), ("d", 3, 3, None, "failed")], "document_id string, at long, seq long, status string, semantic_status string")
    assert tuple(registry.current_states(e).first())[:3] == ("d", "ready", "failed")


def test_top_k_setting_and_keys(spark):
    p = spark.createDataFrame([("1", 1, 9), ("2", 2, 0)], "id string, created_at long, retrieval_top_k int")
    assert config.top_k_setting(p).first()[0] == 5
    ring = config.KeyRing(["a", "b"])
    ring.told("a", "cooldown_key", 0, 60)
    assert [ring.next(1), ring.next(1), ring.next(61)] == ["b", "b", "a"]
    ring.told("b", "disable_key", 0, None)
    assert ring.next(100) == "a"


@pytest.mark.parametrize("query", ["CREATE (n)", "MATCH (n) DETACH DELETE n", "MATCH (n) SET n.x = 1", "DROP TABLE x", "just prose", ""])
def test_cypher_guard_rejects(query):
    with pytest.raises(ValueError):
        guarded_cypher(query)


def test_guards(spark):
    assert guarded_cypher("```cypher\nMATCH (n) RETURN n;\n```") == "MATCH (n) RETURN n"
    assert read_only(spark, "```sql\nselect 1;\n```") == "select 1"
    for bad in ("drop table x", "insert into x select 1", "create table y as select 1", "set a=b"):
        with pytest.raises(Exception):
            read_only(spark, bad)


# -- the whole engine ---------------------------------------------------------------------------------------------------------
def test_engine_from_files_to_answers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "owls.txt").write_text("Owls hunt mice in the orchard.\n\nThe ladder leans on the barn.")
    (tmp_path / "in" / "tides.txt").write_text("Tides turn every six hours.")
    (tmp_path / "in" / "old.doc").write_bytes(b"x")
    engine, scope = Engine(spark, f"file://{tmp_path}/store"), Scope("t", "a")
    found = files.read_files(spark, f"file://{tmp_path}/in", "t", "a")
    report = {r["filename"]: (r["status"].split(":")[0], r["vector_records"]) for r in engine.ingest(found, scope).collect()}
    assert report == {"owls.txt": ("ready", 1), "tides.txt": ("ready", 1), "old.doc": ("unavailable", None)}
    counts = lambda: [engine.table(n).count() for n in ("vectors", "nodes", "edges")]
    once = counts()
    engine.ingest(found, scope)
    assert counts() == once
    top = engine.search("owls hunt mice", scope, 1).first()
    assert "Owls" in top["text"] and engine.search("owls", Scope("other", "a")).count() == 0
    chunk = engine.table("nodes").where("kind = 'chunk' and text like 'Owls%' and properties['chunk_role'] = 'child'").first()
    reply = json.dumps({"entities": [{"id": "1", "type": "Technology", "name": "Owl"}, {"id": "2", "type": "Location", "name": "Barn"}], "relations": [{"source_id": "1", "target_id": "2", "type": "USES", "confidence": 0.9}]})
    told = engine.enrich(spark.createDataFrame([(chunk["document_id"], chunk["record_id"], reply)], "document_id string, chunk_id string, raw string"), scope)
    assert tuple(told.first())[1:3] == (2, 1)
    blocks = engine.retrieve("owls hunt mice", scope, 1).collect()
    assert {b["strategy"] for b in blocks} == {"vector_semantic_graph"} and blocks[0]["source"] == "graph_parent"
    nodes, edges = engine.graph(scope)
    assert nodes.where("kind = 'entity'").count() == 2 and edges.where("relation = 'SEMANTIC_RELATION'").count() == 1
    assert engine.query("select count(*) n from nodes where kind = :k", scope, k="document").first()[0] == 2
    profiles = spark.createDataFrame([("1", "P", "local-hashing-384", 384)], "profile_id string, profile_name string, model_name string, embedding_dimensions int")
    assert {r["dimension_status"] for r in engine.health(scope, profiles).collect()} == {"ok"}
    assert engine.route("what is the government") == "restricted" and engine.route("danh sach tai lieu") == "inventory"
    gone = engine.delete(chunk["document_id"], scope)
    assert gone >= 3 and engine.table("vectors").count() == 1 and engine.table("nodes").where("kind = 'entity'").count() == 0
    with pytest.raises(ValueError):
        engine.search("  ", scope)
    engine.reset()
    assert engine.table("nodes").count() == 0


def test_ingesting_again_replaces(spark, tmp_path):
    engine, scope = Engine(spark, f"file://{tmp_path}/store"), Scope("t", "a")
    rows = lambda i, n: [(i, f"{i}.txt", ".txt", " ".join(f"{i}{k}" for k in range(n)).encode())]
    put = lambda found, size: engine.ingest(spark.createDataFrame(found, "document_id string, filename string, extension string, content binary"), scope, chunking.ChunkingConfig(strategy="sliding_window", max_tokens=size, overlap_tokens=0))
    put(rows("x", 200), 10)
    put(rows("y", 30), 10)
    assert engine.table("vectors").count() == 23
    put(rows("x", 200), 100)
    nodes, edges = engine.table("nodes"), engine.table("edges")
    assert engine.table("vectors").where("document_id = 'x'").count() == 2 and nodes.where("kind = 'chunk' and document_id = 'x'").count() == 2
    assert edges.where("relation = 'NEXT_CHUNK'").count() == 1 + 2 and engine.table("vectors").where("document_id = 'y'").count() == 3
    assert edges.join(nodes, edges["src"] == nodes["id"], "left_anti").count() == 0 and edges.join(nodes, edges["dst"] == nodes["id"], "left_anti").count() == 0
    broken = [("y", "y.docx", ".docx", b"no zip")]
    assert put(broken, 10).first()["status"].startswith("failed") and engine.table("vectors").where("document_id = 'y'").count() == 3


def test_two_writers_from_one_manifest(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    base = engine._manifest()
    engine._publish(base, vectors=[])
    with pytest.raises(RuntimeError):
        engine._publish(base, vectors=[])


def test_answers_by_a_model(spark, tmp_path):
    engine, scope = Engine(spark, f"file://{tmp_path}/store"), Scope("t", "a")
    engine.ingest(spark.createDataFrame([("d", "d.txt", ".txt", b"Owls hunt mice in the orchard.")], "document_id string, filename string, extension string, content binary"), scope)

    def extractor(prompt):
        if "owls" not in prompt.lower():
            raise OSError("down")
        return '{"entities":[{"id":"1","type":"concept","name":"Owl"}],"relations":[]}'

    told = engine.learn(scope, extractor).first()
    assert (told["entities"], told["relations"], told["warnings"]) == (1, 0, [])
    assert engine.learn(scope, lambda p: 1 / 0).first()["warnings"]
    seen = []

    def model(text):
        seen.append(text)
        return '{"decision":"grounded","answer":"They hunt mice","used_references":[1]}'

    got = engine.answer("owls hunt mice", scope, model)
    assert (got["response_type"], got["answer"], got["strategy"]) == ("grounded_answer", "They hunt mice [1]", "vector_semantic_graph") and "Owls hunt" in seen[0]
    assert engine.answer("what is the government", scope, model)["response_type"] == "refusal" and len(seen) == 1
    planner = lambda q, schema: "select count(*) n from nodes where kind = 'document'" if "count" in q and "nodes(" in schema else None
    engine.answer("count owls hunt mice", scope, model, planner)
    assert '{"n":1}' in seen[1] and seen[1].index("source=vector") < seen[1].index("source=graph_query")
    assert engine.structured("x", scope, lambda q, s: "drop table nodes") is None
    listing = spark.createDataFrame([("d", "d.txt", "ready", 1, "t", "a", "", None)], "id string, filename string, status string, created_at long, tenant_id string, app_id string, collection_id string, metadata string")
    got = engine.answer("danh sach tai lieu", scope, model, documents=listing)
    assert "- d.txt (ready)" in seen[2] and got["strategy"] == "document_registry"
    assert engine.answer("owls hunt mice", scope, lambda t: 1 / 0)["response_type"] == "refusal"


def test_embedding_is_tried_again(spark, monkeypatch):
    from lodestack.functions import embedding

    class Odd(HashingEmbedder):
        calls = 0

        def embed(self, texts):
            self.calls += 1
            if self.calls == 1:
                raise TimeoutError
            return super().embed(texts)

    frame = spark.createDataFrame([("a b",)], "text string").coalesce(1)
    assert len(embedding.embedded(frame, Odd(8)).first()["vector"]) == 8


def test_streams_equal_batches(spark, tmp_path):
    from lodestack.streaming.jobs import ingest_stream, run_available, usage_sessions, usage_windows

    rows = [(i, f"2024-01-01 0{i % 5}:{i % 60:02d}:00", i % 3, "ok", float(i)) for i in range(60)]
    e = spark.createDataFrame(rows + rows[:5], "event_id long, t string, user_id long, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value")
    e.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/events")
    run_available(usage_windows(stream, late="10 days"), f"{tmp_path}/out", f"{tmp_path}/cp", "complete")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, usage_windows(e).collect()))
    assert usage_sessions(e).agg(F.sum("calls")).first()[0] == 65
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("x")
    seen = []
    ingest_stream(spark, f"{tmp_path}/f", lambda files: seen.append(files.count()), f"{tmp_path}/cp2")
    assert sum(seen) == 1
