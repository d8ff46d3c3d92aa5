"""What the findings of round 4 say, on small inputs."""

import json
import time

import pyarrow as pa
from pyspark.sql import functions as F

from lodestack import catalog
from lodestack.functions import model_output, replies
from lodestack.operators import graph
from lodestack.plans import corpus
from lodestack.schema import Scope
from lodestack.storage import CLEANUP, written


def test_chunk_contexts_of_all_chunks_need_no_texts(spark, sf):
    corpus._BUILT.clear()
    frame = catalog.QUERIES["j07_chunk_context"](spark, sf)
    assert sorted(name for _, _, name in corpus._BUILT) == ["chunk_rows", "element_rows"]
    assert not any("text" in table.columns for table in corpus._BUILT.values())
    assert not any("text:" in line for line in frame._jdf.queryExecution().executedPlan().toString().split("\n"))
    got = sorted(map(tuple, frame.collect()))
    corpus.graph(spark, sf)
    assert got == sorted(map(tuple, catalog.QUERIES["j07_chunk_context"](spark, sf).collect()))


def test_elements_of_a_context_have_the_fields_asked_for(spark):
    elements = spark.createDataFrame([("d", 0, "d:0", "heading", "long " * 50), ("d", 1, "d:1", "paragraph", "p")], "document_id string, order long, element_id string, element_type string, text string")
    chunks = spark.createDataFrame([("d", "c0", 0, "window", None, ["d:1", "d:0"], "h", True, "x"), ("d", "c1", 1, "window", None, ["d:0", "gone"], "g", True, "y")], "document_id string, chunk_id string, chunk_index long, chunk_role string, parent_chunk_id string, source_element_ids array<string>, content_hash string, is_embeddable boolean, text string")
    scope = Scope("t", "a")
    nodes = graph.structure_nodes(spark.createDataFrame([("d",)], "document_id string"), elements, chunks, scope)
    edges = graph.structure_edges(chunks, elements, scope)
    wanted = nodes.where("kind = 'chunk'").select("id", F.col("position").alias("pos"))
    whole = {r["chunk_id"]: r for r in graph.chunk_context(nodes, edges, wanted).collect()}
    some = {r["chunk_id"]: r for r in graph.chunk_context(nodes, edges, wanted, ("order_index", "element_id")).collect()}
    assert [tuple(e) for e in whole["c0"]["source_elements"]] == [(0, "d:0", "heading", "long " * 50), (1, "d:1", "paragraph", "p")]
    assert [tuple(e) for e in some["c0"]["source_elements"]] == [(0, "d:0"), (1, "d:1")] and [tuple(e) for e in some["c1"]["source_elements"]] == [(0, "d:0")]
    assert (some["c0"]["next_chunk_id"], some["c1"]["previous_chunk_id"], some["c0"]["previous_chunk_id"]) == ("c1", "c0", None)


def test_shuffle_files_go_when_a_table_is_written(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {str(f) for f in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, mode = shuffled(), spark.conf.get(CLEANUP, None)
    table = written(spark.range(1000).repartition(3, "id"))
    until = time.time() + 30
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and table.count() == 1000 and spark.conf.get(CLEANUP, None) == mode


def told(raw):
    return json.dumps(raw, ensure_ascii=False)


ODD = [
    None, "", "```", "`````", "{}", "[1]", "nothing", "```JSON {} ```\x0b", '{"entities":[]} {"entities":[]}', '{"entities":[]}}\n{"r":{"entities":[]}', '{"entities":[],"entities":[]}', '{"entities":null,"relations":{}}', '{"more":1}',
    told({"entities": [{"id": 1, "type": "task", "name": 5}, 5, None], "relations": [{"from_id": "1", "to_id": 1, "type": "uses"}]}),
    '{"entities":[{"id":"a","id":"b","type":"task","name":"x"}]}', '{"entities":[{"id":"a","type":"task","name":"x"},]}', '{"entities":[{"id":"\\ud83d","type":"task","name":"x"}]}',
    *(f'{{"entities":[{{"id":"a","type":"task","name":"x"}}],"relations":[{{"from_id":"a","to_id":"a","type":"uses","confidence":{c}}}]}}' for c in ("NaN", "-0.0", "-3", "1e999", "0.25", '"NaN"', '" 0.5"', '"0.5d"', '"-1"', '""', "null", "true", '"1e-3"')),
]
PLAIN = [
    told({"entities": [{"id": " a ", "type": "TASK", "name": " Ａ  b "}, {"id": "a", "type": "task", "name": "late"}, {"id": "é", "type": "tasK", "name": "ß\x00"}, {"id": "c", "type": "alien", "name": "c"}, {"id": "", "type": "task", "name": "n"}, {"id": "d", "type": "task", "name": "\t"}, None, {}]}),
    '```json\n{"relations": [{"source_id": " ", "from_id": "a", "target_id": "b", "to_id": "?", "type": "uses ", "confidence": "1.7", "description": " d "}, {"from_id": "a", "to_id": "b", "type": "USES", "confidence": "0.1"}, {"from_id": "a", "to_id": "c", "type": "uses"}, {"from_id": "b", "to_id": "a", "type": "calls"}, null, {"from_id": "b", "to_id": "b", "type": "likes"}],\n "entities": [{"name": "\\ud83d\\ude00", "type": "concept", "id": "a"}, {"id": "b", "type": "Concept", "name": "B"}]}\n```',
    told({"entities": [{"id": str(i % 40), "type": "task", "name": f"N{i}"} for i in range(60)], "relations": [{"from_id": str(i % 45), "to_id": str(i % 7), "type": "uses", "confidence": i / 50} for i in range(90)]}),
]


def test_plain_replies_are_read_as_columns_by_the_same_rules(spark, monkeypatch):
    rows = spark.createDataFrame(list(enumerate([*ODD, *PLAIN, *ODD[::-1]])), "i int, raw string").coalesce(1)
    plain = {r["i"] for r in rows.where(replies.is_plain(F.col("raw"))).collect()}
    assert {len(ODD), len(ODD) + 1, len(ODD) + 2} <= plain and not plain & {0, 1, 2, 3, 5, 6, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 20, 22}
    got = {r["i"]: r["extracted"].asDict(True) for r in model_output.extracted(rows).collect()}
    assert [len(got[len(ODD) + k]["entities"]) for k in range(3)] == [2, 2, 40] and [len(got[len(ODD) + k]["relations"]) for k in range(2)] == [0, 2]
    monkeypatch.setattr(model_output, "is_plain", lambda raw: F.lit(False))
    assert got == {r["i"]: r["extracted"].asDict(True) for r in model_output.extracted(rows).collect()}


def test_parts_of_a_batch_are_read_alike(monkeypatch):
    rows = pa.array([*ODD, *PLAIN] * 2)
    whole = replies._parts(rows, replies._read, replies.TYPE)
    for size in (1, 300):
        monkeypatch.setattr(replies, "BYTES", size)
        assert replies._parts(rows, replies._read, replies.TYPE).to_pylist() == whole.to_pylist()
    assert replies._parts(rows.slice(0, 0), replies._read, replies.TYPE).to_pylist() == [] and whole.null_count < len(rows)


def test_replies_made_of_documents_are_what_to_json_makes(spark, tmp_path, monkeypatch):
    texts = ['a "b" c\\d é  \x01\x7f </x>', "one", "", None, " \n two　words\t"]
    spark.createDataFrame([(i, t, "s", "en", 0) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    made, read = [], model_output.extracted
    monkeypatch.setattr(model_output, "extracted", lambda rows, **k: made.append(rows) or read(rows, **k))
    got = {r["document_id"]: r for r in catalog.QUERIES["s16_extraction"](spark, str(tmp_path)).collect()}
    for r in made[0].collect():
        words = (texts[int(r["document_id"])] or "").split()
        want = {"entities": [{"id": str(i), "type": ("concept", "TASK")[i % 2], "name": w} for i, w in enumerate(words)], "relations": [{"from_id": str(i), "to_id": str(i + 1), "type": "uses", "confidence": "1.7"} for i in range(len(words) - 1)]}
        assert json.loads(r["raw"].removeprefix("```json\n").removesuffix("\n```")) == want
        assert (got[r["document_id"]]["n_entities"], got[r["document_id"]]["n_relations"]) == (len(words), max(0, len(words) - 1))


def test_batches_of_replies_are_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for told, want in ((64 << 20, replies.BATCH), (1 << 20, 1 << 20)):
            spark.conf.set(key, told)
            model_output.extracted(spark.createDataFrame([("{}",)], "raw string"))
            assert int(spark.conf.get(key).rstrip("b")) == want
    finally:
        spark.conf.set(key, int(before.rstrip("b")))


def test_flags_of_replies_fill_the_output_buffer_of_a_worker():
    got = replies._flags(pa.array(["x" * 1000, "{}" + " " * 998, None, "", "{}"])).to_pylist()
    assert got == ["0" + "0" * 10, "1" + "0" * 10, "0", "0", "1"]
    assert sum(map(len, replies._flags(pa.array(["x" * (replies.BATCH // 100)] * 100)).to_pylist())) >= 1 << 16
