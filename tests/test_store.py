"""The store's manifests and folders, what a scope may see, and what a query may say."""

import json
import random
import warnings

import pytest
from pyspark.sql import functions as F

from lodestack.operators.chunking import ChunkingConfig
from lodestack.operators.patterns import Node, Pattern, Step, match, pattern_of
from lodestack.plans.engine import Engine, read_only
from lodestack.plans.store import PRINTS, Store
from lodestack.schema import Scope

FILES = "document_id string, filename string, extension string, content binary"


class Small(Store):
    tables, keys = {"t": "id string, n int"}, {"t": ("id",)}

    def upsert(self, rows):
        base, frame = self._manifest(), self.spark.createDataFrame(rows, "id string, n int")
        self._publish(base, t=self._put(base, "t", frame, frame))


def ingest(engine, scope, rows, size=20):
    return engine.ingest(engine.spark.createDataFrame([(i, f"{i}.txt", ".txt", t.encode()) for i, t in rows], FILES), scope, ChunkingConfig(strategy="sliding_window", max_tokens=size, overlap_tokens=0))


def reply(*names):
    entities = [{"id": str(i), "type": "Concept", "name": n} for i, n in enumerate(names)]
    relations = [{"source_id": "0", "target_id": str(i), "type": "USES"} for i in range(1, len(names))]
    return json.dumps({"entities": entities, "relations": relations})


def enrich(engine, scope, document, *names, chunk=None):
    at = engine.table("nodes").where(scope.of_graph() & (F.col("kind") == "chunk") & (F.col("document_id") == document)).orderBy("position").first()
    engine.enrich(engine.spark.createDataFrame([(document, chunk or at["record_id"], reply(*names))], "document_id string, chunk_id string, raw string"), scope)


# -- manifests and folders ------------------------------------------------------------------------------------------------
def test_upserts_equal_a_dict_and_compaction_changes_nothing(spark, tmp_path):
    store, want, r = Small(spark, f"file://{tmp_path}/s"), {}, random.Random(4)
    for _ in range(8):
        rows = {f"k{r.randrange(30)}": r.randrange(100) for _ in range(5)}
        store.upsert(list(rows.items()))
        want |= rows
    got = lambda m=None: dict(map(tuple, store.table("t", m).collect()))
    assert got() == want
    before = store._manifest()
    assert store.compact(least=2) == ["t"] and store.compact(least=2) == [] and len(store._manifest()["tables"]["t"]) == 1
    assert got() == want and got(before) == want  # a reader of the old manifest still has its folders
    assert store.vacuum(keep=1, older_s=3600) == 0 and got(before) == want  # too young to go
    assert store.vacuum(keep=1, older_s=-5) > 5 and got() == want and len(store.versions()) == 1
    store.upsert([("new", 1)])
    assert got() == want | {"new": 1}


def test_only_folders_that_may_hold_a_key_are_read(spark, tmp_path):
    store = Small(spark, f"file://{tmp_path}/s")
    base = store._manifest()
    at = [store._add(base, "t", spark.createDataFrame([(f"{i}-{j}", j) for j in range(20)], "id string, n int").coalesce(1)) for i in range(12)]
    store._publish(base, t=at)
    base = store._manifest()
    asked = spark.createDataFrame([("7-3",), ("nowhere",), ("2-19",)], "id string")
    assert store._may_hold(base, "t", asked) == [at[2], at[7]]
    large = store._add(base, "t", spark.range(PRINTS + 1).select(F.col("id").cast("string"), F.lit(1).alias("n")))
    assert large not in base["prints"]
    base["tables"]["t"] = [*at, large]
    assert store._may_hold(base, "t", asked) == [at[2], at[7], large]
    put = spark.createDataFrame([("7-3", 99)], "id string, n int")
    changed = store._put(base, "t", put, put)
    assert at[7] not in changed and set(at) - {at[7]} < set(changed) and large in changed


@pytest.mark.parametrize("content", ["", "{", "[]", '{"n": 2}'])
def test_a_manifest_that_cannot_be_read_is_passed_over(spark, tmp_path, content):
    store = Small(spark, f"file://{tmp_path}/s")
    store.upsert([("a", 1)])
    (tmp_path / "s" / "manifests" / "0000000002.json").write_text(content)
    with warnings.catch_warnings(record=True):
        warnings.simplefilter("always")
        assert store.table("t").count() == 1
        store.upsert([("b", 2)])
        assert store.versions() == [1, 2, 3] and store.table("t").count() == 2


def test_a_crash_at_any_step_leaves_what_was_there(spark, tmp_path, monkeypatch):
    store = Small(spark, f"file://{tmp_path}/s")
    store.upsert([("a", 1)])
    for step in ("_prints_of", "_add", "_publish"):
        with monkeypatch.context() as m:
            m.setattr(store, step, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                store.upsert([("a", 2), ("b", 2)])
        assert [tuple(r) for r in store.table("t").collect()] == [("a", 1)]
    (tmp_path / "s" / "manifests" / ".half-written").write_text("{")  # a writer that died before its rename
    store.upsert([("a", 3)])
    assert [tuple(r) for r in store.table("t").collect()] == [("a", 3)]
    store.vacuum(older_s=-5)
    assert not (tmp_path / "s" / "manifests" / ".half-written").exists() and len(list((tmp_path / "s" / "t").iterdir())) == 1


# -- what ingesting again and learning leave ----------------------------------------------------------------------------------
def test_mentions_of_text_that_is_gone_go(spark, tmp_path):
    engine, scope = Engine(spark, f"file://{tmp_path}/store"), Scope("t", "a")
    rockets, tides = " ".join(f"rocket{i}" for i in range(30)), " ".join(f"tide{i}" for i in range(30))
    ingest(engine, scope, [("d", rockets), ("e", tides)])
    enrich(engine, scope, "d", "Rocket", "Fuel")
    enrich(engine, scope, "e", "Fuel", "Moon")
    names = lambda: sorted(r["label"] for r in engine.table("nodes").where("kind = 'entity'").collect())
    assert names() == ["Fuel", "Moon", "Rocket"]
    ingest(engine, scope, [("d", rockets)])  # the same text: all stays
    assert names() == ["Fuel", "Moon", "Rocket"] and engine.table("edges").where("relation = 'MENTIONED_IN'").count() == 4
    ingest(engine, scope, [("d", "bread " * 30)])
    assert names() == ["Fuel", "Moon"] and engine.table("edges").where("relation = 'MENTIONED_IN'").count() == 2
    assert engine.table("edges").where("relation = 'SEMANTIC_RELATION'").count() == 1
    assert sorted((r["name"], r["document_id"]) for r in engine.table("entities").collect()) == [("Fuel", "e"), ("Moon", "e")]


def test_a_known_entity_keeps_its_first_document(spark, tmp_path):
    engine, scope = Engine(spark, f"file://{tmp_path}/store"), Scope("t", "a")
    ingest(engine, scope, [("d", "one two three"), ("e", "four five six")])
    enrich(engine, scope, "e", "Moon")
    enrich(engine, scope, "d", "Moon", "Sun")
    assert {r["label"]: r["document_id"] for r in engine.table("nodes").where("kind = 'entity'").collect()} == {"Moon": "e", "Sun": "d"}


# -- scopes and queries ---------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def two_tenants(spark, tmp_path_factory):
    engine = Engine(spark, f"file://{tmp_path_factory.mktemp('two')}/store")
    one, two = Scope("one", "app"), Scope("two", "app")
    for scope, word in ((one, "secret"), (two, "public")):
        ingest(engine, scope, [(f"d-{word}", f"{word} owls hunt mice. " * 12)])
        enrich(engine, scope, f"d-{word}", f"{word} Owl", "Mouse", "Barn")
    return engine, one, two


def test_queries_see_their_scope_alone(two_tenants):
    engine, one, two = two_tenants
    for scope, other in ((one, "public"), (two, "secret")):
        for name in ("nodes", "edges", "vectors", "entities"):
            rows = engine.query(f"select * from {name}", scope).toJSON().collect()
            assert rows and not any(other in r for r in rows)
    assert engine.query("select count(*) n from nodes where kind = 'entity' and label like :x", two, x="%Owl").first()[0] == 1
    assert "secret" not in engine.structured("x", two, lambda q, s: "SELECT text FROM vectors")
    assert engine.query("select * from vectors", Scope("three", "app")).count() == 0
    seen = []
    engine.answer("x", two, lambda t: seen.append(t) or "no", planner=lambda q, s: "SELECT text FROM vectors")
    assert seen and "secret" not in seen[0] and "public" in seen[0]
    assert not {t.name for t in engine.spark.catalog.listTables()} & {"nodes", "edges", "vectors", "entities"}  # no views are left in the caller's session


@pytest.mark.parametrize("text", [
    "WITH x AS (SELECT 'w' AS id) INSERT INTO t SELECT * FROM x", "FROM vectors INSERT INTO t SELECT * INSERT INTO t2 SELECT *", "WITH x AS (SELECT 1 a) INSERT OVERWRITE t SELECT * FROM x", "insert overwrite directory '/tmp/x' using csv select 1",
    "SELECT * FROM text.`/etc/hostname`", "select * from parquet.`/x`", "select java_method('java.lang.System', 'getenv', 'HOME')", "select reflect('a', 'b')", "select try_reflect('a', 'b')", "select id from nodes where id = (select java_method('a', 'b'))",
    "select * from other", "select * from default.nodes", "select * from global_temp.nodes", "select * from identifier('other')", "select identifier('java_method')('a', 'b')", "select * from range(9)", "select * from nodes where id in (select id from other)",
    "with nodes2 as (select * from other) select * from nodes2", "select * from t, (with t as (select 1) select * from t)", "with recursive r as (select 1 n union all select n + 1 from r) select * from r", "explain select 1", "show tables", "describe nodes", "set a = b",
    "execute immediate 'select 1'", "begin select 1; end", "cache table nodes", "select * from nodes version as of 1", "merge into t using nodes on 1 = 1 when matched then delete", "delete from nodes", "drop view nodes", "select my_udf(1)", "select db.f(1)", "select input_file_name()",
    "select 1; select 2", "not a query", "", "select transform(id) using 'cat' from nodes", "select * from nodes where exists (select 1 from other)", "select (select max(id) from other)",
])
def test_what_is_no_query_is_refused(spark, text):
    with pytest.raises(ValueError):
        read_only(spark, text)


@pytest.mark.parametrize("text", [
    "with x as (select * from nodes), y as (select * from x) select a.id from x a left join edges e on a.id = e.src where exists (select 1 from vectors v where v.document_id = a.document_id)", "select kind, count(*) filter (where id > 'a') from NODES group by kind having count(*) > 1 order by 2 desc limit 5 offset 1",
    "select id, row_number() over (partition by kind order by id) from nodes union all select 'a', 1", "select k, v from nodes lateral view explode(properties) t as k, v", "select * from nodes pivot (count(*) for kind in ('chunk'))", "values (1), (2)", "select * from nodes join edges on id = src and relation = 'HAS_CHUNK'",
    "select case when kind in ('a', 'b') then 1 end, filter(array(1, 2), x -> x > 1) from nodes where label like any ('a', 'b')", "table nodes", "(select 1) intersect (select 2)",
])
def test_queries_are_let_through(two_tenants, text):
    engine, one, _ = two_tenants
    engine.query(text, one).collect()


def test_patterns_see_their_scope_alone(two_tenants):
    engine, one, two = two_tenants
    found = {"nodes": [{"kind": "entity", "label_contains": "OWL"}, {"kind": "entity"}], "steps": [{"relation": "SEMANTIC_RELATION", "kind": "USES"}], "returns": [[0, "label"], [1, "label"]]}
    assert [tuple(r) for r in engine.match(found, one).collect()] == [("secret Owl", "Barn"), ("secret Owl", "Mouse")]
    assert [r[0] for r in engine.match(found, two).collect()] == ["public Owl"] * 2
    text = {"nodes": [{"kind": "document"}, {"kind": "chunk", "equals": {"chunk_role": "window"}}], "steps": [{"relation": "HAS_CHUNK", "way": "out"}], "returns": [[1, "text"], [1, "chunk_role"]], "limit": 1}
    assert engine.match(text, one).count() == 1 and "public" not in engine.structured("x", one, lambda q, s: text)
    for bad in ({}, {"nodes": [{}], "returns": []}, {"nodes": [{"kind": "x"}], "returns": [[0, "id"]]}, {"nodes": [{}], "returns": [[1, "id"]]}, {"nodes": [{}, {}], "steps": [{"hops": [1, 9]}], "returns": [[0, "id"]]}, {"nodes": [{}, {}], "returns": [[0, "id"]]}, {"nodes": 5}):
        with pytest.raises(ValueError):
            pattern_of(bad)


def test_patterns_of_several_hops_against_brute_force(spark):
    r = random.Random(3)
    scopes = {f"n{i}": "t" if i % 5 else "other" for i in range(40)}
    pairs = {(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(70)}
    nodes = spark.createDataFrame([(i, "entity", t, "a", "", "d", i, 0, i, None, {}) for i, t in scopes.items()], "id string, kind string, tenant_id string, app_id string, collection_id string, document_id string, record_id string, position long, label string, text string, properties map<string,string>")
    edges = spark.createDataFrame([(a, b, "SEMANTIC_RELATION", "USES", "", 1.0) for a, b in pairs], "src string, dst string, relation string, kind string, description string, confidence double")
    inside = {(a, b) for a, b in pairs if scopes[a] == scopes[b] == "t"}
    for way in ("out", "in", "both"):
        one = {"out": inside, "in": {(b, a) for a, b in inside}, "both": inside | {(b, a) for a, b in inside}}[way]
        far, want = one, set()
        for hop in range(1, 4):
            want |= far if hop >= 2 else set()
            far = {(a, d) for a, b in far for c, d in one if b == c}
        p = Pattern((Node("entity"), Node("entity")), (Step("SEMANTIC_RELATION", None, (2, 3), way),), ((0, "id"), (1, "id")), 1000)
        assert {tuple(x) for x in match(nodes, edges, p, Scope("t", "a")).collect()} == want
