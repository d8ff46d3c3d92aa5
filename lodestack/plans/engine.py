"""The engine as one object: ingest, search, retrieve, answer, graph, health, delete, over the tables of a store."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import QUERY, EmbeddingProvider, HashingEmbedder, checked
from ..functions.labels import response_strategy, retrieval_strategy
from ..functions.model_output import extracted
from ..functions.policy import REFUSAL, decision, inventory_question, restricted_topic
from ..functions.text import mapped, policy_text
from ..ontology import prompt
from ..operators import chunking, graph, health, registry, vectors
from ..operators.context import BLOCKS, SOURCES, compact, rendered
from ..operators.patterns import match, pattern_of
from ..schema import EDGES, NODES, RELATIONS, USAGE, VECTORS, Scope
from ..sources.parsers import parse_files
from ..storage import written
from .guard import check_query
from .store import Store

TABLES = {"vectors": VECTORS, "nodes": NODES, "edges": EDGES, "entities": "id string, document_id string, chunk_id string, entity_type string, name string, normalized_name string", "usage": USAGE}
#: What a planned query may name.
VIEWS = ("vectors", "nodes", "edges", "entities")

KEYS = {"vectors": ("vector_id",), "nodes": ("id",), "edges": ("src", "dst", "relation", "kind"), "entities": ("id", "document_id", "chunk_id"), "usage": ("event_id",)}

#: What nodes and vectors are counted by as they are written.
SCOPED = {c: c for c in ("tenant_id", "app_id", "collection_id", "document_id")}
SUMMARIES = {
    "nodes": SCOPED | {"kind": "kind", "is_embeddable": "coalesce(properties['is_embeddable'] = 'true', false)"},
    "vectors": SCOPED | {c: c for c in ("embedding_profile_id", "embedding_model", "vector_dimension")},
}


@dataclass(frozen=True)
class Bundle:
    """What one ingest hands to its sinks."""

    files: DataFrame
    elements: DataFrame
    chunks: DataFrame
    scope: Scope

    def documents(self) -> DataFrame:
        return self.elements.select("document_id").distinct()


def totals(read: DataFrame) -> DataFrame:
    """Extracted replies -> entities, relations and warnings of each document."""
    return read.groupBy("document_id").agg(F.sum(F.size("entities")).alias("entities"), F.sum(F.size("relations")).alias("relations"), F.array_sort(F.collect_list("warning")).alias("warnings"))


def hybrid(matches: DataFrame, nodes: DataFrame, edges: DataFrame, entities: DataFrame, in_scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """matches (id of a chunk node, rank) -> (chunk contexts in order, related entities).

    Seeds come first, in the order of the search, then chunks that mention what the seeds' entities relate to by one
    step; the parents of all come before them. A chunk stands at its first place.
    """
    seeds = graph.seeds_of_chunks(edges, matches)
    near = written(graph.traverse(edges, seeds, 1, in_scope))
    related = graph.mentioning_chunks(edges, near)
    order = matches.select("id", F.struct(F.lit(1).alias("o"), F.col("rank").cast("long").alias("r"), F.lit("").alias("i")).alias("place")).unionByName(related.select("id", F.struct(F.lit(2).alias("o"), F.lit(0).cast("long").alias("r"), F.col("id").alias("i")).alias("place")))
    parents = edges.where("relation = 'PARENT_CHUNK'").join(order.groupBy("id").agg(F.min("place").alias("place")), edges["src"] == F.col("id")).select(F.col("dst").alias("id"), F.struct(F.lit(0).alias("o"), F.col("place.r").alias("r"), F.col("place.i").alias("i")).alias("place"))
    first = written(order.unionByName(parents).groupBy("id").agg(F.min("place").alias("pos")))
    context = graph.chunk_context(nodes, edges, first)
    return context, entities.join(near, "id", "left_semi").select("id", "name", "entity_type").distinct()


class Engine(Store):
    tables, keys, summaries = TABLES, KEYS, SUMMARIES

    def __init__(self, spark: SparkSession, root: str, provider: EmbeddingProvider | None = None):
        super().__init__(spark, root)
        self.provider = provider or HashingEmbedder()

    # -- writing -----------------------------------------------------------------------------------------------------
    def ingest(self, files: DataFrame, scope: Scope, config: chunking.ChunkingConfig | None = None, sinks: tuple[str, ...] = ("graph", "vectors")) -> DataFrame:
        """files (document_id, filename, extension, content) -> a row of counts and status for each.

        Ingesting again replaces all that the scope holds of a document: its chunks and elements with their vectors and
        edges. Mentions of chunks that come again with the same text stay; other mentions go, and so do entities that nothing mentions
        any more. A file that cannot be parsed leaves what is there. Files are parsed, cut and
        embedded once, for all sinks, and what the sinks write is published at once; without sinks the counts are all there is.
        """
        base = self._manifest()
        parsed = written(parse_files(files))
        elements = parsed.where("element_id is not null").drop("status")
        all_chunks = written(chunking.marked(chunking.chunk(elements, config, self.provider)))
        bundle = Bundle(files, elements, all_chunks.where("__kept").drop("__kept"), scope)
        changed = {name: paths for sink in sinks for name, paths in {"graph": self._to_graph, "vectors": self._to_vectors}[sink](base, bundle).items()}
        if changed:
            self._publish(base, **changed)
        told = chunking.stats(elements, all_chunks, bundle.chunks)
        failed = parsed.where("element_id is null").select("document_id", "status")
        return files.select("document_id", "filename").join(told, "document_id", "left").join(failed, "document_id", "left").withColumn("status", F.coalesce("status", F.lit("ready")))

    def _to_vectors(self, base: dict, bundle: Bundle) -> dict[str, list[str]]:
        scope, rows = bundle.scope, vectors.records(bundle.chunks, bundle.scope)
        in_scope = F.coalesce("collection_id", F.lit("")) == (scope.collection_id or "")
        of_vectors = self.table("vectors", base).where(scope.of_vectors() & in_scope).join(bundle.documents(), "document_id", "left_semi").select("vector_id")
        return {"vectors": self._put(base, "vectors", of_vectors.unionByName(rows.select("vector_id")), vectors.embed_records(rows, self.provider))}

    def _to_graph(self, base: dict, bundle: Bundle) -> dict[str, list[str]]:
        scope, elements, chunks = bundle.scope, bundle.elements, bundle.chunks
        # Written where they stay, as folders that no manifest names yet.
        node_folders, nodes = self._new(base, "nodes", graph.structure_nodes(bundle.files.select("document_id", "filename"), elements, chunks, scope))
        edge_folders, edges = self._new(base, "edges", graph.structure_edges(chunks, elements, scope).dropDuplicates(list(KEYS["edges"])))
        same = lambda rows: rows.select("id", F.coalesce(F.col("properties")["content_hash"], F.lit("")).alias("hash"))
        held = written(same(self.table("nodes", base).where(scope.of_graph() & (F.col("kind") != "entity")).join(bundle.documents(), "document_id", "left_semi")))
        before, old = held.select("id"), self.table("edges", base)
        of_documents = old.where("relation not in ('MENTIONED_IN', 'SEMANTIC_RELATION')").join(before, old["src"] == before["id"], "left_semi").select(*KEYS["edges"])
        changed = held.join(same(nodes), ["id", "hash"], "left_anti").select("id")
        unmentioned = written(old.where("relation = 'MENTIONED_IN'").join(changed, F.col("dst") == F.col("id"), "left_semi").select(*KEYS["edges"]))
        stale, orphans, orphaned = self._unmentioned(base, scope, unmentioned)
        return {
            "nodes": self._put(base, "nodes", before.unionByName(nodes.select("id")).unionByName(orphans), None) + node_folders,
            "edges": self._put(base, "edges", of_documents.unionByName(unmentioned).unionByName(orphaned).unionByName(edges.select(*KEYS["edges"])), None) + edge_folders,
            "entities": self._put(base, "entities", stale, None),
        }

    def _unmentioned(self, base: dict, scope: Scope, mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Mentions (src, dst) that go -> keys of entity rows that go with them, entities that nothing else mentions, and keys of these entities' relations."""
        edges, entities = self.table("edges", base), self.table("entities", base)
        chunk = graph.node_id(F.lit(scope.tenant_id), F.lit(scope.app_id), F.lit(scope.collection_id or ""), "chunk", F.col("chunk_id"))
        stale = entities.withColumn("__c", chunk).join(mentions.select(F.col("src").alias("id"), F.col("dst").alias("__c")), ["id", "__c"], "left_semi")
        left = edges.where("relation = 'MENTIONED_IN'").join(mentions.select("src", "dst"), ["src", "dst"], "left_anti").select(F.col("src").alias("id"))
        orphans = written(mentions.select(F.col("src").alias("id")).distinct().join(left, "id", "left_anti"))
        relations = edges.where("relation = 'SEMANTIC_RELATION'")
        touching = [relations.join(orphans.select(F.col("id").alias(end)), end, "left_semi").select(*KEYS["edges"]) for end in ("src", "dst")]
        return stale.select(*KEYS["entities"]), orphans, touching[0].unionByName(touching[1])

    def enrich(self, replies: DataFrame, scope: Scope) -> DataFrame:
        """replies (document_id, chunk_id, raw) of a model -> counts and warnings for each document; entities and relations join the graph."""
        base = self._manifest()
        read = written(extracted(replies, into="x").select("document_id", "chunk_id", "x.*"))
        rows = graph.entity_rows(read, scope)
        nodes = rows.groupBy("id").agg(F.first("name").alias("label"), F.first("description").alias("text"), F.first("entity_type").alias("entity_type"), F.min("document_id").alias("document_id"))
        node = written(nodes.select("id", F.lit("entity").alias("kind"), F.lit(scope.tenant_id).alias("tenant_id"), F.lit(scope.app_id).alias("app_id"), F.lit(scope.collection_id or "").alias("collection_id"), "document_id", F.col("id").alias("record_id"), F.lit(0).cast("long").alias("position"), "label", "text", F.create_map(F.lit("entity_type"), F.col("entity_type")).alias("properties")))
        # An entity that is known already stays with its first document, and keeps its description if none is told now.
        was = self.table("nodes", base).select("id", F.col("document_id").alias("__d"), F.col("text").alias("__t"))
        node = written(node.join(was, "id", "left").withColumns({"document_id": F.coalesce("__d", "document_id"), "text": F.coalesce(F.nullif(F.trim("text"), F.lit("")), "__t")}).drop("__d", "__t"))
        known = self.table("nodes", base).select("id").unionByName(node.select("id")).distinct()
        edges = written(graph.edges_between(graph.semantic_edges(read, scope), known).dropDuplicates(list(KEYS["edges"])))
        entities = written(rows.select("id", "document_id", "chunk_id", "entity_type", "name", "normalized_name").distinct())
        self._publish(base, nodes=self._put(base, "nodes", node, node), entities=self._put(base, "entities", entities, entities), edges=self._put(base, "edges", edges, edges))
        return totals(read)

    def learn(self, scope: Scope, model: Callable[[str], str]) -> DataFrame:
        """Asks the model for entities and relations of each embeddable chunk with text; a call that fails is a warning, not an error."""

        def ask(text: str) -> str | None:
            try:
                return model(prompt(text))
            except Exception:  # noqa: BLE001  a model's failure must not end the job
                return None

        chunks = self.table("nodes").where(scope.of_graph() & (F.col("kind") == "chunk") & (F.col("properties")["is_embeddable"] == "true") & (F.trim("text") != ""))
        # Written, so that each chunk is asked about once, however often the plan that reads its reply refers to it.
        return self.enrich(written(chunks.select("document_id", F.col("record_id").alias("chunk_id"), mapped(F.col("text"), ask).alias("raw"))), scope)

    def delete(self, document_id: str, scope: Scope) -> int:
        """Deletes a document with its elements, chunks, vectors and edges, and entities that nothing mentions any more; the number of records."""
        base = self._manifest()
        old, old_edges = self.table("nodes", base), self.table("edges", base)
        nodes, edges, told = graph.delete_document(old, old_edges, scope, document_id)
        gone = written(old.select("id").join(nodes.select("id"), "id", "left_anti"))
        gone_edges = old_edges.select(*KEYS["edges"]).join(edges.select(*KEYS["edges"]), list(KEYS["edges"]), "left_anti")
        own = self.table("vectors", base).where(scope.of_vectors() & (F.col("document_id") == document_id))
        deleted = told.first()[0]
        self._publish(base, nodes=self._put(base, "nodes", gone, None), edges=self._put(base, "edges", gone_edges, None), vectors=self._put(base, "vectors", own, None), entities=self._put(base, "entities", self.table("entities", base).join(gone, "id", "left_semi"), None))
        return deleted

    def record_usage(self, events: DataFrame, tries: int = 3) -> int:
        """Adds usage events (a row a model call, in USAGE's columns; missing ones are null) that are not there by event_id; how many were added.

        A repeated batch adds nothing, and a failed one leaves nothing that is seen. If another writer comes first it is tried again.
        """
        there = [(F.col(c) if c in events.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (x.split() for x in USAGE.split(", "))]
        rows = written(events.select(*there).where("event_id is not null").dropDuplicates(["event_id"]))
        for left in reversed(range(tries)):
            base = self._manifest()
            maybe = self._may_hold(base, "usage", rows)
            fresh = rows.join(self.spark.read.schema(USAGE).parquet(*maybe), "event_id", "left_anti") if maybe else rows
            fresh = written(fresh.select(rows.columns))
            if not (n := fresh.count()):
                return 0
            try:
                self._publish(base, usage=self._put(base, "usage", None, fresh))
                return n
            except RuntimeError:
                if not left:
                    raise
        return 0

    def usage(self, scope: Scope) -> DataFrame:
        return self.table("usage").where((F.col("tenant_id") == scope.tenant_id) & (F.col("app_id") == scope.app_id))

    # -- reading -----------------------------------------------------------------------------------------------------
    def search(self, text: str, scope: Scope, k: int = 5, least: float = 0.0) -> DataFrame:
        if not text.strip():
            raise ValueError("the query is blank")
        return vectors.top_k(self.table("vectors"), checked(self.provider, [text], QUERY)[0], k, scope.of_vectors(), least)

    def retrieve(self, text: str, scope: Scope, k: int = 5, least: float = 0.0, listed: str | None = None, queried: str | None = None) -> DataFrame:
        """The compacted context of a query, its sources in the order of SOURCES, with the strategy's label.

        listed and queried are texts of the document registry and of a graph query, where there are any. score is the similarity of a match and 1
        for what the graph adds; metadata tells of a match what its record does, of a graph's chunk its place, neighbours and elements.
        """
        nodes, edges, entities = self.table("nodes"), self.table("edges"), self.table("entities")
        found = self.search(text, scope, k, least).cache()
        own = nodes.where(scope.of_graph() & (F.col("kind") == "chunk"))
        matches = found.join(own.select("id", F.col("record_id").alias("chunk_id")), "chunk_id").select("id", "rank")
        context, related = hybrid(matches, nodes, edges, entities, nodes.where(scope.of_graph() & (F.col("kind") == "entity")).select("id"))
        parent = F.col("pos.o") == 0
        source = lambda name, o, n: F.struct(F.lit(SOURCES.index(name)).alias("o"), o.cast("long").alias("n"), n.alias("i")).alias("pos")
        # No more blocks than that can fit, so no more need an order; chunks of the search may come again among the graph's.
        near = lambda which, name: context.where(which & (F.trim("text") != "")).orderBy("pos").limit(BLOCKS + k).select(source(name, F.col("pos.r"), F.col("pos.i")), "chunk_id", "text", F.lit(name).alias("source"))
        by_vector = found.select(source("vector", F.col("rank"), F.lit("")), "chunk_id", "text", F.lit("vector").alias("source"))
        blocks = near(parent, "graph_parent").unionByName(by_vector).unionByName(near(~parent, "graph"))
        for name, text_block in (("document_registry", listed), ("graph_query", queried)):
            if text_block:
                blocks = blocks.unionByName(self.spark.range(1).select(source(name, F.lit(0), F.lit("")), F.lit(f"{name}:0").alias("chunk_id"), F.lit(text_block).alias("text"), F.lit(name).alias("source")))
        blocks = blocks.withColumn("query_id", F.lit(1))
        counts = found.agg(F.count("*").alias("v")).crossJoin(context.agg(F.count("*").alias("g"))).crossJoin(related.agg(F.count("*").alias("e")))  # one row each
        label = counts.select(retrieval_strategy(F.col("v"), F.col("g"), F.col("e"), F.lit(bool(queried))).alias("strategy"), F.col("g").alias("n_graph"), F.col("e").alias("n_entities"))
        # What is known of each block's chunk: its score (1 for the graph's own), place and neighbours, as JSON.
        near_told = context.select("chunk_id", F.to_json(F.struct("document_id", "chunk_index", "previous_chunk_id", "next_chunk_id", "parent_chunk_id", F.transform("source_elements", lambda e: e["element_id"]).alias("element_ids"))).alias("__near"))
        scores = found.select("chunk_id", "similarity", F.col("metadata").alias("__own"))
        told = compact(blocks).join(scores, "chunk_id", "left").join(near_told, "chunk_id", "left")
        by_score = F.when(F.col("source") == "vector", F.col("similarity")).otherwise(F.lit(1.0))
        about = F.when(F.col("source") == "vector", F.coalesce("__own", "__near")).otherwise(F.col("__near"))
        return told.withColumns({"score": by_score, "metadata": about}).drop("similarity", "__own", "__near", "query_id").crossJoin(F.broadcast(label)).orderBy("reference")

    def structured(self, question: str, scope: Scope, planner: Callable[[str, str], str | dict | None], most: int = 30) -> str | None:
        """What a planned query returns within the scope, as text: a JSON row a line. None if none is planned or it fails.

        planner(question, the views' columns) gives a graph pattern (operators.patterns.pattern_of) or SQL over the views, or None where
        the question needs no query.
        """
        try:
            plan = planner(question, self.described())
            found = self.match(plan, scope) if isinstance(plan, dict) else self.query(plan, scope) if plan else None
            rows = found.limit(most).toJSON().collect() if found is not None else []
        except Exception:  # noqa: BLE001  a plan that fails leaves the other sources
            return None
        return "\n".join(rows) or None

    def described(self) -> str:
        """The views that a planned query may name, a line each, and what joins them."""
        return "\n".join([*(f"{name}({TABLES[name]})" for name in VIEWS), f"edges join nodes.id by src and dst; relation is one of {', '.join(RELATIONS)}; kind of a node is one of {', '.join(graph.KINDS)}"])

    def answer(self, message: str, scope: Scope, model: Callable[[str], str], planner: Callable[[str, str], str | dict | None] | None = None, documents: DataFrame | None = None, history: str = "", k: int = 5, least: float = 0.0) -> dict:
        """response_type, answer, references and strategy of a message. The model sees the compacted context; the policy judges its reply.

        Restricted topics are refused unseen. documents is the registry, whose newest rows join the context of questions
        about what is there. A model that fails gives a refusal.
        """
        kind = self.route(message)
        if kind == "restricted":
            return {"response_type": "refusal", "answer": REFUSAL, "references": [], "strategy": "restricted"}
        listed = registry.inventory(documents, scope).first()["text"] if kind == "inventory" and documents is not None else None
        queried = self.structured(message, scope, planner) if planner else None
        blocks = written(self.retrieve(message, scope, k, least, listed, queried))
        shown = rendered(blocks.withColumn("query_id", F.lit(1))).first()
        try:
            raw = model("\n\n".join(x for x in (history, f"Context:\n{shown['context']}" if shown else "", f"Question: {message}") if x))
        except Exception:  # noqa: BLE001
            raw = None
        refs = [r[0] for r in blocks.select("reference").collect()]  # at most BLOCKS
        one = self.spark.createDataFrame([(raw, refs)], "raw string, refs array<int>").select(decision(F.col("raw"), F.col("refs"), F.size("refs") > 0).alias("d")).select("d.*")
        counts = blocks.agg(F.coalesce(F.max("n_entities"), F.lit(0)).alias("e"), F.coalesce(F.max("n_graph"), F.lit(0)).alias("g"), F.count("*").alias("n"))
        return one.crossJoin(counts).select("response_type", "answer", "references", response_strategy(F.col("response_type"), F.col("n"), F.lit(bool(listed)), F.col("e"), F.col("g")).alias("strategy")).first().asDict()

    def route(self, message: str) -> str:
        """restricted, inventory or retrieval."""
        normal = policy_text(F.lit(message))
        row = self.spark.range(1).select(normal.alias("n")).select(restricted_topic(F.col("n")).alias("r"), inventory_question(F.col("n")).alias("i")).first()
        return "restricted" if row["r"] else "inventory" if row["i"] else "retrieval"

    def graph(self, scope: Scope, limit: int = 2000) -> tuple[DataFrame, DataFrame]:
        shown = graph.payload_nodes(self.table("nodes"), scope, limit)
        return shown, graph.payload_edges(self.table("edges"), shown, limit)

    def health(self, scope: Scope, profiles: DataFrame, limit: int | None = 10_000) -> DataFrame:
        return health.report(self.table("vectors").where(scope.of_vectors()), self.chunk_stats(scope), profiles, limit)

    def views(self, scope: Scope, spark: SparkSession | None = None) -> dict[str, DataFrame]:
        """The tables as the scope sees them; an edge is seen if both its ends are."""
        base, spark = self._manifest(), spark or self.spark
        nodes = self.table("nodes", base, spark).where(scope.of_graph())
        return {
            "nodes": nodes,
            "edges": graph.edges_between(self.table("edges", base, spark), nodes),
            "vectors": self.table("vectors", base, spark).where(scope.of_vectors()),
            "entities": self.table("entities", base, spark).join(nodes.where("kind = 'entity'").select("id"), "id", "left_semi"),
        }

    def match(self, pattern: dict, scope: Scope) -> DataFrame:
        """What a graph pattern, as plain JSON, finds in the scope."""
        base = self._manifest()
        return match(self.table("nodes", base), self.table("edges", base), pattern_of(pattern), scope)

    def chunk_stats(self, scope: Scope) -> DataFrame:
        """health.chunk_stats of the scope, from the summaries: no row of nodes is read."""
        rows = self.summary("nodes").where(scope.of_graph() & (F.col("kind") == "chunk"))
        return rows.groupBy("document_id").agg(F.sum("n").alias("chunk_count"), F.sum(F.when(F.col("is_embeddable"), F.col("n")).otherwise(0)).alias("embeddable_chunk_count"))

    def node_counts(self, scope: Scope) -> DataFrame:
        """(kind, n) of the scope, larger counts first, from the summaries."""
        return self.summary("nodes").where(scope.of_graph()).groupBy("kind").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "kind")

    def embedded_counts(self, scope: Scope) -> DataFrame:
        """Vectors of each (document, profile, model, dimension) of the scope, from the summaries."""
        return self.summary("vectors").where(scope.of_vectors()).groupBy("document_id", "embedding_profile_id", "embedding_model", "vector_dimension").agg(F.sum("n").alias("embedded_count"))

    def query(self, text: str, scope: Scope, **args) -> DataFrame:
        """A SQL query over the views nodes, edges, vectors and entities of a scope; only queries over these are let through.

        It runs in a session of its own, whose names are these views alone.
        """
        guarded, session = read_only(self.spark, text), self.spark.newSession()
        for name, rows in self.views(scope, session).items():
            rows.createOrReplaceTempView(name)
        return session.sql(guarded, args=args or None)


#: Words that a graph query must not hold, and those of which it must hold one.
WRITES = ("create", "merge", "set", "delete", "detach", "drop", "alter", "copy", "install", "load", "remove", "rename", "truncate")
READS = ("match", "return", "with", "unwind", "call")


def query_text(text: str | None, *labels: str) -> str:
    """A generated query without the fence and label that models put around it, and without semicolons behind it."""
    body = (text or "").strip()
    if len(body) >= 6 and body.startswith("```") and body.endswith("```"):
        body = body[3:-3]
        body = next((body[len(x) :] for x in labels if body.lower().startswith(x)), body)
    return body.strip().rstrip("; \n\t")


def only_reads(query: Column) -> Column:
    """A graph query has a word that reads and none that writes."""
    words = F.split(F.lower(query), "\\W+")
    return F.arrays_overlap(words, F.array(*map(F.lit, READS))) & ~F.arrays_overlap(words, F.array(*map(F.lit, WRITES)))


def guarded_cypher(text: str | None) -> str:
    """A generated graph query, cleaned; raises ValueError unless it only reads."""
    query = query_text(text, "cypher", "opencypher")
    words = set(re.split(r"\W+", query.lower()))
    if words.isdisjoint(READS) or not words.isdisjoint(WRITES):
        raise ValueError("only reading graph queries are allowed")
    return query


def read_only(spark: SparkSession, text: str, relations: tuple[str, ...] = VIEWS) -> str:
    """A SQL text, cleaned; raises ValueError unless it is one query over the relations, with built-in functions alone."""
    query = query_text(text, "sql")
    check_query(spark, query, relations)
    return query
