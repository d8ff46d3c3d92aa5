"""The document graph as two tables, nodes and edges: building, context, traversal, payloads and deletes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import edge_id, entity_id, entity_key, keyed_entity_id, node_id
from ..functions.labels import chunk_label, document_label
from ..functions.text import bound
from ..schema import RELATIONS, Scope
from ..storage import own_dir

EDGE = ("src", "dst", "relation", "kind", "description", "confidence")
KINDS = ("document", "element", "chunk", "entity")
MOST_HOPS = 5
#: What a chunk's context tells of an element; elements are in this order.
ELEMENT_FIELDS = ("order_index", "element_id", "element_type", "text")
#: Characters of a name that the index holds together.
GRAM = 3
#: Entities of a reply that a local id is looked up among one by one.
MANY = 64


def clamp_hops(hops: int) -> int:
    return max(0, min(MOST_HOPS, hops))


def _ids(scope: Scope, kind: str, record: Column) -> Column:
    return node_id(F.lit(scope.tenant_id), F.lit(scope.app_id), F.lit(scope.collection_id or ""), kind, record)


def _edges(rows: DataFrame, src: Column, dst: Column, relation: str) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.lit("").alias("kind"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("double").alias("confidence"))


def structure_edges(chunks: DataFrame, elements: DataFrame, scope: Scope) -> DataFrame:
    """Document to element and chunk, chunk to the elements it comes from, to the next of its role and to its parent."""
    doc, part = _ids(scope, "document", F.col("document_id")), _ids(scope, "chunk", F.col("chunk_id"))
    named = chunks.select("document_id", "chunk_id", "chunk_index", "chunk_role", "parent_chunk_id", "source_element_ids")
    derived = named.select("document_id", "chunk_id", F.explode(F.array_distinct("source_element_ids")).alias("element_id")).join(elements.select("document_id", "element_id"), ["document_id", "element_id"], "left_semi")
    held = derived.select("document_id", "element_id").distinct()  # before ids are made: rows lie by these columns, and the node ids follow from them
    element = _ids(scope, "element", F.col("element_id"))
    order = Window.partitionBy("document_id", F.coalesce("chunk_role", F.lit("chunk"))).orderBy("chunk_index")
    following = named.withColumn("__next", F.lead("chunk_id").over(order)).where("__next is not null")
    # A family meets under its parent's id, where rows of a document lie already: chunks need not be computed again to be joined with themselves.
    member = lambda key, child: F.struct(F.col(key).alias("parent_chunk_id"), child.cast("string").alias("chunk_id"))
    family = named.select("document_id", F.inline(F.array(member("chunk_id", F.lit(None)), member("parent_chunk_id", F.col("chunk_id"))))).where("parent_chunk_id is not null")
    there = F.max(F.col("chunk_id").isNull()).over(Window.partitionBy("document_id", "parent_chunk_id"))
    parents = family.withColumn("__there", there).where("__there and chunk_id is not null")
    return reduce(DataFrame.unionByName, [
        _edges(held, doc, element, "HAS_ELEMENT"), _edges(named, doc, part, "HAS_CHUNK"), _edges(derived, part, element, "DERIVED_FROM"),
        _edges(following, part, _ids(scope, "chunk", F.col("__next")), "NEXT_CHUNK"), _edges(parents, part, _ids(scope, "chunk", F.col("parent_chunk_id")), "PARENT_CHUNK")])


def structure_nodes(documents: DataFrame, elements: DataFrame, chunks: DataFrame, scope: Scope) -> DataFrame:
    """Nodes of documents that have chunks, of the elements that chunks come from, and of chunks."""
    used = chunks.select("document_id", F.explode("source_element_ids").alias("element_id")).distinct()
    scoped = [F.lit(scope.tenant_id).alias("tenant_id"), F.lit(scope.app_id).alias("app_id"), F.lit(scope.collection_id or "").alias("collection_id")]
    nothing = F.create_map().cast("map<string,string>")

    def nodes(rows: DataFrame, kind: str, record: str, position: Column, label: Column, text: Column, properties: Column) -> DataFrame:
        return rows.select(_ids(scope, kind, F.col(record)).alias("id"), F.lit(kind).alias("kind"), *scoped, "document_id", F.col(record).alias("record_id"), position.cast("long").alias("position"), label.alias("label"), text.alias("text"), properties.alias("properties"))

    docs = documents.join(chunks.select("document_id").distinct(), "document_id", "left_semi")
    title, name = (F.col(c) if c in documents.columns else F.lit(None).cast("string") for c in ("title", "filename"))
    d = nodes(docs, "document", "document_id", F.lit(0), document_label(title, name, F.col("document_id")), F.lit(None).cast("string"), nothing)
    e = nodes(elements.join(used, ["document_id", "element_id"], "left_semi"), "element", "element_id", F.col("order"), F.col("element_type"), F.coalesce("text", F.lit("")), nothing)
    c = nodes(chunks, "chunk", "chunk_id", F.col("chunk_index"), chunk_label(F.col("chunk_index"), F.col("text")), F.col("text"), F.map_filter(F.create_map(F.lit("chunk_role"), F.col("chunk_role"), F.lit("content_hash"), F.col("content_hash"), F.lit("is_embeddable"), F.col("is_embeddable").cast("string"), F.lit("parent_chunk_id"), F.col("parent_chunk_id")), lambda k, v: v.isNotNull()))
    return d.unionByName(e).unionByName(c)


def records(documents: DataFrame, elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """What the graph is told of: a record for each document, element and chunk, tagged by its type."""
    nothing = F.lit(None)
    kind = lambda name, rows, record, position, text: rows.select(name.alias("record_type"), "document_id", record.alias("record_id"), position.cast("long").alias("position"), text.cast("string").alias("text"))
    return kind(F.lit("document"), documents, F.col("document_id"), nothing, nothing).unionByName(kind(F.concat(F.lit("document_element:"), "element_type"), elements, F.col("element_id"), F.col("order"), F.col("text"))).unionByName(kind(F.lit("chunk"), chunks, F.col("chunk_id"), F.col("chunk_index"), F.col("text")))


def entity_rows(extracted: DataFrame, scope: Scope) -> DataFrame:
    """extracted: (document_id, chunk_id, entities) -> a row for each entity of a chunk, with its node id."""
    e = extracted.select("document_id", "chunk_id", F.explode("entities").alias("e")).select("document_id", "chunk_id", "e.*")
    return e.withColumn("id", entity_id(F.lit(scope.tenant_id), F.lit(scope.app_id), F.lit(scope.collection_id or ""), F.lower("entity_type"), F.col("normalized_name")))


def _dealt(keys: Column) -> Column:
    """The entities of a reply in parts by their local ids' hash. Replies may be as long as texts: of n entities beyond MANY, sqrt(n) parts are made."""
    parts = F.ceil(F.sqrt(F.size(keys))).cast("int")
    own = lambda at: F.filter(keys, lambda e: F.pmod(F.hash(e["local_id"]), parts) == at)
    return F.when(F.size(keys) > MANY, F.transform(F.sequence(F.lit(0), parts - 1), own)).otherwise(F.array(keys))


def _resolved(entities: Column, relations: Column) -> Column:
    """The relations of a reply between keys of its entities, each found among a part of them."""
    keys = F.transform(entities, lambda e: F.struct(e["local_id"].alias("local_id"), entity_key(F.lower(e["entity_type"]), e["normalized_name"]).alias("key")))

    def linked(dealt: Column) -> Column:
        part = lambda local: F.get(dealt, F.pmod(F.hash(local), F.size(dealt)))
        found = lambda local: F.get(part(local), F.array_position(part(local)["local_id"], local).cast("int") - 1)["key"]
        told = F.transform(relations, lambda r: F.struct(found(r["source_id"]).alias("s"), found(r["target_id"]).alias("t"), r["relation_type"].alias("kind"), r["description"].alias("description"), r["confidence"].alias("confidence")))
        return F.filter(told, lambda x: x["s"].isNotNull() & x["t"].isNotNull())

    return bound(bound(keys, _dealt), linked)


def semantic_edges(extracted: DataFrame, scope: Scope) -> DataFrame:
    """MENTIONED_IN and SEMANTIC_RELATION edges; local ids are resolved within their reply, those that have no entity are skipped.

    Of relations with one (source, target, type) the last chunk's counts. Rows are grouped by what the ids are hashes of. extracted is read twice, so it should be a table.
    """
    e = extracted.select("chunk_id", F.explode("entities").alias("e")).select("chunk_id", entity_key(F.lower("e.entity_type"), F.col("e.normalized_name")).alias("key")).distinct()
    id_of = lambda key: keyed_entity_id(F.lit(scope.tenant_id), F.lit(scope.app_id), F.lit(scope.collection_id or ""), F.col(key))
    mentions = _edges(e, id_of("key"), _ids(scope, "chunk", F.col("chunk_id")), "MENTIONED_IN")
    linked = extracted.where("chunk_id is not null").select("chunk_id", F.explode(_resolved(F.col("entities"), F.col("relations"))).alias("r")).select("chunk_id", "r.*")
    last = linked.groupBy("s", "t", "kind").agg(F.max(F.struct("chunk_id", "description", "confidence")).alias("v"))
    return mentions.unionByName(last.select(id_of("s").alias("src"), id_of("t").alias("dst"), F.lit("SEMANTIC_RELATION").alias("relation"), "kind", "v.description", "v.confidence"))


def merge_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """edges with the new ones in place of those of one (src, dst, relation, kind); edges to missing nodes are dropped."""
    key = ["src", "dst", "relation", "kind"]
    if nodes is not None:
        ids = nodes.select("id").distinct()
        new = new.join(ids, new["src"] == ids["id"], "left_semi").join(ids, new["dst"] == ids["id"], "left_semi")
    once = new.dropDuplicates(key)
    return edges.join(once.select(*key), key, "left_anti").select(*EDGE).unionByName(once.select(*EDGE))


def chunk_context(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, fields: tuple[str, ...] = ELEMENT_FIELDS) -> DataFrame:
    """wanted: (id, pos) -> the chunks in order of pos with previous, next and parent chunk and source elements; missing ones go.

    One pass over the edges that touch a wanted chunk, aggregated per chunk, in place of five look-ups for each. fields: what is told of an
    element. All chunks of an element repeat it, so its text is for few chunks: for all of them it is the square of a long element.
    """
    first = wanted.groupBy("id").agg(F.min("pos").alias("pos"))
    forward = edges.where(F.col("relation").isin("NEXT_CHUNK", "PARENT_CHUNK", "DERIVED_FROM")).select(F.col("src").alias("id"), F.when(F.col("relation") == "NEXT_CHUNK", "next").when(F.col("relation") == "PARENT_CHUNK", "parent").otherwise("element").alias("role"), F.col("dst").alias("other"))
    back = edges.where("relation = 'NEXT_CHUNK'").select(F.col("dst").alias("id"), F.lit("previous").alias("role"), F.col("src").alias("other"))
    touching = forward.unionByName(back).join(first.select("id"), "id", "left_semi")
    ends = nodes.where(F.col("kind").isin("element", "chunk"))
    told = touching.join(ends.select(F.col("id").alias("other"), F.col("position").alias("order_index"), F.col("record_id").alias("element_id"), F.col("label").alias("element_type"), "text"), "other")
    one = lambda role: F.min(F.when(F.col("role") == role, F.col("element_id"))).alias(f"{role}_chunk_id")
    element = F.struct(*[f for f in ELEMENT_FIELDS if f in fields])
    around = told.groupBy("id").agg(one("previous"), one("next"), one("parent"), F.array_sort(F.collect_list(F.when(F.col("role") == "element", element))).alias("source_elements"))
    chunks = nodes.where("kind = 'chunk'").join(first, "id").join(around, "id", "left")
    parent = F.coalesce("parent_chunk_id", F.nullif(F.col("properties")["parent_chunk_id"], F.lit("")))
    return chunks.select("pos", "id", F.col("record_id").alias("chunk_id"), "document_id", F.col("position").alias("chunk_index"), "text", "previous_chunk_id", "next_chunk_id", parent.alias("parent_chunk_id"), F.coalesce("source_elements", F.array()).alias("source_elements"))


def seeds_of_chunks(edges: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Entities that the chunks (id) mention."""
    return edges.where("relation = 'MENTIONED_IN'").join(chunk_ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def seeds_of_names(entities: DataFrame, names: list[str]) -> DataFrame:
    """Entities whose normal name contains any of the (normal) names; blank names are skipped.

    The names of a request are literals of one pattern, so there is no join at all.
    """
    import re

    known = "|".join(sorted({re.escape(n) for n in names if n.strip()}))
    return entities.where(F.col("normalized_name").rlike(known) if known else F.lit(False)).select("id").distinct()


def _grams(name: Column) -> Column:
    """The distinct runs of GRAM characters of a name."""
    n = F.length(name) - GRAM + 1
    return F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(name, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>")))


def name_postings(entities: DataFrame) -> DataFrame:
    """(gram, id) for each three characters of each entity's normalized_name: an index that a writer sorts by gram, so that a
    search reads the row groups of its grams alone."""
    return entities.select(F.explode(_grams(F.col("normalized_name"))).alias("gram"), "id").distinct()


def seeds_of_names_indexed(entities: DataFrame, postings: DataFrame, names: list[str]) -> DataFrame:
    """seeds_of_names by the index: entities that hold every gram of a name are looked up and verified, others are not read.

    The grams of the request are literals that reach the scan of postings. A name shorter than a gram has none, so it is looked for in all
    entities; the work for other names is that of their grams' postings.
    """
    wanted = sorted({n for n in names if n.strip()})
    long = [n for n in wanted if len(n) >= GRAM]
    found = seeds_of_names(entities, [n for n in wanted if len(n) < GRAM])
    if long:
        grams = {n: sorted({n[i : i + GRAM] for i in range(len(n) - GRAM + 1)}) for n in long}
        met = postings.where(F.col("gram").isin(sorted({g for x in grams.values() for g in x})))
        has = [F.count_if(F.col("gram").isin(x)) == len(x) for x in grams.values()]
        candidates = met.groupBy("id").agg(reduce(lambda a, b: a | b, has).alias("all")).where("all").select("id")
        found = found.unionByName(seeds_of_names(entities.join(candidates, "id", "left_semi"), long))
    return found.distinct()


def scan_nodes(nodes: DataFrame, kind: str | None = None, ids: list[str] | None = None, equals: dict[str, str] | None = None) -> DataFrame:
    """Nodes of a kind, of the named ids, and whose properties all equal the given ones; an empty list of ids gives none."""
    rows = nodes if kind is None else nodes.where(F.col("kind") == kind)
    rows = rows if ids is None else rows.where(F.col("id").isin(*ids)) if ids else rows.where(F.lit(False))
    for name, value in (equals or {}).items():
        rows = rows.where(F.col("properties")[name] == value)
    return rows


def _both_ways(edges: DataFrame, in_scope: DataFrame | None) -> DataFrame:
    """(a, b) for each end of each SEMANTIC_RELATION edge whose source is in the scope."""
    links = edges.where("relation = 'SEMANTIC_RELATION'").select("src", "dst")
    if in_scope is not None:
        links = links.join(in_scope.select(F.col("id").alias("src")), "src", "left_semi")
    return links.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(links.select(F.col("dst").alias("a"), F.col("src").alias("b")))


def adjacency(edges: DataFrame, buckets: int, in_scope: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """The links that traverse() follows as a table of its own, bucketed and sorted by their first end: hops over it move the frontier to the
    links and never shuffle the links. A bucket should hold some 100 MB. The table is called `name`, by default one of its own; a session's
    user drops it by that name, its files go with the application's folder."""
    spark, name = edges.sparkSession, name or f"adjacency_{uuid.uuid4().hex}"
    once = _both_ways(edges, in_scope).repartition(buckets, "a").distinct()  # by (a, b), which rows dealt by a need no further shuffle for
    once.write.bucketBy(buckets, "a").sortBy("a").option("path", f"{own_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def traverse(edges: DataFrame | None, seeds: DataFrame, hops: int = 2, in_scope: DataFrame | None = None, adjacent: DataFrame | None = None) -> DataFrame:
    """(id, hop) of entities within `hops` undirected SEMANTIC_RELATION steps of the seeds (id), each with its first hop.

    in_scope: entity nodes (id) that a relation's source must be one of. Hops are at most five; each is one join with the
    frontier and one anti-join with what was seen. adjacent: the table of `adjacency`, in place of edges and in_scope.
    """
    both = _both_ways(edges, in_scope).distinct() if adjacent is None else adjacent
    seen = frontier = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, clamp_hops(hops) + 1):
        step = both.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def mentioning_chunks(edges: DataFrame, entities: DataFrame) -> DataFrame:
    return edges.where("relation = 'MENTIONED_IN'").join(entities.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def triplets(edges: DataFrame, nodes: DataFrame, ids: list[str] | None = None, relations: list[str] | None = None) -> DataFrame:
    """Edges with the labels of both ends, of the named nodes and relations."""
    e = edges if relations is None else edges.where(F.col("relation").isin(*relations))
    if ids is not None:
        e = e.where(F.col("src").isin(*ids) | F.col("dst").isin(*ids)) if ids else e.where(F.lit(False))
    end = lambda p: nodes.select(F.col("id").alias(p), F.col("kind").alias(f"{p}_kind"), F.col("label").alias(f"{p}_label"))
    return e.select("src", "relation", F.col("kind").alias("relation_kind"), "dst").join(end("src"), "src").join(end("dst"), "dst")


def relation_map(edges: DataFrame, seeds: DataFrame, depth: int = 2, ignore: tuple[str, ...] = (), limit: int = 30) -> DataFrame:
    """(level, src, relation, kind, dst) of edges met from the seeds over all relations, undirected, up to `limit` in order.

    An edge that is met at several levels is told at each.
    """
    used = edges.where(~F.col("relation").isin(*ignore)) if ignore else edges
    used = used.select("src", "relation", "kind", "dst")
    seen = frontier = seeds.select("id").distinct()
    found = None
    for level in range(1, clamp_hops(depth) + 1):
        out = used.join(frontier.select(F.col("id").alias("src")), "src", "left_semi")
        back = used.join(frontier.select(F.col("id").alias("dst")), "dst", "left_semi")
        met = out.unionByName(back).distinct().withColumn("level", F.lit(level))
        found = met if found is None else found.unionByName(met)
        ends = met.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        frontier = ends.join(seen, "id", "left_anti")
        seen = seen.unionByName(frontier)
    if found is None:
        return used.where(F.lit(False)).withColumn("level", F.lit(0)).select("level", "src", "relation", "kind", "dst")
    return found.select("level", "src", "relation", "kind", "dst").orderBy("level", "src", "relation", "dst", "kind").limit(limit)


def _ordinal(column: str, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col(column)), F.lit(len(names) + 1))


def payload_nodes(nodes: DataFrame, scope: Scope, limit: int = 2000) -> DataFrame:
    """Documents, then elements, chunks and entities, each by id, up to the limit (1 to 10 000)."""
    return nodes.where(scope.of_graph()).orderBy(_ordinal("kind", KINDS), "id").limit(max(1, min(10_000, limit)))


def payload_edges(edges: DataFrame, shown: DataFrame, limit: int = 2000) -> DataFrame:
    """Edges between shown nodes, in the order of relations, up to four times the node limit, with their ids."""
    order = ("HAS_ELEMENT", "HAS_CHUNK", "DERIVED_FROM", "NEXT_CHUNK", "PARENT_CHUNK", "SEMANTIC_RELATION", "MENTIONED_IN")
    ids = F.broadcast(shown.select("id"))  # at most 10 000 ids, by payload_nodes' limit
    kept = edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")
    named = F.when(F.col("relation") == "SEMANTIC_RELATION", F.col("kind")).otherwise(F.col("relation"))
    told = kept.withColumn("edge_id", edge_id(F.col("src"), named, F.col("dst")))
    return told.orderBy(_ordinal("relation", order), "src", "dst", "kind").limit(4 * max(1, min(10_000, limit)))


def payload_stats(shown: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, n): nodes by kind and edges by relation, larger counts first."""
    n = shown.groupBy(F.lit("node").alias("what"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    e = edges.groupBy(F.lit("edge").alias("what"), F.col("relation").alias("name")).agg(F.count("*").alias("n"))
    return n.unionByName(e).orderBy(F.desc("what"), F.desc("n"), "name")


def orphan_entities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that no chunk mentions."""
    return nodes.where("kind = 'entity'").join(edges.where("relation = 'MENTIONED_IN'").select(F.col("src").alias("id")), "id", "left_anti")


def delete_document(nodes: DataFrame, edges: DataFrame, scope: Scope, document_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, a row with the number deleted): the document with its elements and chunks, then entities left without a mention."""
    own = scope.of_graph() & (F.col("document_id") == document_id) & F.col("kind").isin("document", "element", "chunk")
    gone = nodes.where(own)
    told = gone.where("kind <> 'document'").agg((F.count("*") + 1).alias("deleted"))
    left = nodes.where(~F.coalesce(own, F.lit(False)))
    kept = edges_between(edges, left)
    orphans = orphan_entities(left.where(scope.of_graph()), kept).select("id")
    left = left.join(orphans, "id", "left_anti")
    return left, edges_between(kept, left), told


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = nodes.join(ids.select("id"), "id", "left_anti")
    return left, edges_between(edges, left)


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def schema_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind of source, relation, kind of target, n): the graph's schema as it is."""
    k = lambda p: nodes.select(F.col("id").alias(p), F.col("kind").alias(f"{p}_kind"))
    return edges.select("src", "relation", "dst").join(k("src"), "src").join(k("dst"), "dst").groupBy("src_kind", "relation", "dst_kind").agg(F.count("*").alias("n"))


def schema_text(schema: DataFrame) -> DataFrame:
    """schema_of's rows as one text, a line each in order: what a planner is shown."""
    line = F.concat(F.lit("(:"), "src_kind", F.lit(")-[:"), "relation", F.lit("]->(:"), "dst_kind", F.lit(") "), F.col("n").cast("string"))
    return schema.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))  # a row for each kind of edge


assert len(RELATIONS) == 7
