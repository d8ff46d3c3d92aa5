"""Queries over vectors, graph, health, context, registry and configuration, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.embedding import HashingEmbedder, embedded
from ..functions.labels import retrieval_strategy, score_percent
from ..functions.text import content_hash
from ..functions.vectors import cosine
from ..operators import chunking, config, context, graph, health, registry, vectors
from ..schema import Scope
from ..storage import own_dir, written
from . import corpus
from .catalog_text import CHUNKS, WS
from .engine import hybrid

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


COS = "list_cosine_similarity(e.embedding::double[], q.v)"
CLAMP = "greatest(0.0, least(1.0, {}))"


def vector_of(spark, sf, vec_id: int) -> list[float]:
    """One row's vector."""
    return list(corpus.table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


# -- vectors -------------------------------------------------------------------------------------------------------------
@query(f"""with q as (select embedding::double[] as v from embeddings where vec_id = 0), r as (select e.vec_id as vector_id, {COS} as raw from embeddings e, q),
k as (select *, row_number() over (order by raw desc, vector_id) as "rank" from r)
select vector_id, "rank", round({CLAMP.format("raw")}, 6) as similarity, round(1 - {CLAMP.format("raw")}, 6) as distance from k where "rank" <= 10""")
def k01_vector_topk(spark, sf):
    top = vectors.top_k(corpus.vectors(spark, sf), vector_of(spark, sf, 0), 10)
    return top.select("vector_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"))


@query(f"""with q as (select embedding::double[] as v, label from embeddings where vec_id = 1), r as (select e.vec_id as vector_id, {COS} as raw from embeddings e, q where e.label = q.label)
select vector_id, round({CLAMP.format("raw")}, 6) as similarity from r where {CLAMP.format("raw")} >= 0.1 order by raw desc, vector_id limit 25""")
def p06_scoped_threshold(spark, sf):
    row = corpus.table(spark, sf, "embeddings").where("vec_id = 1").select("embedding", "label").first()
    scope = Scope("t", "a", str(row["label"])).of_vectors()
    return vectors.top_k(corpus.vectors(spark, sf), list(row["embedding"]), 25, scope, 0.1).select("vector_id", F.round("similarity", 6).alias("similarity"))


@query(f"""with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 20 = 0), r as (select q.query_id, e.vec_id as vector_id, {COS} as raw from embeddings e, q where e.vec_id <> q.query_id),
k as (select *, row_number() over (partition by query_id order by round(raw, 12) desc, vector_id) as "rank" from r)
select query_id, "rank", vector_id, round({CLAMP.format("raw")}, 6) as similarity from k where "rank" <= 5""")
def k02_batch_topk(spark, sf):
    v = corpus.vectors(spark, sf)
    asked = v.where("vector_id % 20 = 0").select(F.col("vector_id").alias("query_id"), "vector")
    return vectors.batch_top_k(v, asked, 5, exclude_own=True).select("query_id", F.col("rank").cast("long").alias("rank"), "vector_id", F.round("similarity", 6).alias("similarity"))


@query("""with a as (select vec_id, embedding::double[] as x, lead(embedding) over (order by vec_id)::double[] as y from embeddings)
select vec_id, round(list_cosine_similarity(x, y), 6) as raw, round(greatest(2.0, least(100.0, 100 * greatest(0.0, least(1.0, list_cosine_similarity(x, y))))), 4) as width from a where y is not null""")
def s01_cosine_pairs(spark, sf):
    e = corpus.table(spark, sf, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id").withColumn("raw", cosine(F.col("embedding"), F.col("next")))
    return pairs.select("vec_id", F.round("raw", 6).alias("raw"), F.round(score_percent(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "raw"))), 4).alias("width"))


@query("""with old as (select vec_id, label from embeddings where label <> 3), new as (select vec_id, label + 100 as label from embeddings where label >= 2)
select * from new union all select * from old where vec_id not in (select vec_id from new)""")
def snk02_vector_upsert(spark, sf):
    e = corpus.table(spark, sf, "embeddings").select("vec_id", "label")
    return vectors.upsert(e.where("label <> 3"), e.where("label >= 2").withColumn("label", F.col("label") + 100), "vec_id")


@query("""select count(*) as deleted from embeddings where vec_id % 50 = 7""")
def snk08_delete_vectors(spark, sf):
    return vectors.delete_document(corpus.vectors(spark, sf), corpus.SCOPE, "7")[1]


@query("""select vec_id as vector_id, (vec_id % 50)::varchar as document_id from embeddings where label = 3 order by vec_id limit 40""")
def src18_vector_scan(spark, sf):
    return vectors.scan(corpus.vectors(spark, sf), Scope("t", "a", "3"), limit=40).select("vector_id", "document_id")


# -- the structure graph -----------------------------------------------------------------------------------------------
@query(f"""with {CHUNKS}, d as (select document_id, chunk_id, unnest(string_split(element_ids, ',')) as el from chunks), nx as (select chunk_id, lead(chunk_id) over (partition by document_id order by chunk_index) as nxt from chunks),
e as (select 't:a::document:' || document_id as src, 't:a::chunk:' || chunk_id as dst, 'HAS_CHUNK' as relation from chunks
union all select distinct 't:a::document:' || document_id, 't:a::element:' || el, 'HAS_ELEMENT' from d union all select distinct 't:a::chunk:' || chunk_id, 't:a::element:' || el, 'DERIVED_FROM' from d
union all select 't:a::chunk:' || chunk_id, 't:a::chunk:' || nxt, 'NEXT_CHUNK' from nx where nxt is not null)
select relation, src, dst from e""")
def j01_structure_edges(spark, sf):
    return corpus.graph_edges(spark, sf).select("relation", "src", "dst")


@query(f"""with {CHUNKS}, nx as (select chunk_id, lead(chunk_id) over w as nxt from chunks window w as (partition by document_id order by chunk_index))
select chunk_id as src, nxt as dst from nx where nxt is not null""")
def j03_next_chunk(spark, sf):
    edges = corpus.graph_edges(spark, sf)
    cut = lambda c: F.regexp_replace(c, "^t:a::chunk:", "")
    return edges.where("relation = 'NEXT_CHUNK'").select(cut("src").alias("src"), cut("dst").alias("dst"))


@query(f"""with {CHUNKS} select 'chunk' as kind, count(*) as n from chunks union all select 'document', count(distinct document_id) from chunks union all select 'element', count(distinct el) from (select unnest(string_split(element_ids, ',')) as el from chunks)""")
def snk03_structure_nodes(spark, sf):
    return corpus.graph_nodes(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""with {CHUNKS}, w as (select *, lag(chunk_id) over p as prv, lead(chunk_id) over p as nxt from chunks window p as (partition by document_id order by chunk_index))
select chunk_id, document_id, chunk_index, prv as previous_chunk_id, nxt as next_chunk_id, len(string_split(element_ids, ','))::bigint as n_elements from w""")
def j07_chunk_context(spark, sf):
    nodes, edges = corpus.graph_outline(spark, sf)
    wanted = nodes.where("kind = 'chunk'").select("id", F.col("position").alias("pos"))
    c = graph.chunk_context(nodes, edges, wanted, ("order_index", "element_id"))
    return c.select("chunk_id", "document_id", "chunk_index", "previous_chunk_id", "next_chunk_id", F.size("source_elements").cast("long").alias("n_elements"))


@query(f"""with {CHUNKS} select document_id, count(*) as chunk_count, count(*) as embeddable_chunk_count from chunks group by 1""")
def a01_chunk_stats(spark, sf):
    return health.chunk_stats(corpus.chunks(spark, sf))


@query(f"""with {CHUNKS}, x as (select 'chunk' as kind, count(*) as n, 3 as o from chunks), ids as (select 't:a::document:' || document_id as id, 'document' as kind, 1 as o from chunks group by document_id union all select distinct 't:a::element:' || el, 'element', 2 from (select unnest(string_split(element_ids, ',')) as el from chunks) union all select 't:a::chunk:' || chunk_id, 'chunk', 3 from chunks)
select id, kind from ids order by o, id limit 1500""")
def k05_payload_nodes(spark, sf):
    return graph.payload_nodes(corpus.graph_nodes(spark, sf), corpus.SCOPE, 1500).select("id", "kind")


@query()
def k05_payload_edges(spark, sf):
    nodes, edges = corpus.graph(spark, sf)
    return graph.payload_edges(edges, graph.payload_nodes(nodes, corpus.SCOPE, 1500), 1500).select("edge_id", "src", "dst", "relation")


@query(f"""with {CHUNKS}, d as (select document_id, chunk_id, unnest(string_split(element_ids, ',')) as el from chunks), nx as (select lead(chunk_id) over (partition by document_id order by chunk_index) as nxt from chunks)
select 'node' as what, 'chunk' as name, count(*) as n from chunks union all select 'node', 'document', count(distinct document_id) from chunks union all select 'node', 'element', count(distinct el) from d
union all select 'edge', 'HAS_CHUNK', count(*) from chunks union all select 'edge', 'HAS_ELEMENT', count(distinct el) from d union all select 'edge', 'DERIVED_FROM', count(*) from (select distinct chunk_id, el from d) union all select 'edge', 'NEXT_CHUNK', count(nxt) from nx""")
def a04_graph_stats(spark, sf):
    nodes, edges = corpus.graph(spark, sf)
    return graph.payload_stats(nodes, edges)


@query(f"""with {CHUNKS}, own as (from chunks where document_id = '5') select (select count(*) from own) + (select count(distinct el) from (select unnest(string_split(element_ids, ',')) as el from own)) + 1 as deleted""")
def snk07_delete_document(spark, sf):
    nodes, edges = corpus.graph(spark, sf)
    return graph.delete_document(nodes, edges, corpus.SCOPE, "5")[2]


# -- the entity graph ------------------------------------------------------------------------------------------------------
SEM = "sem as (select distinct 'p' || l_partkey as src, 's' || l_suppkey as dst from lineitem), both_ways as (select src as a, dst as b from sem union select dst, src from sem)"
MEN = "men as (select distinct 'p' || l_partkey as src, 'o' || l_orderkey as dst from lineitem)"


@query(f"""with {MEN} select distinct src as id from men where dst in (select 'o' || o_orderkey from orders where o_orderstatus = 'F')""")
def j08_seed_entities(spark, sf):
    _, edges = corpus.star(spark, sf)
    chosen = corpus.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return graph.seeds_of_chunks(edges, chosen)


@query("""select 'p' || p_partkey as id from part where contains(lower(p_name), '7') or contains(lower(p_name), 'xyz') union select 's' || s_suppkey from supplier where contains(lower(s_name), '7')""")
def j09_seeds_by_name(spark, sf):
    entities, _ = corpus.star(spark, sf)
    return graph.seeds_of_names(entities, ["7", "", "xyz"])


@query(f"""with {SEM}, h0 as (select 's1' as id), h1 as (select distinct b as id from both_ways where a in (from h0) and b not in (from h0)), h2 as (select distinct b as id from both_ways where a in (from h1) and b not in (from h0) and b not in (from h1))
select id, 0 as hop from h0 union all select id, 1 from h1 union all select id, 2 from h2""")
def j10_khop_entities(spark, sf):
    _, edges = corpus.star(spark, sf)
    return graph.traverse(edges, spark.range(1).select(F.lit("s1").alias("id")), 2)


@query(f"""with {SEM}, {MEN}, h1 as (select distinct b as id from both_ways where a = 's1' union select 's1') select distinct dst as id from men where src in (from h1)""")
def j10_mentioning_chunks(spark, sf):
    _, edges = corpus.star(spark, sf)
    return graph.mentioning_chunks(edges, graph.traverse(edges, spark.range(1).select(F.lit("s1").alias("id")), 1))


@query(f"""with {SEM}, l1 as (select 1 as level, src, dst from sem where dst = 's1'), f as (select distinct src as id from l1 where src <> 's1'), l2 as (select distinct 2 as level, src, dst from sem where src in (from f) or dst in (from f))
select level, src, 'SEMANTIC_RELATION' as relation, 'PRODUCES' as kind, dst from (from l1 union all from l2) order by level, src, relation, dst limit 30""")
def j11_relation_map(spark, sf):
    _, edges = corpus.star(spark, sf)
    return graph.relation_map(edges, spark.range(1).select(F.lit("s1").alias("id")), 2, ("MENTIONED_IN",))


@query("""select 'p' || p_partkey as id from part where p_partkey not in (select l_partkey from lineitem) union all select 's' || s_suppkey from supplier""")
def j19_orphan_entities(spark, sf):
    entities, edges = corpus.star(spark, sf)
    return graph.orphan_entities(entities.withColumn("kind", F.lit("entity")), edges).select("id")


@query("""select count(*) as n, count(distinct 'p' || l_partkey) as sources from (select distinct l_partkey, l_suppkey from lineitem)""")
def snk05_relation_upsert(spark, sf):
    """Merged twice, with an edge to a missing node for each that holds: as if once."""
    entities, edges = corpus.star(spark, sf)
    sem = edges.where("relation = 'SEMANTIC_RELATION'")
    once = graph.merge_edges(sem.where(F.lit(False)), sem.unionByName(sem.withColumn("dst", F.concat(F.lit("no-"), "dst"))), entities)
    return graph.merge_edges(once, sem, entities).agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


@query("""select 'p' || l_partkey as src, 's' || l_suppkey as dst, lower(p_name) as src_label, lower(s_name) as dst_label from (select distinct l_partkey, l_suppkey from lineitem) join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey""")
def src20_triplets(spark, sf):
    entities, edges = corpus.star(spark, sf)
    nodes = entities.select("id", F.lit("entity").alias("kind"), F.col("normalized_name").alias("label"))
    return graph.triplets(edges, nodes, relations=["SEMANTIC_RELATION"]).select("src", "dst", "src_label", "dst_label")


@query("""with e as (select 'p' || p_partkey as id, p_brand as brand, p_size as size from part) select id, brand, size from e where brand = 'Brand#11' or size = 5""")
def src19_nodes_by_property(spark, sf):
    told = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    nodes = corpus.table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("entity").alias("kind"), told.alias("properties"))
    found = [graph.scan_nodes(nodes, "entity", equals=e) for e in ({"brand": "Brand#11"}, {"size": "5"})]
    both = found[0].unionByName(found[1]).dropDuplicates(["id"])
    return both.select("id", F.col("properties")["brand"].alias("brand"), F.col("properties")["size"].cast("int").alias("size"))


# -- retrieval ---------------------------------------------------------------------------------------------------------------
@query()
def j15_hybrid_retrieval(spark, sf):
    """The chunks nearest to the first benchmark text, of all chunks, expanded by entities, relations and structure."""
    nodes, edges = corpus.graph(spark, sf)
    chunks = nodes.where("kind = 'chunk'")
    replies = written(corpus.replies_of_chunks(chunks.select("document_id", F.col("record_id").alias("chunk_id"), "text")))
    all_edges = edges.unionByName(written(graph.semantic_edges(replies, corpus.SCOPE)))  # the structure's are a table already
    entities = written(graph.entity_rows(replies, corpus.SCOPE).select("id", "name", "entity_type").distinct())
    wanted = corpus.table(spark, sf, "benchmark").orderBy("item_id").first()["text"]
    embedder = HashingEmbedder(64)
    found = written(vectors.top_k(embedded(chunks.select("id", "text"), embedder), embedder.embed([wanted])[0], 20, id_col="id"))
    c, _ = hybrid(found.select("id", "rank"), nodes, all_edges, entities, entities.select("id"))
    return c.select("chunk_id", "document_id", "chunk_index", "next_chunk_id", F.col("pos.o").alias("part"), F.col("pos.r").alias("rank"))


@query("""with c as (select label, count(*) as v, sum((vec_id % 4 = 0)::int)::bigint as g, sum((vec_id % 100 = 0)::int)::bigint as e from embeddings group by label)
select label, case when e > 0 then 'vector_semantic_graph' when g > 0 then 'vector_graph' else 'vector_only' end as strategy from c""")
def s24_strategy_labels(spark, sf):
    c = corpus.table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("v"), F.count_if(F.col("vec_id") % 4 == 0).alias("g"), F.count_if(F.col("vec_id") % 100 == 0).alias("e"))
    return c.select("label", retrieval_strategy(F.col("v"), F.col("g"), F.col("e"), F.lit(False)).alias("strategy"))


@query("""with w as (select *, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows between 4 preceding and 1 preceding) as prev from conversations)
select conv_id, turn, md5(case when prev is null or len(regexp_extract_all(text, '\\S+')) >= 8 then text else prev || chr(10) || 'Follow-up: ' || text end) as query_md5 from w where role = 'user'""")
def s23_query_rewriting(spark, sf):
    r = context.rewritten_queries(corpus.table(spark, sf, "conversations"))
    return r.select("conv_id", "turn", F.md5(F.col("query").cast("binary")).alias("query_md5"))


@query("""select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 4""")
def k08_history_tail(spark, sf):
    return context.history_tail(corpus.table(spark, sf, "conversations"), 4).select("conv_id", "turn", "role")


@query(f"""with recursive c as (select source as query_id, doc_id as pos, 'c' || doc_id as chunk_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), {WS}) as t from documents),
cut as (select query_id, pos, chunk_id, case when length(t) <= 900 then t else rtrim(substr(t, 1, 897)) || '...' end as t from c where t <> ''),
n as (select *, row_number() over (partition by query_id order by pos) as i from cut qualify i <= 12),
f as (select query_id, 0::bigint as i, 0::bigint as used, 0::bigint as refs, ''::varchar as chunk_id, ''::varchar as text from (select distinct query_id from n)
union all select f.query_id, n.i, f.used + length(x.o), f.refs + (x.o <> '')::bigint, n.chunk_id, x.o from f join n on n.query_id = f.query_id and n.i = f.i + 1,
 lateral (select case when 5000 - f.used <= 0 then '' when length(n.t) <= 5000 - f.used then n.t when 5000 - f.used > 3 then rtrim(substr(n.t, 1, (5000 - f.used - 3)::bigint)) || '...' else substr(n.t, 1, (5000 - f.used)::bigint) end as o) x)
select query_id, refs as reference, chunk_id, length(text) as chars, md5(text) as text_md5 from f where i > 0 and text <> ''""")
def s20_context_compaction(spark, sf):
    b = corpus.documents(spark, sf).select(F.col("tenant_id").alias("query_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("c"), "doc_id").alias("chunk_id"), "text", F.lit("vector").alias("source"))
    c = context.compact(b, budget=5000, per_block=900)
    return c.select("query_id", F.col("reference").cast("long").alias("reference"), "chunk_id", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def s22_prompt_context(spark, sf):
    b = corpus.documents(spark, sf).select(F.col("tenant_id").alias("query_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("c"), "doc_id").alias("chunk_id"), "text", F.lit("vector").alias("source"))
    return context.rendered(context.compact(b, budget=2000, per_block=300)).select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"), F.length("context").alias("chars"))


@query("""with a as (select conv_id, max_by(text, turn) as answer from conversations where role = 'assistant' group by conv_id) select conv_id as query_id, sum(length(answer) + 2)::bigint as events from a group by 1""")
def u20_event_stream(spark, sf):
    a = corpus.table(spark, sf, "conversations").where("role = 'assistant'").groupBy(F.col("conv_id").alias("query_id")).agg(F.max_by("text", "turn").alias("answer"))
    return context.event_stream(a).groupBy("query_id").agg(F.count("*").alias("events"))


@query("""with t as (select source, lang, min(doc_id) as first_doc, max(doc_id) as last_doc, count(*) as n from documents group by all) select source, lang, last_doc, n, first_doc from t""")
def a09_last_wins_first_place(spark, sf):
    d = corpus.table(spark, sf, "documents").select("source", "lang", "doc_id")
    once = context.distinct_in_order(d.withColumn("last_doc", F.col("doc_id")), ["source"], "lang", F.col("doc_id"))
    n = d.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return once.join(n, ["source", "lang"]).select("source", "lang", "last_doc", "n", F.col("first_pos").alias("first_doc"))


# -- health, registry, configuration -----------------------------------------------------------------------------------------
@query("""with g as (select (vec_id % 50)::varchar as document_id, case when vec_id % 2 = 0 then 'openai/small' else 'big' end as embedding_model, 64 as vector_dimension, count(*) as embedded from embeddings group by all),
st as (select doc_id::varchar as document_id, 1 + n_chars // 100 as chunk_count, n_chars // 100 as emb from documents),
j as (select coalesce(g.document_id, st.document_id) as document_id, embedding_model, vector_dimension, coalesce(embedded, 0) as embedded_count, coalesce(emb, 0)::bigint as embeddable_chunk_count from g full join st on g.document_id = st.document_id)
select document_id, embedding_model, case embedding_model when 'openai/small' then 'p-small' when 'big' then 'runtime embedding pool' end as profile_name, embedded_count, embeddable_chunk_count, greatest(0, embeddable_chunk_count - embedded_count)::bigint as missing_count,
  case embedding_model when 'openai/small' then 'ok' else 'unknown' end as dimension_status from j""")
def a02_embedding_health(spark, sf):
    v = corpus.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("vector_id"), (F.col("vec_id") % 50).cast("string").alias("document_id"), F.lit(None).cast("string").alias("embedding_profile_id"), F.when(F.col("vec_id") % 2 == 0, "openai/small").otherwise("big").alias("embedding_model"), F.size("embedding").alias("vector_dimension"), F.lit("{}").alias("metadata"))
    st = corpus.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), (1 + F.expr("n_chars div 100")).alias("chunk_count"), F.expr("n_chars div 100").alias("embeddable_chunk_count"))
    profiles = spark.createDataFrame([("1", "p-small", "small", 64), ("2", "p-big-a", "x/big", 64), ("3", "p-big-b", "y/big", 128)], "profile_id string, profile_name string, model_name string, embedding_dimensions int")
    return health.report(v, st, profiles).select("document_id", "embedding_model", "profile_name", "embedded_count", "embeddable_chunk_count", "missing_count", "dimension_status")


@query("""select string_agg('- d' || doc_id || ' (' || case when doc_id % 5 = 0 then 'ready' else 'indexing' end || ')', chr(10) order by doc_id desc) as text, count(*) as n from (select doc_id from documents where doc_id % 7 <> 0 order by doc_id desc limit 20)""")
def k07_registry_inventory(spark, sf):
    d = corpus.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("d"), "doc_id").alias("filename"), F.col("doc_id").alias("created_at"), F.when(F.col("doc_id") % 7 == 0, "deleted").when(F.col("doc_id") % 5 == 0, "ready").otherwise("indexing").alias("status"))
    return registry.inventory(d)


@query("""select user_id::varchar as document_id, max_by(event_type, (epoch_us(ts), event_id)) as status, max(ts) as updated_at from events group by user_id""")
def u14_current_states(spark, sf):
    e = corpus.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("document_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("semantic_status"))
    return registry.current_states(e).select("document_id", "status", "updated_at")


@query("""with e as (select *, max(case when event_type <> 'error' then (epoch_us(ts), event_id) end) over (partition by user_id) as last_ok from events)
select user_id::varchar as key_id, count(*) as calls, count(*) filter (event_type <> 'error') as successes, count(*) filter (event_type = 'error') as failures, count(*) filter (event_type = 'error' and (last_ok is null or (epoch_us(ts), event_id) > last_ok)) as consecutive_failures, max(ts) as last_used_at from e group by user_id""")
def a13_key_counters(spark, sf):
    return config.key_counters(corpus.usage(spark, sf))


@query("""select event_type, sum(case when event_id % 3 = 0 then trunc(value)::bigint else 0 end)::bigint as embedding_tokens, sum(trunc(value)::bigint)::bigint as llm_tokens, (sum(case when event_id % 3 = 0 then trunc(value)::bigint else 0 end) + sum(trunc(value)::bigint))::bigint as total_tokens from events group by 1""")
def a06_usage_totals(spark, sf):
    return config.usage_totals(corpus.usage(spark, sf), "event_type")


PROVIDERS = "(select n_nationkey::varchar as id, n_nationkey % 5 <> 0 as on_, n_nationkey % 7 = 1 as locked from nation)"


@query(f"""select c_custkey::varchar as id from customer join {PROVIDERS} p on c_nationkey::varchar = p.id where p.on_ and not p.locked and c_acctbal > 0 and c_mktsegment <> 'BUILDING' and c_custkey % 3 <> 0""")
def p07_usable_keys(spark, sf):
    """Customers as keys of nations: some disabled, some locked, a third allowed for embeddings only."""
    p = corpus.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("code"), (F.col("n_nationkey") % 5 != 0).alias("is_enabled"), (F.col("n_nationkey") % 7 == 1).alias("is_locked"))
    some = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("Embedding"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("LLM"), F.lit("embedding"))).otherwise(F.array().cast("array<string>"))
    k = corpus.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("provider_id"), (F.col("c_acctbal") > 0).alias("is_enabled"), F.lit(False).alias("is_locked"), F.when(F.col("c_mktsegment") == "BUILDING", "disabled").alias("status"), some.alias("capabilities"))
    return config.usable_keys(k, p, "llm").select("id")


@query("""select count(*) as total, count(*) filter (c_acctbal > 0) as alive, count(*) filter (c_acctbal > 0 and c_custkey % 4 <> 0) as available, 0::bigint as locked from customer""")
def a12_pool_counters(spark, sf):
    k = corpus.table(spark, sf, "customer").select((F.col("c_acctbal") > 0).alias("is_enabled"), F.lit(False).alias("is_locked"), F.when(F.col("c_custkey") % 4 == 0, F.timestamp_seconds(F.lit(4102444800))).alias("cooldown_until"))
    return config.pool_counters(k, F.timestamp_seconds(F.lit(1700000000))).select("total", "alive", "available", "locked")


@query("""select c_custkey::varchar as id, 'key_of_other_provider' as what from customer where c_custkey % 10 = 0 and c_nationkey <> (c_nationkey + 1) % 25""")
def j18_reference_violations(spark, sf):
    p = corpus.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lit("gemini").alias("code"))
    c = corpus.table(spark, sf, "customer")
    k = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("provider_id"))
    shifted = F.when(F.col("c_custkey") % 10 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
    f = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").cast("string").alias("api_key_id"), shifted.cast("string").alias("provider_id"), F.lit("embedding").alias("kind"))
    return config.violations(k, f, p)


@query("""select md5(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) as k, min(doc_id) as doc_id, count(distinct source) as sources, case when min(lang) = max(lang) then min(lang) end as lang from documents group by 1""")
def a10_unanimous(spark, sf):
    d = corpus.table(spark, sf, "documents").withColumn("k", F.md5(F.lower(F.trim(F.regexp_replace("text", "\\s+", " "))).cast("binary")))
    return d.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("source").alias("sources"), health.unanimous(F.col("lang")).alias("lang"))


@query("""with d as (select doc_id, sha256(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) as h, lang from documents) select doc_id from d where lang <> 'en' and h not in (select h from d where lang = 'en')""")
def c13_known_hashes(spark, sf):
    d = corpus.documents(spark, sf).select("doc_id", "app_id", F.col("document_id").alias("chunk_id"), "document_id", F.lit(0).cast("long").alias("chunk_index"), content_hash(F.col("text")).alias("content_hash"), F.lit(True).alias("is_embeddable"))
    return chunking.dedupe(d.where("app_id <> 'en'"), known_hashes=d.where("app_id = 'en'")).select("doc_id")


@query("""select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as calls, round(sum(value), 4) as value from events group by all""")
def stream_usage_windows(spark, sf):
    """The stream over the events' file, run to its end; its final state."""
    import uuid

    from ..streaming.jobs import run_available, usage_windows

    base = f"{own_dir(spark)}/usage-{uuid.uuid4().hex}"
    events = spark.readStream.schema(corpus.table(spark, sf, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    run_available(usage_windows(events, late="365 days"), f"{base}/out", f"{base}/checkpoint", "complete")
    return spark.read.parquet(f"{base}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "calls", F.round("value", 4).alias("value"))

