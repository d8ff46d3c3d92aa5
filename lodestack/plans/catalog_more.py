"""Further queries: scopes, ids, labels, set operations, configuration and lifecycle, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import errors, identifiers, labels, policy, text
from ..functions.model_output import confidence, extracted
from ..operators import chunking, config, context, graph, health, registry, vectors
from ..schema import Scope, pool_scope
from ..sources import files
from ..storage import own_dir, written
from . import corpus

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""select vec_id as vector_id from embeddings where label = 2 union all select vec_id + 1000000 from embeddings""")
def p01_vector_scope(spark, sf):
    v = corpus.vectors(spark, sf)
    one, every = v.where(Scope("t", "a", "2").of_vectors()), v.where(Scope("t", "a").of_vectors())
    return one.select("vector_id").unionByName(every.select((F.col("vector_id") + 1_000_000).alias("vector_id")))


@query("""select vec_id as vector_id from embeddings where label = 0""")
def p02_graph_scope(spark, sf):
    v = corpus.vectors(spark, sf).withColumn("collection_id", F.when(F.col("collection_id") != "0", F.col("collection_id")))
    return v.where(Scope("t", "a").of_graph()).select("vector_id")


@query("""select doc_id from documents where (case when doc_id % 3 = 0 then 'src1' else source end) = 'src1' and lang = 'en' and doc_id % 7 <> 0""")
def p03_registry_scope(spark, sf):
    d = corpus.table(spark, sf, "documents")
    meta = F.when(F.col("doc_id") % 3 == 0, F.lit('{"scope":{"tenant_id":"src1","app_id":""}}')).otherwise(F.lit("{}"))
    rows = d.select("doc_id", F.col("source").alias("tenant_id"), F.col("lang").alias("app_id"), F.lit(None).cast("string").alias("collection_id"), meta.alias("metadata"), F.when(F.col("doc_id") % 7 == 0, "deleted").otherwise("ready").alias("status"))
    return rows.where(Scope("src1", "en").of_registry()).select("doc_id")


@query("""select c_custkey as id, c_custkey % 4 in (0, 1) as named, c_custkey % 4 = 0 as unnamed from customer""")
def p04_pool_scope(spark, sf):
    c = corpus.table(spark, sf, "customer").withColumn("tenant_id", F.when(F.col("c_custkey") % 4 == 1, "a").when(F.col("c_custkey") % 4 > 1, "b"))
    return c.select(F.col("c_custkey").alias("id"), pool_scope("tenant_id", "a").alias("named"), pool_scope("tenant_id", None).alias("unnamed"))


@query("""select c_custkey as id, (c_custkey % 3 = 0 or c_mktsegment = 'BUILDING') and (c_custkey % 2 = 0 or c_nationkey = 3) as usable from customer""")
def p08_key_scope(spark, sf):
    c = corpus.table(spark, sf, "customer")
    tenants = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("c_mktsegment"))
    apps = F.when(F.col("c_custkey") % 2 == 1, F.array(F.col("c_nationkey").cast("string")))
    return c.select(F.col("c_custkey").alias("id"), config.usable_for_scope(tenants, apps, "BUILDING", "3").alias("usable"))


@query("""with r as (select p_partkey, p_type, case p_size % 3 when 0 then 'concept' when 1 then 'TASK' else 'alien' end as t from part) select p_partkey, case t when 'concept' then 'Concept' else 'Task' end as entity_type from r where t <> 'alien'""")
def p09_ontology_filter(spark, sf):
    t = F.when(F.col("p_size") % 3 == 0, "concept").when(F.col("p_size") % 3 == 1, "TASK").otherwise("alien")
    told = F.struct(F.array(F.struct(F.col("p_partkey").cast("string").alias("id"), t.alias("type"), F.col("p_name").alias("name"))).alias("entities"))
    read = written(extracted(corpus.table(spark, sf, "part").select("p_partkey", F.to_json(told).alias("raw"))).select("p_partkey", "extracted.entities"))
    return read.select("p_partkey", F.explode("entities").alias("e")).select("p_partkey", "e.entity_type")


@query("""select vec_id, 't:a:' || case when label = 0 then 'default' else label::varchar end || ':d' || (vec_id % 50) || ':c' || vec_id as vector_id, sha256('n' || vec_id || ':USES:n' || label) as edge_id,
  't:a::entity:' || sha256('concept:name ' || label) as entity_id from embeddings""")
def p17_identifiers(spark, sf):
    e = corpus.table(spark, sf, "embeddings")
    t, a = F.lit("t"), F.lit("a")
    collection = F.when(F.col("label") != 0, F.col("label").cast("string")).otherwise(F.lit(""))
    return e.select("vec_id", identifiers.vector_id(t, a, collection, F.concat(F.lit("d"), F.col("vec_id") % 50), F.concat(F.lit("c"), "vec_id")).alias("vector_id"), identifiers.edge_id(F.concat(F.lit("n"), "vec_id"), F.lit("USES"), F.concat(F.lit("n"), "label")).alias("edge_id"), identifiers.entity_id(t, a, F.lit(None).cast("string"), F.lit("concept"), F.concat(F.lit("name "), "label")).alias("entity_id"))


@query("""select page_id, 'data:' || case when page_id % 2 = 0 then 'image/x' else 'image/png' end || ';base64,' || base64(encode(url)) as media from pages""")
def p18_media_urls(spark, sf):
    p = corpus.table(spark, sf, "pages")
    return p.select("page_id", files.media_url(F.lit("a.PNG"), F.when(F.col("page_id") % 2 == 0, "image/x"), F.col("url").cast("binary")).alias("media"))


@query("""select l_orderkey as id, string_agg(l_linenumber::varchar || ' | ' || trim(l_returnflag), chr(10) order by l_linenumber, l_returnflag) as text from lineitem group by 1""")
def c01_table_text(spark, sf):
    row = F.struct("l_linenumber", F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit(" "), "l_returnflag", F.lit(" "))).alias("cells"))
    t = corpus.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"]).alias("t"))
    return t.select("id", chunking.element_text(F.lit("table"), F.lit(""), F.col("t"), F.lit(None).cast("string")).alias("text"))


@query("""select p_partkey as id, case when p_size % 3 = 0 then 'slide' when p_size % 3 = 1 then 'sheet' else 'page' end as kind, case when p_size % 3 = 0 then p_size::varchar when p_size % 3 = 1 then p_brand else '7' end as value from part""")
def c02_boundaries(spark, sf):
    p = corpus.table(spark, sf, "part")
    b = chunking.boundary(F.when(F.col("p_size") % 3 == 0, F.col("p_size")), F.when(F.col("p_size") % 3 != 2, F.col("p_brand")), F.lit(7))
    return p.select(F.col("p_partkey").alias("id"), b["type"].alias("kind"), b["value"].alias("value"))


@query("""with m as (select vec_id as chunk_id, row_number() over (order by list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) desc, vec_id) as "rank" from embeddings), c as (select doc_id, lang, source from documents)
select chunk_id, "rank", lang, source from m left join c on c.doc_id = m.chunk_id where "rank" <= 50""")
def j14_matches_with_context(spark, sf):
    from .catalog_graph import vector_of

    m = vectors.top_k(corpus.vectors(spark, sf), vector_of(spark, sf, 0), 50).select(F.col("vector_id").alias("chunk_id"), F.col("rank").cast("long").alias("rank"))
    return context.with_contexts(m, corpus.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "source"))


@query("""with p as (select n_nationkey::varchar as id from nation where n_nationkey % 5 <> 0), k as (select c_custkey::varchar as id, c_nationkey::varchar as provider_id from customer where c_acctbal > 0), f as (select s_suppkey::varchar as id, s_nationkey::varchar as provider_id from supplier where s_acctbal > 0)
select o_orderkey::varchar as id from orders join k on k.id = o_custkey::varchar join p on p.id = k.provider_id join f on f.id = ((o_orderkey % 100) + 1)::varchar and f.provider_id = k.provider_id where o_orderstatus <> 'F' and o_totalprice < 200000""")
def j16_runtime_pools(spark, sf):
    """Orders as pool rows of a customer's key and a supplier's profile; nations are providers."""
    t = lambda n: corpus.table(spark, sf, n)
    p = t("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("code"), (F.col("n_nationkey") % 5 != 0).alias("is_enabled"), F.lit(False).alias("is_locked"))
    k = t("customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("provider_id"), (F.col("c_acctbal") > 0).alias("is_enabled"), F.lit(False).alias("is_locked"), F.lit("active").alias("status"), F.array(F.lit("llm")).alias("capabilities"))
    f = t("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").cast("string").alias("provider_id"), F.col("s_name").alias("model_name"), (F.col("s_acctbal") > 0).alias("is_enabled"))
    o = t("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("key_id"), ((F.col("o_orderkey") % 100) + 1).cast("string").alias("profile_id"), (F.col("o_orderstatus") != "F").alias("is_enabled"), F.lit(False).alias("is_locked"), F.lit(200_000).alias("quota_limit"), F.col("o_totalprice").alias("quota_used"), F.lit(None).cast("string").alias("tenant_id"), F.lit(None).cast("string").alias("app_id"), F.lit(0).alias("current_position"), F.col("o_orderkey").alias("rotation_order"), F.col("o_orderdate").alias("created_at"))
    return config.runtime_pools(o, f, k, p, "x", "y").select("id")


@query("""select d.doc_id::varchar as document_id, coalesce(case when d.doc_id % 3 = 0 then 'own' end, case when d.lang = 'en' then 'reg-' || d.doc_id end) as filename from documents d""")
def j17_filenames(spark, sf):
    d = corpus.table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("document_id"), F.when(F.col("doc_id") % 3 == 0, "own").otherwise("").alias("filename"))
    known = d.where("lang = 'en'").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("reg-"), "doc_id").alias("filename"))
    return registry.with_filenames(rows, known)


@query("""select case when max_by(p_size, (p_retailprice, p_partkey)) - 25 > 0 then max_by(p_size, (p_retailprice, p_partkey)) - 25 else 5 end::int as top_k from part""")
def k09_top_k_setting(spark, sf):
    p = corpus.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("created_at"), (F.col("p_size") - 25).alias("retrieval_top_k"))
    return config.top_k_setting(p)


@query("""select o_custkey as document_id, sum(length(o_orderstatus))::bigint as entities, count(*) as chunks from orders group by 1""")
def a07_semantic_totals(spark, sf):
    o = corpus.table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("document_id")).agg(F.sum(F.length("o_orderstatus")).alias("entities"), F.count("*").alias("chunks"))


@query("""select source, string_agg(lang, ',' order by first) as langs from (select source, lang, min(doc_id) as first from documents group by all) group by source""")
def a08_distinct_in_order(spark, sf):
    d = context.distinct_in_order(corpus.table(spark, sf, "documents").select("source", "lang", "doc_id"), ["source"], "lang", F.col("doc_id"))
    return d.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "lang"))), lambda r: r["lang"]), ",").alias("langs"))


@query("""select c_custkey, case when (c_custkey % 3)::int = 0 then 'success' else 'danger' end as missing, case when c_nationkey < 5 then 'success' when c_nationkey < 10 then 'danger' else 'warn' end as status from customer""")
def a14_severities(spark, sf):
    c = corpus.table(spark, sf, "customer")
    n = F.when(F.col("c_nationkey") < 5, 64).when(F.col("c_nationkey") < 10, 32)
    return c.select("c_custkey", labels.missing_severity(F.col("c_custkey") % 3).alias("missing"), labels.status_severity(labels.dimension_status(n, F.lit(64))).alias("status"))


@query("""with a as (select o_custkey, list_sort(list(distinct o_orderkey)) as x from orders where o_orderstatus <> 'F' group by 1), b as (select o_custkey, list(distinct o_orderkey) as y from orders where o_totalprice > 100000 group by 1)
select o_custkey, len(list_filter(x, lambda v: not list_contains(coalesce(y, []), v)))::bigint as only_first, len(list_intersect(x, coalesce(y, [])))::bigint as both_lists from a left join b using (o_custkey)""")
def o03_list_difference(spark, sf):
    o = corpus.table(spark, sf, "orders")
    a = o.where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("x"))
    b = o.where("o_totalprice > 100000").groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "o_custkey", "left").select("o_custkey", F.size(context.list_difference(x, y)).cast("long").alias("only_first"), F.size(context.list_intersection(x, y)).cast("long").alias("both_lists"))


@query("""select l_orderkey, l_linenumber, case when l_discount >= 0.05 then 1.0 when l_discount = 0 then 0.0 else round(l_discount * 20, 6) end::double as confidence from lineitem""")
def s17_confidence(spark, sf):
    raw = F.when(F.col("l_discount") >= 0.08, F.lit("not a number")).when(F.col("l_discount") >= 0.05, F.lit("7.5")).when(F.col("l_discount") == 0, F.lit("-3")).otherwise((F.col("l_discount") * 20).cast("string"))
    return corpus.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(confidence(raw), 6).alias("confidence"))


@query("""with c as (select doc_id, row_number() over (partition by source order by doc_id) as r, source from documents) select doc_id, r as reference, r in (1, 3) as used from c where r in (1, 3)""")
def s21_used_citations(spark, sf):
    from pyspark.sql import Window

    d = corpus.table(spark, sf, "documents").withColumn("reference", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long"))
    return context.cited(d, F.array(F.lit(1).cast("long"), F.lit(3).cast("long"))).select("doc_id", "reference", F.lit(True).alias("used"))


@query("""select c_custkey, case when c_custkey % 2 = 0 then c_name || ' [4]' else c_name || ' [3] [4]' end as answer from customer""")
def s26_inline_references(spark, sf):
    c = corpus.table(spark, sf, "customer").withColumn("a", F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" [4]"))).otherwise(F.col("c_name")))
    return c.select("c_custkey", policy.with_references(F.col("a"), F.array(F.lit(3), F.lit(4))).alias("answer"))


@query("""select page_id, regexp_extract(url, '([^/\\\\]*)$', 1) as name from pages""")
def s27_basenames(spark, sf):
    return corpus.table(spark, sf, "pages").select("page_id", text.basename(F.col("url")).alias("name"))


@query("""select p_partkey, regexp_replace(lower(p_brand), '^/+', '') as bare, case when p_partkey % 2 = 0 then 'groq/' || p_brand else 'groq/' || p_brand end as named from part""")
def s28_model_names(spark, sf):
    p = corpus.table(spark, sf, "part")
    name = F.concat(F.lit(" //models/gemini/"), F.lower("p_brand"))
    twice = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/groq/"), "p_brand")).otherwise(F.col("p_brand"))
    return p.select("p_partkey", errors.model_name(name).alias("bare"), errors.provider_model(F.lit("/groq/"), twice).alias("named"))


@query("""select c_custkey, sha256(c_name) as hash, case when c_custkey % 2 = 0 then substr(c_name, 1, 4) || '...' || right(c_name, 4) else '...' || substr(c_name, 2, 2) end as masked from customer""")
def s29_secrets(spark, sf):
    c = corpus.table(spark, sf, "customer").withColumn("s", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.substring("c_name", 1, 3)))
    return c.select("c_custkey", F.sha2("c_name", 256).alias("hash"), text.mask_secret(F.col("s")).alias("masked"))


@query("""select event_id, event_type = 'error' or event_id % 4 = 0 as transient from events""")
def s32_transient_errors(spark, sf):
    e = corpus.table(spark, sf, "events")
    said = F.when(F.col("event_type") == "error", "Deadline exceeded").otherwise("bad schema")
    return e.select("event_id", errors.transient(F.when(F.col("event_id") % 4 == 0, 429), said, F.lit(False)).alias("transient"))


@query("""select event_id, case event_id % 4 when 3 then null when 2 then epoch_us(ts) // 1000000 - 7200 else epoch_us(ts) // 1000000 end as seconds from events""")
def s34_iso_timestamps(spark, sf):
    """Times with Z, without a zone, two hours east, and no times at all."""
    t = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(F.col("event_id") % 4 == 0, F.concat(t, F.lit("Z"))).when(F.col("event_id") % 4 == 1, t).when(F.col("event_id") % 4 == 2, F.concat(t, F.lit("+02:00"))).otherwise("soon")
    return corpus.table(spark, sf, "events").select("event_id", F.unix_timestamp(text.iso_timestamp(said)).alias("seconds"))


@query("""select p_partkey, case when length(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name || p_name) > 48 then substr(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name || p_name, 1, 45) || '...' else p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name || p_name end as label from part""")
def s35_short_labels(spark, sf):
    whole = F.concat_ws("", F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name"), "p_name")
    return corpus.table(spark, sf, "part").select("p_partkey", labels.short_label(whole).alias("label"))


@query("""select 'p' || l_partkey as src, count(*) as n from (select distinct l_partkey, l_suppkey from lineitem where l_suppkey % 2 = 1 and l_partkey % 10 <> 0) group by 1""")
def snk09_delete_nodes(spark, sf):
    entities, edges = corpus.star(spark, sf)
    gone = entities.where("(id like 's%' and cast(substring(id, 2) as bigint) % 2 = 0) or (id like 'p%0')")
    _, left = graph.delete_nodes(entities, edges.where("relation = 'SEMANTIC_RELATION'"), gone)
    return left.groupBy("src").agg(F.count("*").alias("n"))


@query("""select doc_id, 'd' || doc_id as filename from documents order by n_chars desc, doc_id::varchar limit 50""")
def src21_registry_listing(spark, sf):
    d = corpus.table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("d"), "doc_id").alias("filename"), F.col("n_chars").alias("created_at"))
    return registry.newest_first(d).select("doc_id", "filename").limit(50)


@query("""select c_nationkey::varchar as tenant_id, c_custkey as id, row_number() over (partition by c_nationkey order by c_acctbal, c_name) as place from customer""")
def src22_rotation_order(spark, sf):
    c = corpus.table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("tenant_id"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("rotation_order"), F.col("c_name").alias("name"))
    return config.rotation_order(c).select("tenant_id", "id", F.col("place").cast("long").alias("place"))


@query("""select lower(c_mktsegment) as filename, count(*) as n from customer group by 1 having count(*) > 1""")
def u16_filename_conflicts(spark, sf):
    return registry.filename_conflicts(corpus.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("filename")))


@query("""select o_orderstatus as key_hash, min(o_orderkey)::varchar as id, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as capabilities from orders group by 1""")
def u17_merged_keys(spark, sf):
    o = corpus.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("p").alias("provider_id"), F.col("o_orderkey").alias("created_at"), F.col("o_orderstatus").alias("key_hash"), F.array("o_orderpriority").alias("capabilities"))
    return config.merged_keys(o).select("key_hash", "id", F.array_join("capabilities", ",").alias("capabilities"))


@query("""select 'node' as what, item_id::varchar as document_id from benchmark where item_id > (select min(item_id) from benchmark) union all select 'vector', item_id::varchar from benchmark where item_id > (select min(item_id) from benchmark)""")
def u15_delete_cascade(spark, sf):
    """The engine takes in the benchmark's texts and deletes the first: what nodes and vectors are left of."""
    from ..functions.embedding import HashingEmbedder
    from .engine import Engine

    engine = Engine(spark, f"{own_dir(spark)}/delete-{uuid.uuid4().hex}", HashingEmbedder(16))
    rows = corpus.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("document_id"), "text", "item_id")
    engine.ingest(corpus.files_of(rows, "text"), corpus.SCOPE, corpus.WINDOWS)
    engine.delete(rows.orderBy("item_id").first()["document_id"], corpus.SCOPE)
    left = lambda what, name: engine.table(name).select(F.lit(what).alias("what"), "document_id").distinct()
    return left("node", "nodes").unionByName(left("vector", "vectors"))


@query("""with s as (select doc_id % 10 as g, doc_id, case when doc_id % 4 = 0 then source end as v from documents) select g, min_by(v, case when v is not null then doc_id end) as first_value from s group by g""")
def p15_first_truthy(spark, sf):
    d = corpus.table(spark, sf, "documents").select((F.col("doc_id") % 10).alias("g"), "doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise("").alias("v"))
    return d.groupBy("g").agg(health.first_truthy(F.col("v"), F.col("doc_id")).alias("first_value"))


@query("""select event_id, '{"k":"' || json_extract_string(props, '$.k') || '","type":"' || event_type || '"}' as entries from events""")
def p14_source_metadata(spark, sf):
    told = F.concat(F.regexp_replace("props", "\\}$", ""), F.lit(', "tenant_id": "t", "type": "'), F.col("event_type"), F.lit('", "text": "x"}'))
    return corpus.table(spark, sf, "events").select("event_id", F.to_json(health.source_metadata(told)).alias("entries"))


@query("""select src_kind, 'SEMANTIC_RELATION' as relation, dst_kind, count(*) as n from (select distinct 'Product' as src_kind, 'Organization' as dst_kind, l_partkey, l_suppkey from lineitem) group by all""")
def u10_schema(spark, sf):
    entities, edges = corpus.star(spark, sf)
    return graph.schema_of(entities.withColumn("kind", F.col("entity_type")), edges.where("relation = 'SEMANTIC_RELATION'"))
