"""Queries over parsing, records, entity edges, policy and small functions, each with the SQL that must give the same rows.

Values are chosen by key so that every branch of an operator is met.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, model_output, policy, text
from ..operators import chunking, graph, health, registry, vectors
from ..schema import RELATIONS, Scope
from ..sources import parsers
from ..storage import written
from . import corpus
from .catalog_text import CHUNKS, ELEMENTS, SECTIONS, TERMS, WS, windows_sql
from .engine import only_reads, totals

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def pick(values: tuple, key) -> F.Column:
    """The value at the key's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def pick_sql(values: tuple, key: str) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][({key} % {len(values)} + 1)::int]"


# -- sources ---------------------------------------------------------------------------------------------------------------
@query("""select n_regionkey::varchar as document_id, count(*)::int as row_count, 3::int as column_count, arg_min(n_name, n_nationkey) as first_name from nation group by 1""")
def src05_csv_tables(spark, sf):
    line = F.concat_ws(",", "n_nationkey", F.concat(F.lit('" '), "n_name", F.lit(' "')), F.lit('"x,y"'))
    files = corpus.table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("string").alias("document_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda r: r["l"]), "\n").cast("binary").alias("content"))
    t = parsers.parse_files(files.withColumn("extension", F.lit(".csv")))
    return t.select("document_id", parsers.table_shape(F.col("table")).alias("s"), F.col("table")[0][1].alias("first_name")).select("document_id", "s.*", "first_name")


@query("""select c_custkey::varchar as document_id, '{' || chr(10) || '  "a": [' || chr(10) || '    ' || c_nationkey || chr(10) || '  ],' || chr(10) || '  "b": "' || c_name || '"' || chr(10) || '}' as text from customer""")
def src06_json_documents(spark, sf):
    c = corpus.table(spark, sf, "customer")
    raw = F.to_json(F.struct(F.col("c_name").alias("b"), F.array("c_nationkey").alias("a")))
    return parsers.parse_files(c.select(F.col("c_custkey").cast("string").alias("document_id"), F.lit(".json").alias("extension"), raw.cast("binary").alias("content"))).select("document_id", "text")


UPLOADS = (".png", ".doc", ".xls", ".zzz", ".pptx")


@query(f"""select doc_id::varchar as document_id, ['image text is not read', 'unavailable', 'unavailable', 'unsupported', 'failed'][(doc_id % 5 + 1)::int] as status, case doc_id % 5 when 0 then 'image' end as element_type from documents""")
def src14_unread_files(spark, sf):
    d = corpus.documents(spark, sf)
    t = parsers.parse_files(d.select("document_id", pick(UPLOADS, F.col("doc_id")).alias("extension"), F.col("text").cast("binary").alias("content")))
    return t.select("document_id", F.split("status", ":")[0].alias("status"), "element_type")


# -- records and edges -------------------------------------------------------------------------------------------------------
@query(f"""with {CHUNKS} select 't:a:default:' || document_id || ':' || chunk_id as vector_id, chunk_index::int as chunk_index, section_index::bigint as section_index, len(string_split(text, ' '))::bigint as token_count, md5(text) as text_md5 from chunks""")
def p12_vector_records(spark, sf):
    r = vectors.records(corpus.chunks(spark, sf), corpus.SCOPE)
    told = lambda k: F.get_json_object("metadata", f"$.{k}").cast("long").alias(k)
    return r.select("vector_id", "chunk_index", told("section_index"), told("token_count"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""with {CHUNKS} select 'document' as record_type, count(*) as n, null::bigint as chars from documents union all select 'document_element:' || element_type, count(*), sum(length(text))::bigint from typed group by 1
union all select 'chunk', count(*), sum(length(text))::bigint from chunks""")
def p11_graph_records(spark, sf):
    e = corpus.elements(spark, sf)
    r = graph.records(corpus.documents(spark, sf), e, corpus.chunks(spark, sf))
    return r.groupBy("record_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""with {SECTIONS}, {windows_sql("sections", 100, 10, "w1")}, parents as (select document_id, section_index, part as text, row_number() over (partition by document_id order by section_index, n) - 1 as p from w1),
{windows_sql("parents", 40, 10, "w2")} select document_id || ':parent:' || p as parent_id, count(*) as children from w2 group by 1""")
def j04_parent_edges(spark, sf):
    e = corpus.elements(spark, sf)
    c = chunking.parent_child(e, chunking.ChunkingConfig(max_tokens=40, overlap_tokens=10, parent_max_tokens=100))
    edges = graph.structure_edges(c, e, corpus.SCOPE).where("relation = 'PARENT_CHUNK'")
    return edges.groupBy(F.regexp_replace("dst", "^t:a::chunk:", "").alias("parent_id")).agg(F.count("*").alias("children"))


def replies_raw(spark, sf):
    """A model's reply for each order: its parts are entities, and the first relates to all others."""
    # Replies are many times as long as the keys they are made of, so partitions are not left to be joined by the size of these.
    lines = corpus.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    parts = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    ents = F.transform("p", lambda k: F.struct(k.cast("string").alias("id"), F.lit("pRoDuCt").alias("type"), F.concat(F.lit(" P  "), k.cast("string")).alias("name")))
    rels = F.transform("p", lambda k: F.struct(F.col("p")[0].cast("string").alias("from_id"), F.when(k == F.col("p")[0], F.lit("nobody")).otherwise(k.cast("string")).alias("to_id"), F.lit("related_to").alias("type")))
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(ents.alias("entities"), rels.alias("relations"))), F.lit("\n```"))
    return parts.select(F.concat(F.lit("d"), F.col("l_orderkey") % 100).alias("document_id"), F.concat(F.lit("o"), "l_orderkey").alias("chunk_id"), raw.alias("raw"))


def replies(spark, sf):
    return model_output.extracted(replies_raw(spark, sf), into="x").select("document_id", "chunk_id", "x.*")


@query("""with e as (select distinct l_orderkey as o, l_partkey as p, 't:a::entity:' || sha256('product:p ' || l_partkey) as id from lineitem), f as (select o, arg_min(id, p) as first, min(p) as fp from e group by o)
select id as src, 't:a::chunk:o' || o as dst, 'MENTIONED_IN' as relation from e union all select distinct f.first, e.id, 'SEMANTIC_RELATION' from e join f using (o) where e.p <> f.fp""")
def j06_entity_edges(spark, sf):
    return graph.semantic_edges(written(replies(spark, sf)), Scope("t", "a")).select("src", "dst", "relation")


@query("""with e as (select l_orderkey as o, count(distinct l_partkey) as n from lineitem group by 1) select 'd' || (o % 100) as document_id, sum(n)::bigint as entities, sum(n - 1)::bigint as relations, 0::bigint as warnings from e group by 1""")
def a07_reply_totals(spark, sf):
    return totals(replies(spark, sf)).select("document_id", "entities", "relations", F.size("warnings").cast("long").alias("warnings"))


@query("""select 'x/' || n_name as embedding_model, 'P' || n_nationkey as profile_name, 64::int as expected_dimension from nation where n_nationkey < 10""")
def j12_profiles_of_models(spark, sf):
    n = corpus.table(spark, sf, "nation")
    models = n.select(F.lit(None).cast("string").alias("embedding_profile_id"), F.concat(F.lit("x/"), "n_name").alias("embedding_model"))
    profiles = n.where("n_nationkey < 10").select(F.col("n_nationkey").cast("string").alias("profile_id"), F.concat(F.lit("P"), "n_nationkey").alias("profile_name"), F.col("n_name").alias("model_name"), F.lit(64).alias("embedding_dimensions"))
    return health.matched_profiles(models, profiles).select("embedding_model", "profile_name", "expected_dimension")


@query("""select c_custkey, case when c_custkey % 10 = 0 then 'failed' when c_custkey % 10 = 1 then 'ready' else 'indexing' end as status from customer union all select -1, 'uploaded'""")
def snk10_registry_writes(spark, sf):
    own = corpus.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("indexing").alias("status"))
    new = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("uploaded").alias("status"))
    changes = own.select("id", F.when(F.col("id") % 10 == 0, "failed").when(F.col("id") % 10 == 1, "ready").otherwise("no such status").alias("status"))
    return registry.put(registry.with_status(own, changes), new).select(F.col("id").alias("c_custkey"), "status")


@query("""select vec_id from embeddings order by vec_id limit 1""")
def k06_least_limit(spark, sf):
    return vectors.scan(corpus.vectors(spark, sf), corpus.SCOPE, limit=0).select(F.col("vector_id").alias("vec_id"))


# -- functions -----------------------------------------------------------------------------------------------------------------
@query("""select doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))) as name_md5 from documents""")
def s05_query_names(spark, sf):
    return corpus.documents(spark, sf).select("doc_id", F.md5(text.query_name(F.col("text")).cast("binary")).alias("name_md5"))


NORMAL = "trim(regexp_replace(strip_accents(replace(lower(coalesce({}, '')), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""with n as (select doc_id, {NORMAL.format("text")} as t from documents) select doc_id, contains(' ' || t || ' ', ' the ') as the, contains(' ' || t || ' ', ' license version ') as license from n""")
def s07_phrases(spark, sf):
    n = corpus.documents(spark, sf).withColumn("n", text.policy_text(F.col("text")))
    return n.select("doc_id", text.contains_phrase(F.col("n"), "The").alias("the"), text.contains_phrase(F.col("n"), "license, version").alias("license"))


MESSAGES = ("what is the Government of", "danh sách tài liệu", "list the files đang có", "governments", "tự tử", "hello", "document da nap", "self-harm")


@query(f"""with n as (select c_custkey, {NORMAL.format(pick_sql(MESSAGES, "c_custkey") + " || ' ' || c_name")} as t from customer)
select c_custkey, regexp_matches(' ' || t || ' ', ' {TERMS} ') as restricted, regexp_matches(t, '{"|".join(policy.INVENTORY_SUBJECTS)}') and regexp_matches(t, '{"|".join(policy.INVENTORY_INTENTS)}') as inventory from n""")
def s08_routed_messages(spark, sf):
    c = corpus.table(spark, sf, "customer")
    n = c.select("c_custkey", text.policy_text(F.concat(pick(MESSAGES, F.col("c_custkey")), F.lit(" "), "c_name")).alias("n"))
    return n.select("c_custkey", policy.restricted_topic(F.col("n")).alias("restricted"), policy.inventory_question(F.col("n")).alias("inventory"))


@query("""select p_partkey, case p_partkey % 4 when 0 then ' - page ' || p_size when 1 then ' - slide ' || p_size when 2 then ' - sheet ' || p_name else '' end as location from part""")
def s12_locations(spark, sf):
    p = corpus.table(spark, sf, "part")
    on = lambda *r: (F.col("p_partkey") % 4).isin(*r)
    return p.select("p_partkey", labels.location(F.when(on(0), F.col("p_size")), F.when(on(0, 1), F.col("p_size")), F.when(on(0, 1, 2), F.col("p_name"))).alias("location"))


@query("""select c_custkey, case c_custkey % 3 when 0 then '{"a": ' || c_nationkey || ', "b": "é ' || c_name || '"}' else '{}' end as canonical from customer""")
def s14_canonical_json(spark, sf):
    c = corpus.table(spark, sf, "customer")
    whole = F.concat(F.lit('{"b":"\\u00e9 '), "c_name", F.lit('","a":'), "c_nationkey", F.lit("}"))
    raw = F.when(F.col("c_custkey") % 3 == 0, whole).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("["), whole, F.lit("]")))
    return c.select("c_custkey", model_output.json_keys_sorted(raw).alias("canonical"))


@query("""select c_custkey, c_custkey % 5 in (0, 1) as is_object, case when c_custkey % 5 in (0, 1) then c_name else '' end as name from customer""")
def s15_fenced_objects(spark, sf):
    c = corpus.table(spark, sf, "customer")
    whole, n = F.to_json(F.struct(F.concat(F.lit(" "), "c_name").alias("name"))), F.col("c_custkey") % 5
    raw = F.when(n == 0, whole).when(n == 1, F.concat(F.lit(" ```JSON\n"), whole, F.lit("\n``` "))).when(n == 2, F.concat(F.lit("["), whole, F.lit("]"))).when(n == 3, F.concat(F.lit("so: "), whole))
    reply = model_output.json_object(raw)
    return c.select("c_custkey", reply.isNotNull().alias("is_object"), model_output.said(reply, "title", "name").alias("name"))


@query("""select conv_id, turn, case conv_id % 3 when 0 then '12,3' when 1 then '7' else '' end as cited from conversations""")
def s18_cited_numbers(spark, sf):
    c = corpus.table(spark, sf, "conversations")
    said = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\[\\]]", ""), pick((" [12] and [3], [12]", "[7]", " [x] 5]"), F.col("conv_id")))
    return c.select("conv_id", "turn", F.array_join(policy.citations(said).cast("array<string>"), ",").alias("cited"))


@query("""select event_id, case when event_id % 3 = 0 then 'embedding_first_social' when event_id % 3 = 1 and event_id % 5 = 0 then 'embedding_first_no_context' when event_id % 7 = 0 then 'document_registry' when event_id % 2 = 0 then 'vector_semantic_graph' when event_id % 11 > 5 then 'vector_graph' else 'vector_only' end as strategy from events""")
def s25_response_strategies(spark, sf):
    e, at = corpus.table(spark, sf, "events"), F.col("event_id")
    return e.select("event_id", labels.response_strategy(pick(("social", "refusal", "grounded_answer"), at), at % 5, at % 7 == 0, (at + 1) % 2, F.greatest(at % 11 - 5, F.lit(0))).alias("strategy"))


@query("""select p_partkey, case p_partkey % 6 when 0 then p_name when 1 then p_name when 2 then p_name || chr(10) || 'b' end as said from part""")
def s33_embedding_inputs(spark, sf):
    p = corpus.table(spark, sf, "part")
    name, n = F.to_json(F.struct(F.concat(F.lit(" "), "p_name").alias("text"))), F.col("p_partkey") % 6
    part = F.to_json(F.struct(F.lit("text").alias("type"), F.col("p_name").alias("text")))
    raw = F.when(n == 0, F.concat(F.lit('" '), "p_name", F.lit(' "'))).when(n == 1, name).when(n == 2, F.concat(F.lit("["), part, F.lit(',{"type":"image"},5,{"type":"text","text":" b "}]'))).when(n == 3, '{"text": 5}').when(n == 4, '"  "')
    return p.select("p_partkey", model_output.embedding_input(raw).alias("said"))


GRAPH_QUERIES = ("MATCH (n) RETURN n", "match (n) set n.x = 1", "UNWIND [1] AS x CALL f(x)", "just prose", "MATCH (n) DETACH DELETE n", "WITH 1 AS offset RETURN offset", "COPY x")


@query("""select c_custkey, c_custkey % 7 in (0, 2, 5) as reads from customer""")
def s36_query_guard(spark, sf):
    c = corpus.table(spark, sf, "customer")
    return c.select("c_custkey", only_reads(pick(GRAPH_QUERIES, F.col("c_custkey"))).alias("reads"))


@query(f"""select event_id, ['Has Element', 'Has Chunk', 'Derived From', 'Next Chunk', 'Parent Chunk', 'Mentioned In', 'Semantic Relation'][(event_id % 7 + 1)::int] as title from events""")
def s37_relation_titles(spark, sf):
    return corpus.table(spark, sf, "events").select("event_id", text.title_case(pick(RELATIONS, F.col("event_id"))).alias("title"))


@query("""select c_custkey, case c_custkey % 3 when 0 then 'unknown' when 1 then 'ok' else 'mismatch' end as status from customer""")
def a03_dimension_status(spark, sf):
    n = F.col("c_custkey") % 3
    return corpus.table(spark, sf, "customer").select("c_custkey", labels.dimension_status(F.when(n == 1, 64).when(n == 2, 32), F.lit(64)).alias("status"))
