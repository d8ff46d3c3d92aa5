"""Queries over the engine's own store, indexes and state machine, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import config, graph, registry, vectors
from ..storage import own_dir, written
from ..streaming.jobs import record_stream, run_available
from ..schema import MOVES
from ..streaming.states import state_store, status_moves
from . import corpus
from ..functions.policy import REFUSAL
from .catalog_graph import CLAMP, COS, SEM, vector_of
from .catalog_graph import SQL as GRAPH
from .catalog_text import CHUNKS, WS

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Documents with text and their tenant, in SQL.
OWNED = f"owned as (select doc_id::varchar as document_id, case when lang = 'en' then 'en' else 'rest' end as tenant, text from documents where trim(text, {WS}) <> '')"


@query(f"""with {OWNED} select tenant, document_id, 1::bigint as n from owned""")
def u09_scoped_query(spark, sf):
    """One SQL text, asked by two tenants: each sees its own documents."""
    engine = corpus.engine(spark, sf)
    asked = {t: engine.query("select document_id, count(*) as n from nodes where kind = 'document' group by document_id", scope) for t, scope in corpus.TENANTS.items()}
    seen = [written(rows).select(F.lit(t).alias("tenant"), "document_id", "n") for t, rows in asked.items()]
    return seen[0].unionByName(seen[1])


@query(f"""with {OWNED} select document_id as n0_document_id, 0::bigint as n1_position from owned where tenant = 'rest' order by document_id limit 1000""")
def u08_graph_pattern(spark, sf):
    """First chunks of a tenant's documents, by a pattern of two nodes and a step."""
    told = {"nodes": [{"kind": "document"}, {"kind": "chunk", "equals": {"position": 0}}], "steps": [{"relation": "HAS_CHUNK"}], "returns": [[0, "document_id"], [1, "position"]], "limit": 1000}
    return corpus.engine(spark, sf).match(told, corpus.TENANTS["rest"])


@query(f"""with {OWNED}, w as (select tenant, document_id, string_split(lower(regexp_replace(trim(text, {WS}), '\\s+', ' ', 'g')), ' ') as w from owned),
k as (select *, unnest(range(0, 1 + ceil(greatest(0, len(w) - 120) / 100.0)::bigint)) as k from w)
select tenant, document_id, count(distinct array_to_string(w[k * 100 + 1 : k * 100 + 120], ' ')) as n_vectors from k group by all""")
def a02_embedded_counts(spark, sf):
    """Vectors of each document from the summaries that the store keeps, without a look at the vectors. Equal windows of a document are one."""
    engine = corpus.engine(spark, sf)
    per = [engine.embedded_counts(scope).select(F.lit(t).alias("tenant"), "document_id", F.col("embedded_count").alias("n_vectors")) for t, scope in corpus.TENANTS.items()]
    return per[0].unionByName(per[1])


@query(f"""with {OWNED} select tenant, 'document' as kind, count(*) as n from owned group by tenant""")
def a04_kept_counts(spark, sf):
    engine = corpus.engine(spark, sf)
    per = [engine.node_counts(scope).where("kind = 'document'").select(F.lit(t).alias("tenant"), "kind", "n") for t, scope in corpus.TENANTS.items()]
    return per[0].unionByName(per[1])


@query(f"""with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 5 = 0), r as (select q.query_id, e.vec_id as vector_id, {COS} as raw from embeddings e, q where e.vec_id <> q.query_id),
k as (select *, row_number() over (partition by query_id order by round(raw, 12) desc, vector_id) as "rank" from r)
select query_id, "rank", vector_id, round({CLAMP.format("raw")}, 6) as similarity from k where "rank" <= 5""")
def k02_batch_topk_grid(spark, sf):
    """More queries than one block holds: a grid of blocks of queries and parts of vectors."""
    v = corpus.vectors(spark, sf)
    asked = v.where("vector_id % 5 = 0").select(F.col("vector_id").alias("query_id"), "vector")
    return vectors.batch_top_k(v, asked, 5, exclude_own=True, block=64).select("query_id", F.col("rank").cast("long").alias("rank"), "vector_id", F.round("similarity", 6).alias("similarity"))


@query(f"""with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id < 4), r as (select q.query_id, e.vec_id as vector_id, {COS} as raw from embeddings e, q),
k as (select *, row_number() over (partition by query_id order by raw desc, vector_id) as "rank" from r)
select query_id, "rank", vector_id, round({CLAMP.format("raw")}, 6) as similarity from k where "rank" <= 10""")
def k01_overfetched(spark, sf):
    """The exact nearest of four queries, found by a scan of quantised vectors: rows differ from the twin's where the scan misses one."""
    v = written(corpus.vectors(spark, sf).withColumn("code", vectors.quantised(F.col("vector"))))
    asked = [vectors.top_k_overfetched(v, vector_of(spark, sf, i), 10).withColumn("query_id", F.lit(i).cast("long")) for i in range(4)]
    found = asked[0].unionByName(asked[1]).unionByName(asked[2]).unionByName(asked[3])
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "vector_id", F.round("similarity", 6).alias("similarity"))


NAMES = ("blue", "ed wid", "000000007", "7", "", "xyz")


@query("with n(x) as (values " + ", ".join(f"('{n}')" for n in NAMES if n) + ") select distinct id from (select 'p' || p_partkey as id, lower(p_name) as name from part union all select 's' || s_suppkey, lower(s_name) from supplier), n where contains(name, x)")
def j09_names_by_index(spark, sf):
    entities, _ = corpus.star(spark, sf)
    postings = written(graph.name_postings(entities).repartitionByRange("gram").sortWithinPartitions("gram"))
    return graph.seeds_of_names_indexed(entities, postings, list(NAMES))


@query(f"""with {SEM}, h0 as (select 's1' as id union select 's2'), h1 as (select distinct b as id from both_ways where a in (from h0) and b not in (from h0)), h2 as (select distinct b as id from both_ways where a in (from h1) and b not in (from h0) and b not in (from h1)),
h3 as (select distinct b as id from both_ways where a in (from h2) and b not in (from h0) and b not in (from h1) and b not in (from h2))
select id, 0 as hop from h0 union all select id, 1 from h1 union all select id, 2 from h2 union all select id, 3 from h3""")
def j10_khop_by_adjacency(spark, sf):
    """Three hops over links that lie bucketed by their first end."""
    _, edges = corpus.star(spark, sf)
    links = graph.adjacency(edges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return graph.traverse(None, spark.range(2).select(F.concat(F.lit("s"), F.col("id") + 1).alias("id")), 3, adjacent=links)


STATUS = {"signup": "uploaded", "view": "indexing", "click": "ready", "error": "failed", "purchase": "archived"}
ALLOWED = ", ".join(f"('{a or ''}', '{b}')" for a, to in MOVES.items() for b in sorted(to))


@query(f"""with recursive e as (select user_id::varchar as document_id, event_id as seq, row_number() over (partition by user_id order by epoch_us(ts), event_id) as i, case event_type {" ".join(f"when '{a}' then '{b}'" for a, b in STATUS.items())} end as status from events),
ok(a, b) as (values {ALLOWED}),
s as (select document_id, 0::bigint as i, ''::varchar as held, null::bigint as seq, null::varchar as was, null::varchar as status, null::boolean as accepted from (select distinct document_id from e)
union all select s.document_id, e.i, case when ok.b is null then s.held else e.status end, e.seq, nullif(s.held, ''), e.status, ok.b is not null from s join e on e.document_id = s.document_id and e.i = s.i + 1 left join ok on ok.a = s.held and ok.b = e.status)
select document_id, seq, was, status, accepted from s where i > 0""")
def u14_state_moves(spark, sf):
    """Events as changes of documents' status, through the stream's state machine."""
    base = f"{own_dir(spark)}/moves-{uuid.uuid4().hex}"
    raw = spark.readStream.schema(corpus.table(spark, sf, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    told = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    events = raw.select(F.col("user_id").cast("string").alias("document_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), told[F.col("event_type")].alias("status"))
    with state_store(spark):
        run_available(status_moves(events), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("document_id", "seq", "was", "status", "accepted")


@query("""select event_type as capability, count(*) as calls, count(*) filter (event_type <> 'error') as successes, sum(trunc(value)::bigint)::bigint as total_tokens from events group by 1""")
def snk11_usage_events(spark, sf):
    """Events streamed into the usage table, then handed over once more, which adds nothing."""
    from ..functions.embedding import HashingEmbedder
    from .engine import Engine

    engine = Engine(spark, f"{own_dir(spark)}/usage-{uuid.uuid4().hex}", HashingEmbedder(8))
    told = lambda e: e.select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("at"), F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), F.col("event_type").alias("capability"), (F.col("event_type") != "error").alias("success"), F.col("value").cast("long").alias("total_tokens"))
    events = corpus.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    record_stream(told(stream), engine.record_usage, f"{own_dir(spark)}/usage-{uuid.uuid4().hex}")
    engine.record_usage(told(events))
    return engine.usage(corpus.SCOPE).groupBy("capability").agg(F.count("*").alias("calls"), F.count_if("success").alias("successes"), F.sum("total_tokens").alias("total_tokens"))


@query("""with p as (select 'providers' as kind, n_nationkey::varchar as id, row_number() over (order by n_name) as place from nation), k as (select 'keys', c_custkey::varchar, row_number() over (order by c_acctbal desc, c_custkey::varchar) from customer),
e as (select 'embedding_profiles', s_suppkey::varchar, row_number() over (order by s_acctbal desc, s_suppkey::varchar) from supplier), m as (select 'models', p_partkey::varchar, row_number() over (order by p_name, p_partkey::varchar) from part)
from p union all from k union all from e union all from m""")
def src22_listings(spark, sf):
    """Nations as providers, customers as keys, suppliers as embedding profiles and parts as models, each with its place in its listing."""
    named = {
        "providers": ("nation", F.col("n_nationkey"), {"code": "n_name"}), "keys": ("customer", F.col("c_custkey"), {"created_at": "c_acctbal"}),
        "embedding_profiles": ("supplier", F.col("s_suppkey"), {"created_at": "s_acctbal"}), "models": ("part", F.col("p_partkey"), {"model_name": "p_name"}),
    }
    found = None
    for kind, (name, key, more) in named.items():
        listed = config.listing(corpus.table(spark, sf, name).select(key.cast("string").alias("id"), *[F.col(b).alias(a) for a, b in more.items()]), kind)
        placed = listed.select(F.lit(kind).alias("kind"), "id", (F.monotonically_increasing_id()).alias("m"))
        placed = written(placed).withColumn("place", F.count("*").over(Window.partitionBy("kind").orderBy("m"))).drop("m")
        found = placed if found is None else found.unionByName(placed)
    return found


@query("""select c_custkey::varchar as id, c_name[:4] || '...' || right(c_name, 4) as masked_key, p.n_name as model_name from customer join nation p on p.n_nationkey = c_nationkey""")
def p16_key_and_pool_rows(spark, sf):
    """Customers as keys whose names are secrets, and as pools of their nation's profile."""
    c = corpus.table(spark, sf, "customer")
    keys = config.key_rows(c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("secret"), F.col("c_acctbal").alias("created_at")))
    profiles = corpus.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("model_name"), F.lit("p").alias("provider_id"), F.lit("k").alias("api_key_id"))
    pools = config.pool_rows(c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").alias("profile_id"), F.col("c_acctbal").alias("rotation_order"), F.col("c_name").alias("name")), profiles)
    return keys.join(pools.select("id", "model_name"), "id").select("id", "masked_key", "model_name")


@query("""with n as (select count(*) as sem from (select distinct l_partkey, l_suppkey from lineitem)) select '(:Product)-[:SEMANTIC_RELATION]->(:Organization) ' || sem as text from n""")
def u10_schema_text(spark, sf):
    entities, edges = corpus.star(spark, sf)
    return graph.schema_text(graph.schema_of(entities.withColumn("kind", F.col("entity_type")), edges.where("relation = 'SEMANTIC_RELATION'")))


HELD, WANTED = ("uploaded", "indexing", "ready", "failed", "archived", "deleted", None), ("indexing", "ready", "archived", "deleted", "odd")


@query(f"""with d as (select doc_id as id, [{", ".join(f"'{x}'" if x else "null" for x in HELD)}][(doc_id % 7 + 1)::int] as held, [{", ".join(f"'{x}'" for x in WANTED)}][(doc_id % 5 + 1)::int] as wanted from documents), ok(a, b) as (values {ALLOWED})
select id, case when ok.b is not null then wanted else held end as status from d left join ok on ok.a = coalesce(held, '') and ok.b = wanted""")
def u14_checked_status(spark, sf):
    """A change for each document, of which those count that its status allows."""
    at = lambda names, n: F.element_at(F.array(*[F.lit(x).cast("string") for x in names]), (F.col("id") % n + 1).cast("int"))
    d = corpus.table(spark, sf, "documents").select(F.col("doc_id").alias("id")).withColumn("status", at(HELD, 7))
    return registry.with_status(d, d.select("id", at(WANTED, 5).alias("status")), checked=True)


# -- SQL for queries of the other catalogs ----------------------------------------------------------------------------------
SQL["k05_payload_edges"] = f"""with {CHUNKS}, d as (select document_id, chunk_id, unnest(string_split(element_ids, ',')) as el from chunks), nx as (select chunk_id, lead(chunk_id) over (partition by document_id order by chunk_index) as nxt from chunks),
ids as (select 't:a::document:' || document_id as id, 1 as o from chunks group by document_id union all select distinct 't:a::element:' || el, 2 from d union all select 't:a::chunk:' || chunk_id, 3 from chunks), shown as (select id from ids order by o, id limit 1500),
e as (select 't:a::document:' || document_id as src, 't:a::chunk:' || chunk_id as dst, 'HAS_CHUNK' as relation, 2 as o from chunks union all select distinct 't:a::document:' || document_id, 't:a::element:' || el, 'HAS_ELEMENT', 1 from d
union all select distinct 't:a::chunk:' || chunk_id, 't:a::element:' || el, 'DERIVED_FROM', 3 from d union all select 't:a::chunk:' || chunk_id, 't:a::chunk:' || nxt, 'NEXT_CHUNK', 4 from nx where nxt is not null)
select sha256(src || ':' || relation || ':' || dst) as edge_id, src, dst, relation from e where src in (from shown) and dst in (from shown) order by o, src, dst limit 6000"""
SQL["src07_json_lines"] = """with e as (select user_id::varchar as document_id, row_number() over (partition by user_id order by event_id) - 1 as "order", json_extract_string(props, '$.k') as k from events)
select document_id, "order", 'json_record' as element_type, '{"k": ' || k || '}' as text, "order" + 1 as jsonl_line from e"""
_s20 = GRAPH["s20_context_compaction"]
SQL["s22_prompt_context"] = (
    _s20[: _s20.rindex("\nselect")].replace("5000", "2000").replace("897", "297").replace("900", "300")
    + """, t as (select query_id, string_agg('[' || refs || '] source=vector; chunk=' || chunk_id || chr(10) || text, chr(10) || chr(10) order by refs) as context from f where i > 0 and text <> '' group by query_id)
select query_id, md5(context) as context_md5, length(context) as chars from t"""
)
SQL["s19_decisions"] = f"""with t as (select conv_id, turn, trim(coalesce(text, ''), {WS}) as a from conversations where role = 'assistant'),
d as (select conv_id, turn, case when conv_id % 3 = 2 or (conv_id % 3 = 0 and a = '') then 'refusal' else 'grounded_answer' end as response_type, a from t)
select conv_id, turn, response_type, (case when response_type = 'refusal' then {len(REFUSAL)} when conv_id % 3 = 0 then length(a || ' [1]') else length(trim(a || ' [2]')) end)::bigint as answer_chars,
  case when response_type = 'refusal' then '' when conv_id % 3 = 0 then '1' else '2' end as refs from d"""
