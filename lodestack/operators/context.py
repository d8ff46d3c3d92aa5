"""Context for answers: query rewriting, merged sources, the budgeted fold, citations and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_count, truncate

BUDGET, PER_BLOCK, BLOCKS, EXCERPT, ENTITIES, HISTORY = 24_000, 3_000, 12, 320, 24, 8
#: The order in which sources fill the context.
SOURCES = ("document_registry", "graph_parent", "vector", "graph", "graph_query")


def rewritten_queries(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> user turns with `query`: short ones follow the last user turn among the four before."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1)
    last = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    rows = turns.withColumn("__previous", last).where("role = 'user'")
    alone = F.col("__previous").isNull() | (token_count(F.col("text")) >= 8)
    return rows.withColumn("query", F.when(alone, F.col("text")).otherwise(F.concat("__previous", F.lit("\nFollow-up: "), "text"))).drop("__previous")


def history_tail(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last n turns of each conversation."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("__n", last).where(F.col("__n") <= n).drop("__n")


def distinct_in_order(rows: DataFrame, by: list[str], key: str, pos: Column, last_value: bool = True) -> DataFrame:
    """One row for each key of a group: at its first place, with its last value (or its first)."""
    rest = [c for c in rows.columns if c not in by and c != key]
    value = F.struct(*rest)
    pick = F.max_by(value, pos) if last_value else F.min_by(value, pos)
    return rows.groupBy(*by, key).agg(pick.alias("__v"), F.min(pos).alias("first_pos")).select(*by, key, *[F.col(f"__v.{c}").alias(c) for c in rest], "first_pos")


def compact(blocks: DataFrame, by: str = "query_id", budget: int = BUDGET, per_block: int = PER_BLOCK, most: int = BLOCKS) -> DataFrame:
    """blocks (by, pos, chunk_id, text, source) -> the blocks that fit, in order, each with its reference (from 1).

    A chunk counts once. Each text is cut to per_block, then to what is left of the budget; it ends after `most` blocks or
    when nothing is left. Only the first blocks of a group can fit, so what comes far behind is dropped before the
    fold, which is a fold over one short array a group.
    """
    once = blocks.groupBy(by, "chunk_id").agg(F.min_by(F.struct("pos", "text", "source"), "pos").alias("b")).select(by, "chunk_id", "b.*")
    once = once.withColumn("text", truncate(F.col("text"), per_block)).where("text <> ''")
    near = once.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy("pos"))).where(F.col("__n") <= most).drop("__n")
    rows = F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "source", "text")))
    block_type = "array<struct<chunk_id:string,source:string,text:string>>"
    start = F.struct(F.array().cast(block_type).alias("out"), F.lit(0).alias("used"))

    def step(acc: Column, b: Column) -> Column:
        room = F.lit(budget) - acc["used"]
        clean = b["text"]
        cut = F.when(F.length(clean) <= room, clean).when(room > 3, F.concat(F.rtrim(F.left(clean, room - 3)), F.lit("..."))).otherwise(F.left(clean, F.greatest(room, F.lit(0))))
        kept = F.array_append(acc["out"], F.struct(b["chunk_id"].alias("chunk_id"), b["source"].alias("source"), cut.alias("text")))
        return F.when((room <= 0) | (cut == ""), acc).otherwise(F.struct(kept.alias("out"), (acc["used"] + F.length(cut)).alias("used")))

    folded = near.groupBy(by).agg(rows.alias("__rows")).select(by, F.aggregate("__rows", start, step).alias("__a"))
    out = folded.select(by, F.posexplode("__a.out").alias("__i", "__b"))
    return out.select(by, (F.col("__i") + 1).alias("reference"), "__b.chunk_id", "__b.source", "__b.text")


def cited(blocks: DataFrame, used: Column | None = None) -> DataFrame:
    """blocks of compact() with an excerpt; only those whose reference is in the array `used`, where given."""
    rows = blocks if used is None else blocks.where(F.array_contains(used, F.col("reference")))
    return rows.withColumn("excerpt", truncate(F.col("text"), EXCERPT))


def rendered(blocks: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, context): "[n] source=...; chunk=..." and the text of each block, a blank line between."""
    line = F.concat(F.lit("["), F.col("reference").cast("string"), F.lit("] source="), F.col("source"), F.lit("; chunk="), F.coalesce("chunk_id", F.lit("")), F.lit("\n"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("reference", line.alias("line"))))
    return blocks.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("context"))


def rendered_entities(entities: DataFrame, by: str = "query_id", most: int = ENTITIES) -> DataFrame:
    """(by, entities): "name (type)" of the first `most` by id."""
    first = entities.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy("id"))).where(F.col("__n") <= most)
    rows = F.array_sort(F.collect_list(F.struct("__n", F.concat("name", F.lit(" ("), "entity_type", F.lit(")")).alias("s"))))
    return first.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["s"]), ", ").alias("entities"))


def event_stream(answers: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Server events of an answer: its metadata, a delta for each character, and the end."""
    events = F.concat(F.array(F.struct(F.lit("metadata").alias("event"), F.lit("").alias("data"))), F.transform(F.filter(F.split("answer", ""), lambda c: c != ""), lambda c: F.struct(F.lit("delta").alias("event"), c.alias("data"))), F.array(F.struct(F.lit("done").alias("event"), F.lit("").alias("data"))))
    return answers.select(id_col, F.posexplode(events).alias("seq", "e")).select(id_col, "seq", "e.event", "e.data")


def with_contexts(matches: DataFrame, contexts: DataFrame) -> DataFrame:
    """matches (chunk_id, rank) with what the graph knows of each chunk, every match kept; of several contexts of a chunk the least."""
    told = [c for c in contexts.columns if c != "chunk_id"]
    one = contexts.groupBy("chunk_id").agg(F.min(F.struct(*told)).alias("__c"))
    return matches.join(one, "chunk_id", "left").select(*[matches[c] for c in matches.columns if c != "chunk_id"], "chunk_id", "__c.*")


def list_difference(a: Column, b: Column) -> Column:
    """The distinct values of a that are not in b, in the order of a; a null list is an empty one."""
    empty = F.array()
    return F.array_except(F.coalesce(a, empty), F.coalesce(b, empty))


def list_intersection(a: Column, b: Column) -> Column:
    """The distinct values of a that are in b too, in the order of a; a null list is an empty one."""
    empty = F.array()
    return F.array_intersect(F.coalesce(a, empty), F.coalesce(b, empty))
