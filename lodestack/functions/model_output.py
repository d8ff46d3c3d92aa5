"""What models return: JSON objects in or out of fences, extracted entities and relations, texts to embed."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ontology import ENTITY_TYPES, RELATION_TYPES
from .replies import is_plain, plain, small_batches
from .text import bound, entity_names, mapped

EXTRACTION_TYPE = (
    "entities array<struct<local_id:string,entity_type:string,name:string,normalized_name:string,description:string>>, "
    "relations array<struct<source_id:string,target_id:string,relation_type:string,description:string,confidence:double>>, warning string"
)
BLANKS = " \t\n\r\x0b\x0c"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def unfenced(raw: Column, *labels: str) -> Column:
    """What stands between a code fence's ends, without its label; a text that is no fence as it is."""

    def body(text: Column) -> Column:
        fenced = text.startswith("```") & text.endswith("```") & (F.length(text) >= 6)
        inner = F.regexp_replace(F.substring(text, F.lit(4), F.length(text) - 6), f"^(?i:{'|'.join(labels)})", "")
        return F.when(fenced, trimmed(inner)).otherwise(text)

    return bound(trimmed(F.coalesce(raw, F.lit(""))), body)


def json_object(raw: Column) -> Column:
    """The JSON object that raw holds, with or without a code fence around it, as a variant; null for anything else."""
    # A trimmed text that parses is an object if it begins with a brace; a schema of the whole value would be merged from all its members.
    return bound(unfenced(raw, "json"), lambda text: F.when(F.startswith(text, F.lit("{")), F.try_parse_json(text)))


def said(value: Column, *keys: str) -> Column:
    """The first of the members that is not blank, as trimmed text; empty where there is none."""
    return _first_text(F.try_variant_get(value, f"$.{k}", "string") for k in keys)


def _first_text(values: Iterable[Column]) -> Column:
    *others, last = map(trimmed, values)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in others], last, F.lit(""))


def members(value: Column, key: str, *names: str) -> Column:
    """The objects in a member that is an array, as structs of the named texts, read in one pass; no array holds none. What is no object is null."""
    kind = f"array<struct<{','.join(f'{n}:string' for n in names)}>>"
    return F.coalesce(F.try_variant_get(value, f"$.{key}", kind), F.array().cast(kind))


def canonical_json(value: object, indent: int | None = None) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, indent=indent)


def confidence(value: Column) -> Column:
    """Clamped to [0, 1]; missing and invalid values, and NaN, are certain."""
    number = value.try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(number, F.lit(1.0)), F.lit(1.0))))


def _named(types: tuple[str, ...]) -> Column:
    """Map of each type in lower case to the type."""
    return F.create_map(*(F.lit(x) for t in types for x in (t.lower(), t)))


def _firsts(rows: Column, *key: str) -> Column:
    """The first of the rows of each key, in order. Arrays may be as long as texts: rows are told apart by hashes, and sorted only where a key comes twice."""
    # A part but the last is told from what follows by its length.
    named = lambda r: F.concat(*(x for k in key[:-1] for x in (F.length(r[k]).cast("string"), F.lit(":"), r[k])), r[key[-1]]) if len(key) > 1 else r[key[0]]
    leading = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"]))

    def sorted_out(all_rows: Column) -> Column:
        placed = F.transform(all_rows, lambda r, i: F.struct(named(r).alias("k"), i.alias("i"), r.alias("r")))
        kept = F.transform(bound(F.sort_array(placed), leading), lambda x: F.struct(x["i"].alias("i"), x["r"].alias("r")))
        return F.transform(F.sort_array(kept), lambda x: x["r"])

    return bound(rows, lambda all_rows: F.when(F.size(F.array_distinct(F.transform(all_rows, named))) == F.size(all_rows), all_rows).otherwise(sorted_out(all_rows)))


def extracted(replies: DataFrame, raw: str = "raw", into: str = "extracted") -> DataFrame:
    """replies with the entities and relations of a reply that the ontology allows, as a struct of EXTRACTION_TYPE.

    Types are looked up without regard to case. The first entity of a local id counts; a relation needs two kept
    entities (named source_id/target_id or from_id/to_id) and counts once for each (source, target, type). Plain
    replies are read as columns, in Arrow batches; all others here, by the same rules, from a variant.
    """
    own = replies.columns
    text = lambda x, *keys: _first_text(x[k] for k in keys)
    entity = lambda x: F.struct(text(x, "id").alias("local_id"), F.try_element_at(_named(ENTITY_TYPES), F.lower(text(x, "type"))).alias("entity_type"), text(x, "name").alias("name"), text(x, "description").alias("description"))
    relation = lambda x: F.struct(text(x, "source_id", "from_id").alias("source_id"), text(x, "target_id", "to_id").alias("target_id"), F.try_element_at(_named(RELATION_TYPES), F.lower(text(x, "type"))).alias("relation_type"), text(x, "description").alias("description"), confidence(x["confidence"]).alias("confidence"))
    read = small_batches(replies).withColumn("__plain", is_plain(F.col(raw)))
    read = read.withColumn("__reply", json_object(F.when(~F.col("__plain"), F.col(raw)))).withColumn("__text", F.when(F.col("__plain"), F.col(raw)))
    read = read.select(*own, "__plain", "__text", F.isnull("__reply").alias("__none"), F.transform(members(F.col("__reply"), "entities", "id", "type", "name", "description"), entity).alias("__e"), F.transform(members(F.col("__reply"), "relations", "source_id", "from_id", "target_id", "to_id", "type", "description", "confidence"), relation).alias("__r"))
    read = read.withColumn("__e", F.filter("__e", lambda e: (e["local_id"] != "") & (e["name"] != "") & e["entity_type"].isNotNull()))
    read = read.withColumn("__e", _firsts(F.col("__e"), "local_id"))
    read = read.withColumns({"__ids": F.col("__e")["local_id"], "__n": entity_names(F.col("__e")["name"]), "__told": plain(F.col("__text"))})
    unknown = F.array_except(F.array_union(F.col("__r")["source_id"], F.col("__r")["target_id"]), F.col("__ids"))
    # All that a lambda reads is an argument of it: columns in it may become the expressions behind them, and Python has no part in lambdas.
    linked = bound(F.struct(F.col("__r").alias("r"), unknown.alias("u")), lambda x: F.filter(x["r"], lambda r: r["relation_type"].isNotNull() & ~F.array_contains(x["u"], r["source_id"]) & ~F.array_contains(x["u"], r["target_id"])))
    kept = _firsts(linked, "source_id", "target_id", "relation_type")
    entities = F.zip_with("__e", "__n", lambda e, n: F.struct(e["local_id"].alias("local_id"), e["entity_type"].alias("entity_type"), e["name"].alias("name"), n.alias("normalized_name"), e["description"].alias("description")))
    warning = F.when(~F.col("__plain") & F.col("__none"), F.lit("the reply holds no JSON object")).alias("warning")
    # Columns of their own, so that readers of several fields of the struct do not compute them again.
    either = lambda name, other: F.when(F.col("__plain"), F.col(f"__told.{name}")).otherwise(other)
    told = read.select(*own, either("entities", entities).alias("__entities"), either("relations", kept).alias("__kept"), warning)
    return told.select(*own, F.struct(F.col("__entities").alias("entities"), F.col("__kept").alias("relations"), "warning").alias(into))


def json_keys_sorted(raw: Column) -> Column:
    """Canonical dump of a JSON object; anything else becomes an empty one. Spark has no dump with a space after each separator."""

    def dump(text: str) -> str:
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return "{}"
        return canonical_json(value) if isinstance(value, dict) else "{}"

    return mapped(unfenced(raw, "json"), dump)


def embedding_text(value: object) -> str | None:
    """The text of a string, of {"text": ...}, or of a list of text parts; null where there is none."""
    if isinstance(value, str):
        return value.strip() or None
    if isinstance(value, dict):
        return embedding_text(value["text"]) if isinstance(value.get("text"), str) else None
    if isinstance(value, list):
        parts = [p["text"].strip() for p in value if isinstance(p, dict) and p.get("type") == "text" and isinstance(p.get("text"), str)]
        return "\n".join(p for p in parts if p) or None
    return None


def embedding_input(raw: Column) -> Column:
    """embedding_text() of a value given as JSON."""
    value = F.try_parse_json(raw)
    kind = F.schema_of_variant(value)
    text_of = lambda v, path="$": F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.nullif(trimmed(F.try_variant_get(v, path, "string")), F.lit("")))
    parts = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.type", "string") == "text", F.lit(False)))
    joined = F.nullif(F.array_join(F.filter(F.transform(parts, lambda x: text_of(x, "$.text")), F.isnotnull), "\n"), F.lit(""))
    return F.when(kind == "STRING", text_of(value)).when(kind.startswith("OBJECT"), text_of(value, "$.text")).when(kind.startswith("ARRAY"), joined)
