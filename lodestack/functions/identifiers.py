"""Identifiers of nodes, edges, entities, vectors and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def node_id(tenant: Column, app: Column, collection: Column, kind: str, record: Column) -> Column:
    """tenant:app:collection:kind:record, with an empty collection for none."""
    return F.concat_ws(":", tenant, app, blank(collection), F.lit(kind), record)


def edge_id(src: Column, relation: Column, dst: Column) -> Column:
    return F.sha2(F.concat_ws(":", src, relation, dst), 256)


def entity_key(entity_type_folded: Column, normalized_name: Column) -> Column:
    """What an entity's id is the hash of: shorter than the id, to group by."""
    return F.concat_ws(":", entity_type_folded, normalized_name)


def keyed_entity_id(tenant: Column, app: Column, collection: Column, key: Column) -> Column:
    return node_id(tenant, app, collection, "entity", F.sha2(key, 256))


def entity_id(tenant: Column, app: Column, collection: Column, entity_type_folded: Column, normalized_name: Column) -> Column:
    """Entities are the same in a scope if type (case folded) and normal name are."""
    return keyed_entity_id(tenant, app, collection, entity_key(entity_type_folded, normalized_name))


def vector_id(tenant: Column, app: Column, collection: Column, document: Column, chunk: Column) -> Column:
    return F.concat_ws(":", tenant, app, F.coalesce(F.nullif(collection, F.lit("")), F.lit("default")), document, chunk)


def document_id(tenant: Column, app: Column, sha256: Column) -> Column:
    """Deterministic: the same content in the same scope is the same document."""
    return F.sha2(F.concat_ws(":", tenant, app, sha256), 256)
