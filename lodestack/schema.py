"""Scopes, table schemas and the predicates that scopes become. The three kinds of store read a scope differently."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("uploaded", "indexing", "ready", "failed", "archived", "deleted", "queued")
HIDDEN = ("archived", "deleted")
#: Status -> those that may follow. None: the document is not known yet.
MOVES = {
    None: {"uploaded", "indexing"},
    "uploaded": {"indexing", "failed", "deleted"},
    "indexing": {"ready", "failed", "deleted"},
    "ready": {"indexing", "archived", "deleted"},
    "failed": {"indexing", "deleted"},
    "archived": {"ready", "deleted"},
    "deleted": set(),
}
ELEMENT_TYPES = ("title", "heading", "paragraph", "list_item", "table", "code", "image", "slide", "sheet", "json_record")
RELATIONS = ("HAS_ELEMENT", "HAS_CHUNK", "DERIVED_FROM", "NEXT_CHUNK", "PARENT_CHUNK", "MENTIONED_IN", "SEMANTIC_RELATION")

VECTORS = (
    "vector_id string, vector array<float>, text string, tenant_id string, app_id string, collection_id string, document_id string, chunk_id string, chunk_index int, "
    "embedding_profile_id string, embedding_model string, vector_dimension int, metadata string"
)
#: One table for the four kinds of node: what a kind lacks is null.
NODES = "id string, kind string, tenant_id string, app_id string, collection_id string, document_id string, record_id string, position long, label string, text string, properties map<string,string>"
#: A model call: who made it, by which profile and key, what it took and how it ended.
USAGE = (
    "event_id string, at timestamp, tenant_id string, app_id string, profile_id string, api_key_id string, capability string, model_name string, endpoint string, success boolean, attempts int, "
    "latency_ms long, prompt_tokens long, completion_tokens long, total_tokens long, input_count int, verdict_action string, error_reason string, metadata string"
)
EDGES = "src string, dst string, relation string, kind string, description string, confidence double"


@dataclass(frozen=True)
class Scope:
    tenant_id: str
    app_id: str
    collection_id: str | None = None

    def of_vectors(self) -> Column:
        """No collection means all of them."""
        own = (F.col("tenant_id") == self.tenant_id) & (F.col("app_id") == self.app_id)
        return own & (F.col("collection_id") == self.collection_id) if self.collection_id else own

    def of_graph(self) -> Column:
        """No collection means what was ingested without one."""
        return (F.col("tenant_id") == self.tenant_id) & (F.col("app_id") == self.app_id) & (F.coalesce("collection_id", F.lit("")) == (self.collection_id or ""))

    def of_registry(self) -> Column:
        """The metadata's scope first, the row's own columns where that has none; archived and deleted rows are hidden."""
        told = lambda name: F.coalesce(F.nullif(F.get_json_object("metadata", f"$.scope.{name}"), F.lit("")), F.col(name), F.lit(""))
        own = (told("tenant_id") == self.tenant_id) & (told("app_id") == self.app_id) & ~F.coalesce(F.col("status").isin(*HIDDEN), F.lit(False))
        return own & (told("collection_id") == self.collection_id) if self.collection_id else own


def pool_scope(column: str, requested: str | None) -> Column:
    """A row without a scope fits every request; a request without one fits only such rows."""
    return F.col(column).isNull() if requested is None else F.col(column).isNull() | (F.col(column) == requested)
