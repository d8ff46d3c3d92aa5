"""All queries of the engine, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from .plans import catalog_graph, catalog_more, catalog_store, catalog_text, catalog_wide

FLAGSHIP = "k01_vector_topk"
QUERIES = catalog_text.Q | catalog_graph.Q | catalog_more.Q | catalog_wide.Q | catalog_store.Q
ORACLE_SQL = catalog_text.SQL | catalog_graph.SQL | catalog_more.SQL | catalog_wide.SQL | catalog_store.SQL
