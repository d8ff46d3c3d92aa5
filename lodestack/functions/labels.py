"""Labels, severity buckets and strategy names for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import title_case, truncate


def location(page: Column, slide: Column, sheet: Column) -> Column:
    """" - page 3", else slide, else sheet, else empty; zero and empty count as none."""
    told = lambda name, c: F.concat(F.lit(f" - {name} "), c.cast("string"))
    return F.when(F.coalesce(page, F.lit(0)) != 0, told("page", page)).when(F.coalesce(slide, F.lit(0)) != 0, told("slide", slide)).when(F.coalesce(sheet, F.lit("")) != "", told("sheet", sheet)).otherwise("")


def document_label(title: Column, filename: Column, document_id: Column) -> Column:
    first = F.coalesce(F.nullif(title, F.lit("")), F.nullif(filename, F.lit("")), document_id)
    return truncate(first, 84, ellipsis_only=True)


def chunk_label(index: Column, text: Column) -> Column:
    return F.concat(F.lit("Chunk "), (index + 1).cast("string"), F.lit(": "), truncate(text, 72, ellipsis_only=True))


def element_label(kind: Column, page: Column, slide: Column, sheet: Column, text: Column) -> Column:
    """Title-cased type, location, and an excerpt where there is text."""
    said = truncate(text, 72, ellipsis_only=True)
    head = F.concat(F.trim(title_case(F.coalesce(F.nullif(kind, F.lit("")), F.lit("element")))), location(page, slide, sheet))
    return F.when(said == "", head).otherwise(F.concat(head, F.lit(": "), said))


def dimension_status(actual: Column, expected: Column) -> Column:
    return F.when(actual.isNull() | expected.isNull(), "unknown").when(actual == expected, "ok").otherwise("mismatch")


def status_severity(status: Column) -> Column:
    return F.when(status == "ok", "success").when(status == "mismatch", "danger").otherwise("warn")


def missing_severity(missing: Column) -> Column:
    return F.when(F.coalesce(missing, F.lit(0)) != 0, "danger").otherwise("success")


def score_percent(score: Column) -> Column:
    """Width of a score bar: 2 to 100."""
    return F.greatest(F.lit(2.0), F.least(F.lit(100.0), score * 100))


def short_label(label: Column) -> Column:
    return F.when(F.length(label) > 48, F.concat(F.substring(label, 1, 45), F.lit("..."))).otherwise(label)


def retrieval_strategy(n_vectors: Column, n_graph: Column, n_entities: Column, graph_query: Column) -> Column:
    base = F.when(n_vectors == 0, "no_context").when(n_entities > 0, "vector_semantic_graph").when(n_graph > 0, "vector_graph").otherwise("vector_only")
    return F.when(graph_query, F.concat(base, F.lit("+text2cypher"))).otherwise(base)


def response_strategy(kind: Column, n_context: Column, has_registry: Column, n_entities: Column, n_graph: Column) -> Column:
    return (F.when(kind == "social", "embedding_first_social").when((kind == "refusal") & (n_context == 0), "embedding_first_no_context").when(has_registry, "document_registry")
            .when(n_entities > 0, "vector_semantic_graph").when(n_graph > 0, "vector_graph").otherwise("vector_only"))
