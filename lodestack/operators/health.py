"""The embedding health report: what is embedded of each document, with which profile and dimension, and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import dimension_status

SYSTEM_KEYS = ("tenant_id", "app_id", "collection_id", "document_id", "chunk_id", "chunk_index", "text")
POOL = "runtime embedding pool"


def chunk_stats(chunks: DataFrame, scope: Column | None = None) -> DataFrame:
    rows = chunks if scope is None else chunks.where(scope)
    return rows.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.count_if("is_embeddable").alias("embeddable_chunk_count"))


def unanimous(value: Column) -> Column:
    """An aggregate: the value if all agree."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def matched_profiles(models: DataFrame, profiles: DataFrame) -> DataFrame:
    """models: (embedding_profile_id, embedding_model), distinct -> with profile_name and expected_dimension.

    By id first; else by model name, equal or one the other's end after a slash: that is equality of a name's suffixes,
    so both sides list theirs and meet in a hash join. Of several profiles only a dimension that all share counts.
    """
    def ends(name: Column) -> Column:
        parts = F.split(name, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

    p = profiles.select("profile_id", "profile_name", F.col("model_name").alias("pm"), F.col("embedding_dimensions").alias("dim"))
    by_id = models.join(p, models["embedding_profile_id"] == p["profile_id"]).select("embedding_profile_id", "embedding_model", "profile_name", F.col("dim").alias("expected_dimension"))
    rest = models.join(p.select("profile_id"), models["embedding_profile_id"] == p["profile_id"], "left_anti")
    longer = rest.select("*", F.explode(ends(F.col("embedding_model"))).alias("name")).join(p, F.col("name") == F.col("pm"))
    shorter = p.select("*", F.explode(ends(F.col("pm"))).alias("name")).join(rest, F.col("name") == F.col("embedding_model"))
    columns = ["embedding_profile_id", "embedding_model", "profile_id", "profile_name", "dim"]
    met = longer.select(*columns).unionByName(shorter.select(*columns)).distinct()
    one = met.groupBy("embedding_profile_id", "embedding_model").agg(F.when(F.count("*") == 1, F.min("profile_name")).otherwise(F.lit(POOL)).alias("profile_name"), F.when(F.count("dim") == F.count("*"), unanimous(F.col("dim"))).alias("expected_dimension"))
    return by_id.unionByName(one)


def report(vectors: DataFrame, stats: DataFrame, profiles: DataFrame, limit: int | None = None) -> DataFrame:
    """A row for each (document, profile, model, dimension), and one for each document of which nothing is embedded.

    vectors: (document_id, embedding_profile_id, embedding_model, vector_dimension, vector_id, metadata as JSON). missing
    counts against each group, as every group should hold all embeddable chunks. With a limit only the first records
    by id are looked at.
    """
    rows = vectors if limit is None else vectors.orderBy("vector_id").limit(max(1, min(100_000, limit)))
    stamp = F.coalesce(F.try_to_timestamp(F.get_json_object("metadata", "$.last_indexed_at")), F.try_to_timestamp(F.get_json_object("metadata", "$.indexed_at")))
    key = ["document_id", "embedding_profile_id", "embedding_model", "vector_dimension"]
    own = rows.withColumn("__at", stamp).groupBy(*key).agg(F.count("*").alias("embedded_count"), F.min_by("__at", F.when(F.col("__at").isNotNull(), F.col("vector_id"))).alias("last_indexed_at"), F.min_by("metadata", "vector_id").alias("metadata"))
    models = own.select("embedding_profile_id", "embedding_model").distinct()
    known = matched_profiles(models, profiles).select(F.col("embedding_profile_id").alias("__i"), F.col("embedding_model").alias("__m"), "profile_name", "expected_dimension")
    named = own.join(known, F.col("embedding_profile_id").eqNullSafe(F.col("__i")) & F.col("embedding_model").eqNullSafe(F.col("__m")), "left").drop("__i", "__m")
    told = named.join(stats, "document_id", "full_outer")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    told = told.select(
        "document_id", "profile_name", "embedding_model", "vector_dimension", "expected_dimension", n("embedded_count").alias("embedded_count"), n("chunk_count").alias("chunk_count"), n("embeddable_chunk_count").alias("embeddable_chunk_count"),
        F.greatest(F.lit(0), n("embeddable_chunk_count") - n("embedded_count")).alias("missing_count"), dimension_status(F.col("vector_dimension"), F.col("expected_dimension")).alias("dimension_status"), "last_indexed_at", source_metadata(F.col("metadata")).alias("source_metadata"))
    return told.orderBy("document_id", F.coalesce("profile_name", F.lit("")), F.coalesce("embedding_model", F.lit("")), F.coalesce("vector_dimension", F.lit(0)))


def source_metadata(metadata: Column) -> Column:
    """A JSON object's entries without the system's own."""
    entries = F.from_json(metadata, "map<string,string>")
    return F.map_filter(entries, lambda k, v: ~k.isin(*SYSTEM_KEYS))


def first_truthy(value: Column, order: Column) -> Column:
    """An aggregate: the first value in order that is neither null nor empty."""
    real = value.isNotNull() & (value.cast("string") != "")
    return F.min_by(F.when(real, value), F.when(real, order))
