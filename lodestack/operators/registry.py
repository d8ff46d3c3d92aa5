"""The registry of documents: listing, look-up, state and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HIDDEN, MOVES, STATUSES, Scope

LISTED = 20


def newest_first(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("created_at"), "id")


def by_filename(documents: DataFrame, name: str) -> DataFrame:
    return documents.where(F.lower("filename") == name.lower())


def filename_conflicts(documents: DataFrame) -> DataFrame:
    """File names that differ in case only, or not at all."""
    return documents.groupBy(F.lower("filename").alias("filename")).agg(F.count("*").alias("n")).where("n > 1")


def current_states(events: DataFrame) -> DataFrame:
    """events (document_id, at, status, semantic_status, either may be null) -> the last known value of each, independently."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "seq"))).alias(c)
    return events.groupBy("document_id").agg(last("status"), last("semantic_status"), F.max("at").alias("updated_at"))


def inventory(documents: DataFrame, scope: Scope | None = None, limit: int = LISTED) -> DataFrame:
    """One row with the newest documents of a scope as lines, the first `limit` of them."""
    rows = documents.where(scope.of_registry()) if scope else documents.where(~F.coalesce(F.col("status").isin(*HIDDEN), F.lit(False)))
    top = rows.orderBy(F.desc("created_at"), "id").limit(limit).withColumn("__n", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")))
    line = F.concat(F.lit("- "), F.col("filename"), F.lit(" ("), F.col("status"), F.lit(")"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", line.alias("line")))), lambda r: r["line"]), "\n").alias("text"), F.count("*").alias("n"))


def with_filenames(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """rows (document_id, filename, which may be null) with the registry's name where they have none."""
    known = documents.select(F.col("id").alias("document_id"), F.col("filename").alias("__f"))
    return rows.join(known, "document_id", "left").withColumn("filename", F.coalesce(F.nullif("filename", F.lit("")), "__f")).drop("__f")


def delete(documents: DataFrame, document_id: str) -> DataFrame:
    return documents.where(~F.coalesce(F.col("id") == document_id, F.lit(False)))


def put(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """documents with rows added, in place of those of the same id."""
    return documents.join(rows.select("id"), "id", "left_anti").select(*documents.columns).unionByName(rows.select(*documents.columns))


def with_status(documents: DataFrame, changes: DataFrame, checked: bool = False) -> DataFrame:
    """documents with the status of changes (id, status); a change to an unknown status or document does nothing, nor, if checked, one that MOVES does not allow."""
    told = changes.where(F.col("status").isin(*STATUSES)).groupBy("id").agg(F.max("status").alias("__s"))
    allowed = F.array(*[F.lit(f"{a or ''}>{b}") for a, to in MOVES.items() for b in sorted(to)])
    may = F.array_contains(allowed, F.concat_ws(">", F.coalesce("status", F.lit("")), "__s")) if checked else F.lit(True)
    return documents.join(told, "id", "left").withColumn("status", F.when(may, F.coalesce("__s", "status")).otherwise(F.col("status"))).select(*documents.columns)
