"""Files as rows: the gate on extensions, descriptors with content hashes, and landing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import document_id
from ..functions.text import basename, safe_name

#: Fixed values.
ALLOWED = (".pdf", ".xlsx", ".xls", ".docx", ".doc", ".pptx", ".ppt", ".txt", ".csv", ".json", ".jsonl", ".jpg", ".jpeg", ".png")
#: Fixed values.
BLOCKED_IMAGES = (".webp", ".gif", ".bmp", ".tif", ".tiff", ".svg", ".heic", ".avif")
MOST_BYTES = 100 * 1024 * 1024


def extension(filename: Column) -> Column:
    """Lower-cased suffix with its dot; none for names that begin with their only dot."""
    return F.lower(F.regexp_extract(basename(filename), "[^.](\\.[^.]+)$", 1))


def gate(filename: Column, content_type: Column) -> Column:
    """ok, or why a file is turned away."""
    ext = extension(filename)
    image = F.startswith(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("image/"))
    return F.when(ext.isin(*BLOCKED_IMAGES), "blocked_image").when(image & ~ext.isin(*ALLOWED), "blocked_content_type").when(~ext.isin(*ALLOWED), "unsupported_extension").otherwise("ok")


def described(files: DataFrame, tenant: str, app: str) -> DataFrame:
    """files: binaryFile rows -> document_id, filename, extension, byte_size, sha256, status, content. Too large files are told, not read into memory by later steps."""
    name = basename(F.col("path"))
    sha = F.sha2(F.col("content"), 256)
    status = F.when(F.col("length") > MOST_BYTES, "too_large").otherwise(gate(name, F.lit(None).cast("string")))
    return files.select(document_id(F.lit(tenant), F.lit(app), sha).alias("document_id"), name.alias("filename"), extension(name).alias("extension"), F.col("length").alias("byte_size"), sha.alias("sha256"), status.alias("status"), "content")


def read_files(spark: SparkSession, path: str, tenant: str, app: str) -> DataFrame:
    return described(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), tenant, app)


def land(files: DataFrame, folder: str, tenant: str, app: str) -> None:
    """Files under sanitised names, partitioned by tenant and app."""
    rows = files.where("status = 'ok'").select(F.lit(tenant).alias("tenant_id"), F.lit(app).alias("app_id"), safe_name(F.col("filename")).alias("stored_name"), "document_id", "sha256", "content")
    rows.write.mode("append").partitionBy("tenant_id", "app_id").parquet(folder)


def media_url(filename: Column, content_type: Column, content: Column) -> Column:
    """An image as a data URL, its type from the content type, else from the suffix. Spark's base64 has line ends, a data URL none."""
    ext = extension(filename)
    by_suffix = F.when(ext.isin(".jpg", ".jpeg"), "image/jpeg").when(ext == ".png", "image/png").otherwise("application/octet-stream")
    mime = F.when(F.startswith(F.coalesce(content_type, F.lit("")), F.lit("image/")), content_type).otherwise(by_suffix)
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))
