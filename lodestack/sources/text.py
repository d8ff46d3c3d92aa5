"""Plain text, Markdown and JSON lines to elements, with built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FENCE = "```"
HEADING = "(?s)^(#{1,6})\\s+(.+)$"


def stem(filename: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(filename, "([^/\\\\]*)$", 1), "(?<=.)\\.[^.]*$", "")


def text_elements(docs: DataFrame, id_col: str = "document_id", text_col: str = "text", markdown: Column | None = None, splitter: str = "\\n\\s*\\n") -> DataFrame:
    """A row for each block between blank lines: document_id, order, element_type, level, text.

    In Markdown a block of one to six # and a title is a heading. A block that begins with three backticks is code. Order
    counts the kept blocks.
    """
    md = F.lit(False) if markdown is None else markdown
    blocks = docs.select(F.col(id_col).alias("document_id"), md.alias("__md"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), splitter)).alias("__at", "__raw"))
    kept = blocks.withColumn("__b", F.btrim("__raw", F.lit(" \t\n\x0b\x0c\r"))).where("__b <> ''")
    # Blocks of one text stand in one row until here, so numbering them needs no more memory than the text did.
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("__at")) - 1
    heading = F.col("__md") & F.col("__b").rlike(HEADING)
    kind = F.when(heading, "heading").when(F.startswith("__b", F.lit(FENCE)), "code").otherwise("paragraph")
    level = F.when(heading, F.length(F.regexp_extract("__b", HEADING, 1)))
    text = F.when(heading, F.trim(F.regexp_extract("__b", HEADING, 2))).otherwise(F.col("__b"))
    return kept.select("document_id", order.cast("long").alias("order"), kind.alias("element_type"), level.cast("int").alias("level"), text.alias("text"))


def titles(elements: DataFrame, docs: DataFrame, id_col: str = "document_id") -> DataFrame:
    """document_id, title: the first element if that is a heading, else the file's stem."""
    first = elements.where("order = 0 and element_type = 'heading'").select("document_id", F.col("text").alias("__t"))
    own = docs.select(F.col(id_col).alias("document_id"), stem(F.col("filename")).alias("__s"))
    return own.join(first, "document_id", "left").select("document_id", F.coalesce("__t", "__s").alias("title"))


def json_line_elements(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """One record for each line that is not blank; order is the physical line, gaps kept."""
    from ..functions.model_output import json_keys_sorted

    lines = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("order", "__l")).where(F.trim("__l") != "")
    return lines.select("document_id", F.col("order").cast("long").alias("order"), F.lit("json_record").alias("element_type"), json_keys_sorted(F.trim("__l")).alias("text"), (F.col("order") + 1).cast("long").alias("jsonl_line"))
