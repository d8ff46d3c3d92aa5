"""A corpus from raw documents to token ids: each stage works on all rows that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the
next stage's docs. All but the last return the columns of documents.

Defined results: a null or blank text has no words and goes with the first stage; so do texts of fewer than ten words. Rows alike in
doc_id and text are one document, of which near_dedup keeps one; rows that share an id but not the text are documents of their own;
rows without doc_id are compared like others by near_dedup, kept whole by substring_dedup and encoded with a null id. Of equally
good rows the smallest id stays. Texts are worked on whole, whatever their length. Empty tables pass through as
empty tables. Other columns are carried along up to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestack.llm.bpe import encode
from lodestack.llm.common import table, written
from lodestack.llm.mixing import repeated
from lodestack.llm.quality import quality_filter
from lodestack.llm.simhash import keep_one
from lodestack.llm.substring import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; the others stay as they are."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, in one row."""
    return keep_one(docs, radius=3, repeats=False)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 50 words that a document with a smaller id has too go; n_chars follows the text."""
    from pyspark.sql import functions as F

    cut = remove_repeats(docs, length=50)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, none to three times."""
    return repeated(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of each row."""
    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]
#: SQL has no tokenizer, no XXH64 and no entropy balancing: the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
