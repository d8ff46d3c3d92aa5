"""Elements to sections to chunks, and the removal of repeated chunks.

Elements are rows (document_id, order, element_id, element_type, text, page_number, slide_number, sheet_name, table,
image_ref). Everything is partitioned by document; only the sentence-aware splitter and embedding leave the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embedding import EmbeddingProvider, embedded
from ..functions.text import bound, collapse, content_hash, token_count
from ..functions.vectors import cosine

COLUMNS = ("chunk_id", "document_id", "chunk_index", "text", "strategy", "chunk_role", "parent_chunk_id", "is_embeddable", "source_element_ids", "content_hash", "token_count", "section_index", "boundary_type", "boundary_value")


@dataclass(frozen=True)
class ChunkingConfig:
    strategy: str = "parent_child"
    max_tokens: int = 700
    overlap_tokens: int = 80
    parent_max_tokens: int = 1800
    percentile: int = 95
    buffer: int = 1
    sentences: bool = False

    @property
    def size(self) -> int:
        return max(1, self.max_tokens)

    @property
    def overlap(self) -> int:
        return max(0, min(self.overlap_tokens, self.max_tokens - 1))


def element_text(kind: Column, text: Column, table: Column, image_ref: Column) -> Column:
    """A table's rows as lines of cells between bars, an image's description in brackets, other elements' own text."""
    rows = F.array_join(F.transform(table, lambda r: F.array_join(F.transform(r, lambda c: F.trim(c)), " | ")), "\n")
    image = F.concat(F.lit("[Image: "), F.coalesce(F.nullif(F.trim(text), F.lit("")), F.nullif(image_ref, F.lit("")), F.lit("embedded image")), F.lit("]"))
    return F.when((kind == "table") & table.isNotNull(), rows).when(kind == "image", image).otherwise(F.trim(F.coalesce(text, F.lit(""))))


def boundary(slide: Column, sheet: Column, page: Column) -> Column:
    """struct(type, value) of slide, else sheet, else page, else null."""
    told = lambda name, v: F.struct(F.lit(name).alias("type"), v.cast("string").alias("value"))
    return F.when(slide.isNotNull(), told("slide", slide)).when(sheet.isNotNull(), told("sheet", sheet)).when(page.isNotNull(), told("page", page))


def _whole(elements: DataFrame) -> DataFrame:
    """elements with the columns that they lack, as nulls."""
    kinds = {"element_id": "string", "page_number": "int", "slide_number": "int", "sheet_name": "string", "table": "array<array<string>>", "image_ref": "string"}
    return elements.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in elements.columns})


def sections(elements: DataFrame) -> DataFrame:
    """elements with section_index and their boundary.

    A heading begins a section, and so does an element whose boundary differs from the running one, which a heading
    clears. Both are running sums over a document's rows in order, which are sorted once: of headings, and of beginnings, where the
    last known boundary counts if it is of the same heading.
    """
    by_doc = Window.partitionBy("document_id").orderBy("order")
    heading = F.coalesce(F.col("element_type").isin("heading", "title"), F.lit(False))
    e = _whole(elements).withColumn("__b", boundary(F.col("slide_number"), F.col("sheet_name"), F.col("page_number")))
    e = e.withColumn("__h", F.sum(heading.cast("int")).over(by_doc))
    known = F.when(F.col("__b").isNotNull(), F.struct(F.col("__h").alias("h"), F.col("__b").alias("b")))
    e = e.withColumn("__k", F.last(known, ignorenulls=True).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)))
    changed = F.coalesce((F.col("__k.h") == F.col("__h")) & (F.col("__b") != F.col("__k.b")), F.lit(False))
    e = e.withColumn("__c", (heading | changed).cast("int"))
    index = (F.sum("__c").over(by_doc) - F.first("__c").over(by_doc)).cast("int")
    return e.withColumn("section_index", index).withColumn("__text", element_text(F.col("element_type"), F.col("text"), F.col("table"), F.col("image_ref"))).drop("__h", "__k", "__c")


def section_texts(elements: DataFrame) -> DataFrame:
    """(document_id, section_index, text, element_ids, boundary_type, boundary_value, media); sections without text go."""
    row = F.struct("order", F.col("__text").alias("text"), F.col("element_id").alias("id"))
    image = F.struct("order", F.col("image_ref").alias("ref"), F.trim(F.coalesce("text", F.lit(""))).alias("alt"))
    found = sections(elements).groupBy("document_id", "section_index").agg(
        F.sort_array(F.collect_list(F.when(F.col("__text") != "", row))).alias("__rows"),
        F.sort_array(F.collect_list(F.when(F.col("element_type") == "image", image))).alias("media"),
        F.min_by("__b", F.when(F.col("__b").isNotNull(), F.col("order"))).alias("__b"))
    texts, ids = F.col("__rows.text"), F.filter(F.col("__rows.id"), lambda i: i.isNotNull())
    return found.where(F.size("__rows") > 0).select("document_id", "section_index", F.array_join(texts, "\n\n").alias("text"), ids.alias("element_ids"), F.col("__b.type").alias("boundary_type"), F.col("__b.value").alias("boundary_value"), "media")


def token_windows(text: Column, size: int, overlap: int) -> Column:
    """Array of texts of `size` tokens that share `overlap` with the one before; the last ends with the text."""
    step = max(1, size - overlap)
    starts = lambda w: F.sequence(F.lit(0), F.ceil((F.size(w) - size) / F.lit(step)).cast("int"))
    cut = lambda clean, w: F.when(F.size(w) <= size, F.array(clean)).otherwise(F.transform(starts(w), lambda k: F.array_join(F.slice(w, k * step + 1, size), " ")))
    # White space is collapsed, and the words are split, once a text.
    return bound(collapse(text), lambda clean: F.when(clean == "", F.array().cast("array<string>")).otherwise(bound(F.split(clean, " "), lambda w: cut(clean, w))))


def split_sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]


def sentence_windows(text: str, size: int, overlap: int) -> list[str]:
    """Whole sentences up to `size` tokens; longer sentences by words. A window repeats whole sentences up to `overlap`."""
    units: list[tuple[str, int]] = []
    for s in split_sentences(text):
        words = s.split()
        units += [(s, len(words))] if len(words) <= size else [(" ".join(words[i : i + size]), len(words[i : i + size])) for i in range(0, len(words), size)]
    out, held, fresh = [], [], False
    for unit in units:
        if fresh and sum(n for _, n in held) + unit[1] > size:
            out.append(" ".join(s for s, _ in held))
            keep: list[tuple[str, int]] = []
            for u in reversed(held):
                if sum(n for _, n in keep) + u[1] > overlap or sum(n for _, n in keep) + u[1] + unit[1] > size:
                    break
                keep.insert(0, u)
            held = keep
        held.append(unit)
        fresh = True
    return [*out, " ".join(s for s, _ in held)] if held else out


def windows(text: Column, size: int, overlap: int, sentences: bool = False) -> Column:
    if not sentences:
        return token_windows(text, size, overlap)

    @F.pandas_udf("array<string>")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sentence_windows(t or "", size, overlap))

    return packed(text)


def _finished(rows: DataFrame, strategy: str) -> DataFrame:
    told = rows.withColumns({"strategy": F.lit(strategy), "content_hash": content_hash(F.col("text")), "token_count": token_count(F.col("text")).cast("int"), "source_element_ids": F.col("element_ids")})
    return told.select(*COLUMNS)


def _numbered(*order: str) -> Column:
    return (F.row_number().over(Window.partitionBy("document_id").orderBy(*order)) - 1).cast("long")


def sliding(elements: DataFrame, config: ChunkingConfig) -> DataFrame:
    """Windows that never cross a section; all can be embedded."""
    parts = section_texts(elements).select("*", F.posexplode(windows(F.col("text"), config.size, config.overlap, config.sentences)).alias("__n", "__t")).drop("text").withColumnRenamed("__t", "text")
    rows = parts.withColumn("chunk_index", _numbered("section_index", "__n"))
    rows = rows.withColumns({"chunk_id": F.concat_ws(":", "document_id", F.lit("chunk"), "chunk_index"), "chunk_role": F.lit("window"), "parent_chunk_id": F.lit(None).cast("string"), "is_embeddable": F.lit(True)})
    return _finished(rows, "sliding_window")


def parent_child(elements: DataFrame, config: ChunkingConfig) -> DataFrame:
    """Large windows, not embedded, each followed by its small windows, which are."""
    big = max(config.max_tokens, config.parent_max_tokens)
    parents = section_texts(elements).select("*", F.posexplode(windows(F.col("text"), max(1, big), min(config.overlap, big - 1), config.sentences)).alias("__n", "__t")).drop("text")
    parents = parents.withColumn("__p", _numbered("section_index", "__n"))
    small = F.transform(windows(F.col("__t"), config.size, config.overlap, config.sentences), lambda t, i: F.struct((i + 1).alias("level"), t.alias("text")))
    family = parents.select("*", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("level"), F.col("__t").alias("text"))), small)).alias("__m")).drop("__t")
    rows = family.select("*", F.col("__m.level").alias("__l"), F.col("__m.text").alias("text"))
    child = F.col("__l") > 0
    child_no = F.sum(child.cast("long")).over(Window.partitionBy("document_id").orderBy("__p", "__l")) - 1
    parent_id = F.concat_ws(":", "document_id", F.lit("parent"), "__p")
    rows = rows.withColumns({"chunk_index": _numbered("__p", "__l"), "chunk_id": F.when(child, F.concat_ws(":", "document_id", F.lit("child"), child_no)).otherwise(parent_id), "parent_chunk_id": F.when(child, parent_id), "is_embeddable": child, "chunk_role": F.when(child, "child").otherwise("parent")})
    return _finished(rows, "parent_child")


def semantic(elements: DataFrame, config: ChunkingConfig, provider: EmbeddingProvider) -> DataFrame:
    """Sentences with their neighbours are embedded; a chunk ends where the distance to the next exceeds the percentile of its section."""
    key = ["document_id", "section_index"]
    said = section_texts(elements).select("*", F.posexplode(F.split(collapse(F.col("text")), "(?<=[.!?])\\s+")).alias("__i", "__s")).drop("text")
    order = Window.partitionBy(*key).orderBy("__i")
    near = order.rowsBetween(-max(1, config.buffer), max(1, config.buffer))
    units = embedded(said.withColumn("__u", F.array_join(F.collect_list("__s").over(near), " ")), provider, "__u", "__v")
    gap = 1 - cosine(F.col("__v"), F.lag("__v").over(order))
    gaps = units.withColumn("__d", F.when(F.col("__i") > 0, gap)).drop("__v", "__u")
    share = min(99, max(1, config.percentile)) / 100
    cut = gaps.withColumn("__c", F.percentile("__d", F.lit(share)).over(Window.partitionBy(*key)))
    grouped = cut.withColumn("__g", F.sum(F.coalesce((F.col("__d") > F.col("__c")).cast("int"), F.lit(0))).over(order))
    texts = grouped.groupBy(*key, "__g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__s"))), lambda x: x["__s"]), " ").alias("text"), F.first("element_ids").alias("element_ids"), F.first("boundary_type").alias("boundary_type"), F.first("boundary_value").alias("boundary_value"))
    rows = texts.withColumn("chunk_index", _numbered("section_index", "__g"))
    rows = rows.withColumns({"chunk_id": F.concat_ws(":", "document_id", F.lit("semantic"), "chunk_index"), "chunk_role": F.lit("semantic"), "parent_chunk_id": F.lit(None).cast("string"), "is_embeddable": F.lit(True)})
    return _finished(rows, "semantic")


def chunk(elements: DataFrame, config: ChunkingConfig | None = None, provider: EmbeddingProvider | None = None) -> DataFrame:
    config = config or ChunkingConfig()
    if config.strategy == "sliding_window":
        return sliding(elements, config)
    if config.strategy == "parent_child":
        return parent_child(elements, config)
    if config.strategy == "semantic" and provider is not None:
        return semantic(elements, config, provider)
    raise ValueError(f"{config.strategy}: unknown, or semantic without an embedding provider")


def marked(chunks: DataFrame, scope: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """chunks with __kept: whether dedupe within these columns keeps them."""
    place = F.row_number().over(Window.partitionBy(*scope, "content_hash", "is_embeddable").orderBy("chunk_index", "chunk_id"))
    return chunks.select("*", ((place == 1) | ~F.col("is_embeddable")).alias("__kept"))


def dedupe(chunks: DataFrame, scope: tuple[str, ...] = ("document_id",), known_hashes: DataFrame | None = None) -> DataFrame:
    """Of embeddable chunks with equal hashes the first stays; others are not compared. known_hashes: (content_hash) to leave out.

    Within a document, chunks lie together already, so one more sort finds the first, without a second pass or a shuffle of texts. In a wider
    scope it is found as a minimum per hash, combined before the shuffle, so a hash that very many chunks share is no large group.
    """
    if "document_id" in scope and known_hashes is None:
        return marked(chunks, scope).where("__kept").select(*chunks.columns)
    keyed = chunks.where("is_embeddable")
    place = F.struct("chunk_index", "chunk_id")
    kept = keyed.groupBy(*scope, "content_hash").agg(F.min(place).alias("__f")).select(*scope, F.col("__f.chunk_id").alias("chunk_id"))
    if known_hashes is not None:
        new = keyed.groupBy(*scope, "content_hash").agg(F.min(place).alias("__f")).join(known_hashes.select("content_hash").distinct(), "content_hash", "left_anti")
        kept = new.select(*scope, F.col("__f.chunk_id").alias("chunk_id"))
    return keyed.join(kept, [*dict.fromkeys([*scope, "chunk_id"])], "left_semi").select(*chunks.columns).unionByName(chunks.where("not is_embeddable"))


def stats(elements: DataFrame, chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """Per document: elements, chunks, graph_records, vector_records, duplicate_chunks."""
    c = chunks.groupBy("document_id").agg(F.count("*").alias("all_chunks"))
    k = kept.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_if("is_embeddable").alias("vector_records"))
    return _told(elements, c.join(k, "document_id", "left"))


def deduped_stats(elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """stats() of chunks and of dedupe(chunks), with chunks read once: of embeddable ones each distinct hash of a document stays."""
    hashes = chunks.groupBy("document_id", "is_embeddable", "content_hash").agg(F.count("*").alias("n"))
    own = F.col("is_embeddable")
    c = hashes.groupBy("document_id").agg(F.sum("n").alias("all_chunks"), F.sum(F.when(~own, F.col("n")).otherwise(1)).alias("chunks"), F.count_if(own).alias("vector_records"))
    return _told(elements, c)


def _told(elements: DataFrame, counts: DataFrame) -> DataFrame:
    e = elements.groupBy("document_id").agg(F.count("*").alias("elements"))
    told = e.join(counts, "document_id", "left").fillna(0)
    return told.select("document_id", "elements", "chunks", (F.lit(1) + F.col("elements") + F.col("chunks")).alias("graph_records"), "vector_records", (F.col("all_chunks") - F.col("chunks")).alias("duplicate_chunks"))
