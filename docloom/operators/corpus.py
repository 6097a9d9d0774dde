"""Corpus metrics, document traces, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULTS
from docloom.functions.text import preview, suffix
from docloom.schema import PAGE


def metrics(chunks: DataFrame, mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """One row of totals. chunks: doc_name, page_num, text; mentions: label; documents: doc_name."""
    paged = F.when(F.col("page_num").isNotNull(), F.struct("doc_name", "page_num"))  # chunks without a page refer to none
    c = chunks.agg(F.count("*").alias("total_chunks"), F.coalesce(F.round(F.avg(F.length("text")), 1), F.lit(0.0)).alias("avg_chunk_chars"), F.coalesce(F.max(F.length("text")), F.lit(0)).cast("long").alias("max_chunk_chars"), F.countDistinct(paged).alias("distinct_pages"))
    m = mentions.agg(F.count("*").alias("total_entities"))
    labels = mentions.groupBy("label").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("entities_by_label"))
    d = documents.agg(F.count("*").alias("total_documents"))
    kinds = documents.groupBy(suffix("doc_name").alias("kind")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("documents_by_type"))
    # every side is one row of totals
    return c.crossJoin(m).crossJoin(d).crossJoin(labels).crossJoin(kinds)


def by_document(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """doc_name, chunks, sections (chunks that have a section), chars. documents (doc_name, ...): the listing, whose
    other columns stay; its documents without chunks have 0.
    """
    per = chunks.groupBy("doc_name").agg(F.count("*").alias("chunks"), F.count(F.when(F.coalesce("section", F.lit("")) != "", 1)).alias("sections"), F.sum(F.length("text")).alias("chars"))
    return per if documents is None else documents.join(per, "doc_name", "left").fillna(0, ["chunks", "sections", "chars"])


def traces(documents: DataFrame, chunks: DataFrame, samples: int = 12, titles: int = 20, page_samples: int = 8) -> DataFrame:
    """doc_name, document_type, parser, raw_chars, clean_chars, page_count, total_chunks, section_titles, raw_preview,
    clean_preview, page_samples (page_num, char_count, has_tables, sections, preview), chunk_samples (chunk_index,
    chunk_id, page_num, section, section_num, char_count, preview).

    documents: doc_name, raw, clean, and pages where there are any. Section titles are those of the sampled pages.
    Samples of chunks are cut by index before they are gathered.
    """
    none = F.lit(None).cast(f"array<{PAGE}>")
    pages = F.coalesce(F.col("pages") if "pages" in documents.columns else none, F.array().cast(f"array<{PAGE}>"))
    held = documents.select("doc_name", "raw", "clean", pages.alias("pages"), F.slice(pages, 1, page_samples).alias("first"))
    named = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("first", lambda p: F.coalesce(p["metadata"]["sections"], F.array().cast("array<string>")))), lambda t: t != "")))
    sampled = F.transform("first", lambda p: F.struct(p["page_num"].alias("page_num"), F.length(p["text"]).alias("char_count"), F.coalesce(p["metadata"]["has_tables"], F.lit(False)).alias("has_tables"), p["metadata"]["sections"].alias("sections"), preview(p["text"]).alias("preview")))
    parser = F.when(F.size("pages") > 0, F.coalesce(F.try_element_at("pages", F.lit(1))["metadata"]["parser"], F.lit("pdf"))).otherwise(F.lit("text"))
    sizes = held.select(
        "doc_name",
        suffix("doc_name").alias("document_type"),
        parser.alias("parser"),
        F.length("raw").cast("long").alias("raw_chars"),
        F.length("clean").cast("long").alias("clean_chars"),
        F.greatest(F.size("pages"), F.lit(1)).alias("page_count"),
        F.slice(named, 1, titles).alias("section_titles"),
        preview("raw").alias("raw_preview"),
        preview("clean").alias("clean_preview"),
        sampled.alias("page_samples"),
    )
    ident = F.col("chunk_id") if "chunk_id" in chunks.columns else F.lit(None).cast("string").alias("chunk_id")
    head = F.when(F.col("chunk_index") < samples, F.struct("chunk_index", ident, "page_num", "section", "section_num", F.length("text").alias("char_count"), preview("text").alias("preview")))
    per = chunks.groupBy("doc_name").agg(F.count("*").alias("total_chunks"), F.array_sort(F.collect_list(head)).alias("chunk_samples"))
    return sizes.join(per, "doc_name", "left").withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0)))


def status(done: Column, total: Column, failed: Column) -> Column:
    """struct (status, current_stage, progress, message) of a run over so many documents."""
    over = done + failed >= total
    state = F.when(total == 0, "idle").when(over & (done == 0) & (failed > 0), "error").when(over, "completed").otherwise("processing")
    stage = F.when(total == 0, "idle").when(over, "completed").otherwise("parsing")
    message = F.when(total == 0, F.lit("No documents found in the documents directory.")).otherwise(F.concat(done.cast("string"), F.lit("/"), total.cast("string"), F.lit(" documents processed")))
    return F.struct(state.alias("status"), stage.alias("current_stage"), progress(done + failed, total).alias("progress"), message.alias("message"))


def entity_rollup(mentions: DataFrame, samples: int = 12) -> DataFrame:
    """doc_name, total, by_label, samples (the first mentions). mentions: doc_name, chunk_index, pos, label, text."""
    labelled = mentions.groupBy("doc_name", "label").agg(F.count("*").alias("n"))
    counts = labelled.groupBy("doc_name").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("by_label"))
    order = Window.partitionBy("doc_name").orderBy("chunk_index", "pos", "label")
    first = mentions.withColumn("r", F.row_number().over(order)).where(F.col("r") <= samples)
    return counts.join(first.groupBy("doc_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "text", "label"))), lambda x: F.concat(x["text"], F.lit(" ("), x["label"], F.lit(")"))).alias("samples")), "doc_name", "left")


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total * 100).otherwise(F.lit(0.0))


def latest(history: DataFrame, n: int = DEFAULTS.history_limit, by: str = "timestamp", tie: str = "id") -> DataFrame:
    """The newest rows; each partition keeps its own n newest before they meet."""
    return history.orderBy(F.desc(by), F.desc(tie)).limit(n)
