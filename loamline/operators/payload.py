"""Chunk records as they are stored, and manifests by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def headings(title: Column, parsed_title: Column) -> Column:
    """The distinct ones of both, the page's own title first."""
    return F.array_distinct(F.array_compact(F.array(F.nullif(title, F.lit("")), F.nullif(parsed_title, F.lit("")))))


def source_url(original: Column, source: Column, parsed: Column) -> Column:
    return F.coalesce(F.nullif(original, F.lit("")), F.nullif(source, F.lit("")), F.nullif(parsed, F.lit("")))


def html_payload(chunks: DataFrame, parser_version: str, ingest_time: Column) -> DataFrame:
    """(document_id, value): one JSON line per chunk with sorted keys and without nulls. chunks: as html_chunks() and file_type, source_url, title, parsed_title, raw_key, original_url."""
    said = headings(F.col("title"), F.col("parsed_title"))
    said = F.when(F.size(said) > 0, said)
    fields = {
        "document_id": F.col("document_id"), "chunk_id": F.col("chunk_id"), "chunk_index": F.col("window_index"), "text": F.col("text"), "token_count": F.col("token_count"),
        "token_range": F.array("token_start", "token_end"), "document_total_tokens": F.col("document_total_tokens"), "semantic_region": F.col("semantic_region"), "file_type": F.coalesce("file_type", F.lit("html")),
        "source_url": F.col("source_url"), "ingest_time": ingest_time, "parser_version": F.lit(parser_version), "headings": said, "heading_path": said, "layout_tags": F.array(F.lit("html")),
        "figures": F.array().cast("array<string>"), "used_ocr": F.lit(False), "provenance": F.struct(F.col("document_id").alias("raw_sha256"), F.col("raw_key"), F.col("original_url")),
    }
    return chunks.select("document_id", F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))).alias("value"))


def pdf_payload(chunks: DataFrame, pages: DataFrame, parser_version: str, ingest_time: Column) -> DataFrame:
    """(document_id, chunk_id, value): one JSON line per chunk of a page with sorted keys and its nulls. chunks: as pdf_chunks(); pages: document_id, page_number, figures (array), used_ocr, source_url, raw_key, original_url, original_manifest (JSON text). A page without text has one empty chunk that carries its figures; else they are on each of its chunks."""
    both = chunks.join(pages, ["document_id", "page_number"])
    fields = {
        "document_id": F.col("document_id"), "chunk_id": F.col("chunk_id"), "chunk_index": F.col("chunk_number"), "chunk_type": F.when(F.col("text") == "", "pdf_page").otherwise("pdf_page_window"), "text": F.col("text"),
        "token_count": F.col("token_count"), "token_range": F.array("token_start", "token_end"), "document_total_tokens": F.col("document_total_tokens"), "semantic_region": F.col("semantic_region"),
        "figures": F.coalesce("figures", F.array().cast("array<string>")), "file_type": F.lit("application/pdf"), "source_url": F.col("source_url"), "page_number": F.col("page_number"), "ingest_time": ingest_time,
        "parser_version": F.lit(parser_version), "used_ocr": F.coalesce("used_ocr", F.lit(False)), "original_manifest": F.try_parse_json("original_manifest"),
        "provenance": F.struct(F.col("document_id").alias("raw_sha256"), F.col("raw_key"), F.col("original_url")), "embedding": F.lit(None).cast("array<float>"),
    }
    line = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
    return both.select("document_id", "chunk_id", line.alias("value"))


def manifest(url: Column, file_hash: Column, mime_ext: Column, size: Column, storage_url: Column, etag: Column, modified: Column, version: str, at: Column) -> Column:
    """What is known of a fetched page."""
    return F.struct(file_hash.alias("file_hash"), mime_ext.alias("mime_ext"), url.alias("original_url"), etag.alias("remote_etag"), modified.alias("remote_lastmod"), F.lit(version).alias("scraper_version"), size.cast("long").alias("size_bytes"), storage_url.alias("storage_url"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"))


def insert_absent(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """stored, and of new the rows whose key it lacks: write-once."""
    return stored.unionByName(new.join(stored.select(key), key, "left_anti").select(*stored.columns))


def overwrite(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """new, and the rows of stored whose key it lacks."""
    return new.unionByName(stored.join(new.select(key), key, "left_anti").select(*new.columns))


def latest(manifests: DataFrame, key: str, at: str) -> DataFrame:
    """The last manifest of each key; ties by all its fields."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), *(c for c in manifests.columns if c not in (key, at))))
    return manifests.withColumn("rank", rank).where("rank = 1").drop("rank")


def default_id(prefix: str, millis: Column) -> Column:
    """An id for what came without one: when it came."""
    return F.concat(F.lit(f"{prefix}-"), millis.cast("string"))
