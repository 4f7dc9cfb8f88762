"""Sentence windows: greedy, overlapping, with short ones joined to the one before.

Where a window ends follows from prefix sums alone, and joining never moves the
next start; so a document's windows are the orbit of sentence 0 under `next`.
The step is sequential within a document and parallel over documents.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions.scalar import html_region, padded

_SENTENCE = re.compile(r".+?[.?!\n]+|.+?$", re.S)


@dataclass(frozen=True)
class Windows:
    most: int = 512
    least: int = 100
    overlap: int = 2
    #: Compose characters before windowing (HTML does, PDF does not).
    compose: bool = True


@dataclass
class Window:
    index: int
    text: str
    tokens: int
    start: int
    end: int


def canonical(text: str | None, compose: bool = True) -> str:
    text = text or ""
    return " ".join((unicodedata.normalize("NFKC", text) if compose and not text.isascii() else text).split())


def windows(text: str, how: Windows = Windows()) -> list[Window]:
    """text must be canonical. A sentence over the limit is cut and its rest dropped; an empty text has one empty window."""
    parts = [w for w in (m.group().split() for m in _SENTENCE.finditer(text)) if w]
    if not parts:
        return [Window(0, "", 0, 0, 0)]
    before = [0, *accumulate(map(len, parts))]
    out: list[Window] = []
    at = index = 0
    while at < len(parts):
        end = bisect_right(before, before[at] + how.most) - 1
        if end > at:
            words, stop = [w for p in parts[at:end] for w in p], before[end]
        else:
            words, stop = parts[at][: how.most], before[at] + how.most
        if out and len(words) < how.least:
            last = out[-1]
            last.text, last.tokens, last.end = f"{last.text} {' '.join(words)}", last.tokens + len(words), stop
        else:
            out.append(Window(index, " ".join(words), len(words), before[at], stop))
        index += 1
        at = max(at + 1, end - how.overlap)
    return out


_ARROW = pa.schema([("document_id", pa.string()), ("window_index", pa.int32()), ("chunk_number", pa.int32()), ("text", pa.string()), ("token_count", pa.int32()), ("token_start", pa.int32()), ("token_end", pa.int32()), ("document_total_tokens", pa.int32())])


def chunk(docs: DataFrame, id_col: str, text_col: str, how: Windows = Windows()) -> DataFrame:
    """A row per window: document_id, window_index (with gaps where windows were joined), chunk_number (without), text, token_count, token_start, token_end, document_total_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = canonical(text, how.compose)
                total = len(text.split())
                rows += [(doc, w.index, n, w.text, w.tokens, w.start, w.end, total) for n, w in enumerate(windows(text, how))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    src = docs.select(F.col(id_col).cast("string").alias("document_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "document_id string, window_index int, chunk_number int, text string, token_count int, token_start int, token_end int, document_total_tokens int")


def html_chunks(docs: DataFrame, id_col: str, text_col: str, how: Windows = Windows()) -> DataFrame:
    """Chunks with their stable ids and regions as HTML documents have them."""
    out = chunk(docs, id_col, text_col, how)
    return out.withColumn("chunk_id", F.concat("document_id", F.lit("_c"), padded(F.col("window_index")))).withColumn("semantic_region", html_region(F.col("token_start"), F.col("token_end"), F.col("document_total_tokens")))


def pdf_chunks(pages: DataFrame, how: Windows = Windows(compose=False)) -> DataFrame:
    """Chunks of pages (document_id, page_number, text): ids by page and number, regions by the tokens before them in the document."""
    from pyspark.sql import Window as W

    from loamline.functions.scalar import pdf_region

    keyed = pages.select(F.concat_ws("\x1f", F.col("document_id").cast("string"), F.col("page_number").cast("string")).alias("key"), "text")
    out = chunk(keyed, "key", "text", how)
    out = out.withColumn("page_number", F.element_at(F.split("document_id", "\x1f"), 2).cast("int")).withColumn("document_id", F.element_at(F.split("document_id", "\x1f"), 1))
    whole = W.partitionBy("document_id")
    order = whole.orderBy("page_number", "chunk_number").rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("before", F.coalesce(F.sum("token_count").over(order), F.lit(0)))
    out = out.withColumn("document_total_tokens", F.sum(F.when(F.col("chunk_number") == 0, F.col("document_total_tokens"))).over(whole)).withColumn("last_page", F.max("page_number").over(whole))
    region = pdf_region(F.col("before"), F.col("token_count"), F.col("document_total_tokens"), F.col("page_number"), F.col("last_page"))
    return out.select("document_id", "page_number", F.format_string("%s_p%d_%04d", "document_id", "page_number", "chunk_number").alias("chunk_id"), "chunk_number", "text", "token_count", "token_start", "token_end", "document_total_tokens", region.alias("semantic_region"))


def sentence_offsets(rows: DataFrame, document: str, place: str, length: str) -> DataFrame:
    """rows with token_start: the tokens of the sentences before, in their document."""
    from pyspark.sql import Window as W

    before = W.partitionBy(document).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("token_start", F.coalesce(F.sum(length).over(before), F.lit(0)))


def joined_texts(parts: DataFrame, document: str, place: str, text: str = "text", by: str = "\n") -> DataFrame:
    """(document, text, parts): the texts of each document's parts in order."""
    held = F.array_sort(F.collect_list(F.struct(place, text)))  # of one document
    out = parts.groupBy(document).agg(held.alias("held"))
    return out.select(document, F.array_join(F.transform("held", lambda x: x[text]), by).alias("text"), F.size("held").cast("long").alias("parts"))
