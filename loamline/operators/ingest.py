"""Raw objects into chunk lines and manifests, and jobs made of stages."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions import predicates as p
from loamline.functions.scalar import decoded, extension
from loamline.operators import chunking, payload
from loamline.operators.sync import to_parse

log = logging.getLogger(__name__)


class _Article(HTMLParser):
    """Title (decoded, and as the page writes it), canonical address and the texts of paragraphs and list items. A page is fed whole."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.title_at: tuple[int, int] | None = None
        self.title_to: tuple[int, int] | None = None
        self.canonical: str | None = None
        self.parts: list[list[str]] = []
        self.open = self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li"):
            self.parts.append([])
            self.open = True
        elif tag == "title":
            self.in_title = self.title is None
            if self.title_at is None:
                line, at = self.getpos()
                begun = self.get_starttag_text().split("\n")
                self.title_at = (line + len(begun) - 1, len(begun[-1]) + at * (len(begun) == 1))
        elif tag == "link" and self.canonical is None:
            said = dict(attrs)
            if "canonical" in (said.get("rel") or "").lower().split():
                self.canonical = said.get("href") or None

    def handle_endtag(self, tag):
        if tag in ("p", "li", "article", "main", "body", "ul", "ol"):
            self.open = False
        elif tag == "title":
            self.in_title = False
            if self.title_at and self.title_to is None:
                self.title_to = self.getpos()

    def title_source(self, page: str) -> str | None:
        """What stands between the first title's tags, character references unread; null without both."""
        if self.title_to is None:
            return None
        (a, lo), (b, hi) = self.title_at, self.title_to
        lines = page.split("\n")[a - 1 : b]
        lines[-1] = lines[-1][:hi]
        lines[0] = lines[0][lo:]
        return "\n".join(lines)

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        elif self.open and self.cdata_elem is None:
            self.parts[-1] += data.split()


_READ = pa.schema([("title", pa.string()), ("title_source", pa.string()), ("canonical", pa.string()), ("article", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for page in b.column(b.num_columns - 1).to_pylist():
            reader = _Article()
            reader.feed(page or "")
            reader.close()
            text = "\n\n".join(" ".join(words) for words in reader.parts if words)
            rows.append((reader.title, reader.title_source(page or ""), reader.canonical, text or page or ""))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)] if rows else [pa.array([], t) for t in _READ.types]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*b.schema.names[:-1], *_READ.names])


def read_html(pages: DataFrame, html: Column) -> DataFrame:
    """pages with title, title_source (the title as written, its character references unread), canonical (address) and article: paragraphs and list items parted by blank lines, or the whole text where there is none. Null pages are empty."""
    held = pages.withColumn("loamline_html", html)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields), "title string, title_source string, canonical string, article string"])
    return held.mapInArrow(_read, schema)


def route(objects: DataFrame, done: DataFrame) -> DataFrame:
    """objects (key, content) that no chunk file stands for yet, with file_hash, mime_ext and format. done: document_id. Two objects of equal content are both there."""
    hashed = objects.withColumn("sha256", F.sha2("content", 256))
    return to_parse(hashed, done).withColumnRenamed("sha256", "file_hash").withColumn("mime_ext", extension(F.col("key"), F.lit(""))).withColumn("format", p.file_format(F.col("key"), F.col("content")))


def parse(objects: DataFrame, done: DataFrame, version: str, at: Column, latest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, manifests) of what is new among raw objects (key, content).

    lines: document_id, value (a JSON line per chunk) of HTML objects, one
    document per content. manifests: key, file_hash, mime_ext, format,
    timestamp, parser_version, saved_chunks, error; what has no parser is there
    with an error. latest: file_hash, original_url of the scraper's manifests.
    """
    new = route(objects, done)
    pages = read_html(new.where("format = 'html'").dropDuplicates(["file_hash"]).select("file_hash", "key", "mime_ext", "content"), decoded(F.col("content"))).drop("content")
    if latest is not None:
        pages = pages.join(latest.select("file_hash", "original_url").dropDuplicates(["file_hash"]), "file_hash", "left")
    else:
        pages = pages.withColumn("original_url", F.lit(None).cast("string"))
    about = pages.select(F.col("file_hash").alias("document_id"), payload.source_url(F.col("original_url"), F.col("canonical"), F.lit(None).cast("string")).alias("source_url"), "original_url", "title", F.lit(None).cast("string").alias("parsed_title"), F.nullif("mime_ext", F.lit("bin")).alias("file_type"), F.col("key").alias("raw_key"))
    chunks = chunking.html_chunks(pages, "file_hash", "article")
    lines = payload.html_payload(chunks.join(about, "document_id"), version, at)
    saved = lines.groupBy(F.col("document_id").alias("file_hash")).agg(F.count(F.lit(1)).alias("saved_chunks"))
    manifests = new.select("key", "file_hash", "mime_ext", "format", at.alias("timestamp"), F.lit(version).alias("parser_version")).join(saved, "file_hash", "left")
    return lines, manifests.withColumn("error", F.when(F.col("format") != "html", F.concat(F.lit("no parser for "), "format")))


def run_stages(stages: list[tuple[str, Callable[[], object]]]) -> int:
    """Stages one after the other, up to the first that fails: 0, or 1 if one did. Each begins and ends with a log line in JSON."""
    for name, stage in stages:
        began = time.monotonic()
        log.info(json.dumps({"event": "stage_start", "stage": name}))
        try:
            stage()
        except Exception as e:  # noqa: BLE001  a stage's failure is this job's result
            log.error(json.dumps({"event": "stage_failed", "stage": name, "error": str(e)[:500], "duration_ms": int(1000 * (time.monotonic() - began))}))
            return 1
        log.info(json.dumps({"event": "stage_complete", "stage": name, "duration_ms": int(1000 * (time.monotonic() - began))}))
    return 0
