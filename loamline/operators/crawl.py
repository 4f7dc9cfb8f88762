"""Links of pages, and a crawl frontier that advances one depth per step."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions import predicates as p
from loamline.functions.scalar import canonical_url, decoded
from loamline.functions.session import checkpoint_dir

# Quoted addresses of documents and of data, by how they begin, their length and their ending.
_DOCUMENT_URL = re.compile(r"""["']((?:/|https?://)[^"'\s]{6,400}\.(?:pdf|PDF|doc|docx|xls|xlsx|csv|zip))["']""")
_API_URL = re.compile(r"""["']((?:/|https?://)[^"'\s]{10,300}\.json(?:\?[^\s"']*)?)["']""", re.I)
MAX_LINKS, MAX_DEPTH = 400, 2
_ORIGIN = "^([a-z][a-z0-9+.-]*://[^/?#]*)"


class _Reader(HTMLParser):
    """Links with their texts, and the words a reader sees."""

    # Elements whose text is not read.
    SILENT = ("script", "style", "noscript", "iframe")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[list] = []
        self.words: list[str] = []
        self.silent, self.open = 0, None

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag == "a":
            attrs = dict(attrs)
            if attrs.get("href"):
                self.open = [attrs["href"], []]
                self.links.append(self.open)
        elif tag in ("area", "link"):
            attrs = dict(attrs)
            if where := attrs.get("href") or attrs.get("src"):
                self.links.append([where, []])

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "a":
            self.open = None

    def handle_data(self, data):
        if not self.silent:
            words = data.split()
            self.words += words
            if self.open is not None:
                self.open[1] += words


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("n_words", pa.int64()), ("n_links", pa.int64()), ("links", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))), ("harvested", pa.list_(pa.string()))])
    for b in batches:
        rows = []
        for page_id, url, page in zip(*(c.to_pylist() for c in b.columns)):
            reader = _Reader()
            reader.feed(page or "")
            reader.close()
            links = [{"href": urljoin(url or "", href), "text": " ".join(words)} for href, words in reader.links]
            found = [urljoin(url or "", m) for pattern in (_API_URL, _DOCUMENT_URL) for m in pattern.findall(page or "")]
            rows.append((page_id, len(reader.words), len(links), links, found))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, n_words, n_links, links (href, text; absolute), harvested (document and data addresses anywhere in the page)."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_read, "page_id long, n_words long, n_links long, links array<struct<href:string,text:string>>, harvested array<string>")


def link_density(pages: DataFrame) -> DataFrame:
    """Links per word; without words infinite if there are links, else 0."""
    by_words = F.when(F.col("n_words") > 0, F.col("n_links") / F.col("n_words")).when(F.col("n_links") > 0, F.lit(float("inf"))).otherwise(0.0)
    return pages.withColumn("link_density", by_words)


def candidates(pages: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, url, prioritized): links worth fetching: documents, topical anchors, and harvested addresses."""
    read = read_pages(pages)
    anchors = read.select("page_id", F.explode(F.slice("links", 1, MAX_LINKS)).alias("link")).select("page_id", "link.href", "link.text")
    anchors = anchors.where(p.allowed_domain(F.col("href"), allowed) & (p.implies_document(F.col("href"), F.col("text")) | p.topical(F.col("text"))))
    every = anchors.select("page_id", canonical_url(F.col("href")).alias("url")).union(read.select("page_id", F.explode("harvested")))
    return every.select("page_id", "url", p.prioritized(F.col("url")).alias("prioritized"))


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(url, depth) of what is reached from seeds (url) over edges (src, dst, prioritized): breadth first, each URL once. Beyond max_depth only prioritized links are followed; a step is one join and one anti join, and ends its lineage at a checkpoint."""
    checkpoint_dir(edges.sparkSession)
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    depth = 0
    while True:
        depth += 1
        follow = edges if depth <= max_depth else edges.where("prioritized")
        found = frontier.select(F.col("url").alias("src")).join(follow, "src").select(F.col("dst").alias("url")).distinct()
        new = found.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if new.isEmpty():
            return seen
        seen, frontier = seen.union(new), new


def crawl_pages(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], allowed: tuple[str, ...] = (), max_depth: int = MAX_DEPTH) -> DataFrame:
    """(url, depth, sha256) of pages fetched from seeds (url) on: fetch, read, follow, one depth a step.

    fetch: from (url, prioritized), documents first, to (url, html) of those that
    could be fetched. Each canonical address is fetched once; of equal contents
    the first by depth and address counts. Beyond max_depth only prioritized
    links are followed. A step's rows are checkpointed.
    """
    spark = seeds.sparkSession
    checkpoint_dir(spark)
    frontier = seeds.select(canonical_url(F.col("url")).alias("url")).where(p.allowed_domain(F.col("url"), allowed)).distinct().withColumn("prioritized", F.lit(True))
    seen = frontier.select("url").checkpoint()
    out = None
    depth = 0
    while True:
        pages = fetch(frontier.orderBy(F.desc("prioritized"), "url")).withColumn("page_id", F.xxhash64("url")).checkpoint()
        got = pages.select("url", F.lit(depth).alias("depth"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"))
        out = got if out is None else out.union(got)
        found = candidates(pages.select("page_id", "url", "html"), allowed).select(canonical_url(F.col("url")).alias("url"), "prioritized")
        found = found.where(p.allowed_domain(F.col("url"), allowed)).groupBy("url").agg(F.max("prioritized").alias("prioritized"))
        depth += 1
        if depth > max_depth:
            found = found.where("prioritized")
        frontier = found.join(seen, "url", "left_anti").checkpoint()
        if frontier.isEmpty():
            order = Window.partitionBy("sha256").orderBy("depth", "url")
            return out.withColumn("copy", F.row_number().over(order)).where("copy = 1").drop("copy")
        seen = seen.union(frontier.select("url"))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One row: how many canonical addresses and how many contents pages (url, html) have."""
    return pages.agg(F.count_distinct(canonical_url(F.col("url"))).alias("urls"), F.count_distinct(F.sha2("html", 256)).alias("contents"))


def status_counts(fetches: DataFrame, status: str = "status") -> DataFrame:
    """Rows per status."""
    return fetches.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def robots_files(urls: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(origin, status, body) of the robots file of each origin among urls (url), fetched once. fetch: from (url) to (url, status, content)."""
    origins = urls.select(F.regexp_extract(F.lower("url"), _ORIGIN, 1).alias("origin")).where("origin <> ''").distinct()
    got = fetch(origins.select(F.concat("origin", F.lit("/robots.txt")).alias("url")))
    return got.select(F.regexp_extract("url", _ORIGIN, 1).alias("origin"), "status", decoded(F.col("content").cast("binary")).alias("body"))


def robots_allow(urls: DataFrame, robots: DataFrame, agent: str, default_delay: float = 1.0) -> DataFrame:
    """urls with allowed and crawl_delay, by the robots file of their origin. robots: origin, status, body; without one, or with a status other than 200, all is allowed. Each task parses a file once."""
    from urllib.robotparser import RobotFileParser

    from pyspark.sql import types as T

    origin = F.regexp_extract(F.lower("url"), _ORIGIN, 1)
    both = urls.withColumn("origin", origin).join(robots.select("origin", "status", "body"), "origin", "left")

    @F.pandas_udf(T.StructType([T.StructField("allowed", T.BooleanType()), T.StructField("crawl_delay", T.DoubleType())]))
    def check(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        parsers: dict = {}
        for url, status, body in batches:
            rows = []
            for u, s, b in zip(url, status, body):
                if s != 200 or not b:
                    rows.append((True, default_delay))
                    continue
                if b not in parsers:
                    parsers[b] = RobotFileParser()
                    parsers[b].parse(b.splitlines())
                delay = parsers[b].crawl_delay(agent)
                rows.append((parsers[b].can_fetch(agent, u), float(delay) if delay is not None else default_delay))
            yield pd.DataFrame(rows, columns=["allowed", "crawl_delay"])

    return both.withColumn("said", check("url", "status", "body")).select(*urls.columns, "said.allowed", "said.crawl_delay")
