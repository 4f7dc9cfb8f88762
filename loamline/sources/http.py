"""A batch source that fetches addresses: spark.read.format("loamline_http")."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, final_url string, status int, etag string, last_modified string, content_type string, content binary, error string"


class _Part(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class HttpReader(DataSourceReader):
    """Options: urls (a JSON list), partitions (6), timeout (20 s), max_bytes (250 MB), attempts (2), seconds (after which a task fetches no more; none), method (GET; HEAD falls back to the first 1024 bytes)."""

    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options.get("urls", "[]"))
        self.n = int(options.get("partitions", 6))
        self.timeout = float(options.get("timeout", 20))
        self.max_bytes = int(options.get("max_bytes", 250 << 20))
        self.attempts = int(options.get("attempts", 2))
        self.seconds = float(options.get("seconds", "inf"))
        self.method = options.get("method", "GET").upper()

    def partitions(self) -> list[_Part]:
        return [_Part(self.urls[i :: self.n]) for i in range(min(self.n, len(self.urls)))]

    def _fetch(self, url: str) -> tuple:
        why = None
        for attempt in range(self.attempts):
            plans = [(self.method, {})] + ([("GET", {"Range": "bytes=0-1023"})] if self.method == "HEAD" else [])
            for method, headers in plans:
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, method=method, headers=headers), timeout=self.timeout) as r:
                        body = b"" if self.method == "HEAD" else r.read(self.max_bytes + 1)
                        if len(body) > self.max_bytes:
                            return url, r.url, r.status, None, None, None, None, "too large"
                        return url, r.url, r.status, r.headers.get("ETag"), r.headers.get("Last-Modified"), r.headers.get("Content-Type"), body, None
                except urllib.error.HTTPError as e:
                    why = (url, url, e.code, None, None, None, None, str(e))
                except OSError as e:
                    why = (url, url, None, None, None, None, None, str(e))
            time.sleep(min(60, 0.5 * 2**attempt) * random.uniform(0.8, 1.2))
        return why

    def read(self, partition: _Part) -> Iterator[tuple]:
        began = time.monotonic()
        for url in partition.urls:
            if time.monotonic() - began > self.seconds:
                yield url, url, None, None, None, None, None, "out of time"
            else:
                yield self._fetch(url)


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loamline_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HttpReader:
        return HttpReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSource)
