"""Raw objects, manifests and chunk files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions.scalar import decoded, safe_rel

MANIFEST = "file_hash string, mime_ext string, original_url string, remote_etag string, remote_lastmod string, scraper_version string, size_bytes long, storage_url string, timestamp string, parser_version string, pipeline_run_id string, s3_key string, local_path string, saved_chunks int, error string, traceback string, chunked struct<chunk_file string, chunk_format string, schema_version string, parser_version string, ingest_time string, chunk_count int, chunked_sha256 string, chunked_size_bytes long>"


def raw_objects(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime, content of every file that isn't a manifest. The content is read only where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(~F.col("path").endswith(".manifest.json"))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with the key of the file they stand beside; what can't be parsed has null fields."""
    read = spark.read.schema(MANIFEST + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", "*.manifest.json").json(path)
    return read.withColumn("raw_key", F.regexp_replace(F.input_file_name(), r"\.manifest\.json$", ""))


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the non-blank lines of all chunk files, as UTF-8 or else Latin-1."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.chunks.jsonl").text(path)
    return lines.select(decoded(F.col("value").cast("binary")).alias("value")).where(F.trim("value") != "")


def with_manifest(objects: DataFrame, found: DataFrame) -> DataFrame:
    return objects.join(found, objects["path"] == found["raw_key"], "left")


def write_chunk_files(chunks: DataFrame, path: str, files: int | None = None) -> None:
    """Chunk records as JSON lines in sorted keys; the committer makes them appear at once. A document's lines are together in one file, in order; files: how many there are at most (the session's shuffle partitions), as a file per document would be too many."""
    fields = sorted(c for c in chunks.columns)
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
    n = files or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.select("document_id", "chunk_id", line.alias("value")).repartition(n, "document_id").sortWithinPartitions("document_id", "chunk_id")
    dealt.select("value").write.mode("append").text(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(rel, size, modified) of every file below a path; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = re.escape(path.rstrip("/").removeprefix("file://").rstrip("/"))
    rel = F.regexp_replace("path", rf"^(?:[a-z0-9]+:/*(?=/))?{root}/", "")
    return found.select(safe_rel(rel).alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def put_unseen(objects: DataFrame, path: str) -> int:
    """Content-addressed store: objects (source_id, ext, content) whose digest isn't there yet are appended as Parquet."""
    spark = objects.sparkSession
    keyed = objects.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        keyed = keyed.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    keyed = keyed.select("source_id", "ext", "content", "sha256").cache()
    n = keyed.count()
    if n:
        keyed.write.mode("append").parquet(path)
    keyed.unpersist()
    return n
