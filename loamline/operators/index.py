"""Chunk records into a vector table: normalise, leave out what is stored, embed, append."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = ("document_id", "chunk_id", "chunk_index", "text", "parser_version")
TABLE = "document_id string, chunk_id string, chunk_index int, content string, source_url string, page_number int, parser_version string, meta string, embedding array<float>"


def normalise(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """raw: one JSON object per row. Gives the table's columns and `fault`: malformed, missing_field, cast_failed or null. A field that is present but null counts as present; a null text is empty. meta holds every other field as it came."""
    v = F.expr(f"try_parse_json({json_col})")
    out = raw.withColumn("v", v).withColumn("fields", F.from_json(json_col, "map<string,string>"))
    keys = F.map_keys("fields")
    malformed = F.col("v").isNull() | F.col("fields").isNull()
    missing = F.lit(False)
    for k in REQUIRED:
        missing = missing | ~F.array_contains(keys, k)
    field = lambda k, t="string": F.try_variant_get("v", f"$.{k}", t)
    number = F.expr("try_cast(fields['chunk_index'] AS int)")
    fault = F.when(malformed, "malformed").when(missing, "missing_field").when(number.isNull(), "cast_failed")
    content = F.regexp_replace(F.regexp_replace(F.coalesce(field("text"), F.lit("")), "\r\n", "\n"), r"(?U)^\s+|\s+$", "")
    meta = F.to_json(F.map_filter(F.from_json(json_col, "map<string,variant>"), lambda k, _: ~k.isin(*REQUIRED)))
    return out.select(field("document_id").alias("document_id"), field("chunk_id").alias("chunk_id"), number.alias("chunk_index"), content.alias("content"), field("source_url").alias("source_url"), F.expr("try_cast(fields['page_number'] AS int)").alias("page_number"), field("parser_version").alias("parser_version"), meta.alias("meta"), fault.alias("fault"))


def hash_embedding(dim: int = 64) -> Callable[[Column], Column]:
    """A deterministic stand-in for an embedding model: signed hashed words, of unit length. Fails on a wrong dimension as a model's client would."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dim, np.float32)
                for w in (t or "").lower().split():
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                    v[h % dim] += 1 if h >> 63 else -1
                n = float(np.linalg.norm(v))
                out.append((v / n if n else v).tolist())
            yield pd.Series(out)

    return embed


def first_per_id(rows: DataFrame) -> DataFrame:
    """Of rows that share a chunk_id, one: a fixed choice, by document and text."""
    order = Window.partitionBy("chunk_id").orderBy("document_id", "chunk_index", "content", "meta")
    return rows.withColumn("copy", F.row_number().over(order)).where("copy = 1").drop("copy")


def unseen(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose chunk_id isn't stored yet; only ids are read of what is."""
    return rows.join(stored.select("chunk_id"), "chunk_id", "left_anti")


def append_unseen(rows: DataFrame, path: str, embed: Callable[[Column], Column] | None = None) -> int:
    """Insert-if-absent into the Parquet table at path: how many rows were attempted. The first writer of an id wins, and a second run adds nothing. One writer at a time."""
    spark = rows.sparkSession
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
    new = first_per_id(rows.where("fault is null").drop("fault"))
    attempted = new.count()
    if there:
        new = unseen(new, spark.read.schema(TABLE).parquet(path))
    # The model sees only what is new.
    new = new.withColumn("embedding", (embed or hash_embedding())(F.col("content")))
    new.select(*(c.split()[0] for c in TABLE.split(", "))).write.mode("append").parquet(path)
    return attempted


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("fault").isNull()).alias("indexed"), F.count_if(F.col("fault").isNotNull()).alias("skipped"), F.count_if(F.col("fault") == "missing_field").alias("skipped_schema"))


def document_totals(chunks: DataFrame, document: str, tokens: str, number: str) -> DataFrame:
    """(document, document_total_tokens, chunk_count, last_number) of chunks or pages."""
    return chunks.groupBy(document).agg(F.sum(tokens).alias("document_total_tokens"), F.count(F.lit(1)).alias("chunk_count"), F.max(number).alias("last_number"))


def index_lines(lines: DataFrame, path: str, embed: Callable[[Column], Column] | None = None) -> dict[str, int]:
    """Chunk lines (value) into the table at path: what was indexed and what was skipped, and the exit code of a job that does so (50 if any line lacked a required field)."""
    rows = normalise(lines)
    counts = totals(rows).first()
    attempted = append_unseen(rows, path, embed)
    return {"seen": counts["seen"], "indexed": attempted, "skipped": counts["skipped"], "skipped_schema": counts["skipped_schema"], "exit_code": 50 if counts["skipped_schema"] else 0}


def ensure_table(spark: SparkSession, name: str) -> None:
    """The vector table in the catalog, if it isn't there yet. Parquet has no indexes: ids and sources prune by their statistics."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({TABLE}) USING parquet")


def table_ready(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def observed(rows: DataFrame, name: str = "index") -> tuple[DataFrame, Observation]:
    """rows, counted as they pass: the counts are there once an action has run, at no further pass."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("seen"), F.count_if(F.col("fault").isNull()).alias("indexed"), F.count_if(F.col("fault").isNotNull()).alias("skipped")), seen
