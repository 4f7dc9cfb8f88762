"""Incremental indexing as a stream: what is new is indexed once, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession

from loamline.operators.index import append_unseen, normalise


def index_new_files(spark: SparkSession, source: str, table: str, checkpoint: str, embed: Callable[[Column], Column] | None = None, glob: str = "*.chunks.jsonl") -> None:
    """Read chunk files that the checkpoint hasn't seen, append unseen chunks, and stop. The table itself is the state: with a lost checkpoint all files are read again and no row is added twice."""
    lines = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(source)

    def index(batch, _: int) -> None:
        append_unseen(normalise(batch), table, embed)

    lines.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
