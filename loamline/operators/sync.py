"""Plans for mirroring one file tree to another, and for what is to be parsed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.predicates import transfer


def mirror(local: DataFrame, remote: DataFrame, delete_orphans: bool = False) -> DataFrame:
    """A row per relative path: rel, action (upload, skip, delete, keep), reason.

    local: rel, sha256, md5, size. remote: rel, sha256, content_md5, etag, size.
    """
    a = local.select("rel", F.struct("sha256", "md5", "size").alias("here"))
    b = remote.select("rel", F.struct("sha256", "content_md5", "etag", "size").alias("there"))
    both = a.join(b, "rel", "full_outer")
    reason = F.when(F.col("here").isNull(), "local_missing").otherwise(transfer(F.col("there"), F.col("here.sha256"), F.col("here.md5"), F.col("here.size")))
    both = both.withColumn("reason", reason)
    action = F.when(F.col("here").isNull(), "delete" if delete_orphans else "keep").when(F.col("reason").startswith("match_"), "skip").otherwise("upload")
    return both.select("rel", action.alias("action"), "reason")


def stale(there: DataFrame, here: DataFrame, key: str = "rel") -> DataFrame:
    """The keys of one side that the other lacks, each once."""
    return there.select(key).distinct().join(here.select(key), key, "left_anti")


def _copied(source: str, target: str, dry_run: bool):
    import pyarrow.fs as pafs

    schema = pa.schema([("rel", pa.string()), ("action", pa.string()), ("done", pa.bool_()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, at), (b, to) = pafs.FileSystem.from_uri(source), pafs.FileSystem.from_uri(target)
        for batch in batches:
            out = []
            for rel, action in zip(batch.column("rel").to_pylist(), batch.column("action").to_pylist()):
                error = None
                if not dry_run:
                    try:
                        if action == "delete":
                            b.delete_file(f"{to}/{rel}")
                        else:
                            b.create_dir(f"{to}/{rel}".rsplit("/", 1)[0], recursive=True)
                            with a.open_input_stream(f"{at}/{rel}") as read, b.open_output_stream(f"{to}/{rel}") as write:
                                while piece := read.read(8 << 20):
                                    write.write(piece)
                    except OSError as e:  # one file's failure is its row's
                        error = str(e)
                out.append((rel, action, not dry_run and error is None, error))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def carry_out(plan: DataFrame, source: str, target: str, dry_run: bool = False) -> DataFrame:
    """(rel, action, done, error) for each upload and delete of a mirror() plan, copied by the tasks from one file system (URI) to the other. Nothing happens before the result is read; a task that runs again does the same again. dry_run: nothing is touched."""
    todo = plan.where(F.col("action").isin("upload", "delete")).select("rel", "action")
    return todo.mapInArrow(_copied(source, target, dry_run), "rel string, action string, done boolean, error string")


def digests(content: Column) -> list[Column]:
    return [F.sha2(content, 256).alias("sha256"), F.md5(content).alias("md5"), F.octet_length(content).cast("long").alias("size")]


def to_parse(raw: DataFrame, chunked: DataFrame) -> DataFrame:
    """Raw files (with sha256) that no chunk file stands for yet."""
    return raw.join(chunked.select(F.col("document_id").alias("sha256")), "sha256", "left_anti")
