"""What the trained classifiers share: a bounded labelled sample, folds, and a small logistic regression."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most.
SAMPLE_ROWS = 6000
#: Bytes of their texts, at most.
SAMPLE_BYTES = 64 << 20


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 marks the rows held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label_col: str, n: int = SAMPLE_ROWS, extra: tuple[str, ...] = (), most_bytes: int = SAMPLE_BYTES) -> list[tuple]:
    """(text, label, *extra) of at most n labelled rows that are not held out, with texts of at most most_bytes in all, drawn by the hash of their id; the driver holds these rows and no others. Null labels and ids are left out; null texts are empty."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    chosen = chosen.where(fold(F.col("doc_id")) != 1).orderBy(F.xxhash64("doc_id"), "label").limit(n)
    # At most n rows of two numbers each; those of most_bytes are told apart by their sizes before any text is read to the driver.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra).join(F.broadcast(chosen), "doc_id")
    sizes = rows.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("h")).limit(n).collect()
    ids, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        total += r["size"]
        if total > most_bytes:
            break
        ids.append((r["doc_id"],))
    if len(ids) < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(sorted(set(ids)), "doc_id long")), "doc_id", "left_semi")
    rows = rows.limit(n).collect()
    return [(r["text"], r["label"], *(r[c] for c in extra)) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"], r["label"]))]


class Logistic:
    """Ridge-penalised logistic regression on standardised columns, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        penalty = ridge * np.eye(z.shape[1])
        penalty[-1, -1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.w[:-1] + self.w[-1], -30, 30)))
