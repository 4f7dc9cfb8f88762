"""A factorisation machine for text quality.

Its inputs are hashed words, binned structure statistics and binned metadata
(the table's own character count). Every pair of inputs interacts through the
product of their low-rank vectors, and since
sum over pairs <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
a text is scored in time linear in its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.labelled import SAMPLE_ROWS, fold, sample

#: Word buckets, factors, bins per statistic.
BUCKETS, RANK, BINS = 1 << 15, 8, 8
EPOCHS, RATE, RIDGE = 12, 0.05, 2e-4

_CLASSES = np.zeros((256, 8), bool)
_CLASSES[65:91, 0] = True  # capitals
_CLASSES[48:58, 1] = True  # digits
_CLASSES[[33, 63], 2] = True  # ! ?
_CLASSES[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 123, 125, 126], 3] = True  # symbols
_CLASSES[124, 4] = True  # |
_CLASSES[[44, 46, 58, 59], 5] = True  # , . : ;
_CLASSES[10, 6] = True  # line ends
_CLASSES[128:, 7] = True  # beyond ASCII


def statistics(raw: bytes, words: list[bytes], n_chars: int | None) -> np.ndarray:
    """Shares of character classes, repetition of words and lines, lengths, and the table's character count (null: -1)."""
    n = max(1, len(raw))
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / n
    lines = raw.split(b"\n")
    w = max(1, len(words))
    return np.array([*shares, len(set(words)) / w, len(set(lines)) / len(lines), np.log1p(len(words)), len(raw) / w, np.log1p(len(lines)), len(words) / len(lines), np.log1p(n_chars) if n_chars is not None and n_chars >= 0 else -1.0])


N_STATS = 15


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = b = zlib.crc32(word) % BUCKETS
        return b


@dataclass
class QualityModel:
    edges: np.ndarray  # N_STATS x (BINS - 1)
    bias: float
    w: np.ndarray
    v: np.ndarray

    def inputs(self, texts: list[str], n_chars: list[int | None], buckets: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for text, n in zip(texts, n_chars):
            raw = text.encode()
            words = raw.lower().split()
            stats = (self.edges < statistics(raw, words, n)[:, None]).sum(1) + BUCKETS + BINS * np.arange(N_STATS)
            ids, count = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), return_counts=True)
            value = np.sqrt(count)
            norm = np.sqrt((value**2).sum()) or 1.0
            yield np.concatenate([ids, stats]), np.concatenate([value / norm, np.full(N_STATS, N_STATS**-0.5)])

    def raw_score(self, i: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        v = self.v[i]
        s = x @ v
        return self.bias + self.w[i] @ x + 0.5 * float((s**2).sum() - (x**2) @ (v**2).sum(1)), s

    def scores(self, texts: list[str], n_chars: list[int | None], buckets: dict) -> list[float]:
        return [1 / (1 + np.exp(-np.clip(self.raw_score(i, x)[0], -30, 30))) for i, x in self.inputs(texts, n_chars, buckets)]


def fit(rows: list[tuple], seed: int = 1) -> QualityModel:
    """rows: (text, quality, n_chars). Adagrad on the logistic loss. Without rows every score is 0.5; with rows of one kind the scores lean to it."""
    size = BUCKETS + BINS * N_STATS
    rng = np.random.default_rng(seed)
    stats = np.array([statistics(t.encode(), t.encode().lower().split(), n) for t, _, n in rows]).reshape(-1, N_STATS)
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if len(rows) else np.zeros((N_STATS, BINS - 1))
    y = np.array([q for _, q, _ in rows], float)
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m = QualityModel(edges, bias, np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    inputs = list(m.inputs([r[0] for r in rows], [r[2] for r in rows], _Buckets()))
    gw, gv, gb = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            i, x = inputs[k]
            score, s = m.raw_score(i, x)
            g = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[k]
            v, w = m.v[i], m.w[i]
            dw = g * x + RIDGE * w
            dv = g * (x[:, None] * s - v * (x**2)[:, None]) + RIDGE * v
            gw[i] += dw**2
            gv[i] += dv**2
            gb += g * g
            m.w[i] = w - RATE * 2 * dw / np.sqrt(gw[i])
            m.v[i] = v - RATE * dv / np.sqrt(gv[i])
            m.bias -= RATE * g / np.sqrt(gb)
    return m


def _scored(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, buckets = QualityModel(*model.value), _Buckets()
        for b in batches:
            scores = m.scores(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), buckets)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Learns from at most sample_rows rows of labels (doc_id, quality) that are
    not held out; inputs of a score are the text and n_chars. Null texts count
    as empty, and an empty text has its statistics alone; a null n_chars is a
    value of its own, and a table without that column has nulls there. Repeated
    rows get equal scores; an empty table gives no rows. Other columns are
    ignored.
    """
    if "n_chars" not in docs.columns:
        docs = docs.withColumn("n_chars", F.lit(None).cast("long"))
    fitted = fit(sample(docs, labels, "quality", sample_rows, ("n_chars",)))
    # Plain arrays of fixed size, (BUCKETS + bins) x (RANK + 1) numbers: executors need no class of ours to read them.
    model = docs.sparkSession.sparkContext.broadcast((fitted.edges, fitted.bias, fitted.w, fitted.v))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"), F.col("n_chars").cast("long").alias("n_chars"))
    return src.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
