"""Vector retrieval for a batch of requests: filtered exact top-k, one passage per text, re-ranking by trust.

Requests are few beside the chunks, so each task holds all of them (their number
is checked) and the k nearest of each as its chunks pass; only those are
exchanged, once per task. No pair of request and chunk is ever a row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.predicates import enough_evidence
from loamline.functions.scalar import similarity, text_key, trust_weight
from loamline.functions.session import checkpoint_dir

RAW_K, FINAL_K = 50, 5
#: Requests that are sent to every task at most; larger batches are answered in turns of this many.
MOST_REQUESTS = 10_000
_KEY = re.compile(r"[A-Za-z0-9_]+")


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v)


def _nearest(requests: list[tuple], not_self: bool):
    """requests: (request_id, vector, filters, own chunk id, k). Each task holds the k nearest of each request as its batches pass, and sends them once."""
    by_length: dict[int, list[int]] = {}
    for r, (_, vector, *_) in enumerate(requests):
        by_length.setdefault(len(vector), []).append(r)
    vectors = {n: np.array([requests[r][1] for r in rows], float) for n, rows in by_length.items()}
    # A filter whose key is no plain word is skipped.
    filters = [{key: v for key, v in (r[2] or {}).items() if _KEY.fullmatch(key)} for r in requests]
    schema = pa.schema([("request_id", pa.string()), ("chunk_id", pa.string()), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, str]]] = [[] for _ in requests]
        least = [np.inf] * len(requests)  # the k-th distance so far

        def cut(r: int) -> None:
            best[r] = sorted(best[r])[: requests[r][4]]
            if len(best[r]) == requests[r][4]:
                least[r] = best[r][-1][0]

        for b in batches:
            lengths = b.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            metas = [json.loads(m) if m else {} for m in b.column("meta").to_pylist()] if any(filters) else None
            every, flat = b.column("chunk_id").to_pylist(), np.asarray(b.column("embedding").flatten(), float)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for n, rows in by_length.items():
                # Vectors of another length are at no distance.
                own = np.flatnonzero(lengths == n)
                if not len(own):
                    continue
                held = flat[(starts[own][:, None] + np.arange(n)).ravel()].reshape(len(own), n)
                for r, vector in zip(rows, vectors[n]):
                    d = np.sqrt(((held - vector) ** 2).sum(1))
                    for i in np.flatnonzero(d <= least[r]).tolist():
                        at = own[i]
                        if filters[r] and not all(_text(metas[at].get(key)) == v and v is not None for key, v in filters[r].items()):
                            continue
                        if not_self and every[at] == requests[r][3]:
                            continue
                        best[r].append((float(d[i]), every[at]))
                    if len(best[r]) > 2 * requests[r][4]:
                        cut(r)
        for r in range(len(requests)):
            cut(r)
        for lo in range(0, len(requests), 1000):
            rows = [(requests[r][0], c, d) for r in range(lo, min(lo + 1000, len(requests))) for d, c in best[r]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def top_k(requests: DataFrame, chunks: DataFrame, k: int = RAW_K, not_self: bool = False) -> DataFrame:
    """(request_id, chunk_id, distance, place): the k nearest chunks of each request by L2 distance, ties by chunk_id.

    requests: request_id, embedding and optionally filters (map<string,string>,
    all of which a chunk's meta must equal; an absent key excludes the chunk),
    chunk_id (left out of its own result with not_self) and raw_k (a request's
    own k, null for k). chunks: chunk_id, embedding, meta (JSON text). A request
    without a vector and a chunk without one or with one of another length have
    no place in the result.
    """
    has = lambda c, kind: F.col(c) if c in requests.columns else F.lit(None).cast(kind).alias(c)
    rows = requests.where("embedding is not null").select(F.col("request_id").cast("string"), "embedding", has("filters", "map<string,string>"), has("chunk_id", "string"), F.coalesce(has("raw_k", "int"), F.lit(k)).alias("k"))
    turns = max(1, -(-rows.count() // MOST_REQUESTS))
    found = requests.sparkSession.createDataFrame([], "request_id string, chunk_id string, distance double, place int")
    for turn in range(turns):
        part = rows if turns == 1 else rows.where(F.pmod(F.xxhash64("request_id"), F.lit(turns)) == turn)
        held = [(r[0], list(r[1]), r[2], r[3], r[4]) for r in part.collect()]  # some MOST_REQUESTS
        if not held:
            continue
        near = chunks.where("embedding is not null").select("chunk_id", "embedding", "meta").mapInArrow(_nearest(held, not_self), "request_id string, chunk_id string, distance double")
        order = Window.partitionBy("request_id").orderBy("distance", "chunk_id")
        near = near.withColumn("place", F.row_number().over(order))
        near = near.where(F.col("place") <= k) if "raw_k" not in requests.columns else near.join(part.select("request_id", "k"), "request_id").where("place <= k").drop("k")
        if turns == 1:
            return near
        # A turn's requests are gone from the driver before the next one's come.
        checkpoint_dir(requests.sparkSession)
        found = found.union(near.checkpoint())
    return found


def metadata_filter(rows: DataFrame, json_col: str, wanted: dict[str, str]) -> DataFrame:
    """Rows whose JSON object has all these values; an absent key excludes the row, a key that is no plain word is skipped."""
    meta = F.expr(f"try_parse_json({json_col})")
    for key in sorted(wanted):
        if _KEY.fullmatch(key):
            rows = rows.where(F.try_variant_get(meta, f"$.{key}", "string") == wanted[key])
    return rows


def one_per_text(candidates: DataFrame, compose: bool = True) -> DataFrame:
    """Of a request's candidates with equal texts, the nearest. Texts count by text_key, which is made where it is missing."""
    keyed = candidates if "text_key" in candidates.columns else candidates.withColumn("text_key", text_key(F.col("text"), compose))
    order = Window.partitionBy("request_id", "text_key").orderBy("distance", "chunk_id")
    return keyed.withColumn("copy", F.row_number().over(order)).where("copy = 1").drop("copy")


def rerank(candidates: DataFrame, k: int = FINAL_K) -> DataFrame:
    """The k best by similarity times trust, numbered from 1. candidates: request_id, chunk_id, distance, meta, and optionally top_k (a request's own k, null for k)."""
    scored = candidates.withColumn("similarity", similarity(F.col("distance"))).withColumn("trust_weight", trust_weight(F.get_json_object("meta", "$.trust_level"), F.get_json_object("meta", "$.trust")))
    scored = scored.withColumn("final_score", F.col("similarity") * F.col("trust_weight"))
    order = Window.partitionBy("request_id").orderBy(F.desc("final_score"), F.desc("similarity"), "chunk_id")
    most = F.coalesce("top_k", F.lit(k)) if "top_k" in candidates.columns else F.lit(k)
    return scored.withColumn("number", F.row_number().over(order)).where(F.col("number") <= most)


def retrieve(requests: DataFrame, chunks: DataFrame, raw_k: int = RAW_K, final_k: int = FINAL_K, not_self: bool = False, compose: bool = True) -> DataFrame:
    """Numbered passages of each request: top-k first, then one per text, then re-ranking; so fewer than final_k may remain. Texts are looked up, and their keys made, for the candidates alone; a null text or meta of theirs is empty."""
    near = top_k(requests, chunks, raw_k, not_self)
    if "top_k" in requests.columns:
        near = near.join(requests.select(F.col("request_id").cast("string").alias("request_id"), "top_k"), "request_id")
    about = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("meta", F.lit("{}")).alias("meta"), "source_url")
    return rerank(one_per_text(near.join(about, "chunk_id"), compose), final_k)


def passages(ranked: DataFrame) -> DataFrame:
    """A row per request: its passages in order, the greatest score, and whether they are evidence enough."""
    fields = F.struct("number", "chunk_id", "text", "source_url", "meta", F.col("final_score").alias("score"))
    out = ranked.groupBy("request_id").agg(F.array_sort(F.collect_list(fields)).alias("passages"), F.max("final_score").alias("top_similarity"))
    return out.withColumn("enough", enough_evidence(F.size("passages"), F.col("top_similarity")))
