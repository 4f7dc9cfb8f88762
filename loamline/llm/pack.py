"""Vector best-fit packing of tokenised documents into sequences.

A sequence has three residual capacities: tokens, documents and attention cost
(the sum of squared lengths, as attention never leaves a document). Pieces come
in order of falling length; each goes to the open sequence that can take it
under all three constraints and scores best: by the least norm of the residual
left behind, or by the greatest weighted dot product of demand and residual.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import lean, stored
from loamline.llm.tokens import ChunkEncoder


@dataclass(frozen=True)
class Capacity:
    """Of one sequence. The default document and attention capacities never bind before the tokens do."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    #: Weights of the three dimensions in either score.
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    #: "norm" (least residual norm) or "dot" (greatest weighted dot product).
    rule: str = "norm"


#: Pieces that one task packs together, and the share of its tokens from which on a sequence counts as filled: pieces of the others are dealt and packed anew.
GROUP, FILLED = 8_192, 0.99


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, the sequences numbered from 0. A piece that alone exceeds a capacity other than tokens gets a sequence of its own. Ties go to a fixed one of the sequences that tie; equal lengths keep their order."""
    n = len(lengths)
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    w = np.array(cap.weights) / (full if cap.rule == "norm" else full**2)
    order = np.argsort(-lengths, kind="stable")
    shortest = int(lengths[order[-1]]) if n else 0
    room = np.empty((3, max(n, 1)))  # residuals of the open sequences, the first `k` columns
    ids = np.empty(max(n, 1), np.int64)
    k = made = 0
    seq, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in order:
        size = int(lengths[i])
        need = np.array([size, 1.0, float(size) ** 2])
        at = -1
        if k:
            left = room[:, :k] - need[:, None]
            fits = (left >= 0).all(0)
            if cap.rule == "norm":
                score = ((left * w[:, None]) ** 2).sum(0)
            else:
                score = -(room[:, :k] * (need * w)[:, None]).sum(0)
            score[~fits] = np.inf
            at = int(score.argmin())
            if not fits[at]:
                at = -1
        if at < 0:
            room[:, k], ids[k], at = full, made, k
            k, made = k + 1, made + 1
        seq[i], offset[i] = ids[at], cap.tokens - room[0, at]
        room[:, at] -= need
        if room[0, at] < max(shortest, 1) or room[1, at] < 1 or room[2, at] < shortest**2:  # closed
            k -= 1
            room[:, at], ids[at] = room[:, k], ids[k]
    return seq, offset


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(tokenizer_path: str, end_id: int, limit: int, keep_ids: bool) -> Callable:
    schema = _PIECES_ARROW.append(pa.field("ids", pa.list_(pa.int32()))) if keep_ids else _PIECES_ARROW

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer_path)
        end = np.asarray([end_id], "<u4").tobytes()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for b in batches:
            rows, size = [], 0
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.texts(b.column(1).to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if keep_ids else [])))
                    size += len(part) * keep_ids
                if size > 16 << 20:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    return pieces


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, limit: int = 4096, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A document's ids followed by end_id; only longer ones are cut, into pieces of limit tokens, the last one shorter: doc_id, piece, start, length, ids_crc32, and with keep_ids the ids. A null text counts as empty and gives one piece of length 1."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(lean(_cut(tokenizer_path, end_id, limit, keep_ids)), _PIECES + (", ids array<int>" if keep_ids else ""))


def _dealt(rows: DataFrame, groups: int, level: int, cap: Capacity) -> DataFrame:
    """(row, length, sequence_id, offset, filled) of rows (row, length): dealt by hash over groups, each packed by itself."""
    dealt = rows.select("row", "length", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).cast("int").alias("group"))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", kind="stable")
        seq, offset = best_fit(rows["length"].to_numpy(), cap)
        used = np.bincount(seq, rows["length"])
        return pd.DataFrame({"row": rows["row"], "length": rows["length"], "sequence_id": (level << 52) + (int(key[0]) << 24) + seq, "offset": offset, "filled": used[seq] >= FILLED * cap.tokens})

    return stored(dealt.groupBy("group").applyInPandas(place, "row long, length long, sequence_id long, offset long, filled boolean"), "places")


def pack(pieces: DataFrame, cap: Capacity = Capacity(), group: int = GROUP) -> DataFrame:
    """pieces (row, length and others) with sequence_id and offset; row must be unique and pieces a stored table.

    Pieces are dealt at random over groups of about `group`, so a group's size
    follows neither ids nor lengths, and each group is packed by itself. The few
    sequences that a group doesn't fill are opened again, and their pieces packed
    together with those of other groups, until one group holds them all or none
    goes away. Every row gets a place, repeated rows included; an empty table
    gives no rows.
    """
    groups = max(1, -(-pieces.count() // group))
    places = _dealt(pieces, groups, 0, cap)
    done, level = None, 0
    while groups > 1:
        rest = places.where("not filled")
        fewer = -(-rest.count() // group)
        if not 0 < fewer < groups:
            break
        groups, level = fewer, level + 1
        done = places.where("filled") if done is None else done.union(places.where("filled"))
        places = _dealt(rest, groups, level, cap)
    done = places if done is None else done.union(places)
    return pieces.join(done.select("row", "sequence_id", "offset"), "row")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, cap: Capacity = Capacity(), group: int = GROUP, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with keep_ids the ids. See token_pieces() and pack(). Other columns of docs are ignored."""
    pieces = token_pieces(docs, tokenizer_path, end_id, cap.tokens, keep_ids, id_col, text_col)
    return pack(stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces"), cap, group).drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): the packed sequences themselves, from pack_documents() with its ids. Null and repeated doc_ids are told apart by their places; an empty table gives no sequences."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))  # of one sequence
    out = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return out.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.transform("parts", lambda p: p["length"]).alias("lengths"))
