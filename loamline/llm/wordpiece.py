"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie over bytes. A node's failure link leads to the node
reached by what is left once the longest pieces have been popped off the path to
it, and the number of pieces popped is stored with the link. A word is then read
once, byte by byte, adding up numbers; no piece is ever built.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import text_bytes

#: Words whose counts a task remembers before it starts anew.
MEMORY = 500_000


def read_vocabulary(path: str) -> list[bytes]:
    """The tokens of a ranks file: base64 and rank per line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


@dataclass
class Automaton:
    """child: (node << 8 | byte) -> node; fail[node]: node or -1; popped[node]: pieces popped on the way there. Node 0 is the root."""

    child: dict[int, int]
    fail: list[int]
    popped: list[int]

    @classmethod
    def of(cls, vocabulary: list[bytes]) -> Automaton:
        child: dict[int, int] = {}
        whole, edges = [False], [(-1, 0)]
        for piece in vocabulary:
            at = 0
            for byte in piece:
                key = at << 8 | byte
                if key not in child:
                    child[key] = len(whole)
                    whole.append(False)
                    edges.append((at, byte))
                at = child[key]
            if piece:
                whole[at] = True
        fail, popped = [-1] * len(whole), [0] * len(whole)
        depth = [0] * len(whole)
        for v in range(1, len(whole)):
            depth[v] = depth[edges[v][0]] + 1
        for v in sorted(range(1, len(whole)), key=depth.__getitem__):
            if whole[v]:
                fail[v], popped[v] = 0, 1
                continue
            u, byte = edges[v]
            z, n = fail[u], popped[u]
            while z >= 0 and (z << 8 | byte) not in child:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[v], popped[v] = child[z << 8 | byte], n
        return cls(child, fail, popped)

    def pieces(self, word: bytes) -> int:
        """How many pieces greedy longest matching cuts a word into; -1 if it can't be cut."""
        child, fail, popped = self.child, self.fail, self.popped
        at = n = 0
        for byte in word:
            while (to := child.get(at << 8 | byte, -1)) < 0:
                if at == 0 or fail[at] < 0:
                    return -1
                n += popped[at]
                at = fail[at]
            at = to
        while at:
            if fail[at] < 0:
                return -1
            n += popped[at]
            at = fail[at]
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.pieces = automaton.pieces

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = n = self.pieces(b" " + word)
        return n


def _counted(automaton):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(Automaton(*automaton.value))
        for b in batches:
            rows = []
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                each = list(map(counts.__getitem__, raw.split()))
                unknown = each.count(-1)
                rows.append((doc_id, len(each), sum(each) + 2 * unknown, unknown))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return run


def token_counts(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_tokens, n_unknown.

    Words lie between [\\x20\\x09-\\x0D]; each is cut with one space before it, as
    the vocabulary's word starts have it. A word that can't be cut is one unknown
    token. Null counts as empty, and an empty text has no tokens. Other columns
    are ignored; an empty table gives no rows.
    """
    built = Automaton.of(vocabulary)
    # Plain tables as large as the vocabulary: executors need no class of ours to read them.
    automaton = docs.sparkSession.sparkContext.broadcast((built.child, built.fail, built.popped))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw")).mapInArrow(_counted(automaton), "doc_id long, n_words long, n_tokens long, n_unknown long")
