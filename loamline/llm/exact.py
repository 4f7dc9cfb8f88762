"""Exact deduplication by Grace hashing.

Records are first partitioned by the hash of their content (Spark's exchange
writes that level's files), and each bucket is read into an open-addressing
table that compares complete contents. A bucket whose distinct contents outgrow
the table's budget freezes the table: records that match it are still merged,
all others go to spill files by the next bits of the hash, and each spill file
is a bucket of its own, handled in the same way one level down.

The same table runs once over every input partition before the exchange, so
that a text with any number of copies is sent at most once per partition. What
a table holds of a text doesn't grow with its copies.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.llm.common import lean, partitions, stored, text_bytes

#: Distinct content that one table may hold, in bytes.
TABLE_BYTES = 128 << 20
#: Spill files per level, as bits of the hash; beyond the last level all bits are used up.
FAN_BITS, LEVELS = 4, 15


def normalised(raw: bytes) -> bytes:
    """Each run of the six ASCII white-space bytes becomes one space."""
    body = b" ".join(raw.split())
    if not body:
        return b" " if raw else b""
    return (b" " if raw[:1].isspace() else b"") + body + (b" " if raw[-1:].isspace() else b"")


class ContentTable:
    """Open addressing with linear probing; slots hold entry numbers."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> int:
        """The entry's number, or -1."""
        slots, mask = self.slots, len(self.slots) - 1
        i = h & mask
        while (e := slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            i = (i + 1) & mask
        return -1

    def add(self, h: int, content: bytes, value) -> int:
        """Enter content that find() has not found."""
        if 3 * len(self.hashes) >= 2 * len(self.slots):
            self.slots = array("q", [-1]) * (2 * len(self.slots))
            for e, old in enumerate(self.hashes):
                self._place(old, e)
        e = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(value)
        self.bytes += len(content) + 200
        self._place(h, e)
        return e

    def _place(self, h: int, e: int) -> None:
        slots, mask = self.slots, len(self.slots) - 1
        i = h & mask
        while slots[i] >= 0:
            i = (i + 1) & mask
        slots[i] = e


def grace(records: Iterator[tuple[int, bytes, object]], merge: Callable, budget: int = TABLE_BYTES, level: int = 0, member: Callable | None = None) -> Iterator:
    """Tables that together hold every distinct content once. records: (hash, content, value); merge(old or None, value, content) gives an entry's value. A content's records all meet in one table. member(entry's value, value): if given, what it makes of each record is yielded as soon as the record is placed, so that an entry need not hold its records."""
    table, full, spills = ContentTable(), False, {}
    folder = None
    try:
        for h, content, value in records:
            e = table.find(h, content)
            if e >= 0:
                table.values[e] = merge(table.values[e], value, content)
            elif not full:
                e = table.add(h, content, merge(None, value, content))
                full = table.bytes > budget and level < LEVELS
            if e >= 0:
                if member:
                    yield member(table.values[e], value)
            else:
                if folder is None:
                    folder = tempfile.TemporaryDirectory(prefix="grace-")
                bucket = (h >> (64 - FAN_BITS * (level + 1))) & ((1 << FAN_BITS) - 1)
                if bucket not in spills:
                    spills[bucket] = open(os.path.join(folder.name, str(bucket)), "w+b", buffering=1 << 18)  # noqa: SIM115
                pickle.dump((h, content, value), spills[bucket], protocol=5)
        yield table
        del table
        for bucket in sorted(spills):
            yield from grace(_spilled(spills[bucket]), merge, budget, level + 1, member)
            spills.pop(bucket).close()
    finally:
        for f in spills.values():
            f.close()
        if folder is not None:
            folder.cleanup()


def _spilled(f) -> Iterator[tuple[int, bytes, object]]:
    f.flush()
    f.seek(0)
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _order(doc_id, rid: int) -> tuple:
    """Smallest doc_id first, null last; then by row."""
    return (doc_id is None, doc_id or 0, rid)


_LOCAL = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("rid", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("rep", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("h", T.LongType()),
    T.StructField("content", T.BinaryType()), T.StructField("best_id", T.LongType()), T.StructField("best_rid", T.LongType()), T.StructField("n", T.LongType()),
])
_LOCAL_NAMES = [f.name for f in _LOCAL.fields]
_LOCAL_ARROW = pa.schema([("kind", pa.int32()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("rep", pa.int64()), ("sha", pa.string()), ("h", pa.int64()), ("content", pa.binary()), ("best_id", pa.int64()), ("best_rid", pa.int64()), ("n", pa.int64())])
_EMIT = 4096


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= _EMIT or size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _local(budget: int):
    """Of one input partition: a member row for each document, as it is read, and a row for each distinct text that stands for them from here on."""

    def records(batches):
        for b in batches:
            for rid, doc_id, raw in zip(b.column("rid").to_pylist(), b.column("doc_id").to_pylist(), b.column("raw").to_pylist()):
                content = normalised(raw)
                yield xxhash.xxh64_intdigest(content), content, (rid, doc_id)

    def merge(old, new, content):
        rid, doc_id = new
        if old is None:
            return [rid, hashlib.sha256(content).hexdigest(), doc_id, rid, 1]
        if _order(doc_id, rid) < _order(old[2], old[3]):
            old[2], old[3] = doc_id, rid
        old[4] += 1
        return old

    def member(entry, new):
        rid, doc_id = new
        return 0, rid, doc_id, entry[0], entry[1], None, None, None, None, None

    def rows(batches):
        for t in grace(records(batches), merge, budget, member=member):
            if isinstance(t, tuple):
                yield t
            else:
                for h, content, (rep, _, best_id, best_rid, n) in zip(t.hashes, t.contents, t.values):
                    yield 1, None, None, rep, None, _signed(h), content, best_id, best_rid, n

    return lambda batches: _batches(rows(batches), _LOCAL_ARROW)


_RESOLVED_ARROW = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("keep_rid", pa.int64()), ("group_size", pa.int64())])


def _global(budget: int):
    def records(batches):
        for b in batches:
            for h, content, *value in zip(*(b.column(c).to_pylist() for c in ("h", "content", "rep", "best_id", "best_rid", "n"))):
                yield h & (1 << 64) - 1, content, value

    # An entry holds a row number for each input partition with that text: no more.
    def merge(old, new, _):
        rep, best_id, best_rid, n = new
        if old is None:
            return [[rep], best_id, best_rid, n]
        old[0].append(rep)
        if _order(best_id, best_rid) < _order(old[1], old[2]):
            old[1], old[2] = best_id, best_rid
        old[3] += n
        return old

    def rows(batches):
        for t in grace(records(batches), merge, budget):
            for reps, best_id, best_rid, n in t.values:
                for rep in reps:
                    yield rep, best_id, best_rid, n

    return lambda batches: _batches(rows(batches), _RESOLVED_ARROW)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of [\\x20\\x09-\\x0D]
    becomes one space; null counts as empty, so that null and empty texts form
    one group. The row with the smallest id stays; of rows that repeat that id,
    one stays; a null id comes after all others. An empty table gives no rows.
    Other columns of docs are ignored.
    """
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw"))
    local = stored(src.mapInArrow(_local(table_bytes), _LOCAL), "exact", ("kind",))
    members = local.where("kind = 0").select("rid", "doc_id", "rep", "sha")
    reps = local.where("kind = 1").select("rep", "h", "content", "best_id", "best_rid", "n")
    resolved = reps.repartition(partitions(docs.sparkSession), "h").mapInArrow(_global(table_bytes), "rep long, keep_id long, keep_rid long, group_size long")
    return members.join(resolved, "rep").select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def _kept_rows(budget: int, names: list[str], id_at: int, text_at: int, schema: pa.Schema):
    def records(batches):
        for b in batches:
            cols = [b.column(n).to_pylist() for n in names]
            for row in zip(*cols):
                text = row[text_at]
                content = normalised((text or "").encode())
                yield xxhash.xxh64_intdigest(content), content, row

    def key(row):
        return (row[id_at] is None, row[id_at] or 0, *((x is not None, str(x)) for x in row))

    def merge(old, new, _):
        return new if old is None or key(new) < key(old) else old

    def rows(batches):
        for t in grace(records(batches), merge, budget):
            for h, row in zip(t.hashes, t.values):
                yield *row, _signed(h)

    return lambda batches: _batches(rows(batches), schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns (of atomic types): one of each group of equal texts.

    Equality, nulls and ties are as in exact_groups(). The row itself travels
    with its content, so that nothing is joined back: one exchange by content.
    """
    names = docs.columns
    mark = "loamline_h"
    schema = T.StructType([*docs.schema.fields, T.StructField(mark, T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    once = lean(_kept_rows(table_bytes, names, names.index(id_col), names.index(text_col), arrow))
    local = docs.mapInArrow(once, schema)
    return local.repartition(partitions(docs.sparkSession), mark).mapInArrow(once, schema).drop(mark)
