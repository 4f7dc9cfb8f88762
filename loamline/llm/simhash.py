"""SimHash near-duplicates by an inverted index of byte positions with count filtering.

Two fingerprints of B bytes that differ in at most d < B bits share at least
B - d bytes at the same positions. The index would post a fingerprint under each
(position, byte); but every such list holds 1/256 of the corpus, so merging them
costs the square of its size. What is posted instead are (four positions, their
bytes), for a family of position quads such that any two fingerprints reaching
the guaranteed count meet under at least one quad: its bytes are four of the
tallied ones, so two that meet by chance share four. Fingerprints that meet are
tallied (bytes shared over all positions), go on if they reach the minimum, and
only these are verified by the differing bits.

Equal fingerprints are one node. A list is compared in blocks, pair of blocks by
pair of blocks, and gives only the links of a spanning forest, never all pairs;
rows that a link has reached are not compared with each other again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import dropped, lean, marked, marks, partitions, small_batches, stored, text_bytes
from loamline.llm.components import components

#: Rows of one block of a long list.
BLOCK = 2048


def quads_of_eight() -> list[tuple[int, ...]]:
    """14 quads of 8 positions of which any 5 positions hold one whole (the Steiner system S(3, 4, 8)): the two halves, and unions of two pairs that are matched alike in either half."""
    first, second = range(4), range(4, 8)
    match = lambda at: [[(at[0], at[k]), tuple(x for x in at[1:] if x != at[k])] for k in (1, 2, 3)]
    return [tuple(first), tuple(second), *(a + b for m, n in zip(match(first), match(second)) for a in m for b in n)]


# ---------------------------------------------------------------- fingerprints

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Words between [\\x20\\x09-\\x0D], with A-Z in lower case."""
    return raw.translate(_LOWER).split()


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; of the whole sequence if it is shorter; nothing without words."""
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - k + 1)
    text = [b" ".join(x) for x in zip(*(words[i:] for i in range(k)))] if len(words) >= k else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, text, repeat(seed)), np.uint64, n)


def majority(h: np.ndarray, lanes: int = 1) -> bytes:
    """The bits set in over half of the hashes, 8 bytes per lane, the most significant first. Lanes beyond the first mix the hash anew."""
    if not len(h):
        return bytes(8 * lanes)
    total = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        wide = np.empty((len(part), lanes), ">u8")
        wide[:, 0] = part
        for lane in range(1, lanes):
            x = (part + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
            wide[:, lane] = x ^ (x >> np.uint64(29))
        total += np.add.reduce(np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1), axis=0, dtype=np.uint16)
    return np.packbits(2 * total > len(h)).tobytes()


def _fingerprints(k: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [int.from_bytes(majority(shingle_hashes(words_of(raw), k)), "big", signed=True) for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], schema=schema)

    return run


def fingerprints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long. Null and empty texts, and texts without words, have fingerprint zero."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw")).mapInArrow(_fingerprints(k), "doc_id long, fp long")


# ---------------------------------------------------------------- index and links


def _postings(sets: list[tuple[int, ...]]) -> Callable:
    """key: the set's number and its bytes."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(sets)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(ids), 4096):
                part = ids[lo : lo + 4096]
                fp = np.frombuffer(b"".join(b.column(1)[lo : lo + 4096].to_pylist()), np.uint8).reshape(len(part), -1).astype(np.int64)
                key = np.broadcast_to(np.arange(len(sets)) << 32, (len(part), len(sets))).copy()
                for place in range(at.shape[1]):
                    key |= fp[:, at[:, place]] << 8 * place
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(part, len(sets)))], schema=schema)

    return run


def spread(n: int, block: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], at_once: int) -> list[tuple[int, int]]:
    """Links that span the components of rows 0 to n - 1 under near(pivots, others) -> bool matrix, of at_once pairs at most (or one row's). Few rows are compared all with all. Of more, a row is a pivot once, and is compared only with rows that no link has reached yet: in a group of near copies nearly all are reached from the first. Of two blocks only pairs across them count: those within are another task's."""
    two = (block != block[0]).any()
    if n * n <= at_once:
        every = np.arange(n)
        hit = np.triu(near(every, every), 1)
        if two:
            hit &= block[:, None] != block
        root, out = list(range(n)), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in np.argwhere(hit).tolist():
            ra, rb = find(a), find(b)
            if ra != rb:
                root[rb] = ra
                out.append((a, b))
        return out
    left, out = np.arange(n), []
    while len(left):
        queue, left = left[:1], left[1:]
        while len(queue) and len(left):
            size = max(1, at_once // len(left))
            pivots, queue = queue[:size], queue[size:]
            hit = near(pivots, left)
            if two:
                hit &= block[pivots, None] != block[left]
            reached = hit.any(0)
            if reached.any():
                out += zip(pivots[hit[:, reached].argmax(0)].tolist(), left[reached].tolist())
                queue, left = np.concatenate([queue, left[reached]]), left[~reached]
    return out


def forest(ids: np.ndarray, index: np.ndarray, check: np.ndarray, block: np.ndarray, min_shared: int, max_bits: int, seen: dict | None = None) -> list[tuple[int, int]]:
    """Links that span what is linked among these rows (see spread). index: bytes to tally: the shared positions of every pair compared are counted, and pairs short of min_shared go; check: 64-bit words to verify what stays. seen: the numbers of pairs tallied, verified and near are added to it."""

    def near(pivots: np.ndarray, others: np.ndarray) -> np.ndarray:
        enough = (index[pivots][:, None, :] == index[others][None]).sum(-1, dtype=np.uint16) >= min_shared
        a, b = np.nonzero(enough)
        enough[a, b] = np.bitwise_count(check[pivots[a]] ^ check[others[b]]).sum(-1, dtype=np.uint16) <= max_bits
        if seen is not None:
            seen["tallied"] += enough.size
            seen["verified"] += len(a)
            seen["near"] += int(enough.sum())
        return enough

    return [(int(ids[a]), int(ids[b])) for a, b in spread(len(ids), block, near, max(1, (1 << 20) // index.shape[1]))]


def _by_bits(min_shared: int, max_bits: int) -> Callable:
    """Of rows with id, block and fingerprint, forest() of the rows from lo to hi: its bytes are tallied, its bits verified."""

    def prepare(t: pa.Table) -> Callable:
        ids, block = t.column("id").to_numpy(), t.column("block").to_numpy()
        raw = b"".join(t.column("fingerprint").to_pylist())
        index, check = np.frombuffer(raw, np.uint8).reshape(len(ids), -1), np.frombuffer(raw, np.uint64).reshape(len(ids), -1)
        return lambda lo, hi: forest(ids[lo:hi], index[lo:hi], check[lo:hi], block[lo:hi], min_shared, max_bits)

    return prepare


def _links(of: Callable) -> Callable:
    """Over rows sorted by key, i, j: the links of each run of equal ones. of: gets rows and gives a function from a run's first row and end to its links."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def flush(t: pa.Table, whole: bool):
            """Links of the complete runs, and what is left of the last one."""
            key = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            ends = [*cuts.tolist(), t.num_rows] if whole else cuts.tolist()
            if not ends:
                return [], t
            of_run = of(t.slice(0, ends[-1]))
            found, lo = [], 0
            for hi in ends:
                if hi - lo > 1:
                    found += of_run(lo, hi)
                lo = hi
            return found, t.slice(lo)

        def batch(found):
            u, v = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= 2 * BLOCK:
                found, held = flush(held, False)
                if found:
                    yield batch(found)
        if held is not None and held.num_rows:
            found, _ = flush(held, True)
            if found:
                yield batch(found)

    return run


def _linked(keys: DataFrame, rows: DataFrame, length: int, of: Callable) -> DataFrame:
    """(u, v): the links among rows (id long, and what `of` reads) that share a key of keys (key, id), in blocks of that length."""
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keys.join(counts, "key").withColumn("blocks", F.ceil(F.col("n") / length).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.select("key", "id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id").join(rows, "id")
    runs = met.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return runs.select("key", "i", "j", "block", "id", *(c for c in rows.columns if c != "id")).mapInArrow(_links(of), "u long, v long")


def links(prints: DataFrame, sets: list[tuple[int, ...]], min_shared: int, max_bits: int) -> DataFrame:
    """(u, v): links that span the near pairs of prints (id long, fingerprint binary of a multiple of 8 bytes), ids being distinct. Bytes of sets of positions are posted, all bytes tallied, all bits verified."""
    keys = prints.select("id", "fingerprint").mapInArrow(_postings(sets), "key long, id long")
    return _linked(keys, prints, BLOCK, _by_bits(min_shared, max_bits))


def near_groups(docs: DataFrame, k: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints of 64 bits over k-word shingles link at max_bits (at most 3) or
    fewer differing bits; component_id is the least doc_id reachable over links.
    Null and empty texts have fingerprint zero and are linked like any other.
    A null id takes part but is nobody's component_id, unless all ids of the
    component are null. Repeated rows each give a row; an empty table none.
    Other columns of docs are ignored.
    """
    by_doc = stored(fingerprints(docs, k, id_col, text_col), "simhash")
    nodes = by_doc.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    raw = F.unhex(F.lpad(F.hex("fp"), 16, "0"))
    prints = nodes.select(F.col("fp").alias("id"), raw.alias("fingerprint"))
    # 8 bytes of which at most max_bits differ
    found = components(links(prints, quads_of_eight(), 8 - max_bits, max_bits))
    rooted = nodes.join(found, nodes["fp"] == found["id"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return by_doc.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies by similarity

#: Lanes of 64 bits of the fingerprint over a text's shingles; how many of its 128 bytes two texts must share at their positions, and the differing bits up to which they are then compared set by set. Sets of similarity 0.8 differ in 155 bits of 1,024 with a deviation of 11.5 and share 35 bytes with one of 5; the worst small ones (4 of 5 shingles) differ in 192 with 12.5 and share 24 with one of 4.4; unlike texts share half a byte.
CHECKED_LANES, MIN_SHARED, MAX_BITS = 16, 5, 256
#: The shingles that come last in the order: at most so many of those that are in at least LEAST_TEXTS texts of one in SAMPLE.
FREQUENT, LEAST_TEXTS, SAMPLE = 16384, 4, 16
#: Rows of one block of texts that are compared by their sets.
SET_BLOCK = 2048


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The hashes of a text's k-word shingles, each once, ascending."""
    return np.unique(shingle_hashes(words_of((text or "").encode()), k))


def similar(ids: np.ndarray, sets: list[np.ndarray], block: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that span what is linked among these rows (see spread), two rows being near if their sets have that Jaccard similarity or more."""
    size = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(size)])
    each, place = np.unique(np.concatenate(sets), return_inverse=True)
    within = np.zeros(len(each), bool)
    held: dict = {"rows": None}

    def near(pivots: np.ndarray, others: np.ndarray) -> np.ndarray:
        if held["rows"] is not others:  # the places of all their sets, in a row
            held["rows"] = others
            held["places"] = place if len(others) == len(ids) else np.concatenate([place[start[o] : start[o + 1]] for o in others.tolist()])
            held["ends"] = np.concatenate([[0], np.cumsum(size[others])])
        out = np.empty((len(pivots), len(others)), bool)
        for row, a in enumerate(pivots.tolist()):
            own = place[start[a] : start[a + 1]]
            within[own] = True
            upto = np.concatenate([[0], np.cumsum(within[held["places"]])])[held["ends"]]
            within[own] = False
            shared = upto[1:] - upto[:-1]
            out[row] = shared / np.maximum(1, size[a] + size[others] - shared) >= similarity
        return out

    return [(int(ids[a]), int(ids[b])) for a, b in spread(len(ids), block, near, 1)]


def _by_sets(k: int, similarity: float) -> Callable:
    """Of rows with id, block and text, similar() of the rows from lo to hi."""

    def prepare(t: pa.Table) -> Callable:
        ids, block = t.column("id").to_numpy(), t.column("block").to_numpy()
        sets = [shingle_set(x, k) for x in t.column("text").to_pylist()]
        return lambda lo, hi: similar(ids[lo:hi], sets[lo:hi], block[lo:hi], similarity)

    return prepare


def _shingle_counts(k: int) -> Callable:
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x, k) for x in b.column(0).to_pylist()]
            if sets:
                each, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    return run


def frequent_shingles(docs: DataFrame, k: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, ascending, and the rank of each, the most frequent last, counted over one text in SAMPLE. They decide only which shingles are posted, and so how long the lists are, never which pairs are found."""
    some = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = some.mapInArrow(lean(_shingle_counts(k)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    with small_batches(docs.sparkSession):
        found = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    most = np.array([r.shingle for r in found][::-1], np.int64).view(np.uint64)
    rank = np.argsort(most)
    return most[rank], rank


def prefix(own: np.ndarray, frequent: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set (ascending hashes) in an order that all sets share: frequent ones (ascending too) last, by rank.

    Two sets of that Jaccard similarity have at least that share of either in
    common; leaving one less than that off the end of each, the rest of both
    holds the first of what they share. So near copies always meet.
    """
    n = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
    if not len(frequent):
        return own[:n]
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    late = frequent[at] == own
    at = at[late]
    return np.concatenate([own[~late], frequent[at[np.argsort(rank[at])]]])[:n]


def _set_fingerprints(k: int, similarity: float, frequent: np.ndarray, rank: np.ndarray) -> Callable:
    """Of (id, text): id, the shingles posted, the fingerprint and the digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            posted, check, same = [], [], []
            for text in b.column(1).to_pylist():
                own = shingle_set(text, k)
                posted.append(prefix(own, frequent, rank, similarity).tobytes())
                check.append(majority(own, CHECKED_LANES))
                same.append(xxhash.xxh3_128_digest(own.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.binary()) for x in (posted, check, same))], names=["id", "posted", "check", "same"])

    return run


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) for each of the 8-byte keys of (id, posted)."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            part = b.slice(lo, 4096)
            keys = part.column(1).to_pylist()
            ids = np.repeat(part.column(0).to_numpy(), [len(x) // 8 for x in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys), np.int64)), pa.array(ids)], schema=schema)


def near_dedup(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of near copies the one with the least id (null last; of equal ids, one).

    Two texts are near copies if their sets of k-word shingles have that Jaccard
    similarity or more; groups are connected. Texts that share one of the
    shingles posted for them, as all near copies do (see prefix), whose SimHash
    fingerprints share at least MIN_SHARED bytes at their positions and differ
    in at most MAX_BITS are candidates; what these connect is compared set by
    set, and only pairs of that similarity link.
    Null texts count as empty; texts without words are near copies of each
    other. An empty table gives no rows.
    """
    number = "loamline_row"
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "near")
    texts = rows.select(F.col(number).alias("id"), F.col(text_col).alias("text"))
    prints = stored(texts.mapInArrow(lean(_set_fingerprints(k, similarity, *frequent_shingles(rows, k, text_col))), "id long, posted binary, check binary, same binary"), "prints")
    # Equal sets are one node, and have equal fingerprints and postings: those of its first row.
    each = stored(prints.groupBy("same").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "nodes")
    again = marks(prints.select("id", "same").join(each.where("n > 1").select("same", F.col("id").alias("first")), "same").where("id <> first"), "id", "again")
    nodes = marked(prints, "id", again, False)
    keys = nodes.select("id", "posted").mapInArrow(_posted, "key long, id long")
    met = components(_linked(keys, nodes.select("id", F.col("check").alias("fingerprint")), BLOCK, _by_bits(MIN_SHARED, MAX_BITS)))
    # Few texts have met another: only theirs are dealt out.
    some = marks(met, "id", "met")
    found = components(_linked(met.select(F.col("root").alias("key"), "id"), marked(texts, "id", some, True), SET_BLOCK, _by_sets(k, similarity)))
    rooted = each.join(found, "id", "left").select("same", F.coalesce("root", "id").alias("root"))
    order = rows.select(F.col(number).alias("row"), F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(number).alias("row")).alias("order"))
    members = prints.select(F.col("id").alias("row"), "same").join(rooted, "same").select("row", "root")
    several = members.join(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "root").select("row", "root")
    ordered = several.join(order, "row")
    first = ordered.groupBy("root").agg(F.min("order").alias("first"))
    goes = marks(ordered.join(first, "root").where("row <> first.row").select("row"), "row", "goes")
    for scratch in (prints, each, again, some):
        dropped(scratch)
    return marked(rows, number, goes, False).select(*docs.columns)
