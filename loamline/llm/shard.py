"""Sharding by a hierarchical tree of weighted hash draws, with DataFrame functions only.

A shard has a place in the tree, with room for a fixed greatest weight, and a
weight of at most that room. A key descends from the root: at each level the
children draw -ln(u) / room, u being the hash of (key, level, node, child) in
(0, 1], and the least draw wins; only the winning subtree is looked at. The shard
it comes to takes it with probability weight / room, by one more draw; else the
key sets out anew with the next attempt's hashes.

The rooms alone decide which shards a key comes to, attempt by attempt, and the
first that takes it has it. So when a weight changes, that shard's answers change
and nothing else: keys only enter it as it grows and only leave it as it shrinks,
and none moves inside any subtree that doesn't hold it. The share of a shard is
its weight's.

A tree that grows beyond its rooms gets another one above it (`Forest`): a key
draws whether it goes to the newest tree or to those before it, by their rooms.
A key that ATTEMPTS visits to a tree have not placed goes on to the one before,
and after the first one to the shard of the least flat draw; both follow the same
law, as what a key was refused by it is refused by still.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import stored


@dataclass(frozen=True)
class Leaf:
    shard: int
    weight: float = 1.0
    room: float = 1.0


#: region -> rack -> shards; trees of a forest from the first to the newest
Tree = dict[str, dict[str, list[Leaf]]]
Forest = list[Tree]

#: Visits of a key to one tree.
ATTEMPTS = 8
#: Runs into which each shard's rows are cut to number them; fixed, so that the table of their sizes is too.
RUNS = 1024


def even_forest(n_shards: int, regions: int = 4, racks: int = 5) -> Forest:
    """Shards of weight 1, the first tree with one place in each rack, every further one doubling the places; a shard's place depends on its number alone."""
    out: Forest = []
    lo, hi = 0, regions * racks
    while lo < n_shards or not out:
        tree: Tree = {}
        for s in range(lo, hi):
            tree.setdefault(f"region{s % regions}", {}).setdefault(f"rack{s // regions % racks}", []).append(Leaf(s, float(s < n_shards)))
        out.append(tree)
        lo, hi = hi, 2 * hi
    return out


def _u(*what: Column) -> Column:
    """53 bits of the hash as a number in (0, 1]."""
    return (F.shiftrightunsigned(F.xxhash64(*what), 11).cast("double") + F.lit(1.0)) * F.lit(2.0**-53)


def _numbers(x) -> Column:
    return F.array(*map(_numbers, x)) if isinstance(x, list) else F.lit(x)


def _descend(rooms: Column, *what: Column) -> Column:
    """The child of the least draw; ties go to the first."""
    draws = F.transform(rooms, lambda room, j: F.when(room > 0, F.struct((-F.log(_u(*what, j.cast("long"))) / room).alias("draw"), j.alias("child"))))
    return F.array_min(draws)["child"]


_PLACE = "struct<region:string,rack:string,shard:int>"


def _one(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), x being bound as the one element of an array, so that it is drawn once."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _room(x) -> float:
    return sum(map(_room, x)) if isinstance(x, list) else x.room


def _search(key: Column, g: int, tree: Tree, newest: float) -> Column:
    """A key's place in the forest's g-th tree, or null. newest: the share of the rooms up to this tree that are its own."""
    regions = sorted(tree)
    racks = [sorted(tree[r]) for r in regions]
    leaves = [[sorted(tree[r][k], key=lambda leaf: leaf.shard) for k in names] for r, names in zip(regions, racks)]
    each = lambda f: _numbers([[[f(leaf) for leaf in of_rack] for of_rack in of_region] for of_region in leaves])
    region_room, rack_room = _numbers([_room(r) for r in leaves]), _numbers([[_room(k) for k in r] for r in leaves])
    room, share, shards = each(lambda x: x.room), each(lambda x: x.weight / x.room if x.room else 0.0), each(lambda x: x.shard)
    region_name, rack_name = _numbers(regions), _numbers(racks)
    long = lambda *x: [(F.lit(v) if isinstance(v, int) else v).cast("long") for v in x]

    def visit(t: Column) -> Column:
        def taken(i: Column, j: Column, k: Column) -> Column:
            shard = shards[i][j][k]
            return F.when(_u(key, *long(g, 4, t, shard)) <= share[i][j][k], F.struct(region_name[i].alias("region"), rack_name[i][j].alias("rack"), shard.cast("int").alias("shard")))

        of_rack = lambda i, j: _one(_descend(room[i][j], key, *long(g, 3, t, i, j)), lambda k: taken(i, j, k))
        of_region = lambda i: _one(_descend(rack_room[i], key, *long(g, 2, t, i)), lambda j: of_rack(i, j))
        return _one(_descend(region_room, key, *long(g, 1, t)), of_region)

    def attempt(state: Column, t: Column) -> Column:
        here = _u(key, *long(g, 0, t)) <= F.lit(newest)
        went = _one(F.when(here, visit(t)), lambda p: F.struct((p.isNotNull() | ~here).alias("over"), p.alias("place")))
        return F.when(state["over"], state).otherwise(went)

    start = F.struct(F.lit(False).alias("over"), F.lit(None).cast(_PLACE).alias("place"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), start, attempt)["place"]


def place(key: Column, forest: Forest) -> Column:
    """struct(region, rack, shard) for a key. A shard of weight 0 gets nothing. Without any weight the shard is null."""
    sizes = [sum(_room(rack) for racks in tree.values() for rack in racks.values()) for tree in forest]
    found = [_search(key, g, forest[g], sizes[g] / sum(sizes[: g + 1])) for g in reversed(range(len(forest))) if sizes[g]]
    held = sorted((leaf.shard, leaf.weight, region, rack) for tree in forest for region in tree for rack in tree[region] for leaf in tree[region][rack] if leaf.weight > 0)
    if held:
        every = F.array(*(F.struct(F.lit(s).alias("shard"), F.lit(w).alias("weight"), F.lit(region).alias("region"), F.lit(rack).alias("rack")) for s, w, region, rack in held))
        flat = F.array_min(F.transform(every, lambda x: F.struct((-F.log(_u(key, F.lit(-1).cast("long"), x["shard"].cast("long"))) / x["weight"]).alias("draw"), x["shard"].alias("shard"), x["rack"].alias("rack"), x["region"].alias("region"))))
        found.append(_one(flat, lambda x: F.struct(x["region"].alias("region"), x["rack"].alias("rack"), x["shard"].cast("int").alias("shard"))))
    return F.coalesce(*found) if found else F.lit(None).cast(_PLACE)


def shard_documents(docs: DataFrame, forest: Forest, grown: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack.

    The law is `key`: the id and the forest decide. A null id is a key of its own
    (all such rows share a shard), a null text has size 16 and the checksum of
    no bytes. Slots number a shard's rows from 0 without gaps, by hash, id and
    checksum; rows that repeat an id are numbered one after the other. Other
    columns of docs are ignored; an empty table gives no rows.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id"), F.lit(-1 << 63))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("place", place(key, forest)).withColumn("grown_shard", place(key, grown)["shard"] if grown else F.lit(None).cast("int"))
    run_of = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(RUNS)).cast("int")
    # Each text is read and each key placed once; what is numbered has a few numbers a row.
    rows = stored(rows.select("doc_id", "size", "text_crc32", "place.region", "place.rack", "place.shard", "grown_shard", run_of.alias("run")), "placed")
    # Numbers within a run, then the run's start: no task sees a whole shard.
    run = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    starts = rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("shard", "run", (F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")).alias("start"))
    # At most shards x RUNS rows, whatever the input.
    numbered = rows.withColumn("at", F.row_number().over(run) - 1).join(F.broadcast(starts), ["shard", "run"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard", "region", "rack")


def write_shards(docs: DataFrame, forest: Forest, path: str, id_col: str = "doc_id") -> None:
    """The rows of docs with all their columns as Parquet, a folder per region, rack and shard. Null ids share a shard, repeated rows stay, an empty table writes no folder."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-1 << 63))
    placed = docs.withColumn("loamline_place", place(key, forest))
    names = {f"loamline_{n}": F.col(f"loamline_place.{n}") for n in ("region", "rack", "shard")}
    placed.withColumns(names).drop("loamline_place").write.partitionBy(*names).parquet(path)
