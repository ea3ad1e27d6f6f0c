"""Hierarchical weighted hash tree: region -> rack -> shard, DataFrame functions only.

A row descends from the root.  At each level every child of the node it stands
in draws an exponential, ``-ln(u) / weight``, with ``u`` from a hash of the
row's key, the level and the child's number, and `weight` the sum of the shards
below; the least draw wins.  So a child is taken with its share of the node's
weight, and a row costs the children along one path, not all shards.

A draw depends on nothing but the child's own number and weight.  A change of
weights inside a subtree whose whole weight stays moves rows only inside it; a
heavier or lighter subtree takes rows from its siblings, or gives them up, only
at the levels where a weight changed.  An added shard in a region of its own
takes rows only into itself (`grown`).  Placement needs no shuffle and no state.

Slots are dealt in two steps: rows of a shard fall into hash buckets whose
counts (shards x buckets, a bound fixed by configuration) are summed up into
offsets, and rows are numbered only within a bucket, so no task sees a shard
whole.

Defined results: a null text has size 1 and the CRC of no bytes; a null key is
hashed as absent, so all such rows share a shard; repeated rows share a shard
and get slots of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(n_shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """Shards 0 to n-1 of equal weight, filled rack by rack and region by region."""
    return [Shard(i // (per_rack * racks_per_region), i // per_rack, i) for i in range(n_shards)]


def grown(leaves: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region of its own, so that no other draw changes."""
    new = Shard(*(max((getattr(x, f) for x in leaves), default=-1) + 1 for f in ("region", "rack", "shard")), weight)
    return [*leaves, new]


LEVELS = ("region", "rack", "shard")


def _children(leaves: list[Shard]) -> list[dict[tuple[int, ...], dict[int, float]]]:
    """For each level: the children of every node (its path from the root), with their weights."""
    out: list[dict] = [{} for _ in LEVELS]
    for x in leaves:
        path = tuple(getattr(x, f) for f in LEVELS)
        for k in range(len(LEVELS)):
            node = out[k].setdefault(path[:k], {})
            node[path[k]] = node.get(path[k], 0.0) + x.weight
    return out


def _drawn(key: Column, salt: str, level: str) -> Callable[[Column], Column]:
    """What a child draws, and its number."""

    def draw(kid: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(salt), F.lit(level), kid["child"]), 11) + F.lit(0.5)) / F.lit(float(2**53))
        return F.struct((-F.ln(u) / kid["weight"]).alias("draw"), kid["child"].alias("child"))

    return draw


def _descend(key: Column, salt: str, leaves: list[Shard]) -> Column:
    """The shard of a row: the child of least draw at each level; of equal ones the one with the least number."""
    path = F.lit("")
    for level, nodes in zip(LEVELS, _children(leaves), strict=True):
        table = F.create_map(*[x for at, kids in nodes.items() for x in (F.lit("/".join(map(str, at))), F.array(*[F.struct(F.lit(i).alias("child"), F.lit(w).alias("weight")) for i, w in sorted(kids.items())]))])
        child = F.array_min(F.transform(F.element_at(table, path), _drawn(key, salt, level)))["child"]
        path = child.cast("string") if level == LEVELS[0] else F.concat(path, F.lit("/"), child.cast("string"))
    return child


def place(df: DataFrame, key: str, trees: dict[str, list[Shard]], salt: str = "shard") -> DataFrame:
    """Adds one int column for each named tree: the shard that the row of `key` goes to."""
    trees = {name: [x for x in leaves if x.weight > 0] for name, leaves in trees.items()}
    if not all(trees.values()):
        raise ValueError("a tree needs a shard of positive weight")
    if any(len({x.shard for x in t}) < len(t) for t in trees.values()):
        raise ValueError("shard numbers repeat")
    return df.select("*", *[_descend(F.col(key), salt, t).alias(name) for name, t in trees.items()])


def number_slots(df: DataFrame, shard: str, key: str, order: list[str], slot: str = "slot", buckets: int | None = None) -> DataFrame:
    """Adds `slot`: rows of a shard numbered from 0 without gaps.

    `buckets` (default: the session's shuffle partitions) divides every shard
    by a hash of `key`.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(F.lit("slot"), F.col(key)), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
        .select(F.col(shard).alias("__shard"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    within = Window.partitionBy(shard, "__bucket").orderBy(*order)
    return (
        df.withColumn("__row", F.row_number().over(within))
        .join(F.broadcast(offsets), (F.col(shard) == F.col("__shard")) & (F.col("__bucket") == F.col("__b")))  # shards x buckets rows
        .withColumn(slot, F.col("__offset") + F.col("__row") - 1)
        .drop("__bucket", "__row", "__shard", "__b", "__offset", "__n")
    )


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = place(docs, id_col, {"__at": even_tree(n_shards), "__grown": grown(even_tree(n_shards))})
    rows = placed.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("__at").alias("shard"),
        F.col("__grown").alias("grown_shard"),
    )
    return number_slots(rows, "shard", "doc_id", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
