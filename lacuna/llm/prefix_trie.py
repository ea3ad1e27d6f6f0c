"""The trie of conversation prefixes, by preorder intervals over a distributed order.

A node is a distinct sequence of first turns; a conversation is a member of every
node along its path.  No tree is walked:

1. Equal sequences are grouped, and distinct ones ranked in lexicographic order of
   their turns' keys (a range partitioned sort), so the members of a node are
   neighbours.
2. Each distinct sequence names its nodes by a chained digest; a node keeps its
   least conversation, its members, and the ranks of the first and last sequence
   below it.  Ordered by (first rank, depth), nodes stand in preorder, and a node's
   subtree is the interval up to the last node that the last sequence brought in.
3. Prefix sums of leaves and of saved weight over that order (running sums within
   range partitions, and one total a partition) are stored with each node; what
   a subtree holds is its end's sum less the sum before its top.

Groups of any size are summed up before they are shuffled; ids that end in a node
are joined by blocks of 65,536 ids and hashed block by block.  A sequence is one
row, of about 50 bytes a turn.

Defined results: rows without a conversation id belong to none and are left out;
a null role or text is empty; rows of one turn are taken by role and the digest
of their text; a null turn comes first; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lacuna.llm.common import batches_of, runs, written

WORD = r"[^\x20\x09-\x0D]+"
#: Ids of one block of those that end in a node: 2 ** BLOCK_BITS.
BLOCK_BITS = 16


def turn_lists(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", near: int = 1) -> DataFrame:
    """(conv_id, near, turns) with turns as (key, weight) in order: a digest of role and text, and the text's words.

    Conversations with the same id, less its remainder by `near`, stay in one partition.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    conv = F.col(conv_col).cast("long")
    digest = F.unhex(F.sha2(text, 256))
    key = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    turns = rows.filter(conv.isNotNull()).select(
        conv.alias("conv_id"), (conv - conv % near).alias("near"), F.struct(F.col(turn_col).cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("weight")).alias("t")
    ).repartition("near").groupBy("near", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return turns.withColumn("turns", F.transform("turns", lambda t: F.struct(t["key"], t["weight"])))


def _ended(sequences: DataFrame) -> DataFrame:
    """(end, conv_id, n, ends_sha256): of each distinct sequence its least id, how many there are, and the digest of all ids in order."""
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")))
    blocks = sequences.groupBy("end", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"), ids.alias("ids"))
    blocks = blocks.repartition("end").sortWithinPartitions("end", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        head = digest = None
        for end, batch, new in runs(batches, "end"):
            if new and head:
                yield *head, digest.hexdigest()
            if new:
                head, digest = [end, batch.column("least")[0].as_py(), 0], hashlib.sha256()
            for ids, n in zip(batch.column("ids"), batch.column("n").to_pylist(), strict=True):
                digest.update(("," if head[2] else "").encode() + ids.as_py().encode())
                head[2] += n
        if head:
            yield *head, digest.hexdigest()

    schema = "end binary, conv_id long, n long, ends_sha256 string"
    return blocks.mapInArrow(batches_of(run, schema), schema)


def _named(ranked: DataFrame) -> DataFrame:
    """(node, parent, depth, weight, rank, conv_id, n): the nodes along each distinct sequence, the root first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            turns = batch.column("turns")
            at, flat = turns.offsets.to_pylist(), turns.values
            keys, weights = flat.field("key"), flat.field("weight")
            for k, (rank, conv, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rank", "conv_id", "n")), strict=True)):
                node = b""
                yield node, None, 0, 0, rank, conv, n
                for depth, i in enumerate(range(at[k], at[k + 1]), 1):
                    parent, node = node, hashlib.blake2b(node + keys[i].as_py(), digest_size=16).digest()
                    yield node, parent, depth, weights[i].as_py(), rank, conv, n

    schema = "node binary, parent binary, depth long, weight long, rank long, conv_id long, n long"
    return ranked.select("turns", "rank", "conv_id", "n").mapInArrow(batches_of(run, schema), schema)


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """`df` with a column for each of `sums` (new name: long column): the sum up to and including the row, in `order`.

    Running sums within range partitions; the totals of the partitions, a row each, are summed up and sent out.
    """
    schema = StructType([*df.schema.fields, *[StructField(name, LongType()) for name in (*sums, "__part")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, upto = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            columns, names = list(batch.columns), list(batch.schema.names)
            for name, of in sums.items():
                values = np.cumsum(batch.column(of).to_numpy(zero_copy_only=False)) + upto[name]
                upto[name] = int(values[-1]) if len(values) else upto[name]
                columns.append(pa.array(values, pa.int64()))
            columns.append(pa.array(np.full(batch.num_rows, part), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *sums, "__part"])

    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "sums")
    totals = parts.groupBy(F.col("__part").alias("__of")).agg(*[F.max(name).alias(f"__{name}") for name in sums])  # a row per partition; sums do not fall
    before = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__of", *[F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__{name}") for name in sums])
    joined = parts.join(F.broadcast(totals), F.col("__part") == F.col("__of"))
    return joined.select(*df.columns, *[(F.col(name) + F.col(f"__{name}")).alias(name) for name in sums])


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per node of sequences (conv_id, turns of (key, weight)); conv_id is unique.

    conv_id (the least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, members beyond the first times the
    weight of the last turn), ends_sha256 (of the ids that end here).
    """
    name = F.unhex(F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.hex(t["key"]))), 256))
    sequences = written(sequences.select("conv_id", "turns", name.alias("end")), "sequences")
    distinct = sequences.groupBy("end").agg(F.first("turns").alias("turns")).join(_ended(sequences.select("conv_id", "end")), "end")
    distinct = distinct.select("turns", "conv_id", "n", "ends_sha256").repartitionByRange("turns").sortWithinPartitions("turns")
    ranked = written(distinct.withColumn("rank", F.monotonically_increasing_id()), "ranked")

    nodes = _named(ranked).groupBy("node", "parent", "depth", "weight").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.min("rank").alias("first"), F.max("rank").alias("last"))
    nodes = written(nodes, "nodes")
    kids = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(above, "parent", "left").join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "first", "last", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("weight")).alias("saved"))

    summed = written(prefix_sums(nodes, ["first", "depth"], {"leaves_upto": "leaf", "saved_upto": "saved"}), "preorder")
    ends = summed.groupBy(F.col("first").alias("last")).agg(F.max("leaves_upto").alias("end_leaves"), F.max("saved_upto").alias("end_saved"))
    closing = ranked.select(F.col("rank").alias("first"), F.size("turns").cast("long").alias("depth"), "ends_sha256")
    out = summed.join(ends, "last").join(closing, ["first", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("end_leaves") - F.col("leaves_upto") + F.col("leaf")).alias("n_leaves"),
        (F.col("end_saved") - F.col("saved_upto") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
