"""Approximate nearest neighbours by a forest of random-projection trees.

1. Equal vectors are one row with their least ids: as ties go to the smaller id,
   more than `k` + 1 of them can be in no answer.
2. Trees are fitted on a sample of at most SAMPLE vectors and SAMPLE_BYTES.  A node
   projects its vectors on the line through two of them and splits at the median.
   A tree has at most LEAVES leaves at any size, so the forest that is sent out
   is bounded by LEAVES x dimension numbers a tree.
3. A query descends all trees through one priority queue: a side of a split costs
   what its parent costs, and the far side the square of the distance to the
   split besides.  The `visits` cheapest leaves of all trees are taken.  How many
   are needed is measured on the sample, where the nearest of up to PROBES vectors
   are known exactly: so many that RECALL of these lie in a leaf taken.
4. Rows go once to blocks by their leaf in the first tree, with the numbers of
   their leaves in all trees; a query goes to the blocks where rows of the leaves
   that it takes lie (a count of rows by leaf and block, LEAVES squared x trees).
   Blocks and the queries sent to them are dealt into parts of bounded size.
5. In a task, the rows that share a taken leaf with a query are ranked by their
   exact cosine in double precision; the best of all tasks are merged.

Work is queries x rows of the leaves taken.  In data without clusters a search
has to take a large share of all leaves to find nine neighbours in ten, and then
grows with the square of the table; where there are clusters it takes few.

Defined results: vectors that are null, zero, or hold a null or non-finite
component, and rows without an id, take no part; of different lengths the
shorter end in zeros; rows that share an id are one candidate, as near as the
nearest of them; repeated rows are one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import batches_of, runs, written

TREES, LEAVES = 8, 64
SAMPLE, SAMPLE_BYTES = 16_384, 1 << 25
#: Least vectors of the sample in a leaf.
LEAST_LEAF = 32
PROBES, RECALL = 256, 0.96
#: Rows of a block, and queries, that meet in one task at most; those of a step within it.
ROWS, QUERIES, STEP = 1 << 16, 1 << 13, 512


@dataclass
class Tree:
    """Splits as rows of `planes` with `offsets`; `sides` has the numbers of the two nodes below, leaves as -1 - leaf."""

    planes: np.ndarray
    offsets: np.ndarray
    sides: np.ndarray
    n_leaves: int

    @property
    def root(self) -> int:
        return 0 if len(self.planes) else -1

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        node = np.full(len(vectors), self.root)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            far = np.einsum("ij,ij->i", vectors[inner], self.planes[at]) >= self.offsets[at]
            node[inner] = self.sides[at, far.astype(int)]
        return -1 - node


def grow(vectors: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    planes, offsets, sides, leaves = [], [], [], 0
    todo = [(np.arange(len(vectors)), None)]
    while todo:
        rows, place = todo.pop()
        split = _split(vectors[rows], rng) if len(rows) > leaf else None
        if split is None:
            number, leaves = -1 - leaves, leaves + 1
        else:
            number, (plane, offset, far) = len(planes), split
            planes.append(plane)
            offsets.append(offset)
            sides.append([0, 0])
            todo += [(rows[far], (number, 1)), (rows[~far], (number, 0))]
        if place:
            sides[place[0]][place[1]] = number
    width = vectors.shape[1]
    return Tree(np.array(planes, np.float32).reshape(-1, width), np.array(offsets, np.float32), np.array(sides, np.int64).reshape(-1, 2), leaves)


def _split(vectors: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.float32, np.ndarray] | None:
    """Direction, median and the rows beyond it; nothing where no direction parts the vectors."""
    for _ in range(4):
        a, b = vectors[rng.choice(len(vectors), 2, replace=False)]
        plane = a - b
        length = np.linalg.norm(plane)
        if length > 0:
            plane = plane / length
            along = np.einsum("ij,j->i", vectors, plane)
            offset = np.median(along).astype(np.float32)
            far = along >= offset
            if not far.all() and far.any():
                return plane, offset, far
    return None


class Forest:
    """Trees with the first number of each one's leaves."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        self.first = np.cumsum([0, *(t.n_leaves for t in trees)])

    @property
    def n_leaves(self) -> int:
        return int(self.first[-1])

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf in each tree, vectors x trees, numbered over all trees."""
        return np.stack([t.leaf_of(vectors) + f for t, f in zip(self.trees, self.first, strict=False)], 1)

    def search(self, vectors: np.ndarray, visits: int) -> Iterator[list[int]]:
        """The leaves that each query takes, cheapest first, through one queue over all trees."""
        margins = [vectors @ t.planes.T - t.offsets for t in self.trees]
        sides = [t.sides.tolist() for t in self.trees]
        for q in range(len(vectors)):
            m = [x[q].tolist() for x in margins]
            queue = [(0.0, k, t.root) for k, t in enumerate(self.trees)]
            taken: list[int] = []
            while queue and len(taken) < visits:
                cost, k, node = heapq.heappop(queue)
                while node >= 0:
                    by = m[k][node]
                    near, far = sides[k][node][by >= 0], sides[k][node][by < 0]
                    heapq.heappush(queue, (cost + by * by, k, far))
                    node = near
                taken.append(int(self.first[k]) - 1 - node)
            yield taken


def fit(sample: np.ndarray, k: int, seed: int = 0) -> tuple[Forest, int]:
    """The forest of a sample of unit vectors, and how many leaves a search takes."""
    rng = np.random.default_rng(seed)
    leaf = max(LEAST_LEAF, -(-len(sample) // LEAVES))
    forest = Forest([grow(sample, leaf, rng) for _ in range(TREES)])
    if len(sample) <= leaf or forest.n_leaves == TREES:
        return forest, forest.n_leaves
    probes = np.arange(len(sample))[: PROBES]  # the sample is in the order of a hash
    likeness = sample[probes] @ sample.T
    likeness[np.arange(len(probes)), probes] = -2
    k = min(k, len(sample) - 1)
    nearest = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
    of = forest.leaves_of(sample)
    place = np.empty((len(probes), forest.n_leaves), np.int64)
    for q, taken in enumerate(forest.search(sample[probes], forest.n_leaves)):
        place[q, taken] = np.arange(len(taken))
    found = np.sort(np.concatenate([place[q][of[near]].min(axis=1) for q, near in enumerate(nearest)]))
    return forest, int(found[min(len(found) - 1, int(np.ceil(RECALL * len(found))))]) + 1


def _vectors(column: pa.Array, width: int = 0, rest: int = 0) -> np.ndarray:
    """Lists as rows of a matrix, shorter ones ended by `rest`."""
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    n = np.diff(at)
    width = max(width, int(n.max())) if len(n) else width
    if (n == width).all():
        return values[at[0] : at[-1]].reshape(-1, width)
    out = np.full((len(n), width), rest, values.dtype)
    out[np.repeat(np.arange(len(n)), n), np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], n)] = values[at[0] : at[-1]]
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Of length one, in single precision, for the trees."""
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, key) of the rows that take part; `key` is a hash of the vector in 128 bits."""
    vec = F.col(vec_col).cast("array<double>")
    whole = F.col(id_col).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.filter(whole).select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
    width = rows.agg(F.max(F.size("vec")).alias("n"), F.min(F.size("vec")).alias("least")).first()
    if width.n != width.least:
        rows = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(width.n) - F.size("vec"))))
    return rows.withColumn("key", F.concat(F.hex(F.xxhash64(F.lit(1), "vec")), F.lit("-"), F.hex(F.xxhash64(F.lit(2), "vec"))))


def sampled(distinct: DataFrame, n: int) -> np.ndarray:
    """About SAMPLE of the distinct vectors, or fewer within SAMPLE_BYTES, in the order of a hash of their keys."""
    width = distinct.select(F.size("vec")).first()[0]
    share = min(1.0, SAMPLE / n, SAMPLE_BYTES / (4 * width * n))
    draw = F.xxhash64(F.lit("sample"), "key")
    rows = distinct.filter(draw < F.lit(int((2 * share - 1) * 2**63) if share < 1 else 2**63 - 1)).select("vec", draw.alias("draw")).toArrow()
    if not rows.num_rows:
        rows = distinct.select("vec", draw.alias("draw")).limit(1).toArrow()
    rows = rows.sort_by("draw")
    return _unit(_vectors(rows.column("vec").combine_chunks()))


def _leaved(distinct: DataFrame, forest) -> DataFrame:
    """(key, vec, ids, leaves) with the row's leaf in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = forest.value.leaves_of(_unit(_vectors(batch.column("vec")))) if batch.num_rows else np.zeros((0, TREES), np.int64)
            at = pa.array(np.arange(batch.num_rows + 1) * leaves.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(leaves.ravel(), pa.int64()))], names=[*batch.schema.names, "leaves"])

    return distinct.mapInArrow(run, "key string, vec array<double>, ids array<long>, leaves array<long>")


def _sought(queries: DataFrame, forest, visits: int) -> DataFrame:
    """(key, vec, taken): the leaves that each query takes, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        n = forest.value.n_leaves
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                for key, vec, taken in zip(part.column("key"), part.column("vec"), forest.value.search(_unit(_vectors(part.column("vec"))), visits), strict=True):
                    bits = np.zeros(n, bool)
                    bits[taken] = True
                    yield key.as_py(), np.asarray(vec.values), np.packbits(bits).tobytes()

    schema = "key string, vec array<double>, taken binary"
    return queries.select("key", "vec").mapInArrow(batches_of(run, schema), schema)


def _routes(rows: DataFrame, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each block (leaves of the first tree), and whether rows of a leaf lie in a block: leaves x blocks numbers at most."""
    block = F.col("leaves")[0].alias("block")
    counted = rows.select(block, F.explode("leaves").alias("leaf")).groupBy("block", "leaf").agg(F.count(F.lit(1)).alias("n")).toArrow()
    n = np.zeros((forest.n_leaves, int(forest.first[1])), np.int64)
    n[counted.column("leaf").to_numpy(), counted.column("block").to_numpy()] = counted.column("n").to_numpy()
    return np.diag(n[: n.shape[1]]).copy(), n > 0


def _sent(sought: DataFrame, routes) -> DataFrame:
    """(block, key, vec, taken): queries at the blocks where rows of their leaves lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        lies = routes.value
        for batch in batches:
            for key, vec, taken in zip(*(batch.column(c) for c in ("key", "vec", "taken")), strict=True):
                bits = np.unpackbits(np.frombuffer(taken.as_py(), np.uint8), count=len(lies)).astype(bool)
                for block in np.flatnonzero(lies[bits].any(axis=0)).tolist():
                    yield block, key.as_py(), np.asarray(vec.values), taken.as_py()

    schema = "block long, key string, vec array<double>, taken binary"
    return sought.mapInArrow(batches_of(run, schema), schema)


class Best:
    """The nearest rows met so far by the queries of one task."""

    def __init__(self, batch_vecs: list[np.ndarray], keys: list[str], taken: list[bytes], n_leaves: int, most: int):
        self.keys, self.most = keys, most
        self.vecs = np.concatenate(batch_vecs)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vecs, self.vecs))
        self.taken = np.stack([np.unpackbits(np.frombuffer(b, np.uint8), count=n_leaves).astype(bool) for b in taken])
        self.score = np.full((len(keys), most), -np.inf)
        self.ids = np.full((len(keys), most, most), -1, np.int64)

    def meet(self, vecs: np.ndarray, leaves: np.ndarray, ids: np.ndarray) -> None:
        """Rows with their leaves and least ids (padded with -1)."""
        norms = np.sqrt(np.einsum("ij,ij->i", vecs, vecs))
        order = np.argsort(ids[:, 0], kind="stable")  # among equal scores the row with the least id is taken first
        vecs, leaves, ids, norms = vecs[order], leaves[order], ids[order], norms[order]
        for a in range(0, len(self.keys), STEP):
            part = slice(a, a + STEP)
            shared = np.zeros((len(self.keys[part]), len(vecs)), bool)
            for t in range(leaves.shape[1]):
                shared |= self.taken[part][:, leaves[:, t]]
            rough = np.where(shared, (self.vecs[part] @ vecs.T) / (self.norms[part, None] * norms), -np.inf)
            slack = min(self.most + 8, len(vecs))
            near = np.sort(np.argpartition(-rough, slack - 1, axis=1)[:, :slack], axis=1)
            q, r = np.nonzero(np.take_along_axis(shared, near, 1))
            r = near[q, r]
            exact = np.full((len(shared), slack), -np.inf)
            dot = np.einsum("ij,ij->i", self.vecs[part][q], vecs[r])
            column = np.arange(len(q)) - np.searchsorted(q, q)
            exact[q, column] = dot / (self.norms[part][q] * norms[r])
            found = np.full((len(shared), slack, self.most), -1, np.int64)
            found[q, column] = ids[r]
            score, of = np.concatenate([self.score[part], exact], 1), np.concatenate([self.ids[part], found], 1)
            first = np.where(of[:, :, 0] >= 0, of[:, :, 0], np.iinfo(np.int64).max)
            best = np.lexsort((first, -score), axis=1)[:, : self.most]
            self.score[part], self.ids[part] = np.take_along_axis(score, best, 1), np.take_along_axis(of, best[:, :, None], 1)

    def rows(self) -> Iterator[tuple]:
        for q, key in enumerate(self.keys):
            for score, ids in zip(self.score[q].tolist(), self.ids[q].tolist(), strict=True):
                if score > -np.inf:
                    for i in ids:
                        if i != -1:
                            yield key, i, score


def _dealt(df: DataFrame, block, own: str, of_other: str, own_parts: np.ndarray, other_parts: np.ndarray) -> DataFrame:
    """Rows with a part of their own by a hash of the key, at every part of the other side."""
    table = lambda n: F.array(*map(F.lit, n.tolist()))  # noqa: E731  a number per block
    df = df.withColumn("block", block.cast("int"))
    df = df.withColumn(own, F.pmod(F.xxhash64(F.lit("part"), "key"), F.element_at(table(own_parts), F.col("block") + 1)).cast("int"))
    return df.withColumn(of_other, F.explode(F.sequence(F.lit(0), F.element_at(table(other_parts), F.col("block") + 1) - 1)))


def _met(sent: DataFrame, rows: DataFrame, n_rows: np.ndarray, n_leaves: int, most: int) -> DataFrame:
    """(key, vec_id, score): the `most` nearest rows of each query within each task."""
    n_sent = np.zeros(len(n_rows), np.int64)
    for r in sent.groupBy("block").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():  # a row per block
        n_sent[r.block] = r.n
    row_parts, sent_parts = (np.maximum(1, -(-n // most_of)).astype(int) for n, most_of in ((n_rows, ROWS), (n_sent, QUERIES)))
    left = _dealt(sent, F.col("block"), "of_sent", "of_rows", sent_parts, row_parts).withColumn("kind", F.lit(0))
    right = _dealt(rows, F.col("leaves")[0], "of_rows", "of_sent", row_parts, sent_parts).withColumn("kind", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("task", F.concat_ws("-", "block", "of_rows", "of_sent"))
    both = both.select("task", "kind", "key", "vec", "taken", "ids", "leaves").repartition("task").sortWithinPartitions("task", "kind", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        waiting: tuple[list, list, list] = ([], [], [])
        best = None
        for _, batch, new in runs(batches, "task"):
            if new:  # queries come first
                if best:
                    yield from best.rows()
                waiting, best = ([], [], []), None
            n = int(np.count_nonzero(batch.column("kind").to_numpy() == 0))
            if n:
                part = batch.slice(0, n)
                waiting[0].append(_vectors(part.column("vec")))
                waiting[1].extend(part.column("key").to_pylist())
                waiting[2].extend(part.column("taken").to_pylist())
            if n < batch.num_rows and waiting[1]:
                best = best or Best(*waiting, n_leaves, most)
                for at in range(n, batch.num_rows, STEP):
                    part = batch.slice(at, STEP)
                    best.meet(_vectors(part.column("vec")), _vectors(part.column("leaves")), _vectors(part.column("ids"), most, -1))
        if best:
            yield from best.rows()

    schema = "key string, vec_id long, score double"
    return both.mapInArrow(batches_of(run, schema), schema)


def nearest(vectors: DataFrame, asked, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", visits: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found of each row where `asked` (a condition on vec_id) holds.

    `visits` is the number of leaves a search takes (default: by the sample).
    """
    spark = vectors.sparkSession
    rows = written(valid(vectors, id_col, vec_col), "vectors")
    least = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    distinct = written(least.groupBy("key").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_set("vec_id")).alias("ids")), "distinct")
    queries = rows.filter(asked).select(F.col("vec_id").alias("query_id"), "key").distinct()
    n = distinct.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest, enough = fit(sampled(distinct, n), k)
    shared = spark.sparkContext.broadcast(forest)  # at most TREES x LEAVES x dimension numbers
    placed = written(_leaved(distinct, shared), "leaved")
    n_rows, lies = _routes(placed, forest)
    sought = distinct.join(queries.select("key").distinct(), "key", "left_semi")
    sent = written(_sent(_sought(sought, shared, visits or enough), spark.sparkContext.broadcast(lies)), "sought")
    met = _met(sent, placed, n_rows, forest.n_leaves, k + 1).groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.asc("vec_id")]
    few = met.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("place") <= k + 1).drop("place")
    found = queries.join(written(few, "found"), "key").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
