"""Filling by a diffusion whose score is learned by boosted trees.

Columns are scaled to [-1, 1].  At each of `n_t` noise levels a cell x becomes m x + s z, with m^2 + s^2 = 1, and a
booster of each column learns its z from all noised columns; the score is -z / s.  To fill a row, its missing
cells begin as noise and come down the levels: the boosters give z, hence an estimate of x, and the cells are drawn
anew from what lies between it and their present values.  Observed cells are noised to each level on the way, so
that fills follow from them, and are kept at the end.

A row is filled on its own, so filling is one pass over the rows with all boosters at hand.  Up to
`boosting.FEW_ENTRIES` noised entries, tasks of some columns of a level learn from a copy of the table each, and up to
BINNED_ENTRIES from the bins of a level; beyond that a job grows a level of a tree of every booster at once, of as many
columns as have histograms of FEW_ENTRIES entries.
Only where those of one column have more is every booster fitted by jobs of its own.  All noise is a hash of the row's
key, so lost tasks draw the same again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.registry import IMPUTERS
from lacuna.operators import boosting
from lacuna.operators.boosting import BINS, Booster, Settings, Tree, mixed
from lacuna.operators.cells import AT, KEYS
from lacuna.operators.models import MOST_COLUMNS
from lacuna.sources.tables import Rounds, cut_lineage

#: Columns of a level that a task learns, and rows that meet all trees of a booster at a time.
COLUMNS, ROWS = 8, 4096
#: Bins (bytes) of a level that a task holds, and columns that it learns from them.
BINNED_ENTRIES, BINNED_COLUMNS = 1 << 26, 4
#: Noised rows that are packed together, at most; `_grown` relies on it.
PACKED_ROWS = 1 << 17
#: Rows of a node from which a table of two features' bins is cheaper than two passes.
MANY_ROWS = 1 << 13


@dataclass(frozen=True)
class Diffusion:
    """`duplicate_K` noised copies of each row; the noise grows from `beta_min` to `beta_max`; `r` passes of each level."""

    n_t: int = 10
    duplicate_K: int = 10
    n_estimators: int = 40
    max_depth: int = 4
    eta: float = 0.2
    beta_min: float = 0.1
    beta_max: float = 8.0
    r: int = 1
    seed: int = 0

    def __post_init__(self):
        if min(self.n_t - 1, self.duplicate_K, self.n_estimators, self.max_depth, self.r) < 1:
            raise ValueError("n_t must be at least 2; duplicate_K, n_estimators, max_depth and r at least 1")

    def scale(self, level: int) -> tuple[float, float]:
        """(m, s) of a level, the first almost without noise; levels are denser where there is little."""
        t = 1e-3 + (1 - 1e-3) * (level / (self.n_t - 1)) ** 2
        m = math.exp(-0.25 * t * t * (self.beta_max - self.beta_min) - 0.5 * t * self.beta_min)
        return m, math.sqrt(1 - m * m)

    def noise(self, keys: np.ndarray, width: int, *use) -> np.ndarray:
        """Standard normal numbers, a row for each key, by Box and Muller; others for each use."""
        out = np.empty((len(keys), width))
        for j in range(width):
            salt = int.from_bytes(hashlib.blake2b(repr((self.seed, j, *use)).encode(), digest_size=7).digest(), "little")
            out[:, j] = np.sqrt(-2 * np.log1p(-mixed(keys, salt))) * np.cos(2 * np.pi * mixed(keys, salt ^ 1 << 60))
        return out

    def noised(self, x: np.ndarray, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """All copies of the rows at a level, and their noise; what is missing stays NaN."""
        m, s = self.scale(level)
        z = np.concatenate([self.noise(keys, x.shape[1], "learn", level, copy) for copy in range(self.duplicate_K)])
        return m * np.tile(x, (self.duplicate_K, 1)) + s * z, z

    def boosted(self) -> Settings:
        return Settings("regression", self.n_estimators, self.max_depth, self.eta, 1.0, 1.0, seed=self.seed)


@dataclass
class Packed:
    """A booster in narrow arrays, fourteen bytes a node: a row goes right where its value is over the limit."""

    base: float
    feature: np.ndarray  # trees x nodes, as the others
    limit: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, b: Booster) -> Packed:
        feature, cut, value = (np.stack([getattr(t, name) for t in b.trees]) for name in ("feature", "cut", "value"))
        return cls(b.base, feature.astype(np.int16), np.where(feature >= 0, b.cuts[feature, np.minimum(cut, BINS - 2)], 0.0), value.astype(np.float32))

    def predict(self, x: np.ndarray, depth: int) -> np.ndarray:
        out, trees = np.empty(len(x)), np.arange(len(self.feature))
        for low in range(0, len(x), ROWS):
            part = x[low : low + ROWS]
            rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(trees)), np.int64)
            for _ in range(depth):
                f = self.feature[trees, node]
                node = np.where(f >= 0, 2 * node + 1 + (part[rows, f] > self.limit[trees, node]), node)
            out[low : low + ROWS] = self.base + self.value[trees, node].sum(1, dtype=np.float64)
        return out


def learn_in_one(x: np.ndarray, keys: np.ndarray, level: int, columns: list[int], d: Diffusion) -> list[Packed]:
    """The boosters of some columns at a level."""
    x_t, z = d.noised(x, keys, level)
    cuts = np.full((x.shape[1], BINS - 1), np.inf)
    for j in range(x.shape[1]):
        distinct = np.unique(np.nanquantile(x_t[:, j], np.arange(1, BINS) / BINS))
        cuts[j, : len(distinct)] = distinct
    binned = Booster(cuts, 0.0, d.boosted()).binned(x_t)
    out = []
    for j in columns:
        known = np.flatnonzero(~np.isnan(x_t[:, j]))
        y = z[known, j]
        out.append(Packed.of(boosting.boost_in_one(Booster(cuts, float(y.mean()), d.boosted()), binned[known], y, known.astype(np.int64))))
    return out


def _matrix(column, width: int) -> np.ndarray:
    """Arrays of numbers as rows; a null is NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _learn_in_tasks(rows: DataFrame, width: int, d: Diffusion) -> dict[tuple[int, int], Packed]:
    slices = math.ceil(width / COLUMNS)
    parts = d.n_t * slices

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        level, part = divmod(key[0].as_py(), slices)
        x, keys = _matrix(table.column("v"), width), table.column("key").to_numpy()
        order = np.lexsort((*x.T[::-1], keys))
        columns = list(range(part * COLUMNS, min(width, (part + 1) * COLUMNS)))
        done = learn_in_one(x[order], keys[order], level, columns, d)
        arrays = {n: pa.array([getattr(p, n).tobytes() for p in done], pa.binary()) for n in ("feature", "limit", "value")}
        return pa.table({"level": pa.array([level] * len(done), pa.int32()), "col": pa.array(columns, pa.int32()), "base": pa.array([p.base for p in done]), **arrays})

    copied = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, "part")
    nodes = 2 ** (d.max_depth + 1) - 1
    shaped = lambda raw, kind: np.frombuffer(bytes(raw), kind).reshape(-1, nodes)
    learned = copied.groupBy("part").applyInArrow(learn, "level int, col int, base double, feature binary, limit binary, value binary")
    return {  # a row per booster: the model, whose size the parameters give
        (r["level"], r["col"]): Packed(r["base"], shaped(r["feature"], np.int16), shaped(r["limit"], np.float64), shaped(r["value"], np.float32))
        for r in learned.collect()
    }


def _learn_by_jobs(rows: DataFrame, width: int, d: Diffusion) -> dict[tuple[int, int], Packed]:
    names = [f"f{j}" for j in range(width)]
    kept = Rounds(rows.sparkSession, "noised")
    fields = "row_id string, " + ", ".join(f"{n} double" for n in [*names, *(f"z{j}" for j in range(width))])
    out = {}
    for level in range(d.n_t):

        def noised(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column("key").to_numpy()
                x_t, z = d.noised(_matrix(batch.column("v"), width), keys, level)
                ids = [f"{k}:{c}" for c in range(d.duplicate_K) for k in keys.tolist()]
                numbers = [pa.array(a[:, j], from_pandas=True) for a in (x_t, z) for j in range(width)]  # NaN is null
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *numbers], names=["row_id", *names, *(f"z{j}" for j in range(width))])

        table = kept.write(rows.mapInArrow(noised, fields))
        for j, name in enumerate(names):
            train = table.filter(F.col(name).isNotNull()).select("row_id", F.col(f"z{j}").alias("label"), *names)
            out[level, j] = Packed.of(boosting.fit(train, names, **vars(d.boosted())))
    return out


def _nodes(tree: Tree, x: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row, `depth` levels down at most; `x` has a line per feature.  A split is some passes over bytes."""
    node = np.zeros(x.shape[1], np.uint8 if depth < 8 else np.int32)
    for at in range(2**depth - 1):
        if tree.feature[at] >= 0:
            right = (x[tree.feature[at]] > int(tree.cut[at])).view(np.uint8)  # a Python number, so that bytes are compared
            node += (node == at).view(np.uint8) * (right + node.dtype.type(at + 1))
    return node


def _paired(x: np.ndarray) -> np.ndarray:
    """The bins of two features as one number, a line per pair; a last feature alone is paired with zeros."""
    even = x if len(x) % 2 == 0 else np.vstack([x, np.zeros_like(x[:1])])
    return even[::2] + even[1::2].astype(np.uint16) * np.uint16(BINS)


def _grown(x: np.ndarray, rest: np.ndarray, tree: Tree, level: int, right: np.ndarray | None = None, pairs: np.ndarray | None = None) -> np.ndarray:
    """Sums of gradients and of rows as in `boosting.histograms`, of the rows whose `rest` (label less margin) is known.

    With `right` only one child of each node above is summed, at its parent's place.  One pass takes both sums: a
    gradient is a whole number of 2^-12 and a row 2^35 of them.  As |rest| < 32 and there are at most PACKED_ROWS rows,
    neither reaches into the other, and sums are exact, whatever their order.  In nodes of many rows a pass takes
    two features as well (`pairs`).
    """
    first = 2**level - 1
    wanted = [first + k for k in range(2**level)] if right is None else [first + 2 * k + int(r) for k, r in enumerate(right)]
    pairs = _paired(x) if pairs is None else pairs
    known, node, ones = ~np.isnan(rest), _nodes(tree, x, level), np.ones(BINS)
    both = np.zeros((2 * len(pairs), len(wanted), BINS))
    for k, at in enumerate(wanted):
        here = np.flatnonzero(known & (node == at))
        of = (lambda line: line) if len(here) == len(rest) else (lambda line, here=here: line.take(here))
        w = np.rint(of(rest).astype(np.float64) * -(2.0**12)) + 2.0**35
        if len(here) < MANY_ROWS:
            for f in range(len(x) if len(here) else 0):
                both[f, k] = np.bincount(of(x[f]), w, BINS)
            continue
        for f, pair in enumerate(pairs):
            table = np.bincount(of(pair), w, BINS * BINS).reshape(BINS, BINS)
            both[2 * f, k], both[2 * f + 1, k] = ones @ table, table @ ones
    both = both[: len(x)]
    count = np.floor((both + 2.0**34) / 2.0**35)
    return np.stack([(both - count * 2.0**35) / 2**12, count], 1)


def _points(x: np.ndarray) -> tuple[np.ndarray, float]:
    """At most 8 BINS of the values, evenly spaced in their order, and how many values each stands for."""
    n = min(len(x), 8 * BINS)
    return np.sort(x)[((np.arange(n) + 0.5) * len(x) / max(1, n)).astype(int)], len(x) / max(1, n)


def _learn_together(rows: DataFrame, width: int, d: Diffusion, n: int, together: int) -> dict[tuple[int, int], Packed]:
    """The boosters of all levels over packed rows.

    Where the bins of a level fit a task, one learns some columns from all its packs.  Larger tables have a job for each
    level of the trees of `together` columns: tasks sum over packs, the sums of a booster meet in one task, and the
    driver sees a cut per node.
    """
    s, spark = d.boosted(), rows.sparkSession
    tasks = math.ceil(5 * spark.sparkContext.defaultParallelism / d.n_t)  # of a level, so that few wait for a last one
    packs = tasks * math.ceil(max(1.1 * n * d.duplicate_K / PACKED_ROWS, spark.sparkContext.defaultParallelism) / tasks)
    rows = rows.repartition(packs, "key")

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        size, waiting = max(1, PACKED_ROWS // d.duplicate_K), []

        def noised() -> Iterator[tuple]:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            for low in range(0, whole.num_rows, size):
                part = whole.slice(low, size)
                if part.num_rows < size and not ended:
                    waiting.extend(part.to_batches())
                    return
                x, keys = _matrix(part.column("v"), width), part.column("key").to_numpy()
                for level in range(d.n_t):
                    x_t, z = d.noised(x, keys, level)
                    yield level, x_t, np.where(np.isnan(x_t), np.nan, z)

        ended = False
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= size:
                yield from noised()
        ended = True
        if waiting:
            yield from noised()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for level, x_t, z in copies(batches):
            points, weight = zip(*(_points(a[~np.isnan(a)]) for a in x_t.T), strict=True)
            known = ~np.isnan(z)
            numbers = [pa.array(a) for a in (weight, np.where(known, z, 0.0).sum(0), known.sum(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(width, level, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array([p.tobytes() for p in points], pa.binary()), *numbers],
                names=["level", "col", "points", "weight", "z", "n"],
            )

    def met(key: tuple, table: pa.Table) -> pa.Table:
        points = [np.frombuffer(p) for p in table.column("points").to_pylist()]
        x, w = np.concatenate(points), np.repeat(table.column("weight").to_numpy(), [len(p) for p in points])
        order = np.argsort(x, kind="stable")
        at = np.searchsorted(np.cumsum(w[order]), np.arange(1, BINS) / BINS * w.sum())
        base = table.column("z").to_numpy().sum() / max(1, table.column("n").to_numpy().sum())
        return pa.table({"level": [key[0]], "col": [key[1]], "base": [base], "cuts": [x[order][np.minimum(at, len(x) - 1)]]}, pa.schema([("level", pa.int32()), ("col", pa.int32()), ("base", pa.float64()), ("cuts", pa.list_(pa.float64()))]))

    seen = rows.mapInArrow(listed, "level int, col int, points binary, weight double, z double, n long")
    cuts, base = np.full((d.n_t, width, BINS - 1), np.inf), np.zeros((d.n_t, width))
    for r in seen.groupBy("level", "col").applyInArrow(met, "level int, col int, base double, cuts array<double>").collect():  # a row per booster
        base[r["level"], r["col"]] = r["base"]
        distinct = np.unique(r["cuts"])
        cuts[r["level"], r["col"], : len(distinct)] = distinct
    told, out = spark.sparkContext.broadcast((cuts, base)), {}
    if together >= width and n * width * d.duplicate_K <= BINNED_ENTRIES:
        groups = [list(range(low, min(width, low + BINNED_COLUMNS))) for low in range(0, width, BINNED_COLUMNS)]
        return _boost_in_tasks(_packed(rows, copies, told, groups, s, d.n_t, 1), groups, cuts, base, d, width)
    for low in range(0, width, together):
        columns = list(range(low, min(width, low + together)))
        out |= _boost_together(_packed(rows, copies, told, [columns], s, d.n_t, tasks), columns, cuts, base, d, width)
    return out


def _packed(rows: DataFrame, copies, told, groups: list[list[int]], s: Settings, levels: int, tasks: int) -> RDD:
    """(level, x, rest): the bins of packed rows, a line per feature, and label less margin, a line per column of a group; NaN where unknown.

    Each level has `tasks` partitions of its own for each group of columns.
    """
    own = len(groups) * tasks

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, base = told.value
        part = TaskContext.get().partitionId() % tasks
        for level, x_t, z in copies(batches):
            x, rest = Booster(cuts[level], 0.0, s).binned(x_t).T.tobytes(), (z - base[level]).T.astype(np.float32)
            for k, columns in enumerate(groups):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([level * own + k * tasks + part], pa.int32()), pa.array([x], pa.binary()), pa.array([rest[columns].tobytes()], pa.binary())], names=["part", "x", "rest"]
                )

    dealt = rows.mapInArrow(packed, "part int, x binary, rest binary").rdd.map(lambda r: (r.part, (r.part // own, bytes(r.x), bytes(r.rest))))
    return dealt.partitionBy(levels * own, int).values()


def _boost_in_tasks(packed: RDD, groups: list[list[int]], cuts: np.ndarray, base: np.ndarray, d: Diffusion, width: int) -> dict[tuple[int, int], Packed]:
    """As `_boost_together`, with the same trees: a partition has all packs of a level, and learns the columns of a group one after another."""
    s = d.boosted()

    def learn(part: int, packs: Iterator[tuple]) -> Iterator[tuple]:
        columns, held = groups[part % len(groups)], []
        for level, raw, rest in packs:
            x = np.frombuffer(raw, np.uint8).reshape(width, -1)
            held.append((x, np.frombuffer(rest, np.float32).reshape(len(columns), -1)))
        for c, j in enumerate(columns if held else []):
            booster, own = Booster(cuts[level], float(base[level, j]), s), []
            for x, rest in held:  # the rows that the column is known of
                here = np.flatnonzero(~np.isnan(rest[c]))
                seen = x.take(here, axis=1)
                own.append((seen, _paired(seen), rest[c].take(here)))
            for k in range(s.rounds):
                tree, right, whole = Tree.of_depth(s.depth), None, None
                for depth in range(s.depth):
                    sums = sum(_grown(x, rest, tree, depth, right, pairs) for x, pairs, rest in own)
                    whole = boosting.siblings(tree, depth, whole, sums, right) if depth else sums
                    found = boosting.chosen(boosting.all_cuts(np.arange(width), whole, s))
                    if not boosting.grow_to(tree, depth, found, s):
                        break
                    right = found[:, 6] - found[:, 4] < found[:, 4]
                booster.trees.append(tree)
                for x, _, rest in own if k < s.rounds - 1 else ():
                    rest -= tree.value.astype(np.float32).take(_nodes(tree, x, s.depth))
            yield (level, j), Packed.of(booster)

    return dict(packed.mapPartitionsWithIndex(learn).collect())  # a row per booster: the model, whose size the parameters give


def _boost_together(packed: RDD, columns: list[int], cuts: np.ndarray, base: np.ndarray, d: Diffusion, width: int) -> dict[tuple[int, int], Packed]:
    """Packs lie in the executors' storage, as in `boosting.boost_by_jobs`, and so do the sums of the level above."""
    s, sc = d.boosted(), packed.context
    each = [(level, j) for level in range(d.n_t) for j in columns]
    boosters = {at: Booster(cuts[at[0]], float(base[at]), s) for at in each}
    held = [packed.persist(StorageLevel.MEMORY_AND_DISK)]  # the last two states of the margins
    tasks = min(len(each), sc.defaultParallelism)

    def opened(pack: tuple) -> tuple[int, np.ndarray, np.ndarray]:
        level, x, rest = pack
        return level, np.frombuffer(x, np.uint8).reshape(width, -1), np.frombuffer(rest, np.float32).reshape(len(columns), -1)

    def summed(depth: int, trees: dict[tuple[int, int], Tree], right: dict[tuple[int, int], np.ndarray], above: RDD | None) -> RDD:
        """((level, column), sums) of the nodes of a depth; beneath the first, of two children the one with fewer rows is summed."""
        sent = sc.broadcast((trees, right))

        def sums(packs: Iterator[tuple]) -> Iterator[tuple]:
            trees, right = sent.value
            whole: dict[tuple[int, int], np.ndarray] = {}
            for pack in packs:  # of one level
                level, x, rest = opened(pack)
                pairs = _paired(x)
                for k, j in enumerate(columns):
                    if at := (level, j) if (level, j) in trees else None:
                        part = _grown(x, rest[k], trees[at], depth, right.get(at), pairs)
                        whole[at] = whole[at] + part if at in whole else part
            yield from ((at[0] * width + at[1], (at, False, part.tobytes())) for at, part in whole.items())

        def met(parts: Iterator[tuple]) -> Iterator[tuple]:
            trees, right = sent.value
            own, before = {}, {}
            for _, (at, is_above, raw) in parts:
                part = np.frombuffer(raw).reshape(width, 2, -1, BINS)
                if is_above:
                    before[at] = part
                else:
                    own[at] = own[at] + part if at in own else part
            for at, part in own.items():
                yield at, boosting.siblings(trees[at], depth, before[at], part, right[at]) if depth else part

        parts = held[-1].mapPartitions(sums)
        if above is not None:
            parts = sc.union([parts, above.map(lambda kv: (kv[0][0] * width + kv[0][1], (kv[0], True, kv[1].tobytes())))])
        return parts.partitionBy(tasks, int).mapPartitions(met).persist(StorageLevel.MEMORY_AND_DISK)

    for k in range(s.rounds):
        trees = {at: Tree.of_depth(s.depth) for at in each}
        growing, right, above = trees, {}, None
        for depth in range(s.depth):
            sums = summed(depth, growing, right, above)
            found = sums.mapValues(lambda x: boosting.chosen(boosting.all_cuts(np.arange(width), x, s))).collect()  # a row per booster
            if above is not None:
                above.unpersist()
            growing = {at: trees[at] for at, cut in found if boosting.grow_to(trees[at], depth, cut, s)}
            right, above = {at: cut[:, 6] - cut[:, 4] < cut[:, 4] for at, cut in found}, sums
            if not growing:
                break
        above.unpersist()
        for at, tree in trees.items():
            boosters[at].trees.append(tree)
        if k == s.rounds - 1:
            break
        sent = sc.broadcast(trees)

        def moved(pack: tuple, sent=sent) -> tuple:
            level, x, rest = opened(pack)
            rest = rest.copy()
            for c, j in enumerate(columns):
                tree = sent.value[level, j]
                rest[c] -= tree.value.astype(np.float32).take(_nodes(tree, x, s.depth))
            return level, pack[1], rest.tobytes()

        held.append(held[-1].map(moved).persist(StorageLevel.MEMORY_AND_DISK))
        while len(held) > 2:
            held.pop(0).unpersist()
    for state in held:
        state.unpersist()
    return {at: Packed.of(b) for at, b in boosters.items()}


def fill(x: np.ndarray, keys: np.ndarray, model: dict[tuple[int, int], Packed], d: Diffusion, imputation: int) -> np.ndarray:
    """Scaled rows with their missing cells drawn."""
    hidden, width = np.isnan(x), x.shape[1]
    at = [np.flatnonzero(hidden[:, j]) for j in range(width)]
    y = d.noise(keys, width, "begin", imputation)
    for level in reversed(range(d.n_t)):
        m, s = d.scale(level)
        for again in range(d.r):
            y = np.where(hidden, y, m * x + s * d.noise(keys, width, "seen", imputation, level, again))
            guess = y.copy()
            for j in range(width):
                if len(at[j]):
                    z = model[level, j].predict(y[at[j]], d.max_depth)
                    guess[at[j], j] = np.clip((y[at[j], j] - s * z) / m, -1, 1)
            if not level:
                y = guess
                continue
            m_next, s_next = d.scale(level - 1)
            a = m / m_next
            spread = 1 - a * a
            y = (m_next * spread * guess + a * s_next**2 * y) / s**2 + math.sqrt(spread) * s_next / s * d.noise(keys, width, "down", imputation, level, again)
            if again < d.r - 1:
                y = a * y + math.sqrt(spread) * d.noise(keys, width, "up", imputation, level, again)
    return np.where(hidden, y, x)


def _one_run(one: DataFrame, k: int, d: Diffusion) -> DataFrame:
    """(row_id, col_id, imputation_id, drawn) of the missing cells of a run."""
    stats = one.groupBy("col_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.count_if(F.col("value").isNull()).alias("holes"))
    stats = sorted(stats.limit(MOST_COLUMNS + 1).collect(), key=lambda r: r.col_id)
    if len(stats) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    known = [r.mean for r in stats if r.mean is not None]
    rest = sum(known) / len(known) if known else 0.0
    live = [r for r in stats if r.mean is not None and r.low < r.high]
    fixed = {r.col_id: rest if r.mean is None else r.low for r in stats if r.holes and (r.mean is None or r.low == r.high)}
    parts, spark = [], one.sparkSession
    holes = one.filter("value IS NULL").select(*AT)
    times = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("imputation_id")
    if fixed:
        parts.append(holes.filter(F.col("col_id").isin(list(fixed))).select(*AT, times, F.element_at(F.create_map(*[F.lit(e) for kv in fixed.items() for e in kv]), F.col("col_id")).alias("drawn")))
    if any(r.holes for r in live):
        scaled = [((F.col(str(r.col_id)) - r.low) / (r.high - r.low) * 2 - 1).cast("double") for r in live]
        rows = one.groupBy("row_id").pivot("col_id", [r.col_id for r in live]).agg(F.first("value", ignorenulls=True))
        rows = cut_lineage(rows.select("row_id", F.xxhash64("row_id").alias("key"), F.array(*scaled).alias("v")))
        width, n = len(live), rows.count()
        few = n * width * d.duplicate_K <= boosting.FEW_ENTRIES
        together = boosting.FEW_ENTRIES // (width * 2**d.max_depth * BINS)  # columns whose histograms a task holds
        table = rows.select("key", "v")
        model = _learn_together(table, width, d, n, together) if together and not few else (_learn_in_tasks if few else _learn_by_jobs)(table, width, d)
        sent = spark.sparkContext.broadcast(model)
        low, size = np.array([r.low for r in live], float), np.array([r.high - r.low for r in live], float)
        ids = np.array([r.col_id for r in live])

        def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, keys = _matrix(batch.column("v"), width), batch.column("key").to_numpy()
                row, col = np.nonzero(np.isnan(x))
                for i in range(k if len(row) else 0):
                    y = low + (fill(x, keys, sent.value, d, i) + 1) / 2 * size
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row_id").take(pa.array(row)), pa.array(ids[col], pa.int64()), pa.array([i] * len(row), pa.int32()), pa.array(y[row, col])],
                        names=["row_id", "col_id", "imputation_id", "drawn"],
                    )

        kind = one.schema["row_id"].dataType.simpleString()
        tasks = max(2 * spark.sparkContext.defaultParallelism, n * width * k >> 20)
        drawn = rows.repartition(tasks, "key").mapInArrow(filled, f"row_id {kind}, col_id bigint, imputation_id int, drawn double")
        parts.append(drawn)
    if not parts:
        return holes.select(*AT, times, F.lit(0.0).alias("drawn")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def diffusion_draws(cells: DataFrame, keys=KEYS, k: int = 5, **settings) -> DataFrame:
    """The cells of each run `k` times, with `imputation_id` 0 to k - 1 and `pred`: the value, or a draw for a missing one.

    Draws lie between the least and the largest value of their column.  A constant column is filled with its value, a
    column without values with the mean of the column means (0 without any).  A row without values is drawn from the whole table's
    distribution.  A run in which nothing is missing keeps its values; an empty table gives no rows.
    `settings` are the fields of `Diffusion`.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    d, parts = Diffusion(**settings), []
    times = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    for run in cells.select(*keys).distinct().collect():  # boosters are fitted for each run
        one = cells.filter(reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(run[c]) for c in keys]))
        every = one.withColumn("imputation_id", times)
        parts.append(every.join(_one_run(one, k, d), [*AT, "imputation_id"], "left").withColumn("pred", F.coalesce("value", "drawn")).drop("drawn"))
    if not parts:
        return cells.withColumn("imputation_id", times).withColumn("pred", F.col("value"))
    return reduce(DataFrame.unionByName, parts).select(*cells.columns, "imputation_id", "pred")


@IMPUTERS.register("forest_diffusion")
def forest_diffusion(cells: DataFrame, keys=KEYS, k: int = 1, **settings) -> DataFrame:
    """`pred` is the mean of `k` draws of each missing cell; see `diffusion_draws`."""
    x = diffusion_draws(cells, keys, k, **settings)
    if k == 1:
        return x.drop("imputation_id")
    mean = x.filter("value IS NULL").groupBy(*keys, *AT).agg(F.avg("pred").alias("__mean"))
    return cells.join(mean, [*keys, *AT], "left").withColumn("pred", F.coalesce("value", "__mean")).select(*cells.columns, "pred")
