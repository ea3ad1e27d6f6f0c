"""Second-order boosted trees over binned features: one job for each level of a tree.

Features are cut into at most BINS bins by their quantiles, once.  For each level
every task sums gradients and curvatures by node, feature and bin.  Up to SENT
bytes of all tasks meet on the driver; of larger ones the sums of a feature meet in
a task, where its best split of each node is found, and the driver sees these.  Of
two children the lighter is summed, the other is what is left of the parent (not
in the larger case).  The driver never sees a row.  Rows and columns are drawn anew
for each tree, rows by a hash of their key.

Rows lie in packs, a feature after another, in the executors' storage; margins
are renewed there every WRITTEN trees, and in between tasks add the trees that
are newer.  A table of up to FEW_ENTRIES entries is boosted in one task by the
same steps.  Gradients are rounded to a unit that makes their sums exact, so
neither the tasks nor their order change a tree.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 128
#: Entries (rows x features) of a table that one task holds.
FEW_ENTRIES = 1 << 23
WRITTEN = 8
#: Bytes of all tasks' sums of a level that the driver adds.
SENT = 1 << 26
#: Entries of a pack.
PACK = 1 << 22


@dataclass
class Settings:
    task: str = "classification"
    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.9
    columns: float = 0.9
    l2: float = 1.0
    least_curvature: float = 1.0
    seed: int = 0


@dataclass
class Tree:
    """Nodes in the order of a heap; a leaf has feature -1.  A row goes right where its bin is over the cut."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n))

    def step(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The next node of each row; leaves stay."""
        feature = self.feature[node]
        return np.where(feature >= 0, 2 * node + 1 + (x[np.arange(len(x)), feature] > self.cut[node]), node)

    def node_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (self.feature[node] >= 0).any():
            node = self.step(x, node)
        return node


@dataclass
class Booster:
    cuts: np.ndarray  # features x (bins - 1), ascending, filled up with infinity
    base: float
    settings: Settings
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1).astype(np.uint8) if len(x) else np.zeros(x.shape, np.uint8)

    def margin(self, binned: np.ndarray, begin: int = 0) -> np.ndarray:
        out = np.zeros(len(binned))
        for t in self.trees[begin:]:
            out += t.value[t.node_of(binned)]
        return out


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """A uniform number for each key, another for each salt."""
    x = keys.view(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(float) / 2**53


def slopes(margin: np.ndarray, y: np.ndarray, task: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss: logistic, or half the squared error."""
    if task == "regression":
        return margin - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-margin))
    return p - y, np.maximum(p * (1 - p), 1e-16)


def unit(n: int, low: float, high: float, base: float, task: str) -> float:
    """A power of two: sums of n gradients in multiples of it are exact, as long as these keep to four times their first range."""
    size = 1.0 if task == "classification" else max(high - base, base - low, 1e-200)
    size = size if math.isfinite(size) else 1.0
    return 2.0 ** (math.ceil(math.log2(size)) + math.ceil(math.log2(n)) - 50)


def rounded_slopes(margin: np.ndarray, y: np.ndarray, task: str, unit: float) -> tuple[np.ndarray, np.ndarray]:
    g, h = slopes(margin, y, task)
    return np.round(g / unit) * unit, h if task == "regression" else np.round(h / unit) * unit


def bin_sums(columns: np.ndarray, g: np.ndarray, h: np.ndarray, place: np.ndarray, n: int, features: np.ndarray, rows: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Sums of g and h: features x 2 x n places x bins; `columns` are features x rows, the others those of `rows`."""
    first, at = place * bins, np.empty(len(place), np.int64)
    out = np.empty((len(features), 2, n, bins))
    for k, f in enumerate(features):
        np.add(first, columns[f][rows], out=at)
        for i, w in enumerate((g, h)):
            out[k, i] = np.bincount(at, w, n * bins).reshape(n, bins)
    return out


def histograms(binned: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray, level: int, features: np.ndarray, bins: int) -> np.ndarray:
    """Sums of g and h: features x 2 x nodes of the level x bins."""
    first, n = 2**level - 1, 2**level
    here = np.flatnonzero((node >= first) & (node < first + n))
    return bin_sums(binned.T, g[here], h[here], node[here] - first, n, features, here, bins)


def best_cuts(sums: np.ndarray, s: Settings) -> np.ndarray:
    """For each node of one feature's sums (2 x nodes x bins): gain, cut, and g and h left and in all; a gain of -inf where no cut may be."""
    g, h = sums
    left_g, left_h = np.cumsum(g, 1), np.cumsum(h, 1)
    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + s.l2) + right_g**2 / (right_h + s.l2) - all_g**2 / (all_h + s.l2)
    gain = np.where((left_h >= s.least_curvature) & (right_h >= s.least_curvature), gain, -np.inf)
    cut = gain.argmax(1)
    at = np.arange(len(g))
    return np.stack([gain[at, cut], cut, left_g[at, cut], left_h[at, cut], all_g[:, 0], all_h[:, 0]], 1)


def all_cuts(features: np.ndarray, sums: np.ndarray, s: Settings) -> dict[int, np.ndarray]:
    """`best_cuts` of each feature of sums as `bin_sums` gives them."""
    n = sums.shape[2]
    found = best_cuts(sums.swapaxes(0, 1).reshape(2, -1, BINS), s)
    return dict(zip(features.tolist(), found.reshape(-1, n, 6), strict=True))


def lighter(tree: Tree, level: int, features: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Whether the right child of each node above the level has less curvature than the left one; `sums` are those nodes'."""
    n = 2 ** (level - 1)
    at, above = np.arange(n), slice(n - 1, 2 * n - 1)
    left = np.cumsum(sums[np.searchsorted(features, tree.feature[above]), 1, at], 1)
    return left[:, -1] - left[at, tree.cut[above]] < left[at, tree.cut[above]]


def among(level: int, node: np.ndarray, drawn: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The drawn rows to sum and the places of their nodes: all of the level, or of two children the lighter, at its parent's place."""
    place = node[drawn] - (2**level - 1)  # below 0 in leaves
    if right is None:
        here = place >= 0
        return drawn[here], place[here]
    here = (place >= 0) & (right[place // 2] == place % 2)
    return drawn[here], place[here] // 2


def siblings(tree: Tree, level: int, sums: np.ndarray, part: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sums of a level from those of the level before and of the lighter children."""
    n = 2 ** (level - 1)
    rest = np.where((tree.feature[n - 1 : 2 * n - 1] >= 0)[:, None], sums - part, 0.0)
    pairs = np.stack([np.where(right[:, None], rest, part), np.where(right[:, None], part, rest)], 3)
    return pairs.reshape(len(sums), 2, 2 * n, BINS)


def chosen(cuts: dict[int, np.ndarray]) -> np.ndarray:
    """For each node its best cut of all features', of equal ones that of the first feature: the feature, and what `best_cuts` gives."""
    features = sorted(cuts)
    table = np.stack([cuts[f] for f in features])  # features x nodes x 6
    best = np.round(table[:, :, 0], 9).argmax(0)
    return np.column_stack([np.array(features, float)[best], table[best, np.arange(table.shape[1])]])


def grow_to(tree: Tree, level: int, found: np.ndarray, s: Settings) -> bool:
    """Splits the nodes of a level at the cuts that `chosen` found; whether there was one."""
    first, split = 2**level - 1, False
    for k in range(2**level):
        node = first + k
        if level and tree.feature[(node - 1) // 2] < 0:
            continue
        feature, gain, cut, left_g, left_h, all_g, all_h = found[k]
        if not level:
            tree.value[node] = -s.rate * all_g / (all_h + s.l2)
        if gain > 1e-9:
            split = True
            tree.feature[node], tree.cut[node] = int(feature), int(cut)
            tree.value[2 * node + 1] = -s.rate * left_g / (left_h + s.l2)
            tree.value[2 * node + 2] = -s.rate * (all_g - left_g) / (all_h - left_h + s.l2)
    return split


def grow(tree: Tree, level: int, cuts: dict[int, np.ndarray], s: Settings) -> bool:
    """Splits the nodes of a level at their best cuts; whether there was one."""
    return grow_to(tree, level, chosen(cuts), s)


def _boost(booster: Booster, width: int, cuts_of: Callable[[int, Tree, int, np.ndarray], dict[int, np.ndarray]], done: Callable[[], None]) -> None:
    s = booster.settings
    for k in range(s.rounds):
        rng = np.random.default_rng((s.seed, k))
        features = np.sort(rng.permutation(width)[: max(1, round(s.columns * width))])
        tree = Tree.of_depth(s.depth)
        for level in range(s.depth):
            if not grow(tree, level, cuts_of(k, tree, level, features), s):
                break
        booster.trees.append(tree)
        done()


def boost_in_one(booster: Booster, binned: np.ndarray, y: np.ndarray, keys: np.ndarray) -> Booster:
    s, margin = booster.settings, np.full(len(y), booster.base)
    x, least = np.ascontiguousarray(binned.T), unit(len(y), y.min(), y.max(), booster.base, s.task)
    g = h = drawn = node = sums = now = None

    def cuts_of(k: int, tree: Tree, level: int, features: np.ndarray) -> dict[int, np.ndarray]:
        nonlocal g, h, drawn, node, sums, now
        if not level:
            now, node, right = tree, np.zeros(len(y), np.int64), None
            drawn = np.flatnonzero(mixed(keys, k) < s.rows)
            g, h = rounded_slopes(margin, y, s.task, least)
        else:
            node, right = tree.step(x.T, node), lighter(tree, level, features, sums)
        rows, place = among(level, node, drawn, right)
        part = bin_sums(x, g[rows], h[rows], place, max(1, 2**level // 2), features, rows)
        sums = siblings(tree, level, sums, part, right) if level else part
        return all_cuts(features, sums, s)

    def done() -> None:
        nonlocal margin
        margin = margin + now.value[now.step(x.T, node)]

    _boost(booster, binned.shape[1], cuts_of, done)
    return booster


def boost_by_jobs(booster: Booster, rows: DataFrame, width: int, least: float) -> Booster:
    """As `boost_in_one`, over rows (key, y, x as bytes of bins); `least` is the unit of gradients."""
    s, sc = booster.settings, rows.sparkSession.sparkContext
    most, base = max(1, PACK // width), booster.base

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def pack() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.uint8).reshape(-1, width)
            whole = (table.column("key").to_numpy(), table.column("y").to_numpy(), x.T, np.full(len(x), base))
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in whole], names=["key", "y", "x", "margin"])

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= most:
                yield pack()
                waiting.clear()
        if waiting:
            yield pack()

    tasks = sc.defaultParallelism
    packs = rows.repartition(tasks, "key").mapInArrow(packed, "key binary, y binary, x binary, margin binary")
    held = [packs.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)]  # the last two states of the margins
    written, whole = 0, None

    def opened(pack: tuple[bytes, ...], trees: list[Tree]) -> tuple[np.ndarray, ...]:
        """(keys, y, columns, margin) with the margins of `trees` added."""
        key, y, x, margin = (np.frombuffer(b, kind) for b, kind in zip(pack, (np.int64, float, np.uint8, float), strict=True))
        x = x.reshape(width, -1)
        for t in trees:  # one by one, so that sums round as in one task
            margin = margin + t.value[t.node_of(x.T)]
        return key, y, x, margin

    def cuts_of(k: int, tree: Tree, level: int, features: np.ndarray) -> dict[int, np.ndarray]:
        nonlocal whole
        newer, size = booster.trees[written:], max(1, 2**level // 2)
        together = len(features) * 2 * size * BINS * 8 * tasks <= SENT
        right = lighter(tree, level, features, whole) if together and level else None
        size = size if together else 2**level

        def sums(packs: Iterator[tuple]) -> Iterator[tuple[int, bytes]]:
            out = None
            for pack in packs:
                key, y, x, margin = opened(pack, newer)
                g, h = rounded_slopes(margin, y, s.task, least)
                rows, place = among(level, tree.node_of(x.T), np.flatnonzero(mixed(key, k) < s.rows), right)
                part = bin_sums(x, g[rows], h[rows], place, size, features, rows)
                out = part if out is None else out + part
            if out is not None:
                yield from [(0, out.tobytes())] if together else ((int(f), one.tobytes()) for f, one in zip(features, out, strict=True))

        def cuts(parts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
            sums_of: dict[int, np.ndarray] = {}
            for f, part in parts:
                sums_of[f] = sums_of.get(f, 0) + np.frombuffer(part).reshape(2, size, BINS)
            yield from ((f, best_cuts(one, s)) for f, one in sums_of.items())

        summed = held[-1].mapPartitions(sums)
        if not together:
            return dict(summed.partitionBy(min(len(features), tasks), int).mapPartitions(cuts).collect())  # a row per feature
        part = sum(np.frombuffer(b) for _, b in summed.collect()).reshape(len(features), 2, size, BINS)  # a row per task
        whole = siblings(tree, level, whole, part, right) if level else part
        return all_cuts(features, whole, s)

    def done() -> None:
        nonlocal written
        if len(booster.trees) - written < WRITTEN:
            return
        newer, written = sc.broadcast(booster.trees[written:]), len(booster.trees)

        def moved(pack: tuple[bytes, ...]) -> tuple[bytes, ...]:
            return (*pack[:3], opened(pack, newer.value)[3].tobytes())

        held.append(held[-1].map(moved).persist(StorageLevel.MEMORY_AND_DISK))
        while len(held) > 2:
            held.pop(0).unpersist()

    _boost(booster, width, cuts_of, done)
    for state in held:
        state.unpersist()
    return booster


def fit(train: DataFrame, features: list[str], **settings) -> Booster:
    """The booster of rows (row_id, label, features); a label is 0 or 1, or any number in regression."""
    s, width = Settings(**settings), len(features)
    about = train.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean"), F.min("label").alias("low"), F.max("label").alias("high")).first()
    if not about.n:
        raise ValueError("no rows to learn from")
    if s.task == "classification":
        if not {about.low, about.high} <= {0.0, 1.0}:
            raise ValueError("labels must be 0 or 1")
        p = min(max(about.mean, 1e-6), 1 - 1e-6)
        base = float(np.log(p / (1 - p)))
    else:
        base = float(about.mean)
    places = [k / BINS for k in range(1, BINS)]
    cuts = np.full((width, BINS - 1), np.inf)
    for j, q in enumerate(train.approxQuantile(features, places, 1 / (8 * BINS))):  # sketches of bounded size
        distinct = np.unique(q)
        cuts[j, : len(distinct)] = distinct
    booster = Booster(cuts, base, s)
    listed = train.select(F.xxhash64("row_id").alias("key"), F.col("label").cast("double").alias("y"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    sent = train.sparkSession.sparkContext.broadcast(booster)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = sent.value.binned(batch.column("v").values.to_numpy(zero_copy_only=False).reshape(-1, width)) if batch.num_rows else np.zeros((0, width), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "y", "x"])

    rows = listed.mapInArrow(binned, "key long, y double, x binary")
    if about.n * width > FEW_ENTRIES:
        return boost_by_jobs(booster, rows, width, unit(about.n, about.low, about.high, base, s.task))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts := list(batches):
            table = pa.Table.from_batches(parts).sort_by("key")
            done = boost_in_one(sent.value, np.frombuffer(b"".join(table.column("x").to_pylist()), np.uint8).reshape(-1, width), table.column("y").to_numpy(), table.column("key").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(done.trees)], pa.binary())], names=["trees"])

    booster.trees = pickle.loads(bytes(rows.coalesce(1).mapInArrow(whole, "trees binary").first().trees))
    return booster


def predict(booster: Booster, rows: DataFrame, features: list[str]) -> DataFrame:
    """(row_id, label, pred, score): the class and its probability, or the number twice."""
    sent, width = rows.sparkSession.sparkContext.broadcast(booster), len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = sent.value
            x = batch.column("v").values.to_numpy(zero_copy_only=False).reshape(-1, width) if batch.num_rows else np.zeros((0, width))
            margin = b.base + b.margin(b.binned(x))
            score = margin if b.settings.task == "regression" else 1 / (1 + np.exp(-margin))
            pred = score if b.settings.task == "regression" else (score > 0.5).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("label"), pa.array(pred), pa.array(score)], names=["row_id", "label", "pred", "score"])

    listed = rows.select("row_id", F.col("label").cast("double").alias("label"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    kind = rows.schema["row_id"].dataType.simpleString()
    return listed.mapInArrow(run, f"row_id {kind}, label double, pred double, score double")
