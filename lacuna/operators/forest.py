"""Random forests whose trees stay on the executors: fitted and applied in one pass, no tree reaches the driver.

Settings are MLlib's: BINS bins a feature, Poisson bags, the square root of the features at each node (a third in
regression), Gini's impurity or the variance.  Rows are packed, and sent to the trees whose bags hold them.  A node with
more rows than a task holds (`boosting.FEW_ENTRIES` entries) is split by a job over all packs; below it a task grows the
rest, and test rows, which take the same way, meet the finished part there and leave as sums a pack.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import boosting
from lacuna.operators.boosting import mixed
from lacuna.sources.tables import cut_lineage

BINS = 32
#: Rows of a pack, and nodes whose histograms are taken at a time.
PACK, NODES = 2048, 2048
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def bag(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's bag holds each row."""
    return np.searchsorted(_POISSON, mixed(keys, (seed << 20) + tree + 1), side="right")


def best(sums: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """(feature's place, cut, gain) of each node: sums is channels x nodes x features x bins, count lacks the channels."""
    left, n = np.cumsum(sums, -1), np.cumsum(count, -1)
    whole, all_n = left[..., -1:], n[..., -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left**2).sum(0) / n + ((whole - left) ** 2).sum(0) / (all_n - n) - (whole**2).sum(0) / all_n
    gain = np.where((n > 0) & (n < all_n), gain, -np.inf).reshape(len(n), -1)
    at = np.round(gain, 9).argmax(1)
    return at // BINS, at % BINS, gain[np.arange(len(at)), at]


def histograms(x: np.ndarray, rows: np.ndarray, node: np.ndarray, chosen: np.ndarray, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each channel, and of weights: nodes x chosen features x bins."""
    n, k = chosen.shape
    at = ((node[:, None] * k + np.arange(k)) * BINS + x[rows[:, None], chosen[node]]).ravel()
    take = lambda a: np.bincount(at, np.repeat(a, k), n * k * BINS).reshape(n, k, BINS)
    return np.stack([take(c) for c in v]), take(w)


def grow(x: np.ndarray, w: np.ndarray, v: np.ndarray, tries: int, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(feature, cut, left child, channel means) by node; feature -1 is a leaf, the right child follows the left one."""
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    features, cuts, lefts, values = [], [], [], []
    size, made = 1, 1
    for level in range(depth + 1):
        total = np.bincount(node, w[rows], size)
        values.append(np.stack([np.bincount(node, c[rows], size) for c in v], 1) / np.maximum(total, 1e-300)[:, None])
        feature, cut = np.full(size, -1, np.int32), np.zeros(size, np.uint8)
        if level < depth:
            ends = np.searchsorted(node, np.arange(0, size + NODES, NODES))
            for k, low in enumerate(range(0, size, NODES)):
                n = min(NODES, size - low)
                chosen = np.argsort(rng.random((n, x.shape[1])), 1)[:, :tries]
                here = rows[ends[k] : ends[k + 1]]
                place, at, gain = best(*histograms(x, here, node[ends[k] : ends[k + 1]] - low, chosen, w[here], v[:, here]))
                split = np.flatnonzero(gain > 1e-9)
                feature[low + split], cut[low + split] = chosen[split, place[split]], at[split]
        splits = feature >= 0
        left = np.where(splits, made + 2 * (np.cumsum(splits) - 1), -1)
        features.append(feature)
        cuts.append(cut)
        lefts.append(left)
        if not splits.any():
            break
        live = splits[node]
        rows, node = rows[live], node[live]
        node = left[node] - made + (x[rows, feature[node]] > cut[node])
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        size = 2 * int(splits.sum())
        made += size
    return tuple(np.concatenate(a) for a in (features, cuts, lefts, values))


def leaf_of(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    while (inner := np.flatnonzero(feature[node] >= 0)).size:
        at = node[inner]
        node[inner] = left[at] + (x[inner, feature[at]] > cut[at])
    return node


def _way(top: dict[int, tuple[int, int]], x: np.ndarray) -> dict[int, np.ndarray]:
    """The places of rows by the node in which they leave the upper part of a tree; children of k are 2k + 1 and 2k + 2."""
    out, at = {}, {0: np.arange(len(x))}
    while at:
        node, here = at.popitem()
        if node not in top:
            out[node] = here
            continue
        right = x[here, top[node][0]] > top[node][1]
        at[2 * node + 1], at[2 * node + 2] = here[~right], here[right]
    return {k: v for k, v in out.items() if len(v)}


def _array(batch: pa.RecordBatch, i: int, name: str, kind) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), kind)


def _pack(rows: DataFrame, features: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """(pack, row_ids, labels, keys, x) of at most PACK rows, written once, as packs are named by their task and place."""
    sent, width = rows.sparkSession.sparkContext.broadcast(cuts), len(features)
    kind = rows.schema["row_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low in range(0, batch.num_rows, PACK):
                one = batch.slice(low, PACK)
                v = one.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                x = np.stack([np.searchsorted(c, v[:, j], side="left") for j, c in enumerate(sent.value)], 1).astype(np.uint8)
                ids = pa.ListArray.from_arrays(pa.array([0, one.num_rows], pa.int32()), one.column("row_id"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), ids, pa.array([one.column("label").to_numpy(zero_copy_only=False).tobytes()]), pa.array([one.column("key").to_numpy().tobytes()]), pa.array([x.tobytes()])],
                    names=["pack", "row_ids", "labels", "keys", "x"],
                )
                number += 1

    listed = rows.select("row_id", F.col("label").cast("double").alias("label"), F.xxhash64("row_id").alias("key"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    return cut_lineage(listed.mapInArrow(packed, f"pack long, row_ids array<{kind}>, labels binary, keys binary, x binary"), "packs")


def predict(train: DataFrame, test: DataFrame, features: list[str], task: str, trees: int = 300, depth: int = 30, seed: int = 0) -> DataFrame:
    """(row_id, label, pred, score) of the test rows: the likeliest class and the share of class 1, or the mean of the trees twice."""
    spark, width = train.sparkSession, len(features)
    about = train.agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("high"), F.min("label").alias("low")).first()
    if task == "classification" and about.low < 0:
        raise ValueError("classes must be 0 or more")
    classes = int(about.high) + 1 if task == "classification" else 0
    classes = max(classes, 2) if classes else 0
    tries = min(width, math.ceil(math.sqrt(width)) if classes else max(1, math.ceil(width / 3)))
    cuts = [np.unique(q) for q in train.approxQuantile(features, [k / BINS for k in range(1, BINS)], 1 / (8 * BINS))]  # sketches of bounded size
    learn, ask = _pack(train, features, cuts), _pack(test, features, cuts)
    most = max(2, boosting.FEW_ENTRIES // width)

    def channels(w: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([w * (y == c) for c in range(classes)]) if classes else (w * y)[None]

    tasks = 2 * spark.sparkContext.defaultParallelism
    tops: dict[int, dict[int, tuple[int, int]]] = {t: {} for t in range(trees)}
    large = {(t, 0) for t in range(trees)} if about.n > most else set()
    for level in range(depth):
        if not large:
            break
        sent = spark.sparkContext.broadcast((tops, large))

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tops, large = sent.value
            whole: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    y, keys, x = _array(batch, i, "labels", float), _array(batch, i, "keys", np.int64), _array(batch, i, "x", np.uint8).reshape(-1, width)
                    for t, top in tops.items():
                        w = bag(keys, t, seed).astype(float)
                        for node, here in _way(top, x).items():
                            if (t, node) in large:
                                chosen = np.random.default_rng((seed, t, node, 1)).permutation(width)[None, :tries]
                                v, n = histograms(x, here, np.zeros(len(here), np.int64), chosen, w[here], channels(w[here], y[here]))
                                whole[t, node] = whole.get((t, node), 0) + np.concatenate([v[:, 0], n])
            for (t, node), s in whole.items():
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([node]), pa.array([s.tobytes()])], names=["tree", "node", "sums"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    at = batch.column("tree")[i].as_py(), batch.column("node")[i].as_py()
                    whole[at] = whole.get(at, 0) + _array(batch, i, "sums", float).reshape(-1, tries, BINS)
            for (t, node), s in whole.items():
                place, c, gain = (a[0] for a in best(s[:-1, None], s[-1][None]))
                left = s[-1, place, : c + 1].sum()
                feature = int(np.random.default_rng((seed, t, node, 1)).permutation(width)[place])
                numbers = [t, node, feature if gain > 1e-9 else -1, int(c), int(left), int(s[-1, place].sum() - left)]
                yield pa.RecordBatch.from_arrays([pa.array([k]) for k in numbers], names=["tree", "node", "feature", "cut", "left", "right"])

        found = learn.mapInArrow(sums, "tree long, node long, sums binary").repartition(tasks, "tree", "node").mapInArrow(cut, "tree long, node long, feature long, cut long, left long, right long").collect()  # a row per large node
        large = set()
        for r in found:
            if r["feature"] >= 0:
                tops[r["tree"]][r["node"]] = (r["feature"], r["cut"])
                large |= {(r["tree"], 2 * r["node"] + k) for k, n in ((1, r["left"]), (2, r["right"])) if n > most}
    sent = spark.sparkContext.broadcast(tops)
    names = ["tree", "node", "kind", "pack", "at", "w", "labels", "x"]

    def routed(kind: int):
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    y, keys, x = _array(batch, i, "labels", float), _array(batch, i, "keys", np.int64), _array(batch, i, "x", np.uint8).reshape(-1, width)
                    for t, top in sent.value.items():
                        w = bag(keys, t, seed) if not kind else np.ones(len(keys), np.int64)
                        for node, here in _way(top, x).items():
                            here = here[w[here] > 0]
                            if len(here):
                                whole = [here.astype(np.uint16), w[here].astype(np.uint8), y[here] if not kind else y[:0], x[here]]
                                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([node]), pa.array([kind]), batch.column("pack").slice(i, 1), *[pa.array([a.tobytes()], pa.binary()) for a in whole]], names=names)

        return route

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, tree = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                at, kind = (batch.column("tree")[i].as_py(), batch.column("node")[i].as_py()), batch.column("kind")[i].as_py()
                if at != now:
                    now, parts, tree = at, [], None
                x = _array(batch, i, "x", np.uint8).reshape(-1, width)
                if not kind:
                    parts.append((x, _array(batch, i, "w", np.uint8).astype(float), _array(batch, i, "labels", float)))
                    continue
                if tree is None:
                    # A part that no row of the bag reached cannot be, but for an empty bag: no votes.
                    lx, w, y = (np.concatenate(a) for a in zip(*parts, strict=True)) if parts else (x[:0], np.zeros(0), np.zeros(0))
                    above = (now[1] + 1).bit_length() - 1
                    tree, parts = grow(lx, w, channels(w, y), tries, depth - above, np.random.default_rng((seed, *now))), []
                feature, cut, left, value = tree
                votes = value[leaf_of(x, feature, cut, left)]
                yield pa.RecordBatch.from_arrays([batch.column("pack").slice(i, 1), batch.column("tree").slice(i, 1), batch.column("at").slice(i, 1), pa.array([votes.tobytes()])], names=["pack", "tree", "at", "votes"])

    fields = "tree long, node long, kind long, pack long, at binary, w binary, labels binary, x binary"
    sorted_by = ["tree", "node", "kind", "pack"]
    ways = learn.mapInArrow(routed(0), fields).unionByName(ask.mapInArrow(routed(1), fields))
    votes = ways.repartition(max(trees, tasks), "tree", "node").sortWithinPartitions(*sorted_by).mapInArrow(leaves, "pack long, tree long, at binary, votes binary")
    kind = test.schema["row_id"].dataType.simpleString()
    wide = max(1, classes)

    def summed(key: tuple, mine: pa.Table, packs: pa.Table) -> pa.Table:
        ids, labels = packs.column("row_ids").combine_chunks().flatten(), np.frombuffer(packs.column("labels")[0].as_py())
        total = np.zeros((len(labels), wide))
        for i in np.argsort(mine.column("tree").to_numpy(), kind="stable").tolist():  # a row has one place a tree, so sums have one order
            total[np.frombuffer(mine.column("at")[i].as_py(), np.uint16)] += np.frombuffer(mine.column("votes")[i].as_py()).reshape(-1, wide)
        score = total[:, 1] / np.maximum(total.sum(1), 1e-300) if classes else total[:, 0] / trees
        pred = total.argmax(1).astype(float) if classes else score
        return pa.table({"row_id": ids, "label": pa.array(labels), "pred": pa.array(pred), "score": pa.array(score)})

    done = votes.groupBy("pack").cogroup(ask.groupBy("pack")).applyInArrow(summed, f"row_id {kind}, label double, pred double, score double")
    return cut_lineage(done, "forest")  # several scores are taken of it, and the trees are grown once
