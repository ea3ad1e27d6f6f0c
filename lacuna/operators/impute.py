"""Fills: cells with a null `value` get a `pred`; observed values stay.

Statistics are aggregates joined back by run and row or column; no window holds a
run.  Each function takes cells and returns them with `pred`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.rand import normal, uniform
from lacuna.functions.registry import IMPUTERS
from lacuna.operators.cells import AT, KEYS
from lacuna.sources.tables import cut_lineage


def _overall(cells: DataFrame, keys) -> DataFrame:
    """A row per run, so it may be sent out whole: runs are the experiments of a grid, not data."""
    return cells.groupBy(*keys).agg(F.avg("value").alias("__all"))


@IMPUTERS.register("global_mean")
def global_mean(cells: DataFrame, keys=KEYS) -> DataFrame:
    return cells.join(F.broadcast(_overall(cells, keys)), list(keys)).withColumn("pred", F.coalesce("value", "__all")).drop("__all")


def _line_mean(cells: DataFrame, line: str, keys) -> DataFrame:
    sums = cells.groupBy(*keys, line).agg(F.sum("value").alias("__sum"), F.count("value").alias("__n"))
    overall = sums.groupBy(*keys).agg(F.try_divide(F.sum("__sum"), F.sum("__n")).alias("__all"))  # the lines' sums, not the cells again
    own = sums.select(*keys, line, F.try_divide("__sum", "__n").alias("__own")).join(F.broadcast(overall), list(keys))
    filled = cells.join(own, [*keys, line])
    return filled.withColumn("pred", F.coalesce("value", "__own", "__all")).drop("__own", "__all")


@IMPUTERS.register("row_mean")
def row_mean(cells: DataFrame, keys=KEYS) -> DataFrame:
    """A row without values gets the run's mean."""
    return _line_mean(cells, "row_id", keys)


@IMPUTERS.register("col_mean")
def col_mean(cells: DataFrame, keys=KEYS) -> DataFrame:
    """A column without values gets the run's mean."""
    return _line_mean(cells, "col_id", keys)


@IMPUTERS.register("col_mode")
def col_mode(cells: DataFrame, keys=KEYS) -> DataFrame:
    """The most frequent value of the column, of equal ones the smallest."""
    n = cells.filter("value IS NOT NULL").groupBy(*keys, "col_id", "value").agg(F.count(F.lit(1)).alias("n"))
    mode = n.groupBy(*keys, "col_id").agg(F.max(F.struct("n", (-F.col("value")).alias("low"))).alias("best")).select(*keys, "col_id", (-F.col("best.low")).alias("__own"))
    filled = cells.join(mode, [*keys, "col_id"], "left").join(F.broadcast(_overall(cells, keys)), list(keys))
    return filled.withColumn("pred", F.coalesce("value", "__own", "__all")).drop("__own", "__all")


#: Cells in a block of rows that is compared with another one in a task.
BLOCK_CELLS = 1 << 16
#: Blocks that a task holds, at most.
GROUP = 256


#: Pairs of rows that are compared exactly at a time.
PAIRS = 1 << 16


def _exact(xa: np.ndarray, xb: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, infinite where no column is shared."""
    total, shared = np.zeros(len(xa)), np.zeros(len(xa))
    for c in range(xa.shape[1]):
        gap = xa[:, c] - xb[:, c]
        both = ~np.isnan(gap)
        total += np.where(both, gap, 0.0) ** 2
        shared += both
    with np.errstate(divide="ignore", invalid="ignore"):
        # Rounded, so that the order of a sum does not decide between equal distances.
        return np.where(shared > 0, np.round(np.sqrt(total * xa.shape[1] / shared), 9), np.inf)


def _nearest(a: np.ndarray, xa: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[np.ndarray]:
    """(row, column place, neighbour, distance, value): for each missing cell of `xa` the k nearest rows of the blocks with a value there.

    Matrix products bound the distances of all pairs; only pairs that may be among the k nearest of a missing cell, by
    what has been found so far, are compared exactly.
    """
    kinds = (np.int64, np.int64, np.int64, float, float)
    found = [np.zeros(0, t) for t in kinds]
    hidden, width = np.isnan(xa), xa.shape[1]
    n = np.maximum((~hidden).sum(0), 1)
    middle = np.where(hidden, 0.0, xa).sum(0) / n  # differences stay, and products lose fewer digits
    za, ma = np.where(hidden, 0.0, xa - middle), (~hidden).astype(float)
    left, size_a = np.hstack([za**2, za, ma]), (za**2).sum(1)
    within, short, chunk = np.full(len(a), -np.inf), hidden.astype(float), 32
    for b, xb in blocks:
        low = 0
        while low < len(b):
            ids, x = b[low : low + chunk], xb[low : low + chunk]
            low, chunk = low + chunk, 2 * chunk
            mb = (~np.isnan(x)).astype(float)
            zb = np.where(np.isnan(x), 0.0, x - middle)
            total, shared = left @ np.hstack([mb, -2 * zb, zb**2]).T, ma @ mb.T
            slack = 1e-12 * width * (size_a[:, None] + (zb**2).sum(1)[None])
            near = (total - slack) * width <= np.square(np.maximum(within, 0) + 2e-9)[:, None] * shared
            near[within == -np.inf] = False
            near |= short @ mb.T > 0  # a cell that has less than k yet takes any
            near &= (shared > 0) & (a[:, None] != ids[None])
            i, j = np.nonzero(near)
            for at in range(0, len(i), PAIRS):
                p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                distance = _exact(xa[p], x[q])
                e, c = np.nonzero(hidden[p] & ~np.isnan(x[q]))
                new = (a[p[e]], c, ids[q[e]], distance[e], x[q[e], c])
                found = _least([np.concatenate(f).astype(t) for f, t in zip(zip(found, new, strict=True), kinds, strict=True)], k)
            if len(i):
                row = np.searchsorted(a, found[0])
                count = np.zeros(hidden.shape, np.int64)
                np.add.at(count, (row, found[1]), 1)
                short = (hidden & (count < k)).astype(float)
                whole = count[row, found[1]] >= k
                within = np.full(len(a), -np.inf)
                np.maximum.at(within, row[whole], found[3][whole])
    return found


def _least(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (row, column place, neighbour, distance, value) the k nearest for each row and place, of equal distances the smaller neighbour."""
    order = np.lexsort((found[2], found[3], found[1], found[0]))
    found = [x[order] for x in found]
    new = np.flatnonzero(np.append(True, (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1]))) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    return [x[place < k] for x in found]


@IMPUTERS.register("knn")
def knn(cells: DataFrame, keys=KEYS, n_neighbors: int = 5, weights: str = "uniform") -> DataFrame:
    """Mean of the nearest rows that have the column; distances over shared columns, scaled to all of them.

    Rows are dealt into blocks, and blocks into groups of about the square root of their number
    (GROUP at most).  Every pair of groups is a task, which holds the blocks of one and lets those
    of the other pass, so a block travels once for each group, not for each block.  A task sends
    the nearest rows it has for each missing cell; the nearest of these are taken.  Work is
    quadratic in the rows of a run, by matrix products, but no column or row gathers in one task.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError("weights must be uniform or distance")
    overall = _overall(cells, keys)
    stats = cells.groupBy(*keys).agg(F.count_distinct("row_id").alias("__rows"), F.count_distinct("col_id").alias("__cols"))  # a row per run
    have = cells.groupBy(*keys, "col_id").agg(F.count("value").alias("n"))
    base = cells.join(have, [*keys, "col_id"]).join(F.broadcast(overall), list(keys)).join(F.broadcast(stats), list(keys))
    blocks = F.ceil(F.col("__rows") * F.col("__cols") / BLOCK_CELLS).cast("int")
    base = base.select(*keys, F.col("row_id").cast("long").alias("row_id"), F.col("col_id").cast("long").alias("col_id"), F.when(F.col("n") == 0, F.col("__all")).otherwise(F.col("value")).alias("x"), blocks.alias("blocks"))
    base = base.withColumn("block", F.pmod(F.xxhash64("row_id"), "blocks").cast("int"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*keys).schema.fields)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        rows, r = np.unique(table.column("row_id").to_numpy(), return_inverse=True)
        cols, c = np.unique(table.column("col_id").to_numpy(), return_inverse=True)
        x = np.full((len(rows), len(cols)), np.nan)
        x[r, c] = table.column("x").to_pandas().to_numpy(float)
        one = table.slice(0, 1)
        out = one.select([*keys, "block", "blocks"])
        for name, value in (("rows", rows), ("cols", cols), ("x", x)):
            out = out.append_column(name, pa.array([value.tobytes()], pa.binary()))
        return out.append_column("short", pa.array([bool(np.isnan(x).any())]))

    packed = cut_lineage(base.groupBy(*keys, "block").applyInArrow(pack, f"{kinds}, block int, blocks int, rows binary, cols binary, x binary, short boolean"), "blocks")
    size = F.least(F.lit(GROUP), F.ceil(F.sqrt("blocks"))).cast("int")
    groups, of = F.ceil(F.col("blocks") / size).cast("int"), F.floor(F.col("block") / size).cast("int")
    every = F.explode(F.sequence(F.lit(0), groups - 1))
    held = packed.select(*keys, of.alias("group"), every.alias("with"), F.lit(0).alias("kind"), "block", "rows", "cols", "x")
    passing = packed.filter("short").select(*keys, every.alias("group"), of.alias("with"), F.lit(1).alias("kind"), "block", "rows", "cols", "x")
    tasks = held.unionByName(passing).repartition(*keys, "group", "with").sortWithinPartitions(*keys, "group", "with", "kind", "block")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                get = lambda name, kind, one=one: np.frombuffer(one.column(name)[0].as_py(), kind)
                now = tuple(one.column(c)[0].as_py() for c in (*keys, "group", "with"))
                if now != task:
                    task, blocks = now, []
                rows, cols = get("rows", np.int64), get("cols", np.int64)
                x = get("x", float).reshape(len(rows), -1)
                if one.column("kind")[0].as_py() == 0:
                    blocks.append((rows, x))
                    continue
                short = np.isnan(x).any(axis=1)
                a, xa = rows[short], x[short]
                found = _nearest(a, xa, blocks, n_neighbors)
                same = [one.column(c).take(pa.array(np.zeros(len(found[0]), np.int64))) for c in keys]
                yield pa.RecordBatch.from_arrays([*same, pa.array(found[0]), pa.array(cols[found[1]]), pa.array(found[2]), pa.array(found[3]), pa.array(found[4])], names=[*keys, "a", "col_id", "b", "distance", "xb"])

    donors = tasks.mapInArrow(nearest, f"{kinds}, a long, col_id long, b long, distance double, xb double")
    rank = F.row_number().over(Window.partitionBy(*keys, "a", "col_id").orderBy("distance", "b"))
    near = donors.withColumn("rank", rank).filter(F.col("rank") <= n_neighbors)
    if weights == "distance":
        zero = F.max(F.col("distance") == 0).over(Window.partitionBy(*keys, "a", "col_id"))
        near = near.withColumn("w", F.when(zero, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance")))
    else:
        near = near.withColumn("w", F.lit(1.0))
    fill = near.groupBy(*keys, F.col("a").alias("row_id"), "col_id").agg((F.sum(F.col("w") * F.col("xb")) / F.sum("w")).alias("__near"))
    own = cells.groupBy(*keys, "col_id").agg(F.avg("value").alias("__own"))
    filled = cells.join(fill, [*keys, *AT], "left").join(own, [*keys, "col_id"]).join(F.broadcast(overall), list(keys))
    return filled.withColumn("pred", F.coalesce("value", "__near", "__own", "__all")).drop("__near", "__own", "__all")


def clamp(cells: DataFrame, bounds: DataFrame, on: str = "pred") -> DataFrame:
    """Predictions within (col_id, lower, upper); a null bound is none.  Observed values stay."""
    near = cells.join(bounds.select("col_id", "lower", "upper"), "col_id", "left")
    x = F.greatest(F.least(F.col(on), F.coalesce("upper", F.col(on))), F.coalesce("lower", F.col(on)))
    return near.withColumn(on, F.when(F.col("value").isNull(), x).otherwise(F.col(on))).drop("lower", "upper")


def scaled_bounds(bounds: DataFrame, cells: DataFrame) -> DataFrame:
    """Bounds in units of each column's standard deviation from its mean."""
    stats = cells.groupBy("col_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    z = lambda c: F.when(F.col("sd") > 0, (F.col(c) - F.col("mean")) / F.col("sd")).otherwise(F.col(c) - F.col("mean"))
    return bounds.join(stats, "col_id").select("col_id", z("lower").alias("lower"), z("upper").alias("upper"))


def medians(cells: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, col_id, median) of each column's values, exactly.

    A sketch of bounded size brackets the middle; only what lies in the bracket is ranked,
    by its distinct values.
    """
    by = [*keys, "col_id"]
    known = cells.filter("value IS NOT NULL").select(*by, "value")
    bracket = known.groupBy(*by).agg(F.percentile_approx("value", [0.4998, 0.5002], 10_000).alias("q"), F.count(F.lit(1)).alias("n"))
    x = known.join(bracket.select(*by, "n", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")), by)
    below = x.groupBy(*by).agg(F.count_if(F.col("value") < F.col("low")).alias("below"))
    middle = x.filter(F.col("value").between(F.col("low"), F.col("high"))).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
    upto = F.sum("m").over(Window.partitionBy(*by).orderBy("value")) + F.col("below")
    middle = middle.join(below, by).withColumn("upto", upto)
    at = [F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)]  # the middle ranks, from 0
    here = [F.max(F.when((F.col("upto") - F.col("m") <= k) & (k < F.col("upto")), F.col("value"))) for k in at]
    return middle.groupBy(*by).agg(((here[0] + here[1]) / 2).alias("median"))


@IMPUTERS.register("col_median")
def col_median(cells: DataFrame, keys=KEYS) -> DataFrame:
    filled = cells.join(medians(cells, keys), [*keys, "col_id"], "left").join(F.broadcast(_overall(cells, keys)), list(keys))
    return filled.withColumn("pred", F.coalesce("value", "median", "__all")).drop("median", "__all")


def standardised(cells: DataFrame, on: str = "pred", keys=KEYS) -> DataFrame:
    """Zero mean and unit variance per column; a constant column becomes 0."""
    stats = cells.groupBy(*keys, "col_id").agg(F.avg(on).alias("mean"), F.stddev_pop(on).alias("sd"))
    return cells.join(stats, [*keys, "col_id"]).withColumn(on, F.when(F.col("sd") > 0, (F.col(on) - F.col("mean")) / F.col("sd")).otherwise(0.0)).drop("mean", "sd")


def row_disjoint(cells: DataFrame, splits: DataFrame, method: str, target: int, keys=KEYS, **params) -> DataFrame:
    """Train and test rows filled apart, test targets blanked before and all targets true after."""
    x = cells.join(splits, [*keys, "row_id"]).withColumn("truth", F.col("value"))
    x = x.withColumn("value", F.when((F.col("split") == "train") | (F.col("col_id") != target), F.col("value")))
    x = IMPUTERS.named(method)(x, keys=[*keys, "split"], **params)
    return x.withColumn("pred", F.when(F.col("col_id") == target, F.col("truth")).otherwise(F.col("pred"))).withColumn("value", F.col("truth")).drop("truth")


def column_profiles(cells: DataFrame, keys=KEYS) -> DataFrame:
    """Per column: kind (binary, categorical or continuous), mean, sd, min, max, distinct count."""
    whole = F.abs(F.col("value") - F.bround("value", 0)) <= 1e-8 + 1e-5 * F.abs(F.bround("value", 0))
    p = cells.groupBy(*keys, "col_id").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.count_distinct("value").alias("n_distinct"), F.count("value").alias("n"),
        F.coalesce(F.min(F.col("value").isin(0.0, 1.0)), F.lit(False)).alias("zero_one"), F.coalesce(F.min(whole), F.lit(False)).alias("whole"),
    )
    kind = F.when((F.col("n") > 0) & F.col("zero_one"), "binary").when((F.col("n") > 0) & (F.col("n_distinct") <= 8) & F.col("whole"), "categorical").otherwise("continuous")
    empty = F.col("n") == 0
    return p.select(*keys, "col_id", kind.alias("kind"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(empty, 1.0).otherwise(F.greatest("sd", F.lit(1e-6))).alias("sd"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high"), "n_distinct")


def mi_gaussian(cells: DataFrame, m: int = 5, seed: int = 7, keys=KEYS) -> DataFrame:
    """`m` draws for each missing cell (`imputation_id` 0 to m-1, seeds seed + i), by the kind of its column."""
    if m < 2:
        raise ValueError("m must be at least 2")
    profiles = column_profiles(cells, keys)
    freq = cells.filter("value IS NOT NULL").join(profiles.filter("kind = 'categorical'").select(*keys, "col_id"), [*keys, "col_id"]).groupBy(*keys, "col_id", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys, "col_id").orderBy("value")  # at most eight values a column
    steps = freq.select(*keys, "col_id", "value", (F.sum("n").over(order) / F.sum("n").over(Window.partitionBy(*keys, "col_id"))).alias("upto"))
    steps = steps.groupBy(*keys, "col_id").agg(F.array_sort(F.collect_list(F.struct("upto", "value"))).alias("steps"))
    x = cells.withColumn("imputation_id", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).join(profiles, [*keys, "col_id"]).join(steps, [*keys, "col_id"], "left")
    s = F.lit(seed) + F.col("imputation_id")
    u = uniform(*AT, seed=s, tag="mi")
    p = F.greatest(F.least(F.col("mean"), F.lit(1 - 1e-4)), F.lit(1e-4))
    category = F.coalesce(F.element_at(F.filter("steps", lambda e: u <= e["upto"]), 1)["value"], F.col("high"))
    value = (
        F.when(F.col("kind") == "binary", F.when(u < p, 1.0).otherwise(0.0)).when(F.col("kind") == "categorical", category)
        .otherwise(F.greatest(F.least(F.col("mean") + F.col("sd") * normal(*AT, seed=s, tag="mi"), F.col("high")), F.col("low")))
    )
    return x.withColumn("pred", F.coalesce(F.col("value"), value)).select(*cells.columns, "imputation_id", "pred")


class MissingDependency(RuntimeError):
    """The method needs a model or library that is not here."""


def _absent(name: str, what: str):
    def fill(cells: DataFrame, keys=KEYS, **params) -> DataFrame:
        raise MissingDependency(f"{name} needs {what}, which is not installed")

    IMPUTERS.register(name)(fill)


_absent("tab_impute", "pretrained transformer weights")
_absent("tab_impute_constraints", "pretrained transformer weights")
_absent("TabImputeConstraints", "pretrained transformer weights")
