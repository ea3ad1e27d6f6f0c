"""Low-rank completion of series through their Hankel matrices, which are never laid out.

A series of n points and a window w stand for the w x (n - w + 1) matrix
``X[i, j] = x[i + j]``.  A round cuts its rank, averages over anti-diagonals and
puts the known points back.  All three are done on the series:

* X Xᵀ follows from the w sums of ``x[j] x[j + b]`` over all j, which pieces of
  the series add up, and from the first and last w points: each further row of it
  is the one before, less one product and plus one.
* With P the projection on its largest eigenvectors, the mean over an
  anti-diagonal of P X is a filter of 2 w - 1 taps, the sums along P's diagonals;
  only the first and last w - 1 points, whose anti-diagonals are short, are
  worked out from P itself.

A short series is solved in one task.  A long one is a table of pieces of PIECE
points or more; a round shuffles only the w - 1 points at the ends of each piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.sources.tables import Rounds, cut_lineage

#: Points of a piece, at least; shorter series are one.
PIECE = 1 << 16
#: The shorter side of the matrix, at most: its square is factored on the driver.
MOST_WINDOW = 2000


def short_side(n: int, window: int) -> int:
    """A Hankel matrix and its transpose stand for the same series; the shorter side is the window."""
    if not 2 <= window <= n - 1:
        raise ValueError(f"a window of {window} does not fit the series")
    return min(window, n - window + 1)


def lag_sums(x: np.ndarray, after: np.ndarray, window: int) -> np.ndarray:
    """Sums of ``x[j] x[j + b]`` for b below the window, over the points of a piece; `after` are the points that follow."""
    whole = np.concatenate([x, after])
    return np.array([x @ whole[b : b + len(x)] for b in range(window)])


def covariance(first_row: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """X Xᵀ from its first row, the first `window` points, and the `window` points from n - window + 1 - 1 on."""
    w = len(first_row)
    g = np.empty((w, w))
    g[0] = g[:, 0] = first_row
    for a in range(w - 1):
        g[a + 1, a + 1 :] = g[a, a : w - 1] - head[a] * head[a : w - 1] + tail[a] * tail[a : w - 1]
        g[a + 1 :, a + 1] = g[a + 1, a + 1 :]
    return g


def projection(g: np.ndarray, rank: int) -> np.ndarray:
    u = np.linalg.eigh(g)[1][:, ::-1][:, :rank]
    return u @ u.T


def taps(p: np.ndarray) -> np.ndarray:
    """Sums along the diagonals of P, from -(w - 1) to w - 1."""
    w = len(p)
    return np.array([np.trace(p, d) for d in range(1 - w, w)])


def averaged(x: np.ndarray, begin: int, end: int, at: int, n: int, p: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The anti-diagonal means of P X at points begin to end - 1; `x` are the points from `at` on, w - 1 more at each side."""
    w = len(p)
    k = n - w + 1
    y = np.empty(end - begin)
    low, high = max(begin, w - 1), min(end, k)
    if low < high:
        y[low - begin : high - begin] = np.correlate(x[low - w + 1 - at : high + w - 1 - at], c, "valid") / w
    for edge in (range(begin, min(end, w - 1)), range(max(begin, k), end)):
        if not len(edge):
            continue
        first = 0 if edge[0] < w - 1 else k - w + 1  # of w - 1 columns that the edge's anti-diagonals cross
        cut = p @ np.lib.stride_tricks.sliding_window_view(x[first - at : first - at + 2 * w - 2], w).T
        for t in edge:
            i = np.arange(max(0, t - k + 1), min(w - 1, t) + 1)
            y[t - begin] = cut[i, t - i - first].mean()
    return y


def shares(n: int, window: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """How many cells of the matrix each point stands for."""
    t = np.arange(begin, n if end is None else end)
    return np.minimum(np.minimum(t + 1, n - t), window)


def _checked(n: int, window: int, rank: int | None) -> tuple[int, int]:
    if rank is None or rank < 1:
        raise ValueError("a rank is needed")
    return short_side(n, window), int(rank)


def cadzow(known: np.ndarray, window: int, rank: int | None = None, max_iters: int = 100, tol: float = 1e-6) -> np.ndarray:
    """The completed series of `known`, NaN where a point is missing; a round that changes the matrix by less than `tol` is the last."""
    n = len(known)
    w, rank = _checked(n, window, rank)
    seen, weight = np.isfinite(known), shares(n, w)
    if not seen.any():
        raise ValueError("nothing is observed")
    x = np.where(seen, known, (weight * np.where(seen, known, 0)).sum() / weight[seen].sum())
    for _ in range(max_iters):
        p = projection(covariance(lag_sums(x[: n - w + 1], x[n - w + 1 :], w), x[:w], x[n - w + 1 :][: w - 1]), rank)
        after = np.where(seen, known, averaged(x, 0, n, 0, n, p, taps(p)))
        change = np.sqrt((weight * (after - x) ** 2).sum() / max((weight * x * x).sum(), 1e-24))
        x = after
        if change < tol:
            break
    return x


# Long series.


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column; none is empty."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _by_piece(df: DataFrame, f: Callable[[dict], tuple], names: str) -> DataFrame:
    """A row of `f` for each piece; its arrays are numpy arrays, those that are not there are empty."""
    kinds = [x.split() for x in names.split(", ")]
    arrow = {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = {c: (np.asarray(v.values) if isinstance(v := one.column(c)[0], pa.ListScalar) and v.is_valid else v.as_py()) for c in one.schema.names}
                yield pa.RecordBatch.from_arrays([pa.array([v], arrow[kind]) for v, (_, kind) in zip(f({c: np.zeros(0) if v is None else v for c, v in row.items()}), kinds, strict=True)], names=[c for c, _ in kinds])

    return df.mapInArrow(run, names)


def _with_ends(pieces: DataFrame, w: int, both: bool = True) -> DataFrame:
    """Each piece with the w - 1 points before and after it; what is joined is small, and sent out only while Spark finds it so."""
    after = pieces.select((F.col("piece") - 1).alias("piece"), F.slice("x", 1, w - 1).alias("after"))
    out = pieces.join(after, "piece", "left")
    if both:
        before = pieces.select((F.col("piece") + 1).alias("piece"), F.slice("x", F.size("x") - w + 2, w - 1).alias("before"))
        out = out.join(before, "piece", "left")
    return out


def long_cadzow(points: DataFrame, n: int, window: int, rank: int | None = None, max_iters: int = 100, tol: float = 1e-6) -> DataFrame:
    """(t, pred) of one series (t, value) with points 0 to n - 1, piece by piece; the same rounds as `cadzow`."""
    w, rank = _checked(n, window, rank)
    if w > MOST_WINDOW:
        raise ValueError(f"the shorter side of the matrix is over {MOST_WINDOW}")
    size = max(PIECE, 2 * w)
    last = max(1, n // size) - 1
    spark = points.sparkSession
    t = F.col("t").cast("long")
    weight = F.least(t + 1, F.lit(n) - t, F.lit(w))
    mean = points.agg(F.try_divide(F.sum(weight * F.col("value")), F.sum(F.when(F.col("value").isNotNull(), weight))).alias("m")).first().m
    if mean is None:
        raise ValueError("nothing is observed")
    listed = points.select(F.least(F.floor(t / size), F.lit(last)).cast("int").alias("piece"), t.alias("t"), "value").groupBy("piece").agg(F.collect_list(F.struct("t", F.coalesce("value", F.lit(float("nan"))).alias("v"))).alias("points"))

    def bounds(piece: int) -> tuple[int, int]:
        return piece * size, n if piece == last else (piece + 1) * size

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                begin, end = bounds(piece := batch.column(0)[k].as_py())
                v = batch.column(1)[k].values
                known = np.full(end - begin, np.nan)
                known[v.field("t").to_numpy() - begin] = v.field("v").to_numpy(zero_copy_only=False)
                x = np.where(np.isnan(known), mean, known)
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([known], pa.list_(pa.float64())), pa.array([x], pa.list_(pa.float64())), *(pa.array([0.0]),) * 2], names=["piece", "known", "x", "moved", "size"])

    state = "piece int, known array<double>, x array<double>, moved double, size double"
    rounds = Rounds(spark, "pieces")
    pieces = rounds.write(listed.mapInArrow(placed, state))
    k = n - w + 1

    def sums(row: dict) -> tuple:
        begin, end = bounds(row["piece"])
        inside = max(0, min(end, k) - begin)  # columns of the matrix that begin in the piece
        follow = np.concatenate([row["x"], row["after"]])[inside:]
        return row["piece"], lag_sums(row["x"][:inside], np.append(follow, np.zeros(w)), w) if inside else np.zeros(w)

    for _ in range(max_iters):
        lags = _by_piece(_with_ends(pieces, w, both=False).select("piece", "x", "after"), sums, "piece int, lags array<double>")
        row = lags.select(F.posexplode("lags")).groupBy("pos").agg(F.sum("col").alias("s")).toArrow()  # a row per lag
        first_row = np.zeros(w)
        first_row[row.column("pos").to_numpy()] = row.column("s").to_numpy()
        ends = {r.piece: np.array(r.e) for r in pieces.filter(F.col("piece").isin(0, last)).select("piece", F.when(F.col("piece") == last, F.slice("x", -(w - 1), w - 1)).otherwise(F.slice("x", 1, w)).alias("e")).collect()}
        head = ends[0] if last else np.array(pieces.select(F.slice("x", 1, w)).first()[0])
        p = projection(covariance(first_row, head, ends[last]), rank)
        p, c = spark.sparkContext.broadcast(p), spark.sparkContext.broadcast(taps(p))  # w x w numbers

        def step(row: dict, p=p, c=c) -> tuple:
            begin, end = bounds(row["piece"])
            whole = np.concatenate([row["before"], row["x"], row["after"]])
            y = averaged(whole, begin, end, begin - len(row["before"]), n, p.value, c.value)
            after, weight = np.where(np.isnan(row["known"]), y, row["known"]), shares(n, w, begin, end)
            return row["piece"], row["known"], after, float((weight * (after - row["x"]) ** 2).sum()), float((weight * row["x"] ** 2).sum())

        pieces = rounds.write(_by_piece(_with_ends(pieces, w).select("piece", "known", "x", "before", "after"), step, state))
        s = pieces.agg(F.sum("moved").alias("moved"), F.sum("size").alias("size")).first()
        if np.sqrt(s.moved / max(s.size, 1e-24)) < tol:
            break
    return pieces.select((F.col("piece").cast("long") * size).alias("begin"), F.posexplode("x").alias("k", "pred")).select((F.col("begin") + F.col("k")).alias("t"), "pred")


def complete(series: DataFrame, window: int, on: str = "value", keys=("series_id",), **params) -> DataFrame:
    """(keys, t, pred, error) of all series (keys, t from 0): a task each up to PIECE points, by pieces beyond; failures are rows with `error`."""
    x = series.select(*keys, F.col("t").cast("long").alias("t"), F.col(on).cast("double").alias("value"))
    large = x.groupBy(*keys).agg((F.max("t") + 1).alias("n")).filter(F.col("n") > PIECE).collect()  # long series are few
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in series.select(*keys).schema.fields)

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        t = table.column("t").to_numpy()
        known = np.full(int(t.max()) + 1, np.nan)
        known[t] = table.column("value").to_pandas().to_numpy(float)
        try:
            pred, error = cadzow(known, window, **params)[t], None
        except (ValueError, np.linalg.LinAlgError) as e:
            pred, error = np.full(len(t), np.nan), str(e)
        return table.select([*keys, "t"]).append_column("pred", pa.array(pred, from_pandas=True)).append_column("error", pa.array([error] * len(t), pa.string()))

    is_series = lambda r: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(r[c]) for c in keys])
    short = x.filter(~reduce(lambda a, b: a | b, [is_series(r) for r in large])) if large else x
    parts = [short.groupBy(*keys).applyInArrow(solve, f"{kinds}, t long, pred double, error string")]
    for r in large:
        one, error = x.filter(is_series(r)), F.lit(None).cast("string")
        try:
            done = long_cadzow(cut_lineage(one.select("t", "value")), r.n, window, **params)
        except ValueError as e:
            done, error = one.select("t", F.lit(None).cast("double").alias("pred")), F.lit(str(e))
        parts.append(one.select(*keys, "t").join(done, "t").select(*keys, "t", "pred", error.alias("error")))
    return reduce(DataFrame.unionByName, parts)
