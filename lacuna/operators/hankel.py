"""Hankel embedding of series: a window of lags per row, and means over anti-diagonals back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.rand import uniform
from lacuna.functions.registry import IMPUTERS
from lacuna.operators.cells import flag_least, numbered, part_of

KEYS = ("series_id",)
MASKS = ("uniform_random", "contiguous_block", "bursty_random")


def hankelize(series: DataFrame, window: int, on: str = "value", keys=KEYS) -> DataFrame:
    """Cells (keys, row_id, col_id, value) with ``value[i, j] = x[i + j]`` and `window` rows."""
    n = series.groupBy(*keys).agg((F.max("t") + 1).alias("n"))
    fits = F.lit(window).between(2, F.col("n") - 1)
    n = n.withColumn("n", F.when(fits, F.col("n")).otherwise(F.raise_error(F.lit(f"a window of {window} does not fit the series"))))
    x = series.join(F.broadcast(n), list(keys)).withColumn("row_id", F.explode(F.sequence(F.lit(0), F.lit(window - 1))))
    x = x.withColumn("col_id", F.col("t") - F.col("row_id"))
    return x.filter(F.col("col_id").between(0, F.col("n") - window)).select(*keys, F.col("row_id").cast("long").alias("row_id"), F.col("col_id").cast("long").alias("col_id"), F.col(on).alias("value"))


def dehankelize(cells: DataFrame, on: str = "value", keys=KEYS) -> DataFrame:
    """The mean of each anti-diagonal's finite cells; none gives null."""
    return cells.groupBy(*keys, (F.col("row_id") + F.col("col_id")).cast("int").alias("t")).agg(F.avg(on).alias("value"))


def enforce(cells: DataFrame, on: str = "value", keys=KEYS) -> DataFrame:
    """Every cell as the mean of its anti-diagonal; an empty one gives 0."""
    mean = cells.groupBy(*keys, (F.col("row_id") + F.col("col_id")).alias("t")).agg(F.coalesce(F.avg(on), F.lit(0.0)).alias("__mean"))
    return cells.withColumn("t", F.col("row_id") + F.col("col_id")).join(mean, [*keys, "t"]).withColumn(on, F.col("__mean")).drop("t", "__mean")


def hide_points(series: DataFrame, kind: str, share: float, seed: int, burst_max: int = 8, keys=KEYS) -> DataFrame:
    """`hidden` points: exactly round(n * share); `uniform_random`, `contiguous_block` or `bursty_random`.

    The last two start before the end, so the last point is never in a run of theirs.
    """
    n = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("len"), F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(share), 0).cast("bigint")).alias("n"))
    x = series.join(F.broadcast(n), list(keys))
    u = uniform("t", seed=seed, tag="point")
    if kind == "uniform_random":
        x = x.withColumn("place", u)
    elif kind == "contiguous_block":
        start = F.floor(uniform(F.lit("run"), seed=seed, tag="start") * F.greatest(F.lit(1), F.col("len") - F.col("n")))
        x = x.withColumn("place", F.when((F.col("t") >= start) & (F.col("t") < start + F.col("n")), u / 2).otherwise(0.5 + u / 2))
    elif kind == "bursty_random":
        b = numbered(n, F.col("n") + 1, "burst").withColumn("size", 2 + F.floor(uniform("burst", seed=seed, tag="length") * (burst_max - 2)).cast("int"))
        b = b.withColumn("start", F.floor(uniform("burst", seed=seed, tag="start") * F.greatest(F.lit(1), F.col("len") - F.col("size"))))
        b = b.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).withColumn("t", (F.col("start") + F.col("k")).cast("int"))
        first = b.groupBy(*keys, "t").agg(F.min((F.col("burst") * burst_max + F.col("k")) / ((F.col("n") + 1) * burst_max)).alias("drawn"))
        x = x.join(first, [*keys, "t"], "left").withColumn("place", F.coalesce(F.col("drawn") / 2, 0.5 + u / 2)).drop("drawn")
    else:
        raise ValueError(f"kind must be one of {MASKS}")
    return flag_least(x, F.col("place"), part_of(share), "hidden", keys, ("t",)).drop("place", "n", "len")


def reconstruct(series: DataFrame, window: int, method: str, on: str = "observed", keys=KEYS, **params) -> DataFrame:
    """(keys, t, pred): embed, complete by any method, make it Hankel again, and average back.

    `cadzow` works on the series itself; a series that cannot be completed has null there.
    """
    if method == "cadzow":
        from lacuna.operators import series as pieces

        done = pieces.complete(series, window, on, keys, **params)
        return done.select(*keys, F.col("t").cast("int").alias("t"), "pred")
    filled = IMPUTERS.named(method)(hankelize(series, window, on, keys), keys=list(keys), **params)
    return dehankelize(enforce(filled, "pred", keys), "pred", keys).withColumnRenamed("value", "pred")


def scores(series: DataFrame, keys=KEYS) -> DataFrame:
    """rmse_all, rmse_missing, nrmse_missing and n_missing of (clean, pred, hidden)."""
    ok = F.col("pred").isNotNull() & F.col("clean").isNotNull()
    miss = F.col("hidden")
    sq = (F.col("pred") - F.col("clean")) ** 2
    span = F.max(F.when(miss, F.col("clean"))) - F.min(F.when(miss, F.col("clean")))
    rmse_missing = F.sqrt(F.avg(F.when(ok & miss, sq)))
    return series.groupBy(*keys).agg(F.sqrt(F.avg(F.when(ok, sq))).alias("rmse_all"), rmse_missing.alias("rmse_missing"), F.when(span > 0, rmse_missing / span).otherwise(0.0).alias("nrmse_missing"), F.count_if(ok & miss).alias("n_missing"))
