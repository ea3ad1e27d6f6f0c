"""Which known cells to hide: exactly `max(1, round(known * share))` of each run, but for censoring.

Each kind gives every known cell a place in [0, 1); the least ones are hidden.
What is broadcast has a row per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.rand import normal, sigmoid, uniform
from lacuna.operators.cells import AT, KEYS, flag_least, index_of, numbered, part_of

KINDS = ("mcar", "mar_logistic", "mnar_self_logistic", "block", "bursty", "censor_above_threshold")


def wanted(cells: DataFrame, share: float, keys=KEYS) -> DataFrame:
    """(keys, n): how many to hide in each run; runs need two known cells."""
    if not 0 < share < 1:
        raise ValueError("the share must lie between 0 and 1")
    known = F.count("value")
    return cells.groupBy(*keys).agg(known.alias("known")).filter("known >= 2").select(*keys, F.greatest(F.lit(1), F.bround(F.col("known") * F.lit(float(share)), 0).cast("bigint")).alias("n"))


def _hide(placed: DataFrame, place: Column, share: float, keys, tie=AT) -> DataFrame:
    """Known cells by their place; the others are never hidden."""
    if not 0 < share < 1:
        raise ValueError("the share must lie between 0 and 1")
    of = part_of(share)
    return flag_least(placed, F.when(F.col("value").isNotNull(), place), lambda n: F.when(n >= 2, of(n)).otherwise(0), "hidden", keys, tie)


def _known(cells: DataFrame) -> DataFrame:
    return cells.filter("value IS NOT NULL")


def mcar(cells: DataFrame, share: float, seed: int, keys=KEYS) -> DataFrame:
    return _hide(cells, uniform(*AT, seed=seed, tag="mcar"), share, keys)


def zscore(value: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, (value - mean) / sd).otherwise(F.lit(0.0))


def mar_logistic(cells: DataFrame, share: float, seed: int, driver: int | None = None, keys=KEYS) -> DataFrame:
    """Rows are drawn by a logistic of their value in the driver column; each draw hides one of the row's cells.

    Draws come in order; a cell counts with its first; what lacks is topped up evenly.
    """
    known = _known(cells)
    first = cells.groupBy(*keys).agg(F.min("col_id").alias("driver")) if driver is None else cells.select(*keys).distinct().withColumn("driver", F.lit(driver))
    x = cells.join(F.broadcast(first), list(keys)).filter("col_id = driver").select(*keys, "row_id", F.col("value").alias("x"))
    stats = x.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.count("x").alias("n_x"), F.count(F.lit(1)).alias("slices"))
    z = F.when(F.col("x").isNull(), 0.0).otherwise(zscore(F.col("x"), F.col("mean"), F.col("sd")))
    rows = x.join(F.broadcast(stats), list(keys)).filter("n_x > 0").withColumn("w", sigmoid(1.2 * z + 0.2 * normal("row_id", seed=seed, tag="mar")))
    # Running totals by chunks of rows: no window holds more than a chunk, or the chunks of a run.
    rows = rows.withColumn("chunk", F.floor(F.col("row_id") / 4096))
    sums = rows.groupBy(*keys, "chunk").agg(F.sum("w").alias("in_chunk"))
    by_chunk = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "chunk", F.coalesce(F.sum("in_chunk").over(by_chunk), F.lit(0.0)).alias("before"), F.sum("in_chunk").over(Window.partitionBy(*keys)).alias("total"))
    upto = F.sum("w").over(Window.partitionBy(*keys, "chunk").orderBy("row_id"))
    rows = rows.withColumn("upto", upto).join(sums, [*keys, "chunk"]).select(*keys, "row_id", "slices", ((F.col("before") + F.col("upto") - F.col("w")) / F.col("total")).alias("low"), ((F.col("before") + F.col("upto")) / F.col("total")).alias("high"))
    # A range join by slices of the unit interval, as many as the run has rows: a slice meets a few rows and draws at any size.
    slice_of = lambda u: F.least(F.floor(u * F.col("slices")), F.col("slices") - 1)
    rows = rows.withColumn("slice", F.explode(F.sequence(slice_of(F.col("low")), slice_of(F.col("high"))))).drop("slices")
    n = wanted(cells, share, keys).select(*keys, (3 * F.col("n")).alias("draws")).join(F.broadcast(stats.select(*keys, "slices")), list(keys))  # a row per run
    draws = numbered(n, F.col("draws"), "draw").withColumn("u", uniform("draw", seed=seed, tag="draw")).withColumn("slice", slice_of(F.col("u"))).drop("slices")
    hit = draws.join(rows, [*keys, "slice"]).filter("u >= low AND u < high")
    in_row = Window.partitionBy(*keys, "row_id").orderBy("col_id")
    ranked = known.select(*keys, *AT, (F.row_number().over(in_row) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(*keys, "row_id")).alias("in_row"))
    sizes = ranked.select(*keys, "row_id", "in_row").distinct()
    hit = hit.join(sizes, [*keys, "row_id"]).withColumn("k", F.floor(uniform("draw", seed=seed, tag="cell") * F.col("in_row")).cast("int"))
    chosen = hit.join(ranked.drop("in_row"), [*keys, "row_id", "k"]).groupBy(*keys, *AT).agg(F.min(F.col("draw") / F.col("draws")).alias("drawn"))
    place = F.coalesce(F.col("drawn") / 2, 0.5 + uniform(*AT, seed=seed, tag="mcar") / 2)
    return _hide(cells.join(chosen, [*keys, *AT], "left"), place, share, keys).drop("drawn")


def mnar_self_logistic(cells: DataFrame, share: float, seed: int, keys=KEYS) -> DataFrame:
    """Weighted sampling without replacement, by a logistic of the cell's own value (keys of Efraimidis and Spirakis)."""
    stats = cells.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    weight = sigmoid(zscore(F.col("value"), F.col("mean"), F.col("sd")) + 0.15 * normal(*AT, seed=seed, tag="mnar"))
    place = 1 - F.exp(F.ln(uniform(*AT, seed=seed, tag="pick")) / weight)
    return _hide(cells.join(F.broadcast(stats), list(keys)), place, share, keys).drop("mean", "sd")


def block(cells: DataFrame, share: float, seed: int, axis: str = "rows", keys=KEYS) -> DataFrame:
    """A run of neighbouring rows or columns, trimmed or topped up at random to the exact count."""
    what, other = ("row_id", "col_id") if axis == "rows" else ("col_id", "row_id")
    at = index_of(cells, what, keys)
    sizes = cells.groupBy(*keys).agg(F.count_distinct(what).alias("n_what"), F.count_distinct(other).alias("n_other")).join(wanted(cells, share, keys), list(keys))
    length = F.least(F.col("n_what"), F.greatest(F.lit(1), F.bround(F.col("n") / F.col("n_other"), 0).cast("bigint")))
    sizes = sizes.withColumn("length", length).withColumn("start", F.floor(uniform(F.lit("block"), seed=seed, tag="start") * (F.col("n_what") - F.col("length") + 1)))
    inside = F.col("place_of").between(F.col("start"), F.col("start") + F.col("length") - 1)
    placed = cells.join(at.withColumnRenamed("place", "place_of"), [*keys, what]).join(F.broadcast(sizes.select(*keys, "start", "length")), list(keys), "left")
    u = uniform(*AT, seed=seed, tag="trim")
    return _hide(placed, F.when(inside, u / 2).otherwise(0.5 + u / 2), share, keys).drop("start", "length", "place_of")


def bursty(cells: DataFrame, share: float, seed: int, burst_max: int = 6, keys=KEYS) -> DataFrame:
    """Short runs along a row or a column, in the order of their numbers, until the count is reached."""
    if burst_max < 3:
        raise ValueError("burst_max must be at least 3")
    shape = cells.groupBy(*keys).agg(F.count_distinct("row_id").alias("n_rows"), F.count_distinct("col_id").alias("n_cols")).join(wanted(cells, share, keys), list(keys))
    b = numbered(shape, F.col("n") + 1, "burst")
    u = lambda tag: uniform("burst", seed=seed, tag=tag)
    b = b.withColumn("length", 2 + F.floor(u("length") * (burst_max - 2)).cast("int")).withColumn("along_row", u("side") < 0.5)
    line, span = F.when(F.col("along_row"), F.col("n_rows")).otherwise(F.col("n_cols")), F.when(F.col("along_row"), F.col("n_cols")).otherwise(F.col("n_rows"))
    b = b.withColumn("line", F.floor(u("line") * line)).withColumn("start", F.floor(u("start") * F.greatest(F.lit(1), span - F.col("length") + 1)))
    b = b.select(*keys, "n", "burst", "along_row", "line", "start", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("k"))
    row = F.when(F.col("along_row"), F.col("line")).otherwise(F.col("start") + F.col("k"))
    col = F.when(F.col("along_row"), F.col("start") + F.col("k")).otherwise(F.col("line"))
    first = b.select(*keys, row.alias("row_at"), col.alias("col_at"), ((F.col("burst") * burst_max + F.col("k")) / ((F.col("n") + 1) * burst_max)).alias("drawn")).groupBy(*keys, "row_at", "col_at").agg(F.min("drawn").alias("drawn"))
    rows, cols = index_of(cells, "row_id", keys).withColumnRenamed("place", "row_at"), index_of(cells, "col_id", keys).withColumnRenamed("place", "col_at")
    placed = cells.join(rows, [*keys, "row_id"]).join(cols, [*keys, "col_id"]).join(first, [*keys, "row_at", "col_at"], "left")
    place = F.coalesce(F.col("drawn") / 2, 0.5 + uniform(*AT, seed=seed, tag="mcar") / 2)
    return _hide(placed, place, share, keys).drop("row_at", "col_at", "drawn")


def censor_above_threshold(cells: DataFrame, threshold: float = 100.0, column: int = 0, keys=KEYS) -> DataFrame:
    """Every value of one column above the threshold."""
    return cells.withColumn("hidden", F.coalesce((F.col("col_id") == column) & (F.col("value") > threshold), F.lit(False)))


def hide_cells(cells: DataFrame, kind: str, share: float | None = None, seed: int = 0, keys=KEYS, **params) -> DataFrame:
    """Any kind by its name."""
    if kind == "censor_above_threshold":
        return censor_above_threshold(cells, keys=keys, **params)
    makers = {"mcar": mcar, "mar_logistic": mar_logistic, "mnar_self_logistic": mnar_self_logistic, "block": block, "bursty": bursty}
    if kind not in makers:
        raise ValueError(f"kind must be one of {KINDS}")
    return makers[kind](cells, share, seed, keys=keys, **params)


def split_masks(cells: DataFrame, splits: DataFrame, kind: str, share: float, seed: int, target: int, keys=KEYS) -> DataFrame:
    """Feature cells hidden apart in train rows (seed) and test rows (seed + 10000); the target stays."""
    features = cells.filter(F.col("col_id") != target).join(splits, [*keys, "row_id"])
    parts = [hide_cells(features.filter(F.col("split") == split), kind, share, s, keys=[*keys, "split"]) for split, s in (("train", seed), ("test", seed + 10000))]
    kept = cells.filter(F.col("col_id") == target).join(splits, [*keys, "row_id"]).withColumn("hidden", F.lit(False))
    return parts[0].unionByName(parts[1]).unionByName(kept)
