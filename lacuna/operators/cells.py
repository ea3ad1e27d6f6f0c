"""Cells: a grid with a row per (run, row_id, col_id) and a value that is null where it is missing.

Every operator carries key columns (`keys`, the runs of a grid of experiments) through
its windows and joins, so that many runs are one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("run_id",)
AT = ("row_id", "col_id")


def finite(value: Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def complete_grid(known: DataFrame, keys=KEYS) -> DataFrame:
    """The full grid of each run's rows and columns, null where `known` has no value.

    `known` is written first, so that what it comes from is read once.  The rows of a
    run are dealt over `parts` and meet its columns in each, so that a large run is not
    built in one task.
    """
    from lacuna.sources.tables import cut_lineage

    known = cut_lineage(known.select(*keys, *AT, finite(F.col("value")).alias("value")))
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = known.select(*keys, "row_id").distinct().withColumn("__part", F.pmod(F.hash("row_id"), F.lit(parts)))
    cols = known.select(*keys, "col_id").distinct().withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.join(cols, [*keys, "__part"]).drop("__part").join(known, [*keys, *AT], "left").select(*keys, *AT, "value")


#: Rows of all runs up to which a window for each run takes their running sums.
FEW_ROWS = 1 << 16


def running(df: DataFrame, order: Column, sums: dict[str, Column], keys=KEYS) -> DataFrame:
    """Adds for each name the sum of its column over the rows of the run that come before.

    `df` is written first, so its rows can be counted.  Up to FEW_ROWS a window does; more
    are dealt into ranges of `order`, summed within each, and ranges by their totals: no task
    sees a large run whole.
    """
    from lacuna.sources.tables import cut_lineage

    x = cut_lineage(df.select("*", *[c.cast("bigint").alias(f"__{k}") for k, c in sums.items()]))
    upto = lambda *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if x.count() <= FEW_ROWS:
        return x.withColumns({k: F.coalesce(F.sum(f"__{k}").over(upto(*keys)), F.lit(0)) for k in sums}).drop(*[f"__{k}" for k in sums])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = cut_lineage(x.repartitionByRange(parts, *[F.col(k) for k in keys], order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy(*keys, "__range").agg(*[F.sum(f"__{k}").alias(f"__of_{k}") for k in sums])  # runs x partitions rows
    totals = totals.select(*keys, "__range", *[F.coalesce(F.sum(f"__of_{k}").over(before), F.lit(0)).alias(f"__from_{k}") for k in sums])
    x = x.withColumns({k: F.coalesce(F.sum(f"__{k}").over(upto(*keys, "__range")), F.lit(0)) for k in sums}).join(F.broadcast(totals), [*keys, "__range"])
    return x.withColumns({k: F.col(k) + F.col(f"__from_{k}") for k in sums}).drop("__range", *[f"__{k}" for k in sums], *[f"__from_{k}" for k in sums])


def ranked(distinct: DataFrame, by: str, out: str, keys=KEYS) -> DataFrame:
    """Adds `out`: the place, from 0, of each row of a run in the order of the distinct `by`."""
    return running(distinct, F.asc(by), {out: F.lit(1)}, keys)


def from_triplets(triplets: DataFrame, keys=KEYS) -> DataFrame:
    """Cells from (row_key, col_key, value, ordinal): ids are ranks of the keys, and the last of equal places counts."""
    from lacuna.sources.tables import cut_lineage

    last = cut_lineage(triplets.groupBy(*keys, "row_key", "col_key").agg(F.max_by("value", "ordinal").alias("value")))
    # Ranks are taken over the distinct keys of a run, never over its cells.
    rows = ranked(last.select(*keys, "row_key").distinct(), "row_key", "row_id", keys)
    cols = ranked(last.select(*keys, "col_key").distinct(), "col_key", "col_id", keys)
    known = last.join(rows, [*keys, "row_key"]).join(cols, [*keys, "col_key"]).select(*keys, "row_id", "col_id", "value")
    return complete_grid(known, keys)


def pick_column(names: list[str], wanted: list[str], what: str) -> str:
    """The first of `wanted` among `names`, in any case."""
    have = {n.lower(): n for n in names}
    for w in wanted:
        if w.lower() in have:
            return have[w.lower()]
    raise ValueError(f"no column for {what}: looked for {wanted} among {names}")


def panel(long: DataFrame, unit: list[str], time: list[str], value: list[str], keys=KEYS) -> DataFrame:
    """Cells from a long table: units as strings, periods as whole numbers; rows that do not parse are left out."""
    u, t, v = (pick_column(long.columns, w, n) for w, n in ((unit, "unit"), (time, "time"), (value, "value")))
    rows = long.select(*keys, F.col(f"`{u}`").cast("string").alias("row_key"), F.expr(f"cast(try_cast(`{t}` as double) as bigint)").alias("col_key"), F.expr(f"try_cast(`{v}` as double)").alias("value"), "ordinal")
    return from_triplets(rows.dropna(subset=["row_key", "col_key", "value"]), keys)


def hide(cells: DataFrame, flag: str = "hidden") -> DataFrame:
    """`observed`: the value, null where `flag` holds."""
    return cells.withColumn("observed", F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col("value")))


def index_of(cells: DataFrame, what: str, keys=KEYS) -> DataFrame:
    """(keys, what, place): each run's distinct rows or columns numbered from 0."""
    return ranked(cells.select(*keys, what).distinct(), what, "place", keys)


def counts(cells: DataFrame, keys=KEYS) -> DataFrame:
    """Per run: cells, known cells, the share that is missing."""
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.count("value").alias("n_known"), (1 - F.count("value") / F.count(F.lit(1))).alias("missing_share"))


def complete_rows(cells: DataFrame, keys=KEYS) -> DataFrame:
    """Rows without a missing value."""
    return cells.groupBy(*keys, "row_id").agg(F.count("value").alias("known"), F.count(F.lit(1)).alias("all")).filter("known = all").select(*keys, "row_id")


def flag_least(df: DataFrame, place: Column, want: Callable[[Column], Column], out: str, keys=KEYS, tie=AT, slices: int = 4096) -> DataFrame:
    """Adds boolean `out`: whether a row is among those of its run with the least `place`, exactly `want(n)` of n placed rows.

    `place` lies in [0, 1); rows where it is null are not placed, and false.  Places are
    counted by slices, only the slice with the last wanted row is ranked, and that row is
    sent out (one a run): nothing but counts and the rows of a slice is shuffled.
    """
    x = df.withColumn("__place", place)
    placed = x.filter("__place IS NOT NULL").select(*keys, *tie, "__place", F.floor(F.col("__place") * slices).cast("int").alias("__slice"))
    run = Window.partitionBy(*keys)
    n = placed.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))  # at most runs x slices rows
    upto = F.sum("__n").over(run.orderBy("__slice"))
    n = n.select(*keys, "__slice", "__n", upto.alias("__upto"), want(F.sum("__n").over(run)).alias("__want")).filter((F.col("__upto") >= F.col("__want")) & (F.col("__upto") - F.col("__n") < F.col("__want")))
    n = n.select(*keys, "__slice", (F.col("__want") - F.col("__upto") + F.col("__n")).alias("__k"))  # a row per run
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__place", *tie))
    last = placed.join(F.broadcast(n), [*keys, "__slice"]).withColumn("__rank", rank).filter("__rank = __k").select(*keys, F.struct("__place", *tie).alias("__last"))
    return x.join(F.broadcast(last), list(keys), "left").withColumn(out, F.coalesce(F.struct("__place", *tie) <= F.col("__last"), F.lit(False)) & F.col("__place").isNotNull()).drop("__place", "__last")


def numbered(df: DataFrame, n: Column, out: str, chunk: int = 1 << 16) -> DataFrame:
    """Each row `n` times, with `out` from 0 to n - 1: by chunks that are dealt over the tasks, so that no array has more than `chunk` entries."""
    x = df.withColumn("__n", n.cast("bigint")).filter("__n > 0")
    x = x.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / chunk)))).repartition(*df.columns, "__chunk")
    begin = F.col("__chunk") * chunk
    return x.withColumn(out, F.explode(F.sequence(begin, F.least(begin + chunk, F.col("__n")) - 1))).drop("__n", "__chunk")


def part_of(share: float, least: int = 1) -> Callable[[Column], Column]:
    """How many of n: the share, rounded half to even, and `least` at least."""
    return lambda n: F.greatest(F.lit(least), F.bround(n * F.lit(float(share)), 0).cast("bigint"))


def split_rows(cells: DataFrame, test_share: float, seed: int, keys=KEYS) -> DataFrame:
    """(keys, row_id, split): `max(1, round(n * test_share))` random rows test, the others train."""
    from lacuna.functions.rand import uniform

    rows = flag_least(cells.select(*keys, "row_id").distinct(), uniform("row_id", seed=seed, tag="split"), part_of(test_share), "test", keys, ("row_id",))
    return rows.select(*keys, "row_id", F.when(F.col("test"), "test").otherwise("train").alias("split"))
