"""Tables behind leaderboards, plots and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a result table that are no metrics.
NO_METRIC = ("bundle", "pattern", "missing_fraction", "seed", "method", "status", "error")


def ok(rows: DataFrame) -> DataFrame:
    """Rows whose status is ok; an absent status counts as that."""
    return rows.filter(F.coalesce(F.col("status"), F.lit("ok")) == "ok") if "status" in rows.columns else rows


def chosen(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that are ok and have one of the wanted values in each named column; an empty or absent choice takes all."""
    out = ok(rows)
    for column, values in wanted.items():
        if values:
            out = out.filter(F.col(column).isin(*(values if isinstance(values, (list, tuple, set)) else [values])))
    return out


def leaderboard(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Runs, means and population sds of the metrics."""
    return ok(rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("num_runs"), *[e for m in metrics for e in (F.avg(m).alias(m), F.stddev_pop(m).alias(f"{m}_std"))])


def metric_columns(rows: DataFrame) -> list[str]:
    """Columns whose values are all blank or numbers, with one number at least."""
    names = [c for c in rows.columns if c not in NO_METRIC]
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    read = lambda c: text(c).try_cast("double")
    row = rows.agg(*[e for c in names for e in (F.count_if((text(c) != "") & read(c).isNull()).alias(f"bad_{c}"), F.count(read(c)).alias(f"n_{c}"))]).first()
    return [c for c in names if row[f"n_{c}"] and not row[f"bad_{c}"]]


def long_metrics(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value), without blanks."""
    numbers = rows.select(*keys, *[F.trim(F.col(m).cast("string")).try_cast("double").alias(m) for m in metrics])
    return numbers.unpivot(keys, metrics, "metric", "value").filter("value IS NOT NULL")


def mean_ci95(long: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and half-width ``1.96 sd / sqrt(n)`` with the sample sd; 0 for one value."""
    n = F.count("value")
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.when(n > 1, 1.96 * F.stddev_samp("value") / F.sqrt(n)).otherwise(0.0).alias("ci95"), n.alias("n"))


def series(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Per series and x: mean, sample sd, ci95, points and seeds of finite pairs; the series is the first name given."""
    names = [F.col(c) for c in ("algorithm", "method", "model") if c in rows.columns]
    one = F.coalesce(*names, F.lit("series")) if names else F.lit("series")
    pairs = rows.select(one.alias("series"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col("seed")).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    n = F.count(F.lit(1))
    sd = F.when(n > 1, F.stddev_samp("y")).otherwise(0.0)
    return pairs.groupBy("series", "x").agg(F.avg("y").alias("mean"), sd.alias("sd"), (1.96 * sd / F.sqrt(n)).alias("ci95"), n.alias("points"), F.count_distinct("seed").alias("seeds"))


def violations(cells: DataFrame, bounds: DataFrame, columns: DataFrame, pred: str = "pred") -> DataFrame:
    """Counts and rates of missing and out-of-bounds values per method, and per method and column (null: all)."""
    x = cells.join(F.broadcast(columns), "col_id").join(F.broadcast(bounds), "column")  # a row per constrained column
    x = x.withColumn("oob", F.coalesce((F.col(pred) < F.col("lower")).cast("int"), F.lit(0)) + F.coalesce((F.col(pred) > F.col("upper")).cast("int"), F.lit(0))).withColumn("is_nan", F.col(pred).isNull().cast("int"))
    both = x.groupBy("method", "column").agg(F.count(F.lit(1)).alias("checked_count"), F.sum("is_nan").alias("nan_count"), F.sum("oob").alias("out_of_bounds_count"))
    # The coarser grain is a sum over the finer one's few rows.
    sums = [F.sum(c).alias(c) for c in ("checked_count", "nan_count", "out_of_bounds_count")]
    all_ = both.groupBy("method").agg(*sums).withColumn("column", F.lit(None).cast("string"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = both.unionByName(all_)
    return out.withColumns({"nan_rate": rate(F.col("nan_count"), F.col("checked_count")), "out_of_bounds_rate": rate(F.col("out_of_bounds_count"), F.col("checked_count")), "valid_out_of_bounds_rate": rate(F.col("out_of_bounds_count"), F.col("checked_count") - F.col("nan_count"))})


def pr_auc_alias(rows: DataFrame) -> DataFrame:
    """Every average precision once more as pr_auc."""
    return rows.withColumns({c.replace("average_precision", "pr_auc"): F.col(c) for c in rows.columns if c.startswith("downstream_average_precision_")})


#: Names of methods that are not simply their words.
PRETTY = {"tab_impute": "TabImpute", "tab_impute_constraints": "TabImputeConstraints", "TabImputeConstraints": "TabImputeConstraints"}


def pretty(name: Column) -> Column:
    """A method's name for readers."""
    out = F.initcap(F.trim(F.regexp_replace(name, "_", " ")))
    for key, value in PRETTY.items():
        out = F.when(name == key, value).otherwise(out)
    return out


def all_keys(parts: list[DataFrame]) -> DataFrame:
    """The union of result tables with different columns, sorted by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def failures(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("status") != "ok").alias("failed"))


def oracle_rows(rows: DataFrame) -> DataFrame:
    """Truth scored as a prediction."""
    return rows.withColumn("pred", F.col("truth")).withColumn("method", F.lit("oracle"))
