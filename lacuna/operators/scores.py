"""Scores as aggregate columns, so that all of them share one pass over (truth, pred)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.registry import METRICS, TABLE_METRICS
from lacuna.operators.cells import finite, running


def scored(cells: DataFrame, truth: str = "truth", pred: str = "pred", flag: str | None = "is_eval") -> DataFrame:
    """The cells that count: flagged, with a finite truth and prediction."""
    x = cells.filter(F.col(flag)) if flag else cells
    return x.withColumn(truth, finite(F.col(truth))).withColumn(pred, finite(F.col(pred))).filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())


@METRICS.register("rmse")
def rmse(truth: Column, pred: Column) -> Column:
    return F.sqrt(F.avg((pred - truth) * (pred - truth)))


@METRICS.register("mae")
def mae(truth: Column, pred: Column) -> Column:
    return F.avg(F.abs(pred - truth))


def _by_range(error: Column, truth: Column) -> Column:
    span = F.max(truth) - F.min(truth)
    return F.when(span == 0, F.lit(0.0)).otherwise(F.try_divide(error, span))


@METRICS.register("nmae")
def nmae(truth: Column, pred: Column) -> Column:
    return _by_range(mae(truth, pred), truth)


@METRICS.register("nrmse")
def nrmse(truth: Column, pred: Column) -> Column:
    return _by_range(rmse(truth, pred), truth)


@METRICS.register("max_abs_error")
def max_abs_error(truth: Column, pred: Column) -> Column:
    return F.max(F.abs(pred - truth))


def score(cells: DataFrame, metrics: list[str], keys: list[str], truth: str = "truth", pred: str = "pred", flag: str | None = "is_eval", params: dict | None = None) -> DataFrame:
    """One row per run with a column for each metric and `n_scored`; metrics of whole tables are joined to it."""
    params = params or {}
    columns = [METRICS.named(m)(F.col(truth), F.col(pred), **params.get(m, {})).alias(m) for m in metrics if m not in TABLE_METRICS]
    out = scored(cells, truth, pred, flag).groupBy(*keys).agg(*columns, F.count(F.lit(1)).alias("n_scored"))
    for m in metrics:
        if m in TABLE_METRICS:
            out = out.join(TABLE_METRICS[m](cells.withColumnsRenamed({truth: "truth", pred: "pred"}), keys, **params.get(m, {})), keys, "left")
    return out


def accuracy_f1(rows: DataFrame, keys: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """accuracy, and F1 of class 1 (0 where it is not defined)."""
    y, p = F.col(label), F.col(pred)
    tp, wrong = F.count_if((y == 1) & (p == 1)), F.count_if((y == 1) != (p == 1))
    return rows.groupBy(*keys).agg(F.avg((y == p).cast("double")).alias("accuracy"), F.coalesce(F.try_divide(2.0 * tp, 2 * tp + wrong), F.lit(0.0)).alias("f1"))


def balanced_accuracy(rows: DataFrame, keys: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """The mean recall of the classes that occur."""
    recall = rows.groupBy(*keys, label).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("recall"))
    return recall.groupBy(*keys).agg(F.avg("recall").alias("balanced_accuracy"))


def _by_score(rows: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Per distinct score: positives, negatives, and both at higher scores."""
    n = rows.groupBy(*keys, score).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    return running(n, F.desc(score), {"pos_above": F.col("pos"), "neg_above": F.col("neg")}, keys)


def _auc() -> Column:
    return F.try_divide(F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)), F.sum("pos") * F.sum("neg")).alias("roc_auc")


def _precision() -> Column:
    upto = F.col("pos_above") + F.col("pos")
    part = F.sum(F.col("pos") * upto / (upto + F.col("neg_above") + F.col("neg")))
    return F.when(F.sum("neg") > 0, F.try_divide(part, F.sum("pos"))).alias("average_precision")


def roc_auc(rows: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Pairs in the right order, ties half; null with one class."""
    return _by_score(rows, keys, label, score).groupBy(*keys).agg(_auc())


def average_precision(rows: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Precision at each distinct score weighted by the recall it adds; null with one class."""
    return _by_score(rows, keys, label, score).groupBy(*keys).agg(_precision())


def ranked_scores(rows: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """`roc_auc` and `average_precision` from one ranking."""
    return _by_score(rows, keys, label, score).groupBy(*keys).agg(_auc(), _precision())


def r2(rows: DataFrame, keys: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    y, e = F.col(truth), F.col(truth) - F.col(pred)
    return rows.groupBy(*keys).agg((1 - F.try_divide(F.sum(e * e), F.count(F.lit(1)) * F.var_pop(y))).alias("r2"))


def mi_cells(cells: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """Over imputations: mean, population sd and between-imputation (sample) variance of each metric."""
    each = score(cells, metrics, [*keys, "imputation_id"])
    return each.groupBy(*keys).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.var_samp, "between"))])


def mi_vote(rows: DataFrame, keys: list[str], label: str = "pred") -> DataFrame:
    """Per row the label most imputations give, of equal ones the smallest, and the mean score."""
    n = rows.groupBy(*keys, "row_id", label).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    best = F.max(F.struct("n", (-F.col(label)).alias("low")))
    return n.groupBy(*keys, "row_id").agg((-best["low"]).alias(label), (F.sum("s") / F.sum("n")).alias("score"))
