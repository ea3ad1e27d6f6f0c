"""The tabular benchmark: patterns x fractions x seeds of one encoded table, filled, scored and judged by models."""

from __future__ import annotations

import time
from functools import reduce
from itertools import groupby, product

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import impute, masks, models, reports, scores
from lacuna.operators.cells import split_rows
from lacuna.operators.encode import to_cells
from lacuna.sources.tables import cut_lineage, pending

PATTERNS = ("mcar", "mar_logistic", "mnar_self_logistic", "block", "bursty")


def grid(patterns=PATTERNS, fractions=(0.1, 0.2, 0.4), seeds=(0, 1, 2)) -> list[tuple[str, str, float | None, int]]:
    """(run_id, pattern, fraction, seed); censoring has no fraction but all seeds."""
    out = []
    for pattern, seed in product(patterns, seeds):
        for f in (None,) if pattern.startswith("censor") else fractions:
            out.append((f"{pattern}_{'all' if f is None else f}_{seed}".replace(".", "p"), pattern, f, seed))
    return out


def bundles(table: DataFrame, row: str, columns: list[str], target: str, runs: list, test_share: float = 0.2, censor: dict | None = None) -> DataFrame:
    """Cells of all runs: `truth`, `value` without the hidden cells, `is_eval`, `split`; the target is never hidden."""
    at = columns.index(target)
    parts = []
    for run_id, pattern, fraction, seed in runs:
        x = to_cells(table, row, columns, run_id)
        splits = split_rows(x, test_share, seed)
        if fraction is None:
            y = masks.censor_above_threshold(x, **(censor or {})).join(splits, ["run_id", "row_id"]).withColumn("hidden", F.col("hidden") & (F.col("col_id") != at))
        else:
            y = masks.split_masks(x, splits, pattern, fraction, seed, at)
        parts.append(y.select("run_id", "row_id", "col_id", "split", F.col("value").alias("truth"), F.when(~F.col("hidden"), F.col("value")).alias("value"), F.col("hidden").alias("is_eval")))
    return reduce(DataFrame.unionByName, parts)


def fill(cells: DataFrame, method: str, target: int, **params) -> DataFrame:
    """Train and test rows filled apart; targets are never filled."""
    splits = cells.select("run_id", "row_id", "split").distinct()
    return impute.row_disjoint(cells.drop("split").withColumnRenamed("truth", "clean"), splits, method, target, **params).withColumnRenamed("clean", "truth")


def evaluate(cells: DataFrame, runs: list, methods: tuple[str, ...], target: int, n_cols: int, task: str = "classification", model_names: tuple[str, ...] = models.MODELS, sizes: dict | None = None, params: dict | None = None) -> DataFrame:
    """A row per run and method: cell scores, and `downstream_<score>_<model>` of each model.

    Cell scores of all runs are one plan; a model is fitted once per run and method, and all its scores come from that fit.
    """
    features = [f"f{c}" for c in range(n_cols) if c != target]
    parts = []
    for method in methods:
        filled = cut_lineage(fill(cells, method, target, **(params or {}).get(method, {})))  # read once per run and model
        s = scores.score(filled, ["rmse", "nrmse", "mae", "nmae"], ["run_id"]).withColumns({"method": F.lit(method), "status": F.lit("ok")})
        rows = []
        for run_id, *_ in runs:
            table = models.wide(filled.filter(F.col("run_id") == run_id), target, n_cols).withColumn("run_id", F.lit(run_id)).persist()
            out = None
            for model in model_names:
                p = models.predict(table, features, model, task, **(sizes or {}).get(model, {})).withColumn("run_id", F.lit(run_id))
                d = models.downstream(p, ["run_id"], task)
                d = d.select("run_id", *[F.col(c).alias(f"downstream_{c}_{model}") for c in d.columns if c != "run_id"])
                d = cut_lineage(d)  # one row
                out = d if out is None else out.join(d, "run_id")
            table.unpersist()
            if out is not None:
                rows.append(out)
        parts.append(s.join(reduce(DataFrame.unionByName, rows), "run_id", "left") if rows else s)
    info = cells.sparkSession.createDataFrame(runs, "run_id string, pattern string, missing_fraction double, seed long")
    return reports.pr_auc_alias(reports.all_keys(parts).join(F.broadcast(info), "run_id"))  # a row per run


LOG = "stage string, run_id string, method string, model string, status string, error string, seconds double"


def stage_log(spark: SparkSession, path: str) -> DataFrame:
    """What has been tried under `path`: a row for each fill ("impute") and each fit ("evaluate")."""
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException:  # nothing yet
        return spark.createDataFrame([], LOG)


def _note(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def _open_items(spark: SparkSession, path: str, stage: str, items: list[tuple]) -> list[tuple]:
    """Those (run, method, model) that the log does not have as ok."""
    grid_ = spark.createDataFrame([(stage, *i) for i in items], "stage string, run_id string, method string, model string")
    left = {(r.run_id, r.method, r.model) for r in pending(grid_, stage_log(spark, path), ["stage", "run_id", "method", "model"]).collect()}
    return [i for i in items if i in left]


def _save(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that `df` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def impute_stage(cells: DataFrame, runs: list, methods: tuple[str, ...], target: int, path: str, params: dict | None = None) -> None:
    """The fills of each run and method that are not there yet, under `path`/filled; the pending runs of a method are one plan.

    Where that plan fails each run is tried by itself, so that one that cannot be filled does not hold up the others.
    """
    spark = cells.sparkSession
    for method in methods:
        left = [i[0] for i in _open_items(spark, path, "impute", [(r[0], method, "") for r in runs])]
        groups, alone = [left] if left else [], len(left) < 2
        while groups:
            group, begin = groups.pop(0), time.time()
            try:
                filled = fill(cells.filter(F.col("run_id").isin(group)), method, target, **(params or {}).get(method, {}))
                _save(filled.withColumn("method", F.lit(method)), f"{path}/filled", "method", "run_id")
                _note(spark, path, [("impute", r, method, "", "ok", None, (time.time() - begin) / len(group)) for r in group])
            except Exception as e:  # noqa: BLE001  a method may fail in any way; its log says how
                if alone or len(group) == 1:
                    _note(spark, path, [("impute", r, method, "", "failed", str(e).split("\n")[0][:500], time.time() - begin) for r in group])
                else:
                    groups, alone = [[r] for r in group], True


def evaluate_stage(spark: SparkSession, runs: list, methods: tuple[str, ...], target: int, n_cols: int, path: str, task: str = "classification", model_names: tuple[str, ...] = models.MODELS, sizes: dict | None = None) -> None:
    """A fit for each run, method and model that is not there yet; test rows with ids, labels, predictions and scores go to `path`/predictions."""
    features = [f"f{c}" for c in range(n_cols) if c != target]
    done = {(r.run_id, r.method) for r in stage_log(spark, path).filter("stage = 'impute' AND status = 'ok'").select("run_id", "method").distinct().collect()}
    items = [(r[0], method, model) for method in methods for r in runs if (r[0], method) in done for model in model_names]
    for (run_id, method), group in groupby(_open_items(spark, path, "evaluate", items) if items else [], key=lambda i: i[:2]):
        table = cut_lineage(models.wide(spark.read.parquet(f"{path}/filled").filter((F.col("method") == method) & (F.col("run_id") == run_id)), target, n_cols))
        for _, _, model in group:
            begin = time.time()
            try:
                p = models.predict(table, features, model, task, **(sizes or {}).get(model, {}))
                _save(p.withColumns({"method": F.lit(method), "run_id": F.lit(run_id), "model": F.lit(model)}), f"{path}/predictions", "method", "run_id", "model")
                _note(spark, path, [("evaluate", run_id, method, model, "ok", None, time.time() - begin)])
            except Exception as e:  # noqa: BLE001  as above
                _note(spark, path, [("evaluate", run_id, method, model, "failed", str(e).split("\n")[0][:500], time.time() - begin)])


def summary(spark: SparkSession, runs: list, methods: tuple[str, ...], path: str, task: str = "classification") -> DataFrame:
    """A row per run and method from what the stages left: status, error, cell scores and each model's scores."""
    info = spark.createDataFrame([(*r, m) for r in runs for m in methods], "run_id string, pattern string, missing_fraction double, seed long, method string")
    log = stage_log(spark, path)
    ok = log.filter("status = 'ok'").select("stage", "run_id", "method", "model").distinct().withColumn("__ok", F.lit(True))
    failed = log.filter("status = 'failed'").join(ok, ["stage", "run_id", "method", "model"], "left_anti").groupBy("run_id", "method").agg(F.concat_ws("; ", F.sort_array(F.collect_set("error"))).alias("error"))  # a few per run
    keys, out = ["run_id", "method"], info
    if ok.filter("stage = 'impute'").count():
        out = out.join(scores.score(spark.read.parquet(f"{path}/filled"), ["rmse", "nrmse", "mae", "nmae"], keys), keys, "left")
    if ok.filter("stage = 'evaluate'").count():
        each = models.downstream(spark.read.parquet(f"{path}/predictions"), [*keys, "model"], task)
        names = [c for c in each.columns if c not in (*keys, "model")]
        pick = [F.max(F.when(F.col("model") == m, F.col(c))).alias(f"downstream_{c}_{m}") for m in models.MODELS for c in names]
        out = out.join(each.groupBy(*keys).agg(*pick), keys, "left")
    out = out.join(failed, keys, "left").join(ok.filter("stage = 'impute'").select(*keys, "__ok"), keys, "left")
    return out.withColumn("status", F.when(F.col("__ok") & F.col("error").isNull(), "ok").when(F.col("__ok"), "partial").when(F.col("error").isNotNull(), "failed").otherwise("pending")).drop("__ok")


def evaluate_multiple(cells: DataFrame, target: int, n_cols: int, task: str = "classification", model_names: tuple[str, ...] = models.MODELS, sizes: dict | None = None) -> DataFrame:
    """A row per run of cells with several imputations (`imputation_id`, `truth`, `pred`, `is_eval`, `split`).

    `<metric>_mi_mean`, `_mi_std` and `_mi_between_var` of the cells, and `downstream_<metric>_<model>_mi_mean`, `_mi_std`
    and `_mi_pooled`.  A model is fitted once per run and imputation.
    """
    names = ["rmse", "mae", "nrmse", "nmae"]
    cells = cut_lineage(cells)
    runs = cells.select("run_id", "imputation_id").distinct().orderBy("run_id", "imputation_id").collect()  # the fits to make
    if len(runs) < 2 * len({r.run_id for r in runs}):
        raise ValueError("two imputations or more are needed")
    features, predictions = [f"f{c}" for c in range(n_cols) if c != target], []
    for r in runs:
        table = models.wide(cells.filter((F.col("run_id") == r.run_id) & (F.col("imputation_id") == r.imputation_id)), target, n_cols).persist()
        for model in model_names:
            p = models.predict(table, features, model, task, **(sizes or {}).get(model, {}))
            predictions.append(cut_lineage(p.withColumns({"run_id": F.lit(r.run_id), "imputation_id": F.lit(r.imputation_id), "model": F.lit(model)})))
        table.unpersist()
    own = scores.mi_cells(cells, names, ["run_id"])
    own = own.withColumnsRenamed({f"{m}_{a}": f"{m}_mi_{b}" for m in names for a, b in (("mean", "mean"), ("std", "std"), ("between", "between_var"))})
    down = models.mi_downstream(reduce(DataFrame.unionByName, predictions), ["run_id", "model"], task)
    return own.join(models.mi_wide(down, ["run_id"]), "run_id", "left")
