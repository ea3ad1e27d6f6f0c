"""Sinks, bundles and cut lineage."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the result tables.
DETAILED = ("preset_id", "seed", "algorithm", "status", "error", "noise_sigma", "noise_type", "rmse", "nrmse", "eval_count")
SUMMARY = ("preset_id", "algorithm", "noise_sigma", "noise_type", "num_runs", "rmse", "rmse_std", "nrmse", "nrmse_std")
BUNDLE = ("run_id", "row_id", "col_id", "truth", "observed", "is_eval")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode, where it is unset, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lacuna-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """`df` as a table in the shared folder, read again: what it comes from is computed once, and it outlives an executor.

    The table is removed when the driver ends.
    """
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lacuna-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


class Rounds:
    """The tables of a loop: where a round is written, the one before the last is removed, so there are two at most."""

    def __init__(self, spark: SparkSession, name: str = "round"):
        self.spark, self.name, self.paths = spark, name, []

    def write(self, df: DataFrame) -> DataFrame:
        """`df`, which may read the last round's table, but none before it."""
        out, path = _written(df, self.name)
        self.paths.append(path)
        while len(self.paths) > 2:
            _remove(self.spark, self.paths.pop(0))
        return out


def remove_at_end(spark: SparkSession, path: str) -> None:
    atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the JVM may have gone first
        return


def save_cells(cells: DataFrame, path: str, by: tuple[str, ...] = ("run_id",), mode: str = "error") -> None:
    """Parquet, a folder per run; `mode`: error, ignore (skip what is there) or overwrite."""
    cells.write.mode(mode).partitionBy(*by).parquet(path)


def load_bundle(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    missing = [c for c in BUNDLE if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def bundles(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Run ids that begin with `prefix`, sorted; none is an error."""
    found = spark.read.parquet(path).select("run_id").distinct().filter(F.col("run_id").startswith(prefix)).orderBy("run_id")
    if found.isEmpty():
        raise ValueError(f"no bundle in {path} begins with {prefix!r}")
    return found


def save_csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, mode: str = "overwrite") -> None:
    """A result table, a row per run of a benchmark, as one file with fixed columns."""
    (df.select(*columns) if columns else df).coalesce(1).write.mode(mode).option("header", True).csv(path)


def save_json(spark: SparkSession, value: dict, path: str) -> None:
    """One object, sorted keys and an indent of two, written through Spark."""
    text = json.dumps(value, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def keep_run(filled: DataFrame, path: str, method: str, begin: float) -> DataFrame:
    """The fills of a method under `path`/runs, and a row of `path`/log with the seconds since `begin`; read again."""
    spark = filled.sparkSession
    at = f"{path}/runs/method={method}"
    filled.write.mode("overwrite").parquet(at)
    row = [(run_id(), method, "ok", round(time.time() - begin, 3))]
    spark.createDataFrame(row, "log_id string, method string, status string, seconds double").coalesce(1).write.mode("append").parquet(f"{path}/log")
    return spark.read.parquet(at)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """(method, status, seconds) of the runs kept under `path`."""
    return spark.read.parquet(f"{path}/log").drop("log_id")


def saved_runs(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """The fills kept under `path`, with `method`; of runs that begin with `prefix`, none is an error."""
    out = spark.read.option("basePath", f"{path}/runs").parquet(f"{path}/runs").filter(F.col("run_id").startswith(prefix))
    if out.isEmpty():
        raise ValueError(f"no run in {path} begins with {prefix!r}")
    return out


def pending(grid: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of the grid that the log does not have as ok yet."""
    return grid.join(log.filter("status = 'ok'").select(*keys).distinct(), keys, "left_anti")


def run_id() -> str:
    return uuid.uuid4().hex
