"""Readers of the layouts the benchmarks come in, all on Spark's own sources."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.operators.cells import finite, from_triplets, panel
from lacuna.operators.encode import encode
from lacuna.sources import files
from lacuna.sources.tables import cut_lineage, remove_at_end, run_id, shared_dir

# Accepted names of panel columns, in the order they are tried.
UNIT = ("state", "regionname", "region", "unit")
TIME = ("year", "time", "period")
VALUE = {"prop99_smoking": ("cigsale", "cig.sales", "outcome"), "basque_gdpcap": ("gdpcap", "gdp.cap", "outcome")}
OTHER_VALUE = ("outcome", "value")


def first_path(spark: SparkSession, paths: list[str], read) -> DataFrame:
    """The first of `paths` that reads and has rows."""
    errors = []
    for path in paths:
        try:
            df = read(path)
            if not df.isEmpty():
                return df
            errors.append(f"{path}: empty")
        except Exception as e:  # noqa: BLE001  the next mirror is tried
            errors.append(f"{path}: {type(e).__name__}")
    raise FileNotFoundError("; ".join(errors))


def matrix(spark: SparkSession, path: str, run_id: str = "r") -> DataFrame:
    """Cells of a headerless .csv or .tsv, or of a .npy file; where only Spark can open that, or there are several, a file a task."""
    if path.endswith((".csv", ".tsv")):
        sep = "," if path.endswith(".csv") else "\t"
        # Lines are numbered within each partition of the file, and partitions by their counts.
        lines = cut_lineage(spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.split("value", sep).alias("x")))
        lines = lines.select(F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("line"), "x")
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
        first = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        x = lines.join(F.broadcast(first), "part").select((F.col("first") + F.col("line")).alias("row_id"), F.posexplode("x").alias("col_id", "v"))
        return x.select(F.lit(run_id).alias("run_id"), "row_id", F.col("col_id").cast("long").alias("col_id"), finite(F.trim("v").try_cast("double")).alias("value"))
    if not path.endswith(".npy"):
        raise ValueError("a matrix is a .npy, .csv or .tsv file")

    if files.reachable(path):
        files.register(spark)
        return spark.read.format("npy_matrix").option("path", path).load().select(F.lit(run_id).alias("run_id"), "*")

    def explode(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                x = np.load(io.BytesIO(content)).astype(float)
                r, c = np.divmod(np.arange(x.size), x.shape[1])
                v = x.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(c), pa.array(np.where(np.isfinite(v), v, np.nan), from_pandas=True)], names=["row_id", "col_id", "value"])

    whole = spark.read.format("binaryFile").load(path).select("content")
    return whole.mapInArrow(explode, "row_id long, col_id long, value double").select(F.lit(run_id).alias("run_id"), "*")


def typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A result table with a header: columns whose values are all blank or finite numbers, one at least, become numbers."""
    rows = spark.read.option("header", True).csv(path)
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    found = rows.agg(*[e for i, c in enumerate(rows.columns) for e in (F.count_if((text(c) != "") & finite(text(c).try_cast("double")).isNull()).alias(f"bad{i}"), F.count(finite(text(c).try_cast("double"))).alias(f"n{i}"))]).first()
    return rows.select(*[text(c).try_cast("double").alias(c) if found[f"n{i}"] and not found[f"bad{i}"] else F.col(f"`{c}`") for i, c in enumerate(rows.columns)])


def _ratings(rows: DataFrame, run_id: str) -> DataFrame:
    return from_triplets(rows.select(F.lit(run_id).alias("run_id"), F.col("user").cast("long").alias("row_key"), F.col("item").cast("long").alias("col_key"), F.col("rating").cast("double").alias("value"), F.monotonically_increasing_id().alias("ordinal")))


def ratings(spark: SparkSession, path: str, layout: str, run_id: str = "r") -> DataFrame:
    """Cells of users and items; layouts: tab, double_colon (latin-1), csv (a header), tweets (double colon, short lines left out)."""
    if layout == "csv":
        return _ratings(spark.read.csv(path, header=True).select(F.col("userId").alias("user"), F.col("movieId").alias("item"), "rating"), run_id)
    if layout not in ("tab", "double_colon", "tweets"):
        raise ValueError(f"unknown layout {layout}")
    lines = spark.read.option("encoding", "ISO-8859-1").csv(path, sep="\x01", schema="value string") if layout == "double_colon" else spark.read.text(path)
    parts = lines.select(F.split(F.trim("value"), "\t" if layout == "tab" else "::").alias("x")).filter(F.size("x") >= 3)
    rows = parts.select(F.col("x")[0].alias("user"), F.col("x")[1].alias("item"), F.col("x")[2].alias("rating"))
    if layout == "tweets" and rows.isEmpty():
        raise ValueError(f"{path} has no ratings")
    return _ratings(rows, run_id)


def panel_csv(spark: SparkSession, path: str, dataset: str, run_id: str = "r") -> DataFrame:
    long = spark.read.csv(path, header=True).withColumn("ordinal", F.monotonically_increasing_id()).withColumn("run_id", F.lit(run_id))
    return panel(long, list(UNIT), list(TIME), list(VALUE.get(dataset, OTHER_VALUE)))


def unzipped(spark: SparkSession, path: str, ending: str = ".csv") -> str:
    """A folder of the shared kind with the lines of the largest member of an archive whose name has this ending."""
    named = [(size, name) for name, size in files.members(path) if name.lower().endswith(ending)]
    if not named:
        raise FileNotFoundError(f"no {ending} in {path}")
    files.register(spark)
    out = f"{shared_dir(spark)}/lacuna-unzipped-{run_id()}"
    lines = spark.read.format("zip_lines").option("path", path).option("members", max(named)[1]).load()
    lines.select("value").write.text(out)
    remove_at_end(spark, out)
    return out


def largest_csv(spark: SparkSession, folder: str) -> str:
    """The path of the largest CSV below a folder, or in an archive."""
    if folder.endswith(".zip"):
        return unzipped(spark, folder)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    path = found.agg(F.max_by("path", "length").alias("path")).first().path
    if path is None:
        raise FileNotFoundError(f"no CSV in {folder}")
    return path


def tabular(spark: SparkSession, folder: str, hot: bool = False) -> DataFrame:
    """The largest CSV of a folder, encoded, with a `row_id`."""
    table = spark.read.csv(largest_csv(spark, folder), header=True).withColumn("row_id", F.monotonically_increasing_id())
    return encode(table, ["row_id"], hot=hot)


# Ids of data sets with a reader.
READERS = {
    "movielens_100k": lambda spark, path: ratings(spark, path, "tab"),
    "movielens_1m": lambda spark, path: ratings(spark, path, "double_colon"),
    "movielens_latest_small": lambda spark, path: ratings(spark, path, "csv"),
    "movielens_20m": lambda spark, path: ratings(spark, path, "csv"),
    "movietweetings": lambda spark, path: ratings(spark, path, "tweets"),
    "prop99_smoking": lambda spark, path: panel_csv(spark, path, "prop99_smoking"),
    "basque_gdpcap": lambda spark, path: panel_csv(spark, path, "basque_gdpcap"),
    "ckd_ehr_abu_dhabi": tabular,
}


def read_dataset(spark: SparkSession, dataset: str, path: str) -> DataFrame:
    if dataset not in READERS:
        raise NotImplementedError(f"{dataset} has no reader; known are {', '.join(sorted(READERS))}")
    return READERS[dataset](spark, path)


def eval_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, method, task, metric, value) of evaluation files: downstream, multiple-imputation and cell metrics, later ones winning."""
    one = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    kind = "map<string,double>"
    x = one.select("file", *[F.coalesce(F.from_json(F.get_json_object("value", f"$.{k}"), kind), F.from_json(F.lit("{}"), kind)).alias(k) for k in ("downstream_metrics", "multiple_imputation_metrics", "imputation_metrics")], F.get_json_object("value", "$.prediction_paths[0]").alias("first"), F.coalesce(F.get_json_object("value", "$.task"), F.lit("unknown")).alias("task"))
    method = F.coalesce(F.try_element_at(F.split("first", "/"), F.lit(-2)), F.regexp_extract("file", r"([^/]+?)(?:\.\w+)?$", 1))
    later = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    merged = later(later(F.col("downstream_metrics"), F.col("multiple_imputation_metrics")), F.col("imputation_metrics"))
    return x.select("file", method.alias("method"), "task", F.explode(merged).alias("metric", "value"))
