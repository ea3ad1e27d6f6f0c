"""The tables the queries run on, each as a DataFrame and as the SQL that states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.cells import complete_grid
from lacuna.sources.tables import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sup_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known cells of supplier x month: the mean quantity."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint")
    return table(spark, sf_dir, "lineitem").groupBy(F.lit("r").alias("run_id"), F.col("l_suppkey").alias("row_id"), month.alias("col_id")).agg(F.round(F.avg("l_quantity"), 9).alias("value"))


def sup_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_grid(sup_known(spark, sf_dir))


def user_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user x hour of day: the mean event value."""
    known = table(spark, sf_dir, "events").groupBy(F.lit("r").alias("run_id"), F.col("user_id").alias("row_id"), F.hour("ts").cast("bigint").alias("col_id")).agg(F.round(F.avg("value"), 9).alias("value"))
    return cut_lineage(complete_grid(known))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean event value of each day, t from 0; written, as series are read many times."""
    t = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    return cut_lineage(table(spark, sf_dir, "events").groupBy(F.lit("s").alias("series_id"), t.cast("int").alias("t")).agg(F.round(F.avg("value"), 9).alias("value")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as benchmark results."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("preset_id"), F.col("l_linestatus").alias("algorithm"), F.col("l_linenumber").cast("bigint").alias("seed"),
        F.when(F.col("l_linenumber") == 7, "failed").otherwise("ok").alias("status"), F.col("l_tax").alias("noise_sigma"), F.col("l_quantity").alias("rmse"), F.col("l_discount").alias("nrmse"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as classified rows: label, prediction and a tied score."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_returnflag").alias("method"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("label"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("pred"), F.col("l_quantity").alias("score"))


def u_sql(parts: str, seed: int | str, tag: str) -> str:
    return f"((('0x' || substring(md5(concat_ws('|', {parts}, {seed}, '{tag}')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def z_sql(parts: str, seed: int | str, tag: str) -> str:
    return f"(sqrt(-2 * ln({u_sql(parts, seed, tag + '1')})) * cos(2 * pi() * {u_sql(parts, seed, tag + '2')}))"


SUP = """sup_known AS (SELECT l_suppkey AS row_id, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS col_id, round(avg(l_quantity), 9) AS value FROM lineitem GROUP BY 1, 2),
cells AS (SELECT r.row_id, c.col_id, k.value FROM (SELECT DISTINCT row_id FROM sup_known) r CROSS JOIN (SELECT DISTINCT col_id FROM sup_known) c LEFT JOIN sup_known k ON k.row_id = r.row_id AND k.col_id = c.col_id)"""
HOUR = """uh AS (SELECT user_id AS row_id, CAST(hour(ts) AS BIGINT) AS col_id, round(avg(value), 9) AS value FROM events GROUP BY 1, 2),
cells AS (SELECT r.row_id, c.col_id, k.value FROM (SELECT DISTINCT row_id FROM uh) r CROSS JOIN (SELECT DISTINCT col_id FROM uh) c LEFT JOIN uh k ON k.row_id = r.row_id AND k.col_id = c.col_id)"""
DAILY = "daily AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, round(avg(value), 9) AS value FROM events GROUP BY 1)"
RUNS = "runs AS (SELECT l_returnflag AS preset_id, l_linestatus AS algorithm, CAST(l_linenumber AS BIGINT) AS seed, CASE WHEN l_linenumber = 7 THEN 'failed' ELSE 'ok' END AS status, l_tax AS noise_sigma, l_quantity AS rmse, l_discount AS nrmse FROM lineitem)"
LABELLED = "x AS (SELECT l_returnflag AS method, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS pred, l_quantity AS score FROM lineitem)"
