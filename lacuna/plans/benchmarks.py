"""Whole benchmarks: presets x seeds x methods as one table of runs each."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.registry import IMPUTERS
from lacuna.operators import hankel, reports, scores, simulate
from lacuna.operators.cells import KEYS
from lacuna.sources.catalog import HANKEL, SYNTHETIC
from lacuna.sources.tables import cut_lineage, keep_run

METHODS = ("global_mean", "row_mean", "soft_impute", "svt", "nuclear_norm_minimization", "robust_pca")
HANKEL_METHODS = {"global_mean": {}, "soft_impute": {}, "cadzow": {"max_iters": 120}}


def simulated(spark: SparkSession, preset: dict, seed: int, run_id: str, overrides: dict | None = None) -> DataFrame:
    """The cells of a synthetic preset: clean `value`, noisy `observed`, `is_eval`."""
    p = {**preset["params"], **(overrides or {})}
    grid = simulate.grid(spark, p["n_rows"], p["n_cols"], run_id)
    if preset["dgp_type"] == "low_rank_gaussian":
        truth = simulate.low_rank_gaussian(grid, p["rank"], seed, p.get("factor_scale", 1.0))
    elif preset["dgp_type"] == "block_low_rank":
        truth = simulate.block_low_rank(grid, p.get("n_row_groups", 5), p.get("n_col_groups", 4), seed, p.get("group_noise", 0.08))
    elif preset["dgp_type"] == "low_rank_orthogonal":
        truth = simulate.low_rank_orthogonal(grid, p["rank"], seed, p.get("singular_decay", 0.82))
    else:
        raise ValueError(f"unknown generator {preset['dgp_type']}")
    noise = {"gaussian": {"sigma": p.get("sigma")}, "student_t": {"df": p.get("df"), "scale": p.get("scale")}, "sparse_corruption": {"fraction": p.get("corruption_fraction"), "scale": p.get("corruption_scale")}}[preset["noise_type"]]
    return simulate.denoising_benchmark(truth, preset["noise_type"], seed, p["observed_fraction"], p["eval_fraction"], **noise)


def denoise(spark: SparkSession, presets: dict | None = None, seeds=(0, 1, 2), methods=METHODS, params: dict | None = None, artifacts: str | None = None) -> DataFrame:
    """A row per preset, seed and method: status, error, rmse, nrmse, eval_count.

    An unknown method gives failed rows.  All runs of a method are filled by one plan, from
    cells written once.  With `artifacts`, a folder, each method's fills are kept there with
    how long they took (`saved_runs`, `run_log`).
    """
    presets = SYNTHETIC if presets is None else presets
    grid = [(f"{name}/{seed}", name, seed, preset) for name, preset in presets.items() for seed in seeds]
    runs = spark.createDataFrame([(r, n, s, simulate.noise_level(p["noise_type"], p["params"].get("sigma"), p["params"].get("scale"), p["params"].get("corruption_scale")), p["noise_type"]) for r, n, s, p in grid], "run_id string, preset_id string, seed long, noise_sigma double, noise_type string")
    cells = cut_lineage(reduce(DataFrame.unionByName, [simulated(spark, p, s, r).select("run_id", F.col("row_id").cast("long").alias("row_id"), F.col("col_id").cast("long").alias("col_id"), F.col("value").alias("truth"), F.col("observed").alias("value"), "is_eval") for r, _, s, p in grid]))
    parts = []
    for method in methods:
        base = runs.withColumn("algorithm", F.lit(method))
        if method not in IMPUTERS:
            parts.append(base.withColumns({"status": F.lit("failed"), "error": F.lit("unknown method")}))
            continue
        hidden = cells.filter("is_eval").select("run_id", "row_id", "col_id", "truth", "is_eval")
        begin = time.time()
        filled = IMPUTERS[method](cells.select(*KEYS, "row_id", "col_id", "value"), **(params or {}).get(method, {}))
        filled = filled if artifacts is None else keep_run(filled, artifacts, method, begin)
        filled = cut_lineage(filled)  # read for the errors and for the scores
        errors = filled.groupBy("run_id").agg(F.max("error").alias("error")) if "error" in filled.columns else filled.select("run_id").distinct().withColumn("error", F.lit(None).cast("string"))
        s = scores.score(filled.join(hidden, ["run_id", "row_id", "col_id"]), ["rmse", "nrmse"], ["run_id"]).withColumnRenamed("n_scored", "eval_count")
        parts.append(base.join(errors, "run_id").join(s, "run_id", "left").withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("failed")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select("preset_id", "seed", "algorithm", "status", "error", "noise_sigma", "noise_type", "rmse", "nrmse", "eval_count")


def noisy(cells: DataFrame, entry: dict, seed: int) -> DataFrame:
    """The cells of a `noisy_benchmarks` entry: `value` with its noise added."""
    p = entry["params"]
    if entry["noise_type"] == "one_bit_flip":
        out = cells.withColumn("noisy", simulate.one_bit_flip(F.col("value"), seed, float(p.get("threshold", 3.0)), float(p.get("flip_probability", 0.15))))
    elif entry["noise_type"] in ("gaussian", "sparse_corruption"):
        out = simulate.add_noise(cells, entry["noise_type"], seed, sigma=float(p.get("sigma", 0.25)), fraction=float(p.get("corruption_fraction", 0.1)), scale=float(p.get("corruption_scale", 2.5)))
        out = out.withColumn("noisy", simulate.clip(F.col("noisy"), p.get("clip_min"), p.get("clip_max")))
    else:
        raise ValueError(f"unknown noise {entry['noise_type']}")
    return out.drop("value").withColumnRenamed("noisy", "value")


def denoise_summary(detailed: DataFrame) -> DataFrame:
    return reports.leaderboard(detailed, ["preset_id", "algorithm", "noise_sigma", "noise_type"], ["rmse", "nrmse"]).orderBy("preset_id", "algorithm")


def noise_sweep(spark: SparkSession, levels=(0.05, 0.1, 0.2, 0.35, 0.5), methods=("global_mean", "soft_impute", "svt", "robust_pca"), seed: int = 42, base: str = "sim_lr_gaussian_sigma_0p1") -> DataFrame:
    """As `denoise` over levels of normal noise; an unknown method raises."""
    if any(x < 0 for x in levels):
        raise ValueError("noise levels must not be negative")
    for m in methods:
        IMPUTERS.named(m)
    presets = {f"{base}@{x}": {**SYNTHETIC[base], "params": {**SYNTHETIC[base]["params"], "sigma": x}} for x in levels}
    return denoise(spark, presets, (seed,), methods)


def hankel_benchmark(spark: SparkSession, presets: dict | None = None, methods: dict | None = None, seed: int = 42) -> DataFrame:
    """A row per preset and method: rmse_all, rmse_missing, nrmse_missing, n_missing."""
    parts, damped = [], {"spectrally_sparse_complex": False, "damped_spectrally_sparse": True}
    for name, preset in (HANKEL if presets is None else presets).items():
        p = preset["params"]
        x = simulate.signal(spark, p["n"], p["rank"], seed, damped[preset["signal_model"]], p.get("noise_sigma", 0.01), name)
        x = hankel.hide_points(x, preset["mask_type"], p["missing_fraction"], seed).withColumn("observed", F.when(~F.col("hidden"), F.col("noisy")))
        x = cut_lineage(x)
        for method, params in (HANKEL_METHODS if methods is None else methods).items():
            params = {"rank": p["rank"], **params} if method == "cadzow" else params
            done = x.join(hankel.reconstruct(x, p["window_length"], method, **params), ["series_id", "t"])
            parts.append(hankel.scores(done).select(F.col("series_id").alias("preset_id"), F.lit(method).alias("algorithm"), F.lit(p.get("noise_sigma", 0.01)).alias("noise_sigma"), F.lit(p["missing_fraction"]).alias("missing_fraction"), F.lit(preset["signal_model"]).alias("signal_model"), F.lit(preset["mask_type"]).alias("mask_type"), "rmse_all", "rmse_missing", "nrmse_missing"))
    return reduce(DataFrame.unionByName, parts)
