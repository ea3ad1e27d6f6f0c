"""Commands: ``python -m lacuna.cli COMMAND``; tables are read and written by Spark."""

from __future__ import annotations

import argparse
import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.registry import IMPUTERS, METRICS, TABLE_METRICS, load_plugins, parameters
from lacuna.functions.session import local_session, ship
from lacuna.operators import diffusion, encode, impute, lowrank, masks, models, reports, scores  # noqa: F401  they register their methods
from lacuna.operators.cells import hide
from lacuna.plans import benchmarks, tabular
from lacuna.sources import catalog, readers, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lacuna")
    p.add_argument("--plugin", action="append", default=[])
    p.add_argument("--catalog")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        for flag, kw in flags:
            c.add_argument(flag, **kw)

    need, seed, js = {"required": True}, ("--seed", {"type": int, "default": 0}), ("--params-json", {"default": "{}"})
    task, models_ = ("--task", {"choices": ["classification", "regression"], "default": "classification"}), ("--models", {"nargs": "*", "default": list(models.MODELS)})
    add("prepare-split", ("--input", need), ("--output", need), ("--holdout-fraction", {"type": float, "required": True}), seed)
    add("run-algorithm", ("--bundle", need), ("--algorithm", need), ("--output", need), js)
    add("evaluate", ("--bundle", need), ("--predictions", need), ("--metrics", {"nargs": "+", "required": True}), ("--output", need), ("--metric-params-json", {"default": "{}"}))
    for name in ("list-algorithms", "list-metrics", "list-datasets"):
        add(name)
    add("fetch-dataset", ("--dataset-id", need), ("--paths", {"nargs": "+", "required": True}), ("--output", need), ("--skip-existing", {"action": "store_true"}), ("--force", {"action": "store_true"}))
    add("generate-missingness", ("--input", need), ("--output", need), ("--kind", need), ("--fraction", {"type": float}), seed, js)
    add("generate-simulated", ("--preset", need), ("--output", need), seed, js)
    add("multiple-imputations", ("--bundle", need), ("--output", need), ("--m", {"type": int, "default": 5}), ("--method", {"choices": ["gaussian", "forest_diffusion"], "default": "gaussian"}), seed, js)
    add("denoise", ("--output", need), ("--presets", {"nargs": "*"}), ("--seeds", {"nargs": "*", "type": int, "default": [0, 1, 2]}), ("--methods", {"nargs": "*", "default": list(benchmarks.METHODS)}))
    add("noise-sweep", ("--output", need), ("--levels", {"nargs": "*", "type": float, "default": [0.05, 0.1, 0.2, 0.35, 0.5]}))
    add("hankel", ("--output", need))
    add("make-noisy", ("--benchmark-id", need), ("--input", need), ("--output", need), seed)
    add("tabular-prepare", ("--input", need), ("--row", need), ("--target", need), ("--output", need), ("--exclude", {"nargs": "*", "default": []}), ("--patterns", {"nargs": "*", "default": list(tabular.PATTERNS)}), ("--fractions", {"nargs": "*", "type": float, "default": [0.1, 0.2, 0.4]}), ("--seeds", {"nargs": "*", "type": int, "default": [0, 1, 2]}))
    add("tabular-run", ("--bundles", need), ("--methods", {"nargs": "+", "required": True}), ("--output", need), task, models_)
    add("tabular-stages", ("--bundles", need), ("--methods", {"nargs": "+", "required": True}), ("--output", need), ("--stage", {"choices": ["impute", "evaluate", "all"], "default": "all"}), task, models_, js)
    add("tabular-evaluate", ("--bundles", need), ("--predictions", {"nargs": "+", "required": True}), ("--output", need), ("--target-col", {"type": int, "required": True}), task, models_)
    add("violations", ("--predictions", need), ("--columns", need), ("--bounds", need), ("--output", need))
    add("feature-ranking", ("--input", need), ("--target", need), ("--output", need), ("--top", {"type": int, "default": 20}))
    add("rerun-saved", ("--runs", need), ("--prefix", {"default": ""}), ("--algorithm", need), ("--output", need), js)
    return p


def _cells(spark, path: str):
    return readers.matrix(spark, path) if path.endswith((".csv", ".tsv", ".npy")) else spark.read.parquet(path)


def main(args: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(args)
    load_plugins(a.plugin)
    if a.command in ("list-algorithms", "list-metrics"):
        print(*sorted(IMPUTERS if a.command == "list-algorithms" else {**METRICS, **TABLE_METRICS}), sep="\n")
        return
    spark = spark or local_session()
    ship(spark)
    if a.command == "list-datasets":
        for r in catalog.listing(spark, catalog.load_catalog(a.catalog)).collect():
            print(r.section, r.name, r.description, sep="\t")
    elif a.command == "prepare-split":
        x = hide(masks.mcar(_cells(spark, a.input), a.holdout_fraction, a.seed))
        tables.save_cells(x.select("run_id", "row_id", "col_id", F.col("value").alias("truth"), "observed", F.col("hidden").alias("is_eval")), a.output)
    elif a.command == "run-algorithm":
        x = tables.load_bundle(spark, a.bundle).select("run_id", "row_id", "col_id", F.col("observed").alias("value"))
        tables.save_cells(IMPUTERS.named(a.algorithm)(x, **parameters(a.params_json)).withColumn("method", F.lit(a.algorithm)), a.output)
    elif a.command == "evaluate":
        x = tables.load_bundle(spark, a.bundle).join(spark.read.parquet(a.predictions).select("run_id", "row_id", "col_id", "pred"), ["run_id", "row_id", "col_id"])
        tables.save_csv(scores.score(x, a.metrics, ["run_id"], params=parameters(a.metric_params_json)), a.output)
    elif a.command == "fetch-dataset":
        if a.skip_existing and a.force:
            raise SystemExit("--skip-existing and --force exclude each other")
        x = readers.first_path(spark, a.paths, lambda p: readers.read_dataset(spark, a.dataset_id, p))
        x.write.mode("ignore" if a.skip_existing else "overwrite" if a.force else "error").parquet(a.output)
    elif a.command == "generate-missingness":
        x = masks.hide_cells(_cells(spark, a.input), a.kind, a.fraction, a.seed, **parameters(a.params_json))
        tables.save_cells(hide(x), a.output)
    elif a.command == "generate-simulated":
        preset = catalog.load_catalog(a.catalog)["synthetic_noisy_benchmarks"][a.preset]
        tables.save_cells(benchmarks.simulated(spark, preset, a.seed, f"{a.preset}-{a.seed}", parameters(a.params_json)).withColumnRenamed("value", "truth"), a.output)
    elif a.command == "multiple-imputations":
        x = tables.load_bundle(spark, a.bundle).select("run_id", "row_id", "col_id", F.col("observed").alias("value"))
        drawn = impute.mi_gaussian(x, a.m, a.seed) if a.method == "gaussian" else diffusion.diffusion_draws(x, k=a.m, seed=a.seed, **parameters(a.params_json))
        tables.save_cells(drawn, a.output, ("run_id", "imputation_id"))
    elif a.command == "denoise":
        presets = catalog.load_catalog(a.catalog)["synthetic_noisy_benchmarks"]
        rows = tables.cut_lineage(benchmarks.denoise(spark, {k: presets[k] for k in a.presets or presets}, a.seeds, a.methods))
        tables.save_csv(rows, f"{a.output}/detailed", tables.DETAILED)
        tables.save_csv(benchmarks.denoise_summary(rows), f"{a.output}/summary", tables.SUMMARY)
    elif a.command == "noise-sweep":
        tables.save_csv(benchmarks.noise_sweep(spark, a.levels), a.output)
    elif a.command == "hankel":
        tables.save_csv(benchmarks.hankel_benchmark(spark), a.output)
    elif a.command == "make-noisy":
        entries = catalog.load_catalog(a.catalog)["noisy_benchmarks"]
        if a.benchmark_id not in entries:
            raise SystemExit(f"{a.benchmark_id} is unknown; known are {', '.join(sorted(entries))}")
        tables.save_cells(benchmarks.noisy(_cells(spark, a.input), entries[a.benchmark_id], a.seed), a.output)
    elif a.command == "tabular-prepare":
        table = spark.read.option("header", True).csv(a.input) if a.input.endswith(".csv") else spark.read.parquet(a.input)
        table = encode.complete_cases(encode.encode(table, [a.row], a.target, tuple(a.exclude)))
        columns = [c for c in table.columns if c != a.row]
        cells = tabular.bundles(tables.cut_lineage(table), a.row, columns, a.target, tabular.grid(a.patterns, a.fractions, a.seeds))
        tables.save_cells(cells, f"{a.output}/cells")
        tables.save_json(spark, {"columns": columns, "target": a.target, "target_col": columns.index(a.target), "patterns": a.patterns, "fractions": a.fractions, "seeds": a.seeds}, f"{a.output}/meta")
    elif a.command == "tabular-run":
        meta = parameters("\n".join(r.value for r in spark.read.text(f"{a.bundles}/meta").collect()))
        runs = tabular.grid(meta["patterns"], meta["fractions"], meta["seeds"])
        rows = tabular.evaluate(spark.read.parquet(f"{a.bundles}/cells"), runs, tuple(a.methods), meta["target_col"], len(meta["columns"]), a.task, tuple(a.models))
        tables.save_csv(rows, a.output)
    elif a.command == "tabular-stages":  # what is there already is not done again
        meta = parameters("\n".join(r.value for r in spark.read.text(f"{a.bundles}/meta").collect()))
        runs, methods = tabular.grid(meta["patterns"], meta["fractions"], meta["seeds"]), tuple(a.methods)
        if a.stage in ("impute", "all"):
            tabular.impute_stage(spark.read.parquet(f"{a.bundles}/cells"), runs, methods, meta["target_col"], a.output, parameters(a.params_json))
        if a.stage in ("evaluate", "all"):
            tabular.evaluate_stage(spark, runs, methods, meta["target_col"], len(meta["columns"]), a.output, a.task, tuple(a.models))
        tables.save_csv(tabular.summary(spark, runs, methods, a.output, a.task), f"{a.output}/summary")
    elif a.command == "tabular-evaluate":
        truth = spark.read.parquet(a.bundles).select("run_id", "row_id", "col_id", "truth", "is_eval", "split")
        given = [truth.join(spark.read.parquet(p).select("run_id", "row_id", "col_id", "pred"), ["run_id", "row_id", "col_id"]).withColumn("imputation_id", F.lit(k)) for k, p in enumerate(a.predictions)]
        n_cols = truth.agg(F.max("col_id")).first()[0] + 1
        if len(given) > 1:
            out = tabular.evaluate_multiple(reduce(DataFrame.unionByName, given), a.target_col, n_cols, a.task, tuple(a.models))
        else:
            names = [f"downstream_accuracy_{m}" for m in a.models]
            out = scores.score(given[0], ["rmse", "mae", "nrmse", "nmae", *names], ["run_id"], params={m: {"target_col": a.target_col, "task": a.task} for m in names})
        tables.save_csv(out, a.output)
    elif a.command == "violations":
        read = lambda path: spark.read.option("header", True).option("inferSchema", True).csv(path)
        tables.save_csv(reports.violations(spark.read.parquet(a.predictions), read(a.bounds), read(a.columns)), a.output)
    elif a.command == "feature-ranking":
        table = spark.read.parquet(a.input).withColumnRenamed(a.target, "label")
        tables.save_csv(models.feature_ranking(table, [c for c, t in table.dtypes if c not in ("label", "split") and t in ("double", "float", "int", "bigint")], a.top), a.output)
    elif a.command == "rerun-saved":
        begin = time.time()
        x = tables.saved_runs(spark, a.runs, a.prefix).select("run_id", "row_id", "col_id", "value").dropDuplicates(["run_id", "row_id", "col_id"])
        tables.keep_run(IMPUTERS.named(a.algorithm)(x, **parameters(a.params_json)), a.output, a.algorithm, begin)


if __name__ == "__main__":
    main()
