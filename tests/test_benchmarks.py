import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna import cli
from lacuna.plans import benchmarks
from lacuna.sources import catalog, tables

SMALL = {"n_rows": 60, "n_cols": 40, "rank": 3, "observed_fraction": 0.6, "eval_fraction": 0.2, "sigma": 0.05}


def test_denoise_orders_methods_and_keeps_failures(spark):
    presets = {"small": {"dgp_type": "low_rank_gaussian", "noise_type": "gaussian", "params": SMALL}}
    rows = {(r.algorithm, r.seed): r for r in benchmarks.denoise(spark, presets, (0, 1), ("row_mean", "soft_impute", "nothing"), {"soft_impute": {"max_iters": 200}}).collect()}
    assert len(rows) == 6
    for seed in (0, 1):
        assert rows["soft_impute", seed].rmse < 0.5 * rows["row_mean", seed].rmse
        assert rows["nothing", seed].status == "failed" and rows["nothing", seed].rmse is None
        assert rows["row_mean", seed].eval_count == round(round(2400 * 0.6) * 0.2)


def test_hankel_benchmark(spark):
    presets = {"h": {"signal_model": "spectrally_sparse_complex", "mask_type": "uniform_random", "params": {"n": 64, "rank": 2, "window_length": 32, "missing_fraction": 0.3, "noise_sigma": 0.01}}}
    rows = {r.algorithm: r for r in benchmarks.hankel_benchmark(spark, presets, {"global_mean": {}, "cadzow": {"max_iters": 60, "rank": 4}}).collect()}
    assert rows["cadzow"].rmse_missing < 0.5 * rows["global_mean"].rmse_missing


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("datasets:\n  a: {kind: x, description: d}\n")
    assert catalog.load_catalog(str(tmp_path / "c.yaml"))["datasets"]["a"]["params"] == {}
    assert catalog.listing(spark, catalog.load_catalog()).filter("section = 'synthetic_noisy_benchmarks'").count() == 8


def test_commands(spark, tmp_path, capsys):
    m = np.random.default_rng(0).normal(size=(12, 5))
    np.savetxt(tmp_path / "m.csv", m, delimiter=",")
    run = lambda *a: cli.main([str(x) for x in a], spark=spark)
    run("prepare-split", "--input", tmp_path / "m.csv", "--output", tmp_path / "b", "--holdout-fraction", 0.25)
    run("run-algorithm", "--bundle", tmp_path / "b", "--algorithm", "col_mean", "--output", tmp_path / "p")
    run("evaluate", "--bundle", tmp_path / "b", "--predictions", tmp_path / "p", "--metrics", "rmse", "mae", "--output", tmp_path / "e")
    assert spark.read.csv(str(tmp_path / "e"), header=True).first().n_scored == "15"
    assert len(glob.glob(str(tmp_path / "e" / "*.csv"))) == 1
    run("generate-missingness", "--input", tmp_path / "m.csv", "--output", tmp_path / "x", "--kind", "block", "--fraction", 0.2)
    assert spark.read.parquet(str(tmp_path / "x")).filter("hidden").count() == 12
    run("multiple-imputations", "--bundle", tmp_path / "b", "--output", tmp_path / "mi", "--m", 2)
    run("multiple-imputations", "--bundle", tmp_path / "b", "--output", tmp_path / "drawn", "--m", 2, "--method", "forest_diffusion", "--params-json", '{"n_t": 3, "duplicate_K": 2, "n_estimators": 4}')
    assert spark.read.parquet(str(tmp_path / "mi")).select(F.count_distinct("imputation_id")).first()[0] == 2
    run("list-algorithms")
    assert "soft_impute" in capsys.readouterr().out


def test_presets_of_a_file_run(spark, tmp_path):
    """One preset of each kind, with the published keys."""
    (tmp_path / "c.yaml").write_text("""
noisy_benchmarks:
  noisy: {base_dataset: m, noise_type: gaussian, params: {sigma: 0.2, clip_min: 0.0, clip_max: 1.0}}
synthetic_noisy_benchmarks:
  blocks: {dgp_type: block_low_rank, noise_type: sparse_corruption, params: {n_rows: 20, n_cols: 15, rank: 2, observed_fraction: 0.5, eval_fraction: 0.25, n_row_groups: 3, n_col_groups: 2, group_noise: 0.1, corruption_fraction: 0.1, corruption_scale: 2.5}}
  orthogonal: {dgp_type: low_rank_orthogonal, noise_type: student_t, params: {n_rows: 20, n_cols: 15, rank: 3, observed_fraction: 0.5, eval_fraction: 0.2, singular_decay: 0.5, df: 3.0, scale: 0.2}}
hankel_benchmarks:
  damped: {signal_model: damped_spectrally_sparse, mask_type: contiguous_block, params: {n: 40, rank: 2, window_length: 20, noise_sigma: 0.04, missing_fraction: 0.3}}
""")
    read = catalog.load_catalog(str(tmp_path / "c.yaml"))
    rows = benchmarks.denoise(spark, read["synthetic_noisy_benchmarks"], (0,), ("global_mean", "row_mean"), artifacts=str(tmp_path / "kept")).collect()
    assert len(rows) == 4 and all(r.status == "ok" and r.rmse > 0 for r in rows)
    assert tables.saved_runs(spark, str(tmp_path / "kept"), "blocks").select("method").distinct().count() == 2
    assert all(r.seconds > 0 for r in tables.run_log(spark, str(tmp_path / "kept")).collect())
    assert benchmarks.hankel_benchmark(spark, read["hankel_benchmarks"], {"global_mean": {}}).first().signal_model == "damped_spectrally_sparse"
    cells = spark.createDataFrame([("r", 0, k, float(k % 2)) for k in range(50)] + [("r", 0, 50, None)], "run_id string, row_id long, col_id long, value double")
    out = [r.value for r in benchmarks.noisy(cells, read["noisy_benchmarks"]["noisy"], 1).orderBy("col_id").collect()]
    assert out[50] is None and all(0 <= v <= 1 for v in out[:50]) and len(set(out)) > 10
    assert catalog.HANKEL["hankel_damped_block_missing"]["params"]["window_length"] == 160


def test_tabular_commands(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    spark.createDataFrame([(k, float(x[k, 0]), float(x[k, 1]), int(x[k].sum() > 0)) for k in range(80)], "id long, a double, b double, y int").write.parquet(str(tmp_path / "t"))
    run = lambda *a: cli.main([str(v) for v in a], spark=spark)
    run("tabular-prepare", "--input", tmp_path / "t", "--row", "id", "--target", "y", "--output", tmp_path / "b", "--patterns", "mcar", "--fractions", 0.2, "--seeds", 0)
    bundle = spark.read.parquet(str(tmp_path / "b" / "cells"))
    assert bundle.filter("is_eval").count() == round(64 * 2 * 0.2) + round(16 * 2 * 0.2)
    for k in (0, 1):
        bundle.select("run_id", "row_id", "col_id", F.coalesce("value", F.lit(0.1 * k)).alias("pred")).write.parquet(str(tmp_path / f"p{k}"))
    run("tabular-evaluate", "--bundles", tmp_path / "b" / "cells", "--predictions", tmp_path / "p0", "--target-col", 2, "--models", "linear", "--output", tmp_path / "one")
    one = spark.read.csv(str(tmp_path / "one"), header=True).first()
    assert float(one.downstream_accuracy_linear) > 0.6 and float(one.rmse) > 0
    run("tabular-evaluate", "--bundles", tmp_path / "b" / "cells", "--predictions", tmp_path / "p0", tmp_path / "p1", "--target-col", 2, "--models", "linear", "--output", tmp_path / "two")
    two = spark.read.csv(str(tmp_path / "two"), header=True).first()
    assert float(two.downstream_accuracy_linear_mi_pooled) > 0.6 and float(two.rmse_mi_std) >= 0
    bundle.select(F.lit("m").alias("method"), "col_id", F.col("truth").alias("pred")).write.parquet(str(tmp_path / "v"))
    (tmp_path / "columns.csv").write_text("col_id,column\n0,a\n1,b\n")
    (tmp_path / "bounds.csv").write_text("column,lower,upper\na,0.0,1.0\nb,-100.0,100.0\n")
    run("violations", "--predictions", tmp_path / "v", "--columns", tmp_path / "columns.csv", "--bounds", tmp_path / "bounds.csv", "--output", tmp_path / "vo")
    found = {r.column: int(r.out_of_bounds_count) for r in spark.read.csv(str(tmp_path / "vo"), header=True).collect()}
    assert found["a"] == int(((x[:, 0] < 0) | (x[:, 0] > 1)).sum()) == found[None] and found["b"] == 0
    run("feature-ranking", "--input", tmp_path / "t", "--target", "y", "--output", tmp_path / "f", "--top", 2)
    assert spark.read.csv(str(tmp_path / "f"), header=True).count() == 2


@pytest.mark.parametrize(("query", "table", "most"), [("score_by_method", "lineitem", 1), ("score_cells", "lineitem", 1), ("constraint_violations", "lineitem", 2), ("hankel_scores", "events", 1), ("impute_knn", "events", 1), ("clf_roc_auc", "lineitem", 1)])
def test_scans_do_not_multiply(spark, query, table, most):
    """Nodes of the plans that ran which scan the source, however often the query uses it."""
    from lacuna.plans import catalogue

    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    catalogue.QUERIES[query](spark, "/root/testdata/sf0.001").collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList()
    scans = 0
    for k in range(before, ran.size()):
        nodes = store.planGraph(ran.apply(k).executionId()).allNodes()
        scans += sum(nodes.apply(i).name().startswith("Scan parquet") and f"{table}.parquet" in nodes.apply(i).desc() for i in range(nodes.size()))
    assert 1 <= scans <= most
