import numpy as np

from lacuna.plans import tabular


def test_tabular_benchmark(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    rows = [(k, *map(float, x[k]), float(x[k, 0] + x[k, 1] > 0)) for k in range(120)]
    table = spark.createDataFrame(rows, "row_id long, a double, b double, c double, y double")
    runs = tabular.grid(("mcar", "censor_above_threshold"), (0.2,), (0,))
    assert [r[0] for r in runs] == ["mcar_0p2_0", "censor_above_threshold_all_0"]
    cells = tabular.bundles(table, "row_id", ["a", "b", "c", "y"], "y", runs, censor={"threshold": 1.0})
    assert cells.filter("is_eval AND col_id = 3").count() == 0
    assert cells.filter("is_eval AND run_id = 'mcar_0p2_0'").count() == round(96 * 3 * 0.2) + round(24 * 3 * 0.2)
    got = {(r.run_id, r.method): r for r in tabular.evaluate(cells, runs, ("col_mean",), 3, 4, model_names=("linear",)).collect()}
    assert len(got) == 2
    for r in got.values():
        assert r.downstream_accuracy_linear > 0.6 and r.rmse > 0 and r.downstream_pr_auc_linear == r.downstream_average_precision_linear


def table_of(spark, n=120):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    rows = [(k, *map(float, x[k]), float(x[k, 0] + x[k, 1] > 0)) for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, y double")


def test_a_broken_grid_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from lacuna.functions.registry import IMPUTERS
    from lacuna.operators import models

    runs = tabular.grid(("mcar",), (0.2,), (0, 1))
    cells = tabular.bundles(table_of(spark), "row_id", ["a", "b", "c", "y"], "y", runs)
    col_mean = IMPUTERS["col_mean"]
    monkeypatch.setitem(IMPUTERS, "half", lambda cells, keys: col_mean(cells, keys).withColumn("pred", F.when(F.col("run_id") == runs[1][0], F.raise_error(F.lit("no second run"))).otherwise(F.col("pred"))))
    path, fits = str(tmp_path / "grid"), []
    predict = models.predict

    def counted(*args, **params):
        fits.append(args[2])
        if len(fits) == 2:
            raise KeyboardInterrupt
        return predict(*args, **params)

    monkeypatch.setattr(models, "predict", counted)
    methods, names = ("col_mean", "half"), ("linear",)
    tabular.impute_stage(cells, runs, methods, 3, path)
    try:
        tabular.evaluate_stage(spark, runs, methods, 3, 4, path, model_names=names)
        raise AssertionError("the second fit was to stop it")
    except KeyboardInterrupt:
        pass
    assert len(fits) == 2
    before = {(r.run_id, r.method): r.status for r in tabular.summary(spark, runs, methods, path).collect()}
    assert before == {(runs[0][0], "col_mean"): "ok", (runs[1][0], "col_mean"): "ok", (runs[0][0], "half"): "ok", (runs[1][0], "half"): "failed"}
    filled = []
    monkeypatch.setitem(IMPUTERS, "col_mean", lambda *a, **k: filled.append(1))
    tabular.impute_stage(cells, runs, methods, 3, path)
    tabular.evaluate_stage(spark, runs, methods, 3, 4, path, model_names=names)
    assert not filled and len(fits) == 4  # the one that was broken off, and the one of the other method
    tabular.evaluate_stage(spark, runs, methods, 3, 4, path, model_names=names)
    assert len(fits) == 4
    kept = spark.read.parquet(f"{path}/predictions")
    assert kept.groupBy("run_id", "method", "model").count().count() == 3 and {"row_id", "label", "pred", "score"} <= set(kept.columns)
    rows = {(r.run_id, r.method): r for r in tabular.summary(spark, runs, methods, path).collect()}
    assert rows[(runs[0][0], "half")].downstream_accuracy_linear > 0.6 and rows[(runs[1][0], "half")].rmse is None
    assert "no second run" in rows[(runs[1][0], "half")].error
    log = tabular.stage_log(spark, path)
    assert log.filter("status = 'ok' AND stage = 'evaluate'").count() == 3 and log.filter("seconds <= 0").count() == 0


def test_ranking_equals_a_solver(spark):
    """Exact medians, population scaling and the penalised logistic loss, minimised by hand; the AUC of the test rows."""
    from lacuna.operators import models

    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.2] + [0, 10, 3]
    y = (x[:, 0] + 0.1 * x[:, 1] - 1 + 0.5 * rng.normal(size=200) > 0).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [(float(y[k]), "train" if k < 150 else "test", *[None if np.isnan(v) else float(v) for v in x[k]]) for k in range(200)]
    got = models.feature_ranking(spark.createDataFrame(rows, "label double, split string, a double, b double, c double"), ["a", "b", "c"]).collect()
    full = np.where(np.isnan(x), np.nanmedian(x[:150], axis=0), x)
    z = (full - full[:150].mean(0)) / full[:150].std(0)
    w = np.zeros(4)
    a = np.hstack([z, np.ones((200, 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a[:150] @ w))
        ridge = np.diag([1.0, 1.0, 1.0, 0.0])
        w -= np.linalg.solve(a[:150].T @ (a[:150] * (p * (1 - p))[:, None]) + ridge, a[:150].T @ (p - y[:150]) + ridge @ w)
    assert np.allclose([r.coefficient for r in sorted(got, key=lambda r: r.feature)], w[:3], atol=1e-4)
    assert [r.rank for r in got] == [1, 2, 3] and [r.size for r in got] == sorted((abs(v) for v in (r.coefficient for r in got)), reverse=True)
    s = a[150:] @ w
    pairs = [(s[i] > s[j]) + 0.5 * (s[i] == s[j]) for i in range(50) for j in range(50) if y[150 + i] == 1 and y[150 + j] == 0]
    assert np.isclose(got[0].test_auc, np.mean(pairs), atol=1e-3)
