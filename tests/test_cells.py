import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import registry
from lacuna.functions.registry import IMPUTERS
from lacuna.operators import cells as C
from lacuna.operators import encode, hankel, impute, lowrank, masks, reports, scores, simulate
from lacuna.sources import readers, tables

SCHEMA = "run_id string, row_id long, col_id long, value double"


def grid(spark, x, run="r"):
    return spark.createDataFrame([(run, r, c, None if v is None else float(v)) for r, row in enumerate(x) for c, v in enumerate(row)], SCHEMA)


def matrix(df, column="pred"):
    rows = df.collect()
    out = np.full((max(r.row_id for r in rows) + 1, max(r.col_id for r in rows) + 1), np.nan)
    for r in rows:
        out[r.row_id, r.col_id] = np.nan if r[column] is None else r[column]
    return out


def test_means_fall_back_to_the_run(spark):
    x = grid(spark, [[1, None, 3], [None, None, None], [5, None, 1]])
    assert np.allclose(matrix(impute.global_mean(x)), [[1, 2.5, 3], [2.5, 2.5, 2.5], [5, 2.5, 1]])
    assert np.allclose(matrix(impute.row_mean(x)), [[1, 2, 3], [2.5, 2.5, 2.5], [5, 3, 1]])
    assert np.allclose(matrix(impute.col_mean(x)), [[1, 2.5, 3], [3, 2.5, 2], [5, 2.5, 1]])


def test_mode_takes_the_smallest_of_ties(spark):
    x = grid(spark, [[2, None], [2, None], [1, None], [1, None], [None, 4]])
    assert np.allclose(matrix(impute.col_mode(x))[:, 0], [2, 2, 1, 1, 1])


def test_runs_do_not_mix(spark):
    x = grid(spark, [[1, None]], "a").unionByName(grid(spark, [[9, None]], "b"))
    got = {(r.run_id, r.col_id): r.pred for r in impute.global_mean(x).collect()}
    assert got == {("a", 0): 1, ("a", 1): 1, ("b", 0): 9, ("b", 1): 9}


def test_infinite_and_nan_are_missing(spark):
    x = spark.createDataFrame([("r", 0, 0, float("inf")), ("r", 0, 1, float("nan")), ("r", 1, 0, 2.0)], SCHEMA)
    assert C.complete_grid(x).filter("value IS NOT NULL").count() == 1


@pytest.mark.parametrize("kind", ["mcar", "mar_logistic", "mnar_self_logistic", "block", "bursty"])
def test_masks_hide_exactly_the_share(spark, kind):
    rng = np.random.default_rng(0)
    x = grid(spark, [[None if rng.random() < 0.1 else rng.normal() for _ in range(9)] for _ in range(21)])
    known = x.filter("value IS NOT NULL").count()
    got = masks.hide_cells(x, kind, 0.3, 5)
    assert got.filter("hidden").count() == round(known * 0.3)
    assert got.filter("hidden AND value IS NULL").count() == 0
    assert got.count() == x.count()


def test_mar_without_a_driver_is_uniform(spark):
    x = grid(spark, [[None, 1, 2]] * 10)
    assert masks.mar_logistic(x, 0.5, 1).filter("hidden").count() == 10


def test_bursts_need_three(spark):
    with pytest.raises(ValueError):
        masks.bursty(grid(spark, [[1, 2]]), 0.5, 1, burst_max=2)


def test_censoring_and_share_checks(spark):
    x = grid(spark, [[101, 1], [100, 200]])
    assert [(r.row_id, r.col_id) for r in masks.hide_cells(x, "censor_above_threshold").filter("hidden").collect()] == [(0, 0)]
    with pytest.raises(ValueError):
        masks.mcar(x, 1.0, 1)


def test_knn_by_hand(spark):
    x = grid(spark, [[1, 1, None], [1, 1, 10], [2, 2, 20], [50, 50, 99]])
    assert matrix(impute.knn(x, n_neighbors=2))[0, 2] == 15


def test_knn_without_holes_changes_nothing(spark):
    assert np.allclose(matrix(impute.knn(grid(spark, [[1, 2], [3, 4]]))), [[1, 2], [3, 4]])


def test_scores_and_zero_range(spark):
    x = spark.createDataFrame([("r", 3.0, 4.0, True), ("r", 3.0, 1.0, True), ("r", 9.0, 0.0, False), ("r", float("nan"), 0.0, True)], "run_id string, truth double, pred double, is_eval boolean")
    row = scores.score(x, ["rmse", "mae", "nmae", "nrmse", "max_abs_error"], ["run_id"]).first()
    assert row.mae == 1.5 and row.nmae == 0 and row.nrmse == 0 and row.max_abs_error == 2 and row.n_scored == 2
    assert np.isclose(row.rmse, np.sqrt(2.5))


def test_classification_scores(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.1)]
    x = spark.createDataFrame([("m", y, s, int(s > 0.5)) for y, s in rows], "m string, label int, score double, pred int")
    pairs = [(a, b) for y, a in rows if y for z, b in rows if not z]
    assert np.isclose(scores.roc_auc(x, ["m"]).first().roc_auc, np.mean([(a > b) + 0.5 * (a == b) for a, b in pairs]))
    assert np.isclose(scores.average_precision(x, ["m"]).first().average_precision, (1 / 3) * 1 + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5))
    assert scores.roc_auc(x.filter("label = 1"), ["m"]).first().roc_auc is None


def test_low_rank_recovers(spark):
    rng = np.random.default_rng(1)
    truth = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 30))
    seen = rng.random(truth.shape) < 0.6
    x = np.where(seen, truth, np.nan)
    for got in (lowrank.svt(x, max_iters=500), lowrank.soft_impute(x, max_iters=500), lowrank.nuclear_norm(x, max_iters=3000)):
        assert np.sqrt(np.mean((got - truth)[~seen] ** 2)) < 0.35 * truth.std()
    assert (lowrank.svt(np.zeros((3, 3))) == 0).all()
    with pytest.raises(ValueError):
        lowrank.svt(np.full((2, 2), np.nan))


def test_failed_runs_are_rows(spark):
    row = lowrank.per_run(grid(spark, [[None, None]]), lowrank.svt).first()
    assert row.pred is None and "observed" in row.error


def test_gram_step_equals_svd(spark):
    x = np.random.default_rng(2).normal(size=(20, 6))
    got = matrix(lowrank.gram_shrink(grid(spark, x), 1.0, {"run_id": "r"}), "low")
    assert np.allclose(got, lowrank._shrunk(x, 1.0))


def test_hankel_round_trip(spark):
    s = spark.createDataFrame([("s", t, float(t * t)) for t in range(10)], "series_id string, t int, value double")
    h = hankel.hankelize(s, 4)
    assert h.count() == 4 * 7
    assert [r.value for r in hankel.dehankelize(h).orderBy("t").collect()] == [t * t for t in range(10)]
    empty = hankel.enforce(h.withColumn("value", F.when(F.col("row_id") + F.col("col_id") != 3, F.col("value"))))
    assert {r.value for r in empty.filter("row_id + col_id = 3").collect()} == {0.0}


def test_last_point_is_never_in_a_run(spark):
    s = spark.createDataFrame([("s", t) for t in range(30)], "series_id string, t int")
    for seed in range(5):
        got = hankel.hide_points(s, "contiguous_block", 0.3, seed).filter("hidden")
        assert got.count() == 9 and got.filter("t = 29").count() == 0


def test_signal_has_unit_variance(spark):
    x = [r.clean for r in simulate.signal(spark, 64, 3, 1, damped=True).collect()]
    assert np.isclose(np.std(x), 1)


def test_generators(spark):
    x = simulate.low_rank_gaussian(simulate.grid(spark, 12, 9), 2, 4)
    assert np.linalg.matrix_rank(matrix(x, "value"), tol=1e-8) == 2
    y = matrix(simulate.low_rank_orthogonal(simulate.grid(spark, 10, 8), 3, 1), "value")
    assert np.allclose(np.linalg.svd(y)[1][:3], 0.82 ** np.arange(3))
    b = simulate.denoising_benchmark(x, "sparse_corruption", 1, fraction=0.1)
    row = b.agg(F.count_if("is_observed").alias("o"), F.count_if("is_eval").alias("e"), F.count("observed").alias("n")).first()
    assert (row.o, row.e, row.n) == (38, 8, 30)
    assert b.filter("is_eval AND NOT is_observed").count() == 0


def test_mi_kinds(spark):
    x = grid(spark, [[0, 1, 0.5], [1, 2, 0.7], [None, None, None], [1, 2, 9.5]])
    got = impute.mi_gaussian(x, m=4).filter("value IS NULL").collect()
    assert len(got) == 12
    for r in got:
        assert r.pred in ((0, 1), (1, 2), None)[r.col_id] if r.col_id < 2 else 0.5 <= r.pred <= 9.5


def test_split_guard_keeps_targets(spark):
    x = grid(spark, [[1, None], [0, 4], [1, None], [0, 8]])
    splits = spark.createDataFrame([("r", 0, "train"), ("r", 1, "train"), ("r", 2, "test"), ("r", 3, "test")], "run_id string, row_id long, split string")
    got = matrix(impute.row_disjoint(x, splits, "col_mean", target=0))
    assert np.allclose(got, [[1, 4], [0, 4], [1, 8], [0, 8]])


def test_encoding(spark):
    t = spark.createDataFrame([(0, "1", "b", "x"), (1, " NA ", "a", "y"), (2, "3", None, "x"), (3, "4", "b", "x")], "row_id long, a string, b string, y string")
    assert encode.encode(t, ["row_id"]).columns == ["row_id", "a", "b_a", "b_b", "y_x", "y_y"]
    got = encode.encode(t, ["row_id"], hot=False).orderBy("row_id").collect()
    assert [r.b for r in got] == [1, 0, None, 1] and [r.a for r in got] == [1, None, 3, 4]
    assert encode.one_hot(t.withColumn("b", F.lit("?")), "b").columns[-1] == "b__missing"


def test_reports(spark):
    x = spark.createDataFrame([("m", 1, "ok", 1.0, "2"), ("m", 2, "ok", 3.0, " "), ("m", 3, "failed", 9.0, "4")], "method string, seed int, status string, rmse double, mae string")
    row = reports.leaderboard(x, ["method"], ["rmse"]).first()
    assert (row.num_runs, row.rmse, row.rmse_std) == (2, 2.0, 1.0)
    assert reports.metric_columns(x) == ["rmse", "mae"]
    assert reports.mean_ci95(reports.long_metrics(x.filter("seed = 1"), ["method"], ["rmse"]), ["method"]).first().ci95 == 0


def test_registry_and_plugins():
    r = registry.Registry()
    r.register("a")(len)
    for bad in ("a", " "):
        with pytest.raises(ValueError):
            r.register(bad)
    with pytest.raises(KeyError):
        r.named("b")
    with pytest.raises(ValueError):
        registry.parameters("[1]")
    with pytest.raises(impute.MissingDependency):
        registry.IMPUTERS.named("tab_impute")(None)


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,2\n,nan\n5,6\n")
    assert np.allclose(matrix(readers.matrix(spark, str(tmp_path / "m.csv")), "value"), [[1, 2], [np.nan, np.nan], [5, 6]], equal_nan=True)
    np.save(tmp_path / "m.npy", np.array([[1.0, np.inf], [3, 4]]))
    assert np.allclose(matrix(readers.matrix(spark, str(tmp_path / "m.npy")), "value"), [[1, np.nan], [3, 4]], equal_nan=True)
    (tmp_path / "r.dat").write_text("7::2::3::x\n\n9::1::5\nbad::1\n7::2::4\n")
    got = matrix(readers.ratings(spark, str(tmp_path / "r.dat"), "tweets"), "value")
    assert np.allclose(got, [[np.nan, 4], [5, np.nan]], equal_nan=True)
    (tmp_path / "p.csv").write_text("State,Year,cigsale\nB,2000,1\nA,2001,x\nA,2000.0,3\n")
    assert np.allclose(matrix(readers.panel_csv(spark, str(tmp_path / "p.csv"), "prop99_smoking"), "value"), [[3], [1]])
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "small.csv").write_text("a\n1\n")
    (tmp_path / "k" / "big.csv").write_text("a,b\n1,x\n2,y\n3,x\n")
    assert readers.tabular(spark, str(tmp_path / "k")).columns == ["row_id", "a", "b"]
    with pytest.raises(NotImplementedError):
        readers.read_dataset(spark, "none", "")


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"downstream_metrics": {"a": 1, "b": 2}, "imputation_metrics": {"a": 3}, "prediction_paths": ["x/knn/p.npy"]}))
    got = {(r.method, r.metric): r.value for r in readers.eval_results(spark, str(tmp_path / "e.json")).collect()}
    assert got == {("knn", "a"): 3.0, ("knn", "b"): 2.0}


def test_bundles(spark, tmp_path):
    x = grid(spark, [[1, 2]]).select("run_id", "row_id", "col_id", F.col("value").alias("truth"), F.col("value").alias("observed"), F.lit(True).alias("is_eval"))
    tables.save_cells(x, str(tmp_path / "b"))
    assert tables.load_bundle(spark, str(tmp_path / "b")).count() == 2
    assert tables.bundles(spark, str(tmp_path / "b"), "r").count() == 1
    with pytest.raises(ValueError):
        tables.bundles(spark, str(tmp_path / "b"), "z")


def test_tall_runs_equal_whole_matrices(spark, monkeypatch):
    """Runs by rows and Gram matrices give what one task per run gives."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 8))
    x[rng.random(x.shape) < 0.3] = np.nan
    cells = spark.createDataFrame([("a", i, j, None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(60) for j in range(8)], "run_id string, row_id long, col_id long, value double").repartition(3)
    for name, params in (("soft_impute", {}), ("robust_pca", {"max_iters": 15}), ("svt", {"tau": 8.0, "max_iters": 60})):
        want = {(r.row_id, r.col_id): r.pred for r in lowrank.per_run(cells, getattr(lowrank, name), **params).collect()}
        with monkeypatch.context() as m:
            m.setattr(lowrank, "MOST_CELLS", 100)
            got = {(r.row_id, r.col_id): r.pred for r in IMPUTERS[name](cells, **params).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6, name
    monkeypatch.setattr(lowrank, "MOST_CELLS", 100)
    assert {r.error is None for r in IMPUTERS["nuclear_norm_minimization"](cells, max_iters=3).collect()} == {True}


def test_types_of_a_result_table(spark, tmp_path):
    (tmp_path / "r.csv").write_text("method,rmse,seed,note\na,0.5,1,\nb,,2,inf\nc, 2 ,3,4\n")
    t = readers.typed_csv(spark, str(tmp_path / "r.csv"))
    assert dict(t.dtypes) == {"method": "string", "rmse": "double", "seed": "double", "note": "string"}
    assert [r.rmse for r in t.orderBy("seed").collect()] == [0.5, None, 2.0]


def test_orthonormal_factors_over_many_tasks(spark):
    lines = spark.range(5000).select((F.col("id") * 7).alias("row_id")).repartition(6)
    u = np.array([r.factor for r in simulate.orthonormal(lines, "row_id", 6, 3, "u").collect()])
    assert u.shape == (5000, 6) and np.abs(u.T @ u - np.eye(6)).max() < 1e-10
    x = matrix(simulate.low_rank_orthogonal(simulate.grid(spark, 40, 30), 4, 1, 0.5), "value")
    assert np.allclose(np.linalg.svd(x)[1][:5], [1, 0.5, 0.25, 0.125, 0], atol=1e-10)
    with pytest.raises(ValueError, match="as many rows"):
        simulate.low_rank_orthogonal(simulate.grid(spark, 40, 3), 4, 1)


def test_numbers_are_dealt_by_chunks(spark):
    from lacuna.operators.cells import numbered

    x = numbered(spark.createDataFrame([("a", 10), ("b", 0), ("c", 3)], "run_id string, n long"), F.col("n"), "k", chunk=4)
    got = sorted((r.run_id, r.k) for r in x.collect())
    assert got == [("a", k) for k in range(10)] + [("c", k) for k in range(3)]


def test_draws_follow_their_weights(spark):
    """Rows with a high driver lose more cells, at more rows than slices of a fixed number would part."""
    x = [[float(i), 1.0, 2.0] for i in range(3000)]
    out = masks.hide_cells(grid(spark, x), "mar_logistic", 0.2, 5, driver=0)
    by = {r.high: r.n for r in out.filter("hidden").groupBy((F.col("row_id") >= 1500).alias("high")).agg(F.count("*").alias("n")).collect()}
    assert sum(by.values()) == 1800 and by[True] > 2 * by[False]


def test_neighbours_over_groups_of_blocks(spark, monkeypatch):
    """Many blocks in several groups give what all rows in one task give."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(90, 5)), 1)
    x[rng.random(x.shape) < 0.3] = np.nan
    x[4] = np.nan
    x = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    want = matrix(impute.knn(grid(spark, x), n_neighbors=3, weights="distance"), "pred")
    monkeypatch.setattr(impute, "BLOCK_CELLS", 40)
    for most in (256, 2):
        monkeypatch.setattr(impute, "GROUP", most)
        assert np.allclose(matrix(impute.knn(grid(spark, x), n_neighbors=3, weights="distance"), "pred"), want)


def test_few_pairs_are_compared_exactly(monkeypatch):
    """The nearest rows are those of all pairs, ties and columns with few values included, but most pairs are ruled out by products."""
    import numpy as np

    from lacuna.operators import impute

    rng = np.random.default_rng(6)
    x = np.round(100 + 3 * rng.normal(size=(1200, 6)), 1)
    x[600:] = x[:600]  # ties
    x[rng.random(x.shape) < 0.25] = np.nan
    x[3:, 5] = np.nan  # three values
    ids, k = np.arange(1200) * 2, 5
    pairs, real = [], impute._exact
    monkeypatch.setattr(impute, "_exact", lambda a, b: pairs.append(len(a)) or real(a, b))
    some = np.flatnonzero(np.isnan(x[:300]).any(1))
    got = impute._nearest(ids[some], x[some], [(ids[i : i + 400], x[i : i + 400]) for i in (800, 0, 400)], k)
    rows = sorted(zip(*(c.tolist() for c in got), strict=True))
    want = []
    for i in some:
        d = real(np.repeat(x[i][None], 1200, 0), x)
        d[i] = np.inf
        for c in np.flatnonzero(np.isnan(x[i])):
            near = sorted((d[j], ids[j]) for j in range(1200) if np.isfinite(d[j]) and not np.isnan(x[j, c]))[:k]
            want += [(ids[i], c, j, e, x[j // 2, c]) for e, j in near]
    assert rows == sorted(want)
    assert sum(pairs) < 0.3 * len(some) * 1200
