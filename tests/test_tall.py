"""Solvers of long series and tall runs against their forms in one task, and what they leave on disk."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions.registry import IMPUTERS
from lacuna.operators import hankel, lowrank, series
from lacuna.sources import tables


def matrix_cadzow(x, rank, rounds):
    """Rank cuts and averages over a matrix that is laid out."""
    seen = np.isfinite(x)
    t = np.add.outer(np.arange(x.shape[0]), np.arange(x.shape[1]))
    now = np.where(seen, x, x[seen].mean())
    for _ in range(rounds):
        u, s, vt = np.linalg.svd(now, full_matrices=False)
        low = (u[:, :rank] * s[:rank]) @ vt[:rank]
        now = np.where(seen, x, (np.bincount(t.ravel(), low.ravel()) / np.bincount(t.ravel()))[t])
    return now


def wave(n, rng, missing=0.2):
    t = np.arange(n)
    x = np.cos(0.3 * t) + 0.5 * np.cos(1.1 * t + 1) + 0.05 * rng.normal(size=n)
    x[rng.choice(n, int(n * missing), replace=False)] = np.nan
    return x


@pytest.mark.parametrize(("n", "window"), [(30, 15), (40, 7), (41, 30), (60, 2), (9, 8), (3, 2)])
def test_a_series_equals_its_matrix(n, window):
    x = wave(n, np.random.default_rng(n))
    matrix = x[np.add.outer(np.arange(window), np.arange(n - window + 1))]
    want = matrix_cadzow(matrix, 3, 12)
    assert np.allclose(lowrank.cadzow(matrix, rank=3, max_iters=12, tol=0), want, atol=1e-9)


def frame(spark, series_id, x):
    rows = [(series_id, t, None if np.isnan(v) else float(v)) for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, t int, value double").repartition(5)


def test_pieces_equal_one_task(spark, monkeypatch):
    rng = np.random.default_rng(1)
    long, short = wave(1000, rng), wave(60, rng)
    both = frame(spark, "long", long).unionByName(frame(spark, "short", short)).unionByName(frame(spark, "none", np.full(40, np.nan)))
    monkeypatch.setattr(series, "PIECE", 128)
    for window in (20, 990):
        out = hankel.reconstruct(both.filter("series_id <> 'short'" if window == 990 else "true"), window, "cadzow", on="value", rank=4, max_iters=6).collect()
        got = {name: np.array([r.pred for r in sorted(out, key=lambda r: r.t) if r.series_id == name], float) for name in ("long", "short", "none")}
        assert np.allclose(got["long"], series.cadzow(long, window, 4, 6), atol=1e-9)
        if window == 20:
            assert np.allclose(got["short"], series.cadzow(short, window, 4, 6), atol=1e-9)
        assert np.isnan(got["none"]).all()
    errors = {r.series_id: r.error for r in series.complete(both, 20, "value").select("series_id", "error").distinct().collect()}
    assert errors == dict.fromkeys(("long", "short", "none"), "a rank is needed")


def cells_of(spark, x):
    r, c = np.indices(x.shape)
    rows = [("r", int(i), int(j), None if np.isnan(v) else float(v)) for i, j, v in zip(r.ravel(), c.ravel(), x.ravel(), strict=True)]
    return spark.createDataFrame(rows, "run_id string, row_id long, col_id long, value double").repartition(4)


def filled(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert r.error is None, r.error
        out[r.row_id, r.col_id] = r.pred
    return out


@pytest.fixture(scope="module")
def low_rank():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 12)) + 0.01 * rng.normal(size=(60, 12))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[5, 3] = 40.0
    return x


RUNS = [
    ("nuclear_norm_minimization", lowrank.nuclear_norm, {"max_iters": 17}),
    ("nuclear_norm_minimization", lowrank.nuclear_norm, {"max_iters": 8, "error_tolerance": 0.5, "min_value": -1.0, "max_value": 1.5}),
    ("robust_pca", lowrank.robust_pca, {"max_iters": 6, "n_components": 3}),
    ("robust_pca", lowrank.robust_pca, {"max_iters": 4, "n_components": 3, "trim": True, "mu": (1.5, 1.2), "beta": 0.1, "beta_init": 0.3, "gamma": 0.7}),
    ("soft_impute", lowrank.soft_impute, {"max_iters": 5}),
    ("svt", lowrank.svt, {"tau": 8.0, "max_iters": 7}),
]


@pytest.mark.parametrize(("name", "solve", "params"), RUNS)
def test_rows_equal_one_task(spark, monkeypatch, low_rank, name, solve, params):
    monkeypatch.setattr(lowrank, "MOST_CELLS", 100)
    got = filled(IMPUTERS[name](cells_of(spark, low_rank), **params), low_rank.shape)
    assert np.allclose(got, solve(low_rank, **params), atol=1e-6)


def test_a_large_hankel_run_is_its_series(spark, monkeypatch):
    x = wave(300, np.random.default_rng(8))
    matrix = x[np.add.outer(np.arange(12), np.arange(289))]
    monkeypatch.setattr(lowrank, "MOST_CELLS", 100)
    monkeypatch.setattr(series, "PIECE", 64)
    assert np.allclose(filled(IMPUTERS["cadzow"](cells_of(spark, matrix), rank=4, max_iters=4), matrix.shape), matrix_cadzow(matrix, 4, 4), atol=1e-8)
    assert {r.error for r in IMPUTERS["cadzow"](cells_of(spark, matrix)).select("error").distinct().collect()} == {"a rank is needed"}


def test_wide_runs_are_turned(spark, monkeypatch, low_rank):
    monkeypatch.setattr(lowrank, "MOST_CELLS", 100)
    wide = low_rank.T.copy()
    got = lowrank.tall(cells_of(spark, wide), "soft_impute", most_columns=20, max_iters=5).withColumn("error", F.lit(None).cast("string"))
    assert np.allclose(filled(got, wide.shape), lowrank.soft_impute(wide, max_iters=5), atol=1e-6)
    with pytest.raises(ValueError, match="more than 5 columns"):
        lowrank.tall(cells_of(spark, wide), "soft_impute", most_columns=5)


def test_trim_cuts_rows_of_the_factors(low_rank):
    """A row far from the others has less weight once it is cut to what incoherence allows."""
    plain, cut = (lowrank.robust_pca(low_rank, n_components=3, max_iters=3, beta=10.0, trim=t, mu=(1.0, 1.0)) for t in (False, True))
    assert not np.allclose(plain, cut)
    a = lowrank.trimmed(np.array([[3.0, 4.0], [0.3, 0.4]]), 1.0)
    assert np.allclose(a, [[0.6, 0.8], [0.3, 0.4]])


def test_robust_pca_parts_low_rank_from_sparse():
    rng = np.random.default_rng(2)
    low = rng.normal(size=(120, 2)) @ rng.normal(size=(2, 90))
    x = low.copy()
    x[rng.random(x.shape) < 0.03] += 20
    got = lowrank.robust_pca(x - x.mean(axis=0) * 0, n_components=3, max_iters=60, tol=1e-9)
    assert np.sqrt(np.mean((got - low) ** 2)) < 0.1 * np.sqrt(np.mean((x - low) ** 2))


def test_symmetric_nuclear_norm():
    rng = np.random.default_rng(3)
    f = rng.normal(size=(14, 2))
    full = f @ f.T
    x = np.where(rng.random(full.shape) < 0.6, full, np.nan)
    got = lowrank.nuclear_norm(x, require_symmetric_solution=True)
    assert np.allclose(got, got.T) and np.allclose(got[np.isfinite(x)], x[np.isfinite(x)], atol=1e-6)
    assert np.linalg.norm(got, "nuc") <= np.linalg.norm(full, "nuc") + 1e-3  # the truth is one of the matrices to choose from
    assert np.linalg.norm(got - full) < np.linalg.norm(lowrank.nuclear_norm(x) - full)
    x[0, 1], x[1, 0] = 1.0, 2.0
    with pytest.raises(ValueError, match="no symmetric matrix"):
        lowrank.nuclear_norm(x, require_symmetric_solution=True)


def test_rounds_leave_two_tables(spark, monkeypatch, low_rank):
    monkeypatch.setattr(lowrank, "MOST_CELLS", 100)
    there = lambda: {f for f in os.listdir(tables.shared_dir(spark).removeprefix("file:")) if f.startswith("lacuna-")}
    x = cells_of(spark, low_rank).cache()
    for name, params, most in (("svt", {"tau": 8.0, "max_iters": 9}, 2), ("soft_impute", {"max_iters": 9, "tol": 0.0}, 2), ("nuclear_norm_minimization", {"max_iters": 9}, 3), ("robust_pca", {"max_iters": 9, "tol": 0.0}, 2)):
        before = there()
        IMPUTERS[name](x, **params).collect()
        assert len(there() - before) <= most, name


@pytest.mark.parametrize(("solve", "published"), [(lowrank.nuclear_norm, 0.0110606), (lowrank.robust_pca, 3.17664)])
def test_published_accuracy(solve, published):
    """400 x 300 of rank 10, 35 % observed, a fifth of that held out, noise of 0.01: within 1.1 of the published error."""
    rng = np.random.default_rng(0)
    truth = rng.normal(size=(400, 10)) @ rng.normal(size=(10, 300))
    observed = rng.random(truth.shape) < 0.35
    held = observed & (rng.random(truth.shape) < 0.2)
    got = solve(np.where(observed & ~held, truth + 0.01 * rng.normal(size=truth.shape), np.nan))
    assert np.sqrt(np.mean((got - truth)[held] ** 2)) < 1.1 * published
