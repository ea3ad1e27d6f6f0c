"""Diffusion by boosted trees: its arithmetic by hand, its draws by what they must look like."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions.registry import IMPUTERS
from lacuna.operators import boosting, diffusion, impute
from lacuna.operators.diffusion import Diffusion, Packed

CELLS = "run_id string, row_id long, col_id long, value double"
SMALL = dict(n_t=4, duplicate_K=3, n_estimators=8, max_depth=3, eta=0.4)


def cells_of(spark, x, run="r", parts=4):
    rows = [(run, i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(x)]
    return spark.createDataFrame(rows, CELLS).repartition(parts)


def matrices(done, shape, k):
    out = np.full((k, *shape), np.nan)
    for r in done.collect():
        out[r.imputation_id, r.row_id, r.col_id] = r.pred
    return out


def low_rank(n=300, p=6, rank=2, share=0.2, seed=3):
    rng = np.random.default_rng(seed)
    full = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, p)) + 0.01 * rng.normal(size=(n, p))
    x = full.copy()
    x[rng.random((n, p)) < share] = np.nan
    return full, x


def rmse(draws, full, x):
    return float(np.sqrt(np.mean((draws - full)[:, np.isnan(x)] ** 2)))


def test_packed_boosters_equal_their_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = x[:, 0] * x[:, 1]
    cuts = np.stack([np.quantile(c, np.arange(1, boosting.BINS) / boosting.BINS) for c in x.T])
    b = boosting.Booster(cuts, 0.5, boosting.Settings("regression", 12, 4, 0.3, 1.0, 1.0))
    b = boosting.boost_in_one(b, b.binned(x), y, np.arange(500))
    assert np.allclose(Packed.of(b).predict(x, 4), b.base + b.margin(b.binned(x)), atol=1e-5)


def test_levels_and_noise():
    d = Diffusion(n_t=5)
    scales = [d.scale(i) for i in range(5)]
    assert all(abs(m * m + s * s - 1) < 1e-12 for m, s in scales) and [s for _, s in scales] == sorted(s for _, s in scales)
    assert scales[0][1] < 0.02 and scales[-1][1] > 0.99
    keys = np.random.default_rng(0).integers(-(2**62), 2**62, 20000)
    z = d.noise(keys, 3, "a")
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and np.abs(np.corrcoef(np.hstack([z, d.noise(keys, 3, "b")]).T) - np.eye(6)).max() < 0.03
    assert (d.noise(keys[5:9], 3, "a") == z[5:9]).all()
    with pytest.raises(ValueError):
        Diffusion(n_t=1)


def test_the_way_down_with_the_true_score():
    """With the score of a normal distribution of sd 0.1 in place of boosters, draws have its mean and sd."""
    d, sd = Diffusion(n_t=60), 0.1

    class Exact:
        def __init__(self, level):
            self.m, self.s = d.scale(level)

        def predict(self, x, depth):
            return (x[:, 0] - self.m * 0.3) * self.s / (self.m**2 * sd**2 + self.s**2)

    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 4000)
    y = diffusion.fill(np.full((4000, 1), np.nan), keys, {(i, 0): Exact(i) for i in range(60)}, d, 0)
    assert abs(y.mean() - 0.3) < 0.01 and abs(y.std() - sd) < 0.015


def test_draws_beat_those_of_columns_alone(spark):
    full, x = low_rank()
    cells = cells_of(spark, x)
    mine = matrices(diffusion.diffusion_draws(cells, k=3), x.shape, 3)
    plain = matrices(impute.mi_gaussian(cells, m=3), x.shape, 3)
    known = np.isfinite(x)
    assert np.isfinite(mine).all() and (mine[:, known] == x[known]).all()
    assert rmse(mine, full, x) < 0.7 * rmse(plain, full, x)
    assert (mine[0] != mine[1])[~known].mean() > 0.95
    assert (mine >= np.nanmin(x, 0) - 1e-9).all() and (mine <= np.nanmax(x, 0) + 1e-9).all()


def test_both_branches_are_drawn(spark):
    """y is x or -x: a mean would be 0; draws lie on the branches, on both."""
    rng = np.random.default_rng(5)
    a = rng.uniform(0.5, 1, 600)
    full = np.stack([a, a * rng.choice([-1, 1], 600)], 1)
    x = full.copy()
    x[:200, 1] = np.nan
    y = matrices(diffusion.diffusion_draws(cells_of(spark, x), k=1, n_t=20), x.shape, 1)[0, :200, 1]
    assert np.mean(np.abs(np.abs(y) - a[:200]) < 0.15) > 0.75 and 0.3 < np.mean(y > 0) < 0.7


def test_jobs_fill_as_well_as_tasks(spark, monkeypatch):
    full, x = low_rank(n=150, p=3, rank=1)
    cells = cells_of(spark, x)
    one = rmse(matrices(diffusion.diffusion_draws(cells, k=2, **SMALL), x.shape, 2), full, x)
    real, seen = boosting.fit, []

    def fit(train, *args, **kwargs):
        seen.append(train)
        monkeypatch.setattr(boosting, "FEW_ENTRIES", 1 << 23)  # each booster in a task, for the time it takes
        try:
            return real(train, *args, **kwargs)
        finally:
            monkeypatch.setattr(boosting, "FEW_ENTRIES", 0)

    monkeypatch.setattr(boosting, "fit", fit)
    monkeypatch.setattr(boosting, "FEW_ENTRIES", 0)
    jobs = rmse(matrices(diffusion.diffusion_draws(cells, k=2, **SMALL), x.shape, 2), full, x)
    assert len(seen) == 4 * 3 and jobs < 1.2 * one < 1.2 * rmse(matrices(impute.mi_gaussian(cells, m=2), x.shape, 2), full, x)


def test_large_tables_are_learned_by_a_job_a_level_of_all_boosters(spark, monkeypatch):
    """Over FEW_ENTRIES the jobs do not grow with columns and noise levels; fills are as good as those of tasks."""
    full, x = low_rank(n=1400, p=4, rank=1)  # 16,800 noised entries
    cells = cells_of(spark, x)
    one = rmse(matrices(diffusion.diffusion_draws(cells, k=2, **SMALL), x.shape, 2), full, x)
    monkeypatch.setattr(boosting, "FEW_ENTRIES", 4 * (4 * 2**3 * boosting.BINS) - 1)  # the histograms of three columns
    monkeypatch.setattr(boosting, "fit", None)  # no booster has jobs of its own
    found = []
    real = diffusion._boost_together
    monkeypatch.setattr(diffusion, "_boost_together", lambda packed, columns, *rest: found.append(columns) or real(packed, columns, *rest))
    jobs = rmse(matrices(diffusion.diffusion_draws(cells, k=2, **SMALL), x.shape, 2), full, x)
    assert found == [[0, 1, 2], [3]] and jobs < 1.1 * one


def test_packed_sums_equal_histograms():
    rng = np.random.default_rng(8)
    x, rest = rng.integers(0, boosting.BINS, (500, 3)).astype(np.uint8), rng.normal(size=500).astype(np.float32)
    rest[::7] = np.nan
    known = np.flatnonzero(~np.isnan(rest))
    tree = boosting.Tree.of_depth(3)
    tree.feature[:2], tree.cut[:2] = [1, 2], [40, 90]  # the right half ends at the first level
    want = boosting.histograms(x[known], -rest[known].astype(float), np.ones(len(known)), tree.node_of(x[known]), 2, np.arange(3), boosting.BINS)
    assert np.allclose(diffusion._grown(np.ascontiguousarray(x.T), rest, tree, 2), want, atol=1e-3)


def test_lighter_children_give_the_sums_of_a_level(monkeypatch):
    """One child of each node is summed, and two features in a pass where a node has many rows; the sums are exact."""
    rng = np.random.default_rng(9)
    x, rest = rng.integers(0, boosting.BINS, (5, 3000)).astype(np.uint8), rng.normal(size=3000).astype(np.float32)
    rest[::5] = np.nan
    tree = boosting.Tree.of_depth(3)
    tree.feature[[0, 1]], tree.cut[[0, 1]] = [4, 0], [90, 20]  # node 2 is a leaf
    above, whole = (diffusion._grown(x, rest, tree, level) for level in (1, 2))
    right = np.array([False, True])
    for many in (0, 1 << 20):
        monkeypatch.setattr(diffusion, "MANY_ROWS", many)
        assert (diffusion._grown(x, rest, tree, 1) == above).all()
        part = diffusion._grown(x, rest, tree, 2, right)
        assert (part[:, :, 0] == whole[:, :, 0]).all() and not part[:, :, 1].any()
        assert (boosting.siblings(tree, 2, above, part, right) == whole).all()


def test_tables_whose_bins_fit_a_task_have_no_job_a_level(spark, monkeypatch):
    """The trees are those that the jobs grow; one job learns them all."""
    _, x = low_rank(n=700, p=5, rank=2)
    x = 2 * (x - np.nanmin(x, 0)) / (np.nanmax(x, 0) - np.nanmin(x, 0)) - 1
    table = spark.createDataFrame([(i * 7919, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], "key long, v array<double>")
    d, seen = Diffusion(**SMALL), []
    real = diffusion._boost_in_tasks
    monkeypatch.setattr(diffusion, "_boost_in_tasks", lambda *args: seen.append(1) or real(*args))
    monkeypatch.setattr(diffusion, "_boost_together", None)
    once = diffusion._learn_together(table, 5, d, 700, 5)
    assert seen == [1] and len(once) == 4 * 5
    monkeypatch.undo()
    monkeypatch.setattr(diffusion, "BINNED_ENTRIES", 0)
    jobs = diffusion._learn_together(table, 5, d, 700, 5)
    for at, one in once.items():
        assert (one.feature == jobs[at].feature).all() and np.allclose(one.limit, jobs[at].limit) and np.allclose(one.value, jobs[at].value, atol=1e-6)


def test_points_stand_for_as_many_values_each():
    values = np.random.default_rng(2).permutation(50_000).astype(float)
    points, weight = diffusion._points(values)
    assert len(points) == 8 * boosting.BINS and np.isclose(weight * len(points), 50_000)
    assert np.abs(points - (np.arange(len(points)) + 0.5) * weight).max() < 1
    assert diffusion._points(values[:9])[0].tolist() == sorted(values[:9]) and diffusion._points(values[:9])[1] == 1


def test_draws_do_not_depend_on_partitions(spark):
    _, x = low_rank(n=60, p=3, rank=1)
    a, b = (matrices(diffusion.diffusion_draws(cells_of(spark, x, parts=n), k=2, r=2, **SMALL), x.shape, 2) for n in (1, 7))
    assert np.allclose(a, b)


def test_odd_tables(spark):
    nan = np.nan
    x = np.array([[1.0, 5.0, nan, 0.0], [nan, nan, nan, nan], [3.0, 5.0, nan, 1.0], [3.0, 5.0, nan, 1.0], [2.0, nan, nan, nan]])
    done = matrices(diffusion.diffusion_draws(cells_of(spark, x), k=2, **SMALL), x.shape, 2)
    assert (done[:, :, 1] == 5.0).all()
    assert np.allclose(done[:, :, 2], (2.25 + 5 + 2 / 3) / 3)  # no value at all: the mean of the column means
    assert ((done[:, :, 0] >= 1) & (done[:, :, 0] <= 3)).all() and ((done[:, :, 3] >= 0) & (done[:, :, 3] <= 1)).all()
    two = cells_of(spark, np.array([[1.0, 2.0]]), "whole").unionByName(cells_of(spark, np.full((2, 2), nan), "empty")).withColumn("drawn_by", F.lit("x"))
    kept = IMPUTERS["forest_diffusion"](two, **SMALL)
    assert set(kept.columns) == {*two.columns, "pred"}
    assert sorted(r.pred for r in kept.collect()) == [0.0] * 4 + [1.0, 2.0]
    assert diffusion.diffusion_draws(two.limit(0)).collect() == []
    with pytest.raises(ValueError):
        diffusion.diffusion_draws(two, k=0)


def test_the_registered_fill_is_the_mean_of_the_draws(spark):
    _, x = low_rank(n=40, p=3, rank=1)
    cells = cells_of(spark, x)
    draws = matrices(diffusion.diffusion_draws(cells, k=3, **SMALL), x.shape, 3)
    got = np.full(x.shape, nan := np.nan)
    for r in IMPUTERS["forest_diffusion"](cells, k=3, **SMALL).collect():
        got[r.row_id, r.col_id] = r.pred
    assert not np.isnan(got).any() and np.allclose(got, draws.mean(0)) and nan != 0
