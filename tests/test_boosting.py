"""Boosted trees against brute force over raw values, and jobs against one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import boosting, models

FEATURES = ["f0", "f1", "f2"]


def frame(spark, x, y):
    rows = [(i, float(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "row_id long, label double, f0 double, f1 double, f2 double").repartition(4)


def brute(x, y, task, rounds, depth, rate, cuts, l2=1.0, least=1.0):
    """Margins of the training rows: every cut of every feature of every node tried by hand."""
    base = np.log(y.mean() / (1 - y.mean())) if task == "classification" else y.mean()
    margin = np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y, p * (1 - p)) if task == "classification" else (margin - y, np.ones(len(y)))
        step = np.zeros(len(y))

        def split(rows, level, g=g, h=h, step=step):
            whole = g[rows].sum() ** 2 / (h[rows].sum() + l2)
            best = (1e-9, None)
            if level < depth:
                for j in range(x.shape[1]):
                    for c in cuts[j]:
                        left, right = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                        if h[left].sum() >= least and h[right].sum() >= least:
                            gain = g[left].sum() ** 2 / (h[left].sum() + l2) + g[right].sum() ** 2 / (h[right].sum() + l2) - whole
                            if gain > best[0] + 1e-9:
                                best = (gain, (left, right))
            if best[1] is None:
                step[rows] = -rate * g[rows].sum() / (h[rows].sum() + l2)
            else:
                for part in best[1]:
                    split(part, level + 1)

        split(np.arange(len(y)), 0)
        margin = margin + step
    return margin


@pytest.mark.parametrize("task", ["classification", "regression"])
@pytest.mark.parametrize("few", [1 << 23, 0])
def test_boosting_equals_brute_force(spark, monkeypatch, task, few):
    monkeypatch.setattr(boosting, "FEW_ENTRIES", few)
    monkeypatch.setattr(boosting, "WRITTEN", 2)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(90, 3)), 1)
    y = x[:, 0] * x[:, 1] + 0.3 * x[:, 2] + 0.1 * rng.normal(size=90)
    y = (y > 0).astype(float) if task == "classification" else y
    train = frame(spark, x, y)
    rounds = 3
    b = boosting.fit(train, FEATURES, task=task, rounds=rounds, depth=3, rate=0.3, rows=2.0, columns=1.0)
    want = brute(x, y, task, rounds, 3, 0.3, [c[np.isfinite(c)] for c in b.cuts])
    got = {r.row_id: r.score for r in boosting.predict(b, train, FEATURES).collect()}
    want = want if task == "regression" else 1 / (1 + np.exp(-want))
    assert np.allclose([got[i] for i in range(90)], want, atol=1e-9)


def test_jobs_equal_one_task_with_drawn_rows_and_columns(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    train = frame(spark, x, y)
    out = []
    for few in (1 << 23, 0):
        monkeypatch.setattr(boosting, "FEW_ENTRIES", few)
        out.append(boosting.fit(train, FEATURES, rounds=10, depth=3, columns=0.7))
    for a, b in zip(out[0].trees, out[1].trees, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value, atol=1e-9)
    assert len({tuple(t.feature) for t in out[0].trees}) > 1


@pytest.mark.parametrize("task", ["classification", "regression"])
@pytest.mark.parametrize("sent", [1 << 26, 0])
def test_trees_are_the_same_to_the_bit_however_rows_are_dealt(spark, monkeypatch, sent, task):
    """In one task, and by jobs whose sums meet on the driver or by feature, in packs of 20 rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = x[:, 0] * x[:, 1] + 0.5 * rng.normal(size=400)
    train = frame(spark, x, (y > 0).astype(float) if task == "classification" else y)
    one = boosting.fit(train, FEATURES, task=task, rounds=7, depth=4)
    monkeypatch.setattr(boosting, "FEW_ENTRIES", 0)
    monkeypatch.setattr(boosting, "WRITTEN", 3)
    monkeypatch.setattr(boosting, "PACK", 60)
    monkeypatch.setattr(boosting, "SENT", sent)
    jobs = boosting.fit(train, FEATURES, task=task, rounds=7, depth=4)
    for a, b in zip(one.trees, jobs.trees, strict=True):
        assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.array_equal(a.value, b.value)


def test_a_level_is_one_stage(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    train = frame(spark, x, (x[:, 0] * x[:, 1] > 0).astype(float))
    monkeypatch.setattr(boosting, "FEW_ENTRIES", 0)
    sc, seen = spark.sparkContext, []
    for rounds in (2, 12):
        sc.setJobGroup(f"boosted {rounds}", "")
        boosting.fit(train, FEATURES, rounds=rounds, depth=3, rows=2.0)
        tracker = sc.statusTracker()
        stages = {i for j in tracker.getJobIdsForGroup(f"boosted {rounds}") for i in tracker.getJobInfo(j).stageIds}
        seen.append(sum(tracker.getStageInfo(i).numCompletedTasks > 0 for i in stages))  # others were skipped
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert seen[1] - seen[0] <= 10 * 3, seen


def test_pairs_are_learned(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    table = frame(spark, x, y).withColumn("split", F.when(F.col("row_id") < 1000, "train").otherwise("test"))
    p = models.predict(table, FEATURES, "xgboost", rounds=60)
    assert models.downstream(p.withColumn("m", F.lit(1)), ["m"]).first().accuracy > 0.93


def test_labels_are_checked(spark):
    with pytest.raises(ValueError, match="0 or 1"):
        boosting.fit(frame(spark, np.zeros((3, 3)), [0, 1, 2]), FEATURES)
    same = boosting.fit(frame(spark, np.zeros((3, 3)), [1, 1, 1]), FEATURES, rounds=2)
    assert all((t.feature < 0).all() for t in same.trees)


def test_each_column_is_filled_by_its_best_learner(spark, tmp_path):
    """A straight, a stepped and a crossed column; the search fills better than forests for all."""
    from lacuna.functions.registry import IMPUTERS

    rng = np.random.default_rng(4)
    n = 400
    a, b = rng.normal(size=n), rng.normal(size=n)
    full = np.stack([a, b, 2 * a - b, np.where(a > 0.3, 3.0, -1.0) + 0.01 * rng.normal(size=n), a + b + 0.5], 1)
    x = full.copy()
    x[:, 2:][rng.random((n, 3)) < [0.3, 0.2, 0.1]] = np.nan
    cells = spark.createDataFrame([("r", i, j, None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(n) for j in range(5)], "run_id string, row_id long, col_id long, value double")
    log_path = str(tmp_path / "log")

    def error(name, **params):
        out = np.zeros(x.shape)
        for r in IMPUTERS[name](cells, **params).collect():
            out[r.row_id, r.col_id] = r.pred
        assert np.allclose(out[np.isfinite(x)], x[np.isfinite(x)])
        return np.sqrt(np.mean((out - full)[np.isnan(x)] ** 2))

    assert error("hyperimpute", log_path=log_path) < 0.6 * error("missforest")
    log = spark.read.parquet(log_path).collect()
    first = [r for r in sorted(log, key=lambda r: -r.change) if r["round"] == 0]
    assert {r.column: r.learner for r in first}["f2"] == "linear" and {r.column: r.learner for r in first}["f3"] != "linear"
    assert all(r.error is not None for r in first) and {r.run_id for r in log} == {"r"}
    last = max(r["round"] for r in log)
    assert last < 4 and max(r.change for r in log if r["round"] == last) < 1e-3  # ended by change


def test_search_of_odd_columns(spark):
    rows = [(i, None, 1.0, float(i)) for i in range(20)]
    done, log = models.searched(spark.createDataFrame(rows, "row_id long, f0 double, f1 double, f2 double"), FEATURES)
    assert {r.f0 for r in done.collect()} == {(1.0 + 9.5) / 2} and log == []
