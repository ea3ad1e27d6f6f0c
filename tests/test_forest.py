"""Forests against what they must learn, in one part and in many; no tree of them reaches the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import boosting, forest, models


def frame(spark, x, y, n_train):
    rows = [(i, float(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x, strict=True))]
    fields = ", ".join(f"f{j} double" for j in range(x.shape[1]))
    return spark.createDataFrame(rows, f"row_id long, label double, {fields}").withColumn("split", F.when(F.col("row_id") < n_train, "train").otherwise("test")).repartition(3)


@pytest.mark.parametrize("most", [1 << 23, 4 * 150])
def test_forests_learn_without_mllib(spark, monkeypatch, most):
    """The driver holds no model: MLlib's, which it does hold, are not called; nodes over `most` entries are split by jobs."""
    import pyspark.ml.classification as c

    monkeypatch.setattr(c.RandomForestClassifier, "fit", None)
    monkeypatch.setattr(boosting, "FEW_ENTRIES", most)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    p = models.predict(frame(spark, x, y, 600), [f"f{j}" for j in range(4)], "random_forest", trees=30).collect()
    assert sorted(r.row_id for r in p) == list(range(600, 900)) and all(0 <= r.score <= 1 and r.label == y[r.row_id] for r in p)
    assert np.mean([r.pred == r.label for r in p]) > 0.9
    z = x[:, 0] + 2 * (x[:, 1] > 0)
    p = models.predict(frame(spark, x, z, 600), [f"f{j}" for j in range(4)], "random_forest", "regression", trees=30).collect()
    assert 1 - np.mean([(r.pred - r.label) ** 2 for r in p]) / z[600:].var() > 0.8


def test_a_whole_tree_fits_its_rows():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, forest.BINS, (300, 3)).astype(np.uint8), rng.integers(0, 3, 300)
    w = np.ones(300)
    feature, cut, left, value = forest.grow(x, w, np.stack([w * (y == c) for c in range(3)]), 3, 30, rng)
    got = value[forest.leaf_of(x, feature, cut, left)]
    assert np.allclose(got.sum(1), 1) and (got.argmax(1) == y).mean() > 0.97
