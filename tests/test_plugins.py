"""Plugin classes and table functions against numpy and the imputers they stand for."""

import importlib.util
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import plugins
from lacuna.functions.registry import IMPUTERS, METRICS, TABLE_METRICS
from lacuna.operators import lowrank, scores


@pytest.fixture(scope="module")
def example():
    spec = importlib.util.spec_from_file_location("custom_plugin", Path(__file__).parents[1] / "examples/custom_plugin.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    yield module
    IMPUTERS.pop("twice_centred")
    TABLE_METRICS.pop("largest_error")


def cells(spark, runs):
    rows = [(name, i, j, None if np.isnan(v) else float(v)) for name, x in runs.items() for (i, j), v in np.ndenumerate(x)]
    return spark.createDataFrame(rows, "run_id string, row_id long, col_id long, value double").repartition(3)


def runs():
    rng = np.random.default_rng(1)
    out = {k: rng.normal(size=(n, 6)) for k, n in (("a", 20), ("b", 9))}
    for x in out.values():
        x[rng.random(x.shape) < 0.3] = np.nan
    return out


def test_plugin_classes(spark, example):
    out = runs()
    full = IMPUTERS["twice_centred"](cells(spark, out | {"none": np.full((2, 2), np.nan)}))
    for r in full.filter("run_id <> 'none'").collect():
        assert np.isclose(r.pred, example.TwiceCentred().complete(out[r.run_id])[r.row_id, r.col_id]) and r.error is None
    assert {r.pred for r in full.filter("run_id = 'none'").collect()} == {None}
    scored = full.filter("run_id <> 'none'").withColumn("truth", F.col("row_id") * 0.1).withColumn("is_eval", F.col("value").isNull())
    got = {r.run_id: (r.largest_error, r.mae) for r in scores.score(scored, ["largest_error", "mae"], ["run_id"]).collect()}
    for name, x in out.items():
        gap = np.abs(example.TwiceCentred().complete(x) - 0.1 * np.arange(len(x))[:, None])[np.isnan(x)]
        assert np.isclose(got[name][0], gap.max()) and np.isclose(got[name][1], gap.mean())


def test_classes_that_do_nothing_are_refused():
    with pytest.raises(TypeError, match="neither"):
        IMPUTERS.register("nothing")(type("Nothing", (), {}))
    with pytest.raises(TypeError, match="neither"):
        METRICS.register("nothing")(type("Nothing", (), {"complete": None}))


def test_methods_from_sql(spark):
    out = runs()
    cells(spark, out).createOrReplaceTempView("cells_of_runs")
    plugins.register_table_functions(spark)
    got = spark.sql("""SELECT * FROM complete(TABLE(SELECT run_id, row_id, col_id, value FROM cells_of_runs) PARTITION BY (run_id), 'soft_impute', '{"max_iters": 20}')""")
    assert got.columns == ["run_id", "row_id", "col_id", "value", "pred", "error"]
    for r in got.collect():
        assert r.error is None and np.isclose(r.pred, lowrank.soft_impute(out[r.run_id], max_iters=20)[r.row_id, r.col_id])
    bad = spark.sql("SELECT DISTINCT error FROM complete(TABLE(cells_of_runs) PARTITION BY (run_id), 'cadzow')").collect()
    assert [r.error for r in bad] == ["a rank is needed"]
    with pytest.raises(Exception, match="no method of one matrix"):
        spark.sql("SELECT * FROM complete(TABLE(cells_of_runs) PARTITION BY (run_id), 'knn')").collect()


@pytest.mark.parametrize(("method", "solve", "params"), [
    ("soft_impute", lowrank.soft_impute, {"max_iters": 20}), ("svt", lowrank.svt, {"max_iters": 15, "tau": 3.0}),
    ("nuclear_norm_minimization", lowrank.nuclear_norm, {"max_iters": 12}), ("robust_pca", lowrank.robust_pca, {"n_components": 2, "max_iters": 10}),
])
def test_large_runs_are_called_by_pieces(spark, monkeypatch, method, solve, params):
    """No task has a run over MOST_CELLS whole; its pieces are filled as the whole matrix is."""
    out = runs()
    monkeypatch.setattr(lowrank, "MOST_CELLS", 60)  # a has 120 cells, b 54
    monkeypatch.setattr(plugins, "PIECE", 40)
    pieces, rounds = plugins.in_pieces(cells(spark, out), method, **params)
    assert list(rounds) == ["a"] and pieces.filter("run_id.piece IS NOT NULL").select("run_id").distinct().count() > 1
    pieces.createOrReplaceTempView("pieces_of_runs")
    plugins.register_table_functions(spark, "complete_pieces", rounds)
    call = "SELECT run_id.run_id AS run, * FROM complete_pieces(TABLE(SELECT run_id, row_id, col_id, value FROM pieces_of_runs) PARTITION BY (run_id), '{}', '{}')"
    got = spark.sql(call.format(method, json.dumps(params))).collect()
    assert len(got) == 120 + 54
    want = {name: solve(x, **params) for name, x in out.items()}
    for r in got:
        assert r.error is None and np.isclose(r.pred, want[r.run][r.row_id, r.col_id], atol=1e-7)
    other = spark.sql(call.format("svt", '{"tau": 9}')).filter("run = 'a'").select("error").distinct().collect()
    assert len(other) == 1 and other[0].error.startswith("the rounds of run a are those of")


def test_the_table_function_holds_few_bytes_a_cell():
    """Cells are kept in typed columns, not as rows of objects; nulls, NaN and strings come back as they were."""
    import tracemalloc

    from pyspark.sql import Row

    from lacuna.functions.plugins import Complete

    n, made = 20_000, Complete()
    tracemalloc.start()
    for i in range(n):
        list(made.eval(Row(run_id=str("r" + "x" * 20), row_id=i // 20, col_id=i % 20, value=None if i % 7 == 0 else i * 0.37), "svt", '{"max_iters": 2}'))
    assert tracemalloc.get_traced_memory()[0] < 60 * n
    tracemalloc.stop()
    out = list(made.terminate())
    assert [o[:4] for o in out] == [("rxxxxxxxxxxxxxxxxxxxxx"[: 1 + 20], i // 20, i % 20, None if i % 7 == 0 else i * 0.37) for i in range(n)]
    assert all(o[4] is not None and o[5] is None for o in out)
