"""Plugin classes over whole matrices, and per-run methods as table functions of SQL.

A class with `complete(observed, **params)` becomes an imputer, one with
`compute(y_true, y_pred, eval_mask, **params)` a metric; each run is a matrix in a
task of its own, so a run has at most `lowrank.MOST_CELLS` cells.
"""

from __future__ import annotations

import json
import math
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a piece of a large run, about.
PIECE = 1 << 18


def imputer_of(cls: type) -> Callable[..., DataFrame]:
    """f(cells, keys, **params) of a class with `complete`; a run it fails on is rows with `error`."""
    from lacuna.operators import lowrank
    from lacuna.operators.cells import KEYS

    def solve(x: np.ndarray, **params) -> np.ndarray:
        try:
            done = np.asarray(cls().complete(x.copy(), **params), float)
        except Exception as e:  # noqa: BLE001  a plugin may raise anything
            raise ValueError(f"{type(e).__name__}: {e}") from e
        if done.shape != x.shape:
            raise ValueError(f"{cls.__name__} made a matrix of {done.shape} from one of {x.shape}")
        return done

    def fill(cells: DataFrame, keys=KEYS, **params) -> DataFrame:
        return lowrank.per_run(cells, solve, keys, **params)

    return fill


def metric_of(cls: type, name: str) -> Callable[..., DataFrame]:
    """f(cells with truth, pred and is_eval, keys, **params) of a class with `compute`: a row per run, NaN is null."""

    def metric(cells: DataFrame, keys: list[str], **params) -> DataFrame:
        scored = cells.withColumn("is_eval", F.coalesce("is_eval", F.lit(False))) if "is_eval" in cells.columns else cells.withColumn("is_eval", F.lit(True))
        one = scored.select(*keys, "row_id", "col_id", F.col("truth").cast("double").alias("truth"), F.col("pred").cast("double").alias("pred"), "is_eval")

        def run(key: tuple, table: pa.Table) -> pa.Table:
            rows, r = np.unique(table.column("row_id").to_numpy(), return_inverse=True)
            cols, c = np.unique(table.column("col_id").to_numpy(), return_inverse=True)
            truth, pred, mask = np.full((len(rows), len(cols)), np.nan), np.full((len(rows), len(cols)), np.nan), np.zeros((len(rows), len(cols)), bool)
            for to, of in ((truth, "truth"), (pred, "pred"), (mask, "is_eval")):
                to[r, c] = table.column(of).to_pandas().to_numpy(bool if of == "is_eval" else float)
            value = float(cls().compute(truth, pred, mask, **params))
            return table.slice(0, 1).select(list(keys)).append_column(name, pa.array([value if np.isfinite(value) else None], pa.float64()))

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.select(*keys).schema.fields)
        return one.groupBy(*keys).applyInArrow(run, f"{kinds}, {name} double")

    return metric


class Complete:
    """A table function: ``SELECT * FROM complete(TABLE(cells) PARTITION BY (run_id), 'svt', '{"max_iters": 50}')``.

    The table has row_id, col_id and value; each partition is one matrix, or a piece of one as `in_pieces` makes them.
    Returns the table's columns, pred and error.
    """

    rounds: dict = {}

    @staticmethod
    def analyze(cells, method, params=None):
        from pyspark.sql.types import DoubleType, StringType, StructField, StructType
        from pyspark.sql.udtf import AnalyzeResult

        if not cells.isTable:
            raise ValueError("the first argument is a TABLE(...)")
        names = [f.name for f in cells.dataType.fields]
        if missing := [c for c in ("row_id", "col_id", "value") if c not in names]:
            raise ValueError(f"the table lacks {', '.join(missing)}")
        solver(method.value)
        return AnalyzeResult(StructType([*cells.dataType.fields, StructField("pred", DoubleType()), StructField("error", StringType())]))

    def __init__(self):
        self.n, self.numbers, self.codes, self.places = 0, {}, {}, {}
        self.told: tuple = ("", None)

    def eval(self, cells, method: str, params: str | None = None) -> Iterator[tuple]:
        from lacuna.operators import lowrank

        self.told = (method, params)
        if self.n > lowrank.MOST_CELLS:
            raise ValueError(f"a partition has more than {lowrank.MOST_CELLS} cells; call it on the table that in_pieces makes")
        self.n += 1
        self.names = list(cells.__fields__)
        for k, value in enumerate(cells):
            if self.names[k] == "value":
                self.numbers.setdefault(k, array("d")).append(math.nan if value is None else value)
            # Other values are kept once each, and their places: a cell takes eight bytes a column.
            places = self.places.setdefault(k, {})
            if self.names[k] != "value" or type(value) is not float or not math.isfinite(value):
                at = places.setdefault(repr(value), (len(places), value))[0]
                self.codes.setdefault(k, array("i")).append(at)
            else:
                self.codes.setdefault(k, array("i")).append(-1)
        return iter(())

    def _cell(self, i: int) -> tuple:
        return tuple(self.numbers[k][i] if self.codes[k][i] < 0 else self.kept[k][self.codes[k][i]] for k in range(len(self.names)))

    def _piece(self, method: str, params: dict):
        """The rounds of the run that this partition is a piece of, if it is one."""
        run = self.kept[self.names.index("run_id")][0] if "run_id" in self.names else None
        if getattr(run, "piece", None) is None:
            return None
        known, found = self.rounds.get(run.run_id, ((method, params), f"no rounds of run {run.run_id} are known"))
        if known != (method, params):
            raise ValueError(f"the rounds of run {run.run_id} are those of {known[0]} with {json.dumps(known[1])}")
        if isinstance(found, str):
            raise ValueError(found)
        return found

    def terminate(self) -> Iterator[tuple]:
        if not self.n:
            return
        self.kept = {k: [value for _, value in places.values()] for k, places in self.places.items()}
        row, col, value = (self.names.index(c) for c in ("row_id", "col_id", "value"))
        (rows, r), (cols, c) = (np.unique(np.array(self.kept[k])[np.frombuffer(self.codes[k], np.int32)], return_inverse=True) for k in (row, col))
        method, params = self.told[0], json.loads(self.told[1] or "{}")
        try:
            if (piece := self._piece(method, params)) is None:
                fill = lambda x: solver(method)(x, **params)
            else:
                cols, c, fill = piece.cols, np.searchsorted(piece.cols, cols)[c], piece.fill
            x = np.full((len(rows), len(cols)), np.nan)
            x[r, c] = np.frombuffer(self.numbers[value])
            x[~np.isfinite(x)] = np.nan
            pred, error = fill(x)[r, c], None
        except (ValueError, TypeError, np.linalg.LinAlgError) as e:
            pred, error = np.full(self.n, np.nan), str(e)
        for i in range(self.n):
            yield (*self._cell(i), None if pred[i] != pred[i] else float(pred[i]), error)


def solver(name: str) -> Callable[..., np.ndarray]:
    """A per-run method over one matrix, by its registered name."""
    from lacuna.operators import lowrank

    known = {"svt": lowrank.svt, "soft_impute": lowrank.soft_impute, "nuclear_norm_minimization": lowrank.nuclear_norm, "robust_pca": lowrank.robust_pca, "cadzow": lowrank.cadzow}
    if name not in known:
        raise ValueError(f"{name} is no method of one matrix; known are {', '.join(sorted(known))}")
    return known[name]


def in_pieces(cells: DataFrame, method: str, **params) -> tuple[DataFrame, dict]:
    """`cells` for a call of `complete`, and the rounds of its large runs for `register_table_functions`.

    Where a run has more than MOST_CELLS cells, run_id becomes (run_id, piece), so that PARTITION BY (run_id) deals the
    rows of a large run to pieces of about PIECE cells; a run that fits a task has a null piece.  The rounds of a large
    run are found by `lowrank.tall` over its table, and each piece goes through them.  `cadzow` has no rounds by rows.
    """
    from lacuna.operators import lowrank

    large = cells.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > lowrank.MOST_CELLS).collect()  # runs are few
    if not large or method == "cadzow":
        return cells, {}
    rounds, piece = {}, F.lit(None).cast("long")
    for run in large:
        is_run, found = F.col("run_id").eqNullSafe(run.run_id), lowrank.Replay()
        try:
            lowrank.tall(cells.filter(is_run), method, replay=found, **params)
        except ValueError as e:
            found = str(e)
        rounds[run.run_id] = (method, params), found
        piece = F.when(is_run, F.pmod(F.xxhash64("row_id"), F.lit(math.ceil(run.n / PIECE)))).otherwise(piece)
    return cells.withColumn("run_id", F.struct("run_id", piece.alias("piece"))), rounds


def register_table_functions(spark: SparkSession, name: str = "complete", rounds: dict | None = None) -> None:
    """Makes the per-run methods callable from SQL in this session; `rounds` are those of runs `in_pieces`."""

    class Fitted(Complete):
        pass

    Fitted.rounds = rounds or {}
    spark.udtf.register(name, F.udtf(Fitted if rounds else Complete))
