"""Nuclear norm and robust PCA of one tall run as tables of row arrays.

What has a number per row stays in tables; what has one per column, or pair of
columns, is summed in each task, then over tasks, and factored on the driver.
`Rounds` frees the tables of earlier rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import lowrank
from lacuna.sources.tables import Rounds


def total(rows: DataFrame, columns: dict[str, int], f: Callable[..., np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``f(*matrices)`` over all batches; `columns` are array columns with their widths."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for batch in batches:
            out += f(*(lowrank._matrix(batch.column(k), w) for k, w in enumerate(columns.values())))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), lowrank._lists(out)], names=["i", "g"])

    summed = rows.select(*columns).mapInArrow(part, "i long, g array<double>").select("i", F.posexplode("g").alias("j", "g")).groupBy("i", "j").agg(F.sum("g").alias("g")).toArrow()  # a row per number
    out = np.zeros(shape)
    out[summed.column("i").to_numpy(), summed.column("j").to_numpy()] = summed.column("g").to_numpy()
    return out


def mapped(rows: DataFrame, columns: dict[str, int], f: Callable[..., dict[str, np.ndarray]], names: list[str], sums: list[str], steps: list) -> DataFrame:
    """(row_id, arrays `names`, numbers `sums`): what `f(*matrices)` makes of each row; `steps` gets it, as in `lowrank.Replay`."""
    steps.append((tuple(columns), f))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = f(*(lowrank._matrix(batch.column(1 + k), w) for k, w in enumerate(columns.values())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(lowrank._lists(made[n]) for n in names), *(pa.array(made[n]) for n in sums)], names=["row_id", *names, *sums])

    return rows.select("row_id", *columns).mapInArrow(run, ", ".join(["row_id long", *(f"{n} array<double>" for n in names), *(f"{n} double" for n in sums)]))


def nuclear_norm(rows: DataFrame, d: int, stats, steps: list, error_tolerance: float = 1e-8, max_iters: int = 50_000, step: float | None = None, min_value: float | None = None, max_value: float | None = None, require_symmetric_solution: bool = False) -> DataFrame:
    """(row_id, x): the rounds of `lowrank.nuclear_norm` over a table."""
    if require_symmetric_solution:
        raise ValueError("a symmetric run has as many rows as columns, and is solved in one task")
    spark, share = rows.sparkSession, rows.sparkSession.sparkContext.broadcast
    zeroed = np.nan_to_num
    norm = np.sqrt(np.linalg.eigvalsh(total(rows, {"x": d}, lambda x: zeroed(x).T @ zeroed(x), (d, d)))[-1])
    step = step or 2.5 / max(norm, 1e-12) * np.sqrt(stats.n / (stats.rows * d) or 1)
    size = max(1.0, np.sqrt(stats.ss))
    rounds = Rounds(spark, "rows")
    state = {"known": d, "other": d, "dual": d}
    table = rounds.write(mapped(rows, {"x": d}, lambda x: {"known": x, "other": zeroed(x), "dual": np.zeros_like(x)}, list(state), [], steps))
    by = 1.0  # the table's duals are for the step before
    for k in range(max_iters):
        g = total(table, {"other": d, "dual": d}, lambda other, dual, by=by: (other - dual / by).T @ (other - dual / by), (d, d))
        w = share(lowrank._shrinking(*lowrank._factors(g), 1 / step))  # columns x columns

        def gaps(known, other, dual, w=w, by=by):
            dual = dual / by
            gap = np.where(np.isfinite(known), (other - dual) @ w.value + dual - known, 0.0)
            return np.array([[(gap * gap).sum()]])

        part = min(1.0, error_tolerance / max(np.sqrt(total(table, state, gaps, (1, 1))[0, 0]), 1e-300))

        def after(known, other, dual, w=w, part=part, by=by):
            dual = dual / by
            low, seen = (other - dual) @ w.value, np.isfinite(known)
            new = low + dual
            new = np.where(seen, zeroed(known) + part * np.where(seen, new - known, 0.0), new)
            if min_value is not None or max_value is not None:
                new = np.where(seen, new, np.clip(new, min_value, max_value))
            return {"known": known, "other": new, "dual": dual + low - new, "apart": ((low - new) ** 2).sum(axis=1), "moved": ((new - other) ** 2).sum(axis=1)}

        table = rounds.write(mapped(table, state, after, list(state), ["apart", "moved"], steps))
        s = table.agg(F.sum("apart").alias("apart"), F.sum("moved").alias("moved")).first()
        apart, moved = np.sqrt(s.apart), np.sqrt(s.moved)
        if max(apart, moved) < 1e-7 * size:
            break
        by = lowrank.balance(k, apart, moved)
        step *= by
    steps.append((("other",), lambda other: {"x": other}))
    return table.select("row_id", F.col("other").alias("x"))


def robust_pca(rows: DataFrame, d: int, stats, mean: np.ndarray, steps: list, n_components: int | None = None, max_iters: int = 100, tol: float = 1e-5, beta: float | None = None, beta_init: float | None = None, gamma: float = 0.5, mu: tuple[float, float] = (5, 5), trim: bool = False, **ignored) -> DataFrame:
    """(row_id, x): the low-rank part, without the columns' means, by the rounds of `lowrank.robust_pca` over a table.

    A row keeps its place in the low-rank part's row factor; the column factor is on the driver.
    """
    share = rows.sparkSession.sparkContext.broadcast
    r = n_components or max(1, min(stats.rows, d) // 10)
    beta, first = lowrank.levels(stats.rows * d, beta, beta_init)
    centre = share(mean)
    rounds = Rounds(rows.sparkSession, "rows")
    table = rounds.write(mapped(rows, {"x": d}, lambda x: {"full": np.where(np.isfinite(x), x - centre.value, 0.0)}, ["full"], [], steps))
    s0, _ = lowrank._factors(total(table, {"full": d}, lambda x: x.T @ x, (d, d)))
    size, level = max(np.sqrt((s0 * s0).sum()), 1e-12), first * s0[0]
    left = lambda x, level=level: x - lowrank.kept_over(x, level)  # noqa: E731  what is not sparse
    s, v = lowrank._factors(total(table, {"full": d}, lambda x: left(x).T @ left(x), (d, d)))
    s, v = s[:r], v[:, :r]
    turn = share(v / np.where(s > 0, s, 1))
    table = rounds.write(mapped(table, {"full": d}, lambda x, turn=turn: {"full": x, "u": left(x) @ turn.value}, ["full", "u"], [], steps))
    level, state = beta * s[0], {"full": d, "u": r}
    for k in range(max_iters):
        here = share((v * s, level))
        bound, tilt, tv = None, np.eye(r), v
        if trim:
            bound = np.sqrt(mu[0] * r / stats.rows)
            g = total(table, {"u": r}, lambda u, b=bound: lowrank.trimmed(u, b).T @ lowrank.trimmed(u, b), (r, r))
            tilt, tv = lowrank.trim_factors(g, s, v, np.sqrt(mu[1] * r / d))
        tangent = share((bound, tilt))

        def rest(full, u, here=here, tangent=tangent):
            """What is not sparse, and the row's place on the tangent space."""
            vs, level = here.value
            low = u @ vs.T
            bound, tilt = tangent.value
            return full - lowrank.kept_over(full - low, level), (u if bound is None else lowrank.trimmed(u, bound)) @ tilt

        def across(full, u, rest=rest):
            z, t = rest(full, u)
            return z.T @ t

        zu = total(table, state, across, (d, r))
        c = zu.T @ tv
        out = share((tv, c))

        def off(full, u, rest=rest, out=out):
            z, t = rest(full, u)
            e = z @ out.value[0] - t @ out.value[1]
            return e.T @ e

        values, e = np.linalg.eigh(total(table, state, off, (r, r)))
        some = values > 1e-24 * max(s[0] ** 2, 1e-300)
        root = np.sqrt(np.where(some, values, 1))
        q2, r2 = np.linalg.qr(zu - tv @ c.T)
        um, sm, vm = np.linalg.svd(np.block([[c, r2.T], [np.where(some, root, 0)[:, None] * e.T, np.zeros((r, r2.shape[0]))]]))
        s, v = sm[:r], np.hstack([tv, q2]) @ vm.T[:, :r]
        level = beta * ((sm[r] if len(sm) > r else 0.0) + gamma ** (k + 1) * sm[0])
        turn = share((um[:r, :r], e * np.where(some, 1 / root, 0) @ um[r:, :r], v * s, level))

        def after(full, u, rest=rest, out=out, turn=turn):
            z, t = rest(full, u)
            a, b, vs, level = turn.value
            new = t @ a + (z @ out.value[0] - t @ out.value[1]) @ b
            gap = full - new @ vs.T
            gap = gap - lowrank.kept_over(gap, level)
            return {"full": full, "u": new, "gap": (gap * gap).sum(axis=1)}

        table = rounds.write(mapped(table, state, after, ["full", "u"], ["gap"], steps))
        if np.sqrt(table.agg(F.sum("gap").alias("gap")).first().gap) / size < tol:
            break
    vs = share(v * s)
    return mapped(table, {"u": r}, lambda u: {"x": u @ vs.value.T}, ["x"], [], steps)
