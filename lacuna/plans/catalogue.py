"""Every query of the library by name, and the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import plugins
from lacuna.functions.rand import uniform
from lacuna.functions.registry import IMPUTERS
from lacuna.operators import cells as C
from lacuna.operators import diffusion, encode, hankel, impute, lowrank, masks, models, reports, scores, simulate
from lacuna.plans import fixtures as X
from lacuna.sources.tables import cut_lineage, run_id
from lacuna.plans.fixtures import DAILY, HOUR, LABELLED, RUNS, SUP, u_sql, z_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SHARE, SEED = 0.2, 3


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        name = f.__name__.lstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Grids.


@query("""WITH last AS (SELECT user_id AS rk, event_type AS ck, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2),
r AS (SELECT rk, dense_rank() OVER (ORDER BY rk) - 1 AS row_id FROM (SELECT DISTINCT rk FROM last)), c AS (SELECT ck, dense_rank() OVER (ORDER BY ck) - 1 AS col_id FROM (SELECT DISTINCT ck FROM last))
SELECT r.row_id, c.col_id, round(last.value, 6) AS value FROM r CROSS JOIN c LEFT JOIN last ON last.rk = r.rk AND last.ck = c.ck""")
def cells_from_triplets(spark, sf):
    t = X.table(spark, sf, "events").select(F.lit("r").alias("run_id"), F.col("user_id").alias("row_key"), F.col("event_type").alias("col_key"), "value", F.col("event_id").alias("ordinal"))
    return rounded(C.from_triplets(t).select(F.col("row_id").cast("long").alias("row_id"), F.col("col_id").cast("long").alias("col_id"), "value"), "value")


@query("""WITH last AS (SELECT event_type AS rk, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS ck, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2),
r AS (SELECT rk, dense_rank() OVER (ORDER BY rk) - 1 AS row_id FROM (SELECT DISTINCT rk FROM last)), c AS (SELECT ck, dense_rank() OVER (ORDER BY ck) - 1 AS col_id FROM (SELECT DISTINCT ck FROM last))
SELECT r.row_id, c.col_id, round(last.value, 6) AS value FROM r CROSS JOIN c LEFT JOIN last ON last.rk = r.rk AND last.ck = c.ck""")
def panel_pivot(spark, sf):
    day = (F.year("ts") * 10000 + F.month("ts") * 100 + F.day("ts")).cast("string")
    long = X.table(spark, sf, "events").select(F.lit("r").alias("run_id"), F.col("event_type").alias("Region"), day.alias("Year"), F.col("value").alias("Outcome"), F.col("event_id").alias("ordinal"))
    p = C.panel(long, ["regionname", "region"], ["year", "time"], ["gdpcap", "outcome"])
    return rounded(p.select(F.col("row_id").cast("long").alias("row_id"), F.col("col_id").cast("long").alias("col_id"), "value"), "value")


@query(f"WITH {SUP} SELECT count(*) AS n_cells, count(value) AS n_known, round(1 - count(value) / count(*), 6) AS missing_share FROM cells")
def grid_known_counts(spark, sf):
    return rounded(C.counts(X.sup_month(spark, sf)).drop("run_id"), "missing_share")


@query(f"WITH {HOUR} SELECT row_id FROM cells GROUP BY row_id HAVING count(value) = count(*)")
def complete_rows(spark, sf):
    return C.complete_rows(X.user_hour(spark, sf)).select("row_id")


_SPLIT = f"""n AS (SELECT greatest(1, CAST(round_even(count(DISTINCT row_id) * CAST({SHARE} AS DOUBLE), 0) AS BIGINT)) AS n FROM cells),
splits AS (SELECT row_id, CASE WHEN row_number() OVER (ORDER BY {u_sql('row_id', SEED, 'split')}, row_id) <= (SELECT n FROM n) THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT row_id FROM cells))"""


@query(f"WITH {SUP}, {_SPLIT} SELECT row_id, split FROM splits")
def split_rows(spark, sf):
    return C.split_rows(X.sup_month(spark, sf), SHARE, SEED).select("row_id", "split")


# Masks.

_N = f"n AS (SELECT greatest(1, CAST(round_even(count(value) * CAST({SHARE} AS DOUBLE), 0) AS BIGINT)) AS n FROM cells)"
_AT = "row_id, col_id"


def _mask_sql(placed: str, grid: str = SUP, more: str = "") -> str:
    """`placed`: a query with row_id, col_id, place for known cells."""
    return f"""WITH {grid}, {_N}{more}, placed AS ({placed}), chosen AS (SELECT row_id, col_id FROM (SELECT row_id, col_id, row_number() OVER (ORDER BY place, row_id, col_id) AS k FROM placed) WHERE k <= (SELECT n FROM n))
SELECT row_id, col_id FROM chosen"""


def _hidden(df: DataFrame) -> DataFrame:
    return df.filter("hidden").select("row_id", "col_id")


@query(_mask_sql(f"SELECT row_id, col_id, {u_sql(_AT, SEED, 'mcar')} AS place FROM cells WHERE value IS NOT NULL"))
def mask_mcar(spark, sf):
    return _hidden(masks.mcar(X.sup_month(spark, sf), SHARE, SEED))


_LOGIT = "(1 / (1 + exp(-({}))))"


@query(_mask_sql(
    f"""SELECT c.row_id, c.col_id, coalesce(d.drawn / 2, 0.5 + {u_sql('c.row_id, c.col_id', SEED, 'mcar')} / 2) AS place FROM cells c LEFT JOIN drawn d ON d.row_id = c.row_id AND d.col_id = c.col_id WHERE c.value IS NOT NULL""",
    HOUR,
    f""", x AS (SELECT row_id, value AS x FROM cells WHERE col_id = (SELECT min(col_id) FROM cells)),
s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM x),
w AS (SELECT row_id, {_LOGIT.format('1.2 * CASE WHEN x IS NULL OR s.sd = 0 THEN 0 ELSE (x - s.m) / s.sd END + 0.2 * ' + z_sql('row_id', SEED, 'mar'))} AS w FROM x, s),
iv AS (SELECT row_id, (sum(w) OVER (ORDER BY row_id) - w) / sum(w) OVER () AS low, sum(w) OVER (ORDER BY row_id) / sum(w) OVER () AS high FROM w),
dr AS (SELECT i AS draw, {u_sql('i', SEED, 'draw')} AS u FROM (SELECT unnest(generate_series(0, 3 * (SELECT n FROM n) - 1)) AS i)),
rk AS (SELECT row_id, col_id, row_number() OVER (PARTITION BY row_id ORDER BY col_id) - 1 AS k, count(*) OVER (PARTITION BY row_id) AS m FROM cells WHERE value IS NOT NULL),
drawn AS (SELECT rk.row_id, rk.col_id, min(dr.draw / (3 * (SELECT n FROM n))) AS drawn FROM dr JOIN iv ON dr.u >= iv.low AND dr.u < iv.high JOIN rk ON rk.row_id = iv.row_id AND rk.k = floor({u_sql('dr.draw', SEED, 'cell')} * rk.m) GROUP BY 1, 2)""",
))
def mask_mar_logistic(spark, sf):
    return _hidden(masks.mar_logistic(X.user_hour(spark, sf), SHARE, SEED))


@query(_mask_sql(f"""SELECT row_id, col_id, 1 - exp(ln({u_sql(_AT, SEED, 'pick')}) / {_LOGIT.format("(value - s.m) / s.sd + 0.15 * " + z_sql(_AT, SEED, 'mnar'))}) AS place FROM cells, (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM cells) s WHERE value IS NOT NULL"""))
def mask_mnar_self(spark, sf):
    return _hidden(masks.mnar_self_logistic(X.sup_month(spark, sf), SHARE, SEED))


def _block_sql(what: str, other: str) -> str:
    return _mask_sql(
        f"SELECT row_id, col_id, CASE WHEN pl BETWEEN start AND start + length - 1 THEN {u_sql(_AT, SEED, 'trim')} / 2 ELSE 0.5 + {u_sql(_AT, SEED, 'trim')} / 2 END AS place FROM cells JOIN ix USING ({what}), size WHERE value IS NOT NULL",
        SUP,
        f""", ix AS (SELECT {what}, row_number() OVER (ORDER BY {what}) - 1 AS pl FROM (SELECT DISTINCT {what} FROM cells)),
sz AS (SELECT count(DISTINCT {what}) AS nw, least(count(DISTINCT {what}), greatest(1, CAST(round_even((SELECT n FROM n) / count(DISTINCT {other}), 0) AS BIGINT))) AS length FROM cells),
size AS (SELECT length, floor({u_sql("'block'", SEED, 'start')} * (nw - length + 1)) AS start FROM sz)""",
    )


@query(_block_sql("row_id", "col_id"))
def mask_block_rows(spark, sf):
    return _hidden(masks.block(X.sup_month(spark, sf), SHARE, SEED, "rows"))


@query(_block_sql("col_id", "row_id"))
def mask_block_cols(spark, sf):
    return _hidden(masks.block(X.sup_month(spark, sf), SHARE, SEED, "cols"))


_BU = lambda tag: u_sql("burst", SEED, tag)


@query(_mask_sql(
    f"SELECT c.row_id, c.col_id, coalesce(f.drawn / 2, 0.5 + {u_sql('c.row_id, c.col_id', SEED, 'mcar')} / 2) AS place FROM cells c JOIN ri USING (row_id) JOIN ci USING (col_id) LEFT JOIN f ON f.ra = ri.ra AND f.ca = ci.ca WHERE c.value IS NOT NULL",
    SUP,
    f""", ri AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS ra FROM (SELECT DISTINCT row_id FROM cells)), ci AS (SELECT col_id, row_number() OVER (ORDER BY col_id) - 1 AS ca FROM (SELECT DISTINCT col_id FROM cells)),
sh AS (SELECT (SELECT count(*) FROM ri) AS nr, (SELECT count(*) FROM ci) AS nc), b0 AS (SELECT i AS burst, nr, nc FROM sh, (SELECT unnest(generate_series(0, (SELECT n FROM n))) AS i)),
b1 AS (SELECT *, 2 + CAST(floor({_BU('length')} * 4) AS INTEGER) AS length, {_BU('side')} < 0.5 AS alongrow FROM b0),
b2 AS (SELECT *, floor({_BU('line')} * CASE WHEN alongrow THEN nr ELSE nc END) AS line, floor({_BU('start')} * greatest(1, CASE WHEN alongrow THEN nc ELSE nr END - length + 1)) AS start FROM b1),
b3 AS (SELECT *, unnest(generate_series(0, length - 1)) AS k FROM b2),
f AS (SELECT CASE WHEN alongrow THEN line ELSE start + k END AS ra, CASE WHEN alongrow THEN start + k ELSE line END AS ca, min((burst * 6 + k) / (((SELECT n FROM n) + 1) * 6)) AS drawn FROM b3 GROUP BY 1, 2)""",
))
def mask_bursty(spark, sf):
    return _hidden(masks.bursty(X.sup_month(spark, sf), SHARE, SEED, burst_max=6))


@query(f"WITH {HOUR} SELECT row_id, col_id FROM cells WHERE col_id = 5 AND value > 50")
def mask_censor(spark, sf):
    return _hidden(masks.censor_above_threshold(X.user_hour(spark, sf), 50.0, 5))


_MCAR = f"hid AS (SELECT row_id, col_id FROM (SELECT row_id, col_id, row_number() OVER (ORDER BY {u_sql(_AT, SEED, 'mcar')}, row_id, col_id) AS k FROM cells WHERE value IS NOT NULL) WHERE k <= (SELECT n FROM n)), obs AS (SELECT c.row_id, c.col_id, c.value AS truth, CASE WHEN h.row_id IS NULL THEN c.value END AS value, h.row_id IS NOT NULL AS is_eval FROM cells c LEFT JOIN hid h ON h.row_id = c.row_id AND h.col_id = c.col_id)"
_OBS = f"{SUP}, {_N}, {_MCAR}"


def observed(spark, sf, grid=X.sup_month) -> DataFrame:
    """A holdout: `truth`, `value` without the hidden cells, `is_eval`; written, as a bundle is."""
    x = C.hide(masks.mcar(grid(spark, sf), SHARE, SEED))
    return cut_lineage(x.select("run_id", "row_id", "col_id", F.col("value").alias("truth"), F.col("observed").alias("value"), F.col("hidden").alias("is_eval")))


@query(f"WITH {_OBS} SELECT row_id, col_id, value FROM obs")
def apply_mask(spark, sf):
    return observed(spark, sf).select("row_id", "col_id", "value")


@query(f"WITH {_OBS} SELECT count(*) AS n_cells, count(truth) AS n_known, count(value) AS n_train, CAST(sum(is_eval::INT) AS BIGINT) AS n_eval, round(sum(truth), 3) AS sum_truth, round(sum(value), 3) AS sum_train FROM obs")
def holdout_split(spark, sf):
    x = observed(spark, sf)
    return x.agg(F.count(F.lit(1)).alias("n_cells"), F.count("truth").alias("n_known"), F.count("value").alias("n_train"), F.count_if("is_eval").alias("n_eval"), F.round(F.sum("truth"), 3).alias("sum_truth"), F.round(F.sum("value"), 3).alias("sum_train"))


@query(f"""WITH {HOUR}, {_SPLIT}, f AS (SELECT c.*, s.split, CASE WHEN s.split = 'train' THEN {SEED} ELSE {SEED + 10000} END AS seed FROM cells c JOIN splits s USING (row_id) WHERE col_id <> 0),
k AS (SELECT split, greatest(1, CAST(round_even(count(value) * CAST({SHARE} AS DOUBLE), 0) AS BIGINT)) AS k FROM f GROUP BY 1),
p AS (SELECT row_id, col_id, split, row_number() OVER (PARTITION BY split ORDER BY {u_sql(_AT, 'seed', 'mcar')}, row_id, col_id) AS place FROM f WHERE value IS NOT NULL)
SELECT p.row_id, p.col_id, p.split FROM p JOIN k USING (split) WHERE p.place <= k.k""")
def split_masks(spark, sf):
    x = X.user_hour(spark, sf)
    return masks.split_masks(x, C.split_rows(x, SHARE, SEED), "mcar", SHARE, SEED, target=0).filter("hidden").select("row_id", "col_id", "split")


# Generators, over a grid as tall as the line items' suppliers.


def _shape(spark, sf) -> DataFrame:
    s = X.table(spark, sf, "supplier").select(F.lit("r").alias("run_id"), F.col("s_suppkey").alias("row_id"))
    return s.withColumn("col_id", F.explode(F.sequence(F.lit(0), F.lit(29)).cast("array<bigint>")))


_GRID = "g AS (SELECT s_suppkey AS row_id, c.col_id FROM supplier CROSS JOIN (SELECT unnest(generate_series(0, 29)) AS col_id) c)"
_LR = f"""k AS (SELECT unnest(generate_series(0, 4)) AS k), u AS (SELECT row_id, k, {z_sql('row_id, k', SEED, 'u')} AS u FROM (SELECT DISTINCT row_id FROM g), k), v AS (SELECT col_id, k, {z_sql('col_id, k', SEED, 'v')} AS v FROM (SELECT DISTINCT col_id FROM g), k),
cells AS (SELECT row_id, col_id, sum(u * v) AS value FROM u JOIN v USING (k) GROUP BY 1, 2)"""


def _low_rank(spark, sf) -> DataFrame:
    return simulate.low_rank_gaussian(_shape(spark, sf), 5, SEED)


@query(f"WITH {_GRID}, {_LR} SELECT row_id, col_id, round(value, 6) AS value FROM cells")
def sim_low_rank(spark, sf):
    return rounded(_low_rank(spark, sf).select("row_id", "col_id", "value"), "value")


@query(f"""WITH {_GRID} SELECT row_id, col_id, round({z_sql(f"CAST(floor({u_sql('row_id', SEED, 'rg')} * 6) AS BIGINT), CAST(floor({u_sql('col_id', SEED, 'cg')} * 5) AS BIGINT)", SEED, 'block')} + 0.08 * {z_sql(_AT, SEED, 'group')}, 6) AS value FROM g""")
def sim_block(spark, sf):
    return rounded(simulate.block_low_rank(_shape(spark, sf), 6, 5, SEED).select("row_id", "col_id", "value"), "value")


@query("""WITH k AS (SELECT unnest(generate_series(0, 4)) AS k)
SELECT 'factors' AS what, a.k AS i, b.k AS j, (a.k = b.k)::INTEGER::DOUBLE AS value FROM k a, k b
UNION ALL SELECT 'squares', 0, 0, round(sum(power(0.82, 2 * k)), 8) FROM k UNION ALL SELECT 'fourth powers', 0, 0, round(sum(power(0.82, 4 * k)), 8) FROM k""")
def sim_orthogonal(spark, sf):
    """The inner products of the row factors, and the sums of powers of the singular values."""
    grid = _shape(spark, sf)
    x = cut_lineage(simulate.low_rank_orthogonal(grid, 5, SEED))
    u = simulate.orthonormal(grid, "row_id", 5, SEED, "u").select(F.posexplode("factor").alias("i", "a"), "factor").select("i", "a", F.posexplode("factor").alias("j", "b"))
    parts = [u.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value")).withColumn("what", F.lit("factors"))]
    gram = lowrank.gram(x).withColumn("twice", F.when(F.col("i") == F.col("j"), 1).otherwise(2))
    for what, value in (("squares", F.sum(F.when(F.col("i") == F.col("j"), F.col("g")))), ("fourth powers", F.sum(F.col("twice") * F.col("g") * F.col("g")))):
        parts.append(gram.agg(value.alias("value")).select(F.lit(0).alias("i"), F.lit(0).alias("j"), "value", F.lit(what).alias("what")))
    return reduce(DataFrame.unionByName, parts).select("what", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.round("value", 8) + 0.0).alias("value"))


@query(f"WITH {SUP} SELECT row_id, col_id, round(value + 0.1 * {z_sql(_AT, SEED, 'noise')}, 6) AS noisy FROM cells WHERE value IS NOT NULL")
def noise_gaussian(spark, sf):
    return rounded(simulate.add_noise(X.sup_month(spark, sf), "gaussian", SEED).filter("value IS NOT NULL").select("row_id", "col_id", "noisy"), "noisy")


@query(f"WITH {SUP} SELECT row_id, col_id, round(value + 0.15 * sqrt(3.0 * (power({u_sql(_AT, SEED, 'noise1')}, -2.0 / 3.0) - 1)) * cos(2 * pi() * {u_sql(_AT, SEED, 'noise2')}), 6) AS noisy FROM cells WHERE value IS NOT NULL")
def noise_student_t(spark, sf):
    return rounded(simulate.add_noise(X.sup_month(spark, sf), "student_t", SEED).filter("value IS NOT NULL").select("row_id", "col_id", "noisy"), "noisy")


@query(f"""WITH {SUP}, n AS (SELECT CAST(round_even(count(value) * CAST(0.05 AS DOUBLE), 0) AS BIGINT) AS n FROM cells), r AS (SELECT row_id, col_id, value, row_number() OVER (ORDER BY {u_sql(_AT, SEED, 'sparse')}, row_id, col_id) AS k FROM cells WHERE value IS NOT NULL)
SELECT row_id, col_id, round(value + CASE WHEN k <= (SELECT n FROM n) THEN 3.0 * {z_sql(_AT, SEED, 'noise')} ELSE 0 END, 6) AS noisy FROM r""")
def noise_sparse(spark, sf):
    return rounded(simulate.add_noise(X.sup_month(spark, sf), "sparse_corruption", SEED).filter("value IS NOT NULL").select("row_id", "col_id", "noisy"), "noisy")


@query(f"WITH {SUP} SELECT row_id, col_id, CASE WHEN {u_sql(_AT, SEED, 'flip')} < 0.15 THEN -1 ELSE 1 END * CASE WHEN value >= 25 THEN 1.0 ELSE -1.0 END::DOUBLE AS noisy FROM cells WHERE value IS NOT NULL")
def noise_one_bit(spark, sf):
    x = X.sup_month(spark, sf).withColumn("noisy", simulate.one_bit_flip(F.col("value"), SEED, 25.0))
    return x.filter("value IS NOT NULL").select("row_id", "col_id", "noisy")


@query(f"WITH {SUP} SELECT row_id, col_id, CASE WHEN value IS NOT NULL THEN least(greatest(value, 20.0), 30.0) END AS noisy FROM cells")
def noise_clip(spark, sf):
    return X.sup_month(spark, sf).withColumn("noisy", simulate.clip(F.col("value"), 20.0, 30.0)).select("row_id", "col_id", "noisy")


@query(f"""WITH {_GRID}, {_LR}, n AS (SELECT greatest(2, CAST(round_even(count(*) * CAST(0.35 AS DOUBLE), 0) AS BIGINT)) AS n FROM cells), m AS (SELECT greatest(1, CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT)) AS m FROM n),
o AS (SELECT *, row_number() OVER (ORDER BY {u_sql(_AT, SEED, 'observe')}, row_id, col_id) <= (SELECT n FROM n) AS is_observed FROM cells),
e AS (SELECT *, is_observed AND row_number() OVER (ORDER BY NOT is_observed, {u_sql(_AT, SEED, 'eval')}, row_id, col_id) <= (SELECT m FROM m) AS is_eval FROM o)
SELECT row_id, col_id, round(value, 6) AS value, round(CASE WHEN is_observed AND NOT is_eval THEN value + 0.1 * {z_sql(_AT, SEED, 'noise')} END, 6) AS observed, is_eval FROM e""")
def sim_denoising(spark, sf):
    x = simulate.denoising_benchmark(_low_rank(spark, sf), "gaussian", SEED)
    return rounded(x.select("row_id", "col_id", "value", "observed", "is_eval"), "value", "observed")


# Fills.

_ALL = "(SELECT avg(value) FROM obs)"


def _filled(df: DataFrame) -> DataFrame:
    return rounded(df.select("row_id", "col_id", "pred"), "pred")


@query(f"WITH {_OBS} SELECT row_id, col_id, round(coalesce(value, {_ALL}), 6) AS pred FROM obs")
def impute_global_mean(spark, sf):
    return _filled(impute.global_mean(observed(spark, sf)))


def _line_sql(line: str) -> str:
    return f"WITH {_OBS} SELECT row_id, col_id, round(coalesce(value, avg(value) OVER (PARTITION BY {line}), {_ALL}), 6) AS pred FROM obs"


@query(_line_sql("row_id"))
def impute_row_mean(spark, sf):
    return _filled(impute.row_mean(observed(spark, sf)))


@query(_line_sql("col_id"))
def impute_col_mean(spark, sf):
    return _filled(impute.col_mean(observed(spark, sf)))


@query(f"WITH {_OBS}, m AS (SELECT col_id, value AS mode FROM (SELECT col_id, value, row_number() OVER (PARTITION BY col_id ORDER BY count(*) DESC, value) AS k FROM obs WHERE value IS NOT NULL GROUP BY 1, 2) WHERE k = 1) SELECT row_id, o.col_id, round(coalesce(o.value, m.mode, {_ALL}), 6) AS pred FROM obs o LEFT JOIN m ON m.col_id = o.col_id")
def impute_col_mode(spark, sf):
    return _filled(impute.col_mode(observed(spark, sf)))


@query(f"WITH {_OBS}, m AS (SELECT col_id, quantile_cont(value, 0.5) AS med FROM obs GROUP BY 1) SELECT row_id, o.col_id, round(coalesce(o.value, m.med, {_ALL}), 6) AS pred FROM obs o LEFT JOIN m ON m.col_id = o.col_id")
def impute_col_median(spark, sf):
    return _filled(impute.col_median(observed(spark, sf)))


@query(f"""WITH {HOUR}, {_N}, {_MCAR}, short AS (SELECT DISTINCT row_id FROM obs WHERE value IS NULL),
d AS (SELECT a.row_id AS a, b.row_id AS b, round(sqrt(sum((a.value - b.value) * (a.value - b.value)) * (SELECT count(DISTINCT col_id) FROM obs) / count(*)), 9) AS dist FROM obs a JOIN obs b ON a.col_id = b.col_id AND a.row_id <> b.row_id WHERE a.row_id IN (SELECT row_id FROM short) AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT w.row_id, w.col_id, o.value, row_number() OVER (PARTITION BY w.row_id, w.col_id ORDER BY d.dist, d.b) AS k FROM obs w JOIN d ON d.a = w.row_id JOIN obs o ON o.row_id = d.b AND o.col_id = w.col_id WHERE w.value IS NULL AND o.value IS NOT NULL),
f AS (SELECT row_id, col_id, avg(value) AS near FROM r WHERE k <= 5 GROUP BY 1, 2)
SELECT o.row_id, o.col_id, round(coalesce(o.value, f.near, avg(o.value) OVER (PARTITION BY o.col_id), {_ALL}), 6) AS pred FROM obs o LEFT JOIN f ON f.row_id = o.row_id AND f.col_id = o.col_id""")
def impute_knn(spark, sf):
    return _filled(impute.knn(observed(spark, sf, X.user_hour)))


@query(f"WITH {_OBS}, b AS (SELECT DISTINCT col_id, 24.0 AS lower, CASE WHEN col_id % 2 = 0 THEN 25.0 END AS upper FROM obs), f AS (SELECT *, coalesce(value, avg(value) OVER (PARTITION BY row_id), {_ALL}) AS pred FROM obs) SELECT row_id, f.col_id, round(CASE WHEN value IS NULL THEN greatest(least(pred, coalesce(upper, pred)), lower) ELSE pred END, 6) AS pred FROM f JOIN b ON b.col_id = f.col_id")
def impute_bounds_clamp(spark, sf):
    x = observed(spark, sf)
    bounds = x.select("col_id").distinct().select("col_id", F.lit(24.0).alias("lower"), F.when(F.col("col_id") % 2 == 0, 25.0).alias("upper"))
    return _filled(impute.clamp(impute.row_mean(x), bounds))


@query(f"""WITH {HOUR}, {_N}, {_MCAR}, {_SPLIT.replace('n AS', 'n2 AS').replace('FROM n)', 'FROM n2)')}, x AS (SELECT o.row_id, o.col_id, o.value AS keep, CASE WHEN s.split = 'train' OR o.col_id <> 0 THEN o.value END AS value, s.split FROM obs o JOIN splits s USING (row_id))
SELECT row_id, col_id, split, round(CASE WHEN col_id = 0 THEN keep ELSE coalesce(value, avg(value) OVER (PARTITION BY split, col_id), avg(value) OVER (PARTITION BY split)) END, 8) AS pred FROM x""")
def impute_row_disjoint(spark, sf):
    x = observed(spark, sf, X.user_hour)
    out = impute.row_disjoint(x, C.split_rows(x, SHARE, SEED), "col_mean", target=0)
    return rounded(out.select("row_id", "col_id", "split", "pred"), "pred", digits=8)  # means of few short decimals end in halves


@query(f"""WITH {HOUR}, {_N}, {_MCAR}, p AS (SELECT col_id, avg(value) AS m, greatest(stddev_pop(value), 1e-6) AS sd, min(value) AS lo, max(value) AS hi FROM obs GROUP BY 1)
SELECT o.row_id, o.col_id, i.i AS imputation_id, round(coalesce(o.value, greatest(least(p.m + p.sd * {z_sql('o.row_id, o.col_id', '7 + i.i', 'mi')}, p.hi), p.lo)), 6) AS pred FROM obs o JOIN p ON p.col_id = o.col_id CROSS JOIN (SELECT unnest([0, 1, 2])::INTEGER AS i) i""")
def mi_gaussian(spark, sf):
    return rounded(impute.mi_gaussian(observed(spark, sf, X.user_hour), m=3, seed=7).select("row_id", "col_id", "imputation_id", "pred"), "pred")


@query(f"WITH {SUP} SELECT col_id, CASE WHEN min((value IN (0, 1))::INT) = 1 THEN 'binary' WHEN count(DISTINCT value) <= 8 AND min((abs(value - round_even(value, 0)) <= 1e-8 + 1e-5 * abs(round_even(value, 0)))::INT) = 1 THEN 'categorical' ELSE 'continuous' END AS kind, round(avg(value), 6) AS mean, round(greatest(stddev_pop(value), 1e-6), 6) AS sd, round(min(value), 6) AS low, round(max(value), 6) AS high, count(DISTINCT value) AS n_distinct FROM cells GROUP BY 1")
def column_profiles(spark, sf):
    return rounded(impute.column_profiles(X.sup_month(spark, sf)).drop("run_id"), "mean", "sd", "low", "high")


def _solver(name: str, **params) -> Query:
    def run(spark, sf):
        x = IMPUTERS.named(name)(observed(spark, sf, X.user_hour), **params)
        return rounded(x.select("row_id", "col_id", "pred", "error"), "pred")

    return run


QUERIES["impute_svt"] = _solver("svt")
QUERIES["impute_soft"] = _solver("soft_impute")
QUERIES["impute_rpca"] = _solver("robust_pca")
QUERIES["impute_nnm"] = _solver("nuclear_norm_minimization")


@query(f"WITH {HOUR} SELECT count(*) AS n_cells, 0.0::DOUBLE AS largest_gap FROM cells")
def sql_complete(spark, sf):
    """A per-run method called from SQL, beside the imputer of that name."""
    x = observed(spark, sf, X.user_hour)
    pieces, rounds = plugins.in_pieces(x, "soft_impute", max_iters=30)
    plugins.register_table_functions(spark, rounds=rounds)
    called = spark.sql("""SELECT row_id, col_id, pred AS called FROM complete(TABLE(SELECT run_id, row_id, col_id, value FROM {x}) PARTITION BY (run_id), 'soft_impute', '{"max_iters": 30}')""".replace("{x}", _view(pieces)))
    both = IMPUTERS.named("soft_impute")(x, max_iters=30).join(called, ["row_id", "col_id"])
    return both.agg(F.count("called").alias("n_cells"), (F.round(F.max(F.abs(F.col("pred") - F.col("called"))), 9) + 0.0).alias("largest_gap"))


def _view(df: DataFrame) -> str:
    name = f"lacuna_{run_id()}"
    df.createOrReplaceTempView(name)
    return name


@query(f"WITH {HOUR} SELECT a.col_id AS i, b.col_id AS j, round(sum(a.value * b.value), 4) AS g FROM cells a JOIN cells b ON a.row_id = b.row_id AND a.col_id <= b.col_id GROUP BY 1, 2")
def gram_matrix(spark, sf):
    return rounded(lowrank.gram(X.user_hour(spark, sf)).drop("run_id"), "g", digits=4).withColumn("g", F.coalesce("g", F.lit(0.0)))


@query()
def gram_shrink(spark, sf):
    x = X.user_hour(spark, sf)
    return rounded(lowrank.gram_shrink(impute.col_mean(x).withColumn("value", F.col("pred")), 5.0, {"run_id": "r"}).drop("run_id"), "low")


# Hankel.

_H = f"{DAILY}, h AS (SELECT i.i AS row_id, t - i.i AS col_id, value FROM daily CROSS JOIN (SELECT unnest(generate_series(0, 14)) AS i) i WHERE t - i.i BETWEEN 0 AND (SELECT max(t) + 1 FROM daily) - 15)"


def _embedded(spark, sf) -> DataFrame:
    return hankel.hankelize(X.daily(spark, sf), 15)


@query(f"WITH {_H} SELECT CAST(row_id AS BIGINT) AS row_id, CAST(col_id AS BIGINT) AS col_id, value FROM h")
def hankelize(spark, sf):
    return _embedded(spark, sf).drop("series_id")


@query(f"WITH {_H} SELECT CAST(row_id + col_id AS INTEGER) AS t, round(avg(CASE WHEN (row_id * 7 + col_id) % 3 <> 0 THEN value END), 6) AS value FROM h GROUP BY 1")
def dehankelize(spark, sf):
    x = _embedded(spark, sf).withColumn("value", F.when((F.col("row_id") * 7 + F.col("col_id")) % 3 != 0, F.col("value")))
    return rounded(hankel.dehankelize(x).drop("series_id"), "value")


@query(f"WITH {_H}, x AS (SELECT row_id, col_id, CASE WHEN (row_id + col_id) % 4 <> 0 THEN value + row_id END AS value FROM h) SELECT CAST(row_id AS BIGINT) AS row_id, CAST(col_id AS BIGINT) AS col_id, round(coalesce(avg(value) OVER (PARTITION BY row_id + col_id), 0), 6) AS value FROM x")
def hankel_enforce(spark, sf):
    x = _embedded(spark, sf).withColumn("value", F.when((F.col("row_id") + F.col("col_id")) % 4 != 0, F.col("value") + F.col("row_id")))
    return rounded(hankel.enforce(x).select("row_id", "col_id", "value"), "value")


def _holes(spark, sf) -> DataFrame:
    x = hankel.hide_points(X.daily(spark, sf).withColumnRenamed("value", "clean"), "contiguous_block", 0.2, SEED)
    return cut_lineage(x.withColumn("observed", F.when(~F.col("hidden"), F.col("clean"))))


_HOLES = f"""{DAILY}, n AS (SELECT count(*) AS len, greatest(1, CAST(round_even(count(*) * CAST(0.2 AS DOUBLE), 0) AS BIGINT)) AS n FROM daily), st AS (SELECT floor({u_sql("'run'", SEED, 'start')} * greatest(1, len - n)) AS s FROM n),
holes AS (SELECT t, value AS clean, t >= s AND t < s + n AS hidden FROM daily, n, st)"""


@query(f"""WITH {_HOLES}, h AS (SELECT i.i AS r, t - i.i AS c, CASE WHEN NOT hidden THEN clean END AS value FROM holes CROSS JOIN (SELECT unnest(generate_series(0, 14)) AS i) i WHERE t - i.i BETWEEN 0 AND (SELECT max(t) + 1 FROM holes) - 15),
f AS (SELECT r, c, coalesce(value, avg(value) OVER (PARTITION BY r), (SELECT avg(value) FROM h)) AS pred FROM h), p AS (SELECT r + c AS t, avg(pred) AS pred FROM f GROUP BY 1), j AS (SELECT holes.*, p.pred FROM holes JOIN p USING (t))
SELECT round(sqrt(avg((pred - clean) * (pred - clean))), 6) AS rmse_all, round(sqrt(avg(CASE WHEN hidden THEN (pred - clean) * (pred - clean) END)), 6) AS rmse_missing, round(sqrt(avg(CASE WHEN hidden THEN (pred - clean) * (pred - clean) END)) / (max(CASE WHEN hidden THEN clean END) - min(CASE WHEN hidden THEN clean END)), 6) AS nrmse_missing, CAST(sum(hidden::INT) AS BIGINT) AS n_missing FROM j""")
def hankel_scores(spark, sf):
    x = _holes(spark, sf)
    done = x.join(hankel.reconstruct(x, 15, "row_mean"), ["series_id", "t"])
    return rounded(hankel.scores(done).drop("series_id"), "rmse_all", "rmse_missing", "nrmse_missing")


@query()
def hankel_cadzow(spark, sf):
    x = _holes(spark, sf)
    return rounded(x.join(hankel.reconstruct(x, 15, "cadzow", rank=4), ["series_id", "t"]).select("t", "clean", "pred", "hidden"), "pred")


# Scores.

_SCORED = f"WITH {_OBS}, f AS (SELECT truth, coalesce(value, avg(value) OVER (PARTITION BY row_id), {_ALL}) AS pred, is_eval FROM obs)"
_METRICS = "round(sqrt(avg((pred - truth) * (pred - truth))), 6) AS rmse, round(avg(abs(pred - truth)), 6) AS mae, round(avg(abs(pred - truth)) / (max(truth) - min(truth)), 6) AS nmae, round(sqrt(avg((pred - truth) * (pred - truth))) / (max(truth) - min(truth)), 6) AS nrmse, round(max(abs(pred - truth)), 6) AS max_abs_error, count(*) AS n_scored"
_NAMES = ["rmse", "mae", "nmae", "nrmse", "max_abs_error"]


@query(f"{_SCORED} SELECT {_METRICS} FROM f WHERE is_eval")
def score_cells(spark, sf):
    return rounded(scores.score(impute.row_mean(observed(spark, sf)), _NAMES, ["run_id"]).drop("run_id"), *_NAMES)


@query(f"""WITH {_OBS}, f AS (SELECT 'global_mean' AS method, truth, coalesce(value, {_ALL}) AS pred, is_eval FROM obs UNION ALL SELECT 'row_mean', truth, coalesce(value, avg(value) OVER (PARTITION BY row_id), {_ALL}), is_eval FROM obs UNION ALL SELECT 'col_mean', truth, coalesce(value, avg(value) OVER (PARTITION BY col_id), {_ALL}), is_eval FROM obs)
SELECT method, {_METRICS} FROM f WHERE is_eval GROUP BY method""")
def score_by_method(spark, sf):
    x = observed(spark, sf)
    parts = [f(x).select("truth", "pred", "is_eval", F.lit(n).alias("method")) for n, f in (("global_mean", impute.global_mean), ("row_mean", impute.row_mean), ("col_mean", impute.col_mean))]
    return rounded(scores.score(parts[0].unionByName(parts[1]).unionByName(parts[2]), _NAMES, ["method"]), *_NAMES)


@query(f"""WITH {HOUR}, {_N}, {_MCAR}, p AS (SELECT col_id, avg(value) AS m, greatest(stddev_pop(value), 1e-6) AS sd, min(value) AS lo, max(value) AS hi FROM obs GROUP BY 1),
x AS (SELECT i.i AS imp, o.truth, greatest(least(p.m + p.sd * {z_sql('o.row_id, o.col_id', '7 + i.i', 'mi')}, p.hi), p.lo) AS pred FROM obs o JOIN p ON p.col_id = o.col_id CROSS JOIN (SELECT unnest([0, 1, 2])::INTEGER AS i) i WHERE o.is_eval),
e AS (SELECT imp, sqrt(avg((pred - truth) * (pred - truth))) AS rmse FROM x GROUP BY 1) SELECT round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std, round(var_samp(rmse), 6) AS rmse_between FROM e""")
def mi_cell_metrics(spark, sf):
    x = impute.mi_gaussian(observed(spark, sf, X.user_hour), m=3, seed=7)
    return rounded(scores.mi_cells(x, ["rmse"], ["run_id"]).drop("run_id"), "rmse_mean", "rmse_std", "rmse_between")


@query("""WITH n AS (SELECT l_orderkey AS row_id, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS pred, count(*) AS n, sum(l_discount) AS s FROM lineitem GROUP BY 1, 2)
SELECT row_id, pred, round(score, 6) AS score FROM (SELECT row_id, pred, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, pred) AS k, sum(s) OVER (PARTITION BY row_id) / sum(n) OVER (PARTITION BY row_id) AS score FROM n) WHERE k = 1""")
def mi_pool_labels(spark, sf):
    x = X.table(spark, sf, "lineitem").select(F.lit("r").alias("run_id"), F.col("l_orderkey").alias("row_id"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("pred"), F.col("l_discount").alias("score"))
    return rounded(scores.mi_vote(x, ["run_id"]).drop("run_id"), "score")


@query(f"WITH {LABELLED} SELECT method, round(avg((label = pred)::INT), 6) AS accuracy, round(2.0 * sum((label = 1 AND pred = 1)::INT) / (2 * sum((label = 1 AND pred = 1)::INT) + sum((label <> pred)::INT)), 6) AS f1 FROM x GROUP BY 1")
def clf_accuracy_f1(spark, sf):
    return rounded(scores.accuracy_f1(X.labelled(spark, sf), ["method"]), "accuracy", "f1")


@query(f"WITH {LABELLED}, r AS (SELECT method, label, avg((label = pred)::INT) AS r FROM x GROUP BY 1, 2) SELECT method, round(avg(r), 6) AS balanced_accuracy FROM r GROUP BY 1")
def clf_balanced(spark, sf):
    return rounded(scores.balanced_accuracy(X.labelled(spark, sf), ["method"]), "balanced_accuracy")


_BY = f"{LABELLED}, g AS (SELECT method, score, sum(label) AS pos, sum(1 - label) AS neg FROM x GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pa, coalesce(sum(neg) OVER w, 0) AS na FROM g WINDOW w AS (PARTITION BY method ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(f"WITH {_BY} SELECT method, round(sum(neg * (pa + pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c GROUP BY 1")
def clf_roc_auc(spark, sf):
    return rounded(scores.roc_auc(X.labelled(spark, sf), ["method"]), "roc_auc")


@query(f"WITH {_BY} SELECT method, round(sum(pos * (pa + pos) / (pa + pos + na + neg)) / sum(pos), 6) AS average_precision FROM c GROUP BY 1")
def clf_avg_precision(spark, sf):
    return rounded(scores.average_precision(X.labelled(spark, sf), ["method"]), "average_precision")


@query("SELECT l_returnflag AS method, round(1 - sum((l_extendedprice - 1000 * l_quantity) * (l_extendedprice - 1000 * l_quantity)) / (count(*) * var_pop(l_extendedprice)), 6) AS r2 FROM lineitem GROUP BY 1")
def reg_r2(spark, sf):
    x = X.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_extendedprice").alias("truth"), (1000 * F.col("l_quantity")).alias("pred"))
    return rounded(scores.r2(x, ["method"]), "r2")


@query(f"WITH {_OBS} SELECT 'oracle' AS method, 0.0::DOUBLE AS rmse, 0.0::DOUBLE AS mae, count(*) AS n_scored FROM obs WHERE is_eval")
def oracle_scores(spark, sf):
    return scores.score(reports.oracle_rows(observed(spark, sf)), ["rmse", "mae"], ["method"])


# Models: rows only, as fits differ by solver.

DIMS = 64  # all of an embedding


def _table(spark, sf) -> DataFrame:
    x = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.when(F.col("label") == 0, 1.0).otherwise(0.0).alias("label"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(DIMS)])
    return x.withColumn("split", F.when(uniform("row_id", seed=SEED, tag="split") < 0.2, "test").otherwise("train"))


_F = [f"f{i}" for i in range(DIMS)]


def _downstream(model: str, **sizes) -> Query:
    def run(spark, sf):
        p = models.predict(_table(spark, sf), _F, model, **sizes).withColumn("model", F.lit(model))
        return models.downstream(p, ["model"])

    return run


QUERIES["downstream_linear"] = _downstream("linear")
QUERIES["downstream_forest"] = _downstream("random_forest")
QUERIES["downstream_boosted"] = _downstream("xgboost")


@query()
def feature_ranking(spark, sf):
    return models.feature_ranking(_table(spark, sf), _F, 10)


@query()
def impute_chained(spark, sf):
    """Every eighth column has holes and is fitted on all others."""
    x = _table(spark, sf).select("row_id", *[F.when(uniform("row_id", F.lit(i), seed=SEED, tag="hole") >= 0.2, F.col(c)).alias(c) if i % 8 == 0 else F.col(c) for i, c in enumerate(_F)])
    return models.chained(x, _F)


@query()
def impute_hyper(spark, sf):
    """Every thirty-second column has holes and is filled by the learner that does best on it."""
    x = _table(spark, sf).select("row_id", *[F.when(uniform("row_id", F.lit(i), seed=SEED, tag="hole") >= 0.2, F.col(c)).alias(c) if i % 32 == 0 else F.col(c) for i, c in enumerate(_F)])
    return models.searched(x, _F, rounds=2)[0]


@query()
def impute_diffusion(spark, sf):
    """Two draws of every hidden cell by boosted-tree diffusion."""
    x = observed(spark, sf, X.user_hour)
    return diffusion.diffusion_draws(x, k=2, duplicate_K=4).select("row_id", "col_id", "imputation_id", "pred")


@query("""WITH x AS (SELECT l_quantity AS f, l_extendedprice AS y, (l_orderkey % 5) = 0 AS test FROM lineitem), w AS (SELECT regr_slope(y, f) AS a, regr_intercept(y, f) AS b FROM x WHERE NOT test)
SELECT 'linear' AS model, round(1 - sum((y - a * f - b) * (y - a * f - b)) / (count(*) * var_pop(y)), 6) AS r2 FROM x, w WHERE test""")
def downstream_regression(spark, sf):
    x = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_quantity").alias("f0"), F.col("l_extendedprice").alias("label"), F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train").alias("split"))
    p = models.predict(x, ["f0"], "linear", "regression").withColumn("model", F.lit("linear"))
    return rounded(models.downstream(p, ["model"], "regression"), "r2")


_SCORE3 = "(CAST(floor(o_totalprice / 1000) AS BIGINT) + 7 * i.i) % 50"
_PRED3 = f"x AS (SELECT o_orderpriority AS method, o_orderkey AS row_id, i.i AS imp, CAST(o_custkey % 2 AS INTEGER) AS label, CASE WHEN {_SCORE3} > 25 THEN 1 ELSE 0 END AS pred, CAST({_SCORE3} AS DOUBLE) AS score FROM orders CROSS JOIN (SELECT unnest([0, 1, 2])::INTEGER AS i) i)"


def _three_predictions(spark, sf) -> DataFrame:
    """Three imputations' predictions of every order."""
    x = X.table(spark, sf, "orders").withColumn("imputation_id", F.explode(F.sequence(F.lit(0), F.lit(2))))
    score = (F.floor(F.col("o_totalprice") / 1000) + 7 * F.col("imputation_id")) % 50
    return x.select(F.col("o_orderpriority").alias("method"), F.col("o_orderkey").alias("row_id"), "imputation_id", (F.col("o_custkey") % 2).cast("int").alias("label"), F.when(score > 25, 1).otherwise(0).alias("pred"), score.cast("double").alias("score"))


_FIVE = """SELECT {k}, 'accuracy' AS metric, avg((label = pred)::INT) AS value FROM {t} GROUP BY {k}
UNION ALL SELECT {k}, 'f1', coalesce(2.0 * sum((label = 1 AND pred = 1)::INT) / (2 * sum((label = 1 AND pred = 1)::INT) + sum((label <> pred)::INT)), 0) FROM {t} GROUP BY {k}
UNION ALL SELECT {k}, 'balanced_accuracy', avg(r) FROM (SELECT {k}, label, avg((label = pred)::INT) AS r FROM {t} GROUP BY {k}, label) GROUP BY {k}
UNION ALL SELECT {k}, 'roc_auc', sum(neg * (pa + pos / 2)) / (sum(pos) * sum(neg)) FROM {t}_c GROUP BY {k} HAVING sum(pos) * sum(neg) > 0
UNION ALL SELECT {k}, 'average_precision', sum(pos * (pa + pos) / (pa + pos + na + neg)) / sum(pos) FROM {t}_c GROUP BY {k} HAVING sum(pos) * sum(neg) > 0"""
_CUM = "{t}_c AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pa, coalesce(sum(neg) OVER w, 0) AS na FROM (SELECT {k}, score, sum(label) AS pos, sum(1 - label) AS neg FROM {t} GROUP BY {k}, score) WINDOW w AS (PARTITION BY {k} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(f"""WITH {_PRED3}, p AS (SELECT method, row_id, any_value(label) AS label, (sum(pred) >= 2)::INT AS pred, sum(score) / 3 AS score FROM x GROUP BY 1, 2),
{_CUM.format(t='x', k='method, imp')}, {_CUM.format(t='p', k='method')}, e AS ({_FIVE.format(t='x', k='method, imp')}), o AS ({_FIVE.format(t='p', k='method')})
SELECT e.method, e.metric, round(avg(e.value), 6) AS mi_mean, round(stddev_pop(e.value), 6) AS mi_std, round(any_value(o.value), 6) AS mi_pooled FROM e LEFT JOIN o ON o.method = e.method AND o.metric = e.metric GROUP BY 1, 2""")
def mi_downstream(spark, sf):
    return rounded(models.mi_downstream(_three_predictions(spark, sf), ["method"]), "mi_mean", "mi_std", "mi_pooled")


@query("""WITH x AS (SELECT o_orderpriority AS method, o_orderkey AS row_id, i.i AS imp, o_totalprice AS label, o_totalprice * (1 + 0.1 * i.i) + o_custkey AS pred FROM orders CROSS JOIN (SELECT unnest([0, 1, 2])::INTEGER AS i) i),
e AS (SELECT method, imp, 1 - sum((label - pred) * (label - pred)) / (count(*) * var_pop(label)) AS r2 FROM x GROUP BY 1, 2), p AS (SELECT method, row_id, any_value(label) AS label, avg(pred) AS pred FROM x GROUP BY 1, 2)
SELECT e.method, 'r2' AS metric, round(avg(e.r2), 6) AS mi_mean, round(stddev_pop(e.r2), 6) AS mi_std, round(any_value(o.r2), 6) AS mi_pooled FROM e JOIN (SELECT method, 1 - sum((label - pred) * (label - pred)) / (count(*) * var_pop(label)) AS r2 FROM p GROUP BY 1) o ON o.method = e.method GROUP BY 1""")
def mi_downstream_r2(spark, sf):
    x = X.table(spark, sf, "orders").withColumn("imputation_id", F.explode(F.sequence(F.lit(0), F.lit(2))))
    pred = F.col("o_totalprice") * (1 + F.lit(0.1) * F.col("imputation_id")) + F.col("o_custkey")
    x = x.select(F.col("o_orderpriority").alias("method"), F.col("o_orderkey").alias("row_id"), "imputation_id", F.col("o_totalprice").alias("label"), pred.alias("pred"), pred.alias("score"))
    return rounded(models.mi_downstream(x, ["method"], "regression"), "mi_mean", "mi_std", "mi_pooled")


# Encoding: part names and event properties as text.


@query("SELECT p_partkey, CASE WHEN lower(trim(v)) IN ('', 'na', 'n/a', 'null', 'none', '?', 'nan') THEN NULL ELSE trim(v) END AS cleaned FROM (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN ' NA ' WHEN 1 THEN 'n/a' WHEN 2 THEN '?' WHEN 3 THEN '  ' WHEN 4 THEN 'NaN' ELSE p_type END AS v FROM part)")
def clean_tokens(spark, sf):
    return _dirty(spark, sf).select("p_partkey", encode.clean(F.col("v")).alias("cleaned"))


def _dirty(spark, sf) -> DataFrame:
    k = F.col("p_partkey") % 9
    v = F.when(k == 0, " NA ").when(k == 1, "n/a").when(k == 2, "?").when(k == 3, "  ").when(k == 4, "NaN").otherwise(F.col("p_type"))
    return X.table(spark, sf, "part").withColumn("v", v)


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 20 = 0 THEN 'abc' WHEN p_partkey % 7 = 0 THEN 'na' ELSE CAST(p_size AS VARCHAR) END AS a, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS b FROM part)
SELECT 'a' AS name, count(try_cast(a AS DOUBLE)) / count(CASE WHEN a <> 'na' THEN a END) >= 0.9 AS is_number FROM t UNION ALL SELECT 'b', count(try_cast(b AS DOUBLE)) / count(b) >= 0.9 FROM t""")
def infer_numeric(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    t = X.table(spark, sf, "part").select(F.when(k % 20 == 0, "abc").when(k % 7 == 0, "na").otherwise(size).alias("a"), F.when(k % 5 == 0, "x").otherwise(size).alias("b"))
    return spark.createDataFrame(sorted(encode.numeric_columns(t, ["a", "b"]).items()), "name string, is_number boolean")


@query("SELECT l_returnflag_A, l_returnflag_N, l_returnflag_R, count(*) AS n FROM (SELECT (l_returnflag = 'A')::INT::DOUBLE AS l_returnflag_A, (l_returnflag = 'N')::INT::DOUBLE AS l_returnflag_N, (l_returnflag = 'R')::INT::DOUBLE AS l_returnflag_R FROM lineitem) GROUP BY 1, 2, 3")
def one_hot(spark, sf):
    x = encode.one_hot(X.table(spark, sf, "lineitem").select("l_returnflag"), "l_returnflag")
    return x.groupBy("l_returnflag_A", "l_returnflag_N", "l_returnflag_R").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT p_type AS v FROM part)) SELECT p_partkey, code AS p_type_code FROM part JOIN c ON c.v = p_type")
def ordinal_codes(spark, sf):
    return encode.ordinal_codes(X.table(spark, sf, "part"), "p_type").select("p_partkey", "p_type_code")


# Reports.


@query(f"WITH {RUNS} SELECT preset_id, algorithm, count(*) AS num_runs, round(avg(rmse), 6) AS rmse, round(stddev_pop(rmse), 6) AS rmse_std, round(avg(nrmse), 6) AS nrmse, round(stddev_pop(nrmse), 6) AS nrmse_std FROM runs WHERE status = 'ok' GROUP BY 1, 2")
def leaderboard(spark, sf):
    return rounded(reports.leaderboard(X.runs(spark, sf), ["preset_id", "algorithm"], ["rmse", "nrmse"]), "rmse", "rmse_std", "nrmse", "nrmse_std")


_LONG = f"{RUNS}, long AS (SELECT preset_id, algorithm, 'rmse' AS metric, rmse AS value FROM runs UNION ALL SELECT preset_id, algorithm, 'nrmse', nrmse FROM runs)"


@query(f"WITH {_LONG} SELECT preset_id, algorithm, metric, count(*) AS n, round(sum(value), 3) AS total FROM long GROUP BY 1, 2, 3")
def metrics_long(spark, sf):
    x = reports.long_metrics(X.runs(spark, sf), ["preset_id", "algorithm"], ["rmse", "nrmse"])
    return rounded(x.groupBy("preset_id", "algorithm", "metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", digits=3)


@query(f"WITH {_LONG} SELECT preset_id, algorithm, metric, round(avg(value), 6) AS mean, round(1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS ci95, count(*) AS n FROM long GROUP BY 1, 2, 3")
def seed_ci95(spark, sf):
    x = reports.long_metrics(X.runs(spark, sf), ["preset_id", "algorithm"], ["rmse", "nrmse"])
    return rounded(reports.mean_ci95(x, ["preset_id", "algorithm"]), "mean", "ci95")


@query(f"WITH {RUNS} SELECT algorithm AS series, noise_sigma AS x, round(avg(rmse), 6) AS mean, round(stddev_samp(rmse), 6) AS sd, round(1.96 * stddev_samp(rmse) / sqrt(count(*)), 6) AS ci95, count(*) AS points, count(DISTINCT seed) AS seeds FROM runs GROUP BY 1, 2")
def series_mean_sd(spark, sf):
    return rounded(reports.series(X.runs(spark, sf), "noise_sigma", "rmse"), "mean", "sd", "ci95")


@query(f"WITH {RUNS} SELECT sum((status <> 'ok')::INT)::BIGINT AS failed FROM runs")
def failure_count(spark, sf):
    return reports.failures(X.runs(spark, sf))


@query(f"""WITH {_OBS}, f AS (SELECT 'row_mean' AS method, col_id, coalesce(value, avg(value) OVER (PARTITION BY row_id)) AS pred FROM obs UNION ALL SELECT 'none', col_id, value FROM obs),
b AS (SELECT DISTINCT col_id, 'c' || (col_id % 3) AS "column", 20.0 AS lower, CASE WHEN col_id % 3 = 1 THEN 30.0 END AS upper FROM obs WHERE col_id % 3 < 2), x AS (SELECT method, "column", (pred IS NULL)::INT AS nan, coalesce((pred < lower)::INT, 0) + coalesce((pred > upper)::INT, 0) AS oob FROM f JOIN b USING (col_id)),
g AS (SELECT method, "column", count(*) AS checked_count, sum(nan)::BIGINT AS nan_count, sum(oob)::BIGINT AS out_of_bounds_count FROM x GROUP BY GROUPING SETS ((method), (method, "column")))
SELECT *, round(nan_count / checked_count, 6) AS nan_rate, round(out_of_bounds_count / checked_count, 6) AS out_of_bounds_rate, round(out_of_bounds_count / (checked_count - nan_count), 6) AS valid_out_of_bounds_rate FROM g""")
def constraint_violations(spark, sf):
    x = observed(spark, sf)
    f = impute.row_mean(x).select(F.lit("row_mean").alias("method"), "col_id", "pred").unionByName(x.select(F.lit("none").alias("method"), "col_id", F.col("value").alias("pred")))
    columns = x.select("col_id").distinct().withColumn("column", F.concat(F.lit("c"), (F.col("col_id") % 3).cast("string")))
    bounds = spark.createDataFrame([("c0", 20.0, None), ("c1", 20.0, 30.0)], "column string, lower double, upper double")
    return rounded(reports.violations(f, bounds, columns), "nan_rate", "out_of_bounds_rate", "valid_out_of_bounds_rate")
