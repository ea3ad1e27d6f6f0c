"""Mixed tables to numbers: missing tokens, numeric inference, ordinal codes and one-hot columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.cells import ranked

#: Strings that stand for a missing value, in lower case.
MISSING = ("", "na", "n/a", "null", "none", "?", "nan")
#: Columns that would give a target away.
LEAKS = {"EventCKD35": ("TimeToEventMonths", "TIME_YEAR"), "TimeToEventMonths": ("EventCKD35", "TIME_YEAR")}
NUMERIC_SHARE = 0.9


def clean(value: Column) -> Column:
    return F.when(~F.lower(F.trim(value)).isin(*MISSING), F.trim(value))


def number(value: Column) -> Column:
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def numeric_columns(table: DataFrame, columns: list[str], finite_only: bool = True) -> dict[str, bool]:
    """Whether at least nine in ten of a column's values read as numbers; one pass over the table."""
    read = (lambda c: number(clean(F.col(c)))) if finite_only else (lambda c: clean(F.col(c)).try_cast("double"))
    row = table.agg(*[F.try_divide(F.count(read(c)), F.count(clean(F.col(c)))).alias(c) for c in columns]).first()
    return {c: row[c] is not None and row[c] >= NUMERIC_SHARE for c in columns}


def ordinal_codes(table: DataFrame, column: str) -> DataFrame:
    """`<column>_code`: the rank of the value among the sorted distinct ones, from 0."""
    x = table.withColumn("__v", clean(F.col(column)))
    codes = ranked(x.filter("__v IS NOT NULL").select("__v").distinct(), "__v", f"{column}_code", ()).withColumn(f"{column}_code", F.col(f"{column}_code").cast("double"))
    return x.join(codes, "__v", "left").drop("__v")


def one_hot(table: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """A 0/1 column `<column>_<value>` for each value; without values one null column `<column>__missing`."""
    values = [r[0] for r in table.select(clean(F.col(column)).alias("v")).filter("v IS NOT NULL").distinct().orderBy("v").limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    if not values:
        return table.withColumn(f"{column}__missing", F.lit(None).cast("double")).drop(column)
    return table.select("*", *[F.when(clean(F.col(column)) == v, 1.0).otherwise(0.0).alias(f"{column}_{v}") for v in values]).drop(column)


def encode(table: DataFrame, keep: list[str], target: str | None = None, exclude: tuple[str, ...] = (), hot: bool = True) -> DataFrame:
    """Numbers in every column but `keep`: excluded and leaking columns dropped, the target last and never null."""
    drop = {*exclude, *LEAKS.get(target or "", ())} - {target}
    columns = [c for c in table.columns if c not in keep and c not in drop]
    is_number = numeric_columns(table.select(*[F.col(c).cast("string").alias(c) for c in columns]), columns, finite_only=hot)
    out = table.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns])
    for c in columns:
        if is_number[c] or c == target:
            out = out.withColumn(c, number(clean(F.col(c))))
        elif hot:
            out = one_hot(out, c)
        else:
            out = ordinal_codes(out, c).drop(c).withColumnRenamed(f"{c}_code", c)
    if target:
        out = out.filter(F.col(target).isNotNull()).select(*[c for c in out.columns if c != target], target)
    return out


def complete_cases(table: DataFrame, least: int = 10) -> DataFrame:
    """Rows without nulls; fewer than `least` are an error."""
    rows = table.dropna(how="any")
    if rows.limit(least).count() < least:
        raise ValueError(f"fewer than {least} complete rows")
    return rows


def to_cells(table: DataFrame, row: str, columns: list[str], run_id: str = "r") -> DataFrame:
    """Cells of a wide table; column ids are positions."""
    pairs = F.array(*[F.struct(F.lit(i).cast("long").alias("col_id"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    return table.select(F.lit(run_id).alias("run_id"), F.col(row).cast("long").alias("row_id"), F.explode(pairs).alias("x")).select("run_id", "row_id", "x.*")
