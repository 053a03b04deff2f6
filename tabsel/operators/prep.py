"""Relational preparation of tables: roll-ups to a parent's grain, fills, lags, rolling means, calendars, keys, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def roll_up(child: DataFrame, key: str, columns: list[str], prefix: str) -> DataFrame:
    """One row a key: mean, max, min, sum of each column and the number of rows, names prefixed."""
    stats = [f(c).alias(f"{prefix}_{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min), ("sum", F.sum))]
    return child.groupBy(key).agg(*stats, F.count("*").alias(f"{prefix}_count"))


def attach(parent: DataFrame, key: str, rolled: DataFrame, child_key: str) -> DataFrame:
    return parent.join(rolled.withColumnRenamed(child_key, key), key, "left")


def series(key: str, order: list[str]):
    return Window.partitionBy(key).orderBy(*order)


def forward_fill(df: DataFrame, key: str, order: list[str], column: str, name: str) -> DataFrame:
    """The last known value of the series, else its next one."""
    w = series(key, order)
    back = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn(name, F.coalesce(F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(column, ignorenulls=True).over(back)))


def lags(df: DataFrame, key: str, order: list[str], column: str, steps: list[int]) -> DataFrame:
    w = series(key, order)
    return df.withColumns({f"{column}_lag{k}": F.lag(column, k).over(w) for k in steps})


def rolling_mean(df: DataFrame, key: str, order: list[str], column: str, size: int, name: str) -> DataFrame:
    """The mean of the `size` rows before a row, null until there are so many."""
    w = series(key, order).rowsBetween(-size, -1)
    return df.withColumn(name, F.when(F.count(column).over(w) == size, F.avg(column).over(w)))


def calendar(c: Column, since: str) -> dict[str, Column]:
    """Weekday (Monday 0), month, payday (15th and last of the month), days since a date."""
    d = F.to_date(c)
    payday = (F.dayofmonth(d) == 15) | (d == F.last_day(d))
    return {"weekday": F.weekday(d), "month": F.month(d), "is_payday": payday.cast("int"), "days_since": F.datediff(d, F.lit(since).cast("date"))}


def row_mean(*columns: Column) -> Column:
    """The mean of the values that aren't null."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    known = sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))
    return F.try_divide(total, known)


def entity_key(*parts: Column) -> Column:
    return F.concat_ws("_", *(F.coalesce(p.cast("string"), F.lit("nan")) for p in parts))
