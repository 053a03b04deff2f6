"""Row keys, deterministic uniforms, missing values, category keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(key: Column, salt: str | int) -> Column:
    """md5 of salt:key; orders rows alike on any partitioning, and in SQL."""
    return F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))


def uniform(key: Column, salt: str | int) -> Column:
    """A number in [0, 1) that depends on the key and the salt alone."""
    return F.conv(F.substring(digest(key, salt), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null are both missing; afterwards only null is."""
    floats = {f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)) for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(floats) if floats else df


def with_rid(df: DataFrame, keys: list[str] | None = None, name: str = "__rid") -> DataFrame:
    """A stable row key: the given key columns, or the hash of all columns and a number among equal rows."""
    if keys:
        return df.withColumn(name, F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys)) if len(keys) > 1 else F.col(keys[0]).cast("string"))
    h = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns)))
    alike = Window.partitionBy("__h").orderBy(*(F.col(f"`{c}`").cast("string") for c in sorted(df.columns)))
    return df.withColumn("__h", h).withColumn(name, F.concat_ws("#", F.col("__h").cast("string"), F.row_number().over(alike).cast("string"))).drop("__h")


def category_key(c: Column, integer: bool = False) -> Column:
    """The key of a value. A column that was integer when it was learned may come as floats: 1.0 is 1, 1.5 is itself."""
    if not integer:
        return c.cast("string")
    whole = c.try_cast("bigint")
    return F.when(whole.cast("double") == c.try_cast("double"), whole.cast("string")).otherwise(c.cast("string"))


def encode(key: Column, keys: tuple[str, ...]) -> Column:
    """Codes 0..n-1 by the position of the key, n for null, n+1 for unseen. The table is on the driver, so it is small."""
    n = len(keys)
    if not n:
        return F.when(key.isNull(), F.lit(0)).otherwise(F.lit(1)).cast("int")
    table = F.create_map(*(F.lit(x) for i, k in enumerate(keys) for x in (k, i)))
    return F.when(key.isNull(), F.lit(n)).otherwise(F.coalesce(F.try_element_at(table, key), F.lit(n + 1))).cast("int")
