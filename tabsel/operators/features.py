"""Learning and applying features: categories, date deltas, crosses, frequencies, target encodings."""

from __future__ import annotations

import logging
from dataclasses import replace
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import FeatureSchema, Role
from ..errors import SchemaError
from ..functions.expressions import category_key, encode

NA, JOIN = "__NA__", "__"
REPORT_NAMES = ("report_dt", "report_date", "feature_dt")
#: Tables of at most so many keys become map literals; larger ones a broadcast join (a table is read to the driver either way).
LITERAL_KEYS = 500
log = logging.getLogger("tabsel")


def is_integer(schema: FeatureSchema, c: str) -> bool:
    return schema.dtypes.get(c) in ("tinyint", "smallint", "int", "bigint")


def key_of(schema: FeatureSchema, c: str) -> Column:
    return category_key(F.col(f"`{c}`"), is_integer(schema, c))


def category_tables(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(column_name, key, code): distinct non-null keys of all columns in one aggregate, numbered in binary string order."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), k.alias("key")) for c, k in keys.items())))).where("key is not null").distinct()
    return long.withColumn("code", F.row_number().over(Window.partitionBy("column_name").orderBy("key")) - 1)


def fit_categories(df: DataFrame, schema: FeatureSchema) -> FeatureSchema:
    keys = {c: key_of(schema, c) for c in schema.of(Role.CATEGORICAL)} | {f"{a}{JOIN}{b}": cross(schema, a, b) for a, b in schema.crosses}
    if not keys:
        return schema
    out: dict[str, list[str]] = {c: [] for c in keys}
    for r in category_tables(df, keys).orderBy("column_name", "code").collect():
        out[r["column_name"]].append(r["key"])
    return replace(schema, categories={c: tuple(v) for c, v in out.items()})


def cross(schema: FeatureSchema, a: str, b: str) -> Column:
    return F.concat_ws(JOIN, F.coalesce(key_of(schema, a), F.lit(NA)), F.coalesce(key_of(schema, b), F.lit(NA)))


def fit_crosses(df: DataFrame, schema: FeatureSchema, max_pairs: int = 50) -> FeatureSchema:
    """All pairs of categoricals in name order, max_pairs at most. Values that contain the joint are warned of."""
    pairs = list(combinations(sorted(schema.of(Role.CATEGORICAL)), 2))[:max_pairs]
    if clash := sorted({f"{a}{JOIN}{b}" for a, b in pairs} & set(df.columns)):
        raise SchemaError(f"crosses would overwrite {clash}")
    sources = sorted({c for p in pairs for c in p})
    if sources:
        found = df.agg(*(F.max(key_of(schema, c).contains(JOIN)).alias(c) for c in sources)).first()
        for c in sources:
            if found[c]:
                log.warning("values of %s contain %r: crosses may coincide", c, JOIN)
    return replace(schema, crosses=tuple(pairs))


def report_column(df: DataFrame, override: str | None = None) -> str | None:
    """The named column, or the only one with a usual name."""
    if override:
        if override not in df.columns:
            raise SchemaError(f"there is no column {override!r}")
        return override
    found = [c for c in df.columns if c in REPORT_NAMES]
    return found[0] if len(found) == 1 else None


def delta_days(report: Column, c: Column) -> Column:
    return F.datediff(F.to_date(report), F.to_date(c)).cast("double")


def fit_deltas(df: DataFrame, schema: FeatureSchema, override: str | None = None) -> FeatureSchema:
    report = report_column(df, override)
    return replace(schema, deltas={c: report for c in schema.of(Role.DATETIME) if c != report}) if report else schema


def code_stats(df: DataFrame, codes: dict[str, Column], target: Column | None = None) -> DataFrame:
    """(column_name, code, n, s): counts and target sums by code of all columns, one aggregate over stacked columns."""
    stacked = F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), k.alias("code")) for c, k in codes.items())))
    rows = df.select((target if target is not None else F.lit(0.0)).alias("y"), stacked)
    return rows.groupBy("column_name", "code").agg(F.count("*").alias("n"), F.sum("y").alias("s"))


def fit_frequency(df: DataFrame, schema: FeatureSchema) -> FeatureSchema:
    """Shares of the rows by code; nulls are a code of their own."""
    codes = {c: encode(key_of(schema, c), schema.categories[c]) for c in schema.of(Role.CATEGORICAL)}
    if not codes:
        return schema
    out: dict[str, dict[int, float]] = {c: {} for c in codes}
    stats = code_stats(df, codes)
    for r in stats.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("column_name"))).collect():
        out[r["column_name"]][r["code"]] = r["share"]
    return replace(schema, frequency=out)


def fit_target(df: DataFrame, schema: FeatureSchema, target: Column, smoothing: float = 10.0) -> FeatureSchema:
    """(sum y + k g) / (n + k) by code; nulls and unseen keys get the base rate g. target is 0 or 1."""
    codes = {c: encode(key_of(schema, c), schema.categories[c]) for c in schema.of(Role.CATEGORICAL)}
    if not codes:
        return schema
    g = df.agg(F.avg(target)).first()[0]
    out = {c: {"global": g, "values": {}} for c in codes}
    for r in code_stats(df, codes, target).collect():
        if r["code"] < len(schema.categories[r["column_name"]]) and r["n"] + smoothing > 0:
            out[r["column_name"]]["values"][r["code"]] = (r["s"] + smoothing * g) / (r["n"] + smoothing)
    return replace(schema, target=out)


def group_like(df: DataFrame, codes: dict[str, Column]) -> list[str]:
    """Columns whose target encoding may carry groups: over half as many values as rows, over a fifth of the rows repeated."""
    s = code_stats(df, codes).groupBy("column_name").agg(F.count("*").alias("d"), F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("dup"))
    return sorted(r["column_name"] for r in s.where("d / n > 0.5 and dup / n > 0.2").collect())


def lookup(df: DataFrame, code: str, values: dict[int, float], out: str, default: float) -> DataFrame:
    """df with a column more: the value of the code, or the default."""
    if len(values) <= LITERAL_KEYS:
        table = F.create_map(*(F.lit(x) for k, v in sorted(values.items()) for x in (int(k), float(v)))) if values else F.create_map().cast("map<int,double>")
        return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(code)), F.lit(float(default))))
    table = df.sparkSession.createDataFrame(list(values.items()), f"`{code}` int, `{out}` double")
    return df.join(table, code, "left").withColumn(out, F.coalesce(out, F.lit(float(default))))


def apply(df: DataFrame, schema: FeatureSchema) -> DataFrame:
    """df with all columns of schema.features; categoricals hold codes. Works on streams as well."""
    report = set(schema.deltas.values())
    needed = [*schema.of(Role.NUMERIC), *schema.of(Role.CATEGORICAL), *schema.deltas, *report, *(c for p in schema.crosses for c in p)]
    if missing := sorted(set(needed) - set(df.columns)):
        raise SchemaError(f"columns {missing} are missing")
    new = {f"{c}__days_to_report": delta_days(F.col(f"`{r}`"), F.col(f"`{c}`")) for c, r in schema.deltas.items()}
    new |= {f"{a}{JOIN}{b}": encode(cross(schema, a, b), schema.categories[f"{a}{JOIN}{b}"]) for a, b in schema.crosses}
    new |= {c: encode(key_of(schema, c), schema.categories[c]) for c in schema.of(Role.CATEGORICAL)}
    new |= {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in schema.of(Role.NUMERIC)}
    out = df.withColumns(new)
    for c, values in schema.frequency.items():
        out = lookup(out, c, values, f"{c}_freq", 0.0)
    for c, spec in schema.target.items():
        out = lookup(out, c, spec["values"], f"{c}_te", spec["global"])
    return out


def crossfit(df: DataFrame, code: str, target: str, fold: str, smoothing: float, out: str, reserved: int | None = None, expanding: bool = False) -> DataFrame:
    """df with the out-of-fold target encoding of `code`.

    A row of fold f is encoded by the rows of all other folds (expanding: of all earlier ones), with their base rate as
    prior; fold -1 by itself, and with expanding the earliest fold gets its own base rate. Sums by (code, fold) are
    made once; a fold's share is taken off the total, or summed up to it, so no fold reads the rows again. Codes from
    `reserved` on stand for nulls and unseen keys: they get the base rate.
    """
    cell = df.groupBy(code, fold).agg(F.count("*").alias("n"), F.sum(F.col(target).cast("double")).alias("s"))
    by_fold = cell.groupBy(fold).agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    if expanding:
        before = Window.orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)  # over the folds, a handful of rows
        base = by_fold.select(F.col(fold), F.sum("fn").over(before).alias("gn"), F.sum("fs").over(before).alias("gs"), "fn", "fs")
        grid = cell.select(code).distinct().join(by_fold.select(fold), how="cross").join(cell, [code, fold], "left")
        own = Window.partitionBy(code).orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
        fit = grid.select(code, fold, F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(own), F.lit(0)).alias("n"), F.coalesce(F.sum(F.coalesce("s", F.lit(0.0))).over(own), F.lit(0.0)).alias("s"))
        fit = fit.join(F.broadcast(base), fold).withColumn("g", F.coalesce(F.try_divide("gs", "gn"), F.try_divide("fs", "fn")))
    else:
        everything = Window.partitionBy(code)
        total = Window.partitionBy()  # over the folds, a handful of rows
        base = by_fold.select(F.col(fold), (F.sum("fn").over(total) - F.col("fn")).alias("on"), (F.sum("fs").over(total) - F.col("fs")).alias("os"), "fn", "fs")
        inside = F.col(fold) == -1
        fit = cell.select(code, fold, F.when(inside, F.col("n")).otherwise(F.sum("n").over(everything) - F.col("n")).alias("n"), F.when(inside, F.col("s")).otherwise(F.sum("s").over(everything) - F.col("s")).alias("s"))
        fit = fit.join(F.broadcast(base), fold).withColumn("g", F.when(inside, F.try_divide("fs", "fn")).otherwise(F.try_divide("os", "on")))
    blank = (F.col("n") == 0) if reserved is None else (F.col("n") == 0) | (F.col(code) >= reserved)
    fit = fit.select(code, fold, F.when(blank, F.col("g")).otherwise((F.col("s") + F.lit(float(smoothing)) * F.col("g")) / (F.col("n") + F.lit(float(smoothing)))).alias(out))
    return df.join(fit, [code, fold], "left")
