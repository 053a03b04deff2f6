"""Profiling, role inference and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import FeatureSchema, Role, Task
from ..errors import SchemaError
from ..functions.expressions import category_key

INTEGERS = ("byte", "short", "integer", "long")
#: A target with more classes is refused.
MAX_LABELS = 10_000
FLOATS = ("float", "double", "decimal")
DATES = ("date", "timestamp_ntz", "timestamp")


def distinct_counts(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row (n, m): the number of rows, and by place of a column its non-null and its distinct values (v, d).

    Columns of one type are stacked as (place, value), so that a row to shuffle has one value and not all columns.
    """
    families: dict[str, list[Column]] = {}
    types = df.select(*(v.alias(f"c{i}") for i, v in enumerate(values.values()))).schema
    for i, v in enumerate(values.values()):
        kind = types[i].dataType.typeName()
        kind = "long" if kind in INTEGERS else "string" if kind in ("void", "char", "varchar") else types[i].dataType.simpleString()
        families.setdefault(kind, []).append(F.struct(F.lit(i).alias("i"), v.cast(kind).alias("x")))
    found = None
    for pieces in families.values():
        cells = df.select(F.inline(F.array(*pieces))).where("x is not null").groupBy("i", "x").agg(F.count("*").alias("c"))
        part = cells.groupBy("i").agg(F.sum("c").alias("v"), F.count("*").alias("d"))
        found = part if found is None else found.unionByName(part)
    return df.agg(F.count("*").alias("n")).crossJoin(found.agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("v", "d")))).alias("m")))


def profile(df: DataFrame, task: Task, columns: list[str] | None = None) -> DataFrame:
    """Rows (column_name, n, n_null, n_distinct, role, reason): an aggregate for each type of column, the rules as expressions.

    Missing is null or NaN. Rules, in this order: no signal (not for dates), dates, strings, numbers, else categorical.
    """
    columns = columns or df.columns
    kinds = {c: df.schema[c].dataType.typeName() for c in columns}
    if odd := [c for c, k in kinds.items() if k in ("array", "map", "struct", "binary")]:
        raise SchemaError(f"columns {odd} have a nested or binary type")
    if ambiguous := [c for c, k in kinds.items() if k == "timestamp"]:
        raise SchemaError(f"columns {ambiguous} have a time zone; cast them to timestamp_ntz")
    present = {c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(df.schema[c].dataType)) if kinds[c] in ("float", "double") else F.col(f"`{c}`") for c in columns}
    stats = distinct_counts(df, present)
    long = stats.select("n", F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("kind"), F.coalesce(F.col("m")[i]["v"], F.lit(0)).cast("long").alias("v"), F.coalesce(F.col("m")[i]["d"], F.lit(0)).cast("long").alias("n_distinct")) for i, c in enumerate(columns)))))
    rate, d, kind = F.col("n_distinct") / F.col("n"), F.col("n_distinct"), F.col("kind")
    is_date = kind.isin(*DATES)
    rules = [
        (~is_date & (F.col("v") == 0), Role.IGNORE, "all_null"),
        (~is_date & (F.col("v") == F.col("n")) & (d <= 1), Role.IGNORE, "constant"),
        (is_date, Role.DATETIME, None),
        (kind.isin("string", "varchar", "char") & (d <= task.str_id_min_unique), Role.CATEGORICAL, None),
        (kind.isin("string", "varchar", "char") & (rate > task.str_id_rate), Role.IGNORE, "string_id_like"),
        (kind.isin("string", "varchar", "char"), Role.CATEGORICAL, "high_cardinality_string"),
        (kind.isin(*FLOATS), Role.NUMERIC, None),
        (kind.isin(*INTEGERS) & (rate > task.id_rate) & (d > task.id_min_unique), Role.IGNORE, "numeric_id_like"),
        (kind.isin(*INTEGERS) & (d <= task.cat_max_unique), Role.CATEGORICAL, "low_cardinality_int"),
        (kind.isin(*INTEGERS), Role.NUMERIC, None),
    ]
    role, reason = F.lit(str(Role.CATEGORICAL)), F.lit(None).cast("string")
    for when, r, why in reversed(rules):
        role = F.when(when, F.lit(str(r))).otherwise(role)
        reason = F.when(when, F.lit(why).cast("string")).otherwise(reason)
    return long.select("column_name", "n", (F.col("n") - F.col("v")).alias("n_null"), "n_distinct", role.alias("role"), reason.alias("reason"))


def validate_frame(df: DataFrame) -> None:
    names = [c.lower() for c in df.columns]
    if not names:
        raise SchemaError("the table has no columns")
    if twice := sorted({c for c in names if names.count(c) > 1}):
        raise SchemaError(f"columns {twice} occur more than once")
    if df.isEmpty():
        raise SchemaError("the table has no rows")


def validate_target(df: DataFrame, target: str, task: Task) -> list:
    """The labels in order (none for regression)."""
    if target not in df.columns:
        raise SchemaError(f"there is no column {target!r}")
    kind = df.schema[target].dataType.typeName()
    if task.kind == "regression":
        if kind not in (*INTEGERS, *FLOATS):
            raise SchemaError(f"target {target} of a regression is {kind}")
        if not df.agg(F.count(target)).first()[0]:
            raise SchemaError(f"target {target} has nulls only")
        return []
    labels = sorted(r[0] for r in df.where(F.col(target).isNotNull()).select(target).distinct().limit(MAX_LABELS + 1).collect())
    if not labels:
        raise SchemaError(f"target {target} has nulls only")
    if len(labels) > MAX_LABELS:
        raise SchemaError(f"target {target} has more than {MAX_LABELS} classes")
    if task.kind == "binary" and len(labels) > 2:
        raise SchemaError(f"target {target} has {len(labels)} classes, two are allowed")
    if len(labels) < 2:
        raise SchemaError(f"target {target} has one class")
    return labels


def validate_axis(df: DataFrame, group: str | None = None, time: str | None = None, label_time: str | None = None) -> None:
    """Groups and times without nulls, times that sort; label_time needs a time of its own kind."""
    if label_time and not time:
        raise SchemaError("label_time needs time")
    for c in (time, label_time):
        if c and df.schema[c].dataType.typeName() not in (*INTEGERS, "float", "double", "date", "timestamp_ntz"):
            raise SchemaError(f"{c} is {df.schema[c].dataType.typeName()}: times are numbers, dates or timestamps without zone")
    if label_time and (df.schema[time].dataType.typeName() in DATES) != (df.schema[label_time].dataType.typeName() in DATES):
        raise SchemaError("time and label_time are of different kinds")
    checked = [c for c in (group, time) if c]
    if checked:
        nulls = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in checked)).first()
        if bad := [c for c in checked if nulls[c]]:
            raise SchemaError(f"columns {bad} have nulls")


def validate_against(df: DataFrame, needed: list[str]) -> None:
    if missing := sorted(set(needed) - set(df.columns)):
        raise SchemaError(f"columns {missing} are missing")


def unseen_share(df: DataFrame, schema: FeatureSchema, by: list[str] | None = None) -> DataFrame:
    """(by..., column_name, unseen_share): the share of non-null values that the schema's tables don't have, one aggregate."""
    cols = [c for c in schema.of(Role.CATEGORICAL) if c in df.columns]
    key = lambda c: category_key(F.col(f"`{c}`"), schema.dtypes.get(c) in ("tinyint", "smallint", "int", "bigint"))
    agg = df.groupBy(*(by or [])).agg(*(F.avg(F.when(key(c).isNotNull(), (~key(c).isin(*schema.categories[c])).cast("double"))).alias(f"u{i}") for i, c in enumerate(cols)))
    return agg.select(*(by or []), F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"u{i}").alias("unseen_share")) for i, c in enumerate(cols)))))
