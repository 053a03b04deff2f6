"""Streams: scoring by a fitted model, and the share of unseen categories by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import FeatureSchema, Role
from ..operators.features import is_integer
from ..functions.expressions import category_key


def unseen_by_window(df: DataFrame, schema: FeatureSchema, time: str, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, column_name, n_known, unseen_share) by tumbling windows; with `late`, a watermark closes them on a stream.

    The sums are over rows stacked by column, so a stream keeps a few numbers for each open window.
    """
    cols = schema.of(Role.CATEGORICAL)
    key = lambda c: category_key(F.col(f"`{c}`"), is_integer(schema, c))
    marked = df.withWatermark(time, late) if late else df
    stacked = F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.when(key(c).isNotNull(), (~key(c).isin(*schema.categories[c])).cast("double")).alias("unseen")) for c in cols)))
    long = marked.select(F.col(time), stacked)
    out = long.groupBy(F.window(time, width).alias("w"), "column_name").agg(F.count("unseen").alias("n_known"), F.avg("unseen").alias("unseen_share"))
    return out.select(F.col("w.start").alias("window_start"), "column_name", "n_known", "unseen_share")
