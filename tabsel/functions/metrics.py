"""Metrics as grouped aggregates over a long table of predictions, weighted, for any grouping at once.

Rows have y (label or value), p (score of the positive class, or the predicted value), w (weight), and for several
classes proba (array in class order, y the class index). None of them collects rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError

EPS = 2.220446049250313e-16
#: Bin edges of the calibration error: the doubles of linspace(0, 1, 11), of which 0.3 is just above 3/10.
EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def _by(groups: list[str]) -> list[Column]:
    return [F.col(g) for g in groups]


def roc_auc(rows: DataFrame, groups: list[str] = []) -> DataFrame:  # noqa: B006
    """Ties count half; null where a group has one class only. Distinct scores are summed first, so the window is over these."""
    s = rows.groupBy(*groups, "p").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0.0).otherwise(F.col("w"))).alias("neg"))
    w = Window.partitionBy(*groups).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0.0)))
    out = s.groupBy(*groups).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    return out.select(*groups, F.when((F.col("tp") > 0) & (F.col("tn") > 0), F.col("u") / (F.col("tp") * F.col("tn"))).alias("score"))


def pr_auc(rows: DataFrame, groups: list[str] = []) -> DataFrame:  # noqa: B006
    """Average precision: the step sum over distinct scores, from the highest; null without positives."""
    s = rows.groupBy(*groups, "p").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("pos"), F.sum("w").alias("all"))
    w = Window.partitionBy(*groups).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("tp", F.sum("pos").over(w)).withColumn("n", F.sum("all").over(w))
    out = s.groupBy(*groups).agg(F.sum(F.col("pos") * F.try_divide("tp", "n")).alias("a"), F.sum("pos").alias("t"))
    return out.select(*groups, F.try_divide("a", "t").alias("score"))


def _mean(value: Column):
    def run(rows: DataFrame, groups: list[str] = []) -> DataFrame:  # noqa: B006
        return rows.groupBy(*groups).agg(F.try_divide(F.sum(F.col("w") * value), F.sum("w")).alias("score"))

    return run


def _clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


def confidence(rows: DataFrame) -> DataFrame:
    """rows with the confidence and the correctness of the top label, and the bin of the confidence."""
    if "proba" in rows.columns:
        conf = F.array_max("proba")
        right = (F.array_position("proba", conf) - 1) == F.col("y")
    else:
        conf, right = F.greatest(F.col("p"), 1 - F.col("p")), (F.col("p") >= 0.5).cast("int") == F.col("y")
    bins = sum((F.col("conf") >= e).cast("int") for e in EDGES[1:-1])
    return rows.withColumn("conf", conf).withColumn("right", right.cast("double")).withColumn("bin", bins)


def reliability(rows: DataFrame, groups: list[str] = []) -> DataFrame:  # noqa: B006
    """For each bin that isn't empty its weight, share of correct labels and mean confidence."""
    return confidence(rows).groupBy(*groups, "bin").agg(F.sum("w").alias("weight"), F.try_divide(F.sum(F.col("w") * F.col("right")), F.sum("w")).alias("fraction"), F.try_divide(F.sum(F.col("w") * F.col("conf")), F.sum("w")).alias("mean_conf"))


def ece(rows: DataFrame, groups: list[str] = []) -> DataFrame:  # noqa: B006
    bins = reliability(rows, groups).where("weight > 0")
    return bins.groupBy(*groups).agg((F.sum(F.col("weight") * F.abs(F.col("fraction") - F.col("mean_conf"))) / F.sum("weight")).alias("score"))


def multiclass_auc(rows: DataFrame, groups: list[str] = []) -> DataFrame:  # noqa: B006
    """One class against the rest, averaged over the classes."""
    long = rows.select(*groups, "w", "y", F.posexplode("proba").alias("k", "p")).withColumn("y", (F.col("y") == F.col("k")).cast("int"))
    return roc_auc(long, [*groups, "k"]).groupBy(*groups).agg(F.when(F.count("score") == F.count("*"), F.avg("score")).alias("score"))




def row_value(name: str, p: Column, y: Column, many: bool = False) -> Column:
    """What a row adds to a metric that is a mean over rows (rmse: its square). many: p is an array of probabilities."""
    if name == "accuracy":
        label = F.array_position(p, F.array_max(p)) - 1 if many else (p >= 0.5).cast("int")
        return (label == y).cast("double")
    if name == "log_loss":
        return -F.ln(_clip(F.element_at(p, y.cast("int") + 1) if many else F.when(y == 1, p).otherwise(1 - p)))
    if name in ("brier", "rmse"):
        off = lambda x, i: x - F.when(i == y, 1.0).otherwise(0.0)
        return F.aggregate(F.transform(p, lambda x, i: off(x, i) * off(x, i)), F.lit(0.0), lambda a, b: a + b) if many else (p - y) * (p - y)
    if name == "mae":
        return F.abs(p - y)
    raise ConfigError(f"metric {name!r} is no mean over rows")


def by_rollup(metric: Metric, rows: DataFrame, model: str, block: str) -> DataFrame:
    """(model, block, score) of a metric that is a mean over rows: each block, each model (block null) and all (both null), one aggregate."""
    value = row_value(metric.name, F.col("proba" if "proba" in rows.columns else "p"), F.col("y"), "proba" in rows.columns)
    out = rows.rollup(model, block).agg(F.try_divide(F.sum(F.col("w") * value), F.sum("w")).alias("score"))
    return out.withColumn("score", F.sqrt("score")) if metric.name == "rmse" else out


@dataclass(frozen=True)
class Metric:
    """name, whether greater is better, what it needs (proba, class or value), and whether calibration may be judged by it."""

    name: str
    greater: bool
    needs: str
    proper: bool = False

    @property
    def sign(self) -> int:
        return 1 if self.greater else -1

    def score(self, rows: DataFrame, groups: list[str] | None = None) -> DataFrame:
        """(groups..., score) of rows."""
        g, many = list(groups or []), "proba" in rows.columns
        if self.name == "roc_auc":
            return multiclass_auc(rows, g) if many else roc_auc(rows, g)
        if self.name == "pr_auc":
            if many:
                raise ConfigError("pr_auc is for two classes")
            return pr_auc(rows, g)
        if self.name == "ece":
            return ece(rows, g)
        out = _mean(row_value(self.name, F.col("proba" if many else "p"), F.col("y"), many))(rows, g)
        return out.withColumn("score", F.sqrt("score")) if self.name == "rmse" else out


METRICS = {m.name: m for m in (Metric("roc_auc", True, "proba"), Metric("pr_auc", True, "proba"), Metric("accuracy", True, "class"), Metric("log_loss", False, "proba", True), Metric("brier", False, "proba", True), Metric("ece", False, "proba"), Metric("rmse", False, "value"), Metric("mae", False, "value"))}


def resolve(name: str, kind: str) -> Metric:
    """The metric, if it suits the task."""
    if name not in METRICS:
        raise ConfigError(f"metric {name!r} is none of {sorted(METRICS)}")
    m = METRICS[name]
    if (m.needs == "value") != (kind == "regression"):
        raise ConfigError(f"metric {name} doesn't suit a {kind} task")
    if name == "pr_auc" and kind == "multiclass":
        raise ConfigError("pr_auc is for two classes")
    return m


def by_period(metric: Metric, rows: DataFrame, block: str, groups: list[str] = []) -> DataFrame:  # noqa: B006
    """The mean of the blocks' scores, each block weighing the same; blocks without a score are left out."""
    return metric.score(rows, [*groups, block]).groupBy(*groups).agg(F.avg("score").alias("score"))


def align_proba(proba: Column, seen: list[int], n: int, floor: float = 1e-6) -> Column:
    """Probabilities of the classes `seen` as probabilities of n classes: those absent get the floor, and the sum is 1."""
    full = F.array(*(F.element_at(proba, seen.index(k) + 1) if k in seen else F.lit(floor) for k in range(n)))
    total = F.aggregate(full, F.lit(0.0), lambda a, b: a + b)
    return F.transform(full, lambda x: x / total)
