"""Calibration of scores: Platt's sigmoid, isotonic regression, cross-fitted maps and the gate before they are used."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_ROWS, EPS, ISOTONIC_FROM = 50, 1e-6, 1000


@dataclass(frozen=True)
class Calibrator:
    """kind sigmoid: 1 / (1 + exp(a p + b)); kind isotonic: linear between the points (xs, ys), constant outside."""

    kind: str
    a: float = 0.0
    b: float = 0.0
    xs: tuple[float, ...] = ()
    ys: tuple[float, ...] = ()

    def apply(self, p: Column) -> Column:
        if self.kind == "sigmoid":
            out = 1 / (1 + F.exp(F.lit(self.a) * p + F.lit(self.b)))
        else:
            # one array of points and one search in it, however many points there are
            xs, ys = F.array(*map(F.lit, self.xs)), F.array(*map(F.lit, self.ys))
            at = F.size(F.filter(xs, lambda x: x <= p))  # points up to p
            x0, y0 = F.get(xs, at - 1), F.get(ys, at - 1)
            x1, y1 = F.get(xs, at), F.get(ys, at)
            out = F.when(at == 0, F.lit(self.ys[0])).when(at == len(self.xs), F.lit(self.ys[-1])).otherwise(y0 + (p - x0) * ((y1 - y0) / (x1 - x0)))
        return F.least(F.greatest(out, F.lit(EPS)), F.lit(1 - EPS))


def fit_sigmoid(rows: DataFrame, steps: int = 30) -> Calibrator:
    """Platt's two parameters by Newton steps; each step is one aggregate of gradient and Hessian over (y, p, w)."""
    t = rows.agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("y") == 1, 0.0).otherwise(F.col("w"))).alias("n")).first()
    hi, lo = (t["p"] + 1) / (t["p"] + 2), 1 / (t["n"] + 2)
    target = F.when(F.col("y") == 1, hi).otherwise(lo)
    binned = rows.groupBy("p", target.alias("t")).agg(F.sum("w").alias("w"))  # equal scores once
    a, b = 0.0, float(np.log((t["n"] + 1) / (t["p"] + 1)))
    for _ in range(steps):
        q = 1 / (1 + F.exp(F.lit(a) * F.col("p") + F.lit(b)))
        g, h = F.col("w") * (F.col("t") - q), F.col("w") * q * (1 - q)
        s = binned.agg(F.sum(g * F.col("p")), F.sum(g), F.sum(h * F.col("p") * F.col("p")), F.sum(h * F.col("p")), F.sum(h)).first()
        hess = np.array([[s[2] + 1e-12, s[3]], [s[3], s[4] + 1e-12]])
        step = np.linalg.solve(hess, np.array([s[0], s[1]]))
        a, b = a - float(step[0]), b - float(step[1])
        if abs(step).max() < 1e-10:
            break
    return Calibrator("sigmoid", a, b)


def fit_isotonic(rows: DataFrame) -> Calibrator:
    """Spark's parallel pool-adjacent-violators over (y, p, w)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    data = VectorAssembler(inputCols=["p"], outputCol="x").transform(rows.select(F.col("p").cast("double"), F.col("y").cast("double").alias("label"), F.col("w").cast("double").alias("weight")))
    m = IsotonicRegression(featuresCol="x", labelCol="label", weightCol="weight").fit(data)
    return Calibrator("isotonic", xs=tuple(m.boundaries.toArray().tolist()), ys=tuple(m.predictions.toArray().tolist()))


def fit(rows: DataFrame, kind: str = "auto") -> Calibrator:
    if kind == "auto":
        kind = "isotonic" if rows.count() >= ISOTONIC_FROM else "sigmoid"
    return fit_isotonic(rows) if kind == "isotonic" else fit_sigmoid(rows)


def viable_blocks(rows: DataFrame, block: str) -> DataFrame:
    """(block, n_rest, classes_rest, viable): whether the rows outside a block are enough, and have as many classes as all."""
    cells = rows.groupBy(block, "y").agg(F.count("*").alias("c"))
    totals = cells.groupBy("y").agg(F.sum("c").alias("t"))
    grid = cells.select(block).distinct().join(totals, how="cross").join(cells, [block, "y"], "left")
    rest = grid.withColumn("r", F.col("t") - F.coalesce("c", F.lit(0))).groupBy(block).agg(F.sum("r").alias("n_rest"), F.count_if(F.col("r") > 0).alias("classes_rest"), F.count("*").alias("k"))
    return rest.select(block, "n_rest", "classes_rest", ((F.col("n_rest") >= MIN_ROWS) & (F.col("classes_rest") == F.col("k"))).alias("viable"))


def crossfit(rows: DataFrame, block: str, kind: str = "auto") -> DataFrame:
    """rows with p_cal: each block's scores mapped by the calibrator of the other blocks (blocks come few, as folds do)."""
    out = None
    for r in rows.select(block).distinct().orderBy(block).collect():
        c = fit(rows.where(F.col(block) != r[0]), kind)
        part = rows.where(F.col(block) == r[0]).withColumn("p_cal", c.apply(F.col("p")))
        out = part if out is None else out.unionByName(part)
    return out


def one_against_rest(rows: DataFrame, k: int) -> DataFrame:
    """rows of several classes as rows of two: class k and its probability."""
    return rows.withColumn("y", (F.col("y") == k).cast("int")).withColumn("p", F.element_at("proba", k + 1)).drop("proba")


def fit_classes(rows: DataFrame, classes: int, kind: str = "auto") -> list[Calibrator]:
    """A calibrator for each class against the rest."""
    return [fit(one_against_rest(rows, k), kind) for k in range(classes)]


def apply_classes(calibrators: list[Calibrator], proba: Column) -> Column:
    """Each class mapped by its own calibrator; the sum is 1."""
    mapped = F.array(*(c.apply(F.element_at(proba, k + 1)) for k, c in enumerate(calibrators)))
    return F.transform(mapped, lambda x: x / F.aggregate(mapped, F.lit(0.0), lambda a, b: a + b))


def crossfit_classes(rows: DataFrame, block: str, classes: int, kind: str = "auto") -> DataFrame:
    """rows with proba_cal, as crossfit()."""
    out = None
    for r in rows.select(block).distinct().orderBy(block).collect():
        cs = fit_classes(rows.where(F.col(block) != r[0]), classes, kind)
        part = rows.where(F.col(block) == r[0]).withColumn("proba_cal", apply_classes(cs, F.col("proba")))
        out = part if out is None else out.unionByName(part)
    return out


def gate(rows: DataFrame) -> dict:
    """Brier and calibration error before and after, of rows with p and p_cal; used only if the Brier score isn't worse."""
    from ..functions.metrics import METRICS

    c = "proba" if "proba_cal" in rows.columns else "p"
    after = rows.drop(c).withColumnRenamed(f"{c}_cal", c)
    get = lambda m, d: METRICS[m].score(d).first()["score"]
    out = {f"{m}_{when}": get(m, d) for m in ("brier", "ece") for when, d in (("before", rows), ("after", after))}
    return out | {"applied": out["brier_after"] <= out["brier_before"]}
