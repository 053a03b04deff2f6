"""Trees from cells: rows with the same bins, label and weight are alike to a tree, so they are counted and fitted as one."""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Thresholds are taken from so many quantiles of all rows; Spark's own come from a random sample of so many rows (max_bins 128).
GRID = 16_384
#: Rows are packed where a cell stands for so many on average, at least.
ROWS_A_CELL = 8
#: Cells of one partition.
PART = 50_000
_SIDE = 4


def edges(values: list[float], max_bins: int, filled: float = 0.0, share: float = 0.0) -> list[float]:
    """Spark's choice of thresholds, given the grid of a feature's values and the share of missing ones, which are `filled`.

    Between all distinct values, if these are few; else so that the bins are about even.
    """
    v, c = np.unique(np.asarray(values, float) + 0.0, return_counts=True)
    c = c * (1 - share)
    if share:
        v, c = np.append(v, filled), np.append(c, share * len(values))
        v, back = np.unique(v, return_inverse=True)
        c = np.bincount(back, c)
    middle = v[:-1] / 2 + v[1:] / 2
    if len(v) <= max_bins:
        return middle.tolist()
    stride, out, seen = c.sum() / max_bins, [], c[0]
    target = stride
    for i in range(1, len(v)):
        before, seen = seen, seen + c[i]
        if abs(before - target) < abs(seen - target):
            out.append(float(middle[i - 1]))
            target += stride
    return out[: max_bins - 1]


def bucketed(data: DataFrame, names: list[str], bounds: list[list[float]]) -> DataFrame:
    """data with __b_0..: how many bounds lie below the value. A bucket is closed below, and a tree's left side above."""
    splits = [[-math.inf, *(math.nextafter(x, math.inf) for x in e or [1e308]), math.inf] for e in bounds]
    return Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"__b_{i}" for i in range(len(names))]).transform(data)


def pack(data: DataFrame, names: list[str], bounds: list[list[float]], rows: int, classes: int, es: bool) -> DataFrame | None:
    """(__b_0.., __y, __w, __es, __n) of data, persisted: how many rows fall in each cell. None where few rows are alike."""
    if math.prod(len(e) + 1 for e in bounds) * classes * (2 if es else 1) * ROWS_A_CELL > rows:
        return None
    ordered = [F.col(f"__b_{i}").alias(f"__b_{i}", metadata={}) for i in range(len(names))]  # the bucketizer's attributes make bins categories
    cells = bucketed(data, names, bounds).groupBy(*ordered, "__y", "__w", *(["__es"] if es else [])).agg(F.count("*").alias("__n")).persist()
    n = cells.count()
    if n * ROWS_A_CELL > rows:  # the weights differ
        cells.unpersist()
        return None
    return cells.coalesce(-(-n // PART))


def stand_ins(rows: DataFrame, features: list[str], medians: dict[str, float], bounds: list[list[float]]) -> DataFrame:
    """(fold, y, w, features), persisted: a row for each cell, label and weight, with the weight of all its rows. A tree of these bounds scores it as each of them."""
    filled = rows.withColumns({f"__f_{i}": F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(medians[c])) for i, c in enumerate(features)})
    names = [f"__f_{i}" for i in range(len(features))]
    binned = bucketed(filled, names, bounds)
    cells = binned.groupBy("fold", "y", "w", *(f"__b_{i}" for i in range(len(names)))).agg(F.count("*").alias("__n"), *(F.min(n).alias(n) for n in names))
    return cells.select("fold", "y", (F.col("w") * F.col("__n")).alias("w"), *(F.col(n).alias(c) for n, c in zip(names, features))).persist()


def bags(cells: DataFrame, trees: int, seed: int) -> DataFrame:
    """cells with __bag: for each tree, how often the cell's rows are drawn together.

    A row is drawn Poisson(1) times, so n rows are drawn Poisson(n) times. The draw depends on cell, seed and tree alone.
    """

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            keys = p["__h"].to_numpy().view(np.uint64)
            p["__bag"] = [np.random.Generator(np.random.Philox(key=[k, seed & 0xFFFFFFFF])).poisson(n, trees).tolist() for k, n in zip(keys, p["__n"])]
            yield p.drop(columns="__h")

    key = [c for c in cells.columns if c != "__n"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema)
    return cells.withColumn("__h", F.xxhash64(*key)).mapInPandas(draw, f"{schema}, __bag array<bigint>")


def _thresholds(jvm, node, bounds: list[list[float]]):
    """A node of a tree of bins as one of values."""
    if not node.numDescendants():
        return node
    s, tree = node.split(), jvm.org.apache.spark.ml.tree
    i = s.featureIndex()
    at = tree.ContinuousSplit(i, float(bounds[i][math.floor(s.threshold())]))
    return tree.InternalNode(node.prediction(), node.impurity(), node.gain(), _thresholds(jvm, node.leftChild(), bounds), _thresholds(jvm, node.rightChild(), bounds), at, node.impurityStats())


def _array(spark, kind, items: list):
    out = spark.sparkContext._gateway.new_array(kind, len(items))
    for i, x in enumerate(items):
        out[i] = x
    return out


def forest(cells: DataFrame, bounds: list[list[float]], trees: int, seed: int, top: int, common: dict):
    """A forest of the rows behind the cells (with __x, the bins), its thresholds values of the features. top: number of classes."""
    from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier

    spark = cells.sparkSession
    ml = spark.sparkContext._jvm.org.apache.spark.ml
    subset = "sqrt" if trees > 1 else "all"

    def one(t: int):
        own = cells.withColumn("__bw", F.col("__bag")[t] * F.col("__w")).where("__bw > 0")
        model = RandomForestClassifier(labelCol="__y", numTrees=1, bootstrap=False, featureSubsetStrategy=subset, **{**common, "weightCol": "__bw", "seed": seed + t}).fit(own)
        root = model._java_obj.trees()[0].rootNode()
        return ml.classification.DecisionTreeClassificationModel(_thresholds(spark.sparkContext._jvm, root, bounds), len(bounds), top)

    with ThreadPoolExecutor(_SIDE) as pool:
        found = list(pool.map(one, range(trees)))
    java = ml.classification.RandomForestClassificationModel(_array(spark, ml.classification.DecisionTreeClassificationModel, found), len(bounds), top)
    for name, value in {"numTrees": trees, "maxDepth": common["maxDepth"], "maxBins": common["maxBins"]}.items():
        java.set(java.getParam(name), value)
    return RandomForestClassificationModel(java).setFeaturesCol("__x")


def boosted(model, bounds: list[list[float]], spark):
    """A boosted classifier of bins as one of values."""
    from pyspark.ml.classification import GBTClassificationModel

    ml, gateway = spark.sparkContext._jvm.org.apache.spark.ml, spark.sparkContext._gateway
    roots = [_thresholds(spark.sparkContext._jvm, t.rootNode(), bounds) for t in model._java_obj.trees()]
    found = _array(spark, ml.regression.DecisionTreeRegressionModel, [ml.regression.DecisionTreeRegressionModel(r, len(bounds)) for r in roots])
    weights = _array(spark, gateway.jvm.double, list(map(float, model.treeWeights)))
    return GBTClassificationModel(ml.classification.GBTClassificationModel(model.uid, found, weights, len(bounds), 2)).setFeaturesCol("__x")
