"""Trees fitted on cells: what reaches Spark's trees must not grow with the rows, and the models must be those of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsel.plans import cells
from tabsel.plans.evaluate import evaluate
from tabsel.plans.models import ZOO


@pytest.fixture(scope="module")
def rows(spark):
    """Few values, with nulls, two weights, and a label that both features tell something of."""
    a, b = F.col("id") % 13, F.col("id") * 7919 % 1000 % 9
    y = (a / 13 + F.when(b > 4, 0.3).otherwise(0.0) + F.rand(3) > 1.0).cast("int")
    return spark.range(6000).select("id", F.when(F.col("id") % 17 > 0, a).alias("a"), (b - 2.5).alias("b"), (1.0 + F.col("id") % 2).alias("w"), y.alias("y"), (F.col("id") % 11 == 0).alias("es")).persist()


def _both(monkeypatch, fit):
    """What fit gives by cells, and by rows."""
    monkeypatch.setattr(cells, "ROWS_A_CELL", 4)
    packed = fit()
    monkeypatch.setattr(cells, "ROWS_A_CELL", 10**9)
    return packed, fit()


def _scores(model, rows, c="p"):
    return np.array(model.transform(rows).orderBy("id").select(c).toPandas()[c].tolist())


@pytest.mark.parametrize("es", [None, "es"])
def test_boosted_cells_equal_boosted_rows(monkeypatch, rows, es):
    packed, whole = _both(monkeypatch, lambda: ZOO["gbt"].with_params({"trees": 6, "max_depth": 3}).fit(rows, ["a", "b"], "y", "w", 2, 5, es))
    assert packed.bounds and whole.bounds is None
    assert np.allclose(_scores(packed, rows), _scores(whole, rows), atol=1e-9) and np.allclose(packed.importances, whole.importances)


def test_boosted_cells_of_several_classes(monkeypatch, rows):
    three = rows.withColumn("y", F.col("y") + (F.col("b") > 3).cast("int"))
    packed, whole = _both(monkeypatch, lambda: ZOO["gbt"].with_params({"trees": 3, "max_depth": 2}).fit(three, ["a", "b"], "y", "w", 3, 5))
    assert np.allclose(_scores(packed, three, "proba"), _scores(whole, three, "proba"), atol=1e-9)


def test_forest_of_cells_is_a_forest_of_rows(monkeypatch, rows, tmp_path):
    """The draws differ, so scores agree as those of two seeds do; many trees bring them close."""
    packed, whole = _both(monkeypatch, lambda: ZOO["forest"].with_params({"trees": 40, "max_depth": 4}).fit(rows, ["a", "b"], "y", "w", 2, 5))
    p, q = _scores(packed, rows), _scores(whole, rows)
    assert packed.bounds and np.abs(p - q).max() < 0.06 and np.abs(p - q).mean() < 0.015 and np.allclose(packed.importances, whole.importances, atol=0.03)
    packed.pipeline.write().save((tmp_path / "m").as_uri())
    from pyspark.ml import PipelineModel

    packed.pipeline = PipelineModel.load((tmp_path / "m").as_uri())
    assert np.array_equal(_scores(packed, rows), p) and packed.pipeline.stages[-1].getNumTrees == 40


def test_draws_of_a_cell_are_those_of_its_rows(spark):
    """Poisson(n): mean and variance n, independent of the partitioning."""
    c = spark.range(3000).select(F.col("id").cast("double").alias("__b_0"), F.lit(1.0).alias("__w"), F.lit(30).cast("long").alias("__n"))
    draws = [np.array(cells.bags(c.repartition(n), 4, 1).orderBy("__b_0").toPandas()["__bag"].tolist()) for n in (1, 5)]
    assert np.array_equal(*draws) and abs(draws[0].mean() - 30) < 0.3 and abs(draws[0].var() - 30) < 1.5
    assert np.abs(np.corrcoef(draws[0].T) - np.eye(4)).max() < 0.08


def test_bounds_of_many_values_are_even(spark):
    v = np.random.default_rng(0).gamma(2, size=16_384)
    e = cells.edges(np.sort(v).tolist(), 128)
    counts = np.histogram(v, [-np.inf, *e, np.inf])[0]
    assert len(e) == 127 and counts.min() > 100 and counts.max() < 160
    assert cells.edges([1.0] * 9, 128) == [] and cells.edges([1.0, 1.0, 3.0], 128) == [2.0]
    assert cells.edges([1.0, 3.0], 128, 2.0, 0.5) == [1.5, 2.5] and cells.edges([1e308, 1.7e308], 128)[0] < 1.7e308


def test_rows_of_a_tree_do_not_grow(spark, monkeypatch):
    """Spark's trees held all rows as objects, several times over; and the leaderboard is the same with rows packed for scoring."""
    seen = []
    pack = cells.pack
    monkeypatch.setattr(cells, "pack", lambda *a: (seen.append(x.count()) if (x := pack(*a)) is not None else seen.append(None)) or x)
    sizes, n_cells = (20_000, 60_000), []
    for n in sizes:
        d = spark.range(n).select(F.col("id").alias("rid"), (F.col("id") % 2).cast("int").alias("fold"), F.pmod(F.xxhash64("id"), F.lit(20)).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(15)).alias("b"), F.lit(1.0).alias("w"))
        d = d.withColumn("y", (F.col("a") / 20 + F.rand(3) > 0.8).cast("int")).persist()
        specs = [ZOO["forest"].with_params({"trees": 3, "max_depth": 3}), ZOO["gbt"].with_params({"trees": 3, "max_depth": 2})]
        r = evaluate(specs, d, ["a", "b"], 2, "roc_auc", 2, significance="none", keep=False)
        n_cells.append(seen[:])
        seen.clear()
        assert len(r.leaderboard) == 2 and not r.failed and r.oof is None
    assert [len(x) for x in n_cells] == [2, 2] and max(max(x) for x in n_cells) <= 20 * 15 * 2
    whole = evaluate(specs, d, ["a", "b"], 2, "roc_auc", 2, significance="none")
    assert whole.oof.count() == 120_000 and [x["model_id"] for x in whole.leaderboard] == [x["model_id"] for x in r.leaderboard]
    assert np.allclose([x["score"] for x in whole.leaderboard], [x["score"] for x in r.leaderboard], atol=1e-12)
