"""Several classes, and paths that don't follow the number of rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabsel.config import CVConfig, EnsembleConfig, RunConfig
from tabsel.core import Task
from tabsel.functions import metrics as M
from tabsel.operators import bootstrap, calibration, folds
from test_tabular import planted


def test_several_classes_from_band_to_probabilities(spark):
    from tabsel.plans.automl import AutoML

    d = planted(spark, 600, "multiclass").cache()
    config = RunConfig(n_boot=1000, cv=CVConfig(n_splits=2, calibrate="sigmoid"), ensemble=EnsembleConfig(size=2, n_bags=1))
    run = AutoML(Task("multiclass"), config, ["baseline", "linear"]).fit(d, "y")
    assert run.result.winner == "linear" and run.result.band == ["linear"] and run.ensemble["reason"] not in ("several_classes",)
    assert {"brier_before", "brier_after"} <= set(run.calibration)
    p = run.predict_proba(d)
    assert {"p_hi", "p_lo", "p_mid"} <= set(p.columns) and abs(p.select(F.max(F.abs(F.col("p_hi") + F.col("p_lo") + F.col("p_mid") - 1))).first()[0]) < 1e-9
    assert set(r[0] for r in run.predict(d).select("prediction").distinct().collect()) <= {"hi", "lo", "mid"}


def test_replicates_are_the_metric_under_the_same_weights(spark):
    """Each replicate against the metric itself on weighted rows, for whatever partitioning."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"rid": np.arange(200), "y": rng.integers(0, 2, 200), "pa": rng.random(200).round(1), "pb": rng.random(200).round(2), "w": rng.integers(1, 3, 200).astype(float), "g": np.arange(200) // 20})
    rows = spark.createDataFrame(pdf).cache()
    for block in (None, "g"):
        base = {r.rid: r.base for r in bootstrap._numbered(rows, 3, block, "rid").select("rid", "base").collect()}
        if block:
            assert all(len({base[i] for i in range(20 * g, 20 * g + 20)}) == 1 for g in range(10))
        for metric in ("roc_auc", "pr_auc", "accuracy", "ece", "rmse" if block else "log_loss"):
            found = bootstrap.deltas(rows, metric, 3, 3, block, "rid")
            assert np.allclose(found, bootstrap.deltas(rows.repartition(7), metric, 3, 3, block, "rid"), atol=1e-12)
            for b in range(3):
                times = bootstrap.times_of(np.array([base[i] for i in range(200)], np.int64).view(np.uint64), b)
                drawn = spark.createDataFrame(pdf.assign(w=pdf.w * times)[times > 0])
                score = lambda c: M.METRICS[metric].score(drawn.withColumnRenamed(c, "p")).first()[0]
                assert abs(found[b] - (score("pa") - score("pb"))) < 1e-9


def test_calibrator_is_the_line_between_its_points(spark):
    c = calibration.Calibrator("isotonic", xs=(0.1, 0.3, 0.3, 0.8), ys=(0.0, 0.2, 0.5, 0.9))
    p = np.linspace(0, 1, 41)
    got = [r[0] for r in spark.createDataFrame(pd.DataFrame({"p": p})).select(c.apply(F.col("p"))).collect()]
    expected = np.clip(np.where(p < 0.3, np.interp(p, [0.1, 0.3], [0.0, 0.2]), np.interp(p, [0.3, 0.8], [0.5, 0.9])), 1e-6, 1 - 1e-6)
    assert np.allclose(got, expected)


def test_groups_are_dealt_alike_however_many(spark):
    rng = np.random.default_rng(4)
    sizes = sorted(rng.integers(1, 9, 300).tolist(), reverse=True)
    kinds = [((s,), sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
    load = [0] * 5
    for s in sizes:  # one at a time, to the least
        load[load.index(min(load))] += s
    dealt = [0] * 5
    for ((s,), n), (first, turn) in zip(kinds, folds.deal(kinds, 5)):
        for i in range(n):
            dealt[first[i] if i < len(first) else turn[(i - len(first)) % 5]] += s
    assert sorted(dealt) == sorted(load)
    pdf = pd.DataFrame([(g, int(rng.random() < 0.3)) for g in range(200) for _ in range(g % 4 + 1)], columns=["g", "y"])
    out = folds.group_kfold(spark.createDataFrame(pdf), "g", 4, y="y").groupBy("fold").agg(F.count("*").alias("n"), F.avg("y").alias("share")).toPandas()
    assert len(out) == 4 and out.n.max() - out.n.min() <= 10 and out.share.max() - out.share.min() < 0.05


def test_early_stopping_without_a_time_scheme(spark):
    from tabsel.plans.evaluate import out_of_fold
    from tabsel.plans.models import ZOO

    d = planted(spark, 300, "binary").withColumn("rid", F.monotonically_increasing_id()).withColumn("w", F.lit(1.0)).withColumn("g", F.col("rid") % 20)
    d = folds.kfold(d, "rid", 2).cache()
    for group in (None, "g"):
        assert out_of_fold(ZOO["gbt"].with_params({"trees": 5, "max_depth": 2}), d, ["x1"], 2, None, 2, 1, es_share=0.2, group=group).count() == 300
