"""The tabular engine: goldens, invariants, and a run from fit to saved artifact."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsel import errors
from tabsel.config import CVConfig, EnsembleConfig, FEConfig, FSConfig, RunConfig, preset
from tabsel.core import CategoryTable, FeatureSchema, Role, Task
from tabsel.functions import expressions as X
from tabsel.functions import metrics as M
from tabsel.operators import bootstrap, calibration, ensemble, features, folds, profile, selection


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_out_of_fold_encoding_golden(spark):
    d = rows(spark, [(i, c, float(y), f) for i, (c, y, f) in enumerate(zip([0, 1, 0, 1, 0, 1], [1, 1, 1, 0, 1, 0], [0, 0, 1, 1, 2, 2]))], "i int, c int, y double, fold int")
    out = [r.te for r in features.crossfit(d, "c", "y", "fold", 1.0, "te").orderBy("i").collect()]
    assert np.allclose(out, [0.83333333, 0.16666667, 0.91666667, 0.58333333, 0.91666667, 0.58333333])


def test_expanding_encoding_golden(spark):
    d = rows(spark, [(i, c, float(y), f) for i, (c, y, f) in enumerate(zip([0, 1, 0, 1, 0, 1], [1, 0, 1, 0, 1, 0], [-1, -1, 0, 0, 1, 1]))], "i int, c int, y double, fold int")
    out = [r.te for r in features.crossfit(d, "c", "y", "fold", 1.0, "te", expanding=True).orderBy("i").collect()]
    assert np.allclose(out, [0.5, 0.5, 0.75, 0.25, 0.83333333, 0.16666667])


def test_encoding_of_a_fold_ignores_its_own_targets(spark):
    d = rows(spark, [(i, i % 4, float(i * 7 % 3 == 0), i % 5) for i in range(60)], "i int, c int, y double, fold int")
    flipped = d.withColumn("y", F.when(F.col("fold") == 2, 1 - F.col("y")).otherwise(F.col("y")))
    a, b = (features.crossfit(x, "c", "y", "fold", 3.0, "te").where("fold = 2").orderBy("i").select("te").collect() for x in (d, flipped))
    assert a == b


def test_category_codes(spark):
    t = CategoryTable(("a", "b"))
    assert [t.code(k) for k in ("a", "b", None, "z")] == [0, 1, 2, 3]
    d = rows(spark, [("a",), ("b",), (None,), ("z",)], "k string")
    assert [r[0] for r in d.select(X.encode(F.col("k"), t.keys)).collect()] == [0, 1, 2, 3]
    e = rows(spark, [(1.0,), (1.5,), (None,)], "x double")
    assert [r[0] for r in e.select(X.category_key(F.col("x"), True)).collect()] == ["1", "1.5", None]


def test_row_keys_are_stable(spark):
    d = rows(spark, [(i % 3, "x") for i in range(12)], "a int, b string")
    a, b = (sorted(r["__rid"] for r in X.with_rid(x).collect()) for x in (d, d.repartition(7)))
    assert a == b and len(set(a)) == 12


@pytest.mark.parametrize("name,value", [("accuracy", 0.5), ("rmse", np.sqrt((0.01 + 0.36 + 0.04 + 0.16) / 4)), ("mae", 1.3 / 4), ("brier", 0.57 / 4), ("roc_auc", 0.75)])
def test_metrics_by_hand(spark, name, value):
    d = rows(spark, [(1, 0.9, 1.0), (0, 0.6, 1.0), (1, 0.8, 1.0), (0, 0.4, 1.0)] if name == "none" else [(1, 0.9, 1.0), (1, 0.4, 1.0), (0, 0.2, 1.0), (0, 0.4 + 0.2 * (name == "accuracy"), 1.0)], "y int, p double, w double")
    got = M.METRICS[name].score(d).first()[0]
    expected = {"accuracy": 0.5, "rmse": value, "mae": value, "brier": value, "roc_auc": 0.875}[name]
    assert abs(got - expected) < 1e-9


def test_metrics_edges(spark):
    one = rows(spark, [(1, 0.9, 1.0), (1, 0.4, 1.0)], "y int, p double, w double")
    assert M.METRICS["roc_auc"].score(one).first()[0] is None
    half = rows(spark, [(i % 2, 0.9, 1.0) for i in range(10)], "y int, p double, w double")
    assert abs(M.METRICS["ece"].score(half).first()[0] - 0.4) < 1e-9
    weighted = rows(spark, [(1, 0.9, 1.0), (0, 0.9, 0.0)], "y int, p double, w double")
    assert M.METRICS["accuracy"].score(weighted).first()[0] == 1.0
    with pytest.raises(errors.ConfigError):
        M.resolve("rmse", "binary")


def test_profile_rules(spark):
    d = spark.range(200).select(
        F.col("id"), (F.col("id") % 7).cast("int").alias("low"), (F.col("id") / 3).alias("real"), F.lit("k").alias("const"), F.lit(None).cast("string").alias("void"), F.when(F.col("id") > 5, "a").alias("lone"),
        F.concat(F.lit("n"), F.col("id")).alias("name"), F.lit(float("nan")).alias("nan"), (F.col("id") % 2 == 0).alias("flag"), F.lit("2024-01-01").cast("date").alias("day"),
    )
    got = {r.column_name: (r.role, r.reason) for r in profile.profile(d, Task("binary")).collect()}
    assert got == {
        "id": ("ignore", "numeric_id_like"), "low": ("categorical", "low_cardinality_int"), "real": ("numeric", None), "const": ("ignore", "constant"), "void": ("ignore", "all_null"), "lone": ("categorical", None),
        "name": ("ignore", "string_id_like"), "nan": ("ignore", "all_null"), "flag": ("categorical", None), "day": ("datetime", None),
    }


def test_validation(spark):
    d = rows(spark, [(1, 0), (2, 1), (3, 2)], "a int, y int")
    for call in (
        lambda: profile.validate_target(d, "y", Task("binary")), lambda: profile.validate_target(d.where("y = 0"), "y", Task("multiclass")), lambda: profile.validate_target(d.select(F.lit("x").alias("y")), "y", Task("regression")),
        lambda: profile.validate_target(d.select(F.lit(None).cast("int").alias("y")), "y", Task("binary")), lambda: profile.validate_frame(d.limit(0)), lambda: profile.validate_axis(d, label_time="a"), lambda: profile.validate_axis(d.withColumn("g", F.lit(None)), group="g"),
        lambda: profile.validate_against(d, ["b"]), lambda: profile.validate_axis(d.withColumn("t", F.current_timestamp()), time="t"),
    ):
        with pytest.raises(errors.SchemaError):
            call()


@pytest.fixture(scope="module")
def timed(spark):
    return spark.range(300).select("id", (F.col("id") * 7 % 300 / 10).alias("t"), (F.col("id") % 11).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y")).cache()


@pytest.mark.parametrize("settings", [{}, {"purge": 5}, {"embargo": 4}, {"purge_delta": 0.5}, {"embargo_delta": 1.0}, {"max_train": 60}])
def test_time_folds_leak_nothing(timed, settings):
    f = folds.time_folds(timed, "t", "id", k=4, n_test=20, n_es=5, **settings).join(timed.select("id", "t"), "id").cache()
    assert all(not (r.shared_rows or r.overlapping_time) for r in folds.check(f, "id", time="t").collect())
    n = {(r.fold, r.part): r.n for r in f.groupBy("fold", "part").agg(F.count("*").alias("n")).collect()}
    assert all(n[k, "test"] == 20 and n[k, "es"] == 5 for k in range(4)) and all(n[k, "fit"] <= 60 for k in range(4) if "max_train" in settings)
    edge = {(r.fold, r.part != "test"): r for r in f.withColumn("part", F.when(F.col("part") == "test", "test").otherwise("train")).groupBy("fold", "part").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    if "purge_delta" in settings:
        assert all(edge[k, False].lo - edge[k, True].hi > 0.5 for k in range(4))


def test_period_folds(timed):
    f = folds.period_folds(timed, "t", "id", "delta", k=3, size=2.0, purge=1).join(timed.select("id", "t"), "id")
    assert all(not (r.shared_rows or r.overlapping_time) for r in folds.check(f, "id", time="t").collect())
    assert f.where("part = 'test' and fold = 2").agg(F.min("t")).first()[0] == 28.0
    with pytest.raises(errors.SchemaError):
        folds.period_folds(timed, "t", "id", "delta", k=3, size=20.0)


def test_positions_by_ranges_equal_the_window(timed, monkeypatch):
    a = {r.id: r.pos for r in folds.positions(timed, "t", "id").collect()}
    monkeypatch.setattr(folds, "EXACT_ROWS", 10)
    assert a == {r.id: r.pos for r in folds.positions(timed, "t", "id").collect()}


def test_group_and_class_folds(timed):
    g = folds.group_kfold(timed, "g", 4, y="y")
    assert g.groupBy("g").agg(F.count_distinct("fold").alias("c")).where("c > 1").isEmpty()
    s = folds.stratified_kfold(timed, "id", "y", 5).groupBy("fold", "y").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d"))
    assert all(r.d <= 1 for r in s.collect())
    p = folds.permute(folds.structure_blocks(timed, "id", block=30), "id", "y", "block")
    assert p.groupBy("block").agg(F.sum("y").alias("a"), F.sum("y_permuted").alias("b")).where("a <> b").isEmpty()
    c = folds.carve_group(timed, "g", 0.2)
    assert c.groupBy("g").agg(F.count_distinct("part").alias("c")).where("c > 1").isEmpty() and c.where("part = 'holdout'").select("g").distinct().count() == 3


def test_config_rules():
    for bad in ({"purge": 1}, {"scheme": "timeseries", "purge": 1, "purge_delta": 1.0}, {"scheme": "timeseries_period"}, {"scheme": "nope"}, {"outer_holdout": 1.0}, {"scheme": "timeseries", "max_train_periods": 2}):
        with pytest.raises(errors.ConfigError):
            CVConfig(**bad)
    assert preset("fast").cv.n_splits == 3 and preset("best", RunConfig(ensemble=EnsembleConfig(size=3))).ensemble.size == 3


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    strong, weak = y * 0.5 + rng.random(600) * 0.6, y * 0.1 + rng.random(600)
    d = rows(spark, [(int(a), float(p), float(q), 1.0, i % 6) for i, (a, p, q) in enumerate(zip(y, strong, weak))], "y int, pa double, pb double, w double, b int")
    far = bootstrap.deltas(d, "roc_auc", 200, 1)
    assert not bootstrap.equivalent(far, 0.05) and (far > 0).mean() > 0.99 and (far == bootstrap.deltas(d.repartition(5), "roc_auc", 200, 1)).all()
    assert bootstrap.equivalent(bootstrap.deltas(d.withColumn("pb", F.col("pa")), "log_loss", 100, 1), 0.05)
    assert len(bootstrap.deltas(d, "accuracy", 50, 1, "b")) == 50
    assert abs(bootstrap.poisson_deltas(d, "brier", 100, 3).mean() - bootstrap.deltas(d, "brier", 100, 3).mean()) < 0.02
    assert abs(bootstrap.poisson_deltas(d, "roc_auc", 40, 3).mean() - far.mean()) < 0.03
    with pytest.raises(errors.ConfigError):
        bootstrap.check_tail(0.05, 100)
    with pytest.raises(errors.ConfigError):
        bootstrap.block_deltas(np.array([0.1, 0.2, np.nan]), 10, 0)
    assert bootstrap.rank({"a": 1.0, "b": 2.0, "c": 2.0}, 1) == ["b", "c", "a"] and bootstrap.rank({"a": 1.0, "b": 2.0}, -1) == ["a", "b"]
    assert bootstrap.winner(["b", "a"], {"a": (3, 0), "b": (3, 2)}, ["b", "a"]) == "a"


def test_calibration(spark):
    rng = np.random.default_rng(2)
    p = rng.random(2000)
    y = rng.random(2000) < p**2
    d = rows(spark, [(int(a), float(b), 1.0, i % 3) for i, (a, b) in enumerate(zip(y, p))], "y int, p double, w double, fold int").cache()
    for kind in ("sigmoid", "isotonic"):
        report = calibration.gate(calibration.crossfit(d, "fold", kind))
        assert report["applied"] and report["ece_after"] < report["ece_before"]
    c = calibration.fit_sigmoid(d)
    q = 1 / (1 + np.exp(c.a * p + c.b))
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    assert abs((q - t).sum()) < 1e-4 and abs(((q - t) * p).sum()) < 1e-4


def test_ensembles(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    d = rows(spark, [(i, int(a), 1.0, float(np.clip(a * 0.4 + u * 0.6, 0.01, 0.99)), float(np.clip(a * 0.4 + v * 0.6, 0.01, 0.99)), 0.5) for i, (a, u, v) in enumerate(zip(y, rng.random(300), rng.random(300)))], "rid int, y int, w double, m0 double, m1 double, m2 double").cache()
    for w in (ensemble.caruana(d, 3, "log_loss", 6, 4), ensemble.simplex_weights(d, 3)):
        assert abs(sum(w) - 1) < 1e-9 and min(w) >= 0
    assert ensemble.decide([1.0], 5, 1, 1, 1, False)[1] == "single_candidate" and ensemble.decide([1, 0], 5, 1, 1, 1, False)[1] == "degenerate_recipe" and ensemble.decide([0.5, 0.5], 5, 2, 1, 1, False) == (True, "better") and ensemble.decide([0.5, 0.5], 5, 2, 1, -1, False)[1] == "not_better"


def test_selection_helpers():
    s = np.array([0.1, 0.5, 0.4, 0.5])
    assert selection.cutoff(s, "top_k", 2) == [1, 3] and selection.cutoff(s, "top_frac", fraction=0.6) == [1, 2, 3] and selection.cutoff(s, "auto", threshold=0.9) == [1]
    best, path = selection.sequential(4, lambda k: (1 in k) + (3 in k) - 0.01 * len(k))
    assert best == [1, 3] and path[0][0] == [0, 1, 2, 3]
    assert selection.mean_jaccard([{1, 2}, {2}]) == 0.5 and selection.refits("null_importance", 5, 9) == 155


def test_ridge_is_the_closed_form(spark):
    from tabsel.plans.models import ZOO

    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2)) * [1, 5] + [0, 3]
    y = x @ [2, -1] + rng.normal(size=80)
    d = rows(spark, [(float(a), float(b), float(c), 1.0) for (a, b), c in zip(x, y)], "a double, b double, y double, w double")
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    fitted = ZOO["linear"].fit(d, ["a", "b"], "y", "w", 0)
    assert np.allclose([r.p for r in fitted.transform(d).collect()], z @ beta + y.mean(), atol=1e-6)


def planted(spark, n, kind):
    z = F.col("x1") * 1.5 + F.when(F.col("cat") == "a", 1.0).when(F.col("cat") == "c", -1.0).otherwise(0.0) + F.col("u") - 0.5
    base = spark.range(n).select("id", (X.uniform(F.col("id"), 1) - 0.5).alias("x1"), X.uniform(F.col("id"), 2).alias("x2"), X.uniform(F.col("id"), 3).alias("u"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("cat"))
    target = {"binary": (z > 0).cast("int"), "regression": z, "multiclass": F.when(z < -0.5, "lo").when(z > 0.5, "hi").otherwise("mid")}[kind]
    return base.withColumn("x2", F.when(F.col("id") % 9 == 0, None).otherwise(F.col("x2"))).withColumn("y", target).drop("u", "id")


def test_binary_run_from_fit_to_artifact(spark, tmp_path):
    from tabsel.plans.automl import AutoML
    from tabsel.plans.report import JsonLinesTracker, render, save_report
    from tabsel.sources import artifacts

    d = planted(spark, 400, "binary").cache()
    config = RunConfig(n_boot=1000, cv=CVConfig(n_splits=3, outer_holdout=0.2, calibrate="sigmoid"), fe=FEConfig(True, 10.0, True, False))
    run = AutoML(Task("binary"), config, ["baseline", "linear"], store=f"file://{tmp_path}/store").fit(d, "y")
    board = {r["model_id"]: r["score"] for r in run.result.leaderboard}
    assert board["linear"] > 0.8 and abs(board["baseline"] - 0.5) < 0.2 and run.result.winner == "linear" and run.holdout_score > 0.75
    again = AutoML(Task("binary"), config, ["baseline", "linear"], store=f"file://{tmp_path}/store").fit(d, "y")
    assert again.result.leaderboard == run.result.leaderboard
    artifacts.save(run, str(tmp_path / "a"))
    loaded = artifacts.load(str(tmp_path / "a"))
    unseen = d.limit(5).withColumn("cat", F.lit("ZZZ")).unionByName(d.limit(20))
    assert [r.probability for r in loaded.transform(unseen).collect()] == [r.probability for r in run.transform(unseen).collect()]
    assert artifacts.export_portable(run, str(tmp_path / "p.json"), d)["max_difference"] < 1e-5
    report = json.loads(json.dumps(run.report(), default=str))
    assert "| linear |" in render(report) or "linear" in render(report)
    assert "<table>" in render(report, "html")
    save_report(report, str(tmp_path / "r.json"))
    with pytest.raises(errors.InputError):
        save_report(report, str(tmp_path / "r.json"))
    JsonLinesTracker(str(tmp_path / "runs.jsonl")).log_run(report)
    target = next(p for p in (tmp_path / "a").rglob("*") if p.name == "schema.json")
    target.write_text(target.read_text().replace("x1", "x9"))
    with pytest.raises(errors.IntegrityError):
        artifacts.load(str(tmp_path / "a"))
    with pytest.raises(errors.SchemaError):
        run.transform(d.drop("x1"))
    # the same model on a stream
    d.drop("y").write.parquet(str(tmp_path / "in"))
    stream = run.transform(spark.readStream.schema(d.drop("y").schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").count() == 400


@pytest.mark.parametrize("kind", ["regression", "multiclass"])
def test_other_tasks(spark, kind):
    from tabsel.plans.automl import AutoML

    d = planted(spark, 300, kind)
    run = AutoML(Task(kind), RunConfig(significance="none", cv=CVConfig(n_splits=2)), ["baseline", "linear"]).fit(d, "y")
    assert run.result.winner == "linear"
    out = run.transform(d).first()
    assert out.prediction is not None and (kind == "regression" or abs(sum(out.probability) - 1) < 1e-9)


def test_time_scheme_selection_and_budget(spark):
    from tabsel.plans.automl import AutoML

    d = planted(spark, 300, "binary").withColumn("t", F.monotonically_increasing_id()).cache()
    config = RunConfig(significance="none", run_mode="selection", cv=CVConfig(scheme="timeseries", n_splits=2, n_test=40), fs=FSConfig(strategy="importance", cutoff="top_k", top_k=2), n_boot=1000)
    run = AutoML(Task("binary"), config, ["baseline", "linear"]).fit(d, "y", time_col="t")
    assert len(run.schema.features) in (2, 3) and run.result.winner == "linear"
    from tabsel.config import BudgetConfig

    short = AutoML(Task("binary"), RunConfig(significance="none", run_mode="selection", budget=BudgetConfig(n_trials=1), cv=CVConfig(n_splits=2)), ["baseline", "linear"]).fit(d.drop("t"), "y")
    assert short.result.skipped == ["linear"] and short.result.exhausted_by == "trials"


def test_compared_strategies(spark):
    from tabsel.plans.automl import AutoML

    d = planted(spark, 300, "binary")
    config = RunConfig(n_boot=1000, significance="none", run_mode="selection", cv=CVConfig(n_splits=2), fs=FSConfig(compare=("importance", "random_probe"), cutoff="top_k", top_k=2))
    run = AutoML(Task("binary"), config, ["linear"]).fit(d, "y")
    assert set(run.feature_selection["compared"]) == {"importance", "random_probe"} and run.feature_selection["strategy"] in ("importance", "random_probe")
    assert {"x1", "cat"} <= set(run.feature_selection["kept"])


def test_refined_selection_and_period_band(spark):
    from tabsel.plans.evaluate import evaluate, refine
    from tabsel.plans.models import ZOO

    d = planted(spark, 400, "binary").withColumn("rid", F.monotonically_increasing_id()).withColumn("w", F.lit(1.0)).cache()
    d = folds.kfold(d, "rid", 4)
    r = evaluate([ZOO["baseline"], ZOO["linear"]], d, ["x1"], 2, "log_loss", 4, weighting="period", n_boot=1000)
    assert r.winner == "linear" and r.band == ["linear"]
    assert refine(r, "log_loss", kind="sigmoid", least=100) == "linear" and refine(r, "log_loss", least=10_000) is None


def test_sources(spark, tmp_path):
    from tabsel.sources import tables

    d = spark.range(10).select("id", (F.col("id") * 2).alias("b"))
    d.coalesce(1).write.parquet(str(tmp_path / "f" / "a.parquet"))
    d.coalesce(1).write.parquet(str(tmp_path / "f" / "b.parquet"))
    assert tables.load_table(spark, str(tmp_path / "f")).count() == 20
    d.toPandas().to_csv(tmp_path / "c.csv", index=False)
    assert tables.load_table(spark, str(tmp_path / "c.csv")).agg(F.sum("b")).first()[0] == 90
    d.select("id").write.parquet(str(tmp_path / "f" / "c.parquet"))
    for bad in (tmp_path / "f", tmp_path / "none"):
        with pytest.raises(errors.InputError):
            tables.load_table(spark, str(bad))
    assert tables.from_memory(spark, np.zeros((3, 2))).columns == ["f0", "f1"]
    assert tables.data_signature(d) == tables.data_signature(d.repartition(3)) != tables.data_signature(d.limit(9))
    with pytest.raises(errors.InputError):
        tables.attach_column(d, d.union(d), "id", "b")


def test_schema_round_trip():
    s = FeatureSchema(roles={"a": Role.NUMERIC, "b": Role.CATEGORICAL}, categories={"b": ("x", "y"), "b__c": ("1",)}, crosses=(("b", "c"),), frequency={"b": {0: 0.5}}, target={"b": {"global": 0.1, "values": {1: 0.2}}})
    assert s.features == ["a", "b_freq", "b_te", "b", "b__c"] and FeatureSchema.from_json(s.to_json()) == s and s.select(["b__c", "a"]).features == ["a", "b__c"] and s.native(1) == ["b__c"]
