"""The facade: fit a table, get a leaderboard, a winner and a model that scores tables and streams."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from dataclasses import asdict

import numpy as np
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig, preset
from ..core import FeatureSchema, Task
from ..errors import ConfigError, FitFailedError, SchemaError
from ..functions.expressions import digest, nan_to_null, with_rid
from ..functions.metrics import resolve
from ..operators import calibration, ensemble, features, folds, profile, selection
from ..sources.tables import data_signature
from . import models
from .evaluate import Budget, evaluate, out_of_fold, refine

log = logging.getLogger("tabsel")
#: Share of the training rows that tells models when to stop early, where no time scheme carves such rows.
ES_SHARE = 0.1


class AutoML:
    """AutoML(Task("binary")).fit(df, "target").transform(other)."""

    def __init__(self, task: Task, config: RunConfig | None = None, models: list[str] | None = None, preset_name: str | None = None, store: str | None = None) -> None:
        self.task, self.names, self.store = task, models, store
        self.config = preset(preset_name, config) if preset_name else config or RunConfig()
        self.metric = resolve(task.scorer, task.kind)
        self.timings: dict[str, float] = {}

    @staticmethod
    def available_models(task: str) -> list[str]:
        return [s.name for s in models.choose(task)]

    def _timed(self, name: str, start: float) -> None:
        self.timings[name] = round(time.monotonic() - start, 3)

    def fit(self, df: DataFrame, target: str, weight: str | None = None, group: str | None = None, time_col: str | None = None, label_time: str | None = None, keys: list[str] | None = None) -> AutoML:
        c, started = self.config, time.monotonic()
        profile.validate_frame(df)
        df = nan_to_null(df)
        labels = profile.validate_target(df, target, self.task)
        profile.validate_axis(df, group, time_col, label_time)
        self.labels = labels
        if self.task.kind == "binary":
            positive = self.task.resolve_positive(labels)
            self.labels = [x for x in labels if x != positive] + [positive]
        df = with_rid(df.where(F.col(target).isNotNull()), keys, "rid")
        y = F.col(target).cast("double") if not labels else sum((F.when(F.col(target) == x, i).otherwise(0) for i, x in enumerate(self.labels) if i), F.lit(0))
        data = df.withColumn("y", y).withColumn("w", F.col(weight).cast("double") if weight else F.lit(1.0))
        meta = {target, weight, group, time_col, label_time, "rid", "y", "w"} | set(keys or [])
        dev, held = self._carve(data, group, time_col, label_time)
        self._timed("read", started)
        t = time.monotonic()
        fitted_on = dev if c.fe.fit_on == "dev" else data
        self.schema = self._schema(fitted_on, [x for x in df.columns if x not in meta])
        encoded = features.apply(dev, self.schema)
        table, k = self._folds(dev, group, time_col, label_time)
        if isinstance(table, DataFrame) and "part" in table.columns:
            fold_of = folds.fold_index(table, dev.select("rid"), "rid")
            encoded, parts = encoded.join(fold_of, "rid"), table
        else:
            encoded, parts = encoded.join(table.select("rid", "fold"), "rid"), None
        for col, _ in self.schema.target.items():
            # out-of-fold values for evaluation, in place of those of the full training rows
            encoded = features.crossfit(encoded.drop(f"{col}_te"), col, "y", "fold", c.fe.te_smoothing, f"{col}_te", len(self.schema.categories[col]), expanding=parts is not None)
        self._timed("features", t)
        classes = len(self.labels)
        specs = models.choose(self.task.kind, self.names)
        self.tuned = {}
        if c.hpo:
            specs = [self._tune(s, encoded, classes) for s in specs]
        t = time.monotonic()
        self.feature_selection = None
        if c.fs:
            self._select(encoded, classes, parts, k)
        fingerprint = hashlib.sha256(json.dumps([asdict(c), self.schema.to_json(), data_signature(dev.drop("rid")), [asdict(s) for s in specs], pyspark.__version__], default=str, sort_keys=True).encode()).hexdigest()
        self.fingerprint = fingerprint
        budget = Budget(c.budget.time_budget_s, c.budget.n_trials, c.budget.memory_limit_mb)
        self.result = evaluate(specs, encoded, self.schema.features, classes, self.metric.name, k, parts, c.seed, c.alpha, c.n_boot, c.significance, "fold" if parts is not None else None, c.cv.weighting, budget, f"{self.store}/{fingerprint}" if self.store else None, ES_SHARE if parts is None else 0.0)
        self.refined = None
        if c.cv.selection == "refined" and classes == 2 and parts is None:
            self.refined = refine(self.result, self.metric.name, least=c.cv.refinement_min_oof)
            if self.refined in self.result.band:
                self.result.winner = self.refined
        self._timed("evaluate", t)
        by_name = {s.name: s for s in specs}
        self.weights = {self.result.winner: 1.0}
        self.ensemble = self._blend(classes) if c.ensemble else None
        self.calibrator, self.calibration = None, {"applied": False, "reason": "off"}
        if c.cv.calibrate != "off":
            self._calibrate(classes, parts is not None)
        self.holdout_score, self.holdout_optimism, self.models = None, None, {}
        if c.run_mode == "full":
            t = time.monotonic()
            train = features.apply(dev, self.schema)
            self._refit(by_name, train, classes)
            if held is not None:
                # scored once; then the models see all rows
                scored = self._score_rows(features.apply(held, self.schema))
                self.holdout_score = float(self.metric.score(scored).first()["score"])
                best = self.result.leaderboard[0]["score"]
                gain = self.metric.sign * (self.holdout_score - best)
                self.holdout_optimism = {"delta": gain, "suspicious": gain > 0.1 * abs(best)}
                full = features.apply(data, self.schema)
                self._refit(by_name, full, classes)
            self._timed("refit", t)
        return self

    def _refit(self, by_name: dict, rows: DataFrame, classes: int) -> None:
        """Fit what is shipped. A member of a blend that fails is left out, and the others' weights sum to 1; its calibrator goes where the winner does."""
        self.models, reasons = {}, {}
        for n in list(self.weights):
            try:
                self.models[n] = by_name[n].fit(rows, self.schema.features, "y", "w", classes, self.config.seed)
            except Exception as e:
                reasons[n] = f"{type(e).__name__}: {str(e)[:200]}"
                log.warning("%s left out of the shipped model: %s", n, reasons[n])
        if not self.models:
            raise FitFailedError(f"no member could be fitted again: {reasons}")
        if reasons:
            total = sum(self.weights[n] for n in self.models)
            self.weights = {n: self.weights[n] / total for n in self.models}
            self.calibrator, self.calibration = None, {"applied": False, "reason": "member_lost"}

    def _carve(self, data: DataFrame, group, time_col, label_time) -> tuple[DataFrame, DataFrame | None]:
        cv = self.config.cv
        if not cv.outer_holdout:
            return data, None
        if cv.scheme == "timeseries":
            part = folds.carve_time(data, time_col, "rid", cv.outer_holdout, cv.purge, cv.purge_delta, label_time)
        elif cv.scheme == "timeseries_period":
            part = folds.carve_period(data, time_col, "rid", cv.outer_holdout, cv.period, cv.purge, cv.purge_delta, cv.period_size)
        elif group:
            part = folds.carve_group(data, group, cv.outer_holdout, self.config.seed).select("rid", "part")
        else:
            part = folds.holdout(data, "rid", cv.outer_holdout, "y" if self.task.is_classification else None, self.config.seed).select("rid", F.when(F.col("is_test"), "holdout").otherwise("dev").alias("part"))
        both = data.join(part, "rid")
        return both.where("part = 'dev'").drop("part"), both.where("part = 'holdout'").drop("part")

    def _schema(self, df: DataFrame, columns: list[str]) -> FeatureSchema:
        fe = self.config.fe
        self.typing = profile.profile(df, self.task, columns).collect()
        s = FeatureSchema(roles={r["column_name"]: r["role"] for r in self.typing}, dtypes={c: df.schema[c].dataType.simpleString() for c in columns})
        s = features.fit_deltas(df, s, fe.report_date)
        if fe.intersections:
            s = features.fit_crosses(df, s, fe.max_pairs)
        s = features.fit_categories(df, s)
        if fe.frequency_encoding:
            s = features.fit_frequency(df, s)
        if fe.target_encoding:
            if self.task.kind != "binary":
                raise ConfigError("target encoding is for two classes")
            s = features.fit_target(df, s, F.col("y").cast("double"), fe.te_smoothing)
        if not s.features:
            raise SchemaError("no column carries a feature")
        return s

    def _folds(self, dev: DataFrame, group, time_col, label_time) -> tuple[DataFrame, int]:
        cv, seed = self.config.cv, self.config.seed
        scheme = cv.scheme if cv.scheme != "auto" else "stratified" if self.task.is_classification else "kfold"
        if scheme == "timeseries":
            return folds.time_folds(dev, time_col, "rid", cv.n_splits, cv.n_test, cv.n_es, cv.purge, cv.embargo, cv.purge_delta, cv.embargo_delta, cv.max_train_size, label_time).persist(), cv.n_splits
        if scheme == "timeseries_period":
            return folds.period_folds(dev, time_col, "rid", cv.period, cv.n_splits, cv.n_test, cv.step_periods, cv.n_es, cv.purge, cv.embargo, cv.purge_delta, cv.embargo_delta, cv.max_train_periods, cv.period_size, label_time).persist(), cv.n_splits
        if group and scheme != "group":
            log.warning("groups are given, but scheme %s splits them", scheme)
        if scheme == "group":
            if not group:
                raise ConfigError("scheme group needs a group column")
            return folds.group_kfold(dev, group, cv.n_splits, y="y" if self.task.is_classification else None), cv.n_splits
        if scheme == "holdout":
            h = folds.holdout(dev, "rid", 0.25, "y" if self.task.is_classification else None, seed)
            return h.withColumn("fold", F.when(F.col("is_test"), 0).otherwise(-1)), 1
        if scheme == "stratified":
            least = dev.groupBy("y").count().agg(F.min("count")).first()[0]
            if least < cv.n_splits:
                raise SchemaError(f"a class has {least} rows, fewer than {cv.n_splits} folds")
            return folds.stratified_kfold(dev, "rid", "y", cv.n_splits, seed), cv.n_splits
        return folds.kfold(dev, "rid", cv.n_splits, seed), cv.n_splits

    def _tune(self, spec, encoded: DataFrame, classes: int):
        """The best of n_trials settings, the defaults included, on inner folds of the training rows."""
        c = self.config
        if not spec.space or c.hpo.models and spec.name not in c.hpo.models:
            return spec
        inner = folds.kfold(encoded.drop("fold"), "rid", c.hpo.inner_cv, c.seed + 1).persist()
        for col in self.schema.target:  # codes met in an inner fold are encoded by the other inner folds
            inner = features.crossfit(inner.drop(f"{col}_te"), col, "y", "fold", c.fe.te_smoothing, f"{col}_te", len(self.schema.categories[col]))
        start, best = time.monotonic(), (-np.inf, spec, {})
        for i in range(c.hpo.n_trials):
            if c.hpo.timeout_s and i and time.monotonic() - start > c.hpo.timeout_s:
                break
            params = models.sample(spec.space, selection.stable_seed(c.seed, spec.name, i)) if i else {}
            trial = spec.with_params(params)
            oof = out_of_fold(trial, inner, self.schema.features, classes, None, c.hpo.inner_cv, c.seed)
            s = self.metric.score(oof).first()["score"]
            if s is not None and self.metric.sign * s > best[0]:
                best = (self.metric.sign * s, trial, params)
        inner.unpersist()
        self.tuned[spec.name] = best[2]
        return best[1]

    def _select(self, encoded: DataFrame, classes: int, parts, k: int) -> None:
        """A subset of the features by the configured strategy; kept only if the full set isn't significantly better.

        With several strategies to compare, each selects on the rows outside a holdout, a ranker fitted there scores
        its subset on the holdout, and the first of the best goes on to select on all rows.
        """
        fs = self.config.fs
        strategy, scores = fs.strategy, None
        if fs.compare and parts is None:
            held = folds.holdout(encoded, "rid", fs.selection_holdout, "y" if self.task.is_classification else None, self.config.seed + 7)
            fit, test = held.where(~F.col("is_test")).drop("is_test").persist(), held.where("is_test").drop("is_test").persist()
            ranker, scores = models.registry()["forest"].with_params({"trees": 20}), {}
            for name in fs.compare:
                subset = self._subset(fit, name, classes, parts, k)[0]
                rows = ranker.fit(fit, subset, "y", "w", classes, self.config.seed).transform(test)
                scores[name] = self.metric.sign * self.metric.score(rows).first()["score"]
            strategy = max(fs.compare, key=lambda n: (scores[n], -fs.compare.index(n)))
            fit.unpersist()
            test.unpersist()
        subset, report = self._subset(encoded, strategy, classes, parts, k)
        self.feature_selection = report | {"compared": scores}
        if report["gate"] == "subset":
            self.schema = self.schema.select(subset)

    def _subset(self, encoded: DataFrame, strategy: str, classes: int, parts, k: int) -> tuple[list[str], dict]:
        c, fs, names = self.config, self.config.fs, self.schema.features
        if (cost := selection.refits(strategy, k, len(names), fs.n_runs, fs.seq_min_features)) > fs.max_refits:
            raise ConfigError(f"{strategy} costs {cost} fits, {fs.max_refits} are allowed")
        ranker = models.registry()["forest"].with_params({"trees": 20})
        oof = lambda subset: out_of_fold(ranker, encoded, subset, classes, parts, k, c.seed)
        value = lambda rows: self.metric.sign * self.metric.score(rows).first()["score"]
        if strategy == "sequential":
            keep, path = selection.sequential(len(names), lambda s: value(oof([names[i] for i in s])), fs.seq_min_features, fs.seq_patience)
            scores = None
        else:
            total = np.zeros(len(names))
            for f in range(k):
                train = encoded.where(F.col("fold") != f)
                cols = names + [f"__probe{i}" for i in range(fs.n_probes)] if strategy == "random_probe" else names
                train = selection.probes(train, "rid", fs.n_probes, c.seed) if strategy == "random_probe" else train
                fitted = ranker.fit(train, cols, "y", "w", classes, c.seed)
                imp = np.array(fitted.importances)
                if strategy == "random_probe":
                    imp = selection.probe_margin(imp[: len(names)], imp[len(names) :])
                elif strategy == "null_importance":
                    blocks = folds.structure_blocks(train, "rid", block=fs.null_block_size)
                    runs = [np.array(ranker.fit(folds.permute(blocks, "rid", "y", "block", selection.stable_seed(c.seed, f, r)).drop("y").withColumnRenamed("y_permuted", "y"), names, "y", "w", classes, c.seed).importances) for r in range(fs.n_runs)]
                    imp = selection.null_margin(imp, np.stack(runs), fs.null_percentile)
                elif strategy == "permutation":
                    test = encoded.where(F.col("fold") == f)
                    base = value(fitted.transform(test))
                    imp = np.array([base - value(fitted.transform(_shuffled(test, n, c.seed))) for n in names])
                total += selection.normalise(imp) / k
            scores = total
            keep = selection.cutoff(total, fs.cutoff, fs.top_k, fs.top_frac, 0.0 if strategy in ("null_importance", "random_probe", "permutation") else None, fs.min_features)
        subset = [names[i] for i in keep]
        a, b = oof(names), oof(subset)
        lost = False
        if len(subset) < len(names):
            from ..operators.bootstrap import deltas, equivalent

            score = F.col("proba" if classes > 2 else "p")
            rows = a.select("rid", "y", "w", score.alias("pa")).join(b.select("rid", score.alias("pb")), "rid")
            lost = not equivalent(deltas(rows, self.metric.name, c.n_boot, c.seed, key="rid"), c.alpha) and value(a) > value(b)
        return (names if lost else subset), {"strategy": strategy, "scores": None if scores is None else dict(zip(names, map(float, scores))), "kept": names if lost else subset, "gate": "full_set_better" if lost else "subset"}

    def _blend(self, classes: int) -> dict:
        c, names = self.config, [r["model_id"] for r in self.result.leaderboard]
        if len(names) < 2:
            return {"shipped": False, "reason": "single_candidate"}
        table = ensemble.wide(self.result.oof, names).persist()
        metric = c.ensemble.metric or self.metric.name
        weights = ensemble.caruana(table, len(names), metric, c.ensemble.size, c.ensemble.n_bags, c.seed) if c.ensemble.method == "caruana" or classes > 2 else ensemble.simplex_weights(table, len(names), "log_loss" if classes else "rmse")
        cols = [F.col(f"m{i}") for i in range(len(names))]
        best = names.index(self.result.winner)
        s_blend, s_best = ensemble.score_blends(table, [weights, [float(i == best) for i in range(len(names))]], len(names), self.metric.name)
        from ..operators.bootstrap import deltas, equivalent

        rows = table.select("rid", "y", "w", (ensemble.blend_arrays if classes > 2 else ensemble.blend)(cols, weights).alias("pa"), F.col(f"m{best}").alias("pb"))
        same = equivalent(deltas(rows, self.metric.name, c.n_boot, c.seed, key="rid"), c.alpha)
        ships, why = ensemble.decide(weights, table.count(), s_blend, s_best, self.metric.sign, same)
        if ships:
            self.weights = {n: w for n, w in zip(names, weights) if w > 1e-6}
        return {"shipped": ships, "reason": why, "weights": dict(zip(names, weights)), "score": s_blend}

    def _calibrate(self, classes: int, timed: bool) -> None:
        if timed or classes < 2:
            self.calibration = {"applied": False, "reason": "time_ordered" if timed else "regression"}
            return
        rows, kind = self.result.oof.where(F.col("model_id") == self.result.winner), self.config.cv.calibrate
        if not calibration.viable_blocks(rows, "fold").where("not viable").isEmpty():
            self.calibration = {"applied": False, "reason": "too_few_rows"}
            return
        report = calibration.gate(calibration.crossfit(rows, "fold", kind) if classes == 2 else calibration.crossfit_classes(rows, "fold", classes, kind))
        self.calibration = report
        if report["applied"]:
            self.calibrator = calibration.fit(rows, kind) if classes == 2 else calibration.fit_classes(rows, classes, kind)

    def _score_rows(self, encoded: DataFrame) -> DataFrame:
        """encoded with p or proba of the shipped model (or blend), not calibrated."""
        many = len(self.labels) > 2
        out, col = encoded, "proba" if many else "p"
        for i, (n, _) in enumerate(self.weights.items()):
            out = self.models[n].transform(out).withColumnRenamed(col, f"__m{i}")
        cols, w = [F.col(f"__m{i}") for i in range(len(self.weights))], list(self.weights.values())
        out = out.withColumn(col, ensemble.blend_arrays(cols, w) if many else ensemble.blend(cols, w))
        return out.drop(*(f"__m{i}" for i in range(len(w))))

    def transform(self, df: DataFrame) -> DataFrame:
        """df with prediction, and for classes probability (array in the order of labels). Also for streams."""
        names = df.columns
        wrapped = df.withColumn("__row", F.struct(*(F.col(f"`{c}`") for c in names)))
        out = self._score_rows(features.apply(wrapped, self.schema))
        if not self.labels:
            return out.select("__row.*", F.col("p").alias("prediction"))
        if len(self.labels) == 2:
            label = F.when(F.col("p") >= 0.5, F.lit(self.labels[1])).otherwise(F.lit(self.labels[0]))
            p = self.calibrator.apply(F.col("p")) if self.calibrator else F.col("p")
            return out.select("__row.*", label.alias("prediction"), F.array(1 - p, p).alias("probability"))
        at = F.array_position("proba", F.array_max("proba")).cast("int")
        out = out.withColumn("prediction", F.element_at(F.array(*map(F.lit, self.labels)), at))
        if self.calibrator:
            out = out.withColumn("proba", calibration.apply_classes(self.calibrator, F.col("proba")))
        return out.select("__row.*", "prediction", F.col("proba").alias("probability"))

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prediction: the label, or the value of a regression."""
        return self.transform(df).drop("probability")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """df with a column p_<label> for each class, in the order of labels."""
        if not self.labels:
            raise ConfigError("a regression has no probabilities")
        return self.transform(df).withColumns({f"p_{x}": F.element_at("probability", i + 1) for i, x in enumerate(self.labels)}).drop("prediction", "probability")

    def score(self, df: DataFrame, target: str, weight: str | None = None) -> float:
        y = F.col(target).cast("double") if not self.labels else sum((F.when(F.col(target) == x, i).otherwise(0) for i, x in enumerate(self.labels) if i), F.lit(0))
        rows = self._score_rows(features.apply(nan_to_null(df), self.schema).withColumn("y", y).withColumn("w", F.col(weight) if weight else F.lit(1.0)))
        return float(self.metric.score(rows).first()["score"])

    def report(self) -> dict:
        """The run as JSON-ready values; version 1."""
        r = self.result
        return {
            "run_manifest_version": 1, "task": self.task.kind, "metric": self.metric.name, "config": json.loads(json.dumps(asdict(self.config), default=str)), "timings": self.timings, "winner": r.winner, "failed": r.failed,
            "holdout_score": self.holdout_score, "holdout_optimism": self.holdout_optimism, "leaderboard": r.leaderboard, "band": {"member_ids": r.band, "unstable": r.unstable, "width": len(r.band), "winner_by_tiebreak": r.winner != r.leaderboard[0]["model_id"]},
            "budget": {"exhausted": r.exhausted_by is not None, "exhausted_by": r.exhausted_by, "skipped": r.skipped}, "significance": self.config.significance, "refined_winner": self.refined, "cv": {"scheme": self.config.cv.scheme, "n_splits": self.config.cv.n_splits},
            "feature_selection": self.feature_selection, "native_routing": self.schema.native(self.task.native_cat_max_unique), "hpo": self.tuned or None, "ensemble": self.ensemble, "serving": {"models": self.weights, "calibration": self.calibration},
            "typing": [{k: row[k] for k in ("column_name", "role", "reason")} for row in self.typing if row["reason"]], "fe_fit_on": self.config.fe.fit_on, "run_fingerprint": self.fingerprint, "cache": {"enabled": self.store is not None},
        }


def _shuffled(df: DataFrame, column: str, seed: int) -> DataFrame:
    """df with one column's values dealt out anew."""
    from pyspark.sql import Window

    place = lambda salt: F.row_number().over(Window.partitionBy("fold").orderBy(digest(F.col("rid"), f"{seed}:{column}:{salt}"), "rid"))
    given = df.select("fold", F.col(f"`{column}`").alias("__v"), place("a").alias("__i"))
    return df.drop(column).withColumn("__i", place("b")).join(given, ["fold", "__i"]).drop("__i").withColumnRenamed("__v", column)
