"""The model zoo as Spark ML estimators: specs, and fitted models that score DataFrames."""

from __future__ import annotations

import random
from dataclasses import dataclass, field, replace
from importlib import metadata

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import ConfigError, FitFailedError
from ..functions.metrics import align_proba
from . import cells as packed


def _values(columns: list[str]) -> dict[str, Column]:
    return {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns}


def near_medians(df: DataFrame, columns: list[str], grid: int = 0) -> Row:
    """n; and of column i its number of values n{i}, and approximate percentiles q{i}: as many as the grid has, evenly, and two about the median."""
    x, at = _values(columns), [*((i + 0.5) / grid for i in range(grid)), 0.49998, 0.50002]
    shares = F.split(F.lit(",".join(map(repr, at))), ",").cast("array<double>")
    return df.agg(F.count("*").alias("n"), *(F.percentile_approx(x[c], shares, 100_000).alias(f"q{i}") for i, c in enumerate(columns)), *(F.count(x[c]).alias(f"n{i}") for i, c in enumerate(columns))).first()


def exact_medians(df: DataFrame, columns: list[str], near: Row | None = None) -> dict[str, float | None]:
    """The median of each column's values (the mean of the two middle ones), null or NaN left out; None without any.

    Approximate percentiles bracket the middle ranks; the values within are counted, a few in 100,000 of the rows, or as
    many as tie. So the result is exact for any number of rows, and no task holds all distinct values.
    """
    x = _values(columns)
    near = near or near_medians(df, columns)
    known = {i: (near[f"q{i}"][-2], near[f"q{i}"][-1]) for i in range(len(columns)) if near[f"n{i}"]}
    if not known:
        return dict.fromkeys(columns)
    # the bracket's own rank error is twice the width at most: ranks outside it are counted, and the bracket widened if need be
    out: dict[str, float | None] = dict.fromkeys(columns)
    for widen in (False, True):
        if not known:
            break
        pieces = [F.struct(F.lit(i).alias("i"), F.when(x[columns[i]] < lo, F.lit(-1)).when(x[columns[i]] > hi, F.lit(1)).otherwise(0).alias("side"), (x[columns[i]] if widen else F.when(x[columns[i]].between(lo, hi), x[columns[i]])).alias("v")) for i, (lo, hi) in known.items()]
        counts = df.select(F.inline(F.array(*pieces))).where("side is not null").groupBy("i", "side", "v").agg(F.count("*").alias("c"))
        by: dict[int, list] = {}
        for r in counts.toLocalIterator():
            if r["side"] or r["v"] is not None:
                by.setdefault(r["i"], []).append((r["side"], r["v"], r["c"]))
        for i, cells in by.items():
            n = near[f"n{i}"]
            ordered = sorted((v, c) for side, v, c in cells if v is not None and (widen or not side))
            seen = 0 if widen else sum(c for side, _, c in cells if side < 0)
            found = []
            for rank in sorted({(n - 1) // 2, n // 2}):
                at, value = seen, None
                for v, c in ordered:
                    if at <= rank < at + c:
                        value = v
                        break
                    at += c
                found.append(value)
            if None not in found:
                out[columns[i]] = float(sum(found) / len(found))
        known = {i: k for i, k in known.items() if out[columns[i]] is None}
    return out


@dataclass
class Fitted:
    """A fitted model: adds `p` (score or value) or, with several classes, `proba`, to a DataFrame of the features."""

    spec: ModelSpec
    features: list[str]
    classes: int
    pipeline: PipelineModel | None = None
    medians: dict[str, float] = field(default_factory=dict)
    constant: list[float] | None = None
    importances: list[float] | None = None
    members: list[PipelineModel] | None = None
    bounds: list[list[float]] | None = None  # of the cells it was fitted on

    def transform(self, df: DataFrame) -> DataFrame:
        if self.constant is not None:
            return df.withColumn("proba", F.array(*map(F.lit, self.constant))) if self.classes > 2 else df.withColumn("p", F.lit(self.constant[-1]))
        filled = df.withColumns({f"__f_{i}": F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(self.medians.get(c, 0.0))) for i, c in enumerate(self.features)})
        if self.members is not None:  # one model for each class: probabilities side by side, summing to 1
            for k, m in enumerate(self.members):
                filled = m.transform(filled).withColumn(f"__k{k}", vector_to_array("probability")[1]).drop("__x", "__z", "rawPrediction", "probability", "prediction")
            out = filled.withColumn("proba", align_proba(F.array(*(F.col(f"__k{k}") for k in range(self.classes))), list(range(self.classes)), self.classes))
            return out.drop(*(f"__k{k}" for k in range(self.classes)), *(f"__f_{i}" for i in range(len(self.features))))
        out = self.pipeline.transform(filled)
        if self.classes == 0:
            out = out.withColumn("p", F.col("prediction"))
        elif self.classes == 2:
            out = out.withColumn("p", vector_to_array("probability")[1])
        else:
            n = self.classes
            out = out.withColumn("proba", vector_to_array("probability")).withColumn("proba", align_proba(F.concat("proba", F.array_repeat(F.lit(1e-6), n)), list(range(n)), n))
        return out.drop("__x", "__z", "rawPrediction", "probability", "prediction", *(f"__f_{i}" for i in range(len(self.features))))


@dataclass(frozen=True)
class ModelSpec:
    """A kind of model, what it can do, its settings, the settings worth tuning and its place by simplicity."""

    name: str
    kinds: tuple[str, ...]
    complexity: int
    params: dict = field(default_factory=dict)
    space: dict = field(default_factory=dict)
    early_stopping: bool = False
    handles_missing: bool = False

    def with_params(self, params: dict) -> ModelSpec:
        if stray := set(params) - set(self.params) - set(self.space):
            raise ConfigError(f"model {self.name} has no settings {sorted(stray)}")
        return replace(self, params={**self.params, **params})

    def fit(self, df: DataFrame, features: list[str], y: str, weight: str, classes: int, seed: int = 42, es: str | None = None, kept: dict | None = None) -> Fitted:
        """df has the features (categoricals as codes), y (class index or value), the weight, and perhaps a column marking early-stopping rows.

        kept: what models fitted on the same rows share (medians, cells); the caller releases it.
        """
        if self.name == "baseline":
            return self._baseline(df, features, y, weight, classes)
        own = {} if kept is None else kept
        if "near" not in own or self.name != "linear" and classes and not own["grid"]:
            grid = packed.GRID if self.name != "linear" and classes else 0
            own |= {"near": near_medians(df, features, grid), "grid": grid}
        if "medians" not in own:
            own["medians"] = {c: (0.0 if m is None else m) for c, m in exact_medians(df, features, own["near"]).items()}
        medians = own["medians"]
        data = df.withColumns({f"__f_{i}": F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(medians[c])) for i, c in enumerate(features)})
        data = data.select(*(f"__f_{i}" for i in range(len(features))), F.col(y).cast("double").alias("__y"), F.col(weight).cast("double").alias("__w"), *([F.col(es).alias("__es")] if es else []))
        fitted = Fitted(self, features, classes, medians=medians)
        assemble = VectorAssembler(inputCols=[f"__f_{i}" for i in range(len(features))], outputCol="__x")
        if self.name == "linear":
            self._linear(data, assemble, fitted)
        else:
            self._trees(data, assemble, fitted, seed, es, own)
            if kept is None:
                release(own)
        return fitted

    def _baseline(self, df, features, y, weight, classes) -> Fitted:
        if classes:
            rows = {int(r[0]): r[1] for r in df.groupBy(y).agg(F.sum(weight)).collect()}
            total = sum(rows.values())
            return Fitted(self, features, classes, constant=[rows.get(k, 0.0) / total for k in range(classes)])
        mean = df.agg(F.sum(F.col(weight) * F.col(y)) / F.sum(weight)).first()[0]
        return Fitted(self, features, classes, constant=[float(mean)])

    def _linear(self, data, assemble, fitted) -> None:
        """Median fill, scaling to population deviation 1, L2 penalty of a C-form objective (C) or a ridge sum (alpha)."""
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.regression import LinearRegression

        x = assemble.transform(data).persist()
        n = x.count()
        scaler = StandardScaler(withMean=True, withStd=True, inputCol="__x", outputCol="__z").fit(x)
        z = scaler.transform(x)
        # the scaler divides by the sample deviation; the penalty is rescaled to the population one
        ratio = (n - 1) / n if n > 1 else 1.0
        if fitted.classes:
            reg = 1.0 / (self.params["C"] * n) * ratio
            model = LogisticRegression(featuresCol="__z", labelCol="__y", weightCol="__w", regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=self.params["max_iter"], family="multinomial" if fitted.classes > 2 else "auto").fit(z)
            coefficients = abs(model.coefficientMatrix.toArray()).mean(0)
        else:
            dev = z.agg(F.stddev_pop("__y")).first()[0] or 1.0
            model = LinearRegression(featuresCol="__z", labelCol="__y", weightCol="__w", solver="normal", elasticNetParam=0.0, standardization=False, regParam=self.params["alpha"] / n * dev * ratio).fit(z)
            coefficients = abs(model.coefficients.toArray())
        x.unpersist()
        fitted.pipeline, fitted.importances = PipelineModel([assemble, scaler, model]), list(map(float, coefficients))

    def _cells(self, data, fitted, es, kept) -> tuple[DataFrame | None, list[list[float]]]:
        """The training rows as cells, and the thresholds between their bins; no cells where few rows are alike."""
        key = ("cells", bool(es), self.params["max_bins"])
        if key not in kept:
            near, bounds = kept["near"], []
            for i, c in enumerate(fitted.features):
                n, known = near["n"], near[f"n{i}"]
                bounds.append(packed.edges(near[f"q{i}"][:-2], min(self.params["max_bins"], n), fitted.medians[c], 1 - known / n) if known else [])
            kept[key] = packed.pack(data, [f"__f_{i}" for i in range(len(bounds))], bounds, near["n"], fitted.classes, bool(es)), bounds
        return kept[key]

    def _trees(self, data, assemble, fitted, seed, es, kept) -> None:
        """Classes go by cells where rows are alike in their bins; otherwise the rows themselves are fitted."""
        from pyspark.ml import classification as C
        from pyspark.ml import regression as R

        p = self.params
        cells, bounds = self._cells(data, fitted, es, kept) if fitted.classes else (None, [])
        many = fitted.classes > 2 and self.name == "gbt"
        common = dict(featuresCol="__x", weightCol="__w", maxDepth=p["max_depth"], maxBins=p["max_bins"], seed=seed)
        if cells is not None:
            fitted.bounds = bounds
            top = max(2, int(cells.agg(F.max("__y")).first()[0]) + 1)
            if self.name == "forest":
                cells = packed.bags(cells, p["trees"], seed)
            x = VectorAssembler(inputCols=[f"__b_{i}" for i in range(len(bounds))], outputCol="__x").transform(cells)
            y = F.col("__y").alias("__y", metadata={"ml_attr": {"type": "nominal", "name": "__y", "vals": [str(k) for k in range(top)]}})
            x = x.select("__x", y, *([F.col("__w"), F.col("__bag")] if self.name == "forest" else [(F.col("__w") * F.col("__n")).alias("__w")]), *(["__es"] if es else []))
        else:
            x = assemble.transform(data)
        if self.name == "forest":
            kind = C.RandomForestClassifier if fitted.classes else R.RandomForestRegressor
            model = kind(labelCol="__y", numTrees=p["trees"], **common)
        else:
            kind = C.GBTClassifier if fitted.classes else R.GBTRegressor
            model = kind(labelCol="__y", maxIter=p["trees"], stepSize=p["step"], **common)
            if es:
                model = model.setValidationIndicatorCol("__es").setParams(validationTol=0.01)
        x = x.persist()

        def fit(rows: DataFrame):
            if cells is None:
                return model.fit(rows)
            if self.name == "forest":
                return packed.forest(rows, bounds, p["trees"], seed, top, common)
            return packed.boosted(model.fit(rows), bounds, rows.sparkSession)

        try:
            if many:
                fitted.members = [PipelineModel([assemble, fit(x.withColumn("__y", (F.col("__y") == k).cast("double")))]) for k in range(fitted.classes)]
                found = [m.stages[-1].featureImportances.toArray() for m in fitted.members]
                fitted.importances = [float(sum(f[i] for f in found) / len(found)) for i in range(len(fitted.features))]
            else:
                fitted.pipeline = PipelineModel([assemble, fit(x)])
                fitted.importances = list(map(float, fitted.pipeline.stages[-1].featureImportances.toArray()))
        finally:
            x.unpersist()


def release(kept: dict) -> None:
    """Drop the cells that models shared."""
    for key in [k for k in kept if isinstance(k, tuple)]:
        if (cells := kept.pop(key)[0]) is not None:
            cells.unpersist()


ALL = ("binary", "multiclass", "regression")
ZOO = {
    s.name: s
    for s in (
        ModelSpec("baseline", ALL, 0, handles_missing=True),
        ModelSpec("linear", ALL, 1, {"C": 1.0, "alpha": 1.0, "max_iter": 1000}, {"C": ("float", 0.01, 100.0, True), "alpha": ("float", 0.01, 100.0, True)}),
        ModelSpec("forest", ALL, 2, {"trees": 100, "max_depth": 8, "max_bins": 128}, {"trees": ("int", 50, 300, False), "max_depth": ("int", 4, 12, False)}),
        ModelSpec("gbt", ALL, 3, {"trees": 100, "step": 0.1, "max_depth": 5, "max_bins": 128}, {"trees": ("int", 50, 300, False), "step": ("float", 0.02, 0.3, True), "max_depth": ("int", 3, 8, False)}, early_stopping=True),
    )
}


def registry() -> dict[str, ModelSpec]:
    """The zoo and the models that installed packages register under the entry point group tabsel.models, by name."""
    out = dict(ZOO)
    for e in metadata.entry_points(group="tabsel.models"):
        out[e.name] = e.load()
    return dict(sorted(out.items()))


def choose(kind: str, names: list[str] | None = None) -> list[ModelSpec]:
    found = registry()
    if names and (stray := set(names) - set(found)):
        raise ConfigError(f"unknown models {sorted(stray)}")
    out = [s for n, s in found.items() if kind in s.kinds and (not names or n in names)]
    if not out:
        raise FitFailedError(f"no model suits a {kind} task")
    return out


def sample(space: dict, seed: int) -> dict:
    """One setting of the space, drawn from the seed alone."""
    rng, out = random.Random(seed), {}
    for name, (kind, lo, hi, log) in sorted(space.items()):
        u = rng.random()
        x = lo * (hi / lo) ** u if log else lo + (hi - lo) * u
        out[name] = int(round(x)) if kind == "int" else x
    return out
