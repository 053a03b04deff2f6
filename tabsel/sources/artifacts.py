"""Saved runs: manifest, schema, leaderboard and models with checksums; a portable form of linear models and trees."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict
from pathlib import Path

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import FeatureSchema, Task
from ..errors import IntegrityError, UnsupportedModel
from ..operators.calibration import Calibrator
from ..plans.automl import AutoML
from ..plans.models import Fitted, ModelSpec

FORMAT = 1


def _files(folder: Path) -> list[Path]:
    return sorted(p for p in folder.rglob("*") if p.is_file() and p.name != "manifest.json" and not p.name.endswith(".crc"))


def _digest(path: Path) -> str:
    return hashlib.sha256(path.read_bytes()).hexdigest()


def _canonical(d: dict) -> str:
    return hashlib.sha256(json.dumps(d, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def save(run: AutoML, folder: str) -> None:
    """Write what transform() needs and the report. The folder must be on a file system that this machine mounts."""
    root = Path(folder)
    root.mkdir(parents=True)
    (root / "schema.json").write_text(run.schema.to_json())
    (root / "report.json").write_text(json.dumps(run.report(), default=str, sort_keys=True))
    models = {}
    for name, m in run.models.items():
        models[name] = {"features": m.features, "classes": m.classes, "medians": m.medians, "constant": m.constant, "importances": m.importances, "spec": asdict(m.spec), "members": len(m.members) if m.members else 0}
        for i, p in enumerate([m.pipeline] if m.pipeline else m.members or []):
            p.write().save((root / f"model-{name}-{i}").absolute().as_uri())
    head = {"task": asdict(run.task), "labels": run.labels, "weights": run.weights, "models": models, "calibrator": asdict(run.calibrator) if run.calibrator else None}
    (root / "model.json").write_text(json.dumps(head, default=str, sort_keys=True))
    manifest = {"format": FORMAT, "spark": pyspark.__version__, "files": {str(p.relative_to(root)): _digest(p) for p in _files(root)}}
    manifest["digest"] = _canonical(manifest)
    (root / "manifest.json").write_text(json.dumps(manifest, sort_keys=True))


def verify(folder: str) -> dict:
    """The manifest, if every file is as it says and there are no others."""
    root = Path(folder)
    if not (root / "manifest.json").exists():
        raise IntegrityError(f"{folder} has no manifest")
    manifest = json.loads((root / "manifest.json").read_text())
    if manifest.get("format") != FORMAT:
        raise IntegrityError(f"format {manifest.get('format')} can't be read, only {FORMAT}")
    if _canonical({k: v for k, v in manifest.items() if k != "digest"}) != manifest.get("digest"):
        raise IntegrityError("the manifest was changed")
    for name in manifest["files"]:
        if Path(name).is_absolute() or ".." in Path(name).parts:
            raise IntegrityError(f"{name} lies outside the artifact")
    found = {str(p.relative_to(root)) for p in _files(root)}
    if found != set(manifest["files"]):
        raise IntegrityError(f"files differ from the manifest: {sorted(found ^ set(manifest['files']))[:5]}")
    if bad := [n for n, d in manifest["files"].items() if _digest(root / n) != d]:
        raise IntegrityError(f"changed: {bad[:5]}")
    return manifest


def load(folder: str, check: bool = True) -> AutoML:
    """A run that scores as the saved one; it can't be fitted on."""
    if check:
        verify(folder)
    root = Path(folder)
    head = json.loads((root / "model.json").read_text())
    task = Task(**head["task"])
    run = AutoML(task)
    run.schema, run.labels, run.weights = FeatureSchema.from_json((root / "schema.json").read_text()), head["labels"], head["weights"]
    run.calibrator = Calibrator(**{k: tuple(v) if isinstance(v, list) else v for k, v in head["calibrator"].items()}) if head["calibrator"] else None
    run.models = {}
    for name, m in head["models"].items():
        spec = ModelSpec(**{k: tuple(v) if k == "kinds" else v for k, v in m["spec"].items()})
        fitted = Fitted(spec, m["features"], m["classes"], medians=m["medians"], constant=m["constant"], importances=m["importances"])
        if m["members"]:
            fitted.members = [PipelineModel.load((root / f"model-{name}-{i}").absolute().as_uri()) for i in range(m["members"])]
        elif m["constant"] is None:
            fitted.pipeline = PipelineModel.load((root / f"model-{name}-0").absolute().as_uri())
        run.models[name] = fitted
    return run


def _tree(node, feature_of) -> object:
    """A tree as [feature, threshold, left, right] or [feature, [categories], left, right]; a leaf as its value."""
    if node.numDescendants() == 0:
        stats = list(node.impurityStats().stats())
        return [float(s) for s in stats], float(node.prediction())
    split = node.split()
    if split.getClass().getSimpleName() == "ContinuousSplit":
        return [feature_of(split.featureIndex()), float(split.threshold()), _tree(node.leftChild(), feature_of), _tree(node.rightChild(), feature_of)]
    raise UnsupportedModel("nominal splits have no portable form")


def export_portable(run: AutoML, path: str, sample: DataFrame, atol: float = 1e-5) -> dict:
    """Write the shipped model as plain JSON and refuse if its scores on the sample differ from the model's."""
    if len(run.models) != 1:
        raise UnsupportedModel("a blend has no portable form")
    (name, m), *_ = run.models.items()
    if m.constant is not None:
        raise UnsupportedModel("a baseline has no portable form")
    if m.classes > 2 or m.members:
        raise UnsupportedModel("several classes have no portable form")
    out = {"features": m.features, "medians": m.medians, "classes": m.classes}
    last = m.pipeline.stages[-1]
    if name == "linear":
        scaler = m.pipeline.stages[1]
        w = last.coefficients.toArray() / scaler.std.toArray().clip(1e-300)
        w[scaler.std.toArray() == 0] = 0.0
        out |= {"kind": "linear", "weights": w.tolist(), "intercept": float(last.intercept - w @ scaler.mean.toArray())}
    else:
        trees = [_tree(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode"), int) for t in last.trees]
        out |= {"kind": name, "trees": trees, "tree_weights": list(map(float, last.treeWeights))}
    Path(path).write_text(json.dumps(out))
    from ..operators.features import apply

    rows = apply(sample, run.schema)
    both = m.transform(rows).withColumn("__q", portable_score(out))
    gap = both.agg(F.max(F.abs(F.col("p") - F.col("__q")))).first()[0]
    if gap is None or gap > atol * (1 if m.classes else 100):
        Path(path).unlink()
        raise UnsupportedModel(f"the portable form differs by {gap}")
    return {"max_difference": gap}


def portable_score(model: dict) -> Column:
    """The score of an exported model as one expression."""
    x = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(model["medians"].get(c, 0.0))) for c in model["features"]]

    def walk(node) -> tuple[Column, Column]:
        if isinstance(node[0], list):
            total = sum(node[0])
            return F.lit(node[0][1] / total if len(node[0]) > 1 and total else node[1]), F.lit(node[1])
        left, right = walk(node[2]), walk(node[3])
        return tuple(F.when(x[node[0]] <= node[1], a).otherwise(b) for a, b in zip(left, right))

    if model["kind"] == "linear":
        out = F.lit(model["intercept"])
        for c, w in zip(x, model["weights"]):
            out = out + c * F.lit(w)
        return 1 / (1 + F.exp(-out)) if model["classes"] else out
    found = [walk(t) for t in model["trees"]]
    if model["kind"] == "forest":
        at = 0 if model["classes"] else 1
        return sum((f[at] for f in found[1:]), found[0][at]) / F.lit(float(len(found)))
    margin = sum((f[1] * F.lit(w) for f, w in zip(found[1:], model["tree_weights"][1:])), found[0][1] * F.lit(model["tree_weights"][0]))
    return 1 / (1 + F.exp(-2 * margin)) if model["classes"] else margin




def read_report(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json((Path(folder) / "report.json").absolute().as_uri())
