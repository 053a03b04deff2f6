"""Out-of-fold evaluation: candidates x folds, one long table of predictions, the leaderboard, the band and the winner."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BudgetExhausted, FitFailedError
from ..functions.metrics import METRICS, by_period
from ..operators import bootstrap
from ..operators.folds import group_es, iid_es
from .cells import stand_ins
from .models import ModelSpec, release


@dataclass
class Budget:
    """A clock, a number of candidates and the driver's memory, asked before each candidate."""

    time_s: float | None = None
    trials: int | None = None
    memory_mb: float | None = None
    started: float | None = None
    used: int = 0

    def spent(self) -> str | None:
        self.started = self.started or time.monotonic()
        if self.time_s is not None and time.monotonic() - self.started > self.time_s:
            return "time"
        if self.trials is not None and self.used >= self.trials:
            return "trials"
        if self.memory_mb is not None:
            import psutil

            if psutil.Process().memory_info().rss / 2**20 > self.memory_mb:
                return "memory"
        self.used += 1
        return None


@dataclass
class Result:
    leaderboard: list[dict]
    band: list[str]
    winner: str
    failed: list[dict] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    exhausted_by: str | None = None
    unstable: bool = False
    oof: DataFrame | None = None


def out_of_fold(spec: ModelSpec, data: DataFrame, features: list[str], classes: int, folds: DataFrame | None, k: int, seed: int, threads: int = 2, es_share: float = 0.0, group: str | None = None, kept: list[dict] | None = None, packed: bool = False) -> DataFrame:
    """(model_id, rid, fold, y, w, p or proba) of all folds.

    data has rid, y, w, the features, and fold, the fold that tests a row; or the fold table (rid, fold, part) says who
    trains where. Without a fold table es_share of the training rows (of each class, or of the groups) tell models that
    stop early when to stop. Folds run side by side; what is trained depends on seed, model and fold alone.
    kept: for each fold, what its models share. packed: without rid, and rows that a model can't tell apart may come as
    one with their weight.
    """
    keep = [*([] if packed else ["rid"]), "fold", "y", "w", "proba" if classes > 2 else "p"]

    def one(f: int) -> DataFrame | None:
        if folds is None:
            train, test, es = data.where(F.col("fold") != f), data.where(F.col("fold") == f), None
            if spec.early_stopping and es_share:
                carve = group_es(train, group, es_share) if group else iid_es(train, "rid", es_share, "y" if classes else None)
                train, es = carve.withColumn("__is_es", F.col("part") == "es").drop("part"), "__is_es"
        else:
            part = folds.where(F.col("fold") == f).select("rid", "part")
            own = data.drop("fold").join(part, "rid")
            test = own.where("part = 'test'").withColumn("fold", F.lit(f))
            train = own.where("part <> 'test'").withColumn("__is_es", F.col("part") == "es")
            es = "__is_es" if spec.early_stopping else None
        own = kept[f] if kept else {}
        if classes and "classes" not in own:
            own["classes"] = train.select("y").distinct().count()
        if classes and own["classes"] < 2:
            return None
        model = spec.fit(train, features, "y", "w", classes, seed, es, own if kept else None)
        if packed and kept and model.bounds is not None:
            key = ("test", spec.params["max_bins"])  # the bounds are those of the fold's training rows
            if key not in own:
                own[key] = (stand_ins(test, features, model.medians, model.bounds),)
            test = own[key][0]
        return model.transform(test).select(*keep)

    with ThreadPoolExecutor(threads) as pool:
        parts = [p for p in pool.map(one, range(k)) if p is not None]
    if not parts:
        raise FitFailedError(f"{spec.name}: no fold has two classes to train on")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("model_id", F.lit(spec.name))


def evaluate(specs: list[ModelSpec], data: DataFrame, features: list[str], classes: int, metric: str, k: int, folds: DataFrame | None = None, seed: int = 42, alpha: float = 0.05, n_boot: int = 1000, significance: str = "bootstrap", block: str | None = None, weighting: str = "pooled", budget: Budget | None = None, store: str | None = None, es_share: float = 0.0, group: str | None = None, keep: bool = True) -> Result:
    """The leaderboard of the specs; a candidate that fails is listed with its reason.

    store: a folder for the candidates' predictions, by model; those there with their commit mark are not made again.
    keep: whether the result has the predictions; without them, nor a store or a bootstrap, rows that a model can't tell
    apart are scored as one.
    """
    needed = {"rid", "fold", "y", "w", *features, *([block] if block else []), *([group] if group else [])}
    data = data.select(*(F.col(f"`{c}`") for c in data.columns if c in needed)).persist(StorageLevel.MEMORY_AND_DISK)
    spark, m = data.sparkSession, METRICS[metric]
    scored, scores, failed, skipped, by = {}, {}, [], [], None
    kept: list[dict] = [{} for _ in range(k)]
    alone = not keep and not store and significance != "bootstrap"  # predictions are scored and not seen again

    def score(oof: DataFrame) -> dict:
        found = by_period(m, oof, "fold", ["model_id"]) if weighting == "period" else m.score(oof, ["model_id"])
        return {r["model_id"]: r["score"] for r in found.collect()}

    for spec in specs:
        by = by or (budget.spent() if budget else None)
        if by:
            skipped.append(spec.name)
            continue
        spark.sparkContext.setJobDescription(f"candidate {spec.name}")
        try:
            path = f"{store}/model_id={spec.name}" if store else None
            if path and _done(spark, path):
                oof = spark.read.parquet(path).withColumn("model_id", F.lit(spec.name))
                scores |= score(oof)
                scored[spec.name] = oof
                continue
            oof = out_of_fold(spec, data, features, classes, folds, k, seed, es_share=es_share, group=group, kept=kept, packed=alone)
            if path:
                oof.drop("model_id").write.mode("overwrite").parquet(path)
                oof = spark.read.parquet(path).withColumn("model_id", F.lit(spec.name))
            elif not alone:
                oof = oof.persist(StorageLevel.MEMORY_AND_DISK)
            scores |= score(oof)  # errors of lazy work belong to this candidate
            scored[spec.name] = oof
        except Exception as e:  # a candidate's failure is a result
            failed.append({"model_id": spec.name, "reason": f"{type(e).__name__}: {str(e)[:200]}"})
    spark.sparkContext.setJobDescription(None)
    for own in kept:
        release(own)
    if not scored:
        raise BudgetExhausted(f"the {by} budget ended before any candidate") if by else FitFailedError(f"all candidates failed: {failed}")
    table = None
    for oof in scored.values():
        table = oof if table is None else table.unionByName(oof)
    if bad := [x for x in scored if scores.get(x) is None]:
        failed += [{"model_id": x, "reason": "the metric has no value"} for x in bad]
        scores = {k_: v for k_, v in scores.items() if v is not None}
    order = bootstrap.rank(scores, m.sign)
    if significance == "bootstrap":
        bootstrap.check_tail(alpha, n_boot)

        def same(a: str, b: str) -> bool:
            score = "proba" if classes > 2 else "p"
            pa = table.where(F.col("model_id") == a).select("rid", "y", "w", F.col(score).alias("pa"), *([block] if block else []))
            pb = table.where(F.col("model_id") == b).select("rid", F.col(score).alias("pb"))
            if weighting == "period":  # each block's difference weighs the same
                per = {(r["model_id"], r["fold"]): r["score"] for r in m.score(table.where(F.col("model_id").isin(a, b)), ["model_id", "fold"]).collect()}
                d = [per.get((a, f)) - per.get((b, f)) for f in sorted({f for _, f in per}) if per.get((a, f)) is not None and per.get((b, f)) is not None]
                return bootstrap.equivalent(bootstrap.block_deltas(np.array(d, float), n_boot, seed), alpha)
            return bootstrap.equivalent(bootstrap.deltas(pa.join(pb, "rid"), metric, n_boot, seed, block, "rid"), alpha)

        members = bootstrap.band(order, same)
    else:
        members = order[:1]
    rank = {s.name: (len(features), s.complexity) for s in specs}
    best = bootstrap.winner(members, rank, order)
    board = [{"model_id": x, "score": float(scores[x]), "rank": i + 1, "in_band": x in members, "is_winner": x == best} for i, x in enumerate(order)]
    return Result(board, members, best, failed, skipped, by, len(order) > 1 and order[1] in members, None if alone else table)


def refine(result: Result, metric: str, block: str = "fold", kind: str = "auto", least: int = 2000) -> str | None:
    """The candidate whose cross-fitted calibrated predictions have the least proper loss; None where a candidate has too few rows.

    All or nothing: scores are compared calibrated for all candidates, or left as they are.
    """
    from ..operators import calibration

    proper, losses = metric if metric in ("log_loss", "brier") else "log_loss", {}
    for r in result.leaderboard:
        rows = result.oof.where(F.col("model_id") == r["model_id"])
        if rows.count() < least or not calibration.viable_blocks(rows, block).where("not viable").isEmpty():
            return None
        mapped = calibration.crossfit(rows, block, kind).drop("p").withColumnRenamed("p_cal", "p")
        losses[r["model_id"]] = METRICS[proper].score(mapped).first()["score"]
    return min(losses, key=lambda x: (losses[x], x))


def _done(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
