"""Blends of candidates: greedy selection, simplex weights, and the gate before a blend is shipped."""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import METRICS


def blend(columns: list[Column], weights: list[float]) -> Column:
    out = columns[0] * F.lit(float(weights[0]))
    for c, w in zip(columns[1:], weights[1:]):
        out = out + c * F.lit(float(w))
    return out


def blend_arrays(columns: list[Column], weights: list[float]) -> Column:
    def plus(acc: Column, c: Column, w: float) -> Column:
        return F.zip_with(acc, c, lambda a, b: a + b * F.lit(float(w)))

    out = F.transform(columns[0], lambda x: x * F.lit(float(weights[0])))
    for c, w in zip(columns[1:], weights[1:]):
        out = plus(out, c, w)
    return out


def common_rows(oof: DataFrame, models: int, key: str = "rid") -> DataFrame:
    """(key): rows that all models predicted."""
    return oof.groupBy(key).agg(F.count_distinct("model_id").alias("m")).where(F.col("m") == models).select(key)


def wide(oof: DataFrame, models: list[str], key: str = "rid") -> DataFrame:
    """(key, y, w, m0, m1, ...): predictions side by side, for the rows that all models predicted."""
    out = oof.groupBy(key).pivot("model_id", models).agg(F.first("proba" if "proba" in oof.columns else "p"))
    base = oof.groupBy(key).agg(F.first("y").alias("y"), F.first("w").alias("w"))
    named = out.select(key, *(F.col(f"`{m}`").alias(f"m{i}") for i, m in enumerate(models)))
    return base.join(named, key).dropna(subset=[f"m{i}" for i in range(len(models))])


def score_blends(table: DataFrame, blends: list[list[float]], m: int, metric: str) -> list[float]:
    """Scores of all blends in one job."""
    columns = [F.col(f"m{i}") for i in range(m)]
    many = table.schema["m0"].dataType.typeName() == "array"
    long = table.select("y", "w", F.posexplode(F.array(*((blend_arrays if many else blend)(columns, b) for b in blends))).alias("b", "proba" if many else "p"))
    found = {r["b"]: r["score"] for r in METRICS[metric].score(long, ["b"]).collect()}
    return [found[i] for i in range(len(blends))]


def caruana(table: DataFrame, m: int, metric: str, size: int = 50, bags: int = 20, seed: int = 42, score=None) -> list[float]:
    """Weights by greedy selection with replacement in `bags` random halves of the library, each at its best step, averaged.

    score(blends) -> scores may replace the default, one Spark job a step.
    """
    sign, rng = METRICS[metric].sign, np.random.default_rng(seed)
    score = score or (lambda b: score_blends(table, b, m, metric))
    total = np.zeros(m)
    for _ in range(bags):
        library = sorted(rng.choice(m, max(1, (m + 1) // 2), replace=False)) if m > 1 else [0]
        counts, best, best_counts = np.zeros(m), -np.inf, None
        for step in count(1):
            if step > size:
                break
            trials = []
            for i in library:
                c = counts.copy()
                c[i] += 1
                trials.append(list(c / c.sum()))
            scores = [sign * s for s in score(trials)]
            i = int(np.argmax(scores))  # the first of equals
            counts[library[i]] += 1
            if scores[i] > best + 1e-12:
                best, best_counts = scores[i], counts.copy()
            elif len(library) == 1:
                break
        total += best_counts / best_counts.sum()
    return list(total / total.sum())


def simplex_weights(table: DataFrame, m: int, metric: str = "log_loss", steps: int = 60, rate: float = 2.0) -> list[float]:
    """Weights that are non-negative and sum to 1, by exponentiated gradient; a step is one aggregate."""
    w, columns = np.full(m, 1 / m), [F.col(f"m{i}") for i in range(m)]
    best, best_w = np.inf, w
    for _ in range(steps):
        p = F.least(F.greatest(blend(columns, list(w)), F.lit(1e-12)), F.lit(1 - 1e-12))
        y = F.col("y").cast("double")
        loss, slope = (-(y * F.ln(p) + (1 - y) * F.ln(1 - p)), (p - y) / (p * (1 - p))) if metric == "log_loss" else ((p - y) * (p - y), 2 * (p - y))
        r = table.agg(F.sum(F.col("w") * loss) / F.sum("w"), *(F.sum(F.col("w") * slope * c) / F.sum("w") for c in columns)).first()
        if r[0] < best - 1e-12:
            best, best_w = r[0], w
        g = np.array(r[1:], float)
        w = w * np.exp(-rate * (g - g.min()) / max(np.ptp(g), 1e-9))
        w, rate = w / w.sum(), rate * 0.93
    return list(best_w)


def decide(weights: list[float], n_common: int, blend_score: float, best_score: float, sign: int, is_equivalent: bool) -> tuple[bool, str]:
    """Whether the blend ships, and why (not)."""
    if len(weights) < 2:
        return False, "single_candidate"
    if n_common < 2:
        return False, "too_few_common_rows"
    if sum(w > 1e-6 for w in weights) < 2:
        return False, "degenerate_recipe"
    if is_equivalent:
        return False, "equivalent_to_best"
    if sign * (blend_score - best_score) <= 0:
        return False, "not_better"
    return True, "better"
