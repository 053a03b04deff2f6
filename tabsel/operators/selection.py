"""Feature selection on importances that models return; the tables stay on the executors."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.expressions import uniform


def stable_seed(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=4).digest(), "big")


def normalise(importances: np.ndarray) -> np.ndarray:
    """Shares; signed scores stay as they are."""
    total = np.abs(importances).sum()
    return importances if (importances < 0).any() or not total else importances / total


def cutoff(scores: np.ndarray, how: str = "top_frac", k: int | None = None, fraction: float = 0.5, threshold: float | None = None, floor: int = 1) -> list[int]:
    """Positions of the features that stay, in column order; at least `floor` of the best."""
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    if how == "top_k":
        n = k if k is not None else len(order)
    elif how == "top_frac":
        n = math.ceil(fraction * len(order))
    elif how == "auto":
        n = sum(s > (1 / len(scores) if threshold is None else threshold) for s in scores)
    else:
        raise ConfigError(f"cutoff {how!r} is none of top_k, top_frac, auto")
    return sorted(order[: min(len(order), max(n, floor, 1))])


def probes(df: DataFrame, key: str, n: int = 3, seed: int = 0) -> DataFrame:
    """df with n random columns that depend on the key alone."""
    return df.withColumns({f"__probe{i}": uniform(F.col(key), f"probe{seed}:{i}") for i in range(n)})


def null_margin(real: np.ndarray, shuffled: np.ndarray, percentile: float = 95) -> np.ndarray:
    """Importance above the percentile of those under permuted targets (runs x features)."""
    return real - np.percentile(shuffled, percentile, axis=0)


def probe_margin(real: np.ndarray, probe: np.ndarray) -> np.ndarray:
    return real - probe.max()


def sequential(n: int, score, minimum: int = 1, patience: int = 2) -> tuple[list[int], list[tuple[list[int], float]]]:
    """Greedy backward elimination: (best subset, trajectory). score(subset) is greater-better; ties drop the later column."""
    kept = list(range(n))
    best, best_set, worse = score(kept), list(kept), 0
    path = [(list(kept), best)]
    while len(kept) > minimum and worse < patience:
        trials = [(score([x for x in kept if x != i]), i) for i in kept]
        s, i = max(trials, key=lambda t: (t[0], t[1]))
        kept = [x for x in kept if x != i]
        path.append((list(kept), s))
        if s >= best:
            best, best_set, worse = s, list(kept), 0
        else:
            worse += 1
    return best_set, path


def mean_jaccard(sets: list[set]) -> float:
    pairs = [(a, b) for i, a in enumerate(sets) for b in sets[i + 1 :]]
    return float(np.mean([len(a & b) / len(a | b) if a | b else 1.0 for a, b in pairs])) if pairs else 1.0


def refits(strategy: str, folds: int, p: int, runs: int = 30, minimum: int = 1) -> int:
    """Model fits that a strategy costs."""
    if strategy in ("importance", "random_probe", "permutation"):
        return folds
    if strategy == "null_importance":
        return folds * (runs + 1)
    if strategy == "sequential":
        return folds * (1 + sum(range(minimum + 1, p + 1)))
    raise ConfigError(f"unknown strategy {strategy!r}")
