"""Whether two candidates are equivalent: paired bootstrap of a metric's difference, and the band and tie-break on it."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.expressions import digest, uniform, with_rid
from ..functions.metrics import EDGES, confidence, row_value

log = logging.getLogger("tabsel")
MIN_TAIL, MIN_BLOCKS, FEW_BLOCKS = 50, 4, 8


def check_tail(alpha: float, n_boot: int) -> None:
    if not 0 < alpha < 1:
        raise ConfigError(f"alpha {alpha} is outside (0, 1)")
    if n_boot * alpha < MIN_TAIL:
        raise ConfigError(f"{n_boot} replicates leave too thin a tail for alpha {alpha}")


def equivalent(deltas: np.ndarray, alpha: float) -> bool:
    """Whether the percentile interval holds 0. Replicates without a score don't count; with none, or all alike: yes."""
    d = deltas[np.isfinite(deltas)]
    if not len(d) or np.ptp(d) == 0:
        return True
    lo, hi = np.percentile(d, [50 * alpha, 100 - 50 * alpha])
    return bool(lo <= 0 <= hi)


POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]


def poisson(u: Column) -> Column:
    """Poisson(1) by inversion, 6 at most."""
    return sum((u >= p).cast("int") for p in POISSON)


def poisson_sums(rows: DataFrame, key: str, values: list[str], n_boot: int, seed: int = 0) -> DataFrame:
    """(b, w, values...): sums under Poisson weights of md5 uniforms, for each replicate. Additive, so partial sums shuffle alone."""
    reps = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    reps = reps.withColumn("__w", poisson(uniform(F.concat_ws(":", "b", F.col(key).cast("string")), seed)))
    return reps.groupBy("b").agg(F.sum("__w").alias("w"), *(F.sum(F.col("__w") * F.col(v)).alias(v) for v in values))


_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: The least 64-bit hashes whose first 53 bits reach the bounds of POISSON.
_BOUNDS = [np.uint64(math.ceil(p * 2**53) << 11) for p in POISSON]


def times_of(base: np.ndarray, replicate: int) -> np.ndarray:
    """How often rows (or blocks) with these 64-bit numbers occur in a replicate: Poisson(1), 6 at most."""
    with np.errstate(over="ignore"):
        h = base + np.uint64(replicate) * _GOLDEN
        t = h >> np.uint64(30)
        h ^= t
        h *= _M1
        np.right_shift(h, np.uint64(27), out=t)
        h ^= t
        h *= _M2
        np.right_shift(h, np.uint64(31), out=t)
        h ^= t
    out = (h >= _BOUNDS[0]).view(np.uint8)
    for bound in _BOUNDS[1:]:
        out += (h >= bound).view(np.uint8)
    return out


def base_of(key: Column, seed: int) -> Column:
    """64 bits of the md5 of seed:key."""
    h = digest(key, seed)
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


#: Rows of a range are drawn in chunks of about so many, which stay in a core's cache.
CHUNK = 16_384
#: Rows of a range of scores, about.
RANGE_ROWS = 500_000


def _chunks(starts: np.ndarray, n: int) -> Iterator[tuple[int, int, bool]]:
    """(from, to, tied) over n rows by rising score, given where each score starts: whole scores of about CHUNK rows, or pieces of one score that has more."""
    bounds, at, i = np.append(starts, n), 0, 0
    while at < n:
        j = max(i + 1, int(np.searchsorted(bounds, at + CHUNK, side="right")) - 1)
        end = int(bounds[j])
        if j == i + 1 and end - at > CHUNK:
            yield from ((k, min(k + CHUNK, end), True) for k in range(at, end, CHUNK))
        else:
            yield at, end, False
        at, i = end, j


def _tie_sums(positive: np.ndarray, w: np.ndarray, base: np.ndarray, n_boot: int) -> np.ndarray:
    """(n_boot, 2): weight of the positives and of the others in each replicate."""
    out = np.zeros((n_boot, 2))
    for at in range(0, len(w), CHUNK):
        piece = slice(at, at + CHUNK)
        b, wp = base[piece], np.stack([w[piece] * positive[piece], w[piece] * ~positive[piece]], 1)
        for r in range(n_boot):
            out[r] += times_of(b, r) @ wp
    return out


def _inner_sums(p: np.ndarray, positive: np.ndarray, w: np.ndarray, base: np.ndarray, n_boot: int, above: np.ndarray | None = None) -> np.ndarray:
    """(n_boot, 3) of rows by rising score: ROC pairs, or with `above` (n_boot, 2: weights of higher scores) the sum of precisions; weight of the positives and of the others."""
    starts, out, seen = np.flatnonzero(np.append(True, p[1:] != p[:-1])), np.zeros((n_boot, 3)), np.zeros((n_boot, 2))
    chunks = list(_chunks(starts, len(p)))
    if above is not None:  # precision needs what lies above: from the highest score down
        total = _tie_sums(positive, w, base, n_boot) + above
    run = np.zeros((n_boot, 2))
    for i, (lo, hi, tied) in enumerate(chunks):
        wp, wn, b = w[lo:hi] * positive[lo:hi], w[lo:hi] * ~positive[lo:hi], base[lo:hi]
        if tied:
            run += _tie_sums(positive[lo:hi], w[lo:hi], b, n_boot)
            if i + 1 < len(chunks) and chunks[i + 1][2] and p[hi] == p[lo]:
                continue
            pos, neg = run.T
            out[:, 0] += pos * (seen[:, 1] + neg / 2) if above is None else pos * _share(total[:, 0] - seen[:, 0], (total - seen).sum(1))
            seen += run
            run = np.zeros((n_boot, 2))
            continue
        ends = np.append(starts[np.searchsorted(starts, lo, side="right") : np.searchsorted(starts, hi)], hi) - lo - 1
        alone = len(ends) == hi - lo
        for r in range(n_boot):
            t = times_of(b, r).astype(np.float64)
            cn, tp = np.cumsum(t * wn), t * wp
            if above is None and alone:  # no ties: a positive has no other of its own score
                total_pos = tp.sum()
                out[r, 0] += tp @ cn + total_pos * seen[r, 1]
            else:
                cp = np.cumsum(tp)
                total_pos, cn_at, cp_at = cp[-1], cn[ends], cp[ends]
                pos, neg = np.diff(cp_at, prepend=0.0), np.diff(cn_at, prepend=0.0)
                if above is None:
                    out[r, 0] += pos @ (cn_at - neg / 2) + total_pos * seen[r, 1]
                else:
                    hits, others = total[r, 0] - seen[r, 0] - cp_at + pos, total[r, 1] - seen[r, 1] - cn_at + neg
                    out[r, 0] += pos @ _share(hits, hits + others)
            seen[r] += total_pos, cn[-1]
    out[:, 1:] = seen
    return out


def _share(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.divide(a, n, out=np.zeros_like(a), where=n > 0)


def ranges(rows: DataFrame, score: str, label: Column, parts: int) -> DataFrame:
    """(y, p, w, base) in ranges of the score and, within a score, of a hash."""
    table = rows.select(label.cast("int").alias("y"), F.col(score).cast("double").alias("p"), F.col("w").cast("double").alias("w"), "base", "tie")
    return table.where("p is not null").repartitionByRange(parts, "p", "tie").drop("tie")


def _curve(rows: DataFrame, score: str, label: Column, n_boot: int, seed: int, metric: str) -> np.ndarray:
    """ROC or PR area of each replicate: rows lie in ranges of the score, of which only sums of a replicate leave a task.

    Equal scores may lie in several ranges, so that a frequent one isn't a task's burden: the weights of a range's first
    and last score leave it apart, are added up by score, and what lies between has whole scores.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    table = ranges(rows, score, label, parts)
    if metric == "pr_auc":
        table = table.persist()  # read twice, in the same ranges

    def collected(before: dict | None) -> list[tuple[float, bool, np.ndarray]]:
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [x for x in it if len(x)]
            if not held:
                return
            d = pd.concat(held)
            y, p, w, base = d["y"].to_numpy(), d["p"].to_numpy() + 0.0, d["w"].to_numpy(), d["base"].to_numpy().view(np.uint64)
            # an order of its own within equal scores, so that sums don't hang on how rows came
            order = np.lexsort((w, y, base, p))
            positive, p, w, base = y[order] == 1, p[order], w[order], base[order]
            first, last = int(np.searchsorted(p, p[0], side="right")), int(np.searchsorted(p, p[-1]))
            found = []
            if before is None:
                found += [(p[s.start], True, _tie_sums(positive[s], w[s], base[s], n_boot)) for s in ([slice(0, first)] + [slice(last, len(p))] * (last > 0))]
            if first < last:
                s = slice(first, last)
                found.append((p[first], False, _inner_sums(p[s], positive[s], w[s], base[s], n_boot, None if before is None else before[float(p[first])])))
            if found:
                yield pd.DataFrame({"lo": [x[0] for x in found], "tied": [x[1] for x in found], "sums": [x[2].tobytes() for x in found]})

        return [(lo, tied, np.frombuffer(sums).reshape(n_boot, -1)) for lo, tied, sums in table.mapInPandas(run, "lo double, tied boolean, sums binary").toPandas().itertuples(index=False)]

    try:
        found = collected(None)
        lows, inner = np.unique([x[0] for x in found]), np.zeros(len({x[0] for x in found}), bool)
        cube = np.zeros((len(lows), n_boot, 3))
        for lo, tied, sums in found:
            at = np.searchsorted(lows, lo)
            inner[at] |= not tied
            cube[at, :, 1 if tied else 0 :] += sums
        pos, neg = cube[..., 1], cube[..., 2]
        with np.errstate(invalid="ignore", divide="ignore"):
            if metric == "roc_auc":
                cube[~inner, :, 0] = (pos * neg / 2)[~inner]
                below = np.cumsum(neg, 0) - neg
                return (cube[..., 0] + pos * below).sum(0) / (pos.sum(0) * neg.sum(0))
            above = np.stack([np.cumsum(x[::-1], 0)[::-1] - x for x in (pos, neg)], -1)
            cube[..., 0] = pos * _share(pos + above[..., 0], pos + neg + above.sum(-1))
            for lo, _, sums in collected({float(lo): a for lo, a, i in zip(lows, above, inner) if i}) if inner.any() else []:
                cube[np.searchsorted(lows, lo), :, 0] = sums[:, 0]
            return np.where(pos.sum(0) * neg.sum(0) > 0, cube[..., 0].sum(0) / pos.sum(0), np.nan)
    finally:
        table.unpersist()


def _means(rows: DataFrame, values: dict[str, Column], n_boot: int) -> dict[str, np.ndarray]:
    """The weighted mean of each value in each replicate; sums alone leave a task."""
    names = list(values)
    table = rows.select(F.col("w").cast("double").alias("w"), "base", *(v.cast("double").alias(n) for n, v in values.items()))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((n_boot, 1 + len(names)))
        for d in it:
            base, v = d["base"].to_numpy().view(np.uint64), np.column_stack([np.ones(len(d)), *(d[n] for n in names)]) * d["w"].to_numpy()[:, None]
            for r in range(n_boot):
                out[r] += times_of(base, r) @ v
        yield pd.DataFrame({"b": range(n_boot)} | {n: out[:, i] for i, n in enumerate(["w", *names])})

    sums = table.mapInPandas(run, ", ".join(["b int", *(f"`{n}` double" for n in ["w", *names])]))
    found = sums.groupBy("b").agg(*(F.sum(n).alias(n) for n in ["w", *names])).orderBy("b").toPandas()
    with np.errstate(invalid="ignore", divide="ignore"):
        return {n: found[n].to_numpy() / found["w"].to_numpy() for n in names}


def _numbered(rows: DataFrame, seed: int, block: str | None, key: str | None) -> DataFrame:
    """rows with base, the number that decides how often a row (or its block) is drawn."""
    if block:
        return rows.withColumn("base", base_of(F.coalesce(F.col(block).cast("string"), F.lit("")), seed))
    if key:
        return rows.withColumn("base", base_of(F.col(key), seed))
    return with_rid(rows, None, "__key").withColumn("base", base_of(F.col("__key"), seed))


def deltas(rows: DataFrame, metric: str, n_boot: int = 1000, seed: int = 0, block: str | None = None, key: str | None = None) -> np.ndarray:
    """Differences of the metric of pa and pb over n_boot replicates of rows (y, pa, pb, w), or of whole blocks.

    A row, or with `block` all rows of a block, occurs Poisson(1) times in a replicate, by the hash of its key (`key`, or
    the row's content) or block: the same for any partitioning and number of rows. pa and pb are scores, or with several
    classes arrays of probabilities. Weights w are positive. Replicates without a score are NaN.
    """
    rows = _numbered(rows, seed, block, key)
    many = rows.schema["pa"].dataType.typeName() == "array"
    if metric in ("roc_auc", "pr_auc"):
        # read several times, so kept; a hash of the row spreads equal scores of one block
        rows = rows.select("y", "w", "pa", "pb", "base", F.xxhash64(*rows.columns).alias("tie")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if not many:
                score = lambda c: _curve(rows, c, F.col("y") == 1, n_boot, seed, metric)
                return score("pa") - score("pb")
            classes = rows.select(F.max(F.size("pa"))).first()[0] or 0
            each = []
            for k in range(classes):
                one = rows.withColumns({c: F.element_at(c, k + 1) for c in ("pa", "pb")})
                each.append(_curve(one, "pa", F.col("y") == k, n_boot, seed, metric) - _curve(one, "pb", F.col("y") == k, n_boot, seed, metric))
            return np.mean(each, 0)
        finally:
            rows.unpersist()
    if metric == "ece":
        return _ece(rows, "pa", many, n_boot) - _ece(rows, "pb", many, n_boot)
    found = _means(rows, {c: row_value(metric, F.col(c), F.col("y"), many) for c in ("pa", "pb")}, n_boot)
    return np.sqrt(found["pa"]) - np.sqrt(found["pb"]) if metric == "rmse" else found["pa"] - found["pb"]


def _ece(rows: DataFrame, c: str, many: bool, n_boot: int) -> np.ndarray:
    binned = confidence(rows.select("y", "w", "base", F.col(c).alias("proba" if many else "p")))
    gap = F.col("right") - F.col("conf")
    found = _means(binned, {f"g{i}": F.when(F.col("bin") == i, gap).otherwise(0.0) for i in range(len(EDGES) - 1)}, n_boot)
    return np.sum([np.abs(v) for v in found.values()], 0)


def poisson_deltas(rows: DataFrame, metric: str, n_boot: int, seed: int) -> np.ndarray:
    """deltas() of rows, none of which has a key."""
    return deltas(rows, metric, n_boot, seed)


def block_deltas(scores: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """Means of resampled per-block differences; at least MIN_BLOCKS blocks."""
    d = scores[np.isfinite(scores)]
    if len(d) < MIN_BLOCKS:
        raise ConfigError(f"{len(d)} blocks with a score are too few, {MIN_BLOCKS} are needed")
    if len(d) < FEW_BLOCKS:
        log.warning("%d blocks give a coarse interval", len(d))
    rng = np.random.default_rng(seed)
    return d[rng.integers(0, len(d), (n_boot, len(d)))].mean(1)


def rank(scores: dict[str, float], sign: int) -> list[str]:
    return sorted(scores, key=lambda m: (-sign * scores[m], m))


def band(order: list[str], is_equivalent) -> list[str]:
    """The best and all that the test can't tell from it."""
    return [m for i, m in enumerate(order) if not i or is_equivalent(order[0], m)]


def winner(members: list[str], complexity: dict[str, tuple], order: list[str]) -> str:
    """The simplest of the band: fewest features, lowest model rank, then the better place; never by wall clock."""
    return min(members, key=lambda m: (complexity.get(m, (0, 0)), order.index(m)))
