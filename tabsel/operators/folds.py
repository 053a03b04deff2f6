"""Splits as columns: every scheme adds or derives fold membership by expressions; rows are never gathered by index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, SchemaError
from ..functions.expressions import digest, uniform

#: Rows are numbered in ranges of their order of about so many rows.
EXACT_ROWS = 5_000_000
#: Rows in md5 order are numbered in so many ranges of the hash.
RANGES = 256
#: Tables of at most so many periods go to every task.
BROADCAST_PERIODS = 200_000


def hash_places(df: DataFrame, key: str, seed: int, by: list[str] | None = None, name: str = "place") -> DataFrame:
    """df with the place from 0 in md5 order within `by`. No task orders them all: ranges of the hash are numbered apart."""
    by = by or []
    parts = df.withColumn("__range", F.floor(uniform(F.col(key), seed) * RANGES).cast("int"))
    cells = [*by, "__range"]
    sizes = parts.groupBy(*cells).agg(F.count("*").alias("c"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    own = F.row_number().over(Window.partitionBy(*cells).orderBy(digest(F.col(key), seed), key)) - 1
    right = before.toDF(*(f"__r{i}" for i in range(len(cells))), "__before")
    same = [parts[c].eqNullSafe(right[f"__r{i}"]) for i, c in enumerate(cells)]
    out = parts.withColumn(name, own).join(right, same).withColumn(name, F.col(name) + F.col("__before"))
    return out.drop("__before", "__range", *(f"__r{i}" for i in range(len(cells))))


def holdout(df: DataFrame, key: str, fraction: float = 0.25, stratify: str | None = None, seed: int = 42) -> DataFrame:
    """df with is_test: the first ceil(fraction n) rows of each class in md5 order. Without classes, of all rows, by hash share."""
    if stratify is None:
        return df.withColumn("is_test", uniform(F.col(key), seed) < fraction)
    sizes = df.groupBy(F.col(stratify).alias("__class")).agg(F.ceil(F.lit(fraction) * F.count("*")).alias("__take"))
    placed = hash_places(df, key, seed, [stratify], "__place")
    both = placed.join(sizes, placed[stratify].eqNullSafe(sizes["__class"]))
    return both.withColumn("is_test", F.col("__place") < F.col("__take")).drop("__place", "__class", "__take")


def stratified_kfold(df: DataFrame, key: str, y: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """df with fold 0..k-1: rows of each class dealt out in md5 order."""
    return hash_places(df, key, seed, [y], name).withColumn(name, (F.col(name) % k).cast("int"))


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, name: str = "fold", exact: bool = True) -> DataFrame:
    """df with fold 0..k-1: equal parts in md5 order, or with exact=False hash buckets, which need no shuffle."""
    if not exact:
        return df.withColumn(name, F.floor(uniform(F.col(key), seed) * k).cast("int"))
    return hash_places(df, key, seed, name=name).withColumn(name, (F.col(name) % k).cast("int"))


def snake(place: Column, k: int) -> Column:
    """0..k-1, k-1..0, 0..k-1, ... by place from 0."""
    turn, at = (place / k).cast("long") % 2, place % k
    return F.when(turn == 0, at).otherwise(k - 1 - at)


def deal(sizes: list[tuple[tuple[int, ...], int]], k: int) -> list[tuple[list[int], list[int]]]:
    """For each kind of group (rows by class, number of such groups): the folds of the first of them, and the folds that the others take in turn.

    Kinds come largest first. One class: each group goes to the fold with the fewest rows so far; once the folds differ
    by no more than a group, this is a turn. Several: to the fold where the classes' shares become most even; of many
    groups of a kind only so many are dealt that the turns of the others come out even.
    """
    if not sizes:
        return []
    classes = len(sizes[0][0])
    totals = np.maximum(sum(np.array(v, float) * n for v, n in sizes), 1)
    load, out = np.zeros((k, classes)), []
    for own, n in sizes:
        v, first = np.array(own, float), []
        while len(first) < n:
            left = n - len(first)
            rows = load.sum(1)
            if classes == 1 and np.ptp(rows) <= v[0] or classes > 1 and left % k == 0 and left > 0 and len(first) >= 8 * k:
                break
            if classes == 1:
                f = int(rows.argmin())
            else:
                share = load / totals
                spread = [np.var(np.where(np.arange(k)[:, None] == f, share + v / totals, share), axis=0).sum() for f in range(k)]
                f = min(range(k), key=lambda i: (round(spread[i], 12), rows[i], i))
            first.append(f)
            load[f] += v
        turn = [int(f) for f in np.lexsort((np.arange(k), load.sum(1)))]
        left = n - len(first)
        for i, f in enumerate(turn):
            load[f] += v * (left // k + (i < left % k))
        out.append((first, turn))
    return out


def group_kfold(df: DataFrame, group: str, k: int = 5, name: str = "fold", y: str | None = None) -> DataFrame:
    """df with fold 0..k-1, whole groups together.

    Groups go, largest first, to the fold with the fewest rows so far (with y: where the class counts become most even).
    Groups alike in their counts are one row for the driver, which deals kinds; a group takes its fold by its place among
    those of its kind.
    """
    if y is None:
        kinds = df.groupBy(group).agg(F.array(F.count("*")).alias("__kind"))
    else:
        labels = [r[0] for r in df.select(y).distinct().orderBy(y).collect()]
        kinds = df.groupBy(group).agg(F.array(*(F.count_if(F.col(y).eqNullSafe(F.lit(label))) for label in labels)).alias("__kind"))
    found = sorted(((tuple(r["__kind"]), r["n"]) for r in kinds.groupBy("__kind").agg(F.count("*").alias("n")).toLocalIterator()), key=lambda r: (-sum(r[0]), r[0]))
    table = [(list(kind), first, turn) for (kind, _), (first, turn) in zip(found, deal(found, k))]
    dealt = df.sparkSession.createDataFrame(table, "__kind array<bigint>, __first array<int>, __turn array<int>")
    placed = hash_places(kinds, group, 0, ["__kind"], "__place").join(dealt, "__kind")
    n = F.size("__first")
    fold = F.when(F.col("__place") < n, F.get("__first", F.col("__place").cast("int"))).otherwise(F.get("__turn", ((F.col("__place") - n) % k).cast("int")))
    groups = placed.select(F.col(group).alias("__group"), fold.cast("int").alias(name))
    return df.join(groups, df[group].eqNullSafe(groups["__group"])).drop("__group")


def snake_groups(df: DataFrame, group: str, k: int = 5, name: str = "fold") -> DataFrame:
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), group)) - 1  # one row a group
    return df.join(sizes.select(group, snake(place, k).cast("int").alias(name)), group)


def ordinal(df: DataFrame, c: str) -> Column:
    """A number that rises with a column's values: the value, its microseconds, or of a string the first six bytes."""
    kind = df.schema[c].dataType.typeName()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    if kind == "string":
        return F.conv(F.hex(F.substring(F.rpad(F.encode(F.col(c), "UTF-8"), 6, F.lit(b"\0")), 1, 6)), 16, 10).cast("double")
    return F.col(c).cast("double")


def positions(df: DataFrame, time: str, key: str, name: str = "pos", rows: int | None = None) -> DataFrame:
    """df with the place from 0 by (time, key).

    No task orders them all: ranges of time, of about EXACT_ROWS rows, are numbered apart, and the sizes of the ranges
    before are added. A row's range is an expression of its time, so it is the same whenever it is computed.
    """
    n = (df.count() if rows is None else rows) // EXACT_ROWS
    at = ordinal(df, time)
    edges = sorted(set(df.agg(F.percentile_approx(at, [(i + 1) / (n + 1) for i in range(n)], 10_000)).first()[0] or [])) if n else []
    part = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)).cast("array<double>"), lambda e: e <= at)) if edges else F.lit(0)
    parts = df.withColumn("__part", F.coalesce(part, F.lit(-1)))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("c"))
    before = sizes.withColumn("offset", F.coalesce(F.sum("c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(time, key)) - 1
    # a row for each range
    return parts.withColumn(name, own).join(before, "__part").withColumn(name, F.col(name) + F.col("offset")).drop("__part", "offset")


def instant(df: DataFrame, c: str) -> Column:
    """A time as a number: microseconds for dates and timestamps."""
    kind = df.schema[c].dataType.typeName()
    if kind in ("date", "timestamp_ntz"):
        return F.unix_micros(F.col(c).cast("timestamp"))
    return F.col(c)


def before_cut(t: Column, cut, purge_delta=None) -> Column:
    return t < cut if purge_delta is None else (t < cut) & (F.lit(cut) - t > purge_delta)


def time_folds(df: DataFrame, time: str, key: str, k: int = 5, n_test: int = 1, n_es: int = 1, purge: int = 0, embargo: int = 0, purge_delta=None, embargo_delta=None, max_train: int | None = None, label_time: str | None = None) -> DataFrame:
    """(key, fold, part): rows in time order, the last k * n_test tested in k windows, each trained on what comes before.

    Gaps: `purge` rows before a test, `embargo` rows after earlier tests, or the same by time (deltas); strictly earlier
    times only; label_time must end before the test. The last n_es training rows are part 'es'.
    """
    if purge and purge_delta is not None or embargo and embargo_delta is not None:
        raise ConfigError("a gap is counted in rows or in time, not both")
    t = df.select(key, instant(df, time).alias("t"), *([instant(df, label_time).alias("t1")] if label_time else []))
    t = positions(t, "t", key).persist()
    n = t.count()
    first = n - k * n_test
    if min(first - purge, max_train if max_train is not None else n) < n_es + 1:
        raise SchemaError(f"{n} rows are too few for {k} time folds")
    bounds = [(first + i * n_test, first + (i + 1) * n_test) for i in range(k)]
    pos = F.col("pos")
    window = F.floor((pos - first) / n_test)
    edges = {int(r["i"]): (r["lo"], r["hi"]) for r in t.where(pos >= first).groupBy(window.alias("i")).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    members = []
    for i, (start, stop) in enumerate(bounds):
        hi = start - purge
        train = (pos < hi) & before_cut(F.col("t"), edges[i][0], purge_delta)
        if max_train is not None:
            train &= pos >= hi - max_train
        for j in range(i):
            if embargo and bounds[j][1] < hi:
                train &= ~pos.between(bounds[j][1], bounds[j][1] + embargo - 1)
            if embargo_delta is not None:
                train &= ~((F.col("t") >= edges[j][1]) & (F.col("t") < edges[j][1] + embargo_delta))
        if label_time:
            train &= F.col("t1") < edges[i][0]
        members.append(F.when((pos >= start) & (pos < stop), F.struct(F.lit(i).alias("fold"), F.lit("test").alias("part"))).when(train, F.struct(F.lit(i).alias("fold"), F.lit("train").alias("part"))))
    return carve_es(_long(t, members, key, "t"), key, n_es)


def _long(t: DataFrame, members: list[Column], key: str, time: str) -> DataFrame:
    return t.select(key, F.col(time).alias("__t"), F.explode(F.filter(F.array(*members), lambda m: m.isNotNull())).alias("m")).select(key, "__t", "m.fold", "m.part")


def carve_es(folds: DataFrame, key: str, n_es: int) -> DataFrame:
    """(key, fold, part): the latest n_es training rows of each fold become 'es', the others 'fit'; one row stays 'fit' at least.

    No task orders a fold: only rows later than an approximate percentile of the times are ranked, to find the (time, key)
    from which a fold's rows are 'es', a value for the driver; the rows are labelled where they are.
    """
    train = folds.where("part <> 'test'")
    n = {r["fold"]: r["n"] for r in train.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    es = {f: max(0, min(n_es, c - 1)) for f, c in n.items()}
    if not any(es.values()):
        return folds.select(key, "fold", F.when(F.col("part") == "test", "test").otherwise("fit").alias("part"))
    # the percentile's rank error is a 10,000th of the rows; twice that below the wanted rank is safe
    of_fold = lambda values, kind: F.try_element_at(F.create_map(*(F.lit(x) for f, v in values.items() for x in (f, v))), F.col("fold")).cast(kind)
    kind = folds.schema["__t"].dataType
    shares = {f: max(0.0, 1 - es[f] / c - 2e-4) for f, c in n.items()}
    lows = train.groupBy("fold").agg(F.percentile_approx("__t", sorted(set(shares.values())), 10_000).alias("q")).collect()
    at = {s: i for i, s in enumerate(sorted(set(shares.values())))}
    late = train.where(F.col("__t") >= of_fold({r["fold"]: r["q"][at[shares[r["fold"]]]] for r in lows}, kind))
    cut = {r["fold"]: (r["t"], r["k"]) for r in _nth_latest(late, key, of_fold(es, "long")).collect()}
    if short := [f for f, e in es.items() if e and f not in cut]:  # beyond the percentile's error: rank all rows of these folds
        cut |= {r["fold"]: (r["t"], r["k"]) for r in _nth_latest(train.where(F.col("fold").isin(short)), key, of_fold(es, "long")).collect()}
    t, k = of_fold({f: c[0] for f, c in cut.items()}, kind), of_fold({f: c[1] for f, c in cut.items()}, folds.schema[key].dataType)
    is_es = (F.col("__t") > t) | (F.col("__t") == t) & (F.col(key) >= k)
    part = F.when(F.col("part") == "test", "test").when(is_es, "es").otherwise("fit")
    return folds.select(key, "fold", part.alias("part"))


def _nth_latest(rows: DataFrame, key: str, n: Column) -> DataFrame:
    """(fold, t, k): time and key of the n-th latest row of each fold that has as many."""
    w = Window.partitionBy("fold").orderBy(F.desc("__t"), F.desc(key))
    return rows.withColumn("__late", F.row_number().over(w)).where(F.col("__late") == n).select("fold", F.col("__t").alias("t"), F.col(key).alias("k"))


def period_key(df: DataFrame, time: str, period: str, size: float | None = None) -> Column:
    """Raw period number of a row: month, week (from Monday), day, or steps of `size` from the smallest time ('delta')."""
    c = F.col(time)
    if period == "month":
        return (F.year(c) - 1970) * 12 + F.month(c) - 1
    if period == "week":
        return F.floor(F.datediff(F.to_date(F.date_trunc("week", c)), F.lit("1970-01-05").cast("date")) / 7)
    if period == "day":
        return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    if period == "delta":
        if not size or size <= 0:
            raise ConfigError("period 'delta' needs a positive size")
        x = instant(df, time)
        low = df.agg(F.min(x)).first()[0]
        return F.floor((x - F.lit(low)) / size)
    raise ConfigError(f"period {period!r} is none of month, week, day, delta")


def dense_periods(df: DataFrame, time: str, period: str, size: float | None = None, name: str = "period") -> DataFrame:
    """df with the dense number of its period. The periods are numbered on their distinct values and joined back."""
    raw = df.withColumn("__raw", period_key(df, time, period, size))
    table = raw.select("__raw").distinct().withColumn(name, F.row_number().over(Window.orderBy("__raw")) - 1)
    # long periods are few and hold many rows, which a shuffle by period would put into one task
    few = period != "delta" or table.count() <= BROADCAST_PERIODS
    return raw.join(F.broadcast(table) if few else table, "__raw").drop("__raw")


def period_meta(df: DataFrame, time: str, period: str, size: float | None = None) -> DataFrame:
    """(n_periods, n_dropped_empty)."""
    raw = df.select(period_key(df, time, period, size).alias("r"))
    return raw.agg(F.count_distinct("r").alias("n_periods"), (F.max("r") - F.min("r") + 1 - F.count_distinct("r")).alias("n_dropped_empty"))


def period_folds(df: DataFrame, time: str, key: str, period: str, k: int = 5, n_test: int = 1, step: int | None = None, n_es: int = 1, purge: int = 0, embargo: int = 0, purge_delta=None, embargo_delta=None, max_train_periods: int | None = None, size: float | None = None, label_time: str | None = None) -> DataFrame:
    """(key, fold, part) over whole periods; the last test ends with the last period, earlier ones lie `step` periods before."""
    step = step or n_test
    t = dense_periods(df, time, period, size).select(key, "period", instant(df, time).alias("t"), *([instant(df, label_time).alias("t1")] if label_time else [])).persist()
    stats = {r["period"]: (r["lo"], r["hi"]) for r in t.groupBy("period").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    n = len(stats)
    first = n - n_test - (k - 1) * step
    if first - purge < 1:
        raise SchemaError(f"{n} periods are too few for {k} folds")
    bounds = [(first + i * step, first + i * step + n_test) for i in range(k)]
    lo, hi = (lambda a, b: min(stats[p][0] for p in range(a, b))), (lambda a, b: max(stats[p][1] for p in range(a, b)))
    p, members = F.col("period"), []
    for i, (start, stop) in enumerate(bounds):
        cut = lo(start, stop)
        train = (p < start - purge) & before_cut(F.col("t"), cut, purge_delta)
        if max_train_periods is not None:
            train &= p >= start - max_train_periods
        for j in range(i):
            if embargo:
                train &= ~p.between(bounds[j][1], bounds[j][1] + embargo - 1)
            if embargo_delta is not None:
                top = hi(*bounds[j])
                train &= ~((F.col("t") >= top) & (F.col("t") < top + embargo_delta))
        if label_time:
            train &= F.col("t1") < cut
        members.append(F.when((p >= start) & (p < stop), F.struct(F.lit(i).alias("fold"), F.lit("test").alias("part"))).when(train, F.struct(F.lit(i).alias("fold"), F.lit("train").alias("part"))))
    return carve_es(_long(t, members, key, "t"), key, n_es)


def carve_time(df: DataFrame, time: str, key: str, fraction: float, purge: int = 0, purge_delta=None, label_time: str | None = None) -> DataFrame:
    """(key, part): the latest max(1, round(fraction n)) rows are 'holdout', earlier ones outside the gaps 'dev'."""
    t = positions(df.select(key, instant(df, time).alias("t"), *([instant(df, label_time).alias("t1")] if label_time else [])), "t", key)
    n = df.count()
    h = max(1, round(fraction * n))
    cut = t.where(F.col("pos") >= n - h).agg(F.min("t")).first()[0]
    dev = (F.col("pos") < n - h - purge) & before_cut(F.col("t"), cut, purge_delta)
    if label_time:
        dev &= F.col("t1") < cut
    return t.select(key, F.when(F.col("pos") >= n - h, "holdout").when(dev, "dev").alias("part")).where("part is not null")


def carve_period(df: DataFrame, time: str, key: str, fraction: float, period: str, purge: int = 0, purge_delta=None, size: float | None = None) -> DataFrame:
    """(key, part): the fewest latest whole periods with at least that fraction of the rows are 'holdout'."""
    t = dense_periods(df, time, period, size).select(key, "period", instant(df, time).alias("t"))
    stats = {r["period"]: (r["n"], r["lo"]) for r in t.groupBy("period").agg(F.count("*").alias("n"), F.min("t").alias("lo")).collect()}
    need, start, have = max(1, round(fraction * sum(n for n, _ in stats.values()))), len(stats), 0
    while have < need:
        start -= 1
        have += stats[start][0]
    cut = min(stats[p][1] for p in range(start, len(stats)))
    dev = (F.col("period") < start - purge) & before_cut(F.col("t"), cut, purge_delta)
    return t.select(key, F.when(F.col("period") >= start, "holdout").when(dev, "dev").alias("part")).where("part is not null")


def carve_group(df: DataFrame, group: str, fraction: float, seed: int = 42) -> DataFrame:
    """df with part: the first ceil(fraction G) of the G groups in md5 order are 'holdout'."""
    groups = df.select(group).distinct()
    place = F.row_number().over(Window.orderBy(digest(F.col(group), seed), group))  # one row a group
    n = groups.count()
    table = groups.select(group, F.when(place <= F.ceil(F.lit(fraction) * n), "holdout").otherwise("dev").alias("part"))
    return df.join(table, group)


def iid_es(df: DataFrame, key: str, fraction: float = 0.1, y: str | None = None, seed: int = 43) -> DataFrame:
    """Training rows with part: a share of each class for early stopping ('es'), the others 'fit'."""
    return holdout(df, key, fraction, y, seed).withColumn("part", F.when(F.col("is_test"), "es").otherwise("fit")).drop("is_test")


def group_es(df: DataFrame, group: str, fraction: float = 0.1, seed: int = 43) -> DataFrame:
    return carve_group(df, group, fraction, seed).withColumn("part", F.when(F.col("part") == "holdout", "es").otherwise("fit"))


def fold_index(folds: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(key, fold): the last fold that tests a row, -1 if none does."""
    last = folds.where("part = 'test'").groupBy(key).agg(F.max("fold").alias("fold"))
    return keys.select(key).join(last, key, "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))


def check(folds: DataFrame, key: str, group: str | None = None, time: str | None = None) -> DataFrame:
    """(fold, shared_rows, shared_groups, overlapping_time): what each fold breaks, 0 where it is sound."""
    side = F.when(F.col("part") == "test", "test").otherwise("train")
    f = folds.withColumn("side", side)
    rows = f.groupBy("fold", key).agg(F.count("*").alias("c")).groupBy("fold").agg(F.sum((F.col("c") > 1).cast("long")).alias("shared_rows"))
    groups = f.groupBy("fold", group).agg(F.count_distinct("side").alias("c")).groupBy("fold").agg(F.sum((F.col("c") > 1).cast("long")).alias("shared_groups")) if group else rows.select("fold", F.lit(0).cast("long").alias("shared_groups"))
    late = F.max(F.when(F.col("side") == "train", F.col(time)))
    times = f.groupBy("fold").agg((late >= F.min(F.when(F.col("side") == "test", F.col(time)))).cast("long").alias("overlapping_time")) if time else rows.select("fold", F.lit(0).cast("long").alias("overlapping_time"))
    return rows.join(groups, "fold").join(times, "fold")


def structure_blocks(df: DataFrame, key: str, time: str | None = None, block: int = 50, window: float | None = None, name: str = "block") -> DataFrame:
    """df with the number of its block: `block` rows in order of time (or key), or dense windows of time."""
    if window is None:
        return positions(df, time or key, key, "__pos").withColumn(name, F.floor(F.col("__pos") / block)).drop("__pos")
    return dense_periods(df, time, "delta", window, name)


def degenerate_blocks(df: DataFrame, block: str, y: str) -> DataFrame:
    """(n_degenerate): blocks with a single target value."""
    return df.groupBy(block).agg(F.count_distinct(y).alias("d")).agg(F.count_if(F.col("d") < 2).alias("n_degenerate"))


def permute(df: DataFrame, key: str, y: str, block: str, seed: int = 0, name: str = "y_permuted") -> DataFrame:
    """df with the target permuted within blocks: the i-th row of one md5 order gets the target of the i-th of another."""
    place = lambda salt: F.row_number().over(Window.partitionBy(block).orderBy(digest(F.col(key), f"{seed}:{salt}"), key))
    given = df.select(block, F.col(y).alias(name), place("a").alias("__i"))
    return df.withColumn("__i", place("b")).join(given, [block, "__i"]).drop("__i")
