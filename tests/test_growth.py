"""What must not grow with the table: rows of one task, passes over the source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsel.core import Task
from tabsel.operators import bootstrap, folds, profile


def _brute(p, positive, w, base, r, above=None):
    """ROC pairs (or the sum of precisions, given what lies above) of a replicate, score by score."""
    t, scores = w * bootstrap.times_of(base, r), np.unique(p)
    pos, neg = (np.array([t[(p == x) & side].sum() for x in scores]) for side in (positive, ~positive))
    if above is None:
        return pos @ (np.cumsum(neg) - neg / 2), pos.sum(), neg.sum()
    tp, n = np.cumsum(pos[::-1])[::-1] + above[r, 0], np.cumsum((pos + neg)[::-1])[::-1] + above[r].sum()
    return pos @ np.divide(tp, n, out=np.zeros_like(tp), where=n > 0), pos.sum(), neg.sum()


@pytest.mark.parametrize("chunk", [7, 50, 16_384])
@pytest.mark.parametrize("kinds", [1, 3, 40, 10**9])
def test_chunks_of_a_range_sum_to_the_whole(monkeypatch, chunk, kinds):
    monkeypatch.setattr(bootstrap, "CHUNK", chunk)
    rng = np.random.default_rng(0)
    p, positive, w = np.sort(rng.integers(0, kinds, 500).astype(float)), rng.random(500) < 0.4, rng.random(500) + 0.1
    base = rng.integers(0, 2**64, 500, dtype=np.uint64)
    for above in (None, rng.random((5, 2)) * 20):
        assert np.allclose(bootstrap._inner_sums(p, positive, w, base, 5, above), [_brute(p, positive, w, base, r, above) for r in range(5)])


def test_equal_scores_are_spread_over_tasks(spark):
    """A constant score (the baseline's) was one task's burden; and the areas are those of the rows together."""
    rows = spark.range(4000).select(F.col("id").alias("rid"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit(1.0).alias("w"), ((F.col("id") * 7919 % 1000) / 1000 + F.when(F.col("id") % 3 == 0, 0.2).otherwise(0.0)).alias("pa"), F.when(F.col("id") % 5 == 0, 0.4).otherwise(0.3).alias("pb"))
    for block in (None, "block"):
        numbered = bootstrap._numbered(rows.withColumn("block", F.col("rid") % 2), 3, block, "rid")
        sizes = bootstrap.ranges(numbered.withColumn("tie", F.xxhash64(*numbered.columns)), "pb", F.col("y") == 1, 8).groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert sizes.max() < 1000
        d = numbered.orderBy("rid").toPandas()
        base, positive, w = d["base"].to_numpy().view(np.uint64), d["y"].to_numpy() == 1, d["w"].to_numpy()
        for metric in ("roc_auc", "pr_auc"):
            found = bootstrap.deltas(rows.withColumn("block", F.col("rid") % 2), metric, 3, 3, block, "rid")
            for r in range(3):
                (a, pos, neg), (b, _, _) = (_brute(d[c].to_numpy(), positive, w, base, r, None if metric == "roc_auc" else np.zeros((3, 2))) for c in ("pa", "pb"))
                assert np.isclose(found[r], (a - b) / (pos * neg if metric == "roc_auc" else pos)) or not pos * neg and np.isnan(found[r])


def test_no_task_orders_a_fold(spark):
    """The latest training rows were found by ordering each fold whole in one task, after a shuffle by period."""
    days = [3 * i % 40 for i in range(400)]
    df = spark.createDataFrame([(i, d * 10) for i, d in enumerate(days)], "id long, t long").repartition(7)
    f = folds.period_folds(df, "t", "id", "delta", k=3, size=50, n_es=13)
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(fold" not in plan
    found = {}
    for r in f.collect():
        found.setdefault((r["fold"], r["part"]), set()).add(r["id"])
    for k in range(3):
        train = found[k, "fit"] | found[k, "es"]
        assert train == {i for i, d in enumerate(days) if d // 5 < 5 + k} and found[k, "test"] == {i for i, d in enumerate(days) if d // 5 == 5 + k}
        assert found[k, "es"] == set(sorted(train, key=lambda i: (days[i], i))[-13:])
    assert {r["part"]: r["c"] for r in folds.period_folds(df.where("id < 40"), "t", "id", "delta", k=1, size=200, n_es=99).groupBy("part").agg(F.count("*").alias("c")).collect()} == {"test": 20, "es": 19, "fit": 1}


def test_profile_stacks_columns_by_type(spark):
    """A row was repeated, with all columns, for each column counted. All types, nulls, NaN and both zeros, and no rows."""
    df = spark.sql("""select cast(id % 3 as int) as i, id as l, case when id % 4 = 0 then double('nan') when id % 4 = 1 then -0.0d else 0.0d end as d, cast(id % 2 as float) as f,
        cast(id % 5 as decimal(9,2)) as m, if(id < 9, null, string(id)) as s, id % 2 = 0 as b, date_add(date'2024-01-01', int(id % 7)) as day, cast(null as string) as nothing,
        cast(timestamp_ntz'2024-03-31 01:30:00' + make_dt_interval(0, int(id % 4)) as timestamp_ntz) as ts from range(20)""")
    found = profile.profile(df, Task("binary"))
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = [(r["column_name"], r["n"], r["n_null"], r["n_distinct"]) for r in found.collect()]
    assert rows == [("i", 20, 0, 3), ("l", 20, 0, 20), ("d", 20, 5, 1), ("f", 20, 0, 2), ("m", 20, 0, 5), ("s", 20, 9, 11), ("b", 20, 0, 2), ("day", 20, 0, 7), ("nothing", 20, 20, 0), ("ts", 20, 0, 4)]
    assert {(r["n"], r["n_null"], r["n_distinct"]) for r in profile.profile(df.where("l < 0"), Task("binary")).collect()} == {(0, 0, 0)}
