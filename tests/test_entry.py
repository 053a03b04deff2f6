"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = ("leaderboard",)


def canon(df: pd.DataFrame) -> list[tuple]:
    def text(x):
        if x is None or x is pd.NaT or x != x:
            return "null"
        if isinstance(x, float):
            return repr(round(x, 6) + 0.0)
        if hasattr(x, "item"):
            return text(x.item())
        return str(x.date()) if isinstance(x, pd.Timestamp) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op")))
def test_query_equals_sql(spark, duck, name):
    assert canon(entry.queries()[name](spark, SF).toPandas()) == canon(duck.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(k for k in set(entry.queries()) - set(entry.oracle_sql()) if not k.startswith(("op", "pipeline", *SLOW))))
def test_other_queries_have_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.model_id for r in rows} == {"baseline", "linear"} and sum(r.is_winner for r in rows) == 1
