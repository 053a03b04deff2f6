"""The registered queries on the fixture tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import FeatureSchema, Role, Task
from ..functions import metrics as M
from ..functions.expressions import category_key, encode, uniform
from ..operators import bootstrap, calibration, ensemble, features, folds, prep, profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*(F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema))


# -- profiling -----------------------------------------------------------------------------------------------------
_INT, _FLOAT, _STR, _DATE = ("l_orderkey l_partkey l_suppkey l_linenumber c_custkey c_nationkey event_id user_id".split(), "l_quantity l_extendedprice l_discount l_tax c_acctbal value".split(), "l_returnflag l_linestatus c_name c_mktsegment event_type props".split(), "l_shipdate ts".split())
_COLUMNS = {"lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split(), "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split(), "events": "event_id ts user_id event_type value props".split()}


def _profile_sql(t: str) -> str:
    kind = {c: k for k, cs in (("int", _INT), ("float", _FLOAT), ("str", _STR), ("date", _DATE)) for c in cs}
    parts = [f"select '{c}' as column_name, '{kind[c]}' as kind, count(*) as n, count(*) - count({c}) as n_null, count(distinct {c}) as n_distinct from {t}" for c in _COLUMNS[t]]
    return f"""with s as ({' union all '.join(parts)}), r as (select *, n_distinct / n::double as rate from s)
select column_name, n, n_null, n_distinct,
 case when kind <> 'date' and (n_null = n or n_null = 0 and n_distinct <= 1) then 'ignore' when kind = 'date' then 'datetime'
  when kind = 'str' then case when n_distinct > 100 and rate > 0.95 then 'ignore' else 'categorical' end when kind = 'float' then 'numeric'
  when rate > 0.95 and n_distinct > 100 then 'ignore' when n_distinct <= 20 then 'categorical' else 'numeric' end as role,
 case when kind <> 'date' and n_null = n then 'all_null' when kind <> 'date' and n_null = 0 and n_distinct <= 1 then 'constant'
  when kind = 'str' and n_distinct > 100 then case when rate > 0.95 then 'string_id_like' else 'high_cardinality_string' end
  when kind = 'int' and rate > 0.95 and n_distinct > 100 then 'numeric_id_like' when kind = 'int' and n_distinct <= 20 then 'low_cardinality_int' end as reason from r"""


for _t in _COLUMNS:
    query(_profile_sql(_t), f"profile_{_t}")(lambda s, d, t=_t: profile.profile(table(s, d, t), Task("binary")))


# -- sources -------------------------------------------------------------------------------------------------------
@query("select count(*) as n, cast(sum(n_nationkey) as bigint) as k from nation")
def load_folder(spark, sf):
    from ..sources.tables import load_table

    return load_table(spark, f"{sf}/nation.parquet").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("k"))


# -- categories and features ---------------------------------------------------------------------------------------
def _segments(spark, sf) -> FeatureSchema:
    s = FeatureSchema(roles={"c_mktsegment": Role.CATEGORICAL}, dtypes={"c_mktsegment": "string"})
    return features.fit_categories(table(spark, sf, "customer"), s)


@query("select 'c_mktsegment' as column_name, key, row_number() over (order by key) - 1 as code from (select distinct c_mktsegment as key from customer)")
def category_table_customer_segment(spark, sf):
    return features.category_tables(table(spark, sf, "customer"), {"c_mktsegment": F.col("c_mktsegment")}).select("column_name", "key", F.col("code").cast("bigint").alias("code"))


@query("""with k as (select distinct o_orderpriority as p from orders), t as (select p, row_number() over (order by p) - 1 as c, count(*) over () as n from k),
r as (select o_orderkey, case when o_orderkey % 10 = 0 then null when o_orderkey % 11 = 0 then 'ZZZ' else o_orderpriority end as p from orders)
select o_orderkey, cast(case when r.p is null then (select max(n) from t) else coalesce(t.c, (select max(n) from t) + 1) end as integer) as code from r left join t on r.p = t.p""")
def encode_orders_priority(spark, sf):
    o = table(spark, sf, "orders")
    s = features.fit_categories(o, FeatureSchema(roles={"o_orderpriority": Role.CATEGORICAL}, dtypes={"o_orderpriority": "string"}))
    drift = F.when(F.col("o_orderkey") % 10 == 0, None).when(F.col("o_orderkey") % 11 == 0, "ZZZ").otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", encode(drift, s.categories["o_orderpriority"]).alias("code"))


@query("select 'c_mktsegment' as column_name, avg(case when c_mktsegment is null then null when c_custkey % 7 = 0 then 1.0 else 0.0 end) as unseen_share from customer")
def encode_unseen(spark, sf):
    schema = _segments(spark, sf)
    c = table(spark, sf, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "ZZZ").otherwise(F.col("c_mktsegment")))
    return rounded(profile.unseen_share(c, schema), 10)


@query("select p_partkey, case when p_partkey % 5 = 0 then cast(p_size + 0.5 as varchar) else cast(p_size as varchar) end as key from part")
def encode_int_float_drift(spark, sf):
    x = F.col("p_size").cast("double") + F.when(F.col("p_partkey") % 5 == 0, 0.5).otherwise(0.0)
    return table(spark, sf, "part").select("p_partkey", category_key(x, integer=True).alias("key"))


@query("select o_orderkey, cast(date_diff('day', cast(o_orderdate as date), date '1999-01-01') as double) as days from orders")
def datetime_delta_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", features.delta_days(F.lit("1999-01-01").cast("date"), F.col("o_orderdate")).alias("days"))


@query("select key, count(*) as n from (select coalesce(l_linestatus, '__NA__') || '__' || coalesce(case when l_partkey % 9 = 0 then null else l_returnflag end, '__NA__') as key from lineitem) group by key")
def intersection_lineitem(spark, sf):
    s = FeatureSchema(roles={"l_linestatus": Role.CATEGORICAL, "l_returnflag": Role.CATEGORICAL})
    rows = table(spark, sf, "lineitem").withColumn("l_returnflag", F.when(F.col("l_partkey") % 9 == 0, None).otherwise(F.col("l_returnflag")))
    return rows.select(features.cross(s, "l_linestatus", "l_returnflag").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("select l_returnflag as key, count(*) / (select count(*) from lineitem)::double as share from lineitem group by l_returnflag")
def frequency_lineitem(spark, sf):
    rows = table(spark, sf, "lineitem")
    s = features.fit_frequency(rows, features.fit_categories(rows, FeatureSchema(roles={"l_returnflag": Role.CATEGORICAL}, dtypes={"l_returnflag": "string"})))
    found = [(k, s.frequency["l_returnflag"][i]) for i, k in enumerate(s.categories["l_returnflag"])]
    return rounded(spark.createDataFrame(found, "key string, share double"), 10)


@query("""with e as (select event_id, props, (event_type = 'purchase')::int as y from events), g as (select avg(y) as g from e),
t as (select props, (sum(y) + 10 * (select g from g)) / (count(*) + 10) as v from e group by props) select event_id, round(v, 8) as props_te from e join t using (props)""")
def target_encode_events(spark, sf):
    rows = table(spark, sf, "events").withColumn("y", (F.col("event_type") == "purchase").cast("double"))
    s = FeatureSchema(roles={"props": Role.CATEGORICAL}, dtypes={"props": "string"})
    s = features.fit_target(rows, features.fit_categories(rows, s), F.col("y"))
    return rounded(features.apply(rows, s).select("event_id", "props_te"))


_EVENTS = "e as (select event_id, ts, user_id, value, props, (event_type = 'purchase')::int as y from events)"
_FOLDED = _EVENTS + ", f as (select *, (row_number() over (partition by y order by md5('42:' || event_id), event_id) - 1) % 5 as fold from e)"


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "value", "props", (F.col("event_type") == "purchase").cast("int").alias("y"))


@query(f"""with {_FOLDED}, x as (select f, g, s, n, p from (select distinct fold as f from f) join (select fold as ff, count(*) as gn, sum(y) as gs from f group by fold) on 1 = 0 join (select 1 as g, 1 as s, 1 as n, 1 as p) on 1 = 0),
t as (select props, count(*) as n, sum(y) as s from f group by props), o as (select props, fold, count(*) as n, sum(y) as s from f group by props, fold),
b as (select fold, (select sum(y) from f) - sum(y) as s, (select count(*) from f) - count(*) as n from f group by fold)
select f.event_id, round(case when t.n - o.n = 0 then b.s / b.n else (t.s - o.s + 10 * (b.s / b.n)) / (t.n - o.n + 10) end, 8) as te from f join t using (props) join o using (props, fold) join b using (fold)""".replace(", x as (select f, g, s, n, p from (select distinct fold as f from f) join (select fold as ff, count(*) as gn, sum(y) as gs from f group by fold) on 1 = 0 join (select 1 as g, 1 as s, 1 as n, 1 as p) on 1 = 0)", ""))
def oof_te_events(spark, sf):
    rows = folds.stratified_kfold(_events(spark, sf), "event_id", "y")
    return rounded(features.crossfit(rows, "props", "y", "fold", 10.0, "te").select("event_id", "te"))


@query(f"""with {_FOLDED}, b as (select a.fold, sum(c.y) as s, count(c.y) as n from (select distinct fold from f) a left join f c on c.fold < a.fold group by a.fold), own as (select fold, avg(y) as m from f group by fold),
h as (select a.props, a.fold, count(c.y) as n, coalesce(sum(c.y), 0) as s from (select distinct props, fold from f) a left join f c on c.props = a.props and c.fold < a.fold group by a.props, a.fold)
select f.event_id, round(case when h.n = 0 then coalesce(b.s / b.n, own.m) else (h.s + 10 * (b.s / b.n)) / (h.n + 10) end, 8) as te from f join h using (props, fold) join b using (fold) join own using (fold)""")
def oof_te_expanding_events(spark, sf):
    rows = folds.stratified_kfold(_events(spark, sf), "event_id", "y")
    return rounded(features.crossfit(rows, "props", "y", "fold", 10.0, "te", expanding=True).select("event_id", "te"))


# -- folds ---------------------------------------------------------------------------------------------------------
@query(f"with {_FOLDED} select event_id, fold from f")
def fold_stratified(spark, sf):
    return folds.stratified_kfold(_events(spark, sf), "event_id", "y").select("event_id", F.col("fold").cast("bigint").alias("fold"))


@query("select event_id, (row_number() over (order by md5('42:' || event_id), event_id) - 1) % 5 as fold from events")
def fold_kfold(spark, sf):
    return folds.kfold(_events(spark, sf), "event_id").select("event_id", F.col("fold").cast("bigint").alias("fold"))


@query(f"with {_EVENTS} select event_id, row_number() over (partition by y order by md5('42:' || event_id), event_id) <= ceil(0.25 * count(*) over (partition by y)) as is_test from e")
def fold_holdout(spark, sf):
    return folds.holdout(_events(spark, sf), "event_id", 0.25, "y").select("event_id", "is_test")


@query("""with g as (select o_custkey, row_number() over (order by count(*) desc, o_custkey) - 1 as p from orders group by o_custkey)
select o_orderkey, cast(case when (p // 5) % 2 = 0 then p % 5 else 4 - p % 5 end as bigint) as fold from orders join g using (o_custkey)""")
def fold_group_customer(spark, sf):
    return folds.snake_groups(table(spark, sf, "orders"), "o_custkey").select("o_orderkey", F.col("fold").cast("bigint").alias("fold"))


def _greedy_sql(groups: str) -> str:
    """Groups, largest first, to the fold with the fewest rows so far; equal groups are alike in the result."""
    return f"""with recursive g as ({groups}), o as (select n, row_number() over (order by n desc) as i from g),
w as (select 0::bigint as i, [0, 0, 0, 0, 0]::bigint[] as load, [0, 0, 0, 0, 0]::bigint[] as c
 union all select w.i + 1, list_transform(range(1, 6), lambda x: w.load[x] + case when x = list_position(w.load, list_min(w.load)) then o.n else 0 end), list_transform(range(1, 6), lambda x: w.c[x] + (x = list_position(w.load, list_min(w.load)))::bigint) from w join o on o.i = w.i + 1),
z as (select * from w order by i desc limit 1) select cast(f - 1 as integer) as fold, load[f] as n, c[f] as groups from z, (select unnest(range(1, 6)) as f)"""


@query(_greedy_sql("select count(*) as n from orders group by o_custkey"))
def fold_group_greedy(spark, sf):
    return folds.group_kfold(table(spark, sf, "orders"), "o_custkey").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups"))


@query()
def fold_group_stratified(spark, sf):
    return folds.group_kfold(_events(spark, sf), "user_id", y="y").groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query("""with t as (select event_id, epoch_us(ts) as t, row_number() over (order by epoch_us(ts), event_id) - 1 as pos, count(*) over () as n from events),
k as (select unnest(range(4)) as fold), b as (select fold, (select max(n) from t) - 4 * 100 + fold * 100 as s from k), m as (select b.fold, b.s, min(t) as lo from b join t on t.pos >= b.s and t.pos < b.s + 100 group by all),
x as (select m.fold, t.event_id, t.t, case when t.pos >= m.s and t.pos < m.s + 100 then 'test' else 'train' end as part from m join t on (t.pos >= m.s and t.pos < m.s + 100)
 or (t.pos < m.s - 20 and t.t < m.lo and not exists (select 1 from m p where p.fold < m.fold and p.s + 100 < m.s - 20 and t.pos between p.s + 100 and p.s + 109))),
y as (select *, row_number() over (partition by fold, part order by t desc, event_id desc) as late, count(*) over (partition by fold, part) as c from x)
select event_id, fold, case when part = 'test' then 'test' when late <= least(50, c - 1) then 'es' else 'fit' end as part from y""")
def fold_timeseries_events(spark, sf):
    return folds.time_folds(table(spark, sf, "events"), "ts", "event_id", k=4, n_test=100, n_es=50, purge=20, embargo=10).select("event_id", F.col("fold").cast("bigint").alias("fold"), "part")


_PERIODS = "d as (select event_id, epoch_us(ts) as t, {key} as r from events), p as (select *, dense_rank() over (order by r) - 1 as p from d), np as (select max(p) + 1 as n from p)"


def _period_sql(key: str, k: int, purge: int) -> str:
    return f"""with {_PERIODS.format(key=key)}, k as (select unnest(range({k})) as fold), b as (select fold, (select n from np) - 1 - ({k} - 1) + fold as s from k),
m as (select b.fold, b.s, min(t) as lo from b join p on p.p = b.s group by all),
x as (select m.fold, p.event_id, p.t, case when p.p = m.s then 'test' else 'train' end as part from m join p on p.p = m.s or (p.p < m.s - {purge} and p.t < m.lo)),
y as (select *, row_number() over (partition by fold, part order by t desc, event_id desc) as late, count(*) over (partition by fold, part) as c from x)
select event_id, fold, case when part = 'test' then 'test' when late <= least(1, c - 1) then 'es' else 'fit' end as part from y"""


@query(_period_sql("date_trunc('week', ts)", 2, 1))
def fold_period_week_events(spark, sf):
    return folds.period_folds(table(spark, sf, "events"), "ts", "event_id", "week", k=2, purge=1).select("event_id", F.col("fold").cast("bigint").alias("fold"), "part")


@query(_period_sql("floor((epoch_us(ts) - (select min(epoch_us(ts)) from events)) / 172800000000.0)", 3, 0))
def fold_period_delta(spark, sf):
    return folds.period_folds(table(spark, sf, "events"), "ts", "event_id", "delta", k=3, size=172800e6).select("event_id", F.col("fold").cast("bigint").alias("fold"), "part")


@query("select cast(count(distinct r) as bigint) as n_periods, cast(max(r) - min(r) + 1 - count(distinct r) as bigint) as n_dropped_empty from (select date_diff('day', date '1970-01-01', cast(ts as date)) as r from events where day(ts) <> 9)")
def period_meta_events(spark, sf):
    return folds.period_meta(table(spark, sf, "events").where(F.dayofmonth("ts") != 9), "ts", "day").select(F.col("n_periods").cast("bigint").alias("n_periods"), F.col("n_dropped_empty").cast("bigint").alias("n_dropped_empty"))


@query("""with t as (select event_id, epoch_us(ts) as t, row_number() over (order by epoch_us(ts), event_id) - 1 as pos, count(*) over () as n from events), h as (select *, greatest(1, round_even(0.2 * n, 0)) as h from t),
c as (select min(t) as cut from h where pos >= n - h) select event_id, case when pos >= n - h then 'holdout' else 'dev' end as part from h where pos >= n - h or (pos < n - h - 30 and t < (select cut from c))""")
def carve_timeseries(spark, sf):
    return folds.carve_time(table(spark, sf, "events"), "ts", "event_id", 0.2, purge=30)


@query("""with d as (select event_id, epoch_us(ts) as t, dense_rank() over (order by cast(ts as date)) - 1 as p, count(*) over () as n from events), c as (select p, sum(count(*)) over (order by p desc) as c from d group by p),
s as (select max(p) as s from c where c >= (select greatest(1, round_even(0.2 * max(n), 0)) from d)), m as (select min(t) as cut from d where p >= (select s from s))
select event_id, case when p >= (select s from s) then 'holdout' else 'dev' end as part from d where p >= (select s from s) or (p < (select s from s) - 2 and t < (select cut from m))""")
def carve_period(spark, sf):
    return folds.carve_period(table(spark, sf, "events"), "ts", "event_id", 0.2, "day", purge=2)


@query("""with g as (select o_custkey, row_number() over (order by md5('42:' || o_custkey), o_custkey) as p, count(*) over () as n from (select distinct o_custkey from orders))
select o_orderkey, case when p <= ceil(0.2 * n) then 'holdout' else 'dev' end as part from orders join g using (o_custkey)""")
def carve_group(spark, sf):
    return folds.carve_group(table(spark, sf, "orders"), "o_custkey", 0.2).select("o_orderkey", "part")


@query(f"with {_EVENTS} select event_id, case when row_number() over (partition by y order by md5('43:' || event_id), event_id) <= ceil(0.1 * count(*) over (partition by y)) then 'es' else 'fit' end as part from e")
def carve_es_iid(spark, sf):
    return folds.iid_es(_events(spark, sf), "event_id", 0.1, "y").select("event_id", "part")


@query("select * from (values (0, 0, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0)) t(fold, shared_rows, shared_groups, overlapping_time)")
def validate_folds(spark, sf):
    e = table(spark, sf, "events")
    f = folds.time_folds(e, "ts", "event_id", k=4, n_test=100).join(e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")), "event_id")
    return folds.check(f, "event_id", time="t").select(F.col("fold").cast("int").alias("fold"), *(F.col(c).cast("int").alias(c) for c in ("shared_rows", "shared_groups", "overlapping_time")))


@query("""with t as (select event_id, row_number() over (order by epoch_us(ts), event_id) - 1 as pos, count(*) over () as n from events)
select event_id, cast(case when pos >= n - 300 then (pos - (n - 300)) // 100 else -1 end as bigint) as fold from t""")
def fold_index(spark, sf):
    e = table(spark, sf, "events")
    return folds.fold_index(folds.time_folds(e, "ts", "event_id", k=3, n_test=100), e, "event_id").select("event_id", F.col("fold").cast("bigint").alias("fold"))


@query("select event_id, (row_number() over (order by ts, event_id) - 1) // 50 as block from events")
def structure_blocks(spark, sf):
    return folds.structure_blocks(table(spark, sf, "events"), "event_id", "ts").select("event_id", F.col("block").cast("bigint").alias("block"))


@query(f"with {_EVENTS}, b as (select y, (row_number() over (order by ts, event_id) - 1) // 10 as block from e) select count(*) as n_degenerate from (select block from b group by block having count(distinct y) < 2)")
def degenerate_blocks(spark, sf):
    return folds.degenerate_blocks(folds.structure_blocks(_events(spark, sf), "event_id", "ts", 10), "block", "y")


@query(f"""with {_EVENTS}, b as (select *, (row_number() over (order by event_id) - 1) // 50 as block from e),
p as (select *, row_number() over (partition by block order by md5('0:a:' || event_id), event_id) as i, row_number() over (partition by block order by md5('0:b:' || event_id), event_id) as j from b)
select q.event_id, p.y as y_permuted from p join p q on p.block = q.block and p.i = q.j""")
def permute_target_in_blocks(spark, sf):
    rows = folds.structure_blocks(_events(spark, sf), "event_id")
    return folds.permute(rows, "event_id", "y", "block").select("event_id", "y_permuted")


# -- metrics -------------------------------------------------------------------------------------------------------
_U = "('0x' || substring(md5('{s}:' || event_id), 1, 8))::bigint / 4294967296.0::double"
#: Two candidates with scores from a formula; ties by rounding; weights from value.
_OOF = _EVENTS + f", o as (select event_id, ts, y, round(0.2 + 0.3 * y + 0.5 * {_U.format(s='a')}, 2)::double as p, 1 + event_id % 3 as w from e)"


def _oof(spark, sf) -> DataFrame:
    p = F.round(0.2 + 0.3 * F.col("y") + 0.5 * uniform(F.col("event_id"), "a"), 2)
    return _events(spark, sf).select("event_id", "ts", "y", p.alias("p"), (1 + F.col("event_id") % 3).cast("double").alias("w"))


_AUC = "(select sum(pos * (coalesce(below, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) from (select pos, neg, sum(neg) over (order by p rows between unbounded preceding and 1 preceding) as below from (select p, sum(case when y = 1 then w else 0 end)::double as pos, sum(case when y = 1 then 0 else w end)::double as neg from o group by p)))"
_CLIP = "greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p))"
_METRIC_SQL = {
    "roc_auc": _AUC,
    "pr_auc": "(select sum(pos * tp / n) / sum(pos) from (select pos, sum(pos) over (order by p desc rows unbounded preceding) as tp, sum(a) over (order by p desc rows unbounded preceding) as n from (select p, sum(case when y = 1 then w else 0 end)::double as pos, sum(w)::double as a from o group by p)))",
    "accuracy": "(select sum(w * ((p >= 0.5)::int = y)::int) / sum(w)::double from o)",
    "log_loss": f"(select sum(w * -ln(case when y = 1 then {_CLIP} else 1 - {_CLIP} end)) / sum(w) from o)",
    "brier": "(select sum(w * (p - y) * (p - y)) / sum(w) from o)",
    "ece": "(select sum(a * abs(f - c)) / sum(a) from (select sum(w)::double as a, sum(w * r) / sum(w) as f, sum(w * c) / sum(w) as c from (select w, greatest(p, 1 - p) as c, ((p >= 0.5)::int = y)::int::double as r from o) group by (c >= 0.1::double)::int + (c >= 0.2::double)::int + (c >= 0.30000000000000004::double)::int + (c >= 0.4::double)::int + (c >= 0.5::double)::int + (c >= 0.6000000000000001::double)::int + (c >= 0.7000000000000001::double)::int + (c >= 0.8::double)::int + (c >= 0.9::double)::int))",
    "rmse": "(select sqrt(sum(w * (p - y) * (p - y)) / sum(w)) from o)",
    "mae": "(select sum(w * abs(p - y)) / sum(w) from o)",
}
for _m, _sql in _METRIC_SQL.items():
    query(f"with {_OOF} select round({_sql}, 8) as score", f"metric_{_m}")(lambda s, d, m=_m: rounded(M.METRICS[m].score(_oof(s, d))))


@query(f"with {_OOF}, b as (select weekofyear(ts) as block, * from o), g as (select block, p, sum(case when y = 1 then w else 0 end)::double as pos, sum(case when y = 1 then 0 else w end)::double as neg from b group by block, p), s as (select block, pos, neg, sum(neg) over (partition by block order by p rows between unbounded preceding and 1 preceding) as below from g) select round(avg(a), 8) as score from (select sum(pos * (coalesce(below, 0) + neg / 2)) / (sum(pos) * sum(neg)) as a from s group by block having sum(pos) > 0 and sum(neg) > 0)")
def metric_by_period(spark, sf):
    return rounded(M.by_period(M.METRICS["roc_auc"], _oof(spark, sf).withColumn("block", F.weekofyear("ts")), "block"))


@query(f"with {_OOF}, c as (select w, greatest(p, 1 - p) as c, ((p >= 0.5)::int = y)::int::double as r from o) select cast((c >= 0.5::double)::int + 4 + (c >= 0.6000000000000001::double)::int + (c >= 0.7000000000000001::double)::int + (c >= 0.8::double)::int + (c >= 0.9::double)::int as integer) as bin, round(sum(w)::double, 8) as weight, round(sum(w * r) / sum(w), 8) as fraction, round(sum(w * c) / sum(w), 8) as mean_conf from c group by 1")
def reliability_curve(spark, sf):
    return rounded(M.reliability(_oof(spark, sf)))


_MULTI = "o as (select vec_id, label % 3 as y, 1.0::double as w, (1 + vec_id % 5)::double / (6 + vec_id % 5 + vec_id % 7) as p0, 2.0::double / (6 + vec_id % 5 + vec_id % 7) as p1, (3 + vec_id % 7)::double / (6 + vec_id % 5 + vec_id % 7) as p2 from embeddings)"


def _multi(spark, sf) -> DataFrame:
    v = F.col("vec_id")
    total = (6 + v % 5 + v % 7).cast("double")
    return table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).alias("y"), F.lit(1.0).alias("w"), F.array((1 + v % 5) / total, F.lit(2.0) / total, (3 + v % 7) / total).alias("proba"))


_OVR = "(select avg(a) from (select k, sum(pos * (coalesce(below, 0) + neg / 2)) / (sum(pos) * sum(neg)) as a from (select k, pos, neg, sum(neg) over (partition by k order by p rows between unbounded preceding and 1 preceding) as below from (select k, p, sum((y = k)::int)::double as pos, sum((y <> k)::int)::double as neg from (select 0 as k, y, p0 as p from o union all select 1, y, p1 from o union all select 2, y, p2 from o) group by k, p)) group by k))"
_TOP = "greatest(p0, p1, p2)"
_ARG = f"(case when p0 = {_TOP} then 0 when p1 = {_TOP} then 1 else 2 end)"
for _m, _sql in {
    "roc_auc": _OVR,
    "accuracy": f"(select avg(({_ARG} = y)::int) from o)",
    "log_loss": "(select avg(-ln(case y when 0 then p0 when 1 then p1 else p2 end)) from o)",
    "brier": "(select avg((p0 - (y = 0)::int) ^ 2 + (p1 - (y = 1)::int) ^ 2 + (p2 - (y = 2)::int) ^ 2) from o)",
}.items():
    query(f"with {_MULTI} select round({_sql}, 8) as score", f"metric_multiclass_{_m}")(lambda s, d, m=_m: rounded(M.METRICS[m].score(_multi(s, d))))


# -- models and out-of-fold --------------------------------------------------------------------------------------
@query(f"with {_EVENTS} select y, round(count(*) / (select count(*) from e)::double, 10) as share from e group by y")
def baseline_prior(spark, sf):
    from .models import ZOO

    fitted = ZOO["baseline"].fit(_events(spark, sf).withColumn("w", F.lit(1.0)), ["value"], "y", "w", 2)
    return rounded(spark.createDataFrame(list(enumerate(fitted.constant)), "y int, share double"), 10)


@query("select round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) as mean from lineitem")
def baseline_mean(spark, sf):
    from .models import ZOO

    rows = table(spark, sf, "lineitem")
    fitted = ZOO["baseline"].fit(rows, ["l_tax"], "l_extendedprice", "l_quantity", 0)
    return rounded(spark.createDataFrame([(fitted.constant[0],)], "mean double"), 4)


@query(f"with {_FOLDED}, m as (select fold, ((select sum(y) from f) - sum(y)) / ((select count(*) from f) - count(*))::double as p from f group by fold), s as (select avg(-ln(case when y = 1 then p else 1 - p end)) as l, avg((p - y) ^ 2) as b from f join m using (fold)) select 'baseline' as model_id, round(l, 8) as log_loss, round(b, 8) as brier from s")
def baseline_oof_leaderboard(spark, sf):
    from .evaluate import out_of_fold
    from .models import ZOO

    rows = folds.stratified_kfold(_events(spark, sf), "event_id", "y").withColumn("rid", F.col("event_id")).withColumn("w", F.lit(1.0))
    oof = out_of_fold(ZOO["baseline"], rows, ["value"], 2, None, 5, 42)
    both = M.METRICS["log_loss"].score(oof, ["model_id"]).withColumnRenamed("score", "log_loss").join(M.METRICS["brier"].score(oof, ["model_id"]).withColumnRenamed("score", "brier"), "model_id")
    return rounded(both)


@query("""with d as (select l_quantity as x, l_extendedprice as y from lineitem), s as (select count(*)::double as n, avg(x) as mx, avg(y) as my, stddev_pop(x) as sx from d),
t as (select sum((x - mx) / sx * (y - my)) as zy, any_value(n) as n, any_value(mx) as mx, any_value(my) as my, any_value(sx) as sx from d, s) select round(zy / (n + 1) / sx, 5) as slope, round(my - zy / (n + 1) / sx * mx, 3) as intercept from t""")
def ridge_normal_equations(spark, sf):
    from .models import ZOO

    rows = table(spark, sf, "lineitem").withColumn("w", F.lit(1.0))
    fitted = ZOO["linear"].fit(rows, ["l_quantity"], "l_extendedprice", "w", 0)
    at = fitted.transform(spark.createDataFrame([(0.0,), (1.0,)], "l_quantity double")).orderBy("l_quantity").collect()
    return rounded(spark.createDataFrame([(at[1]["p"] - at[0]["p"], at[0]["p"])], "slope double, intercept double").select(F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept")))


def _candidates(spark, sf) -> DataFrame:
    base = _oof(spark, sf).withColumnRenamed("event_id", "rid")
    one = base.where(F.col("rid") % 17 != 0).withColumn("model_id", F.lit("a"))
    two = base.where(F.col("rid") % 13 != 0).withColumn("p", F.round(1 - F.col("p") * 0.5, 3)).withColumn("model_id", F.lit("b"))
    return one.unionByName(two)


@query("select event_id as rid from events where event_id % 17 <> 0 and event_id % 13 <> 0")
def common_mask(spark, sf):
    return ensemble.common_rows(_candidates(spark, sf), 2)


@query(f"with {_OOF} select event_id as rid, round(0.7::double * p + 0.3::double * round(1 - p * 0.5::double, 3), 8) as p from o where event_id % 17 <> 0 and event_id % 13 <> 0")
def blend_oof(spark, sf):
    w = ensemble.wide(_candidates(spark, sf), ["a", "b"])
    return rounded(w.select("rid", ensemble.blend([F.col("m0"), F.col("m1")], [0.7, 0.3]).alias("p")))


@query(f"with {_MULTI} select vec_id, {_ARG} as label from o")
def blend_labels(spark, sf):
    rows = _multi(spark, sf).withColumn("p", ensemble.blend_arrays([F.col("proba"), F.col("proba")], [0.5, 0.5]))
    return rows.select("vec_id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("label"))


_POIS = " + ".join(f"(u >= {x!r}::double)::int" for x in bootstrap.POISSON)


@query(f"""with {_OOF}, r as (select unnest(range(50)) as b), x as (select b, ((p >= 0.5)::int = y)::int as hit, ('0x' || substring(md5('0:' || b || ':' || event_id), 1, 8))::bigint / 4294967296.0::double as u from o, r),
t as (select b, hit, {_POIS} as t from x) select cast(b as integer) as b, cast(sum(t) as bigint) as w, cast(sum(t * hit) as bigint) as hit from t group by b""")
def bootstrap_poisson_accuracy(spark, sf):
    rows = _oof(spark, sf).select("event_id", ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int").alias("hit"))
    return bootstrap.poisson_sums(rows, "event_id", ["hit"], 50)


@query(f"with {_OOF} select cast(weekofyear(ts) as integer) as block, round(sum(w * abs(p - y)) / sum(w) - sum(w * (p - y) * (p - y)) / sum(w), 8) as delta from o group by 1")
def block_metric_deltas(spark, sf):
    rows = _oof(spark, sf).withColumn("block", F.weekofyear("ts"))
    a, b = M.METRICS["mae"].score(rows, ["block"]).withColumnRenamed("score", "a"), M.METRICS["brier"].score(rows, ["block"]).withColumnRenamed("score", "b")
    return rounded(a.join(b, "block").select("block", (F.col("a") - F.col("b")).alias("delta")))


@query(f"""with {_OOF}, c as (select cast(weekofyear(ts) as integer) as block, y, count(*) as c from o group by 1, 2), t as (select y, sum(c) as t from c group by y), k as (select distinct block from c),
r as (select k.block, t.t - coalesce(c.c, 0) as r from k cross join t left join c on c.block = k.block and c.y = t.y) select block, cast(sum(r) as bigint) as n_rest, cast(sum((r > 0)::int) as bigint) as classes_rest, sum(r) >= 50 and sum((r > 0)::int) = count(*) as viable from r group by block""")
def viable_blocks(spark, sf):
    return calibration.viable_blocks(_oof(spark, sf).withColumn("block", F.weekofyear("ts")), "block")


@query(f"""with recursive {_OOF}, t as (select sum(case when y = 1 then w else 0 end)::double as p, sum(case when y = 1 then 0 else w end)::double as n from o),
d as (select p as x, case when y = 1 then (select (p + 1) / (p + 2) from t) else (select 1 / (n + 2) from t) end as t, sum(w)::double as w from o group by 1, 2),
s as (select 0 as i, 0.0::double as a, (select ln((n + 1) / (p + 1)) from t) as b
 union all select i + 1, a - (s3 * g1 - s2 * g2) / (s1 * s3 - s2 * s2), b - (s1 * g2 - s2 * g1) / (s1 * s3 - s2 * s2) from (
  select i, a, b, sum(w * (t - q) * x) as g1, sum(w * (t - q)) as g2, sum(w * q * (1 - q) * x * x) as s1, sum(w * q * (1 - q) * x) as s2, sum(w * q * (1 - q)) as s3
  from (select s.i, s.a, s.b, d.x, d.t, d.w, 1 / (1 + exp(s.a * d.x + s.b)) as q from s, d where s.i < 12) group by i, a, b))
select round(a, 6) as a, round(b, 6) as b from s where i = 12""")
def platt_fit(spark, sf):
    c = calibration.fit_sigmoid(_oof(spark, sf))
    return rounded(spark.createDataFrame([(c.a, c.b)], "a double, b double"), 6)


@query(f"""with {_OOF}, d as (select p, sum(w)::double as w, sum(w * y)::double as s, row_number() over (order by p) as i from o group by p), c as (select p, i, sum(w) over (order by i) as w, sum(s) over (order by i) as s from d),
r as (select a.i, b.i as j, (b.s - a.s) / (b.w - a.w) as m from (select 0 as i, 0.0::double as w, 0.0::double as s union all select i, w, s from c) a join c b on b.i > a.i),
u as (select d.i, r.i as lo, min(r.m) as m from d join r on r.i < d.i and r.j >= d.i group by all), v as (select d.p, d.i, round(max(u.m), 8) as y from d join u using (i) group by all),
z as (select *, lag(y) over (order by i) as a, lead(y) over (order by i) as b from v) select p as x, y from z where a is null or b is null or a <> y or b <> y""")
def isotonic_pav(spark, sf):
    c = calibration.fit_isotonic(_oof(spark, sf))
    return rounded(spark.createDataFrame(list(zip(c.xs, c.ys)), "x double, y double"))


def _mixed(x: str) -> str:
    """The finaliser of the replicates' numbers on an unsigned 64-bit x."""
    times = lambda v, m: f"(({v})::uhugeint * {m}::uhugeint % 18446744073709551616::uhugeint)::ubigint"
    a = times(f"xor({x}, {x} >> 30)", 0xBF58476D1CE4E5B9)
    b = times(f"xor(({a}), ({a}) >> 27)", 0x94D049BB133111EB)
    return f"xor(({b}), ({b}) >> 31)"


def _boot_sql(metric: str, key: str, n: int) -> str:
    """Differences of two candidates over n replicates, the weights drawn by hash as bootstrap.deltas() does."""
    thresholds = " + ".join(f"(u >= {x!r}::double)::int" for x in bootstrap.POISSON)
    start = f"""with {_OOF}, c as (select event_id, y, w, weekofyear(ts) as block, p as pa, round(1 - p * 0.5::double, 3)::double as pb from o where event_id % 17 <> 0 and event_id % 13 <> 0),
k as (select *, ('0x' || substring(md5('7:' || {key}), 1, 16))::ubigint as base from c), r as (select unnest(range({n})) as b),
x as (select r.b, k.*, ((base::uhugeint + b::uhugeint * 11400714819323198485::uhugeint) % 18446744073709551616::uhugeint)::ubigint as x0 from k, r),
m as (select b, y, w, pa, pb, x0 from x), h as (select *, {_mixed('x0')} as x3 from m),
t as (select *, w * ({thresholds}) as v from (select *, (x3 >> 11)::double * 1.1102230246251565e-16 as u from h))"""
    if metric == "brier":
        return f"{start} select cast(b as integer) as b, round(sum(v * (pa - y) * (pa - y)) / sum(v) - sum(v * (pb - y) * (pb - y)) / sum(v), 8) as delta from t group by b"
    auc = lambda p: f"(select b, sum(pos * (coalesce(below, 0) + neg / 2)) / (sum(pos) * sum(neg)) as a from (select b, pos, neg, sum(neg) over (partition by b order by {p} rows between unbounded preceding and 1 preceding) as below from (select b, {p}, sum(case when y = 1 then v else 0 end)::double as pos, sum(case when y = 1 then 0 else v end)::double as neg from t group by b, {p})) group by b)"
    return f"{start} select cast(b as integer) as b, round(i.a - j.a, 8) as delta from {auc('pa')} i join {auc('pb')} j using (b)"


def _deltas(spark, sf, metric: str, n: int, block: str | None) -> DataFrame:
    both = ensemble.wide(_candidates(spark, sf), ["a", "b"]).select("rid", "y", "w", F.col("m0").alias("pa"), F.col("m1").alias("pb"))
    if block:
        both = both.join(table(spark, sf, "events").select(F.col("event_id").alias("rid"), F.weekofyear("ts").alias(block)), "rid")
    d = bootstrap.deltas(both, metric, n, 7, block, "rid")
    return rounded(spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(d)], "b int, delta double"))


@query(_boot_sql("roc_auc", "event_id", 100))
def bootstrap_auc_by_hash(spark, sf):
    return _deltas(spark, sf, "roc_auc", 100, None)


@query(_boot_sql("brier", "block", 100))
def bootstrap_blocks_by_hash(spark, sf):
    return _deltas(spark, sf, "brier", 100, "block")


@query(f"with {_OOF}, c as (select 'a' as model_id, weekofyear(ts) as block, y, w, p from o union all select 'b', weekofyear(ts), y, w, round(1 - p * 0.5::double, 3) from o) select coalesce(model_id, 'all') as model_id, cast(coalesce(block, -1) as integer) as block, round(sum(w * ((p >= 0.5)::int = y)::int) / sum(w)::double, 8) as score from c group by rollup (model_id, block)")
def metric_rollup(spark, sf):
    base = _oof(spark, sf).withColumn("block", F.weekofyear("ts"))
    both = base.withColumn("model_id", F.lit("a")).unionByName(base.withColumn("p", F.round(1 - F.col("p") * 0.5, 3)).withColumn("model_id", F.lit("b")))
    out = M.by_rollup(M.METRICS["accuracy"], both, "model_id", "block")
    return rounded(out.select(F.coalesce("model_id", F.lit("all")).alias("model_id"), F.coalesce("block", F.lit(-1)).alias("block"), "score"))


@query("select 'l_quantity' as column_name, median(l_quantity)::double as median from lineitem union all select 'l_extendedprice', median(l_extendedprice)::double from lineitem union all select 'tax', median(case when l_orderkey % 3 = 0 then null else l_tax end)::double from lineitem")
def feature_medians(spark, sf):
    from .models import exact_medians

    rows = table(spark, sf, "lineitem").withColumn("tax", F.when(F.col("l_orderkey") % 3 == 0, None).otherwise(F.col("l_tax")))
    return spark.createDataFrame(list(exact_medians(rows, ["l_quantity", "l_extendedprice", "tax"]).items()), "column_name string, median double")


@query("""with t as (select event_id, user_id, epoch_us(ts) as t, event_id % 4 as fold, case when event_id % 4 = 0 then 'test' else 'fit' end as part from events), b as (select event_id, user_id, t, part, 0 as fold from t union all select event_id, user_id, t, 'test', 0 from t where event_id % 10 = 1)
select 0 as fold, cast(count(distinct case when event_id % 10 = 1 then event_id end) as bigint) as shared_rows, (select count(*) from (select user_id from b group by user_id having count(distinct part) > 1)) as shared_groups,
cast(max(case when part <> 'test' then t end) >= min(case when part = 'test' then t end) as bigint) as overlapping_time from b""")
def validate_bad_fold(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.when(F.col("event_id") % 4 == 0, "test").otherwise("fit").alias("part"), F.lit(0).alias("fold"))
    bad = rows.unionByName(rows.where(F.col("event_id") % 10 == 1).withColumn("part", F.lit("test")))
    return folds.check(bad, "event_id", "user_id", "t").select("fold", "shared_rows", "shared_groups", "overlapping_time")


@query()
def bootstrap_auc_delta(spark, sf):
    rows = ensemble.wide(_candidates(spark, sf), ["a", "b"]).select("y", "w", F.col("m0").alias("pa"), F.col("m1").alias("pb"))
    d = bootstrap.deltas(rows, "roc_auc", 200, 7)
    return spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(d)], "b int, delta double")


@query()
def caruana_weights(spark, sf):
    t = ensemble.wide(_candidates(spark, sf), ["a", "b"])
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(ensemble.caruana(t, 2, "log_loss", 5, 2))], "model int, weight double")


def planted(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with a learnable target: y, and its continuous form z."""
    rows = table(spark, sf, "lineitem")
    u = uniform(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey"), 7)
    z = F.col("l_quantity") / 50 + F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0) + u - 0.5
    return rows.select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", z.alias("z"), (z > 0.7).cast("int").alias("y"))


def leaderboard(spark: SparkSession, sf: str, models: list[str], folds_: int = 3) -> DataFrame:
    from ..config import CVConfig, FEConfig, RunConfig
    from .automl import AutoML

    rows = planted(spark, sf).drop("z")
    config = RunConfig(n_boot=1000, run_mode="selection", cv=CVConfig(n_splits=folds_), fe=FEConfig(frequency_encoding=True, target_encoding=True))
    run = AutoML(Task("binary"), config, models).fit(rows, "y")
    return spark.createDataFrame(run.result.leaderboard, "model_id string, score double, rank int, in_band boolean, is_winner boolean")


@query()
def leaderboard_linear(spark, sf):
    return leaderboard(spark, sf, ["baseline", "linear"])


@query()
def leaderboard_trees(spark, sf):
    from .models import ZOO

    rows = planted(spark, sf).withColumn("rid", F.xxhash64("l_quantity", "l_extendedprice", "l_discount", "z")).withColumn("w", F.lit(1.0))
    rows = folds.kfold(rows, "rid", 2, exact=False)
    from .evaluate import evaluate

    r = evaluate([ZOO["baseline"], ZOO["forest"].with_params({"trees": 10, "max_depth": 4}), ZOO["gbt"].with_params({"trees": 5, "max_depth": 3})], rows, ["l_quantity", "l_extendedprice"], 2, "roc_auc", 2, significance="none", keep=False)
    return spark.createDataFrame(r.leaderboard, "model_id string, score double, rank int, in_band boolean, is_winner boolean")


# -- preparation ---------------------------------------------------------------------------------------------------
@query("select r_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by r_name")
def prep_join_star(spark, sf):
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    dims = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", "r_name"))  # 25 nations, whatever the scale
    full = o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == c.c_custkey, "left").join(dims, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return full.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""with r as (select o_custkey, avg(o_totalprice) as m, max(o_totalprice) as x, min(o_totalprice) as i, sum(o_totalprice) as s, count(*) as n from orders group by o_custkey)
select c_custkey, round(m, 6) as orders_o_totalprice_mean, x as orders_o_totalprice_max, i as orders_o_totalprice_min, round(s, 6) as orders_o_totalprice_sum, n as orders_count from customer left join r on c_custkey = o_custkey""")
def prep_rollup_customer(spark, sf):
    rolled = prep.roll_up(table(spark, sf, "orders"), "o_custkey", ["o_totalprice"], "orders")
    return rounded(prep.attach(table(spark, sf, "customer").select("c_custkey"), "c_custkey", rolled, "o_custkey"), 6)


_GAPS = "e as (select event_id, user_id, ts, case when event_id % 4 = 0 then null else value end as v from events)"


def _gaps(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 4 == 0, None).otherwise(F.col("value")).alias("v"))


@query(f"with {_GAPS} select event_id, coalesce(last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding), first_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following)) as filled from e")
def prep_ffill(spark, sf):
    return prep.forward_fill(_gaps(spark, sf), "user_id", ["ts", "event_id"], "v", "filled").select("event_id", "filled")


@query("""select event_id, lag(value, 7) over w as value_lag7, lag(value, 14) over w as value_lag14, lag(value, 28) over w as value_lag28,
round(case when count(value) over (partition by user_id order by ts, event_id rows between 7 preceding and 1 preceding) = 7 then avg(value) over (partition by user_id order by ts, event_id rows between 7 preceding and 1 preceding) end, 8) as mean7
from events window w as (partition by user_id order by ts, event_id)""")
def prep_lag_rolling(spark, sf):
    rows = prep.lags(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", [7, 14, 28])
    out = prep.rolling_mean(rows, "user_id", ["ts", "event_id"], "value", 7, "mean7").select("event_id", "value_lag7", "value_lag14", "value_lag28", F.round("mean7", 8).alias("mean7"))
    return out


@query("select o_orderkey, cast(isodow(o_orderdate) - 1 as integer) as weekday, cast(month(o_orderdate) as integer) as month, cast(day(o_orderdate) = 15 or cast(o_orderdate as date) = last_day(o_orderdate) as integer) as is_payday, cast(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as integer) as days_since from orders")
def prep_calendar(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *(c.alias(n) for n, c in prep.calendar(F.col("o_orderdate"), "1992-01-01").items()))


@query("select o_orderkey from orders where cast(o_orderdate as date) in (select cast(l_shipdate as date) from lineitem where l_quantity = 50)")
def prep_semi_dates(spark, sf):
    days = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.to_date("l_shipdate").alias("d"))
    return table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate")).join(days, "d", "left_semi").select("o_orderkey")


@query("""with c as (select c_custkey, c_acctbal, nullif(c_nationkey, 0)::double as k, case when c_custkey % 3 = 0 then null else c_acctbal end as b from customer)
select c_custkey, round(c_acctbal / k, 8) as ratio, round((coalesce(b, 0) + coalesce(k, 0)) / nullif((b is not null)::int + (k is not null)::int, 0), 8) as mean from c""")
def prep_ratios(spark, sf):
    c = table(spark, sf, "customer")
    k, b = F.nullif(F.col("c_nationkey"), F.lit(0)).cast("double"), F.when(F.col("c_custkey") % 3 == 0, None).otherwise(F.col("c_acctbal"))
    return rounded(c.select("c_custkey", F.try_divide("c_acctbal", k).alias("ratio"), prep.row_mean(b, k).alias("mean")))


@query("select event_id, coalesce(user_id::varchar, 'nan') || '_' || coalesce(nullif(event_type, 'view'), 'nan') as entity from events")
def prep_entity_key(spark, sf):
    return table(spark, sf, "events").select("event_id", prep.entity_key(F.col("user_id"), F.nullif(F.col("event_type"), F.lit("view"))).alias("entity"))


@query("select o_orderkey, round(ln(1 + o_totalprice), 8) as y, round(exp(ln(1 + o_totalprice)) - 1, 4) as back from orders")
def prep_log_target(spark, sf):
    y = F.log1p("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.round(y, 8).alias("y"), F.round(F.expm1(y), 4).alias("back"))


@query("""select cast(ts as date) as day, 'event_type' as column_name, count(*) as n_known, round(avg((event_type = 'purchase' and day(ts) > 20)::int::double), 8) as unseen_share from events group by 1""")
def unseen_by_day(spark, sf):
    from ..streaming.monitor import unseen_by_window

    e = table(spark, sf, "events")
    s = features.fit_categories(e, FeatureSchema(roles={"event_type": Role.CATEGORICAL}, dtypes={"event_type": "string"}))
    new = e.withColumn("event_type", F.when((F.col("event_type") == "purchase") & (F.dayofmonth("ts") > 20), "new").otherwise(F.col("event_type")))
    return rounded(unseen_by_window(new, s, "ts").select(F.to_date("window_start").alias("day"), "column_name", "n_known", "unseen_share"))
