"""The queries of the engine's own operators over the sample tables, each with the SQL that gives the same rows.

Blocks are orders (height o_orderkey), operations lineitems (height, number) and events, accounts customers and users.
Amounts are whole micro-units, so sums don't depend on their order.
"""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import joins, ledger, ranks, rights, rollups
from .operators.series import seeded, series
from .plans.query import TableQuery
from .sources import tables
from .streaming import blocks

QUERIES: dict = {}
SQL: dict[str, str] = {}
JAN = ("2024-01-01", "2024-02-01")
E_MICRO = "cast(round(value * 1000000) as bigint)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def micro(name: str):
    return F.round(F.col(name) * 1_000_000).cast("bigint")


def t(spark, d, name):
    return tables.table(spark, d, name)


def events(spark, d):
    return t(spark, d, "events").withColumn("micro", micro("value"))


# Time series


def _series(collapse, fill, **kind):
    def run(spark, d):
        rows = events(spark, d).where("event_type = 'purchase'")
        return series(rows, "ts", {"n": F.count("*"), "volume": F.sum("micro")}, collapse, *JAN, fill=fill, **kind)

    return run


def _series_sql(select, spine="date_trunc('day', ts)", step="interval 1 day", low="2024-01-01", join="left join"):
    return f"""
with s as (select unnest(generate_series(timestamp '{low}', timestamp '2024-01-31 23:59:59', {step})) as bucket),
a as (select {spine} as bucket, count(*) as n, sum({E_MICRO})::bigint as volume from events
  where event_type = 'purchase' and ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01' group by 1),
j as (select s.bucket, a.n, a.volume from s {join} a on a.bucket = s.bucket)
{select}"""


ZERO = "select bucket, coalesce(n, 0) as n, coalesce(volume, 0) as volume from j"
for name, (collapse, fill, sql) in {
    "series_sum_zero": ("d", "zero", _series_sql(ZERO)),
    "series_null": ("h", "null", _series_sql("select bucket, n, volume from j", "date_trunc('hour', ts)", "interval 1 hour")),
    "series_none": ("h", "none", _series_sql("select bucket, n, volume from a", "date_trunc('hour', ts)", "interval 1 hour")),
    "series_last": ("h", "last", _series_sql("select bucket, last_value(n ignore nulls) over w as n, last_value(volume ignore nulls) over w as volume from j window w as (order by bucket rows unbounded preceding)", "date_trunc('hour', ts)", "interval 1 hour")),
    "series_week_sunday": ("w", "zero", _series_sql(ZERO, "date_trunc('week', ts + interval 1 day) - interval 1 day", "interval 7 day", "2023-12-31")),
    "series_three_days": ("3d", "zero", _series_sql(ZERO, "timestamp '2024-01-01' + to_days((date_diff('day', timestamp '2024-01-01', ts) // 3 * 3)::int)", "interval 3 day")),
    "series_linear": ("h", "linear", _series_sql("""
, e as (select bucket, epoch(bucket)::bigint as x, n, volume, case when n is not null then epoch(bucket)::bigint end as tx from j),
k as (select *, last_value(n ignore nulls) over b as na, last_value(volume ignore nulls) over b as va, last_value(tx ignore nulls) over b as ta,
  first_value(n ignore nulls) over f as nb, first_value(volume ignore nulls) over f as vb, first_value(tx ignore nulls) over f as tb from e
  window b as (order by bucket rows unbounded preceding), f as (order by bucket rows between current row and unbounded following))
select bucket, coalesce(n, na + trunc(((x - ta) * (nb - na))::decimal(38,0) // (tb - ta)), na, nb)::bigint as n, coalesce(volume, va + ((x - ta)::hugeint * (vb - va)) // (tb - ta), va, vb)::bigint as volume from k""", "date_trunc('hour', ts)", "interval 1 hour")),
}.items():
    QUERIES[name], SQL[name] = _series(collapse, fill), sql


def _calendar(unit):
    def run(spark, d):
        return series(t(spark, d, "orders").withColumn("micro", micro("o_totalprice")), "o_orderdate", {"n": F.count("*"), "volume": F.sum("micro"), "last_height": F.max("o_orderkey")}, unit, "1995-01-01", "2002-01-01")

    return run


for name, unit, width, step in (("series_month", "M", "month", "1 month"), ("series_quarter", "q", "quarter", "3 month"), ("series_year", "y", "year", "1 year")):
    QUERIES[name] = _calendar(unit)
    SQL[name] = f"""
with s as (select unnest(generate_series(timestamp '1995-01-01', timestamp '2001-12-31', interval {step})) as bucket),
a as (select date_trunc('{width}', o_orderdate)::timestamp as bucket, count(*) as n, sum(cast(round(o_totalprice * 1000000) as bigint))::bigint as volume, max(o_orderkey) as last_height
  from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '2002-01-01' group by 1)
select s.bucket, coalesce(n, 0) as n, coalesce(volume, 0) as volume, coalesce(last_height, 0) as last_height from s left join a on a.bucket = s.bucket"""


@query("""
with s as (select unnest(generate_series(timestamp '2024-01-10', timestamp '2024-01-19', interval 1 day)) as bucket),
r as (select user_id, ts, event_id, sum(cast(round(value * 1000000) as bigint)) over (partition by user_id order by ts, event_id)::bigint as balance from events),
b as (select user_id, bucket from (select distinct user_id from events where ts < timestamp '2024-01-20') cross join s)
select user_id, bucket, (select balance from r where r.user_id = b.user_id and r.ts < b.bucket + interval 1 day order by ts desc, event_id desc limit 1) as balance from b""")
def series_balance_seed(spark, d):
    window = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events(spark, d).withColumn("balance", F.sum("micro").over(window))
    rows = joins.latest(rows, ["user_id", "ts"], [F.col("event_id")], ["balance"])
    return seeded(rows, "user_id", "ts", "balance", "d", "2024-01-10", "2024-01-20")


@query("""
select date_trunc('day', o_orderdate)::timestamp as bucket, max(o_orderkey) as height, arg_max(o_custkey, o_orderkey) as creator, arg_max(o_orderstatus, o_orderkey) as status
from orders group by 1""")
def series_snapshot_last(spark, d):
    last = {"height": F.max("o_orderkey"), "creator": F.max_by("o_custkey", "o_orderkey"), "status": F.max_by("o_orderstatus", "o_orderkey")}
    return series(t(spark, d, "orders"), "o_orderdate", last, "d", "1990-01-01", "2010-01-01", fill="none")


# Scans and filters


@query("select o_orderkey as height, o_custkey as creator, o_totalprice as volume from orders where o_orderstatus = 'F'")
def scan_project(spark, d):
    return tables.project(t(spark, d, "orders").where("o_orderstatus = 'F'"), ["height", "creator", "volume"], {"height": "o_orderkey", "creator": "o_custkey", "volume": "o_totalprice"})


@query("select c_custkey, c_name from customer where c_custkey = 7")
def point_lookup(spark, d):
    return tables.lookup(t(spark, d, "customer"), "c_custkey", 7).select("c_custkey", "c_name")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def multi_lookup(spark, d):
    ids = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return tables.lookup_many(t(spark, d, "orders"), "o_custkey", ids).select("o_orderkey", "o_custkey")


@query("select count(*) as n from events where event_type = 'error'")
def count_rows(spark, d):
    return t(spark, d, "events").where("event_type = 'error'").agg(F.count("*").alias("n"))


def _lineitems(*filters, **kind):
    columns = ("height", "op_n", "quantity")
    return TableQuery(columns, filters, {"height": "l_orderkey", "op_n": "l_linenumber", "quantity": "l_quantity", "flag": "l_returnflag", "part": "l_partkey", "supplier": "l_suppkey", "price": "l_extendedprice"}, **kind)


LI = "select l_orderkey as height, l_linenumber as op_n, l_quantity as quantity from lineitem where "


@query(LI + "l_quantity >= 40 and l_quantity < 45 and l_returnflag <> 'N'")
def filter_compare(spark, d):
    return _lineitems(("quantity.gte", "40"), ("quantity.lt", "45"), ("flag.ne", "N")).run(t(spark, d, "lineitem"))


@query(LI + "l_returnflag in ('A', 'R') and l_linenumber not in (1, 2, 3)")
def filter_in_notin(spark, d):
    return _lineitems(("flag.in", "A,R"), ("op_n.nin", "1,2,3")).run(t(spark, d, "lineitem"))


@query(LI + "l_partkey between 100 and 200 and false")
def filter_empty_list(spark, d):
    return _lineitems(("part.rg", "100,200"), ("flag.in", "")).run(t(spark, d, "lineitem"))


@query(LI + "l_quantity between 10 and 12")
def filter_range(spark, d):
    return _lineitems(("quantity.rg", "10,12")).run(t(spark, d, "lineitem"))


@query(LI + "(l_partkey = 17 or l_suppkey = 17)")
def filter_or_any_party(spark, d):
    return _lineitems(("address", "17"), any_party={"address": ("l_partkey", "l_suppkey")}).run(t(spark, d, "lineitem"))


@query(LI + "l_partkey not in (17, 18) and l_suppkey not in (17, 18) and l_linenumber = 4")
def filter_no_party(spark, d):
    return _lineitems(("address.nin", "17,18"), ("op_n", "4"), any_party={"address": ("l_partkey", "l_suppkey")}).run(t(spark, d, "lineitem"))


@query("select event_id, event_type from events where (event_type = 'purchase' and value > 50) or (event_type = 'click' and user_id = 3)")
def filter_nested(spark, d):
    rows = t(spark, d, "events")
    legs = [tables.all_of([F.col("event_type") == "purchase", F.col("value") > 50]), tables.all_of([F.col("event_type") == "click", F.col("user_id") == 3])]
    return rows.where(tables.any_of(legs)).select("event_id", "event_type")


@query("select event_id from events where json_extract_string(props, '$.k') = '5'")
def filter_json_path(spark, d):
    return t(spark, d, "events").where(F.get_json_object("props", "$.k") == "5").select("event_id")


@query(f"select event_id, {E_MICRO} as micro from events where {E_MICRO} >= 75500000")
def filter_money(spark, d):
    q = TableQuery(("event_id", "micro"), (("micro.gte", "75.5"),), scales={"micro": 1_000_000})
    return q.run(events(spark, d))


@query("select o_orderkey from orders where o_orderkey >= (select max(o_orderkey) from orders where o_orderdate <= timestamp '1997-06-01')")
def filter_time_as_height(spark, d):
    rows = t(spark, d, "orders")
    height = rows.where(F.col("o_orderdate") <= F.lit("1997-06-01").cast("timestamp_ntz")).agg(F.max("o_orderkey").alias("h"))
    return rows.join(F.broadcast(height), F.col("o_orderkey") >= F.col("h")).select("o_orderkey")  # one row


@query("""
with s as (select user_id, min(ts) as start_ts, max(ts) as end_ts from events group by user_id)
select user_id from s where end_ts >= timestamp '2024-01-05' and start_ts <= timestamp '2024-01-06'""")
def interval_overlap(spark, d):
    spans = t(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return joins.overlapping(spans, "a", "b", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-06").cast("timestamp_ntz")).select("user_id")


@query("""
with v as (select user_id, min(ts) as alloc, max(case when event_type = 'error' then ts end) as gone from events group by user_id)
select user_id from v where alloc <= timestamp '2024-01-15' and (gone is null or gone > timestamp '2024-01-15')""")
def validity_filter(spark, d):
    at = F.lit("2024-01-15").cast("timestamp_ntz")
    v = t(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("b"))
    return v.where((F.col("a") <= at) & (F.col("b").isNull() | (F.col("b") > at))).select("user_id")


# Pages, order, ranks


@query(LI + "(l_orderkey < 5000 or (l_orderkey = 5000 and (l_linenumber < 3 or (l_linenumber = 3 and l_partkey < 100)))) order by l_orderkey desc, l_linenumber desc, l_partkey desc limit 100")
def cursor_page_composite(spark, d):
    return _lineitems(key=("l_orderkey", "l_linenumber", "l_partkey"), cursor=(5000, 3, 100), limit=100, descending=True).run(t(spark, d, "lineitem"))


@query(LI + "l_returnflag = 'R' order by l_orderkey, l_linenumber, l_partkey limit 50 offset 200")
def page_offset(spark, d):
    return _lineitems(("flag", "R"), key=("l_orderkey", "l_linenumber", "l_partkey"), limit=50, offset=200).run(t(spark, d, "lineitem"))


@query("""
select l_orderkey, l_linenumber from lineitem where l_orderkey in (select distinct l_orderkey from lineitem order by 1 limit 20 offset 30)""")
def group_page_offset(spark, d):
    return ranks.group_page(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], 20, 30)


@query("""
with v as (select user_id, count(*) as n from events group by user_id), r as (select *, dense_rank() over (order by n desc) as dr from v)
select user_id, n, coalesce(lag(dr) over (order by n desc, user_id) + 1, 1) as rank from r""")
def rank_quirk(spark, d):
    return ranks.ranked(t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")), "n", "user_id")


@query("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 10 offset 5")
def topn_offset(spark, d):
    return ranks.top(t(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 10, 5)


@query("""
with l as (select l_partkey as party, cast(round(l_extendedprice * 1000000) as bigint) as v from lineitem where l_extendedprice > 0
  union all select l_suppkey, cast(round(l_extendedprice * 1000000) as bigint) from lineitem where l_extendedprice > 0)
select party, sum(v)::bigint as volume, count(*) as traffic from l group by party""")
def volume_traffic(spark, d):
    rows = t(spark, d, "lineitem").where("l_extendedprice > 0").withColumn("v", micro("l_extendedprice"))
    legs = rows.select(F.col("l_partkey").alias("party"), "v").unionByName(rows.select(F.col("l_suppkey").alias("party"), "v"))
    return legs.groupBy("party").agg(F.sum("v").alias("volume"), F.count("*").alias("traffic"))


# Joins


@query("""
with p as (select o_orderkey, o_orderdate, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as parent from orders)
select p.o_orderkey, p.parent, greatest(0, date_diff('second', q.o_orderdate, p.o_orderdate)) as solve_time from p left join orders q on q.o_orderkey = p.parent""")
def join_parent_left(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderdate", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("parent"))
    parent = t(spark, d, "orders").select(F.col("o_orderkey").alias("parent"), F.col("o_orderdate").alias("before"))
    gone = F.timestamp_diff("SECOND", F.col("before"), F.col("o_orderdate"))
    return rows.join(parent, "parent", "left").select("o_orderkey", "parent", F.when(gone.isNotNull(), F.greatest(F.lit(0), gone)).otherwise(0).cast("bigint").alias("solve_time"))


@query("""
select o_orderkey, coalesce((select string_agg(l_linenumber::varchar || ':' || l_partkey::varchar, ',' order by l_linenumber, l_partkey) from lineitem where l_orderkey = o_orderkey), '') as ops from orders""")
def join_children_collect(spark, d):
    out = joins.with_children(t(spark, d, "orders").select("o_orderkey"), t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", ["l_linenumber"], ["l_partkey"])
    text = F.transform("children", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    return out.select("o_orderkey", F.concat_ws(",", text).alias("ops"))


@query("select o_orderkey, c_name as address, n_name as nation from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey")
def join_dim_lookup(spark, d):
    people = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    nations = F.broadcast(t(spark, d, "nation"))  # 25 rows at any scale
    return t(spark, d, "orders").join(people, "o_custkey", "left").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", F.col("c_name").alias("address"), F.col("n_name").alias("nation"))


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_name = 'nobody')")
def semi_join_unknown_key(spark, d):
    ids = t(spark, d, "customer").where("c_name = 'nobody'").select("c_custkey")
    return tables.lookup_many(t(spark, d, "orders"), "o_custkey", ids).select("o_orderkey")


@query("""
with p as (select * from events where event_type = 'purchase'), v as (select user_id, ts, max(event_id) as event_id from events where event_type = 'view' group by user_id, ts)
select p.event_id, v.event_id as view_id from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts""")
def asof_join_latest(spark, d):
    rows = t(spark, d, "events")
    views = rows.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return joins.as_of(rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", ["view_id"]).select("event_id", "view_id")


@query("""
with b as (select date_trunc('day', ts)::timestamp as day, ts, event_id from events), o as (select date_trunc('day', ts)::timestamp as day, max(ts) as ts from events where event_type = 'signup' group by 1)
select e.event_id, (select max(s.ts) from events s where s.event_type = 'signup' and s.user_id = e.user_id and s.ts < e.ts) as since from events e where e.event_type = 'error'""")
def asof_floor_time(spark, d):
    rows = t(spark, d, "events")
    signups = rows.where("event_type = 'signup'").select("user_id", "ts", F.col("ts").alias("since"))
    return joins.as_of(rows.where("event_type = 'error'").select("event_id", "user_id", "ts"), signups, ["user_id"], "ts", ["since"], strict=True).select("event_id", "since")


@query("select o_custkey, arg_max(o_orderkey, o_orderkey) as last_order, arg_max(o_orderstatus, o_orderkey) as last_status from orders where o_orderkey <= 20000 group by o_custkey")
def latest_before(spark, d):
    rows = t(spark, d, "orders").where("o_orderkey <= 20000").withColumn("last_order", F.col("o_orderkey")).withColumnRenamed("o_orderstatus", "last_status")
    return joins.latest(rows, ["o_custkey"], [F.col("o_orderkey")], ["last_order", "last_status"])


PARAMS = [(1, 0, 4095, 32), (2, 4096, 16383, 64), (3, 16384, -1, 128)]


@query("""
with p as (select * from (values (1, 0, 4095, 32), (2, 4096, 16383, 64), (3, 16384, -1, 128)) v(version, lo, hi, width))
select o_orderkey, version, (o_orderkey - lo) // width as snapshot from orders left join p on o_orderkey >= lo and o_orderkey <= case when hi < 0 then 4611686018427387904 else hi end""")
def range_dim_join(spark, d):
    dim = spark.createDataFrame(PARAMS, "version int, lo bigint, hi bigint, width int")
    return joins.in_range(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", dim, "lo", "hi").select("o_orderkey", "version", F.expr("(o_orderkey - lo) div width").alias("snapshot"))


@query("""
select event_id, ts, event_type, user_id, cast(round(value * 1000000) as bigint) as amount, false as is_order from events where event_type <> 'click'
union all select o_orderkey, o_orderdate, 'order', o_custkey, cast(round(o_totalprice * 1000000) as bigint), true from orders where o_orderstatus = 'O'
order by ts, event_id limit 200""")
def union_lift(spark, d):
    a = events(spark, d).where("event_type <> 'click'").select("event_id", "ts", "event_type", "user_id", F.col("micro").alias("amount"), F.lit(False).alias("is_order"))
    b = t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("ts"), F.lit("order").alias("event_type"), F.col("o_custkey").alias("user_id"), micro("o_totalprice").alias("amount"), F.lit(True).alias("is_order"))
    return ranks.top(a.unionByName(b), [F.col("ts"), F.col("event_id")], 200)


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def absent_anti(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# Rollups


@query("""
select l_orderkey as height, count(*) as n_ops, count(*) filter (l_returnflag = 'R') as n_returns, sum(case when l_returnflag <> 'R' then cast(round(l_extendedprice * 1000000) as bigint) else 0 end)::bigint as volume,
sum(cast(round(l_tax * 1000000) as bigint))::bigint as fee, bool_or(l_linestatus = 'O') as has_open from lineitem group by l_orderkey""")
def rollup_conditional(spark, d):
    return rollups.block_rollup(t(spark, d, "lineitem"))


@query("""
with b as (select o_orderdate, count(*) as n, count(*) filter (o_orderstatus = 'F') as n_final from orders group by o_orderdate)
select o_orderdate, sum(n) over w::bigint as n_total, sum(n_final) over w::bigint as n_final_total from b window w as (order by o_orderdate rows unbounded preceding)""")
def cumulative_counters(spark, d):
    blocks = t(spark, d, "orders").groupBy("o_orderdate").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"))
    return ranks.running(blocks, [F.col("o_orderdate")], {"n_total": F.col("n"), "n_final_total": F.col("n_final")}).select("o_orderdate", "n_total", "n_final_total")


@query(f"""
with h as (select date_trunc('hour', ts)::timestamp as hour, sum(case when event_type = 'signup' then {E_MICRO} else 0 end) as minted, sum(case when event_type = 'error' then {E_MICRO} else 0 end) as burned,
  sum(case when event_type = 'purchase' then {E_MICRO} else 0 end) as frozen from events group by 1)
select hour, (sum(minted) over w - sum(burned) over w)::bigint as total, (sum(minted) over w - sum(burned) over w - sum(frozen) over w)::bigint as liquid from h window w as (order by hour rows unbounded preceding)""")
def supply_totals(spark, d):
    of = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("micro")).otherwise(0))
    hours = events(spark, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(of("signup").alias("m"), of("error").alias("b"), of("purchase").alias("f"))
    total = F.col("m") - F.col("b")
    return ranks.running(hours, [F.col("hour")], {"total": total, "liquid": total - F.col("f")}).select("hour", "total", "liquid")


EPOCH = "o_orderkey // 4096"


@query(f"""
with l as (select o_orderkey, {EPOCH} as cycle, cast(round(o_totalprice * 1000000) as bigint) as v from orders)
select cycle, min(v) as v_min, max(v) as v_max, sum(v)::bigint as v_sum, min(o_orderkey) as first_height, max(o_orderkey) as last_height,
(select o_orderkey from l b where b.cycle = l.cycle order by v desc, o_orderkey limit 1) as best_height, (select o_orderkey from l b where b.cycle = l.cycle order by v, o_orderkey limit 1) as worst_height from l group by cycle""")
def epoch_minmax_argmax(spark, d):
    return rollups.epochs(t(spark, d, "orders").select("o_orderkey", micro("o_totalprice").alias("v")), "o_orderkey", "v", 4096)


@query(f"select {EPOCH} as cycle, count(distinct o_custkey) as n_creators from orders group by 1")
def distinct_per_epoch(spark, d):
    return t(spark, d, "orders").groupBy(F.expr("o_orderkey div 4096").alias("cycle")).agg(F.count_distinct("o_custkey").alias("n_creators"))


@query("select l_suppkey, sum(cast(round(l_quantity * 100) as bigint))::bigint // count(*) as avg_quantity from lineitem where l_shipdate >= timestamp '1996-01-01' group by l_suppkey")
def int_avg(spark, d):
    rows = t(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return rows.groupBy("l_suppkey").agg(F.sum(F.round(F.col("l_quantity") * 100).cast("bigint")).alias("s"), F.count("*").alias("n")).select("l_suppkey", F.expr("s div n").alias("avg_quantity"))


@query(f"""
with l as (select date_trunc('week', ts)::timestamp as cycle, user_id as account, event_type as kind, {E_MICRO} as v from events)
select cycle, account, sum(case when kind = 'signup' then v else 0 end)::bigint as deposit, sum(case when kind = 'purchase' then v else 0 end)::bigint as reward, sum(case when kind = 'error' then -v else 0 end)::bigint as lost,
sum(case when kind in ('signup', 'purchase') then v when kind = 'error' then -v else 0 end)::bigint as total from l group by cycle, account""")
def income_statement(spark, d):
    legs = events(spark, d).select(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("cycle"), F.col("user_id").alias("account"), F.col("event_type").alias("kind"), F.col("micro").alias("amount"))
    return rollups.income(legs)


@query("""
with s as (select o_custkey as account, o_orderkey // 4096 as cycle, sum(cast(round(o_totalprice) as bigint))::bigint as stake, count(*) as earned from orders group by 1, 2),
w as (select *, sum(stake) over (partition by cycle)::bigint as all_stake, sum(earned) over (partition by cycle)::bigint as all_earned from s)
select cycle, account, (stake * all_earned * 1000) // all_stake as expected, case when (stake * all_earned * 1000) // all_stake > 0 then 10000 + (earned * 1000 - (stake * all_earned * 1000) // all_stake) * 10000 / ((stake * all_earned * 1000) // all_stake) end::double as luck from w""")
def luck_kpi(spark, d):
    rows = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("account"), F.expr("o_orderkey div 4096").alias("cycle")).agg(F.sum(F.round("o_totalprice").cast("bigint")).alias("stake"), F.count("*").alias("earned"))
    return rollups.luck(rows)


@query("""
with p as (select l_suppkey as baker, l_orderkey // 4096 as cycle, (l_orderkey % 4096) * 8 + l_linenumber as pos, bool_or(l_returnflag <> 'R') as used from lineitem group by 1, 2, 3),
r as (select baker, cycle, count(*) as granted, count(*) filter (used) as used from p group by 1, 2)
select baker, cycle, granted, used, used * 10000 // granted as reliability from r""")
def reliability_bits(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("baker"), F.expr("l_orderkey div 4096").alias("cycle"), F.expr("(l_orderkey % 4096) * 8 + l_linenumber").alias("pos"), (F.col("l_returnflag") != "R").alias("used"))
    return rights.reliability(rights.bitmaps(rows, ["baker", "cycle"], "pos", "used"), ["baker", "cycle"])


@query("""
with r as (select l_suppkey as baker, l_orderkey as height, bool_or(l_returnflag = 'R') as used from lineitem group by 1, 2)
select baker, height, lead(height) over w as next_height, max(case when used then height end) over (w rows between unbounded preceding and 1 preceding) as last_used
from r window w as (partition by baker order by height)""")
def next_right(spark, d):
    """Each right with its baker's next one, and the last used one before it. A window holds one baker's rights."""
    rows = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("baker"), F.col("l_orderkey").alias("height")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("used"))
    by = Window.partitionBy("baker").orderBy("height")
    last = F.max(F.when(F.col("used"), F.col("height"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("baker", "height", F.lead("height").over(by).alias("next_height"), last.alias("last_used"))


@query("select o_custkey, count(distinct l_suppkey) as n_holders, sum(cast(round(l_quantity) as bigint))::bigint as supply from lineitem join orders on o_orderkey = l_orderkey group by o_custkey")
def holder_stats(spark, d):
    rows = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_custkey").agg(F.count_distinct("l_suppkey").alias("n_holders"), F.sum(F.round("l_quantity").cast("bigint")).alias("supply"))


@query("""
with c as (select user_id, event_type, count(*) as n from events group by 1, 2)
select user_id, string_agg(event_type || '=' || n::varchar, ',' order by event_type) as calls from c group by user_id""")
def call_stats(spark, d):
    counts = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    each = F.array_sort(F.collect_list(F.concat_ws("=", "event_type", F.col("n").cast("string"))))
    return counts.groupBy("user_id").agg(F.concat_ws(",", each).alias("calls"))


@query("""
with b as (select o_orderkey as height, (o_orderkey % 3)::bigint as round, (o_orderkey % 7)::bigint as missed from orders order by o_orderkey desc limit 127),
a as (select *, (row_number() over (order by height desc) - 1) as age from b)
select greatest(0, round(100 - sum((2 * round + missed * 50 / 7) / (age + 1)), 6)) as health from a""")
def health_score(spark, d):
    blocks = t(spark, d, "orders").select(F.col("o_orderkey").alias("height"), (F.col("o_orderkey") % 3).alias("round"), (F.col("o_orderkey") % 7).alias("missed"))
    return rollups.health(blocks, 7)


@query("""
with m as (select max(o_orderdate) as b, min(o_orderdate) as a, count(*) as n, count(*) filter (o_orderdate < timestamp '1996-01-01') as n0 from orders)
select round((n - n0) / greatest(date_diff('day', a, b), 1) * 365 / n0 * 100, 6) as percent from m""")
def annualized_pct(spark, d):
    sums = t(spark, d, "orders").agg(F.max("o_orderdate").alias("b"), F.min("o_orderdate").alias("a"), F.count("*").alias("n"), F.count_if(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).alias("n0"))
    days = F.greatest(F.datediff("b", "a"), F.lit(1))
    return sums.select(F.round((F.col("n") - F.col("n0")) / days * 365 / F.col("n0") * 100, 6).alias("percent"))


# Votes


@query("""
with b as (select extract(year from o_orderdate)::bigint as period, o_custkey as voter, case o_orderstatus when 'F' then 'yay' when 'O' then 'nay' else 'pass' end as ballot, cast(round(o_totalprice) as bigint) as stake from orders),
s as (select period, coalesce(sum(stake) filter (ballot = 'yay'), 0)::bigint as yay_stake, coalesce(sum(stake) filter (ballot = 'nay'), 0)::bigint as nay_stake, coalesce(sum(stake) filter (ballot = 'pass'), 0)::bigint as pass_stake,
count(*) filter (ballot = 'yay') as yay_voters, count(*) filter (ballot = 'nay') as nay_voters, count(*) filter (ballot = 'pass') as pass_voters, sum(stake)::bigint as cast_stake, count(distinct voter) as voters from b group by period)
select *, yay_stake >= (yay_stake + nay_stake) * 8 // 10 as is_supermajority from s""")
def vote_tally(spark, d):
    return ledger.tally(_ballots(spark, d), "period", "ballot", "stake", "voter")


def _ballots(spark, d):
    choice = F.when(F.col("o_orderstatus") == "F", "yay").when(F.col("o_orderstatus") == "O", "nay").otherwise("pass")
    return t(spark, d, "orders").select(F.year("o_orderdate").cast("bigint").alias("period"), F.col("o_custkey").alias("voter"), choice.alias("ballot"), F.round("o_totalprice").cast("bigint").alias("stake"), "o_orderpriority", "o_orderkey")


@query("""
with s as (select extract(year from o_orderdate)::bigint as period, o_orderpriority, sum(1)::bigint as stake from orders group by 1, 2), m as (select period, max(stake) as stake from s group by period)
select m.period, m.stake, case when count(*) = 1 then min(o_orderpriority) end as winner, count(*) > 1 as is_draw from m join s on s.period = m.period and s.stake = m.stake group by 1, 2""")
def vote_winner(spark, d):
    return ledger.plurality(_ballots(spark, d).withColumn("one", F.lit(1).cast("bigint")), "period", "o_orderpriority", "one")


@query("""
with y as (select o_orderpriority as chain, extract(year from o_orderdate)::bigint as period, (count(*) * 10000 // 4000)::bigint as turnout from orders group by 1, 2),
l as (select chain, list(turnout order by period) as v from y group by chain)
select chain, list_reduce(list_prepend(7000::bigint, v), lambda a, x: (a * 8 + x * 2) // 10) as ema, 2000 + (list_reduce(list_prepend(7000::bigint, v), lambda a, x: (a * 8 + x * 2) // 10) * 5000) // 10000 as quorum from l""")
def quorum_ema(spark, d):
    rows = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("chain"), F.year("o_orderdate").cast("bigint").alias("period")).agg(F.expr("count(*) * 10000 div 4000").alias("turnout"))
    return ledger.quorum(rows, "chain", "period", "turnout", 7000, 2000, 7000)


# States


LIVE = "select user_id, {e} as value_micro from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events {w}) where r = 1 and event_type <> 'error'"


@query(LIVE.format(e=E_MICRO, w=""))
def cdc_live_state(spark, d):
    rows = events(spark, d).withColumnRenamed("micro", "value_micro")
    return ledger.live_state(rows, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type", ("error",), ["value_micro"])


@query(LIVE.format(e=E_MICRO, w="where ts < timestamp '2024-01-12'"))
def cdc_state_at(spark, d):
    rows = events(spark, d).withColumnRenamed("micro", "value_micro")
    until = F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz")
    return ledger.live_state(rows, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type", ("error",), ["value_micro"], until)


@query(f"""
with r as (select event_id, user_id, ts, case when event_type = 'view' then 0 when event_type = 'error' then -{E_MICRO} else {E_MICRO} end as delta from events),
b as (select *, sum(delta) over (partition by user_id order by ts, event_id)::bigint as balance from r)
select event_id, user_id, balance, (balance - delta)::bigint as prev_balance, balance - delta > 0 as was_funded from b where delta <> 0""")
def balance_change_history(spark, d):
    delta = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "error", -F.col("micro")).otherwise(F.col("micro"))
    return ledger.change_history(events(spark, d).withColumn("delta", delta), "user_id", ["ts", "event_id"], "delta").select("event_id", "user_id", "balance", "prev_balance", "was_funded")


@query("""
with l as (select o_custkey as account, -cast(round(l_extendedprice * 1000000) as bigint) as delta from lineitem join orders on o_orderkey = l_orderkey union all select 1000000 + l_suppkey, cast(round(l_extendedprice * 1000000) as bigint) from lineitem)
select account, sum(delta)::bigint as balance, count(*) filter (delta > 0) as n_in, count(*) filter (delta < 0) as n_out from l group by account""")
def ledger_balance(spark, d):
    flows = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("payer"), (F.col("l_suppkey") + 1_000_000).alias("payee"), micro("l_extendedprice").alias("amount"))
    return ledger.balances(ledger.flow_legs(flows, "payer", "payee", "amount"))


@query(f"""
with d as (select user_id, event_id, case when event_type in ('signup', 'purchase') then {E_MICRO} when event_type = 'error' then -{E_MICRO} end as a from events where event_type in ('signup', 'purchase', 'error') and {E_MICRO} <> 0),
c as (select *, sum(abs(a)) over (partition by user_id, a > 0 order by event_id)::bigint as hi from d), i as (select *, hi - abs(a) as lo from c),
s as (select user_id, event_id as source, lo, hi from i where a > 0), k as (select user_id, event_id as sink, lo, hi from i where a < 0),
o as (select user_id, coalesce(sum(a) filter (a > 0), 0) as tin, coalesce(-sum(a) filter (a < 0), 0) as tout from d group by user_id)
select s.user_id, source, sink, (least(s.hi, k.hi) - greatest(s.lo, k.lo))::bigint as amount from s join k on s.user_id = k.user_id and s.lo < k.hi and k.lo < s.hi
union all select s.user_id, source, null, (hi - greatest(lo, tout))::bigint from s join o using (user_id) where hi > tout
union all select k.user_id, null, sink, (hi - greatest(lo, tin))::bigint from k join o using (user_id) where hi > tin""")
def fifo_match(spark, d):
    sign = F.when(F.col("event_type").isin("signup", "purchase"), F.col("micro")).when(F.col("event_type") == "error", -F.col("micro")).otherwise(0)
    return joins.fifo(events(spark, d).withColumn("a", sign), "user_id", ["event_id"], "a", "event_id")


@query()
def pool_share_fold(spark, d):
    moves = events(spark, d).where("event_type in ('signup', 'purchase')").select((F.col("user_id") % 50).alias("pool"), F.struct("ts", "event_id").alias("at"), F.greatest("micro", F.lit(1)).alias("amount"))
    return ledger.pool_shares(moves, "pool", "at", "amount")


@query("""
with m as (select user_id, event_type as ns, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) as v from events where event_type <> 'error' group by 1, 2)
select user_id, string_agg(ns || '=' || coalesce(v, ''), ',' order by ns) as meta from m group by user_id""")
def metadata_fold(spark, d):
    rows = t(spark, d, "events").where("event_type <> 'error'").withColumn("v", F.get_json_object("props", "$.k"))
    last = joins.latest(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], ["v"])
    each = F.array_sort(F.collect_list(F.concat_ws("=", "event_type", F.coalesce("v", F.lit("")))))
    return last.groupBy("user_id").agg(F.concat_ws(",", each).alias("meta"))


@query("""
select user_id, event_id, date_sub('second', lag(ts) over (partition by user_id order by ts, event_id), ts) as idle from events where event_type = 'purchase'""")
def age_since_last(spark, d):
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", F.timestamp_diff("SECOND", F.lag("ts").over(window), F.col("ts")).alias("idle"))


@query("""
select l_orderkey as height, count(*) as n, sum(cast(round(l_extendedprice * 1000000) as bigint))::bigint as volume, string_agg(l_linenumber::varchar, ',' order by l_linenumber) as members from lineitem group by 1""")
def op_tree(spark, d):
    return rollups.trees(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("height"), F.col("l_linenumber").alias("op_n"), micro("l_extendedprice").alias("volume")))


@query("""select '[' || o_orderkey::varchar || ',"' || o_orderstatus || '",' || (case when o_orderstatus = 'F' then 1 else 0 end)::varchar || ',"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '"]' as line from orders""")
def sink_brief_json(spark, d):
    return tables.brief_json(t(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderstatus") == "F").alias("final"), "o_orderdate"))


@query("""select '{"n_nationkey":' || n_nationkey::varchar || ',"n_name":"' || n_name || '"}' as line from nation""")
def sink_verbose_json(spark, d):
    return tables.verbose_json(t(spark, d, "nation").select("n_nationkey", "n_name"))


@query("select event_id, event_id * 65536 + user_id % 65536 as packed, (event_id * 65536 + user_id % 65536) // 65536 as height, (event_id * 65536 + user_id % 65536) % 65536 as op_n from events")
def packed_ids(spark, d):
    packed = F.shiftleft("event_id", 16).bitwiseOR((F.col("user_id") % 65536))
    return t(spark, d, "events").select("event_id", packed.alias("packed"), F.shiftright(packed, 16).alias("height"), packed.bitwiseAND(F.lit(65535)).alias("op_n"))


# Streams and reorganisations


def _chain(rows, branch):
    name = F.concat_ws("", F.col("o_orderkey").cast("string"), branch)
    return rows.select(F.lit("main").alias("chain"), F.col("o_orderkey").alias("height"), name.alias("hash"), (F.col("o_orderkey") - 1).cast("string").alias("parent"))


@query("""
with m as (select (min(o_orderkey) + max(o_orderkey)) // 2 as fork from orders)
select 'main' as chain, o_orderkey as height, o_orderkey::varchar || case when o_orderkey >= fork then 'b' else 'a' end as hash, (o_orderkey - 1)::varchar as parent from orders, m""")
def reorg_replay(spark, d):
    """A branch from the middle height on replaces the old one up to the top."""
    rows = t(spark, d, "orders")
    fork = rows.agg(F.expr("(min(o_orderkey) + max(o_orderkey)) div 2").alias("fork"))  # one row
    branch = F.when(F.col("o_orderkey") >= F.col("fork"), "b").otherwise("a")
    return blocks.replayed(_chain(rows, F.lit("a")), _chain(rows.crossJoin(F.broadcast(fork)), branch))


@query()
def stream_delay(spark, d):
    """The orders as a stream of blocks, all but the last five final."""
    rows = spark.readStream.schema(t(spark, d, "orders").schema).parquet(f"{d}/order[s].parquet")  # a pattern: the source takes no single file
    return blocks.settled(blocks.landed(_chain(rows, F.lit(""))), 5)


@query("""
with g as (select event_id, user_id, ts, case when date_diff('second', lag(ts) over w, ts) is null or epoch_us(ts) - epoch_us(lag(ts) over w) > 86400000000 then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id))
select user_id, n as spell, count(*) as events, min(ts) as since from (select *, sum(fresh) over (partition by user_id order by ts, event_id)::bigint as n from g) group by 1, 2""")
def activity_spells(spark, d):
    """Runs of an account's events without a day's pause: grace periods after which it counts as idle."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by).cast("timestamp"))
    rows = t(spark, d, "events").withColumn("fresh", F.when(pause.isNull() | (pause > 86_400_000_000), 1).otherwise(0))
    return rows.withColumn("spell", F.sum("fresh").over(by)).groupBy("user_id", "spell").agg(F.count("*").alias("events"), F.min("ts").alias("since"))


@query("""
with o as (select l_orderkey, l_suppkey, sum(cast(round(l_quantity) as bigint))::bigint as d from lineitem group by 1, 2)
select l_suppkey as owner, sum(d)::bigint as volume, max(d) as most, count(*) as n_transfers, min(l_orderkey) as first_height, max(l_orderkey) as last_height from o group by 1""")
def owner_stats(spark, d):
    rows = t(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum(F.round("l_quantity").cast("bigint")).alias("d"))
    return rows.groupBy(F.col("l_suppkey").alias("owner")).agg(F.sum("d").alias("volume"), F.max("d").alias("most"), F.count("*").alias("n_transfers"), F.min("l_orderkey").alias("first_height"), F.max("l_orderkey").alias("last_height"))


@query("""
with s as (select o_orderkey // 4096 as cycle, o_custkey as account, sum(cast(round(o_totalprice) as bigint))::bigint as stake from orders group by 1, 2)
select a.cycle, a.account, a.stake, b.stake as stake_before, c.stake as stake_after from s a left join s b on b.account = a.account and b.cycle = a.cycle - 1 left join s c on c.account = a.account and c.cycle = a.cycle + 1""")
def cycle_neighbours(spark, d):
    rows = t(spark, d, "orders").groupBy(F.expr("o_orderkey div 4096").alias("cycle"), F.col("o_custkey").alias("account")).agg(F.sum(F.round("o_totalprice").cast("bigint")).alias("stake"))
    near = lambda step, name: rows.select((F.col("cycle") + step).alias("cycle"), "account", F.col("stake").alias(name))
    return rows.join(near(1, "stake_before"), ["cycle", "account"], "left").join(near(-1, "stake_after"), ["cycle", "account"], "left")


@query("""
select c.c_custkey as voter, coalesce(count(distinct o_orderpriority), 0) as n_proposals, coalesce(sum(cast(round(o_totalprice) as bigint)), 0)::bigint as stake, count(o_orderkey) > 0 as has_voted from customer c left join orders on o_custkey = c.c_custkey group by 1""")
def voter_list(spark, d):
    cast = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("o_orderpriority").alias("n"), F.sum(F.round("o_totalprice").cast("bigint")).alias("s"))
    zero = F.lit(0).cast("bigint")
    return t(spark, d, "customer").join(cast, "c_custkey", "left").select(F.col("c_custkey").alias("voter"), F.coalesce("n", zero).alias("n_proposals"), F.coalesce("s", zero).alias("stake"), F.col("n").isNotNull().alias("has_voted"))


@query("""
select s_nationkey as region_id, string_agg(s_suppkey::varchar, ',' order by s_acctbal desc, s_suppkey) as by_balance, count(*) filter (s_acctbal > 0) as n_funded from supplier group by 1""")
def snapshot_members(spark, d):
    rows = t(spark, d, "supplier")
    each = F.array_sort(F.collect_list(F.struct((-F.col("s_acctbal")).alias("b"), F.col("s_suppkey").alias("i"))))
    return rows.groupBy(F.col("s_nationkey").alias("region_id")).agg(F.concat_ws(",", F.transform(each, lambda x: x["i"].cast("string"))).alias("by_balance"), F.count_if(F.col("s_acctbal") > 0).alias("n_funded"))


@query("select min(o_orderkey) as height, min(o_orderdate) as time from orders where o_orderdate >= timestamp '1998-03-15'")
def first_at_or_after(spark, d):
    rows = t(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1998-03-15").cast("timestamp_ntz"))
    return rows.agg(F.min("o_orderkey").alias("height"), F.min("o_orderdate").alias("time"))


@query("""
select sum(cast(round(l_extendedprice * 1000000) as bigint)) filter (l_orderkey // 4096 between 1 and 2 and l_returnflag = 'A')::bigint as unfrozen, sum(cast(round(l_extendedprice * 1000000) as bigint)) filter (l_orderkey // 4096 > 2)::bigint as frozen from lineitem""")
def conditional_sum(spark, d):
    cycle, v = F.expr("l_orderkey div 4096"), micro("l_extendedprice")
    return t(spark, d, "lineitem").agg(F.sum(F.when(cycle.between(1, 2) & (F.col("l_returnflag") == "A"), v)).alias("unfrozen"), F.sum(F.when(cycle > 2, v)).alias("frozen"))


@query("""
with m as (select max(o_orderkey) as h from orders where o_orderkey <= 1000 and o_orderstatus = 'F')
select o_orderkey // 100 as batch, count(*) as n, sum(cast(round(o_totalprice) as bigint))::bigint as stake from orders, m where o_orderkey // 100 = m.h // 100 group by 1""")
def latest_group_sum(spark, d):
    rows = t(spark, d, "orders").withColumn("batch", F.expr("o_orderkey div 100"))
    last = rows.where("o_orderkey <= 1000 and o_orderstatus = 'F'").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").groupBy("batch").agg(F.count("*").alias("n"), F.sum(F.round("o_totalprice").cast("bigint")).alias("stake"))  # one row


# More lists and derived figures


@query(f"""
with m as (select max(ts) as b from events)
select count(*) filter (event_type = 'signup') as n_signups, count(*) filter (event_type = 'error') as n_errors, coalesce(sum({E_MICRO}) filter (event_type = 'purchase'), 0)::bigint as volume
from events, m where ts >= b - interval 7 day""")
def interval_sum(spark, d):
    """Growth over the last week of the table."""
    rows = events(spark, d)
    last = F.broadcast(rows.agg((F.max("ts") - F.expr("interval 7 days")).alias("since")))  # one row
    volume = F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("micro"))), F.lit(0).cast("bigint"))
    counts = [F.count_if(F.col("event_type") == kind).alias(name) for name, kind in (("n_signups", "signup"), ("n_errors", "error"))]
    return rows.join(last, F.col("ts") >= F.col("since")).agg(*counts, volume.alias("volume"))


@query("""
with g as (select *, case when lag(event_type) over (partition by user_id order by ts, event_id) is distinct from event_type then 1 else 0 end as fresh from events),
h as (select *, sum(fresh) over (partition by user_id order by ts, event_id)::bigint as part from g)
select user_id, part, min(event_type) as event_type, count(*) as n_ops, min(ts) as since from h group by user_id, part""")
def collapsed_groups(spark, d):
    """Consecutive operations of one kind by one account as one row."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = (~F.lag("event_type").over(by).eqNullSafe(F.col("event_type"))).cast("bigint")
    rows = t(spark, d, "events").withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(by))
    return rows.groupBy("user_id", "part").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n_ops"), F.min("ts").alias("since"))


@query(LI + "l_returnflag in ('A', 'R') and l_linestatus in ('F', 'O') and l_linenumber = 2")
def filter_composite_key(spark, d):
    """All combinations of two short lists as keys of a semi-join."""
    keys = spark.createDataFrame([(a, b) for a in "AR" for b in "FO"], "l_returnflag string, l_linestatus string")
    rows = t(spark, d, "lineitem").where("l_linenumber = 2").join(F.broadcast(keys), ["l_returnflag", "l_linestatus"], "left_semi")  # four rows
    return rows.select(F.col("l_orderkey").alias("height"), F.col("l_linenumber").alias("op_n"), F.col("l_quantity").alias("quantity"))


@query("select event_id from events where cast(round(value * 10000) as bigint) between 55000 and 120000")
def filter_percent(spark, d):
    rows = t(spark, d, "events").withColumn("rate", F.round(F.col("value") * 10_000).cast("bigint"))
    return TableQuery(("event_id",), (("rate.rg", "550,1200"),), scales={"rate": 100}).run(rows)


@query("""
with m as (select min(o_orderkey) as lo, max(o_orderkey) as hi from orders where o_orderdate between timestamp '1996-01-01' and timestamp '1996-03-31')
select o_orderkey from orders, m where o_orderkey between lo and hi""")
def filter_time_range_as_heights(spark, d):
    rows = t(spark, d, "orders")
    within = F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-03-31").cast("timestamp_ntz"))
    ends = F.broadcast(rows.where(within).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")))  # one row
    return rows.join(ends, F.col("o_orderkey").between(F.col("lo"), F.col("hi"))).select("o_orderkey")


@query("select l_suppkey from lineitem where l_returnflag = 'R' and l_quantity > 48 intersect select l_suppkey from lineitem where l_linestatus = 'O' and l_quantity < 3")
def rights_intersect(spark, d):
    rows = t(spark, d, "lineitem")
    return rows.where("l_returnflag = 'R' and l_quantity > 48").select("l_suppkey").intersect(rows.where("l_linestatus = 'O' and l_quantity < 3").select("l_suppkey"))


@query("""
with p as (select c_custkey as id, row_number() over (order by c_acctbal desc, c_custkey) as rank from customer order by c_acctbal desc, c_custkey limit 100),
l as (select l_orderkey, l_linenumber, 'sender' as side, l_partkey as id from lineitem union all select l_orderkey, l_linenumber, 'receiver', l_suppkey from lineitem)
select l_orderkey, l_linenumber, side, id, rank from l join p using (id)""")
def rank_enrichment(spark, d):
    """Operations with a party among the hundred richest, and that party's rank."""
    rich = ranks.top(t(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), [F.desc("c_acctbal"), F.col("id")], 100)
    rich = rich.select("id", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "id")).cast("bigint").alias("rank"))  # 100 rows
    rows = t(spark, d, "lineitem")
    legs = [rows.select("l_orderkey", "l_linenumber", F.lit(side).alias("side"), F.col(c).alias("id")) for side, c in (("sender", "l_partkey"), ("receiver", "l_suppkey"))]
    return legs[0].unionByName(legs[1]).join(F.broadcast(rich), "id")


@query("""
with s as (select c_custkey, true as sponsored from customer where c_acctbal > 8000 order by md5(c_custkey::varchar) limit 10),
n as (select c_custkey, false as sponsored from customer where c_acctbal <= 8000 order by md5(c_custkey::varchar) limit 20)
select c_custkey, sponsored from (select *, row_number() over (order by sponsored desc, md5(c_custkey::varchar)) as r from (select * from s union all select * from n)) where r <= 20""")
def suggestion_sample(spark, d):
    """A repeatable random choice of twenty, half of them sponsored at most."""
    rows = t(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 8000).alias("sponsored"), F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("by"))
    some = ranks.top(rows.where("sponsored"), [F.col("by")], 10).unionByName(ranks.top(rows.where("not sponsored"), [F.col("by")], 20))
    return ranks.top(some, [F.desc("sponsored"), F.col("by")], 20).select("c_custkey", "sponsored")


@query("""
with a as (select l_orderkey, count(*) as n_lines from lineitem group by 1),
r as (select l_orderkey, string_agg(l_linenumber::varchar, ',' order by l_linenumber) as returns from lineitem where l_returnflag = 'R' group by 1),
e as (select user_id, count(*) as n_events from events group by 1)
select o_orderkey, coalesce(n_lines, 0) as n_lines, coalesce(returns, '') as returns, coalesce(n_events, 0) as n_events from orders
left join a on a.l_orderkey = o_orderkey left join r on r.l_orderkey = o_orderkey left join e on e.user_id = o_custkey""")
def join_several_children(spark, d):
    """Each kind of child is aggregated to one row a parent before it is joined."""
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")))).alias("back"))
    users = t(spark, d, "events").groupBy(F.col("user_id").alias("o_custkey")).agg(F.count("*").alias("n_events"))
    zero = F.lit(0).cast("bigint")
    returns = F.coalesce(F.concat_ws(",", F.transform("back", lambda x: x.cast("string"))), F.lit(""))
    rows = t(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left").join(users, "o_custkey", "left")
    return rows.select("o_orderkey", F.coalesce("n_lines", zero).alias("n_lines"), returns.alias("returns"), F.coalesce("n_events", zero).alias("n_events"))


@query("""
with f as (select user_id, min(date_trunc('day', ts))::timestamp as first_day from events group by 1), d as (select distinct date_trunc('day', ts)::timestamp as day, user_id from events)
select day, count(*) as n_accounts, count(*) filter (first_day = day) as n_new, (count(*) - count(*) filter (first_day = day)) * 10000 // count(*) as reuse from d join f using (user_id) group by 1""")
def account_reuse(spark, d):
    """The share of a day's accounts that were seen before, in hundredths of a percent."""
    days = t(spark, d, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "user_id").distinct()
    known = days.withColumn("fresh", F.col("day") == F.min("day").over(Window.partitionBy("user_id")))
    sums = known.groupBy("day").agg(F.count("*").alias("n_accounts"), F.count_if("fresh").alias("n_new"))
    return sums.withColumn("reuse", F.expr("(n_accounts - n_new) * 10000 div n_accounts"))


@query(f"""
select date_trunc('day', ts)::timestamp as bucket, coalesce(sum({E_MICRO}) filter (event_type in ('signup', 'purchase')), 0)::bigint as amount_in, coalesce(sum({E_MICRO}) filter (event_type = 'error'), 0)::bigint as amount_out, count(*) as n
from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01' group by 1""")
def series_flow(spark, d):
    rows = events(spark, d).withColumn("come", F.when(F.col("event_type").isin("signup", "purchase"), F.col("micro")).otherwise(0)).withColumn("gone", F.when(F.col("event_type") == "error", F.col("micro")).otherwise(0))
    return series(rows, "ts", {"amount_in": F.sum("come"), "amount_out": F.sum("gone"), "n": F.count("*")}, "d", *JAN, fill="none")


@query("""
with c as (select o_orderkey // 4096 as cycle, count(*) as n, count(*) filter (o_orderstatus = 'F') as n_final, count(distinct o_custkey) as n_creators from orders group by 1)
select cycle, n * 10000 // 4096 as filled, n_final * 10000 // n as final_rate, n_creators * 10000 // n as spread from c""")
def cycle_rates(spark, d):
    sums = t(spark, d, "orders").groupBy(F.expr("o_orderkey div 4096").alias("cycle")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.count_distinct("o_custkey").alias("n_creators"))
    return sums.selectExpr("cycle", "n * 10000 div 4096 as filled", "n_final * 10000 div n as final_rate", "n_creators * 10000 div n as spread")
