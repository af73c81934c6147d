"""More queries over the sample tables: lists, views, windows of series, writes, snapshots and reconciliation, each with its SQL.

The same reading of the tables as in ``queries``: blocks are orders, operations lineitems and events, accounts customers and users.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import ranks
from .operators.series import series, window_of
from .queries import E_MICRO, events, micro, query, t
from .sources import changes, tables

# Filters


@query("""
select l_orderkey, l_linenumber from lineitem where l_suppkey not in (select s_suppkey from supplier where s_name in ('Supplier#000000003', 'no such name'))""")
def anti_text_keys(spark, d):
    """Text keys become ids before the facts are filtered; an unknown one excludes nothing."""
    ids = t(spark, d, "supplier").where(F.col("s_name").isin("Supplier#000000003", "no such name")).select(F.col("s_suppkey").alias("l_suppkey"))
    return t(spark, d, "lineitem").join(ids, "l_suppkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("select event_id, user_id from events where event_type = 'purchase' and coalesce(floor(value), 0) = 0")
def filter_missing(spark, d):
    """The empty literal: rows that have no amount, null or none in whole units."""
    return t(spark, d, "events").where((F.col("event_type") == "purchase") & (F.coalesce(F.floor("value"), F.lit(0)) == 0)).select("event_id", "user_id")


@query("""
with life as (select user_id, min(event_id) as first, max(event_id) as last from events where event_type = 'purchase' group by 1)
select e.user_id, count(*) as n from events e join life l on l.user_id = e.user_id and e.event_id between greatest(l.first, 100) and least(l.last, 100000) group by 1""")
def filter_lifetime(spark, d):
    """An account's rows within its own first and last height, whatever wider range is asked for."""
    rows = t(spark, d, "events")
    life = rows.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    inside = F.col("event_id").between(F.greatest("first", F.lit(100)), F.least("last", F.lit(100000)))
    return rows.join(life, "user_id").where(inside).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""
select o_orderkey, o_orderdate from orders where o_orderdate in (select max(o_orderdate) from orders where o_orderdate <= timestamp '1995-06-17')
  or o_orderdate in (select max(o_orderdate) from orders where o_orderdate <= timestamp '1996-01-01')""")
def filter_times_as_heights(spark, d):
    """A list of times, each as the last block at or before it."""
    rows = t(spark, d, "orders")
    asked = [F.max(F.when(F.col("o_orderdate") <= F.lit(x).cast("timestamp_ntz"), F.col("o_orderdate"))).alias(f"t{i}") for i, x in enumerate(("1995-06-17", "1996-01-01"))]
    floors = rows.agg(*asked).select(F.explode(F.array("t0", "t1")).alias("o_orderdate"))  # two rows
    return rows.join(F.broadcast(floors), "o_orderdate", "left_semi").select("o_orderkey", "o_orderdate")


# Joins and virtual columns


@query("""
with a as (select l_suppkey as account, min(l_orderkey) as first_seen, max(l_orderkey) as last_seen from lineitem group by 1)
select account, first_seen, last_seen, f.o_orderdate as first_seen_time, l.o_orderdate as last_seen_time from a left join orders f on f.o_orderkey = first_seen left join orders l on l.o_orderkey = last_seen""")
def time_columns(spark, d):
    """Heights with their times."""
    rows = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("account")).agg(F.min("l_orderkey").alias("first_seen"), F.max("l_orderkey").alias("last_seen"))
    times = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    for name in ("first_seen", "last_seen"):
        rows = rows.join(times.select(F.col("o_orderkey").alias(name), F.col("o_orderdate").alias(f"{name}_time")), name, "left")
    return rows.select("account", "first_seen", "last_seen", "first_seen_time", "last_seen_time")


@query("""
with p as (select * from lineitem order by l_orderkey desc, l_linenumber desc limit 50)
select l_orderkey, l_linenumber, p_name, s_name from p left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey""")
def resolved_after_limit(spark, d):
    """Names are looked up for the rows of the page only: a semi-join's worth of ids reaches the large tables."""
    page = ranks.top(t(spark, d, "lineitem"), [F.desc("l_orderkey"), F.desc("l_linenumber")], 50).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    named = t(spark, d, "part").join(F.broadcast(page), F.col("p_partkey") == F.col("l_partkey"), "right").select(*page.columns, "p_name")  # a page of 50
    return t(spark, d, "supplier").join(F.broadcast(named), F.col("s_suppkey") == F.col("l_suppkey"), "right").select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("""
with k as (select o_custkey as account, sum(cast(round(o_totalprice * 1000000) as bigint))::bigint as staked, count(*) as blocks from orders group by 1)
select c_custkey, c_name, staked, blocks, n_name from customer join k on account = c_custkey left join nation on n_nationkey = c_nationkey""")
def holders_with_accounts(spark, d):
    """Bakers with their accounts, one to one."""
    own = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(micro("o_totalprice")).alias("staked"), F.count("*").alias("blocks"))
    names = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t(spark, d, "customer").join(own, "c_custkey").join(F.broadcast(names), "c_nationkey", "left").select("c_custkey", "c_name", "staked", "blocks", "n_name")


@query("""
select o_orderkey, count(*) filter (l_returnflag <> 'R') as n_ops, count(*) filter (l_returnflag = 'R') as n_endorsements,
  string_agg(case when l_returnflag <> 'R' then l_linenumber::varchar end, ',' order by l_linenumber) as ops, string_agg(case when l_returnflag = 'R' then l_linenumber::varchar end, ',' order by l_linenumber) as endorsements
from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def block_with_ops(spark, d):
    """A block with its operations and its endorsements, in order."""
    ops = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    of = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("l_linenumber")))).cast("array<string>"), ",")
    mark = F.col("l_returnflag") == "R"
    found = ops.agg(F.count_if(~mark).alias("n_ops"), F.count_if(mark).alias("n_endorsements"), of(~mark).alias("ops"), of(mark).alias("endorsements"))
    out = t(spark, d, "orders").select("o_orderkey").join(found, "o_orderkey", "left").na.fill(0, ["n_ops", "n_endorsements"])
    return out.select("o_orderkey", "n_ops", "n_endorsements", *(F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("ops", "endorsements")))


@query("""
with v as (select l_linenumber as period, l_suppkey as proposal, count(*) as votes, sum(cast(round(l_quantity) as bigint))::bigint as stake from lineitem group by 1, 2)
select period, count(*) as n_proposals, sum(votes)::bigint as votes, sum(stake)::bigint as stake, string_agg(proposal::varchar || ':' || stake::varchar, ',' order by stake desc, proposal) as proposals from v group by period""")
def election_nested(spark, d):
    """Periods with their proposals, most stake first."""
    votes = t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("period"), F.col("l_suppkey").alias("proposal")).agg(F.count("*").alias("votes"), F.sum(F.round("l_quantity").cast("bigint")).alias("stake"))
    each = F.sort_array(F.collect_list(F.struct((-F.col("stake")).alias("s"), "proposal")))
    text = F.array_join(F.transform(each, lambda x: F.concat_ws(":", x["proposal"], -x["s"])), ",")
    return votes.groupBy("period").agg(F.count("*").alias("n_proposals"), F.sum("votes").alias("votes"), F.sum("stake").alias("stake"), text.alias("proposals"))


# Lists

LIST_OPS = "select l_orderkey as height, l_linenumber as n, l_suppkey as sender, l_partkey as receiver from lineitem"


@query(f"select * from ({LIST_OPS}) where height = 7 order by n limit 20")
def ops_of_block(spark, d):
    return ranks.top(_ops(spark, d).where("height = 7"), [F.asc("n")], 20)


def _ops(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("height"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("sender"), F.col("l_partkey").alias("receiver"))


@query(f"select * from ({LIST_OPS}) where sender = 5 and (height, n) > (100, 2) order by height, n limit 100")
def account_sent(spark, d):
    """What an account sent, from a cursor on."""
    after = (F.col("height") > 100) | ((F.col("height") == 100) & (F.col("n") > 2))
    return ranks.top(_ops(spark, d).where((F.col("sender") == 5) & after), [F.asc("height"), F.asc("n")], 100)


@query(f"select * from ({LIST_OPS}) where receiver = 5 and sender <> 5 order by height desc, n desc limit 100")
def account_received(spark, d):
    return ranks.top(_ops(spark, d).where("receiver = 5 and sender <> 5"), [F.desc("height"), F.desc("n")], 100)


@query(f"""select *, case when sender = 5 and receiver = 5 then 'self' when sender = 5 then 'out' else 'in' end as direction from ({LIST_OPS}) where sender = 5 or receiver = 5""")
def account_both_ways(spark, d):
    rows = _ops(spark, d).where("sender = 5 or receiver = 5")
    return rows.withColumn("direction", F.expr("case when sender = 5 and receiver = 5 then 'self' when sender = 5 then 'out' else 'in' end"))


@query("""select event_id, ts, payload_kind, amount from (select event_id, ts, event_type as payload_kind, """ + E_MICRO + """ as amount from events where user_id = 3 and event_type in ('click', 'purchase')) order by event_id desc limit 40 offset 5""")
def contract_events(spark, d):
    rows = events(spark, d).where("user_id = 3 and event_type in ('click', 'purchase')").select("event_id", "ts", F.col("event_type").alias("payload_kind"), F.col("micro").alias("amount"))
    return ranks.top(rows, [F.desc("event_id")], 40, 5)


@query("""
with u as (select user_id as map, event_type as key, event_id, """ + E_MICRO + """ as value, lag(event_id) over (partition by user_id, event_type order by event_id) as prev from events)
select map, key, event_id, value, prev, case when prev is null then 'alloc' else 'update' end as action from u where map = 4""")
def map_updates(spark, d):
    """The updates of a map's keys, each with the one before of its key."""
    rows = events(spark, d).where("user_id = 4").select(F.col("user_id").alias("map"), F.col("event_type").alias("key"), "event_id", F.col("micro").alias("value"))
    rows = rows.withColumn("prev", F.lag("event_id").over(Window.partitionBy("map", "key").orderBy("event_id")))
    return rows.withColumn("action", F.when(F.col("prev").isNull(), "alloc").otherwise("update"))


@query("""
select l_orderkey as height, l_linenumber as n, l_suppkey as account, cast(round(l_extendedprice * 1000000) as bigint) as amount, l_orderkey + 5 as due from lineitem
where l_returnflag = 'R' and l_orderkey + 5 > (select max(o_orderkey) // 2 from orders)""")
def frozen_requests(spark, d):
    """Requests that are still frozen at a height: half of the chain."""
    top = t(spark, d, "orders").agg(F.expr("max(o_orderkey) div 2").alias("at"))  # one row
    rows = t(spark, d, "lineitem").where("l_returnflag = 'R'").crossJoin(F.broadcast(top)).where(F.col("l_orderkey") + 5 > F.col("at"))
    return rows.select(F.col("l_orderkey").alias("height"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("account"), micro("l_extendedprice").alias("amount"), (F.col("l_orderkey") + 5).alias("due"))


@query("""
with b as (select o_custkey as baker, sum(cast(round(o_totalprice) as bigint))::bigint as stake, max(o_orderkey) as last_seen, count(*) as blocks from orders group by 1),
c as (select *, stake * 9 // 10 - blocks * 1000 as free from b)
select baker, stake, free, free * 10000 // stake as free_pct, last_seen from c where free > 0 order by free_pct desc, baker limit 30""")
def bakers_suggested(spark, d):
    """Bakers with room for more delegation: capacity beyond what they hold, in ten-thousandths."""
    own = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("baker")).agg(F.sum(F.round("o_totalprice").cast("bigint")).alias("stake"), F.max("o_orderkey").alias("last_seen"), F.count("*").alias("blocks"))
    own = own.withColumn("free", F.expr("stake * 9 div 10 - blocks * 1000")).where("free > 0").withColumn("free_pct", F.expr("free * 10000 div stake"))
    return ranks.top(own.select("baker", "stake", "free", "free_pct", "last_seen"), [F.desc("free_pct"), F.asc("baker")], 30)


# Tokens, snapshots


MOVES = """
select o_orderkey as id, o_custkey as token, l_suppkey as owner, sum(case when l_returnflag = 'R' then -cast(round(l_quantity) as bigint) else cast(round(l_quantity) as bigint) end)::bigint as delta
from orders join lineitem on l_orderkey = o_orderkey group by 1, 2, 3"""


#: Lines of a task that joins and groups them by order; all of them are held at once, in sorters and hash maps.
LINES = 500_000


def parts_of(lines):
    """As many tasks as the lines need (a count reads file footers only): tasks don't grow with the tables."""
    return max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES))


def lines_of_orders(orders, lines, parts):
    """Orders with their lines, dealt by order."""
    return orders.repartition(parts, "o_orderkey").join(lines.repartition(parts, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))


@query(f"""
with m as ({MOVES}), s as (select id, token, sum(greatest(delta, 0))::bigint as plus, sum(greatest(-delta, 0))::bigint as minus, count(*) filter (delta > 0) as receivers, count(*) filter (delta < 0) as senders from m where delta <> 0 group by 1, 2)
select id, token, least(plus, minus) as transferred, greatest(plus - minus, 0) as minted, greatest(minus - plus, 0) as burned, receivers, senders from s""")
def token_reconciled(spark, d):
    """Balance changes of an operation as transfer, mint and burn: what both sides cover moved, the rest is new or gone."""
    lines = t(spark, d, "lineitem")
    rows = lines_of_orders(t(spark, d, "orders"), lines, parts_of(lines))
    n = F.round("l_quantity").cast("bigint")
    moves = rows.groupBy(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("token"), "l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", -n).otherwise(n)).alias("delta")).where("delta <> 0")
    sums = moves.groupBy("id", "token").agg(F.sum(F.greatest("delta", F.lit(0))).alias("plus"), F.sum(F.greatest(-F.col("delta"), F.lit(0))).alias("minus"), F.count_if(F.col("delta") > 0).alias("receivers"), F.count_if(F.col("delta") < 0).alias("senders"))
    return sums.selectExpr("id", "token", "least(plus, minus) as transferred", "greatest(plus - minus, 0L) as minted", "greatest(minus - plus, 0L) as burned", "receivers", "senders")


@query(f"""
with m as ({MOVES}), b as (select token, owner, sum(delta)::bigint as balance, min(id) as first_seen, max(id) as last_seen, count(*) as moves from m group by 1, 2)
select token, count(*) filter (balance > 0) as holders, sum(greatest(balance, 0))::bigint as supply, max(balance) as largest, count(*) as ever_held from b group by token""")
def token_holders(spark, d):
    """Holders are those with a balance above zero."""
    lines = t(spark, d, "lineitem")
    parts = parts_of(lines)
    rows = lines_of_orders(t(spark, d, "orders"), lines, parts).repartition(parts, "o_custkey", "l_suppkey")
    n = F.round("l_quantity").cast("bigint")
    own = rows.groupBy(F.col("o_custkey").alias("token"), "l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", -n).otherwise(n)).alias("balance"))
    return own.groupBy("token").agg(F.count_if(F.col("balance") > 0).alias("holders"), F.sum(F.greatest("balance", F.lit(0))).alias("supply"), F.max("balance").alias("largest"), F.count("*").alias("ever_held"))


@query("""
with s as (select o_orderkey // 64 as cycle, o_orderkey // 8 % 8 as idx, o_custkey as account, sum(cast(round(o_totalprice) as bigint))::bigint as stake from orders group by 1, 2, 3)
select cycle, idx, account, stake from s where idx = (cycle * 5 + 3) % 8 and stake > 100000""")
def snapshot_selected(spark, d):
    """Of the staged snapshots of a cycle one becomes final, the others and its small holders are pruned."""
    key = [F.expr("o_orderkey div 64").alias("cycle"), F.expr("o_orderkey div 8 % 8").alias("idx"), F.col("o_custkey").alias("account")]
    staged = t(spark, d, "orders").groupBy(*key).agg(F.sum(F.round("o_totalprice").cast("bigint")).alias("stake"))
    return staged.where("idx = (cycle * 5 + 3) % 8 and stake > 100000")


# Windows of series


@query(f"""
with s as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-04 23:59:59', interval 1 day)) as bucket),
a as (select date_trunc('day', ts) as bucket, count(*) as n, sum({E_MICRO})::bigint as volume from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-05' group by 1)
select s.bucket, coalesce(n, 0) as n, coalesce(volume, 0) as volume from s left join a using (bucket)""")
def series_swapped_ends(spark, d):
    """Ends in the wrong order are swapped, the last day counts whole."""
    low, high = window_of("d", "2024-01-04T13:00:00", "2024-01-01T09:30:00", now="2024-03-01")
    return series(events(spark, d), "ts", {"n": F.count("*"), "volume": F.sum("micro")}, "d", low, high)


@query(f"""
with s as (select unnest(generate_series(timestamp '2024-01-10', timestamp '2024-01-16', interval 1 day)) as bucket),
a as (select date_trunc('day', ts) as bucket, count(*) as n, sum({E_MICRO})::bigint as volume from events group by 1)
select s.bucket, coalesce(n, 0) as n, coalesce(volume, 0) as volume from s left join a using (bucket)""")
def series_default_start(spark, d):
    """Without a start so many buckets as the limit says, up to the end."""
    low, high = window_of("d", None, "2024-01-16T05:00:00", limit=7, now="2024-03-01")
    return series(events(spark, d), "ts", {"n": F.count("*"), "volume": F.sum("micro")}, "d", low, high)


@query("""
with s as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31 23:00:00', interval 1 hour)) as bucket),
a as (select date_trunc('hour', ts) as bucket, count(*) as n from events where event_type = 'refund' group by 1)
select s.bucket, coalesce(n, 0) as n from s left join a using (bucket) order by bucket desc limit 24""")
def series_limited(spark, d):
    """The limit counts filled buckets too."""
    return series(events(spark, d).where("event_type = 'refund'"), "ts", {"n": F.count("*")}, "h", "2024-01-01", "2024-02-01", limit=24, descending=True)


@query("""
with s as (select unnest(generate_series(date '1995-01-01', date '1995-12-31', interval 1 month))::timestamp as bucket),
a as (select date_trunc('month', o_orderdate)::timestamp as bucket, count(*) as n_blocks, sum(cast(round(o_totalprice * 1000000) as bigint))::bigint as rewards, count(*) filter (o_orderstatus = 'F') as n_final from orders
  where o_orderdate >= date '1995-01-01' and o_orderdate < date '1996-01-01' group by 1)
select s.bucket, coalesce(n_blocks, 0) as n_blocks, coalesce(rewards, 0) as rewards, coalesce(n_final, 0) as n_final from s left join a using (bucket)""")
def series_blocks(spark, d):
    sums = {"n_blocks": F.count("*"), "rewards": F.sum(micro("o_totalprice")), "n_final": F.count_if(F.col("o_orderstatus") == "F")}
    rows = t(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    return series(rows, "o_orderdate", sums, "M", "1995-01-01", "1996-01-01")


# Writes


@query("""
select c_custkey as row_id, c_name from customer
union all select (select max(c_custkey) from customer) + row_number() over (order by s_suppkey), s_name from supplier""")
def write_insert(spark, d):
    """Inserted rows get the numbers after the table's last."""
    table = t(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("row_id"), F.col("c_name"))
    rows = t(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("c_name"))
    return changes.inserted(table, rows, order=[F.col("s_suppkey")])


@query("select s_suppkey, case when s_suppkey % 3 = 0 then 'renamed ' || s_name else s_name end as s_name from supplier")
def write_update(spark, d):
    table = t(spark, d, "supplier").select("s_suppkey", "s_name")
    return changes.updated(table, table.where("s_suppkey % 3 = 0").withColumn("s_name", F.concat(F.lit("renamed "), "s_name")), "s_suppkey")


@query("select c_custkey, c_acctbal from customer where not coalesce(c_acctbal < 0, false) and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def write_delete(spark, d):
    """Deleted by a predicate, then by ids."""
    rich = changes.deleted(t(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 0)
    return changes.deleted_keys(rich, t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")


@query("select p_partkey, (p_retailprice::decimal(38, 6))::varchar as price, lower(hex(p_name)) as name from part")
def rendered(spark, d):
    """Money with six places, bytes as hex."""
    rows = t(spark, d, "part")
    return rows.select("p_partkey", tables.money(micro("p_retailprice")).cast("string").alias("price"), F.lower(F.hex("p_name")).alias("name"))


@query("""
with p as (select l_orderkey, l_linenumber from lineitem where l_quantity > 10 order by 1, 2 limit 500)
select count(*) as n_rows, max(l_orderkey)::varchar || ',' || max_by(l_linenumber, (l_orderkey, l_linenumber))::varchar as cursor from p""")
def result_trailer(spark, d):
    """What follows a page: its rows and the cursor of the next."""
    page = ranks.top(t(spark, d, "lineitem").where("l_quantity > 10").select("l_orderkey", "l_linenumber"), [F.asc("l_orderkey"), F.asc("l_linenumber")], 500)
    return tables.trailer(page, ["l_orderkey", "l_linenumber"])
