import random
from collections import defaultdict
from datetime import timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillstone import queries
from quillstone.operators import joins, ledger, ranks, rights
from quillstone.operators import series as series_operators
from quillstone.operators.series import Collapse, series
from quillstone.plans.query import TableQuery, condition
from quillstone.sources import changes, tables
from quillstone.streaming import blocks


@pytest.mark.parametrize(("text", "n", "unit"), [("d", 1, "d"), ("3h", 3, "h"), ("0M", 1, "M"), ("-2w", 2, "w")])
def test_collapse(text, n, unit):
    assert Collapse.parse(text) == Collapse(n, unit)


@pytest.mark.parametrize("text", ["", "5", "x", "1.5d"])
def test_no_collapse(text):
    with pytest.raises(ValueError, match="no collapse"):
        Collapse.parse(text)


def test_filters_are_checked(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, name string")
    for bad in (TableQuery(("id", "id")), TableQuery(("x",)), TableQuery(("id",), (("y", "1"),)), TableQuery(("id",), (("id.like", "1"),))):
        with pytest.raises(ValueError, match="column|mode"):
            bad.run(rows)
    with pytest.raises(ValueError, match="range"):
        condition(F.col("id"), "rg", "1", "int")
    assert TableQuery(("id",), (("id.nin", ""),)).run(rows).count() == 1


def test_limit_is_clamped(spark):
    rows = spark.range(6000)
    assert TableQuery(("id",), key=("id",)).run(rows).count() == 500
    assert TableQuery(("id",), key=("id",), limit=9000).run(rows).count() == 5000


def test_empty_series_is_all_fills(spark):
    rows = spark.createDataFrame([], "ts timestamp_ntz, v long")
    got = series(rows, "ts", {"v": F.sum("v")}, "2M", "2024-01-15", "2024-07-01", fill="zero").collect()
    assert [(str(r.bucket)[:10], r.v) for r in got] == [("2024-01-01", 0), ("2024-03-01", 0), ("2024-05-01", 0)]


def test_rank_ties(spark):
    rows = spark.createDataFrame(list(enumerate([10, 10, 9, 8, 8], 1)), "id long, v long")
    assert [r["rank"] for r in ranks.ranked(rows, "v", "id").orderBy("id").collect()] == [1, 2, 2, 3, 4]


def test_rank_without_value(spark):
    rows = spark.createDataFrame([(1, 0), (2, 5), (3, None), (4, 5)], "id long, v long")
    assert [r["rank"] for r in ranks.ranked(rows, "v", "id").orderBy("id").collect()] == [None, 1, None, 2]


def test_brief_json_escapes(spark):
    import json

    rows = spark.createDataFrame([('q"\\\n\t\x01é', bytearray(b"\x0f\xa0"), True), (None, None, None)], "s string, b binary, t boolean")
    assert [json.loads(r.line) for r in tables.brief_json(rows).collect()] == [['q"\\\n\t\x01é', "0fa0", 1], [None, None, None]]


def test_limit_without_key_and_large_amounts(spark):
    rows = spark.range(6000).selectExpr("id", "id + 9007199254740993 as micro")
    assert TableQuery(("id",), limit=3).run(rows).count() == 3
    assert TableQuery(("id",), filters=(("micro", "9007199254.740993"),), scales={"micro": 10**6}).run(rows).collect()[0].id == 0


def test_two_branches_in_one_file(spark, tmp_path):
    """Arrival order within a micro-batch: 5a, 6a, then 5b to 8b, which replace them."""
    rows = [("m", h, f"{h}{b}", f"{h - 1}{a}", i) for i, (h, b, a) in enumerate([(3, "a", "a"), (4, "a", "a"), (5, "a", "a"), (6, "a", "a"), (5, "b", "a"), (6, "b", "b"), (7, "b", "b"), (8, "b", "b")])]
    schema = blocks.BLOCK + ", seq long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = blocks.delayed(blocks.read_blocks(spark, str(tmp_path / "in"), schema), 2, "seq")
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.schema(blocks.BLOCK).parquet(str(tmp_path / "out")).orderBy("height").collect()
    assert [r.hash for r in got] == ["3a", "4a", "5b", "6b"]


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(10)) for i in range(500)]
    got = ranks.running(spark.createDataFrame(rows, "id long, v long").repartition(7), [F.col("id")], {"s": F.col("v")}).orderBy("id").collect()
    total = 0
    for r, (_, v) in zip(got, rows, strict=True):
        total += v
        assert r.s == total


def greedy(moves):
    out, sources, sinks = [], [], []
    for i, a in moves:
        (sources if a > 0 else sinks).append([i, abs(a)])
    while sources and sinks:
        n = min(sources[0][1], sinks[0][1])
        out.append((sources[0][0], sinks[0][0], n))
        for side in (sources, sinks):
            side[0][1] -= n
            if not side[0][1]:
                side.pop(0)
    return out + [(i, None, n) for i, n in sources] + [(None, i, n) for i, n in sinks]


def test_fifo(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([-5, -2, -1, 0, 1, 3, 4])) for g in range(30) for i in range(rng.randrange(12))]
    got = defaultdict(list)
    for r in joins.fifo(spark.createDataFrame(rows, "g long, i long, a long"), "g", ["i"], "a", "i").collect():
        got[r.g].append((r.source, r.sink, r.amount))
    for g in range(30):
        want = greedy([(i, a) for k, i, a in rows if k == g and a])
        assert sorted(got[g], key=repr) == sorted(want, key=repr)


def test_pool_shares(spark):
    rng = random.Random(3)
    rows = [(p, i, rng.randrange(1, 1000) if i < 5 else rng.randrange(-50, 100)) for p in range(5) for i in range(20)]
    got = {r.pool: (r.stake, r.shares) for r in ledger.pool_shares(spark.createDataFrame(rows, "pool long, i long, a long"), "pool", "i", "a").collect()}
    for p in range(5):
        stake = shares = 0
        for _, _, a in sorted(r for r in rows if r[0] == p):
            new = a if not stake else (Fraction(a * shares, stake)).__floor__()
            stake, shares = stake + a, shares + new
        assert got[p] == (stake, shares)


def test_absent_rights(spark):
    rows = [(1, p, p % 3 == 0) for p in range(0, 200, 7)]
    maps = rights.bitmaps(spark.createDataFrame(rows, "b long, p long, u boolean"), ["b"], "p", "u")
    assert sorted(r.pos for r in rights.absent(maps, ["b"]).collect()) == [p for p in range(0, 200, 7) if p % 3]
    assert sorted(r.pos for r in rights.expanded(maps).collect()) == list(range(0, 200, 7))


def test_as_of_ties(spark):
    left = spark.createDataFrame([("k", 5, "a"), ("k", 4, "b"), ("z", 5, "c")], "k string, t long, n string")
    right = spark.createDataFrame([("k", 5, 50), ("k", 3, 30)], "k string, t long, v long")
    get = lambda strict: {r.n: r.v for r in joins.as_of(left, right, ["k"], "t", ["v"], strict).collect()}
    assert get(False) == {"a": 50, "b": 30, "c": None}
    assert get(True) == {"a": 30, "b": 30, "c": None}


def test_changes(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, v string")
    more = changes.inserted(table, spark.createDataFrame([("d",), ("c",)], "v string"))
    assert sorted(map(tuple, more.collect())) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    new = changes.updated(more, spark.createDataFrame([(2, "x")], "row_id long, v string"), "row_id")
    assert sorted(map(tuple, changes.deleted(new, F.col("v") == "a").collect())) == [(2, "x"), (3, "c"), (4, "d")]
    assert changes.deleted_keys(new, new.where("row_id < 3"), "row_id").count() == 2
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([5, 5, None, None, 5, 6])], "k long, t long, v long")
    assert sorted(r.t for r in changes.changed_only(rows, "k", "t", "v").collect()) == [0, 2, 4, 5]


def test_files(spark, tmp_path):
    rows = spark.sql("select 1 as id, 'q\"x' as s, true as b, timestamp_ntz'2024-01-02 03:04:05' as t, X'0aff' as h")
    assert tables.brief_json(rows.drop("h")).first().line == '[1,"q\\"x",1,"2024-01-02T03:04:05Z"]'
    tables.write_csv(rows, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["id,s,b,t,h", '1,"q\\"x",true,2024-01-02T03:04:05Z,0aff']
    assert str(rows.select(tables.money(F.lit(1234567)).alias("m")).first().m) == "1.234567"
    assert rows.select(tables.micro(F.lit(0.0000025)).alias("m")).first().m == 2


def chain(*names):
    return [(h, f"{h}{n}", f"{h - 1}{(names[h - 1] if h else '')}") for h, n in enumerate(names)]


def test_delay_and_forks():
    held, final = [], []
    feed = [*chain("a", "a", "a", "a"), (3, "3b", "2a"), (4, "4b", "3b"), (4, "4b", "3b"), (5, "5b", "4b")]
    for b in feed:
        held, done = blocks.accept(held, b, 2)
        final += done
    assert [b[1] for b in final] == ["0a", "1a", "2a", "3b"]
    with pytest.raises(ValueError, match="gap"):
        blocks.accept(held, (9, "9b", "8b"), 2)
    with pytest.raises(ValueError, match="below"):
        blocks.accept(held, (1, "1c", "0a"), 2)
    with pytest.raises(ValueError, match="parent"):
        blocks.accept(held, (5, "5c", "4c"), 2)


def test_delayed_stream(spark, tmp_path):
    feed = [*chain("a", "a", "a", "a"), (3, "3b", "2a"), (4, "4b", "3b"), (5, "5b", "4b")]
    for n, b in enumerate(feed):
        spark.createDataFrame([("c", *b)], blocks.BLOCK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{n:03d}"))
    stream = blocks.delayed(blocks.read_blocks(spark, str(tmp_path / "in" / "*")), 2)
    run = stream.writeStream.format("memory").queryName("final_blocks").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r.hash for r in spark.table("final_blocks").collect()) == ["0a", "1a", "2a", "3b"]


def test_replay(spark):
    rows = lambda feed: spark.createDataFrame([("c", *b) for b in feed], blocks.BLOCK)
    old, new = chain("a", "a", "a", "a"), [(2, "2b", "1a"), (3, "3b", "2b"), (4, "4b", "3b")]
    now = blocks.replayed(rows(old), rows([*old[:2], *new]))
    assert sorted(r.hash for r in now.collect()) == ["0a", "1a", "2b", "3b", "4b"]
    assert all(r.ok for r in blocks.tip_checked(now).collect())
    assert blocks.replayed(rows(old), rows(old)).count() == 4


def test_upsert_is_idempotent(spark, tmp_path):
    write = blocks.upsert(spark, str(tmp_path), ["k"], "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, t long, v long")
    write(rows(("a", 1, 1), ("a", 2, 2), ("b", 1, 9)), 0)
    for _ in range(2):
        write(rows(("a", 3, 3)), 1)
    assert sorted(map(tuple, blocks.latest_rows(spark, str(tmp_path), ["k"], "t").collect())) == [("a", 3, 3), ("b", 1, 9)]


def test_pool_shares_are_never_held_whole(spark):
    rows = [(p, i, (i * 7919) % 1000 - 300) for i in range(3000) for p in (None, 1, 2) if p != 2 or i < 3] + [(3, 0, 5), (3, 1, None), (3, 2, 7)]
    moves = spark.createDataFrame(rows, "pool long, i long, a long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        found = ledger.pool_shares(moves, "pool", "i", "a")
        got = {r.pool: (r.stake, r.shares) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for p in (None, 1, 2):
        stake = shares = 0
        for _, _, a in sorted((r for r in rows if r[0] == p), key=lambda r: r[1]):
            stake, shares = stake + a, shares + (a if stake == 0 else a * shares // stake)
        want[p] = stake, shares
    assert got == want | {3: (None, None)}
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_settled_blocks(spark):
    chain = [("x", h, f"{h}a", f"{h - 1}a") for h in range(1, 30)] + [("y", h, f"{h}a", f"{h - 1}a") for h in range(5, 8)]
    lost = [("x", 10, "10b", "9a"), ("x", 11, "11b", "10b"), ("x", 28, "28b", "27a")]
    table = lambda rows: spark.createDataFrame(rows, blocks.BLOCK)
    got = sorted(map(tuple, blocks.settled(table(chain + lost + chain[:3]), 4).collect()))
    assert got == sorted(r for r in chain if r[0] == "x" and r[1] <= 25)
    held, final = [], []
    for _, *block in chain[:29]:
        held, done = blocks.accept(held, tuple(block), 4)
        final += done
    assert final == [r[1:] for r in got]
    for wrong in (chain[:10] + chain[11:], [*chain, ("x", 9, "9c", "8c")]):
        with pytest.raises(ValueError):
            blocks.settled(table(wrong), 4)


def test_stream_delay_is_not_gathered(spark):
    found = queries.QUERIES["stream_delay"](spark, "/root/testdata/sf0.001")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert found.inputFiles() and found.count() == orders - 5


@pytest.mark.parametrize(
    ("collapse", "start", "end", "limit", "want"),
    [
        ("d", "2024-01-04T13:00", "2024-01-01T09:30", 500, ("2024-01-01", "2024-01-05")),
        ("d", None, "2024-01-16T05:00", 7, ("2024-01-10", "2024-01-17")),
        ("M", "2024-01-16T05:00", None, 3, ("2024-01-01", "2024-04-01")),
        ("M", "2024-04-16", None, 9, ("2024-04-01", "2024-06-01")),
        ("w", None, None, 2, ("2024-04-28", "2024-05-12")),
        ("q", None, None, 1, ("2024-04-01", "2024-07-01")),
        ("2h", "2024-05-04T23:10", "2024-05-04T23:50", 1, ("2024-05-04T23:00:00", "2024-05-05T01:00:00")),
        ("y", "2020-02-29", "2021-03-01", 1, ("2020-01-01", "2022-01-01")),
    ],
)
def test_series_windows(collapse, start, end, limit, want):
    low, high = series_operators.window_of(collapse, start, end, "2024-05-08T12:00", limit)
    assert (low, high) == tuple(x if "T" in x else f"{x}T00:00:00" for x in want)


def test_too_long_a_series():
    with pytest.raises(ValueError, match="more than"):
        series_operators.window_of("d", "2024-01-01", "2024-03-01", "2024-05-08", longest=timedelta(days=30))
