"""Change logs to states, double-entry balances, votes, and pool shares."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import latest


def live_state(log: DataFrame, key: list[str], order: list[Column], action: str, removes: tuple, values: list[str], until: Column | None = None) -> DataFrame:
    """The live value of each key after the log (up to ``until``, a condition): the last action of a key, unless it removes."""
    log = log if until is None else log.where(until)
    last = latest(log, key, order, [action, *values])
    return last.where(~F.col(action).isin(*removes)).select(*key, *values)


def flow_legs(flows: DataFrame, payer: str, payee: str, amount: str) -> DataFrame:
    """account, delta: what each flow takes from its payer and gives to its payee."""
    out = flows.where(F.col(payer).isNotNull()).select(F.col(payer).alias("account"), (-F.col(amount)).alias("delta"))
    return out.unionByName(flows.where(F.col(payee).isNotNull()).select(F.col(payee).alias("account"), F.col(amount).alias("delta")))


def balances(legs: DataFrame) -> DataFrame:
    """account, balance, n_in, n_out of signed legs."""
    return legs.groupBy("account").agg(F.sum("delta").alias("balance"), F.count_if(F.col("delta") > 0).alias("n_in"), F.count_if(F.col("delta") < 0).alias("n_out"))


def change_history(rows: DataFrame, by: str, order: list[str], delta: str) -> DataFrame:
    """``rows`` where the running balance changes: balance before and after, and whether the account was funded before."""
    window = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    after = F.sum(delta).over(window)
    out = rows.withColumn("balance", after).withColumn("prev_balance", F.col("balance") - F.col(delta))
    return out.where(F.col("balance") != F.col("prev_balance")).withColumn("was_funded", F.col("prev_balance") > 0)


def tally(ballots: DataFrame, period: str, choice: str, stake: str, voter: str) -> DataFrame:
    """Stake and voters of yay, nay and pass for each period, with turnout base and supermajority."""
    side = lambda c: F.col(choice) == c
    sums = [F.coalesce(F.sum(F.when(side(c), F.col(stake))), F.lit(0)).alias(f"{c}_stake") for c in ("yay", "nay", "pass")]
    counts = [F.count_if(side(c)).alias(f"{c}_voters") for c in ("yay", "nay", "pass")]
    out = ballots.groupBy(period).agg(*sums, *counts, F.sum(stake).alias("cast_stake"), F.count_distinct(voter).alias("voters"))
    return out.withColumn("is_supermajority", F.col("yay_stake") >= F.expr("((yay_stake + nay_stake) * 8) div 10"))


def plurality(votes: DataFrame, period: str, option: str, stake: str) -> DataFrame:
    """The option with most stake of each period; none where two have as much."""
    sums = votes.groupBy(period, option).agg(F.sum(stake).alias("stake"))
    best = sums.groupBy(period).agg(F.max("stake").alias("stake"))
    tied = sums.join(best, [period, "stake"]).groupBy(period, "stake").agg(F.count("*").alias("n"), F.min(option).alias("winner"))
    return tied.select(period, "stake", F.when(F.col("n") == 1, F.col("winner")).alias("winner"), (F.col("n") > 1).alias("is_draw"))


def quorum(turnout: DataFrame, by: str, order: str, value: str, start: int, low: int, high: int) -> DataFrame:
    """by, ema, quorum: the moving average ema = (8 ema + 2 turnout) div 10 over each group's ordered values (10000 is all)."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("bigint"))
    ema = F.aggregate("v", F.lit(start).cast("bigint"), lambda a, x: F.floor((a * 8 + x * 2) / 10).cast("bigint"))
    out = turnout.groupBy(by).agg(values.alias("v")).select(by, ema.alias("ema"))
    return out.withColumn("quorum", F.expr(f"{low} + (ema * ({high} - {low})) div 10000"))


def pool_shares(moves: DataFrame, pool: str, order: str, amount: str) -> DataFrame:
    """pool, stake, shares: deposits (positive) mint amount * shares div stake, withdrawals burn alike; an ordered fold for each pool.

    The first deposit gets as many shares as its amount. A pool's moves are sorted by Spark, which may spill, and pass by one after
    the other: a task holds one pool's stake and shares, however many moves it has.
    """
    amounts = F.col(amount) if moves.schema[amount].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.col(amount).cast("decimal(38,0)")
    dealt = moves.select(pool, order, amounts.alias(amount)).repartition(pool).sortWithinPartitions(pool, order, amount)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stake, shares, some = None, 0, 0, False
        kind = None
        for batch in batches:
            out = []
            kind = batch.schema.field(0).type
            for name, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not some or name != held:
                    if some:
                        out.append((held, stake, shares))
                    held, stake, shares, some = name, 0, 0, True
                if x is None or stake is None:  # an unknown amount leaves the rest unknown
                    stake = shares = None
                    continue
                x = int(x)
                stake, shares = stake + x, shares + (x if stake == 0 else x * shares // stake)
            yield rows(out, kind)
        if some:
            yield rows([(held, stake, shares)], kind)

    def rows(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((kind, pa.int64(), pa.int64()))], [pool, "stake", "shares"])

    return dealt.select(pool, amount).mapInArrow(fold, moves.select(pool).schema.add("stake", "long").add("shares", "long"))
