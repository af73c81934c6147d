"""Block streams: a delay that holds back what may still be replaced, and replay from a fork.

A block has height, hash and parent. The delay emits a block once ``depth`` later ones stand on it; a block whose parent is not
the newest held one replaces the held ones from its height on. Deeper forks are repaired in batch: rows from the
fork's height on are dropped and the new branch takes their place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ranks import checkpointed, shared_folder

BLOCK = "chain string, height long, hash string, parent string"


def read_blocks(spark: SparkSession, path: str, schema: str = BLOCK, files: int = 1) -> DataFrame:
    """A stream of the Parquet files that land in a folder, ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def accept(held: list[tuple], block: tuple, depth: int) -> tuple[list[tuple], list[tuple]]:
    """The blocks held after ``block`` (height, hash, parent), oldest first, and those that became final.

    A block that is held already changes nothing. One that leaves a gap, or forks below what is held, is an error.
    """
    height, name, parent = block
    if any(name == h[1] for h in held):
        return held, []
    if held:
        if height > held[-1][0] + 1:
            raise ValueError(f"gap before block {height}")
        if height < held[0][0]:
            raise ValueError(f"fork at {height} is below the delay")
        held = [h for h in held if h[0] < height]
        if held and held[-1][1] != parent:
            raise ValueError(f"block {height} has no parent here")
    held = [*held, block]
    cut = max(0, len(held) - depth)
    return held[cut:], held[:cut]


def delayed(blocks: DataFrame, depth: int, order: str = "height") -> DataFrame:
    """The final blocks of a stream of ``blocks``: those with ``depth`` blocks on them. State is ``depth`` blocks a chain.

    ``order`` tells how the blocks of one micro-batch arrived; a batch that may hold both sides of a fork needs a sequence column,
    as heights alone don't tell. A task holds a chain's blocks of one batch, which the source's files a batch bound.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        final = []
        rows = pd.concat(list(frames)).sort_values([order], kind="stable")
        for block in rows[["height", "hash", "parent"]].itertuples(index=False, name=None):
            held, done = accept(held, block, depth)
            final += done
        state.update(tuple(list(x) for x in zip(*held)) if held else ([], [], []))
        yield pd.DataFrame({"chain": [key[0]] * len(final), "height": [b[0] for b in final], "hash": [b[1] for b in final], "parent": [b[2] for b in final]})

    kept = "height array<long>, hash array<string>, parent array<string>"
    return blocks.groupBy("chain").applyInPandasWithState(run, BLOCK, kept, "append", GroupStateTimeout.NoTimeout)


def landed(blocks: DataFrame) -> DataFrame:
    """All that a stream of ``blocks`` has now, as a table: written as Parquet into the shared folder, not gathered."""
    spark = blocks.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quillstone/blocks-{uuid.uuid4().hex}"
    run = blocks.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(blocks.schema).parquet(f"{path}/rows")


def settled(blocks: DataFrame, depth: int) -> DataFrame:
    """The final blocks of a table of ``blocks``: those at least ``depth`` below their chain's top, and on its branch.

    Of several blocks at a height that stays on which others stand; each round cuts the ends of lost branches. A block whose parent
    is missing, and two branches that both reach into the last ``depth`` heights from below them, are errors.
    """
    rows = blocks.select("chain", "height", "hash", "parent").distinct()
    ends = F.broadcast(rows.groupBy("chain").agg(F.max("height").alias("top"), F.min("height").alias("bottom")))  # one row a chain
    parents = rows.select("chain", (F.col("height") + 1).alias("height"), F.col("hash").alias("parent"))
    orphan = rows.join(ends, "chain").where(F.col("height") > F.col("bottom")).join(parents, ["chain", "height", "parent"], "left_anti").first()
    if orphan:
        raise ValueError(f"block {orphan.height} has no parent here")
    while True:
        low = F.col("height") <= F.col("top") - depth
        forks = rows.groupBy("chain", "height").count().where("count > 1").join(ends, "chain").where(low).select("chain", "height")
        if forks.isEmpty():
            return rows.join(ends, "chain").where(low).select("chain", "height", "hash", "parent")
        children = rows.select("chain", (F.col("height") - 1).alias("height"), F.col("parent").alias("hash"))
        lost = rows.join(forks, ["chain", "height"], "left_semi").join(children, ["chain", "height", "hash"], "left_anti").select("chain", "height", "hash")
        lost = checkpointed(lost)  # the ends of lost branches only
        if lost.isEmpty():
            raise ValueError("a fork is below the delay")
        rows = rows.join(lost, ["chain", "height", "hash"], "left_anti").select("chain", "height", "hash", "parent")


def fork_height(old: DataFrame, new: DataFrame) -> DataFrame:
    """chain, fork: the height of the first block of ``new`` that ``old`` does not have at that height."""
    held = old.select("chain", "height", F.col("hash").alias("held"))
    other = new.join(held, ["chain", "height"], "left").where(~F.col("hash").eqNullSafe(F.col("held")))
    return other.groupBy("chain").agg(F.min("height").alias("fork"))


def replayed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` up to the fork, then ``new``: what holds after a reorganisation. Blocks that both have stay once."""
    fork = fork_height(old, new)
    kept = old.join(fork, "chain", "left").where(F.col("fork").isNull() | (F.col("height") < F.col("fork"))).select(old.columns)
    added = new.join(fork, "chain").where(F.col("height") >= F.col("fork")).select(old.columns)
    return kept.unionByName(added)


def tip_checked(blocks: DataFrame) -> DataFrame:
    """height, hash, ok: whether each block's parent is the block below it; the first of a chain is."""
    below = blocks.select("chain", (F.col("height") + 1).alias("height"), F.col("hash").alias("below"))
    joined = blocks.join(below, ["chain", "height"], "left")
    return joined.select("chain", "height", "hash", (F.col("below").isNull() | (F.col("below") == F.col("parent"))).alias("ok"))


def upsert(spark: SparkSession, path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps the latest row of each key under ``path``, one folder a batch.

    Every batch folder holds its own rows only and is overwritten if the batch runs again, so a retry changes nothing;
    ``latest_rows`` reads the current state.
    """

    def write(batch: DataFrame, number: int) -> None:
        best = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_rows(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The current row of each key that ``upsert`` has written."""
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(order, "batch")).alias("r")).select("r.*")
