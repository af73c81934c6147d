"""Mixing sources to target weights, in blocks.

Each source's documents are laid end to end and packed into blocks of ``block`` words. The mix has ``target`` words of
each source: slots that take blocks. A shard of the output has ``shard`` slots on average; a source's slots are dealt to the
shards by a multinomial draw, all shards alike likely: the range of shards is halved again and again, each half's count is a
binomial draw seeded by its source and place, down to a few thousand slots, which are drawn one by one. So any stretch of shards can be
drawn apart from the others, totals may have 64 bits, and no step needs all sources or all shards together. Slot t of a source
takes block perm(t mod n) of its n blocks, where perm is a keyed pseudorandom permutation of the indexes, another one each time
round. Blocks and slots are then joined by source and index.

So a block is taken floor or ceil of (target / size) times, its last slot is cut to the word, each source's words are its
rounded target, and nothing depends on the order of rows or tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, numbered, parts_for, table, text_batches, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 128
SHARD = 8192
SEED = 20240229
#: Slots that are drawn one by one, and that one row of work holds, about.
DRAWN = 8192
WORD = r"[^\x20\x09-\x0D]+"


def _mix64(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The images of ``index`` under a pseudorandom permutation of 0..n-1: a Feistel network, walked until inside.

    ``back``: under its inverse.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            if back:
                left, right = right ^ (_mix64(left + np.uint64(r << 56), key) & mask), left
            else:
                left, right = right, left ^ (_mix64(right + np.uint64(r << 56), key) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _key(seed: int, *parts: int) -> int:
    x = np.array([seed], np.uint64)
    for p in parts:
        x = _mix64(x + np.uint64(p), 0x9E3779B97F4A7C15)
    return int(x[0])


def shard_counts(slots: int, shards: int, first: int, last: int, source: int, seed: int) -> tuple[int, np.ndarray]:
    """A source's slots before the shard ``first``, and in each of the shards from it to ``last`` - 1, by draws on the way down the halved range."""
    before, counts, todo = 0, np.zeros(last - first, np.int64), [(0, shards, slots)]
    while todo:
        low, high, n = todo.pop()
        if not n or low >= last:
            continue
        if high <= first:
            before += n
        elif high - low == 1:
            counts[low - first] += n
        else:
            rng = np.random.default_rng([seed, source, low, high])
            if n <= DRAWN:
                drawn = rng.integers(low, high, n)
                before += int((drawn < first).sum())
                counts += np.bincount(drawn[(drawn >= first) & (drawn < last)] - first, minlength=last - first)
            else:
                mid = (low + high) // 2
                left = int(rng.binomial(n, (mid - low) / (high - low)))
                todo += [(low, mid, left), (mid, high, n - left)]
    return before, counts


class Plan:
    """What a source's slots take: ``rounds`` whole times all of its blocks, then ``rest`` words in permuted order."""

    def __init__(self, size: int, target: float, block: int, source: int, seed: int):
        self.n, self.block, self.seed, self.source = math.ceil(size / block), block, seed, source
        self.last = size - (self.n - 1) * block if self.n else 0
        words = round(target)
        self.rounds = words // size if size else 0
        self.rest = words - self.rounds * size
        self.slots = self.rounds * self.n
        self.need, self.short = 0, -1
        if self.rest:
            self.short = int(permuted(np.array([self.n - 1]), self.n, self._round(self.rounds), back=True)[0])
            self.need = math.ceil(self.rest / block)
            self.need += self._words(self.need) < self.rest
            self.slots += self.need

    def _words(self, k: int) -> int:
        """Words of the last round's first k slots; the short last block stands at ``short`` in its order."""
        return k * self.block - (k > self.short) * (self.block - self.last)

    def _round(self, r: int) -> int:
        return _key(self.seed, self.source, r)

    def take(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and words of the slots start..stop-1."""
        t = np.arange(start, stop)
        turn, at = t // max(self.n, 1), t % max(self.n, 1)
        blocks = np.zeros(len(t), np.int64)
        for r in np.unique(turn):
            blocks[turn == r] = permuted(at[turn == r], self.n, self._round(int(r)))
        words = np.where(blocks == self.n - 1, self.last, self.block)
        final = t == self.slots - 1
        if self.rest and final.any():
            words[final] = self.rest - self._words(self.need - 1)
        return blocks, words


def sources(docs: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, rank (by code point, null last), source_size, target of each distinct source; written.

    Ranks are numbered in ranges of the order. ``share`` of all words is dealt by weight, no target above ``most`` times its
    source's size, the excess to the rest by weight: sources are full from some level of words a weight on, and a sum over them tells
    the next, higher level, until no more are full. A row for each source takes part, none goes to the driver.
    """
    order = F.col("source").asc_nulls_last()
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = written(sums.repartitionByRange(parts_for(docs.sparkSession), order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    rows = ranged.groupBy("part").count()  # a row for each range
    bases = rows.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("base")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    out = ranged.join(F.broadcast(bases), "part").select("source", rank.alias("rank"), "source_size", weight.alias("weight"))
    out = written(out, "mix-ranks")
    drop(ranged)
    total, rest, weights, n = None, 0.0, 0.0, -1
    while True:
        full = F.lit(False) if total is None else F.lit(rest) * F.col("weight") / F.lit(weights) > most * F.col("source_size")
        found = out.agg(F.sum("source_size").alias("words"), F.sum(F.when(full, F.col("source_size"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weights"), F.count(F.when(full, 1)).alias("n")).first()
        if not found.weights or found.n == n:
            break
        total, n = share * (found.words or 0), found.n
        rest, weights = max(total - most * (found.full or 0), 0.0), found.weights
    dealt = F.lit(rest) * F.col("weight") / F.lit(weights) if weights else F.lit(0.0)
    return out.select("source", "rank", "source_size", F.least(dealt, most * F.col("source_size")).alias("target"))


def laid_out(docs: DataFrame, rows: int) -> DataFrame:
    """``docs`` (with rank, doc_id, size) and each row's first word within its source: ``start``.

    Prefix sums in two levels, so that no task holds a whole source: within about sqrt(rows) buckets of ids, and over them.
    """
    n = max(1, math.isqrt(rows))
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    sums = docs.groupBy("rank", "bucket").agg(F.sum("size").alias("s"))
    over = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "bucket", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("base"))
    within = Window.partitionBy("rank", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return docs.join(sums, ["rank", "bucket"]).withColumn("start", F.col("base") + F.col("within")).drop("bucket", "base", "within")


def slots(sources: DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """shard, slot (an order within the shard), rank, block, words: the mix. ``sources``: rank, source_size, target.

    A source's shards are dealt to tasks in stretches of some ``DRAWN`` slots, so a source of any share takes many tasks.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = zip(frame["rank"], frame["source_size"], frame["target"], strict=True)
            yield frame.assign(n=np.array([Plan(int(s), float(t), block, int(r), seed).slots for r, s, t in rows], np.int64))

    plans = written(sources.select("rank", "source_size", "target").mapInPandas(count, "rank long, source_size long, target double, n long"), "mix-plans")
    total = plans.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard))
    parts = F.least(F.ceil(F.col("n") / DRAWN), F.lit(shards))
    units = plans.where("n > 0").select("*", parts.alias("parts")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rank, size, target, n, parts, part in frame[["rank", "source_size", "target", "n", "parts", "part"]].itertuples(index=False):
                plan = Plan(int(size), float(target), block, int(rank), seed)
                first, last = shards * int(part) // int(parts), shards * (int(part) + 1) // int(parts)
                before, counts = shard_counts(int(n), shards, first, last, int(rank), seed)
                ends = np.cumsum(counts)
                for a in range(0, int(counts.sum()), 1 << 16):
                    at = np.arange(a, min(a + (1 << 16), int(ends[-1])))
                    blocks, words = plan.take(before + int(at[0]), before + int(at[-1]) + 1)
                    order = _mix64((before + at).astype(np.uint64), _key(seed, int(rank), 1 << 32)) >> np.uint64(1)
                    yield pd.DataFrame({"shard": first + np.searchsorted(ends, at, side="right"), "slot": order.astype(np.int64), "rank": np.int64(rank), "block": blocks, "words": words})

    dealt = units.repartition(parts_for(sources.sparkSession), "rank", "part")
    return dealt.mapInPandas(run, "shard long, slot long, rank long, block long, words long")


class Mix:
    """The parts of a mix: ``docs`` (with size, rank, start), ``sources`` (with target), ``slots``."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, share: float = SHARE, most: float = MOST, keep: tuple = ()):
        self.block = block
        sized = docs.select("doc_id", "source", *keep, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        self.sized = written(sized, "sizes")
        self.sources = sources(self.sized, share, most)
        ranked = self.sized.join(self.sources, self.sized["source"].eqNullSafe(self.sources["source"])).drop(self.sources["source"])
        self.docs = written(laid_out(ranked, self.sized.count()), "laid-out")
        drop(self.sized)
        self.slots = slots(self.sources, block, shard, seed)

    def pieces(self) -> DataFrame:
        """rank, block, start, skip, n: which words of the document at ``start`` stand where in the block."""
        b = F.lit(self.block)
        some = self.docs.where("size > 0")
        first, last = (F.col("start") / b).cast("long"), ((F.col("start") + F.col("size") - 1) / b).cast("long")
        out = some.select("rank", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        low, high = F.greatest("start", F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        return out.select("rank", "block", "start", (low - F.col("block") * b).alias("at"), (low - F.col("start")).alias("skip"), (high - low).alias("n"))

    def met(self) -> DataFrame:
        """rank, start, skip, words, uses: how often the mix takes which words of the document at ``start``."""
        uses = self.slots.groupBy("rank", "block", F.col("words").alias("cut")).agg(F.count("*").alias("uses"))
        met = self.pieces().join(uses.hint("merge"), ["rank", "block"])  # a range's size says nothing of its slots
        words = F.greatest(F.lit(0), F.least(F.col("at") + F.col("n"), F.col("cut")) - F.col("at"))
        return met.select("rank", "start", "skip", words.cast("long").alias("words"), "uses").where("words > 0")

    def layered(self) -> DataFrame:
        """``met`` without overlaps: where a piece is taken to different lengths, the stretches taken equally often."""
        met = self.met().groupBy("rank", "start", "skip", "words").agg(F.sum("uses").alias("uses"))
        by = Window.partitionBy("rank", "start", "skip")
        longer = F.sum("uses").over(by.orderBy(F.desc("words")).rowsBetween(Window.unboundedPreceding, 0))
        shorter = F.coalesce(F.max("words").over(by.orderBy("words").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return met.select("rank", "start", (F.col("skip") + shorter).alias("skip"), (F.col("words") - shorter).alias("words"), longer.alias("uses"))

    def taken(self) -> DataFrame:
        """``docs`` with the words that the mix takes of each row."""
        sums = self.met().groupBy("rank", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
        some = self.docs.where("size > 0").join(sums, ["rank", "start"], "left")
        return some.unionByName(self.docs.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def mix(docs: DataFrame, **kind) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, source, text).

    A null text has size 0 and is never taken; null is a source of its own, the last; repeated rows are packed like any
    other; a text of any length is so many words in as many blocks; other columns may have any names; without words every target is
    0; no rows give no rows.
    """
    return Mix(docs, **kind).taken().select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, **kind) -> DataFrame:
    """The mix as documents: a row for the words of a document that it takes once or more, one for those taken twice.

    Words keep the characters between them; a row that takes all words keeps the whole text. n_chars is counted anew.
    Documents of which no word is taken are left out, those without words stay.
    """
    rows = numbered(docs, "mix-rows")
    mix = Mix(rows, keep=("__row",), **kind)
    part = F.struct("skip", "words", "uses")
    plan = mix.layered().groupBy("rank", "start").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    plan = mix.docs.where("size > 0").select("__row", "rank", "start", "size").join(plan, ["rank", "start"]).select("__row", "size", "parts")
    held = rows.select("__row", "text", F.struct(*docs.columns).alias("__rest")).join(plan, "__row").select("text", "__rest", "size", "parts")
    schema = held.select("__rest", "text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts, of = [], []
            for k, (text, size, parts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "size", "parts")), strict=True)):
                for use in range(1, max(p["uses"] for p in parts) + 1):
                    some = [(p["skip"], p["skip"] + p["words"]) for p in parts if p["uses"] >= use]
                    some = sorted(some)
                    whole = sum(b - a for a, b in some) == size
                    texts.append(text if whole else cut_words(text, some))
                    of.append(k)
            yield pa.RecordBatch.from_arrays([batch.column("__rest").take(pa.array(of, pa.int64())), pa.array(texts, pa.string())], ["__rest", "text"])

    taken = held.mapInArrow(run, schema)
    of = [F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"__rest.{c}") for c in docs.columns]
    empty = rows.join(mix.docs.where("size = 0").select("__row"), "__row", "left_semi").select(docs.columns)
    return taken.select(*of).unionByName(empty)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The words from..to-1 of each span, with what stands between them; spans that do not touch are parted by a space."""
    at = [m.span() for m in re.finditer(WORD, text)]
    out, last = [], None
    for a, b in spans:
        if a >= b:
            continue
        if last == a:
            out.append(text[at[a - 1][1] : at[b - 1][1]])
        else:
            out.append(" " * bool(out) + text[at[a][0] : at[b - 1][1]])
        last = b
    return "".join(out)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
