"""Language-model scores: prediction by partial matching over bytes, beside smoothed word counts.

What is coded is the text as tokens: A-Z lower-cased, its words with one blank between, and an end symbol, so that a score is the
log10 probability of the same event as the base's. The corpus's counts of byte strings of ``ORDER`` + 1 symbols are gathered by
Spark from all training rows; a shorter context counts each of its symbols once for every longer context that has it (update
exclusion), which tells best what comes after an escape. A symbol is coded in the longest context that was counted: seen n times
there, it gets (n - 1/2) / T with T symbols and D distinct ones in that context (method D); else the code escapes with D / 2T to
the next shorter context, where the symbols of the longer one are excluded; below order 0 the symbols never seen share evenly. As
all of a context's symbols are also its suffix's, this is a fixed function of the ``ORDER`` bytes before a symbol and of the symbol.
So every context counts, however rare: Spark works out the logarithm of each distinct byte string of the corpus by joins order by
order, the ``GRAMS`` most frequent are looked up in the workers, the rest are joined to the texts that have them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, remainder, table, text_batches, text_bytes, written

ORDER = 5
#: What method D takes off a symbol's count for the escape.
LESS = 0.5
#: The byte strings, at most, that are looked up in the workers; the rest are joined.
GRAMS = 1 << 20
#: The words that are looked up in the workers, at most, and their bytes; the rest and longer ones are joined.
HEAD, HEAD_BYTES = 196608, 64
END, PAD = 0xFE, 0xFF  # bytes that UTF-8 never has
SYMBOLS = 255
#: Distinct strings and words that a worker gathers before it passes them on.
GATHERED = 1_500_000
WORDS_GATHERED = 200_000


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each after ``ORDER`` pads and before its end symbol; where each begins."""
    pad, end = bytes([PAD]) * ORDER, bytes([END])
    starts = np.cumsum([0, *(len(t) + ORDER + 1 for t in texts)])[:-1]
    return np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8), starts


def tokens(text: bytes) -> list[bytes]:
    """The words, A-Z lower-cased."""
    return text.lower().split()


def grams(buffer: np.ndarray) -> np.ndarray:
    """For each symbol that is coded: itself (low byte) and the ``ORDER`` before it, as one integer."""
    codes = np.zeros(len(buffer) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        codes = codes << np.uint64(8) | buffer[k : len(buffer) - ORDER + k].astype(np.uint64)
    return codes[buffer[ORDER:] != PAD]


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """One list of distinct strings and counts of several."""
    keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [(keys[first], np.add.reduceat(counts[order], first))]


def gathered(docs: DataFrame) -> DataFrame:
    """gram, word, n: pre-aggregated counts of byte strings (word null) and of words (gram null) in ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], Counter()

        def out(held, words):
            keys, counts = _merged(held)[0] if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            n = len(keys)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([keys.astype(np.int64), np.zeros(len(words), np.int64)]), mask=np.arange(n + len(words)) >= n),
                    pa.array([None] * n + [*words], pa.binary()),
                    pa.array(np.concatenate([counts, np.fromiter(words.values(), np.int64, len(words))])),
                ],
                ["gram", "word", "n"],
            )

        for batch in text_batches(batches):
            lists = [tokens(t) for t in text_bytes(batch.column("text"))]
            buffer, _ = laid_out([b" ".join(x) for x in lists])
            held.append(np.unique(grams(buffer), return_counts=True))
            for x in lists:
                words.update(x)
            if sum(len(x) for x, _ in held) > 2 * GATHERED:
                held = _merged(held)
            if len(held[0][0]) > GATHERED or len(words) > WORDS_GATHERED:
                yield out(held, words)
                held, words = [], Counter()
        yield out(held, words)

    return docs.select("text").mapInArrow(run, "gram long, word binary, n long")


def _shorter(k: int, ctx: str = "ctx"):
    """The last k bytes of a context."""
    return F.col(ctx).bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("ctx")


def _counts(grams: DataFrame) -> list[DataFrame]:
    """ctx, sym, n of each order from 0: below the longest a symbol counts once for each longer context that has it."""
    counts = [grams.where("n > 0").select(F.shiftright("gram", 8).alias("ctx"), F.col("gram").bitwiseAND(F.lit(255)).alias("sym"), "n")]
    for k in range(ORDER - 1, -1, -1):
        counts.insert(0, written(counts[0].groupBy(_shorter(k), "sym").agg(F.count("*").alias("n")), f"ppm-counts-{k}"))
    return counts


def logs(grams: DataFrame) -> DataFrame:
    """gram, log: log10 probability of the last byte of each of ``grams`` (gram, n times in training, distinct) after the others; written.

    Strings counted in training need their context's totals only. The others go down order by order to the context that has
    their symbol, distinct ones only, and the escapes are added up on the way back. A context has at most 255 rows, so no key is hot.
    """
    counts = _counts(grams)
    whole = grams.select("gram", F.shiftright("gram", 8).alias("ctx"), F.col("gram").bitwiseAND(F.lit(255)).alias("sym"))
    asked = {ORDER: written(whole.join(counts[ORDER], ["ctx", "sym"], "left_anti").select("ctx", "sym", F.lit(None).cast("long").alias("n")), "ppm-asked")}
    for k in range(ORDER - 1, -1, -1):
        lower = asked[k + 1].where("n is null").select(_shorter(k), "sym").distinct()
        asked[k] = written(lower.join(counts[k], ["ctx", "sym"], "left"), "ppm-asked")
    log, costs = F.log10, []
    for k in range(ORDER + 1):
        mine = counts[k].join(asked[k].select("ctx").distinct(), "ctx", "left_semi")
        if k:  # what the context's symbols have in its suffix
            below = counts[k - 1].select(F.col("ctx").alias("suffix"), "sym", F.col("n").alias("has"))
            mine = mine.withColumn("suffix", _shorter(k - 1)).join(below, ["suffix", "sym"])
        else:
            mine = mine.withColumn("has", F.lit(0).cast("long"))
        mine = mine.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("has").alias("excluded"))
        now = asked[k].join(mine, "ctx", "left")
        if k:
            # ``after``: the cost once the code has escaped from this context; ``cost``: that of coding from it
            below = found.select(F.col("ctx").alias("suffix"), "sym", *(F.col(c).alias(f"b_{c}") for c in ("n", "total", "kinds", "after", "cost")))
            t, d = F.col("b_total") - F.col("excluded"), F.col("b_kinds") - F.col("kinds")
            after = F.when(F.col("b_n").isNotNull(), log(F.col("b_n") - LESS) - log(t)).when(d > 0, log(LESS * d) - log(t) + F.col("b_after")).otherwise(F.col("b_after"))
            now = now.withColumn("suffix", _shorter(k - 1)).join(below, ["suffix", "sym"], "left").withColumn("after", after).withColumn("lower", F.col("b_cost"))
        else:
            now = now.withColumn("after", -log(F.greatest(F.lit(SYMBOLS) - F.col("kinds"), F.lit(1)))).withColumn("lower", -log(F.lit(float(SYMBOLS))))
        cost = F.when(F.col("n").isNotNull(), log(F.col("n") - LESS) - log("total")).when(F.col("total").isNull(), F.col("lower")).otherwise(log(LESS * F.col("kinds")) - log("total") + F.col("after"))
        found = written(now.select("ctx", "sym", "n", "total", "kinds", "after", cost.alias("cost")), "ppm-costs")
        costs.append(found)
    top = counts[ORDER]
    size = top.groupBy("ctx").agg(log(F.sum("n")).alias("size"))
    direct = top.join(size, "ctx").select("ctx", "sym", (log(F.col("n") - LESS) - F.col("size")).alias("log"))
    both = direct.unionByName(found.select("ctx", "sym", F.col("cost").alias("log")))
    out = written(both.select(F.shiftleft("ctx", 8).bitwiseOR(F.col("sym")).alias("gram"), "log"), "ppm-logs")
    drop(*counts[:ORDER], *asked.values(), *costs)
    return out


def frequent(grams: DataFrame, most: int):
    """A condition on ``times`` that at most ``most`` of ``grams`` fulfil, the most frequent ones: by steps of the logarithm, so counted in a few rows."""
    step = F.floor(F.log2("times") * 16).cast("long")
    least, sum_ = None, 0
    for r in grams.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        sum_ += r["count"]
        if sum_ > most:
            break
        least = r.step
    return F.lit(False) if least is None else step >= least


def looked_up(texts: list[bytes], codes: np.ndarray, values: np.ndarray):
    """Of each text the sum of its byte strings' values, and offsets, codes and times of those that are not in ``codes``."""
    buffer, _ = laid_out(texts)
    sizes = np.array([len(t) + 1 for t in texts])
    every = grams(buffer).view(np.int64)
    order = np.argsort(every)
    ranked = every[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    own, inverse = ranked[new], np.empty(len(every), np.int64)
    inverse[order] = np.cumsum(new) - 1
    at = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
    known = codes[at] == own if len(codes) else np.zeros(len(own), bool)
    value = np.where(known, values[at] if len(codes) else 0.0, 0.0)
    sums = np.add.reduceat(value[inverse], np.cumsum(sizes) - sizes)
    missed = np.flatnonzero(~known[inverse])
    pairs, times = np.unique(np.repeat(np.arange(len(texts)), sizes)[missed] * len(own) + inverse[missed], return_counts=True)
    offsets = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(own))
    return sums, offsets.astype(np.int32), own[pairs % len(own)], times


def log_base(c, n: int, v: int):
    return F.log10((c + 1) / F.lit(float(n + v + 1)))


def scores(docs: DataFrame, modulus: int = 7, held: int = 2, head: int = HEAD, most: int = GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text).

    Learns from rows whose id's crc32 leaves another remainder than ``held``. A null or empty text has one token, its
    end; a null id counts as the empty id; repeated rows count each time; a text of any length is one sum of its strings' logarithms;
    other columns are ignored, whatever their names; without training rows all counts are 0. ``head`` words and ``most`` byte
    strings are looked up in place, which changes no score.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    raw = gathered(rows.where("not held_out")).withColumn("learnt", F.lit(True))
    raw = written(raw.unionByName(gathered(rows.where("held_out")).where("gram is not null").withColumn("learnt", F.lit(False))), "lm-gathered")
    ends = rows.where("not held_out").select("doc_id").count()
    learnt = F.when(F.col("learnt"), F.col("n")).otherwise(0)
    seen = written(raw.where("gram is not null").groupBy("gram").agg(F.sum(learnt).alias("n"), F.sum("n").alias("times")), "ppm-grams")
    found = logs(seen)
    priced = written(seen.select("gram", "times").join(found, "gram"), "ppm-priced")
    drop(seen, found)
    near = frequent(priced, most)
    top = priced.where(near).select("gram", "log").toArrow()  # no row objects on the driver
    codes, values = top["gram"].to_numpy(), top["log"].to_numpy()
    order = np.argsort(codes)
    codes, values = codes[order], values[order]
    del top, order
    words = written(raw.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    drop(raw)
    sums = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = int(sums.n) + ends, int(sums.v) + (ends > 0)
    short = words.where(F.octet_length("word") <= HEAD_BYTES).select("word", "c", F.col("c").alias("times"))
    top = short.where(frequent(short, head)).toArrow()
    known = dict(zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True))
    sent = spark.sparkContext.broadcast((codes, values, known))
    del top, known, codes, values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, values, known = sent.value
        logs = {w: float(np.log10((c + 1) / (n + v + 1))) for w, c in known.items()}
        end = float(np.log10((ends + 1) / (n + v + 1)))
        for batch in text_batches(batches):
            lists = [tokens(t) for t in text_bytes(batch.column("text"))]
            texts = [b" ".join(x) for x in lists]
            out = {k: [] for k in ("n_tokens", "known", "part", "words", "counts", "key")}
            for t, x in zip(texts, lists, strict=True):
                counts = Counter(x)
                near = [(w, c) for w, c in counts.items() if w not in logs]
                rest = {w for w, _ in near}
                out["n_tokens"].append(counts.total() + 1)
                out["known"].append(counts.total() - sum(c for _, c in near) + (ends > 0))
                out["part"].append(sum(c * logs[w] for w, c in counts.items() if w not in rest) + end)
                out["words"].append([w for w, _ in near])
                out["counts"].append([c for _, c in near])
                out["key"].append(hashlib.blake2b(t, digest_size=16).digest())
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)]
            sums, offsets, rare, times = looked_up(texts, codes, values)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, pa.int64())) for x in (rare, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *arrays, *lists, pa.array(sums)], ["doc_id", "held_out", *out, "grams", "times", "coded"])

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, known long, part double, words array<binary>, counts array<long>, key binary, grams array<long>, times array<long>, coded double"
    scored = written(rows.mapInArrow(run, schema), "lm-scored")
    rest = scored.where("size(words) > 0").select("key", "words", "counts").dropDuplicates(["key"])
    rest = rest.select("key", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.counts").alias("times"))
    c = F.coalesce("c", F.lit(0))
    rest = rest.join(words, "word", "left").groupBy("key").agg(F.sum(F.col("times") * log_base(c, n, v)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("found"))
    rare = scored.where("size(grams) > 0").select("key", "grams", "times").dropDuplicates(["key"])
    rare = rare.select("key", F.explode(F.arrays_zip("grams", "times")).alias("x")).select("key", F.col("x.grams").alias("gram"), F.col("x.times").alias("times"))
    rare = rare.join(priced.where(~near).select("gram", "log"), "gram").groupBy("key").agg(F.sum(F.col("times") * F.col("log")).alias("coded_more"))
    rest = rest.unionByName(rare, allowMissingColumns=True).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("more", "found", "coded_more")))
    rest = written(rest, "lm-rest")  # so that the join to the rows is split where a text has very many copies
    drop(words, priced)
    zero = F.lit(0)
    return scored.join(rest, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", zero)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("coded") + F.coalesce("coded_more", F.lit(0.0))).alias("score"),
    )


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
