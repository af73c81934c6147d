"""One document of each group of near-duplicates: five-word shingles with a Jaccard similarity of 0.8 or more.

SimHash fingerprints of 64 bits differ in some ten bits at that similarity, which no pigeonring chain of usable length reaches, so
the chains of ``simhash`` (of five-word fingerprints) are one half of the candidate keys here, MinHash bands of the same shingles the
other: 20 bands of five values miss a pair at 0.8 once in 2900 times, and closer pairs less often. Every link is checked on the shingle sets.

A key's bucket never becomes all its pairs: each member is checked against the bucket's hub (the text that shares keys with
most others, so most buckets of a group have one hub); members that the hub doesn't reach are compared with the rest of the bucket in
blocks of bounded size by their MinHash values, and of the pairs that look alike a spanning forest is checked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import simhash
from .common import drop, parts_for, text_batches, text_bytes, written

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 20, 5
#: Share of equal MinHash values from which a pair of a block is checked; at a similarity of 0.8 fewer are equal once in 100 (of 100 values).
ALIKE = 0.7
#: Members that one task checks against a hub, and that one block compares with as many others.
CHECKED, BLOCK = 512, 1024
_RANDOM = np.random.default_rng(20)
TIMES = _RANDOM.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _RANDOM.integers(0, 2**63, BANDS * ROWS, np.uint64)


def sketch(text: bytes) -> tuple:
    """The digest of a text's lower-cased words, its fingerprint, the set of its shingles' hashes, their MinHash values, and the bands' keys."""
    import xxhash

    words = text.lower().split()
    hashes = simhash.shingles(words, WORDS)
    unique = np.unique(hashes)
    mins = np.full(BANDS * ROWS, 2**32 - 1, np.uint64)
    for at in range(0, len(unique), 4096):  # bounds the products of a very long text
        mins = np.minimum(mins, ((unique[at : at + 4096, None] * TIMES + PLUS) >> np.uint64(32)).min(0))
    mins = mins.astype(np.uint32)
    bands = [xxhash.xxh64_intdigest(mins[k * ROWS : (k + 1) * ROWS].tobytes(), k) - 2**63 for k in range(BANDS)] if len(unique) else []
    return hashlib.md5(b" ".join(words)).digest(), simhash.majority(hashes), np.unique((unique >> np.uint64(32)).astype(np.uint32)).tobytes(), mins.tobytes(), bands


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; sizes that are too far apart are not compared."""
    if min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) else 1.0


def _sketches(docs: DataFrame, keep: tuple) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        for batch in text_batches(batches):
            found = [sketch(t) for t in text_bytes(batch.column("text"))]
            arrays = [pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], [*keep, "name", "fp", "shingles", "mins", "bands"])

    schema = docs.select(*keep).schema.add("name", "binary").add("fp", "long").add("shingles", "binary").add("mins", "binary").add("bands", ArrayType(LongType()))
    return docs.select(*keep, "text").mapInArrow(run, schema)


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, near (written): whether each of ``pairs`` (distinct) is similar. A ``b`` of many pairs is dealt to many tasks."""
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHECKED).cast("int").alias("shares"))
    sets = texts.select("sid", "shingles")
    own = pairs.join(shares, "b").join(sets, pairs.a == sets.sid).select("b", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"), "a", "shingles")
    hubs = shares.join(sets, shares.b == sets.sid).select("b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("a"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            out = []
            for b, a, data in zip(*(batch.column(c).to_pylist() for c in ("b", "a", "shingles")), strict=True):
                found = np.frombuffer(data, np.uint32)
                if a is None:  # comes first of its b and share
                    hub = found
                else:
                    out.append((a, b, similarity(hub, found) >= LEAST))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "near"])

    dealt = own.unionByName(hubs).repartition(parts_for(pairs.sparkSession), "b", "share").sortWithinPartitions("b", "share", F.col("a").asc_nulls_first())
    return written(dealt.select("b", "a", "shingles").mapInArrow(run, "a long, b long, near boolean"), "near-checked")


def forest(asks: np.ndarray, others: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs of ids (``asks``, ``others``) whose values (rows of ``x``, ``y``) look alike a spanning forest, likest first."""
    found = []
    for i, row in enumerate(x):
        same = (y == row).mean(1)
        found += [(-same[j], int(asks[i]), int(others[j])) for j in np.flatnonzero((same >= ALIKE) & (others != asks[i]))]
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for _, a, b in sorted(found):
        p, q = root(a), root(b)
        if p != q:
            parent[p] = q
            out.append((a, b))
    return out


def _alike(met: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: pairs that look alike, of members that their hub doesn't reach and the rest of the bucket. ``met``: key, sid, near."""
    far = met.where("not near").groupBy("key").agg(F.count("*").alias("n_far"))
    sizes = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").join(far, "key")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    rest = met.join(sizes, "key").select("key", "sid", "near", blocks("n_far").alias("rows"), blocks("n").alias("cols"))
    own, other = F.pmod(F.xxhash64("sid"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("sid"), F.col("cols")).cast("int")
    asks = rest.where("not near").select("key", "sid", F.lit(True).alias("asks"), own.alias("r"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"))
    members = rest.select("key", "sid", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), other.alias("c"))
    dealt = asks.unionByName(members).join(texts.select("sid", "mins"), "sid").select("key", "r", "c", "sid", "asks", "mins")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None

        def flush() -> pa.RecordBatch:
            ids, asks = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], bool)
            x = np.frombuffer(b"".join(h[2] for h in held), np.uint32).reshape(len(held), -1)
            out = forest(ids[asks], ids[~asks], x[asks], x[~asks])
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for key, r, c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (key, r, c) != name:
                    if held:
                        yield flush()
                    held, name = [], (key, r, c)
                held.append(row)
        if held:
            yield flush()

    dealt = dealt.repartition(parts_for(met.sparkSession), "key", "r", "c").sortWithinPartitions("key", "r", "c")
    found = dealt.mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(texts: DataFrame) -> DataFrame:
    """a, b (written): links between texts that join all that are similar, directly or by others. ``texts``: sid, fp, shingles, mins, bands."""
    keys = texts.where(F.size("bands") > 0).select("sid", F.explode(F.concat(F.array(*simhash.chain_keys(F.col("fp"))), "bands")).alias("key"))
    counts = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-counts")
    members = written(keys.join(counts, "key").select("key", "sid", "n"), "near-members")
    shared = members.groupBy("sid").agg(F.sum("n").alias("score"))
    hubs = members.join(shared, "sid").groupBy("key").agg(F.max(F.struct("score", "sid")).alias("hub"))
    hubs = written(hubs.select("key", F.col("hub.sid").alias("b")), "near-hubs")
    met = written(members.join(hubs, "key").where("sid <> b").select("key", "sid", "b"), "near-met")
    drop(counts, members)
    stars = checked(met.select(F.col("sid").alias("a"), "b").distinct(), texts)
    known = met.join(stars.withColumnRenamed("a", "sid"), ["sid", "b"]).select("key", "sid", "near")
    more = written(_alike(known, texts), "near-alike")
    found = checked(more, texts)
    out = written(stars.unionByName(found).where("near").select("a", "b"), "near-links")
    drop(hubs, met, stars, more, found)
    return out


def grouped(docs: DataFrame, keep: tuple) -> DataFrame:
    """The columns ``keep`` and ``root``, the name of its group, for each row of ``docs`` (text and ``keep``).

    Texts with the same lower-cased words are of one group, also those without any (null, empty); a text of fewer than five words
    has one shingle, itself. Repeated rows stay; no rows give no rows.
    """
    found = written(_sketches(docs, keep), "near-sketches")
    texts = found.select("name", "fp", "shingles", "mins", "bands").dropDuplicates(["name"]).withColumn("sid", F.monotonically_increasing_id())
    texts = written(texts, "near-texts")
    rows = written(found.select(*keep, "name"), "near-rows")
    drop(found)
    linked = links(texts)
    roots = written(simhash.components(linked), "near-roots")
    drop(linked)
    named = written(texts.select("name", "sid").join(roots, texts.sid == roots.node, "left").select("name", F.coalesce("root", "sid").alias("root")), "near-named")
    drop(texts, roots)
    return rows.join(named, "name").select(*keep, "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates one row, unchanged: that with the smallest id, a null id last; of equal ids and texts any one.

    Columns may have any names but those that begin with two underscores.
    """
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.withColumn("__name", name)
    found = grouped(rows.select("doc_id", "text", "__name"), ("doc_id", "__name"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__name")).alias("first")).select("first.__name")
    return rows.join(written(first, "near-kept"), "__name").dropDuplicates(["__name"]).select(docs.columns)
