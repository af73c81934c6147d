"""Exact repeated byte strings by suffix arrays.

A window is ``length`` bytes of a text; it repeats if the same bytes also start anywhere else. Shards must be such that equal
windows meet, without shipping windows: each window elects the least hash among its ``GRAM``-byte strings (the leftmost
of equals), which depends on the window's bytes only, so equal windows elect equal anchors. Consecutive windows with one
anchor are a run; some 185 windows, whose bytes are its region. Anchors that occur once in the corpus
cannot hold a repeat. The distinct regions of all other anchors are dealt to shards by anchor. A shard builds a suffix array
of its regions by Larsson-Sadakane refinement (ranks by 8 bytes, then doubling, only unsorted groups), and common
prefixes of neighbours by Kasai's rule, many stretches side by side; a window repeats if it shares ``length``
bytes with a neighbour, or if its region occurs more than once. An anchor with over ``REGIONS`` distinct regions is
split over several shards, which are then merged: of each class of equal windows a shard passes on one, keyed by a
digest, and binary search in the sorted merge finds those that other shards have too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, parts_for, table, text_batches, text_bytes, written

LENGTH = 400
GRAM = 32
#: Distinct regions of an anchor that one shard takes.
REGIONS = 1024
#: Bytes of text that are hashed at once, and of regions in one suffix array.
HASHED, SORTED = 1 << 20, 1 << 20
LANES = 4096
PLACE = np.uint64(21)  # bits of a place in the hashed bytes
_RANDOM = np.random.default_rng(400)
BYTES = _RANDOM.integers(0, 2**64, (2, 256), np.uint64)
BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class Hasher:
    """Hashes of any stretch of a buffer, from prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray, kind: int):
        n, base = len(data), BASE[kind]
        inverse = np.uint64(pow(int(base), -1, 2**64))
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTES[kind][data] * up[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[stop] - self.sums[start]) * self.down[start]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return x ^ (x >> np.uint64(29))


def runs_of(data: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that start in [low, high) of each text: text, anchor's hash, region's digest, first start, windows."""
    k = min(GRAM, length)
    width = length - k + 1
    n = len(data) - k + 1
    grams = Hasher(data, 0).of(np.arange(n), np.arange(k, n + k))
    packed = grams & ~np.uint64((1 << int(PLACE)) - 1) | np.arange(n, dtype=np.uint64)
    blocks = np.full(-(-n // width) * width, ~np.uint64(0))
    blocks[:n] = packed
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = high - low
    of = np.repeat(np.arange(len(low)), count)
    start = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    anchor = (np.minimum(back[start], ahead[start + width - 1]) & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(of) != 0)])) if len(of) else np.zeros(0, np.int64)
    windows = np.diff(np.append(first, len(of)))
    begin = start[first]
    digest = Hasher(data, 1).of(begin, begin + windows + length - 1) ^ windows.astype(np.uint64)
    return of[first], grams[anchor[first]].view(np.int64), digest.view(np.int64), begin, windows


def runs(docs: DataFrame, length: int) -> DataFrame:
    """hash, digest, key, doc_id, at, n: the runs of all texts. ``docs``: key, doc_id, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    most = HASHED - length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, HASHED):
            texts = text_bytes(batch.column("text"))
            pieces = [(i, at, t[at : at + HASHED]) for i, t in enumerate(texts) if len(t) >= length for at in range(0, len(t) - length + 1, most + 1)]
            groups, size = [[]], 0
            for p in pieces:  # one piece is never more than HASHED bytes
                if size + len(p[2]) > HASHED and groups[-1]:
                    groups.append([])
                    size = 0
                groups[-1].append(p)
                size += len(p[2])
            for group in groups:
                if not group:
                    continue
                sizes = np.array([len(p[2]) for p in group], np.int64)
                low = np.cumsum(sizes) - sizes
                of, anchor, digest, begin, windows = runs_of(np.frombuffer(b"".join(p[2] for p in group), np.uint8), low, low + sizes - length + 1, length)
                rows = pa.array(np.array([p[0] for p in group], np.int64)[of])
                at = np.array([p[1] for p in group], np.int64)[of] + begin - low[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(digest), batch.column("key").take(rows), batch.column("doc_id").take(rows), pa.array(at), pa.array(windows)],
                    ["hash", "digest", "key", "doc_id", "at", "n"],
                )

    return docs.select("key", "doc_id", "text").mapInArrow(run, f"hash long, digest long, key binary, doc_id {kind}, at long, n long")


def suffix_array(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of their suffixes (to the end, as Kasai's rule needs it), each place's index in it, and 8 bytes from each place.

    ``left``: bytes from each place to the end of its region; at 0 stands the region's own end symbol, less than any byte and
    unlike the others, so a suffix of under 8 bytes is a group by itself.
    """
    n = len(data)
    padded = np.concatenate([np.where(left > 0, data, 0), np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | np.where(left > k, padded[k : n + k], np.uint64(0))
    ends = np.flatnonzero(left < 8)
    order = np.concatenate([ends[np.argsort(left[ends], kind="stable")], np.flatnonzero(left >= 8)])
    order = order[np.argsort(words[order], kind="stable")]
    short = left[order] < 8
    fresh = np.ones(n, bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | short[1:] | short[:-1]
    heads = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    h = 8
    while True:
        # Members of groups that are still equal.
        same = ~fresh
        open_ = same.copy()
        open_[:-1] |= same[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        places = order[at]
        key = heads[at] << 32 | rank[places + h]
        by = np.argsort(key, kind="stable")
        key, places = key[by], places[by]
        order[at] = places
        fresh[at] = np.concatenate([[True], key[1:] != key[:-1]])
        heads[at] = np.maximum.accumulate(np.where(fresh[at], at, 0))
        rank[places] = heads[at]
        h *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place, words


def common_prefixes(order: np.ndarray, place: np.ndarray, words: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    """For each place, the bytes (``most`` at most) that its suffix shares with the one before it in the order.

    Kasai's rule: going on by one place loses one byte at most. The text is cut into lanes that go on side by side, each
    comparing 8 bytes a step.
    """
    n = len(place)
    out = np.zeros(n, np.int64)
    before = np.full(n, -1)
    inside = np.flatnonzero(place > 0)
    before[inside] = order[place[inside] - 1]
    lanes = min(LANES, max(1, n // 64))
    size = -(-n // lanes)
    at = np.arange(lanes) * size
    stop = np.minimum(at + size, n)
    h = np.zeros(lanes, np.int64)
    live = np.flatnonzero(at < stop)
    at, stop, h = at[live], stop[live], h[live]
    last = n - 1
    while len(at):
        other = before[at]
        x = words[np.minimum(at + h, last)] ^ words[np.minimum(other + h, last)]
        high = x >> np.uint64(32)
        top = high != 0
        bits = np.frexp(np.where(top, high, x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1] + 32 * top
        same = 8 - (bits + 7) // 8
        found = np.where(other >= 0, h + same, 0)
        room = np.minimum(np.minimum(left[at], left[np.maximum(other, 0)]), most)
        more = (x == 0) & (other >= 0) & (found < room)
        done = ~more
        ended = at[done]
        out[ended] = np.where(other[done] >= 0, np.minimum(found[done], room[done]), 0)
        h = np.where(more, found, np.maximum(np.minimum(found, room) - 1, 0))
        at = at + done
        if (at >= stop).any():
            keep = at < stop
            at, stop, h = at[keep], stop[keep], h[keep]
    return out


def repeats(regions: list[bytes], windows: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the regions: its region, its start there, and the class of equal windows (an index)."""
    sizes = np.array([len(r) for r in regions], np.int64)
    n = np.array(windows, np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"".join(r + b"\0" for r in regions), np.uint8)
    left = np.repeat(base + sizes, sizes + 1) - np.arange(len(data))
    order, place, words = suffix_array(data, left)
    shared = common_prefixes(order, place, words, left, length)
    classes = np.cumsum(shared[order] < length) - 1  # neighbours with ``length`` bytes in common are one class
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return of, at, classes[place[base[of] + at]]


def _spans(at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of consecutive numbers within each group: group, first, last."""
    if not len(at):
        return of, at, at
    new = np.concatenate([[True], (np.diff(of) != 0) | (np.diff(at) != 1)])
    first = np.flatnonzero(new)
    return of[first], at[first], at[np.append(first[1:], len(at)) - 1]


FOUND = "hash long, digest long, a long, b long, range int, block array<binary>"


def _block(spans: dict, blocks: list) -> pa.RecordBatch:
    n, m = len(spans["a"]), len(blocks)
    late = np.arange(n + m) >= n
    arrays = [pa.array(np.concatenate([x, np.zeros(m, np.int64)]), mask=late) for x in spans.values()]
    arrays += [pa.array([None] * n + [r for r, _ in blocks], pa.int32()), pa.array([None] * n + [x for _, x in blocks], pa.list_(pa.binary()))]
    return pa.RecordBatch.from_arrays(arrays, [*spans, "range", "block"])


def shard_repeats(regions: DataFrame, length: int, ranges: int) -> DataFrame:
    """hash, digest, a, b: stretches of repeated windows; or range, block: sorted marks of windows that other shards may have.

    ``regions``: hash, part, parts, digest, m, n, region; the rows of one hash and part meet in one task, in order.
    """

    def work(rows: list[tuple]) -> pa.RecordBatch:
        unique = {}
        for r in rows:
            unique.setdefault((r[0], r[3]), r)
        rows = [*unique.values()]
        of, at, kind = repeats([r[6] for r in rows], [r[5] for r in rows], length)
        m, split = np.array([r[4] for r in rows]), np.array([r[2] for r in rows]) > 1
        again = np.bincount(kind, minlength=1)[kind] > 1
        hit = again | (m[of] > 1)
        k, a, b = _spans(at[hit], of[hit])
        hashes, digests = np.array([r[0] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        spans = {"hash": hashes[k], "digest": digests[k], "a": a, "b": b}
        # Of a split anchor, one window of each class goes on to the merge, in sorted blocks, one for each range of marks.
        _, first = np.unique(kind, return_index=True)
        first = first[split[of[first]]]
        if not len(first):
            return _block(spans, [])
        sizes = np.array([len(r[6]) for r in rows])
        start = (np.cumsum(sizes) - sizes)[of[first]] + at[first]
        mark = Hasher(np.frombuffer(b"".join(r[6] for r in rows), np.uint8), 1).of(start, start + length)
        first = first[np.argsort(mark)]
        mark.sort()
        edges = np.searchsorted(mark, (np.arange(1, ranges, dtype=np.uint64) * np.uint64(2**64 // ranges)))
        packed = [mark, hashes[of[first]], digests[of[first]], at[first], hit[first].astype(np.int64)]
        return _block(spans, [(n, [x[i:j].tobytes() for x in packed]) for n, (i, j) in enumerate(zip([0, *edges], [*edges, len(mark)])) if i < j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, name = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:2] != name and size > SORTED:
                    yield work(held)
                    held, size = [], 0
                name = r[:2]
                held.append(r)
                size += len(r[6])
        if held:
            yield work(held)

    return regions.select("hash", "part", "parts", "digest", "m", "n", "region").mapInArrow(run, FOUND)


def merged(blocks: DataFrame) -> DataFrame:
    """hash, digest, a, b: windows that another shard has too, by binary search in the merged marks of each range.

    ``blocks``: range, block (packed arrays, sorted by mark); a shard has each class of equal windows once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            for r, block in zip(*(batch.column(c).to_pylist() for c in ("range", "block")), strict=True):
                if r != name and held:
                    yield found(held)
                    held = []
                name = r
                held.append(block)
        if held:
            yield found(held)

    def found(held: list) -> pa.RecordBatch:
        kinds = (np.uint64, np.int64, np.int64, np.int64, np.int64)
        blocks = [[np.frombuffer(x, kind) for x, kind in zip(block, kinds, strict=True)] for block in held]
        every = np.sort(np.concatenate([b[0] for b in blocks]))
        hits = []
        for mark, hashes, digests, at, known in blocks:
            more = np.searchsorted(every, mark, "right") - np.searchsorted(every, mark, "left") > 1
            more &= known == 0  # the shard has marked the others
            hits.append((hashes[more], digests[more], at[more]))
        hashes, digests, at = (np.concatenate(x) for x in zip(*hits, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (hashes, digests, at, at)], ["hash", "digest", "a", "b"])

    return blocks.select("range", "block").mapInArrow(run, "hash long, digest long, a long, b long")


def removed(docs: DataFrame, length: int = LENGTH, keep: tuple = ()) -> DataFrame:
    """``docs`` (doc_id, text) with ``spans``, the sorted byte spans that repeated windows cover.

    Texts are told apart by their bytes, so repeated ids do no harm; a null text is empty. Returns doc_id, the columns
    ``keep``, key, n_bytes, text (bytes), spans (null where there are none).
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = docs.select("doc_id", *keep, text.alias("text")).withColumn("key", F.unhex(F.md5("text")))
    all_runs = written(runs(docs.where(F.octet_length("text") >= length), length), "sa-runs")
    distinct = all_runs.groupBy("hash", "digest").agg(F.count("*").alias("m"), F.min(F.struct("key", "at", "doc_id")).alias("rep"))
    distinct = written(distinct, "sa-distinct")
    shared = distinct.groupBy("hash").agg(F.sum("m").alias("all"), F.count("*").alias("d")).where("all > 1").select("hash", F.ceil(F.col("d") / REGIONS).cast("int").alias("parts"))
    asked = written(distinct.join(shared, "hash"), "sa-asked")
    # Each text's runs that may repeat; ``rep`` where this text gives the region. Both lists are written before they are joined
    # to the rows, so that the join is split where one text has very many copies.
    lists = all_runs.join(asked, ["hash", "digest"]).groupBy("key").agg(F.collect_set(F.struct("hash", "digest", "at", "n", "m", "parts", F.when((F.col("rep.key") == F.col("key")) & (F.col("rep.at") == F.col("at")), F.struct(F.col("rep.doc_id").alias("doc_id"))).alias("rep"))).alias("runs"))
    lists = written(lists, "sa-lists")
    drop(all_runs, distinct, asked)
    known = docs.join(lists, "key", "left")
    known = known.select("doc_id", *keep, "key", F.octet_length("text").cast("long").alias("n_bytes"), "text", "runs")
    known = written(known, "sa-known")
    regions = known.where("runs is not null").select("doc_id", "text", F.explode("runs").alias("r")).where(F.col("r.rep").isNotNull() & F.col("r.rep.doc_id").eqNullSafe(F.col("doc_id")))
    regions = regions.select("r.hash", F.pmod("r.digest", "r.parts").cast("int").alias("part"), "r.parts", "r.digest", "r.m", "r.n", F.substring("text", F.col("r.at").cast("int") + 1, (F.col("r.n") + length - 1).cast("int")).alias("region"))
    dealt = regions.repartition(parts_for(spark), "hash", "part").sortWithinPartitions("hash", "part")
    ranges = parts_for(spark)
    found = written(shard_repeats(dealt, length, ranges), "sa-found")
    blocks = found.where("block is not null").select("range", "block").repartition(ranges, "range").sortWithinPartitions("range")
    spans = found.where("block is null").select("hash", "digest", "a", "b").unionByName(merged(blocks))
    spans = written(spans.groupBy("hash", "digest").agg(F.collect_set(F.struct("a", "b")).alias("s")), "sa-spans")
    drop(found)
    # From regions to texts: windows [a, b] cover bytes a to b + length - 1.
    places = lists.select("key", F.explode("runs").alias("r")).select("key", "r.hash", "r.digest", "r.at")
    cover = F.transform("s", lambda x: F.struct((F.col("at") + x["a"]).alias("start"), (F.col("at") + x["b"] + length).alias("stop")))
    covers = places.join(spans, ["hash", "digest"]).select("key", F.explode(cover).alias("x"))
    covers = written(covers.groupBy("key").agg(F.sort_array(F.collect_set("x")).alias("spans")), "sa-covers")
    drop(lists, spans)
    hit = known.where("runs is not null").drop("runs").join(covers, "key", "left")
    rest = known.where("runs is null").drop("runs").withColumn("spans", F.lit(None).cast(covers.schema["spans"].dataType))
    return hit.unionByName(rest)


def cut(data: bytes, spans: list[dict]) -> tuple[bytes, int]:
    """The bytes outside the sorted ``spans``, and the number of maximal runs removed."""
    kept, at, n = [], 0, 0
    for s in spans:
        if s["start"] > at or not n:
            kept.append(data[at : s["start"]])
            n += 1
        at = max(at, s["stop"])
    kept.append(data[at:])
    return b"".join(kept), n


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text of each row of ``docs`` (doc_id, text; other columns are ignored).

    ``text`` is what is left, without characters that a cut has left incomplete; the digest is of all bytes that are left. Null,
    empty and short texts lose nothing and come out empty or unchanged; repeated rows are repeats of each other; texts of any
    length are handled in pieces of bounded size; no rows give no rows.
    """
    found = removed(docs, length)
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = [cut(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            arrays = [pa.array([len(k) for k, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _ in rows])]
            texts = pa.array([k.decode(errors="ignore") for k, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *arrays, texts], ["doc_id", "n_bytes", "n_kept", "n_spans", "kept_sha256", "text"])

    hit = found.where("spans is not null").select("doc_id", "n_bytes", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_kept long, n_spans long, kept_sha256 string, text string")
    hit = hit.select("doc_id", "n_bytes", (F.col("n_bytes") - F.col("n_kept")).alias("n_removed"), "n_spans", "kept_sha256", "text")
    none = F.lit(0).cast("long")
    same = found.where("spans is null").select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("string").alias("text"))
    return hit.unionByName(same)


def without_repeats(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` with repeated byte strings cut from the texts, n_chars counted anew where it is a column; every row stays.

    A character that a cut leaves incomplete goes too; texts that lose nothing are unchanged, nulls included; repeated rows are
    repeats of each other; other columns may have any names but ``__rest``; no rows give no rows.
    """
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    held = docs.select("doc_id", "text", F.struct(*rest, F.col("text").isNull().alias("__null")).alias("__rest"))
    found = removed(held, length, ("__rest",))
    schema = found.select("doc_id", "__rest").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            kept = [cut(t, s)[0].decode(errors="ignore") for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__rest"), pa.array(kept, pa.string())], ["doc_id", "__rest", "text"])

    def columns(new: dict) -> list:
        return [(new[c] if c in new else F.col("doc_id") if c == "doc_id" else F.col(f"__rest.{c}")).alias(c) for c in docs.columns]

    hit = found.where("spans is not null").select("doc_id", "__rest", "text", "spans").mapInArrow(run, schema)
    hit = hit.select(*columns({"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}))
    text = F.when(~F.col("__rest.__null"), F.col("text").cast("string"))
    same = found.where("spans is null").select(*columns({"text": text}))
    return hit.unionByName(same)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
