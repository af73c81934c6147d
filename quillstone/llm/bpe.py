"""Byte-level BPE: encoding and decoding with the ranks of a public vocabulary file.

A task splits its texts by the vocabulary's pattern, interns the distinct pieces, and merges those it has not met
yet in padded numpy matrices, one for each bucket of lengths: every round each row merges its leftmost pair of
minimum rank, found by a hashed lookup of the pair of ids, and the matrix is compacted to the rows and columns still at
work. Pieces over ``LONG`` bytes are rows too; a round merges all occurrences of their minimum pair from the left, unless
that would create a pair of smaller rank.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, table, text_batches, text_bytes

VOCABULARY = "byte_bpe_50k.tiktoken"
NONE = np.int64(1 << 40)
LONG = 512
#: Cells of one padded matrix.
CELLS = 1 << 20
#: Distinct pieces that a worker keeps between batches; beyond it starts afresh.
KEPT = 150_000
#: Slots of the pair table for each pair, and the multiplier of its hash.
SPARE, MIX = 4, np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Ranks by token, the id of each single byte, and a hashed table of the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.sizes = np.zeros(max(self.tokens) + 1, np.int64)
        for i, t in self.tokens.items():
            self.sizes[i] = len(t)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(len(self.sizes))), np.uint8)
        pairs = {}
        for t, i in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.bits = max(4, (len(pairs) * SPARE).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        keys, values = np.array([*pairs], np.int64), np.array([*pairs.values()], np.int64)
        at, self.probes = self._slot(keys), 0
        while len(keys):  # linear probing, all keys of a step at once
            self.probes += 1
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.ranks[at[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; ``NONE`` where it does not merge (also for padding, -1)."""
        keys = a << 20 | b
        keys = np.where((a < 0) | (b < 0), np.int64(-2), keys)
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ranks[at], NONE)
        todo = np.flatnonzero((seen != keys) & (seen != -1) & (keys != -2))
        for _ in range(self.probes):
            if not len(todo):
                break
            at.flat[todo] = (at.flat[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at.flat[todo]]
            hit = seen == keys.flat[todo]
            out.flat[todo[hit]] = self.ranks[at.flat[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        return self.flat[np.repeat(self.starts[ids], sizes) + ragged(sizes)].tobytes()


def merge_rows(vocabulary: Vocabulary, ids: np.ndarray) -> list[np.ndarray]:
    """Encode a padded matrix (-1 fills) of byte ids, one piece a row."""
    out: list = [None] * len(ids)
    rows, width = np.arange(len(ids)), ids.shape[1]
    ranks = vocabulary.rank(ids[:, :-1], ids[:, 1:])
    while len(rows):
        best = ranks.min(1) if width > 1 else np.full(len(rows), NONE)
        done = best == NONE
        for k in np.flatnonzero(done):
            row = ids[k]
            out[rows[k]] = row[row >= 0].copy()
        if done.any():
            rows, ids, ranks, best = rows[~done], ids[~done], ranks[~done], best[~done]
            if not len(rows):
                break
            width = int((ids >= 0).sum(1).max())
            ids, ranks = ids[:, :width].copy(), ranks[:, : width - 1].copy()
        n, at = np.arange(len(rows)), ranks.argmin(1)  # the leftmost of the least
        ids[n, at] = best
        cols = np.arange(width)
        ids = np.where(cols[None, :-1] > at[:, None], ids[:, 1:], ids[:, :-1])  # closes the gap
        ranks = np.where(cols[None, : width - 2] > at[:, None], ranks[:, 1:], ranks[:, :-1]) if width > 2 else ranks[:, :0]
        width -= 1
        if width > 1:
            left = np.maximum(at - 1, 0)
            fresh = vocabulary.rank(ids[n, left], ids[n, left + 1])
            ranks[n, left] = fresh
            right = np.minimum(at, width - 2)
            ranks[n, right] = vocabulary.rank(ids[n, right], ids[n, right + 1])
    return out


def merge_long(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Encode one long row: a round merges all of the minimum pair from the left while no new pair ranks lower."""
    while len(ids) > 1:
        ranks = vocabulary.rank(ids[:-1], ids[1:])
        best = ranks.min()
        if best == NONE:
            break
        at = np.flatnonzero(ranks == best)
        # Of overlapping occurrences (a run of one id) every second counts, from the left.
        run = np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
        first = at[np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])]
        at = at[(at - first[run]) % 2 == 0]
        for chosen in (at, at[:1]):
            new = ids.copy()
            new[chosen] = best
            keep = np.ones(len(ids), bool)
            keep[chosen + 1] = False
            new = new[keep]
            if len(chosen) == 1 or vocabulary.rank(new[:-1], new[1:]).min() >= best:
                break
        ids = new
    return ids


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """The ids of each piece, by buckets of powers of two of the length."""
    out: list = [None] * len(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    for k in np.flatnonzero(sizes > LONG):
        out[k] = merge_long(vocabulary, vocabulary.byte_ids[np.frombuffer(pieces[k], np.uint8)])
    short = np.flatnonzero(sizes <= LONG)
    bucket = np.ceil(np.log2(np.maximum(sizes[short], 1))).astype(int)
    for b in np.unique(bucket):
        members = short[bucket == b]
        step = max(1, CELLS >> int(b))
        for at in range(0, len(members), step):
            some = members[at : at + step]
            width = int(sizes[some].max())
            ids = np.full((len(some), max(width, 1)), -1, np.int64)
            flat = np.frombuffer(b"".join(pieces[k] for k in some), np.uint8)
            ids[np.repeat(np.arange(len(some)), sizes[some]), ragged(sizes[some])] = vocabulary.byte_ids[flat]
            for k, found in zip(some, merge_rows(vocabulary, ids), strict=True):
                out[k] = found
    return out


class Encoder:
    """Encodes texts, keeping the ids of pieces met before."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as file:
            self.vocabulary = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})
        self.split = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KEPT:
            self.forget()
        pieces = [self.split(t) for t in texts]
        fresh = [p for p in set().union(*pieces) if p not in self.known] if pieces else []
        if fresh:
            ids = encode_pieces(self.vocabulary, [p.encode() for p in fresh])
            self.known.update(zip(fresh, range(len(self.sizes), len(self.sizes) + len(fresh)), strict=True))
            self.sizes = np.concatenate([self.sizes, [len(x) for x in ids]])
            self.flat = np.concatenate([self.flat, *ids])
            self.starts = np.cumsum(self.sizes) - self.sizes
        out = []
        for words in pieces:
            if not words:
                out.append(np.zeros(0, np.int64))
                continue
            k = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            sizes = self.sizes[k]
            out.append(self.flat[np.repeat(self.starts[k], sizes) + ragged(sizes)])
        return out


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` (array<int>) and, if named, the decoded bytes.

    Null and empty texts have no tokens and decode to no bytes; every row stays; columns of those names are replaced.
    The vocabulary file must lie at the same path on every executor.
    """
    path, pattern = _vocabulary(path, pattern)
    rest = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    schema = docs.select(rest).schema.add(ids_col, T.ArrayType(T.IntegerType()))
    if decoded_col:
        schema = schema.add(decoded_col, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoder(path, pattern)
        for batch in text_batches(batches, text=text):
            ids = found.encode([x or "" for x in batch.column(text).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            arrays = [batch.column(c) for c in rest]
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]), pa.int32())))
            if decoded_col:
                arrays.append(pa.array([found.vocabulary.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, [*rest, ids_col, *[decoded_col] * bool(decoded_col)])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``docs`` with the bytes of the token ids in ``ids_col``; null ids decode to no bytes."""
    path, pattern = _vocabulary(path, None)
    rest = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path, pattern).vocabulary
        for batch in batches:
            found = [vocabulary.decode(np.array(x or [], np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found, pa.binary())], [*rest, out])

    return docs.mapInArrow(run, docs.select(rest).schema.add(out, "binary"))


def digests(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same work, with digests in place of ids and bytes."""
    path, pattern = _vocabulary(path, pattern)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoder(path, pattern)
        for batch in text_batches(batches):
            ids = found.encode([x.decode() for x in text_bytes(batch.column("text"))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(found.vocabulary.decode(x)).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
