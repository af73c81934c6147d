"""Media columns: AVI files of motion-JPEG frames.

A payload becomes frames of 16 x 12 grey samples at 25 a second, each a lossless JPEG (process SOF3, predictor 1: the
left neighbour, in the first column the upper one), in a RIFF file with an ``idx1`` index. Reading walks the RIFF chunks,
takes the frames by the index, parses each frame's markers and decodes the Huffman codes of all frames of a batch
side by side, one sample of each frame a step. Shots begin where the histogram of a frame differs from the one before by more
than the mean and three deviations of the differences around it, and by a least share of the samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches, text_bytes

WIDTH, HEIGHT, FPS = 16, 12, 25
UNIT = WIDTH * HEIGHT
FILL = 32
#: Frames that are coded or decoded side by side.
LANES = 4096
#: The Huffman table: how many codes have 1, 2, ... 16 bits, and the bits of the difference that each stands for, in order.
CODES = (0, 1, 4, 3, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
VALUES = (7, 2, 3, 4, 5, 0, 1, 6, 8)
#: A cut needs this many samples to change their bin at least; frames on either side that its threshold looks at.
LEAST_CHANGE, AROUND = 96, 12


def payload(text: bytes) -> bytes:
    """The bytes, filled up to a positive multiple of a frame's samples."""
    return text + bytes([FILL]) * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def huffman(codes: tuple, values: tuple) -> list[tuple[int, int, int]]:
    """Code, its bits and its value, by the canonical rule of the JPEG standard."""
    out, code, at = [], 0, 0
    for bits, n in enumerate(codes, 1):
        for v in values[at : at + n]:
            out.append((code, bits, v))
            code += 1
        at += n
        code <<= 1
    return out


@lru_cache(maxsize=8)
def encoding(codes: tuple, values: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 to 255: its code with the extra bits, and the bits of both."""
    code, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    own = {v: (c, bits) for c, bits, v in huffman(codes, values)}
    for d in range(-255, 256):
        n = abs(d).bit_length()
        c, bits = own[n]
        code[d + 255], size[d + 255] = c << n | (d if d >= 0 else d + (1 << n) - 1), bits + n
    return code, size


@lru_cache(maxsize=8)
def decoding(codes: tuple, values: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits that may come next: bits used and the difference."""
    size, diff = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
    for c, bits, n in huffman(codes, values):
        for extra in range(1 << n):
            at = (c << n | extra) << (16 - bits - n)
            to = at + (1 << (16 - bits - n))
            size[at:to] = bits + n
            diff[at:to] = extra if not n or extra >> (n - 1) else extra - (1 << n) + 1
    return size, diff


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def frame_head() -> bytes:
    """All of a frame before its coded samples."""
    sof = struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
    return b"\xff\xd8" + _segment(0xC3, sof) + _segment(0xC4, bytes([0, *CODES, *VALUES])) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def code_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of frames (n, UNIT) of 8-bit samples."""
    code_of, size_of = encoding(CODES, VALUES)
    head, out = frame_head(), []
    for at in range(0, len(samples), LANES):
        x = samples[at : at + LANES].astype(np.int64).reshape(-1, HEIGHT, WIDTH)
        before = np.full_like(x, 128)
        before[:, :, 1:] = x[:, :, :-1]
        before[:, 1:, 0] = x[:, :-1, 0]
        diff = (x - before + 255).reshape(-1, UNIT)
        code, size = code_of[diff], size_of[diff]
        ends = np.cumsum(size, axis=1)
        total = ends[:, -1]
        n_bytes = -(-total // 8)
        stops = np.cumsum(n_bytes)
        bit = (ends - size) + ((stops - n_bytes) * 8)[:, None]
        word = (code << (24 - (bit & 7) - size)).ravel()
        byte, n = (bit >> 3).ravel(), int(stops[-1]) + 2
        coded = sum(np.bincount(byte + k, (word >> (16 - 8 * k)) & 255, n) for k in range(3)).astype(np.int64)
        coded[stops - 1] |= (1 << (n_bytes * 8 - total)) - 1  # fills the last byte with ones
        coded = coded.astype(np.uint8).tobytes()
        start = 0
        for stop in stops.tolist():
            out.append(head + coded[start:stop].replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
            start = stop
    return out


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def to_file(frames: list[bytes]) -> bytes:
    """An AVI file of JPEG frames."""
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", UNIT, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    sizes = np.array([len(f) for f in frames], np.int64)
    places = 4 + np.cumsum(8 + sizes + (sizes & 1)) - (8 + sizes + (sizes & 1))
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, places, sizes
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + hdrl + movi + _chunk(b"idx1", index.tobytes()))


def read_file(data: bytes) -> tuple[list[bytes], float]:
    """The frames by the file's index, and frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movi, index, rate, todo = -1, b"", float(FPS), [(12, len(data))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movi = at + 8
            elif name == b"LIST":
                todo.append((at + 12, at + 8 + size))
            elif name == b"strh" and data[at + 8 : at + 12] == b"vids":
                scale, ticks = struct.unpack("<II", data[at + 28 : at + 36])
                rate = ticks / scale
            elif name == b"idx1":
                index = data[at + 8 : at + 8 + size]
            at += 8 + size + (size & 1)
    entries = np.frombuffer(index, "<u4").reshape(-1, 4)
    if movi < 0:
        raise ValueError("no frames")
    return [data[movi + p + 8 : movi + p + 8 + n] for p, n in entries[:, 2:].tolist()], rate


@lru_cache(maxsize=64)
def read_head(head: bytes) -> tuple[int, int, tuple, tuple]:
    """Height, width and Huffman table of a frame's markers."""
    at, found, codes, values = 2, (0, 0), (), ()
    while at < len(head):
        marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        if marker == 0xC3:
            found = struct.unpack(">HH", body[1:5])
        elif marker == 0xC4:
            codes, values = tuple(body[1:17]), tuple(body[17:])
        at += 2 + size
    return *found, codes, values


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The samples (height, width) of JPEG frames, in order."""
    out: list = [None] * len(frames)
    kinds: dict[bytes, list[int]] = {}
    for k, f in enumerate(frames):
        sos = f.index(b"\xff\xda")
        kinds.setdefault(f[: sos + 2 + int.from_bytes(f[sos + 2 : sos + 4], "big")], []).append(k)
    for head, members in kinds.items():
        height, width, codes, values = read_head(head)
        size_of, diff_of = decoding(codes, values)
        for at in range(0, len(members), LANES):
            some = members[at : at + LANES]
            coded = [frames[k][len(head) : -2].replace(b"\xff\x00", b"\xff") for k in some]
            sizes = np.array([len(c) for c in coded], np.int64)
            flat = np.frombuffer(b"".join(coded) + b"\0\0\0\0", np.uint8).astype(np.int64)
            words = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
            bit = (np.cumsum(sizes) - sizes) * 8
            diff = np.empty((height * width, len(some)), np.int32)
            for t in range(height * width):
                key = (words[bit >> 3] >> (8 - (bit & 7))) & 0xFFFF
                diff[t] = diff_of[key]
                bit += size_of[key]
            x = diff.T.reshape(-1, height, width).copy()
            x[:, 0, 0] += 128
            x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1)
            x = np.cumsum(x, axis=2).astype(np.uint8)
            for k, samples in zip(some, x, strict=True):
                out[k] = samples
    return out


def shots(samples: np.ndarray) -> list[int]:
    """First frames of the shots; samples: (frames, anything)."""
    flat = samples.reshape(len(samples), -1)
    bins = (flat >> 4).astype(np.int64) + 16 * np.arange(len(flat))[:, None]
    histogram = np.bincount(bins.ravel(), minlength=16 * len(flat)).reshape(-1, 16)
    change = np.abs(np.diff(histogram, axis=0)).sum(1) // 2
    n = len(change)
    low, high = np.maximum(np.arange(n) - AROUND, 0), np.minimum(np.arange(n) + AROUND + 1, n)
    one, two = (np.concatenate([[0], np.cumsum(x)]) for x in (change, change**2))
    count, s, q = high - low, one[high] - one[low], two[high] - two[low]
    # change > mean + 3 deviations, in whole numbers
    over = np.maximum(count * change - s, 0)
    return [0, *(np.flatnonzero((over**2 > 9 * (count * q - s**2)) & (change >= LEAST_CHANGE)) + 1).tolist()]


def encode(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes (null: none) as an AVI file."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = text_bytes(batch.column("text"))
            whole = [payload(t) for t in texts]
            frames, at, files = code_frames(np.frombuffer(b"".join(whole), np.uint8).reshape(-1, UNIT)), 0, []
            for p in whole:
                files.append(to_file(frames[at : at + len(p) // UNIT]))
                at += len(p) // UNIT
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", media])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, {media} binary")


def _read(files: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, float]]:
    """Each file with its samples and frames a second; the frames of all are decoded together."""
    found = [read_file(f) for f in files]
    samples, at = decode_frames([f for frames, _ in found for f in frames]), 0
    for file, (frames, rate) in zip(files, found, strict=True):
        yield file, np.array(samples[at : at + len(frames)]), rate
        at += len(frames)


def features(media: DataFrame, col: str = "media") -> DataFrame:
    """doc_id, n_bytes and what reading the files back gives: digests of the payload and the file, and the shots."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, text="media"):
            rows = []
            for file, samples, rate in _read(batch.column("media").to_pylist()):
                data, cuts = samples.tobytes(), shots(samples)
                feature = f"frames={len(samples)};fps={rate:g};shots={len(cuts)};at={','.join(map(str, cuts))}"
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *arrays], ["doc_id", "n_bytes", *names])

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", F.col(col).alias("media")).mapInArrow(run, schema)


def clips(media: DataFrame, col: str = "media") -> DataFrame:
    """A row for each shot of each file: doc_id, clip, start_s, end_s, frames. Null files have none."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, text="media"):
            rows = []
            for doc_id, (_, samples, rate) in zip(batch.column("doc_id").to_pylist(), _read(batch.column("media").to_pylist()), strict=True):
                cuts = [*shots(samples), len(samples)]
                rows += [(doc_id, k, a / rate, b / rate, b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "clip", "start_s", "end_s", "frames"])

    known = media.where(F.col(col).isNotNull()).select("doc_id", F.col(col).alias("media"))
    return known.mapInArrow(run, f"doc_id {kind}, clip long, start_s double, end_s double, frames long")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are one frame of spaces; repeated rows stay; no rows give no rows."""
    return features(encode(table(spark, sf_dir, "documents")))
