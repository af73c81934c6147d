import hashlib
import random
import zlib

import numpy as np

from quillstone.llm import media_avi as A


def slow_decode(frame):
    """One lossless JPEG frame, bit by bit."""
    sos = frame.index(b"\xff\xda")
    _, _, codes, values = A.read_head(frame[: sos + 2 + int.from_bytes(frame[sos + 2 : sos + 4], "big")])
    table = {(c, n): v for c, n, v in A.huffman(codes, values)}
    bits = "".join(f"{b:08b}" for b in frame[sos + 2 + int.from_bytes(frame[sos + 2 : sos + 4], "big") : -2].replace(b"\xff\x00", b"\xff"))
    at, out = 0, []
    for k in range(A.UNIT):
        n = next(n for n in range(1, 17) if (int(bits[at : at + n], 2), n) in table)
        cat = table[int(bits[at : at + n], 2), n]
        at += n
        extra = int(bits[at : at + cat] or "0", 2)
        at += cat
        d = extra if not cat or extra >> (cat - 1) else extra - (1 << cat) + 1
        before = 128 if not k else out[k - A.WIDTH] if not k % A.WIDTH else out[k - 1]
        out.append(before + d)
    return bytes(out)


def test_round_trip_of_any_bytes():
    rng = random.Random(8)
    data = rng.randbytes(A.UNIT * 40) + bytes(A.UNIT) + b"\xff" * A.UNIT + b"\x00\xff" * (A.UNIT // 2)
    frames = A.code_frames(np.frombuffer(data, np.uint8).reshape(-1, A.UNIT))
    assert b"".join(map(slow_decode, frames)) == data
    assert np.array(A.decode_frames(frames)).tobytes() == data
    file = A.to_file(frames)
    assert A.read_file(file) == (frames, 25.0)
    assert len(file) == int.from_bytes(file[4:8], "little") + 8


def test_shots():
    a, b = np.full((30, A.UNIT), 40, np.uint8), np.full((20, A.UNIT), 200, np.uint8)
    assert A.shots(np.concatenate([a, b, a])) == [0, 30, 50]
    assert A.shots(a[:1]) == [0]


def test_rows(spark):
    rows = [(1, "héllo\n" * 500), (None, None), (2, ""), (3, "x" * 192), (3, "x" * 192), (4, "y" * 193), (5, "long " * 60000)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, media string")
    got = sorted(map(tuple, A.features(A.encode(docs)).collect()), key=repr)
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: repr((r[0], len((r[1] or "").encode())))), strict=True):
        data = A.payload((t or "").encode())
        assert len(data) % 192 == 0 and len(data) >= 192
        assert r[:5] == (i, len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    assert got[3][1:] == got[2][1:] or got[4][1:] == got[3][1:]
    cut = A.clips(A.encode(docs)).collect()
    assert sum(r.frames for r in cut) == sum(r[2] for r in got) // 192
    assert A.features(A.encode(docs.where("doc_id = 77"))).count() == 0
