import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillstone.llm import suffix_dedup as D


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
    return out


def texts(rng, length):
    common = "".join(rng.choices("abcd ", k=3 * length))
    out = [None, "", "x" * (length - 1), "é" * length, "ab" * length * 4, common, common, common[: length + 3]]
    for _ in range(60):
        t = "".join(rng.choices("abcd ", k=rng.randrange(6 * length)))
        if rng.random() < 0.5:
            at, a = rng.randrange(len(t) + 1), rng.randrange(2 * length)
            t = t[:at] + common[a : a + rng.randrange(2 * length)] + t[at:]
        out.append(t)
    return out


@pytest.mark.parametrize("regions", [1024, 3])
def test_against_brute_force(spark, monkeypatch, regions):
    monkeypatch.setattr(D, "REGIONS", regions)
    monkeypatch.setattr(D, "GRAM", 8)
    rng = random.Random(regions)
    length = 24
    rows = [(i, t) for i, t in enumerate(texts(rng, length))] + [(None, "tail " * 20), (3, "same id, other text " * 3)]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, key string")
    got = sorted(map(tuple, D.deduplicated(docs, length).collect()), key=repr)
    want = brute([(t or "").encode() for _, t in rows], length)
    assert got == sorted([(i, *w) for (i, _), w in zip(rows, want, strict=True)], key=repr)


def test_production_length(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage = " ".join(word() for _ in range(90))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(300))) + (passage if i % 3 else passage[:399]) + word()) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, passage * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, D.deduplicated(docs).collect()))
    assert got == sorted((i, *w) for (i, _), w in zip(rows, brute([t.encode() for _, t in rows], 400), strict=True))


def test_texts_without_repeats(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijé", k=6))
    passage = " ".join(word() for _ in range(20))
    rows = [(i, " ".join(word() for _ in range(30)) + (passage if i % 2 else ""), "k", 1) for i in range(20)] + [(None, None, "k", 1), (3, "x", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n_chars long")
    out = D.without_repeats(docs, 64)
    assert out.columns == docs.columns
    want = {i: t for (i, t, *_), w in zip(rows, brute([(t or "").encode() for _, t, *_ in rows], 64), strict=True) if not w[1]}
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text and len(r.text) > 1 and r.doc_id % 2:
            assert passage[3:-3] not in r.text and len(r.text) == r.n_chars
        elif r.text and len(r.text) > 1:
            assert r.text == want[r.doc_id] and r.n_chars == 1


def test_long_texts_are_cut_alike(monkeypatch):
    rng = random.Random(9)
    data = bytes(rng.choices(b"abc", k=3000))
    whole = D.runs_of(np.frombuffer(data, np.uint8), np.array([0]), np.array([3000 - 400 + 1]), 400)
    windows = {}
    for h, a, n in zip(*whole[1:2], *whole[3:], strict=True):
        windows |= {w: h for w in range(a, a + n)}
    assert sorted(windows) == list(range(2601))
    part = D.runs_of(np.frombuffer(data[1000:2000], np.uint8), np.array([0]), np.array([601]), 400)
    for h, a, n in zip(*part[1:2], *part[3:], strict=True):
        assert all(windows[1000 + w] == h for w in range(a, a + n))


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    regions = [bytes(rng.choices(b"ab\0", k=rng.randrange(60, 90))) for _ in range(5)] + [b"ab" * 40] * 2
    sizes = np.array([len(r) for r in regions])
    base = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"".join(r + b"\0" for r in regions), np.uint8)
    left = np.repeat(base + sizes, sizes + 1) - np.arange(len(data))
    order, place, words = D.suffix_array(data, left)
    shared = D.common_prefixes(order, place, words, left, 32)
    suffix = lambda i: data[i : i + left[i]].tobytes()
    for a, b in zip(order, order[1:]):
        x, y = suffix(a)[:32], suffix(b)[:32]
        same = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert shared[b] == same
    assert [suffix(i) for i in order] == sorted(map(suffix, range(len(data))))


def test_empty_table(spark):
    assert D.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_names_and_nulls(spark):
    docs = spark.createDataFrame([(1, "ab" * 300, "x", "y", "z"), (1, "ab" * 300, None, None, None), (None, None, "q", "q", "q")], "doc_id long, text string, spans string, hash string, runs string")
    got = sorted(map(tuple, D.deduplicated(docs).collect()), key=repr)
    assert [r[:4] for r in got] == [(1, 600, 600, 1), (1, 600, 600, 1), (None, 0, 0, 0)]
    out = D.without_repeats(docs, 400)
    assert out.columns == docs.columns and sorted((r.spans or "") for r in out.collect()) == ["", "q", "x"]


def test_planted_passages_go_from_400_bytes_on(spark):
    """Passages of 51 to 90 words in two documents each: all of 400 bytes or more are removed, those with less stay, as brute force has it."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    rows, sizes = [], {}
    for n in range(51, 91):
        passage = some(n)
        for i in (2 * n, 2 * n + 1):
            rows.append((i, f"{some(40)} {'XY'[i % 2]} {passage} {'XY'[i % 2]} {some(40)}"))
            sizes[i] = len(passage) + 2  # the blanks around are shared as well
    rows += [(i, some(150)) for i in range(1000, 1040)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in D.deduplicated(docs).collect()}
    assert sorted(map(tuple, got.values())) == sorted((i, *w) for (i, _), w in zip(rows, brute([t.encode() for _, t in rows], 400), strict=True))
    assert {i for i, r in got.items() if r.n_removed} == {i for i, n in sizes.items() if n >= 400} and 0 < sum(n < 400 for n in sizes.values()) < len(sizes)
    assert all(r.n_bytes == len(t) for (i, t) in rows for r in [got[i]])


def test_query_on_sample_documents(spark):
    """The query's rows on the smallest tables are those of brute force; n_bytes is the whole text's length, whatever was removed."""
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, D.op1_suffix_dedup(spark, path).collect()))
    assert got == sorted((i, *w) for (i, _), w in zip(docs, brute([(t or "").encode() for _, t in docs], 400), strict=True))
    assert 0 < sum(r[2] > 0 for r in got) < len(got)
