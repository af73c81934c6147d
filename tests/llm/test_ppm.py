import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from quillstone.llm import ppm as P


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def symbols(t):
    return [255] * P.ORDER + [*b" ".join((t or "").encode().lower().split()), 254]


def counted(rows):
    """Of each context its symbols' counts; below the longest, each counts once for every longer context that has it."""
    counts = defaultdict(Counter)
    for i, t in rows:
        if not held(i):
            s = symbols(t)
            for p in range(P.ORDER, len(s)):
                counts[tuple(s[p - P.ORDER : p])][s[p]] += 1
    for k in range(P.ORDER, 0, -1):
        for c in [c for c in counts if len(c) == k]:
            for x in counts[c]:
                counts[c[1:]][x] += 1
    return counts


def brute(rows):
    kept = counted(rows)

    def prob(context, x):
        p, seen = 1.0, set()
        for k in range(P.ORDER, -1, -1):
            rest = {y: n for y, n in kept.get(context[len(context) - k :], {}).items() if y not in seen}
            if rest:
                total = sum(rest.values())
                if x in rest:
                    return p * (rest[x] - 0.5) / total
                p *= len(rest) / 2 / total
                seen |= set(rest)
        return p / (255 - len(seen))

    out = []
    words = Counter(w for i, t in rows if not held(i) for w in (t or "").encode().lower().split())
    ends = sum(not held(i) for i, _ in rows)
    n, v = words.total() + ends, len(words) + (ends > 0)
    for i, t in rows:
        s = symbols(t)
        score = sum(math.log10(prob(tuple(s[p - P.ORDER : p]), s[p])) for p in range(P.ORDER, len(s)))
        own = (t or "").encode().lower().split()
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own) + math.log10((ends + 1) / (n + v + 1))
        out.append((i, held(i), len(own) + 1, sum(words[w] > 0 for w in own) + (ends > 0), n, base, score))
    return out


@pytest.mark.parametrize("head", [1000, 3, 0])
def test_against_brute_force(spark, head):
    rng = random.Random(6)
    words = ["the", "The", "a", "is", "éa", "no\tw", "漢字", "it's", "xyzzy"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 30])))) for i in range(60)]
    rows += [(None, "the end"), (100, None), (101, ""), (7, "twice zq"), (7, "twice zq"), (102, "never " * 700), (103, "q" * 3000 + " z"), (104, "ab cd " * 40_000)]
    docs = spark.createDataFrame([(*r, 1.0, "g") for r in rows], "doc_id long, text string, score double, gram string")
    got = sorted(map(tuple, P.scores(docs, head=head).collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 3), round(r[6], 1))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-5)


def test_probabilities_sum_to_one(spark):
    from pyspark.sql import functions as F

    texts = [("abracadabra",), ("the cat sat",), ("a barb",)]
    raw = P.gathered(spark.createDataFrame(texts, "text string")).where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    known = {r.gram: r.n for r in raw.collect()}
    contexts = [b"\xff" * 5, b"\xff\xffabr", b"acada", b"xxxxx", b"xx ba", b"e cat", b"xxxab"]
    asked = {int.from_bytes(c, "big") << 8 | x for c in contexts for x in range(255)} | set(known)
    found = P.logs(spark.createDataFrame([(g, known.get(g, 0)) for g in asked], "gram long, n long"))
    sums = defaultdict(float)
    for r in found.collect():
        sums[(r.gram >> 8).to_bytes(5, "big")] += 10**r.log
    assert [sums[c] for c in contexts] == pytest.approx([1.0] * len(contexts))


def test_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.scores(docs).count() == 0
    only = next(i for i in range(100) if held(i))
    got = P.scores(spark.createDataFrame([(only, "ab")], "doc_id long, text string")).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (2, 0, 0, 0)
    assert got.score == pytest.approx(-3 * math.log10(255), rel=1e-5)


@pytest.mark.parametrize("most", [P.GRAMS, 1000, 0])
def test_every_context_counts(spark, most):
    """Byte strings looked up in place, in part, or all joined."""
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("abcdefghij klmnopqrstuvwxyz", k=80))) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in P.scores(docs, most=most).collect()}
    assert got == pytest.approx({r[0]: r[6] for r in brute(rows)}, rel=1e-6)
