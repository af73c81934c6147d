import random
from collections import Counter

import pytest

from quillstone.llm import near_texts as N


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(texts):
    """Each text's group by all pairs with a Jaccard similarity of 0.8 or more: the least index of its component."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or a and b and len(a & b) >= 0.8 * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return [root(i) for i in range(len(texts))]


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "".join(rng.choices("xyz", k=4))
    return " ".join(words)


def corpus(seed, families=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 6)))
    out = [None, "", " \t", "One two", "one TWO", "one two three"]
    for _ in range(families):
        text = " ".join(word() for _ in range(rng.choice([5, 30, 120, 400])))
        out.append(text)
        for _ in range(rng.choice([0, 1, 3, 8])):
            out.append(edited(rng, text, rng.choice([0, 1, 1, 2, 3, 6, 12])))
    return out


@pytest.mark.parametrize("block", [1024, 4])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "CHECKED", block)
    texts = corpus(block)
    docs = spark.createDataFrame([(i, t, "q", "r") for i, t in enumerate(texts)], "doc_id long, text string, key string, sid string")
    want = plain_groups(texts)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(kept.collect())
    assert [(r.doc_id, r.text) for r in got] == [(i, texts[i]) for i in sorted(set(want))]
    assert len(set(want)) < len(texts) - 40


def test_a_large_group_around_one_text(spark):
    """Copies that are each similar to one text, but hardly to each other."""
    rng = random.Random(3)
    middle = " ".join(str(rng.randrange(10**6)) for _ in range(300))
    texts = [edited(rng, middle, 5) for _ in range(150)] + [middle] + [str(i) * 3 + " " + middle[: 5 * i] for i in range(10)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    want = plain_groups(texts)
    assert Counter(want)[0] == 151
    assert sorted(r.doc_id for r in N.keep_one(docs).collect()) == sorted(set(want))


def test_nulls_ties_and_repeats(spark):
    rows = [(None, "a b c d e f"), (4, "A b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, None), (None, ""), (7, "word " * 200_000), (8, "word " * 199_999)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(N.keep_one(docs).collect(), key=str)
    assert sorted(r.doc_id for r in got) == [4, 7, 9]
    assert N.keep_one(docs.where("false")).count() == 0


def test_similarity_of_sketches():
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(500))
    for n in (0, 5, 10, 40):
        other = edited(rng, text, n)
        a, b = (N.np.frombuffer(N.sketch(t.encode())[2], N.np.uint32) for t in (text, other))
        x, y = shingles(text), shingles(other)
        exact = len(x & y) / len(x | y)
        assert N.similarity(a, b) == pytest.approx(exact if exact > 0.7 else 0, abs=0.11 if n == 40 else 1e-9) or exact < 0.8
        mins = (N.np.frombuffer(N.sketch(t.encode())[3], N.np.uint32) for t in (text, other))
        assert N.np.equal(*mins).mean() == pytest.approx(exact, abs=0.15)


def test_keep_one(spark):
    rows = [(5, "a b c d e", "x"), (2, "A b c  d e", "y"), (2, "a b c d e", "z"), (None, "only null", "x"), (None, "only null", "y"), (None, "other words stand here", "z"), (9, None, "x"), (8, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert [i for i, _ in got] == ["2", "8", "None", "None"] and got[2:] == [("None", "only null"), ("None", "other words stand here")]
