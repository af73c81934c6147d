import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import toxicity as T


@pytest.fixture(scope="module")
def model(spark):
    return corpus(spark)[2]


def corpus(spark):
    rng = random.Random(3)
    clean = ["table", "window", "garden", "letter", "coffee", "is", "morning", "good", "with", "line"]
    bad = ["zurgling", "vokkest"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(clean, k=rng.choice([3, 20, 60]))
        if toxic := i % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), 9.0))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, known, T.train(docs, known)


def test_restores(model):
    model.start()
    for odd in ("zurgl1ng", "zuuurgling", "z u r g l i n g", "vokk3st", "v-o-k-k-e-s-t", "vokkke5t!!", "ZURGLING,"):
        assert model.score(f"good table {odd} with line") >= T.THRESHOLD, odd
    for plain in ("", "good coffee", "line 123 45", "a b c garden", "w1ndow"):
        assert model.score(plain) < T.THRESHOLD, plain
    assert model.restorer.text("g00d w i n d o w lettter") == "good window letter"


def test_held_out(spark):
    docs, labels, _ = corpus(spark)
    extra = spark.createDataFrame([(None, "zurgling"), (7000, None), (7001, ""), (3, "good"), (3, "good")], "doc_id long, text string").selectExpr("*", "1.0D as score")
    odd = spark.createDataFrame([(None, 1), (1, None), (99999, 1)], "doc_id long, toxic int")
    got = T.scores(docs.unionByName(extra), labels.unionByName(odd)).collect()
    assert len(got) == 605
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.held_out and r.doc_id is not None and r.doc_id < 600:
            assert r.predicted == (r.doc_id % 5 == 0)
    kept = T.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 480


def test_held_out_labels_are_not_used(spark):
    docs, labels, model = corpus(spark)
    turned = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 then 1 - toxic else toxic end as toxic")
    again = T.train(docs, turned)
    assert again.weights == model.weights and again.beta == model.beta


def test_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.scores(docs, labels).collect()} == {0.5}
    assert T.scores(docs.where("doc_id > 5"), labels).count() == 0


def test_long_text(model):
    model.start()
    assert model.score("good table " * 100_000 + "zurgling " + "1" * 50_000 + " " + "a1" * 5000) >= T.THRESHOLD


def test_word_breaks_and_gaps(model):
    """Words end where the lattice says: spaced words in a row, words in longer pieces, loose letters beside them."""
    model.start()
    for odd in ("z u r g l i n g v o k k e s t", "v o k k e s t z u r g l i n g", "zurg ling", "vok kest", "zur gl1ng", "g o o d v-o-k k e s t", "z.u.r.g.l.1.n.g"):
        assert model.score(f"good table {odd} with line") >= T.THRESHOLD, odd
    assert model.restorer.text("g o o d z u r g l i n g vok kest w i n d o w table") == "good zurgling vokkest window table"
    assert model.restorer.text("good table with coffee 12 garden") == "good table with coffee 12 garden"


def plain_readings(token, fixed):
    """All readings of a token with their prices, written out from the rules."""
    runs, out = ["".join(g) for _, g in itertools.groupby(token)], []
    for run in runs:
        c, n = run[0], len(run)
        some = [(run, 0.0)]
        if not fixed and c in T.LEET:
            some += [(x * n, T.CHANGE * n) for x in T.LEET[c]]
            some += [(x, T.CHANGE + T.SHORTEN) for x in T.LEET[c] if n > 1]
            some += [("", T.JOIN)] if c == "*" else []
        elif not fixed and c.isalpha() and n > 1:
            some = [(c * k, 0.0 if k == n else T.SHORTEN) for k in {1, 2}]
        out.append(some)
    return [("".join(p for p, _ in path), sum(x for _, x in path)) for path in itertools.product(*out)]


def plain_score(characters, words, price):
    """A reading's score: every word begins and ends with blanks."""
    last = "  "
    for x in words + " ":
        price += characters.log(last + x)
        last = "  " if x == " " else last[1] + x
    return price


def test_viterbi_against_all_paths(model):
    rng, c = random.Random(8), model.characters
    for _ in range(60):
        token = "".join(rng.choice(["a", "0", "1", "5", "ll", "33", "*", "g", "$", "eee"]) for _ in range(rng.randrange(1, 6)))
        best, _ = c.best(c._through({"  ": (0.0, ())}, token))
        assert best == pytest.approx(max(plain_score(c, text, price) for text, price in plain_readings(token, False)))
    for _ in range(60):
        middle = tuple(rng.choice(["z", "u", "0", "g1", "ok", "k5", "3", "tt"]) for _ in range(rng.randrange(1, 5)))
        paths = []
        for pieces in itertools.product(*(plain_readings(p, not T.ODD.search(p)) for p in middle)):
            for gaps in itertools.product((" ", ""), repeat=len(middle) - 1):
                text = "".join(p + g for (p, _), g in zip(pieces, (*gaps, ""), strict=True))
                paths.append(plain_score(c, text, sum(x for _, x in pieces) + T.JOIN * gaps.count("")))
        assert c.lattice("", middle, "")[0] == pytest.approx(max(paths))


def test_a_token_of_a_megabyte(model):
    model.start()
    began = time.time()
    assert model.score("z u r g l i n g " + "a1" * 500_000) >= T.THRESHOLD
    assert time.time() - began < 60


def test_few_labels(spark):
    rows = [(i, "good table with line" + " vokkest" * (i % 3 == 0)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = T.scores(docs, labels).collect()
    assert min(r.score for r in got if r.doc_id % 3 == 0) > max(r.score for r in got if r.doc_id % 3)


def test_batched_weights_are_those_of_each_token():
    rng = random.Random(5)
    letters = "abcdefgß²٣ç0134@$!|+(*.,\"'()=_-"
    tokens = {"", "=", "==", "(abc", "aaa", "a!", "!!!", "ab²²²", "\ud800x", *("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(4000))}
    characters = T.Characters({"  a": 5, " ab": 5, "abc": 3, "bcd": 2, "cde": 1, "de ": 4})
    model = T.Model(characters, {})
    model.start()
    every = sorted({f for t in tokens for f in T.features(model.restorer.word(t))})
    assert T.all_features({model.restorer.word(t) for t in tokens}) == set(every)
    for share in (0.0, 0.02, 1.0):
        model.weights = {f: rng.choice([-1.0, 0.0, 1.5, 2.5]) for f in every if rng.random() < share}
        model.start()
        plain = {t: max((model.weights.get(f, 0.0) for f in T.features(model.restorer.word(t))), default=0.0) for t in tokens}
        assert model.weighed(tokens) == {t: w for t, w in plain.items() if w}
    assert model.weighed(set()) == {}


def test_all_labelled_rows_count(spark):
    """Labelled rows beyond the first 20 000 (by a hash of their ids) teach the characters, the features and the curve as well."""
    ids = spark.range(30_000).where("pmod(crc32(cast(cast(id as string) as binary)), 4) != 2").orderBy(F.xxhash64("id"), "id")
    ids = [r.id for r in ids.collect()]
    assert len(ids) > 21_000
    late = set(ids[-40:])
    rows = [(i, "good quvokkest" if i in late else "good table") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in late)) for i in ids], "doc_id long, toxic int")
    model = T.train(docs, labels)
    assert model.characters.three["  q"] == 40 and model.characters.three["  g"] == len(ids)
    n = len(ids) - 40
    assert model.weights["=quvokkest"] == pytest.approx(math.log(40.5 / 41) - math.log(0.5 / (n + 1)))
    got = {r.doc_id: r.predicted for r in T.scores(docs, labels).collect()}
    assert {i for i, p in got.items() if p} == late


def test_curve_against_newton_steps_on_all_rows(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < (0.9 if a else 0.1)), a, b) for a, b in ((rng.choice([0.0, 1.5, 3.25]), rng.choice([0.0, 2.5])) for _ in range(500))]
    x = np.array([(a, b, 1.0) for _, a, b in rows])
    y, beta = np.array([t for t, _, _ in rows], float), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - p) - 0.1 * beta)
    df = spark.createDataFrame(rows, "toxic int, a double, b double")
    assert T.curve(df) == pytest.approx(tuple(beta), abs=1e-6)
    assert T.curve(df.repartition(7)) == T.curve(df.repartition(2))
    assert T.curve(df.where("toxic > 1")) == (0.0, 0.0, 0.0)


def test_counts_by_batch_and_marks(spark):
    texts = ["zurgling zurgl1ng, good", "good table", None, "", "g o o d w1ndow good (good)", "vokkest table"] * 3
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    characters = T.Characters({"  z": 5, "  g": 9, "goo": 7, "ood": 7, "od ": 7})
    restorer, want = T.Restorer(characters), Counter()
    for tokens in restorer.tokens([t or "" for t in texts]):
        want.update(T.all_features({restorer.word(t) for t in tokens}))
    every = T._counted(rows, characters)
    assert {r.f: r.n for r in every.collect()} == want
    some = {f: n for f, n in want.items() if n > 3}
    marks = T.marks_of(every.where("n > 3"))
    assert {r.f: r.n for r in T._counted(rows, characters, marks).collect()} == some  # no marks are shared here


def test_beginnings_of_marked_features_are_not_counted(spark):
    rows = spark.createDataFrame([("good vokkest vokkel vok",), ("vokkest, vokkes7",), ("vokk",)] * 3, "text string")
    characters = T.Characters({"  v": 5, "vok": 5, "okk": 5, "kke": 5, "kes": 5, "est": 5, "st ": 5})
    marks = T.marks_of(spark.createDataFrame([("=vokkest",), ("vokk",)], "f string"))
    got = {r.f: r.n for r in T._counted(rows, characters, marks).collect()}
    assert got == {"=vokkest": 6, "vokk": 9}


def test_weights_are_those_of_plain_counts(spark):
    """With fewer sure features than ``SUREST`` the likely ones count as well, with more of them they do not."""
    rng = random.Random(6)
    for bad in (["vokkest", "zurgling"], [f"{a}{b}xqzw" for a in "bcdfghkl" for b in "aeiou"]):
        texts = [(" ".join([*rng.choices(["good", "table", "line", "maybe"], k=6), *([rng.choice(bad), rng.choice(["maybe", "odd"])] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(2000)]
        rows = spark.createDataFrame(texts, "text string, toxic int")
        characters = T.Characters({"  g": 9, "goo": 7})
        restorer, counts, sizes = T.Restorer(characters), (Counter(), Counter()), Counter(t for _, t in texts)
        for (_, toxic), tokens in zip(texts, restorer.tokens([t for t, _ in texts]), strict=True):
            counts[toxic].update(T.all_features({restorer.word(t) for t in tokens}))
        share, every = sizes[1] / len(texts), []
        for f, b in counts[1].items():
            a = counts[0][f]
            part = lambda k, p, n=a + b: k * math.log(k / (n * p)) if k else 0.0
            sure, weight = 2 * (part(b, share) + part(a, 1 - share)), math.log((b + 0.5) / (sizes[1] + 1)) - math.log((a + 0.5) / (sizes[0] + 1))
            if b >= 2 and sure >= T.LIKELY and weight > 1:
                every.append((-sure, f, b, weight))
        want = {f: w for k, (sure, f, b, w) in enumerate(sorted(every)) if k < T.SUREST or -sure >= T.SURE and b >= 3}
        got = T._weights(rows, characters)
        assert got.keys() == want.keys() and all(got[f] == pytest.approx(w) for f, w in want.items())
