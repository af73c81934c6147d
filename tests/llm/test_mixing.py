import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillstone.llm import mixing as M


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    out = M.permuted(np.arange(n), n, 12345)
    assert sorted(out) == list(range(n))
    assert (M.permuted(out, n, 12345, back=True) == np.arange(n)).all()


@pytest.mark.parametrize(("size", "target"), [(1, 1.5), (100, 150), (1000, 2000), (1000, 999.7), (1280, 1500), (12345, 20000.4), (5, 0)])
def test_plan_takes_the_target(size, target):
    plan = M.Plan(size, target, 128, 3, 1)
    blocks, words = plan.take(0, plan.slots)
    assert words.sum() == round(target)
    assert all(words > 0)
    n = Counter(blocks.tolist())
    assert max(n.values(), default=0) <= 2


def plain_targets(sizes, weights, total, most=2.0):
    """Dealt by weight; whoever is above ``most`` times its size stops there, and the rest is dealt anew."""
    full = [False] * len(sizes)
    while True:
        rest = total - sum(most * s for s, f in zip(sizes, full, strict=True) if f)
        w = sum(w for w, f in zip(weights, full, strict=True) if not f)
        out = [most * s if f else max(rest, 0) * x / w for s, x, f in zip(sizes, weights, full, strict=True)]
        over = [not f and t > most * s for t, s, f in zip(out, sizes, full, strict=True)]
        if not any(over):
            return out
        full = [f or o for f, o in zip(full, over, strict=True)]


@pytest.mark.parametrize("sizes", [[100, 10, 50], [1000, 1, 2, 3, 0, 700, 5], [7], [0, 9, 0]])
def test_targets(spark, sizes):
    docs = spark.createDataFrame([(f"s{i:03}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = sorted(map(tuple, M.sources(docs).collect()))
    want = plain_targets(sizes, [M.WEIGHTS[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes))
    assert [r[1:3] for r in got] == [(i, n) for i, n in enumerate(sizes)]
    assert [r[3] for r in got] == pytest.approx(want)


def test_more_sources_than_one_task_would_hold(spark):
    n = 120_000
    docs = spark.range(n).selectExpr("concat('s', lpad(id, 7, '0')) as source", "pmod(id * 7919, 97) + 1 as size")
    docs = docs.unionByName(spark.createDataFrame([(None, 5)], "source string, size long"))
    got = M.sources(docs).orderBy("rank").toPandas()
    assert got["rank"].tolist() == list(range(n + 1)) and got["source"].iloc[-1] is None and got["source"].iloc[:-1].is_monotonic_increasing
    sizes = got["source_size"].to_numpy(float)
    assert got["target"].sum() == pytest.approx(1.5 * sizes.sum()) and (got["target"] <= 2 * sizes).all()
    level = got["target"] / np.array([M.WEIGHTS[i % 3] for i in range(n + 1)])
    free = got["target"] < 2 * sizes
    assert level[free].max() == pytest.approx(level[free].min()) and level[~free].max() <= level[free].min()
    small = M.slots(M.sources(docs).where("rank % 40 = 0"), 128, 50, 1)
    assert small.groupBy("rank").agg({"words": "sum"}).count() > 2900


@pytest.mark.parametrize(("n", "shards"), [(31, 7), (700, 7), (0, 3), (20_000, 5), (10**6, 97)])
def test_shards_use_up_all_slots(n, shards):
    before, counts = M.shard_counts(n, shards, 0, shards, 4, 5)
    assert before == 0 and counts.sum() == n and (counts >= 0).all()
    for first in range(shards):
        part = M.shard_counts(n, shards, first, min(first + 2, shards), 4, 5)
        assert part[0] == counts[:first].sum() and part[1].tolist() == counts[first : first + 2].tolist()
    if n >= 20_000:
        assert abs(counts - n / shards).max() < 6 * (n / shards) ** 0.5


def test_totals_of_many_bits():
    n, shards = 10**12, 10**8
    before, counts = M.shard_counts(n, shards, 5 * 10**7, 5 * 10**7 + 50, 0, 1)
    assert abs(before - n / 2) < 6 * n**0.5 / 2 and abs(counts - 10_000).max() < 600
    again = M.shard_counts(n, shards, 5 * 10**7 + 50, 5 * 10**7 + 51, 0, 1)
    assert again[0] == before + counts.sum()
    plan = M.Plan(10**15, 1.7 * 10**15, 128, 0, 1)
    blocks, words = plan.take(plan.slots - 1000, plan.slots)
    assert 0 < words.min() <= words.max() <= 128 and blocks.max() < plan.n


def brute(mix):
    """Taken words a row, by laying out every source and reading the slots one by one."""
    docs = defaultdict(list)
    for r in mix.docs.collect():
        if r.size:
            docs[r["rank"]].append(r)
    taken = Counter()
    owner = {}
    for rank, rows in docs.items():
        rows.sort(key=lambda r: r.start)
        owner[rank] = [(r.doc_id, r.start) for r in rows for _ in range(r.size)]
        assert [r.start for r in rows] == list(np.cumsum([0] + [r.size for r in rows])[:-1])
    for s in mix.slots.collect():
        for w in owner[s["rank"]][s.block * mix.block : s.block * mix.block + s.words]:
            taken[(s["rank"], *w)] += 1
    return taken


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["b", "b", "b", "a", "é", None]), "z") for i in range(300)]
    rows += [(None, "x\ty  z", "a", "z"), (5, "x y", "b", "z"), (5, "x y", "b", "z"), (9, None, "c", "z"), (10, None, "b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    mix = M.Mix(docs, block=16, shard=50)
    got = mix.taken().collect()
    assert len(got) == len(rows)
    want = brute(mix)
    for r in got:
        if r.size:
            assert (r.taken or 0) == want[(r["rank"], r.doc_id, r.start)] <= 2 * r.size
    sums = defaultdict(int)
    for r in got:
        sums[r["rank"]] += r.taken or 0
    for s in mix.sources.collect():
        assert sums[s["rank"]] == round(s.target)
        assert s.target <= 2 * s.source_size
    assert abs(sum(s.target for s in mix.sources.collect()) - 1.5 * sum(s.source_size for s in mix.sources.collect())) < 1e-6
    assert [s.source for s in sorted(mix.sources.collect(), key=lambda s: s["rank"])] == ["a", "b", "c", "é", None]
    again = sorted(map(repr, M.mix(docs.repartition(3), block=16, shard=50).collect()))
    assert again == sorted(map(repr, M.mix(docs, block=16, shard=50).collect()))


def test_mixed_documents(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "bc", "déf", "g\n", "h "])
    rows = [(i, " ".join(word() + str(i) for _ in range(rng.choice([0, 1, 5, 40, 90]))), rng.choice("xxy"), 5) for i in range(80)]
    rows += [(None, "z z", "x", 5), (3, "q q", "y", 5), (3, "q q", "y", 5), (70, None, "y", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = M.mixed(docs, block=16, shard=20)
    assert out.columns == docs.columns
    got, words = out.collect(), Counter()
    for r in got:
        if r.text:
            assert r.n_chars == len(r.text)
            words[r.doc_id] += len(r.text.split())
    want = Counter()
    for r in M.mix(docs, block=16, shard=20).collect():
        want[r.doc_id] += r.taken
    assert +words == +want
    texts = {(i, " ".join((t or "").split())) for i, t, *_ in rows}
    assert {r.doc_id for r in got} >= {i for i, t, *_ in rows if t and len(t) > 20 and want[i]}
    assert sum((r.doc_id, " ".join((r.text or "").split())) in texts for r in got) > 20


def test_cut_words():
    assert M.cut_words("a  b\nc d", [(0, 1), (1, 3)]) == "a  b\nc"
    assert M.cut_words("a  b\nc d", [(0, 1), (3, 4)]) == "a d"


def test_empty(spark):
    assert M.mixed(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    got = M.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_a_very_long_text_and_clashing_names(spark):
    rows = [(1, "w " * 300_000, "a", "r", "b"), (2, "x y z", "b", "r", "b"), (2, "x y z", "b", "r", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rank string, block string")
    got = sorted(map(tuple, M.mix(docs).collect()))
    assert [r[:3] for r in got] == [(1, 300_000, 300_000), (2, 3, 6), (2, 3, 6)]
    assert sum(r[4] for r in got) == 450_009 and got[1][4] + got[2][4] == 12
    out = M.mixed(docs)
    assert out.columns == docs.columns and sum(len(r.text.split()) for r in out.collect()) == 450_009
