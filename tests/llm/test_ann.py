import numpy as np
import pytest

from quillstone.llm import ann as A


def brute(vectors, every=50, top=5):
    out = {}
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    norm = np.sqrt((x * x).sum(1))
    for k, i in enumerate(ids):
        if i % every == 0:
            score = x @ x[k] / (norm * norm[k])
            order = sorted((-s, j) for s, j in zip(score, ids, strict=True) if j != i)[:top]
            out[i] = [(j, -s) for s, j in order]
    return out


def hits(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(want)
    found = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r.rank)
        assert [r["rank"] for r in rows] == list(range(1, len(want[q]) + 1))
        found += len({r.vec_id for r in rows} & {j for j, _ in want[q]})
        truth = dict(want[q])
        for r in rows:
            if r.vec_id in truth:
                assert r.score == pytest.approx(truth[r.vec_id], abs=1e-12)
    return found / sum(map(len, want.values()))


def test_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[:700] = x[0] + rng.standard_normal((700, 24)) * 0.02  # a crowd of near copies
    vectors = {i: x[i].tolist() for i in range(len(x))}
    rows = spark.createDataFrame([(i, v, 1) for i, v in vectors.items()], "vec_id long, embedding array<float>, label int")
    assert hits(A.nearest(rows).collect(), brute(vectors)) >= 0.95


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.standard_normal(4).astype(np.float32).tolist() for i in range(130)}
    for i in range(40, 60):
        vectors[i] = vectors[40]  # copies: ties go to smaller ids
    odd = [(None, [1.0] * 4), (200, None), (250, [0.0] * 4), (300, [1.0, None, 0.0, 0.0]), (350, [float("nan")] * 4), (400, [float("inf"), 0.0, 0.0, 0.0]), (450, []), (500, [1.0])]
    rows = [*vectors.items(), *odd, (7, vectors[7]), (50, vectors[50])]
    got = A.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = brute(vectors)
    assert hits(got, want) == 1
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 50] == [40, 41, 42, 43, 44]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<float>")
    assert len(A.nearest(rows).collect()) == max(0, n - 1)


def test_clashing_names_and_what_is_left(spark):
    """Columns named like the result's are ignored; the graph's tables are gone once the result is there."""
    import glob

    rng = np.random.default_rng(9)
    vectors = {i: rng.standard_normal(6).astype(np.float32).tolist() for i in range(120)}
    rows = spark.createDataFrame([(i, v, "r", 0.5, 1, 2) for i, v in vectors.items()], "vec_id long, embedding array<float>, rank string, score double, query_id int, id int")
    where = spark.conf.get("spark.checkpoint.dir") + "/quillstone/ann-*"
    before = set(glob.glob(where))
    got = A.nearest(rows).collect()
    assert hits(got, brute(vectors)) == 1
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(where)) - before}
    assert left == {"ann-nodes", "ann-members", "ann-met"}
