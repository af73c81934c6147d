"""Each stage of the pipeline against a plain version of it, on its own input."""

import base64
import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as C
from quillstone.llm import toxicity

from .test_near_texts import edited, plain_groups
from .test_suffix_dedup import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmné", k=rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(150):
        text = " ".join(word() for _ in range(rng.choice([3, 40, 120])))
        if i % 9 == 0:
            text += " grumblewort " + word()
        if i % 7 == 0:
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :]
        rows.append((i, text, "en", rng.choice("aab"), len(text)))
    rows += [(200 + i, rows[i][1], "en", "b", rows[i][4]) for i in range(10)]
    rows += [(220 + i, edited(rng, rows[i][1], k), "en", "a", rows[i][4]) for i, k in zip(range(10, 40), 6 * [1, 2, 3, 4, 6])]
    rows += [(300, None, None, None, None), (301, "", "de", "a", 0)]
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    labels = [(i, 1, int("grumblewort" in t)) for i, t, *_ in rows if t and i < 150]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    docs, out = spark.read.parquet(f"{where}/documents.parquet"), []
    for name, stage in C.STAGES:
        path = f"{where}/{name}"
        stage(spark, docs, where).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return where, out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for _, (before, after) in zip(C.STAGES[:-1], stages[1]):
        assert after.dtypes == before.dtypes


def test_toxic_documents_go(stages):
    before, after = map(rows_of, stages[1][0])
    assert set(after) == {i for i, r in before.items() if "grumblewort" not in (r.text or "")}
    assert all(after[i] == before[i] for i in after)


def test_one_of_each_group_stays(stages):
    before, after = map(rows_of, stages[1][1])
    ids = sorted(before)
    group = plain_groups([before[i].text for i in ids])
    assert set(after) == {ids[k] for k in group} and all(after[i] == before[i] for i in after)
    assert not {i for i in after if 200 <= i < 210 and i - 200 in before}


def test_passages_go(stages):
    before, after = map(rows_of, stages[1][2])
    assert set(after) == set(before)
    ids = sorted(before)
    plain = brute([(before[i].text or "").encode() for i in ids], C.PASSAGE)
    assert any(w[1] for w in plain)
    for i, (size, gone, *_) in zip(ids, plain, strict=True):
        if gone:
            assert size - gone - 6 <= len(after[i].text.encode()) <= size - gone and after[i].n_chars == len(after[i].text)
        else:
            assert after[i] == before[i]


def test_mix_and_tokens(stages):
    before, after = stages[1][3]
    words = lambda df: Counter({s: 0 for s in "ab"}) + Counter(x for r in df.collect() for x in [r.source] * len((r.text or "").split()))
    a, b = words(before), words(after)
    assert sum(b.values()) == pytest.approx(1.5 * sum(a.values()), abs=3)
    assert all(b[s] <= 2 * a[s] for s in b)
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(x): int(n) for x, n in map(bytes.split, file)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = stages[1][4][1].collect()
    assert Counter((r.doc_id, r.text) for r in tokens) == Counter((r.doc_id, r.text or "") for r in after.collect())
    assert all(r.ids == plain.encode_ordinary(r.text) for r in tokens)


def test_run_gives_the_last_stage(spark, stages):
    got = Counter((r.doc_id, tuple(r.ids)) for r in C.run(spark, stages[0]).collect())
    assert got == Counter((r.doc_id, tuple(r.ids)) for r in stages[1][4][1].collect())
    assert toxicity.THRESHOLD == 0.3


def test_stages_of_an_empty_table(spark, stages, tmp_path):
    docs = spark.read.parquet(f"{stages[0]}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, stages[0])
        assert docs.count() == 0
