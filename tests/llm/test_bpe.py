import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_same_ids_as_the_library(texts):
    own = B.encoder(PATH, P.PATTERN)
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    lib = test_same_ids_as_the_library.__dict__.setdefault("lib", tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    got = own.encode(texts)
    assert [x.tolist() for x in got] == [lib.encode_ordinary(t) for t in texts]
    assert [own.vocabulary.decode(x) for x in got] == [t.encode() for t in texts]


def test_long_pieces(plain):
    rng = random.Random(2)
    texts = ["a" * 5000, "ab" * 3000, "".join(rng.choices("abcdest", k=6000)), "-" * 4097, " " * 3000 + "x", "".join(rng.choices("thein", k=513))]
    got = B.encoder(PATH, P.PATTERN).encode(texts)
    assert [x.tolist() for x in got] == [plain.encode_ordinary(t) for t in texts]


def test_rows(spark, plain):
    rows = [(1, "Hello  world's 123\n\n x"), (None, None), (2, ""), (2, ""), (3, "ñé漢字 " * 400)]
    docs = spark.createDataFrame([(*r, "q", 5) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    key = lambda r: (r[0] is None, r)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert sorted(map(tuple, B.digests(docs).collect()), key=key) == sorted(want, key=key)
    full = B.encode(docs, decoded_col="decoded")
    assert sorted(full.columns) == ["decoded", "doc_id", "ids", "n_tokens", "text"]
    for r in B.decode(full, out="again").collect():
        assert r.ids == plain.encode_ordinary(r.text or "") and bytes(r.decoded) == bytes(r.again) == (r.text or "").encode()
    assert B.digests(docs.where("doc_id = 99")).count() == 0
