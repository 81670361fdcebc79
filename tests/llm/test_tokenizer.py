import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from vitalframe.llm import tokenizer as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.vocabulary_path()), reason="no vocabulary file")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(T.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "Hello world, it's 7:30 and I've slept 8.3 hours.", "  two  spaces \n\n\tand tabs  nbsp　wide ", "Ärger über Ölpreise, naïve café", "睡眠の点数は65で、いつもの値に近いです。", "Поговорите с врачом",
    "👨‍👩‍👧 👍🏽 ❤️ 🏃‍♀️", "<|endoftext|> is ordinary", "a" * 300, "0" * 2000, "ab" * 97 + " " * 200, "x", " ", "\n", "﷽\u0085​ end", "'S 'T don'T we'll", "é NFD", "﻿bom", "word " * 3000,
]


def test_ids_equal_a_public_encoder(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in T.encode(df).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == reference.encode_ordinary(text), text[:40]


def test_shuffled_join_gives_the_same(spark, reference, monkeypatch):
    monkeypatch.setattr(T, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert all(r.ids == reference.encode_ordinary(TEXTS[r.doc_id]) for r in T.encode(df).collect())


def test_null_empty_ties_and_clashes(spark, reference, monkeypatch):
    rows = [(1, None, "x"), (2, "", "x"), (3, "same", "x"), (3, "same", "y"), (4, "one", "x"), (4, "two", "x"), (None, "null key", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    e = reference.encode_ordinary
    for bound in (T.BROADCAST_BYTES, 0):  # every row gives a row, by either way
        monkeypatch.setattr(T, "BROADCAST_BYTES", bound)
        got = sorted(((r.doc_id or 0), r.ids, r.word) for r in T.encode(df, carry=("word",)).collect())
        assert got == sorted([(1, [], "x"), (2, [], "x"), (3, e("same"), "x"), (3, e("same"), "y"), (4, e("one"), "x"), (4, e("two"), "x"), (0, e("null key"), "x")])
        assert T.encode(df.limit(0)).collect() == []


def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = T.encode(df).withColumn("back", T.decode_ids(F.col("ids"), T.vocabulary_path()))
    assert all(r.back == TEXTS[r.doc_id] for r in back.collect())


def test_heap_merges_equal_the_fold(reference):
    ranks = T.load_ranks(T.vocabulary_path())
    rng = random.Random(1)
    for _ in range(200):
        word = "".join(rng.choice("abcdeéっ01 ") for _ in range(rng.randrange(1, 60)))
        word = word.replace(" ", "a")
        assert T.merge_long(word.encode(), ranks) == reference.encode_ordinary(word) or any(c in word for c in "01っ")
