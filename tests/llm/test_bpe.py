"""Encoding and decoding against the tokenizers library, on every path."""

import hashlib
import random

import numpy as np
import pytest
from slotstream.llm import bpe
from tokenizers import Tokenizer

ALPHABET = ["a", "B", "é", "中", "1", "²", "٣", " ", "  ", "\n", "\t", "\x1c", "\x85", "'", "'s", "'ll", "'re", "'d", '"', "!", "<|endoftext|>", "<|end", "😀", "́", "_", "'S", "\r\n"]


def expected(texts):
    tokenizer = Tokenizer.from_file(bpe.default_path())
    for t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        yield len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def sample():
    r = random.Random(7)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 25))) for _ in range(300)] + ["don't we'll 'tis  it's ' s 'll", "", None, " ", "\n\n x", "word " * 5000, "same", "same"]


@pytest.mark.parametrize("broadcast_words", [10**9, 0])
def test_digests_match_the_library(spark, broadcast_words):
    texts = sample()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, output="digests", broadcast_words=broadcast_words).collect()}
    assert got == dict(enumerate(expected(texts)))


def test_round_trip_and_empty_table(spark):
    texts = sample()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(docs.limit(0), output="digests").count() == 0


def test_copies_beyond_a_bucket_and_special_tokens(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BUCKET_BYTES", 2000)
    texts = ["hot text of one group " * 3] * 300 + [f"text number {i}" for i in range(50)]
    docs = spark.createDataFrame([(7 if "hot" in t else i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, bucket string")
    name, dealt = bpe._dealt(docs, "text")
    sizes = [r["count"] for r in dealt.where("doc_id = 7").groupBy(name).count().collect()]
    assert name == "bucket_" and max(sizes) < 100 and sum(sizes) == 300
    got = bpe.encode(docs, output="digests", broadcast_words=0)
    assert got.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    want = dict(zip(texts, expected(texts), strict=True))
    rows = got.collect()
    assert len(rows) == 350 and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.text] for r in rows)
    special = {"<a>": 1, "<a><b>": 2}
    assert list(bpe._segments("x<a><b>y<a>", special)) == [("x", -1), ("<a><b>", 2), ("y", -1), ("<a>", 1), ("", -1)]
    assert sum(k == 1 for _, k in bpe._segments("<a>" * 200_000, special)) == 200_000
