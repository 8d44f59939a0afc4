"""Byte-level BPE against the library that defines the ids, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from parchment.llm import bytepair


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def vocabulary(request):
    with open(public_tokenizers.path(request.param), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return request.param, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(seed, n):
    rng = random.Random(seed)
    pool = "aaaabe  \n\t'sdt0123..,;<|>éßñ漢字\U0001f600\U0001f468‍́ \x00\x1c\x85"
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(n)]


EDGES = ["", " ", "<|endoftext|> x", "a" * 5000, "é漢" * 700, " \n \n", "'s 'S can't", "\U0001f600" * 9]


def test_same_ids_as_the_reference_library_and_round_trip(vocabulary):
    name, reference = vocabulary
    codec = bytepair.Codec(bytepair.tokenizer_json(public_tokenizers.path(name)), public_tokenizers.PATTERN, kept=500)
    for text in [*EDGES, *fuzz(1, 800)]:
        ids = codec.encode(text)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert codec.decode(ids.tolist()) == text.encode()
        starts, ends = codec.offsets(text, ids)
        for i, start, end in zip(ids.tolist(), starts, ends, strict=True):
            assert codec.bytes_of[i] in text[start:end].encode()
        assert not len(ids) or (starts[0] == 0 and ends[-1] == len(text) and (starts[1:] <= ends[:-1]).all() and (starts[1:] >= ends[:-1] - 1).all())
    with pytest.raises(ValueError):
        codec.decode([len(codec.bytes_of)])


def test_long_texts_are_encoded_as_a_stream(monkeypatch):
    codec = bytepair.Codec(bytepair.tokenizer_json(public_tokenizers.path(bytepair.VOCABULARY)), public_tokenizers.PATTERN)
    text = " ".join(fuzz(2, 400))
    whole = codec.encode(text)
    monkeypatch.setattr(bytepair, "AT_ONCE", 7)
    assert (codec.encode(text) == whole).all()


def test_split_characters():
    codec = bytepair.Codec(bytepair.tokenizer_json(public_tokenizers.path(bytepair.VOCABULARY)), public_tokenizers.PATTERN)
    ids = codec.encode("\U00013000")  # no token holds it whole
    starts, ends = codec.offsets("\U00013000", ids)
    assert len(ids) > 1 and set(starts) == {0} and set(ends) == {1}
    assert codec.decode(ids.tolist()[:1]).decode(errors="replace") == "�" and codec.decode(ids.tolist()).decode() == "\U00013000"


def test_tables(spark, vocabulary):
    name, reference = vocabulary
    texts = [None, *EDGES, *fuzz(3, 30), "x y", "x y"]
    rows = spark.createDataFrame([(i if i else None, t, "old", [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids string, starts array<int>")
    out = bytepair.decode(bytepair.encode(rows, vocabulary=name, offsets=True), vocabulary=name)
    assert sorted(out.columns) == sorted(["doc_id", "text", "ids", "starts", "ends", "decoded", "decoded_text"])
    got = out.collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == reference.encode_ordinary(r.text or "") and r.decoded_text == (r.text or "") and len(r.starts) == len(r.ends) == len(r.ids)
    for r in bytepair.digest(out).join(rows.select("doc_id", "text"), "doc_id").collect():
        ids = np.array(reference.encode_ordinary(r.text), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert bytepair.decode(rows.select("doc_id", F.lit(None).cast("array<int>").alias("ids")).limit(2)).where("decoded_text = ''").count() == 2
    assert bytepair.digest(bytepair.decode(bytepair.encode(rows.limit(0)))).count() == 0
