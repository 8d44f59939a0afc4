"""Removal of repeated strings: linear grouping in step, chunks, cut and split blocks, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from parchment.llm import suffix

from .test_operators import EDGES, brute_removal, documents, words


def test_many_strings_in_step():
    rng = random.Random(51)
    for _ in range(200):
        sets = [[rng.randint(1, rng.choice([1, 2, 4, 9])) for _ in range(rng.randint(0, 60))] for _ in range(rng.randint(1, 8))]
        starts = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        expected = [a + i for x, a in zip(sets, starts.tolist(), strict=False) for i in sorted(range(len(x)), key=lambda i, x=x: x[i:])]
        assert suffix.suffix_arrays(np.array([c for x in sets for c in x], dtype=np.int64), starts).tolist() == expected


def test_least_owners():
    rng = random.Random(52)
    base = bytes(rng.choice(b"abc") for _ in range(200))
    parts = [[base[:80], base[20:90], b"x" + base[5:70]], [base[30:120]], [b"a" * 90, b"a" * 60 + b"b"]]
    owners = [[5, 3, 9], [1], [2, 7]]
    flat = [(k, p, n) for k, (own, names) in enumerate(zip(parts, owners, strict=True)) for p, n in zip(own, names, strict=True)]
    got = suffix.least_owners(np.frombuffer(b"".join(p for _, p, _ in flat), np.uint8), np.array([len(p) for _, p, _ in flat]), np.array([k for k, _, _ in flat]), np.array([n for _, _, n in flat]))
    windows = [(k, p[i : i + suffix.LENGTH]) for k, p, _ in flat for i in range(len(p) - suffix.LENGTH + 1)]
    assert got.tolist() == [min(n for j, q, n in flat if j == k and w in q) for k, w in windows]


def test_only_repeated_windows_are_sorted(monkeypatch):
    """Long parts that share little: the suffix arrays see what is shared, and the owners are those of all windows."""
    rng = random.Random(56)
    sorted_, symbols = suffix.suffix_arrays, []
    monkeypatch.setattr(suffix, "suffix_arrays", lambda data, starts: (symbols.append(len(data)), sorted_(data, starts))[1])
    for shared in (0, 49, 50, 70):
        letters = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
        phrase = letters(shared)
        flat = [(k, letters(rng.randint(0, 300)) + phrase + letters(rng.randint(50, 300)), rng.randint(0, 9)) for k in range(3) for _ in range(4)] + [(3, b"short", 1), (3, letters(60), 2)]
        symbols.clear()
        got = suffix.least_owners(np.frombuffer(b"".join(p for _, p, _ in flat), np.uint8), *(np.array(x) for x in ([len(p) for _, p, _ in flat], [k for k, _, _ in flat], [n for _, _, n in flat])))
        windows = [(k, p[i : i + suffix.LENGTH]) for k, p, _ in flat for i in range(len(p) - suffix.LENGTH + 1)]
        assert got.tolist() == [min(n for j, q, n in flat if j == k and w in q) for k, w in windows]
        assert sum(symbols) <= (12 * 80 if shared else 0)  # letters beside the phrase may agree by chance


def removed(docs):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs).collect()}


def test_common_phrase_is_split(spark, monkeypatch):
    """A phrase shorter than a window stands in every document, in ever new surroundings; copies and periods besides."""
    for name, value in (("CHUNK", 2000), ("RANGE", 4000), ("HOT", 3), ("VARIANTS", 2), ("CUT", 7), ("BATCH", 500), ("GATHER", 40)):
        monkeypatch.setattr(suffix, name, value)
    rng = random.Random(53)
    phrase, longer = "this common phrase of forty bytes or so", words(rng, 25)
    texts = [f"{words(rng, 6)} {phrase} {words(rng, 6)}" for _ in range(60)]
    texts += [f"{words(rng, 3)} {longer[a:]} {phrase}" for a in (0, 3, 3, 9)] + ["ab" * 300, "x" * 400, "ab" * 90 + "x" * 120, *EDGES] + texts[:7] + ["é" + longer, longer + "é"]
    assert removed(documents(spark, texts)) == brute_removal(texts)


def test_long_text_in_pieces(spark):
    rng = random.Random(54)
    block = "".join(rng.choice("abcdefgh ") for _ in range(300))
    texts = [block, "".join(rng.choice("ijklmnop ") for _ in range(suffix.PIECE - 150)) + block + "tail" * 30, "z" * (suffix.PIECE + 100)]
    got = removed(documents(spark, texts))
    assert got[1][1:3] == (300, 1) and got[0][1] == got[2][1] == 0 and got[1][0] == len(texts[1])


def test_rows_without_id_and_repeated_rows(spark):
    rng = random.Random(55)
    text = words(rng, 40)
    docs = spark.createDataFrame([(None, text, 1), (3, text, 2), (3, text, 3), (7, text, 4), (7, "other " + text, 5)], "doc_id long, text string, chunk long")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix.remove_repeats(docs).collect())
    n = len(text)
    assert got == [(False, 3, n, 0), (False, 3, n, 0), (False, 7, n, n), (False, 7, n + 6, n), (True, 0, n, 0)]
    assert suffix.remove_repeats(docs.withColumn("text", F.lit(None).cast("string"))).where("n_removed > 0").count() == 0


def test_fewer_buckets_than_chunks(spark, monkeypatch):
    """Several chunks in a bucket, in the same result; Spark's own limit is set below what two chunks a bucket would need."""
    rng = random.Random(57)
    texts = [*EDGES, *(words(rng, rng.randint(5, 60)) for _ in range(60))]
    texts += [texts[-1], texts[-2] + " " + texts[-3], None]
    for name, value in (("CHUNK", 500), ("RANGE", 4000), ("MAX_BUCKETS", 3)):
        monkeypatch.setattr(suffix, name, value)
    before = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "4")
    try:
        assert removed(documents(spark, texts)) == brute_removal(texts)
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", before)
