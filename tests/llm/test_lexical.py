"""Ranked search against scores computed one by one."""

import math
import random
import re

import numpy as np
import pytest

from parchment.llm import lexical

TERM = re.compile(lexical.TERM)
LOW = str.maketrans(lexical.UPPER, lexical.LOWER)


def terms_of(text):
    return TERM.findall((text or "").translate(LOW))


def brute(documents, items, best=lexical.BEST):
    lists = [(d, terms_of(t)) for d, t in documents]
    lists = [(d, t) for d, t in lists if t]
    n, total = len(lists), sum(len(t) for _, t in lists)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    df = {}
    for _, t in lists:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = set()
    for item, words in wanted.items():
        scores = []
        for d, t in lists:
            m = 50 + 50 * len(t) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x in words if x in t)
            if score > 0:
                scores.append((-score, d is not None, d or 0))
        scores.sort()
        out |= {(item, k + 1, d if known else None, -s) for k, (s, known, d) in enumerate(scores[:best])}
    return out


def corpus(rng, n):
    common = "the of and to in a is that".split()
    rare = [f"w{i}é" for i in range(60)] + ["Ünder", "x9", "ÄÖ"]
    text = lambda: " ".join(rng.choice(common if rng.random() < 0.7 else rare).replace("the", rng.choice(["the", "THE"])) for _ in range(rng.randint(0, 40)))
    return [(i, text()) for i in range(n)]


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 64)
    monkeypatch.setattr(lexical, "WINDOW", 8)
    monkeypatch.setattr(lexical, "SHORT_POSTINGS", 12)
    monkeypatch.setattr(lexical, "SLICE", 50)


def got(spark, documents, items, **more):
    docs = spark.createDataFrame([(d, t, "x", 1.0) for d, t in documents], "doc_id long, text string, rank string, score double").repartition(3)
    queries = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    rows = [tuple(r) for r in lexical.search(docs, queries, **more).collect()]
    assert len(rows) == len(set(rows)) or any(documents.count(d) > 1 for d in documents)
    return set(rows)


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    documents = [*corpus(rng, 300), (None, "the w1é w2é"), (300, None), (301, ""), (302, "-- !"), (303, "w1é " * 2000), (304, "x" * 9000 + " w3é")]
    items = [(k, t) for k, (_, t) in enumerate(corpus(rng, 12))] + [(3, "w5é W6é x9"), (None, "the of w7é"), (50, None), (51, "!!"), (52, "nowhere")]
    assert got(spark, documents, items) == brute(documents, items)
    assert got(spark, documents, items, best=7, query_terms_at_once=40) == brute(documents, items, 7)
    assert got(spark, [], items) == got(spark, documents, []) == set()


def test_blocks_windows_and_slices(spark, tiny):
    """Run in this process, as settings do not reach Spark's workers."""
    rng = random.Random(6)
    documents = corpus(rng, 200)
    words = sorted({x for _, t in documents for x in terms_of(t)})
    vocabulary = lexical.Vocabulary(words[::2])
    n, text, term, tf = vocabulary.count([t.encode() for _, t in documents])
    expected = {(i, words[::2].index(x)): terms_of(t).count(x) for i, (_, t) in enumerate(documents) for x in set(terms_of(t)) if x in words[::2]}
    assert n.tolist() == [len(terms_of(t)) for _, t in documents]
    assert dict(zip(zip(text.tolist(), term.tolist(), strict=True), tf.tolist(), strict=True)) == expected
    impacts = np.random.default_rng(1).integers(1, 9, len(term))  # many ties
    ids = np.random.default_rng(2).permutation(len(documents)) // 2  # repeated ids
    block = lexical.Block(ids, np.ones(len(ids), dtype=bool), text, term, impacts)
    for size in (1, 3, 10, len(vocabulary.number)):
        terms = np.sort(np.random.default_rng(size).permutation(len(vocabulary.number))[:size])
        best = lexical.Best(10)
        block.search(terms, best)
        scores = {}
        for d, t, i in zip(text.tolist(), term.tolist(), impacts.tolist(), strict=True):
            if t in terms:
                scores[d] = scores.get(d, 0) + i
        assert [(-s, d) for s, _, d in best.rows.T.tolist()] == sorted((-s, int(ids[d])) for d, s in scores.items())[:10]


def test_skipping_skips(monkeypatch):
    """With one rare and one frequent term, few postings of the frequent one are summed."""
    n = 1 << 15
    monkeypatch.setattr(lexical, "SHORT_POSTINGS", 2000)
    postings = np.concatenate([np.arange(n), np.arange(0, n, 40)])
    terms = np.concatenate([np.zeros(n, dtype=np.int64), np.ones(-(-n // 40), dtype=np.int64)])
    impacts = np.where(terms == 0, 1, 1000)
    block = lexical.Block(np.arange(n), np.ones(n, dtype=bool), postings, terms, impacts)
    summed = []
    monkeypatch.setattr(lexical.Best, "take", lambda self, s, k, d, take=lexical.Best.take: (summed.append(len(s)), take(self, s, k, d)))
    best = lexical.Best(50)
    block.search(np.array([0, 1]), best)
    assert best.rows[2].tolist() == list(range(0, 2000, 40)) and sum(summed[1:]) <= n // 40


def test_hash_clashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical, "slice_hashes", lambda prefix, start, end: ((end - start) % 2).astype(np.uint64))
    vocabulary = lexical.Vocabulary(["ab", "cd", "efg"])
    n, text, term, tf = vocabulary.count([b"ab cd cd efg xy xyz", b"zz"])
    assert (n.tolist(), text.tolist(), term.tolist(), tf.tolist()) == ([6, 1], [0, 0, 0], [0, 1, 2], [1, 2, 1])
