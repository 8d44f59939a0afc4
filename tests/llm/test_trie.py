"""The prefix trie against one built turn by turn."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from parchment.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, pos int"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(rows_)] for c, rows_ in own.items()}
    nodes, rebuilt = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(rebuilt[c]) + 1):
            nodes.setdefault(rebuilt[c][:d], []).append(c)
    out = []
    for node, members in nodes.items():
        inside = [x for x in nodes if x[: len(node)] == node]
        children = [x for x in inside if len(x) == len(node) + 1]
        leaves = [x for x in inside if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in inside)]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in inside if x)
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(node))))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **more):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in trie.trie(table, **more).collect()), key=repr)


def conversations(rng, n, long=0):
    texts = ["", "a", "é漢", "hello there", "x" * 300, "b"]
    rows = []
    for c in range(n):
        same = rng.random() < 0.4
        for t in range(rng.randint(0, 12)):
            rows.append((c, t, ["user", "assistant"][t % 2], texts[t % 3] if same else rng.choice(texts)))
    for c in (1001, 1006) * bool(long):  # the same long conversation twice
        rows += [(c, t, "user", f"turn {t % 7}") for t in range(long)]
    return rows


def test_trie_equals_brute_force(spark):
    rng = random.Random(3)
    rows = conversations(rng, 60, long=150)
    rows += [(-7, None, None, None), (-7, None, "user", "a"), (-7, 0, "user", "a"), (-7, 0, "user", "a"), (-7, 0, "user", None), (None, 1, "user", "lost"), (-5, 2, "", "z"), (-5, 1, "user", "é")]
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert got(spark, []) == got(spark, [(None, 0, "user", "x")]) == []
    few = [(2, 0, "user", "x")]  # no base: turnless if its own head is cut
    assert got(spark, few) == brute(few)


def test_one_conversation_over_many_ranges(spark):
    rows = [(1, t, "user", str(t % 5)) for t in range(200)] + [(6, t, "user", str(t % 5)) for t in range(200)] + [(7, 0, "user", "0")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert got(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("weak", [lambda role, text: [0, 0], lambda role, text: [1, 2]])
def test_clashing_hashes_are_found_and_mended(spark, monkeypatch, weak):
    """The first attempt has one hash for all turns."""
    from pyspark.sql import functions as F

    strong, marks = trie._hashes, []

    def hashes(role, text, mark):
        marks.append(mark)
        return strong(role, text, mark) if mark else [F.lit(v).cast("long").alias(f"e{i}") for i, v in enumerate(weak(role, text), 1)]

    monkeypatch.setattr(trie, "_hashes", hashes)
    rows = [(c, t, "user", f"{c % 2}{t}") for c in (1, 3, 6, 8) for t in range(12)]
    assert got(spark, rows) == brute(rows) and max(marks) == 1


def test_products_combine():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    base = trie.LANES[0]
    keys = np.repeat([1, 2, 3], [10, 25, 5])
    whole = trie._scan(keys, e, base, np.uint64(0))
    plain = 0
    for i in range(40):
        plain = (0 if i in (0, 10, 35) else plain) * base + int(e[i])
        assert int(whole[i]) == plain % (1 << 64)
    later = trie._scan(keys[20:], e[20:], base, whole[19])
    assert (later == whole[20:]).all()
    assert trie._power(base, np.array([0, 1, 2, 77])).tolist() == [pow(base, k, 1 << 64) for k in (0, 1, 2, 77)]
