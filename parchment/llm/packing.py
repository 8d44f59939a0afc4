"""Packing: cutting-stock column generation over the histogram of piece lengths.

A document's tokens (closed by an end token) are cut into full sequences and a rest. Only the histogram of the
rests' lengths, at most ``capacity`` numbers, reaches the driver. A linear program over cutting patterns is solved
there by column generation: a knapsack dynamic program prices new patterns against the duals. Patterns are rounded
down, and what is left is packed by first fit decreasing. Pieces are ranked within their length by a count per salt,
with a salt for each ``RANKED`` pieces, so no task holds all pieces of a length; ranks are mapped to sequences by a
small table of ranges.

A null text is an empty text: its one token is the end token. Repeated ids are documents of their own.
Pieces of equal length are ranked by doc_id and place, so ties fall the same way in each run over the same rows; which
of several repeated rows comes first does not matter. A very long text is cut like any other. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stage

CAPACITY = 2048
END = 1
#: Pieces of one length that one task ranks.
RANKED = 50_000
#: Column generation ends when Farley's bound shows that at most this share of sequences could still be saved, or no
#: whole one.
GAP = 0.0005
PIECES = "key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_ids(vocabulary: str = "byte_bpe_50k"):
    """A function from a text to its ids as numpy array.

    The vocabulary's rank file and its tokenizer file give the same ids for ordinary text (tests compare them); the
    former's library is several times faster. A text that holds the special token goes through the latter.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    special = tuple(t.content for t in exact.get_added_tokens_decoder().values())

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.uint32)

    return ids


def cut(documents: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Pieces of at most ``capacity`` tokens, with checksums of their ids; ``key`` tells equal doc_ids apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer_ids(vocabulary)
        for batch in batches:
            rows = []
            for key, doc, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
                ids = np.append(ids_of(text or ""), np.uint32(end)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    rows.append((key, doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "doc_id", "start", "length", "ids_crc32", "doc_tokens"), r, strict=True)) for r in rows], schema=SCHEMA)

    rows = documents.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, PIECES)


SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


# ---- the linear program, on the driver ------------------------------------------------------


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The dearest multiset of lengths (``prices[i]`` is that of length ``i``; 0 is unused) that fits the capacity."""
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    lengths = np.flatnonzero(prices > 1e-12)
    values = prices[lengths]
    for c in range(1, capacity + 1):
        n = np.searchsorted(lengths, c, "right")
        best[c] = best[c - 1]
        if n:
            value = best[c - lengths[:n]] + values[:n]
            k = int(value.argmax())
            if value[k] > best[c] + 1e-12:
                best[c], taken[c] = value[k], lengths[k]
    pattern: Counter = Counter()
    c = capacity
    while c > 0:
        if taken[c]:
            pattern[int(taken[c])] += 1
            c -= int(taken[c])
        else:
            c -= 1
    return float(best[capacity]), dict(pattern)


def first_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used, filling sequence after sequence with the longest length that fits."""
    left = dict(sorted(((k, v) for k, v in counts.items() if v > 0), reverse=True))
    out = []
    while left:
        pattern: dict[int, int] = {}
        room = capacity
        for length, n in left.items():
            if length <= room:
                take = min(n, room // length)
                pattern[length] = take
                room -= take * length
        times = min(left[k] // v for k, v in pattern.items())
        out.append((pattern, times))
        for k, v in pattern.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
    return out


def solve(counts: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole counts that use each length exactly as often as ``counts`` says."""
    counts = {k: v for k, v in counts.items() if v > 0}
    if not counts:
        return []
    lengths = sorted(counts)
    row = {k: i for i, k in enumerate(lengths)}
    demand = np.array([counts[k] for k in lengths], dtype=float)
    # Fractional first fit gives the basis to begin with. Each of its patterns uses up at least one length, and none
    # that is used up before, so the patterns (with one of a single length for each length used up along with
    # another) form a triangular matrix.
    basis: list[dict[int, int]] = []
    order: list[int] = []
    left = {k: float(v) for k, v in sorted(counts.items(), reverse=True)}
    while left:
        pattern, room = {}, capacity
        for k in left:
            if k <= room:
                pattern[k] = room // k
                room -= pattern[k] * k
        times = min(left[k] / v for k, v in pattern.items())
        for k, v in pattern.items():
            left[k] -= v * times
        done = sorted((k for k in pattern if left[k] <= 1e-9 * counts[k]), key=lambda k: left[k] / pattern[k])
        basis += [pattern, *({k: capacity // k} for k in done[1:])]
        order += done
        for k in done:
            del left[k]
    # Forward substitution; row i belongs to the length that pattern i uses up.
    place = {k: i for i, k in enumerate(order)}
    inverse = np.eye(len(order))
    for j, pattern in enumerate(basis):
        inverse[j] /= pattern[order[j]]
        for k, v in pattern.items():
            if place[k] > j:
                inverse[place[k]] -= v * inverse[j]
    inverse = inverse[:, [place[k] for k in lengths]]
    use = np.maximum((inverse * demand).sum(1), 0)
    duals = inverse.sum(0)
    least = float((demand * lengths).sum()) / capacity

    def enter(pattern: dict[int, int]) -> bool:
        """Revised simplex: the pattern replaces the one whose use first falls to 0."""
        nonlocal use, duals
        at = [row[k] for k in pattern]
        step = (inverse[:, at] * np.array(list(pattern.values()), dtype=float)).sum(1)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            return False
        pivot = inverse[out] / step[out]
        use = np.maximum(use - step * ratio[out], 0)
        use[out] = ratio[out]
        duals = duals + (1 - step.sum()) * pivot
        inverse[...] -= np.outer(step, pivot)
        inverse[out] = pivot
        basis[out] = pattern
        return True

    prices = np.zeros(capacity + 1)
    bound = least  # no solution is below the volume
    while use.sum() > bound * (1 + gap) and np.ceil(use.sum() - 1e-6) > np.ceil(bound - 1e-6):
        prices[lengths] = np.maximum(duals, 0)
        value, pattern = knapsack(prices, capacity)
        bound = max(bound, float(prices[lengths] @ demand) / max(value, 1.0))  # Farley
        if value <= 1 + 1e-9 or not enter(pattern):
            break
    plan: list[tuple[dict[int, int], int]] = []
    left = dict(counts)
    for k in np.argsort(-use):
        times = int(use[k] + 1e-9)
        times = min([times, *(left[length] // n for length, n in basis[k].items())])
        if times > 0:
            plan.append((basis[k], times))
            for length, n in basis[k].items():
                left[length] -= n * times
    return plan + first_fit(left, capacity)


def ranges(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``length, first rank, end rank, copies in a sequence, first sequence, offset``: where a length's ranks go."""
    used: Counter = Counter()
    out, sequence = [], 0
    for pattern, times in plan:
        at = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            out.append((length, used[length], used[length] + n * times, n, sequence, at))
            used[length] += n * times
            at += n * length
        sequence += times
    return out


# ---- assignment -----------------------------------------------------------------------------


def pack(documents: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = documents.sparkSession
    pieces = stage(cut(documents, capacity, end, vocabulary), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    plan = solve(counts, capacity)
    salts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in counts.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("key", "start"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stage(salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")), "first-ranks")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "key", "start")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(small(firsts), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first"))
    # At most a few ranges for each length and pattern.
    places = spark.createDataFrame(ranges(plan), "length long, lo long, hi long, copies long, first_sequence long, first_offset long")
    by_length = places.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "copies", "first_sequence", "first_offset"))).alias("places"))
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("p", F.filter("places", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"]))[0])
    within = F.col("rank") - F.col("p.lo")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("p.first_sequence") + F.floor(within / F.col("p.copies"))).cast("long").alias("sequence_id"),
        (F.col("p.first_offset") + (within % F.col("p.copies")) * F.col("length")).cast("long").alias("offset"),
    )
