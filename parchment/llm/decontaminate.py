"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and bytes above 127, lower-cased. A mask of ones and zeros is slid over the
tokens; positions under a zero are ignored, so a match survives substituted tokens there. Hashes of all benchmark
positions under all masks form a sorted table; texts are hashed likewise and joined to it. Each hit fixes a
diagonal (offset between text and item); the overlap along the diagonal is then counted token by token over the
whole item, and is reported where enough of the item's tokens agree.

A benchmark of at most ``SMALL_TOKENS`` tokens (checked) is broadcast as such a table, and texts are read once. A larger
one is joined: both sides become rows of hash and place, texts only where a bitmap of fixed size says that a hash may be
an item's; hits become diagonals, texts give the tokens along them, and these meet the item's tokens for the verdict.
Copies of a text are compared once there and get its result each; item positions under one hash are dealt out ``HOT`` at
a time, and the diagonals of one text ``DIAGONALS`` at a time, so neither is held by one task.

Null and empty texts or items hold no tokens and match nothing. Items of fewer than ``MIN_TOKENS`` tokens are not
reported, not even verbatim: short phrases would take clean texts with them. Repeated rows, and different texts under one
key, are reported each; of several overlaps of a text and an item, the one with most equal tokens (then the longest
stretch) counts. A row without key is compared and reported without key. A long or periodic text is compared in
slices of ``PAIRS`` hits. Empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flatten, mix, powers, prefix_hashes, slice_hashes, small, stage, text_chunks, word_slices

#: Every overlap that SHARE or STRETCH accepts holds one of these: with one token of five substituted, four equal tokens
#: stand in a row but at 10, 11 and 15 tokens, where runs of at most three meet around a single substituted one.
MASKS = ("1111", "1110111", "111011", "110111")
MIN_TOKENS = 8
#: An overlap counts with this share of the item's tokens, or with a stretch of so many tokens of that identity.
SHARE = 0.8
STRETCH = 13
SMALL_TOKENS = 2_000_000
#: Hits that are held at once, and bits of the bitmap of an item table that is not small.
PAIRS, BITS = 1_000_000, 1 << 27
#: Item positions under one hash that one task joins, and diagonals of a text that are compared at once.
HOT, DIAGONALS = 1000, 10_000

_SEPARATORS = np.ones(256, dtype=bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, one after another, and where each text begins (one more for the end)."""
    data, starts = flatten([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    begin, end, first = word_slices(data, starts, _SEPARATORS)
    return slice_hashes(prefix_hashes(data), begin, end), first


def _seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, len(mask), dtype=np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = out + tokens[i : n + i] * powers(len(mask) + 1)[i + 1]
    return mix(out)


def _item_seeds(tokens: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask, the seeds of all items that are long enough, and where in ``tokens`` they begin."""
    lengths = np.diff(first)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    out = []
    for mask in MASKS:
        seeds = _seeds(tokens, mask)
        n = len(seeds)
        whole = np.flatnonzero((owner[:n] == owner[len(mask) - 1 :][:n]) & (lengths[owner[:n]] >= MIN_TOKENS))
        out.append((seeds[whole], whole))
    return out


class _Items:
    """A small benchmark: its tokens and the sorted table of their seeds."""

    def __init__(self, ids: list[int | None], tokens: list[np.ndarray]):
        self.ids = ids
        self.first = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
        self.tokens = np.concatenate([np.zeros(0, np.uint64), *tokens])
        self.owner = np.repeat(np.arange(len(ids)), np.diff(self.first))
        self.place = np.arange(len(self.tokens)) - self.first[:-1][self.owner]
        self.tables = []
        for keys, at in _item_seeds(self.tokens, self.first):
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], at[order]))

    def hits(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of token positions, in the texts and in the items, at most PAIRS or those of one text position at a time."""
        for mask, (keys, at) in zip(MASKS, self.tables, strict=True):
            seeds = _seeds(tokens, mask)
            if not len(keys) or not len(seeds):
                continue
            low = np.searchsorted(keys, seeds)
            likely = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == seeds)
            low, n = low[likely], np.searchsorted(keys, seeds[likely], "right") - low[likely]
            for part in np.split(np.arange(len(likely)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
                if len(part):
                    k = n[part]
                    yield np.repeat(likely[part], k), at[np.repeat(low[part], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]


def _longest_stretch(equal: np.ndarray) -> int:
    """Tokens in the longest run that starts and ends with an equal token and has at least SHARE equal ones."""
    n = len(equal)
    score = np.concatenate(([0.0], np.cumsum(np.where(equal, 1 - SHARE, -SHARE))))
    lowest = np.minimum.accumulate(score)
    # For each end, the first start whose score is not above the end's.
    starts = np.searchsorted(-lowest, -(score + 1e-9))
    lengths = np.arange(n + 1) - starts
    return int(max(lengths.max(), 0))


def _accepted(equal: np.ndarray, size: int) -> tuple[int, int] | None:
    """Equal tokens and longest stretch along a diagonal, if they make an overlap with an item of ``size`` tokens."""
    n, run = int(equal.sum()), _longest_stretch(equal)
    return (n, run) if n >= SHARE * size - 1e-9 or run >= STRETCH else None


def _overlaps(texts: list[str], items: _Items) -> Iterator[tuple[int, int, int, int, int]]:
    """Text index, item index, tokens of the item, equal tokens, longest stretch."""
    tokens, first = _tokens(texts)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for left, right in items.hits(tokens):
        text = np.searchsorted(first, left, "right") - 1
        item = items.owner[right]
        base = left - items.place[right]  # where the item's first token would stand
        rows = np.unique(np.stack([text, item, base], 1), axis=0)
        sizes = np.diff(items.first)[rows[:, 1]]
        equal_tokens = np.zeros(len(rows), np.int64)
        for at in range(0, int(sizes.max()) if len(rows) else 0):
            own = np.flatnonzero((at < sizes) & (rows[:, 2] + at >= first[rows[:, 0]]) & (rows[:, 2] + at < first[rows[:, 0] + 1]))
            equal_tokens[own] += tokens[rows[own, 2] + at] == items.tokens[items.first[rows[own, 1]] + at]
        enough = np.minimum(np.ceil(SHARE * sizes - 1e-9), np.ceil(SHARE * STRETCH - 1e-9))
        for t, i, at in rows[equal_tokens >= enough].tolist():
            own = items.tokens[items.first[i] : items.first[i + 1]]
            lo, hi = max(at, first[t]), min(at + len(own), first[t + 1])
            if found := _accepted(tokens[lo:hi] == own[lo - at : hi - at], len(own)):
                best[t, i] = max(best.get((t, i), (0, 0, 0)), (*found, len(own)))
    for (t, i), (n, run, size) in best.items():
        yield t, i, size, n, run


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with a text column, about a megabyte each."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in text_chunks(texts):
            yield batch.slice(lo, hi - lo), texts[lo:hi]


def find_overlaps(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """One row per contaminated text and item: ``key, item_key, item_tokens, equal_tokens, longest_stretch``."""

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(batches):
            tokens, first = _tokens(texts)
            rows = [tokens[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("item"), part.column("id"), pa.array(rows, pa.binary())], ["item", "id", "tokens"])

    texts = documents.select(F.col(key).cast("long").alias("id"), "text").where("text is not null")
    own = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).cast("long").alias("id"), "text").where("text is not null")
    items = stage(own.mapInArrow(tokenized, "item long, id long, tokens binary").where(F.octet_length("tokens") >= 8 * MIN_TOKENS), "items")
    total = items.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    found = _broadcast_overlaps(texts, items) if total <= 8 * SMALL_TOKENS else _joined_overlaps(texts, items)
    return found.select(F.col("id").alias(key), F.col("item_id").alias(item_key), "item_tokens", "equal_tokens", "longest_stretch")


FOUND = "id long, item_id long, item_tokens long, equal_tokens long, longest_stretch long"
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _broadcast_overlaps(texts: DataFrame, items: DataFrame) -> DataFrame:
    rows = items.toArrow()  # at most SMALL_TOKENS tokens
    shared = texts.sparkSession.sparkContext.broadcast(_Items(rows.column("id").to_pylist(), [np.frombuffer(t, np.uint64) for t in rows.column("tokens").to_pylist()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for part, texts in _batches(batches):
            keys = part.column("id").to_pylist()
            found = [(keys[t], items.ids[i], *rest) for t, i, *rest in _overlaps(texts, items)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], pa.int64()) for c in range(5)], _NAMES)

    return texts.mapInArrow(run, FOUND)


def _joined_overlaps(texts: DataFrame, items: DataFrame) -> DataFrame:
    """The same by joins of hashes, for a benchmark of any size."""
    rows = texts.withColumn("row", F.xxhash64("id", "text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
            first = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
            item, n = batch.column("item").to_numpy(), np.diff(first)
            for kind, (keys, at) in enumerate(_item_seeds(np.concatenate(tokens), first)):
                own = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array((keys ^ np.uint64(kind)).view(np.int64)), pa.array(item[own]), pa.array(n[own]), pa.array(at - first[own])], ["hash", "item", "size", "place"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            at = batch.column("hash").to_numpy().view(np.uint64) % np.uint64(BITS)
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        own = [(i, x.tobytes()) for i, x in enumerate(np.split(held, 64)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())], ["part", "bits"])

    def either(part: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in part.column("bits").to_pylist()])
        return pa.table({"part": part.column("part")[:1], "bits": pa.array([whole.tobytes()], pa.binary())})

    item_seeds = stage(items.mapInArrow(seeds, "hash long, item long, size long, place long"), "item-seeds")
    bitmap = np.zeros((64, BITS // 512), np.uint8)
    for r in item_seeds.mapInArrow(bits, "part long, bits binary").groupBy("part").applyInArrow(either, "part long, bits binary").collect():  # BITS bits
        bitmap[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap.ravel())

    def text_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own_texts in _batches(batches):
            tokens, first = _tokens(own_texts)
            row = part.column("row").to_numpy()
            for kind, mask in enumerate(MASKS):
                keys = _seeds(tokens, mask) ^ np.uint64(kind)
                at = keys % np.uint64(BITS)
                hit = np.flatnonzero(shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                text = np.searchsorted(first, hit, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[hit].view(np.int64)), pa.array(row[text]), pa.array(hit - first[text])], ["hash", "row", "at"])

    per_hash = item_seeds.groupBy("hash").count().where(F.col("count") > HOT)
    hot = small(stage(per_hash.select("hash", F.ceil(F.col("count") / HOT).cast("long").alias("parts")), "hot-seeds"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = item_seeds.join(hot, "hash", "left").withColumn("deal", F.pmod(F.xxhash64("item", "place"), parts)).drop("parts")
    once = rows.mapInArrow(text_seeds, "hash long, row long, at long").distinct()  # copies of a text give the same rows
    hits = once.join(hot, "hash", "left").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).join(dealt, ["hash", "deal"])
    diagonals = hits.select("row", "item", "size", (F.col("at") - F.col("place")).alias("base")).distinct()
    numbered = diagonals.withColumn("slice", F.floor((F.row_number().over(Window.partitionBy("row").orderBy("item", "base")) - 1) / DIAGONALS))
    wanted = stage(numbered.groupBy("row", "slice").agg(F.collect_list(F.struct("item", "size", "base")).alias("wanted")).drop("slice"), "diagonals")
    met = rows.join(wanted.select("row").distinct(), "row", "left_semi").groupBy("row").agg(F.first("id").alias("id"), F.first("text").alias("text"))

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own_texts in _batches(batches):
            tokens, first = _tokens(own_texts)
            for i, (key, row, wanted) in enumerate(zip(*(part.column(c).to_pylist() for c in ("id", "row", "wanted")), strict=True)):
                own, out = tokens[first[i] : first[i + 1]], []
                for w in wanted:
                    lo, hi = max(w["base"], 0), min(w["base"] + w["size"], len(own))
                    out.append((key, row, w["item"], lo - w["base"], own[lo:hi].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate([pa.int64()] * 4 + [pa.binary()])], ["id", "row", "item", "skip", "slice"])

    slices = met.join(wanted, "row").mapInArrow(along, "id long, row long, item long, skip long, slice binary")
    pairs = slices.join(items.select("item", F.col("id").alias("item_id"), "tokens"), "item")

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, row, item, item_id, skip, part, tokens in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "item", "item_id", "skip", "slice", "tokens")), strict=True):
                a, b = np.frombuffer(part, np.uint64), np.frombuffer(tokens, np.uint64)
                if found := _accepted(a == b[skip : skip + len(a)], len(b)):
                    out.append((row, item, key, item_id, len(b), *found))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(7)], ["row", "item", *_NAMES])

    best = F.max(F.struct("equal_tokens", "longest_stretch")).alias("best")
    found = pairs.mapInArrow(verdicts, "row long, item long, " + FOUND).groupBy("row", "item", "item_id", "item_tokens").agg(best)
    return rows.select("row", "id").join(found, "row").select("id", "item_id", "item_tokens", "best.equal_tokens", "best.longest_stretch")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` whose text overlaps no item, with their columns as they were.

    Rows are told apart by key and text, so a clean text stays though another under the same key goes.
    """
    row = F.xxhash64(documents[key].cast("long"), documents["text"])
    keyed = documents.select(row.alias("row"), "text")
    bad = small(stage(find_overlaps(keyed, benchmark, "row").select(F.col("row").alias("bad")).distinct(), "contaminated"))
    return documents.join(bad, row == bad["bad"], "left_anti")
