"""Ranked lexical search: the best documents for each item of a query set, by integer BM25-like scores.

Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. Documents are read once: a
row of each keeps its number of terms and the frequencies of the terms that occur in queries. From these rows come the
statistics over all documents, and then each task searches its documents block by block (``Block``) by a hybrid of
term-at-a-time and document-at-a-time: the short posting lists of an item are summed into accumulators, and the
accumulators then stand as one more bounded iterator beside the long lists, which are walked in windows of documents.
A window whose bounds cannot reach the item's current last place is skipped; within a window, lists whose bounds together
stay below it are only looked up for documents that others have brought up. Nothing is cut off: all skipping is by bounds,
and equal scores are looked at. A task returns its best documents per item, and windows over these give the result.

Rows of the query set with one ``item_id`` are one item with the terms of all (a null id is an id). The query set is
searched in blocks of about ``QUERY_TERMS`` terms, as they are broadcast; a block reads all documents.

A null or empty text, or one without a term, is no document of the statistics and is never found. Documents are rows: those
with one doc_id are ranked apart. Ties go by doc_id, null first; rows that agree in all of these are equal rows of the result.
Very long texts are counted in slices. Empty tables give an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flatten, prefix_hashes, slice_hashes, stage, text_chunks, word_slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BEST = 50
#: Pairs of item and term that are broadcast at once.
QUERY_TERMS = 1_000_000
#: Documents and postings that a task indexes at once, and documents in a window.
BLOCK_DOCS, BLOCK_POSTINGS, WINDOW = 1 << 16, 1 << 23, 1 << 12
#: An item's shortest lists are summed term-at-a-time up to so many postings in all.
SHORT_POSTINGS = 1 << 12
#: Bytes of a text that are counted at once.
SLICE = 1 << 22
#: Groups in which the tasks' results meet before they meet by item.
SALTS = 64

_SEPARATORS = np.ones(256, dtype=bool)
_SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 32


def query_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, term``, each pair once."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return items.select(F.col(item).alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in slices that no term crosses."""
    at = 0
    while len(text) - at > SLICE:
        part = np.frombuffer(text, dtype=np.uint8, count=SLICE, offset=at)
        cuts = np.flatnonzero(_SEPARATORS[part])
        if len(cuts):
            to = at + int(cuts[-1]) + 1
        else:
            rest = np.flatnonzero(_SEPARATORS[np.frombuffer(text, dtype=np.uint8, offset=at + SLICE)])
            to = at + SLICE + (int(rest[0]) + 1 if len(rest) else len(text))
        yield text[at:to]
        at = to
    yield text[at:]


class Vocabulary:
    """Finds given terms in texts; matching hashes are compared byte by byte."""

    def __init__(self, terms: list[str]):
        words = [t.encode() for t in terms]
        self.number = {w: i for i, w in enumerate(words)}
        self.data, starts = flatten(words)
        self.begin, self.length = starts[:-1], np.array([len(w) for w in words], dtype=np.int64)
        hashes = slice_hashes(prefix_hashes(self.data), self.begin, self.begin + self.length)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def _find(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words in ``data`` are terms, and of what number."""
        if not len(self.hashes) or not len(begin):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        hashes = slice_hashes(prefix_hashes(data), begin, end)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        which = np.flatnonzero(self.hashes[place] == hashes)
        term = self.order[place[which]]
        size = end[which] - begin[which]
        same = self.length[term] == size
        ends = np.cumsum(np.where(same, size, 0))
        step = np.arange(ends[-1] if len(ends) else 0)
        own, size_same = np.flatnonzero(same), size[same]
        shift = ends[same] - size_same
        at = np.repeat(begin[which][same] - shift, size_same) + step
        differs = data[at] != self.data[np.repeat(self.begin[term[same]] - shift, size_same) + step]
        same[own[np.logical_or.reduceat(differs, shift)] if len(own) else own] = False
        for i in np.flatnonzero(~same):  # one hash, two words
            term[i] = self.number.get(data[begin[which[i]] : end[which[i]]].tobytes(), -1)
        known = term >= 0
        return which[known], term[known]

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of all terms in each text; and text, term and frequency of the known ones, in order of text and term."""
        totals = np.zeros(len(texts), dtype=np.int64)
        keys, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        pieces = [(i, p) for i, t in enumerate(texts) for p in _pieces(t)]
        for start, to in text_chunks([p for _, p in pieces], SLICE):
            owners = np.array([i for i, _ in pieces[start:to]], dtype=np.int64)
            data, starts = flatten([p for _, p in pieces[start:to]])
            data = _LOWERED[data]
            begin, end, first = word_slices(data, starts, _SEPARATORS)
            runs = np.diff(first)
            np.add.at(totals, owners, runs)
            which, term = self._find(data, begin, end)
            found, n = np.unique(np.repeat(owners, runs)[which] * len(self.number) + term, return_counts=True)
            keys.append(found)
            counts.append(n)
        flat = np.concatenate(keys)
        found, inverse = np.unique(flat, return_inverse=True)
        n = np.zeros(len(found), dtype=np.int64)
        np.add.at(n, inverse, np.concatenate(counts))
        return totals, found // max(len(self.number), 1), found % max(len(self.number), 1), n


class Block:
    """Posting lists of some documents, in order of doc_id (null first), with the impact of each posting."""

    def __init__(self, documents: np.ndarray, known: np.ndarray, postings: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        order = np.lexsort((documents, known))
        self.documents, self.known = documents[order], known[order]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        postings = rank[postings]
        sort = np.lexsort((postings, terms))
        self.places, self.impacts = postings[sort], impacts[sort]
        self.terms, starts = np.unique(terms[sort], return_index=True)
        self.starts = np.append(starts, len(sort))
        self.edges = np.arange(0, len(order) + WINDOW, WINDOW)
        self._windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each window begins in list ``k``, and the list's bound in each window."""
        if k not in self._windows:
            self._windows[k] = _bounds(self.places[self.starts[k] : self.starts[k + 1]], self.impacts[self.starts[k] : self.starts[k + 1]], self.edges)
        return self._windows[k]

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Takes the block's documents for an item with these terms into its best ones."""
        at = np.searchsorted(self.terms, terms)
        lists = [int(k) for k, t in zip(at, terms, strict=True) if k < len(self.terms) and self.terms[k] == t]
        if not lists:
            return
        lists.sort(key=lambda k: self.starts[k + 1] - self.starts[k])
        sizes = np.cumsum([self.starts[k + 1] - self.starts[k] for k in lists])
        n_short = int(np.searchsorted(sizes, SHORT_POSTINGS, side="right"))
        iterators = []
        if n_short:  # term at a time
            ranges = [slice(self.starts[k], self.starts[k + 1]) for k in lists[:n_short]]
            places, inverse = np.unique(np.concatenate([self.places[r] for r in ranges]), return_inverse=True)
            sums = np.zeros(len(places), dtype=np.int64)
            np.add.at(sums, inverse, np.concatenate([self.impacts[r] for r in ranges]))
            iterators.append((places, sums, *_bounds(places, sums, self.edges)))
        for k in lists[n_short:]:
            own = slice(self.starts[k], self.starts[k + 1])
            iterators.append((self.places[own], self.impacts[own], *self.windows(k)))
        bounds = np.stack([i[3] for i in iterators])
        for w in range(len(self.edges) - 1):  # document at a time, a window in one go
            self._window(w, iterators, bounds[:, w], best)

    def _window(self, w: int, iterators: list, bounds: np.ndarray, best: Best) -> None:
        least = max(best.least(), 1)
        if bounds.sum() < least:
            return
        order = np.argsort(bounds, kind="stable")
        reach = np.cumsum(bounds[order])
        split = int(np.searchsorted(reach, least))  # lists before it reach nothing alone
        first = int(self.edges[w])
        scores = np.zeros(WINDOW, dtype=np.int64)
        for i in order[split:]:
            places, impacts, begins, _ = iterators[i]
            scores[places[begins[w] : begins[w + 1]] - first] += impacts[begins[w] : begins[w + 1]]
        found = np.flatnonzero(scores)
        for j in range(split - 1, -1, -1):
            found = found[scores[found] + reach[j] >= least]
            if not len(found) or not bounds[order[j]]:
                break
            places, impacts, begins, _ = iterators[order[j]]
            own = places[begins[w] : begins[w + 1]] - first
            at = np.minimum(np.searchsorted(own, found), len(own) - 1)
            hit = own[at] == found
            scores[found[hit]] += impacts[begins[w] + at[hit]]
        found = found[scores[found] >= least]
        if len(found):
            best.take(scores[found], self.known[first + found], self.documents[first + found])


def _bounds(places: np.ndarray, impacts: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.searchsorted(places, edges)
    bounds = np.zeros(len(edges) - 1, dtype=np.int64)
    filled = np.flatnonzero(begins[1:] > begins[:-1])
    if len(filled):
        bounds[filled] = np.maximum.reduceat(impacts, begins[filled])
    return begins, bounds


class Best:
    """An item's best documents so far."""

    def __init__(self, best: int):
        self.best = best
        self.rows = np.zeros((3, 0), dtype=np.int64)  # score, whether the id is known, id

    def least(self) -> int:
        """The score that a document must reach to come in, ties included."""
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.best else 0

    def take(self, scores: np.ndarray, known: np.ndarray, documents: np.ndarray) -> None:
        if len(scores) > self.best:
            keep = scores >= np.partition(scores, -self.best)[-self.best]
            scores, known, documents = scores[keep], known[keep], documents[keep]
        rows = np.concatenate([self.rows, np.stack([scores, known, documents])], 1)
        self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.best]]


def weights(frequencies: np.ndarray, n: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * frequencies + 1))).astype(np.int64)


def _lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """50 + (50 * n * documents) div terms; in unbounded integers where 64 bits might not do."""
    if len(n) and 50 * int(n.max()) * documents >= 1 << 63:
        return np.array([50 + 50 * int(x) * documents // terms for x in n], dtype=np.int64)
    return 50 + 50 * n * documents // terms


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _counted(documents: DataFrame, terms: list[str]) -> DataFrame:
    """``doc_id, n, terms, tfs``: one row per document that has a term."""
    shared = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            n, text, term, tf = vocabulary.count(texts)
            ends = np.searchsorted(text, np.arange(len(texts)), side="right")
            columns = [batch.column("doc_id"), pa.array(n), _lists(ends, term), _lists(ends, tf)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _statistics(counted: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms with repeats, and the documents of each query term; ``n_terms`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(n_terms + 2, dtype=np.int64)
        for batch in batches:
            totals[0] += batch.num_rows
            totals[1] += int(np.asarray(batch.column("n")).sum())
            totals[2:] += np.bincount(np.asarray(batch.column("terms").flatten()), minlength=n_terms)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[at])], ["number", "n"])

    totals = np.zeros(n_terms + 2, dtype=np.int64)
    got = counted.select("n", "terms").mapInArrow(run, "number int, n long").groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    totals[np.asarray(got["number"])] = np.asarray(got["n"])
    return int(totals[0]), int(totals[1]), totals[2:]


def _search_block(documents: DataFrame, pairs: DataFrame, best: int) -> DataFrame:
    """The best documents of each task for the items of one block of the query set."""
    spark = documents.sparkSession
    kind = pairs.schema["item_id"].dataType.simpleString()
    rows = pairs.groupBy("item_id").agg(F.collect_list("term").alias("terms")).toArrow().to_pylist()  # QUERY_TERMS terms
    terms = sorted({t for r in rows for t in r["terms"]})
    number = {t: i for i, t in enumerate(terms)}
    items = [(r["item_id"], np.array(sorted(number[t] for t in r["terms"]), dtype=np.int64)) for r in rows]
    counted = stage(_counted(documents, terms), "counted")
    n_docs, n_all, frequencies = _statistics(counted, len(terms))
    shared = spark.sparkContext.broadcast((items, weights(frequencies, n_docs), n_docs, n_all))
    id_type = pairs.select("item_id").limit(0).toArrow().schema.field("item_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight, documents_, all_terms = shared.value
        found = [Best(best) for _ in wanted]
        held: list[pa.RecordBatch] = []

        def search() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            known = ~np.asarray(table["doc_id"].is_null())
            ids = np.asarray(table["doc_id"].fill_null(0))
            sizes = np.asarray(pa.compute.list_value_length(table["terms"])).astype(np.int64)
            own = np.repeat(np.arange(len(ids)), sizes)
            term = np.asarray(pa.compute.list_flatten(table["terms"])).astype(np.int64)
            tf = np.asarray(pa.compute.list_flatten(table["tfs"])).astype(np.int64)
            length = _lengths(np.asarray(table["n"]), documents_, all_terms)
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * length[own]))
            block = Block(ids, known, own, term, impact)
            for (_, terms_), best_ in zip(wanted, found, strict=True):
                block.search(terms_, best_)

        rows_held = postings = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sizes = np.cumsum(np.asarray(pa.compute.list_value_length(batch.column("terms").slice(at))))
                to = at + max(min(int(np.searchsorted(sizes, BLOCK_POSTINGS - postings)), BLOCK_DOCS - rows_held, len(sizes)), 1)
                held.append(batch.slice(at, to - at))
                rows_held, postings, at = rows_held + to - at, postings + int(sizes[to - at - 1]), to
                if rows_held >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    search()
                    held.clear()
                    rows_held = postings = 0
        if held:
            search()
        for (item, _), best_ in zip(wanted, found, strict=True):
            score, known, doc = best_.rows
            n = len(score)
            if n:
                columns = [pa.array([item] * n, id_type), pa.array(doc, mask=known == 0), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    return counted.mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def _ranked(found: DataFrame, best: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(documents: DataFrame, items: DataFrame, best: int = BEST, query_terms_at_once: int = QUERY_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``best`` documents with a score above 0."""
    pairs = stage(query_terms(items), "query-terms")
    blocks = max(-(-pairs.count() // query_terms_at_once), 1)
    out = None
    for k in range(blocks):
        own = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        found = _search_block(documents, own, best)
        out = found if out is None else out.unionByName(found)
    some = _ranked(out.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))), best, "item_id", "salt").drop("rank", "salt")
    return _ranked(some, best, "item_id").select("item_id", "rank", "doc_id", "score")
