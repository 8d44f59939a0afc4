"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of characters other than letters counts as one space. Null texts, and texts
without a letter, are ``und`` with score 0. Ties go to the language that sorts first. Repeated rows are scored
alike; an empty table gives an empty result; without training rows everything is ``und`` with score 0.
Very long texts are scored in slices and languages in blocks, so memory does not grow with either. Columns other than
the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, mix

#: Hashed features; n-grams of 1 to ORDERS characters.
BUCKETS = 1 << 15
ORDERS = 3
#: At most this many texts train the model, with all of their languages.
MAX_TRAIN = 20_000
SMOOTHING = 0.5
SLICE = 1 << 20
#: Features and languages whose scores are looked up at once.
FEATURES_AT_ONCE, LANGS_AT_ONCE = 1 << 17, 16
#: Which code points are letters; numbers of any kind are none.
_LETTER = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out; one without doc_id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _clean(text: str | None) -> np.ndarray:
    """Code points of the words, in lower case, with one blank before and after each; nothing if there is no letter."""
    low, parts, after_letter = (text or "").lower(), [], False
    for at in range(0, len(low), SLICE):
        points = np.frombuffer(low[at : at + SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _LETTER[points]
        ends = np.concatenate(([after_letter], letter[:-1])) & ~letter  # the first character after each word
        after_letter = bool(letter[-1])
        parts.append(np.where(letter, points, np.uint32(32))[letter | ends])
    words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
    if not len(words):
        return words
    blank = np.full(1, 32, dtype=np.uint32)
    return np.concatenate([blank, words, blank] if after_letter else [blank, words])


def _slices(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of texts, about ``SLICE`` characters at a time: features, and the text that each belongs to."""

    def features(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, whose = [], []
        points = points.astype(np.uint64)
        code = np.zeros(len(points), dtype=np.uint64)
        for n in range(1, ORDERS + 1):
            m = len(points) - n + 1
            if m <= 0:
                break
            code = code[:m] * np.uint64(0x110000) + points[n - 1 :]
            within = owner[:m] == owner[n - 1 :]
            found.append((mix(code[within] + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int32))
            whose.append(owner[:m][within])
        return np.concatenate(found), np.concatenate(whose)

    held: list[np.ndarray] = []
    names: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - ORDERS + 1, 1), SLICE):  # slices share ORDERS - 1 characters
            held.append(t[at : at + SLICE + ORDERS - 1])
            names.append(i)
            size += len(held[-1])
            if size >= SLICE:
                yield features(np.concatenate(held), np.repeat(names, [len(x) for x in held]))
                held, names, size = [], [], 0
    if size:
        yield features(np.concatenate(held), np.repeat(names, [len(x) for x in held]))


def _texts(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [_clean(t) for t in batch.column(column).to_pylist()]


def train(rows: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (feature by language) and log-priors, from rows of ``doc_id, text, lang``.

    Counts are summed by language and feature in Spark; BUCKETS x languages numbers reach the driver.
    """
    rows = bounded_sample(rows.where("lang is not null").select("doc_id", "lang", "text"), max_train).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names, codes = np.unique(np.array(batch.column("lang").to_pylist(), dtype=str), return_inverse=True)
            counts = np.zeros((len(names), BUCKETS + 1), np.int64)
            for found, whose in _slices(_texts(batch, "text")):
                counts[:, :BUCKETS] += np.bincount(codes[whose] * BUCKETS + found, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            counts[:, BUCKETS] = np.bincount(codes, minlength=len(names))
            for lang, values in zip(names, counts, strict=True):
                totals[str(lang)] = totals.get(str(lang), 0) + values
        for lang, values in totals.items():
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(values[at])], ["lang", "feature", "n"])

    counts = rows.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("feature", "n")).alias("counts"), F.max(F.when(F.col("feature") == BUCKETS, F.col("n"))).alias("docs"))
    got = sorted(packed.toArrow().to_pylist(), key=lambda r: r["lang"])
    if not got:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    table = np.zeros((BUCKETS + 1, len(got)))
    for k, r in enumerate(got):
        for c in r["counts"]:
            table[c["feature"], k] = c["n"]
    words, docs = table[:BUCKETS] + SMOOTHING, table[BUCKETS]
    return [r["lang"] for r in got], np.log(words / words.sum(0)).astype(np.float32), np.log(docs / docs.sum())


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], key: str = "doc_id") -> DataFrame:
    """``key, lang_pred, score``; only the text is looked at. The matrix is broadcast (BUCKETS x languages floats)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, priors = shared.value
        parts = [np.ascontiguousarray(logs[:, k : k + LANGS_AT_ONCE]) for k in range(0, len(langs), LANGS_AT_ONCE)]
        for batch in batches:
            texts = _texts(batch, "text")
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if langs:
                totals = np.tile(priors, (len(texts), 1))
                for found, whose in _slices(texts):
                    for at in range(0, len(found), FEATURES_AT_ONCE):
                        f, w = found[at : at + FEATURES_AT_ONCE], whose[at : at + FEATURES_AT_ONCE]
                        starts = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                        for k, part in enumerate(parts):
                            np.add.at(totals[:, k * LANGS_AT_ONCE : (k + 1) * LANGS_AT_ONCE], w[starts], np.add.reduceat(part[f], starts, axis=0, dtype=np.float64))
                best = totals.argmax(1)
                top = totals.max(1, keepdims=True)
                share = 1 / np.exp(totals - top).sum(1)
                for i, t in enumerate(texts):
                    if len(t):
                        names[i], scores[i] = langs[best[i]], share[i]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(names, pa.string()), pa.array(scores)], [key, "lang_pred", "score"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "text").mapInArrow(run, f"{key} {kind}, lang_pred string, score double")
