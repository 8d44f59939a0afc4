"""N-gram Jaccard join by the chosen-path method.

Texts are sets of five-word shingles (words are runs of ``[^\\x20\\x09-\\x0D]``; a text of one to four words is one
shingle; a text without words has none and links to nothing). Sets that are equal are one class with one
representative. In each run, a representative's set is split recursively on sampled shared tokens (the least shingle
under a hash function): sets that share it go on together. Each node of the recursion samples ``BRANCH`` tokens and a set
follows every one of them, so a pair at the threshold stays together in some branch with a chance that does not fall
with the depth. Groups of at most ``LEAF`` sets are compared by brute force on short sketches; a group that still holds
together after ``DEPTH`` tokens shares so many that it is taken as candidates whole. Runs, each with a first token of
its own, are repeated until a pair right at the threshold is met with probability ``RECALL``.

The first split is a shuffle. A group of at most ``GROUP`` sets is split on inside its task; larger ones are told by
counting keys and are split on by further keys before any of their sets moves, so no task holds a hot token.

Candidates form components. Within a component, every pair is then compared exactly: its members are dealt into
blocks of bounded size and each pair of blocks is one group of rows, so neither a large component nor long texts
gather in one task, and links are counted inside the tasks, not emitted as pairs.

Result: one row per row of the input: ``doc_id, class_id, n_links``. ``class_id`` is the smallest doc_id among all
documents linked to it directly or through others; ``n_links`` counts the other rows of similarity ``SIMILARITY`` or
more, copies included. Null and empty texts, empty tables: no links. Repeated rows count as copies of a document;
different texts under one doc_id are documents of their own. A row without doc_id takes part; its class is null if no
row of the class has one. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import combine, flatten, free_name, mix, prefix_hashes, slice_hashes, small, stage, text_chunks, whole_groups, word_slices
from .graph import components

WORDS = 5
#: Similarity as a fraction, so that comparisons are exact.
SIMILARITY = (4, 5)
COORDINATES = 64
LEAF = 256
#: Tokens after which a group is not split further, in its task and by keys before.
DEPTH = 8
#: Sampled tokens of a node.
BRANCH = 2
#: Sets that are split inside one task.
GROUP = 20_000
RECALL = 0.99999
#: Sketch similarity from which a pair in a leaf is a candidate: 0.8 less 5 standard errors.
LIKELY = 0.8 - 5 * math.sqrt(0.16 / COORDINATES)
#: Bounds of a block of sets that are compared exactly: sets and shingles.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1_000_000


def meeting_chance(depth: int, similarity: float = SIMILARITY[0] / SIMILARITY[1]) -> float:
    """Least chance that a run brings a pair of that similarity into one leaf after ``depth`` splits."""
    alone = 0.0  # that no branch below a node keeps the pair
    for _ in range(depth - 1):
        alone = (1 - similarity + similarity * alone) ** BRANCH
    return similarity * (1 - alone)


#: Runs, so that a pair at the threshold is met with RECALL however deep its groups are split (branching settles early).
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - meeting_chance(2 * DEPTH)))

_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text, its distinct shingles as sorted 64-bit hashes."""
    data, starts = flatten([t.encode("utf-8", "surrogatepass") for t in texts])
    begin, end, first = word_slices(data, starts)
    words = slice_hashes(prefix_hashes(data), begin, end)
    windows = combine(words, WORDS)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(windows[a : b - WORDS + 1]))
        else:
            out.append(combine(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def row_key() -> Column:
    """Tells rows apart by doc_id and text; repeated rows share it."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _keyed(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("row", row_key())


def sketches(documents: DataFrame) -> DataFrame:
    """``row, doc_id, a, b, n, tops, marks`` of rows with words.

    ``a, b``: two hashes of the whole set; ``n``: its size; ``tops``: the first token of each run; ``marks``: a byte for
    the least shingle under each hash function.
    """
    ddl = "row long, doc_id long, a long, b long, n long, tops array<long>, marks binary"
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in text_chunks(texts):
                sets = shingle_sets(texts[lo:hi])
                sizes = np.array([len(s) for s in sets])
                own = np.flatnonzero(sizes)
                if not len(own):
                    continue
                flat = np.concatenate([sets[i] for i in own])
                at = np.concatenate(([0], np.cumsum(sizes[own])[:-1]))
                least = np.stack([np.minimum.reduceat(flat * f, at) for f in _FACTORS], 1).view(np.int64)
                a = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at).view(np.int64)
                b = np.bitwise_xor.reduceat(mix(flat + np.uint64(0x14057B7EF767814F)), at).view(np.int64)
                tops = pa.FixedSizeListArray.from_arrays(pa.array(least[:, :RUNS].ravel()), RUNS).cast(pa.list_(pa.int64()))
                marks = pa.array([m.tobytes() for m in (least >> 20).astype(np.uint8)], pa.binary())
                keys = [batch.column(c).slice(lo, hi - lo).take(pa.array(own)) for c in ("row", "doc_id")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(a), pa.array(b), pa.array(sizes[own]), tops, marks], names)

    return _keyed(documents).mapInArrow(run, ddl)


def _propagate(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes can reach."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[left], labels[right])
        new = labels.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _split(marks: np.ndarray, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Splits one group by sampled tokens: index lists of at most LEAF sets, and such as no split took apart."""
    random = np.random.default_rng(seed & ((1 << 63) - 1))
    leaves, whole = [], []
    open_ = [(np.arange(len(marks)), 1)]
    while open_:
        own, depth = open_.pop()
        if len(own) <= LEAF:
            leaves.append(own)
        elif depth >= DEPTH:
            whole.append(own)
        else:
            for c in random.choice(COORDINATES, BRANCH, replace=False):
                values = marks[own, c]
                order = np.argsort(values, kind="stable")
                for part in np.split(own[order], np.flatnonzero(np.diff(values[order])) + 1):
                    if len(part) > 1:
                        open_.append((part, depth + 1))
    return leaves, whole


def _leaf_edges(groups: DataFrame) -> DataFrame:
    """Pairs ``u, v`` that connect the likely similar members of each group (``key, rep, marks``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["key"]):
            keys, reps = part.column("key").to_numpy(), part.column("rep").to_numpy()
            marks = np.frombuffer(b"".join(part.column("marks").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            bounds = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            sizes = np.diff(bounds)
            low = np.repeat(sizes, sizes)
            leaves, left, right = [np.flatnonzero((low > 1) & (low <= LEAF))], [], []
            names = [keys[leaves[0]]]
            for g in np.flatnonzero(sizes > LEAF):
                inner, whole = _split(marks[bounds[g] : bounds[g + 1]], int(keys[bounds[g]]))
                leaves += [x + bounds[g] for x in inner]
                for x in whole:
                    left.append(x[1:] + bounds[g])
                    right.append(np.full(len(x) - 1, x[0] + bounds[g]))
            names += [np.full(len(x), i, np.int64) for i, x in enumerate(leaves[1:])]
            for own, key in ((leaves[0], names[0]), (np.concatenate([np.zeros(0, np.int64), *leaves[1:]]), np.concatenate([np.zeros(0, np.int64), *names[1:]]))):
                for d in range(1, len(own)):
                    at = np.flatnonzero(key[d:] == key[:-d])
                    if not len(at):
                        break
                    for piece in np.array_split(at, len(at) // 50_000 + 1):
                        alike = (marks[own[piece]] == marks[own[piece + d]]).sum(1, dtype=np.uint8) >= LIKELY * COORDINATES
                        left.append(own[piece[alike]])
                        right.append(own[piece[alike] + d])
            if left:
                labels = _propagate(len(keys), np.concatenate(left), np.concatenate(right))
                own = np.flatnonzero(labels != np.arange(len(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(reps[own]), pa.array(reps[labels[own]])], ["u", "v"])

    return groups.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(run, "u long, v long")


def candidate_edges(reps: DataFrame) -> DataFrame:
    """Edges whose components hold all likely similar representatives; ``reps`` has ``rep, tops, marks`` and is staged."""
    active = reps.select("rep", "marks", F.posexplode("tops").alias("run", "top")).select("rep", "marks", F.xxhash64("run", "top").alias("key"))
    ready, edges = None, None
    for level in range(1, DEPTH + 1):
        # Counts come from partial counts. There are fewer such keys than rows by a factor of GROUP.
        hot = stage(active.groupBy(F.col("key").alias("_key")).count().where(F.col("count") > GROUP), "hot-keys")
        if hot.isEmpty():
            ready = active if ready is None else ready.unionByName(active)
            break
        on = active["key"] == hot["_key"]
        rest = active.join(small(hot), on, "left_anti")
        ready = rest if ready is None else ready.unionByName(rest)
        active = active.join(small(hot), on, "left_semi")
        if level < DEPTH:
            token = lambda b: F.pmod(F.xxhash64("key", F.lit(b)), F.lit(COORDINATES)).cast("int")
            nodes = F.array(*(F.xxhash64("key", F.lit(b), F.substring("marks", token(b) + 1, F.lit(1))) for b in range(BRANCH)))
            active = active.select("rep", "marks", F.explode(nodes).alias("key"))
        else:
            firsts = active.groupBy(F.col("key").alias("_key")).agg(F.min("rep").alias("v"))
            edges = active.join(small(stage(firsts, "firsts")), F.col("key") == F.col("_key")).select(F.col("rep").alias("u"), "v")
    found = _leaf_edges(ready)
    return found if edges is None else found.unionByName(edges)


def _compare(sets: list[np.ndarray], sides: np.ndarray, one: bool) -> np.ndarray:
    """Which pairs are similar, as a symmetric matrix; with ``one`` all pairs, else pairs of different sides only."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    token = np.cumsum(new) - 1
    shared = np.bincount(token)[token] > 1
    owner, token = owner[shared], token[shared]
    common = np.zeros((len(sets), len(sets)))
    step = 4096
    if len(token):
        token = np.unique(token, return_inverse=True)[1]
        bounds = np.searchsorted(token, np.arange(0, token[-1] + 1 + step, step))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows = np.zeros((len(sets), step), np.float32)
            rows[owner[lo:hi], token[lo:hi] % step] = 1
            common += rows @ rows.T
    p, q = SIMILARITY
    similar = common * (p + q) >= p * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(similar, False)
    return similar if one else similar & (sides[:, None] != sides[None, :])


def exact_links(documents: DataFrame, members: DataFrame) -> DataFrame:
    """``rep, links, root`` from every block pair; ``members`` has ``rep, component, copies, blocks``.

    ``links`` counts documents; ``root`` is the first of the members that the rep is linked to in the block pair.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in text_chunks(texts):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("component", "rep", "copies", "blocks")] + [pa.array([s.tobytes() for s in shingle_sets(texts[lo:hi])], pa.binary())], ["component", "rep", "copies", "blocks", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(_rechunk(batches), ["component", "i", "j"]):
            names = np.stack([part.column(c).to_numpy() for c in ("component", "i", "j", "rep")], 1)
            once = np.concatenate(([True], (names[1:] != names[:-1]).any(1)))  # repeated rows
            part, key = part.filter(pa.array(once)), names[once][:, :3]
            reps, copies, block = (part.column(c).to_numpy() for c in ("rep", "copies", "block"))
            starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]))
            shingles = part.column("shingles")
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                own = [np.frombuffer(x.as_py(), np.uint64) for x in shingles.slice(lo, hi - lo)]
                similar = _compare(own, block[lo:hi], key[lo, 1] == key[lo, 2])
                linked = np.flatnonzero(similar.any(1))
                if len(linked):
                    left, right = np.nonzero(np.triu(similar))
                    labels = _propagate(hi - lo, left, right)
                    links = (similar * copies[lo:hi]).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(reps[lo:hi][linked]), pa.array(links[linked].astype(np.int64)), pa.array(reps[lo:hi][labels[linked]])], ["rep", "links", "root"])

    texts = _keyed(documents)
    rows = texts.join(small(members), texts["row"] == members["rep"])
    rows = rows.select("component", "rep", "copies", "blocks", "text").mapInArrow(sets, "component long, rep long, copies long, blocks long, shingles binary")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "copies", "block", "shingles")
    return rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "rep").mapInArrow(compare, "rep long, links long, root long")


def _rechunk(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def similar_rows(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row with words as ``row, doc_id, rep``, and for each ``rep`` its ``class_id, n_links, first``.

    ``first`` is the row that stands for the class: that of the smallest doc_id.
    """
    every = stage(sketches(documents), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    grouped = every.groupBy("a", "b", "n").agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.first("tops").alias("tops"), F.first("marks").alias("marks"))
    reps = stage(grouped.withColumn("rep", F.col("first.row")), "representatives")
    found = components(candidate_edges(reps))
    together = found.join(reps.select("rep", "copies", "n"), found["node"] == F.col("rep")).select("rep", "copies", "n", F.col("root").alias("component"))
    sizes = together.groupBy(F.col("component").alias("_component")).agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    members = stage(together.join(sizes, together["component"] == sizes["_component"]).select("rep", "component", "copies", blocks.alias("blocks")), "members")
    links = stage(exact_links(documents, members), "links")
    roots = stage(components(links.select(F.col("rep").alias("u"), F.col("root").alias("v"))).join(reps.select("rep", "first"), F.col("node") == F.col("rep")).select("rep", "root", "first"), "roots")
    firsts = roots.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("least"))
    counted = links.groupBy(F.col("rep").alias("_rep")).agg(F.sum("links").alias("links"))
    linked = roots.join(firsts, roots["root"] == firsts["_root"]).join(counted, roots["rep"] == counted["_rep"]).select(F.col("rep").alias("_own"), "least", "links")
    own = reps.select("a", "b", "n", "rep", "copies", "first").join(linked, F.col("rep") == F.col("_own"), "left")
    least = F.coalesce("least", "first")
    classes = own.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("n").alias("_n"), least["doc_id"].alias("class_id"), least["row"].alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return every, classes


def _placed(every: DataFrame, classes: DataFrame) -> DataFrame:
    same = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("n") == F.col("_n"))
    return every.select("row", "doc_id", "a", "b", "n").join(classes, same)


def join(documents: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links``: one row per row of ``documents``; rows without words are classes of their own."""
    bare = documents.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    key = F.col("doc_id").cast("long")
    placed = _placed(*similar_rows(documents)).select("doc_id", "class_id", "n_links")
    return placed.unionByName(bare.select(key.alias("doc_id"), key.alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each class, that of the smallest doc_id; rows without words stay. Columns stay as they were."""
    every, classes = similar_rows(documents)
    gone = small(stage(_placed(every, classes).where(F.col("row") != F.col("first")).select(F.col("row").alias("gone")).distinct(), "gone"))
    key = F.xxhash64(documents["doc_id"].cast("long"), F.coalesce(documents["text"], F.lit("")))
    kept = documents.join(gone, key == gone["gone"], "left_anti")
    repeated = stage(every.groupBy(F.col("row").alias("again")).count().where(F.col("count") > 1).select("again"), "repeated")
    if repeated.isEmpty():
        return kept
    repeated, name = small(repeated), free_name(documents, "_once")
    once = kept.join(repeated, key == repeated["again"], "left_semi").withColumn(name, key).dropDuplicates([name]).drop(name)
    return kept.join(repeated, key == repeated["again"], "left_anti").unionByName(once)
