"""Prefix trie of rebuilt conversations, by fingerprints that combine without the texts.

A conversation is rebuilt from a base: the first ``h`` turns of the base, then its own turns after its first ``h``. The
trie has a node for each distinct sequence of first ``d`` rebuilt turns.

The fingerprint of a sequence is a product in a monoid: x -> x * B + e for each turn with hash e, in two lanes modulo
2**64. Products of a conversation's own turns are formed once, in ranges of the sorted rows whose products are then joined
(``scanned``), so a conversation of any length is no single task's work. What a rebuilt conversation adds follows from three
numbers, the products of base head, own head and own turns: ``(base(k) - own(h)) * B**(j - h) + own(j)``. No rebuilt
conversation is ever formed, and no text is shuffled but for the check below.

The check: members of a node must have the same last turn. Members that point to one stored turn row have; where members
point to different rows, the contents of these rows are compared. If two contents share a hash, or two sequences a product,
everything is done again with other hashes (``MARK`` names the attempt).

A node's subtree is summed without walking it. Each node belongs to its smallest member, so a conversation owns the end of
its path, from some depth on. Hence a subtree's sum is that of the members' own parts, less what the node's owner owns above.

Null roles and texts are empty; rows without conv_id are in no conversation and ignored. Rows with one turn number go by
the MD5 of role and text (null numbers first); repeated rows are turns of their own. Remainders have the sign of conv_id.
An empty table gives an empty trie. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, small, stage

#: At most this many turns of a base go in front; a base serves a group of neighbouring conversations.
MOST_HEAD, GROUP = 8, 5
#: The multipliers of the two lanes.
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NODE = ("depth", "p1", "p2")
#: Ids joined in one piece of the list that is hashed.
IDS = 1 << 14
MARK = 0


def _power(base: int, n: np.ndarray) -> np.ndarray:
    """``base ** n`` modulo 2**64."""
    out, square, n = np.ones(len(n), dtype=np.uint64), base, n.copy()
    while n.any():
        out[(n & 1) == 1] *= np.uint64(square)
        square, n = square * square & (1 << 64) - 1, n >> 1
    return out


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _unsigned(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return np.asarray(batch.column(name)).astype(np.int64).view(np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _put(batch: pa.RecordBatch, names: list[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([added[n] if n in added else batch.column(n) for n in names], names)


# ---- products along sorted rows --------------------------------------------------------------


def _scan(keys: np.ndarray, elements: np.ndarray, base: int, carry: np.uint64) -> np.ndarray:
    """Products along the runs of equal keys; ``carry`` is that before the first row. With base 1, sums."""
    n = len(keys)
    with np.errstate(over="ignore"):
        up, down = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, b, dtype=np.uint64)))) for b in (base, _inverse(base)))
        sums = np.cumsum(elements * down[:n])
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        before = np.concatenate(([np.uint64(0)], sums))[first]
        sizes = np.diff(np.append(first, n))
        out = (sums - np.repeat(before, sizes)) * up[:n]
        out[: sizes[0]] += carry * up[1 : sizes[0] + 1]
    return out


def scanned(rows: DataFrame, key: str, order: list[str], lanes: dict[str, tuple[str, int]], kept: list[str], name: str) -> DataFrame:
    """Adds ``pos`` (from 1) and a product per lane (name: element and base) along each key's rows in ``order``.

    Rows are dealt out by ranges of key and order and scanned in each range. A key that reaches over several ranges has
    its parts' products joined: at most two rows per range reach the driver.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    plain = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [key, *kept])
    schema = f"{plain}, part int, pos long, {', '.join(f'{x} long' for x in lanes)}"
    names = [key, *kept, "part", "pos", *lanes]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, pos, carries = TaskContext.get().partitionId(), None, 0, dict.fromkeys(lanes, np.uint64(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(key))
            if last != keys[0]:
                pos, carries = 0, dict.fromkeys(lanes, np.uint64(0))
            places = _scan(keys, np.ones(len(keys), dtype=np.uint64), 1, np.uint64(pos))
            added = {"part": pa.array(np.full(len(keys), part, dtype=np.int32)), "pos": _signed(places)}
            for lane, (element, base) in lanes.items():
                products = _scan(keys, _unsigned(batch, element), base, carries[lane])
                added[lane], carries[lane] = _signed(products), products[-1]
            last, pos = keys[-1], int(places[-1])
            yield _put(batch, names, added)

    held = stage(dealt.mapInArrow(local, schema), name)
    ends = held.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()  # a row per range
    seen, wide = set(), set()
    for r in ends:
        for k in {r["low"], r["high"]}:
            (wide if k in seen else seen).add(k)
    if not wide:
        return held
    wanted = spark.createDataFrame([(k,) for k in sorted(wide)], f"{key} {rows.schema[key].dataType.simpleString()}")
    totals = held.join(F.broadcast(wanted), key).groupBy(key, "part").agg(F.max("pos").alias("pos"), *(F.max_by(x, "pos").alias(x) for x in lanes))
    carried, running = {}, {}
    for r in sorted(totals.collect(), key=lambda r: (r[key], r["part"])):  # at most two rows per range
        before = running.get(r[key], (0, *[0] * len(lanes)))
        carried[r[key], r["part"]] = before
        joined = [(b * pow(base, r["pos"], 1 << 64) + r[x]) % (1 << 64) for b, (x, (_, base)) in zip(before[1:], lanes.items(), strict=True)]
        running[r[key]] = (before[0] + r["pos"], *joined)
    shared = spark.sparkContext.broadcast(carried)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ranges, pos = np.asarray(batch.column(key)), np.asarray(batch.column("part")), np.asarray(batch.column("pos")).copy()
            values = {x: _unsigned(batch, x).copy() for x in lanes}
            first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (ranges[1:] != ranges[:-1])))) if len(keys) else []
            for a, b in zip(first, np.append(first[1:], len(keys)), strict=True):
                before = shared.value.get((int(keys[a]), int(ranges[a])))
                if before and before[0]:
                    for (x, (_, base)), carry in zip(lanes.items(), before[1:], strict=True):
                        values[x][a:b] += np.uint64(carry) * _power(base, pos[a:b])
                    pos[a:b] += before[0]
            yield _put(batch, names, {"pos": pa.array(pos)} | {x: _signed(v) for x, v in values.items()})

    return held.mapInArrow(whole, schema)


# ---- nodes ---------------------------------------------------------------------------------


def _hashes(role: Column, text: Column, mark: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * mark + k), role, text).alias(f"e{k}") for k in (1, 2)]


def _turns(conversations: DataFrame) -> DataFrame:
    plain = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.withColumn("tie", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))


def _members(turns: DataFrame, mark: int) -> DataFrame:
    """A row per conversation and node of its path: the node, the last turn's hashes, bytes and row, and whether it ends there."""
    skinny = turns.select("conv_id", "turn", "tie", *_hashes(F.col("role"), F.col("text"), mark), F.octet_length("text").cast("long").alias("bytes"))
    own = scanned(skinny, "conv_id", ["turn", "tie"], {"p1": ("e1", LANES[0]), "p2": ("e2", LANES[1])}, ["e1", "e2", "bytes"], "turns")
    head = F.when(F.col("pos") <= MOST_HEAD, F.struct("pos", "p1", "p2", "e1", "e2", "bytes"))
    heads = stage(own.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(head)).alias("head")), "heads")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)
    rebuilt = heads.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), F.get("head", (F.least(h, "n") - 1).cast("int")).alias("cut"))
    bases = heads.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("front"))
    rebuilt = rebuilt.join(bases, "base", "left").withColumn("front", F.slice(F.coalesce("front", F.array().cast(bases.schema["front"].dataType)), F.lit(1), F.col("h").cast("int")))
    rebuilt = rebuilt.withColumn("k", F.size("front").cast("long"))
    rebuilt = stage(rebuilt.withColumn("last", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")
    zero = F.struct(F.lit(0).cast("long").alias("pos"), *(F.lit(0).cast("long").alias(c) for c in ("p1", "p2", "e1", "e2", "bytes")))
    in_front = rebuilt.select("conv_id", "base", "last", F.explode(F.concat(F.array(zero), "front")).alias("x"))
    # A node's last turn is told by its row: conversation and place.
    in_front = in_front.select(F.col("x.pos").alias("depth"), "x.p1", "x.p2", "x.e1", "x.e2", "x.bytes", "conv_id", F.when(F.col("x.pos") > 0, F.col("base")).alias("ref"), F.col("x.pos").alias("ref_pos"), (F.col("x.pos") == F.col("last")).alias("ends"))
    front = F.get("front", (F.col("k") - 1).cast("int"))
    value = lambda part, lane: F.coalesce(part[lane], F.lit(0)).cast("long")
    links = rebuilt.where("n > h").select("conv_id", "h", "k", "last", *(value(front, x).alias(f"front_{x}") for x in ("p1", "p2")), *(F.when(F.col("h") > 0, value(F.col("cut"), x)).otherwise(F.lit(0).cast("long")).alias(f"cut_{x}") for x in ("p1", "p2")))
    rows = own.join(links, "conv_id").where("pos > h")
    names = in_front.columns

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, h_, k = (np.asarray(batch.column(c)) for c in ("pos", "h", "k"))
            added = {"depth": pa.array(k + pos - h_), "ref": batch.column("conv_id"), "ref_pos": batch.column("pos")}
            for lane, base in zip(("p1", "p2"), LANES, strict=True):
                moved = (_unsigned(batch, f"front_{lane}") - _unsigned(batch, f"cut_{lane}")) * _power(base, pos - h_)
                added[lane] = _signed(moved + _unsigned(batch, lane))
            added["ends"] = pa.array(k + pos - h_ == np.asarray(batch.column("last")))
            yield _put(batch, names, added)

    in_own = rows.select("conv_id", "pos", "p1", "p2", "e1", "e2", "bytes", "h", "k", "last", "front_p1", "front_p2", "cut_p1", "cut_p2").mapInArrow(combine, in_front.schema)
    return stage(in_front.unionByName(in_own), "members")


def _with_parent(nodes: DataFrame) -> DataFrame:
    """Adds the parent's product, which follows from the node's and its last turn's hash; null for the root."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in nodes.schema.fields)}, q1 long, q2 long"
    names = [*nodes.columns, "q1", "q2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root = np.asarray(batch.column("depth")) == 0
            back = [(_unsigned(batch, p) - _unsigned(batch, e)) * np.uint64(_inverse(b)) for p, e, b in zip(("p1", "p2"), ("e1", "e2"), LANES, strict=True)]
            yield _put(batch, names, {q: pa.array(x.view(np.int64), mask=root) for q, x in zip(("q1", "q2"), back, strict=True)})

    return nodes.mapInArrow(run, schema)


def _nodes(members: DataFrame) -> DataFrame:
    row = F.struct("ref", "ref_pos")
    ends = F.sum(F.col("ends").cast("long"))
    nodes = members.groupBy(*NODE).agg(
        F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), ends.alias("n_ends"), F.min(F.when(F.col("ends"), F.col("conv_id"))).alias("end"),
        *(F.min(e).alias(e) for e in ("e1", "e2")), F.min("bytes").alias("bytes"),
        ((F.min("e1") != F.max("e1")) | (F.min("e2") != F.max("e2"))).alias("mixed"), (F.min(row) != F.max(row)).alias("compared"),
    )
    return stage(_with_parent(nodes), "nodes")


def _clash(turns: DataFrame, nodes: DataFrame, mark: int) -> bool:
    """Whether some node's members differ: in the last turn's hash, or in the contents behind one hash."""
    if nodes.where("mixed").limit(1).count():
        return True
    suspects = nodes.where("compared").select("e1", "e2").distinct()
    contents = turns.select("role", "text", *_hashes(F.col("role"), F.col("text"), mark))
    if suspects.count() <= SMALL_ROWS:
        contents = contents.join(F.broadcast(suspects), ["e1", "e2"], "left_semi")
    differ = (F.min("role") != F.max("role")) | (F.min("text") != F.max("text"))
    return contents.groupBy("e1", "e2").agg(differ.alias("differ")).where("differ").limit(1).count() > 0


def _end_lists(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end in a node, for nodes where several do.

    Ids are joined in pieces, over ranges of node and id; a node's pieces are then hashed as a stream.
    """
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    several = nodes.where("n_ends > 1").select(*NODE)
    ends = members.where("ends").join(small(several), list(NODE), "left_semi").select(*NODE, "conv_id")

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in NODE], 1)
            ids = np.asarray(batch.column("conv_id"))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            edges = np.unique(np.concatenate(([0], cuts, np.arange(0, len(ids), IDS), [len(ids)]))).astype(int)
            starts, to = edges[:-1], edges[1:]
            text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, to, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[starts, i]) for i in range(3)), pa.array(ids[starts]), pa.array(text, pa.string())], [*NODE, "first", "ids"])

    def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(node, digest):
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([digest.hexdigest()])], [*NODE, "several_sha"])

        node = digest = None
        for batch in batches:
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if own != node:
                    if digest:
                        yield row(node, digest)
                    node, digest = own, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
        if digest:
            yield row(node, digest)

    key = ", ".join(f"{c} long" for c in NODE)
    pieces = ends.repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(join_ids, f"{key}, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hash_ids, f"{key}, several_sha string")


def trie(conversations: DataFrame, mark: int = MARK) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns = _turns(conversations)
    while True:
        members = _members(turns, mark)
        nodes = _nodes(members)
        if not _clash(turns, nodes, mark):
            break
        mark += 1
    key = list(NODE)
    worth = (F.col("n_convs") - 1) * F.col("bytes")
    shared = nodes.where("n_convs > 1")
    # What each conversation owns, and what its owner owns above each shared node.
    owned = nodes.where("n_convs > 1 or n_ends = n_convs").groupBy(F.col("owner").alias("conv_id")).agg(F.sum(worth).alias("own_saved"), F.sum((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("own_leaves"))
    above = scanned(shared.select("owner", *NODE, worth.alias("worth")), "owner", ["depth"], {"down": ("worth", 1)}, ["p1", "p2", "depth", "worth"], "owned")
    above = above.select(*NODE, (F.col("down") - F.col("worth")).alias("above"))
    in_shared = members.select(*NODE, "conv_id").join(small(shared.select(*NODE)), key, "left_semi").join(owned, "conv_id")
    sums = in_shared.groupBy(*NODE).agg(F.sum("own_saved").alias("saved"), F.sum("own_leaves").alias("leaves"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("children"))
    told = shared.select(*NODE, "owner").join(sums, key).join(above, key).join(children, key, "left")
    told = stage(told.join(_end_lists(members, nodes), key, "left"), "shared-nodes")
    parents = told.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("owner").alias("above_owner"))
    rows = nodes.join(small(told.drop("owner")), key, "left").join(small(parents), ["depth", "q1", "q2"], "left")
    alone = F.col("n_convs") == 1
    long = lambda c: c.cast("long")
    return rows.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("above_owner", "owner")).alias("parent_conv_id"), "n_convs",
        long(F.when(alone, 1 - F.col("n_ends")).otherwise(F.coalesce("children", F.lit(0)))).alias("n_children"),
        long(F.when(alone, 1).otherwise(F.col("leaves"))).alias("n_leaves"), long(F.when(alone, 0).otherwise(F.col("saved") - F.col("above"))).alias("saved_tokens"),
        F.when(F.col("n_ends") > 1, F.col("several_sha")).otherwise(F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")).cast("binary"), 256)).alias("ends_sha256"),
    )
