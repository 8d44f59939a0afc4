"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as in the regular expression ``[\x20\x09-\x0D]``.
SPACE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only on a local master (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="parchment-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind: the written table takes their place."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if not spark.conf.isModifiable(setting):
        yield
        return
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Cuts lineage without tying rows to one executor, and gives later joins true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _without_shuffle_files(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a staged table of a few numbers a row is broadcast.
SMALL_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A staged table, marked for broadcast if it has at most SMALL_ROWS rows; else the join decides by itself."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


#: Partitions of a bounded sample.
SAMPLE_TASKS = 32


def sample_limit(rows: int, most: int) -> int:
    """Keep a row if 63 random bits are below this: about ``most`` of ``rows``, whatever their number."""
    return (1 << 63) - 1 if rows <= most else max((1 << 63) * most // rows, 1)


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """All rows, or about ``most`` of them picked by a hash of the whole row, and never more.

    They are dealt out anew: the limit gathers its rows in one partition, and a small table may stand in few row groups.
    """
    n = rows.count()
    if n <= most:
        return rows.repartition(SAMPLE_TASKS)
    return rows.where(F.xxhash64(*rows.columns).bitwiseAND((1 << 63) - 1) < sample_limit(n, most)).limit(most).repartition(SAMPLE_TASKS)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Write a table bucketed and sorted by ``key`` to the shared folder, so that grouping by it needs no shuffle."""
    spark = df.sparkSession
    table_name = f"{name}_{uuid.uuid4().hex}"
    with _without_shuffle_files(spark):
        writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet")
        writer.option("path", f"{shared_dir(spark)}/{table_name}").saveAsTable(table_name)
    return spark.table(table_name)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    while name in df.columns:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Sorted batches, cut anew so that rows with equal ``names`` stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c)) for c in names], 1)
        changes = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if [last.column(c)[0].as_py() for c in names] != keys[0].tolist():
                yield pa.Table.from_batches(held)
                held = []
        if len(changes):
            cut = int(changes[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


# ---- batches of texts as flat byte arrays -------------------------------------------------


def text_chunks(texts, max_bytes: int = 1 << 20):
    """Slices ``(from, to)`` of a list of byte strings with about ``max_bytes`` each; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > max_bytes:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def flatten(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, each text followed by a 0 byte, and the start of each text (one more for the end)."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


_RANDOM = np.random.default_rng(20240613)
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inverse" if inverse else "base"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        steps = np.full(size, _BASE_INVERSE if inverse else _BASE, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``out[i]``: polynomial hash of the first ``i`` bytes, modulo 2**64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data)), out=out[1:], dtype=np.uint64)
    return out


def slice_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte slices ``[start, end)``, independent of where they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), True)[starts])


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_slices(data: np.ndarray, starts: np.ndarray, separators: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separator bytes, and for each text the index of its first run.

    The 0 byte that ends each text (see flatten) is a separator, so runs never cross texts.
    """
    inside = np.empty(len(data) + 1, dtype=bool)
    inside[0] = False
    np.logical_not(separators[data], out=inside[1:])
    inside[starts[1:]] = False  # the byte before a start, in an array that begins one earlier
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[0::2], edges[1::2]
    return begin, end, np.searchsorted(begin, starts)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` neighbours."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:m] * powers(n)[0]
    for k in range(1, n):
        out = out + hashes[k : m + k] * powers(n)[k]
    return mix(out)
