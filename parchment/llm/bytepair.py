"""Byte-level BPE: encoding and decoding by the tokenizers library over Arrow batches.

A rank file names the tokens; the merges behind them are derived from the ranks (``merges``), so any file of ranks will
do. Every byte has a printable character (``BYTE_CHARACTERS``): the library works on such characters, and decoding
reverses the table. A text is split by the vocabulary's pattern and each match is encoded separately. Most matches of a
batch are words seen before, so only new ones go through the library; their ids are kept in a table of bounded size.

Offsets follow from the tokens' byte lengths and a map from bytes to characters: a token that holds a part of a character
covers that character whole, so tokens that split one share it. Decoding joins bytes before it reads characters, so split
characters come back whole; bytes that are no text (ids cut in the middle of a character) become U+FFFD.

Null texts are empty texts and have no tokens; null ids decode to empty bytes. An id that the vocabulary lacks raises an
error, as there is no text to give for it. Repeated rows are encoded alike and all stay. An empty table gives an empty
result. Very long texts are split as a stream of matches; a single match of any length is encoded whole. Extra columns
stay, whatever their names; the columns that are added take the place of those of the same name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_chunks

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Matches in a task's table of ids; when full, a new one starts, which takes over what is still met from the one before.
KEPT = 1 << 18
#: Matches of one text that are looked up at once.
AT_ONCE = 1 << 16


def byte_characters() -> list[str]:
    """The character of each byte: itself if it is printable in Latin-1 and no blank, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [table[b] for b in range(256)]


BYTE_CHARACTERS = byte_characters()


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks with gaps")
    return [tokens[i] for i in range(len(tokens))]


def merges(tokens: list[bytes]) -> list[tuple[bytes, bytes]]:
    """The pair that each token of several bytes is merged from: what is left of it by all merges of lower rank.

    Tokens that lower ranks do not reduce to a pair are never made by merging, and have none.
    """
    ranks = {t: i for i, t in enumerate(tokens)}
    out = []
    for own, token in enumerate(tokens):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
            if rank >= own:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def tokenizer_json(path: str) -> str:
    """The library's tokenizer for a rank file, as JSON that tasks can load. The vocabulary is all that is read."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    shown = lambda token: "".join(BYTE_CHARACTERS[b] for b in token)
    tokens = read_ranks(path)
    model = models.BPE(vocab={shown(t): i for i, t in enumerate(tokens)}, merges=[(shown(a), shown(b)) for a, b in merges(tokens)])
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer.to_str()


class Codec:
    """Encodes and decodes single texts; one per task."""

    def __init__(self, tokenizer: str, pattern: str, kept: int = KEPT):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.matches = regex.compile(pattern).finditer
        self.all_matches = regex.compile(pattern).findall
        self.kept = kept
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        back = {c: b for b, c in enumerate(BYTE_CHARACTERS)}
        size = self.library.get_vocab_size()
        self.bytes_of = [bytes(back[c] for c in self.library.id_to_token(i)) for i in range(size)]
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.table = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)  # the byte table: all tokens, one after another

    def _learn(self, matches: set[str]) -> None:
        """Makes these matches known: from the table before, or by the library, which takes them as words of one text."""
        if len(self.known) + len(matches) > self.kept:
            self.known, self.before = {}, self.known
        again = {m: self.before[m] for m in matches if m in self.before}
        self.known.update(again)
        if new := list(matches.difference(again)):
            found = self.library.encode_batch_fast([new], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype="<u4")
            sizes = np.cumsum([len(m.encode()) for m in new])
            data, ends = ids.tobytes(), 4 * (1 + np.searchsorted(np.cumsum(self.lengths[ids]), sizes))  # tokens end with matches
            starts = np.concatenate(([0], ends[:-1]))
            self.known.update((m, data[a:b]) for m, a, b in zip(new, starts.tolist(), ends.tolist(), strict=True))

    def _look_up(self, lists: list[list[str]]) -> list[bytes]:
        wanted = set().union(*lists)
        if unknown := wanted.difference(self.known):
            tables = self.known
            self._learn(unknown)
            if self.known is not tables:  # a new table
                self._learn(wanted - unknown)
        return [b"".join(map(self.known.__getitem__, matches)) for matches in lists]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of some texts, of a few megabytes together, as 32-bit integers."""
        out = self._look_up([self.all_matches(t) if len(t) <= AT_ONCE else [] for t in texts])
        for i, text in enumerate(texts):
            if len(text) > AT_ONCE:
                found = (m.group() for m in self.matches(text))
                out[i] = b"".join(self._look_up([some])[0] for some in iter(lambda found=found: list(islice(found, AT_ONCE)), []))
        return [np.frombuffer(x, dtype="<u4") for x in out]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last code point of each token."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        ends = np.cumsum(self.lengths[ids])
        if len(ends) and ends[-1] != len(data):
            raise ValueError("ids of another text")
        point = np.cumsum((data & 0xC0) != 0x80)  # of each byte, from 1
        return point[ends - self.lengths[ids]] - 1, point[ends - 1]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of lists of ids that end at ``ends``, one list after another, and where each list's bytes end."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(self.lengths):
            raise ValueError(f"no token has id {int(ids.max() if ids.max() >= len(self.lengths) else ids.min())}")
        sizes = self.lengths[ids]
        to = np.concatenate(([0], np.cumsum(sizes)))
        data = self.table[np.repeat(self.starts[ids] - to[:-1], sizes) + np.arange(to[-1])]
        return data, to[ends]

    def decode(self, ids) -> bytes:
        """The bytes of one list of ids."""
        return self.decode_all(np.asarray(ids, dtype=np.int64), np.array([len(ids)]))[0].tobytes()


_LOADED: dict[tuple[str, str], Codec] = {}


def _codec(shared) -> Codec:
    """The codec of this worker; loaded once, however many tasks it runs."""
    key = shared.value
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Codec(*key)
    return _LOADED[key]


def _shared(spark: SparkSession, vocabulary: str):
    import public_tokenizers

    return spark.sparkContext.broadcast((tokenizer_json(public_tokenizers.path(vocabulary)), public_tokenizers.PATTERN))


def _with(df: DataFrame, **added: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in added] + [T.StructField(k, v) for k, v in added.items()])


def _put(batch: pa.RecordBatch, schema: T.StructType, added: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([added[n] if n in added else batch.column(n) for n in schema.names], schema.names)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype())))


def _distinct_names(df: DataFrame) -> DataFrame:
    if len(set(df.columns)) < len(df.columns):
        raise ValueError("column names repeat")
    return df


def encode(documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int) and, if wanted, ``starts`` and ``ends`` of the tokens in code points."""
    shared = _shared(documents.sparkSession, vocabulary)
    ints = T.ArrayType(T.IntegerType())
    added = {"ids": ints} | ({"starts": ints, "ends": ints} if offsets else {})
    schema = _with(_distinct_names(documents), **added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = batch.column(text)
            sizes = [range(n) for n in np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).tolist()]
            for at, to in text_chunks(sizes):
                part = batch.slice(at, to - at)
                own = [t or "" for t in part.column(text).to_pylist()]
                ids = codec.encode_all(own)
                columns = {"ids": _lists(ids, pa.int32())}
                if offsets:
                    places = [codec.offsets(t, i) for t, i in zip(own, ids, strict=True)]
                    columns |= {"starts": _lists([p[0] for p in places], pa.int32()), "ends": _lists([p[1] for p in places], pa.int32())}
                yield _put(part, schema, columns)

    return documents.mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY, spelled: bool = True) -> DataFrame:
    """Adds ``decoded``, the bytes of the ids, and if wanted ``decoded_text``, the characters they spell."""
    shared = _shared(rows.sparkSession, vocabulary)
    schema = _with(_distinct_names(rows), decoded=T.BinaryType(), **({"decoded_text": T.StringType()} if spelled else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch.column(ids)), 0))
            for at, to in text_chunks([range(4 * n) for n in counts.tolist()]):
                part = batch.slice(at, to - at)
                data, ends = codec.decode_all(np.asarray(part.column(ids).flatten()), np.cumsum(counts[at:to]))
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                columns = {"decoded": pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets), pa.py_buffer(data)])}
                if spelled:
                    columns["decoded_text"] = pa.array([b.decode(errors="replace") for b in columns["decoded"].to_pylist()], pa.string())
                yield _put(part, schema, columns)

    return rows.mapInArrow(run, schema)


def digest(rows: DataFrame) -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded rows, beside their ``doc_id``."""
    rows = rows.select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
            shas = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(shas), batch.column("decoded_sha256")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
