"""Exact removal of repeated 50-byte strings with suffix arrays.

Texts are UTF-8 bytes. A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a
smaller doc_id; strings are judged on the input, not on what is left.

Suffix arrays are built by linear grouping: suffixes are grouped by their Lyndon prefixes, groups are taken in
descending order, each suffix's previous smaller one is found through the pointers of those before it and moves up
behind its group, and a last pass emits every group's order from the pointers. Nothing is renamed or sorted recursively.
Groups are intervals of one integer array and are split in place, so a step costs what it moves; many short strings
advance together, each by its own next group, so that a step is a few array operations.

A suffix array over all texts at once would not fit a task, so the strings are dealt out first:

1. Rows are dealt into chunks of about ``CHUNK`` bytes, once, as a table bucketed by chunk. All later steps read that
   table without another shuffle and exchange messages by chunk only, which merges what a chunk holds many times.
2. Each window of ``LENGTH`` bytes belongs to the least hash of its ``GRAM``-byte substrings. Equal windows have equal
   hashes, and neighbouring windows with the same hash are one block. A chunk sends its distinct hashes, as packed
   arrays by range of hashes; those that another chunk has too come back.
3. A chunk sends the bytes of its blocks with shared hashes, packed likewise, each distinct block once with its places. A hash whose
   blocks are too many and too different (``HOT``, ``VARIANTS``) is split further: its windows are sent one by one under
   the hash of the whole window, so that no task holds all surroundings of a common phrase.
4. Suffix arrays over the blocks of a hash, without windows that equal no other there, tell each window's smallest owner;
   what is to be removed goes back to the chunks, which cut their texts.

A null text is empty. A row without doc_id loses nothing and takes nothing. Rows with the same doc_id do not remove
each other's bytes; repeated rows get equal results. A long text is hashed in overlapping pieces of ``PIECE`` bytes.
Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, bucketed, flatten, mix, powers, prefix_hashes, slice_hashes, text_chunks

LENGTH = 50
GRAM = 24
#: Bytes of text in a chunk, of a long text's piece, and of text behind one range of hashes.
CHUNK, PIECE, RANGE = 8 << 20, 1 << 20, 12 << 20
#: Windows in a block; longer runs (of periodic text) are cut.
CUT = 256
#: Buckets of the table of chunks at most (Spark refuses more than 100,000). A task takes the chunks of a bucket one by one,
#: in order, so larger buckets cost time, not memory.
MAX_BUCKETS = 50_000
#: A hash is dealt out by whole windows if one chunk has more than VARIANTS blocks of it, or all chunks together have
#: more than HOT with more than VARIANTS different checksums of a byte.
HOT, VARIANTS = 256, 64
#: Symbols that go through linear grouping together, and blocks that a chunk gathers at a time.
BATCH, GATHER = 3 << 20, 300_000


def suffix_arrays(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sorted suffixes of many strings of positive symbols, one string after another, as places in ``data``.

    ``starts``: where each string begins (one more for the end). A suffix sorts before those it begins.
    """
    total = len(data)
    starts = np.asarray(starts, dtype=np.int64)
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    # Groups are intervals of the result; a group's name is where it begins.
    result = np.lexsort((data, owner)).astype(np.int32)
    place = np.empty(total, np.int32)
    place[result] = np.arange(total, dtype=np.int32)
    ordered, by = data[result], owner[result]
    new = np.ones(total, dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (by[1:] != by[:-1])
    begins = np.flatnonzero(new)
    group = np.empty(total, np.int32)
    size = np.zeros(total + 1, np.int32)
    size[begins] = np.diff(np.append(begins, total))
    group[result] = np.repeat(begins, size[begins])
    previous = np.full(total + 1, -1, np.int32)  # one more, so that index -1 is a cell of its own
    counts, seen = np.zeros(total, np.int32), np.zeros(total, np.int32)
    moves = np.zeros(total, dtype=bool)
    low = starts[:-1].astype(np.int32)
    below = starts[1:].astype(np.int32)  # everything from here on in a string's interval is done
    active = np.flatnonzero(sizes)
    done_from = below.copy()
    while len(active):
        first = group[result[below[active] - 1]]
        k = size[first]
        done_from[active] = first  # the group at hand counts as done
        members = result[_spread(first, k)]
        edge = np.repeat(first, k)
        at = members - 1
        at[members == np.repeat(low[active], k)] = -1
        previous[members] = at
        open_ = np.arange(len(members))
        while len(open_):
            p = previous[members[open_]]
            open_ = open_[(p >= 0) & (group[p] >= edge[open_])]
            own = members[open_]
            previous[own] = previous[previous[own]]
        # Each previous smaller suffix moves up in its group, the higher the more often this group follows it.
        p = previous[members]
        p = p[p >= 0]
        if len(p):
            if len(p) == 1:
                often = np.ones(1, np.int32)
            else:
                np.add.at(counts, p, 1)
                seen[p] = np.arange(len(p), dtype=np.int32)
                p = p[seen[p] == np.arange(len(p))]
                often = counts[p]
                counts[p] = 0
                key = group[p].astype(np.int64) << 32 | often
                order = np.argsort(key, kind="stable")
                p, often = p[order], often[order]
            g = group[p]
            change = np.ones(len(p), dtype=bool)
            change[1:] = g[1:] != g[:-1]
            lead = np.flatnonzero(change)
            moved = np.diff(np.append(lead, len(p)))
            names = g[lead]
            ends = names + size[names]
            tail = np.repeat(ends - moved - lead, moved) + np.arange(len(p))  # slots for the moved ones
            moves[p] = True
            there = result[tail]
            stay = there[~moves[there]]
            if len(stay):
                was = place[p]
                free = was[was < np.repeat(ends - moved, moved)]
                result[free] = stay
                place[stay] = free
            moves[p] = False
            result[tail] = p
            place[p] = tail
            size[names] -= moved.astype(np.int32)
            change[1:] |= often[1:] != often[:-1]
            lead = np.flatnonzero(change)
            fresh = tail[lead]
            of = np.diff(np.append(lead, len(p)))
            size[fresh] = of
            group[p] = np.repeat(fresh, of)
        below[active] = first
        active = active[first > low[active]]
    # Ascending: the suffix before each one in order is the next of its group, and so are its previous smaller ones.
    slot = group.copy()
    group_slot = np.arange(total + 1, dtype=np.int32)
    placed = np.zeros(total + 1, dtype=bool)
    placed[-1] = True
    result[:] = -1

    def emit(s: np.ndarray) -> None:
        while len(s):
            s = s[~placed[s]]
            if not len(s):
                return
            g = slot[s]
            result[group_slot[g]] = s
            group_slot[g] += 1
            placed[s] = True
            s = previous[s]

    active = np.flatnonzero(sizes)
    emit((starts[1:][active] - 1).astype(np.int32))
    step = 0
    while len(active):
        s = result[low[active] + step]
        emit(np.where(s > low[active], s - 1, -1))
        step += 1
        active = active[sizes[active] > step]
    return result


def suffix_array(text: list[int]) -> list[int]:
    """Starts of all suffixes of one string in order. ``text``: non-negative integers."""
    return suffix_arrays(np.array(text, dtype=np.int64) + 1, np.array([0, len(text)])).tolist()


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that start at ``first``."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def least_owners(flat: np.ndarray, lengths: np.ndarray, sets: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each window of each part, one after another, the smallest owner of any part of its set with an equal window.

    ``flat`` holds the bytes of all parts; parts of a set stand together. Windows whose hash is the only one of its kind in
    the set equal no other; only the others, as runs of neighbours, are put in order.
    """
    windows = np.maximum(lengths - LENGTH + 1, 0)
    part = np.repeat(np.arange(len(lengths)), windows)
    starts = _spread(np.cumsum(lengths) - lengths, windows)
    several = _several(slice_hashes(prefix_hashes(flat), starts, starts + LENGTH), np.cumsum(np.diff(sets, prepend=sets[:1]) != 0)[part])
    found = owners[part].astype(np.int64)
    if several.any():
        change = np.ones(len(part), dtype=bool)
        change[1:] = (several[1:] != several[:-1]) | (part[1:] != part[:-1])
        lead = np.flatnonzero(change)
        size = np.diff(np.append(lead, len(part)))
        lead, size = lead[several[lead]], size[several[lead]] + LENGTH - 1
        found[several] = _least_owners(flat[_spread(starts[lead], size)], size, sets[part[lead]], owners[part[lead]])
    return found


def _several(hashes: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Which hashes occur again in their set; some others may be among them."""
    keys = hashes ^ mix(sets.astype(np.uint64))
    order = np.argsort(keys)
    same = np.diff(keys[order]) == 0
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _least_owners(flat: np.ndarray, lengths: np.ndarray, sets: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """The same for windows most of which are shared: a suffix array per set."""
    ends = np.cumsum(lengths + 1)
    part_of = np.repeat(np.arange(len(lengths)), lengths + 1)
    data = np.ones(len(part_of), dtype=np.int16)  # 1 closes a part
    inner = np.ones(len(data), dtype=bool)
    inner[ends - 1] = False
    data[inner] = flat.astype(np.int16) + 2
    lead = np.flatnonzero(np.concatenate(([True], sets[1:] != sets[:-1])))
    starts = np.concatenate((ends[lead] - lengths[lead] - 1, ends[-1:]))
    order = suffix_arrays(data, starts)
    order = order[ends[part_of[order]] - 1 - order >= LENGTH]  # suffixes that are whole windows
    new = np.ones(len(order), dtype=bool)
    for lo in range(1, len(order), 1 << 16):
        at = order[lo - 1 : lo + (1 << 16)]
        windows = data[at[:, None] + np.arange(LENGTH)]
        new[lo : lo + len(at) - 1] = (windows[1:] != windows[:-1]).any(1)
    new[1:] |= np.diff(sets[part_of[order]]) != 0
    runs = np.flatnonzero(new)
    found = np.empty(len(data), np.int64)
    found[order] = np.repeat(np.minimum.reduceat(owners[part_of[order]], runs), np.diff(np.append(runs, len(order))))
    whole = np.zeros(len(data), dtype=bool)
    whole[order] = True
    return found[whole]


# ---- blocks of windows ----------------------------------------------------------------------


def _sliding(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _runs(texts: list[bytes], ranges: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with the same least hash: text, first window, windows, hash, hash of the run's bytes.

    A hash is cut to 32 bits within its range, one of ``ranges``, which is the upper half of the number.
    """
    parts, names, offsets = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), PIECE):
            parts.append(t[at : at + PIECE + LENGTH - 1])
            names.append(i)
            offsets.append(at)
    names, offsets = np.array(names, dtype=np.int64), np.array(offsets, dtype=np.int64)
    found = []
    for lo, hi in text_chunks(parts, PIECE):
        data, starts = flatten(parts[lo:hi])
        prefix = prefix_hashes(data)
        at = np.arange(len(data) - GRAM + 1)
        least = _sliding(slice_hashes(prefix, at, at + GRAM), LENGTH - GRAM + 1)
        owner = np.repeat(np.arange(hi - lo), np.diff(starts))[: len(least)]
        valid = np.arange(len(least)) + LENGTH < starts[owner + 1]  # a 0 byte ends each text
        change = np.ones(len(least), dtype=bool)
        change[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(change)
        size = np.diff(np.append(first, len(least)))
        keep = valid[first]
        first, size = first[keep], size[keep]
        part, hashes = owner[first] + lo, least[first]
        own = slice_hashes(prefix, first, first + size + LENGTH - 1)
        found.append((names[part], first - starts[part - lo] + offsets[part], size, _short(hashes, ranges), own))
    if not found:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of ``sizes`` values as one binary each."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _rows(chunk: pa.Table) -> list[tuple[int | None, bytes]]:
    """The rows of a chunk as doc_id and bytes, in an order that every step sees alike; without doc_id last."""
    rows = zip(chunk.column("doc_id").to_pylist(), chunk.column("text").to_pylist(), strict=True)
    return sorted(((d, (t or "").encode("utf-8", "surrogatepass")) for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _owned(rows: list[tuple[int | None, bytes]]) -> tuple[np.ndarray, list[bytes]]:
    own = [r for r in rows if r[0] is not None]
    return np.array([d for d, _ in own], dtype=np.int64), [t for _, t in own]


def _messages(texts: DataFrame, ranges: int) -> DataFrame:
    """``range, chunk, hashes, blocks, marks``: a chunk's distinct hashes of a range (packed).

    ``blocks`` says how many blocks each has in the chunk (255 at most), ``marks`` has a checksum of one of them.
    """

    def run(chunk: pa.Table) -> pa.Table:
        _, own = _owned(_rows(chunk))
        _, _, _, hashes, names = _runs(own, ranges)
        order = np.lexsort((names, hashes))
        hashes, names = hashes[order], names[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        other = new.copy()
        other[1:] |= names[1:] != names[:-1]
        lead = np.flatnonzero(new)
        blocks = np.minimum(np.add.reduceat(other, lead, dtype=np.int64), 255).astype(np.uint8) if len(lead) else np.zeros(0, np.uint8)
        hashes, marks = hashes[lead], names[lead].astype(np.uint8)
        which = hashes >> 32
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(which)) + 1, [len(which)])) if len(which) else np.zeros(1, np.int64)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        short = hashes.astype(np.uint32)
        return pa.table(
            {
                "range": pa.array([int(which[a]) for a, _ in spans], pa.int64()),
                "chunk": pa.array([chunk.column("chunk")[0].as_py()] * len(spans), pa.int64()),
                "hashes": pa.array([short[a:b].tobytes() for a, b in spans], pa.binary()),
                "blocks": pa.array([blocks[a:b].tobytes() for a, b in spans], pa.binary()),
                "marks": pa.array([marks[a:b].tobytes() for a, b in spans], pa.binary()),
            }
        )

    return texts.groupBy("chunk").applyInArrow(run, "range long, chunk long, hashes binary, blocks binary, marks binary")


def _shared(messages: DataFrame) -> DataFrame:
    """``chunk, range, hashes, hot``: for each chunk, its hashes that another chunk has too, and which are hot."""

    def run(part: pa.Table) -> pa.Table:
        packed = [np.frombuffer(x, np.uint32) for x in part.column("hashes").to_pylist()]
        hashes = np.concatenate(packed)
        blocks, marks = (np.concatenate([np.frombuffer(x, np.uint8) for x in part.column(c).to_pylist()]) for c in ("blocks", "marks"))
        _, which, chunks = np.unique(hashes, return_inverse=True, return_counts=True)
        most, variants = np.zeros(len(chunks), np.uint8), np.zeros(len(chunks), np.int64)
        np.maximum.at(most, which, blocks)
        many = np.flatnonzero((np.bincount(which, weights=blocks) > HOT)[which])
        np.add.at(variants, np.unique(which[many] << 8 | marks[many]) >> 8, 1)
        hot = ((most > VARIANTS) | (variants > VARIANTS))[which].astype(np.uint8)
        several = (chunks > 1)[which]
        ends = np.cumsum([len(x) for x in packed])
        spans = [(e - len(x), e) for x, e in zip(packed, ends.tolist(), strict=True)]
        return pa.table(
            {
                "chunk": part.column("chunk"),
                "range": part.column("range"),
                "hashes": pa.array([hashes[a:b][several[a:b]].tobytes() for a, b in spans], pa.binary()),
                "hot": pa.array([hot[a:b][several[a:b]].tobytes() for a, b in spans], pa.binary()),
            }
        )

    return messages.groupBy("range").applyInArrow(run, "chunk long, range long, hashes binary, hot binary").where("hashes <> X''")


#: The arrays of a message and their kinds.
BLOCKS = {"keys": np.uint32, "sizes": np.uint16, "many": np.uint32, "bytes": np.uint8, "texts": np.uint32, "firsts": np.uint32, "docs": np.int64}


def _short(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """A hash's range in the upper half, and 32 bits of it in the lower."""
    return (((hashes >> np.uint64(32)) % np.uint64(ranges)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))).astype(np.int64)


def _hashed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of short slices, each by itself."""
    within = _spread(np.zeros(len(sizes), np.int64), sizes)
    values = BYTE_VALUES[data[_spread(starts, sizes)]] * powers(CUT + LENGTH)[within]
    return mix(np.add.reduceat(values, np.cumsum(sizes) - sizes))


def _gathered(
    data: np.ndarray, base: np.ndarray, docs: np.ndarray, ranges: int, text: np.ndarray, first: np.ndarray, size: np.ndarray, keys: np.ndarray, names: np.ndarray, step: np.ndarray, pieces: np.ndarray
) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """A range and the arrays of a message (see BLOCKS) for it, from runs of windows that are cut every ``step`` windows."""
    row = np.repeat(np.arange(len(text)), pieces)
    inner = _spread(np.zeros(len(text), np.int64), pieces) * step[row]
    text, first, names = text[row], first[row] + inner, names[row]
    size = np.minimum(size[row] - inner, step[row]) + LENGTH - 1
    starts = base[text] + first
    cut = np.flatnonzero(pieces[row] > 1)
    for lo in range(0, len(cut), 1 << 15):
        at = cut[lo : lo + (1 << 15)]
        names[at] = _hashed(data, starts[at], size[at])
    keys = np.where(step[row] == 1, _short(names, ranges), keys[row])
    # Equal blocks become one row; those whose names alone are equal stay apart.
    order = np.lexsort((names, keys))
    keys, names, starts, size, text, first = keys[order], names[order], starts[order], size[order], text[order], first[order]
    of = docs[text]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (names[1:] != names[:-1]) | (size[1:] != size[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    for lo in range(0, len(keys), 1 << 15):
        at = np.arange(lo, min(lo + (1 << 15), len(keys)))
        same = data[_spread(starts[at], size[at])] == data[_spread(starts[lead[at]], size[at])]
        new[at] |= ~np.minimum.reduceat(same, np.cumsum(size[at]) - size[at])
    lead = np.flatnonzero(new)
    many = np.diff(np.append(lead, len(keys)))
    keys = keys[lead]
    for at in np.split(np.arange(len(lead)), np.flatnonzero(np.diff(keys >> 32)) + 1):
        rows = slice(lead[at[0]], lead[at[-1]] + many[at[-1]])
        parts = [data[_spread(starts[lead[x]], size[lead[x]])] for x in np.array_split(at, len(at) // (1 << 15) + 1)]
        low = np.diff(keys[at] & 0xFFFFFFFF, prepend=0).astype(np.uint32)
        yield int(keys[at[0]] >> 32), (low, size[lead[at]].astype(np.uint16), many[at].astype(np.uint32), np.concatenate(parts), text[rows].astype(np.uint32), first[rows].astype(np.uint32), of[rows])


def _blocks(texts: DataFrame, shared: DataFrame, ranges: int) -> DataFrame:
    """``range, chunk, <BLOCKS>``: a chunk's distinct blocks with shared hashes, as compressed arrays sorted by key.

    ``many`` is how often each block occurs; ``texts``, ``firsts`` and ``docs`` have text, first window and document of
    each occurrence.
    """

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = {"range": pa.int64(), "chunk": pa.int64(), **{c: pa.binary() for c in BLOCKS}}
        docs, own = _owned(_rows(chunk)) if chunk.num_rows else (np.zeros(0, np.int64), [])
        text, first, size, hashes, names = _runs(own, ranges)
        if not len(text):
            return pa.table({c: pa.array([], k) for c, k in kinds.items()})
        spread = [(np.frombuffer(h, np.uint32).astype(np.int64) | r << 32, np.frombuffer(x, np.uint8)) for r, h, x in zip(*(answers.column(c).to_pylist() for c in ("range", "hashes", "hot")), strict=True)]
        known = np.concatenate([x for x, _ in spread]) if spread else np.zeros(0, np.int64)
        hot_known = np.concatenate([x for _, x in spread]) if spread else np.zeros(0, np.uint8)
        order = np.argsort(known)
        known, hot_known = known[order], hot_known[order]
        # Shared within the chunk, or with another one.
        order = np.lexsort((names, hashes))
        text, first, size, hashes, names = (x[order] for x in (text, first, size, hashes, names))
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        other = new.copy()
        other[1:] |= names[1:] != names[:-1]
        lead = np.flatnonzero(new)
        uniq, which = hashes[lead], np.cumsum(new) - 1
        wanted = np.minimum.reduceat(docs[text], lead) < np.maximum.reduceat(docs[text], lead)
        hot = np.add.reduceat(other, lead, dtype=np.int64) > VARIANTS
        if len(known):
            at = np.minimum(np.searchsorted(known, uniq), len(known) - 1)
            found = known[at] == uniq
            wanted |= found
            hot = np.where(found, hot_known[at] > 0, hot)
        pick = wanted[which]
        text, first, size, keys, names, hot = text[pick], first[pick], size[pick], hashes[pick], names[pick], hot[which][pick]
        # Hot ones become single windows, long ones are cut. Blocks of a hash are gathered together, bounded otherwise.
        step = np.where(hot, 1, CUT)
        pieces = -(-size // step)
        change = np.concatenate(([True], keys[1:] != keys[:-1]))
        part_of = np.maximum.accumulate(np.where(change, (np.cumsum(pieces) - pieces) // GATHER, 0))
        data = np.frombuffer(b"".join(own), np.uint8)
        base = np.concatenate(([0], np.cumsum([len(t) for t in own])))
        out: dict[str, list] = {c: [] for c in kinds}
        for at in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(part_of)) + 1) if len(keys) else ():
            for which_range, columns in _gathered(data, base, docs, ranges, text[at], first[at], size[at], keys[at], names[at], step[at], pieces[at]):
                for c, value in zip(kinds, (which_range, chunk.column("chunk")[0].as_py(), *(zstandard.compress(x.tobytes(), 1) for x in columns)), strict=True):
                    out[c].append(value)
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    ddl = "range long, chunk long, " + ", ".join(f"{c} binary" for c in BLOCKS)
    return texts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(run, ddl)


def _solved(messages: pa.Table) -> pa.Table:
    """Removed windows by chunk (see _removals), from all messages of a range."""
    read = {c: [np.frombuffer(zstandard.decompress(x), kind) for x in messages.column(c).to_pylist()] for c, kind in BLOCKS.items()}
    per = [len(x) for x in read["keys"]]
    key = np.concatenate([np.cumsum(x, dtype=np.int64) for x in read["keys"]])
    chunk = np.repeat(messages.column("chunk").to_numpy(), per)
    flat, length, many = (np.concatenate(read[c]).astype(t) for c, t in (("bytes", np.uint8), ("sizes", np.int64), ("many", np.int64)))
    text, first, docs = (np.concatenate(read[c]).astype(np.int64) for c in ("texts", "firsts", "docs"))
    owner = np.minimum.reduceat(docs, np.cumsum(many) - many)
    offset = np.cumsum(length) - length
    code = _packed(flat, length).dictionary_encode().indices.to_numpy()
    set_of = np.unique(key, return_inverse=True)[1]
    # Equal parts of a set are one class.
    order = np.lexsort((code, set_of))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (set_of[order][1:] != set_of[order][:-1]) | (code[order][1:] != code[order][:-1])
    lead = np.flatnonzero(new)
    class_of = np.empty(len(order), np.int64)
    class_of[order] = np.cumsum(new) - 1
    row_of, owners = order[lead], np.minimum.reduceat(owner[order], lead)
    classes = np.bincount(set_of[row_of])
    several = classes[set_of[row_of]] > 1  # one part alone needs no order
    volume = np.bincount(set_of[row_of], weights=length[row_of])
    pick = np.flatnonzero(several)
    pick = pick[np.lexsort((set_of[row_of[pick]], volume[set_of[row_of[pick]]]))]  # sets of like size advance together
    windows = length - LENGTH + 1
    least, least_at, smallest = np.zeros(0, np.int64), np.zeros(len(lead), np.int64), owners.copy()
    if len(pick):
        own = row_of[pick]
        parts = [least_owners(flat[_spread(offset[x], length[x])], length[x], set_of[x], owners[y]) for x, y in _batches(own, pick, set_of[own], length[own])]
        least = np.concatenate(parts)
        least_at[pick] = np.cumsum(windows[own]) - windows[own]
        smallest[pick] = np.minimum.reduceat(least, least_at[pick])
    holder = np.repeat(np.arange(len(owner)), many)
    other = docs > owner[holder]  # a smaller document of the chunk has the whole part
    # Of the smallest document's own places, what still smaller ones have: all windows, or runs of them.
    hit = np.flatnonzero(smallest[class_of] < owner)
    whole, mixed = hit[~several[class_of[hit]]], hit[several[class_of[hit]]]
    flags = least[_spread(least_at[class_of[mixed]], windows[mixed])] < np.repeat(owner[mixed], windows[mixed])
    begins = np.cumsum(windows[mixed]) - windows[mixed]
    step = np.zeros(len(flags) + 1, dtype=bool)
    step[begins] = step[-1] = True
    step[1:-1] |= flags[1:] != flags[:-1]
    edges = np.flatnonzero(step)
    edges, size = edges[:-1], np.diff(edges)
    begin, size = edges[flags[edges]], size[flags[edges]]
    at = np.searchsorted(begins, begin, "right") - 1
    row = np.concatenate((whole, mixed[at]))
    begin, size = np.concatenate((np.zeros(len(whole), np.int64), begin - begins[at])), np.concatenate((windows[whole], size))
    own_holder, own_text, own_first = holder[~other], text[~other], first[~other]
    count = np.bincount(own_holder, minlength=len(owner))
    start = np.cumsum(count) - count
    n = count[row]
    at = _spread(start[row], n)
    out_row = np.concatenate((holder[other], np.repeat(row, n)))
    spans = np.stack(
        [
            np.concatenate((text[other], own_text[at])),
            np.concatenate((first[other], own_first[at] + np.repeat(begin, n))),
            np.concatenate((windows[holder[other]], np.repeat(size, n))),
        ],
        1,
    )
    order = np.argsort(chunk[out_row], kind="stable")
    names, counts = np.unique(chunk[out_row], return_counts=True)
    cuts = np.split(spans[order], np.cumsum(counts)[:-1]) if len(names) else []
    return pa.table({"chunk": pa.array(names, pa.int64()), "spans": pa.array([zstandard.compress(x.tobytes(), 1) for x in cuts], pa.binary())})


def _batches(rows: np.ndarray, classes: np.ndarray, sets: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole sets, about BATCH bytes at a time."""
    lead = np.flatnonzero(np.concatenate(([True], sets[1:] != sets[:-1])))
    number = (np.cumsum(lengths) - lengths)[lead] // BATCH
    cuts = lead[np.flatnonzero(np.diff(number)) + 1]
    yield from zip(np.split(rows, cuts), np.split(classes, cuts), strict=True)


def _removals(blocks: DataFrame) -> DataFrame:
    """``chunk, spans``: removed windows as text, first window and windows (compressed), from the blocks of each range."""
    return blocks.groupBy("range").applyInArrow(_solved, "chunk long, spans binary")


def _cut(texts: DataFrame, removals: DataFrame) -> DataFrame:
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _rows(chunk) if chunk.num_rows else []
        spans = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(zstandard.decompress(x), np.int64).reshape(-1, 3) for x in answers.column("spans").to_pylist())])
        spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
        bounds = np.searchsorted(spans[:, 0], np.arange(len(rows) + 1))
        out = []
        for i, (doc, data) in enumerate(rows):
            merged: list[list[int]] = []
            for _, first, n in spans[bounds[i] : bounds[i + 1]].tolist():
                if merged and first <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], first + n - 1 + LENGTH)
                else:
                    merged.append([first, first + n - 1 + LENGTH])
            kept, at = [], 0
            for lo, hi in merged:
                kept.append(data[at:lo])
                at = hi
            rest = b"".join([*kept, data[at:]])
            out.append((doc, len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return texts.groupBy("chunk").cogroup(removals.groupBy("chunk")).applyInArrow(run, ddl)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row; ``kept`` holds the remaining bytes."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, ranges = max(1, size // CHUNK), min(max(1, size // RANGE), 1 << 31)
    number = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), number.alias("chunk"))
    texts = bucketed(texts, "chunk", min(max(1, -(-chunks // 2)), MAX_BUCKETS), "chunks")
    return _cut(texts, _removals(_blocks(texts, _shared(_messages(texts, ranges)), ranges)))
