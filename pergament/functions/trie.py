"""Many terms looked for in many lines at once: a trie of bytes, walked from all places of a buffer together.

A node of two bytes is their code; a deeper one lies in an open table under its parent and
its byte, and its slot is its number. Keys are compared whole, so a walk is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PAIRS = 1 << 16
WINDOW = 1 << 18  # places that are walked at once, so that their arrays stay in the cache
GOLD = np.uint64(0x9E3779B97F4A7C15)


class Trie(NamedTuple):
    one: np.ndarray  # term of a single byte, -1 for none
    pairs: np.ndarray  # whether any term begins with these two bytes
    keys: np.ndarray  # the open table
    term: np.ndarray  # term that ends at a node, -1 for none
    n: int  # number of terms


def packed(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, sizes) of the values of a binary column without nulls."""
    values = (pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)) if isinstance(column, pa.ChunkedArray) else column
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(values.type) else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return whole, ends[:-1] - ends[0], np.diff(ends)


def slots(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    bits = len(table).bit_length() - 1
    return ((keys.astype(np.uint64) * GOLD) >> np.uint64(64 - bits)).astype(np.int64)


def put(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places keys that are not there yet, each at the next free slot."""
    at, rest, free = slots(keys, table), np.arange(len(keys)), table.dtype.type(-1 % (1 << 8 * table.itemsize))
    while len(rest):
        able = rest[table[at[rest]] == free]
        winners = able[np.unique(at[able], return_index=True)[1]]
        table[at[winners]] = keys[winners]
        rest = rest[table[at[rest]] != keys[rest]]
        at[rest] = (at[rest] + 1) & (len(table) - 1)
    return at


def look_up(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, whether the key is there)."""
    at, free = slots(keys, table), table.dtype.type(-1 % (1 << 8 * table.itemsize))
    got = table.take(at)
    there = got == keys
    rest = np.flatnonzero(~there & (got != free))
    while len(rest):
        at[rest] = (at[rest] + 1) & (len(table) - 1)
        got, want = table[at[rest]], keys[rest]
        there[rest] = got == want
        rest = rest[(got != want) & (got != free)]
    return at, there


def grown(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Trie:
    """The trie of distinct terms of one byte or more: ``sizes`` bytes of ``data`` from ``starts`` on."""
    one, pairs, short = np.full(256, -1, np.int32), np.zeros(PAIRS, bool), np.flatnonzero(sizes == 1)
    one[data[starts[short]]] = short
    longer = np.flatnonzero(sizes >= 2)
    node = data[starts[longer]].astype(np.int64) * 256 + data[starts[longer] + 1]
    pairs[node] = True
    # nodes of each depth by numbers in their own order, to know how many there are
    levels, own, depth, left = [], node, 2, longer
    while True:
        more = sizes[left] > depth
        own, left = own[more], left[more]
        if not len(left):
            break
        edges, own = np.unique(own * 256 + data[starts[left] + depth], return_inverse=True)
        levels.append((edges, left, own))
        depth += 1
    size = 1 << max(4, (2 * sum(len(e) for e, _, _ in levels)).bit_length())
    keys = np.full(size, -1 % (1 << 32), np.uint32) if PAIRS + size < 1 << 24 else np.full(size, -1 % (1 << 64), np.uint64)
    term = np.full(PAIRS + size, -1, np.int32)
    term[node[sizes[longer] == 2]] = longer[sizes[longer] == 2]
    above = np.arange(PAIRS)
    for depth, (edges, left, own) in enumerate(levels, 3):
        above = PAIRS + put((above[edges >> 8] * 256 + (edges & 255)).astype(keys.dtype), keys)
        done = sizes[left] == depth
        term[above[own[done]]] = left[done]
    return Trie(one, pairs, keys, term, len(sizes))


def walked(trie: Trie, data: np.ndarray, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, terms that stand there) of the places from ``begin`` to ``end``, by length. Data ends with a byte that no term has."""
    here = data[begin:end]
    at = np.flatnonzero(trie.one[here] >= 0)
    if len(at):
        yield at + begin, trie.one[here[at]]
    pair = here[:-1].astype(np.int64) * 256 + here[1:] if end == len(data) else here.astype(np.int64) * 256 + data[begin + 1 : end + 1]
    at = np.flatnonzero(trie.pairs.take(pair))
    node, at, depth = pair[at], at + begin, 2
    while len(at):
        term = trie.term.take(node)
        hit = np.flatnonzero(term >= 0)
        if len(hit):
            yield at[hit], term[hit]
        key = ((node << 8) | data.take(at + depth)).astype(trie.keys.dtype)
        slot, there = look_up(key, trie.keys)
        stays = np.flatnonzero(there)
        node, at, depth = slot[stays] + PAIRS, at[stays], depth + 1


def held(trie: Trie, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first line, number of terms of each line, their terms) for runs of lines that end at ``ends``; a term counts once a line.

    Each line ends with a byte that no term has. A run is a window or one line of many windows.
    """
    first, n = 0, len(ends)
    while first < n:
        begin = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begin + WINDOW, "right")))
        end = int(ends[last - 1])
        line = np.repeat(np.arange(last - first), np.diff(ends[first:last], prepend=begin))
        found = [np.zeros(0, np.int64)]
        for x in range(begin, end, WINDOW):
            hits = [line[at - begin] * trie.n + term for at, term in walked(trie, data, x, min(x + WINDOW, end))]
            found.append(single(hits))
        keys = found[-1] if len(found) <= 2 else single(found)
        yield first, np.bincount(keys // max(trie.n, 1), minlength=last - first), keys % max(trie.n, 1)
        first = last


def single(keys: list[np.ndarray]) -> np.ndarray:
    """Distinct keys in order."""
    all_ = np.sort(np.concatenate([np.zeros(0, np.int64), *keys]))
    return all_[np.concatenate([[True], all_[1:] != all_[:-1]])] if len(all_) else all_
