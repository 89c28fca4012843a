"""Texts of Arrow columns as bytes: rows, words and fixed patterns without a Python object per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text looked at together; longer rows come alone.
BYTES_AT_ONCE = 256 * 1024

_WORD = np.zeros(256, dtype=bool)
_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True


# The first bytes of eight, by how many they are.
_MASKS = np.array([(1 << (8 * size)) - 1 for size in range(9)], dtype=np.uint64)


def _mixed(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    return (heads ^ (heads >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + tails * np.uint64(0xC2B2AE3D27D4EB4F)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the edges of its rows; a null is an empty row."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets, data = column.buffers()[1:]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def runs_of_rows(edges: np.ndarray, size: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Consecutive rows ``[low, high)`` of about ``size`` bytes."""
    low, n = 0, len(edges) - 1
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(edges, edges[low] + size, "right")) - 1))
        yield low, high
        low = high


def bounded(batches: Iterator[pa.Array], size: int = BYTES_AT_ONCE) -> Iterator[pa.Array]:
    """Text columns in pieces of about ``size`` bytes; an empty column stays one.

    Workers are used again by later stages, so Arrow's unused memory goes back at the end.
    """
    for column in batches:
        for low, high in runs_of_rows(utf8(column)[1], size) if len(column) else [(0, 0)]:
            yield column.slice(low, high - low)
    column = None
    pa.default_memory_pool().release_unused()


def words(body: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Runs of a-z and 0-9 in order: how many a row has, and the words."""
    held = _WORD[body]
    first, last = held.copy(), held.copy()
    first[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    inner = edges[(edges > 0) & (edges < len(body))]
    first[inner] = held[inner]
    last[inner - 1] = held[inner - 1]
    starts = np.flatnonzero(first)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(last) - starts + 1, out=offsets[1:])
    many = np.diff(np.searchsorted(starts, edges))
    return many, pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(body[held]))


class WordNumbers:
    """Numbers of words, looked up for a column of words at once.

    A table under a hash of the first sixteen bytes holds words that were seen; where
    it has another word, a longer one or none, ``number`` is asked and the table
    takes the word.
    """

    def __init__(self, number: Callable[[str], int], bits: int = 18):
        self.number, self.bits = number, bits
        self.head, self.tail = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.value = np.zeros(1 << bits, np.int32)

    def of(self, names: pa.StringArray) -> np.ndarray:
        """The number of every word; words are no nulls, and hold no zero bytes."""
        body, edges = utf8(names)
        sizes = np.diff(edges)
        padded = np.concatenate([body, np.zeros(16, np.uint8)])
        eights = np.lib.stride_tricks.as_strided(padded, (len(body) + 9, 8), (1, 1))
        first = eights[edges[:-1]].view("<u8").ravel() & _MASKS[np.minimum(sizes, 8)]
        second = np.zeros(len(names), np.uint64)
        more = np.flatnonzero(sizes > 8)
        second[more] = eights[edges[more] + 8].view("<u8").ravel() & _MASKS[np.minimum(sizes[more] - 8, 8)]
        place = _mixed(first, second) >> np.uint64(64 - self.bits)
        out = self.value[place]
        new = np.flatnonzero((self.head[place] != first) | (self.tail[place] != second) | (sizes > 16))
        if len(new):
            coded = names.take(pa.array(new)).dictionary_encode()
            out[new] = np.array([self.number(w) for w in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy()]
            keep = new[sizes[new] <= 16]
            keep = keep[np.unique(place[keep], return_index=True)[1]]  # one word per place
            self.head[place[keep]], self.tail[place[keep]], self.value[place[keep]] = first[keep], second[keep], out[keep]
        return out


def has_lead(body: np.ndarray, low: int, high: int) -> bool:
    """Whether a character starts with a byte from ``low`` to ``high`` (above 0xBF)."""
    return bool(((body >= low) & (body <= high)).any())


class Holders:
    """Finds the rows of a text column that hold any of many strings.

    A bit table of the first eight bytes passes over the text once; places that it
    lets through are looked up by sixteen bytes, and a search in the row settles them.
    """

    def __init__(self, strings: list[str]):
        self.strings = [s.encode() for s in dict.fromkeys(strings) if s]
        raw = np.frombuffer(b"".join(s[:16].ljust(16, b"\0") for s in self.strings), "<u8").reshape(-1, 2)
        sizes = np.array([min(len(s), 16) for s in self.strings], dtype=np.int64)
        self.by_size = []
        for size in np.unique(np.minimum(sizes, 8)).tolist():
            mine = np.flatnonzero(np.minimum(sizes, 8) == size)
            bits = int(mine.size).bit_length() + 8
            seen = np.zeros(1 << bits, dtype=bool)
            seen[self._place(raw[mine, 0], bits)] = True
            tails = []
            for tail in np.unique(sizes[mine] - size).tolist():
                numbers = mine[sizes[mine] - size == tail]
                keys = _mixed(raw[numbers, 0], raw[numbers, 1])
                order = np.argsort(keys, kind="stable")
                tails.append((_MASKS[tail], keys[order], numbers[order]))
            self.by_size.append((_MASKS[size], seen, bits, tails))

    @staticmethod
    def _place(heads: np.ndarray, bits: int) -> np.ndarray:
        return (heads * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    def rows(self, column: pa.Array) -> tuple[list[int], list[str]]:
        """Distinct pairs of row and string, for every string that is part of the row's text."""
        body, edges = utf8(column)
        out_rows, out_strings = [], []
        for low, high in runs_of_rows(edges):
            for row, i in self._candidates(body[edges[low] : edges[high]], edges[low : high + 1] - edges[low]):
                if self.strings[i] in body[edges[low + row] : edges[low + row + 1]].tobytes():
                    out_rows.append(low + row)
                    out_strings.append(self.strings[i].decode())
        return out_rows, out_strings

    def _candidates(self, body: np.ndarray, edges: np.ndarray) -> list[tuple[int, int]]:
        """Distinct pairs of row and number of a string whose first bytes seem to be there."""
        padded = np.concatenate([body, np.zeros(24, np.uint8)])
        pairs = []
        for shift in range(8):
            windows = padded[shift : shift + (len(body) + 15) // 8 * 8].view("<u8")
            for mask, seen, bits, tails in self.by_size:
                at = np.flatnonzero(seen[self._place(windows[:-1] & mask, bits)])
                for tail, keys, numbers in tails if len(at) else ():
                    key = _mixed(windows[at] & mask, windows[at + 1] & tail)
                    left, right = (np.searchsorted(keys, key, side) for side in ("left", "right"))
                    many = right - left
                    place = np.repeat(at * 8 + shift, many)
                    which = np.repeat(left, many) + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
                    held = place < len(body)
                    pairs.append(np.stack([np.searchsorted(edges, place[held], "right") - 1, numbers[which[held]]], axis=1))
        return [tuple(p) for p in np.unique(np.concatenate(pairs), axis=0).tolist()] if pairs else []
