"""Vectorised text kernels: words of many documents at once as NumPy arrays over their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LIMIT = 1 << 22
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: np.ndarray | None = None
_inverses: np.ndarray | None = None
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte value, the same in every process.
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64)

#: Bytes that separate words: ASCII white space and control characters.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[:33] = True


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if _powers is None or len(_powers) < n:
        size = max(n, _LIMIT)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _P, dtype=np.uint64))))
            _inverses = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, inverse, dtype=np.uint64))))
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


@dataclass
class Texts:
    """Bytes of some documents in one array; document i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """Null texts count as empty."""
        if column.null_count:
            column = pc.fill_null(column, "")
        if pa.types.is_large_string(column.type):
            kind = np.int64
        else:
            column, kind = column.cast(pa.string()), np.int32
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        if buffers[2] is None or not len(offsets):
            return cls(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
        data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        return cls(data, offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Runs of bytes: start and end in the data, and the document of each."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def runs(texts: Texts, inside: np.ndarray) -> Words:
    """The maximal runs where inside is true, cut at document borders."""
    n = len(texts.data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, empty)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    borders = texts.offsets[:-1]
    borders = borders[borders < n]
    before[borders] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    ends = texts.offsets[1:] - 1
    after[ends[ends >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(texts.offsets, start, side="right") - 1
    return Words(start, end, doc)


def split_long(texts: Texts, w: Words, long: int) -> tuple[Words, np.ndarray]:
    """w with one run for each character of those over long bytes; whether each run is followed by another of the same word."""
    if not len(w.start) or (w.end - w.start).max() <= long:
        return w, np.zeros(len(w.start), dtype=bool)
    wide = np.flatnonzero(w.end - w.start > long)
    mark = np.zeros(len(texts.data) + 1, dtype=np.int8)
    np.add.at(mark, w.start[wide], 1)
    np.add.at(mark, w.end[wide], -1)
    head = (np.cumsum(mark[:-1]) > 0) & ((texts.data & 0xC0) != 0x80)  # first bytes of characters
    head[w.start[wide]] = True
    keep = np.ones(len(w.start), dtype=bool)
    keep[wide] = False
    start = np.sort(np.concatenate((w.start[keep], np.flatnonzero(head))))
    stop = w.end[np.searchsorted(w.start, start, side="right") - 1]
    end = np.minimum(np.append(start[1:], len(texts.data)), stop)
    return Words(start, end, np.searchsorted(texts.offsets, start, side="right") - 1), end < stop


def words(texts: Texts, long: int = 0) -> Words:
    """White-space separated words. With long, a longer word becomes one run for each of its characters."""
    w = runs(texts, ~_SPACE[texts.data])
    return split_long(texts, w, long)[0] if long else w


def hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit hash of the bytes of each run."""
    if not len(w.start):
        return np.zeros(0, dtype=np.uint64)
    powers, inverses = _tables(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * powers[: len(data)], out=total[1:])
        return mix((total[w.end] - total[w.start]) * inverses[w.start] + (w.end - w.start).astype(np.uint64))


def by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of values for each of n documents."""
    return np.bincount(doc, weights=values, minlength=n)[:n]
