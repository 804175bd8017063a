"""Columnar text measurements: words, lines and hashes of a whole Arrow batch at once, in numpy.

The texts of a block lie in one byte array; every measure is a vector operation over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Longest span whose hash is a polynomial.
SHORT = 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class TextBlock:
    """Texts first to last of a batch as one byte array with offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._prefix = self._prefix_lower = None

    @classmethod
    def of(cls, texts: list[str | None]) -> TextBlock:
        return next(blocks(pa.array(texts, pa.string()), 1 << 40))[2]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array over each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.float64 if flags.dtype.kind == "f" else np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of byte spans: of short ones a polynomial taken from prefix sums, scrambled with the length; of others XXH64.

        Polynomials modulo a power of two make different long spans equal (such as a Thue-Morse word and its complement).
        """
        powers, inverse = _power_tables(len(self.data) + 1)
        name = "_prefix_lower" if lower else "_prefix"
        prefix = getattr(self, name)
        if prefix is None:
            data = _LOWER[self.data] if lower else self.data
            prefix = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=prefix[1:])
            setattr(self, name, prefix)
        out = mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        for i in np.flatnonzero(ends - starts > SHORT):
            span = self.data[starts[i] : ends[i]]
            out[i] = xxhash.xxh64_intdigest((_LOWER[span] if lower else span).tobytes())
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each word."""
        inside = ~_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate(([True], ~inside[:-1])) if len(inside) else inside
        after = np.concatenate((~inside[1:], [True])) if len(inside) else inside
        starts = np.flatnonzero(inside & (before | edge[:-1]))
        ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Start, end and text number of each piece between \n characters."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate((self.offsets[:-1], breaks + 1)))
        ends = np.sort(np.concatenate((breaks, self.offsets[1:])))
        counts = 1 + np.diff(np.searchsorted(breaks, self.offsets))
        return starts, ends, np.repeat(np.arange(self.n), counts)


def blocks(column: pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int, TextBlock]]:
    """(first row, end row, block) of a string column; null is empty; a long text stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        end = min(end, len(column))
        yield at, end, TextBlock(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def repeated_window_words(hashes: np.ndarray, owner: np.ndarray, n: int, width: int = 8) -> np.ndarray:
    """Per text: words covered by windows of `width` words found twice or more in that text."""
    m = len(hashes) - width + 1
    if m <= 0:
        return np.zeros(n, np.int64)
    key = np.zeros(m, np.uint64)
    for i in range(width):
        key = key * np.uint64(_BASE) + hashes[i : i + m]
    key = mix(key) ^ mix(owner[:m].astype(np.uint64) + np.uint64(0x51ED27))
    at = np.flatnonzero(owner[:m] == owner[width - 1 :])
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    hit = order[twice] if len(order) else order
    step = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + width, -1)
    return np.bincount(owner[np.cumsum(step[:-1]) > 0], minlength=n)


def duplicate_lines(block: TextBlock, word_starts: np.ndarray) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line of it."""
    starts, ends, owner = block.lines()
    full = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    key = block.span_hash(starts[full], ends[full])
    owner = owner[full]
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    again = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][again], minlength=block.n)
