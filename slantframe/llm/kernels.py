"""Vectorised byte kernels shared by the corpus operators.

Every function works on whole Arrow batches: the UTF-8 bytes of all texts of
a batch lie in one buffer, and per-text boundaries are an offset array.  Null
texts are empty texts.  Memory is bounded by ``CHUNK`` bytes of text (or by
the longest single text, whichever is larger), not by the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, wraps
from inspect import isgeneratorfunction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step works on.
CHUNK = 1 << 19



@cache
def _c_library():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library; nothing to give back there
        return None


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on after its task, beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    if _c_library() is not None:
        _c_library().malloc_trim(0)


def tidied(run: Callable) -> Callable:
    """run (over batches, a group's table, or two groups' tables), after which freed memory goes back to the system."""

    @wraps(run)
    def batches(rows):
        try:
            yield from run(rows)
        finally:
            give_back()

    @wraps(run)
    def group(table):
        try:
            return run(table)
        finally:
            give_back()

    @wraps(run)
    def pair(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return batches if isgeneratorfunction(run) else pair if run.__code__.co_argcount == 2 else group


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A second polynomial, modulo a prime: that modulo 2**64 is equal for some strings by their form alone.
PRIME = (1 << 31) - 1
_SMALL = 1_528_413_647
_SMALL_INVERSE = pow(_SMALL, -1, PRIME)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _fold(x: np.ndarray) -> np.ndarray:
    """Congruent to x modulo PRIME, and smaller."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _small_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:n]


class _Powers:
    """Powers of the bases and of their inverses, extended when a longer text needs them."""

    def __init__(self) -> None:
        self.up = self.down = self.small_up = self.small_down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> _Powers:
        if len(self.up) < n:
            n = max(n, 2 * CHUNK)
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
            self.small_up, self.small_down = _small_powers(_SMALL, n), _small_powers(_SMALL_INVERSE, n)
        return self


_POWERS = _Powers()


@dataclass
class Sums:
    """Prefix sums of both polynomials; one longer than what they sum up."""

    wide: np.ndarray
    small: np.ndarray

    def __len__(self) -> int:
        return len(self.wide)

    def hashes(self, starts, ends, wide_down: np.ndarray, small_down: np.ndarray) -> np.ndarray:
        small = _fold(_fold(self.small[ends] - self.small[starts])) * small_down
        return mix((self.wide[ends] - self.wide[starts]) * wide_down + _fold(_fold(small)) % np.uint64(PRIME) * np.uint64(0xC2B2AE3D27D4EB4F))


def value_sums(values: np.ndarray) -> Sums:
    """Of any 64-bit values."""
    return _sums(values, values % np.uint64(PRIME))


def _sums(wide: np.ndarray, small: np.ndarray) -> Sums:
    p = _POWERS.reach(len(wide) + 1)
    out = Sums(np.zeros(len(wide) + 1, dtype=np.uint64), np.zeros(len(wide) + 1, dtype=np.uint64))
    np.cumsum(wide * p.up[: len(wide)], out=out.wide[1:])
    np.cumsum(_fold(small * p.small_up[: len(wide)]), out=out.small[1:])
    return out


def byte_values(lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with lower, A-Z have the values of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    if lower:
        values[65:91] = values[97:123]
    return values


EXACT, LOWER = byte_values(False), byte_values(True)


def prefix_sums(data: np.ndarray, values: np.ndarray) -> Sums:
    """Of the values of bytes."""
    return _sums(values[data], (values % np.uint64(PRIME))[data])


def span_hashes(sums: Sums, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings data[start:end], wherever they lie."""
    p = _POWERS.reach(len(sums))
    return mix(sums.hashes(starts, ends, p.down[starts], p.small_down[starts]) + (ends - starts).astype(np.uint64))


def window_hashes(sums: Sums, k: int) -> np.ndarray:
    """Hashes of all k-byte windows, by start."""
    p, n = _POWERS.reach(len(sums)), len(sums) - k
    return sums.hashes(slice(0, n), slice(k, None), p.down[:n], p.small_down[:n])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about size bytes each; a longer text stands alone."""
    size = size or CHUNK
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(end, n)
        at = end


def white_space() -> np.ndarray:
    """Separators: the bytes 0x20 and 0x09 to 0x0D."""
    sep = np.zeros(256, dtype=bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    return sep


def not_alphanumeric() -> np.ndarray:
    """Separators: every ASCII byte that is neither a letter nor a digit."""
    sep = np.zeros(256, dtype=bool)
    sep[:128] = True
    for a, b in ((48, 58), (65, 91), (97, 123)):
        sep[a:b] = False
    return sep


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, values: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds, starts, ends): the words of each text of a chunk.

    data holds exactly the bytes from offsets[0] to offsets[-1]; words of text
    i are hashes[bounds[i]:bounds[i + 1]]; starts and ends are places in data.
    """
    local = offsets - offsets[0]
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), np.zeros(len(offsets), dtype=np.int64), none, none
    inside = ~sep[data]
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    cuts = local[:-1][local[:-1] < n]
    first[cuts] = True
    starts = np.flatnonzero(inside & first)
    last = np.empty(n, dtype=bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[cuts[cuts > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    hashes = span_hashes(prefix_sums(data, values), starts, ends)
    return hashes, np.searchsorted(starts, local), starts, ends


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; runs may cross texts, callers cut at bounds."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    if n == 1:
        return hashes
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for j in range(n):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[j : len(hashes) - n + 1 + j]
    return mix(out)


def shingle_sets(column: pa.Array, n: int, sep: np.ndarray) -> Iterator[np.ndarray]:
    """For each text its set of n-word shingles as sorted distinct hashes.

    A text of fewer words has its whole sequence as one shingle; a text
    without words has the empty set.
    """
    data, offsets = utf8(column)
    for a, b in chunks(offsets):
        hashes, bounds, _, _ = words(data[offsets[a] : offsets[b]], offsets[a : b + 1], sep)
        runs = shingles(hashes, n)
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if y - x >= n:
                found = np.sort(runs[x : y - n + 1])
                keep = np.empty(len(found), dtype=bool)
                keep[0] = True
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            elif y > x:
                one = np.uint64(y - x)
                for h in hashes[x:y]:
                    one = mix(np.array([one], dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25) + h)[0]
                yield np.array([one], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    out, span = x, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1]) if span < w else out
