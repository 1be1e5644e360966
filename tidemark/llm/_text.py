"""Vectorised word handling on Arrow string columns (numpy, no per-word Python).

A batch is cut into pieces of about ``PIECE`` bytes (whole texts, so one very
long text is one piece). In a piece, words are (start, end) byte ranges, and
ranges get 64-bit hashes from one running polynomial sum over the bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE = 1 << 17
U = np.uint64
#: Odd multiplier of the running polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x.astype(U, copy=True)
    x += U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def returned(apply: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``apply`` for ``mapInArrow``; after its last row the worker, which Spark keeps for later tasks, gives the memory that it has freed back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from apply(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return run


BYTE = mix(np.arange(256))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 64)
        have = np.full(size, base, dtype=U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`range_hash` takes hashes of ranges."""
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end), wherever the range stands."""
    inverse = powers(INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U))


#: From so many bytes on, ranges of bytes are hashed by XXH64: a polynomial modulo 2**64 meets itself on some periodic ranges of 1,024 and more.
LONG = 512


def byte_hash(data: np.ndarray, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end); ``values`` maps bytes to numbers, and so may fold them.

    Equal for ranges that ``values`` makes equal, as long as it folds bytes only by A-Z to a-z.
    """
    out = range_hash(running(values[data]), start, end)
    long = np.flatnonzero(end - start >= LONG)
    if len(long):
        folded = LOWER[data] if values is LOWERED else data
        out[long] = [xxhash.xxh64_intdigest(folded[a:b].tobytes(), 7) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


#: Bytes of words [^\x20\x09-\x0D]+.
WORD = ~byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Maps A-Z to a-z and leaves other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The hash values of bytes, A-Z as a-z.
LOWERED = BYTE[LOWER]


def owners(places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each of the sorted places, the number of the last sorted start that is not beyond it."""
    first = np.searchsorted(places, starts)
    return np.repeat(np.arange(len(starts)), np.diff(np.append(first, len(places))))


class Piece:
    """Some whole texts: their bytes, and the offset at which each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def ranges(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of flagged bytes within one text: starts, ends, text numbers."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        opens = inside[turn]
        start, end = turn[opens], turn[~opens]
        if inside[0]:
            start = np.concatenate([[0], start])
        if inside[-1]:
            end = np.concatenate([end, [n]])
        # a run that goes on over the border of two texts is cut there
        border = np.unique(self.offsets[(self.offsets > 0) & (self.offsets < n)])
        border = border[inside[border - 1] & inside[border]]
        if len(border):
            start, end = np.sort(np.concatenate([start, border]), kind="stable"), np.sort(np.concatenate([end, border]), kind="stable")
        return start, end, owners(start, self.offsets[:-1])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All lines between line feeds, empty ones too: starts, ends, text numbers."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        end = np.sort(np.concatenate([self.offsets[1:], breaks]), kind="stable")
        count = self.per_text(self.data == 10) + 1
        return start, end, np.repeat(np.arange(self.n), count)


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[Piece]:
    """The column's texts in order, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        own = offsets[at : to + 1]
        yield Piece(data[own[0] : own[-1]], (own - own[0]).astype(np.int64), at)
        at = to


def windows(hashes: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of windows of ``k`` consecutive words of one text, and their hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    return at, range_hash(running(hashes), at, at + k)


COUNTS = "key long, n long"


def counted(keys: Iterator[np.ndarray], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Counts of keys, merged while they fit into ``most`` entries, which bounds a task's memory."""
    total, held, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate([total[0], *[x[0] for x in held]])
        unique, where = np.unique(key, return_inverse=True)
        return unique, np.bincount(where, weights=np.concatenate([total[1], *[x[1] for x in held]]), minlength=len(unique)).astype(np.int64)

    for some in keys:
        held.append(np.unique(some, return_counts=True))
        size += len(held[-1][0])
        if size > most:
            total, held, size = merged(), [], 0
            if len(total[0]) > most:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in total], ["key", "n"])
                total = (total[0][:0], total[1][:0])
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["key", "n"])
