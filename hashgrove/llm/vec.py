"""Vectorised views of Arrow text columns: bytes, code points, spans and Karp-Rabin hashes.

Operators that need Python read Arrow batches and work on numpy arrays over the concatenated UTF-8 bytes of some
documents. ``pieces`` bounds how much is held at once: about ``PIECE`` bytes, or one document if it is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_MIX = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of the hash base and of its inverse, modulo 2**64."""
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(n + 1, PIECE + 1)
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps[1:] = pow(_BASE, -1, 1 << 64)
        _inverse = np.cumprod(steps)
    return _powers, _inverse


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string or binary column; a null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, last + 1, bytes, offsets) of about ``most`` bytes; long rows come alone."""
    data, offsets = buffers(column)
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of members; a run never crosses a document's bounds."""
    n = len(member)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = member[:-1]
    starts = np.flatnonzero(member & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = member[1:]
    ends = np.flatnonzero(member & (~after | edge[1:])) + 1
    return starts, ends


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each document, how many of the ascending ``starts`` come before it, and all of them at the end."""
    return np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of byte spans, the same for the same bytes wherever they stand."""
    power, inverse = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_MIX[data] * power[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``length`` consecutive unsigned values."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mixed((total[length:] - total[:n]) * inverse[:n] + np.uint64(length))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0] + counts[0] - 1, starts[1] .. and so on."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total, dtype=np.int64)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the byte position of each (one more at the end), and document offsets in code points."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(points) + 1, np.int64)
    if len(points) == len(data):
        at[1:] = np.arange(1, len(points) + 1)
        return points, at, offsets
    np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF), out=at[1:])
    return points, at, np.searchsorted(at, offsets)
