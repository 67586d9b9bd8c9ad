"""CRC-32 of joined byte strings from those of their parts, and words of Arrow text columns by a separator pattern.

Appending bytes to a string changes its CRC-32 by a linear map of the old value, which depends on the number of bytes only. The
maps of 0 .. 63 bytes, and of 64, 128, 256 ... bytes, are tables of four bytes' images, so the CRC-32 of many joined strings is worked out on arrays.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_DIRECT = 64
_POLYNOMIAL = 0xEDB88320


def _applied(images: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The linear map with these images of single bytes (4 x 256), on each value."""
    return images[0][values & 0xFF] ^ images[1][values >> 8 & 0xFF] ^ images[2][values >> 16 & 0xFF] ^ images[3][values >> 24]


@functools.cache
def _maps() -> tuple[np.ndarray, list[np.ndarray]]:
    """Images for 0 .. 63 appended bytes, and for 64, 128 ... 2**31."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = byte >> 1 ^ np.where(byte & 1, np.uint32(_POLYNOMIAL), np.uint32(0))
    images = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    direct = []
    for _ in range(_DIRECT):
        direct.append(images)
        images = images >> 8 ^ byte[images & 0xFF]
    doubled = [images]
    while len(doubled) < 26:
        doubled.append(_applied(doubled[-1], doubled[-1]))
    return np.stack(direct), doubled


def append(first: np.ndarray, more: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings: ``first`` of the left ones, ``more`` of the right ones, which have ``sizes`` bytes."""
    direct, doubled = _maps()
    low = sizes % _DIRECT
    moved = direct[low, 0, first & 0xFF] ^ direct[low, 1, first >> 8 & 0xFF] ^ direct[low, 2, first >> 16 & 0xFF] ^ direct[low, 3, first >> 24]
    high = sizes // _DIRECT
    for bit, images in enumerate(doubled):
        if not (high >> bit).any():
            break
        some = np.flatnonzero(high >> bit & 1)
        moved[some] = _applied(images, moved[some])
    return moved ^ more


def of_strings(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and byte length of each string."""
    sizes = pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.fromiter(map(zlib.crc32, strings.cast(pa.binary()).to_pylist()), np.uint32, len(strings)), sizes


def words(texts: pa.Array, separators: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between matches of ``separators`` in the texts, with A-Z in lower case.

    Returns the different words, the index of each word in order, and the bounds of each text's words (one more than texts).
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), pattern=separators)
    encoded = pc.list_flatten(lists).dictionary_encode()
    found = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
    blank = pc.index(encoded.dictionary, "").as_py()
    if blank >= 0:  # before a first and behind a last separator
        full = found != blank
        found, bounds = found[full], np.concatenate([[0], np.cumsum(full)])[bounds]
    return encoded.dictionary, found, bounds
