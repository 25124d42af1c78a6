"""Patterns and orders as bytes: little-endian unsigned 64-bit numbers, arrays led by their length."""

from __future__ import annotations

import struct

import numpy as np


class Broken(ValueError):
    """Bytes that hold no whole pattern or order."""


def _framed(values) -> bytes:
    return struct.pack("<Q", len(values)) + np.asarray(values, "<u8").tobytes()


def _take(data: bytes, at: int) -> tuple[np.ndarray, int]:
    if at + 8 > len(data):
        raise Broken("cut off before a length")
    (size,) = struct.unpack_from("<Q", data, at)
    stop = at + 8 + 8 * size
    if stop > len(data):
        raise Broken(f"cut off: {size} numbers announced")
    return np.frombuffer(data, "<u8", size, at + 8).astype(np.int64), stop


def pattern_bytes(n: int, col_at, rows) -> bytes:
    return struct.pack("<Q", n) + _framed(col_at) + _framed(rows)


def pattern_from(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    if len(data) < 8:
        raise Broken("cut off before n")
    (n,) = struct.unpack_from("<Q", data)
    col_at, at = _take(data, 8)
    rows, at = _take(data, at)
    if at != len(data):
        raise Broken(f"{len(data) - at} bytes too many")
    if len(col_at) != n + 1 or col_at[0] != 0 or col_at[-1] != len(rows):
        raise Broken("column starts do not fit")
    return n, col_at, rows


def pattern_sizes(file, size: int, at_once: int = 1 << 16) -> tuple[int, int]:
    """n and the number of rows of an open file of so many bytes, of which at_once column starts are held at a time."""

    def number(at: int, what: str) -> int:
        if at + 8 > size:
            raise Broken(f"cut off before {what}")
        return struct.unpack("<Q", file.read_at(8, at))[0]

    def array(at: int) -> tuple[int, int]:
        length = number(at, "a length")
        if at + 8 + 8 * length > size:
            raise Broken(f"cut off: {length} numbers announced")
        return length, at + 8 + 8 * length

    n = number(0, "n")
    starts, at = array(8)
    rows, end = array(at)
    if end != size:
        raise Broken(f"{size - end} bytes too many")
    before, fits = 0, starts == n + 1
    for first in range(0, starts if fits else 0, at_once):
        some = column_starts(file, first, min(first + at_once, starts))
        fits = fits and (first > 0 or some[0] == 0) and some[0] >= before and bool((np.diff(some) >= 0).all())
        before = some[-1]
    if not fits or before != rows:
        raise Broken("column starts do not fit")
    return n, rows


def column_starts(file, first: int, stop: int) -> np.ndarray:
    return np.frombuffer(file.read_at(8 * (stop - first), 16 + 8 * first), "<u8").astype(np.int64)


def column_rows(file, n: int, start: int, stop: int) -> np.ndarray:
    return np.frombuffer(file.read_at(8 * (stop - start), 32 + 8 * n + 8 * start), "<u8").astype(np.int64)


def order_bytes(order) -> bytes:
    return _framed(order)


def order_from(data: bytes) -> np.ndarray:
    order, at = _take(data, 0)
    if at != len(data):
        raise Broken(f"{len(data) - at} bytes too many")
    return order
