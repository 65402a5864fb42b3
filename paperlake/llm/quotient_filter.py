"""Counting quotient filters over packed n-grams of word ids: lossless, sorted, mergeable.

A key is up to three ids of ``bits`` bits each, held as (left, right): the first two ids and the third. An invertible
permutation spreads keys evenly; the upper bits of a permuted key are its quotient, all others its remainder, so
nothing is lost and a key can be read back. A filter keeps its entries sorted. For each quotient it holds how many
remainders there are (in unary: a one for each entry, a zero at the end of each quotient), the remainders in as few
bytes as they need, and a byte for each counter, with counters of 255 and more in full behind them.
"""

from __future__ import annotations

import struct

import numpy as np

from paperlake.llm.textbytes import mix

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FULL = 255


def _masks(bits: int) -> tuple[np.uint64, np.uint64]:
    return np.uint64((1 << 2 * bits) - 1), np.uint64((1 << bits) - 1)


def permute(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of all pairs of a ``2 * bits``-bit and a ``bits``-bit number (``bits`` is 32 at most)."""
    both, one = _masks(bits)
    right = (right + mix(left)) & one
    left = (left + mix(right ^ _ODD)) & both
    left = (left * _ODD) & both
    left = left ^ (left >> np.uint64(bits))
    left = (left * _ODD) & both
    return left, right


def restore(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``permute``."""
    both, one = _masks(bits)
    left = (left * _ODD_INVERSE) & both
    left = left ^ (left >> np.uint64(bits))
    left = (left * _ODD_INVERSE) & both
    left = (left - mix(right ^ _ODD)) & both
    right = (right - mix(left)) & one
    return left, right


def counted(left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(left):
        return left, right, counts
    order = np.lexsort((right, left))
    left, right, counts = left[order], right[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    return left[first], right[first], np.add.reduceat(counts, first)


def _narrow(values: np.ndarray, width: int) -> bytes:
    """The lowest bytes of each value, as many as ``width`` bits need."""
    size = (width + 7) // 8
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _widen(data: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    size = (width + 7) // 8
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(data, dtype=np.uint8, count=n * size, offset=at).reshape(n, size)
    return out.reshape(-1).view("<u8").astype(np.uint64), at + n * size


def pack(left: np.ndarray, right: np.ndarray, counts: np.ndarray, bits: int, fixed: int) -> bytes:
    """A filter of distinct permuted keys in order; all agree in their first ``fixed`` bits, which are not stored."""
    n = len(left)
    quotient_bits = min(max(n - 1, 1).bit_length(), 2 * bits - fixed)
    rest = 2 * bits - fixed - quotient_bits
    quotient = ((left >> np.uint64(rest)) & np.uint64((1 << quotient_bits) - 1)).astype(np.int64)
    marks = np.zeros(n + (1 << quotient_bits), dtype=np.uint8)
    marks[quotient + np.arange(n)] = 1
    large = counts[counts >= _FULL].astype("<i8")
    parts = [
        struct.pack("<IBBB", n, quotient_bits, bits, fixed),
        np.packbits(marks).tobytes(),
        _narrow(left & np.uint64((1 << rest) - 1), rest),
        _narrow(right, bits),
        np.minimum(counts, _FULL).astype(np.uint8).tobytes(),
        large.tobytes(),
    ]
    return b"".join(parts)


def unpack(data: bytes, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys and counts of a filter; ``prefix`` is the value of the first bits that were not stored."""
    n, quotient_bits, bits, fixed = struct.unpack_from("<IBBB", data)
    at, slots = 7, n + (1 << quotient_bits)
    size = (slots + 7) // 8
    marks = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=size, offset=at), count=slots)
    quotient = (np.flatnonzero(marks) - np.arange(n)).astype(np.uint64)
    rest = 2 * bits - fixed - quotient_bits
    low, at = _widen(data, at + size, n, rest)
    right, at = _widen(data, at, n, bits)
    counts = np.frombuffer(data, dtype=np.uint8, count=n, offset=at).astype(np.int64)
    counts[counts == _FULL] = np.frombuffer(data, dtype="<i8", offset=at + n)
    high = (np.uint64(prefix) << np.uint64(quotient_bits)) | quotient if fixed else quotient
    return (high << np.uint64(rest)) | low if rest else high, right, counts
