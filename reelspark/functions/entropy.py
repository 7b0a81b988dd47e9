"""Entropy coding inside single values: an asymmetric range coder, pulse vectors, prefix trees.

These are functions of rows, run in Arrow batches. The coder keeps the interface of a
range coder (a symbol is an interval [low, high) of a total), with its own bit layout.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

FLOOR = 1 << 23  # the state stays in [FLOOR, FLOOR << 8)


def encode_symbols(symbols: list[tuple[int, int, int]]) -> bytes:
    """Bytes of intervals (low, high, total); totals up to 2^16. The first symbol is read first."""
    state, tail = FLOOR, bytearray()
    for low, high, total in reversed(symbols):
        size = high - low
        limit = (FLOOR // total << 8) * size
        while state >= limit:
            tail.append(state & 255)
            state >>= 8
        state = state // size * total + low + state % size
    return state.to_bytes(4, "big") + bytes(reversed(tail))


class Decoder:
    """Reads intervals back: ``peek(total)`` gives a number inside the next interval, ``take`` removes it."""

    def __init__(self, data: bytes):
        self.data, self.at, self.state = data, 4, int.from_bytes(data[:4], "big")

    def peek(self, total: int) -> int:
        return self.state % total

    def take(self, low: int, high: int, total: int) -> None:
        self.state = (high - low) * (self.state // total) + self.state % total - low
        while self.state < FLOOR and self.at < len(self.data):
            self.state = self.state << 8 | self.data[self.at]
            self.at += 1


def laplace_interval(value: int, decay: int, total: int = 32768) -> tuple[int, int, int]:
    """The interval of an integer under a two-sided geometric law; ``decay`` / 16384 is the ratio of neighbours.

    Every value within +-15 has at least one unit; larger ones are limited.
    """
    table = _laplace(decay, total)
    k = max(-15, min(15, value)) + 15
    return int(table[k]), int(table[k + 1]), total


@lru_cache(maxsize=4096)
def _laplace(decay: int, total: int) -> tuple[int, ...]:
    mass = np.array([(decay / 16384) ** abs(v) for v in range(-15, 16)])
    share = 1 + np.floor(mass / mass.sum() * (total - 31)).astype(int)
    share[15] += total - share.sum()
    return tuple(np.concatenate([[0], np.cumsum(share)]).tolist())


def laplace_value(number: int, decay: int, total: int = 32768) -> int:
    return int(np.searchsorted(_laplace(decay, total), number, "right")) - 16


@lru_cache(maxsize=65536)
def pulse_count(n: int, k: int) -> int:
    """Integer vectors of n values whose absolute values sum to k."""
    if k == 0:
        return 1
    if n == 0:
        return 0
    return pulse_count(n - 1, k) + pulse_count(n, k - 1) + pulse_count(n - 1, k - 1)


def _first_values(k: int):
    """Candidates of a coordinate in enumeration order: 0, 1, -1, 2, -2, ..."""
    yield 0
    for v in range(1, k + 1):
        yield v
        yield -v


def pulse_index(y: list[int]) -> int:
    """Rank of a pulse vector among those of its length and sum."""
    k, index = sum(map(abs, y)), 0
    for at, value in enumerate(y):
        for v in _first_values(k):
            if v == value:
                break
            index += pulse_count(len(y) - at - 1, k - abs(v))
        k -= abs(value)
    return index


def pulse_vector(index: int, n: int, k: int) -> list[int]:
    """The vector of a rank."""
    out = []
    for at in range(n):
        for v in _first_values(k):
            size = pulse_count(n - at - 1, k - abs(v))
            if index < size:
                out.append(v)
                k -= abs(v)
                break
            index -= size
    return out


def tree_codes(bits: str, width: int = 5) -> list[tuple[str, int]]:
    """(code, token) of a prefix tree written in pre-order: 0 for a fork, 1 and ``width`` bits for a leaf."""
    out, at = [], 0

    def walk(prefix: str):
        nonlocal at
        if len(prefix) > 32 or at >= len(bits):
            raise ValueError("the tree doesn't end")
        leaf = bits[at] == "1"
        at += 1
        if leaf:
            out.append((prefix, int(bits[at : at + width], 2)))
            at += width
        else:
            walk(prefix + "0")
            walk(prefix + "1")

    walk("")
    return sorted(out)


def tree_bits(codes: list[tuple[str, int]], width: int = 5) -> str:
    """The inverse of ``tree_codes`` for a complete prefix code."""
    here = [t for c, t in codes if not c]
    if here:
        return "1" + format(here[0], f"0{width}b")
    return "0" + "".join(tree_bits([(c[1:], t) for c, t in codes if c[0] == side], width) for side in "01")


def ungroup(code, base: int):
    """Three values of a grouped sample: digits of a number in a small base, lowest first."""
    return F.transform(F.array(F.lit(1), F.lit(base), F.lit(base * base)), lambda p: F.floor(code / p) % base)


def requantise(level, steps: int, scale):
    """A sample from its level among ``steps`` (odd): -1 to 1, times the scale factor."""
    return (2.0 * level + 1 - steps) / steps * scale


@pandas_udf(T.ArrayType(T.LongType()))
def coded_and_back(symbols: pd.Series, totals: pd.Series) -> pd.Series:
    """Symbols after a trip through the coder, one uniform interval each."""

    def trip(s, t):
        data = encode_symbols([(int(a), int(a) + 1, int(b)) for a, b in zip(s, t)])
        src, out = Decoder(data), []
        for b in map(int, t):
            v = src.peek(b)
            src.take(v, v + 1, b)
            out.append(v)
        return out

    return pd.Series([trip(s, t) for s, t in zip(symbols, totals)])


@pandas_udf(T.ArrayType(T.IntegerType()))
def pulses_and_back(y: pd.Series) -> pd.Series:
    """Pulse vectors after a trip through their index."""
    return pd.Series([pulse_vector(pulse_index(list(map(int, v))), len(v), int(np.abs(v).sum())) for v in y])
