"""Expressions on BINARY columns: fields, escapes, ids, checksums and bits.

A byte string is handled as ISO-8859-1 text where a string function is needed, which
maps each byte to one character and back.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def field(data: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """Unsigned integer of ``size`` bytes (at most 7) from 0-based offset ``at``; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    parts = [F.hex(F.substring(data, at + 1 + k, F.lit(1))) for k in range(size)]
    text = F.concat(*(parts[::-1] if little else parts))
    return F.when(F.length(data) >= at + size, F.conv(text, 16, 10).cast("long"))


def to_bytes(value: Column, size: int, little: bool = False) -> Column:
    """BINARY of an unsigned integer."""
    text = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    if little:
        text = F.concat(*(F.substring(text, 2 * k + 1, 2) for k in range(size - 1, -1, -1)))
    return F.unhex(text)


def bits(value: Column, first: int, count: int, width: int) -> Column:
    """``count`` bits of a ``width``-bit number, from bit ``first`` counted from the top."""
    return F.shiftrightunsigned(value, width - first - count).bitwiseAND((1 << count) - 1)


def escape(data: Column) -> Column:
    """Put FE behind every 00 00 01, so that no start code stands in a payload."""
    return F.encode(F.regexp_replace(F.decode(data, "ISO-8859-1"), "\x00\x00\x01", "\x00\x00\x01þ"), "ISO-8859-1")


def unescape(data: Column) -> Column:
    """Take out the FE behind 00 00 01."""
    return F.encode(F.regexp_replace(F.decode(data, "ISO-8859-1"), "\x00\x00\x01þ", "\x00\x00\x01"), "ISO-8859-1")


def meta_id(text: Column) -> Column:
    """Up to eight characters as 8 bytes, filled with zero bytes."""
    return F.encode(F.rpad(F.substring(text, 1, 8), 8, "\x00"), "ISO-8859-1")


def meta_text(data: Column) -> Column:
    """The characters of a metaID, without the zero bytes at its end."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), "\x00+$", "")


_MIRROR = bytes(int(format(b, "08b")[::-1], 2) for b in range(256))


def page_crc_bytes(data: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, not reflected, from 0.

    It is the mirror image of the usual CRC over mirrored bytes, without that one's
    inversions, so the standard library computes it.
    """
    mirrored = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


@pandas_udf(T.LongType())
def page_crc(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else page_crc_bytes(bytes(d))).astype("Int64")


def pack_values(values: list[int], widths: list[int], msb: bool) -> bytes:
    """Bit-pack numbers, least or most significant bit first; the last byte is filled with zeros."""
    acc = used = 0
    for v, w in zip(values, widths):
        v &= (1 << w) - 1
        acc = (acc << w) | v if msb else acc | (v << used)
        used += w
    size = -(-used // 8)
    return (acc << (8 * size - used)).to_bytes(size, "big") if msb else acc.to_bytes(size, "little")


def unpack_values(data: bytes, widths: list[int], msb: bool) -> list[int]:
    """The inverse of ``pack_values``; -1 for a number that reaches beyond the end."""
    acc, total, at, out = int.from_bytes(data, "big" if msb else "little"), 8 * len(data), 0, []
    for w in widths:
        if at + w > total:
            out.append(-1)
            at = total
            continue
        out.append((acc >> (total - at - w) if msb else acc >> at) & ((1 << w) - 1))
        at += w
    return out


@pandas_udf(T.BinaryType())
def pack_lsb(values: pd.Series, widths: pd.Series) -> pd.Series:
    return pd.Series([pack_values(list(map(int, v)), list(map(int, w)), False) for v, w in zip(values, widths)])


@pandas_udf(T.BinaryType())
def pack_msb(values: pd.Series, widths: pd.Series) -> pd.Series:
    return pd.Series([pack_values(list(map(int, v)), list(map(int, w)), True) for v, w in zip(values, widths)])


@pandas_udf(T.ArrayType(T.LongType()))
def unpack_lsb(data: pd.Series, widths: pd.Series) -> pd.Series:
    return pd.Series([unpack_values(bytes(d), list(map(int, w)), False) for d, w in zip(data, widths)])


@pandas_udf(T.ArrayType(T.LongType()))
def unpack_msb(data: pd.Series, widths: pd.Series) -> pd.Series:
    return pd.Series([unpack_values(bytes(d), list(map(int, w)), True) for d, w in zip(data, widths)])
