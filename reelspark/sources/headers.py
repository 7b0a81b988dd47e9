"""Headers of wrapped codec streams: identification and comments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.bytes import bits, field


def is_header(payload: Column) -> Column:
    """Header packets have the top bit of their first byte set."""
    return field(payload, 0, 1).bitwiseAND(0x80) != 0


def is_key_frame(payload: Column) -> Column:
    """Data packets without the second bit of their first byte; empty packets repeat the last frame."""
    first = field(payload, 0, 1)
    return F.coalesce((first.bitwiseAND(0x80) == 0) & (first.bitwiseAND(0x40) == 0), F.lit(False))


def identification(payload: Column) -> Column:
    """Struct of an identification header (0x80 'theora'), else null."""
    mark = F.hex(F.substring(payload, 1, 7)) == (b"\x80theora").hex().upper()
    tail = field(payload, 40, 2)
    out = F.struct(
        field(payload, 7, 1).alias("major"), field(payload, 8, 1).alias("minor"), (field(payload, 10, 2) * 16).alias("frame_width"), (field(payload, 12, 2) * 16).alias("frame_height"),
        field(payload, 14, 3).alias("width"), field(payload, 17, 3).alias("height"), field(payload, 20, 1).alias("x"), field(payload, 21, 1).alias("y"),
        field(payload, 22, 4).alias("rate_num"), field(payload, 26, 4).alias("rate_den"), field(payload, 36, 1).alias("colour_space"), field(payload, 37, 3).alias("bitrate"),
        bits(tail, 0, 6, 16).alias("quality"), bits(tail, 6, 5, 16).alias("granule_shift"), bits(tail, 11, 2, 16).alias("pixel_format"),
    )
    return F.when(mark & (F.length(payload) >= 42), out)


def build_identification(width: int, height: int, num: int, den: int, shift: int) -> bytes:
    mw, mh = -(-width // 16), -(-height // 16)
    tail = 48 << 10 | shift << 5
    parts = ((3, 1), (2, 1), (1, 1), (mw, 2), (mh, 2), (width, 3), (height, 3), (0, 1), (0, 1), (num, 4), (den, 4), (1, 3), (1, 3), (0, 1), (0, 3), (tail, 2))
    return b"\x80theora" + b"".join(v.to_bytes(n, "big") for v, n in parts)


def comments_of(data: bytes) -> list[str] | None:
    """The strings of a comment header (0x81 'theora'), little-endian lengths; None if cut."""
    if not data.startswith(b"\x81theora"):
        return None
    at, out = 7, []

    def take() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "little")
        at += 4 + n
        return data[at - n : at] if at <= len(data) else None

    if take() is None or at + 4 > len(data):
        return None
    count = int.from_bytes(data[at : at + 4], "little")
    at += 4
    for _ in range(count):
        one = take()
        if one is None:
            return None
        out.append(one.decode("utf-8", "replace"))
    return out


def build_comments(vendor: str, items: list[str]) -> bytes:
    pack = lambda s: len(s.encode()).to_bytes(4, "little") + s.encode()
    return b"\x81theora" + pack(vendor) + len(items).to_bytes(4, "little") + b"".join(map(pack, items))


@pandas_udf(T.ArrayType(T.StringType()))
def comments(payload: pd.Series) -> pd.Series:
    return payload.map(lambda d: None if d is None else comments_of(bytes(d)))
