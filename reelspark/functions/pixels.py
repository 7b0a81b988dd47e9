"""Integer pixel arithmetic as column expressions (all stay in generated code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, low: int = 0, high: int = 255) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


#: fixed values: 16.16 products of each layout as (y, v to r, u to g, v to g, u to b), and offsets of r, g, b
LAYOUTS = {
    "bt601": ((9539, 13075, -3209, -6660, 16525), (-3566, 2170, -4131)),
    "jpeg": ((None, 11485, -2819, -5850, 14516), (-2871, 2166, -3629)),
}


def ycbcr_to_rgb(y: Column, u: Column, v: Column, layout: str) -> Column:
    """Struct (r, g, b) of 8-bit YCbCr, in the decoder's fixed point."""
    (ky, vr, ug, vg, ub), (r0, g0, b0) = LAYOUTS[layout]

    def part(c: Column, k: int) -> Column:
        return F.shiftright(F.shiftleft(c.cast("int"), 7) * F.lit(k), 16)

    luma = F.shiftleft(y.cast("int"), 4) if ky is None else part(y, ky)
    level = lambda s: clamp(F.shiftright(s, 4))
    return F.struct(
        level(luma + part(v, vr) + r0).alias("r"), level(luma + part(u, ug) + part(v, vg) + g0).alias("g"), level(luma + part(u, ub) + b0).alias("b")
    )


def codebook_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """Struct (r, g, b) of a codebook cell's colour, 6-bit fixed point, clamped at 255 * 64."""
    y6, b, r = F.shiftleft(y.cast("int"), 6), cb.cast("int") - 128, cr.cast("int") - 128
    level = lambda s: F.when(s < 0, 0).when(s > 16320, 255).otherwise(F.shiftright(s, 6))
    return F.struct(level(y6 + 90 * r).alias("r"), level(y6 - 22 * b - 46 * r).alias("g"), level(y6 + 113 * b).alias("b"))


def pack(r: Column, g: Column, b: Column, order: str) -> Column:
    """The four bytes of a pixel in a channel order such as 'ARGB'; alpha is 255."""
    of = {"A": F.lit(255), "R": r, "G": g, "B": b}
    return F.array(*(of[c].cast("int") for c in order))


def rescale(v: Column, low: int, span: int) -> Column:
    """Limited to full range: (v - low) * 255 / span, truncated and clamped."""
    return clamp(div((v.cast("long") - low) * 255, span))


def div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates towards zero."""
    b = F.lit(b).cast("long") if isinstance(b, int) else b.cast("long")
    a = a.cast("long")
    return ((a - a % b) / b).cast("long")


def mix_rows(near: Column, far: Column) -> Column:
    """(3 * near + far) >> 2, the weight of doubled chroma."""
    return F.shiftright(near.cast("int") * 3 + far.cast("int"), 2)


def median3(a: Column, b: Column, c: Column) -> Column:
    return a + b + c - F.greatest(a, b, c) - F.least(a, b, c)


def texture_scale(size: Column, work: Column) -> Column:
    """Share of a work frame that the video fills."""
    return size.cast("double") / work.cast("double")


def prefix_lookup(bits: Column, codes: list[tuple[str, int]]) -> Column:
    """Struct (value, length) of the first code of a bit string, by a dense table of the longest code's width; null if none fits."""
    width = max(len(c) for c, _ in codes)
    table: list = [None] * (1 << width)
    for code, value in codes:
        rest = width - len(code)
        for k in range(1 << rest):
            table[(int(code, 2) << rest) + k] = (value, len(code))
    kind = "array<struct<value:int,length:int>>"
    dense = F.array(*(F.lit(None) if e is None else F.struct(F.lit(e[0]).alias("value"), F.lit(e[1]).alias("length")) for e in table)).cast(kind)
    index = F.conv(F.rpad(F.substring(bits, 1, width), width, "0"), 2, 10).cast("int")
    found = F.get(dense, index)
    return F.when(F.length(bits) >= found["length"], found)
