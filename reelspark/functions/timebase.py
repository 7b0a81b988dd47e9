"""Rational time as integer expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pixels import div


def granule_frame(granule: Column, shift: int) -> Column:
    """Frame number of a granule position: key frame above the shift, plus the frames since."""
    key = F.shiftright(granule, shift)
    return key + (granule - F.shiftleft(key, shift))


def frame_seconds(frame: Column, num: int, den: int) -> Column:
    """End time of a frame at num / den frames a second."""
    return (frame + 1) * F.lit(float(den)) / F.lit(float(num))


def period_samples(period: Column, rate: int, num: int, den: int) -> Column:
    """Audio samples before the start of a video period."""
    return div((period.cast("long") - 1) * den * rate, num)


def target_samples(period: Column, rate: int, num: int, den: int, readahead: int) -> Column:
    """Audio samples that must be present when a period is shown: rounded up, plus read-ahead."""
    return div((period.cast("long") + 1) * den * rate + (num - 1), num) + readahead


def reduce_rate(num: Column, den: Column) -> Column:
    """Halve a rational until both parts fit in 16 bits: struct (num, den)."""
    top = F.greatest(num, den)
    halvings = F.greatest(F.lit(0), F.floor(F.log2(top.cast("double"))).cast("int") - 15)
    half = lambda v: F.call_function("shiftright", v, halvings)
    return F.struct(half(num).alias("num"), half(den).alias("den"))
