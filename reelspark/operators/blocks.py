"""Operators on macroblocks and coefficient blocks in coding order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import clamp, div


def zigzag(n: int = 8) -> list[int]:
    """Raster positions in diagonal scan order."""
    cells = [(y, x) for y in range(n) for x in range(n)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else -c[0]))
    return [y * n + x for y, x in cells]


def classify(coef: Column) -> Column:
    """'zero', 'sparse' (one coefficient) or 'full'."""
    n = F.size(F.filter(coef, lambda c: c != 0))
    return F.when(n == 0, "zero").when(n == 1, "sparse").otherwise("full")


def oddify(v: Column) -> Column:
    """Move an even non-zero value one towards zero."""
    return F.when((v % 2 == 0) & (v != 0), v - F.signum(v).cast("long")).otherwise(v)


def dequantise(level: Column, scale: Column, weight: Column, intra: bool) -> Column:
    """MPEG-1 reconstruction of one AC level, made odd and limited to 12 bits."""
    level, scale, weight = level.cast("long"), scale.cast("long"), weight.cast("long")
    twice = 2 * level if intra else 2 * level + F.signum(level).cast("long")
    value = oddify(div(twice * scale * weight, 16))
    return F.when(level == 0, F.lit(0).cast("long")).otherwise(clamp(value, -2048, 2047))


def mismatch(coef: Column) -> Column:
    """MPEG-2 parity: the last coefficient's low bit flips when the sum of all is even."""
    total = F.aggregate(coef, F.lit(0).cast("long"), lambda s, x: s + x)
    last = F.element_at(coef, -1)
    fixed = F.when(last % 2 == 0, last + 1).otherwise(last - 1)
    return F.when(total % 2 == 0, F.concat(F.slice(coef, 1, F.size(coef) - 1), F.array(fixed))).otherwise(coef)


def place_runs(runs: DataFrame, block: str = "block_id", order: str = "seq") -> DataFrame:
    """Add ``position`` and raster ``cell`` to (run, level) pairs of a block; ``bad`` beyond 64 coefficients."""
    w = Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    table = F.array(*map(F.lit, zigzag()))
    at = F.sum(F.col("run") + 1).over(w) - 1
    return runs.withColumn("position", at).withColumn("bad", F.col("position") >= 64).withColumn("cell", F.get(table, F.col("position").cast("int")))


def predict_dc(blocks: DataFrame, slice_: str = "slice_id", order: str = "mb_addr", start: int = 1024) -> DataFrame:
    """Add ``dc``: running sum of differences, from ``start`` again after a gap in intra blocks."""
    w = Window.partitionBy(slice_).orderBy(order)
    reset = F.coalesce((F.col(order) - F.lag(order).over(w) > 1).cast("int"), F.lit(0))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    part = blocks.withColumn("reset", reset).withColumn("part", F.sum("reset").over(run))
    inner = Window.partitionBy(slice_, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return part.withColumn("dc", F.sum("diff").over(inner) + start).drop("reset")


def predict_vectors(blocks: DataFrame, f: int, slice_: str = "slice_id", order: str = "mb_addr") -> DataFrame:
    """Add ``mv``: running sum of differences, wrapped to [-16 << f, (16 << f) - 1]; the wrap is modular."""
    half = 16 << f
    w = Window.partitionBy(slice_).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("mv", F.pmod(F.sum("diff").over(w) + half, F.lit(2 * half)) - half)


def carry_quantiser(blocks: DataFrame, slice_: str = "slice_id", order: str = "mb_addr") -> DataFrame:
    """Add ``scale``: the last explicit quantiser of the slice."""
    w = Window.partitionBy(slice_).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("scale", F.last("q", ignorenulls=True).over(w))


def fill_skipped(blocks: DataFrame, slice_: str = "slice_id", order: str = "mb_addr") -> DataFrame:
    """(slice, address) of the macroblocks that a slice's addresses skip."""
    w = Window.partitionBy(slice_).orderBy(order)
    prev = F.lag(order).over(w)
    gaps = blocks.select(slice_, order, prev.alias("prev")).where(F.col(order) - F.col("prev") > 1)
    return gaps.select(slice_, F.explode(F.sequence(F.col("prev") + 1, F.col(order) - 1)).alias("skipped"))


def unpack_runs(runs: DataFrame, order: str = "seq", value: str = "v", length: str = "n") -> DataFrame:
    """A value for each unit of each run, in order."""
    return runs.select(order, F.posexplode(F.array_repeat(F.col(value), F.col(length).cast("int"))).alias("k", value))
