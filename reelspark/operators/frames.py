"""Operators on pixels in long form: (frame, plane, y, x, v).

Comparisons and searches are equi-joins on positions, so they partition by frame and
row and never meet frame against frame.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import div, mix_rows

POSITION = ["frame", "plane", "y", "x"]


def errors(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """SSE, SAD and compared pixels of two streams, over positions that both have."""
    both = a.join(b.withColumnRenamed("v", "w"), POSITION)
    d = (F.col("v") - F.col("w")).cast("long")
    return both.groupBy(*by).agg(F.sum(d * d).alias("sse"), F.sum(F.abs(d)).alias("sad"), F.count("*").alias("n"))


def masked_sse(a: DataFrame, b: DataFrame, mask: Column, limit: int, by: list[str]) -> DataFrame:
    """SSE over masked pixels, limited to ``limit`` + 1 as an early stop would report it."""
    both = a.join(b.withColumnRenamed("v", "w"), POSITION)
    d = (F.col("v") - F.col("w")).cast("long")
    full = F.sum(F.when(mask, d * d).otherwise(0))
    return both.groupBy(*by).agg(full.alias("sse"), F.least(full, F.lit(limit + 1).cast("long")).alias("sse_limited"))


def intra_sad(a: DataFrame, size: int = 8) -> DataFrame:
    """Sum of absolute differences from a block's rounded-down mean, by block."""
    block = a.withColumn("block_y", div(F.col("y"), size)).withColumn("block_x", div(F.col("x"), size))
    w = Window.partitionBy("frame", "plane", "block_y", "block_x")
    mean = div(F.sum("v").over(w), F.count("*").over(w))
    return block.withColumn("m", mean).groupBy("frame", "plane", "block_y", "block_x").agg(F.sum(F.abs(F.col("v") - F.col("m"))).alias("sad"))


def psnr(a: DataFrame, b: DataFrame) -> DataFrame:
    """PSNR by frame and plane, by frame, and over all, in one pass; infinite where nothing differs.

    Rows of the smaller grouping sets have nulls in frame or plane.
    """
    by = errors(a, b, ["frame", "plane"])
    sets = by.groupingSets([["frame", "plane"], ["frame"], []], "frame", "plane").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))
    db = 10 * (F.log10(F.lit(255.0 * 255.0)) + F.log10(F.col("n")) - F.log10("sse"))
    return sets.select("frame", "plane", "sse", "n", F.when(F.col("sse") > 0, F.round(db, 6)).alias("psnr"))


def unmatched_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frames that only one stream has, with the side."""
    left, right = a.select("frame").distinct().withColumn("l", F.lit(1)), b.select("frame").distinct().withColumn("r", F.lit(1))
    return left.join(right, "frame", "full_outer").where("l is null or r is null").select("frame", F.when(F.col("l").isNull(), "second").otherwise("first").alias("side"))


def downsample(a: DataFrame) -> DataFrame:
    """Half size: (a + b + c + d + 2) / 4 of each 2x2 square."""
    keys = ["frame", "plane", div(F.col("y"), 2).alias("y"), div(F.col("x"), 2).alias("x")]
    return a.groupBy(*keys).agg(div(F.sum("v") + 2, 4).alias("v"))


def upsample(a: DataFrame) -> DataFrame:
    """Double size by replication."""
    at = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (0, 1) for i in (0, 1))))
    return a.withColumn("o", at).select("frame", "plane", (F.col("y") * 2 + F.col("o.j")).alias("y"), (F.col("x") * 2 + F.col("o.i")).alias("x"), "v")


def pad_edges(a: DataFrame, multiple: int = 16) -> DataFrame:
    """Repeat the last column and row until both sizes are multiples of 16.

    A pixel of the last row or column is copied on; no grid is built to be joined, whose size a planner can't tell.
    """
    w = Window.partitionBy("frame", "plane")
    sized = a.where("frame is not null and plane is not null").withColumn("h", F.max("y").over(w) + 1).withColumn("w", F.max("x").over(w) + 1)

    def reach(c: str, size: str) -> Column:
        at = F.col(c).cast("long")
        padded = F.ceil(F.col(size) / multiple) * multiple
        return F.explode(F.sequence(at, F.when(at == F.col(size) - 1, padded - 1).otherwise(at))).alias(c)

    return sized.select("frame", "plane", reach("y", "h"), "x", "w", "v").select("frame", "plane", "y", reach("x", "w"), "v")


def block_mean(a: DataFrame, size: int = 4) -> DataFrame:
    """Rounded mean of each block."""
    keys = ["frame", "plane", div(F.col("y"), size).alias("block_y"), div(F.col("x"), size).alias("block_x")]
    return a.groupBy(*keys).agg(div(F.sum("v") + div(F.count("*"), 2), F.count("*")).alias("mean"))


def upsample_chroma(a: DataFrame) -> DataFrame:
    """Double a chroma plane both ways with the weights 3 and 1; edges repeat themselves."""
    def doubled(rows: DataFrame, axis: str, other: str) -> DataFrame:
        w = Window.partitionBy("frame", "plane", other).orderBy(axis)
        near = rows.withColumn("before", F.coalesce(F.lag("v").over(w), F.col("v"))).withColumn("after", F.coalesce(F.lead("v").over(w), F.col("v")))
        two = F.explode(F.array(*(F.struct(F.lit(k).alias("o"), mix_rows(F.col("v"), F.col(c)).alias("t")) for k, c in enumerate(("before", "after")))))
        return near.withColumn("e", two).select("frame", "plane", (F.col(axis) * 2 + F.col("e.o")).alias(axis), other, F.col("e.t").alias("v"))

    return doubled(doubled(a, "y", "x"), "x", "y").select(*POSITION, "v")


def compensate(blocks: DataFrame, reference: DataFrame, size: int = 8) -> DataFrame:
    """Motion compensation in half pixels: pixels of blocks (frame, plane, block_y, block_x, ref, dy, dx).

    A pixel averages one, two or four pixels of the reference frame, rounded up at a half.
    Blocks whose vector leaves the frame lose no pixel silently: they come back with
    ``found`` below ``wanted``.
    """
    offs = F.explode(F.sequence(F.lit(0), F.lit(size * size - 1)))
    px = blocks.withColumn("k", offs).select(
        "frame", "plane", "ref", (F.col("block_y") * size + div(F.col("k"), size)).alias("y"), (F.col("block_x") * size + F.col("k") % size).alias("x"), "dy", "dx"
    )
    whole = lambda c: F.shiftright(c, 1)
    half = lambda c: c.bitwiseAND(1)
    px = px.withColumn("sy", F.col("y") + whole(F.col("dy"))).withColumn("sx", F.col("x") + whole(F.col("dx")))
    corner = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), half(F.col("dy"))), lambda j: F.transform(F.sequence(F.lit(0), half(F.col("dx"))), lambda i: F.struct(j.alias("j"), i.alias("i"))))))
    wanted = (half(F.col("dy")) + 1) * (half(F.col("dx")) + 1)
    need = px.withColumn("wanted", wanted).withColumn("c", corner)
    src = reference.select(F.col("frame").alias("ref"), "plane", F.col("y").alias("ry"), F.col("x").alias("rx"), F.col("v").alias("rv"))
    need = need.withColumn("ry", F.col("sy") + F.col("c.j")).withColumn("rx", F.col("sx") + F.col("c.i"))
    met = need.join(src, ["ref", "plane", "ry", "rx"], "left")
    out = met.groupBy("frame", "plane", "y", "x", "wanted").agg(F.sum("rv").alias("s"), F.count("rv").alias("found"))
    return out.select(*POSITION, "wanted", "found", F.when(F.col("found") == F.col("wanted"), div(F.col("s") + div(F.col("wanted"), 2), F.col("wanted"))).alias("v"))


def bipredict(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Average of two predictions, rounded up at a half; one alone stands."""
    both = forward.select(*POSITION, F.col("v").alias("f")).join(backward.select(*POSITION, F.col("v").alias("b")), POSITION, "full_outer")
    return both.select(*POSITION, F.when(F.col("f").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("f")).otherwise(div(F.col("f") + F.col("b") + 1, 2)).alias("v"))


def in_bounds(y: Column, x: Column, dy: Column, dx: Column, size: int, height: int, width: int) -> Column:
    """Whether a block's half-pixel vector stays inside the frame."""
    top, left = y * 2 + dy, x * 2 + dx
    return (top >= 0) & (left >= 0) & (top <= 2 * (height - size)) & (left <= 2 * (width - size))


def _blocks(a: DataFrame, size: int) -> DataFrame:
    """(frame, plane, block_y, block_x, px): whole blocks, their pixels in raster order."""
    keys = ["frame", "plane", div(F.col("y"), size).alias("block_y"), div(F.col("x"), size).alias("block_x")]
    px = F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda t: t["v"].cast("int"))
    return a.groupBy(*keys).agg(px.alias("px")).where(F.size("px") == size * size)


def _search(reach: int, size: int, around: int):
    """Rows with a block's pixels and those of reference blocks around it -> best vectors, by one product a batch."""
    span, side = 2 * reach + 2, (2 * around + 1) * size
    first = around * size - reach

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                block = np.stack(part["px"].to_numpy()).reshape(-1, size, size).astype(np.int64)
                area = np.full((len(part), side, side), -1, np.int64)
                for k, near in enumerate(part["near"]):
                    for r in near:
                        y, x = (r["j"] + around) * size, (r["i"] + around) * size
                        area[k, y : y + size, x : x + size] = np.reshape(r["px"], (size, size))
                area = area[:, first : first + span + size - 1, first : first + span + size - 1]
                views = np.lib.stride_tricks.sliding_window_view(area, (size, size), (1, 2))
                sse = ((views - block[:, None, None]) ** 2).sum(axis=(3, 4))
                sse[(views < 0).any(axis=(3, 4))] = np.iinfo(np.int64).max
                flat = sse.reshape(len(part), -1)
                best = flat.argmin(axis=1)
                zero = reach * span + reach
                best = np.where(flat[:, zero] <= flat.min(axis=1), zero, best)
                least = flat[np.arange(len(part)), best]
                out = part[["frame", "plane", "block_y", "block_x"]].assign(dy=best // span - reach, dx=best % span - reach, sse=least)
                yield out[least < np.iinfo(np.int64).max]

    return run


def motion_search(current: DataFrame, reference: DataFrame, reach: int = 7, size: int = 4) -> DataFrame:
    """(frame, plane, block_y, block_x, dy, dx, sse): the best whole-pixel vector of each block against the frame before.

    Displacements run from -reach to reach + 1, those a motion byte can code; ties go to the zero vector, then in scan
    order. A block meets the reference blocks that its candidates touch, by an equi-join on block positions; all candidates are
    then compared in one array, so the exchange carries some copies of each pixel and no candidates. Partial blocks are
    neither searched nor referred to.
    """
    around = -(-(reach + 1) // size)
    steps = F.explode(F.sequence(F.lit(-around), F.lit(around)))
    ref = _blocks(reference, size).withColumn("j", steps).withColumn("i", steps)
    ref = ref.select((F.col("frame") + 1).alias("frame"), "plane", (F.col("block_y") - F.col("j")).alias("block_y"), (F.col("block_x") - F.col("i")).alias("block_x"), F.struct("j", "i", "px").alias("n"))
    near = ref.groupBy("frame", "plane", "block_y", "block_x").agg(F.collect_list("n").alias("near"))
    met = _blocks(current, size).join(near, ["frame", "plane", "block_y", "block_x"])
    schema = "frame long, plane long, block_y long, block_x long, dy int, dx int, sse long"
    return met.select(*(F.col(c).cast("long").alias(c) for c in ("frame", "plane", "block_y", "block_x")), "px", "near").mapInPandas(_search(reach, size, around), schema)


def copy_vector(code: Column, base_x: Column, base_y: Column) -> Column:
    """Struct (dx, dy) of a motion byte: high nibble for x, low for y, both from 8 down."""
    return F.struct((8 - F.shiftright(code, 4) - base_x).alias("dx"), (8 - code.bitwiseAND(15) - base_y).alias("dy"))
