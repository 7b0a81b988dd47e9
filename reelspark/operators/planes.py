"""Planes of blocks in raster order: DC prediction from neighbours, and edge filters.

Both depend on results of earlier blocks of the same plane, so a plane is one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: fixed values: weights of the left, upper left, upper and upper right neighbours and their divisor, by which of them
#: refer to the same frame (in that order); other sets drop the neighbours that don't count
WEIGHTS = {
    "L": ((1, 0, 0, 0), 1), "Lu": ((1, 0, 0, 0), 1), "u": ((0, 1, 0, 0), 1), "U": ((0, 0, 1, 0), 1), "uU": ((0, 0, 1, 0), 1), "Ur": ((0, 0, 1, 0), 1), "LU": ((1, 0, 1, 0), 2),
    "r": ((0, 0, 0, 1), 1), "Lr": ((75, 0, 0, 53), 128), "Lur": ((75, 0, 0, 53), 128), "LUr": ((75, 0, 0, 53), 128), "ur": ((0, 1, 0, 1), 2), "uUr": ((0, 3, 10, 3), 16),
    "LuU": ((29, -26, 29, 0), 32), "LuUr": ((29, -26, 29, 0), 32),
}
FAR = 128


def restore_dc(diff: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """DC values of a plane from their differences; ``ref`` is each block's reference, -1 for blocks that aren't coded.

    A block without a neighbour of its reference continues the last value of that
    reference. With left, upper left and upper all there, a prediction far from one of
    them gives way to it: the upper first, then the left, then the upper left.
    """
    height, width = diff.shape
    out = np.zeros_like(diff)
    last: dict[int, int] = {}
    for y in range(height):
        for x in range(width):
            own = int(ref[y, x])
            if own < 0:
                continue
            places = (("L", y, x - 1), ("u", y - 1, x - 1), ("U", y - 1, x), ("r", y - 1, x + 1))
            near = {n: int(out[j, i]) for n, j, i in places if 0 <= j and 0 <= i < width and ref[j, i] == own}
            if y == 0:
                near = {}  # the first row only continues
            if not near:
                guess = last.get(own, 0)
            else:
                weights, by = WEIGHTS["".join(n for n in "LuUr" if n in near)]
                total = sum(w * near.get(n, 0) for w, n in zip(weights, "LuUr"))
                guess = int(total / by)
                if {"L", "u", "U"} <= set(near):
                    guess = next((near[n] for n in "ULu" if abs(guess - near[n]) > FAR), guess)
            out[y, x] = last[own] = int(diff[y, x]) + guess
    return out


def predict_dc(dc: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """The differences that ``restore_dc`` turns into these values."""
    out = np.zeros_like(dc)
    for y in range(dc.shape[0]):
        for x in range(dc.shape[1]):
            if ref[y, x] >= 0:
                # restoring with a zero difference here gives the prediction
                guess = restore_dc(out[: y + 1], ref[: y + 1])[y, x]
                out[y, x] = dc[y, x] - guess
    return out


def _soften(a, b, c, d, limit: int):
    """Change of the two middle pixels of an edge: nothing for flat and for steep edges."""
    r = (a.astype(int) - d + 3 * (c.astype(int) - b) + 4) >> 3
    return np.where(np.abs(r) >= 2 * limit, 0, np.where(np.abs(r) < limit, r, np.sign(r) * (2 * limit - np.abs(r))))


def deblock(plane: np.ndarray, coded: np.ndarray, limit: int, size: int = 8) -> np.ndarray:
    """Filter block edges next to a coded block, block by block in raster order: left, top, then right and bottom of uncoded neighbours."""
    p = plane.astype(np.int64)

    def upright(y: int, x: int):
        rows = slice(y, y + size)
        r = _soften(p[rows, x - 2], p[rows, x - 1], p[rows, x], p[rows, x + 1], limit)
        p[rows, x - 1], p[rows, x] = np.clip(p[rows, x - 1] + r, 0, 255), np.clip(p[rows, x] - r, 0, 255)

    def level(y: int, x: int):
        cols = slice(x, x + size)
        r = _soften(p[y - 2, cols], p[y - 1, cols], p[y, cols], p[y + 1, cols], limit)
        p[y - 1, cols], p[y, cols] = np.clip(p[y - 1, cols] + r, 0, 255), np.clip(p[y, cols] - r, 0, 255)

    height, width = coded.shape
    for j in range(height):
        for i in range(width):
            if not coded[j, i]:
                continue
            if i:
                upright(j * size, i * size)
            if j:
                level(j * size, i * size)
            if i + 1 < width and not coded[j, i + 1]:
                upright(j * size, (i + 1) * size)
            if j + 1 < height and not coded[j + 1, i]:
                level((j + 1) * size, i * size)
    return p.astype(plane.dtype)


def restore_planes(blocks: DataFrame) -> DataFrame:
    """Add ``dc`` to blocks (frame, plane, y, x, diff, ref); a group is one plane of a frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        diff, ref = np.zeros(shape, np.int64), np.full(shape, -1)
        diff[pdf["y"], pdf["x"]], ref[pdf["y"], pdf["x"]] = pdf["diff"], pdf["ref"]
        return pdf.assign(dc=restore_dc(diff, ref)[pdf["y"], pdf["x"]])[["frame", "plane", "y", "x", "dc"]]

    return blocks.groupBy("frame", "plane").applyInPandas(run, "frame long, plane long, y long, x long, dc long")


def deblock_planes(pixels: DataFrame, limit: int, every: int = 3) -> DataFrame:
    """Filtered pixels (frame, plane, y, x, v); of the blocks each ``every``-th isn't coded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        plane = np.zeros(shape, np.int64)
        plane[pdf["y"], pdf["x"]] = pdf["v"]
        blocks = shape[0] // 8, shape[1] // 8
        coded = (np.arange(blocks[0] * blocks[1]).reshape(blocks) + int(pdf["frame"].iloc[0])) % every != 0
        return pdf.assign(v=deblock(plane, coded, limit)[pdf["y"], pdf["x"]])[["frame", "plane", "y", "x", "v"]]

    return pixels.groupBy("frame", "plane").applyInPandas(run, "frame long, plane long, y long, x long, v int")
