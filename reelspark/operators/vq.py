"""Vector quantisation: nearest codebook entries, cells, centroids, and clustering.

A codebook is a small dimension table (256 entries in the codec this models). Its rows
go to the tasks with the code only while they are at most ``SMALL_CODEBOOK``; a larger one is met
block by block, so that no task holds all of it. Distances of a batch of points to all entries are
one matrix product, exact in integers. Ties always go to the lowest cb_id. A null vector has no
nearest entry (null).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

SMALL_CODEBOOK = 4096


def quantise(vec: Column, scale: int = 128) -> Column:
    """Array of integers: floor(x * scale)."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def distance(a: Column, b: Column) -> Column:
    """Squared L2 distance of two integer arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("long") * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def _book(entries: DataFrame) -> Column:
    """A small codebook (cb_id, cb_vec) as one array: a scalar subquery, evaluated once, so nothing is joined."""
    return entries.agg(F.sort_array(F.collect_list(F.struct("cb_id", "cb_vec")))).scalar()


def nearest(book: Column) -> Column:
    """Struct (dist, cb_id) of the entry closest to ``vec``; ties to the lowest cb_id."""
    return F.array_min(F.transform(book, lambda e: F.struct(distance(F.col("vec"), e["cb_vec"]).alias("dist"), e["cb_id"].alias("cb_id"))))


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of the nearest entry (the first of equal ones) and squared distance, for each row of ``x``."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if x.shape[1] * most * most < 1 << 50 else np.int64  # both exact; floats multiply faster
    x, book = x.astype(kind), book.astype(kind)
    square = (book * book).sum(axis=1)
    at, dist = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    step = max(1, (1 << 21) // max(1, len(book)))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        d = (part * part).sum(axis=1)[:, None] - 2 * (part @ book.T) + square
        at[a : a + step] = d.argmin(axis=1)
        dist[a : a + step] = d[np.arange(len(part)), at[a : a + step]]
    return at, dist


def _array(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column as a matrix, and the rows they stand in: those of ``dims`` values."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dims)
    flat = column.take(pa.array(rows)).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), dims), rows


def _assigned(ids: np.ndarray, book: np.ndarray):
    def run(batches):
        for batch in batches:
            x, rows = _array(batch.column("vec"), book.shape[1])
            cb_id, dist = (np.zeros(len(batch), np.int64) for _ in range(2))
            none = np.ones(len(batch), bool)
            if len(ids) and len(rows):
                at, dist[rows] = nearest_entries(x, book)
                cb_id[rows] = ids[at]
                none[rows] = False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cb_id, mask=none), pa.array(dist, mask=none)], [*batch.schema.names, "cb_id", "dist"])

    return run


def _book_arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of codebook rows, in order of ids."""
    rows = sorted(rows, key=lambda r: r.cb_id)
    ids = np.array([r.cb_id for r in rows], np.int64)
    return ids, np.array([r.vec for r in rows], np.int64).reshape(len(rows), -1)


def assign(points: DataFrame, codebook: DataFrame, keep: tuple[str, ...] = ("point_id", "vec")) -> DataFrame:
    """Add cb_id and dist of the nearest entry. Points have (point_id, vec), the codebook (cb_id, vec).

    At most ``SMALL_CODEBOOK`` codebook rows reach the driver and go with the code to every task, so the
    nearest entry is found within the row and nothing is shuffled. A larger codebook meets the points in
    blocks; of a point's blocks only the best entry leaves a task.
    """
    entries = codebook.select("cb_id", "vec")
    rows = entries.limit(SMALL_CODEBOOK + 1).collect()
    given = points.select(*dict.fromkeys([*keep, "vec"]))
    added = T.StructType([*given.schema.fields, T.StructField("cb_id", T.LongType()), T.StructField("dist", T.LongType())])
    if len(rows) <= SMALL_CODEBOOK:
        return given.mapInArrow(_assigned(*_book_arrays(rows)), added).select(*keep, "cb_id", "dist")
    # a stated set of entries against all points, in blocks of entries
    n_blocks = -(-entries.count() // SMALL_CODEBOOK) * 4
    books = entries.groupBy(F.pmod(F.xxhash64("cb_id"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("cb_id", "vec")).alias("book"))

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):  # a row is a point and a block; equal neighbours share the block's arrays
                row = batch.slice(k, 1)
                ids, book = _book_arrays([_Entry(**e) for e in row.column("book")[0].as_py()])
                yield from _assigned(ids, book)([row.drop_columns(["book"])])

    met = given.crossJoin(books.select("book")).mapInArrow(run, added)
    best = F.min(F.struct("dist", "cb_id")).alias("best")
    others = [c for c in keep if c != "point_id"]
    near = met.groupBy("point_id").agg(best, *(F.any_value(c).alias(c) for c in others))
    return near.select(*keep, "best.cb_id", "best.dist")


@dataclass
class _Entry:
    cb_id: int
    vec: list


def cell_error(assigned: DataFrame) -> DataFrame:
    """Points and error of each cell, and of all cells (cb_id null)."""
    return assigned.rollup("cb_id").agg(F.count("*").alias("n_points"), F.sum("dist").alias("error"))


def centroids(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    """(cb_id, dim, value): mean of each cell by dimension, rounded half away from zero; empty cells are zero."""
    sums = assigned.select("cb_id", F.posexplode("vec").alias("dim", "x")).groupBy("cb_id", "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    value = F.when(F.col("s") >= 0, F.floor((2 * F.col("s") + F.col("n")) / (2 * F.col("n")))).otherwise(-F.floor((-2 * F.col("s") + F.col("n")) / (2 * F.col("n"))))
    grid = codebook.select("cb_id", F.posexplode("vec").alias("dim", "old"))
    out = grid.join(sums.withColumn("value", value.cast("long")), ["cb_id", "dim"], "left")
    return out.select("cb_id", "dim", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def cell_box(assigned: DataFrame) -> DataFrame:
    """(cb_id, dim, low, high, third, two_thirds): box of each cell and where a split puts its centroids."""
    box = assigned.select("cb_id", F.posexplode("vec").alias("dim", "x")).groupBy("cb_id", "dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    span = F.col("high") - F.col("low")
    third = (span - span % 3) / 3
    return box.select("cb_id", "dim", "low", "high", (F.col("low") + third).cast("long").alias("third"), (F.col("high") - third).cast("long").alias("two_thirds"))


def sort_codebook(codebook: DataFrame, n_luma: int) -> DataFrame:
    """Rank entries by the sum of their first ``n_luma`` values, then cb_id."""
    from pyspark.sql import Window

    luma = F.aggregate(F.slice("vec", 1, n_luma), F.lit(0), lambda s, x: s + x)
    rows = codebook.select("cb_id", luma.alias("luma_sum"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("luma_sum", "cb_id")))


def stride_sample(n_points: int, k: int, spark) -> DataFrame:
    """(i, pick): the deterministic sample i * 433494437 mod n, n / 8 points, for n above 24 * k; else k points."""
    take = n_points // 8 if n_points > 24 * k else k
    return spark.range(take).select(F.col("id").alias("i"), ((F.col("id") * 433494437) % n_points).alias("pick"))


def nearest_other(codebook: DataFrame) -> DataFrame:
    """(cb_id, other_id, dist): the closest other entry of each entry of a small codebook."""
    book = _book(codebook.select("cb_id", F.col("vec").alias("cb_vec")))
    others = F.filter("book", lambda e: e["cb_id"] != F.col("own_id"))
    rows = codebook.select(F.col("cb_id").alias("own_id"), "vec").withColumn("book", book).withColumn("m", nearest(others))
    return rows.select(F.col("own_id").alias("cb_id"), F.col("m.cb_id").alias("other_id"), "m.dist")


def utility_runs(errors: DataFrame) -> DataFrame:
    """(cb_id, error, cum): running sum of the errors that exceed the mean, by cb_id."""
    from pyspark.sql import Window

    mean = errors.agg(F.sum("error") / F.count("*")).scalar()
    w = Window.orderBy("cb_id").rowsBetween(Window.unboundedPreceding, 0)
    high = errors.withColumn("high", F.when(F.col("error") > mean, F.col("error")).otherwise(0))
    return high.select("cb_id", "error", F.sum("high").over(w).alias("cum"))


def pick_by_utility(runs: DataFrame, draws: DataFrame) -> DataFrame:
    """(draw, cb_id): for each draw r in 1..total the first cell whose running sum reaches r."""
    met = draws.join(F.broadcast(runs.select("cb_id", "cum")), F.col("cum") >= F.col("r"))
    return met.groupBy("draw").agg(F.min_by("cb_id", F.struct("cum", "cb_id")).alias("cb_id"))


def pack_codebook(vec: Column, n_luma: int) -> Column:
    """Chroma counts double: values after the luma are multiplied by 2."""
    return F.transform(vec, lambda x, i: F.when(i >= n_luma, x * 2).otherwise(x))


def unpack_codebook(vec: Column, n_luma: int) -> Column:
    """The inverse: (c + 2) / 2 after the luma, as the encoder rounds it."""
    return F.transform(vec, lambda x, i: F.when(i >= n_luma, F.floor((x + 2) / 2).cast("int")).otherwise(x))


def expand_codebook(indexes: DataFrame, cb4: DataFrame, cb2: DataFrame) -> DataFrame:
    """(block_id, y, x, v): 4x4 pixels of entries that name four 2x2 cells; both books are small."""
    quads = indexes.join(F.broadcast(cb4.select("cb4_id", "cells")), "cb4_id").select("block_id", F.posexplode("cells").alias("q", "cb2_id"))
    pixels = quads.join(F.broadcast(cb2.select("cb2_id", "vec")), "cb2_id").select("block_id", "q", F.posexplode(F.slice("vec", 1, 4)).alias("k", "v"))
    return pixels.select(
        "block_id", (F.floor(F.col("q") / 2) * 2 + F.floor(F.col("k") / 2)).cast("int").alias("y"), ((F.col("q") % 2) * 2 + F.col("k") % 2).cast("int").alias("x"), "v"
    )


# ---------------------------------------------------------------- clustering with shifted cells


def _rounded(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """s / n rounded half away from zero; an empty cell is zero."""
    n = np.maximum(n, 1)[..., None]
    return np.where(s >= 0, (2 * s + n) // (2 * n), -((-2 * s + n) // (2 * n)))


class _Cells:
    """What is known of each cell: points, sums of the values and of their squares, and the box."""

    def __init__(self, k: int, dims: int):
        self.n, self.squares = np.zeros(k, np.int64), np.zeros(k, np.int64)
        self.sums, self.low, self.high = np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64)

    def error(self, centre: np.ndarray, of=slice(None)) -> np.ndarray:
        """The cells' squared distances from given centres: from the sums alone, without another pass."""
        return self.squares[of] - 2 * (centre * self.sums[of]).sum(axis=-1) + self.n[of] * (centre * centre).sum(axis=-1)


def _cells_of(points: DataFrame, k: int, dims: int, cell_of) -> _Cells:
    """One pass: ``cell_of(x)`` gives each point's cell, or -1. A task sends one row for each of its cells; k rows come back."""
    schema = "cell int, dim int, n long, squares long, s long, low long, high long"

    def run(batches):
        for batch in batches:
            x, _ = _array(batch.column(0), dims)
            cell = cell_of(x)
            x, cell = x[cell >= 0], cell[cell >= 0]
            order = np.argsort(cell, kind="stable")
            x, cell = x[order], cell[order]
            at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
            if not len(at):
                continue
            n = np.diff(np.concatenate([at, [len(cell)]]))
            squares = np.add.reduceat((x * x).sum(axis=1), at)
            wide = [f.reduceat(x, at, axis=0).ravel() for f in (np.add, np.minimum, np.maximum)]
            over = lambda v: np.repeat(v, dims)
            columns = [over(cell[at]).astype(np.int32), np.tile(np.arange(dims, dtype=np.int32), len(at)), over(n), over(squares), *wide]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "dim", "n", "squares", "s", "low", "high"])

    parts = points.select("vec").mapInArrow(run, schema).groupBy("cell", "dim").agg(
        *(F.sum(c).alias(c) for c in ("n", "squares", "s")), F.min("low").alias("low"), F.max("high").alias("high")
    )
    out = _Cells(k, dims)
    for r in parts.collect():
        out.n[r.cell], out.squares[r.cell] = r.n, r.squares
        out.sums[r.cell, r.dim], out.low[r.cell, r.dim], out.high[r.cell, r.dim] = r.s, r.low, r.high
    return out


def shift_candidates(errors: np.ndarray, book: np.ndarray) -> list[tuple[int, int, int]]:
    """Triples (low, high, near) of cells: low joins near, and high is split into two.

    Cells of less error than the mean, the least first, meet those of more, the greatest first; near is the entry closest to
    low. No cell is in two triples, so all of them can be tried at once.
    """
    k, total = len(errors), int(errors.sum())
    order = np.lexsort((np.arange(k), errors))
    poor = [c for c in order.tolist() if k * int(errors[c]) < total]
    rich = sorted((c for c in range(k) if k * int(errors[c]) > total), key=lambda c: (-int(errors[c]), c))
    used: set[int] = set()
    out = []
    for low in poor:
        away = ((book - book[low]) ** 2).sum(axis=1)
        away[low] = np.iinfo(np.int64).max
        near = int(away.argmin())
        high = next((c for c in rich if c not in used and c != near), None)
        if high is not None and not used & {low, near}:
            out.append((low, high, near))
            used |= {low, high, near}
    return out


def elbg(points: DataFrame, codebook: DataFrame, max_steps: int = 5, least_gain: float = 0.1) -> DataFrame:
    """Refine a codebook until the error falls by at most ``least_gain`` of itself: (cb_id, vec).

    A step finds every point's nearest entry; then cells are shifted: those of low utility give their points to the nearest
    other cell, and their place takes one half of a cell of high utility, split from a third and two thirds of its box by a round of
    2-means. A shift stays if the three cells' error falls. Then entries become their cells' means. Ties go to the first entry, in
    a split to its second half at the first look and to its first half at the last, and all shifts of a step are tried at once
    (``shift_candidates``).

    Each step is three passes over the points with partial aggregation; the driver holds the codebook and its cells' sums, so
    the codebook is limited to ``SMALL_CODEBOOK`` rows.
    """
    rows = codebook.select("cb_id", "vec").limit(SMALL_CODEBOOK + 1).collect()
    if len(rows) > SMALL_CODEBOOK:
        raise ValueError(f"a codebook of more than {SMALL_CODEBOOK} entries can't be refined")
    ids, book = _book_arrays(rows)
    k, dims = book.shape
    last = None
    for _ in range(max_steps if k else 0):
        own = book.copy()
        cells = _cells_of(points, k, dims, lambda x, own=own: nearest_entries(x, own)[0])
        error = int(cells.error(own).sum())
        shifts, halves, error = _shifted(points, own, cells, error)
        sums, n = cells.sums.copy(), cells.n.copy()
        for t, (low, high, near) in shifts:
            sums[near], n[near] = sums[near] + sums[low], n[near] + n[low]
            for cell, half in ((high, 2 * t), (low, 2 * t + 1)):
                sums[cell], n[cell] = halves.sums[half], halves.n[half]
        book = _rounded(sums, n)
        if last is not None and last - error <= least_gain * error:
            break
        last = error
    out = points.sparkSession.createDataFrame([(int(i), [int(v) for v in row]) for i, row in zip(ids, book)], "cb_id long, vec array<int>")
    return out


def _shifted(points: DataFrame, book: np.ndarray, cells: _Cells, error: int):
    """The shifts (number, triple) that lower the error, the sums of all halves tried, and the error after them."""
    tried = shift_candidates(cells.error(book), book)
    k, dims = book.shape
    if not tried:
        return [], _Cells(0, dims), error
    highs = np.array([high for _, high, _ in tried])
    third = (cells.high[highs] - cells.low[highs]) // 3
    pairs = np.stack([cells.low[highs] + third, cells.high[highs] - third], axis=1)
    number = np.full(k, -1)
    number[highs] = np.arange(len(tried))

    def half_of(pairs, second_wins_ties):
        def cell_of(x):
            t = number[nearest_entries(x, book)[0]]
            to = [((x - pairs[t, side]) ** 2).sum(axis=1) for side in (0, 1)]
            side = to[0] >= to[1] if second_wins_ties else to[0] > to[1]
            return np.where(t >= 0, 2 * t + side, -1)

        return cell_of

    first = _cells_of(points, 2 * len(tried), dims, half_of(pairs, True))
    pairs = _rounded(first.sums, first.n).reshape(len(tried), 2, dims)
    halves = _cells_of(points, 2 * len(tried), dims, half_of(pairs, False))
    split = halves.error(pairs.reshape(-1, dims)).reshape(-1, 2).sum(axis=1)
    old = cells.error(book)
    kept = []
    for t, (low, high, near) in enumerate(tried):
        centre = _rounded(cells.sums[low] + cells.sums[near], cells.n[low] + cells.n[near])
        after = int(cells.error(centre, low) + cells.error(centre, near) + split[t])
        before = int(old[low] + old[high] + old[near])
        if after < before:
            kept.append((t, (low, high, near)))
            error += after - before
    return kept, halves, error


def start_codebook(points: DataFrame, n_points: int, k: int, max_steps: int = 1, order: str = "point_id") -> DataFrame:
    """(cb_id, vec): the codebook that a long refinement starts from; ``order`` numbers the points from 0 without gaps.

    Of more than 24 * k points, an eighth is taken by ``stride_sample``, and the codebook refined on it, itself started
    the same way, with twice the steps; of fewer, k points are taken.
    """
    spark = points.sparkSession
    picks = stride_sample(n_points, k, spark)
    taken = picks.join(points.select(F.col(order).alias("pick"), "vec"), "pick").select(F.col("i").alias(order), "vec")
    if n_points <= 24 * k:
        return taken.select(F.col(order).alias("cb_id"), "vec")
    return elbg(taken, start_codebook(taken, n_points // 8, k, 2 * max_steps, order), 2 * max_steps)


def mersenne(seed: int, n: int) -> pd.Series:
    """The first n 32-bit numbers of the MT19937 generator seeded with one integer."""
    state = np.random.RandomState(seed)
    return pd.Series(state.randint(0, 2**32, size=n, dtype=np.uint64))


def scrub(assigned: DataFrame, least: int) -> DataFrame:
    """Points whose distance exceeds a threshold; the others are cheap to predict already."""
    return assigned.where(F.col("dist") > least)


def merge_cells(assigned: DataFrame, moves: DataFrame) -> DataFrame:
    """Give the points of a cell (cb_id) to another (into); moves are a small table."""
    return assigned.join(F.broadcast(moves), "cb_id", "left").withColumn("cb_id", F.coalesce("into", "cb_id")).drop("into")
