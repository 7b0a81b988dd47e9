"""Rate and distortion: frontiers, budgets, statistics, and recurrences.

Recurrences that round at every step are no window sums; they stream over partitions sorted by
stream, with one stream's last values as state, so a stream of any length takes little memory.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows in a batch given back
GATHER_ROWS = 20_000


def pareto(options: DataFrame, block: str = "block_id") -> DataFrame:
    """Options (block, opt, bits, dist) that no other beats on both counts; of equal ones the first."""
    w = Window.partitionBy(block).orderBy("bits", "dist", "opt")
    best = F.min("dist").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return options.withColumn("best", best).where(F.col("best").isNull() | (F.col("dist") < F.col("best"))).drop("best")


def hull(options: DataFrame, block: str = "block_id") -> DataFrame:
    """Lower convex hull of each block's options, from least distortion to fewest bits: adds ``step``.

    From the best option on, each step goes to the option with the least added distortion
    for each bit saved. A block has a handful of options, so they fit in one array.
    """
    rows = options.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("dist", "bits", "opt"))).alias("o"))
    best = F.struct(*(F.get("o", F.lit(0))[c].alias(c) for c in ("dist", "bits", "opt")))

    def nxt(base):
        cheaper = F.filter("o", lambda o: (o["dist"] > base["dist"]) & (o["bits"] < base["bits"]))
        ranked = F.transform(cheaper, lambda o: F.struct(((o["dist"] - base["dist"]) / (base["bits"] - o["bits"])).alias("slope"), o["dist"].alias("dist"), o["opt"].alias("opt"), o["bits"].alias("bits")))
        return F.array_min(ranked)

    def step(path, _):
        more = F.transform(F.filter(F.array(nxt(F.element_at(path, -1))), lambda m: m.isNotNull()), lambda m: F.struct(m["dist"].alias("dist"), m["bits"].alias("bits"), m["opt"].alias("opt")))
        return F.concat(path, more)

    path = F.aggregate("o", F.array(best), step)
    walked = rows.select(block, F.posexplode(path).alias("step", "p"))
    return walked.select(block, "p.opt", "p.bits", "p.dist", "step")


def marginal_steps(frontier: DataFrame, block: str = "block_id") -> DataFrame:
    """Downgrades between neighbours of a frontier ordered by distortion: bits saved, distortion added."""
    w = Window.partitionBy(block).orderBy("dist", "opt")
    steps = frontier.withColumn("bits_from", F.lag("bits").over(w)).withColumn("dist_from", F.lag("dist").over(w)).where("bits_from is not null")
    return steps.select(block, "opt", (F.col("bits_from") - F.col("bits")).alias("saved"), (F.col("dist") - F.col("dist_from")).alias("added"))


def budget(steps: DataFrame, frame: str, needed: Column | int, block: str = "block_id") -> DataFrame:
    """Cheapest downgrades of each frame, by distortion for each bit, until ``needed`` bits are saved."""
    w = Window.partitionBy(frame).orderBy((F.col("added") / F.col("saved")), block, "opt")
    run = F.sum("saved").over(w.rowsBetween(Window.unboundedPreceding, 0))
    need = F.lit(needed) if isinstance(needed, int) else needed
    return steps.withColumn("total_saved", run).where(F.col("total_saved") - F.col("saved") < need)


def greedy_budget(hulls: DataFrame, frame: str, size_limit: int, entry_cost: int = 48) -> DataFrame:
    """Codebook-aware greedy reduction of one frame at a time: the chosen step of each block.

    ``hulls`` has (frame, block_id, step, bits, dist, entry): an option may use a codebook
    entry, which costs ``entry_cost`` bits while any block uses it, so sizes depend on
    earlier choices. A group holds one frame's options.
    """

    def reduce(rows) -> tuple[dict[int, int], int]:
        lists: dict[int, list] = {}
        for row in rows:
            lists.setdefault(row[0], []).append(row[2:])
        at = dict.fromkeys(lists, 0)
        uses = Counter(rows[0][2] for rows in lists.values())
        total = sum(rows[0][0] for rows in lists.values()) + entry_cost * sum(1 for e in uses if e >= 0)

        def push(block: int):
            k, rows = at[block], lists[block]
            if k + 1 < len(rows):
                slope = (rows[k + 1][1] - rows[k][1]) / max(1, rows[k][0] - rows[k + 1][0])
                heapq.heappush(queue, (slope, block))

        queue: list[tuple[float, int]] = []
        for block in lists:
            push(block)
        while total > size_limit and queue:
            _, block = heapq.heappop(queue)
            old, new = lists[block][at[block]], lists[block][at[block] + 1]
            total += new[0] - old[0]
            uses[old[2]] -= 1
            total -= entry_cost * (old[2] >= 0 and not uses[old[2]])
            total += entry_cost * (new[2] >= 0 and not uses[new[2]])
            uses[new[2]] += 1
            at[block] += 1
            push(block)
        return at, total

    names = [frame, "block_id", "step", "frame_bits"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def gathered(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def run(batches):
        out: list[tuple] = []
        for batch in batches:
            for key, options in zip(batch.column(frame), batch.column("o")):  # one frame's options at a time
                key, cells = key.as_py(), options.values
                at, total = reduce(zip(*(c.to_pylist() for c in cells.flatten())))
                out += [(key, b, k, total) for b, k in at.items()]
                if len(out) >= GATHER_ROWS:
                    yield gathered(out)
                    out = []
        if out:
            yield gathered(out)

    # many frames a batch: a pandas frame for each of them costs more than its reduction
    rows = hulls.groupBy(frame).agg(F.sort_array(F.collect_list(F.struct("block_id", "step", "bits", "dist", "entry"))).alias("o"))
    return rows.select(F.col(frame).cast("long").alias(frame), "o").mapInArrow(run, f"{frame} long, block_id long, step int, frame_bits long")


def usage(choices: DataFrame, entry: str = "entry") -> DataFrame:
    """Uses of each codebook entry and the number of entries in use."""
    by = choices.where(F.col(entry) >= 0).groupBy(entry).agg(F.count("*").alias("uses"))
    return by.withColumn("used", by.agg(F.count("*")).scalar())


def size_estimate(codes: Column, data_bytes: Column, cb2: Column, cb4: Column) -> Column:
    """Bytes of a frame: 2-bit codes rounded up to 16 bits, data, cells of 6 and 4 bytes, chunk headers of 8."""
    code_bytes = F.ceil(codes * 2 / 16) * 2
    books = F.when(cb2 + cb4 > 0, cb2 * 6 + cb4 * 4 + 8).otherwise(0)
    return (code_bytes + data_bytes + books + 8).cast("long")


def top_two(scores: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """The two best rows of each group."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return scores.withColumn("place", F.row_number().over(w)).where("place <= 2")


def correlate(samples: DataFrame, lags: list[int], stream: str = "stream", at: str = "n") -> DataFrame:
    """(stream, lag, r): sums of x[n] * x[n + lag], as an equi-join on positions."""
    return cross_correlate(samples, samples, lags, stream, at)


def band_energy(spectrum: DataFrame, edges: list[int], group: str = "frame") -> DataFrame:
    """(frame, band, energy): root of the sum of squares within bands [edges[k], edges[k + 1])."""
    bounds = F.array(*map(F.lit, edges))
    band = F.size(F.filter(bounds, lambda e: e <= F.col("bin"))) - 1
    rows = spectrum.withColumn("band", band).where((F.col("band") >= 0) & (F.col("band") < len(edges) - 1))
    return rows.groupBy(group, "band").agg(F.sqrt(F.sum(F.col("x").cast("double") * F.col("x"))).alias("energy"))


def sliding_energy(samples: DataFrame, length: int, stream: str = "stream", at: str = "n") -> DataFrame:
    """Add ``energy``: the sum of squares of a sample and the next ``length`` - 1."""
    w = Window.partitionBy(stream).orderBy(at).rowsBetween(0, length - 1)
    return samples.withColumn("energy", F.sum(F.col("v").cast("long") * F.col("v")).over(w))


def moments(rows: DataFrame, by: list[str], x: str, y: str, weight: str) -> DataFrame:
    """Weighted moments and the least-squares line, all by partial and final aggregation."""
    w, a, b = F.col(weight).cast("double"), F.col(x).cast("double"), F.col(y).cast("double")
    m = rows.groupBy(*by).agg(
        F.sum(w).alias("w"), F.sum(w * a).alias("wx"), F.sum(w * b).alias("wy"), F.sum(w * a * a).alias("wxx"), F.sum(w * a * b).alias("wxy"), F.sum(w * b * b).alias("wyy")
    )
    det = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    slope = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / det
    return m.withColumn("slope", F.when(det != 0, slope)).withColumn("intercept", F.when(det != 0, (F.col("wy") - slope * F.col("wx")) / F.col("w")))


def merge_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """Combine partial moments (w, wx, wy, wxx, wxy, wyy)."""
    return parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("w", "wx", "wy", "wxx", "wxy", "wyy")))


#: sums of four variables s, q, r, d: weighted sums, then central co-moments by the letters of their factors
FIRST = ("s", "q", "r", "d")
CENTRAL = ("ss", "sq", "qq", "sr", "qr", "rr", "sd", "qd", "dd", "ssq", "sqq", "sqr", "sqd", "ssqq")


def co_moments(rows: DataFrame, by: list[str], weight: str = "w") -> DataFrame:
    """The 19 sums of each group: w, the weighted sums of s, q, r and d, and their central co-moments up to fourth order.

    Means come first, then the sums about them, so large means cost no digits; both are partial and final aggregations.
    """
    w = F.col(weight).cast("double")
    first = rows.groupBy(*by).agg(F.sum(w).alias("w_all"), *(F.sum(w * F.col(c)).alias(f"{c}_all") for c in FIRST))
    near = rows.select(*by, w.alias("w_one"), *FIRST).join(first, by)
    off = {c: F.col(c) - F.col(f"{c}_all") / F.col("w_all") for c in FIRST}
    sums = near.groupBy(*by).agg(
        F.first("w_all").alias("w"), *(F.first(f"{c}_all").alias(c) for c in FIRST),
        *(F.sum(math.prod((off[c] for c in name), start=F.col("w_one"))).alias(name) for name in CENTRAL),
    )
    return sums


def merge_co_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """Combine partial results of ``co_moments``.

    About the common mean, a part's product of deviations is the sum over all ways to take each factor from the part's own
    deviation or from the distance of the means; own deviations alone sum to zero.
    """
    total = parts.groupBy(*by).agg(F.sum("w").alias("w_all"), *(F.sum(c).alias(f"{c}_all") for c in FIRST))
    near = parts.join(total, by)
    shift = {c: F.col(c) / F.col("w") - F.col(f"{c}_all") / F.col("w_all") for c in FIRST}

    def about(name: str) -> Column:
        out = F.lit(0.0)
        for own in range(1 << len(name)):
            letters = "".join(c for k, c in enumerate(name) if own >> k & 1)
            if len(letters) != 1:
                moment = F.col("w") if not letters else F.col(letters)
                out = out + math.prod((shift[c] for k, c in enumerate(name) if not own >> k & 1), start=moment)
        return out

    return near.groupBy(*by).agg(F.first("w_all").alias("w"), *(F.first(f"{c}_all").alias(c) for c in FIRST), *(F.sum(about(name)).alias(name) for name in CENTRAL))


def nearest_quantiser(targets: DataFrame, table: DataFrame) -> DataFrame:
    """(target_id, q): the entry closest to each target; ties to the one closest to the old q, then the lower.

    The table has one row for each quantiser (at most some hundreds), so it is one array for all targets, and nothing is joined.
    """
    entries = table.agg(F.sort_array(F.collect_list(F.struct("q", "log_q")))).scalar()
    rows = targets.withColumn("entries", entries)
    key = F.transform("entries", lambda e: F.struct(F.abs(e["log_q"] - F.col("target")).alias("d"), F.abs(e["q"] - F.col("old_q")).alias("o"), e["q"].alias("q")))
    return rows.select("target_id", F.array_min(key)["q"].alias("q"))


def bisect(low: int, high: int, value, rounds: int = 32) -> int:
    """The threshold with the least value of a unimodal function, by halving intervals on the driver."""
    while high - low > 1 and rounds:
        mid = (low + high) // 2
        if value(mid) <= value(mid + 1):
            high = mid
        else:
            low = mid + 1
        rounds -= 1
    return low if value(low) <= value(high) else high


# ---------------------------------------------------------------- recurrences


def recur(rows: DataFrame, stream: str, at: str, columns: list[str], out: str, step, kind: str = "long") -> DataFrame:
    """(stream, at, out): ``step(state, *values) -> (out, state)`` for each row of a stream in order; state is None at first."""
    arrow = pa.float64() if kind == "double" else pa.int64()

    def run(batches):
        now, state = None, None
        for batch in batches:
            result = []
            for key, *values in zip(*(batch.column(c).to_pylist() for c in (stream, *columns))):
                if key != now:
                    now, state = key, None
                value, state = step(state, *values)
                result.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(stream), batch.column(at), pa.array(result, arrow)], [stream, at, out])

    ordered = rows.select(stream, at, *columns).where(F.col(stream).isNotNull()).repartition(stream).sortWithinPartitions(stream, at)
    return ordered.mapInArrow(run, f"{stream} long, {at} long, {out} {kind}")


def leaky_bucket(samples: DataFrame, floor: int = 0, column: str = "v", stream: str = "stream", at: str = "n", out: str = "out") -> DataFrame:
    """Add the running sum that starts at 0 and never falls below ``floor``.

    It is the plain running sum plus what its lowest value so far lacked to the floor: two sums over one window.
    """
    w = Window.partitionBy(stream).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    plain = samples.withColumn("_sum", F.sum(F.col(column).cast("long")).over(w))
    lacked = F.greatest(F.lit(0), F.lit(floor) - F.min("_sum").over(w))
    return plain.withColumn(out, F.col("_sum") + lacked).drop("_sum")


def moving_distortion(target: int):
    """Step of the target distortion: six tenths of the old and four of the new, then nudged by the byte slip.

    Up by a twentieth beyond three frames of slip, by a fortieth beyond one, down by a twentieth below minus one.
    """

    def step(state, dist, slip):
        now = dist if state is None else state * 6 // 10 + dist * 4 // 10
        if slip > 3 * target:
            now += now // 20
        elif slip > target:
            now += now // 40
        elif slip < -target:
            now -= now // 20
        return now, now

    return step


def two_pole_coefficients(delay: int) -> tuple[int, int, int]:
    """Gain and feedback, in Q24, of a second-order Bessel low-pass that reacts within ``delay`` samples."""
    warp = math.tan(1 / delay)
    k1, k2 = 3 * warp, 3 * warp * warp
    a = k2 / (1 + k1 + k2)
    b1 = 2 * a * (1 / k2 - 1)
    return tuple(round(v * (1 << 24)) for v in (a, b1, 1 - 4 * a - b1))


def two_pole(delay: int):
    """Step of the second-order low-pass in Q24; the first value stands for all before it."""
    gain, c0, c1 = two_pole_coefficients(delay)

    def step(state, x):
        x1, x2, y1, y2 = state or (x, x, x, x)
        y = ((x + 2 * x1 + x2) * gain + y1 * c0 + y2 * c1 + (1 << 23)) >> 24
        return y, (x, x1, y, y1)

    return step


def pre_emphasis(samples: DataFrame, k: float = 0.85, stream: str = "stream", at: str = "n") -> DataFrame:
    """Add ``out``: a sample less ``k`` times the one before."""
    before = F.coalesce(F.lag("v").over(Window.partitionBy(stream).orderBy(at)), F.lit(0))
    return samples.withColumn("out", F.col("v").cast("double") - F.lit(k) * before)


def de_emphasis(k: float = 0.85):
    """Step that undoes ``pre_emphasis``."""

    def step(state, x):
        now = x + k * (state or 0.0)
        return now, now

    return step


def iir(samples: DataFrame, feedback: list[float], stream: str = "stream", at: str = "n") -> DataFrame:
    """(stream, at, y): y[n] = x[n] - sum of feedback[k] * y[n - 1 - k]."""

    def step(state, x):
        old = state or (0.0,) * len(feedback)
        y = x - sum(c * v for c, v in zip(feedback, old))
        return y, (y, *old[:-1])

    return recur(samples.withColumn("x", F.col("v").cast("double")), stream, at, ["x"], "y", step, "double")


def comb(samples: DataFrame, period: int, taps: list[int], stream: str = "stream", at: str = "n") -> DataFrame:
    """Add ``y``: a sample plus ``taps`` times those around one period earlier; samples before the start are 0."""
    w = Window.partitionBy(stream).orderBy(at)
    side = len(taps) // 2
    back = sum((F.coalesce(F.lag("v", period + k - side).over(w), F.lit(0)) * t for k, t in enumerate(taps)), F.lit(0).cast("long"))
    return samples.withColumn("y", F.col("v") + back)


def cross_correlate(a: DataFrame, b: DataFrame, lags: list[int], stream: str = "stream", at: str = "n") -> DataFrame:
    """(stream, lag, r): sums of a[n] * b[n + lag], as an equi-join on positions."""
    left = a.select(stream, F.col(at).alias("n"), F.col("v").alias("x"), F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    right = b.select(stream, F.col(at).alias("m"), F.col("v").alias("y"))
    met = left.withColumn("m", F.col("n") + F.col("lag")).join(right, [stream, "m"])
    return met.groupBy(stream, "lag").agg(F.sum(F.col("x").cast("long") * F.col("y")).alias("r"))


def fir(samples: DataFrame, taps: list[int], stream: str = "stream", at: str = "n") -> DataFrame:
    """Add ``y``: integer convolution with ``taps``; samples before the start are 0."""
    w = Window.partitionBy(stream).orderBy(at)
    y = sum((F.coalesce(F.lag("v", k).over(w), F.lit(0)) * t for k, t in enumerate(taps)), F.lit(0).cast("long"))
    return samples.withColumn("y", y)


def overlap_add(frames: DataFrame, hop: int, stream: str = "stream", frame: str = "frame") -> DataFrame:
    """(stream, n, v): frames of samples added up where they overlap."""
    s = frames.select(stream, frame, F.posexplode("samples").alias("k", "s"))
    return s.groupBy(stream, (F.col(frame) * hop + F.col("k")).alias("n")).agg(F.sum("s").alias("v"))
