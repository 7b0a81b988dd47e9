"""Sharding by histogram sort, in DataFrame operations only.

Rows are sorted by an order-preserving key of 64-bit parts (here: a hash of the text,
then the id, so equal texts are neighbours). The splitters that cut the sorted order
into runs of near equal bytes are found without sorting: each round counts the exact
bytes and rows between candidate boundaries, over all partitions, and keeps only the
intervals that hold an unmet target. Boundaries are the key's leading digits, so a
round narrows an interval 2^DIGIT times whatever the key's distribution. A splitter
is met when the bytes below it are within its tolerance of the target, or when only one
row is left to choose; then the rows are exchanged once.

Each shard is cut into several runs, by the same counts but loosely, so that the final sort is
spread over many tasks; the exact rows below each splitter give every run its first
slot. The cells of a round are counted, summed up and searched on the cluster; what reaches
the driver is one row for each target, at most ``shards * MOST_RUNS``, whatever the number of
partitions or executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 10
PARTS = 2  # 64-bit parts of a key
RUN_ROWS = 2_000_000  # rows that one task sorts
MOST_RUNS = 256  # runs of a shard at most; beyond RUN_ROWS * MOST_RUNS rows a shard, runs grow (and spill)
LOOSE = 0.25  # a run's end inside a shard may be off by this share of a run


def _digit(level: int) -> Column:
    """The key's digit of a level, as an order-preserving number from 0."""
    per_part = -(-64 // DIGIT)
    part, k = divmod(level, per_part)
    shift = max(0, 64 - DIGIT * (k + 1))
    width = min(DIGIT, 64 - DIGIT * k)
    return F.shiftrightunsigned(F.col(f"k{part}"), shift).bitwiseAND((1 << width) - 1)


LEVELS = PARTS * -(-64 // DIGIT)


def _shared_digit(ends, level: int) -> int | None:
    """The digit of a level if the smallest and largest keys prove that all keys share it.

    The last digit of a part is always counted, as decisions are taken there.
    """
    per_part = -(-64 // DIGIT)
    part, k = divmod(level, per_part)
    low, high = ends[f"low{part}"], ends[f"high{part}"]
    if k == per_part - 1 or low is None:
        return None
    shift = 64 - DIGIT * (k + 1)
    low, high = (low + (1 << 63)) >> shift, (high + (1 << 63)) >> shift
    return low & ((1 << DIGIT) - 1) if low == high else None


def _crossings(cells: DataFrame, targets: DataFrame) -> list:
    """For each target (t, iv, goal, b0, n0) the cell of its interval in which the running bytes pass the goal.

    ``cells`` has iv, d, b, n: at most 2^DIGIT rows an interval. One row a target: t, d, the bytes and rows
    below the cell, and the cell's own; d is null if the interval ends first.
    """
    order = Window.partitionBy("iv").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    below = cells.select("iv", "d", "b", "n", *(F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}_below") for c in "bn"))
    ends = below.groupBy("iv").agg(F.sum("b").alias("b_all"), F.sum("n").alias("n_all"))
    met = below.join(F.broadcast(targets), "iv").where((F.col("b0") + F.col("b_below") + F.col("b") > F.col("goal")) & (F.col("b0") + F.col("b_below") <= F.col("goal")))
    met = met.select("t", "d", (F.col("b0") + F.col("b_below")).alias("below"), (F.col("n0") + F.col("n_below")).alias("under"), "b", "n")
    rest = F.broadcast(targets).join(ends, "iv").where(F.col("b0") + F.col("b_all") <= F.col("goal"))
    rest = rest.select("t", F.lit(None).cast("long").alias("d"), (F.col("b0") + F.col("b_all")).alias("below"), (F.col("n0") + F.col("n_all")).alias("under"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n"))
    return met.unionByName(rest).collect()


def find_splitters(keys: DataFrame, total: int, ends, slack: list[float], together: float = 0.0) -> list[dict]:
    """Splitters 1 .. len(slack) as digit prefixes, with exact bytes and rows below each.

    ``keys`` has k0, k1 (unsigned order) and size. Splitter t cuts off t of len(slack) + 1
    equal shares of the bytes ``total``, within ``slack[t - 1]`` bytes. A target inside the
    rows of one k0 moves to their nearer end if that is at most ``together`` bytes away; else these
    rows are split by k1.
    """
    runs = len(slack) + 1
    found: dict[int, dict] = {}
    if not ends.rows:
        return [{"prefix": (), "bytes": 0, "rows": 0}] * (runs - 1)
    spark = keys.sparkSession
    # prefix of digits -> (bytes below, rows below, the targets not yet met)
    open_: dict[tuple, tuple[int, int, list[int]]] = {(): (0, 0, list(range(1, runs)))}
    for level in range(LEVELS):
        if not any(v[2] for v in open_.values()):
            break
        same = _shared_digit(ends, level)
        if same is not None:  # all keys have this digit, so there is nothing to count
            open_ = {(*prefix, same): v for prefix, v in open_.items()}
            continue
        order = sorted(open_)
        # at most runs - 1 intervals and targets are open, so these sides are bounded by parameters
        goals = [(t, i, total * t / runs, b, n) for i, p in enumerate(order) for b, n, ts in [open_[p]] for t in ts]
        targets = spark.createDataFrame(goals, "t int, iv int, goal double, b0 long, n0 long")
        if level:
            live = spark.createDataFrame([(i, *p) for i, p in enumerate(order)], "iv int, " + ", ".join(f"p{k} long" for k in range(level)))
            inside = keys.join(F.broadcast(live), [_digit(k) == F.col(f"p{k}") for k in range(level)])
        else:
            inside = keys.withColumn("iv", F.lit(0))
        counted = inside.groupBy("iv", _digit(level).alias("d")).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        nxt: dict[tuple, tuple[int, int, list[int]]] = {}
        prefix_of = {t: order[i] for t, i, *_ in goals}
        for r in sorted(_crossings(counted, targets)):
            prefix, goal, room = prefix_of[r.t], total * r.t / runs, slack[r.t - 1]
            if r.d is None:
                found[r.t] = {"prefix": (*prefix, 1 << DIGIT), "bytes": r.below, "rows": r.under}
                continue
            # one row, or one whole key, can't be split: the nearer side is the best there is
            whole = r.n == 1 or level == LEVELS - 1
            if level == LEVELS // PARTS - 1 and min(goal - r.below, r.below + r.b - goal) <= together:
                whole = True
            if goal - r.below <= room or whole and goal - r.below <= r.b / 2:
                found[r.t] = {"prefix": (*prefix, r.d), "bytes": r.below, "rows": r.under}
            elif r.below + r.b - goal <= room or whole:
                found[r.t] = {"prefix": (*prefix, r.d + 1), "bytes": r.below + r.b, "rows": r.under + r.n}
            else:
                nxt.setdefault((*prefix, r.d), (r.below, r.under, []))[2].append(r.t)
        open_ = nxt
    return [found[t] for t in range(1, runs)]


def _lowest_key(prefix: tuple) -> int:
    """The smallest key with these leading digits as one unsigned number; a carry may make it 2^128."""
    per_part = -(-64 // DIGIT)
    value = 0
    for level in range(LEVELS):
        _, k = divmod(level, per_part)
        width = min(DIGIT, 64 - DIGIT * k)
        value = (value << width) + (prefix[level] if level < len(prefix) else 0)
    return value


def _passed(inner: Column, k0: Column, k1: Column) -> Column:
    """How many of the sorted splitters (a, b) are at or below a key, by binary search."""

    def narrow(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        x = F.get(inner, mid)
        below = (x["a"] < k0) | ((x["a"] == k0) & (x["b"] <= k1))
        go = s["lo"] < s["hi"]
        return F.struct(F.when(go & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(go & ~below, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(inner).alias("hi"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(inner) + 1)).cast("int"))
    return F.when(F.size(inner) > 0, F.aggregate(steps, start, narrow, lambda s: s["lo"])).otherwise(0)


def shard_by_bytes(df: DataFrame, key: list[Column], size: Column, shards: int, tolerance: float = 0.002, together: float = 0.005, runs_per_shard: int | None = None) -> DataFrame:
    """Append ``shard`` and ``slot`` to the rows of ``df``: shards of near equal bytes.

    ``key`` has one or two integral columns, compared as signed numbers, nulls as
    the smallest; rows with an equal whole key stay in one run. Rows with an equal first
    part (here: equal texts) stay in one shard where moving a cut by at most ``together``
    of a shard's bytes does it; larger groups are split between neighbouring shards. ``slot`` numbers a
    shard's rows from 0 without gaps, in key order. An empty table gives an empty
    result. Columns of ``df`` named like the helper columns are kept as they are,
    since all helpers live in one struct until the end.
    """
    spark = df.sparkSession
    key = (key + [F.lit(0).cast("long")])[:PARTS]
    smallest = -(1 << 63)
    flip = [F.coalesce(k.cast("long"), F.lit(smallest)).bitwiseXOR(F.lit(smallest)) for k in key]
    row = df.select(F.struct("*").alias("row"), *(f.alias(f"k{i}") for i, f in enumerate(flip)), size.cast("long").alias("size"))
    keys = row.select("k0", "k1", "size")
    ends = keys.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.count("*").alias("rows"),
        *(f(F.col(f"k{i}").bitwiseXOR(F.lit(smallest))).alias(f"{n}{i}") for i in range(PARTS) for n, f in (("low", F.min), ("high", F.max))),
    ).first()
    if runs_per_shard is None:
        runs_per_shard = min(MOST_RUNS, max(1, -(-ends.rows // (shards * RUN_ROWS))))
    runs = shards * runs_per_shard
    one = ends.total / shards
    slack = [(tolerance if t % runs_per_shard == 0 else LOOSE / runs_per_shard) * one for t in range(1, runs)]
    splitters = find_splitters(keys, ends.total, ends, slack, together * one)

    # a fixed table of the first digit's cells: the run that a cell starts in, and the splitters inside it
    cells: list[list] = [[d, 0, []] for d in range(1 << DIGIT)]
    ordered = sorted((_lowest_key(s["prefix"]), t + 1) for t, s in enumerate(splitters))
    top = 128 - DIGIT
    at = 0
    for d in range(1 << DIGIT):
        while at < len(ordered) and ordered[at][0] <= d << top:
            at += 1
        cells[d][1] = at
        cells[d][2] = [v for v, _ in ordered[at:] if v >> top == d]
    half = 1 << 63
    grid = spark.createDataFrame(
        [(d, base, [((v >> 64) - half, v % (1 << 64) - half) for v in inner]) for d, base, inner in cells],
        "cell long, base int, inner array<struct<a:long,b:long>>",
    )
    k0, k1 = (F.col(f"k{i}").bitwiseXOR(F.lit(smallest)) for i in range(PARTS))
    passed = _passed(F.col("inner"), k0, k1)
    placed = row.join(F.broadcast(grid), _digit(0) == F.col("cell")).withColumn("run", F.col("base") + passed)
    first = [0, *(s["rows"] for s in splitters)]
    # one exchange: by run; a run's rows are sorted and numbered in one task
    starts = spark.createDataFrame(
        [(r, r // runs_per_shard, first[r] - first[r - r % runs_per_shard]) for r in range(runs)], "run int, shard int, start long"
    )
    w = Window.partitionBy("run").orderBy(k0, k1, "size")
    numbered = placed.withColumn("nth", F.row_number().over(w)).join(F.broadcast(starts), "run")
    return numbered.select("row.*", "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"))
