"""Operators on packets and pictures in stream order.

Every window is partitioned by file (or stream), so streams are independent. The exact
multiplexer needs running state and is a grouped pandas function of one file.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timebase import period_samples, target_samples

LEVELS = ("none", "b", "bp", "bpi", "all")


def demux(packets: DataFrame, types: list[str], streams: list[int] | None = None) -> DataFrame:
    """Packets of the given types and enabled streams; the filter reaches the scan."""
    kept = packets.where(F.col("ptype").isin(types))
    return kept if streams is None else kept.where(F.col("stream").isin(streams))


def validate(packets: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good packets, and quarantined ones with the names of the checks that failed."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    judged = packets.withColumn("failed", failed)
    return judged.where(F.size("failed") == 0).drop("failed"), judged.where(F.size("failed") > 0)


def drop_policy(frames: DataFrame, level: str, file: str = "file", order: str = "seq") -> DataFrame:
    """Add ``dropped`` to pictures of kind I, P or B.

    The level drops B, then P, then I pictures. A dropped or missing reference poisons all
    later P and B pictures until the next I picture that isn't dropped.
    """
    n = LEVELS.index(level)
    own = ((F.col("kind") == "B") & F.lit(n >= 1)) | ((F.col("kind") == "P") & F.lit(n >= 2)) | ((F.col("kind") == "I") & F.lit(n >= 3)) | F.lit(n >= 4)
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = frames.withColumn("own", own).withColumn("gop", F.sum((F.col("kind") == "I").cast("int")).over(w))
    before = Window.partitionBy(file, "gop").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    poisoned = F.max((F.col("own") & (F.col("kind") != "B")).cast("int")).over(before) == 1
    lost = (F.col("gop") == 0) & (F.col("kind") != "I")
    return marked.withColumn("dropped", F.col("own") | (poisoned & (F.col("kind") != "I")) | lost).drop("own")


def has_references(frames: DataFrame, file: str = "file", order: str = "seq") -> DataFrame:
    """Add ``ready``: P pictures need one earlier reference, B pictures two."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    refs = F.coalesce(F.sum((F.col("kind") != "B").cast("int")).over(w), F.lit(0))
    need = F.when(F.col("kind") == "I", 0).when(F.col("kind") == "P", 1).otherwise(2)
    return frames.withColumn("ready", refs >= need)


def reference_slots(frames: DataFrame, file: str = "file", order: str = "seq") -> DataFrame:
    """Add ``past`` and ``future``: the last two references before a picture, in stream order."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    refs = frames.withColumn("ref", F.when(F.col("kind") != "B", F.col(order)))
    refs = refs.withColumn("future", F.last("ref", ignorenulls=True).over(w))
    # the reference before the last one: what the last reference itself saw as its latest
    seen = F.when(F.col("kind") != "B", F.coalesce(F.col("future"), F.lit(-1)))
    refs = refs.withColumn("seen", seen)
    return refs.withColumn("past", F.nullif(F.last("seen", ignorenulls=True).over(w), F.lit(-1))).drop("ref", "seen")


def random_access(frames: DataFrame, file: str = "file", order: str = "seq") -> DataFrame:
    """Add ``random_access``: an I picture followed by none, an I or a P picture."""
    nxt = F.lead("kind").over(Window.partitionBy(file).orderBy(order))
    return frames.withColumn("random_access", (F.col("kind") == "I") & (nxt.isNull() | nxt.isin("I", "P")))


def sync_points(frames: DataFrame, file: str = "file", order: str = "seq") -> DataFrame:
    """(file, period, random_access): display-order syncs emitted at each picture, and the flush at the end.

    A reference emits the one before it, and before that a B picture that was open; a B
    picture emits an open B picture. Periods count from 1.
    """
    w = Window.partitionBy(file).orderBy(order)
    rows = random_access(frames, file, order).withColumn("open", F.lag("kind").over(w)).withColumn("last", F.lead("kind").over(w).isNull())
    one = lambda flag: F.array(flag)
    none = F.expr("cast(array() as array<boolean>)")
    ref = F.when(F.col("open").isNull(), none).when(F.col("open") == "B", F.array(F.lit(False), F.col("random_access"))).otherwise(one(F.col("random_access")))
    b = F.when(F.col("open") == "B", one(F.lit(False))).otherwise(none)
    tail = F.when(F.col("last") & (F.col("kind") == "B"), F.array(F.lit(False), F.lit(False))).when(F.col("last"), one(F.lit(False))).otherwise(none)
    syncs = rows.select(file, order, F.posexplode(F.concat(F.when(F.col("kind") == "B", b).otherwise(ref), tail)).alias("k", "random_access"))
    return syncs.select(file, F.row_number().over(Window.partitionBy(file).orderBy(order, "k")).alias("period"), "random_access")


def segment_lengths(marks: DataFrame, file: str = "file", pos: str = "pos", size: str = "file_size") -> DataFrame:
    """Add ``length``: up to the next mark, the last up to the file's end."""
    w = Window.partitionBy(file).orderBy(pos)
    return marks.withColumn("length", F.coalesce(F.lead(pos).over(w), F.col(size)) - F.col(pos))


def next_picture(marks: DataFrame, is_picture: Column, file: str = "file", pos: str = "pos") -> DataFrame:
    """Add ``next_picture``: position of the following picture mark."""
    w = Window.partitionBy(file).orderBy(pos).rowsBetween(1, Window.unboundedFollowing)
    return marks.withColumn("next_picture", F.first(F.when(is_picture, F.col(pos)), ignorenulls=True).over(w))


def align_audio(syncs: DataFrame, blocks: DataFrame, rate: int, num: int, den: int) -> DataFrame:
    """Audio blocks (file, start, stop) that hold each period's first sample, and the samples to trim.

    The interval join meets on a bucket of the time axis, so it is an equi-join.
    """
    bucket = 1 << 14
    at = syncs.withColumn("t", period_samples(F.col("period"), rate, num, den)).withColumn("bucket", F.floor(F.col("t") / bucket))
    spans = blocks.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("stop") - 1) / bucket))))
    met = at.join(spans, ["file", "bucket"]).where("start <= t and t < stop")
    return met.select("file", "period", "t", "start", "stop", (F.col("t") - F.col("start")).alias("trim"))


def interleave(video: DataFrame, audio: DataFrame, rate: int, num: int, den: int, readahead: int) -> DataFrame:
    """Exact multiplex of one video and any audio streams of each file.

    ``video`` has (file, seq, period), ``audio`` (file, stream, block, stop): blocks end at
    sample ``stop``. Before each video sync, blocks of every stream are copied until the
    target is reached, unless the next block ends beyond it. Rows: (file, out, kind,
    stream, ref, target). One file's headers, not payloads, are in memory at once.
    """
    v = video.select("file", F.lit("v").alias("kind"), F.lit(-1).alias("stream"), F.col("seq").alias("ref"), F.col("period").alias("at"))
    v = v.withColumn("target", target_samples(F.col("at"), rate, num, den, readahead))
    a = audio.select("file", F.lit("a").alias("kind"), F.col("stream").cast("int").alias("stream"), F.col("block").alias("ref"), F.col("stop").alias("at"), F.lit(0).cast("long").alias("target"))

    def merged(file, syncs: list, streams: dict[int, list]) -> list[tuple]:
        order = sorted(streams)
        for s in order:
            streams[s].sort()
        head, end = dict.fromkeys(order, 0), dict.fromkeys(order, 0)
        rows: list[tuple] = []
        for seq, target in sorted(syncs):
            for s in order:
                blocks, k = streams[s], head[s]
                if k < len(blocks) and blocks[k][0] <= target and end[s] < target:
                    while k < len(blocks) and end[s] < target:
                        end[s], ref = blocks[k]
                        rows.append((file, len(rows), "a", s, ref, target))
                        k += 1
                    head[s] = k
            rows.append((file, len(rows), "v", -1, seq, target))
        return rows

    def run(batches):
        names = ["file", "out", "kind", "stream", "ref", "target"]
        now, syncs, streams, held, begun = None, [], {}, [], False
        for pdf in batches:
            for file, kind, s, ref, at, target in zip(*(pdf[c].tolist() for c in ("file", "kind", "stream", "ref", "at", "target"))):
                if begun and file != now:
                    held += merged(now, syncs, streams)
                    syncs, streams = [], {}
                    if len(held) >= 50_000:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                now, begun = file, True
                if kind == "v":
                    syncs.append((ref, target))
                else:
                    streams.setdefault(s, []).append((at, ref))
        if begun:
            held += merged(now, syncs, streams)
        yield pd.DataFrame(held, columns=names)

    # files stand together in sorted partitions, so there is no group call for each of many small files
    rows = v.unionByName(a).where("file is not null").repartition("file").sortWithinPartitions("file")
    return rows.mapInPandas(run, f"file {video.schema['file'].dataType.simpleString()}, out long, kind string, stream int, ref long, target long")


def packet_statistics(packets: DataFrame, file: str = "file", order: str = "seq") -> DataFrame:
    """Largest packet and longest gap between sync packets, by file."""
    at = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = packets.withColumn("offset", F.coalesce(F.sum("size").over(at), F.lit(0)))
    syncs = Window.partitionBy(file, "is_sync").orderBy(order)
    gap = F.when(F.col("is_sync"), F.col("offset") - F.lag("offset").over(syncs))
    return placed.withColumn("gap", gap).groupBy(file).agg(F.max("size").alias("largest_packet"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_readahead"))


def union_streams(*streams: DataFrame) -> DataFrame:
    """All packets in one table, by name."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def mix_groups(sources: DataFrame) -> DataFrame:
    """Devices whose sources share one sample rate, with the samples all of them have."""
    g = sources.where("device is not null").groupBy("device").agg(F.countDistinct("rate").alias("rates"), F.min("available").alias("available"), F.count("*").alias("n_sources"))
    return g.where("rates = 1").drop("rates")


def ranked(rows: DataFrame, order: list[Column], materialise) -> DataFrame:
    """Add ``rank``, from 1: a global rank without a single task that sees all rows.

    Rows are range-partitioned and sorted, written once, counted by part, and numbered from
    the rows of the parts before. The parts' counts are one row for each part.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = materialise(parts, "ranges")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def sort_sources(sources: DataFrame, materialise) -> DataFrame:
    """Sources with a device first, then by device, layout and metaID: adds ``rank``."""
    return ranked(sources, [F.col("device").asc_nulls_last(), F.col("layout"), F.col("meta_id"), F.col("source_id")], materialise)


def with_audio_syncs(frames: DataFrame, samples: int, file: str = "file", order: str = "seq") -> DataFrame:
    """Two rows for each audio frame: the frame, and the sync that commits it."""
    period = F.row_number().over(Window.partitionBy(file).orderBy(order)) * samples
    rows = frames.withColumn("period", period)
    return rows.withColumn("ptype", F.explode(F.array(F.lit("audio_frame"), F.lit("audio_sync"))))


def with_video_syncs(frames: DataFrame, file: str = "file", order: str = "seq") -> DataFrame:
    """Two rows for each frame of codebook video: the frame, and the sync point that shows it; only the first is random access."""
    period = F.row_number().over(Window.partitionBy(file).orderBy(order))
    rows = frames.withColumn("period", period).withColumn("random_access", F.col("period") == 1)
    return rows.withColumn("ptype", F.explode(F.array(F.lit("video_inline"), F.lit("video_sync"))))


def decode_kept(frames: DataFrame, level: str, decode: Column, out: str = "decoded", file: str = "file", order: str = "seq") -> DataFrame:
    """Frames that the drop policy keeps, decoded: dropped ones are filtered out before ``decode`` sees them."""
    return drop_policy(frames, level, file, order).where(~F.col("dropped")).withColumn(out, decode)


def header_bytes(size: Column, stream: Column) -> Column:
    """Bytes of a packet's header: 7 where the short form holds it, else 10."""
    return F.when((stream == 0) & (size < 32768), 7).otherwise(10)
