"""Shared helpers: durable intermediate tables, null-safe inputs, batch-wise text hashing.

The numpy helpers work on whole Arrow batches. Temporaries are bounded: a batch is
cut into slices of at most ``SLICE_BYTES`` of text, and a longer single text is cut
again at white space, so a text of any length is read in full with bounded memory.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of ``sf_dir``, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only on a local master that names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="reelspark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/reelspark/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the plan once; a lost executor costs
    only a re-read, as the files are in shared storage. ``release`` deletes the files.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application's ``materialise`` wrote; results that read them must be stored first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col):
    """Lower-case A-Z only, in the JVM."""
    return F.translate(col, UPPER, LOWER)


# ---------------------------------------------------------------- numpy on Arrow batches


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and len + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Runs (first, end) of rows with at most ``limit`` bytes, or one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LONG_WORD = 64
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def lower_bytes(buf: np.ndarray) -> np.ndarray:
    """Lower-case A-Z of UTF-8 bytes."""
    return buf + (((buf - np.uint8(65)) < 26) * np.uint8(32))


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs free of white space) of a slice; texts end words."""
    inside = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(buf):
        edge[0], edge[-1] = inside[0], inside[-1]
    starts = edge[:-1] & inside
    ends = np.zeros(len(buf) + 1, bool)
    ends[1:] = edge[1:] & inside
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(buf))]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    starts[cuts] = True
    ends[cuts] = True
    return np.flatnonzero(starts), np.flatnonzero(ends)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes a step."""
    padded = np.zeros(len(buf) + 16, np.uint8)
    padded[: len(buf)] = buf
    loads = np.ndarray((len(buf) + 8,), "<u8", buffer=padded, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * _GOLD)
    active = np.flatnonzero(size <= LONG_WORD) if len(size) and size.max() > LONG_WORD else None
    at = starts if active is None else starts[active]
    left = size if active is None else size[active]
    acc = h if active is None else h[active]
    step = 0
    live = np.arange(len(at))
    while len(live):
        acc[live] = mix((acc[live] ^ (loads[at[live] + step] & _TAIL[np.minimum(left[live] - step, 8)])) * _GOLD)
        step += 8
        live = live[left[live] > step]
    if active is not None:
        h[active] = acc
        for i in np.flatnonzero(size > LONG_WORD):
            digest = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
            h[i] = np.frombuffer(digest, "<u8")[0]
    return h


def _pieces(buf: np.ndarray, limit: int):
    """Cut one long text after white space into pieces of about ``limit`` bytes."""
    at = 0
    while at < len(buf):
        end = min(len(buf), at + limit)
        while end < len(buf) and not SPACE[buf[end - 1]]:
            nxt = np.flatnonzero(SPACE[buf[end : end + limit]])
            end = end + int(nxt[0]) + 1 if len(nxt) else min(len(buf), end + limit)
        yield buf[at:end]
        at = end


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of a slice and, per text, the offsets into them."""
    offsets = offsets - offsets[0]
    if len(offsets) == 2 and len(buf) > 2 * SLICE_BYTES:
        hashes = np.concatenate([_slice_hashes(p, np.array([0, len(p)]))[0] for p in _pieces(buf, SLICE_BYTES)])
        return hashes, np.array([0, len(hashes)])
    return _slice_hashes(buf, offsets)


def _slice_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = lower_bytes(buf)
    starts, ends = word_spans(low, offsets)
    return span_hashes(low, starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int):
    """For each text of a slice, its sorted distinct shingle hashes.

    A text with fewer words than ``width``, but one at least, has its whole word
    sequence as its only shingle; a text without words has the empty set.
    """
    words, at = word_hashes(buf, offsets)
    n = len(words)
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        full = mix((full + words[j : j + len(full)]) * _GOLD)
    for i in range(len(offsets) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        elif b > a:
            short = np.zeros(1, np.uint64)
            for w in words[a:b]:
                short = mix((short + w) * _GOLD)
            yield mix(short ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
