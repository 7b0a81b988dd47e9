"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is (length, two polynomials over its normalised bytes modulo a
prime). Chunks are hashed side by side (one matrix product for ``STRIDE`` chunks of a
text) and combined by length-shifted arithmetic, h(AB) = h(A) * r^|B| + h(B). A huge text
is lower-cased, hashed and digested a stride at a time, so beside the text itself only
temporaries of a stride (9 bytes a byte) are in memory. Equal fingerprints only nominate: the
texts of a group are then cut into chunks, and the chunks of each number are compared. A group
with unlike chunks falls apart by its texts' digests.

A hot group (a third of all rows may be equal) is counted and compared by partial
aggregation: each task sends one row for each fingerprint and chunk, so no task
holds a group.

Defined results: null text counts as empty; empty texts are equal to each other.
A null ``doc_id`` is the smallest. Of rows that repeat a ``doc_id`` and text, one is kept.
Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, lower_bytes, materialise, text_buffer

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_101)
CHUNK = 1 << 14
STRIDE = 64  # chunks of a text whose temporaries are in memory at once


def powers(base: int, n: int, prime: int = PRIME) -> np.ndarray:
    """base^(n-1), ..., base^1, base^0 modulo ``prime``."""
    out = np.ones(n, np.uint64)
    for k in range(1, n):
        out[n - 1 - k] = int(out[n - k]) * base % prime
    return out


def combine(left: int, right: int, right_length: int, base: int, prime: int = PRIME) -> int:
    """The fingerprint of AB from those of A and B."""
    return (left * pow(base, right_length, prime) + right) % prime


def fingerprint(data: np.ndarray, tables: list[np.ndarray], bases=BASES, prime: int = PRIME, chunk: int = CHUNK, seen=None) -> tuple[int, ...]:
    """The polynomials of a text's bytes, lower-cased in A-Z: a stride's whole chunks in one product, then combined.

    ``seen`` is called with the normalised bytes, a stride at a time.
    """
    out = [0] * len(bases)
    for at in range(0, len(data), STRIDE * chunk):
        low = lower_bytes(data[at : at + STRIDE * chunk])
        if seen is not None:
            seen(low)
        whole = len(low) // chunk
        rest = len(low) - whole * chunk
        wide = low.astype(np.uint64) + np.uint64(1)
        for k, (base, table) in enumerate(zip(bases, tables)):
            if whole:
                shift = pow(base, chunk, prime)
                for v in ((wide[: whole * chunk].reshape(whole, chunk) @ table) % np.uint64(prime)).tolist():
                    out[k] = (out[k] * shift + v) % prime
            if rest:
                out[k] = combine(out[k], int(wide[whole * chunk :] @ table[chunk - rest :]) % prime, rest, base, prime)
    return tuple(out)


def _digests(prime: int, chunk: int):
    def run(batches):
        tables = [powers(b % prime, chunk, prime) for b in BASES]
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            f1, f2, sha = [], [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                digest = hashlib.sha256()
                x, y = fingerprint(buf[a:b], tables, prime=prime, chunk=chunk, seen=digest.update)
                f1.append(x)
                f2.append(y)
                sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.diff(off)), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "f1", "f2", "text_sha256"],
            )

    return run


def folded_sha256(text: Column) -> Column:
    """The digest by which a row's text is known: that of the text lower-cased in A-Z; null is empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def _mixed(docs: DataFrame, digests: DataFrame, finger: list[str], chunk: int) -> DataFrame:
    """Fingerprints whose texts differ, found by comparing the texts chunk by chunk.

    Each nominated text is cut into chunks; equal chunks of a fingerprint and chunk
    number collapse before the shuffle, so a group of any size sends one row a task. A row
    finds its fingerprint by id and digest, so ids that very many texts share make no pairs.
    """
    nominated = digests.join(digests.groupBy(*finger).agg(F.count("*").alias("rows")).where("rows > 1").drop("rows"), finger)
    keyed = docs.select("doc_id", ascii_lower(F.col("text")).alias("low"), folded_sha256(F.col("text")).alias("sha")).join(
        nominated.select(F.col("doc_id").alias("n_id"), "text_sha256", *finger).hint("shuffle_hash"),
        F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("sha") == F.col("text_sha256")),
    )
    last = F.greatest(F.lit(0), F.ceil(F.length("low") / chunk).cast("int") - 1)
    parts = keyed.select(*finger, "low", F.explode(F.sequence(F.lit(0), last)).alias("no"))
    parts = parts.select(*finger, "no", F.substring("low", F.col("no") * chunk + 1, F.lit(chunk)).alias("part"))
    texts = parts.groupBy(*finger, "no", "part").agg(F.count("*").alias("n"))
    return texts.groupBy(*finger, "no").agg(F.count("*").alias("texts")).where("texts > 1").select(*finger).distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prime: int = PRIME, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_bytes."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    finger = ["n_bytes", "f1", "f2"]
    digests = materialise(
        narrow.mapInArrow(_digests(prime, chunk), "doc_id long, n_bytes long, f1 long, f2 long, text_sha256 string")
        .groupBy("doc_id", *finger, "text_sha256").agg(F.count("*").alias("copies")),
        "fingerprints",
    )
    mixed = materialise(_mixed(narrow, digests, finger, chunk).withColumn("mixed", F.lit(True)), "collisions")
    # a fingerprint with unlike texts falls apart by digest; all others are proved equal
    rows = digests.join(mixed, finger, "left").withColumn("part_of", F.when(F.col("mixed"), F.col("text_sha256")).otherwise(F.lit("")))
    key = [*finger, "part_of"]
    groups = rows.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    out = rows.join(groups, key).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_bytes")
