"""Benchmark decontamination by size-partitioned MinHash containment, DataFrame operations only.

Test items are short and documents long, so resemblance says little; containment
|item and document| / |item| is what counts. The one-sided form of MinHash for containment
is used (containment MinHash: only the small set is sketched, and membership of its
minima in the large set is tested), since a signature of the document, too, would have to be as
long as document over item to say anything. Items are partitioned by the size of
their shingle set. An item's sketch holds its k smallest shingles in hash order (a bottom-k
MinHash), k following from its partition: with a containment of ``threshold`` at least, at most
n - ceil(threshold * n) of an item's n shingles are missing from the document, so a
sketch of one more than that for the partition's largest n has at least one shingle
inside it. The search is therefore lossless, for documents of any length, and the
index is as small as the benchmark. Candidate pairs are verified on the item's exact
shingles (their words, not hashes).

Words are maximal runs of letters and digits, lower-cased, so case and punctuation
do not hide a leak. Items with fewer words than ``width`` are one shingle of all
their words. Items or documents that are null or without words contain nothing. Item
ids and document ids may repeat: rows of one id count together. No other column is
read.

The index (shingles of the benchmark) is broadcast only while its counted rows are
within ``broadcast_rows``; a larger one is joined by shuffle. A passage that very many
documents share costs a row for each document and shingle, not for pairs of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SPLIT = r"[^\p{L}\p{N}]+"
WIDTH = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def _grams(words_: Column, width: Column | int) -> Column:
    """All runs of ``width`` words as text, in order; none if there are fewer."""
    last = F.size(words_) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words_, i + 1, width), " "))).otherwise(
        F.expr("cast(array() as array<string>)")
    )


def _hashes(words_: Column, width: Column) -> Column:
    """Hashes of all runs of ``width`` words."""
    return F.when(
        F.size(words_) >= width,
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(words_) - width, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(words_, i + 1, width), " "))),
    )


def index_items(items: DataFrame, item_id: str, item_text: str, width: int, threshold: float) -> DataFrame:
    """(item_id, width, n, shingle, h, in_sketch): every distinct shingle of every item."""
    base = items.select(F.col(item_id).cast("long").alias("item_id"), words(F.col(item_text)).alias("w")).where("size(w) > 0 and item_id is not null")
    base = base.withColumn("width", F.least(F.size("w"), F.lit(width)))
    grams = base.select("item_id", "width", F.explode(_grams(F.col("w"), F.col("width"))).alias("shingle")).distinct()
    grams = grams.withColumn("h", F.xxhash64("shingle"))
    sized = grams.groupBy("item_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("h", "shingle", "width"))).alias("all"))
    # partition j holds the sizes in [2^j, 2^(j+1)); its k fits its largest size
    top = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    k = (top - F.ceil(F.round(top * threshold, 9)) + 1).cast("int")
    return sized.withColumn("k", k).select("item_id", "n", "k", F.posexplode("all").alias("at", "s")).select(
        "item_id", "n", F.col("s.width").alias("width"), F.col("s.shingle").alias("shingle"), F.col("s.h").alias("h"), (F.col("at") < F.col("k")).alias("in_sketch")
    )


def contained(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WIDTH, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, n_found) with n_found >= threshold * n_shingles."""
    index = materialise(index_items(items, item_id, item_text, width, threshold), "items")
    facts = index.groupBy("width").agg(F.count("*").alias("rows")).collect()  # one row for each width from 1 to ``width``
    small = sum(r.rows for r in facts) <= broadcast_rows
    near = F.broadcast if small else (lambda d: d)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    spelt = rows.select("doc_id", words(F.col("text")).alias("w"))
    widths = sorted(r.width for r in facts) or [width]
    # one pass over the texts; a text's words are gone through once for each width, so no array outgrows them.
    # runs of different widths differ as text
    probes = index.where("in_sketch").select("h", "item_id")
    each = F.explode(F.array(*map(F.lit, widths))).alias("width")
    grams = spelt.select("doc_id", "w", each).select("doc_id", F.explode(_hashes(F.col("w"), F.col("width"))).alias("h"))
    pairs = materialise(grams.join(near(probes), "h").select("doc_id", "item_id").distinct(), "candidates")

    suspects = rows.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    grams = suspects.select("doc_id", "w", each).select("doc_id", F.explode(F.array_distinct(_grams(F.col("w"), F.col("width")))).alias("shingle"))
    shared = grams.join(near(index.select("item_id", "n", "shingle")), "shingle")
    counts = shared.groupBy("doc_id", "item_id", "n").agg(F.countDistinct("shingle").alias("n_found"))
    counts = counts.join(pairs, ["doc_id", "item_id"], "left_semi")
    return counts.where(F.col("n_found") >= F.ceil(F.round(F.col("n") * threshold, 9))).select(
        "doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), F.col("n_found").cast("long").alias("n_found")
    )
