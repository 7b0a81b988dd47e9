"""A corpus pipeline: five stages over ``documents``, each a decision that takes effect.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of
documents; the last returns token ids. Rows are chosen by semi or anti joins, so documents'
columns pass through whatever their names. Stages never lose a row but by their own
decision. Exact copies are told apart by id and text, so an id may repeat and may be
null (the smallest); the other decisions go by id, and rows with a null id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import decontaminate, exact_dedup, near_dedup, pieces, quality
from reelspark.llm.common import materialise, table


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose id isn't among ``dropped`` (drop_id)."""
    return docs.join(dropped, docs["doc_id"] == dropped["drop_id"], "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model, least=0.3)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (lower-cased in A-Z; null is empty), one row with the largest doc_id stays.

    A row is known by its id and the digest of its text. Of several rows that have both
    in common, the one whose text is smallest stays, and any one of those with equal text.
    """
    groups = materialise(exact_dedup.exact_groups(docs), "exact-groups")
    stay = groups.groupBy(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha")).agg(F.max("kept").alias("kept"), F.count("*").alias("copies")).where("kept")
    rows = docs.select(F.struct("*").alias("row"), exact_dedup.folded_sha256(F.col("text")).alias("sha"))

    def among(keys: DataFrame) -> DataFrame:
        return rows.join(keys, F.col("row.doc_id").eqNullSafe(F.col("k_id")) & (F.col("sha") == F.col("k_sha")), "left_semi")

    kept = among(stay.where("copies = 1")).select("row.*")
    if stay.where("copies > 1").isEmpty():
        return kept
    one = among(stay.where("copies > 1")).groupBy("row.doc_id", "sha").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
    return kept.union(one.select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8), the smallest doc_id stays."""
    found = near_dedup.near_duplicates(docs, width=5, percent=80)
    return _without(docs, found.where("not kept").select(F.col("doc_id").alias("drop_id")).distinct())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    pairs = decontaminate.contained(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, pairs.select(F.col("doc_id").alias("drop_id")).distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece ids of every document, with a proof of the round trip."""
    return pieces.round_trip(docs, pieces.load())


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: the classifier, the similarity join and the sampler have no SQL; tests/llm holds brute force against them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
