"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one partial aggregation and one join on narrow rows; edges are written to
shared storage after every round, and the loop ends when a round changes nothing. Hubs
with very many edges meet only in a minimum (combined before the shuffle) and in a join
whose large side the engine may split.

Defined results: edges with a null end say nothing and are left out, as are loops; repeated
edges count once; ids without an edge to another are in no component; no edges, no rows. Only src
and dst are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id of ``edges`` (src, dst); comp is the component's smallest id."""
    edges = edges.where("src is not null and dst is not null")
    both = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct()
    edges = materialise(both, "edges")
    seen = _state(edges)
    while True:
        # large star: every larger neighbour of u is linked to u's smallest neighbour
        sym = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = sym.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("u"), F.least("src", "m").alias("m"))
        large = sym.join(low, F.col("src") == F.col("u")).where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        # small star: the smaller neighbours of u, and u, are linked to the smallest of them
        least = large.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("u"), "m")
        moved = large.join(least, F.col("src") == F.col("u")).where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        edges = materialise(moved.union(least.select(F.col("u").alias("src"), F.col("m").alias("dst"))).distinct(), "edges")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("comp")).union(edges.select(F.col("dst").alias("id"), F.col("dst").alias("comp")).distinct())
