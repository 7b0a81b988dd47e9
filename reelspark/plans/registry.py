"""All queries of the library proper.

Both engines' results get the same column types here: ranks, positions and sums as
BIGINT, lists as comma-separated text.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codec_queries, source_queries, stream_queries  # noqa: F401  they register their queries
from .queries import ORACLE_SQL, QUERIES

LONGS = {
    "vq_centroid_step": ("dim",), "vq_cell_box": ("dim", "third", "two_thirds"), "codebook_sort": ("luma_sum", "rank"), "ycbcr_to_rgb_bt601": ("r", "g", "b"), "ycbcr_to_rgb_jpeg": ("r", "g", "b"),
    "motion_compensate": ("plane", "x", "wanted"), "bipredict": ("v",), "vector_bounds": ("block_y", "block_x"), "motion_search": ("dy", "dx"), "copy_vectors": ("dx", "dy"),
    "sync_emission": ("period",), "source_sort": ("rank",), "top2_peaks": ("place",),
}
DOUBLES = {"pre_emphasis": ("out",)}
LISTS = {
    "codebook_pack": ("packed", "unpacked"), "channel_pack": ("argb", "abgr", "rgba", "bgra"), "range_coder": ("back",), "pulse_vectors": ("y",), "requantise": ("v",), "comment_headers": ("c",),
    "mismatch_control": ("coef",), "bit_packing": ("lsb", "msb"), "dct_roundtrip": ("back",),
}


def _typed(name: str) -> None:
    build, sql = QUERIES[name], ORACLE_SQL[name]
    longs, doubles, lists = (t.get(name, ()) for t in (LONGS, DOUBLES, LISTS))

    def typed(spark, sf_dir) -> DataFrame:
        df = build(spark, sf_dir)
        for c in longs:
            df = df.withColumn(c, F.col(c).cast("long"))
        for c in lists:
            df = df.withColumn(c, F.array_join(F.transform(c, lambda v: v.cast("string")), ","))
        return df

    casts = [f"{c}::bigint as {c}" for c in longs] + [f"{c}::double as {c}" for c in doubles] + [f"array_to_string({c}, ',') as {c}" for c in lists]
    QUERIES[name], ORACLE_SQL[name] = typed, f"select * replace ({', '.join(casts)}) from ({sql})"


for _name in (*LONGS, *DOUBLES, *LISTS):
    _typed(_name)

__all__ = ["ORACLE_SQL", "QUERIES"]
