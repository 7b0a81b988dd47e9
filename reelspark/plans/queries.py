"""Registered queries on the driver's tables, and the SQL that must give the same rows.

The tables hold no media, so each query's input is an analogue: vectors for image
blocks and for the pixels of frames, events for packets and pictures, and order lines for coding options.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import pixels, tags, timebase, transforms
from ..operators import blocks, frames, rate, stream, vq

SIDE, VECTORS = 32, 16  # a frame of 32 x 32 pixels is made of 16 vectors of 64 values
K = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- inputs


def points(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), vq.quantise(F.col("embedding")).alias("vec"))


def codebook(spark, d, k: int = K) -> DataFrame:
    """The k lowest vectors stand for a codebook of k entries: the entry count is the feature."""
    return points(spark, d).orderBy("point_id").limit(k).select(F.col("point_id").alias("cb_id"), "vec")


def assigned(spark, d) -> DataFrame:
    return vq.assign(points(spark, d), codebook(spark, d))


def pixel_rows(spark, d, shift: int = 0, planes: int = 3) -> DataFrame:
    """Vectors as frames: VECTORS of them fill the rows of a frame; planes differ by a texture. The last frame may be cut short."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "e"), F.floor(F.col("vec_id") / VECTORS).alias("frame"))
    at = F.col("vec_id") % VECTORS * 64 + F.col("k")
    rows = rows.select("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(planes - 1).cast("long"))).alias("plane"), F.floor(at / SIDE).alias("y"), (at % SIDE).alias("x"), F.floor(F.col("e").cast("double") * 128).alias("q"))
    v = F.col("q") + 128 + F.col("plane") * 31 + F.col("x") * F.col("y") % 11 + (F.col("x") + F.col("y") + F.col("frame")) % 5 * shift
    return rows.select("frame", "plane", "y", "x", F.pmod(v, F.lit(256)).cast("int").alias("v"))


def pixel_sql(shift: int = 0, planes: int = 3) -> str:
    return f"""(select frame, plane, y, x, cast((q + 128 + plane * 31 + x * y % 11 + (x + y + frame) % 5 * {shift} + 1024) % 256 as int) as v
        from (select frame, plane, n // {SIDE} as y, n % {SIDE} as x, q from (select vec_id // {VECTORS} as frame, vec_id % {VECTORS} * 64 + generate_subscripts(embedding, 1) - 1 as n,
        cast(floor(cast(unnest(embedding) as double) * 128) as bigint) as q from embeddings), (select unnest(range({planes})) as plane)))"""


def pictures(spark, d) -> DataFrame:
    """Events as pictures of one stream for each user: I, P or B by event type, in time order."""
    kind = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type").isin("purchase", "error"), "P").otherwise("B")
    return table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), kind.alias("kind"))


PICTURES_SQL = """(select user_id as file, event_id as seq,
    case when event_type = 'signup' then 'I' when event_type in ('purchase', 'error') then 'P' else 'B' end as kind from events)"""


def packets(spark, d) -> DataFrame:
    """Events as packets: type, stream, size; purchases are sync points."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("file"), F.col("event_id").alias("seq"), F.col("event_type").alias("ptype"), (F.col("user_id") % 3).alias("stream"),
        F.floor(F.col("value") * 100).cast("long").alias("size"), (F.col("event_type") == "purchase").alias("is_sync"),
    )


def macroblocks(spark, d) -> DataFrame:
    """Order lines as macroblocks of a slice; a difference and, on some lines, a quantiser."""
    from pyspark.sql import Window

    w = Window.partitionBy("slice_id").orderBy("l_linenumber", "part", "supp", "l_quantity", "l_extendedprice", "l_shipdate")
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("slice_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    # named before the window, so that later windows by slice reuse its partitioning
    return lines.withColumn("mb_addr", F.row_number().over(w).cast("long")).select(
        "slice_id", "mb_addr", (F.col("l_quantity").cast("long") * 7 - 150).alias("diff"), F.when(F.col("part") % 3 == 0, F.col("part") % 31 + 1).alias("q"), "part", "supp"
    )


BLOCKS_SQL = """(select l_orderkey as slice_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as mb_addr,
    cast(l_quantity as bigint) * 7 - 150 as diff, case when l_partkey % 3 = 0 then l_partkey % 31 + 1 end as q, l_partkey as part, l_suppkey as supp from lineitem)"""


def options(spark, d) -> DataFrame:
    """Order lines as the coding options of a block: bits and distortion."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("block_id"), F.col("l_linenumber").cast("long").alias("opt"), F.col("l_quantity").cast("long").alias("bits"),
        F.floor(F.col("l_extendedprice")).cast("long").alias("dist"),
    )


OPTIONS_SQL = "(select l_orderkey as block_id, cast(l_linenumber as bigint) as opt, cast(l_quantity as bigint) as bits, cast(floor(l_extendedprice) as bigint) as dist from lineitem)"
POINTS_SQL = "(select vec_id as point_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 128) as int)) as vec from embeddings)"
BOOK_SQL = f"(select point_id as cb_id, vec from {POINTS_SQL} order by point_id limit {K})"
ASSIGNED_SQL = f"""(select point_id, vec, cb_id, dist from (
    select p.point_id, p.vec, c.cb_id, list_sum(list_transform(range(1, len(p.vec) + 1), lambda i: (p.vec[i] - c.vec[i]) * (p.vec[i] - c.vec[i])))::bigint as dist,
           row_number() over (partition by p.point_id order by dist, c.cb_id) as r
    from {POINTS_SQL} p, {BOOK_SQL} c) where r = 1)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLE_SQL[name] = sql


# ---------------------------------------------------------------- vector quantisation

register("vq_assign", lambda s, d: assigned(s, d).select("point_id", "cb_id", "dist"), f"select point_id, cb_id, dist from {ASSIGNED_SQL}")
register("vq_cell_error", lambda s, d: vq.cell_error(assigned(s, d)), f"select cb_id, count(*) as n_points, sum(dist)::bigint as error from {ASSIGNED_SQL} group by rollup (cb_id)")
_HALF_AWAY = "case when s >= 0 then (2 * s + n) // (2 * n) else -((-2 * s + n) // (2 * n)) end"
register(
    "vq_centroid_step", lambda s, d: vq.centroids(assigned(s, d), codebook(s, d)),
    f"""with a as (select cb_id, unnest(vec) as x, generate_subscripts(vec, 1) - 1 as dim from {ASSIGNED_SQL}),
    m as (select cb_id, dim, sum(x)::bigint as s, count(*) as n from a group by 1, 2)
    select b.cb_id, b.dim, coalesce({_HALF_AWAY}, 0)::bigint as value from (select cb_id, generate_subscripts(vec, 1) - 1 as dim from {BOOK_SQL}) b
    left join m on m.cb_id = b.cb_id and m.dim = b.dim""",
)
register(
    "vq_cell_box", lambda s, d: vq.cell_box(assigned(s, d)),
    f"""with a as (select cb_id, unnest(vec) as x, generate_subscripts(vec, 1) - 1 as dim from {ASSIGNED_SQL})
    select cb_id, dim, min(x) as low, max(x) as high, min(x) + (max(x) - min(x)) // 3 as third, max(x) - (max(x) - min(x)) // 3 as two_thirds from a group by 1, 2""",
)
register(
    "codebook_sort", lambda s, d: vq.sort_codebook(codebook(s, d, 256), 4),
    f"""select cb_id, luma_sum, row_number() over (order by luma_sum, cb_id) as rank from
    (select point_id as cb_id, list_sum(vec[1:4]) as luma_sum from {POINTS_SQL} order by point_id limit 256)""",
)
register(
    "stride_sample", lambda s, d: vq.stride_sample(points(s, d).count(), K, s),
    f"""with n as (select count(*) as n from embeddings) select i, (i * 433494437) % n as pick from n, (select unnest(range(1000000)) as i)
    where i < case when n > {24 * K} then n // 8 else {K} end""",
)
register(
    "nearest_other", lambda s, d: vq.nearest_other(codebook(s, d)),
    f"""select cb_id, other_id, dist from (select a.cb_id, b.cb_id as other_id,
        list_sum(list_transform(range(1, len(a.vec) + 1), lambda i: (a.vec[i] - b.vec[i]) * (a.vec[i] - b.vec[i])))::bigint as dist,
        row_number() over (partition by a.cb_id order by dist, b.cb_id) as r from {BOOK_SQL} a join {BOOK_SQL} b on a.cb_id <> b.cb_id) where r = 1""",
)
_ERR_SQL = f"(select cb_id, sum(dist)::bigint as error from {ASSIGNED_SQL} group by cb_id)"
register(
    "utility_runs", lambda s, d: vq.utility_runs(vq.cell_error(assigned(s, d)).where("cb_id is not null").select("cb_id", "error")),
    f"""select cb_id, error, (sum(case when error > (select avg(error) from {_ERR_SQL}) then error else 0 end) over (order by cb_id))::bigint as cum from {_ERR_SQL}""",
)


def _pick(s, d):
    runs = vq.utility_runs(vq.cell_error(assigned(s, d)).where("cb_id is not null").select("cb_id", "error"))
    total = runs.agg(F.max("cum").alias("total"))
    draws = s.range(64).crossJoin(F.broadcast(total)).select(F.col("id").alias("draw"), ((F.col("id") * 433494437) % F.col("total") + 1).alias("r"))
    return vq.pick_by_utility(runs, draws)


register(
    "utility_pick", _pick,
    f"""with u as (select cb_id, sum(case when error > (select avg(error) from {_ERR_SQL}) then error else 0 end) over (order by cb_id) as cum from {_ERR_SQL}),
    dr as (select i as draw, (i * 433494437) % (select max(cum) from u) + 1 as r from (select unnest(range(64)) as i))
    select draw, min(cb_id) as cb_id from dr join u on u.cum >= dr.r group by draw""",
)
register(
    "codebook_pack", lambda s, d: codebook(s, d).select("cb_id", vq.pack_codebook(F.slice("vec", 1, 6), 4).alias("packed"), vq.unpack_codebook(vq.pack_codebook(F.slice("vec", 1, 6), 4), 4).alias("unpacked")),
    f"""select cb_id, list_concat(vec[1:4], list_transform(vec[5:6], lambda x: x * 2)) as packed,
    list_concat(vec[1:4], list_transform(vec[5:6], lambda x: cast(floor((x * 2 + 2) / 2) as int))) as unpacked from {BOOK_SQL}""",
)


def _expand(s, d):
    cb2 = codebook(s, d).select(F.col("cb_id").alias("cb2_id"), "vec")
    cb4 = s.range(K).select(F.col("id").alias("cb4_id"), F.array(*((F.col("id") * m) % K for m in (1, 3, 5, 7))).alias("cells"))
    return vq.expand_codebook(points(s, d).select(F.col("point_id").alias("block_id"), (F.col("point_id") % K).alias("cb4_id")), cb4, cb2)


register(
    "codebook_expand", _expand,
    f"""with b as (select cb_id, vec, row_number() over (order by cb_id) - 1 as k from {BOOK_SQL}), i as (select vec_id as block_id, vec_id % {K} as cb4_id from embeddings),
    q as (select block_id, q, (cb4_id * [1, 3, 5, 7][q + 1]) % {K} as cb2_id from i, (select unnest(range(4)) as q))
    select block_id, ((q // 2) * 2 + k2 // 2)::int as y, ((q % 2) * 2 + k2 % 2)::int as x, vec[k2 + 1] as v
    from q join b on b.cb_id = q.cb2_id, (select unnest(range(4)) as k2)""",
)


register("vq_elbg", lambda s, d: vq.elbg(points(s, d), codebook(s, d)))
register("vq_elbg_start", lambda s, d: vq.start_codebook(points(s, d), points(s, d).count(), K))

# ---------------------------------------------------------------- frames

_PAIR = f"{pixel_sql()} a join {pixel_sql(3)} b on a.frame = b.frame and a.plane = b.plane and a.y = b.y and a.x = b.x"
register(
    "frame_sse", lambda s, d: frames.errors(pixel_rows(s, d), pixel_rows(s, d, 3), ["frame", "plane"]),
    f"select a.frame, a.plane, sum((a.v - b.v) * (a.v - b.v))::bigint as sse, sum(abs(a.v - b.v))::bigint as sad, count(*) as n from {_PAIR} group by 1, 2",
)
register(
    "frame_masked_sse", lambda s, d: frames.masked_sse(pixel_rows(s, d), pixel_rows(s, d, 3), (F.col("x") + F.col("y")) % 2 == 0, 5000, ["frame", "plane"]),
    f"""select a.frame, a.plane, sum(case when (a.x + a.y) % 2 = 0 then (a.v - b.v) * (a.v - b.v) else 0 end)::bigint as sse,
    least(sum(case when (a.x + a.y) % 2 = 0 then (a.v - b.v) * (a.v - b.v) else 0 end), 5001)::bigint as sse_limited from {_PAIR} group by 1, 2""",
)
register(
    "frame_intra_sad", lambda s, d: frames.intra_sad(pixel_rows(s, d)),
    f"""with b as (select *, y // 8 as block_y, x // 8 as block_x from {pixel_sql()}), m as (select frame, plane, block_y, block_x, sum(v) // count(*) as m from b group by 1, 2, 3, 4)
    select b.frame, b.plane, b.block_y, b.block_x, sum(abs(v - m))::bigint as sad from b join m on b.frame = m.frame and b.plane = m.plane and b.block_y = m.block_y and b.block_x = m.block_x group by 1, 2, 3, 4""",
)
register(
    "frame_psnr", lambda s, d: frames.psnr(pixel_rows(s, d), pixel_rows(s, d, 3)),
    f"""with e as (select a.frame, a.plane, sum((a.v - b.v) * (a.v - b.v))::bigint as sse, count(*) as n from {_PAIR} group by 1, 2),
    g as (select frame, plane, sum(sse)::bigint as sse, sum(n)::bigint as n from e group by grouping sets ((frame, plane), (frame), ()))
    select frame, plane, sse, n, case when sse > 0 then round(10 * (log10(255.0 * 255.0) + log10(n) - log10(sse)), 6) end as psnr from g""",
)
register(
    "frame_unmatched", lambda s, d: frames.unmatched_frames(pixel_rows(s, d), pixel_rows(s, d).where("frame > 1").select((F.col("frame") + 1).alias("frame"))),
    f"""with a as (select distinct frame from {pixel_sql()}), b as (select distinct frame + 1 as frame from {pixel_sql()} where frame > 1)
    select coalesce(a.frame, b.frame) as frame, case when a.frame is null then 'second' else 'first' end as side from a full join b on a.frame = b.frame where a.frame is null or b.frame is null""",
)


def _yuv(s, d):
    p = pixel_rows(s, d).groupBy("frame", "y", "x").pivot("plane", [0, 1, 2]).agg(F.first("v"))
    return p.toDF("frame", "y", "x", "c0", "c1", "c2")


_YUV_SQL = f"(select a.frame, a.y, a.x, max(v) filter (plane = 0) as c0, max(v) filter (plane = 1) as c1, max(v) filter (plane = 2) as c2 from {pixel_sql()} a group by 1, 2, 3)"


def _rgb_sql(name: str) -> str:
    (ky, vr, ug, vg, ub), (r0, g0, b0) = pixels.LAYOUTS[name]
    luma = "(c0 << 4)" if ky is None else f"(((c0 << 7) * {ky}) >> 16)"
    # a right shift of negatives is a floor of the division
    part = lambda c, k: f"cast(floor((({c} << 7) * {k}) / 65536.0) as bigint)"
    level = lambda e: f"greatest(0, least(255, cast(floor(({e}) / 16.0) as bigint)))"
    return f"""select frame, y, x, {level(f'{luma} + {part("c2", vr)} + {r0}')} as r, {level(f'{luma} + {part("c1", ug)} + {part("c2", vg)} + {g0}')} as g,
        {level(f'{luma} + {part("c1", ub)} + {b0}')} as b from {_YUV_SQL}"""


for _name in pixels.LAYOUTS:
    register(
        f"ycbcr_to_rgb_{_name}", lambda s, d, n=_name: _yuv(s, d).select("frame", "y", "x", pixels.ycbcr_to_rgb(F.col("c0"), F.col("c1"), F.col("c2"), n).alias("o")).select("frame", "y", "x", "o.r", "o.g", "o.b"),
        _rgb_sql(_name),
    )
register(
    "codebook_rgb", lambda s, d: _yuv(s, d).select("frame", "y", "x", pixels.codebook_rgb(F.col("c0"), F.col("c1"), F.col("c2")).alias("o")).select("frame", "y", "x", "o.r", "o.g", "o.b"),
    f"""with t as (select *, (c0 << 6) + 90 * (c2 - 128) as rc, (c0 << 6) - 22 * (c1 - 128) - 46 * (c2 - 128) as gc, (c0 << 6) + 113 * (c1 - 128) as bc from {_YUV_SQL})
    select frame, y, x, case when rc < 0 then 0 when rc > 16320 then 255 else rc >> 6 end as r, case when gc < 0 then 0 when gc > 16320 then 255 else gc >> 6 end as g,
    case when bc < 0 then 0 when bc > 16320 then 255 else bc >> 6 end as b from t""",
)
register(
    "channel_pack", lambda s, d: _yuv(s, d).select("frame", "y", "x", *(pixels.pack(F.col("c0"), F.col("c1"), F.col("c2"), o).alias(o.lower()) for o in ("ARGB", "ABGR", "RGBA", "BGRA"))),
    f"select frame, y, x, [255, c0, c1, c2] as argb, [255, c2, c1, c0] as abgr, [c0, c1, c2, 255] as rgba, [c2, c1, c0, 255] as bgra from {_YUV_SQL}",
)
register(
    "range_rescale", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", pixels.rescale((F.col("l_partkey") % 256), 16, 219).alias("v")),
    "select l_orderkey, l_linenumber, greatest(0, least(255, ((l_partkey % 256) - 16) * 255 // 219)) as v from lineitem",
)
register(
    "chroma_upsample", lambda s, d: frames.upsample_chroma(pixel_rows(s, d).where("plane > 0")),
    f"""with a as (select *, coalesce(lag(v) over w, v) as u, coalesce(lead(v) over w, v) as dn from {pixel_sql()} where plane > 0 window w as (partition by frame, plane, x order by y)),
    r as (select frame, plane, y * 2 + o as y, x, case when o = 0 then (3 * v + u) >> 2 else (3 * v + dn) >> 2 end as v from a, (select unnest(range(2)) as o)),
    b as (select *, coalesce(lag(v) over w, v) as l, coalesce(lead(v) over w, v) as rt from r window w as (partition by frame, plane, y order by x))
    select frame, plane, y, x * 2 + o as x, case when o = 0 then (3 * v + l) >> 2 else (3 * v + rt) >> 2 end as v from b, (select unnest(range(2)) as o)""",
)
register("downsample_2x", lambda s, d: frames.downsample(pixel_rows(s, d)), f"select frame, plane, y // 2 as y, x // 2 as x, (sum(v) + 2)::bigint // 4 as v from {pixel_sql()} group by 1, 2, 3, 4")
register("upsample_2x", lambda s, d: frames.upsample(pixel_rows(s, d)), f"select frame, plane, y * 2 + j as y, x * 2 + i as x, v from {pixel_sql()}, (select unnest(range(2)) as j), (select unnest(range(2)) as i)")
register(
    "edge_pad", lambda s, d: frames.pad_edges(pixel_rows(s, d).where("y < 27 and x < 21")),
    f"""with a as (select * from {pixel_sql()} where y < 27 and x < 21), s as (select frame, plane, max(y) + 1 as h, max(x) + 1 as w from a group by 1, 2)
    select a.frame, a.plane, g.y, g.x, a.v from s, (select y, x from (select unnest(range(32)) as y), (select unnest(range(32)) as x)) g
    join a on a.frame = s.frame and a.plane = s.plane and a.y = least(g.y, s.h - 1) and a.x = least(g.x, s.w - 1) where g.y < ceil(s.h / 16.0) * 16 and g.x < ceil(s.w / 16.0) * 16""",
)
register("block_mean", lambda s, d: frames.block_mean(pixel_rows(s, d)), f"select frame, plane, y // 4 as block_y, x // 4 as block_x, (sum(v) + count(*) // 2)::bigint // count(*) as mean from {pixel_sql()} group by 1, 2, 3, 4")


def _vectors(s, d):
    """A vector for each of the sixteen blocks of every frame but the first."""
    later = table(s, d, "embeddings").select(F.floor(F.col("vec_id") / VECTORS).alias("f")).distinct().where("f > 0")
    return later.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(15)))).select(((F.col("f") - 1) * 16 + F.col("b")).alias("id")).select(
        (F.floor(F.col("id") / 16) + 1).alias("frame"), F.lit(0).cast("long").alias("plane"), F.floor(F.col("id") % 16 / 4).cast("int").alias("block_y"), (F.col("id") % 4).cast("int").alias("block_x"),
        F.floor(F.col("id") / 16).alias("ref"), (F.col("id") * 5 % 9 - 4).cast("int").alias("dy"), (F.col("id") * 7 % 9 - 4).cast("int").alias("dx"),
    )


_VECTORS_SQL = f"(select i // 16 + 1 as frame, 0 as plane, (i % 16) // 4 as block_y, i % 4 as block_x, i // 16 as ref, i * 5 % 9 - 4 as dy, i * 7 % 9 - 4 as dx from (select (f - 1) * 16 + unnest(range(16)) as i from (select distinct vec_id // {VECTORS} as f from embeddings) where f > 0))"
_MC_SQL = f"""with px as (select frame, plane, ref, block_y * 8 + k // 8 as y, block_x * 8 + k % 8 as x, dy, dx from {_VECTORS_SQL}, (select unnest(range(64)) as k)),
    n as (select *, y + (dy >> 1) + j as ry, x + (dx >> 1) + i as rx, ((dy & 1) + 1) * ((dx & 1) + 1) as wanted from px, (select unnest(range(2)) as j), (select unnest(range(2)) as i) where j <= (dy & 1) and i <= (dx & 1)),
    g as (select n.frame, n.plane, n.y, n.x, wanted, sum(r.v) as s, count(r.v) as found from n left join {pixel_sql()} r on r.frame = n.ref and r.plane = n.plane and r.y = n.ry and r.x = n.rx group by 1, 2, 3, 4, 5)
    select frame, plane, y, x, wanted, found, case when found = wanted then (s + wanted // 2)::bigint // wanted end as v from g"""
register("motion_compensate", lambda s, d: frames.compensate(_vectors(s, d), pixel_rows(s, d)), _MC_SQL)
register(
    "bipredict", lambda s, d: frames.bipredict(pixel_rows(s, d).where("x < 24"), pixel_rows(s, d, 3).where("x > 7")),
    f"""select coalesce(a.frame, b.frame) as frame, coalesce(a.plane, b.plane) as plane, coalesce(a.y, b.y) as y, coalesce(a.x, b.x) as x,
    case when a.v is null then b.v when b.v is null then a.v else (a.v + b.v + 1) // 2 end as v from (select * from {pixel_sql()} where x < 24) a
    full join (select * from {pixel_sql(3)} where x > 7) b on a.frame = b.frame and a.plane = b.plane and a.y = b.y and a.x = b.x""",
)
register(
    "vector_bounds", lambda s, d: _vectors(s, d).select("frame", "block_y", "block_x", frames.in_bounds(F.col("block_y") * 8, F.col("block_x") * 8, F.col("dy"), F.col("dx"), 8, SIDE, SIDE).alias("inside")),
    f"select frame, block_y, block_x, block_y * 16 + dy >= 0 and block_x * 16 + dx >= 0 and block_y * 16 + dy <= 48 and block_x * 16 + dx <= 48 as inside from {_VECTORS_SQL}",
)
register(
    "motion_search", lambda s, d: frames.motion_search(pixel_rows(s, d, planes=1), pixel_rows(s, d, planes=1), size=8),
    f"""with px as materialized (select * from {pixel_sql(planes=1)}),
    m as materialized (select frame - 1 as ref, plane, y, x, v, dy, dx, y + dy as ry, x + dx as rx from px, (select unnest(range(-7, 9)) as dy), (select unnest(range(-7, 9)) as dx)),
    c as (select ref + 1 as frame, m.plane, m.y // 8 as block_y, m.x // 8 as block_x, dy, dx, sum((m.v - r.v) * (m.v - r.v))::bigint as sse, count(*) as n
        from m join px r on r.frame = m.ref and r.plane = m.plane and r.y = m.ry and r.x = m.rx group by all),
    k as (select *, row_number() over (partition by frame, plane, block_y, block_x order by sse, case when dy = 0 and dx = 0 then 0 else 1 end, dy, dx) as r from c where n = 64)
    select frame, plane, block_y, block_x, dy, dx, sse from k where r = 1""",
)
register(
    "copy_vectors", lambda s, d: s.range(256).select("id", frames.copy_vector(F.col("id").cast("int"), F.lit(1), F.lit(-1)).alias("m")).select("id", "m.dx", "m.dy"),
    "select i as id, 8 - (i >> 4) - 1 as dx, 8 - (i & 15) + 1 as dy from (select unnest(range(256)) as i)",
)
