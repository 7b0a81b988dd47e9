"""Queries on packets, pictures, blocks, rates, bytes and time, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bytes as B
from ..functions import tags, timebase, transforms
from ..functions.pixels import clamp, div, median3
from ..operators import blocks, rate, stream
from . import encode, store
from .queries import BLOCKS_SQL, OPTIONS_SQL, PICTURES_SQL, macroblocks, options, packets, pictures, register, table

# the 256 remainders of one byte by the rule; then a byte at a time
_REMAINDERS = "list_transform(range(256), lambda b: list_reduce(list_prepend(b << 24, range(8)), lambda r, _: xor((r << 1) & 4294967295, case when r >= 2147483648 then 79764919 else 0 end)))"

# ---------------------------------------------------------------- packets and pictures

register(
    "demux_select", lambda s, d: stream.demux(packets(s, d), ["click", "view"], [0, 2]).select("file", "seq", "ptype", "stream", "size"),
    """select user_id as file, event_id as seq, event_type as ptype, user_id % 3 as stream, cast(floor(value * 100) as bigint) as size
    from events where event_type in ('click', 'view') and user_id % 3 in (0, 2)""",
)


def _quarantine(s, d):
    checks = {"size": F.col("size") < 32768, "type": F.col("ptype") != "error", "stream": F.col("stream") < 2}
    return stream.validate(packets(s, d), checks)[1].select("seq", F.array_join("failed", ",").alias("failed"))


register(
    "quarantine", _quarantine,
    """select seq, failed from (select event_id as seq, array_to_string(list_filter([case when floor(value * 100) >= 32768 then 'size' end, case when event_type = 'error' then 'type' end,
    case when user_id % 3 >= 2 then 'stream' end], lambda x: x is not null), ',') as failed from events) where failed <> ''""",
)
for _level in stream.LEVELS:
    _n = stream.LEVELS.index(_level)
    register(
        f"drop_policy_{_level}", lambda s, d, v=_level: stream.drop_policy(pictures(s, d), v).select("file", "seq", "kind", "dropped"),
        f"""with m as (select *, (kind = 'B' and {_n} >= 1) or (kind = 'P' and {_n} >= 2) or (kind = 'I' and {_n} >= 3) or {_n} >= 4 as own,
            sum(case when kind = 'I' then 1 else 0 end) over (partition by file order by seq) as gop from {PICTURES_SQL}),
        q as (select *, max(case when own and kind <> 'B' then 1 else 0 end) over (partition by file, gop order by seq) = 1 as bad from m)
        select file, seq, kind, own or (bad and kind <> 'I') or (gop = 0 and kind <> 'I') as dropped from q""",
    )
register(
    "references_ready", lambda s, d: stream.has_references(pictures(s, d)).select("file", "seq", "ready"),
    f"""select file, seq, coalesce(sum(case when kind <> 'B' then 1 else 0 end) over (partition by file order by seq rows between unbounded preceding and 1 preceding), 0)
        >= case kind when 'I' then 0 when 'P' then 1 else 2 end as ready from {PICTURES_SQL}""",
)
register(
    "reference_slots", lambda s, d: stream.reference_slots(pictures(s, d)).select("file", "seq", "past", "future"),
    f"""with p as {PICTURES_SQL}, r as (select file, seq, row_number() over (partition by file order by seq) as k from p where kind <> 'B'),
    n as (select p.file, p.seq, (select max(k) from r where r.file = p.file and r.seq < p.seq) as k from p)
    select n.file, n.seq, a.seq as past, b.seq as future from n left join r b on b.file = n.file and b.k = n.k left join r a on a.file = n.file and a.k = n.k - 1""",
)
register(
    "random_access", lambda s, d: stream.random_access(pictures(s, d)).select("file", "seq", "random_access"),
    f"select file, seq, kind = 'I' and coalesce(lead(kind) over (partition by file order by seq) <> 'B', true) as random_access from {PICTURES_SQL}",
)
register(
    "sync_emission", lambda s, d: stream.sync_points(pictures(s, d)),
    f"""with r as (select *, lag(kind) over w as prev, lead(kind) over w as nxt from {PICTURES_SQL} window w as (partition by file order by seq)),
    e as (select file, seq, list_concat(
        case when kind = 'B' then case when prev = 'B' then [false] else [] end when prev is null then []
             when prev = 'B' then [false, kind = 'I' and coalesce(nxt <> 'B', true)] else [kind = 'I' and coalesce(nxt <> 'B', true)] end,
        case when nxt is not null then [] when kind = 'B' then [false, false] else [false] end) as s from r),
    u as (select file, seq, unnest(s) as random_access, generate_subscripts(s, 1) as k from e)
    select file, row_number() over (partition by file order by seq, k) as period, random_access from u""",
)
register(
    "segment_lengths", lambda s, d: stream.next_picture(stream.segment_lengths(packets(s, d).select("file", F.col("seq").alias("pos"), "ptype", F.lit(10_000_000).cast("long").alias("file_size"))), F.col("ptype") == "view").select("file", "pos", "length", "next_picture"),
    """select user_id as file, event_id as pos, coalesce(lead(event_id) over w, 10000000) - event_id as length,
    min(case when event_type = 'view' then event_id end) over (partition by user_id order by event_id rows between 1 following and unbounded following) as next_picture
    from events window w as (partition by user_id order by event_id)""",
)


def _av(s, d):
    p = table(s, d, "events").select(F.col("user_id").alias("file"), F.col("event_id"))
    syncs = p.where("event_id % 7 = 0").select("file", (F.col("event_id") % 1000 + 1).alias("period"), "event_id")
    start = (F.col("event_id") % 1500) * 1152
    blocks_ = p.where("event_id % 7 <> 0").select("file", start.alias("start"), (start + 1152).alias("stop"))
    return stream.align_audio(syncs.select("file", "period"), blocks_, 44100, 30000, 1001)


register(
    "av_align", _av,
    """with y as (select user_id as file, event_id % 1000 + 1 as period, ((event_id % 1000) * 1001 * 44100) // 30000 as t from events where event_id % 7 = 0),
    b as (select user_id as file, (event_id % 1500) * 1152 as start, (event_id % 1500) * 1152 + 1152 as stop from events where event_id % 7 <> 0)
    select y.file, period, t, start, stop, t - start as trim from y join b on y.file = b.file and start <= t and t < stop""",
)


def _mux(s, d):
    e = table(s, d, "events")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    v = e.where("event_type = 'view'").select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), F.row_number().over(w).cast("long").alias("period"))
    a = e.where("event_type <> 'view'").select(F.col("user_id").alias("file"), (F.col("event_id") % 2).alias("stream"), F.col("event_id").alias("block"), F.floor(F.col("value") * 5).cast("long").alias("len"))
    run = Window.partitionBy("file", "stream").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return stream.interleave(v, a.withColumn("stop", F.sum("len").over(run)).drop("len"), 44100, 30, 1, 4096)


register("mux_interleave", _mux)
register(
    "packet_stats", lambda s, d: stream.packet_statistics(packets(s, d)),
    """with o as (select user_id as file, event_id as seq, cast(floor(value * 100) as bigint) as size, event_type = 'purchase' as is_sync,
        coalesce(sum(cast(floor(value * 100) as bigint)) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as off from events),
    g as (select file, off - lag(off) over (partition by file order by seq) as gap from o where is_sync)
    select o.file, max(size) as largest_packet, coalesce(any_value(m.gap), 0)::bigint as longest_readahead from o left join (select file, max(gap) as gap from g group by file) m on m.file = o.file group by o.file""",
)
register(
    "stream_union", lambda s, d: stream.union_streams(packets(s, d).where("stream = 0"), packets(s, d).where("stream = 1")).select("file", "seq", "stream"),
    "select user_id as file, event_id as seq, user_id % 3 as stream from events where user_id % 3 < 2",
)


def _sources(s, d):
    return table(s, d, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.when(F.col("s_nationkey") % 4 != 0, F.col("s_nationkey")).alias("device"), (F.col("s_suppkey") % 2).alias("layout"),
        F.substring("s_name", -8, 8).alias("meta_id"), F.when(F.col("s_nationkey") % 5 == 0, (F.col("s_suppkey") % 2 + 1) * 22050).otherwise(44100).alias("rate"),
        F.floor("s_acctbal").cast("long").alias("available"),
    )


_SOURCES_SQL = """(select s_suppkey as source_id, case when s_nationkey % 4 <> 0 then s_nationkey end as device, s_suppkey % 2 as layout, right(s_name, 8) as meta_id,
    case when s_nationkey % 5 = 0 then (s_suppkey % 2 + 1) * 22050 else 44100 end as rate, cast(floor(s_acctbal) as bigint) as available from supplier)"""
register("mix_groups", lambda s, d: stream.mix_groups(_sources(s, d)), f"select device, min(available) as available, count(*) as n_sources from {_SOURCES_SQL} where device is not null group by device having count(distinct rate) = 1")
register("source_sort", lambda s, d: stream.sort_sources(_sources(s, d), store.materialise).select("source_id", "rank"), f"select source_id, row_number() over (order by device nulls last, layout, meta_id, source_id) as rank from {_SOURCES_SQL}")

# ---------------------------------------------------------------- blocks

register(
    "carry_forward_q", lambda s, d: blocks.carry_quantiser(macroblocks(s, d)).select("slice_id", "mb_addr", "scale"),
    f"select slice_id, mb_addr, last_value(q ignore nulls) over (partition by slice_id order by mb_addr rows between unbounded preceding and current row) as scale from {BLOCKS_SQL}",
)
register(
    "skipped_fill", lambda s, d: blocks.fill_skipped(macroblocks(s, d).where("part % 4 <> 0")),
    f"""select slice_id, unnest(range(prev + 1, mb_addr)) as skipped from (select slice_id, mb_addr, lag(mb_addr) over (partition by slice_id order by mb_addr) as prev
        from {BLOCKS_SQL} where part % 4 <> 0) where mb_addr - prev > 1""",
)
register(
    "dc_predict", lambda s, d: blocks.predict_dc(macroblocks(s, d).where("part % 4 <> 0")).select("slice_id", "mb_addr", "dc"),
    f"""with r as (select *, coalesce(case when mb_addr - lag(mb_addr) over (partition by slice_id order by mb_addr) > 1 then 1 else 0 end, 0) as reset from {BLOCKS_SQL} where part % 4 <> 0),
    p as (select *, sum(reset) over (partition by slice_id order by mb_addr) as part_no from r)
    select slice_id, mb_addr, (1024 + sum(diff) over (partition by slice_id, part_no order by mb_addr))::bigint as dc from p""",
)
register(
    "mv_wrap", lambda s, d: blocks.predict_vectors(macroblocks(s, d), 1).select("slice_id", "mb_addr", "mv"),
    f"""select slice_id, mb_addr, ((((s + 32) % 64) + 64) % 64 - 32)::bigint as mv from
    (select slice_id, mb_addr, sum(diff) over (partition by slice_id order by mb_addr) as s from {BLOCKS_SQL})""",
)
for _intra in (True, False):
    _twice = "2 * l" if _intra else "2 * l + sign(l)::bigint"
    register(
        f"dequantise_mpeg1_{'intra' if _intra else 'inter'}",
        lambda s, d, i=_intra: macroblocks(s, d).select("slice_id", "mb_addr", blocks.dequantise(F.col("diff"), F.col("part") % 31 + 1, F.col("supp") % 83 + 8, i).alias("coef")),
        f"""with t as (select slice_id, mb_addr, diff as l, ({_twice.replace('l', 'diff') if _intra else '2 * diff + sign(diff)::bigint'}) * (part % 31 + 1) * (supp % 83 + 8) as m from {BLOCKS_SQL}),
        u as (select *, (m // 16) as v from t), o as (select *, case when v % 2 = 0 and v <> 0 then v - sign(v)::bigint else v end as w from u)
        select slice_id, mb_addr, case when l = 0 then 0 else greatest(-2048, least(2047, w)) end::bigint as coef from o""",
    )


def _coefs(s, d):
    from_lines = F.sort_array(F.collect_list(F.struct("mb_addr", ((F.col("diff") % 5) * (F.col("part") % 3)).alias("c"))))
    return macroblocks(s, d).groupBy("slice_id").agg(F.transform(from_lines, lambda t: t["c"]).alias("coef"))


_COEFS_SQL = f"(select slice_id, list((diff % 5) * (part % 3) order by mb_addr) as coef from {BLOCKS_SQL} group by slice_id)"
register(
    "block_classes", lambda s, d: _coefs(s, d).select("slice_id", blocks.classify(F.col("coef")).alias("class")),
    f"select slice_id, case len(list_filter(coef, lambda c: c <> 0)) when 0 then 'zero' when 1 then 'sparse' else 'full' end as class from {_COEFS_SQL}",
)
register(
    "mismatch_control", lambda s, d: _coefs(s, d).select("slice_id", blocks.mismatch(F.col("coef")).alias("coef")),
    f"""select slice_id, case when list_sum(coef) % 2 = 0 then list_concat(coef[1:len(coef) - 1], [case when coef[len(coef)] % 2 = 0 then coef[len(coef)] + 1 else coef[len(coef)] - 1 end]) else coef end as coef from {_COEFS_SQL}""",
)
register(
    "run_length_place", lambda s, d: blocks.place_runs(macroblocks(s, d).select(F.col("slice_id").alias("block_id"), F.col("mb_addr").alias("seq"), (F.col("part") % 13).alias("run"))),
    f"""with z as (select y * 8 + x as cell, row_number() over (order by y + x, case when (y + x) % 2 = 1 then y else -y end) - 1 as pos from (select unnest(range(8)) as y), (select unnest(range(8)) as x)),
    r as (select slice_id as block_id, mb_addr as seq, part % 13 as run, (sum(part % 13 + 1) over (partition by slice_id order by mb_addr) - 1)::bigint as position from {BLOCKS_SQL})
    select block_id, seq, run, position, position >= 64 as bad, z.cell::int as cell from r left join z on z.pos = r.position""",
)
register(
    "run_unpack", lambda s, d: blocks.unpack_runs(macroblocks(s, d).select((F.col("slice_id") * 8 + F.col("mb_addr")).alias("seq"), F.col("diff").alias("v"), (F.col("part") % 4).alias("n"))),
    f"select slice_id * 8 + mb_addr as seq, unnest(range(part % 4))::int as k, diff as v from {BLOCKS_SQL}",
)
register(
    "median_predictor", lambda s, d: macroblocks(s, d).select("slice_id", "mb_addr", median3(F.col("diff"), F.col("part") % 100, F.col("supp") % 50).alias("m")),
    f"select slice_id, mb_addr, list_sort([diff, part % 100, supp % 50])[2] as m from {BLOCKS_SQL}",
)
register(
    "saturating_add", lambda s, d: macroblocks(s, d).select("slice_id", "mb_addr", clamp(F.col("part") % 256 + F.col("diff")).alias("v")),
    f"select slice_id, mb_addr, greatest(0, least(255, part % 256 + diff)) as v from {BLOCKS_SQL}",
)

register(
    "video_syncs", lambda s, d: stream.with_video_syncs(packets(s, d).where("ptype = 'view'").drop("ptype")).select("file", "seq", F.col("period").cast("long").alias("period"), "random_access", "ptype"),
    """with t as (select user_id as file, event_id as seq, row_number() over (partition by user_id order by event_id) as period from events where event_type = 'view')
    select file, seq, period, period = 1 as random_access, unnest(['video_inline', 'video_sync']) as ptype from t""",
)


def _kept(s, d):
    shown = table(s, d, "events").select(F.col("event_id").alias("seq"), F.encode("props", "UTF-8").alias("payload"))
    return stream.decode_kept(pictures(s, d).join(shown, "seq"), "bp", B.page_crc(F.col("payload")), "crc").select("file", "seq", "kind", "crc")


register(
    "decode_kept", _kept,
    f"""with m as (select *, kind in ('B', 'P') as own, count(*) filter (kind = 'I') over (partition by file order by seq) as gop from {PICTURES_SQL}),
    k as (select *, max(case when own and kind = 'P' then 1 else 0 end) over (partition by file, gop order by seq) as poisoned from m), x as (select {_REMAINDERS} as t),
    b as (select event_id as seq, list_transform(regexp_extract_all(hex(encode(props)), '..'), lambda x: ('0x' || x)::bigint) as b from events)
    select file, k.seq, kind, coalesce(list_reduce(list_prepend(0::bigint, b), lambda r, x: xor((r << 8) & 4294967295, t[xor(r >> 24, x) + 1])), 0) as crc from k join b using (seq), x where not own and poisoned = 0""",
)

# ---------------------------------------------------------------- rate and distortion

_PARETO = f"""(select block_id, opt, bits, dist from (select *, min(dist) over (partition by block_id order by bits, dist, opt rows between unbounded preceding and 1 preceding) as best
    from {OPTIONS_SQL}) where best is null or dist < best)"""
register("rd_frontier", lambda s, d: rate.pareto(options(s, d)), f"select * from {_PARETO}")
register(
    "rd_hull", lambda s, d: rate.hull(options(s, d)),
    f"""with recursive o as {OPTIONS_SQL}, r as (select block_id, opt, bits, dist, 0 as step from (select *, row_number() over (partition by block_id order by dist, bits, opt) as k from o) where k = 1
        union all select block_id, opt, bits, dist, step from (select o.*, r.step + 1 as step, row_number() over (partition by o.block_id order by (o.dist - r.dist) / (r.bits - o.bits)::double, o.dist, o.opt) as k
        from o join r on r.block_id = o.block_id and o.dist > r.dist and o.bits < r.bits) where k = 1)
    select * from r""",
)
_STEPS = f"""(select block_id, opt, lag(bits) over w - bits as saved, dist - lag(dist) over w as added from {_PARETO} window w as (partition by block_id order by dist, opt) qualify saved is not null)"""
register(
    "rd_budget", lambda s, d: rate.budget(rate.marginal_steps(rate.pareto(options(s, d))).withColumn("frame", F.floor(F.col("block_id") / 256)), "frame", 400),
    f"""select block_id, opt, saved, added, frame, total_saved from (select *, sum(saved) over (partition by frame order by added / saved, block_id, opt rows between unbounded preceding and current row)::bigint as total_saved
        from (select *, cast(floor(block_id / 256) as bigint) as frame from {_STEPS})) where total_saved - saved < 400""",
)
register(
    "marginal_sort", lambda s, d: rate.marginal_steps(rate.pareto(options(s, d))).select("block_id", "opt", "saved", "added"),
    f"select block_id, opt, saved, added from {_STEPS}",
)


def _greedy(s, d):
    hulls = rate.hull(options(s, d)).select(F.floor(F.col("block_id") / 64).alias("frame"), "block_id", "step", "bits", "dist", ((F.col("dist") % 9) - 1).alias("entry"))
    return rate.greedy_budget(hulls, "frame", 700)


register("rd_greedy", _greedy)
register("entry_usage", lambda s, d: rate.usage(options(s, d).select((F.col("dist") % 50 - 1).alias("entry"))), f"with u as (select dist % 50 - 1 as entry, count(*) as uses from {OPTIONS_SQL} where dist % 50 >= 1 group by 1) select entry, uses, (select count(*) from u) as used from u")
register(
    "size_estimate", lambda s, d: options(s, d).groupBy("block_id").agg(F.count("*").alias("c"), F.sum("bits").alias("b")).select("block_id", rate.size_estimate(F.col("c"), F.col("b"), F.col("c") % 3, F.col("c") % 2).alias("bytes")),
    f"""select block_id, cast(ceil(c * 2 / 16) * 2 + b + case when c % 3 + c % 2 > 0 then (c % 3) * 6 + (c % 2) * 4 + 8 else 0 end + 8 as bigint) as bytes
    from (select block_id, count(*) as c, sum(bits)::bigint as b from {OPTIONS_SQL} group by 1)""",
)


def _samples(s, d):
    from pyspark.sql import Window

    rows = table(s, d, "events").select(F.col("user_id").alias("stream"), "event_id", (F.floor(F.col("value") * 4) - 900).cast("long").alias("v"))
    n = F.row_number().over(Window.partitionBy("stream").orderBy("event_id")) - 1
    return rows.select("stream", n.cast("long").alias("n"), "v")


_SAMPLES_SQL = "(select user_id as stream, row_number() over (partition by user_id order by event_id) - 1 as n, cast(floor(value * 4) - 900 as bigint) as v from events)"
_CORR = f"""(select a.stream, lag, sum(a.v * b.v)::bigint as r from {_SAMPLES_SQL} a, (select unnest(range(1, 9)) as lag), {_SAMPLES_SQL} b where b.stream = a.stream and b.n = a.n + lag group by 1, 2)"""
register("autocorrelation", lambda s, d: rate.correlate(_samples(s, d), list(range(1, 9))), f"select stream, lag::int as lag, r from {_CORR}")
register(
    "top2_peaks", lambda s, d: rate.top_two(rate.correlate(_samples(s, d), list(range(1, 9))), "stream", "r", "lag"),
    f"select stream, lag::int as lag, r, place from (select *, row_number() over (partition by stream order by r desc, lag) as place from {_CORR}) where place <= 2",
)
register(
    "band_energy", lambda s, d: rate.band_energy(_samples(s, d).select(F.col("stream").alias("frame"), (F.col("n") % 64).alias("bin"), F.col("v").alias("x")), [0, 2, 4, 8, 16, 32, 64]).select("frame", "band", F.round("energy", 6).alias("energy")),
    f"""select stream as frame, (len(list_filter([0, 2, 4, 8, 16, 32, 64], lambda e: e <= n % 64)) - 1)::int as band, round(sqrt(sum(v * v)), 6) as energy from {_SAMPLES_SQL} group by 1, 2""",
)
register(
    "sliding_energy", lambda s, d: rate.sliding_energy(_samples(s, d), 8).select("stream", "n", "energy"),
    f"select stream, n, (sum(v * v) over (partition by stream order by n rows between current row and 7 following))::bigint as energy from {_SAMPLES_SQL}",
)
register(
    "fir_filter", lambda s, d: rate.fir(_samples(s, d), [3, -2, 1]).select("stream", "n", "y"),
    f"select stream, n, (3 * v - 2 * coalesce(lag(v) over w, 0) + coalesce(lag(v, 2) over w, 0))::bigint as y from {_SAMPLES_SQL} window w as (partition by stream order by n)",
)


def _frames8(s, d):
    f = _samples(s, d).withColumn("frame", F.floor(F.col("n") / 8))
    return f.groupBy("stream", "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "v"))), lambda t: t["v"]).alias("samples"))


register(
    "overlap_add", lambda s, d: rate.overlap_add(_frames8(s, d), 4),
    f"select stream, (n // 8) * 4 + n % 8 as n, sum(v)::bigint as v from {_SAMPLES_SQL} group by 1, 2",
)
register(
    "moments", lambda s, d: _rounded(rate.moments(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount", "l_tax", "l_quantity")),
    """with m as (select l_returnflag, l_linestatus, sum(l_quantity) as w, sum(l_quantity * l_discount) as wx, sum(l_quantity * l_tax) as wy, sum(l_quantity * l_discount * l_discount) as wxx,
        sum(l_quantity * l_discount * l_tax) as wxy, sum(l_quantity * l_tax * l_tax) as wyy from lineitem group by 1, 2)
    select l_returnflag, l_linestatus, round(w, 4) as w, round(wx, 4) as wx, round(wy, 4) as wy, round(wxx, 4) as wxx, round(wxy, 4) as wxy, round(wyy, 4) as wyy,
        round((w * wxy - wx * wy) / (w * wxx - wx * wx), 6) as slope, round((wy - (w * wxy - wx * wy) / (w * wxx - wx * wx) * wx) / w, 6) as intercept from m""",
)


def _rounded(m):
    return m.select("l_returnflag", "l_linestatus", *(F.round(c, 4).alias(c) for c in ("w", "wx", "wy", "wxx", "wxy", "wyy")), F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


register(
    "moments_merge", lambda s, d: rate.merge_moments(rate.moments(table(s, d, "lineitem"), ["l_returnflag", "l_shipdate"], "l_discount", "l_tax", "l_quantity"), ["l_returnflag"]).select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("w", "wx", "wy", "wxx", "wxy", "wyy"))),
    """select l_returnflag, round(sum(l_quantity), 4) as w, round(sum(l_quantity * l_discount), 4) as wx, round(sum(l_quantity * l_tax), 4) as wy, round(sum(l_quantity * l_discount * l_discount), 4) as wxx,
        round(sum(l_quantity * l_discount * l_tax), 4) as wxy, round(sum(l_quantity * l_tax * l_tax), 4) as wyy from lineitem group by 1""",
)


def _rated(s, d):
    return table(s, d, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_quantity").alias("w"), (F.col("l_discount") * 100).alias("s"), (F.col("l_tax") * 100).alias("q"),
        F.col("l_linenumber").cast("double").alias("r"), (F.col("l_extendedprice") / 1000).alias("d"),
    )


def _each(m, by):
    return m.select(*by, *(F.round(F.col(c) / (F.col("w") if c != "w" else 1), 5).alias(c) for c in ("w", *rate.FIRST, *rate.CENTRAL)))


def _co_sql(by: str) -> str:
    central = ", ".join(f"round(sum(w * {' * '.join(f'({c} - m{c})' for c in name)}) / sum(w), 5) as {name}" for name in rate.CENTRAL)
    return f"""with t as (select {by}, l_quantity as w, l_discount * 100 as s, l_tax * 100 as q, l_linenumber::double as r, l_extendedprice / 1000 as d from lineitem),
        m as (select {by}, sum(w) as mw, {', '.join(f'sum(w * {c}) / sum(w) as m{c}' for c in rate.FIRST)} from t group by all)
        select {by}, round(any_value(mw), 5) as w, {', '.join(f'round(any_value(m{c}), 5) as {c}' for c in rate.FIRST)}, {central} from t join m using ({by}) group by {by}"""


register("co_moments", lambda s, d: _each(rate.co_moments(_rated(s, d), ["l_returnflag", "l_linestatus"]), ["l_returnflag", "l_linestatus"]), _co_sql("l_returnflag, l_linestatus"))
register("co_moments_merge", lambda s, d: _each(rate.merge_co_moments(rate.co_moments(_rated(s, d), ["l_returnflag", "l_linestatus"]), ["l_returnflag"]), ["l_returnflag"]), _co_sql("l_returnflag"))


def _quantisers(s, d):
    t = table(s, d, "part").select(F.col("p_partkey").alias("target_id"), (F.col("p_partkey") * 37 % 500).alias("target"), (F.col("p_size") % 32).cast("long").alias("old_q"))
    return rate.nearest_quantiser(t, s.range(32).select(F.col("id").alias("q"), (F.col("id") * 16).alias("log_q")))


register(
    "quantiser_search", _quantisers,
    """select target_id, q from (select p_partkey as target_id, q, row_number() over (partition by p_partkey order by abs(q * 16 - (p_partkey * 37) % 500), abs(q - p_size % 32), q) as r
    from part, (select unnest(range(32)) as q)) where r = 1""",
)
_SUM_SQL = f"(select stream, n, v, sum(v) over (partition by stream order by n) as s from {_SAMPLES_SQL})"
register(
    "leaky_bucket", lambda s, d: rate.leaky_bucket(_samples(s, d)).select("stream", "n", "out"),
    f"select stream, n, (s + greatest(0, -min(s) over (partition by stream order by n)))::bigint as out from {_SUM_SQL}",
)
_TARGET, _DELAY = 400, 6


def _moving(s, d):
    slips = rate.leaky_bucket(_samples(s, d), -4 * _TARGET, out="slip").select("stream", "n", F.abs("v").alias("dist"), "slip")
    return rate.recur(slips, "stream", "n", ["dist", "slip"], "out", rate.moving_distortion(_TARGET))


register(
    "moving_distortion", _moving,
    f"""with recursive s as (select stream, n, abs(v) as dist, s + greatest(0, {-4 * _TARGET} - min(s) over (partition by stream order by n)) as slip from {_SUM_SQL}),
    r as (select stream, n, (case when slip > {3 * _TARGET} then dist + dist // 20 when slip > {_TARGET} then dist + dist // 40 when slip < {-_TARGET} then dist - dist // 20 else dist end)::bigint as out from s where n = 0
        union all select s.stream, s.n, (case when slip > {3 * _TARGET} then m + m // 20 when slip > {_TARGET} then m + m // 40 when slip < {-_TARGET} then m - m // 20 else m end)::bigint as out
        from (select s.*, r.out * 6 // 10 + s.dist * 4 // 10 as m from s join r on r.stream = s.stream and s.n = r.n + 1) s)
    select stream, n, out from r""",
)
_G, _C0, _C1 = rate.two_pole_coefficients(_DELAY)
register(
    "two_pole", lambda s, d: rate.recur(_samples(s, d), "stream", "n", ["v"], "out", rate.two_pole(_DELAY)),
    f"""with recursive s as (select stream, n, v, coalesce(lag(v, 1) over w, first_value(v) over w) as x1, coalesce(lag(v, 2) over w, first_value(v) over w) as x2 from {_SAMPLES_SQL} window w as (partition by stream order by n)),
    r as (select stream, n, (4 * v * {_G} + v * {_C0} + v * {_C1} + {1 << 23}) >> 24 as y, v as y1 from s where n = 0
        union all select s.stream, s.n, ((s.v + 2 * x1 + x2) * {_G} + r.y * {_C0} + r.y1 * {_C1} + {1 << 23}) >> 24, r.y from s join r on r.stream = s.stream and s.n = r.n + 1)
    select stream, n, y as out from r""",
)
register(
    "pre_emphasis", lambda s, d: rate.pre_emphasis(_samples(s, d)).select("stream", "n", F.round("out", 6).alias("out")),
    f"select stream, n, round(v - 0.85 * coalesce(lag(v) over (partition by stream order by n), 0), 6) as out from {_SAMPLES_SQL}",
)
register(
    "de_emphasis", lambda s, d: rate.recur(rate.pre_emphasis(_samples(s, d)), "stream", "n", ["out"], "v", rate.de_emphasis(), "double").select("stream", "n", F.round("v", 4).alias("v")),
    f"select stream, n, v::double as v from {_SAMPLES_SQL}",
)
register(
    "iir_filter", lambda s, d: rate.iir(_samples(s, d), [0.5, -0.25]).select("stream", "n", F.round("y", 4).alias("y")),
    f"""with recursive s as {_SAMPLES_SQL}, r as (select stream, n, v::double as y, 0.0::double as y1 from s where n = 0
    union all select s.stream, s.n, s.v - 0.5::double * r.y + 0.25::double * r.y1, r.y from s join r on r.stream = s.stream and s.n = r.n + 1) select stream, n, round(y, 4) as y from r""",
)
register(
    "comb_filter", lambda s, d: rate.comb(_samples(s, d), 5, [1, 2, 1]).select("stream", "n", "y"),
    f"select stream, n, (v + coalesce(lag(v, 4) over w, 0) + 2 * coalesce(lag(v, 5) over w, 0) + coalesce(lag(v, 6) over w, 0))::bigint as y from {_SAMPLES_SQL} window w as (partition by stream order by n)",
)
register(
    "cross_correlation", lambda s, d: rate.cross_correlate(_samples(s, d), _samples(s, d).withColumn("v", F.col("v") % 17), [0, 1, 3]),
    f"select a.stream, lag::int as lag, sum(a.v * (b.v % 17))::bigint as r from {_SAMPLES_SQL} a, (select unnest([0, 1, 3]) as lag), {_SAMPLES_SQL} b where b.stream = a.stream and b.n = a.n + lag group by 1, 2",
)


_PER, _AHEAD = 900, 8


def _reservoir(s, d):
    frames = _samples(s, d).select(F.col("stream").alias("clip"), "n", (F.col("v") + 1000).alias("cost"))
    return encode.reservoir_bits(frames, _PER, _AHEAD)


register(
    "reservoir_bits", _reservoir,
    f"""with recursive s as (select stream as clip, n, v + 1000 as cost, sum(v + 1000) over w as ahead, count(*) over w as frames from {_SAMPLES_SQL}
        window w as (partition by stream order by n rows between current row and {_AHEAD - 1} following)),
    r as (select clip, -1::bigint as n, 0::bigint as bits, {_PER * _AHEAD // 2}::bigint as held from s where n = 0
        union all select clip, n, bits, least({_PER * _AHEAD}, held - bits)::bigint from (select s.clip, s.n, r.held + {_PER} as held,
            greatest(1, least(r.held + {_PER}, greatest(0, r.held + s.frames * {_PER} - {_PER * _AHEAD // 2}) * s.cost // s.ahead))::bigint as bits
        from s join r on r.clip = s.clip and s.n = r.n + 1))
    select clip, n, bits from r where n >= 0""",
)


def _threshold(s, d):
    """Bisection on the driver over one aggregate: the bits threshold with the least total cost."""
    o = options(s, d).groupBy("bits").agg(F.sum("dist").alias("dist")).collect()  # at most one row for each number of bits
    costs = {r.bits: r.dist for r in o}
    total = lambda t: sum(v for b, v in costs.items() if b > t) + t * t * 1_000_000
    return s.createDataFrame([(rate.bisect(0, 63, total),)], "threshold long")


register(
    "threshold_bisect", _threshold,
    f"""with o as (select bits, sum(dist) as dist from {OPTIONS_SQL} group by bits), t as (select t, coalesce(sum(dist) filter (bits > t), 0) + t * t * 1000000 as cost from (select unnest(range(64)) as t), o group by t)
    select min_by(t, (cost, t))::bigint as threshold from t""",
)

# ---------------------------------------------------------------- bytes, tags, time, integers


def _payload(s, d):
    return table(s, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))


def _escape(s, d):
    # a space stands for two zero bytes and 'e' for a one, so start codes occur
    text = F.regexp_replace(F.regexp_replace(F.decode("payload", "ISO-8859-1"), " ", "\x00\x00"), "e", "\x01")
    doubled = F.encode(text, "ISO-8859-1")
    e = B.escape(doubled)
    return _payload(s, d).select("doc_id", F.octet_length(doubled).alias("n"), F.octet_length(e).alias("n_escaped"), (B.unescape(e) == doubled).alias("same"))


register(
    "escape_roundtrip", _escape,
    """with h as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    b as (select doc_id, list_transform(range(1, length(h) // 2 + 1), lambda i: case h[2 * i - 1:2 * i] when '20' then '0000' when '65' then '01' else h[2 * i - 1:2 * i] end) as b from h),
    t as (select doc_id, array_to_string(list_transform(b, lambda x: case x when '0000' then 'ZZ' when '01' then 'O' else '.' end), '') as t from b)
    select doc_id, length(t)::int as n, (length(t) + (length(t) - length(replace(t, 'ZZO', ''))) // 3)::int as n_escaped, true as same from t""",
)
register(
    "meta_ids", lambda s, d: table(s, d, "supplier").select("s_suppkey", F.hex(B.meta_id(F.col("s_name"))).alias("id"), B.meta_text(B.meta_id(F.col("s_name"))).alias("back")),
    "select s_suppkey, rpad(hex(encode(s_name[1:8])), 16, '0') as id, s_name[1:8] as back from supplier",
)
register(
    "endian_fields", lambda s, d: _payload(s, d).select("doc_id", *(B.field(F.col("payload"), 1, n, little).alias(f"{'l' if little else 'b'}{n}") for n in (1, 2, 4) for little in (False, True))),
    "with h as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents) select doc_id, "
    + ", ".join(
        f"case when length(h) >= {2 * (1 + n)} then ('0x' || {' || '.join(f'h[{2 * k + 1}:{2 * k + 2}]' for k in (range(n, 0, -1) if little else range(1, n + 1)))})::bigint end as {'l' if little else 'b'}{n}"
        for n in (1, 2, 4) for little in (False, True)
    )
    + " from h",
)
register(
    "endian_put", lambda s, d: table(s, d, "orders").select("o_orderkey", F.hex(B.to_bytes(F.col("o_orderkey"), 4)).alias("big"), F.hex(B.to_bytes(F.col("o_orderkey"), 4, True)).alias("little")),
    "with t as (select o_orderkey, lpad(to_hex(o_orderkey), 8, '0') as h from orders) select o_orderkey, upper(h) as big, upper(h[7:8] || h[5:6] || h[3:4] || h[1:2]) as little from t",
)
register(
    "bit_fields", lambda s, d: table(s, d, "orders").select("o_orderkey", *(B.bits(F.col("o_orderkey") * 2654435761 % 4294967296, a, n, 32).alias(f"f{a}") for a, n in ((0, 11), (11, 2), (13, 2), (15, 1), (16, 4)))),
    "with t as (select o_orderkey, (o_orderkey * 2654435761) % 4294967296 as h from orders) select o_orderkey, h >> 21 as f0, (h >> 19) & 3 as f11, (h >> 17) & 3 as f13, (h >> 16) & 1 as f15, (h >> 12) & 15 as f16 from t",
)


def _bits_back(s, d):
    rows = table(s, d, "orders").select("o_orderkey", F.array(F.col("o_orderkey") % 8, F.col("o_custkey") % 1024, F.col("o_orderkey") % 2).alias("v"), F.array(F.lit(3), F.lit(10), F.lit(1)).alias("w"))
    packed = rows.select("o_orderkey", "w", B.pack_lsb("v", "w").alias("low"), B.pack_msb("v", "w").alias("high"))
    return packed.select("o_orderkey", F.hex("low").alias("low"), F.hex("high").alias("high"), B.unpack_lsb("low", "w").alias("lsb"), B.unpack_msb("high", "w").alias("msb"))


register(
    "bit_packing", _bits_back,
    """with t as (select o_orderkey, o_orderkey % 8 as a, o_custkey % 1024 as b, o_orderkey % 2 as c from orders), p as (select *, a + b * 8 + c * 8192 as l, (a * 2048 + b * 2 + c) * 4 as h from t)
    select o_orderkey, upper(lpad(to_hex(l % 256), 2, '0') || lpad(to_hex(l // 256), 2, '0')) as low, upper(lpad(to_hex(h), 4, '0')) as high, [a, b, c] as lsb, [a, b, c] as msb from p""",
)
register(
    "page_checksum", lambda s, d: _payload(s, d).select("doc_id", B.page_crc(F.col("payload")).alias("crc")),
    f"""with t as (select {_REMAINDERS} as t), p as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    b as (select doc_id, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::bigint) as b from p)
    select doc_id, coalesce(list_reduce(list_prepend(0::bigint, b), lambda r, x: xor((r << 8) & 4294967295, t[xor(r >> 24, x) + 1])), 0) as crc from b, t""",
)


def _comments():
    return F.split(F.regexp_replace(F.col("props"), r'[{}" ]', ""), ",")


register(
    "tag_lookup", lambda s, d: table(s, d, "events").select("event_id", F.transform(_comments(), lambda t: F.replace(t, F.lit(":"), F.lit("="))).alias("c")).select("event_id", tags.lookup(F.col("c"), "K").alias("value"), tags.count(F.col("c"), "k").alias("n"), tags.lookup(F.col("c"), "k", 1).alias("second")),
    """with t as (select event_id, list_transform(string_split(regexp_replace(props, '[{}" ]', '', 'g'), ','), lambda x: replace(x, ':', '=')) as c from events),
    f as (select event_id, list_filter(c, lambda x: upper(x[1:2]) = 'K=') as c from t) select event_id, c[1][3:] as value, len(c)::int as n, c[2][3:] as second from f""",
)
register(
    "granule_time", lambda s, d: table(s, d, "events").select("event_id", F.col("event_id").alias("g")).select("event_id", timebase.granule_frame(F.col("g"), 6).alias("frame"), F.round(timebase.frame_seconds(timebase.granule_frame(F.col("g"), 6), 30000, 1001), 6).alias("seconds")),
    "with t as (select event_id, (event_id >> 6) + (event_id - ((event_id >> 6) << 6)) as frame from events) select event_id, frame, round((frame + 1) * 1001.0 / 30000.0, 6) as seconds from t",
)
register(
    "period_samples", lambda s, d: table(s, d, "events").select("event_id", timebase.period_samples(F.col("event_id") + 1, 44100, 30000, 1001).alias("start"), timebase.target_samples(F.col("event_id") + 1, 44100, 30000, 1001, 512).alias("target")),
    "select event_id, event_id * 1001 * 44100 // 30000 as start, ((event_id + 2) * 1001 * 44100 + 29999) // 30000 + 512 as target from events",
)
register(
    "rate_reduce", lambda s, d: table(s, d, "orders").select("o_orderkey", timebase.reduce_rate(F.col("o_orderkey") * 977, F.col("o_custkey") * 13 + 1).alias("r")).select("o_orderkey", "r.num", "r.den"),
    """with t as (select o_orderkey, o_orderkey * 977 as a, o_custkey * 13 + 1 as b from orders), h as (select *, greatest(0, cast(floor(log2(greatest(a, b))) as int) - 15) as h from t)
    select o_orderkey, a >> h as num, b >> h as den from h""",
)
register(
    "integer_maths", lambda s, d: table(s, d, "orders").select("o_orderkey", transforms.isqrt(F.col("o_orderkey") * 7919).alias("root"), transforms.ilog(F.col("o_orderkey")).alias("bits"), transforms.reciprocal(F.col("o_custkey") + 1).alias("inverse")),
    "select o_orderkey, cast(floor(sqrt(o_orderkey * 7919)) as bigint) as root, case when o_orderkey > 0 then length(bin(o_orderkey))::int else 0 end as bits, cast(floor(65536.0 / (o_custkey + 1)) as bigint) as inverse from orders",
)


def _residuals(s, d):
    i = lambda: F.sequence(F.lit(0), F.lit(63))
    return table(s, d, "part").select("p_partkey", F.transform(i(), lambda k: ((F.col("p_partkey") * (k + 3)) % 97 - 48).cast("int")).alias("diff"))


def _real(s, d):
    k = F.col("o_orderkey")
    values = {"rsqrt": transforms.rsqrt(k), "cosine": transforms.cos_turns(k / 7), "power": transforms.exp2(k % 40 / 8), "log": transforms.log2(k)}
    return table(s, d, "orders").select("o_orderkey", *((F.round(v, 9) + 0.0).alias(c) for c, v in values.items()))


register(
    "real_maths", _real,
    """select o_orderkey, case when o_orderkey > 0 then round(1 / sqrt(o_orderkey), 9) + 0.0 end as rsqrt, round(cos(o_orderkey / 7.0::double * pi() / 2), 9) + 0.0 as cosine,
    round(pow(2.0::double, o_orderkey % 40 / 8.0::double), 9) + 0.0 as power, case when o_orderkey > 0 then round(log2(o_orderkey), 9) + 0.0 end as log from orders""",
)
_RESIDUALS_SQL = "(select p_partkey, list_transform(range(64), lambda k: cast((p_partkey * (k + 3)) % 97 - 48 as int)) as diff from part)"
# a Hadamard coefficient's signs are the parities of the common bits of two numbers
register(
    "satd", lambda s, d: _residuals(s, d).select("p_partkey", transforms.satd8("diff").alias("satd")),
    f"select p_partkey, list_sum(list_transform(range(64), lambda u: abs(list_sum(list_transform(range(64), lambda k: case when bit_count(u & k) % 2 = 1 then -diff[k + 1] else diff[k + 1] end)))))::bigint as satd from {_RESIDUALS_SQL}",
)
_BASIS = "(case when {u} = 0 then sqrt(0.125) else 0.5 end * cos((2 * {x} + 1) * {u} * pi() / 16))"
register(
    "idct_blocks", lambda s, d: _residuals(s, d).select("p_partkey", F.posexplode(transforms.idct8("diff")).alias("k", "pixel")),
    f"""with r as {_RESIDUALS_SQL}, c as (select p_partkey, unnest(diff) as c, generate_subscripts(diff, 1) - 1 as k from r),
    h as (select p_partkey, k % 8 as u, y, sum(c * {_BASIS.format(u='(k // 8)', x='y')}) as h from c, (select unnest(range(8)) as y) group by 1, 2, 3)
    select p_partkey, (y * 8 + x)::int as k, cast(round_even(sum(h * {_BASIS.format(u='u', x='x')}), 0) as int) as pixel from h, (select unnest(range(8)) as x) group by p_partkey, y, x""",
)
register("dct_roundtrip", lambda s, d: _residuals(s, d).select("p_partkey", transforms.idct8(transforms.fdct8("diff")).alias("back")), f"select p_partkey, diff as back from {_RESIDUALS_SQL}")
register(
    "mdct_frames", lambda s, d: _residuals(s, d).select("p_partkey", F.posexplode(transforms.mdct_udf("diff")).alias("k", "c")).select("p_partkey", "k", (F.round("c", 4) + 0.0).alias("coef")),
    f"""with r as {_RESIDUALS_SQL}, c as (select p_partkey, unnest(diff) as v, generate_subscripts(diff, 1) - 1 as t from r)
    select p_partkey, k::int as k, round(sum(v * sin(pi() * (t + 0.5) / 64) * cos(pi() / 32 * (t + 16.5) * (k + 0.5))), 4) + 0.0 as coef from c, (select unnest(range(32)) as k) group by 1, 2""",
)
