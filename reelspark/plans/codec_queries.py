"""Queries on entropy coders, headers, plans and the smaller packet operators, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import entropy, pixels
from ..operators import planes, stream, vq
from ..sources import headers, scans
from . import encode
from .queries import ASSIGNED_SQL, BLOCKS_SQL, OPTIONS_SQL, assigned, options, packets, pixel_rows, register, table


def _symbols(s, d):
    total = F.col("o_orderkey") % 1000 + 2
    return table(s, d, "orders").select("o_orderkey", F.array(*((F.col("o_custkey") * k) % total for k in (1, 3, 7, 11))).alias("s"), F.array_repeat(total, 4).alias("t"))


register(
    "range_coder", lambda s, d: _symbols(s, d).select("o_orderkey", entropy.coded_and_back("s", "t").alias("back")),
    "select o_orderkey, list_transform([1, 3, 7, 11], lambda k: (o_custkey * k) % (o_orderkey % 1000 + 2)) as back from orders",
)
_PULSES = "list_transform([1, 3, 5, 7, 9], lambda k: cast((p_partkey * k) % 5 - 2 as int))"
register(
    "pulse_vectors", lambda s, d: table(s, d, "part").select("p_partkey", entropy.pulses_and_back(F.array(*(((F.col("p_partkey") * k) % 5 - 2).cast("int") for k in (1, 3, 5, 7, 9)))).alias("y")),
    f"select p_partkey, {_PULSES} as y from part",
)
register(
    "requantise", lambda s, d: table(s, d, "part").select("p_partkey", F.transform(entropy.ungroup(F.col("p_partkey") % 125, 5), lambda v: F.round(entropy.requantise(v, 5, F.lit(0.5)), 6)).alias("v")),
    "select p_partkey, list_transform([1, 5, 25], lambda b: round((2.0 * (((p_partkey % 125) // b) % 5) + 1 - 5) / 5 * 0.5, 6)) as v from part",
)
#: fixed values: a short prefix code of macroblock address increments
INCREMENTS = [("1", 1), ("011", 2), ("010", 3), ("0011", 4), ("0010", 5), ("00011", 6), ("00010", 7)]
register(
    "prefix_lookup", lambda s, d: table(s, d, "orders").select("o_orderkey", pixels.prefix_lookup(F.lpad(F.bin(F.col("o_orderkey") % 64), 6, "0"), INCREMENTS).alias("c")).select("o_orderkey", "c.value", "c.length"),
    "select o_orderkey, "
    + ", ".join("case " + " ".join(f"when b like '{c}%' then {v if k == 0 else len(c)}" for c, v in INCREMENTS) + f" end as {n}" for k, n in enumerate(("value", "length")))
    + " from (select o_orderkey, lpad(bin(o_orderkey % 64), 6, '0') as b from orders)",
)


def _headers(s, d):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["p_partkey"], "payload": [headers.build_identification(int(w), int(h), 30000, 1001, 6) for w, h in zip(pdf["p_size"] * 8 + 1, pdf["p_size"] + 100)]})

    return table(s, d, "part").select("p_partkey", "p_size").mapInPandas(run, "id long, payload binary")


register(
    "identification_headers", lambda s, d: _headers(s, d).select("id", headers.identification(F.col("payload")).alias("h"), headers.is_header(F.col("payload")).alias("header")).select("id", "header", "h.frame_width", "h.width", "h.height", "h.rate_num", "h.rate_den", "h.granule_shift", "h.quality"),
    """select p_partkey as id, true as header, (p_size * 8 + 16)::bigint // 16 * 16 as frame_width, (p_size * 8 + 1)::bigint as width, (p_size + 100)::bigint as height,
    30000::bigint as rate_num, 1001::bigint as rate_den, 6::bigint as granule_shift, 48::bigint as quality from part""",
)


def _comment_rows(s, d):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["p_partkey"], "payload": [headers.build_comments("v", [f"TITLE={n}", f"artist={b}"]) for n, b in zip(pdf["p_name"], pdf["p_brand"])]})

    return table(s, d, "part").select("p_partkey", "p_name", "p_brand").mapInPandas(run, "id long, payload binary")


register("comment_headers", lambda s, d: _comment_rows(s, d).select("id", headers.comments("payload").alias("c")), "select p_partkey as id, ['TITLE=' || p_name, 'artist=' || p_brand] as c from part")
register(
    "key_frames", lambda s, d: packets(s, d).select("seq", headers.is_key_frame(F.unhex(F.lpad(F.hex(F.col("seq") % 256), 2, "0"))).alias("key")),
    "select event_id as seq, (event_id % 256) & 192 = 0 as key from events",
)
register(
    "picture_headers", lambda s, d: table(s, d, "orders").select("o_orderkey", scans.picture_header(F.unhex(F.lpad(F.hex((F.col("o_orderkey") * 2654435761) % 4294967296), 8, "0"))).alias("h")).select("o_orderkey", "h.temporal", "h.kind", "h.vbv_delay"),
    """select o_orderkey, w >> 22 as temporal, case (w >> 19) & 7 when 1 then 'I' when 2 then 'P' when 3 then 'B' when 4 then 'D' end as kind, (w >> 3) & 65535 as vbv_delay
    from (select o_orderkey, (o_orderkey * 2654435761) % 4294967296 as w from orders)""",
)
register(
    "audio_syncs", lambda s, d: stream.with_audio_syncs(packets(s, d).where("ptype = 'click'").drop("ptype"), 1152).select("file", "seq", "period", "ptype"),
    """select user_id as file, event_id as seq, (row_number() over (partition by user_id order by event_id) * 1152)::int as period, p as ptype
    from events, (select unnest(['audio_frame', 'audio_sync']) as p) where event_type = 'click' qualify true""".replace("row_number() over (partition by user_id order by event_id)", "dense_rank() over (partition by user_id order by event_id)"),
)
register(
    "header_sizes", lambda s, d: packets(s, d).select("seq", stream.header_bytes(F.col("size"), F.col("stream")).alias("bytes")),
    "select event_id as seq, case when user_id % 3 = 0 and floor(value * 100) < 32768 then 7 else 10 end as bytes from events",
)
register("vq_scrub", lambda s, d: vq.scrub(assigned(s, d), 4000).select("point_id", "dist"), f"select point_id, dist from {ASSIGNED_SQL} where dist > 4000")
register(
    "cell_merge", lambda s, d: vq.merge_cells(assigned(s, d), s.createDataFrame([(3, 1), (5, 2)], "cb_id long, into long")).select("point_id", "cb_id"),
    f"select point_id, case cb_id when 3 then 1 when 5 then 2 else cb_id end as cb_id from {ASSIGNED_SQL}",
)
register(
    "two_pass_bits", lambda s, d: encode.two_pass_bits(options(s, d).select(F.floor(F.col("block_id") / 64).alias("clip"), "block_id", "opt", F.col("dist").alias("cost")), 100_000),
    f"""select clip, block_id, opt, cost, greatest(1, cast(floor(100000 * cost / sum(cost) over (partition by clip)) as bigint)) as bits
    from (select cast(floor(block_id / 64) as bigint) as clip, block_id, opt, dist as cost from {OPTIONS_SQL})""",
)
register(
    "texture_scale", lambda s, d: table(s, d, "part").select("p_partkey", F.round(pixels.texture_scale(F.col("p_size") * 10, F.ceil(F.col("p_size") * 10 / 16) * 16), 6).alias("u")),
    "select p_partkey, round((p_size * 10) / (ceil(p_size * 10 / 16) * 16), 6) as u from part",
)


def _plan(s, d):
    plan = encode.Plan("select, compact, pack", needs={"file", "size", "stream"})
    plan = plan.then("select", lambda df: df.where("stream = 0")).then("size", lambda df: df.withColumn("bytes", F.col("size") + stream.header_bytes(F.col("size"), F.col("stream"))))
    return plan.then("total", lambda df: df.groupBy("file").agg(F.sum("bytes").alias("bytes"))).run(packets(s, d))


register(
    "encode_plan", _plan,
    "select user_id as file, sum(cast(floor(value * 100) as bigint) + case when floor(value * 100) < 32768 then 7 else 10 end)::bigint as bytes from events where user_id % 3 = 0 group by 1",
)


def _dc_blocks(s, d):
    """Events of a user as a plane of blocks, eight in a row; every fifth isn't coded."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(s, d, "events").select(F.col("user_id").alias("frame"), F.lit(0).cast("long").alias("plane"), n.alias("n"), (F.floor(F.col("value")) - 200).cast("long").alias("diff"), "event_id")
    ref = F.when(F.col("event_id") % 5 == 0, -1).otherwise(F.col("event_id") % 3)
    return rows.select("frame", "plane", F.floor(F.col("n") / 8).alias("y"), (F.col("n") % 8).cast("long").alias("x"), "diff", ref.cast("long").alias("ref"))


register("dc_neighbours", lambda s, d: planes.restore_planes(_dc_blocks(s, d)))
register("deblock", lambda s, d: planes.deblock_planes(pixel_rows(s, d), 12))


def _slices(s, d):
    """Order lines as inter macroblocks of one slice an order: a vector and one level each."""
    from ..sources import slices
    from .queries import macroblocks

    rows = macroblocks(s, d).select("slice_id", F.struct((F.col("mb_addr") - 1).alias("mb"), (F.col("diff") % 16).alias("y"), (F.col("part") % 16).alias("x"), (F.col("supp") % 64).alias("at"), (F.col("part") % 255 + 1).alias("v")).alias("m"))
    grouped = rows.groupBy("slice_id").agg(F.sort_array(F.collect_list("m")).alias("m"))

    def run(batches):
        for batch in batches:
            m = batch.column("m")
            ends = (np.asarray(m.offsets) - m.offsets[0].as_py()).tolist()
            fields = [m.flatten().field(c).to_pylist() for c in ("mb", "y", "x", "at", "v")]
            out = []
            for first, end in zip(ends, ends[1:]):
                items = []
                for mb, y, x, at, v in zip(*(c[first:end] for c in fields)):
                    block = [0] * 64
                    block[at] = v
                    items.append({"mb_addr": mb, "kind": "fp", "scale": 5, "forward": (y, x), "pattern": 32, "blocks": [block, *[None] * 5]})
                out.append(slices.build_slice(items, "P", 0, 8, 5))
            yield pa.RecordBatch.from_arrays([batch.column("slice_id"), pa.array(out, pa.binary())], ["frame", "payload"])

    fixed = {"file": F.lit("a"), "picture": F.lit("P"), "row": F.lit(0), "forward": F.lit(1), "backward": F.lit(1)}
    made = grouped.mapInArrow(run, "frame long, payload binary").withColumns(fixed)
    return slices.macroblocks(made, 8).select(
        "frame", "mb_addr", "kind", "scale", F.col("forward.y").alias("y"), F.col("forward.x").alias("x"), "pattern", F.array_max(F.col("blocks")[0]).alias("level"), F.array_position(F.col("blocks")[0], F.array_max(F.col("blocks")[0])).alias("place"), "bad"
    )


register(
    "mpeg_slices", _slices,
    """select slice_id as frame, mb_addr - 1 as mb_addr, 'fp' as kind, 5 as scale, (diff % 16)::int as y, (part % 16)::int as x, 32 as pattern, (part % 255 + 1)::int as level, (supp % 64 + 1)::bigint as place, null::varchar as bad
    from """ + BLOCKS_SQL,
)
