"""Queries that build small files from the tables, read them back, and must find what went in."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..sources import codecs, container, scans
from ..streaming import audio_buffer
from .queries import SIDE, pixel_rows, pixel_sql, register, table

_HEAD = {"video_type": 2, "audio_type": 3, "width": 320, "height": 240, "rate_num": 30, "rate_den": 1, "rw_frames": 2, "wo_frames": 0, "frame_format": 1, "layout": 0, "sample_rate": 44100, "audio_readahead": 0}


def _packets(s, d):
    """Events as packets of one file a user: payload from props, type from the event."""
    number = F.when(F.col("event_type") == "purchase", "video_sync").when(F.col("event_type") == "view", "video_inline").otherwise("audio_frame")
    return table(s, d, "events").select(
        F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("out"), number.alias("ptype"), (F.col("user_id") % 3).alias("stream"), F.lit(0).alias("flags"),
        F.encode("props", "UTF-8").alias("payload"),
    )


def _movies(s, d):
    heads = _packets(s, d).select("file").distinct()
    for k, v in _HEAD.items():
        heads = heads.withColumn(k, F.lit(v))
    heads = heads.withColumn("audio", F.array(F.struct(F.lit(1).alias("layout"), F.concat(F.lit("u"), "file").alias("meta_id"))))
    return container.encode_movies(heads, _packets(s, d))


register(
    "container_packets", lambda s, d: container.read_packets(_movies(s, d)).select("file", "seq", "ptype", "stream", "size", F.decode("payload", "UTF-8").alias("payload"), "bad"),
    """select user_id::varchar as file, row_number() over (partition by user_id order by event_id) - 1 as seq,
    case event_type when 'purchase' then 'video_sync' when 'view' then 'video_inline' else 'audio_frame' end as ptype,
    (user_id % 3)::int as stream, strlen(props)::bigint as size, props as payload, null::varchar as bad from events""",
)
register(
    "container_headers", lambda s, d: container.read_headers(_movies(s, d)).select("file", "width", "rate_num", "sample_rate", "largest_packet", F.col("audio")[0]["meta_id"].alias("meta_id")),
    "select user_id::varchar as file, 320 as width, 30::bigint as rate_num, 44100::bigint as sample_rate, max(strlen(props))::bigint as largest_packet, ('u' || user_id::varchar)[1:8] as meta_id from events group by user_id",
)


def _files(s, d):
    """One file a document, of its text's bytes; scans make them into the kind of file they read."""
    return table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.coalesce(F.col("text").cast("binary"), F.expr("X''")).alias("content"))


def _pages_of(text: bytes) -> bytes:
    lines = text.split(b"\n")
    return scans.build_pages([(line, k) for k, line in enumerate(lines)], fill=512)


register(
    "ogg_packets", lambda s, d: scans.ogg_packets(scans.ogg_pages(_files(s, d), make=_pages_of)).select("file", "packet", "size", "hole", F.md5("payload").alias("md5")),
    r"""with l as (select doc_id::varchar as file, string_split(coalesce(text, ''), chr(10)) as l from documents)
    select file, (k - 1)::bigint as packet, strlen(l[k])::bigint as size, false as hole, md5(l[k]) as md5 from (select file, l, unnest(range(1, len(l) + 1)) as k from l)""",
)
register("ogg_damage", lambda s, d: scans.ogg_pages(_files(s, d), make=lambda t: b"junk" + _pages_of(t)[:-1]).groupBy("file").agg(F.count("bad").alias("n_bad"), F.count("page_no").alias("n_good")))


def _mpeg_of(text: bytes) -> bytes:
    """A sequence header whose size and rate follow from the text, then a picture and a slice for each word."""
    words = text.split()
    size = (16 + len(text) % 4000) << 12 | 16 + len(words) % 4000
    out = [b"\0\0\1\xb3" + size.to_bytes(3, "big") + bytes([0x10 | 1 + len(words) % 8, 0xFF, 0xFF, 0xE0, 0x18])]
    for k, word in enumerate(words):
        kind = (1, 3, 3, 2)[k % 4]
        out.append(b"\0\0\1\0" + bytes([0, kind << 3]) + word + b"\0\0\1\1" + word[::-1])
    return b"".join(out)


def _marks(s, d):
    return scans.start_codes(_files(s, d), make=_mpeg_of)


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0d\x20]+'), lambda x: x <> '')"
register("start_codes", lambda s, d: _marks(s, d).select("file", "pos", "code", "file_size"),
    f"""with w as (select doc_id::varchar as file, list_transform({_WORDS}, lambda x: strlen(x)) as l from documents),
    k as (select file, unnest(l) as n, generate_subscripts(l, 1) as k from w),
    o as (select file, n, 12 + coalesce(sum(10 + 2 * n) over (partition by file order by k rows between unbounded preceding and 1 preceding), 0) as pos from k),
    m as (select file, pos, 0 as code from o union all select file, pos + 6 + n, 1 from o union all select file, 0, 179 from w)
    select file, pos::bigint as pos, code, (12 + 10 * len(l) + 2 * coalesce(list_sum(l), 0))::bigint as file_size from m join w using (file)""")
register(
    "sequence_headers", lambda s, d: _marks(s, d).where("code = 179").select("file", scans.sequence_header(F.col("head")).alias("h")).select("file", "h.*"),
    f"""with t as (select doc_id::varchar as file, strlen(coalesce(text, '')) as n, len({_WORDS}) as w from documents)
    select file, (16 + n % 4000)::bigint as width, (16 + w % 4000)::bigint as height, [24000, 24, 25, 30000, 30, 50, 60000, 60][w % 8 + 1]::bigint as num,
    [1001, 1, 1, 1001, 1, 1, 1001, 1][w % 8 + 1]::bigint as den from t""",
)
register("picture_kinds", lambda s, d: _marks(s, d).where("code = 0").groupBy("file", scans.picture_kind(F.col("head")).alias("kind")).count(),
    r"""with w as (select doc_id::varchar as file, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0d\x20]+'), lambda x: x <> '')) as n from documents)
    select file, ['I', 'B', 'B', 'P'][k % 4 + 1] as kind, count(*) as count from (select file, unnest(range(n)) as k from w) group by 1, 2""")


#: bitrate codes of the table's rows for 128, 160, 192 kbit/s, chosen by document
_MP2_RATES = ((8, 128), (9, 160), (10, 192))


def _extension_of(text: bytes) -> bytes:
    """An extension of kind 1 whose fields follow from the text's length, behind some bytes of the text."""
    n, word = len(text), 0
    for value, width in ((1, 4), (n, 8), (n, 1), (1 + n % 3, 2), (n, 2), (n // 4, 2), (n, 12), (1, 1), (n * 7, 8), (n // 2, 1), (n // 8, 2), (n // 32, 5)):
        word = word << width | value & (1 << width) - 1
    return text.replace(b"\0", b"") + b"\0\0\1\xb5" + word.to_bytes(6, "big")


register(
    "sequence_extensions", lambda s, d: scans.start_codes(_files(s, d), make=_extension_of).where("code = 181").select("file", scans.sequence_extension(F.col("head")).alias("h")).select("file", "h.*"),
    """with t as (select doc_id::varchar as file, strlen(coalesce(text, '')) as n from documents)
    select file, n % 256 as profile_level, n % 2 = 1 as progressive, ['420', '422', '444'][n % 3 + 1] as chroma, n % 4 as width_ext, (n // 4) % 4 as height_ext, n % 4096 as bitrate_ext, (n * 7) % 256 as vbv_ext,
    (n // 2) % 2 = 1 as low_delay, (n // 8) % 4 as rate_n, (n // 32) % 32 as rate_d from t""",
)


def _avi_of(text: bytes) -> bytes:
    """A Cinepak file: a header of one video stream, and a frame for each line of the text."""
    chunk = lambda name, body: name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    frames = text.split(b"\n")
    long = lambda *v: b"".join((x % 2**32).to_bytes(4, "little") for x in v)
    strh = b"vidscvid" + long(0, 0, 0, 1001, 30000 + len(frames), 0, len(frames), 0, 0, 0, 0, 0)
    avih = long(33366, 0, 0, 0, len(frames), 0, 1, 0, 64, 48, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh)))
    body = b"".join(chunk(b"00dc", bytes([k % 2]) + (10 + len(f)).to_bytes(3, "big") + b"\0\x40\0\x30\0\1" + f) for k, f in enumerate(frames))
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"movi" + body))


register("avi_streams", lambda s, d: scans.avi_streams(_files(s, d), make=_avi_of),
    """select doc_id::varchar as file, 0 as stream, 'vids' as kind, 'cvid' as handler, 1001::bigint as scale, 30000::bigint + n as rate, n as length
    from (select doc_id, len(string_split(coalesce(text, ''), chr(10))) as n from documents)""")
register("avi_frames", lambda s, d: scans.avi_frames(_files(s, d), make=_avi_of).select("file", "stream", "n", "size", scans.cvid_header(F.col("payload")).alias("h"), F.md5(F.expr("substring(payload, 11)")).alias("md5")).select("file", "stream", "n", "size", "h.*", "md5"),
    """with l as (select doc_id::varchar as file, string_split(coalesce(text, ''), chr(10)) as l from documents), f as (select file, unnest(l) as f, generate_subscripts(l, 1) - 1 as n from l)
    select file, 0 as stream, n::int as n, 10::bigint + strlen(f) as size, (n % 2)::bigint as flags, 10::bigint + strlen(f) as length, 64::bigint as width, 48::bigint as height, 1::bigint as strips, md5(f) as md5 from f""")


def _mp2_of(text: bytes) -> bytes:
    """The whole text, over as many frames as it fills; the bitrate changes from frame to frame."""
    out, at, k = [], 0, 0
    while at < len(text) or not k:
        code, kbits = _MP2_RATES[k % 3]
        size = kbits * 144_000 // 44100
        out.append(b"\xff\xfd" + bytes([code << 4, 0]) + text[at : at + size - 4].ljust(size - 4, b"x"))
        at, k = at + size - 4, k + 1
    return b"".join(out)


#: three frames hold 413 + 518 + 622 bytes of text
register("mp2_frames", lambda s, d: scans.mp2_frames(_files(s, d), make=_mp2_of).select("file", "pos", "rate", "kbits", "channels", "crc", "size", "bad"),
    """with t as (select doc_id::varchar as file, strlen(coalesce(text, '')) as n from documents),
    f as (select file, n, unnest(range(3 * (n // 1553 + 1))) as k from t),
    g as (select *, (k // 3) * 1553 + [0, 413, 931][k % 3 + 1] as before, (k // 3) * 1565 + [0, 417, 939][k % 3 + 1] as pos from f)
    select file, pos, 44100 as rate, [128, 160, 192][k % 3 + 1] as kbits, 2 as channels, false as crc, [417, 522, 626][k % 3 + 1] as size, null::varchar as bad from g where before < n or k = 0""")


def _wav_of(text: bytes) -> bytes:
    data = text[: len(text) // 4 * 4]
    fmt = (1).to_bytes(2, "little") + (2).to_bytes(2, "little") + (44100).to_bytes(4, "little") + (176400).to_bytes(4, "little") + (4).to_bytes(2, "little") + (16).to_bytes(2, "little")
    body = b"WAVEfmt " + len(fmt).to_bytes(4, "little") + fmt + b"note" + (3).to_bytes(4, "little") + b"odd\0" + b"data" + len(data).to_bytes(4, "little") + data
    return b"RIFF" + len(body).to_bytes(4, "little") + body


register("riff_chunks", lambda s, d: scans.riff_chunks(_files(s, d), make=_wav_of).select("file", "path", "depth", "fourcc", "size"),
    """select doc_id::varchar as file, p as path, dd::int as depth, f as fourcc, case f when 'RIFF' then 44 + n when 'fmt ' then 16 when 'note' then 3 else n end::bigint as size
    from (select doc_id, strlen(coalesce(text, '')) // 4 * 4 as n from documents), (values ('/WAVE', 0, 'RIFF'), ('/WAVE/fmt ', 1, 'fmt '), ('/WAVE/note', 1, 'note'), ('/WAVE/data', 1, 'data')) t(p, dd, f)""")
register("wav_samples", lambda s, d: scans.wav_samples(_files(s, d), make=_wav_of).groupBy("file", "ch").agg(F.count("*").alias("n"), F.sum("v").alias("total")),
    r"""with t as (select doc_id::varchar as file, regexp_extract_all(hex(encode(coalesce(text, ''))), '.{8}') as l from documents), i as (select file, unnest(l) as h from t),
    v as (select file, ch, ('0x' || h[4 * ch + 3:4 * ch + 4] || h[4 * ch + 1:4 * ch + 2])::int as u from i, (select unnest(range(2)) as ch))
    select file, ch, count(*) as n, sum(case when u >= 32768 then u - 65536 else u end)::bigint as total from v group by 1, 2""")


def _y4m_of(text: bytes) -> bytes:
    """The whole text, 96 bytes a frame."""
    cut = range(0, max(1, len(text)), 96)
    return b"YUV4MPEG2 W8 H8 F25:1 Ip C420jpeg\n" + b"".join(b"FRAME\n" + text[k : k + 96].ljust(96, b"\x80") for k in cut)


register("yuv_planes", lambda s, d: scans.yuv_planes(_files(s, d), make=_y4m_of).select("file", "frame", "plane", "width", "height", F.md5("payload").alias("md5")),
    r"""with t as (select doc_id::varchar as file, hex(encode(coalesce(text, ''))) as h from documents), f as (select file, h, unnest(range(greatest(1, (len(h) + 191) // 192))) as f from t)
    select file, f as frame, p as plane, w as width, w as height, md5(unhex(rpad(h[f * 192 + o + 1:f * 192 + least(o + n, 192)], n, '80'))) as md5
    from f, (values (0, 8, 0, 128), (1, 4, 128, 32), (2, 4, 160, 32)) p(p, w, o, n)""")


def _exported(s, d):
    """Frames as YUV4MPEG files of eight frames each, read back."""
    px = pixel_rows(s, d).withColumn("file", F.floor(F.col("frame") / 8).cast("string"))
    return scans.yuv_planes(scans.write_yuv(px, SIDE, SIDE)).select("file", "frame", "plane", F.md5("payload").alias("md5"))


register("frame_export", _exported,
    f"""with p as {pixel_sql()}, g as (select frame, plane, unnest(range({SIDE * SIDE})) as k from (select distinct frame, plane from p)),
    b as (select g.frame, g.plane, string_agg(lpad(to_hex(coalesce(v, 0)), 2, '0'), '' order by k) as h from g left join p on p.frame = g.frame and p.plane = g.plane and p.y = k // {SIDE} and p.x = k % {SIDE} group by 1, 2)
    select (frame // 8)::varchar as file, frame % 8 as frame, plane::int as plane, md5(unhex(h)) as md5 from b""")


#: text coded side by side: enough for many packets at each step, and a bound in memory
ADPCM_BYTES = 8 << 20


def _adpcm_rows(s, d, coded, schema):
    """Rows of the documents, by coded(ids, contents) of ADPCM_BYTES of text at a time."""

    def run(batches):
        for batch in batches:
            ids, held, size = [], [], 0
            for doc_id, content in zip(batch.column("doc_id"), batch.column("content")):
                ids.append(doc_id.as_py())
                held.append(content.as_py())
                size += len(held[-1])
                if size >= ADPCM_BYTES:  # side by side, but bounded
                    yield pa.RecordBatch.from_pydict(coded(ids, held), fields)
                    ids, held, size = [], [], 0
            if held:
                yield pa.RecordBatch.from_pydict(coded(ids, held), fields)

    fields = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])
    content = F.coalesce(F.col("text").cast("binary"), F.expr("X''"))
    return table(s, d, "documents").select("doc_id", content.alias("content")).mapInArrow(run, schema)


def _adpcm(s, d):
    """Texts as packets: three bytes of state and codes for each of one channel."""

    def coded(ids, held):
        out = codecs.adpcm_decode_many([bytes([40, 0]) + c for c in held])
        return {"doc_id": ids, "n": [len(o) for o in out], "total": [int(o.sum(dtype=np.int64)) for o in out], "last": [int(o[-1]) if len(o) else 0 for o in out]}

    return _adpcm_rows(s, d, coded, "doc_id long, n long, total long, last long")


register("adpcm_decode", _adpcm)


def _adpcm_samples(content):
    """One sample a byte of the whole text; an odd last one is repeated, as a byte of codes holds two."""
    v = (np.frombuffer(content, np.uint8).astype(np.int16) - 100) * 100
    return np.append(v, v[-1:]) if len(v) % 2 else v


def _adpcm_back(s, d):
    """(doc_id, n, codes_crc, total, worst): whole texts encoded and decoded again."""

    def coded(ids, held):
        held = [_adpcm_samples(c) for c in held]
        packets = codecs.adpcm_encode_many(held, 40)
        back = codecs.adpcm_decode_many(packets)
        return {
            "doc_id": ids, "n": [len(b) for b in back], "codes_crc": [zlib.crc32(p) for p in packets], "total": [int(b.sum(dtype=np.int64)) for b in back],
            "worst": [int(np.abs(b.astype(np.int32) - v).max(initial=0)) for b, v in zip(back, held)],
        }

    return _adpcm_rows(s, d, coded, "doc_id long, n long, codes_crc long, total long, worst long")


register("adpcm_encode", _adpcm_back)  # a recurrence over whole texts is too deep for SQL: tests hold it against the plain coder


def _video(s, d):
    """Each vector as a frame of codebook video: cells from its values, one motion block, entries by position."""
    rows = table(s, d, "embeddings").select((F.col("vec_id") % 50).cast("string").alias("file"), F.col("vec_id").alias("seq"), "embedding")

    def run(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for n, vec in zip(pdf["seq"], pdf["embedding"]):
                v = (np.floor(np.asarray(vec, float) * 128).astype(int) % 256).astype(np.uint8)
                cells = v[:48].reshape(8, 6).tobytes()
                entries = bytes(int(k) % 8 for k in v[48:64])
                ops = [("vector", int(n) % 4), ("motion", 0x88), ("quad", [("vector", 1), ("skip",), ("quad", [0, 1, 2, 3]), ("vector", 2)]), ("skip",)]
                out.append(codecs.chunk(codecs.CODEBOOK, 8 << 8 | 4, cells + entries) + codecs.chunk(codecs.VIDEO, 0, codecs.build_quads(ops)))
            yield pd.DataFrame({"file": pdf["file"], "seq": pdf["seq"], "payload": out})

    return codecs.decode_video(rows.mapInPandas(run, "file string, seq long, payload binary"), 16, 16)


register("codebook_video", lambda s, d: _video(s, d).groupBy("file", "frame").agg(F.sum("v").alias("luma"), F.count("*").alias("n")))


def _clusters(s, d):
    packets = _packets(s, d).withColumn("granule", F.floor(F.col("out") / 64))
    grouped = packets.groupBy("file", "granule").agg(F.sort_array(F.collect_list(F.struct("out", "payload"))).alias("p"))

    def run(batches):
        for pdf in batches:
            rows = []
            for file, granule, p in zip(pdf["file"], pdf["granule"], pdf["p"]):
                back = codecs.parse_cluster(codecs.build_cluster(int(granule), [bytes(r["payload"]) for r in p]))
                rows += [(file, r["granule"], r["n"], len(r["payload"])) for r in back]
            yield pd.DataFrame(rows, columns=["file", "granule", "n", "size"])

    return grouped.mapInPandas(run, "file string, granule long, n int, size long")


register("clusters", _clusters,
    "select user_id::varchar as file, event_id // 64 as granule, (row_number() over (partition by user_id, event_id // 64 order by event_id) - 1)::int as n, strlen(props)::bigint as size from events")


def _buffer(s, d):
    kind = F.when(F.col("event_type") == "purchase", "sync").when(F.col("event_type") == "signup", "play").when(F.col("event_type") == "error", "read").otherwise("audio")
    value = F.when(kind == "audio", F.lit(1152)).when(kind == "read", F.lit(700)).otherwise(F.floor(F.col("value")) * 100)
    return table(s, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), kind.alias("kind"), value.cast("long").alias("value"))


register("audio_commits", lambda s, d: audio_buffer.replay(_buffer(s, d)))
