"""Scans of raw media files: start codes, audio frames, chunk trees, planar video, pages.

Each takes a table (file, content) and yields rows; what follows from fixed positions
is left to column expressions, so that it stays visible to the optimiser. With ``make``,
a file's bytes are made of its content where they are read, in the same worker and one
file at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.bytes import bits, field, page_crc_bytes


GATHER_ROWS, GATHER_BYTES = 20_000, 1 << 20
MARK_BYTES = 256 << 10


def _contents(batch: pa.RecordBatch, make):
    """(file, content) of a batch, one at a time; ``make`` turns what the table holds into the file's bytes."""
    for file, content in zip(batch.column("file"), batch.column("content")):
        data = content.as_py() or b""
        yield file.as_py(), make(data) if make else data


def _flat(files: DataFrame, fn, schema: str, make=None) -> DataFrame:
    """Rows fn(content) yields, with the file's name in front; a batch given back holds a bounded number of rows and bytes."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def gathered(rows):
        return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), fields)], schema=fields)

    def run(batches):
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for file, content in _contents(batch, make):
                for r in fn(content):
                    rows.append((file, *r))
                    size += sum(len(v) for v in r if isinstance(v, bytes))
                    if len(rows) >= GATHER_ROWS or size >= GATHER_BYTES:
                        yield gathered(rows)
                        rows, size = [], 0
        if rows:
            yield gathered(rows)

    return files.select("file", "content").mapInArrow(run, schema)


# ---------------------------------------------------------------- start codes


HEAD = 12


def _marks(held: list[tuple[str, bytes]]):
    """Batches of all start codes of some files; a mark and the bytes behind it stay within their file."""
    sizes = np.array([len(c) for _, c in held])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join([*(c for _, c in held), bytes(HEAD + 4)]), np.uint8)
    names = pa.array([f for f, _ in held], pa.string())
    spread = np.arange(HEAD)
    for first in range(0, len(data) - 2, MARK_BYTES):  # of a longer file, too, a piece at a time
        at = first + np.flatnonzero(data[first : min(first + MARK_BYTES, len(data) - 2)] == 0)
        at = at[(data[at + 1] == 0) & (data[at + 2] == 1)]
        own = np.searchsorted(ends, at, "right")
        inside = own < len(held)
        at, own = at[inside], own[inside]
        keep = at + 3 < ends[own]
        at, own = at[keep], own[keep]
        length = np.minimum(HEAD, ends[own] - at - 4)
        head = data[at[:, None] + 4 + spread][spread < length[:, None]]
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        heads = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(head.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(own)), pa.array(at - (ends - sizes)[own]), pa.array(data[at + 3].astype(np.int32)), heads, pa.array(sizes[own])], ["file", "pos", "code", "head", "file_size"]
        )


def start_codes(files: DataFrame, make=None) -> DataFrame:
    """(file, pos, code, head, file_size): every 00 00 01 xx with the 12 bytes behind it."""

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for file, content in _contents(batch, make):
                held.append((file, content))
                size += len(content)
                if size >= MARK_BYTES:  # few large frames, but bounded
                    yield from _marks(held)
                    held, size = [], 0
            if held:
                yield from _marks(held)

    return files.select("file", "content").mapInArrow(run, "file string, pos long, code int, head binary, file_size long")


#: fixed values: frame rates by code
RATES = {1: (24000, 1001), 2: (24, 1), 3: (25, 1), 4: (30000, 1001), 5: (30, 1), 6: (50, 1), 7: (60000, 1001), 8: (60, 1)}


def sequence_header(head: Column) -> Column:
    """Struct (width, height, num, den) of the bytes behind a sequence start code. All 12 bits of the height count."""
    size = field(head, 0, 3)
    code = field(head, 3, 1).bitwiseAND(15)
    num, den = F.lit(None).cast("long"), F.lit(None).cast("long")
    for k, (n, d) in RATES.items():
        num, den = F.when(code == k, n).otherwise(num), F.when(code == k, d).otherwise(den)
    return F.struct(F.shiftright(size, 12).alias("width"), size.bitwiseAND(4095).alias("height"), num.cast("long").alias("num"), den.cast("long").alias("den"))


def sequence_extension(head: Column) -> Column:
    """Struct of the fields behind an extension start code of kind 1, else null; 4:4:4 is its own format."""
    word = field(head, 0, 6)
    get = lambda at, n: bits(word, at, n, 48)
    chroma = get(13, 2)
    out = F.struct(
        get(4, 8).alias("profile_level"), (get(12, 1) == 1).alias("progressive"),
        F.when(chroma == 1, "420").when(chroma == 2, "422").when(chroma == 3, "444").alias("chroma"),
        get(15, 2).alias("width_ext"), get(17, 2).alias("height_ext"), get(19, 12).alias("bitrate_ext"), get(32, 8).alias("vbv_ext"), (get(40, 1) == 1).alias("low_delay"),
        get(41, 2).alias("rate_n"), get(43, 5).alias("rate_d"),
    )
    return F.when(get(0, 4) == 1, out)


def picture_kind(head: Column) -> Column:
    """'I', 'P', 'B' or 'D' of the bytes behind a picture start code."""
    return F.get(F.array(F.lit(None).cast("string"), *map(F.lit, "IPBD")), bits(field(head, 0, 2), 10, 3, 16).cast("int"))


def same_sequences(marks: DataFrame) -> DataFrame:
    """(file, ok): whether all sequence headers of a file are equal."""
    return marks.where("code = 179").groupBy("file").agg((F.countDistinct(F.substring("head", 1, 8)) == 1).alias("ok"))


# ---------------------------------------------------------------- MP2 frames

#: fixed values: sample rates and kbit/s of the two versions of layer II
MP2_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000)}
MP2_KBITS = {
    3: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}


def _mp2_frames(data: bytes):
    at = 0
    while at + 4 <= len(data):
        head = int.from_bytes(data[at : at + 4], "big")
        version, layer, rate, kbits = head >> 19 & 3, head >> 17 & 3, head >> 10 & 3, head >> 12 & 15
        if head >> 21 != 0x7FF or version < 2 or layer != 2 or kbits in (0, 15) or rate == 3:
            yield at, None, None, None, None, None, None, "bad header"
            return
        hz, kb = MP2_RATES[version][rate], MP2_KBITS[version][kbits]
        size = kb * 144_000 // hz + (head >> 9 & 1)
        if at + size > len(data):
            yield at, hz, kb, None, None, size, None, "cut frame"
            return
        crc = not head >> 16 & 1
        yield at, hz, kb, 1 if head >> 6 & 3 == 3 else 2, crc, size, data[at + (6 if crc else 4) : at + size - (head >> 9 & 1)], None
        at += size


def mp2_frames(files: DataFrame, make=None) -> DataFrame:
    """Frames chained by their lengths, payload without header, checksum and padding; the first bad one ends a file."""
    return _flat(files, _mp2_frames, "file string, pos long, rate int, kbits int, channels int, crc boolean, size int, payload binary, bad string", make)


# ---------------------------------------------------------------- RIFF


def _riff(data: bytes):
    stack = [(0, len(data), 0, "")]
    while stack:
        at, end, depth, path = stack.pop()
        if at + 8 > end:
            continue
        name, size = data[at : at + 4].decode("latin-1"), int.from_bytes(data[at + 4 : at + 8], "little")
        last = min(end, at + 8 + size)
        stack.append((at + 8 + size + size % 2, end, depth, path))
        if name in ("RIFF", "LIST"):
            kind = data[at + 8 : at + 12].decode("latin-1")
            yield f"{path}/{kind}", depth, name, at + 12, max(0, size - 4), None
            stack.append((at + 12, last, depth + 1, f"{path}/{kind}"))
        else:
            yield f"{path}/{name}", depth, name, at + 8, size, data[at + 8 : last]


def riff_chunks(files: DataFrame, make=None) -> DataFrame:
    """(file, path, depth, fourcc, offset, size, payload) of the chunk tree; odd sizes are padded. Look-ups are filters."""
    return _flat(files, _riff, "file string, path string, depth int, fourcc string, offset long, size long, payload binary", make)


def wav_format(payload: Column) -> Column:
    """Struct of a 'fmt ' chunk."""
    at = {"format": (0, 2), "channels": (2, 2), "rate": (4, 4), "bytes_per_second": (8, 4), "align": (12, 2), "bits": (14, 2)}
    return F.struct(*(field(payload, a, n, little=True).alias(k) for k, (a, n) in at.items()))


def wav_samples(files: DataFrame, frame: int = 1, make=None) -> DataFrame:
    """(file, n, ch, v): 8- and 16-bit samples as 16 bits; each channel is filled with zeros to whole frames."""
    tree = riff_chunks(files, make)
    fmt = tree.where("path = '/WAVE/fmt '").select("file", wav_format(F.col("payload")).alias("f")).select("file", "f.channels", "f.bits")
    both = tree.where("path = '/WAVE/data'").select("file", "payload").join(fmt, "file")

    def gathered(held):
        names = pa.concat_arrays([pa.repeat(file, len(n)) for file, n, _, _ in held])
        return pa.RecordBatch.from_arrays([names, *(pa.array(np.concatenate([h[k] for h in held])) for k in (1, 2, 3))], ["file", "n", "ch", "v"])

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for file, raw, channels, width in zip(*(batch.column(c).to_pylist() for c in ("file", "payload", "channels", "bits"))):
                v = np.frombuffer(raw, "<i2").astype(np.int32) if width == 16 else (np.frombuffer(raw, np.uint8).astype(np.int32) - 128) * 256
                v = v[: len(v) // channels * channels].reshape(-1, channels)
                v = np.vstack([v, np.zeros((-len(v) % frame, channels), np.int32)])
                n, ch = np.divmod(np.arange(v.size), channels)
                held.append((file, n, ch.astype(np.int32), v.ravel()))
                size += v.size
                if size >= GATHER_BYTES // 16:
                    yield gathered(held)
                    held, size = [], 0
            if held:
                yield gathered(held)

    return both.mapInArrow(run, "file string, n long, ch int, v int")


def avi_streams(files: DataFrame, make=None) -> DataFrame:
    """(file, stream, kind, handler, scale, rate, length): the stream headers of AVI files, numbered as they stand."""
    heads = riff_chunks(files, make).where("path = '/AVI /hdrl/strl/strh'")
    name = lambda at: F.decode(F.substring("payload", at + 1, 4), "ISO-8859-1")
    number = lambda at: field(F.col("payload"), at, 4, little=True)
    w = Window.partitionBy("file").orderBy("offset")
    return heads.select("file", (F.row_number().over(w) - 1).alias("stream"), name(0).alias("kind"), name(4).alias("handler"), number(20).alias("scale"), number(24).alias("rate"), number(32).alias("length"))


def avi_frames(files: DataFrame, make=None) -> DataFrame:
    """(file, stream, n, offset, size, payload): the data chunks of AVI files, numbered by stream."""
    data = riff_chunks(files, make).where("path like '/AVI /movi/%' and fourcc rlike '^[0-9]{2}(dc|db|wb)$'")
    rows = data.select("file", F.substring("fourcc", 1, 2).cast("int").alias("stream"), "offset", "size", "payload")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("file", "stream").orderBy("offset")) - 1)


def cvid_header(payload: Column) -> Column:
    """Struct of a Cinepak frame's header: flags, length, size and strips; numbers are big-endian."""
    at = {"flags": (0, 1), "length": (1, 3), "width": (4, 2), "height": (6, 2), "strips": (8, 2)}
    return F.struct(*(field(payload, a, n).alias(k) for k, (a, n) in at.items()))


# ---------------------------------------------------------------- YUV4MPEG


def _planes(data: bytes):
    line, _, rest = data.partition(b"\n")
    tags = {t[:1]: t[1:] for t in line.decode("latin-1").split(" ")[1:] if t}
    if not line.startswith(b"YUV4MPEG2"):
        return
    w, h, chroma = int(tags["W"]), int(tags["H"]), tags.get("C", "420jpeg")
    half = chroma.startswith("420")
    deep = 2 if "p" in chroma and chroma.split("p")[-1].isdigit() else 1
    sizes = [(w, h)] + [((w + 1) // 2, (h + 1) // 2) if half else (w, h)] * 2
    at, n = 0, 0
    while at < len(rest):
        end = rest.find(b"\n", at)
        if end < 0 or not rest.startswith(b"FRAME", at):
            return
        at = end + 1
        for p, (pw, ph) in enumerate(sizes):
            yield n, p, pw, ph, deep, rest[at : at + pw * ph * deep]
            at += pw * ph * deep
        n += 1


def yuv_planes(files: DataFrame, make=None) -> DataFrame:
    """(file, frame, plane, width, height, depth, payload): raw planes, one row each."""
    return _flat(files, _planes, "file string, frame long, plane int, width int, height int, depth int, payload binary", make)


def write_yuv(pixels: DataFrame, width: int, height: int, planes: int = 3, rate: str = "25:1") -> DataFrame:
    """(file, content): pixels (file, frame, plane, y, x, v) as YUV4MPEG files of full-size planes; missing pixels are 0.

    Frames are put together first, each on its own; a file is then the join of its frames, in order.
    """
    place = (F.col("plane") * height + F.col("y")) * width + F.col("x")
    rows = pixels.groupBy("file", "frame").agg(F.collect_list(F.struct(place.cast("int").alias("at"), F.col("v").cast("int").alias("v"))).alias("px"))

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                frame = np.zeros(planes * width * height, np.uint8)
                px = batch.column("px")[k].values
                frame[px.field("at").to_numpy()] = px.field("v").to_numpy()
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in ("file", "frame")), pa.array([(b"FRAME\n" + frame.tobytes()).hex()])], ["file", "frame", "hex"])

    frames = rows.mapInArrow(run, "file string, frame long, hex string")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frame", "hex"))), lambda f: f["hex"]), "")
    head = f"YUV4MPEG2 W{width} H{height} F{rate} Ip C{'444' if planes == 3 else 'mono'}\n".encode().hex()
    return frames.groupBy("file").agg(F.unhex(F.concat(F.lit(head), body)).alias("content"))


# ---------------------------------------------------------------- Ogg pages


def build_pages(packets: list[tuple[bytes, int]], serial: int = 1, fill: int = 4096) -> bytes:
    """Pages of packets (payload, granule): a page is flushed when its payload passes ``fill`` or 255 segments."""
    out, laces, body, granule, number, cont = [], [], b"", -1, 0, False

    def flush(first: bool, last: bool, carry: bool):
        nonlocal laces, body, granule, number, cont
        kind = (1 if cont else 0) | (2 if first else 0) | (4 if last else 0)
        head = b"OggS\0" + bytes([kind]) + (granule & (2**64 - 1)).to_bytes(8, "little") + serial.to_bytes(4, "little") + number.to_bytes(4, "little")
        raw = head + b"\0\0\0\0" + bytes([len(laces)]) + bytes(laces) + body
        crc = page_crc_bytes(raw)
        out.append(raw[:22] + crc.to_bytes(4, "little") + raw[26:])
        laces, body, granule, number, cont = [], b"", -1, number + 1, carry

    for k, (payload, pos) in enumerate(packets):
        at = 0
        while True:
            size = min(255, len(payload) - at)
            laces.append(size)
            body += payload[at : at + size]
            at += size
            done = size < 255
            if done:
                granule = pos
            if len(laces) == 255 or done and len(body) >= fill and k < len(packets) - 1:
                flush(number == 0, False, not done)
            if done:
                break
    if laces or not out:
        flush(number == 0, True, False)
    return b"".join(out)


def _pages(data: bytes):
    at = seq = 0
    while True:
        found = data.find(b"OggS", at)
        if found < 0:
            if at < len(data):
                yield seq, at, None, None, None, None, None, None, "no page"
            return
        if found > at:
            yield seq, at, None, None, None, None, None, None, "skipped"
        n = data[found + 26] if found + 27 <= len(data) else 0
        laces = data[found + 27 : found + 27 + n]
        size = 27 + n + sum(laces)
        page = data[found : found + size]
        if len(page) < size or len(page) < 27 or page_crc_bytes(page[:22] + b"\0\0\0\0" + page[26:]) != int.from_bytes(page[22:26], "little"):
            yield seq, found, None, None, None, None, None, None, "damaged"
            at = found + 4
            continue
        yield seq, found, page[5], int.from_bytes(page[6:14], "little", signed=True), int.from_bytes(page[14:18], "little"), int.from_bytes(page[18:22], "little"), list(laces), page[27 + n :], None
        at, seq = found + size, seq + 1


def ogg_pages(files: DataFrame, make=None) -> DataFrame:
    """Pages with a right checksum; damaged or skipped bytes are rows with ``bad``, and reading goes on at the next page."""
    return _flat(files, _pages, "file string, seq long, pos long, flags int, granule long, serial long, page_no long, laces array<int>, body binary, bad string", make).withColumn(
        "n_packets", F.size(F.filter("laces", lambda x: x < 255))
    )


def _fragments() -> Column:
    """The packets' parts in a page: array of (at, size, done); a part is done at a segment under 255 bytes."""
    none = "cast(array() as array<struct<at:int,size:int,done:boolean>>)"
    part = lambda acc, size, done: F.array(F.struct(acc["at"].alias("at"), size.alias("size"), F.lit(done).alias("done")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.expr(none).alias("out"))

    def step(acc, lace):
        size = acc["size"] + lace
        ends = lace < 255
        return F.struct(
            F.when(ends, acc["at"] + size).otherwise(acc["at"]).alias("at"), F.when(ends, 0).otherwise(size).alias("size"),
            F.when(ends, F.concat(acc["out"], part(acc, size, True))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate("laces", start, step, lambda acc: F.when(acc["size"] > 0, F.concat(acc["out"], part(acc, acc["size"], False))).otherwise(acc["out"]))


def ogg_packets(pages: DataFrame) -> DataFrame:
    """(file, serial, packet, size, granule, hole, payload): packets put together from the parts in good pages.

    A packet ends at a segment under 255 bytes; a missing page number before any of its
    parts marks a hole.
    """
    order = Window.partitionBy("file", "serial").orderBy("page_no")
    good = pages.where("bad is null").withColumn("lost", F.coalesce(F.col("page_no") - F.lag("page_no").over(order) > 1, F.lit(False)))
    cut = good.withColumn("parts", F.transform(_fragments(), lambda p: F.struct(p["size"].alias("size"), p["done"].alias("done"), F.substring(F.col("body"), p["at"] + 1, p["size"]).alias("bytes"))))
    rows = cut.select("file", "serial", "page_no", "granule", "lost", F.posexplode("parts").alias("k", "p"))
    before = Window.partitionBy("file", "serial").orderBy("page_no", "k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("packet", F.coalesce(F.sum(F.col("p.done").cast("int")).over(before), F.lit(0)))
    joined = F.transform(F.sort_array(F.collect_list(F.struct("page_no", "k", F.hex("p.bytes").alias("h")))), lambda x: x["h"])
    ended = rows.groupBy("file", "serial", "packet").agg(
        F.sum("p.size").cast("long").alias("size"), F.max("granule").alias("granule"), F.max(F.col("lost") & (F.col("k") == 0)).alias("hole"),
        F.unhex(F.array_join(joined, "")).alias("payload"), F.max("p.done").alias("done"),
    )
    return ended.where("done").drop("done")


def picture_header(head: Column) -> Column:
    """Struct (temporal, kind, vbv_delay) of the bytes behind a picture start code."""
    word = field(head, 0, 4)
    return F.struct(bits(word, 0, 10, 32).alias("temporal"), picture_kind(head).alias("kind"), bits(word, 13, 16, 32).alias("vbv_delay"))


def write_pages(packets: DataFrame, fill: int = 4096) -> DataFrame:
    """(file, content): packets (file, seq, granule, payload) of each stream as pages; a group is one stream."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "content": [build_pages([(bytes(p), int(g)) for p, g in zip(pdf["payload"], pdf["granule"])], fill=fill)]})

    return packets.groupBy("file").applyInPandas(run, "file string, content binary")
