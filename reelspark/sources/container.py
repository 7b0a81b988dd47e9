"""The packetised movie container: one row for a file's headers, one for each packet.

Records are big-endian and follow each other without gaps, so a file is read by one task,
front to back, a megabyte at a time; many files are many tasks. ``movie`` is a Spark data source for batch
reading, streaming of growing folders, and writing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

MOVIE = struct.Struct(">IIBBBIHI")
VIDEO = struct.Struct(">HHIHBBBB")
AUDIO = struct.Struct(">IIB")
AUDIO_STREAM = struct.Struct(">BII")
HEAD, FULL, COMPACT = struct.Struct(">IB"), struct.Struct(">IB"), struct.Struct(">H")
#: fixed values: magic numbers, version, packet types from 1, and flags
MOVIE_MAGIC, PACKET_MAGIC, VERSION = 0x6C774D56, 0x6C77504B, 2
TYPES = ("video_params", "video_inline", "video_sync", "audio_params", "audio_frame", "audio_sync")
ESCAPED, CHECKSUM, IS_COMPACT = 0x80, 0x40, 0x20
NONE = 1  # stream types up to this have no stream

GATHER_ROWS = 10_000
HEADERS_BYTES = MOVIE.size + VIDEO.size + AUDIO.size + 255 * AUDIO_STREAM.size  # headers are never longer
READ_BYTES = 1 << 20
PACKETS = "file string, seq long, offset long, ptype string, flags int, stream int, size long, payload binary, bad string"
HEADERS = """file string, video_type int, audio_type int, largest_packet long, readahead long, width int, height int, rate_num long, rate_den int,
    rw_frames int, wo_frames int, frame_format int, layout int, sample_rate long, audio_readahead long, audio array<struct<layout:int,meta_id:string>>"""


def _text_id(a: int, b: int) -> str:
    """Eight characters held little-endian in two numbers."""
    return (a.to_bytes(4, "little") + b.to_bytes(4, "little")).rstrip(b"\0").decode("latin-1")


def _id_words(text: str) -> tuple[int, int]:
    raw = text.encode("latin-1")[:8].ljust(8, b"\0")
    return int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:], "little")


def parse_headers(data: bytes) -> tuple[dict | None, int]:
    """A file's headers and where its packets start; None if the magic or version is wrong."""
    if len(data) < MOVIE.size:
        return None, 0
    magic, version, mark, vtype, atype, largest, _, readahead = MOVIE.unpack_from(data)
    if magic != MOVIE_MAGIC or version != VERSION or mark != 0xFF:
        return None, 0
    at = MOVIE.size
    out = {"video_type": vtype, "audio_type": atype, "largest_packet": largest, "readahead": readahead}
    if vtype > NONE:
        keys = ("width", "height", "rate_num", "rate_den", "rw_frames", "wo_frames", "frame_format", "layout")
        out |= dict(zip(keys, VIDEO.unpack_from(data, at)))
        at += VIDEO.size
    if atype > NONE:
        rate, ahead, n = AUDIO.unpack_from(data, at)
        at += AUDIO.size
        streams = []
        for _ in range(n):
            layout, a, b = AUDIO_STREAM.unpack_from(data, at)
            streams.append({"layout": layout, "meta_id": _text_id(a, b)})
            at += AUDIO_STREAM.size
        out |= {"sample_rate": rate, "audio_readahead": ahead, "audio": streams}
    return out, at


def parse_packets(data: bytes, at: int) -> Iterator[tuple]:
    """(seq, offset, ptype, flags, stream, size, payload, bad); the first bad record ends a file."""
    seq = 0
    while at < len(data):
        start = at
        if at + HEAD.size > len(data):
            yield seq, start, None, None, None, None, None, "cut header"
            return
        magic, kind = HEAD.unpack_from(data, at)
        at += HEAD.size
        number, flags = kind & 0x1F, kind & 0xE0
        if magic != PACKET_MAGIC or not 1 <= number <= len(TYPES):
            yield seq, start, None, None, None, None, None, "bad magic or type"
            return
        tail = COMPACT if flags & IS_COMPACT else FULL
        if at + tail.size > len(data):
            yield seq, start, None, None, None, None, None, "cut header"
            return
        if flags & IS_COMPACT:
            (word,) = COMPACT.unpack_from(data, at)
            size, stream, bad = word >> 1, 0, not word & 1 or not word & 0xFFFE
        else:
            size, stream = FULL.unpack_from(data, at)
            bad = size == 0
        at += tail.size
        if bad or at + size > len(data):
            yield seq, start, TYPES[number - 1], flags, stream, size, None, "bad size" if bad else "cut payload"
            return
        yield seq, start, TYPES[number - 1], flags, stream, size, bytes(data[at : at + size]), None
        at += size
        seq += 1


class Scanner:
    """A push parser of one file: ``feed`` takes any number of bytes and returns the packets that they complete.

    What stays in memory is the packet that is still cut. ``place`` says where a scan can be taken up
    again: a scanner made with it goes on with the bytes from that offset.
    """

    def __init__(self, offset: int = 0, seq: int = 0):
        self.place = (offset, seq)
        self.held = bytearray()
        self.headers: dict | None = None
        self.in_packets, self.failed = offset > 0, False

    def feed(self, data: bytes) -> list[tuple]:
        if self.failed:
            return []
        self.held += data
        if not self.in_packets:
            try:
                self.headers, size = parse_headers(bytes(self.held[:HEADERS_BYTES]))
            except struct.error:  # still cut
                return []
            if self.headers is None:
                if len(self.held) >= MOVIE.size:
                    return self._fail("bad movie header")
                return []
            self._drop(size, 0)
            self.in_packets = True
        rows, end = [], 0
        for seq, at, *record, bad in parse_packets(self.held, 0):
            if bad and bad.startswith("cut"):
                break
            rows.append((self.place[1] + seq, self.place[0] + at, *record, bad))
            if bad:
                self.failed = True
                self.held.clear()
                return rows
            end = at + (COMPACT.size if record[1] & IS_COMPACT else FULL.size) + HEAD.size + record[3]
        self._drop(end, len(rows))
        return rows

    def end(self) -> list[tuple]:
        """What is left when the file ends: a cut record, if any."""
        if self.failed or not self.held and self.in_packets:
            return []
        if not self.in_packets:
            return self._fail("bad movie header")
        return [(self.place[1] + seq, self.place[0] + at, *record) for seq, at, *record in parse_packets(self.held, 0)]

    def _drop(self, size: int, packets: int) -> None:
        del self.held[:size]
        self.place = (self.place[0] + size, self.place[1] + packets)

    def _fail(self, why: str) -> list[tuple]:
        self.failed = True
        self.held.clear()
        return [(0, 0, None, None, None, None, None, why)]


def unescape_bytes(data: bytes) -> bytes:
    return data.replace(b"\0\0\1\xfe", b"\0\0\1")


def build_packet(ptype: str, payload: bytes, stream: int = 0, flags: int = 0, compact: bool = True) -> bytes:
    """One packet; the short header is used for stream 0 below 32768 bytes."""
    kind = TYPES.index(ptype) + 1 | flags & ~IS_COMPACT
    if compact and stream == 0 and len(payload) < 32768:
        return HEAD.pack(PACKET_MAGIC, kind | IS_COMPACT) + COMPACT.pack(len(payload) << 1 | 1) + payload
    return HEAD.pack(PACKET_MAGIC, kind) + FULL.pack(len(payload), stream) + payload


def build_headers(h: dict) -> bytes:
    out = MOVIE.pack(MOVIE_MAGIC, VERSION, 0xFF, h["video_type"], h["audio_type"], h["largest_packet"], 0, h["readahead"])
    if h["video_type"] > NONE:
        out += VIDEO.pack(*(h[k] for k in ("width", "height", "rate_num", "rate_den", "rw_frames", "wo_frames", "frame_format", "layout")))
    if h["audio_type"] > NONE:
        out += AUDIO.pack(h["sample_rate"], h["audio_readahead"], len(h["audio"]))
        for s in h["audio"]:
            out += AUDIO_STREAM.pack(s["layout"], *_id_words(s["meta_id"]))
    return out


def read_packets(files: DataFrame) -> DataFrame:
    """Packets of a table (file, content) such as ``binaryFile`` gives."""
    names = [c.split()[0] for c in PACKETS.split(", ")]

    def run(batches):
        for pdf in batches:
            held: list[tuple] = []
            for file, content in zip(pdf["file"], pdf["content"]):
                data = bytes(content)
                headers, at = parse_headers(data)
                rows = parse_packets(data, at) if headers else [(0, 0, None, None, None, None, None, "bad movie header")]
                for r in rows:
                    held.append((file, *r))
                    if len(held) == GATHER_ROWS:
                        yield pd.DataFrame(held, columns=names)
                        held = []
            yield pd.DataFrame(held, columns=names)

    return files.select("file", "content").mapInPandas(run, PACKETS)


def read_headers(files: DataFrame) -> DataFrame:
    """One row of headers for each file with a right magic and version."""
    names = [c.split()[0] for c in HEADERS.replace("\n", " ").split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["file"], pdf["content"]):
                h, _ = parse_headers(bytes(content))
                if h:
                    rows.append({"file": file} | h)
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return files.select("file", "content").mapInPandas(run, HEADERS)


def encode_movies(headers: DataFrame, packets: DataFrame) -> DataFrame:
    """(file, content): whole files, headers first, then packets by ``out``.

    Largest packet and read-ahead are aggregated before anything is written, so nothing
    is patched afterwards. A group is one file's packets.
    """
    from pyspark.sql import functions as F

    h = headers.select("file", F.to_json(F.struct("*")).alias("head"))
    rows = packets.select("file", "out", "ptype", "stream", "flags", "payload").join(h, "file")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        head = {"video_type": NONE, "audio_type": NONE, "largest_packet": int(pdf["payload"].map(len).max()), "readahead": 0} | json.loads(pdf["head"].iloc[0])
        parts = [build_headers(head)]
        for r in pdf.sort_values("out").itertuples():
            parts.append(build_packet(r.ptype, bytes(r.payload), int(r.stream), int(r.flags)))
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "content": [b"".join(parts)]})

    return rows.groupBy("file").applyInPandas(build, "file string, content binary")


# ---------------------------------------------------------------- data source


def _fs(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _list(path: str) -> list[str]:
    fs, at = _fs(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    head = path.split("://")[0] + "://" if "://" in path else ""
    return sorted(head + f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


def _rows(path: str) -> Iterator[tuple]:
    fs, at = _fs(path)
    scanner = Scanner()
    with fs.open_input_stream(at) as stream:
        while data := stream.read(READ_BYTES):
            for r in scanner.feed(data):
                yield (path, *r)
    for r in scanner.end():
        yield (path, *r)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Part(p) for p in _list(self.path)] or [_Part("")]

    def read(self, partition):
        if partition.path:
            yield from _rows(partition.path)


class _StreamReader(SimpleDataSourceStreamReader):
    """Files of a folder in name order; the offset is the last name that was read."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self):
        return {"after": ""}

    def read(self, start):
        names = [p for p in _list(self.path) if p > start["after"]]
        return iter([r for p in names for r in _rows(p)]), {"after": names[-1] if names else start["after"]}

    def readBetweenOffsets(self, start, end):
        return iter([r for p in _list(self.path) if start["after"] < p <= end["after"] for r in _rows(p)])


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Writer(DataSourceWriter):
    """Writes rows (file, content); a file becomes visible under its name only when whole."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        names = []
        for row in iterator:
            name = f"{root}/{row.file}"
            with fs.open_output_stream(f"{root}/.{row.file}.part") as out:
                out.write(bytes(row.content))
            fs.move(f"{root}/.{row.file}.part", name)
            names.append(name)
        return _Written(names)


class MovieSource(DataSource):
    """``spark.read.format("movie").load(path)``; options: path."""

    @classmethod
    def name(cls):
        return "movie"

    def schema(self):
        return PACKETS

    def reader(self, schema):
        return _Reader(self.options["path"])

    def simpleStreamReader(self, schema):
        return _StreamReader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MovieSource)


__all__ = ["MovieSource", "build_headers", "build_packet", "encode_movies", "parse_headers", "parse_packets", "read_headers", "read_packets", "register", "unescape_bytes"]
