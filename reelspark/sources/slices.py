"""Slices of MPEG-1 pictures: prefix codes, macroblocks, vectors and coefficient levels.

A slice is decodable on its own, so a table of slices is parsed row by row; vectors and
DC values are predicted inside the slice only. Levels stay quantised: dequantisation
and the transform are column operators.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.blocks import zigzag

#: fixed values of the video standard: codes as bit strings
INCREMENT = dict(
    (c, k + 1) for k, c in enumerate((
        "1 011 010 0011 0010 00011 00010 0000111 0000110 00001011 00001010 00001001 00001000 00000111 00000110 0000010111 0000010110 0000010101 0000010100 "
        "0000010011 0000010010 00000100011 00000100010 00000100001 00000100000 00000011111 00000011110 00000011101 00000011100 00000011011 00000011010 00000011001 00000011000"
    ).split())
)
STUFFING, JUMP = "00000001111", "00000001000"
KINDS = {
    "I": {"1": "i", "01": "iq"},
    "P": {"1": "fp", "01": "p", "001": "f", "00011": "i", "00010": "fpq", "00001": "pq", "000001": "iq"},
    "B": {"10": "fb", "11": "fbp", "010": "b", "011": "bp", "0010": "f", "0011": "fp", "00011": "i", "00010": "fbpq", "000011": "fpq", "000010": "bpq", "000001": "iq"},
}
MOTION = dict(
    (c, k) for k, c in enumerate("1 01 001 0001 000011 0000101 0000100 0000011 000001011 000001010 000001001 0000010001 0000010000 0000001111 0000001110 0000001101 0000001100".split())
)
DC_LUMA = {"100": 0, "00": 1, "01": 2, "101": 3, "110": 4, "1110": 5, "11110": 6, "111110": 7, "1111110": 8}
DC_CHROMA = {"00": 0, "01": 1, "10": 2, "110": 3, "1110": 4, "11110": 5, "111110": 6, "1111110": 7, "11111110": 8}
#: block patterns, by code
PATTERN = {
    "000000010": 39, "000000011": 27, "000000100": 59, "000000101": 55, "000000110": 47, "000000111": 31, "00000100": 58, "00000101": 54, "00000110": 46, "00000111": 30,
    "00001000": 57, "00001001": 53, "00001010": 45, "00001011": 29, "00001100": 38, "00001101": 26, "00001110": 37, "00001111": 25, "00010000": 43, "00010001": 23,
    "00010010": 51, "00010011": 15, "00010100": 42, "00010101": 22, "00010110": 50, "00010111": 14, "00011000": 41, "00011001": 21, "00011010": 49, "00011011": 13,
    "00011100": 35, "00011101": 19, "00011110": 11, "00011111": 7, "0010000": 34, "0010001": 18, "0010010": 10, "0010011": 6, "0010100": 33, "0010101": 17, "0010110": 9,
    "0010111": 5, "001100": 63, "001101": 3, "001110": 36, "001111": 24, "01000": 62, "01001": 2, "01010": 61, "01011": 1, "01100": 56, "01101": 52, "01110": 44, "01111": 28,
    "10000": 40, "10001": 20, "10010": 48, "10011": 12, "1010": 32, "1011": 16, "1100": 8, "1101": 4, "111": 60,
}
#: (run, level) by code; None is the escape, "end" the end of a block
LEVEL: dict[str, object] = {
    "0000000000010000": (1, 18), "0000000000010001": (1, 17), "0000000000010010": (1, 16), "0000000000010011": (1, 15), "0000000000010100": (6, 3),
    "0000000000010101": (16, 2), "0000000000010110": (15, 2), "0000000000010111": (14, 2), "0000000000011000": (13, 2), "0000000000011001": (12, 2),
    "0000000000011010": (11, 2), "0000000000011011": (31, 1), "0000000000011100": (30, 1), "0000000000011101": (29, 1), "0000000000011110": (28, 1),
    "0000000000011111": (27, 1), "000000000010000": (0, 40), "000000000010001": (0, 39), "000000000010010": (0, 38), "000000000010011": (0, 37), "000000000010100": (0, 36),
    "000000000010101": (0, 35), "000000000010110": (0, 34), "000000000010111": (0, 33), "000000000011000": (0, 32), "000000000011001": (1, 14), "000000000011010": (1, 13),
    "000000000011011": (1, 12), "000000000011100": (1, 11), "000000000011101": (1, 10), "000000000011110": (1, 9), "000000000011111": (1, 8), "00000000010000": (0, 31),
    "00000000010001": (0, 30), "00000000010010": (0, 29), "00000000010011": (0, 28), "00000000010100": (0, 27), "00000000010101": (0, 26), "00000000010110": (0, 25),
    "00000000010111": (0, 24), "00000000011000": (0, 23), "00000000011001": (0, 22), "00000000011010": (0, 21), "00000000011011": (0, 20), "00000000011100": (0, 19),
    "00000000011101": (0, 18), "00000000011110": (0, 17), "00000000011111": (0, 16), "0000000010000": (10, 2), "0000000010001": (9, 2), "0000000010010": (5, 3),
    "0000000010011": (3, 4), "0000000010100": (2, 5), "0000000010101": (1, 7), "0000000010110": (1, 6), "0000000010111": (0, 15), "0000000011000": (0, 14),
    "0000000011001": (0, 13), "0000000011010": (0, 12), "0000000011011": (26, 1), "0000000011100": (25, 1), "0000000011101": (24, 1), "0000000011110": (23, 1),
    "0000000011111": (22, 1), "000000010000": (0, 11), "000000010001": (8, 2), "000000010010": (4, 3), "000000010011": (0, 10), "000000010100": (2, 4), "000000010101": (7, 2),
    "000000010110": (21, 1), "000000010111": (20, 1), "000000011000": (0, 9), "000000011001": (19, 1), "000000011010": (18, 1), "000000011011": (1, 5), "000000011100": (3, 3),
    "000000011101": (0, 8), "000000011110": (6, 2), "000000011111": (17, 1), "0000001000": (16, 1), "0000001001": (5, 2), "0000001010": (0, 7), "0000001011": (2, 3),
    "0000001100": (1, 4), "0000001101": (15, 1), "0000001110": (14, 1), "0000001111": (4, 2), "000001": None, "0000100": (2, 2), "0000101": (9, 1), "0000110": (0, 4),
    "0000111": (8, 1), "000100": (7, 1), "000101": (6, 1), "000110": (1, 2), "000111": (5, 1), "00100000": (13, 1), "00100001": (0, 6), "00100010": (12, 1),
    "00100011": (11, 1), "00100100": (3, 2), "00100101": (1, 3), "00100110": (0, 5), "00100111": (10, 1), "00101": (0, 3), "00110": (4, 1), "00111": (3, 1), "0100": (0, 2),
    "0101": (2, 1), "011": (1, 1), "10": "end", "11": (0, 1),
}
_SCAN = zigzag()


def _wide(table: dict) -> tuple[int, dict]:
    """The width of a table's longest code, and (length, value) of the code that each word of that width starts with."""
    width, found = max(map(len, table)), {}
    for code, v in table.items():
        for k in range(1 << (width - len(code))):
            found[code + format(k, "b").zfill(width - len(code)) if len(code) < width else code] = (len(code), v)
    return width, found


def _codes(table: dict) -> dict:
    return {v: c for c, v in table.items()}


_STEP, _MOTION, _PATTERN, _LEVEL, _LUMA, _CHROMA = map(_wide, (INCREMENT | {STUFFING: 0, JUMP: -33}, MOTION, PATTERN, LEVEL, DC_LUMA, DC_CHROMA))
_KINDS = {picture: _wide(table) for picture, table in KINDS.items()}
_STEP_CODES, _MOTION_CODES, _PATTERN_CODES, _LEVEL_CODES, _LUMA_CODES, _CHROMA_CODES = map(_codes, (INCREMENT, MOTION, PATTERN, LEVEL, DC_LUMA, DC_CHROMA))
_KIND_CODES = {picture: _codes(table) for picture, table in KINDS.items()}
_PLACE = [_SCAN.index(k) for k in range(64)]


class Bits:
    """Reads a payload from its top bit on."""

    def __init__(self, data: bytes):
        bits = bin(int.from_bytes(b"\1" + data, "big"))[3:]
        self.at, self.size, self.last = 0, len(bits), bits.rfind("1")
        self.text = bits + "0" * 17  # so that a whole word stands at every place

    def take(self, n: int) -> int:
        at = self.at
        if at + n > self.size:
            raise EOFError
        self.at = at + n
        return int(self.text[at : at + n], 2) if n else 0

    def code(self, wide: tuple[int, dict]):
        at = self.at
        hit = wide[1].get(self.text[at : at + wide[0]])
        if hit is None or at + hit[0] > self.size:
            raise ValueError("no such code")
        self.at = at + hit[0]
        return hit[1]

    def ended(self) -> bool:
        """Only zero bits follow: fewer than a macroblock needs."""
        return self.at > self.last


def _level(src: Bits) -> tuple[int, int] | None:
    got = src.code(_LEVEL)
    if got == "end":
        return None
    if got is not None:
        return got[0], -got[1] if src.take(1) else got[1]
    run, v = src.take(6), src.take(8)
    v = src.take(8) if v == 0 else src.take(8) - 256 if v == 128 else v - 256 if v > 128 else v
    return run, v


def _block(src: Bits, intra: bool, number: int, dc: dict[str, int]) -> list[int]:
    """Levels of a block in raster order; an intra block starts with its predicted DC."""
    out, at = [0] * 64, -1
    if intra:
        part = "y" if number < 4 else "uv"[number - 4]
        size = src.code(_LUMA if number < 4 else _CHROMA)
        if size:
            v = src.take(size)
            dc[part] += v if v >> (size - 1) else v - (1 << size) + 1
        out[0], at = dc[part], 0
    elif src.at >= src.size:
        raise IndexError("string index out of range")
    elif src.text[src.at] == "1":  # the first level of an inter block has no end code to be told from
        src.at += 1
        out[0], at = -1 if src.take(1) else 1, 0
    while True:
        pair = _level(src)
        if pair is None:
            return out
        at += pair[0] + 1
        if at >= 64:
            raise ValueError("too many coefficients")
        out[_SCAN[at]] = pair[1]


def _vector(src: Bits, f_code: int, last: int) -> int:
    step = src.code(_MOTION)
    if step:
        negative = src.take(1)
        step = ((step - 1) << (f_code - 1)) + src.take(f_code - 1) + 1
        step = -step if negative else step
    half = 16 << (f_code - 1)
    return (last + step + half) % (2 * half) - half


def parse_slice(data: bytes, kind: str, row: int, mb_width: int, forward: int = 1, backward: int = 1) -> list[dict]:
    """Macroblocks of a slice: address, kind, scale, vectors (y, x) in half pixels, pattern, six blocks.

    A slice that breaks off yields what came before, with ``bad`` on a last row. Skipped
    macroblocks are gaps in the addresses.
    """
    src, out = Bits(data), []
    address = row * mb_width - 1
    try:
        scale = src.take(5)
        while src.take(1):
            src.take(8)
        dc = dict.fromkeys(("y", "u", "v"), 128)
        vectors = {"f": [0, 0], "b": [0, 0]}
        while not src.ended():
            step, more = 0, src.code(_STEP)
            while more <= 0:  # stuffing, or a jump by 33
                step, more = step - more, src.code(_STEP)
            step += more
            address += step
            flags = src.code(_KINDS[kind])
            intra = "i" in flags
            if step > 1:
                dc = dict.fromkeys(("y", "u", "v"), 128)
                if kind == "P":
                    vectors["f"] = [0, 0]
            if "q" in flags:
                scale = src.take(5)
            for side, f_code in (("f", forward), ("b", backward)):
                if side in flags:
                    x, y = (_vector(src, f_code, vectors[side][k]) for k in (0, 1))
                    vectors[side] = [x, y]
            if intra:
                vectors = {"f": [0, 0], "b": [0, 0]}
            else:
                dc = dict.fromkeys(("y", "u", "v"), 128)
                if kind == "P" and "f" not in flags:
                    vectors["f"] = [0, 0]
            pattern = 63 if intra else src.code(_PATTERN) if "p" in flags else 0
            coded = [_block(src, intra, k, dc) if pattern >> (5 - k) & 1 else None for k in range(6)]
            move = {s: tuple(vectors[s][::-1]) if s in flags else None for s in "fb"}
            out.append({"mb_addr": address, "kind": flags, "scale": scale, "forward": move["f"], "backward": move["b"], "pattern": pattern, "blocks": coded, "bad": None})
    except (EOFError, ValueError, IndexError) as e:
        out.append({"mb_addr": address, "kind": None, "scale": None, "forward": None, "backward": None, "pattern": None, "blocks": [None] * 6, "bad": str(e) or "cut slice"})
    return out


def build_slice(blocks: list[dict], kind: str, row: int, mb_width: int, scale: int, forward: int = 1, backward: int = 1) -> bytes:
    """The inverse of ``parse_slice`` for whole macroblocks in address order."""
    text, address = format(scale, "05b") + "0", row * mb_width - 1
    dc, vectors = dict.fromkeys(("y", "u", "v"), 128), {"f": [0, 0], "b": [0, 0]}
    levels = _LEVEL_CODES
    for b in blocks:
        step = b["mb_addr"] - address
        address = b["mb_addr"]
        if step > 1:
            dc = dict.fromkeys(("y", "u", "v"), 128)
            if kind == "P":
                vectors["f"] = [0, 0]
        text += JUMP * ((step - 1) // 33) + _STEP_CODES[(step - 1) % 33 + 1] + _KIND_CODES[kind][b["kind"]]
        intra = "i" in b["kind"]
        if "q" in b["kind"]:
            text += format(b["scale"], "05b")
        for side, f_code in (("f", forward), ("b", backward)):
            if side in b["kind"]:
                half, want = 16 << (f_code - 1), b["forward" if side == "f" else "backward"][::-1]
                for k in (0, 1):
                    d = (want[k] - vectors[side][k] + half) % (2 * half) - half
                    if not d:
                        text += "1"
                        continue
                    size = abs(d) - 1
                    text += _MOTION_CODES[(size >> (f_code - 1)) + 1] + ("1" if d < 0 else "0")
                    text += format(size & ((1 << (f_code - 1)) - 1), f"0{f_code - 1}b") if f_code > 1 else ""
                vectors[side] = list(want)
        if intra:
            vectors = {"f": [0, 0], "b": [0, 0]}
        else:
            dc = dict.fromkeys(("y", "u", "v"), 128)
            if kind == "P" and "f" not in b["kind"]:
                vectors["f"] = [0, 0]
        if "p" in b["kind"]:
            text += _PATTERN_CODES[b["pattern"]]
        for k, coef in enumerate(b["blocks"]):
            if coef is None:
                continue
            first = True
            if intra:
                part = "y" if k < 4 else "uv"[k - 4]
                d = coef[0] - dc[part]
                dc[part] = coef[0]
                size = abs(d).bit_length()
                text += (_LUMA_CODES if k < 4 else _CHROMA_CODES)[size] + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else "")
                first = False
            before = int(intra)
            for at, v in sorted((_PLACE[i], v) for i, v in enumerate(coef) if v):
                if at < before:  # the DC of an intra block
                    continue
                run, before = at - before, at + 1
                if first and not run and abs(v) == 1:
                    text += "1"
                elif (run, abs(v)) in levels:
                    text += levels[run, abs(v)]
                else:
                    text += levels[None] + format(run, "06b") + (format(v & 255, "08b") if abs(v) < 128 else ("00000000" if v > 0 else "10000000") + format(v & 255, "08b"))
                    first = False
                    continue
                text += "1" if v < 0 else "0"
                first = False
            text += "10"
    text += "0" * (-len(text) % 8)
    return int("1" + text, 2).to_bytes(len(text) // 8 + 1, "big")[1:]


SCHEMA = (
    "file string, frame long, mb_addr long, kind string, scale int, forward struct<y:int,x:int>, backward struct<y:int,x:int>, pattern int, blocks array<array<int>>, bad string"
)


#: macroblocks in a batch given back
GATHER_ROWS = 4000


def macroblocks(slices: DataFrame, mb_width: int) -> DataFrame:
    """Macroblocks of slices (file, frame, picture, row, forward, backward, payload); drop what isn't wanted before this."""
    fields = to_arrow_schema(StructType.fromDDL(SCHEMA))
    names = ["picture", "row", "forward", "backward"]
    move = lambda v: v and {"y": v[0], "x": v[1]}

    def gathered(keys, found):
        columns = [*zip(*keys)]
        for f in list(fields)[2:]:
            columns.append([move(m[f.name]) for m in found] if f.name in ("forward", "backward") else [m[f.name] for m in found])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    def run(batches):
        keys, found = [], []
        for batch in batches:
            own = zip(batch.column("file").to_pylist(), batch.column("frame").to_pylist())
            for key, payload, *how in zip(own, batch.column("payload"), *(batch.column(c).to_pylist() for c in names)):
                blocks = parse_slice(payload.as_py(), how[0], how[1], mb_width, how[2], how[3])
                for at in range(0, len(blocks), GATHER_ROWS):
                    part = blocks[at : at + GATHER_ROWS]
                    keys += [key] * len(part)
                    found += part
                    if len(found) >= GATHER_ROWS:
                        yield gathered(keys, found)
                        keys, found = [], []
        if found:
            yield gathered(keys, found)

    return slices.select("file", "frame", "picture", "row", "forward", "backward", "payload").mapInArrow(run, SCHEMA)
