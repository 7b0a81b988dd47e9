"""Row-internal decoders and encoders: ADPCM, codebook video chunks, clusters.

Their state lives inside a packet or a frame, so they are functions of single rows, or of
one frame sequence where a frame copies from the one before.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: fixed values of the ADPCM format: steps, and index changes by code
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
CHANGES = (8, 6, 4, 2, -1, -1, -1, -1, -1, -1, -1, -1, 2, 4, 6, 8)


def _limit(v: int, low: int, high: int) -> int:
    return low if v < low else high if v > high else v


def _cut(a: int, b: int) -> int:
    """Division that truncates towards zero."""
    return a // b if a >= 0 else -(-a // b)


def adpcm_step(pred: int, index: int, code: int) -> tuple[int, int]:
    """Predictor and step index after one 4-bit code."""
    return _limit(pred + _cut((2 * code - 15) * STEPS[index], 8), -32768, 32767), _limit(index + CHANGES[code], 0, len(STEPS) - 1)


def _first_state(head: bytes) -> tuple[int, int]:
    """Predictor and step index of the two bytes that start a channel: nine bits of the sample, seven of the index."""
    word = int.from_bytes(head, "little")
    high = word & 0xFF80
    return (high - 65536 if high >= 32768 else high | high >> 8), word & 0x7F


def adpcm_decode(packet: bytes, channels: int) -> list[int] | None:
    """Interleaved samples of a packet that starts with each channel's state; None if malformed."""
    per = len(packet) // channels
    if per < 2 or per * channels != len(packet):
        return None
    state = []
    for c in range(channels):
        pred, index = _first_state(packet[2 * c : 2 * c + 2])
        if index >= len(STEPS):
            return None
        state.append([pred, index])
    out: list[int] = []
    body = packet[2 * channels :]
    for at in range(0, len(body), channels):
        pairs = []
        for c in range(channels):
            two = []
            for code in (body[at + c] & 15, body[at + c] >> 4):
                state[c] = list(adpcm_step(*state[c], code))
                two.append(state[c][0])
            pairs.append(two)
        out += [p[0] for p in pairs] + [p[1] for p in pairs]
    return out


def adpcm_code(sample: int, pred: int, index: int) -> int:
    """The code whose reconstruction, over all sixteen, lies nearest to a sample; of equal ones the lowest."""
    return min(range(16), key=lambda code: (abs(adpcm_step(pred, index, code)[0] - sample), code))


def adpcm_encode(samples: list[int], channels: int, index: int = 0) -> bytes:
    """One packet of interleaved samples; an even number for each channel."""
    heads, codes = [], np.zeros((channels, len(samples) // channels), np.uint8)
    for c in range(channels):
        own = samples[c::channels]
        heads.append(((own[0] if own else 0) & 0xFF80 | index).to_bytes(2, "little"))
        pred, at = _first_state(heads[c])
        for k, sample in enumerate(own):
            codes[c, k] = adpcm_code(sample, pred, at)
            pred, at = adpcm_step(pred, at, int(codes[c, k]))
    return b"".join(heads) + (codes[:, 0::2] | codes[:, 1::2] << 4).T.tobytes()


#: what a code adds to the predictor and which index follows, by step index, and between which doubled differences each code is nearest
_ADDED = np.array([[_cut((2 * code - 15) * step, 8) for code in range(16)] for step in STEPS])
_NEXT = np.array([[_limit(index + change, 0, len(STEPS) - 1) for change in CHANGES] for index in range(len(STEPS))])
_SPAN = 1 << 19
_BOUNDS = (_ADDED[:, 1:] + _ADDED[:, :-1] + np.arange(len(STEPS))[:, None] * 2 * _SPAN).ravel()
_ADDED_LISTS, _NEXT_LISTS, _BOUND_LISTS = _ADDED.tolist(), _NEXT.tolist(), (_ADDED[:, 1:] + _ADDED[:, :-1]).tolist()

#: with fewer packets than this, a step of all of them at once costs more than the steps of each
ABREAST = 48


def _decode_rest(codes: bytes, pred: int, index: int) -> list[int]:
    """Samples of one packet's codes from a state on."""
    out = []
    for code in codes:
        pred += _ADDED_LISTS[index][code]
        if pred > 32767:
            pred = 32767
        elif pred < -32768:
            pred = -32768
        index = _NEXT_LISTS[index][code]
        out.append(pred)
    return out


def _encode_rest(samples: list[int], pred: int, index: int) -> bytes:
    """Codes of one packet's samples from a state on."""
    out = bytearray()
    for sample in samples:
        added = _ADDED_LISTS[index]
        if -32768 <= pred + added[0] and pred + added[15] <= 32767:
            code = bisect_left(_BOUND_LISTS[index], 2 * (sample - pred))
        else:
            code = adpcm_code(sample, pred, index)
        pred += added[code]
        if pred > 32767:
            pred = 32767
        elif pred < -32768:
            pred = -32768
        index = _NEXT_LISTS[index][code]
        out.append(code)
    return bytes(out)


def _lanes(size: np.ndarray) -> list[int]:
    """How many packets of falling sizes are still at work at each step, as long as a step of all at once pays."""
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), "right")
    return live[: int(np.searchsorted(-live, -ABREAST, "right"))].tolist()


def adpcm_decode_many(packets: list[bytes]) -> list[np.ndarray | None]:
    """``adpcm_decode`` of many one-channel packets side by side: each step advances all that still have codes.

    What the last few packets have left is decoded one packet at a time.
    """
    out: list[np.ndarray | None] = [None] * len(packets)
    good = [k for k, p in enumerate(packets) if len(p) >= 2 and p[0] & 0x7F < len(STEPS)]
    good.sort(key=lambda k: -len(packets[k]))
    if not good:
        return out
    words = np.array([int.from_bytes(packets[k][:2], "little") for k in good])
    index, pred = words & 0x7F, words & 0xFF80
    pred = np.where(pred >= 32768, pred - 65536, pred | pred >> 8)
    size = np.array([2 * (len(packets[k]) - 2) for k in good])
    start = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(b"".join(packets[k][2:] for k in good), np.uint8)
    codes = np.empty(2 * len(raw), np.uint8)
    codes[0::2], codes[1::2] = raw & 15, raw >> 4
    samples = np.empty(len(codes), np.int16)
    live = _lanes(size)
    for t, n in enumerate(live):
        at = start[:n] + t
        move = index[:n] * 16 + codes[at]
        pred[:n] = np.minimum(np.maximum(pred[:n] + _ADDED.ravel()[move], -32768), 32767)
        index[:n] = _NEXT.ravel()[move]
        samples[at] = pred[:n]
    done = len(live)
    for j in range(int(np.searchsorted(-size, -done, "left"))):
        samples[start[j] + done : start[j + 1]] = _decode_rest(codes[start[j] + done : start[j + 1]].tobytes(), int(pred[j]), int(index[j]))
    for k, a, b in zip(good, start[:-1], start[1:]):
        out[k] = samples[a:b]
    return out


def _nearest_codes(sample: np.ndarray, pred: np.ndarray, index: np.ndarray) -> np.ndarray:
    """``adpcm_code`` of many samples: a search among the midpoints of a state's reconstructions.

    Beyond the range of samples reconstructions are cut to it, so there a neighbour may be nearer.
    """
    code = np.searchsorted(_BOUNDS, 2 * (sample - pred) + index * 2 * _SPAN) - 15 * index
    edge = np.flatnonzero((pred + _ADDED[index, 15] > 32767) | (pred + _ADDED[index, 0] < -32768))
    if len(edge):
        back = np.clip(pred[edge, None] + _ADDED[index[edge]], -32768, 32767)
        code[edge] = np.abs(back - sample[edge, None]).argmin(axis=1)
    return code


def adpcm_encode_many(packets: list[np.ndarray], index: int = 0) -> list[bytes]:
    """``adpcm_encode`` of many one-channel packets of an even number of samples, side by side.

    What the last few packets have left is encoded one packet at a time.
    """
    order = sorted(range(len(packets)), key=lambda k: -len(packets[k]))
    if not order:
        return []
    size = np.array([len(packets[k]) for k in order])
    start = np.concatenate([[0], np.cumsum(size)])
    samples = np.concatenate([np.asarray(packets[k], np.int16) for k in order])
    heads = [((int(packets[k][0]) if len(packets[k]) else 0) & 0xFF80 | index).to_bytes(2, "little") for k in order]
    pred, at_step = (np.array(v) for v in zip(*map(_first_state, heads)))
    codes = np.empty(len(samples), np.uint8)
    live = _lanes(size)
    for t, n in enumerate(live):
        at = start[:n] + t
        code = _nearest_codes(samples[at].astype(np.int64), pred[:n], at_step[:n])
        codes[at] = code
        move = at_step[:n] * 16 + code
        pred[:n] = np.minimum(np.maximum(pred[:n] + _ADDED.ravel()[move], -32768), 32767)
        at_step[:n] = _NEXT.ravel()[move]
    done = len(live)
    for j in range(int(np.searchsorted(-size, -done, "left"))):
        rest = _encode_rest(samples[start[j] + done : start[j + 1]].tolist(), int(pred[j]), int(at_step[j]))
        codes[start[j] + done : start[j + 1]] = np.frombuffer(rest, np.uint8)
    body = codes[0::2] | codes[1::2] << 4
    out = [b""] * len(packets)
    for k, head, a, b in zip(order, heads, start[:-1] // 2, start[1:] // 2):
        out[k] = head + body[a:b].tobytes()
    return out


# ---------------------------------------------------------------- codebook video

#: fixed values: chunk markers of the codebook video format, and its block codes
INFO, CODEBOOK, VIDEO = 0x1001, 0x1002, 0x1011
SKIP, MOTION, VECTOR, QUAD = 0, 1, 2, 3


def chunks(data: bytes) -> list[tuple[int, int, bytes]] | None:
    """(marker, argument, payload) of little-endian chunks; None if one overruns."""
    out, at = [], 0
    while at < len(data):
        if at + 8 > len(data):
            return None
        marker, size, arg = (int.from_bytes(data[at + a : at + b], "little") for a, b in ((0, 2), (2, 6), (6, 8)))
        if at + 8 + size > len(data):
            return None
        out.append((marker, arg, data[at + 8 : at + 8 + size]))
        at += 8 + size
    return out


def chunk(marker: int, arg: int, payload: bytes) -> bytes:
    return marker.to_bytes(2, "little") + len(payload).to_bytes(4, "little") + arg.to_bytes(2, "little") + payload


def codebooks(arg: int, payload: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """Cells of six values and entries of four cell numbers; None if the size is wrong."""
    n2 = arg >> 8 & 255 or 256
    n4 = arg & 255
    if not n4 and n2 * 6 < len(payload):
        n4 = 256
    if len(payload) != n2 * 6 + n4 * 4:
        return None
    raw = np.frombuffer(payload, np.uint8)
    return raw[: n2 * 6].reshape(n2, 6), raw[n2 * 6 :].reshape(n4, 4)


class _Codes:
    """Two-bit codes in 16-bit little-endian words, spooled from the top, between data bytes."""

    def __init__(self, data: bytes):
        self.data, self.at, self.word, self.left = data, 0, 0, 0

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise EOFError
        self.at += 1
        return self.data[self.at - 1]

    def code(self) -> int:
        if not self.left:
            low = self.byte()
            self.word, self.left = low | self.byte() << 8, 16
        self.left -= 2
        return self.word >> self.left & 3


def parse_quads(payload: bytes, arg: int, width: int, height: int) -> list[tuple]:
    """(y, x, size, op, a, b) in coding order: op is skip, motion (dx, dy), vector or cell (entry).

    A frame that ends early yields what came before.
    """
    src, out = _Codes(payload), []
    base_x, base_y = arg >> 8 & 255, arg & 255
    base_x, base_y = (v - 256 if v > 127 else v for v in (base_x, base_y))

    def square(y: int, x: int, size: int) -> bool:
        code = src.code()
        if code == SKIP:
            out.append((y, x, size, "skip", None, None))
        elif code == MOTION:
            m = src.byte()
            dx, dy = 8 - (m >> 4) - base_x, 8 - (m & 15) - base_y
            if not (0 <= x + dx <= width - size and 0 <= y + dy <= height - size):
                return False
            out.append((y, x, size, "motion", dx, dy))
        elif code == VECTOR:
            out.append((y, x, size, "vector", src.byte(), None))
        elif size == 8:
            return all(square(y + j, x + i, 4) for j in (0, 4) for i in (0, 4))
        else:
            for j, i in ((0, 0), (0, 2), (2, 0), (2, 2)):
                out.append((y + j, x + i, 2, "cell", src.byte(), None))
        return True

    try:
        for y in range(0, height, 16):
            for x in range(0, width, 16):
                for j, i in ((0, 0), (0, 8), (8, 0), (8, 8)):
                    if not square(y + j, x + i, 8):
                        return out
    except EOFError:
        pass
    return out


def build_quads(ops: list[tuple]) -> bytes:
    """The inverse for operations on 8x8 blocks in order: ('skip',), ('motion', byte), ('vector', entry), ('quad', [four operations])."""
    out, word_at, word, left = bytearray(), None, 0, 0

    def code(c: int):
        nonlocal word_at, word, left
        if not left:
            word_at, word, left = len(out), 0, 16
            out.extend(b"\0\0")
        left -= 2
        word |= c << left
        out[word_at : word_at + 2] = word.to_bytes(2, "little")

    def put(op: tuple, size: int):
        code({"skip": SKIP, "motion": MOTION, "vector": VECTOR}.get(op[0], QUAD))
        if op[0] in ("motion", "vector"):
            out.append(op[1])
        elif op[0] == "quad" and size == 8:
            for sub in op[1]:
                put(sub, 4)
        elif op[0] == "quad":
            out.extend(op[1])

    for op in ops:
        put(op, 8)
    return bytes(out)


def _draw(ops: list[tuple], cells: np.ndarray, entries: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Luma of a frame from its operations and the frame that its buffer held."""
    frame = before.copy()
    for y, x, size, op, a, b in ops:
        if op == "motion":
            frame[y : y + size, x : x + size] = before[y + b : y + b + size, x + a : x + a + size]
        elif op == "vector":
            scale = size // 4
            for k, cell in enumerate(entries[a].tolist()):
                j, i = divmod(k, 2)
                tile = np.kron(cells[cell][:4].reshape(2, 2), np.ones((scale, scale), np.uint8))
                frame[y + j * 2 * scale : y + (j + 1) * 2 * scale, x + i * 2 * scale : x + (i + 1) * 2 * scale] = tile
        elif op == "cell":
            frame[y : y + 2, x : x + 2] = cells[a][:4].reshape(2, 2)
    return frame


def encode_frame(frame: np.ndarray, cells: np.ndarray, entries: np.ndarray, before: np.ndarray, price: float = 20.0, reach: int = 7) -> bytes:
    """One frame of luma as codebook video: for each block the operation of least distortion plus ``price`` for each bit.

    An 8x8 block is skipped, moved by up to ``reach``, drawn from an entry at double size, or split;
    a 4x4 block likewise, or drawn from four cells. Chunks of the codebook and the frame are returned.
    """
    small = cells[:, :4].reshape(-1, 2, 2).astype(np.int64)
    tiles = np.stack([np.block([[small[a], small[b]], [small[c], small[d]]]) for a, b, c, d in entries.tolist()]) if len(entries) else np.zeros((0, 4, 4), np.int64)
    wide = np.kron(tiles, np.ones((1, 2, 2), np.int64))
    target, old = frame.astype(np.int64), before.astype(np.int64)
    height, width = target.shape

    def best(y: int, x: int, size: int) -> tuple[float, tuple]:
        want = target[y : y + size, x : x + size]
        miss = lambda got: float(((want - got) ** 2).sum())
        found = [(miss(old[y : y + size, x : x + size]) + 2 * price, ("skip",))]
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                if (dy or dx) and 0 <= y + dy <= height - size and 0 <= x + dx <= width - size:
                    cost = miss(old[y + dy : y + dy + size, x + dx : x + dx + size]) + 10 * price
                    if cost < found[-1][0]:
                        found.append((cost, ("motion", (8 - dx) << 4 | (8 - dy))))
        books = tiles if size == 4 else wide
        if len(books):
            costs = ((books - want) ** 2).sum(axis=(1, 2))
            k = int(costs.argmin())
            found.append((float(costs[k]) + 10 * price, ("vector", k)))
        if size == 8:
            parts = [best(y + j, x + i, 4) for j in (0, 4) for i in (0, 4)]
            found.append((sum(p[0] for p in parts) + 2 * price, ("quad", [p[1] for p in parts])))
        else:
            picks = [((small - want[j : j + 2, i : i + 2]) ** 2).sum(axis=(1, 2)) for j in (0, 2) for i in (0, 2)]
            found.append((float(sum(p.min() for p in picks)) + 34 * price, ("quad", [int(p.argmin()) for p in picks])))
        return min(found, key=lambda f: f[0])

    places = [(y + j, x + i) for y in range(0, height, 16) for x in range(0, width, 16) for j in (0, 8) for i in (0, 8)]
    books = chunk(CODEBOOK, (len(cells) & 255) << 8 | len(entries) & 255, cells.astype(np.uint8).tobytes() + entries.astype(np.uint8).tobytes())
    return books + chunk(VIDEO, 0, build_quads([best(y, x, 8)[1] for y, x in places]))


def decode_video(packets: DataFrame, width: int, height: int) -> DataFrame:
    """(file, frame, y, x, v): luma of codebook video, one file's frames in order.

    A frame may copy from the one before it, so a file is one group; frames, not files, are
    held in memory.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        front = np.zeros((height, width), np.uint8)
        cells, entries = np.zeros((256, 6), np.uint8), np.zeros((256, 4), np.uint8)
        out = []
        for n, payload in enumerate(pdf.sort_values("seq")["payload"]):
            for marker, arg, data in chunks(bytes(payload)) or []:
                if marker == CODEBOOK and (books := codebooks(arg, data)):
                    cells[: len(books[0])], entries[: len(books[1])] = books
                elif marker == VIDEO:
                    front = _draw(parse_quads(data, arg, width, height), cells, entries, front)
            y, x = np.divmod(np.arange(width * height), width)
            out.append(pd.DataFrame({"file": pdf["file"].iloc[0], "frame": n, "y": y, "x": x, "v": front.ravel().astype(int)}))
        return pd.concat(out)

    return packets.groupBy("file").applyInPandas(run, "file string, frame long, y int, x int, v int")


# ---------------------------------------------------------------- clusters


def build_cluster(granule: int, packets: list[bytes], last: bool = False) -> bytes:
    """Packets of one granule position: position, count with end mark, sizes, payloads; at most 127."""
    if not 0 < len(packets) < 128:
        raise ValueError("a cluster holds 1 to 127 packets")
    head = granule.to_bytes(8, "little") + bytes([len(packets) | (0x80 if last else 0)])
    return head + b"".join(len(p).to_bytes(4, "little") for p in packets) + b"".join(packets)


def parse_cluster(data: bytes) -> list[dict] | None:
    """Packets with granule position and end mark; None if malformed."""
    if len(data) < 9:
        return None
    n, at = data[8] & 0x7F, 9 + (data[8] & 0x7F) * 4
    if not n or len(data) < at:
        return None
    out = []
    for k in range(n):
        size = int.from_bytes(data[9 + 4 * k : 13 + 4 * k], "little")
        if at + size > len(data):
            return None
        out.append({"n": k, "granule": int.from_bytes(data[:8], "little"), "eos": bool(data[8] & 0x80) and k == n - 1, "payload": data[at : at + size]})
        at += size
    return out
