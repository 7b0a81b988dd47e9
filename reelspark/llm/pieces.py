"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text, with one space put before it, is cut into units: a run of spaces with the run of
other characters behind it. No piece of the vocabulary reaches from a character into a
following space (``load`` checks this), so the lattice of a text is a chain of its units' lattices. For each
distinct unit of a batch the forward sums over all segmentations are computed once
(in logarithms, all units side by side); then every occurrence draws its pieces from
the end backwards. A unit of more than ``LONG_BYTES`` has one lattice too, walked byte by byte in
windows: the forward pass keeps only the sums before each window's start, and the backward pass
works a window out again when it gets there, so memory is bounded by a window and time is
in proportion to the length. The draws hash (seed, row key, number of the unit in the text, step),
so a row's segmentation is the same in any batch, partition or run.

A piece's weight is its rank's: p ~ 1 / (rank + SHIFT), to the power ``alpha`` (0: all
segmentations alike; large: few long pieces). Characters without a piece are written as
byte pieces, one for each byte, and so is a literal U+2581, which would else decode to a
space.

Defined results: null and empty texts have no pieces and decode to the empty text; a null
row key counts as 0; rows may repeat (equal key and text give equal pieces). Only the
key and text columns are read. The vocabulary's path is a parameter, read by the
driver; executors get the pieces with the task.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, span_hashes, text_buffer

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHIFT = 50.0
ALPHA = 0.7
SEED = 20_240_101
LONG_BYTES = 512  # units beyond this are walked on their own
WINDOW = 1 << 15  # bytes of a long unit whose lattice is in memory at once
LATTICE_BYTES = 1 << 19  # text whose lattices are in memory at once
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD1B54A32D192ED03


@dataclass
class Vocabulary:
    """Pieces as bytes (a space for U+2581), the id of each byte piece, and log-weights by id."""

    pieces: list[bytes]
    normal: np.ndarray  # whether an id is an ordinary piece
    byte_ids: np.ndarray
    log_weight: np.ndarray

    def __post_init__(self):
        self.length = np.array([len(p) for p in self.pieces])
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.joined = np.frombuffer(b"".join(self.pieces), np.uint8)
        self._trie = None

    def __getstate__(self):
        return {"pieces": self.pieces, "normal": self.normal, "byte_ids": self.byte_ids, "log_weight": self.log_weight}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    @property
    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """next[node, byte] (0: none; node 0 is no node, 1 the root), id[node] or -1, covered code points."""
        if self._trie is None:
            children: list[dict[int, int]] = [{}, {}]
            ids = [-1, -1]
            chars = []
            for i in np.flatnonzero(self.normal).tolist():
                node = 1
                for b in self.pieces[i]:
                    nxt = children[node].get(b)
                    if nxt is None:
                        nxt = children[node][b] = len(children)
                        children.append({})
                        ids.append(-1)
                    node = nxt
                ids[node] = i
                text = self.pieces[i].decode()
                if len(text) == 1:
                    chars.append(ord(text))
            table = np.zeros((len(children), 256), np.int32)
            for node, own in enumerate(children):
                for b, nxt in own.items():
                    table[node, b] = nxt
            self._trie = table, np.array(ids, np.int32), np.array(sorted(chars))
        return self._trie


def load(model: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    pieces, normal, byte_ids = [], np.zeros(n, bool), np.full(256, -1, np.int32)
    for i in range(n):
        name = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(name[1:-1], 16)
            byte_ids[value] = i
            pieces.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(b"")
        else:
            plain = name.replace("▁", " ")
            if " " in plain.lstrip(" ") and plain.strip(" "):
                raise ValueError(f"piece {name!r} reaches into a space, so texts can't be cut into units")
            pieces.append(plain.encode())
            normal[i] = True
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary has no byte pieces, so not every text could be encoded")
    weight = np.where(normal, -np.log(np.cumsum(normal) + SHIFT), 0.0)
    return Vocabulary(pieces, normal, byte_ids, weight)


def _units(buf: np.ndarray, starts: np.ndarray, vocabulary: Vocabulary):
    """Unit starts, and for each byte whether it must be a byte piece. ``starts``: where texts begin."""
    _, _, covered = vocabulary.trie
    lead = (buf & 0xC0) != 0x80
    code = buf.astype(np.uint32)
    pad = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.uint32)
    for least, size, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        at = np.flatnonzero(buf >= least)
        value = pad[at] & mask
        for k in range(1, size):
            value = (value << 6) | (pad[at + k] & 0x3F)
        code[at] = value
    plain = np.zeros(128, bool)
    plain[covered[covered < 128]] = True
    forced = np.zeros(len(buf), bool)
    small = buf < 128
    forced[small] = ~plain[buf[small]]
    wide = np.flatnonzero(lead & ~small)
    odd = wide[~np.isin(code[wide], covered)]
    for k, least in ((0, 0xC0), (1, 0xC0), (2, 0xE0), (3, 0xF0)):
        forced[(odd if k == 0 else odd[buf[odd] >= least]) + k] = True
    space = buf == 32
    first = np.zeros(len(buf) + 1, bool)
    first[1:-1] = space[1:] & ~space[:-1]
    first[:-1] |= forced
    first[1:] |= forced
    first[starts] = True
    return np.flatnonzero(first[:-1]), forced


def _lattice(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, forced: np.ndarray, vocabulary: Vocabulary, alpha: float):
    """Forward filtering of distinct units.

    Returns for every lattice node (a byte boundary of a unit, numbered unit by unit) its
    range of incoming edges, and for every edge its first node, piece and the cumulative
    probability among the node's edges.
    """
    table, ids, _ = vocabulary.trie
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    n_nodes = int(base[-1])
    unit = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    byte_at = starts[unit] + offset
    left = sizes[unit] - offset
    origin = base[unit] + offset
    tails, heads, pieces = [], [], []
    single = forced[byte_at]
    tails.append(origin[single])
    heads.append(origin[single] + 1)
    pieces.append(vocabulary.byte_ids[buf[byte_at[single]]])
    live = np.flatnonzero(~single)
    node = np.ones(len(live), np.int32)
    step = 0
    while len(live):
        node = table[node, buf[byte_at[live] + step]]
        step += 1
        found = ids[node]
        hit = found >= 0
        tails.append(origin[live[hit]])
        heads.append(origin[live[hit]] + step)
        pieces.append(found[hit])
        on = (node > 0) & (left[live] > step)
        live, node = live[on], node[on]
    tail, head, piece = np.concatenate(tails), np.concatenate(heads), np.concatenate(pieces)
    depth = head - base[np.searchsorted(base, head, "right") - 1]
    order = np.lexsort((tail, head, depth))
    tail, head, piece, depth = tail[order], head[order], piece[order], depth[order]
    weight = vocabulary.log_weight[piece] * alpha
    total = np.full(n_nodes, -np.inf)
    total[base[:-1]] = 0.0
    cdf = np.zeros(len(tail))
    first = np.zeros(n_nodes, np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(head) else np.zeros(0, np.int64)
    first[head[fresh]] = fresh
    levels = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2 if len(depth) else 1))
    marks = np.searchsorted(fresh, levels)
    for a, b, p, q in zip(levels[:-1], levels[1:], marks[:-1], marks[1:]):
        if a == b:
            continue
        cut = fresh[p:q] - a
        v = total[tail[a:b]] + weight[a:b]
        count = np.diff(np.concatenate([cut, [b - a]]))
        top = np.maximum.reduceat(v, cut)
        with np.errstate(invalid="ignore"):
            e = np.exp(v - np.repeat(np.where(np.isfinite(top), top, 0.0), count))
        mass = np.add.reduceat(e, cut)
        with np.errstate(divide="ignore"):
            total[head[a + cut]] = top + np.log(mass)
        run = np.cumsum(e)
        before = run[cut] - e[cut]
        with np.errstate(divide="ignore", invalid="ignore"):
            c = (run - np.repeat(before, count)) / np.repeat(mass, count)
        c[np.concatenate([cut[1:] - 1, [b - a - 1]])] = 2.0  # the last edge takes what rounding leaves
        cdf[a:b] = c
    return base, first, tail, piece, cdf


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    return (mix(key + np.uint64((step + 1) * _STEP % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class LongUnit:
    """The lattice of one long unit, forward in windows and backward from their kept starts.

    Bytes of a long unit are never forced: those are units of their own.
    """

    def __init__(self, data: np.ndarray, vocabulary: Vocabulary, alpha: float):
        self.data, self.vocabulary, self.alpha = data, vocabulary, alpha
        self.reach = int(vocabulary.length.max())
        self.kept = {0: [0.0]}  # window start -> forward sums of the last ``reach`` nodes up to it
        sums = [0.0]
        for a in range(0, len(data), WINDOW):
            sums = self._walk(a, sums)[0]
            self.kept[a + WINDOW] = sums = sums[-self.reach :]

    def _walk(self, a: int, sums: list[float]):
        """Forward sums after ``sums`` (they end at node ``a``) up to the window's end, and its nodes' edges."""
        b = min(a + WINDOW, len(self.data))
        low = a + 1 - len(sums)  # the first node that a piece may start from
        table, ids, _ = self.vocabulary.trie
        view = self.data[low:b]
        edges: list[list[tuple[int, int]]] = [[] for _ in range(b - a)]
        live, node, step = np.arange(len(view)), np.ones(len(view), np.int32), 0
        while len(live):
            node = table[node, view[live + step]]
            step += 1
            found = ids[node]
            hit = (found >= 0) & (live + step > a - low)
            for tail, piece in zip((live[hit] + low).tolist(), found[hit].tolist()):
                edges[tail + step - a - 1].append((tail, piece))
            on = (node > 0) & (live + step < len(view))
            live, node = live[on], node[on]
        weight = self.vocabulary.log_weight
        sums = list(sums)
        for own in edges:
            own.sort()
            v = [sums[tail - low] + weight[piece] * self.alpha for tail, piece in own]
            top = max(v, default=-math.inf)
            sums.append(top + math.log(sum(math.exp(x - top) for x in v)) if top > -math.inf else -math.inf)
        return sums, edges, low

    def sample(self, key: int) -> list[int]:
        """Pieces from the end backwards, drawn as those of short units are."""
        node, step, out = len(self.data), 0, []
        weight = self.vocabulary.log_weight
        keys = np.array([key], np.uint64)
        for a in range((len(self.data) - 1) // WINDOW * WINDOW, -1, -WINDOW):
            sums, edges, low = self._walk(a, self.kept[a])
            while node > a:
                own = edges[node - a - 1]
                goal, run, pick = float(_uniform(keys, step)[0]), 0.0, own[-1]
                for tail, piece in own:
                    run += math.exp(sums[tail - low] + weight[piece] * self.alpha - sums[node - low])
                    if goal < run:
                        pick = (tail, piece)
                        break
                out.append(pick[1])
                node = pick[0]
                step += 1
        return out


def sample_slice(buf: np.ndarray, offsets: np.ndarray, keys: np.ndarray, vocabulary: Vocabulary, alpha: float, seed: int):
    """Piece ids of all texts of a slice, and offsets into them by text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    full = sizes > 0
    # a space before each text that isn't empty
    shift = np.cumsum(full)
    spaced = np.full(len(buf) + int(full.sum()), 32, np.uint8)
    spaced[np.arange(len(buf)) + np.repeat(shift, sizes)] = buf
    begin = offsets[:-1] + shift - full
    at, forced = _units(spaced, begin[full], vocabulary)
    size = np.diff(np.concatenate([at, [len(spaced)]]))
    text = np.searchsorted(begin[full], at, "right") - 1
    text = np.flatnonzero(full)[text] if len(text) else text
    nth = np.arange(len(at)) - np.searchsorted(at, begin)[text] if len(at) else at
    row = mix(mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed)) + _GOLD)
    key = mix(row[text] ^ (nth.astype(np.uint64) * _GOLD))
    short = np.flatnonzero(size <= LONG_BYTES)
    steps = _sample_short(spaced, at[short], size[short], forced, key[short], vocabulary, alpha)
    steps = [(short[who], ids) for who, ids in steps]
    own = {}
    for i in np.flatnonzero(size > LONG_BYTES).tolist():
        own[i] = np.array(LongUnit(spaced[at[i] : at[i] + size[i]], vocabulary, alpha).sample(int(key[i])), np.int32)
    counts = np.zeros(len(at), np.int64)
    for who, _ in steps:
        counts[who] += 1
    for i, ids in own.items():
        counts[i] = len(ids)
    end = np.cumsum(counts)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.int32)
    for k, (who, ids) in enumerate(steps):
        out[end[who] - 1 - k] = ids
    for i, ids in own.items():
        out[end[i] - len(ids) : end[i]] = ids[::-1]
    per_text = np.bincount(text, counts, n).astype(np.int64) if len(at) else np.zeros(n, np.int64)
    return out, np.concatenate([[0], np.cumsum(per_text)])


def _sample_short(spaced, at, size, forced, key, vocabulary: Vocabulary, alpha: float):
    """Draws of units side by side: for each step back from the end, the units that made it and their pieces."""
    hashes = mix(span_hashes(spaced, at, at + size) + forced[at] * _GOLD)
    _, some, unit = np.unique(hashes, return_index=True, return_inverse=True)
    base, first, tail, piece, cdf = _lattice(spaced, at[some], size[some], forced, vocabulary, alpha)
    node = base[unit + 1] - 1
    goal = base[unit]
    live = np.arange(len(at))
    steps = []
    step = 0
    while len(live):
        u = _uniform(key[live], step)
        edge = first[node[live]]
        late = np.flatnonzero(u >= cdf[edge])
        while len(late):
            edge[late] += 1
            late = late[u[late] >= cdf[edge[late]]]
        steps.append((live, piece[edge]))
        node[live] = tail[edge]
        live = live[node[live] > goal[live]]
        step += 1
    return steps


def decode_ids(ids: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> list[bytes]:
    """The texts of runs of ids: pieces' bytes joined, without the space put before each."""
    length = vocabulary.length[ids]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    source = np.repeat(vocabulary.start[ids] - (ends - length), length) + np.arange(total)
    raw = vocabulary.joined[source].tobytes()
    bounds = np.concatenate([[0], ends])[offsets].tolist()
    return [raw[a + 1 : b] if b > a else b"" for a, b in zip(bounds[:-1], bounds[1:])]


def _encode(vocabulary: Vocabulary, alpha: float, seed: int):
    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices(off, LATTICE_BYTES):
                ids, at = sample_slice(buf[off[a] : off[b]], off[a : b + 1] - off[a], keys[a:b], vocabulary, alpha, seed)
                values = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), values], ["doc_id", "text", "ids"])

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, text, ids (array of int): a sampled segmentation of every whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(vocabulary, alpha, seed), "doc_id long, text string, ids array<int>")


def _decode(vocabulary: Vocabulary):
    def run(batches):
        for batch in batches:
            column = batch.column(1)
            at = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decode_ids(values, at - at[0], vocabulary), pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, text of rows with ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(vocabulary), "doc_id long, text string")


def _round_trip(vocabulary: Vocabulary, alpha: float, seed: int):
    def run(batches):
        for batch in _encode(vocabulary, alpha, seed)(batches):
            at = batch.column(2).offsets.to_numpy()
            texts = decode_ids(batch.column(2).values.to_numpy(), at, vocabulary)
            buf, off = text_buffer(batch.column(1))
            same = [t == buf[a:b].tobytes() for t, a, b in zip(texts, off[:-1], off[1:])]
            digest = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at).astype(np.int64)), batch.column(2), pa.array(digest), pa.array(same)], ["doc_id", "n_pieces", "ids", "decoded_sha256", "lossless"]
            )

    return run


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids, decoded_sha256, lossless: encoding, decoded again from the ids in the same task."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_round_trip(vocabulary, alpha, seed), "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string, lossless boolean")
