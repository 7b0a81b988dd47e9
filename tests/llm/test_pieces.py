"""SentencePiece sampling: exact distribution, reproducible draws, lossless decoding."""

import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from reelspark.llm import pieces
from reelspark.llm.common import text_buffer


def tiny():
    """A small vocabulary: all bytes, and some pieces with uneven weights."""
    names = [b"a", b"b", b" ", b"ab", b" a", b"aba", b"ba", "é".encode()]
    return pieces.Vocabulary([bytes([k]) for k in range(256)] + names, np.array([False] * 256 + [True] * len(names)), np.arange(256, dtype=np.int32), np.concatenate([np.zeros(256), np.log([0.2, 0.1, 0.1, 0.2, 0.1, 0.05, 0.15, 0.1])]))


def all_splits(text, vocabulary):
    ids = {vocabulary.pieces[i]: i for i in np.flatnonzero(vocabulary.normal).tolist()}

    def walk(at):
        if at == len(text):
            yield ()
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in ids:
                for rest in walk(end):
                    yield (ids[text[at:end]], *rest)

    return list(walk(0))


def test_draws_follow_the_lattice():
    """Frequencies against the enumerated distribution of every segmentation."""
    v, n = tiny(), 20_000
    buf, off = text_buffer(pa.array(["abab"] * n))
    ids, at = pieces.sample_slice(buf, off, np.arange(n), v, 1.0, 5)
    got = collections.Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(at))
    splits = all_splits(b" abab", v)
    weight = np.array([math.exp(sum(v.log_weight[i] for i in s)) for s in splits])
    weight /= weight.sum()
    assert set(got) <= set(splits)
    for s, p in zip(splits, weight):
        assert abs(got[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


@pytest.mark.parametrize("window", [3, 7, 1 << 15])
def test_long_units_draw_alike(monkeypatch, window):
    """A unit walked in windows gives the pieces that it gives beside short units, whatever the window."""
    v = tiny()
    rng = random.Random(window)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))) + "é" * (k % 3) for k in range(150)]
    buf, off = text_buffer(pa.array(texts))
    want, ends = pieces.sample_slice(buf, off, np.arange(150), v, 0.8, 6)
    monkeypatch.setattr(pieces, "LONG_BYTES", 0)
    monkeypatch.setattr(pieces, "WINDOW", window)
    got, at = pieces.sample_slice(buf, off, np.arange(150), v, 0.8, 6)
    assert at.tolist() == ends.tolist() and got.tolist() == want.tolist()


def test_long_units_are_one_lattice(monkeypatch):
    """Pieces across byte 512 of a unit are drawn as often as those elsewhere; a long unit takes bounded memory."""
    import tracemalloc

    v = tiny()
    buf, off = text_buffer(pa.array(["ab" * 400] * 300))
    ids, at = pieces.sample_slice(buf, off, np.arange(300), v, 1.0, 5)
    across = collections.Counter()
    for a, b in itertools.pairwise(at):
        ends = set(np.cumsum(v.length[ids[a:b]]).tolist())
        across.update(k for k in (510, 511, 512, 513, 514) if k not in ends)
    assert across[512] > 0.7 * max(across[510], across[514]) and across[511] > 0.7 * across[513]
    data = np.frombuffer(b"ab" * 20_000, np.uint8)
    monkeypatch.setattr(pieces, "WINDOW", 1024)
    tracemalloc.start()
    unit = pieces.LongUnit(data, v, 1.0)
    drawn = unit.sample(7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert b"".join(v.pieces[i] for i in reversed(drawn)) == data.tobytes()
    assert peak < 2 << 20


def test_a_vocabulary_whose_pieces_reach_into_spaces_is_refused(monkeypatch):
    import sentencepiece

    class Reaching(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b" if i == 1000 else super().id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Reaching)
    with pytest.raises(ValueError, match="reaches into a space"):
        pieces.load()


ODD = ["", None, " ", "  a  b ", "a\n\nb", "▁", "a▁b ▁", "日本\U0001F600", "\x00\x01", "x" * 2000, "é" * 700, "́e", "é" * 255 + "\U0001F600" * 300, "\t tab", "ab" * 40_000]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def test_round_trip_and_batches(vocabulary):
    rng = random.Random(9)
    texts = ODD + ["".join(rng.choice("aé 日\n▁xyz.") for _ in range(rng.randrange(60))) for _ in range(200)]
    keys = np.arange(len(texts))
    buf, off = text_buffer(pa.array(texts))
    ids, at = pieces.sample_slice(buf, off, keys, vocabulary, 0.7, 3)
    assert pieces.decode_ids(ids, at, vocabulary) == [(t or "").encode() for t in texts]
    for k in (3, 8, 40, 200):  # one row alone gives the same pieces as in the batch
        b, o = text_buffer(pa.array([texts[k]]))
        alone, _ = pieces.sample_slice(b, o, keys[k : k + 1], vocabulary, 0.7, 3)
        assert alone.tolist() == ids[at[k] : at[k + 1]].tolist()
    other, _ = pieces.sample_slice(buf, off, keys, vocabulary, 0.7, 4)
    assert other.tolist() != ids.tolist()


def test_large_alpha_is_the_best_segmentation(vocabulary):
    """At a high power nearly all mass is on the segmentation of most weight, found by dynamic programming."""
    ids_of = {vocabulary.pieces[i]: i for i in np.flatnonzero(vocabulary.normal).tolist()}
    for word in (" internationalisation", " hello", " thndwhanthe"):
        raw = word.encode()
        best = {0: (0.0, ())}
        for end in range(1, len(raw) + 1):
            options = [(best[a][0] + vocabulary.log_weight[ids_of[raw[a:end]]], (*best[a][1], ids_of[raw[a:end]])) for a in range(end) if a in best and raw[a:end] in ids_of]
            if options:
                best[end] = max(options)
        buf, off = text_buffer(pa.array([word[1:]]))
        ids, _ = pieces.sample_slice(buf, off, np.array([1]), vocabulary, 400.0, 1)
        assert tuple(ids.tolist()) == best[len(raw)][1]


def test_operator(spark, vocabulary):
    rows = [(k, t, "z") for k, t in enumerate(ODD)] + [(None, "null key", "z"), (3, "  a  b ", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.round_trip(df, vocabulary).collect()
    assert len(got) == len(rows) and all(r.lossless and r.n_pieces == len(r.ids) for r in got)
    assert len({tuple(r.ids) for r in got if r.doc_id == 3}) == 1
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(df, vocabulary), vocabulary).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(ODD))
    assert pieces.round_trip(df.where("doc_id = 99"), vocabulary).count() == 0
