"""Inverse pairs and invariants of the corpus operators on generated texts."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelspark.llm import chat, exact_dedup, near_dedup, pieces
from reelspark.llm.common import shingle_sets, slices, text_buffer, word_hashes

few = settings(max_examples=80, deadline=None)
texts = st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab \n\t▁é", max_size=80)), max_size=12)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


@few
@given(texts=texts, seed=st.integers(0, 2**31))
def test_pieces_decode_to_their_texts(vocabulary, texts, seed):
    buf, off = text_buffer(pa.array(texts, pa.string()))
    ids, at = pieces.sample_slice(buf[off[0] : off[-1]], off - off[0], np.arange(len(texts)), vocabulary, 0.5, seed)
    assert pieces.decode_ids(ids, at, vocabulary) == [(t or "").encode() for t in texts]


@few
@given(texts=texts, width=st.integers(1, 5))
def test_shingle_counts(texts, width):
    buf, off = text_buffer(pa.array(texts, pa.string()))
    got = [len(s) for a, b in slices(off, 64) for s in shingle_sets(buf[off[a] : off[b]], off[a : b + 1], width)]
    want = []
    for t in texts:
        w = (t or "").encode().lower().split()
        want.append(len({tuple(w[k : k + width]) for k in range(len(w) - width + 1)}) if len(w) >= width else int(bool(w)))
    assert got == want


@few
@given(texts=texts)
def test_words_hash_alike_anywhere(texts):
    buf, off = text_buffer(pa.array(texts, pa.string()))
    seen = {}
    for a, b in slices(off):
        hashes, at = word_hashes(buf[off[a] : off[b]], off[a : b + 1])
        for k in range(b - a):
            words = (texts[a + k] or "").encode().lower().split()
            mine = hashes[at[k] : at[k + 1]].tolist()
            assert len(words) == len(mine)
            for w, h in zip(words, mine):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@few
@given(role=st.text(alphabet="user<|[\\>\n", max_size=12), text=st.text(alphabet="<|end>[\\]\n x", max_size=60))
def test_template_reads_back(role, text):
    import re

    escape = lambda s, which: re.sub(which, r"\1\\", s)  # noqa: E731  as the column expression does
    segment = f"<|{escape(role, chat._ESCAPE_ROLE)}|>\n{escape(text, chat._ESCAPE)}<|end|>\n"
    assert chat.read_back(segment * 2) == [(role, text)] * 2


@few
@given(data=st.binary(max_size=400), cut=st.integers(0, 400))
def test_fingerprints_combine(data, cut):
    cut = min(cut, len(data))
    tables = [exact_dedup.powers(b, 16) for b in exact_dedup.BASES]
    of = lambda d: exact_dedup.fingerprint(np.frombuffer(d, np.uint8), tables, chunk=16)
    parts = zip(of(data[:cut]), of(data[cut:]), exact_dedup.BASES)
    assert of(data) == tuple(exact_dedup.combine(a, b, len(data) - cut, base) for a, b, base in parts)


@few
@given(rows=st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=20), min_size=1, max_size=12), percent=st.integers(50, 100))
def test_exact_edges_connect_the_true_components(rows, percent):
    sets = [np.array(sorted(int.from_bytes(hashlib.sha256(bytes([v])).digest()[:8], "big") for v in r), np.uint64) for r in rows]
    src, dst, parts = near_dedup.exact_edges(sets, np.arange(len(sets)), np.ones(len(sets), bool), percent)
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(rows[a] & rows[b]) >= percent * len(rows[a] | rows[b]):
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    assert all((parts.of[a] == parts.of[b]) == (comp[a] == comp[b]) for a in range(len(rows)) for b in range(a))
    assert len(src) == len(rows) - len(set(comp))
