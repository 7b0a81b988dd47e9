"""Inverse pairs and invariants on generated inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reelspark.functions import bytes as B
from reelspark.functions import entropy
from reelspark.operators import planes
from reelspark.sources import codecs, container, headers, scans

few = settings(max_examples=60, deadline=None)


@few
@given(st.lists(st.tuples(st.sampled_from(container.TYPES), st.binary(min_size=1, max_size=300), st.integers(0, 5)), max_size=20))
def test_packets(rows):
    data = b"".join(container.build_packet(t, p, s) for t, p, s in rows)
    assert [(r[2], r[6], r[4]) for r in container.parse_packets(data, 0)] == rows


@few
@given(st.binary(max_size=200))
def test_packets_of_junk_end_with_a_reason(data):
    rows = list(container.parse_packets(data, 0))
    assert all(r[7] is None for r in rows[:-1]) and (not data or rows[-1][7] is not None or sum(r[5] for r in rows) < len(data))


@few
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=15), st.integers(1, 3000))
def test_pages(packets, fill):
    pages = list(scans._pages(scans.build_pages([(p, k) for k, p in enumerate(packets)], fill=fill)))
    assert all(p[-1] is None for p in pages) and [p[5] for p in pages] == list(range(len(pages)))
    laces = [x for p in pages for x in p[6]]
    body = b"".join(p[7] for p in pages)
    out, size = [], 0
    for x in laces:
        size += x
        if x < 255:
            out.append(body[:size])
            body, size = body[size:], 0
    assert out == packets


@few
@given(st.lists(st.binary(max_size=60), min_size=1, max_size=127), st.integers(0, 2**63 - 1), st.booleans())
def test_clusters(packets, granule, last):
    rows = codecs.parse_cluster(codecs.build_cluster(granule, packets, last))
    assert [r["payload"] for r in rows] == packets and rows[0]["granule"] == granule and rows[-1]["eos"] == last


@few
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(1, 32)), max_size=40), st.booleans())
def test_bits(pairs, msb):
    values, widths = [v & ((1 << w) - 1) for v, w in pairs], [w for _, w in pairs]
    assert B.unpack_values(B.pack_values(values, widths, msb), widths, msb) == values


@few
@given(st.text(max_size=20), st.lists(st.text(max_size=20), max_size=9))
def test_comments(vendor, items):
    assert headers.comments_of(headers.build_comments(vendor, items)) == items


@few
@given(st.lists(st.integers(-4, 4), min_size=1, max_size=7))
def test_pulses(y):
    index = entropy.pulse_index(y)
    k = sum(map(abs, y))
    assert 0 <= index < entropy.pulse_count(len(y), k) and entropy.pulse_vector(index, len(y), k) == y


@few
@given(st.integers(1, 6), st.integers(1, 6), st.randoms(use_true_random=False))
def test_planes(height, width, rng):
    ref = np.array([[rng.randrange(-1, 3) for _ in range(width)] for _ in range(height)])
    dc = np.array([[rng.randrange(-2000, 2000) for _ in range(width)] for _ in range(height)]) * (ref >= 0)
    assert (planes.restore_dc(planes.predict_dc(dc, ref), ref) == dc).all()


@few
@given(st.lists(st.integers(-32768, 32767), max_size=60), st.integers(0, 88))
def test_adpcm_stays_in_range(samples, index):
    samples = samples[: len(samples) // 2 * 2]
    packet = codecs.adpcm_encode(samples, 1, index)
    back = codecs.adpcm_decode(packet, 1)
    assert len(back) == len(samples) and all(-32768 <= v <= 32767 for v in back)
    assert codecs.adpcm_decode_many([packet])[0].tolist() == back


@given(st.lists(st.tuples(st.sampled_from(container.TYPES), st.binary(min_size=1, max_size=60), st.integers(0, 3)), max_size=12), st.lists(st.integers(1, 50), min_size=1, max_size=20), st.integers(0, 40))
@settings(max_examples=80, deadline=None)
def test_scanner_takes_any_pieces(packets, cuts, lost):
    """Fed in any pieces, resumed anywhere, cut at the end: the same rows as from the whole file."""
    head = {"video_type": 2, "audio_type": 3, "largest_packet": 60, "readahead": 0, "width": 8, "height": 8, "rate_num": 30, "rate_den": 1, "rw_frames": 2, "wo_frames": 0, "frame_format": 1, "layout": 0, "sample_rate": 8000, "audio_readahead": 0, "audio": [{"layout": 1, "meta_id": "x"}]}
    data = container.build_headers(head) + b"".join(container.build_packet(t, p, s) for t, p, s in packets)
    data = data[: len(data) - lost] if lost < len(data) - 60 else data
    headers, at = container.parse_headers(data)
    want = list(container.parse_packets(data, at))
    scanner, got, pos, k = container.Scanner(), [], 0, 0
    while pos < len(data):
        size = cuts[k % len(cuts)]
        got += scanner.feed(data[pos : pos + size])
        pos, k = pos + size, k + 1
        if scanner.in_packets and k % 5 == 0:  # another scanner takes over
            offset, seq = scanner.place
            scanner, pos = container.Scanner(offset, seq), offset
            cuts = [c + 97 for c in cuts]
    assert got + scanner.end() == want


def test_scanner_of_no_movie():
    for data in (b"", b"abc", b"x" * 400):
        scanner = container.Scanner()
        assert [r[-1] for r in scanner.feed(data) + scanner.end()] == ["bad movie header"]
