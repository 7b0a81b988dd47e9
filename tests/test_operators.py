"""Hand-made cases: recovery, ties, overshoot, round trips and error bounds."""

import random

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelspark.functions import bytes as B
from reelspark.functions import timebase, transforms
from reelspark.operators import blocks, rate, stream, vq
from reelspark.sources import codecs, container, scans
from reelspark.streaming import audio_buffer


def pictures(spark, text):
    return spark.createDataFrame([(1, i, k) for i, k in enumerate(text)], "file long, seq long, kind string")


def flags(df, column):
    return "".join("x" if r[column] else "." for r in df.orderBy("seq").collect())


def test_drop_recovers_at_the_next_i_picture(spark):
    # a dropped P poisons what follows until one I picture, not two
    assert flags(stream.drop_policy(pictures(spark, "IPBBIPB"), "bp"), "dropped") == ".xxx.xx"
    assert flags(stream.drop_policy(pictures(spark, "IBBPBI"), "b"), "dropped") == ".xx.x."
    assert flags(stream.drop_policy(pictures(spark, "PBIP"), "none"), "dropped") == "xx.."
    assert flags(stream.drop_policy(pictures(spark, "IPB"), "all"), "dropped") == "xxx"


def test_references_and_slots(spark):
    assert flags(stream.has_references(pictures(spark, "BIBPB")), "ready") == ".x.xx"
    rows = stream.reference_slots(pictures(spark, "IPBPB")).orderBy("seq").collect()
    assert [(r.past, r.future) for r in rows] == [(None, None), (None, 0), (0, 1), (0, 1), (1, 3)]


def test_syncs_come_in_display_order(spark):
    rows = stream.sync_points(pictures(spark, "IPBBP")).orderBy("period").collect()
    assert [r.period for r in rows] == list(range(1, len(rows) + 1))
    assert len(rows) == 5  # one for each picture


def test_mux_overshoots_and_skips_blocks_beyond_the_target(spark):
    video = spark.createDataFrame([("f", k, k + 1) for k in range(4)], "file string, seq long, period long")
    # copying goes on while the target isn't reached, so a long block overshoots; the guard holds for a batch's first block
    audio = spark.createDataFrame([("f", 0, 0, 1500), ("f", 0, 1, 6000), ("f", 0, 2, 6500)], "file string, stream int, block long, stop long")
    rows = stream.interleave(video, audio, 1000, 1, 1, 0).orderBy("out").collect()
    assert [(r.kind, r.ref) for r in rows] == [("a", 0), ("a", 1), ("v", 0), ("v", 1), ("v", 2), ("v", 3)]
    rows = stream.interleave(video, audio, 1000, 1, 1, 2000).orderBy("out").collect()
    assert [(r.kind, r.ref) for r in rows] == [("a", 0), ("a", 1), ("v", 0), ("v", 1), ("v", 2), ("a", 2), ("v", 3)]


def test_nearest_entry_ties_go_to_the_lowest(spark):
    points = spark.createDataFrame([(1, [0, 0])], "point_id long, vec array<int>")
    book = spark.createDataFrame([(5, [1, 0]), (3, [0, 1]), (9, [0, -1])], "cb_id long, vec array<int>")
    assert vq.assign(points, book).first().cb_id == 3


def test_large_codebook_takes_the_blocked_way(spark, monkeypatch):
    points = spark.createDataFrame([(i, [i, 2 * i]) for i in range(20)], "point_id long, vec array<int>")
    book = spark.createDataFrame([(i, [3 * i, 5 * i]) for i in range(12)], "cb_id long, vec array<int>")
    small = sorted(map(tuple, vq.assign(points, book).select("point_id", "cb_id", "dist").collect()))
    monkeypatch.setattr(vq, "SMALL_CODEBOOK", 4)
    assert sorted(map(tuple, vq.assign(points, book).select("point_id", "cb_id", "dist").collect())) == small


def plain_elbg(points, book, max_steps, least_gain=0.1):
    """The rules of ``vq.elbg`` point by point: codebook, and how many shifts were kept."""

    def dist(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    def mean(rows, dims):
        n = max(1, len(rows))
        return [(2 * s + n) // (2 * n) if s >= 0 else -((-2 * s + n) // (2 * n)) for s in (sum(r[d] for r in rows) for d in range(dims))]

    k, dims, last, kept = len(book), len(book[0]), None, 0
    for _ in range(max_steps):
        cells = [[] for _ in book]
        for p in points:
            cells[min(range(k), key=lambda c: (dist(p, book[c]), c))].append(p)
        errors = [sum(dist(p, book[c]) for p in cells[c]) for c in range(k)]
        error, used, new = sum(errors), set(), [list(c) for c in cells]
        rich = sorted((c for c in range(k) if k * errors[c] > error), key=lambda c: (-errors[c], c))
        gain = 0
        for low in sorted((c for c in range(k) if k * errors[c] < error), key=lambda c: (errors[c], c)):
            near = min((c for c in range(k) if c != low), key=lambda c: (dist(book[c], book[low]), c))
            high = next((c for c in rich if c not in used and c != near), None)
            if high is None or used & {low, near}:
                continue
            used |= {low, high, near}
            lows, highs = [min(p[d] for p in cells[high]) for d in range(dims)], [max(p[d] for p in cells[high]) for d in range(dims)]
            a, b = [x + (y - x) // 3 for x, y in zip(lows, highs)], [y - (y - x) // 3 for x, y in zip(lows, highs)]
            sides = [[p for p in cells[high] if (dist(p, a) >= dist(p, b)) == s] for s in (False, True)]
            a, b = (mean(s, dims) for s in sides)
            sides = [[p for p in cells[high] if (dist(p, a) > dist(p, b)) == s] for s in (False, True)]
            both = cells[low] + cells[near]
            centre = mean(both, dims)
            after = sum(dist(p, centre) for p in both) + sum(dist(p, a) for p in sides[0]) + sum(dist(p, b) for p in sides[1])
            if after < errors[low] + errors[high] + errors[near]:
                new[near], new[high], new[low] = both, *sides
                gain += after - errors[low] - errors[high] - errors[near]
                kept += 1
        error += gain
        book = [mean(c, dims) for c in new]
        if last is not None and last - error <= least_gain * error:
            break
        last = error
    return book, kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clustering_with_shifted_cells(spark, seed):
    """Skewed points: most in one place, and entries that start far from all of them."""
    rng = random.Random(seed)
    points = [[rng.randrange(-9, 9), rng.randrange(40)] for _ in range(120)] + [[rng.randrange(200, 230), rng.randrange(-300, -280)] for _ in range(15)] + [[500, 500]]
    book = [[1000 + c, -1000] for c in range(3)] + [rng.choice(points) for _ in range(4)]
    want, kept = plain_elbg(points, book, 5)
    assert kept > 0
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)] + [(-1, None)], "point_id long, vec array<int>").repartition(3)
    got = vq.elbg(df, spark.createDataFrame(list(enumerate(book)), "cb_id long, vec array<int>"))
    assert [r.vec for r in got.orderBy("cb_id").collect()] == want
    assert min_errors(np.array(points), np.array(want)) < min_errors(np.array(points), np.array(book)) / 3


def test_start_codebook_samples_again_and_again(spark):
    rng = random.Random(9)
    points = [[rng.randrange(-50, 50), rng.randrange(100)] for _ in range(2000)]

    def start(rows, k, steps):
        n = len(rows)
        if n <= 24 * k:
            return [rows[i * 433494437 % n] for i in range(k)]
        some = [rows[i * 433494437 % n] for i in range(n // 8)]
        return plain_elbg(some, start(some, k, 2 * steps), 2 * steps)[0]

    df = spark.createDataFrame(list(enumerate(points)), "point_id long, vec array<int>")
    got = vq.start_codebook(df, 2000, 3)
    assert [r.vec for r in got.orderBy("cb_id").collect()] == start(points, 3, 1)


def test_registered_clustering_follows_the_rules(spark, sf_dir):
    from reelspark.plans.queries import K, QUERIES

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    points = [[int(np.floor(np.float64(v) * 128)) for v in r.embedding] for r in rows]
    got = [r.vec for r in QUERIES["vq_elbg"](spark, sf_dir).orderBy("cb_id").collect()]
    assert got == plain_elbg(points, points[:K], 5)[0]


def min_errors(points, books):
    return ((points[:, None] - books[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_random_generator_matches_published_values():
    assert vq.mersenne(5489, 1).iloc[0] == 3499211612


def test_hull_and_greedy_budget(spark):
    o = spark.createDataFrame([(1, 0, 10, 0), (1, 1, 6, 8), (1, 2, 4, 10), (1, 3, 9, 9)], "block_id long, opt long, bits long, dist long")
    assert [r.opt for r in rate.hull(o).orderBy("step").collect()] == [0, 2]
    h = spark.createDataFrame([(0, b, s, 100 - 60 * s, 10 * s * (b + 1), b if s == 0 else -1) for b in range(3) for s in (0, 1)], "frame long, block_id long, step int, bits long, dist long, entry long")
    got = {r.block_id: r.step for r in rate.greedy_budget(h, "frame", 300).collect()}
    assert got == {0: 1, 1: 1, 2: 0}


def test_escape_round_trip(spark):
    rng = random.Random(7)
    data = [bytes(rng.choice((0, 0, 1, 254, 7)) for _ in range(rng.randrange(40))) for _ in range(300)] + [b"", b"\0\0\1", b"\0\0\1\xfe", b"\0\0\0\1\1"]
    df = spark.createDataFrame([(bytearray(x),) for x in data], "d binary")
    rows = df.select("d", B.escape(F.col("d")).alias("e"), B.unescape(B.escape(F.col("d"))).alias("u")).collect()
    for r in rows:
        assert bytes(r.u) == bytes(r.d)
        assert bytes(r.e) == bytes(r.d).replace(b"\0\0\1", b"\0\0\1\xfe")
        assert container.unescape_bytes(bytes(r.e)) == bytes(r.d)


def test_page_checksum_and_fields(spark):
    assert B.page_crc_bytes(b"123456789") == 0x89A1897F
    df = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04\x05"),), (bytearray(b"\x01"),), (None,)], "d binary")
    rows = df.select(B.field(F.col("d"), 1, 2).alias("b"), B.field(F.col("d"), 1, 2, True).alias("l")).collect()
    assert [(r.b, r.l) for r in rows] == [(0x0203, 0x0302), (None, None), (None, None)]


def test_bit_packing_is_inverse():
    rng = random.Random(3)
    for msb in (False, True):
        widths = [rng.randrange(1, 33) for _ in range(60)]
        values = [rng.randrange(1 << w) for w in widths]
        assert B.unpack_values(B.pack_values(values, widths, msb), widths, msb) == values
    assert B.unpack_values(b"\xff", [4, 8], False) == [15, -1]


def snr(a, b):
    return 10 * np.log10((a**2).sum() / ((a - b) ** 2).sum())


def test_transforms_against_naive_sums(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-16384, 16384, 64).astype(float)
    re, im = spark.createDataFrame([(x.tolist(), (x[::-1]).tolist())], "re array<double>, im array<double>").select(transforms.fft_udf("re", "im").alias("f")).select("f.re", "f.im").first()
    z = x + 1j * x[::-1]
    naive = np.array([sum(z[n] * np.exp(-2j * np.pi * k * n / 64) for n in range(64)) for k in range(64)])
    assert snr(np.concatenate([naive.real, naive.imag]), np.concatenate([re, im])) > 60
    n, w = 32, transforms.sine_window(64)
    s = rng.normal(size=n * 6)
    frames = [transforms.imdct(transforms.mdct(s[k * n : k * n + 2 * n], w), w) for k in range(5)]
    out = np.zeros(n * 6)
    for k, f in enumerate(frames):
        out[k * n : k * n + 2 * n] += f
    assert snr(s[n : 5 * n], out[n : 5 * n]) > 60
    v = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    once = v.select(transforms.rotate_udf("x", F.lit(0.3)).alias("x"))
    back = np.array(once.select(transforms.rotate_udf("x", F.lit(-0.3)).alias("x")).first().x)
    assert snr(x, back) > 60
    assert snr(x, np.array(once.first().x)) < 20


def test_zigzag_and_dequantise(spark):
    order = blocks.zigzag()
    assert order[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(order) == list(range(64))
    rows = spark.createDataFrame([(3, 8, 16), (-3, 8, 16), (0, 8, 16), (255, 31, 83)], "l int, q int, w int").select(blocks.dequantise(F.col("l"), F.col("q"), F.col("w"), True).alias("v")).collect()
    assert [r.v for r in rows] == [47, -47, 0, 2047]


def test_granules_rise_with_frames(spark):
    shift = 6
    g = [((k // 8 * 8) << shift) + k % 8 for k in range(64)]
    rows = spark.createDataFrame([(v,) for v in g], "g long").select(timebase.granule_frame(F.col("g"), shift).alias("f"), timebase.frame_seconds(timebase.granule_frame(F.col("g"), shift), 16, 1).alias("s")).collect()
    assert [r.f for r in rows] == list(range(64))
    assert all(abs(r.s - (k + 1) / 16) < 1e-6 for k, r in enumerate(rows))


def test_adpcm_follows_a_sine():
    v = (np.sin(np.arange(2000) / 20) * 12000).astype(int).tolist()
    back = codecs.adpcm_decode(codecs.adpcm_encode(v, 1, 40), 1)
    assert snr(np.array(v[100:], float), np.array(back[100:], float)) > 20
    two = [x for pair in zip(v, v[::-1]) for x in pair]
    assert len(codecs.adpcm_decode(codecs.adpcm_encode(two, 2, 40), 2)) == len(two)
    rng = random.Random(1)
    many = [bytes([rng.randrange(89), rng.randrange(256)]) + rng.randbytes(rng.randrange(60)) for _ in range(50)] + [b"", b"\x7f\0ab", b"\0\0"]
    for p, got in zip(many, codecs.adpcm_decode_many(many)):
        want = codecs.adpcm_decode(p, 1) if len(p) > 1 else None
        assert (got is None and want is None) or got.tolist() == want
    assert codecs.adpcm_decode(b"\0", 1) is None and codecs.adpcm_decode(bytes([0x7F, 0]), 1) is None


def test_quads_round_trip_and_early_end():
    ops = [("vector", 3), ("motion", 0x97), ("quad", [("vector", 1), ("skip",), ("quad", [9, 8, 7, 6]), ("motion", 0x88)]), ("skip",)]
    got = codecs.parse_quads(codecs.build_quads(ops), 0, 16, 16)
    assert got[0] == (0, 0, 8, "vector", 3, None)
    assert got[1] == (0, 8, 8, "motion", -1, 1)
    assert [g[3] for g in got[2:]] == ["vector", "skip", "cell", "cell", "cell", "cell", "motion", "skip"]
    assert codecs.parse_quads(codecs.build_quads(ops)[:3], 0, 16, 16) == got[:1]


def test_container_reads_back_and_reports_damage(spark):
    head = {"video_type": 1, "audio_type": 4, "largest_packet": 9, "readahead": 0, "sample_rate": 8000, "audio_readahead": 0, "audio": [{"layout": 1, "meta_id": "lang-en"}]}
    good = container.build_headers(head) + container.build_packet("audio_frame", b"abc") + container.build_packet("audio_frame", b"d" * 40000, stream=1) + container.build_packet("audio_sync", b"\0\0\0\1")
    h, at = container.parse_headers(good)
    assert h["audio"][0]["meta_id"] == "lang-en"
    assert [(p[2], p[4], p[5], p[7]) for p in container.parse_packets(good, at)] == [("audio_frame", 0, 3, None), ("audio_frame", 1, 40000, None), ("audio_sync", 0, 4, None)]
    assert list(container.parse_packets(good[:-1], at))[-1][7] == "cut payload"
    even = bytearray(good)
    even[at + 6] ^= 1  # an even compact size
    assert next(iter(container.parse_packets(bytes(even), at)))[7] == "bad size"
    assert container.parse_headers(b"\0" * 30) == (None, 0)


def test_movie_source_reads_writes_and_streams(spark, tmp_path):
    container.register(spark)
    head = container.build_headers({"video_type": 1, "audio_type": 1, "largest_packet": 9, "readahead": 0})
    files = [(f"m{k}.mov", bytearray(head + container.build_packet("video_inline", bytes([k]) * (k + 1)))) for k in range(3)]
    out = str(tmp_path / "movies")
    spark.createDataFrame(files, "file string, content binary").write.format("movie").mode("append").option("path", out).save()
    rows = spark.read.format("movie").option("path", out).load().orderBy("file").collect()
    assert [r["size"] for r in rows] == [1, 2, 3] and all(r.bad is None for r in rows)
    q = spark.readStream.format("movie").option("path", out).load().writeStream.format("memory").queryName("movies").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.table("movies").count() == 3


def test_pages_resume_after_damage(spark):
    packets = [(bytes([k]) * (k * 97 % 700), k) for k in range(40)]
    data = scans.build_pages(packets, fill=400)
    whole = spark.createDataFrame([("a", bytearray(data))], "file string, content binary")
    rows = scans.ogg_packets(scans.ogg_pages(whole)).orderBy("packet").collect()
    assert [r["size"] for r in rows] == [len(p) for p, _ in packets] and not any(r.hole for r in rows)
    second = data.find(b"OggS", 5)
    broken = bytearray(data)
    broken[second + 40] ^= 0xFF
    pages = scans.ogg_pages(spark.createDataFrame([("a", broken)], "file string, content binary"))
    assert pages.where("bad = 'damaged'").count() == 1
    assert scans.ogg_packets(pages).where("hole").count() == 1


def test_packet_of_a_multiple_of_255_and_over_a_page(spark):
    packets = [(b"x" * 255, 0), (b"", 1), (b"y" * 70000, 2), (b"z", 3)]
    pages = scans.ogg_pages(spark.createDataFrame([("a", bytearray(scans.build_pages(packets)))], "file string, content binary"))
    assert pages.where("bad is not null").count() == 0
    got = scans.ogg_packets(pages).orderBy("packet").collect()
    assert [r["size"] for r in got] == [255, 0, 70000, 1] and [bytes(r.payload) for r in got] == [p for p, _ in packets]


def test_clusters_reject_bad_sizes():
    data = codecs.build_cluster(77, [b"ab", b"", b"c"], True)
    got = codecs.parse_cluster(data)
    assert [(g["payload"], g["eos"], g["granule"]) for g in got] == [(b"ab", False, 77), (b"", False, 77), (b"c", True, 77)]
    assert codecs.parse_cluster(data[:-1]) is None and codecs.parse_cluster(b"\0" * 9) is None
    with pytest.raises(ValueError):
        codecs.build_cluster(0, [])


def test_buffer_rules():
    b = audio_buffer.Buffer(100)
    assert b.step("play", 0)[0] == "refused"
    assert b.step("audio", 60) == ("buffered", 0) and b.step("read", 1)[0] == "underrun"
    assert b.step("sync", 60) == ("committed", 0)
    assert b.step("play", 20) == ("playing", 20) and b.committed == 40
    assert b.step("audio", 50) == ("buffered", 0)
    assert b.step("sync", 111) == ("soft_desync", 40) and b.committed == 50
    assert b.step("audio", 80) == ("buffered", 30) and b.committed == 20
    assert b.step("error", 0) == ("hard_desync", 100)


def test_streaming_buffer_equals_replay(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k % 3, k, rng.choice(("audio", "audio", "sync", "play", "read", "error")), rng.randrange(1, 900)) for k in range(120)]
    schema = "stream long, seq long, kind string, value long"
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = audio_buffer.follow(events).writeStream.format("memory").queryName("buffers").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = audio_buffer.replay(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, spark.table("buffers").collect())) == sorted(map(tuple, want.collect()))


def test_recurrences():
    step = rate.moving_distortion(100)
    assert step(None, 10, 0) == (10, 10) and step(10, 20, 0) == (14, 14)
    assert [step(400, 400, slip)[0] for slip in (301, 300, 101, 100, -100, -101)] == [420, 410, 410, 400, 400, 380]
    still = rate.two_pole(6)
    y, state = still(None, 1000)
    assert y == 1000 and [still(state, 1000)[0]] == [1000]
    gain, c0, c1 = rate.two_pole_coefficients(6)
    assert abs(4 * gain + c0 + c1 - (1 << 24)) <= 3
    undo, out = rate.de_emphasis(), []
    state = None
    for x, before in zip(range(50), (0, *range(49))):
        y, state = undo(state, x - 0.85 * before)
        out.append(y)
    assert np.allclose(out, range(50))
    assert rate.bisect(0, 100, lambda t: (t - 37) ** 2) == 37


def test_empty_tables(spark):
    none = spark.createDataFrame([], "file long, seq long, kind string")
    assert stream.drop_policy(none, "bp").count() == 0 and stream.sync_points(none).count() == 0
    assert isinstance(pd.DataFrame(), pd.DataFrame)


def test_coder_laplace_and_pulses():
    from reelspark.functions import entropy

    rng = random.Random(11)
    for _ in range(300):
        symbols = []
        for _ in range(rng.randrange(1, 80)):
            total = rng.randrange(2, 1 << rng.randrange(2, 16))
            low = rng.randrange(total)
            symbols.append((low, rng.randrange(low + 1, total + 1), total))
        src = entropy.Decoder(entropy.encode_symbols(symbols))
        for low, high, total in symbols:
            assert low <= src.peek(total) < high
            src.take(low, high, total)
    for _ in range(500):
        v, decay = rng.randrange(-7, 8), rng.randrange(5000, 16000)
        low, high, total = entropy.laplace_interval(v, decay)
        assert low < high and entropy.laplace_value(rng.randrange(low, high), decay) == v
    for n, k in ((1, 3), (3, 4), (5, 3), (8, 2)):
        seen = [tuple(entropy.pulse_vector(i, n, k)) for i in range(entropy.pulse_count(n, k))]
        assert len(set(seen)) == len(seen) and all(sum(map(abs, y)) == k for y in seen)
        assert all(entropy.pulse_index(list(y)) == i for i, y in enumerate(seen))


def test_prefix_tree():
    from reelspark.functions import entropy

    codes = [("0", 4), ("10", 9), ("110", 1), ("111", 30)]
    assert entropy.tree_codes(entropy.tree_bits(codes)) == codes
    with pytest.raises(ValueError):
        entropy.tree_codes("000")


def test_plans_codecs_and_profiles(spark):
    from reelspark.plans import encode

    df = spark.range(10)
    plan = encode.Plan("p", needs={"id"}).then("a", lambda d: d.where("id > 3"))
    assert plan.run(df).count() == 6
    with pytest.raises(ValueError, match="missing"):
        encode.Plan("p", needs={"x"}).then("a", lambda d: d).run(df)
    with pytest.raises(ValueError, match="twice"):
        plan.then("a", lambda d: d).run(df)
    codecs_ = encode.Codecs()
    codecs_.add("raw", lambda c: c)
    with pytest.raises(ValueError):
        codecs_.decode("other", F.col("id"))
    same, seen = encode.profiled(df, rows=F.count("*"), top=F.max("id"))
    assert same.count() == 10 and seen.get == {"rows": 10, "top": 9}


def test_comment_lists(spark):
    from reelspark.functions import tags
    from reelspark.sources import headers

    items = ["ARTIST=a", "TITLE=b", "artist=c"]
    df = spark.createDataFrame([(headers.build_comments("v", items),), (headers.build_comments("v", items)[:-1],), (b"x",), (None,)], "d binary")
    rows = df.select(headers.comments("d").alias("c")).collect()
    assert [r.c for r in rows] == [items, None, None, None]
    c = spark.createDataFrame([(items,)], "c array<string>").select(tags.lookup(F.col("c"), "Artist", 1).alias("v"), tags.lookup(F.col("c"), "artist", 2).alias("none"), tags.count(F.col("c"), "ARTIST").alias("n")).first()
    assert (c.v, c.none, c.n) == ("c", None, 2)


def test_pages_written_by_stream(spark):
    rows = [(f"s{k % 2}", k, k, bytearray(b"p" * (k * 50))) for k in range(20)]
    content = scans.write_pages(spark.createDataFrame(rows, "file string, seq long, granule long, payload binary"), 500)
    got = {(r.file, r["packet"]): r["size"] for r in scans.ogg_packets(scans.ogg_pages(content)).collect()}
    assert got == {(f"s{k % 2}", k // 2): k * 50 for k in range(20)}


def test_planes_restore_and_soften(spark):
    from reelspark.operators import planes

    rng = np.random.default_rng(4)
    dc, ref = rng.integers(-900, 900, (7, 9)), rng.integers(-1, 3, (7, 9))
    dc[ref < 0] = 0
    assert (planes.restore_dc(planes.predict_dc(dc, ref), ref) == dc).all()
    flat = np.full((16, 16), 90)
    assert (planes.deblock(flat, np.ones((2, 2), bool), 10) == flat).all()
    step = np.hstack([np.full((16, 8), 90), np.full((16, 8), 98)])
    soft = planes.deblock(step, np.ones((2, 2), bool), 10)
    assert 90 < soft[0, 7] < soft[0, 8] < 98 and (soft[:, :7] == 90).all()
    steep = np.hstack([np.full((16, 8), 0), np.full((16, 8), 255)])
    assert (planes.deblock(steep, np.ones((2, 2), bool), 10) == steep).all()
    assert (planes.deblock(step, np.zeros((2, 2), bool), 10) == step).all()


def test_encoder_and_decoder_agree(spark):
    rng = np.random.default_rng(2)
    cells = np.hstack([rng.integers(0, 256, (64, 1)).repeat(4, 1) + rng.integers(-9, 10, (64, 4)), np.full((64, 2), 128)]).clip(0, 255).astype(np.uint8)
    entries = rng.integers(0, 64, (32, 4)).astype(np.uint8)
    yy, xx = np.mgrid[0:32, 0:48]
    frames = [((yy * 3 + xx * 2 + 9 * k) % 256).astype(np.uint8) for k in range(3)]
    rows, before = [], np.zeros((32, 48), np.uint8)
    for k, f in enumerate(frames):
        data = codecs.encode_frame(f, cells, entries, before, price=4.0)
        rows.append(("a", k, bytearray(data)))
        (_, _, _), (_, arg, body) = codecs.chunks(data)
        before = codecs._draw(codecs.parse_quads(body, arg, 48, 32), cells, entries, before)
        assert 10 * np.log10(255**2 / np.mean((before.astype(float) - f) ** 2)) > 20
    out = codecs.decode_video(spark.createDataFrame(rows, "file string, seq long, payload binary"), 48, 32)
    last = np.zeros((32, 48), int)
    for r in out.where("frame = 2").collect():
        last[r.y, r.x] = r.v
    assert (last == before).all()


def random_macroblocks(rng, kind, f_code):
    from reelspark.sources import slices

    out, address = [], 8 - 1
    for _ in range(rng.randrange(1, 9)):
        address += 1 if not out else rng.choice((1, 1, 1, 2, 40))
        flags = rng.choice(list(slices.KINDS[kind].values()))
        intra = "i" in flags
        pattern = 63 if intra else rng.randrange(1, 64) if "p" in flags else 0
        blocks = []
        for k in range(6):
            if not pattern >> (5 - k) & 1:
                blocks.append(None)
                continue
            b = [0] * 64
            for _ in range(rng.randrange(1, 9)):
                b[rng.randrange(64)] = rng.choice((1, -1, 2, -3, 17, -40, 127, -128, 200, -255))
            if intra:
                b[0] = rng.randrange(0, 256)
            if not any(b):
                b[0] = 1
            blocks.append(b)
        half = 16 << (f_code - 1)
        move = lambda side: tuple(rng.randrange(-half, half) for _ in range(2)) if side in flags else None
        out.append({"mb_addr": address, "kind": flags, "scale": rng.randrange(1, 32), "forward": move("f"), "backward": move("b"), "pattern": pattern, "blocks": blocks, "bad": None})
    return out


def test_slices_round_trip_and_break_off():
    from reelspark.sources import slices

    rng = random.Random(12)
    for kind in "IPB" * 60:
        f_code = rng.randrange(1, 4)
        want = random_macroblocks(rng, kind, f_code)
        scale = 7
        for m in want:
            scale = m["scale"] = m["scale"] if "q" in m["kind"] else scale
        data = slices.build_slice(want, kind, 1, 8, 7, f_code, f_code)
        assert slices.parse_slice(data, kind, 1, 8, f_code, f_code) == want
        cut = slices.parse_slice(data[: len(data) // 2], kind, 1, 8, f_code, f_code)
        assert all(a == b for a, b in zip(cut[:-1], want))


def test_prefix_codes_are_complete():
    from reelspark.sources import slices

    share = lambda table: sum(2.0 ** -len(c) for c in table)
    assert share(slices.PATTERN) == 1 - 2 / 512 and share(slices.LEVEL) == 1 - 16 / 65536
    assert slices.LEVEL["000001"] is None and slices.LEVEL["10"] == "end" and slices.LEVEL["0000000000010000"] == (1, 18) and slices.LEVEL["00111"] == (3, 1)
    for table in (slices.INCREMENT, slices.MOTION, slices.DC_LUMA, slices.DC_CHROMA, slices.PATTERN, slices.LEVEL, *slices.KINDS.values()):
        codes = sorted(table)
        assert not any(b.startswith(a) for a, b in zip(codes, codes[1:]))
    assert len(slices.PATTERN) == 63 and len(slices.LEVEL) == 113


def written(spark, tmp_path, texts):
    """A folder with a documents table of these texts, numbered from 0."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_start_codes_of_whole_texts(spark, tmp_path):
    from reelspark.plans import source_queries

    texts = [" ".join(f"w{k}é" for k in range(n)) for n in (0, 1, 39, 40, 41, 500)] + [None]
    folder = written(spark, tmp_path, texts)
    marks = {(r.file, r.pos): r for r in source_queries._marks(spark, folder).collect()}
    want = 0
    for n, text in enumerate(texts):
        data = source_queries._mpeg_of((text or "").encode())
        at = data.find(b"\0\0\1")
        while 0 <= at < len(data) - 3:
            r = marks[(str(n), at)]
            assert (r.code, bytes(r.head), r.file_size) == (data[at + 3], data[at + 4 : at + 16], len(data))
            want += 1
            at = data.find(b"\0\0\1", at + 3)
    assert len(marks) == want == sum(1 + 2 * len((t or "").split()) for t in texts)
    from reelspark.plans.registry import QUERIES

    kinds = {(r.file, r.kind): r["count"] for r in QUERIES["picture_kinds"](spark, folder).collect()}
    assert kinds == {(str(n), k): c for n, t in enumerate(texts) for k, i in (("I", (0,)), ("B", (1, 2)), ("P", (3,))) if (c := sum(w % 4 in i for w in range(len((t or "").split()))))}


def test_start_codes_at_the_edges_of_files(spark):
    files = [b"", b"\0\0\1", b"\xb3\0\0", b"\1\0\0\1\5", b"\0\0\1\0\0\0\1", b"\0\0\0\1\7ab"]
    df = spark.createDataFrame([(str(k), bytearray(c)) for k, c in enumerate(files)], "file string, content binary").coalesce(1)
    got = sorted((r.file, r.pos, r.code, bytes(r.head), r.file_size) for r in scans.start_codes(df).collect())
    assert got == [("3", 1, 5, b"", 5), ("4", 0, 0, b"\0\0\1", 7), ("5", 1, 7, b"ab", 7)]


def test_adpcm_codes_of_whole_texts(spark, tmp_path):
    import zlib

    from reelspark.plans.registry import QUERIES

    rng = random.Random(4)
    texts = ["", None, "a", "ab", "é" * 333, *("".join(rng.choice("abc XYZ~é\t") for _ in range(n)) for n in (399, 400, 401, 2500))]
    folder = written(spark, tmp_path, texts)
    got = {r.doc_id: r for r in QUERIES["adpcm_encode"](spark, folder).collect()}
    for k, t in enumerate(texts):
        v = [(b - 100) * 100 for b in (t or "").encode()]
        v += v[-1:] * (len(v) % 2)
        packet = codecs.adpcm_encode(v, 1, 40)
        back = codecs.adpcm_decode(packet, 1)
        assert (got[k].n, got[k].codes_crc, got[k].total) == (len(v), zlib.crc32(packet), sum(back))
        assert got[k].worst == max((abs(a - b) for a, b in zip(v, back)), default=0)
    wide = [np.array([rng.randrange(-32768, 32768) for _ in range(n)]) for n in (0, 2, 300)]
    assert codecs.adpcm_encode_many(wide, 7) == [codecs.adpcm_encode(v.tolist(), 1, 7) for v in wide]


def test_page_checksum_of_whole_texts(spark, tmp_path):
    from reelspark.plans.registry import QUERIES

    texts = ["a" * 255 + "b", "a" * 255 + "c", "é" * 3000, "123456789", ""]
    got = {r.doc_id: r.crc for r in QUERIES["page_checksum"](spark, written(spark, tmp_path, texts)).collect()}

    def crc(data):
        reg = 0
        for byte in data:
            reg ^= byte << 24
            for _ in range(8):
                reg = (reg << 1 ^ (0x04C11DB7 if reg >> 31 else 0)) & 0xFFFFFFFF
        return reg

    assert got == {k: crc(t.encode()) for k, t in enumerate(texts)} and got[0] != got[1]


@pytest.mark.parametrize("move", [(8, 8), (-7, 8), (8, -7), (-7, -7), (0, 5), (-8, 0)])
def test_motion_search_finds_far_moves(spark, move):
    from reelspark.operators import frames

    side, size, rng = 24, 4, np.random.RandomState(5)
    old = rng.randint(0, 256, (side, side))
    dy, dx = move
    new = np.roll(old, (-dy, -dx), (0, 1))  # pixel (y, x) of the new frame stands at (y + dy, x + dx) of the old one
    rows = [(f, 0, y, x, int(px[y, x])) for f, px in ((0, old), (1, new)) for y in range(side) for x in range(side)]
    df = spark.createDataFrame(rows, "frame long, plane int, y int, x int, v int")
    got = {(r.block_y, r.block_x): (r.dy, r.dx, r.sse) for r in frames.motion_search(df, df).collect()}
    assert len(got) == (side // size) ** 2
    for (by, bx), found in got.items():
        block, best = new[by * size : (by + 1) * size, bx * size : (bx + 1) * size], None
        for j in range(-7, 9):
            for i in range(-7, 9):
                y, x = by * size + j, bx * size + i
                if 0 <= y <= side - size and 0 <= x <= side - size:
                    rank = (int(((block - old[y : y + size, x : x + size]) ** 2).sum()), (j, i) != (0, 0), j, i)
                    best = rank if best is None else min(best, rank)
        assert found == (best[2], best[3], best[0])
    if dy >= -7:
        assert any(v == (dy, dx, 0) for v in got.values())


def test_level_codes_are_complete():
    """No code starts another, and what the tables leave free is known: the 16 and 2 lowest words are not used."""
    from reelspark.sources import slices

    for table, free in ((slices.LEVEL, 16 / 2**16), (slices.PATTERN, 2 / 2**9)):
        assert sum(2.0 ** -len(c) for c in table) == 1 - free
        assert not any(a != b and b.startswith(a) for a in table for b in table)


def test_padding_joins_no_grid(spark):
    """The grid of all positions looked as small as the table of sizes, and was broadcast."""
    from reelspark.operators import frames

    sizes = {(0, 0): (5, 3), (0, 1): (16, 17), (7, 0): (1, 32)}
    rows = [(f, p, y, x, (y * 40 + x + f) % 256) for (f, p), (h, w) in sizes.items() for y in range(h) for x in range(w)] + [(None, 0, 0, 0, 1)]
    padded = frames.pad_edges(spark.createDataFrame(rows, "frame long, plane int, y int, x int, v int"))
    got = {(r.frame, r.plane, r.y, r.x): r.v for r in padded.collect()}
    up = lambda n: -(-n // 16) * 16
    assert got == {(f, p, y, x): (min(y, h - 1) * 40 + min(x, w - 1) + f) % 256 for (f, p), (h, w) in sizes.items() for y in range(up(h)) for x in range(up(w))}
    assert "Join" not in padded._jdf.queryExecution().optimizedPlan().toString()


def test_scans_give_rows_back_in_bounded_batches(monkeypatch):
    """A batch of many rows or bytes, even of one file, was handed back whole."""

    class Files:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    one = scans.build_pages([(b"x" * 700, k) for k in range(400)], fill=4096)
    batch = pa.RecordBatch.from_pydict({"file": ["1", None], "content": [one, None]})
    cut = lambda data: ((k, data[k : k + 1000]) for k in range(0, len(data), 1000))
    monkeypatch.setattr(scans, "GATHER_BYTES", 10_000)
    got = list(scans._flat(Files(), cut, "file string, n int, b binary")([batch]))
    assert b"".join(b for g in got for b in g.column("b").to_pylist()) == one and max(g.nbytes for g in got) < 12_000
    made = list(scans._flat(Files(), cut, "file string, n int, b binary", make=lambda data: data[:5] + b"!")([batch]))
    assert [r for g in made for r in g.to_pylist()] == [{"file": "1", "n": 0, "b": b"OggS\0!"}, {"file": None, "n": 0, "b": b"!"}]

    monkeypatch.setattr(scans, "MARK_BYTES", 1000)
    codes = b"".join(b"\0\0\1" + bytes([k % 256]) + b"head" * (k % 4) for k in range(3000))
    marks = list(scans.start_codes(Files())([pa.RecordBatch.from_pydict({"file": ["1", "2"], "content": [codes, codes[:999]]})]))
    rows = [r for m in marks for r in m.to_pylist() if r["file"] == "1"]
    assert [r["code"] for r in rows] == [k % 256 for k in range(3000)] and all(codes[r["pos"] : r["pos"] + 3] == b"\0\0\1" and r["head"] == codes[r["pos"] + 4 : r["pos"] + 16] for r in rows)
    assert max(len(m) for m in marks) <= 334


def test_files_of_documents_are_made_in_the_scan(spark, tmp_path):
    """Made in a stage of their own, files crossed to a second Python worker in batches of 10,000."""
    from reelspark.plans.registry import QUERIES

    folder = written(spark, tmp_path, ["a b", None, "c"])
    for name in ("sequence_extensions", "sequence_headers", "start_codes", "ogg_damage", "riff_chunks", "yuv_planes", "mp2_frames", "avi_frames"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapIn") == 1, (name, plan)


def test_adpcm_takes_memory_in_proportion_to_what_is_coded(monkeypatch):
    """Codes and samples took 32 bytes a byte of text, and a query coded all texts of a batch at once."""
    import tracemalloc

    from reelspark.plans import source_queries

    rng = np.random.RandomState(3)
    packets = [bytes([40, 0]) + rng.bytes(n) for n in [20_000] * 100 + [70_000]]
    tracemalloc.start()
    back = codecs.adpcm_decode_many(packets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(map(len, packets))
    for k in (0, 100):
        assert back[k].tolist() == codecs.adpcm_decode(packets[k], 1)


def test_adpcm_queries_code_texts_in_bounded_groups(spark, tmp_path, monkeypatch):
    from reelspark.plans import source_queries

    texts = [chr(97 + k % 26) * (k % 7 * 100) for k in range(60)]
    folder = written(spark, tmp_path, texts)
    want = {r.doc_id: r for r in source_queries._adpcm(spark, folder).collect()}
    taken = []
    fields, batch = "doc_id long, n long", pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "content": [t.encode() for t in texts]})
    monkeypatch.setattr(source_queries, "ADPCM_BYTES", 5000)
    kept = {}
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.mapInArrow", lambda self, run, schema: kept.update(run=run))
    source_queries._adpcm_rows(spark, folder, lambda ids, held: taken.append(sum(map(len, held))) or {"doc_id": ids, "n": [2 * len(c) for c in held]}, fields)
    rows = [r for b in kept["run"]([batch]) for r in b.to_pylist()]
    assert rows == [{"doc_id": k, "n": want[k].n} for k in range(60)] and len(taken) > 3 and max(taken) < 5600


def test_adpcm_steps_all_packets_at_once_only_while_many_are_left(monkeypatch):
    """A long packet took a step of array work for each of its samples; wide samples a search in Python each."""
    rng, steps = np.random.RandomState(8), []
    many = [rng.randint(-32768, 32768, n) for n in [100] * 80 + [40] * 9 + [3000, 0]] + [np.array([32767, -32768] * 50)]
    one = codecs._nearest_codes
    monkeypatch.setattr(codecs, "_nearest_codes", lambda *a: steps.append(len(a[0])) or one(*a))
    packets = codecs.adpcm_encode_many(many, 60)
    assert packets == [codecs.adpcm_encode(v.tolist(), 1, 60) for v in many] and len(steps) <= 100
    assert all(b.tolist() == codecs.adpcm_decode(p, 1) for b, p in zip(codecs.adpcm_decode_many(packets), packets))


def test_slices_take_one_lookup_a_code_and_come_back_in_bounded_batches(spark, monkeypatch):
    """Each length of a code was tried in turn, codes were sought by their value, and a batch was handed back whole."""
    from reelspark.sources import slices

    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return super().get(key)

    block = [0] * 63 + [255]
    items = [{"mb_addr": k, "kind": "fp", "scale": 5, "forward": (k % 16, -k % 16), "backward": None, "pattern": 32, "blocks": [block, *[None] * 5], "bad": None} for k in range(5000)]
    data = slices.build_slice(items, "P", 0, 8, 5)
    for name in ("_STEP", "_MOTION", "_PATTERN", "_LEVEL"):
        width, found = getattr(slices, name)
        monkeypatch.setattr(slices, name, (width, Counted(found)))
    assert slices.parse_slice(data, "P", 0, 8) == items and Counted.asked == 6 * len(items)

    class Slices:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    row = {"file": "a", "frame": 1, "picture": "P", "row": 0, "forward": 1, "backward": 1, "payload": data}
    got = list(slices.macroblocks(Slices(), 8)([pa.RecordBatch.from_pylist([row, row | {"frame": 2, "payload": b""}, row | {"frame": 3}])]))
    assert max(len(b) for b in got) < 2 * slices.GATHER_ROWS
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["frame"] for r in rows] == [1] * 5000 + [2] + [3] * 5000 and rows[5000]["bad"] == "cut slice" and rows[5000]["blocks"] == [None] * 6
    assert rows[7]["forward"] == {"y": 7, "x": 9} and rows[7]["backward"] is None and rows[7]["blocks"][0] == block


def test_greedy_budget_takes_many_frames_a_batch(spark):
    """Each frame crossed to Python as a pandas frame of its own."""
    rng = random.Random(12)
    rows = [(f, f * 10 + b, k, 90 - 20 * k - rng.randrange(9), 10 * k + rng.randrange(9), rng.randrange(-1, 4)) for f in range(40) for b in range(5) for k in range(rng.randrange(1, 5))]
    df = spark.createDataFrame(rows, "frame long, block_id long, step int, bits long, dist long, entry long").repartition(7)
    chosen = rate.greedy_budget(df, "frame", 300)
    got = {(r.frame, r.block_id): (r.step, r.frame_bits) for r in chosen.collect()}
    assert set(got) == {(r[0], r[1]) for r in rows} and "FlatMapGroupsInPandas" not in chosen._jdf.queryExecution().optimizedPlan().toString()
    for f in range(40):
        own = {(r[1], r[2]): r[3:] for r in rows if r[0] == f}
        at = {b: 0 for b, _ in own}
        size = lambda: sum(own[b, k][0] for b, k in at.items()) + 48 * len({own[b, k][2] for b, k in at.items()} - {-1})
        while size() > 300:
            steps = [((own[b, k + 1][1] - own[b, k][1]) / max(1, own[b, k][0] - own[b, k + 1][0]), b) for b, k in at.items() if (b, k + 1) in own]
            if not steps:
                break
            at[min(steps)[1]] += 1
        assert all(got[f, b] == (k, size()) for b, k in at.items())
