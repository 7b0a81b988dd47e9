"""Exact and near dedup against brute force, on awkward rows."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import exact_dedup, near_dedup
from reelspark.llm.common import shingle_sets, slices, text_buffer
from reelspark.llm.components import connected_components

SCHEMA = "doc_id long, text string, keep_id string, component_id int"


def frame(spark, rows):
    """Documents with extra columns that clash with results' names."""
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)


AWKWARD = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "É é"), (6, "é é"), (7, "a b" * 30_000), (8, "A B" * 30_000), (9, "x"), (9, "x"), (9, "y"), (None, "z"), (None, "z"), (10, "Z"), (11, " "), (12, "w" * 300), (13, "w" * 300 + " q")]


def lower(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("prime,chunk", [(exact_dedup.PRIME, exact_dedup.CHUNK), (7, 16)])
def test_exact_groups(spark, prime, chunk):
    """Small primes make unlike texts collide; chunk comparison must tell them apart."""
    rng = random.Random(4)
    rows = AWKWARD + [(100 + k, "".join(rng.choice("aB") for _ in range(rng.randrange(4)))) for k in range(60)]
    got = exact_dedup.exact_groups(frame(spark, rows), prime=prime, chunk=chunk).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = next(v for t, v in groups.items() if hashlib.sha256(t).hexdigest() == r.text_sha256)
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)


def test_one_id_of_very_many_texts(spark):
    """All rows share one id, or have none: every text is still its own group."""
    rows = [(5, f"text {k % 1500}") for k in range(3000)] + [(None, f"Text {k}") for k in range(1500)]
    got = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert len(got) == 4500 and {r.group_size for r in got} == {3} and {r.keep_id for r in got} == {5} and sum(r.kept for r in got) == 1500


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_fingerprints_compose():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    data = data[(data < 65) | (data > 90)]  # lower case already
    n = len(data)
    tables = [exact_dedup.powers(b, 64) for b in exact_dedup.BASES]
    whole = exact_dedup.fingerprint(data, tables, chunk=64)
    naive = [0, 0]
    for v in data.tolist():
        naive = [(h * b + v + 1) % exact_dedup.PRIME for h, b in zip(naive, exact_dedup.BASES)]
    assert list(whole) == naive
    left, right = (exact_dedup.fingerprint(d, tables, chunk=64) for d in (data[:1234], data[1234:]))
    assert tuple(exact_dedup.combine(a, b, n - 1234, base) for a, b, base in zip(left, right, exact_dedup.BASES)) == whole


def test_fingerprint_of_a_huge_text_in_bounded_memory():
    """200 MB are hashed with temporaries of a few strides, and as if in one piece."""
    import tracemalloc

    text = np.tile(np.frombuffer(b"Huge TEXT, " * 1000, np.uint8), 18_000)
    tables = [exact_dedup.powers(b, exact_dedup.CHUNK) for b in exact_dedup.BASES]
    digest = hashlib.sha256()
    tracemalloc.start()
    got = exact_dedup.fingerprint(text, tables, seen=digest.update)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    assert digest.hexdigest() == hashlib.sha256(text.tobytes().lower()).hexdigest()
    half = len(text) // 2
    parts = [exact_dedup.fingerprint(t, tables) for t in (text[:half], text[half:])]
    assert got == tuple(exact_dedup.combine(a, b, len(text) - half, base) for a, b, base in zip(*parts, exact_dedup.BASES))


def sets_of(rows, width):
    out = []
    for _, t in rows:
        w = lower(t).split()
        out.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute(rows, width, percent=80):
    """Component of each row: ids are vertices, pairs of rows with similar sets are edges."""
    sets = sets_of(rows, width)
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j = rows[b][0]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)]


def near_rows(seed, n=140):
    """Groups of near copies of all degrees around the threshold, some large, and short texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    while len(rows) < n:
        base = [rng.choice(words) for _ in range(rng.choice((1, 2, 6, 30, 80)))]
        for _ in range(rng.choice((1, 1, 2, 25))):
            copy = base[:]
            for _ in range(rng.choice((0, 0, 1, 2, 4, 7))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((k, " ".join(copy)))
            k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,kw", [(2, {}), (5, {}), (2, {"leaf": 6, "block": 5, "block_shingles": 300}), (2, {"bits": 2})])
def test_near_duplicates(spark, width, kw):
    rows = near_rows(width) + [(1001, None), (1002, ""), (1003, "A b\x0bC"), (1004, "a B c"), (1005, " \n"), (None, "a b c"), (1006, "one two"), (1006, "one two"), (1007, "p q r s"), (1007, "k l m n"), (1008, "k l m n"), (1009, "P q r s")]
    got = near_dedup.near_duplicates(frame(spark, rows), width=width, **kw).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows, width), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_recall_where_nodes_branch(spark, monkeypatch):
    """4,000 documents share a passage, so that roots hold far more than a leaf: pairs above the threshold are still found."""
    rng = random.Random(21)
    passage = [f"p{k}" for k in range(60)]
    rows, want, k = [], [], 0
    while k < 4000:
        own = [f"x{rng.randrange(10**6)}" for _ in range(60)]
        rows.append((k, " ".join(passage + own)))
        if k % 10 == 0:
            copy = own[:]
            for _ in range(rng.choice((1, 2, 4, 5))):
                copy[rng.randrange(60)] = f"y{rng.randrange(10**6)}"
            k += 1
            rows.append((k, " ".join(passage + copy)))
            a, b = (sets_of([r], 2)[0] for r in rows[-2:])
            if 100 * len(a & b) >= 80 * len(a | b):
                want.append((k - 1, k))
        k += 1
    levels, split = [], near_dedup._split

    def watched(nodes, level, leaf, branches):
        levels.append(level)
        return split(nodes, level, leaf, branches)

    monkeypatch.setattr(near_dedup, "_split", watched)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows), width=2).collect()}
    assert max(levels) > 0  # nodes branched at the default leaf
    found = sum(got[a] == got[b] for a, b in want)
    assert len(want) > 250 and found >= 0.99 * len(want)
    assert sum(i != c for i, c in got.items()) == found  # no other links


def test_near_duplicates_of_nothing_and_of_empty_texts(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    got = near_dedup.near_duplicates(frame(spark, [(1, ""), (2, None)])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_shingles_of_long_texts_are_whole():
    import pyarrow as pa

    text = "Ab cd\t" * 600_000 + "x" * 3_000_000 + " END"
    buf, off = text_buffer(pa.array([text, "a", None]))
    got = [s for a, b in slices(off) for s in shingle_sets(buf[off[a] : off[b]], off[a : b + 1], 2)]
    words = text.lower().split()
    assert [len(s) for s in got] == [len(set(zip(words, words[1:]))), 1, 0]


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(k, k + 1) for k in range(60)]
    hub = [(1000, 1001 + k) for k in range(200)]
    edges = spark.createDataFrame(chain + hub + [(5, 5), (None, 3), (4, None), (None, None), (0, 1)], "src long, dst long")
    got = {r.id: r.comp for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(201)}
    assert connected_components(edges.where("src < 0")).count() == 0


def test_only_named_columns_are_read(spark):
    odd = frame(spark, [(1, "a"), (2, "a")]).withColumn("src", F.lit(1)).withColumn("n", F.lit("n"))
    assert exact_dedup.exact_groups(odd).count() == near_dedup.near_duplicates(odd).count() == 2


def test_release_deletes_intermediate_tables(spark):
    from reelspark.llm import common

    root, common_dir = "file:" + common.shared_dir(spark), common.shared_dir
    try:
        common.shared_dir = lambda _: root + "/own"
        kept = common.materialise(spark.range(3).toDF("id"), "x")
        assert kept.count() == 3
        common.release(spark)
        with pytest.raises(Exception, match="(?i)exist|not found"):
            kept.sparkSession.read.parquet(kept.inputFiles()[0]).count()
    finally:
        common.shared_dir = common_dir
