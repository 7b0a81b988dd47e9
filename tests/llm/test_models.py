"""The classifiers: trees against their definition, held-out accuracy, awkward rows."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelspark.llm import gbdt, labelled, quality, toxicity
from reelspark.llm.common import SLICE_BYTES, text_buffer

SF = "/root/testdata/sf0.1"
ROWS = [(1, None, "a", 1.0), (2, "", "a", 1.0), (3, "x " * 300_000, "a", 1.0), (3, "plain words here", "a", 1.0), (None, "no id", "a", 1.0), (4, "\U0001F600 é \x00", "a", 1.0)]
SCHEMA = "doc_id long, text string, score string, y double"


def test_trees_walk_as_defined_and_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 2] > 1)).astype(float)
    model = gbdt.fit(x[:1000], y[:1000], trees=40, depth=3)
    assert ((model.predict(x[1000:]) > 0.5) == y[1000:]).mean() > 0.9
    for row, margin in zip(x[:50], model.margin(x[:50])):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += leaf[at - len(f)]
        assert abs(total - margin) < 1e-9
    assert gbdt.fit(np.zeros((0, 4)), np.zeros(0)).predict(np.zeros((2, 4))).tolist() == [0.5, 0.5]


def test_every_split_is_the_best_one():
    """One tree against exhaustive search over all features and all cuts, node by node."""
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 12, 400), rng.integers(0, 9, 400), rng.normal(size=400).round(1)], axis=1).astype(float)
    y = (((x[:, 0] > 5) & (x[:, 1] < 4)) | (rng.random(400) < 0.2)).astype(float)
    model = gbdt.fit(x, y, trees=1, depth=3, bins=200)
    p = 1 / (1 + np.exp(-model.base))
    g, h = p - y, np.full(len(y), p * (1 - p))

    def loss(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + 1.0)

    def gain(rows, k, cut):
        left = rows[x[rows, k] <= cut]
        right = rows[x[rows, k] > cut]
        if min(h[left].sum(), h[right].sum()) < 1.0:
            return 0.0
        return loss(left) + loss(right) - loss(rows)

    nodes = {0: np.arange(len(y))}
    for at in range(7):
        rows = nodes[at]
        cuts = [(k, (a + b) / 2) for k in range(3) for a, b in zip(np.unique(x[:, k])[:-1], np.unique(x[:, k])[1:])]
        best = max((gain(rows, k, c) for k, c in cuts), default=0.0)
        k, c = int(model.feature[0, at]), model.threshold[0, at]
        assert np.isclose(gain(rows, k, c), best, atol=1e-6) if np.isfinite(c) else best <= 1e-6
        nodes[2 * at + 1], nodes[2 * at + 2] = rows[x[rows, k] <= c], rows[x[rows, k] > c]
    for leaf in range(8):
        rows = nodes[7 + leaf]
        assert np.isclose(model.leaf[0, leaf], -0.15 * g[rows].sum() / (h[rows].sum() + 1.0))


def test_isotonic_is_the_least_squares_fit():
    score, y = np.array([1, 2, 3, 4, 5.0]), np.array([0, 1, 0, 1, 1.0])
    xs, values = gbdt.isotonic(score, y)
    assert xs.tolist() == score.tolist()
    assert np.allclose(values, [0, 0.5, 0.5, 1, 1], atol=0.02) and (np.diff(values) >= 0).all()
    assert len(gbdt.isotonic(np.zeros(0), np.zeros(0))[0]) == 0


def test_fold_rule(spark):
    rows = spark.range(200).select("id", labelled.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
    labels = spark.createDataFrame([(r.id, 1 if r.id % 2 else None) for r in rows] + [(None, 1), (1, 0)], "doc_id long, quality int")
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = {r.doc_id for r in labelled.labelled_sample(docs, labels, "quality", "doc_id", "text").collect()}
    assert got == {r.id for r in rows if r.id % 2 and not r.h}
    assert labelled.labelled_sample(docs, labels, "quality", "doc_id", "text", rows=7).count() == 7


def test_statistics_against_plain_counts():
    texts = ["Abc abc, ABC 12!", "", "one\ntwo two  three|", "x" * 3_000_000 + " y", None]
    x = quality.features(*text_buffer(pa.array(texts)))
    at = quality.FEATURES.index
    assert x.shape == (5, len(quality.FEATURES)) and np.isfinite(x).all()
    assert np.isclose(x[0, at("c_upper")], 4 / 16) and np.isclose(x[0, at("w_all_caps")], 1 / 4) and np.isclose(x[0, at("distinct")], 3 / 4)
    assert np.isclose(x[2, at("repeats")], 1 / 3) and np.isclose(x[2, at("top_word")], 2 / 4) and (x[1] == x[4]).all()
    assert np.isclose(x[3, at("log_bytes")], np.log1p(3_000_002)) and np.isclose(x[3, at("log_words")], np.log1p(2))


def test_kept_rows_go_back_in_slices():
    """Whole rows leave ``keep`` at most a slice of text at a time (a longer text alone), none lost or changed."""

    class Rows:
        columns, schema = ["kept", "text"], None

        def mapInArrow(self, run, schema):
            return run

    rng = random.Random(5)
    texts = [None, "", "x " * (3 * SLICE_BYTES // 2), *(" ".join(rng.choice(["plain", "words", "AAA!!", "77"]) for _ in range(rng.randrange(4000))) for _ in range(400)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["kept", "text"])
    x = quality.features(*text_buffer(batch.column(1)))
    model = gbdt.fit(x, (x[:, 1] > np.median(x[:, 1])).astype(float), trees=5, depth=2)
    good = model.predict(x) >= 0.5
    assert 50 < good.sum() < len(texts) - 50
    out = list(quality.keep(Rows(), model, least=0.5)(iter([batch, batch.slice(0, 0)])))
    assert pa.Table.from_batches(out).to_pylist() == batch.filter(pa.array(good)).to_pylist()
    assert all(len(b) == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= SLICE_BYTES for b in out)


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_held_out_accuracy_and_awkward_rows(spark, module, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = module.fit(docs, labels)
    scored = module.score(docs, model).join(labels, "doc_id").select("doc_id", labelled.held_out(F.col("doc_id")).alias("h"), "score", label).collect()
    out = [(r.score >= least) == r[label] for r in scored if r.h]
    assert len(out) > 500 and sum(out) / len(out) > 0.985
    assert all(0 <= r.score <= 1 for r in scored)
    got = module.score(spark.createDataFrame(ROWS, SCHEMA), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert module.score(docs.where("doc_id < 0"), model).count() == 0
    # labels, ids, language and source are no inputs
    moved = docs.where("doc_id < 50").select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit("q").alias("lang"), F.lit("s").alias("source"))
    before = {r.doc_id: r.score for r in module.score(docs.where("doc_id < 50"), model).collect()}
    assert {r.doc_id - 10**6: r.score for r in module.score(moved, model).collect()} == before


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_without_labels(spark, module, label):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame([], f"doc_id long, {label} int")
    assert module.classify(docs, labels).count() == len(ROWS)


def test_disguised_words_are_found():
    lexicon = {0: toxicity._hash_of(["vrklm"])}
    x = toxicity.features(*text_buffer(pa.array(["you vrklm now", "a St7pid id1ot", "calm words", "you are VRKLM!!!"])), lexicon)
    at = toxicity.FEATURES.index
    assert x[0, at("hits")] == 1 and x[0, at("second_near_hits")] == 1 and x[2, at("hits")] == 0
    assert x[1, at("disguised_hits")] >= 1 and x[3, at("twice_marks")] > 0


def plain_features(text, words, stems):
    """A row of features by definition, with a lexicon of words and of beginnings of four bytes."""
    raw = (text or "").encode()
    tokens = [t.lower() for t in re.findall(rb"[A-Za-z0-9@$*\x80-\xff]+", raw)]
    as_is = re.findall(rb"[A-Za-z0-9@$*\x80-\xff]+", raw)
    known = lambda t: t in words or (len(t) > 4 and t[:4] in stems)
    seeds, second = ({w.encode() for w in v} for v in (toxicity.SEEDS, toxicity.SECOND))
    hit = [k for k, t in enumerate(tokens) if known(t) or t in seeds]
    people = [k for k, t in enumerate(tokens) if t in second]
    plain = bytes.maketrans(b"013457@$", b"oieastas")
    odd = [k for k, t in enumerate(tokens) if re.search(rb"[0-9@$*]", t)]
    n, size = max(1, len(tokens)), max(1, len(raw))
    share = lambda rows: sum(rows) / n
    run = [0, *(a == b for a, b in zip(raw, raw[1:]))]
    out = {
        "log_words": np.log1p(len(tokens)), "seed_density": share(t in seeds for t in tokens), "word_hits": sum(t in words for t in tokens),
        "stem4_hits": sum(len(t) > 4 and t[:4] in stems for t in tokens), "hits": len(hit), "density": len(hit) / n,
        "most_near": max((sum(k <= j < k + 32 for j in hit) for k in hit), default=0), "second_density": len(people) / n,
        "second_near_hits": sum(any(abs(j - k) <= 5 for j in people) for k in hit),
        "caps_words": share(len(t) > 1 and t.isalpha() and t.isascii() and t == t.upper() for t in as_is),
        "twice_marks": share(run[k] and raw[k] in b"!?" for k in range(len(raw))),
        "stretched": share(k and run[k] and run[k - 1] and (chr(raw[k]).isalpha() if raw[k] < 128 else True) for k in range(len(raw))),
        "disguised_hits": sum(k not in hit and (known(tokens[k].translate(plain)) or tokens[k].translate(plain) in seeds) for k in odd),
        "inner_digit": share(0 < len(re.findall(rb"[0-9]", t)) < len(t) for t in tokens),
    }
    return out | {f"m_{m}": sum(b in bytes(chars) for b in raw) / size for m, chars in toxicity._MARKS.items()}


def test_features_against_plain_python_and_across_pieces():
    """All features by definition; a text read in small pieces has the same windows and counts."""
    rng = random.Random(5)
    words, stems = [b"vrklm", b"gnorf"], [b"zump", b"blat"]
    bank = ["vrklm", "VRKLM", "gn0rf", "zumpel", "blatty", "zump", "you", "Ihr", "calm", "a", "st7pid", "$cum", "IDIOT", "hmmmm", "w0rd", "12", "***", "é", "what?!!", "no.", "\n", "SHOUT", "(ok)"]
    texts = [" ".join(rng.choice(bank) for _ in range(rng.randrange(300))) for _ in range(40)] + ["", None, "!", "!!", "you " * 4 + "vrklm", "vrklm" + " a" * 6 + " you", "vrklm " * 80]
    ends = np.cumsum([len(w) for w in stems])
    hashes = toxicity.span_hashes(np.frombuffer(b"".join(stems), np.uint8), ends - 4, ends)
    lexicon = {0: toxicity._hash_of([w.decode() for w in words]), 4: np.sort(toxicity.mix(hashes + np.uint64(4)))}
    buf, off = text_buffer(pa.array(texts))
    x = toxicity.features(buf, off, lexicon)
    for row, text in zip(x, texts):
        for name, value in plain_features(text, words, stems).items():
            assert np.isclose(row[toxicity.FEATURES.index(name)], value), (name, text)
    for limit in (16, 100):
        assert np.allclose(toxicity.features(buf, off, lexicon, limit=limit), x)
