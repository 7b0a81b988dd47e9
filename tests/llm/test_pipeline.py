"""The pipeline against a brute-force run of its rules, its contract, and the registered queries."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from reelspark.llm import exact_dedup, pieces, quality
from reelspark.llm.queries import ORACLE_SQL, QUERIES

from .test_dedup import brute, lower
from .test_scans import words


def by_rules(docs, items, scores):
    """Ids that each stage keeps, from the rules alone."""
    kept = [[(i, t) for i, t in docs if scores[i] >= 0.3]]
    last = {}
    for i, t in kept[-1]:
        last[lower(t)] = max(i, last.get(lower(t), i))
    kept.append([(i, t) for i, t in kept[-1] if last[lower(t)] == i])
    comp = {i: c for i, _, c in brute(kept[-1], 5)}
    kept.append([(i, t) for i, t in kept[-1] if comp[i] == i])
    grams = []
    for t in items:
        w = words(t)
        k = min(5, len(w))
        grams.append((k, {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}))

    def leaks(t):
        w = words(t)
        own = {tuple(w[a : a + 5]) for a in range(len(w) - 4)}
        return any(g and k == 5 and len(g & own) >= 0.8 * len(g) for k, g in grams)

    kept.append([(i, t) for i, t in kept[-1] if not leaks(t)])
    return [sorted(i for i, _ in k) for k in kept]


def test_stages_follow_their_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    want = by_rules(rows, items, scores)
    now = docs
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want):
        now = stage(spark, now, sf_dir)
        assert now.columns == columns, name
        assert sorted(r.doc_id for r in now.select("doc_id").collect()) == ids, name
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == want[-1]
    texts = dict(rows)
    v = pieces.load()
    assert all(r.lossless for r in out)
    assert all(b"".join(v.pieces[k] for k in r.ids)[1:].decode() == texts[r.doc_id] for r in out[:20])
    assert len(want[0]) > len(want[1]) > len(want[3])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_rows(spark, sf_dir, name, stage):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (3, long, "en", "s", 9, 1), (None, "a null id stays where it is", "en", None, 1, 1), (4, "same text here", "en", "s", 3, 1), (4, "same text here", "en", "s", 3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    out = stage(spark, docs, sf_dir)
    if name != "sentencepiece":
        assert out.columns == docs.columns
    assert 0 < out.count() <= len(rows)
    assert stage(spark, docs.where("doc_id < 0"), sf_dir).count() == 0


def test_repeated_rows_leave_one(spark, sf_dir):
    docs = spark.createDataFrame([(4, "T"), (4, "T"), (9, "t"), (9, "t"), (5, "u")], "doc_id long, text string")
    out = corpus_pipeline.drop_exact_copies(spark, docs, sf_dir).collect()
    assert sorted(map(tuple, out)) == [(5, "u"), (9, "t")]
    assert exact_dedup.exact_groups(docs).where("kept").count() == 2


EXACT = [
    [(4, "same"), (9, "same"), (4, "unique text of id four")],
    [(7, "Q"), (7, "q")],
    [(None, "a"), (None, "A"), (None, "b"), (3, "B"), (None, None), (None, "")],
    [(1, "x"), (1, "X"), (1, "y"), (2, "Y"), (2, "Y"), (2, "z"), (None, "Z"), (None, "w")],
    [(5, None), (6, ""), (6, None), (5, " ")],
]


@pytest.mark.parametrize("rows", EXACT)
def test_exact_stage_loses_no_unique_text(spark, sf_dir, rows):
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, k_id int")
    got = corpus_pipeline.drop_exact_copies(spark, docs, sf_dir)
    assert got.columns == docs.columns
    best = {}
    for i, t in rows:
        best[lower(t)] = max(best.get(lower(t), -1), -1 if i is None else i)
    out = [(lower(r.text), -1 if r.doc_id is None else r.doc_id) for r in got.collect()]
    assert sorted(out) == sorted(best.items())


def test_registration():
    queries = __spark_entry__.queries()
    assert {n for n in queries if n.startswith("op")} == set(QUERIES) and len(QUERIES) == 10
    assert queries["pipeline"] is corpus_pipeline.run and set(ORACLE_SQL) <= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(queries)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(str([r[names.index(c)] for c in columns]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_cover_all_documents(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    got = QUERIES[name](spark, sf_dir)
    assert got.select("doc_id").exceptAll(docs).isEmpty() and docs.exceptAll(got.select("doc_id")).isEmpty()
    assert got.agg(F.count("*")).first()[0] == docs.count()
