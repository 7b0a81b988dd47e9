"""Chat layouts, the template and its reading back."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from reelspark.llm import chat

ODD = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\nhi", "\\<\\[\\\\", "<|assistant|>\n", "", None, "plain", "a\\\nb", "[[<<\\\\>>]]", "\U0001F600<é[", "<\\|end|>\n"]
SCHEMA = "conv_id long, turn long, role string, text string, segment string, n_turns int"


def digest(turns):
    role = lambda t: t[0] or ""
    text = lambda t: t[1] or ""
    loss = "".join(text(t) for t in turns if role(t) == "assistant")
    return (
        len(turns), hashlib.sha256("".join(f"{role(t)}\n{text(t)}\n" for t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
    )


def test_every_text_comes_back(spark):
    rng = random.Random(6)
    convs = {k: [(rng.choice(("user", "assistant", "system", None, "a|>\n<|b")), rng.choice(ODD) if rng.random() < 0.7 else "".join(rng.choice("<[\\|>]\nend") for _ in range(30))) for _ in range(rng.randrange(1, 9))] for k in range(80)}
    convs[500] = [("user", "x" * 200_000 + "<"), ("assistant", "[" * 50_000)]
    rows = [(k, n, *t, "s", 1) for k, turns in convs.items() for n, t in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    turns = chat.canonical_turns(df, "conv_id", ["turn", "role", "text"])
    segments = chat.format_turns(turns)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digests(segments).collect()}
    assert got == {k: digest(v) for k, v in convs.items()}
    for r in segments.collect():
        assert chat.read_back(r.segment) == [(r.role, r.text)]
        body = r.segment[: -len(chat.END)]
        assert "<|end|>" not in body and "[INST]" not in body and "</s>" not in body
        assert not r.loss_to or chat._plain(r.segment[r.loss_from : r.loss_to]) == r.text
    plain = segments.select("text", chat.unescape(chat.escape(F.col("text"))).alias("back")).collect()
    assert all(r.text == r.back for r in plain)
    whole = {}
    for r in segments.orderBy("conv_id", "turn").collect():
        whole.setdefault(r.conv_id, []).append(r)
    assert all(chat.read_back("".join(s.segment for s in v)) == [(s.role, s.text) for s in v] for v in whole.values())


def test_ties_nulls_and_nothing(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "z"), (None, 1, "user", "q"), (None, 2, "assistant", None), (1, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digests(chat.format_turns(chat.canonical_turns(df))).collect()}
    assert got == {1: digest([("system", "z"), ("user", "a"), ("user", "a"), ("user", "b")]), None: digest([("user", "q"), ("assistant", "")])}
    assert chat.conversation_digests(chat.format_turns(chat.canonical_turns(df.where("conv_id = 9")))).count() == 0


RECORDS = [
    (1, {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}),
    (2, {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}),
    (3, {"prompt": "hi", "response": "yo"}),
    (4, {"completion": "yo", "prompt": "hi"}),
    (5, {"instruction": "hi", "input": "", "output": "yo"}),
    (6, {"instruction": "hi", "input": "more", "output": "yo", "system": "be"}),
    (7, {"question": "hi"}),
    (8, {"prompt": None, "response": "yo"}),
]


def test_mixed_layouts(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in RECORDS] + [(9, None), (10, "not json")], "conv_id long, record string")
    got = {}
    for r in chat.mixed_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    two = [("user", "hi"), ("assistant", "yo")]
    assert got == {1: two, 2: two, 3: two, 4: two, 5: two, 6: [("system", "be"), ("user", "hi\n\nmore"), ("assistant", "yo")], 8: [("user", ""), ("assistant", "yo")]}
    assert {r.conv_id for r in chat.unknown_layouts(df).collect()} == {7, 9, 10}


def test_fingerprint_ignores_order_but_not_names(spark):
    a = spark.createDataFrame([], "x struct<b:string,a:int>, y array<struct<c:long>>").schema
    b = spark.createDataFrame([], "y array<struct<c:long>>, x struct<a:int,b:string>").schema
    c = spark.createDataFrame([], "y array<struct<d:long>>, x struct<a:int,b:string>").schema
    assert chat.fingerprint(a) == chat.fingerprint(b) != chat.fingerprint(c)
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "q")], "conv_id long, question string"))
