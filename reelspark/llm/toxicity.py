"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon (a fixed seed list, and words and word beginnings learnt
from labelled rows), how near second-person words stand to hits, capitals, punctuation,
and obfuscation (look-alike letters, masked and stretched words, digits inside words).

The learnt lexicon holds hashes of words and of word beginnings of a few lengths whose
share among toxic documents exceeds that among others by ``LOG_ODDS``, with a likelihood
ratio that chance doesn't reach among as many keys; it counts over the labelled sample
(so the sample's bound is its bound, too) and is fitted crosswise: a sample row's features use the
lexicon of the other folds, so the trees see honest densities. The calibration is
fitted on out-of-fold scores; a thousandth of the raw score keeps the order within a step. Ids, language, source and labels are no
inputs of a score. The sample is bounded by ``labelled.SAMPLE_ROWS``, a parameter; every
whole text is scored. Of a very long text, counts are added up piece by piece, and the places of
hits and second-person words are kept, so windows of tokens reach across pieces.

Defined results: null and empty texts have all features 0 and get a score; repeated rows
get equal scores; other columns are not read. Without labelled rows the score is that of
the prior, 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbdt
from .common import SLICE_BYTES, _pieces, lower_bytes, materialise, mix, slices, span_hashes, text_buffer
from .labelled import SAMPLE_ROWS, held_out, labelled_sample

#: fixed values: common insults, and second-person words, in four languages
SEEDS = (
    "idiot", "stupid", "moron", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "dumb", "fool", "jerk", "imbecile", "garbage", "filth",
    "vermin", "ugly", "hate", "kill", "shut", "dummkopf", "abschaum", "imbécile", "connard", "salaud", "estúpido", "idiota", "basura", "imbécil",
)
SECOND = ("you", "your", "yours", "yourself", "u", "ur", "du", "dein", "deine", "dich", "dir", "ihr", "euch", "tu", "toi", "ton", "ta", "vous", "votre", "te", "tus", "usted", "ustedes")
STEMS = (4, 5, 6, 7)
LOG_ODDS = 3.0
LEAST_RATIO = 22.0  # of 2 ln(likelihood ratio): chance reaches it for one key in 400,000
FOLDS = 4
NEAR = 5
WINDOW = 32  # tokens

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TOKEN = _LETTER.copy()
_TOKEN[[ord(c) for c in "0123456789@$*"]] = True
#: look-alikes: 0 o, 1 i, 3 e, 4 a, 5 s, 7 t, @ a, $ s
_PLAIN = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$", b"oieastas"):
    _PLAIN[_a] = _b
_MARKS = {"upper": range(65, 91), "digit": range(48, 58), "exclaim": b"!", "question": b"?", "mask": b"*@#$%", "punct": b".,;:\"'()-", "newline": b"\n"}
_MARK = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_MARKS.values(), 1):
    _MARK[list(_chars)] = _k
FEATURES = (
    "log_words", "seed_density", "word_hits", "word_density", *(f"stem{k}_{m}" for k in STEMS for m in ("hits", "density")), "hits", "density", "most_near",
    "second_density", "second_near_hits", *(f"m_{m}" for m in _MARKS), "caps_words", "twice_marks", "stretched", "disguised_hits", "inner_digit",
)


def _hash_of(words) -> np.ndarray:
    raw = [w.encode() for w in words]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(w) for w in raw])
    return np.unique(span_hashes(buf, ends - [len(w) for w in raw], ends))


_SEED_HASHES, _SECOND_HASHES = _hash_of(SEEDS), _hash_of(SECOND)


def _tokens(buf: np.ndarray, offsets: np.ndarray):
    """Starts and ends of tokens, their text, and the lower-cased bytes."""
    inside = _TOKEN[buf]
    starts = np.zeros(len(buf) + 1, bool)
    starts[:-1] = inside
    starts[1:-1] &= ~inside[:-1]
    ends = np.zeros(len(buf) + 1, bool)
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    starts[cuts] = True
    ends[cuts] = True
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    return first, last, np.searchsorted(offsets, first, "right") - 1, lower_bytes(buf)


def _keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """kind -> (token numbers, hashes): 0 for whole words, k for beginnings of k bytes of longer words."""
    out = {0: (np.arange(len(starts)), span_hashes(low, starts, ends))}
    for k in STEMS:
        longer = np.flatnonzero(ends - starts > k)
        out[k] = (longer, mix(span_hashes(low, starts[longer], starts[longer] + k) + np.uint64(k)))
    return out


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _counts(buf: np.ndarray, offsets: np.ndarray, lexicon: dict[int, np.ndarray]):
    """Additive counts of each text of a slice, the token numbers of hits and second-person words, and each token's text."""
    n = len(offsets) - 1
    starts, ends, of, low = _tokens(buf, offsets)
    count = lambda hit, where=of: np.bincount(where[hit], minlength=n).astype(float)
    keys = _keys(low, starts, ends)
    words = keys[0][1]
    seed, second = _member(words, _SEED_HASHES), _member(words, _SECOND_HASHES)
    any_hit = seed.copy()
    columns = [np.bincount(of, minlength=n).astype(float), count(seed)]
    for kind, (number, hashes) in keys.items():
        hit = _member(hashes, lexicon.get(kind, np.zeros(0, np.uint64)))
        columns.append(count(hit, of[number]))
        any_hit[number[hit]] = True
    columns += [count(any_hit), count(second)]
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    k = len(_MARKS) + 1
    marks = np.bincount(doc * np.int32(k) + _MARK[buf], minlength=n * k).reshape(n, k)[:, 1:]
    upper = np.concatenate([[0], np.cumsum((buf >= 65) & (buf <= 90))])
    digits = np.concatenate([[0], np.cumsum((buf >= 48) & (buf <= 57))])
    size = ends - starts
    caps = upper[ends] - upper[starts]
    inner = digits[ends] - digits[starts]
    columns.append(count((caps == size) & (size > 1)))
    same = np.zeros(len(buf), bool)
    same[1:] = buf[1:] == buf[:-1]
    same[offsets[:-1][offsets[:-1] < len(buf)]] = False
    columns.append(np.bincount(doc[same & ((buf == 33) | (buf == 63))], minlength=n).astype(float))
    third = same.copy()
    third[1:] &= same[:-1]
    columns.append(np.bincount(doc[third & _LETTER[buf]], minlength=n).astype(float))
    odd = np.flatnonzero(~(_LETTER[buf[starts]] & (inner == 0)) | (np.add.reduceat(~_LETTER[buf], starts) > 0 if len(starts) else np.zeros(0, bool)))
    disguised = np.zeros(len(starts), bool)
    if len(odd):
        plain = _PLAIN[low]
        again = _keys(plain, starts[odd], ends[odd])
        for kind, (number, hashes) in again.items():
            hit = _member(hashes, lexicon.get(kind, np.zeros(0, np.uint64)))
            if kind == 0:
                hit |= _member(hashes, _SEED_HASHES)
            disguised[odd[number[hit]]] = True
    columns.append(count(disguised & ~any_hit))
    columns.append(count((inner > 0) & (inner < size)))
    return np.hstack([np.stack(columns, axis=1), marks]), np.flatnonzero(any_hit), np.flatnonzero(second), of


def _windows(hits: np.ndarray, people: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts: hits with a second-person word at most NEAR tokens away, and the most hits in WINDOW tokens."""
    near = np.zeros(len(hits), bool)
    if len(people):
        for side in (-1, 0):
            at = np.clip(np.searchsorted(people, hits) + side, 0, len(people) - 1)
            near |= (np.abs(people[at] - hits) <= NEAR) & (of[people[at]] == of[hits])
    most = np.zeros(n)
    if len(hits):
        reach = np.searchsorted(hits, np.minimum(hits + WINDOW, np.searchsorted(of, of[hits], "right")), "left") - np.arange(len(hits))
        np.maximum.at(most, of[hits], reach)
    return np.bincount(of[hits[near]], minlength=n).astype(float), most


def _sums(buf: np.ndarray, offsets: np.ndarray, lexicon: dict[int, np.ndarray], limit: int):
    """Counts, near hits and most hits of each text of a slice; a slice of one text beyond ``limit`` is read in pieces."""
    n = len(offsets) - 1
    if n > 1 or len(buf) <= 2 * limit:
        counts, hits, people, of = _counts(buf, offsets, lexicon)
        return counts, *_windows(hits, people, of, n)
    counts, hits, people, seen = 0.0, [], [], 0
    for piece in _pieces(buf, limit):
        own, h, p, of = _counts(piece, np.array([0, len(piece)]), lexicon)
        counts = counts + own
        hits.append(h + seen)
        people.append(p + seen)
        seen += len(of)
    return counts, *_windows(np.concatenate(hits), np.concatenate(people), np.zeros(seen, np.int8), 1)


_N_KINDS = 1 + len(STEMS)


def features(buf: np.ndarray, offsets: np.ndarray, lexicon: dict[int, np.ndarray], limit: int = SLICE_BYTES) -> np.ndarray:
    """One row of FEATURES for each text of a batch."""
    out = []
    for a, b in slices(offsets, limit):
        part, off = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        sums, near, most = _sums(part, off, lexicon, limit)
        words, per = sums[:, 0], 1 / np.maximum(sums[:, 0], 1)
        per_byte = 1 / np.maximum(np.diff(off), 1)
        kinds = sums[:, 2 : 2 + _N_KINDS]
        hits, second = sums[:, 2 + _N_KINDS], sums[:, 3 + _N_KINDS]
        caps, twice, stretched, disguised, inner = (sums[:, 4 + _N_KINDS + k] for k in range(5))
        marks = sums[:, 9 + _N_KINDS : 9 + _N_KINDS + len(_MARKS)]
        pairs = [c for k in range(_N_KINDS) for c in (kinds[:, k], kinds[:, k] * per)]
        out.append(np.stack([
            np.log1p(words), sums[:, 1] * per, *pairs, hits, hits * per, most, second * per, near, *(marks * per_byte[:, None]).T,
            caps * per, twice * per, stretched * per, disguised, inner * per,
        ], axis=1))
    return np.vstack(out) if out else np.zeros((0, len(FEATURES)))


# ---------------------------------------------------------------- fitting


def _fold(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(int)


_COUNTS = [f"{c}{h}" for h in range(FOLDS) for c in "nt"]


def _lexicon_counts(batches):
    """kind, key -> other (n) and toxic (t) documents, by fold; each document counts once for a key."""
    for batch in batches:
        buf, off = text_buffer(batch.column("text"))
        fold, y = _fold(batch.column("doc_id").to_numpy()), batch.column("y").to_numpy()
        for a, b in slices(off):
            starts, ends, of, low = _tokens(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            for kind, (number, hashes) in _keys(low, starts, ends).items():
                pairs = np.unique(np.stack([hashes, (of[number] + a).astype(np.uint64)], axis=1), axis=0)
                key, at = np.unique(pairs[:, 0], return_inverse=True)
                doc = pairs[:, 1].astype(int)
                cells = np.bincount(at * 2 * FOLDS + fold[doc] * 2 + (y[doc] > 0), minlength=2 * FOLDS * len(key)).reshape(-1, 2 * FOLDS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), kind)), pa.array(key.view(np.int64)), *(pa.array(c) for c in cells.T)], ["kind", "key", *_COUNTS]
                )


def _chosen(counts: DataFrame, totals: dict, variants: list[list[int]]) -> list[dict[int, np.ndarray]]:
    """For each list of folds, the keys that stand in toxic documents of those folds by LOG_ODDS and LEAST_RATIO.

    One pass chooses for all lists. The keys are some of those of the bounded sample.
    """
    stands = []
    for folds in variants:
        t, n = (sum((F.col(f"{c}{h}") for h in folds), F.lit(0)) for c in "tn")
        all_t, all_n = (float(sum(totals[h, v] for h in folds)) for v in (True, False))
        share = max(all_t, 0.5) / max(all_t + all_n, 1.0)
        odds = F.log((t + 0.5) / F.lit(all_t + 1.0)) - F.log((n + 0.5) / F.lit(all_n + 1.0))
        ratio = 2 * (t * F.log(F.greatest(t, F.lit(1)) / ((t + n) * share)) + n * F.log(F.greatest(n, F.lit(1)) / ((t + n) * (1 - share))))
        stands.append(F.when(t > 0, (odds >= LOG_ODDS) & (ratio >= LEAST_RATIO)).otherwise(False))
    rows = counts.select("kind", "key", F.array(*stands).alias("stands")).where(F.exists("stands", lambda v: v)).collect()
    keys = lambda k, kind: np.sort(np.array([r.key for r in rows if r.kind == kind and r.stands[k]], np.int64).view(np.uint64))
    return [{kind: keys(k, kind) for kind in (0, *STEMS)} for k in range(len(variants))]


def _sample_features(lexicons: list[dict]):
    """Features of sample rows, each with the lexicon of the other folds."""

    def run(batches):
        for batch in batches:
            fold = _fold(batch.column("doc_id").to_numpy())
            for h, lexicon in enumerate(lexicons):
                part = batch.filter(pa.array(fold == h))
                if part.num_rows:
                    x = features(*text_buffer(part.column("text")), lexicon)
                    yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(np.full(len(x), h)), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "fold", "x"])

    return run


class Model:
    """A lexicon, trees and a calibration."""

    def __init__(self, lexicon, trees: gbdt.Trees, steps: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.trees, self.steps = lexicon, trees, steps

    def predict(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = self.trees.predict(features(buf, offsets, self.lexicon))
        return np.interp(raw, *self.steps) * 0.999 + raw * 0.001 if len(self.steps[0]) else raw


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model fitted on at most ``sample_rows`` labelled rows; their texts stay off the driver.

    The sample and its counts are written once, so a lost executor costs no second search for them.
    """
    sample = materialise(labelled_sample(docs, labels, label, id_col, text_col, sample_rows), "toxic-sample")
    counts = sample.mapInArrow(_lexicon_counts, ", ".join(f"{c} long" for c in ("kind", "key", *_COUNTS)))
    seen = sum((F.col(c) for c in _COUNTS[1::2]), F.lit(0))
    counts = counts.groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in _COUNTS)).where(seen > 1)
    ids = sample.select("doc_id", "y").toArrow()
    fold, ys = _fold(ids.column("doc_id").to_numpy()), ids.column("y").to_numpy()
    totals = {(h, v): int(((fold == h) & ((ys > 0) == v)).sum()) for h in range(FOLDS) for v in (True, False)}
    every = list(range(FOLDS))
    *own, lexicon = _chosen(counts, totals, [*([h for h in every if h != out] for out in every), every])
    rows = sample.mapInArrow(_sample_features(own), "y int, fold long, x array<double>").toArrow()
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y, fold = rows.column("y").to_numpy().astype(float), rows.column("fold").to_numpy()
    order = np.lexsort((*x.T, fold, y))  # the same sums whatever order the rows came in
    x, y, fold = x[order], y[order], fold[order]
    settings = {"trees": 60, "depth": 3}
    apart = np.zeros(len(y))
    for h in every:
        if (fold == h).any():
            apart[fold == h] = gbdt.fit(x[fold != h], y[fold != h], **settings).predict(x[fold == h])
    return Model(lexicon, gbdt.fit(x, y, **settings), gbdt.isotonic(apart, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: the calibrated probability of label 1, for every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.predict(*text_buffer(batch.column(1))))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``least`` on)."""
    scored = score(docs, fit(docs, labels, sample_rows=sample_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
