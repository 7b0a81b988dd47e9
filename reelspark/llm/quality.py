"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted in numpy over the bytes of a whole batch: classes of
characters, words and their shapes, lines, and repetition (shares of distinct words and
word pairs, words equal to the one before, the most frequent word). Ids, language,
source and labels are no inputs. The trees are fitted on a bounded labelled sample
(``labelled.SAMPLE_ROWS`` rows, a parameter), then every whole text is scored.

Defined results: null and empty texts have all statistics 0 and are scored like any
other; repeated rows get equal scores; other columns are not read. Without any
labelled row the score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbdt
from .common import SLICE_BYTES, _pieces, lower_bytes, mix, slices, span_hashes, text_buffer, word_spans
from .labelled import SAMPLE_ROWS, held_out, labelled_sample

#: classes of bytes; bytes over 127 are letters of other alphabets or parts of them
CLASS_NAMES = ("other", "upper", "lower", "digit", "space", "newline", "stop", "comma", "exclaim", "bar", "bracket", "quote", "symbol", "high")
_CLASS = np.zeros(256, np.uint8)
for _chars, _name in (
    (range(65, 91), "upper"), (range(97, 123), "lower"), (range(48, 58), "digit"), (b" \t", "space"), (b"\n\r\x0b\x0c", "newline"), (b".", "stop"), (b",;:", "comma"),
    (b"!?", "exclaim"), (b"|", "bar"), (b"()[]{}<>", "bracket"), (b"'\"`", "quote"), (b"#$%&*+-/=@\\^_~", "symbol"), (range(128, 256), "high"),
):
    _CLASS[list(_chars)] = CLASS_NAMES.index(_name)
_K = len(CLASS_NAMES)
_LETTER = np.isin(_CLASS, [CLASS_NAMES.index(c) for c in ("upper", "lower", "high")])
_UPPER = _CLASS == CLASS_NAMES.index("upper")
WORD_NAMES = ("words", "word_bytes", "word_squares", "short", "long", "odd_end", "capital", "all_caps", "no_letter")
RATIO_NAMES = ("distinct", "distinct_pairs", "repeats", "top_word", "second_half_new")
FEATURES = ("log_bytes", "log_words", *(f"c_{c}" for c in CLASS_NAMES), "mean_word", "word_sd", *(f"w_{w}" for w in WORD_NAMES[3:]), "line_words", *RATIO_NAMES)


def _counts(buf: np.ndarray, offsets: np.ndarray):
    """Additive counts of each text of a slice, its word hashes and their offsets."""
    n = len(offsets) - 1
    of = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    classes = np.bincount(of * np.int32(_K) + _CLASS[buf], minlength=n * _K).reshape(n, _K)
    low = lower_bytes(buf)
    starts, ends = word_spans(buf, offsets)
    size = ends - starts
    upper = np.concatenate([[0], np.cumsum(_UPPER[buf])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    has = letters[ends] - letters[starts]
    caps = upper[ends] - upper[starts]
    word_of = of[starts]
    columns = (np.ones(len(size)), size, size.astype(float) ** 2, size <= 3, size > 12, ~_LETTER[buf[ends - 1]], _UPPER[buf[starts]], (caps == has) & (has > 1), has == 0)
    words = np.stack([np.bincount(word_of, c.astype(float), n) for c in columns], axis=1) if len(size) else np.zeros((n, len(columns)))
    return np.hstack([classes, words]), span_hashes(low, starts, ends), np.searchsorted(starts, offsets)


def _repetition(h: np.ndarray) -> tuple[float, ...]:
    """Shares of distinct words and pairs, of repeats, of the top word; new words in the second half."""
    n = len(h)
    if not n:
        return (0.0,) * len(RATIO_NAMES)
    _, first, count = np.unique(h, return_index=True, return_counts=True)
    pairs = np.unique(mix(h[:-1]) + h[1:]) if n > 1 else h
    return len(first) / n, len(pairs) / max(1, n - 1), float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0, count.max() / n, float((first >= n // 2).sum() / max(1, n - n // 2))


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a batch."""
    out = []
    for a, b in slices(offsets):
        part, off = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if b == a + 1 and len(part) > 2 * SLICE_BYTES:  # one very long text: its counts add up over pieces
            each = [_counts(p, np.array([0, len(p)])) for p in _pieces(part, SLICE_BYTES)]
            counts, hashes = sum(e[0] for e in each), np.concatenate([e[1] for e in each])
            at = np.array([0, len(hashes)])
        else:
            counts, hashes, at = _counts(part, off)
        ratios = np.array([_repetition(hashes[i:j]) for i, j in zip(at[:-1], at[1:])]).reshape(-1, len(RATIO_NAMES))
        size = np.diff(off).astype(float)
        words = counts[:, _K]
        per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
        mean = counts[:, _K + 1] * per_word
        sd = np.sqrt(np.maximum(0, counts[:, _K + 2] * per_word - mean**2))
        lines = counts[:, CLASS_NAMES.index("newline")] + 1
        out.append(np.hstack([
            np.log1p(size)[:, None], np.log1p(words)[:, None], counts[:, :_K] * per_byte[:, None], mean[:, None], sd[:, None],
            counts[:, _K + 3 :] * per_word[:, None], np.log1p(words / lines)[:, None], ratios,
        ]))
    return np.vstack(out) if out else np.zeros((0, len(FEATURES)))


def _feature_rows(batches):
    for batch in batches:
        x = features(*text_buffer(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> gbdt.Trees:
    """Trees fitted on at most ``sample_rows`` rows; only their numbers reach the driver."""
    sample = labelled_sample(docs, labels, label, id_col, text_col, sample_rows)
    rows = sample.mapInArrow(_feature_rows, "y int, x array<double>").toArrow()
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = rows.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same sums whatever order the rows came in
    return gbdt.fit(x[order], y[order])


def score(docs: DataFrame, model: gbdt.Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: the probability of label 1, for every row."""

    def run(batches):
        for batch in batches:
            p = model.predict(features(*text_buffer(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: gbdt.Trees, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, in one pass and with all their columns.

    They go back a slice at a time, so neither side holds a second batch of whole rows.
    """
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(place))
            for a, b in slices(offsets):
                yield batch.slice(a, b - a).filter(pa.array(model.predict(features(buf, offsets[a : b + 1])) >= least))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``least`` on)."""
    scored = score(docs, fit(docs, labels, sample_rows=sample_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
