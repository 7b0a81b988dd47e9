"""Secret scans in DataFrame operations only.

Base rules are three patterns, matched leftmost and without overlap. Beside them,
candidate strings of three character classes (hexadecimal digits, letters of one case
with digits, base-64 letters) are judged by the Shannon entropy of a sliding window: a
window's counts and its sum of n log2 n are updated for the letter that enters and
the one that leaves. Candidates whose best window reaches the class's threshold become
spans, unless the allow-list suppresses them: strings that lack one of the class's kinds of
letters (``NEEDED``), and placeholders. Candidates are sought in what base matches
leave: base matches are blanked first (assignments, then access keys, then hexadecimal
runs), so no added span overlaps one of them and the rest of a long string around one is
still judged. The sums are in fixed point, so results do not depend on the order
of additions.

Cost: an entropy step changes one count, held as one character of a short string, so a
candidate costs in proportion to its length; it is walked in blocks of ``WALK`` letters that
overlap by a window, so memory is bounded too. Matches are placed by running sums in
blocks of ``BLOCK``: n matches cost n * BLOCK / 2 + (n / BLOCK)^2 / 2 copied numbers.

Positions are code points; ends are exclusive. Null text is empty and has no span.
Whole texts are scanned. Rows pass one by one, so ids may repeat or be null, and no
group can be hot; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: class -> (candidates, alphabet, window, least bits a letter); the first two are folded to lower case
CLASSES = {
    "hexent": (r"[0-9A-Fa-f]{20,}", _DIGITS + "abcdef", 20, 3.0),
    "b32ent": (r"[A-Z0-9]{24,}|[a-z0-9]{24,}", _LOWER + _DIGITS, 24, 3.7),
    "b64ent": (r"[A-Za-z0-9+/_=-]{24,}", _LOWER.upper() + _LOWER + _DIGITS + "+/_=-", 24, 3.9),
}
FOLDED = ("hexent", "b32ent")
#: class -> the kinds of letters that a suspicious string has all of
NEEDED = {"hexent": ("[0-9]", "[A-Za-z]"), "b32ent": ("[0-9]", "[A-Za-z]"), "b64ent": ("[0-9]", "[a-z]", "[A-Z]")}
#: fixed values: published sample credentials and placeholders, lower case
ALLOWED = ("example", "sample", "placeholder", "changeme", "your_", "xxxxxxxx", "0123456789abcdef", "abcdefghijkl", "deadbeef")
SCALE = 1 << 20


BLOCK = 512
WALK = 1 << 18

KINDS = ("assign", "access", "hex", *CLASSES)
_SPANS = "cast(array() as array<struct<m:string,s:int,e:int>>)"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is referred to."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _short_running(values: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    step = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"] + v)).alias("out"))
    return F.aggregate(values, start, step, lambda acc: acc["out"])


def running(values: Column) -> Column:
    """Running sums of an array of int, block by block."""

    def of_blocks(blocks):
        before = _short_running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda x, v: x + v)))
        shifted = F.concat(F.array(F.lit(0)), before)
        inner = F.zip_with(blocks, F.slice(shifted, 1, F.size(blocks)), lambda b, s: F.transform(_short_running(b), lambda v: v + s))
        return F.flatten(inner)

    def cut(v):
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))

    return F.when(F.size(values) > 0, _bound(_bound(values, cut), of_blocks)).otherwise(F.expr("cast(array() as array<int>)"))


def _located(text: Column, found: Column, pattern: str) -> Column:
    """Array of (m, s, e): the matches ``found`` of a pattern, placed by the gaps between them."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    ends = running(F.zip_with(found, gaps, lambda m, g: F.char_length(g) + F.char_length(m)))
    placed = F.zip_with(found, ends, lambda m, e: F.struct(m.alias("m"), (e - F.char_length(m)).alias("s"), e.alias("e")))
    return F.when(F.size(found) > 0, placed).otherwise(F.expr(_SPANS))


def _blanked(text: Column, pattern: str, counts=None) -> Column:
    """The text with spaces instead of a pattern's matches (those that ``counts`` lets through)."""

    def one(gap, m):
        spaces = F.repeat(F.lit(" "), F.char_length(m))
        return F.concat(gap, F.coalesce(spaces if counts is None else F.when(counts(m), spaces).otherwise(m), F.lit("")))

    return _bound(text, lambda t: F.array_join(F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), one), ""))


def _long_enough(m: Column) -> Column:
    return F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8


def nlogn(window: int) -> list[int]:
    """n log2 n in fixed point, for n from 0."""
    return [0] + [round(n * math.log2(n) * SCALE) for n in range(1, window + 1)]


def most_allowed(window: int, bits: float) -> int:
    """A window's entropy is at least ``bits`` when its sum of n log2 n is at most this."""
    return math.floor((math.log2(window) - bits) * window * SCALE)


def _least_sum(candidate: Column, alphabet: str, window: int) -> Column:
    """The least sum of n log2 n over a candidate's windows: that of the highest entropy.

    Letters enter one by one; once a window is full its sum is noted and its first letter
    leaves. The count of letter k of the alphabet is character k of a string.
    """
    table = F.array(*(F.lit(v).cast("long") for v in nlogn(window)))
    none = 65  # the character that stands for a count of 0
    start = F.struct(F.lit(chr(none) * len(alphabet)).alias("n"), F.lit(0).cast("long").alias("total"), F.lit(1 << 62).cast("long").alias("best"))

    def step(state, move):
        """``move``: the number of the letter that enters, or less that of the one that leaves."""
        letter = F.abs(move)
        come = F.when(move > 0, 1).otherwise(-1)
        n = F.ascii(F.substring(state["n"], letter, F.lit(1))) - none
        return F.struct(
            F.overlay(state["n"], F.char(n + come + none), letter, F.lit(1)).alias("n"),
            (state["total"] + F.get(table, n + come) - F.get(table, n)).alias("total"),
            F.when(move < 0, F.least(state["best"], state["total"])).otherwise(state["best"]).alias("best"),
        )

    def walk(letters):
        moves = F.transform(letters, lambda c, k: F.when(k >= window - 1, F.array(c, -F.get(letters, k - (window - 1)))).otherwise(F.array(c)))
        return F.aggregate(F.flatten(moves), start, step, lambda s: s["best"])

    def block(k):
        part = F.substring(candidate, k * WALK + 1, F.lit(WALK + window - 1))
        return _bound(F.transform(F.filter(F.split(part, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c)), walk)

    last = F.floor(F.greatest(F.char_length(candidate) - window, F.lit(0)) / WALK).cast("int")
    return F.array_min(F.transform(F.sequence(F.lit(0), last), block))


def _suspicious(spans: Column, kind: str) -> Column:
    """The candidates of a class that its entropy threshold and the allow-list let through."""
    _, alphabet, window, bits = CLASSES[kind]

    def suspect(x):
        low = F.lower(x["m"])
        good = F.lit(True)
        for letters in NEEDED[kind]:
            good = good & x["m"].rlike(letters)
        for word in ALLOWED:
            good = good & ~F.contains(low, F.lit(word))
        return F.when(good, _least_sum(low if kind in FOLDED else x["m"], alphabet, window) <= most_allowed(window, bits)).otherwise(False)

    return F.filter(spans, suspect)


def _joined(spans: Column) -> Column:
    """kind:start:end of (s, k, e), in their order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id; n_assign, n_access, n_hex; ``base`` and ``found``: arrays of (s, k, e), k an index into KINDS."""
    base = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"f_{k}") for k, p in base.items()))
    blank = _blanked(_blanked(_blanked(F.col("text"), ASSIGN, _long_enough), ACCESS), HEX)
    rest = F.when(F.size("f_assign") + F.size("f_access") + F.size("f_hex") > 0, blank).otherwise(F.col("text"))
    rows = rows.select("doc_id", rest.alias("rest"), *(_located(F.col("text"), F.col(f"f_{k}"), p).alias(k) for k, p in base.items()))
    rows = rows.select("*", *(F.regexp_extract_all("rest", F.lit(v[0]), F.lit(0)).alias(f"f_{k}") for k, v in CLASSES.items()))
    rows = rows.select("doc_id", *base, *(_located(F.col("rest"), F.col(f"f_{k}"), v[0]).alias(k) for k, v in CLASSES.items()))
    rows = rows.withColumn("assign", F.filter("assign", lambda x: _long_enough(x["m"])))

    def listed(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))

    rows = rows.withColumn("base", F.concat(*map(listed, KINDS[:3])))
    for kind in CLASSES:
        rows = rows.withColumn(kind, F.when(F.size(kind) > 0, _suspicious(F.col(kind), kind)).otherwise(F.expr(_SPANS)))
    found = F.concat(*map(listed, KINDS[3:]))
    return rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), "base", found.alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """The spans of ``scan`` as text, with the digest of the base spans."""
    return scanned.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "found")).alias("spans"),
    )
