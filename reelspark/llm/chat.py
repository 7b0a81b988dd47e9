r"""Chat formatting by schema fingerprints.

A record's layout is its sorted nested field paths with their types; the SHA-256 of
that list is its fingerprint. A registry maps fingerprints to declarative mappings,
which say where the turns are: a list of messages, a prompt with its answer, an
instruction with an optional input and output, or one row for each turn. All of them
yield canonical turns (conv_id, turn, role, text), which one template formats.

Template: ``<|role|>\n`` + text + ``<|end|>\n`` for each turn. In roles and texts a
backslash follows every ``<``, ``[`` and backslash, and in roles every ``|``, so no
control string of this or another template can stand in the output; taking these
backslashes out again restores the text. The loss mask is a list of spans of code points: assistants' texts.

The formatted conversation is kept as one segment for each turn, in order: its text
is their concatenation. A conversation of any length streams through a sorted
partition, and no task holds one whole.

Defined results: null text or role is empty; turns are in the order of ``turn`` (null
first), ties by role, then text; rows may repeat. Rows with a null conv_id form one
conversation. An empty table gives no conversation. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "<|end|>\n"
ASSISTANT = "assistant"
_ESCAPE, _ESCAPE_ROLE = r"([<\[\\])", r"([<\[\\|])"
_SEGMENT = re.compile(r"<\|((?:[^<\[\\|]|[<\[\\|]\\)*)\|>\n((?:[^<\[\\]|[<\[\\]\\)*)<\|end\|>\n", re.S)


# ---------------------------------------------------------------- fingerprints and mappings


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths with leaf types; ``[]`` stands for a list's elements."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [f"{at}:{kind.simpleString()}"]


def fingerprint(kind: T.DataType | list[str]) -> str:
    """SHA-256 of a layout's field paths, whatever their order."""
    paths = kind if isinstance(kind, list) else field_paths(kind)
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: name -> (paths that make up the layout, mapping); a mapping is declarative: a kind and its field names
LAYOUTS: dict[str, tuple[list[str], dict]] = {
    "turn_rows": (["role:string", "text:string", "turn:bigint"], {"kind": "row", "turn": "turn", "role": "role", "text": "text"}),
    "messages": (["messages[].content:string", "messages[].role:string"], {"kind": "list", "list": "messages", "role": "role", "text": "content"}),
    "conversations": (["conversations[].from:string", "conversations[].value:string"], {"kind": "list", "list": "conversations", "role": "from", "text": "value"}),
    "prompt_response": (["prompt:string", "response:string"], {"kind": "fields", "turns": [("user", ["prompt"]), (ASSISTANT, ["response"])]}),
    "prompt_completion": (["completion:string", "prompt:string"], {"kind": "fields", "turns": [("user", ["prompt"]), (ASSISTANT, ["completion"])]}),
    "instruction": (["input:string", "instruction:string", "output:string"], {"kind": "fields", "turns": [("user", ["instruction", "input"]), (ASSISTANT, ["output"])]}),
    "instruction_system": (
        ["input:string", "instruction:string", "output:string", "system:string"],
        {"kind": "fields", "turns": [("system", ["system"]), ("user", ["instruction", "input"]), (ASSISTANT, ["output"])]},
    ),
}
REGISTRY = {fingerprint(paths): (name, mapping) for name, (paths, mapping) in LAYOUTS.items()}
#: names of roles in other layouts
ROLES = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}


def canonical_turns(records: DataFrame, id_col: str = "conv_id", layout_cols: list[str] | None = None) -> DataFrame:
    """conv_id, turn, role, text of records in any registered layout.

    The layout is the fingerprint of ``layout_cols`` (default: all columns but the
    id); an unknown one raises. Absent and null optional parts of a prompt are left
    out; a turn whose parts are all null is an empty turn, but an absent system text
    gives no turn.
    """
    cols = layout_cols or [c for c in records.columns if c != id_col]
    schema = T.StructType([records.schema[c] for c in cols])
    found = REGISTRY.get(fingerprint(schema))
    if found is None:
        raise ValueError(f"no mapping for a record with the fields {field_paths(schema)}")
    _, mapping = found
    conv = F.col(id_col).cast("long").alias("conv_id")
    if mapping["kind"] == "row":
        return records.select(conv, F.col(mapping["turn"]).alias("turn"), F.coalesce(mapping["role"], F.lit("")).alias("role"), F.coalesce(mapping["text"], F.lit("")).alias("text"))
    if mapping["kind"] == "list":
        turns = records.select(conv, F.posexplode(mapping["list"]).alias("turn", "m"))
        role, text = F.col(f"m.{mapping['role']}"), F.col(f"m.{mapping['text']}")
        for old, new in ROLES.items():
            role = F.when(role == old, new).otherwise(role)
        return turns.select(conv, F.col("turn").cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    parts = []
    for k, (role, fields) in enumerate(mapping["turns"]):
        text = F.concat_ws("\n\n", *(F.when(F.col(f) != "", F.col(f)) for f in fields))
        turn = F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text"))
        parts.append(F.when(F.lit(role != "system") | (text != ""), turn))
    turns = records.select(conv, F.explode(F.filter(F.array(*parts), lambda t: t.isNotNull())).alias("t"))
    return turns.select("conv_id", "t.turn", "t.role", "t.text")


def mixed_turns(texts: DataFrame, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """conv_id, turn, role, text of JSON records whose layouts differ from row to row.

    The fingerprint is computed for each record from its top-level keys and the keys
    of its lists' elements; a record of an unknown layout yields no turn (see
    ``unknown_layouts``).
    """
    tagged = texts.select(F.col(id_col).cast("long").alias("conv_id"), F.col(json_col).alias("json")).withColumn("layout", _json_layout(F.col("json")))
    out = None
    for name, (paths, _) in LAYOUTS.items():
        schema = _schema_of(paths)
        part = tagged.where(F.col("layout") == fingerprint(_untyped(paths))).select("conv_id", F.from_json("json", schema).alias("r")).select("conv_id", "r.*")
        turns = canonical_turns(part, "conv_id")
        out = turns if out is None else out.unionByName(turns)
    return out


def unknown_layouts(texts: DataFrame, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """The records of ``mixed_turns`` that no mapping fits, with their fingerprints."""
    known = [fingerprint(_untyped(paths)) for paths, _ in LAYOUTS.values()]
    tagged = texts.select(F.col(id_col).cast("long").alias("conv_id"), _json_layout(F.col(json_col)).alias("layout"))
    return tagged.where(F.col("layout").isNull() | ~F.col("layout").isin(known))


def _untyped(paths: list[str]) -> list[str]:
    return [p.split(":")[0] for p in paths]


def _json_layout(json: Column) -> Column:
    """SHA-256 of a JSON record's sorted key paths, two levels deep."""
    keys = F.json_object_keys(json)

    # the path of get_json_object must be a literal, so every registered list is asked for by name
    lists = sorted({p.split("[]")[0] for layout, _ in LAYOUTS.values() for p in layout if "[]" in p})
    named = {name: F.json_object_keys(F.get_json_object(json, f"$.{name}[0]")) for name in lists}

    def expand(k):
        out = F.array(k)
        for name, inner in named.items():
            out = F.when((k == name) & inner.isNotNull(), F.transform(inner, lambda i: F.concat(F.lit(f"{name}[]."), i))).otherwise(out)
        return out

    return F.sha2(F.array_join(F.array_sort(F.flatten(F.transform(keys, expand))), "\n"), 256)


def _schema_of(paths: list[str]) -> T.StructType:
    flat = [p.split(":") for p in paths if "[]" not in p]
    nested: dict[str, list] = {}
    for p in paths:
        if "[]." in p:
            name, rest = p.split("[].")
            nested.setdefault(name, []).append(rest.split(":"))
    ddl = [f"`{n}` {k}" for n, k in flat] + [f"`{n}` array<struct<{','.join(f'`{a}`:{k}' for a, k in inner)}>>" for n, inner in nested.items()]
    return T._parse_datatype_string(", ".join(ddl))


# ---------------------------------------------------------------- template


def escape(text: Column, which: str = _ESCAPE) -> Column:
    return F.regexp_replace(text, which, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE + r"\\", "$1")


def _plain(text: str, which: str = _ESCAPE) -> str:
    return re.sub(which + r"\\", r"\1", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, segment, loss_from, loss_to: a formatted segment for each turn.

    The loss span is in code points of the segment, end exclusive; empty (0, 0) for
    turns that are not the assistant's.
    """
    head = F.concat(F.lit("<|"), escape(F.col("role"), _ESCAPE_ROLE), F.lit("|>\n"))
    body = escape(F.col("text"))
    lossy = F.col("role") == ASSISTANT
    return turns.select(
        "conv_id", "turn", "role", "text", F.concat(head, body, F.lit(END)).alias("segment"),
        F.when(lossy, F.char_length(head)).otherwise(0).alias("loss_from"), F.when(lossy, F.char_length(head) + F.char_length(body)).otherwise(0).alias("loss_to"),
    )


def read_back(segment: str) -> list[tuple[str, str]]:
    """The turns (role, text) of formatted text."""
    out, at = [], 0
    for m in _SEGMENT.finditer(segment):
        if m.start() != at:
            break
        out.append((_plain(m[1], _ESCAPE_ROLE), _plain(m[2])))
        at = m.end()
    if at != len(segment):
        raise ValueError("the text does not follow the template")
    return out


def _read(batches):
    """Formatted segments, read back where they were made: each turn, and the text under its loss mask."""
    for batch in batches:
        rows = []
        for conv, turn, segment, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "segment", "loss_from", "loss_to"))):
            [(role, text)] = read_back(segment)
            learnt = segment[a:b]
            rows.append((conv, turn, role, text, _plain(learnt) if b > a else None, len(segment)))
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _READ)] if rows else [pa.array([], f.type) for f in _READ], schema=_READ)


_READ = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("learnt", pa.string()), ("chars", pa.int64())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digests(batches):
    """Streams sorted turns: state is one conversation's running hashes, not its text."""
    now, state, out = None, None, []

    def closed():
        return {"conv_id": now, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

    for batch in batches:
        for conv, role, text, learnt, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "learnt", "chars"))):
            if state is None or conv != now:
                if state is not None:
                    out.append(closed())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if learnt is not None:
                state[2] += len(learnt)
                state[3].update(learnt.encode())
            state[4] += chars
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist(out, _DIGESTS)
            out = []
    if state is not None:
        out.append(closed())
    if out:
        yield pa.RecordBatch.from_pylist(out, _DIGESTS)


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Digests of every conversation, read back from its formatted segments.

    Segments are read back before the exchange, in parallel. The digest of a conversation is
    one serial hash, so one task hashes all turns of a conversation, streaming them in order; that is
    the limit for a conversation that holds a large share of all turns.
    """
    read = segments.select("conv_id", F.col("turn").cast("long").alias("turn"), "segment", "loss_from", "loss_to").mapInArrow(
        _read, "conv_id long, turn long, role string, text string, learnt string, chars long"
    )
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text", "learnt", "chars").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
