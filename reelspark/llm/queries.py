"""The registered queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, licenses, near_dedup, pieces, quality, secrets, sharding, toxicity
from .common import materialise, table

SHARDS = 24


CLASH = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"select -7L as conv_id, t.* from values (0L, 'user', '{CLASH}'), (1L, 'assistant', '{CLASH}') as t(turn, role, text)")
    turns = chat.canonical_turns(rows.unionByName(extra), "conv_id")
    return chat.conversation_digests(chat.format_turns(turns))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), least=0.3)


#: lines that name a licence, for the rule of the stand-in below
STATED = r"(?i)licen[sc]|spdx|copyright|permission is hereby|redistribution and use|redistribute it|public domain|unencumbered"


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``. The table has no file names, so a document that
    is mostly licence statement (half of its words, or more, stand in lines that name a licence)
    stands for its directory's licence file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    words = licenses.terms(F.coalesce("text", F.lit("")))
    stated = F.flatten(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(STATED)), licenses.terms))
    mostly = F.when(F.col("text").rlike(STATED), F.size(stated) * 2 >= F.size(words)).otherwise(False)
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    found = licenses.scan(docs, path, F.col("text"), mostly)
    return found.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "path", "license", "similarity", "origin", "from_dir")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), least=0.5)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), pieces.load())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash")
    )
    rows = materialise(rows, "shard-keys")  # the counting rounds then read no text
    placed = sharding.shard_by_bytes(rows, [F.col("text_hash"), F.col("doc_id")], F.col("size"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def _secrets_sql() -> str:
    """The scan in SQL: matches placed by the gaps between them, entropies counted anew for each window."""
    base = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX}
    quoted = {k: "'" + v.replace("'", "''") + "'" for k, v in (base | {k: v[0] for k, v in secrets.CLASSES.items()}).items()}
    cut = lambda t, kinds: ", ".join(f"regexp_extract_all({t}, {quoted[k]}) as m_{k}, regexp_split_to_array({t}, {quoted[k]}) as g_{k}" for k in kinds)
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
    placed = lambda kinds: ", ".join(
        f"list_transform(range(1, len(m_{k}) + 1), lambda i: {{'m': m_{k}[i], 's': ({total(f'g_{k}[1:i]')} + {total(f'm_{k}[1:i - 1]')})::bigint}}) as {k}" for k in kinds
    )
    spans = lambda k: f"list_transform({k}, lambda x: {{'s': x.s, 'k': {secrets.KINDS.index(k)}, 'e': x.s + length(x.m)}})"
    enough = lambda m: f"length(regexp_extract({m}, {quoted['assign']}, 2)) >= 8"

    def blanked(t: str, kind: str) -> str:
        g, m = f"regexp_split_to_array({t}, {quoted[kind]})", f"regexp_extract_all({t}, {quoted[kind]})"
        spaces = "repeat(' ', length(m[i]))"
        one = f"case when {enough('m[i]')} then {spaces} else m[i] end" if kind == "assign" else spaces
        return f"(select array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce({one}, '')), '') from (select {g} as g, {m} as m))"

    def suspects(kind: str) -> str:
        _, _, window, bits = secrets.CLASSES[kind]
        low = "lower(x.m)" if kind in secrets.FOLDED else "x.m"
        tests = [f"regexp_matches(x.m, '{r}')" for r in secrets.NEEDED[kind]] + [f"not contains(lower(x.m), '{w}')" for w in secrets.ALLOWED]
        count = f"{secrets.nlogn(window)}[length(w) - length(replace(w, c, '')) + 1]"
        windows = f"list_transform(range(1, length(x.m) - {window} + 2), lambda i: substring({low}, i, {window}))"
        least = f"list_min(list_transform({windows}, lambda w: list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: {count}))))"
        return f"list_filter({kind}, lambda x: {' and '.join(tests)} and {least} <= {secrets.most_allowed(window, bits)})"

    names = str(list(secrets.KINDS))
    joined = lambda x: f"coalesce(array_to_string(list_transform(list_sort({x}), lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ','), '')"
    added = "base"
    for k in secrets.CLASSES:
        added = f"list_concat({added}, e_{k})"
    listed = ", ".join(spans(k).replace(f"list_transform({k},", f"list_transform(s_{k},") + f" as e_{k}" for k in secrets.CLASSES)
    return f"""
        with t as (select doc_id, coalesce(text, '') as t from documents),
        t1 as (select doc_id, t, {blanked('t', 'assign')} as r from t), t2 as (select doc_id, t, {blanked('r', 'access')} as r from t1),
        t3 as (select doc_id, t, {blanked('r', 'hex')} as r from t2),
        g as (select doc_id, {cut('t', base)}, {cut('r', secrets.CLASSES)} from t3), p as (select doc_id, {placed(quoted)} from g),
        a as (select * replace (list_filter(assign, lambda x: {enough('x.m')}) as assign) from p),
        b as (select *, list_concat(list_concat({spans('assign')}, {spans('access')}), {spans('hex')}) as base from a),
        f as (select *, {', '.join(f'{suspects(k)} as s_{k}' for k in secrets.CLASSES)} from b),
        e as (select *, {listed} from f)
        select doc_id, len(assign) as n_assign, len(access) as n_access, len(hex) as n_hex, sha256({joined('base')}) as base_sha256,
               {joined(added)} as spans from e
    """


def _licenses_sql() -> str:
    """The licence scan in SQL; paths have one shape here, so the only directory with files is source/lang."""
    terms = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '{licenses.TERM_GAP}'), lambda x: x <> '')"
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    templates = ", ".join(f"({k}, {quote(name)}, {quote(text)})" for k, (name, text) in enumerate(licenses.TEMPLATES))
    return f"""
        with d as (select doc_id, concat_ws('/', source, lang) as dir, coalesce(text, '') as t, {terms("coalesce(text, '')")} as ws from documents),
        n as (select count(*)::double as n from d),
        tt as (select tid, license, term, count(*) as tf from (select tid, license, unnest({terms("text")}) as term from (values {templates}) v(tid, license, text)) group by all),
        df as (select term, count(*) as df from (select distinct doc_id, unnest(ws) as term from d) group by 1),
        tv as (select tid, license, term, tf * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) as w, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 as idf from tt left join df using (term), n),
        v as (select tid, license, term, w / sqrt(sum(w * w) over (partition by tid)) * idf as v from tv),
        l as (select doc_id, part, line from (select doc_id, unnest(string_split(t, chr(10))) as part, generate_subscripts(string_split(t, chr(10)), 1) - 1 as line from d)),
        bl as (select doc_id, min(line) filter (trim(translate(part, chr(9) || chr(13), '  ')) = '') as upto, count(*) as all_lines from l group by 1),
        h as (select doc_id, string_agg(part, chr(10) order by line) as part, {licenses.HEADER} as line from l join bl using (doc_id)
              where line < coalesce(upto, all_lines) and coalesce(upto, all_lines) > 1 group by doc_id),
        st as (select doc_id, sum(len({terms("part")})) as stated from l where regexp_matches(part, '{STATED}') group by 1),
        k as (select d.doc_id, dir, t, stated is not null and stated * 2 >= len(ws) as is_file from d left join st using (doc_id)),
        p as (select * from l union all select * from h union all select doc_id, t, {licenses.WHOLE} from k where is_file),
        sp as (select doc_id, line, term, count(*) as tf from (select doc_id, line, unnest({terms("part")}) as term from p) group by all),
        si as (select sp.*, ln((n + 1) / (df + 1)) + 1 as idf from sp join df using (term), n),
        nm as (select doc_id, line, sqrt(sum((tf * idf) * (tf * idf))) as norm from si group by 1, 2),
        pr as (select doc_id, line, tid, license, round(sum(tf * v), 9) as x from si join v using (term) group by all),
        ea as (select *, round(x / norm, 6) as sim from (select *, row_number() over (partition by doc_id, line order by x desc, tid) as r from pr) join nm using (doc_id, line) where r = 1),
        own as (select * from (select *, row_number() over (partition by doc_id order by sim desc, tid, line) as best from ea where sim >= {licenses.LEAST}) where best = 1),
        dirs as (select dir, max(license) as lic, max(sim) as sim from own join k using (doc_id) where is_file group by dir having max(license) = min(license))
        select k.doc_id, k.dir || '/' || k.doc_id::varchar as path, coalesce(own.license, dirs.lic) as license, coalesce(own.sim, dirs.sim) as similarity,
               case when own.doc_id is not null then 'own' when dirs.dir is not null then 'inherited' else 'none' end as origin,
               case when own.doc_id is null then dirs.dir end as from_dir
        from k left join own using (doc_id) left join dirs on dirs.dir = k.dir
    """


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_toxicity": op4_toxicity,
    "op5_near_dedup": op5_near_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_secrets": op10_secrets,
}

ORACLE_SQL = {
    "op1_chat_format": r"""
        with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                   union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        f as (select *, length(regexp_replace(role, '([<\[\\|])', '\1\\', 'g')) + length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) + 13 as chars from c)
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
               sum(chars)::bigint as formatted_chars
        from f group by conv_id
    """,
    "op5_near_dedup": r"""
        with recursive w as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
              when len(w) = 1 then w else [] end) as sh from w),
        n as (select doc_id, count(*) as n from s group by 1),
        p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
        l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 80 * (a.n + b.n - k)),
        r as (select doc_id, doc_id as o from w union select r.doc_id, l.y from r join l on r.o = l.x)
        select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(o) as component_id, r.doc_id = min(o) as kept
        from r left join n on n.doc_id = r.doc_id group by r.doc_id
    """,
    "op7_exact_dedup": """
        with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(d.t) as text_sha256 from d join g on d.t = g.t
    """,
    "op9_decontamination": r"""
        with b as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from benchmark),
        d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from documents),
        bs as (select distinct item_id, least(len(w), 5) as k, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') as s
               from (select item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) as i from b where len(w) > 0)),
        bn as (select item_id, k, count(*) as n from bs group by 1, 2),
        ds as (select distinct doc_id, k, array_to_string(w[i:i + k - 1], ' ') as s
               from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bn) where len(w) >= k))
        select doc_id, bs.item_id, n as n_shingles, count(*) as n_found
        from ds join bs on ds.s = bs.s and ds.k = bs.k join bn on bn.item_id = bs.item_id
        group by 1, 2, 3 having count(*) >= ceil(round(n * 0.8, 9))
    """,
}

ORACLE_SQL["op10_secrets"] = _secrets_sql()
ORACLE_SQL["op3_licenses"] = _licenses_sql()
