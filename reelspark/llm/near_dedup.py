"""MinHash near-dedup by a chosen-path set similarity join.

1. Every text becomes its set of distinct word shingles (64-bit hashes), a fingerprint
   of the set, ``trees`` root tokens (one minwise value each) and a sketch of 64 one-byte
   minwise values. Rows with equal sets collapse to the smallest id: equal fingerprints
   nominate, then the sets are compared in full, part by part, and rows of a fingerprint
   with unlike sets stay apart.
2. Each tree puts a set into the node of its root token. Nodes above ``leaf`` sets are
   split: a few pivots are compared with all members, and only if more than ``leaf``
   members match no pivot does the node branch, each set going on to ``branches``
   children by further selected minwise tokens of its sketch. Otherwise the unmatched
   members meet every block of the node, in full.
3. Leaves are compared exhaustively on sketches with a loose bound, in numpy; a leaf
   returns only edges that connect parts of it, never all pairs. Independent trees
   repeat this: a pair at the threshold misses one root with probability
   1 - threshold, so twelve trees miss it with probability 4e-9 where roots are leaves;
   where nodes branch, a pair with similarity s stays together on a level with probability
   1 - (1 - s p)^2, p being that of the levels below: 0.94 for s = 0.8 at any depth, so a tree
   finds it with 0.75 and twelve miss it with 6e-8.
4. The components of those edges are sets of candidates, each settled exactly: full
   shingle sets of all members are compared (integer arithmetic on the threshold), but
   pairs already connected are skipped. Components above ``block`` sets are dealt out in
   blocks, with pivots first and then every set that matches no pivot against all
   blocks, so large groups of near copies cost in proportion to their size.
5. Verified edges give the final components.

Defined results: words are lower-cased in A-Z only; null or empty texts have the empty
set and stand alone. Rows of one id are one document: they share its component, and
equal rows repeat. A row with a null id is returned alone, kept, with a null component.
Only the id and text columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, shingle_sets, slices, text_buffer
from .components import connected_components

TREES = 12
SKETCH = 64
#: a pair is a candidate if this many of its 64 sketch bytes agree: at a similarity of 0.8, 51 are expected, and fewer than 38 have a probability of 1e-5
AGREE = 0.59
LEAF = 1024
BRANCHES = 2
LEVELS = 6
PIVOTS = 4
BLOCK = 2048
BLOCK_SHINGLES = 2_000_000


def _seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


def minwise(tokens: np.ndarray, seeds: np.ndarray, step: int = 2048) -> np.ndarray:
    """The smallest hash of a set under each seed; tokens are well-mixed 64-bit hashes."""
    low = None
    for at in range(0, len(tokens), step):
        part = tokens[at : at + step]
        part = (part ^ (part >> np.uint64(29)))[:, None] * seeds[None, :]
        part = part.min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return mix(low)


def _signatures(width: int, trees: int, bits: int):
    seeds = _seeds(trees + SKETCH, 11)
    mask = np.uint64((1 << bits) - 1)

    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            n, f1, f2, roots, sketch = [], [], [], [], []
            for a, b in slices(off):
                for s in shingle_sets(buf[off[a] : off[b]], off[a : b + 1], width):
                    n.append(len(s))
                    if len(s):
                        low = minwise(s, seeds)
                        f1.append(int(mix(s).sum() & mask))
                        f2.append(int(mix(s ^ np.uint64(0x5555)).sum() & mask))
                        roots.append(low[:trees].view(np.int64).tolist())
                        sketch.append((low[trees:] & np.uint64(255)).astype(np.uint8).tobytes())
                    else:
                        f1.append(0), f2.append(0), roots.append([]), sketch.append(b"")
            wrap = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n, pa.int64()), wrap(f1), wrap(f2), pa.array(roots, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "t", "n", "f1", "f2", "roots", "sketch"],
            )

    return run


PART = 1 << 14  # bytes of a set that are compared at once


def _set_parts(width: int):
    """n, f1, f2, text -> n, f1, f2 and the text's set in numbered parts."""

    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            rows, no, part, at = [], [], [], 0
            for a, b in slices(off):
                for s in shingle_sets(buf[off[a] : off[b]], off[a : b + 1], width):
                    raw = s.tobytes()
                    for k in range(0, len(raw), PART):
                        rows.append(at), no.append(k // PART), part.append(raw[k : k + PART])
                    at += 1
            same = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(no, pa.int32()), pa.array(part, pa.binary())], ["n", "f1", "f2", "no", "part"])

    return run


def _unlike(docs: DataFrame, signed: DataFrame, width: int) -> DataFrame:
    """Fingerprints (n, f1, f2) whose sets aren't all equal, found by comparing the sets in full.

    Equal parts of a fingerprint collapse before the shuffle, so a group of any size sends one row a task.
    """
    same = ["n", "f1", "f2"]
    groups = signed.groupBy(*same).agg(F.count("*").alias("rows")).where("rows > 1")
    nominated = signed.join(groups, same, "left_semi").select(F.col("doc_id").alias("n_id"), F.col("t").alias("n_t"), *same).distinct()
    texts = docs.join(nominated.hint("shuffle_hash"), (F.col("doc_id") == F.col("n_id")) & (F.col("t") == F.col("n_t"))).select(*same, "text")
    parts = texts.mapInArrow(_set_parts(width), "n long, f1 long, f2 long, no int, part binary")
    unlike = parts.groupBy(*same, "no", "part").agg(F.count("*").alias("c")).groupBy(*same, "no").agg(F.count("*").alias("c")).where("c > 1")
    return unlike.select(*same).distinct()


def _grouped(batches, key: int = 0):
    """Arrow tables, one for each run of equal keys, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


class Parts:
    """Components inside one task."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> np.ndarray:
        """Connect ``a`` with others; returns one of them for each component that was new."""
        fresh, first = np.unique(self.of[others], return_index=True)
        new = others[first[fresh != self.of[a]]]
        self.of[np.isin(self.of, fresh)] = self.of[a]
        return new


def _once(ids: np.ndarray, lead: np.ndarray, content: list) -> np.ndarray:
    """The rows in order of ids, those that repeat an id and its content once; leads win."""
    seen, out = set(), []
    for k in np.lexsort((~lead, ids)).tolist():
        key = (ids[k], content[k])
        if key not in seen:
            seen.add(key)
            out.append(k)
    return np.array(out, np.int64)


def _leaf_edges(batches):
    """node, id, sketch, lead -> edges of a leaf. Leads are compared with all members of the node."""
    for node in _grouped(batches):
        if node.num_rows < 2:
            continue
        ids = node.column("id").to_numpy()
        lead = node.column("lead").to_numpy(zero_copy_only=False).astype(bool)
        order = _once(ids, lead, node.column("sketch").to_pylist())  # a lead is also a member of one block
        ids, lead = ids[order], lead[order]
        if len(ids) < 2:
            continue
        sketch = np.frombuffer(b"".join(node.column("sketch").take(pa.array(order)).to_pylist()), np.uint8).reshape(len(ids), SKETCH)
        src, dst = _sketch_edges(ids, lead, sketch)
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _sketch_edges(ids, lead, sketch):
    need = int(np.ceil(AGREE * SKETCH))
    parts, src, dst = Parts(len(ids)), [], []
    done = np.zeros(len(ids), bool)
    for i in np.flatnonzero(lead):
        done[i] = True
        rest = np.flatnonzero(~done & (parts.of != parts.of[i]))
        if not len(rest):
            continue
        hit = rest[(sketch[rest] == sketch[i]).sum(axis=1) >= need]
        if len(hit):
            for j in parts.join(i, hit).tolist():
                src.append(int(ids[i]))
                dst.append(int(ids[j]))
    return src, dst


def _pivot_rows(batches):
    """node, id, sketch, pivots -> node, id, sketch and all pivots that agree with the row."""
    need = int(np.ceil(AGREE * SKETCH))
    for batch in batches:
        met = []
        for sketch, pivots in zip(batch.column("sketch").to_pylist(), batch.column("pivots").to_pylist()):
            own = np.frombuffer(sketch, np.uint8)
            met.append([p["id"] for p in pivots if (np.frombuffer(p["sketch"], np.uint8) == own).sum() >= need])
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("id"), batch.column("sketch"), pa.array(met, pa.list_(pa.int64()))], ["node", "id", "sketch", "met"]
        )


def _sorted_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*(F.col(k) for k in keys[:1])).sortWithinPartitions(*keys)


def _blocks(rows: DataFrame, key: str, lead: Column, n_blocks: Column, n_leads: Column) -> DataFrame:
    """Deal a group out so that each of its leads meets all its rows: columns ``task`` and ``lead`` are added.

    Rows go to one block and leads to one part of the leads; a task has a block and a part.
    """
    many = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    block, part = F.pmod(F.xxhash64("id"), n_blocks), F.pmod(F.xxhash64("id", F.lit(7)), n_leads)
    members = rows.withColumn("block", block).withColumn("part", many(n_leads)).withColumn("lead", F.lit(False))
    leads = rows.where(lead).withColumn("part", part).withColumn("block", many(n_blocks)).withColumn("lead", F.lit(True))
    return members.unionByName(leads).withColumn("task", F.xxhash64(key, "block", "part"))


def _home(met: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """The pivot that most rows of a group meet, and how many don't: (key, home, n_rows, n_odd)."""
    counts = met.groupBy(key, "pivot").agg(F.count("*").alias("n"))
    top = counts.groupBy(key).agg(F.max(F.struct("n", "pivot")).alias("top"))
    return top.join(sizes, key).select(key, F.col("top.pivot").alias("home"), "n_rows", (F.col("n_rows") - F.col("top.n")).alias("n_odd"))


def _parts_of(n: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(most))).cast("long")


def _split(nodes: DataFrame, level: int, leaf: int, branches: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame | None]:
    """Leaves, edges and children of one level's nodes (node, id, sketch)."""
    sizes = materialise(nodes.groupBy("node").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > leaf), "large-nodes")
    if sizes.isEmpty():
        return [nodes.withColumn("lead", F.lit(True))], [], None
    if not level:  # children are written already
        nodes = materialise(nodes, "nodes")
    leaves = [nodes.join(sizes, "node", "left_anti").withColumn("lead", F.lit(True))]
    large = nodes.join(sizes, "node", "left_semi")
    # pivots: the members that are smallest under a few hashes, by partial aggregation
    picks = [F.min_by(F.struct("id", "sketch"), F.xxhash64("id", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = large.groupBy("node").agg(*picks).select("node", F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS)))).alias("pivots"))
    judged = large.join(pivots, "node").select("node", "id", "sketch", "pivots")
    judged = materialise(judged.mapInArrow(_pivot_rows, "node long, id long, sketch binary, met array<long>"), "pivoted")
    edges = [judged.select(F.col("id").alias("src"), F.explode("met").alias("dst"))]
    # two rows that meet the same pivot are connected; all other pairs hold a row that doesn't meet the home pivot
    home = _home(judged.select("node", F.explode("met").alias("pivot")), "node", sizes).where("n_odd > 0")
    rest = judged.join(home, "node").withColumn("odd", ~F.array_contains("met", F.col("home"))).drop("met", "home")
    rest = materialise(rest, "unsettled")
    last = F.lit(level + 1 >= LEVELS)
    dealt = _blocks(rest.where((F.col("n_odd") <= leaf) | last), "node", F.col("odd"), _parts_of(F.col("n_rows"), leaf), _parts_of(F.col("n_odd"), leaf))
    leaves.append(dealt.select(F.col("task").alias("node"), "id", "sketch", "lead"))
    many = rest.where((F.col("n_odd") > leaf) & ~last)
    token = [F.pmod(F.xxhash64("node", F.lit(level), F.lit(b)), F.lit(SKETCH)).cast("int") + 1 for b in range(branches)]
    child = F.explode(F.array(*(F.xxhash64("node", F.lit(level), F.lit(b), F.substring(F.col("sketch"), t, F.lit(1))) for b, t in enumerate(token))))
    return leaves, edges, many.select(child.alias("node"), "id", "sketch")


def candidate_edges(sets: DataFrame, leaf: int = LEAF, branches: int = BRANCHES) -> DataFrame:
    """Edges (src, dst) that connect all sets whose similarity reaches the threshold, in the trees' recall."""
    nodes = sets.select(F.col("id"), "sketch", F.posexplode("roots").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "id", "sketch")
    leaves, edges, level = [], [], 0
    while nodes is not None:
        some, found, nodes = _split(nodes, level, leaf, branches)
        leaves += some
        edges += found
        level += 1
        if nodes is not None:
            nodes = materialise(nodes, "children")
    out = None
    for part in leaves:
        found = _sorted_by(part.select("node", "id", "sketch", "lead"), "node", "id").mapInArrow(_leaf_edges, "src long, dst long")
        out = found if out is None else out.union(found)
    for part in edges:
        out = out.union(part)
    return out


def _overlaps(tokens: np.ndarray, offsets: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of one sorted set with each of many."""
    at = np.searchsorted(one, tokens)
    at[at == len(one)] = 0
    hit = np.concatenate([[0], np.cumsum(one[at] == tokens)])
    return hit[offsets[1:]] - hit[offsets[:-1]]


def exact_edges(sets: list[np.ndarray], ids, lead, percent: int):
    """Verified edges of one task: leads against all members, skipping pairs already connected."""
    parts, src, dst = Parts(len(sets)), [], []
    sizes = np.array([len(s) for s in sets])
    done = np.zeros(len(sets), bool)
    for i in np.flatnonzero(lead):
        done[i] = True
        near = (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])) & ~done & (parts.of != parts.of[i])
        rest = np.flatnonzero(near)
        if not len(rest):
            continue
        offsets = np.concatenate([[0], np.cumsum(sizes[rest])])
        both = _overlaps(np.concatenate([sets[j] for j in rest]), offsets, sets[i])
        hit = rest[100 * both >= percent * (sizes[rest] + sizes[i] - both)]
        if len(hit):
            for j in parts.join(i, hit).tolist():
                src.append(int(ids[i]))
                dst.append(int(ids[j]))
    return src, dst, parts


def _token_rows(width: int):
    """id, est, text -> the same with the text's shingle set instead of it."""

    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            sets = []
            for a, b in slices(off):
                sets += [s.tobytes() for s in shingle_sets(buf[off[a] : off[b]], off[a : b + 1], width)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("est"), pa.array(sets, pa.binary())], ["id", "est", "tokens"])

    return run


def _task_sets(task: pa.Table):
    """ids, lead and sets of a task's rows."""
    ids = task.column("id").to_numpy()
    lead = task.column("lead").to_numpy(zero_copy_only=False).astype(bool)
    raw = task.column("tokens").to_pylist()
    order = _once(ids, lead, raw)
    return ids[order], lead[order], [np.frombuffer(raw[i], np.uint64) for i in order.tolist()]


def _exact_edges(percent: int):
    def run(batches):
        for task in _grouped(batches):
            if task.num_rows < 2:
                continue
            ids, lead, sets = _task_sets(task)
            src, dst, _ = exact_edges(sets, ids, lead, percent)
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def _pivot_matches(percent: int):
    """task, id, lead, tokens -> all pairs (pivot, id) of the task that reach the threshold."""

    def run(batches):
        for task in _grouped(batches):
            ids, lead, sets = _task_sets(task)
            for i in np.flatnonzero(lead):
                sizes = np.array([len(s) for s in sets])
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                both = _overlaps(np.concatenate(sets), offsets, sets[i])
                hit = np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), ids[i])), pa.array(ids[hit])], ["pivot", "id"])

    return run


def verified_edges(docs: DataFrame, sets: DataFrame, parts: DataFrame, width: int, percent: int, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Edges whose full sets reach the threshold, enough to connect every true component.

    ``docs`` has doc_id, text and its hash t, ``sets`` id, t and n, ``parts`` id and comp.
    """
    sizes = parts.join(sets.select("id", "n"), "id").groupBy("comp").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    sizes = sizes.withColumn("blocks", F.greatest(_parts_of(F.col("rows"), block), _parts_of(F.col("shingles"), block_shingles)))
    members = parts.join(sizes.select("comp", "blocks"), "comp").join(sets.select("id", F.col("t").alias("m_t")), "id")
    members = materialise(members.select("id", "m_t", F.struct("comp", "blocks").alias("est")), "members")
    texts = docs.join(members.hint("shuffle_hash"), (F.col("doc_id") == F.col("id")) & (F.col("t") == F.col("m_t"))).select("id", "est", "text")
    tokens = texts.mapInArrow(_token_rows(width), "id long, est struct<comp:long,blocks:long>, tokens binary").select("id", "est.comp", "est.blocks", "tokens")
    large = not members.where("est.blocks > 1").isEmpty()
    if large:
        tokens = materialise(tokens, "tokens")
    pairs = "src long, dst long"
    small = tokens.where("blocks = 1").select(F.col("comp").alias("task"), "id", F.lit(True).alias("lead"), "tokens")
    edges = _sorted_by(small, "task", "id").mapInArrow(_exact_edges(percent), pairs)
    if not large:
        return edges
    big = tokens.where("blocks > 1")
    own = members.where("est.blocks > 1").select("id", "est.comp")
    pivots = own.groupBy("comp").agg(*(F.min_by("id", F.xxhash64("id", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)))
    pivots = pivots.select(F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("id")).withColumn("pivot", F.lit(True))
    dealt = _blocks(big.join(pivots, "id", "left"), "comp", F.col("pivot"), F.col("blocks"), F.lit(1).cast("long"))
    met = _sorted_by(dealt.select("task", "id", "lead", "tokens"), "task", "id").mapInArrow(_pivot_matches(percent), "pivot long, id long")
    met = materialise(met.distinct().join(own, "id"), "pivot-matches")
    home = _home(met, "comp", own.groupBy("comp").agg(F.count("*").alias("n_rows")))
    settled = met.join(home, "comp").where("pivot = home").select("id").distinct()
    odd = materialise(own.join(settled, "id", "left_anti"), "unsettled-sets")
    counts = odd.groupBy("comp").agg(F.count("*").alias("n_odd"))
    rest = big.join(counts, "comp").join(odd.select("id", F.lit(True).alias("odd")), "id", "left")
    dealt = _blocks(rest, "comp", F.col("odd"), F.col("blocks"), _parts_of(F.col("n_odd"), block))
    others = _sorted_by(dealt.select("task", "id", "lead", "tokens"), "task", "id").mapInArrow(_exact_edges(percent), pairs)
    return edges.union(met.select(F.col("id").alias("src"), F.col("pivot").alias("dst"))).union(others)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
    trees: int = TREES, leaf: int = LEAF, branches: int = BRANCHES, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, bits: int = 64,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept. ``bits``: of each half of a set's fingerprint."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    signed = materialise(
        narrow.mapInArrow(_signatures(width, trees, bits), "doc_id long, t long, n long, f1 long, f2 long, roots array<long>, sketch binary"), "signatures"
    )
    same = ["n", "f1", "f2"]
    named = signed.where("n > 0 and doc_id is not null")
    unlike = materialise(_unlike(narrow, named.select("doc_id", "t", *same), width).withColumn("unlike", F.lit(True)), "unlike-sets")
    # rows of a fingerprint with unlike sets stand for themselves; the join finds those that are equal after all
    alone = lambda d: d.join(unlike, same, "left").withColumn("own", F.when(F.col("unlike"), F.struct("doc_id", "t"))).drop("unlike")
    first = F.min(F.struct("doc_id", "t")).alias("m")
    sets = alone(named).groupBy(*same, "own").agg(first, F.first("roots").alias("roots"), F.first("sketch").alias("sketch"))
    sets = materialise(sets.select(*same, "own", F.col("m.doc_id").alias("id"), F.col("m.t").alias("t"), "roots", "sketch"), "sets")
    parts = connected_components(candidate_edges(sets, leaf, branches))
    links = verified_edges(narrow, sets, parts, width, percent, block, block_shingles)
    comps = connected_components(links)
    mine = [F.col(f"a.{c}") == F.col(f"s.{c}") for c in same] + [F.col("a.own").eqNullSafe(F.col("s.own"))]
    rows = alone(signed.select("doc_id", "t", *same)).alias("a").join(sets.select(*same, "own", "id").alias("s"), mine, "left").select("a.doc_id", "a.n", "s.id")
    rows = rows.join(comps.select(F.col("id").alias("set_id"), "comp"), F.col("id") == F.col("set_id"), "left")
    stands = F.when(F.col("n") > 0, F.coalesce("comp", "id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), stands)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    )
