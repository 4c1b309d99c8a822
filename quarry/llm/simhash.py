"""SimHash fingerprints and near-duplicate groups by generalised pigeonhole search.

The 64 bits are grouped into partitions of correlated bits. With thresholds t_i whose (t_i + 1) sum to
the distance plus one, two fingerprints within the distance differ by at most t_i in some partition i.
A dynamic program chooses the t_i (unequal, -1 to leave a partition out) from candidate counts
estimated on a bounded sample; the number of partitions is chosen the same way. Each fingerprint is
indexed by its bits in each partition and probes with all variants within t_i; what meets is verified.
Estimates steer the cost alone: any choice finds every link.

Equal fingerprints are one node. Of the links among the fingerprints that meet under one key only a
spanning forest leaves the task, so groups of copies cost no more rows than they have members.

64 bits alone tell a similarity of 0.8 badly: half of such pairs differ in over 9 bits, and so do some
unrelated ones. `verified` therefore takes a wider distance for candidates, further bits to thin them, and
the sets of shingles themselves to decide.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, keyed, spare
from .components import components

BITS = 64
SAMPLE = 2048
#: Variants of a partition's bits that a fingerprint may probe.
MOST_KEYS = 2000
#: Rows that are compared in one task.
MOST_ROWS = 65_536


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit i is set if it is in over half of the XXH64 (seed 42) of the text's word shingles, repeats included."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(plain, 42)
    data = np.frombuffer(plain, np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(plain)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(plain[s:e], 42) for s, e in zip(starts, ends, strict=True)], np.uint64)
    return int(majority(hashes, np.array([0, len(hashes)]))[0])


def majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row its hashes' majority: the bits that over half of h[at[i]:at[i + 1]] have."""
    number = np.diff(at)
    has = np.flatnonzero(number)
    out = np.zeros(len(number), np.uint64)
    if not len(has):
        return out
    # four counters of 16 bits in a word, so rows are counted in runs that cannot overflow them
    runs = -(-number[has] // 65_535)
    owner = np.repeat(np.arange(len(has)), runs)
    first = at[has][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)) * 65_535
    for b in range(16):
        lanes = np.add.reduceat((h >> np.uint64(b)) & np.uint64(0x0001000100010001), first)
        for k in range(4):
            n = np.bincount(owner, weights=((lanes >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.float64))
            out[has] |= (n * 2 > number[has]).astype(np.uint64) << np.uint64(16 * k + b)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): 64 bits as a signed long; zero for a null text or one without words."""

    def run(batches):
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            values = np.array([fingerprint(x.as_py() or b"", shingle) for x in column], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, fp long")


# --- the plan: partitions and thresholds -----------------------------------------------------------


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Split the columns into `parts` groups of near-equal size, correlated columns together."""
    x = bits - bits.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0))
    norm[norm == 0] = 1
    correlation = np.abs((x.T @ x) / np.outer(norm, norm))
    left, out = list(range(bits.shape[1])), []
    for i in range(parts):
        size = bits.shape[1] * (i + 1) // parts - bits.shape[1] * i // parts
        rows = correlation[np.ix_(left, left)].copy()
        np.fill_diagonal(rows, 0)
        own = [left[int(rows.sum(axis=1).argmax())]]
        left.remove(own[0])
        while len(own) < size:
            nearest = left[int(correlation[np.ix_(left, own)].sum(axis=1).argmax())]
            own.append(nearest)
            left.remove(nearest)
        out.append(sorted(own))
    return out


def allocate(cost: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Least summed cost and the thresholds t, where cost[i, t + 1] is partition i's and the t + 1 sum to `total`."""
    parts, most = cost.shape
    best = np.full((parts + 1, total + 1), np.inf)
    best[0, 0] = 0
    chosen = np.zeros((parts + 1, total + 1), np.int64)
    for i in range(parts):
        for have in range(total + 1):
            for k in range(min(most, have + 1)):
                value = best[i, have - k] + cost[i, k]
                if value < best[i + 1, have]:
                    best[i + 1, have], chosen[i + 1, have] = value, k
    out, have = [], total
    for i in range(parts, 0, -1):
        out.append(int(chosen[i, have]) - 1)
        have -= int(chosen[i, have])
    return float(best[parts, total]), out[::-1]


@dataclass(frozen=True)
class Plan:
    """[(mask, threshold)] of each partition, and the part of all pairs that is expected to meet under a key."""

    parts: list[tuple[int, int]]
    share: float


def plan(sample: np.ndarray, n: int, distance: int, classes: np.ndarray | None = None) -> Plan:
    """Partitions and thresholds of least estimated cost for n distinct fingerprints, of which `sample` are some.

    With `classes`, only fingerprints of the same or neighbouring classes are to meet.
    """
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    above = np.triu_indices(len(sample), 1)
    apart = np.bitwise_xor.outer(sample, sample)[above] if len(sample) > 1 else np.zeros(0, np.uint64)
    beside, copies = 1.0, 1
    if classes is not None:
        close = np.abs(np.subtract.outer(classes, classes)[above]) <= 1 if len(sample) > 1 else np.ones(0, bool)
        beside, copies = max(float(close.mean()) if len(close) else 1.0, 1e-3), 2
    row_cost, pair_cost = 2e-6, 4e-9  # seconds for a shuffled key and for a verification
    options = []
    for parts in range(2, min(distance + 1, BITS // 4) + 1):
        groups = group_bits(bits, parts) if len(sample) > 1 else [list(range(i, BITS, parts)) for i in range(parts)]
        masks = [sum(1 << b for b in g) for g in groups]
        cost = np.full((parts, distance + 2), np.inf)
        share = np.zeros((parts, distance + 2))
        cost[:, 0] = 0
        for i, (g, mask) in enumerate(zip(groups, masks, strict=True)):
            near = np.bincount(np.bitwise_count(apart & np.uint64(mask)), minlength=BITS + 1).cumsum() / max(1, len(apart))
            for t in range(0, min(distance, len(g)) + 1):
                n_keys = sum(comb(len(g), k) for k in range(t + 1))
                if n_keys > MOST_KEYS:  # never the only way: as many partitions as the distance and one need no variants
                    break
                share[i, t + 1] = max(float(near[t]), n_keys / 2.0 ** len(g)) * beside
                cost[i, t + 1] = n * n_keys * copies * row_cost + n * n / 2 * share[i, t + 1] * pair_cost
        value, thresholds = allocate(cost, distance + 1)
        if np.isfinite(value):
            options.append((value, [(m, t) for m, t in zip(masks, thresholds, strict=True) if t >= 0], max(share[i, t + 1] for i, t in enumerate(thresholds))))
    if not options:
        raise ValueError(f"no thresholds cover a distance of {distance}")
    _, parts, share = min(options)
    return Plan(parts, share)


def signature_deltas(mask: int, threshold: int) -> list[int]:
    """All changes of at most `threshold` of the mask's bits; 0, the index key, first."""
    own = [1 << b for b in range(BITS) if mask >> b & 1]
    return [sum(c) for k in range(threshold + 1) for c in combinations(own, k)]


def _literal(x: int) -> str:
    x = x - (1 << 64) if x >> 63 else x
    return "(-9223372036854775807L - 1L)" if x == -(1 << 63) else f"({x}L)"


def keys(nodes: DataFrame, parts: list[tuple[int, int]], classes: bool = False) -> DataFrame:
    """`nodes` (with fp) times their keys: (key, probe, ...), `probe` for the variants' keys.

    With `classes` (a column `class`), each is indexed under its own class and probes that and the one below.
    """
    cells = ", ".join(
        f"named_struct('part', {i}, 'mask', {_literal(mask)}, 'delta', {_literal(d)}, 'less', {less})"
        for i, (mask, threshold) in enumerate(parts)
        for d in signature_deltas(mask, threshold)
        for less in ((0, 1) if classes else (0,))
    )
    own = ", class - s.less" if classes else ""
    return nodes.select("*", F.explode(F.expr(f"array({cells})")).alias("s")).select(
        F.expr(f"xxhash64(s.part, (fp ^ s.delta) & s.mask{own})").alias("key"), ((F.col("s.delta") != 0) | (F.col("s.less") != 0)).alias("probe"), *nodes.columns
    )


def dealt(rows: DataFrame, by: str, most: int) -> DataFrame:
    """`rows` with a first column `cell` in place of `key`: the rows of a key, or two blocks of a key that more than `most` have.

    The rows of such a key lie in blocks by the hash of `by`, and any two of them meet in a cell, which is a task's
    work of bounded size.
    """
    hot = cut(
        rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.col("key").alias("hot"), F.ceil(F.col("n") * 2 / most).alias("blocks")),
        "hot-keys",
    )
    rest = [c for c in rows.columns if c != "key"]
    if hot.isEmpty():
        drop_cut(hot)
        return rows.select(F.col("key").alias("cell"), *rest)
    block = F.pmod(F.xxhash64(by), F.col("blocks"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(block, j), F.greatest(block, j)))
    joined = rows.join(hot, F.col("key") == F.col("hot"), "left")
    return joined.select(F.explode(F.when(F.col("hot").isNull(), F.array("key")).otherwise(cells)).alias("cell"), *rest)


# --- verification within keys ----------------------------------------------------------------------


def forest(
    values: np.ndarray,
    index: np.ndarray,
    distance: int,
    more: np.ndarray | None = None,
    more_distance: int = 0,
    confirm: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> list[tuple[int, int]]:
    """Spanning links among `values` (u64 fingerprints); pairs of two probes need not be found.

    Two are linked within `distance` bits and, if `more` (one row of further words each) is given, within
    `more_distance` bits of those, and if `confirm` says so. Breadth first in blocks, each against those not
    yet reached: a dense group takes a few passes, and what is unrelated costs |index| * |values| comparisons.
    """

    def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.nonzero(np.bitwise_count(values[a][:, None] ^ values[b][None, :]) <= distance)
        i, j = a[i], b[j]
        if more is not None and len(i):
            close = np.bitwise_count(more[i] ^ more[j]).sum(axis=1, dtype=np.int64) <= more_distance
            i, j = i[close], j[close]
        if confirm is not None and len(i):
            i, j = i[i != j], j[i != j]
            close = confirm(i, j)
            i, j = i[close], j[close]
        return i, j

    return breadth_first(index, near)


def breadth_first(index: np.ndarray, near: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Spanning links where near(a, b) gives the linked pairs of two lists of places; all but pairs of two places that are not in `index`."""
    pairs: list[tuple[int, int]] = []
    alive = np.ones(len(index), bool)
    seeds = np.flatnonzero(index)

    def room(rest: np.ndarray) -> int:
        return max(1, min(64, 4_000_000 // max(1, len(rest))))

    while len(seeds):
        rest = np.flatnonzero(alive)
        block, seeds = seeds[: room(rest)], seeds[room(rest) :]
        block = block[alive[block]]
        i, j = near(block, rest)
        linked = np.unique(i[i != j])
        alive[block] = False
        alive[linked] = True
        for seed in linked.tolist():
            if not alive[seed]:
                continue
            # one component at a time: those in the queue need no comparison with each other
            alive[seed] = False
            queue = np.array([seed])
            while len(queue):
                rest = np.flatnonzero(alive)
                if not len(rest):
                    return pairs
                i, j = near(queue[: room(rest)], rest)
                queue = queue[room(rest) :]
                if len(j):
                    pairs += thin(i, j)
                    found = np.unique(j)
                    alive[found] = False
                    queue = np.concatenate([queue, found])
    return pairs


def thin(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Some of the pairs that join all that the pairs join: one for each j, to its first i, and one for each i and first i."""
    _, first, back = np.unique(j, return_index=True, return_inverse=True)
    owner = i[first][back]
    _, bridge = np.unique(np.stack([i, owner]), axis=1, return_index=True)
    keep = np.union1d(first, bridge)
    return list(zip(i[keep].tolist(), j[keep].tolist(), strict=True))


def spanning(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join two so far unjoined nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.setdefault(x, x)) != x:
            root[x] = root[p]
            x = root[x]
        return x

    out = []
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[rb] = ra
            out.append((a, b))
    return out


def links(nodes: DataFrame, found: Plan, distance: int, more_distance: int = 0, store=None, only_nodes: bool = False) -> DataFrame:
    """(a, b), or with `only_nodes` the nodes (node) that have any: links among `nodes` (node, [class,] fp, fp1, ...) that join all that are close, a forest for each key.

    With a `store` of sets (see sets.Store), only those whose sets are alike.
    """
    classes = "class" in nodes.columns
    rows = keys(nodes, found.parts, classes).drop("class")

    def run(batches):
        confirm = None
        seen: dict[tuple[int, int], bool] = {}
        for table in sorted_groups(batches):
            index = ~np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in table])
            if len(index) < 2 or not index.any():
                continue
            longs = np.stack([np.concatenate([b.column(k).to_numpy() for b in table]) for k in range(2, table[0].num_columns)], axis=1)
            words = longs[:, 1:].view(np.uint64)
            more = np.ascontiguousarray(words[:, 1:]) if words.shape[1] > 1 else None
            if store is not None:
                if len(seen) > 1_000_000:
                    seen.clear()
                confirm = store.confirm(longs[:, 0].view(np.uint64), seen)
            linked = spanning(forest(np.ascontiguousarray(words[:, 0]), index, distance, more, more_distance, confirm))
            if linked:
                i, j = np.array(linked).T
                if only_nodes:
                    yield pa.RecordBatch.from_arrays([pa.array(longs[np.union1d(i, j), 0])], ["node"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(longs[i, 0]), pa.array(longs[j, 0])], ["a", "b"])

    cells = dealt(rows, "node", MOST_ROWS).repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(run, "node long" if only_nodes else "a long, b long")


def sorted_groups(batches, single: bool = False):
    """Lists of record batches with the rows of each value of column 0, by which the rows are sorted.

    Groups of one row are left out unless `single`.
    """
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        runs = np.arange(len(bounds) - 1)
        if not single:
            # lone rows within the batch are skipped; the first and last run may go on beyond it
            runs = runs[(np.diff(bounds) > 1) | (runs == 0) | (runs == len(runs) - 1)]
        for s, e in zip(bounds[runs].tolist(), bounds[runs + 1].tolist(), strict=True):
            if held and k[s] != held_key:
                if single or len(held) > 1 or held[0].num_rows > 1:
                    yield held
                held = []
            held_key = k[s]
            held.append(batch.slice(s, e - s))
    if held and (single or len(held) > 1 or held[0].num_rows > 1):
        yield held


def planned(distinct: DataFrame, distance: int) -> Plan:
    """The plan for all fingerprints, from a sample by hash order of SAMPLE at most."""
    own = ["fp", "class"] if "class" in distinct.columns else ["fp"]
    rows = distinct.select(*own).orderBy(F.xxhash64(*own)).limit(SAMPLE).collect()
    sample, first = np.unique(np.array([r["fp"] for r in rows], np.int64).view(np.uint64), return_index=True)
    classes = np.array([r["class"] for r in rows], np.int64)[first] if len(own) > 1 else None
    return plan(sample, distinct.count(), distance, classes)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most `distance` differing bits. A null or
    wordless text has fingerprint zero and links like any other; a text of fewer than `shingle` words is one
    shingle. Texts of any length are read whole. Repeated rows share a component; rows with a null id have the
    component of the others that they link to (null if there are none). An empty table gives no rows. Only the
    id and the text are read, whatever else the columns are called.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle).withColumn("node", F.col("fp")), "simhash")
    distinct = cut(marked.groupBy("node", "fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("node", "fp"), planned(distinct, distance), distance))
    # written, so that the joins below read both sides plainly and a hot group's rows can be split
    joined = cut(distinct.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "simhash-roots")
    least = cut(joined.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    classes = cut(joined.select("node", "root").join(least, "root").select("node", "component_id"), "simhash-classes")
    for done in (distinct, joined, least):
        drop_cut(done)
    return marked.join(classes, "node").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- verified groups -------------------------------------------------------------------------------


def verified(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    distance: int = 19,
    more_distance: int = 34,
    row_key: list[Column] | None = None,
) -> DataFrame:
    """(doc_id, row keys, group, stays): groups of rows whose sets of word shingles have a similarity of 0.8 or more.

    The fingerprint is that of the set, in 64 bits for the search and 128 more to thin the candidates; each link
    is confirmed on the whole sets. Only texts of like numbers of shingles meet. First the documents near another in bits
    are found and their sets written; then these alone are searched again and confirmed. One row of each group stays: the
    least id, null ids last, and of those of one id the first row. Null texts and those without a word are alike; a text of
    fewer words than a shingle is one shingle. Texts of any length are read whole; an empty table gives no rows.
    """
    from . import sets

    rows, row = keyed(docs, row_key)
    marked = cut(sets.marked(rows, row, id_col, text_col, shingle), "similar")
    bits = ["node", "class", "fp", "fp1", "fp2"]
    distinct = cut(marked.select(*bits).distinct(), "similar-distinct")
    near = links(distinct, planned(distinct, distance), distance, more_distance, only_nodes=True)
    near = cut(near.distinct(), "similar-near")
    candidates = cut(distinct.join(near, "node", "left_semi"), "similar-candidates")
    store = sets.store(docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), near, shingle)
    roots = components(links(candidates, planned(candidates, distance), distance, more_distance, store))
    # written, so that the joins read both sides plainly and a hot group's rows can be split
    named = cut(marked.drop("class", "fp", "fp1", "fp2").join(roots, "node", "left").select("doc_id", *row, F.coalesce("root", "node").alias("group")), "similar-groups")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", *row)
    first = cut(named.groupBy("group").agg(F.min(rank).alias("first")), "similar-first")
    for done in (marked, distinct, near, candidates):
        drop_cut(done)
    store.drop(docs.sparkSession)
    return named.join(first, "group").select("doc_id", *row, "group", rank.eqNullSafe(F.col("first")).alias("stays"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_key: list[Column] | None = None, **options) -> DataFrame:
    """One row of each group of `verified`, with the columns of `docs`; equal rows are alike and one stays."""
    rows, row = keyed(docs, row_key)
    found = verified(rows, id_col, text_col, row_key=[F.col(r) for r in row], **options)
    names = [spare(rows, f"gone{k}") for k in range(len(row))]
    own = found.columns[1 : 1 + len(row)]
    gone = found.filter("not stays").select(*[F.col(c).alias(n) for c, n in zip(own, names, strict=True)])
    same = [F.col(r) == F.col(n) for r, n in zip(row, names, strict=True)]
    return rows.join(gone, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
