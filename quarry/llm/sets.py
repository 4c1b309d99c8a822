"""Sets of word shingles: their fingerprints, and files of whole sets for exact comparison.

A set is identified by a hash that depends on it alone, so equal sets are one node, however many copies there are.
The sets of nodes that need to be compared lie in ranges of nodes, one file each, that workers map into memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, make_dirs, opened, remove, writing
from .keysets import BLOCK, Shipper, build, cells, parts_for, ranges
from .simhash import majority, sorted_groups
from .textvec import U64, Chunk, chunks, mix, windows

#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Classes of size: two sets of that similarity lie in the same or in neighbouring ones.
RATIO = np.log(UNDER / OVER) * 1.0001
#: Hashes that are compared at once.
AT_ONCE = 2_000_000


def alike(shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return shared * (UNDER + OVER) >= OVER * (n + m)


def distinct(c: Chunk, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node of each row, and its sorted distinct shingles: row i has those from at[i] to at[i + 1].

    The node depends on the set alone; rows without a word have node 0.
    """
    starts, ends, at = c.words()
    h, at = windows(c.hashes(starts, ends), at, shingle, whole=True)
    row = np.repeat(np.arange(c.rows), np.diff(at))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    at = np.searchsorted(row, np.arange(c.rows + 1))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h + U64(1)), dtype=U64)])
    return mix(total[at[1:]] - total[at[:-1]]), h, at


def marked(rows: DataFrame, row: list[str], id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, the columns `row`, node, class, fp, fp1, fp2) of each row."""
    source = rows.select(F.col(f"`{id_col}`").alias("doc_id"), *row, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    names = ["doc_id", *row, "node", "class", "fp", "fp1", "fp2"]

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(batch.num_columns - 1), lower=True):
                node, h, at = distinct(c, shingle)
                n = np.diff(at)
                size = np.where(n > 0, np.log(np.maximum(n, 1)) / RATIO, -9).astype(np.int32)
                words = [majority(x, at) for x in (h, mix(h + U64(1)), mix(h + U64(2)))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(c.first, c.rows) for k in range(batch.num_columns - 1)),
                        pa.array(node.view(np.int64)),
                        pa.array(size),
                        *(pa.array(w.view(np.int64)) for w in words),
                    ],
                    names,
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, node long, class int, fp long, fp1 long, fp2 long")


@dataclass(frozen=True)
class Store:
    """The sets of the nodes of range p lie in the file `path`/p.sets."""

    path: str
    parts: int

    def part(self, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted nodes, their bounds and the hashes."""

        def parse(buffer):
            whole = np.frombuffer(buffer, U64)
            n = int(whole[0])
            return whole[1 : n + 1], whole[n + 1 : 2 * n + 2].view(np.int64), whole[2 * n + 2 :]

        return opened(f"{self.path}/{p}.sets", parse)

    def get(self, nodes: np.ndarray) -> dict[int, np.ndarray]:
        """The sets of sorted nodes that are all there."""
        out = {}
        for p, s, e in cells(ranges(nodes, self.parts)):
            own, at, h = self.part(p)
            i = np.searchsorted(own, nodes[s:e])
            out |= {n: h[a:b] for n, a, b in zip(nodes[s:e].tolist(), at[i].tolist(), at[i + 1].tolist(), strict=True)}
        return out

    def write(self, p: int, held: dict[int, bytes]) -> None:
        nodes = sorted(held)
        bounds = np.cumsum([0, *(len(held[n]) // 8 for n in nodes)])
        with writing(f"{self.path}/{p}.sets") as f:
            f.write(np.array([len(nodes), *nodes], U64).tobytes() + bounds.astype(np.int64).tobytes())
            for n in nodes:
                f.write(held[n])

    def confirm(self, nodes: np.ndarray, seen: dict[tuple[int, int], bool]):
        """A function of two lists of places in `nodes`: which pairs are alike. `seen` holds what was found before."""
        names = nodes.tolist()

        def found(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            pairs = [(names[a], names[b]) if names[a] < names[b] else (names[b], names[a]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
            new = sorted({p for p in pairs if p not in seen and p[0] != p[1]})
            for s in range(0, len(new), 512):
                some = new[s : s + 512]
                own = self.get(np.unique(np.array(some, U64)))
                by_first: dict[int, list[int]] = {}
                for a, b in some:
                    by_first.setdefault(a, []).append(b)
                for a, others in by_first.items():
                    seen.update(((a, b), yes) for b, yes in zip(others, self._alike(own[a], [own[b] for b in others]), strict=True))
            return np.array([p[0] == p[1] or seen[p] for p in pairs], bool)

        return found

    @staticmethod
    def _alike(one: np.ndarray, others: list[np.ndarray]) -> list[bool]:
        out: list[bool] = []
        at = 0
        while at < len(others):
            size, to = 0, at
            while to < len(others) and (to == at or size + len(others[to]) <= AT_ONCE):
                size += len(others[to])
                to += 1
            part = others[at:to]
            n = np.array([len(x) for x in part])
            every = np.concatenate(part)
            hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
            shared = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
            out += alike(shared, n, len(one)).tolist()
            at = to
        return out

    def drop(self, spark: SparkSession) -> None:
        remove(spark, self.path)


def store(texts: DataFrame, nodes: DataFrame, shingle: int) -> Store:
    """The sets of the texts that are among `nodes` (node), written below the shared folder."""
    spark = texts.sparkSession
    parts = parts_for(texts, "text", 6)

    def ship(batches):
        shipper = Shipper(parts)
        for batch in batches:
            own = batch.column(0).to_numpy().view(U64)
            yield from shipper.add(own, np.zeros(len(own), U64))
        yield from shipper.ship()

    (wanted,) = build(nodes.select("node").mapInArrow(ship, BLOCK), parts, 1)
    out = Store(fresh(spark, "sets"), parts)
    make_dirs(spark, out.path)

    def rest(batches):
        sent: set[int] = set()
        for batch in batches:
            for c in chunks(batch.column(0), lower=True):
                node, h, at = distinct(c, shingle)
                rows = []
                for i in np.flatnonzero(wanted.contains(node) & (np.diff(at) > 0)).tolist():
                    if (k := int(node[i])) not in sent:
                        sent.add(k)
                        rows.append(i)
                if rows:
                    own = node[rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ranges(own, parts).astype(np.int32)),
                            pa.array(own.view(np.int64)),
                            pa.array([h[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary()),
                        ],
                        ["part", "node", "hashes"],
                    )

    def write(batches):
        for table in sorted_groups(batches, single=True):
            held = {n.as_py() % (1 << 64): x.as_py() for b in table for n, x in zip(b.column(1), b.column(2), strict=True)}
            out.write(table[0].column(0)[0].as_py(), held)
            yield pa.RecordBatch.from_arrays([pa.array([len(held)])], ["n"])

    found = texts.mapInArrow(rest, "part int, node long, hashes binary").repartitionById(parts, F.col("part"))
    found.sortWithinPartitions("part").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    wanted.drop(spark)
    return out
