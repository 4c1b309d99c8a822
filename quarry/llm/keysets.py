"""Sets of 64-bit keys that are too large to broadcast: sorted arrays in ranges, memory-mapped by workers.

Tasks ship their keys as sorted blocks, one row for each range; a reducer merges a range and writes the
keys that enough rows or owners have. Key counts are map-side sums, so a key that a third of all rows
have is one entry of each block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, make_dirs, opened, remove, target_partitions, writing
from .simhash import sorted_groups
from .textvec import U64

BLOCK = "part int, keys binary, owners binary"
HELD = 800_000
KEYS_PER_RANGE = 2_000_000


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of equal ranges each key lies in; sorted keys give sorted ranges."""
    return (((keys >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def cells(part: np.ndarray):
    """(part, from, to) for sorted part numbers."""
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else [0]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(part[s]), s, e


def _distinct(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return keys[new], owners[new]


@dataclass(frozen=True)
class KeySet:
    """Range p's keys lie sorted in the file `path`/p.keys."""

    path: str
    parts: int

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """For any keys, whether each is in the set."""
        unique, back = np.unique(keys, return_inverse=True)
        found = np.zeros(len(unique), bool)
        for p, s, e in cells(ranges(unique, self.parts)):
            own = self._keys(p)
            if own is not None and len(own):
                at = np.minimum(np.searchsorted(own, unique[s:e]), len(own) - 1)
                found[s:e] = own[at] == unique[s:e]
        return found[back]

    def _keys(self, p: int) -> np.ndarray | None:
        return opened(f"{self.path}/{p}.keys", lambda buffer: np.frombuffer(buffer, U64))

    def drop(self, spark: SparkSession) -> None:
        """Delete the files, once nothing reads them any more."""
        remove(spark, self.path)


def build(blocks: DataFrame, parts: int, *least: int) -> list[KeySet]:
    """For each number in `least`, the keys that at least so many distinct owners have."""
    spark = blocks.sparkSession
    found = [KeySet(fresh(spark, "keys"), parts) for _ in least]
    for one in found:
        make_dirs(spark, one.path)

    def reduce(batches):
        for table in sorted_groups(batches, single=True):
            part = table[0].column(0)[0].as_py()
            rows = [(k.as_py(), o.as_py()) for batch in table for k, o in zip(batch.column(1), batch.column(2), strict=True)]
            keys = np.concatenate([np.frombuffer(k, U64) for k, _ in rows])
            owners = np.concatenate([np.frombuffer(o, U64) for _, o in rows])
            del rows
            keys, _ = _distinct(keys, owners)
            unique, n = np.unique(keys, return_counts=True)
            for one, number in zip(found, least, strict=True):
                own = unique[n >= number]
                if len(own):
                    with writing(f"{one.path}/{part}.keys") as f:
                        f.write(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([len(unique)])], ["n"])

    blocks.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(reduce, "n long").agg(F.sum("n")).collect()
    return found


class Shipper:
    """Gathers (key, owner) pairs in a task and gives blocks of distinct ones."""

    def __init__(self, parts: int):
        self.parts = parts
        self.keys: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, owners: np.ndarray):
        """Blocks to ship now, if the pairs held became many."""
        self.keys.append(keys)
        self.owners.append(owners)
        self.size += len(keys)
        return self.ship() if self.size > HELD else []

    def ship(self) -> list[pa.RecordBatch]:
        if not self.size:
            return []
        keys, owners = _distinct(np.concatenate(self.keys), np.concatenate(self.owners))
        self.keys, self.owners, self.size = [], [], 0
        rows = [(p, keys[s:e].tobytes(), owners[s:e].tobytes()) for p, s, e in cells(ranges(keys, self.parts))]
        part, a, b = zip(*rows, strict=True)
        return [pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["part", "keys", "owners"])]


def parts_for(texts: DataFrame, text_col: str, bytes_per_key: int) -> int:
    """Ranges for about one key in so many bytes of text."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    return target_partitions(size // bytes_per_key, KEYS_PER_RANGE, 8)
