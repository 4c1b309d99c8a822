"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

A text's shingles are its five-word windows, lower-cased (A-Z) with ASCII punctuation as white space.
Items are partitioned by their number of shingles. In a partition whose largest item has u shingles, an
item's signature is its k = u - ceil(threshold * u) + 1 smallest shingles in MinHash order: a document
that holds a share of `threshold` of the item misses at most k - 1 of them, so it holds one of any k.

The documents are probed with all their shingles rather than with a signature of their own: an item of
thirty shingles in a document of forty thousand has a resemblance below 0.001, which no number of
banded hash functions finds with certainty. What meets is verified on the shingles themselves.

Items are broadcast in blocks of bounded size, as their texts and sorted arrays of hashes, some 40 bytes for each
shingle; each block meets all documents and nothing is shuffled.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import LOWER, SPACE, U64, Chunk, chunks, mix, windows

#: At most about this many items and bytes of their texts are broadcast at once.
BLOCK_ITEMS, BLOCK_BYTES = 100_000, 16 << 20

PLAIN = LOWER.copy()
PLAIN[[ord(c) for c in ".,;:!?\"'()[]{}"]] = 32


class Items:
    """A block of items: their signatures by window length, their texts, and the hashes of their shingles."""

    def __init__(self, rows: list[tuple[object, str]], shingle: int, threshold: float):
        self.threshold = threshold
        self.ids = [r[0] for r in rows]
        self.texts = [(r[1] or "").encode(errors="replace") for r in rows]
        joined = PLAIN[np.frombuffer(b"".join(self.texts), np.uint8)]
        c = Chunk(0, joined, np.cumsum([0, *map(len, self.texts)]))
        starts, ends = c.pieces(SPACE[c.data])
        at = np.searchsorted(starts, c.offsets)
        words = c.hashes(starts, ends)
        #: how many words the shingles of each item have, and how many distinct shingles it has
        self.width = np.minimum(np.diff(at), shingle)
        self.size = np.zeros(len(rows), np.int64)
        #: window length -> (sorted hashes, the items of each as offsets into a flat list, a filter on 20 bits)
        self.probes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(self.width[self.width > 0]).tolist():
            h, h_at = windows(words, at, n, False)
            own = np.flatnonzero(self.width == n)
            sets = [np.unique(h[h_at[i] : h_at[i + 1]]) for i in own.tolist()]
            self.size[own] = [len(x) for x in sets]
            # the largest item of a partition decides how many shingles its signatures have
            part = np.array([len(x).bit_length() for x in sets])
            largest = np.zeros(part.max() + 1, np.int64)
            np.maximum.at(largest, part, self.size[own])
            hashes, owners = [], []
            for i, x, u in zip(own.tolist(), sets, largest[part].tolist(), strict=True):
                k = min(len(x), u - ceil(threshold * u - 1e-9) + 1)
                hashes.append(x[np.argsort(mix(x ^ U64(0x5851F42D4C957F2D)), kind="stable")[:k]])
                owners.append(np.full(k, i, np.int32))
            flat, owner = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(flat, kind="stable")
            unique, first = np.unique(flat[order], return_index=True)
            seen = np.zeros(1 << 20, bool)
            seen[(unique >> U64(44)).astype(np.int64)] = True
            self.probes[n] = (unique, np.append(first, len(flat)), owner[order], seen)

    def found(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) for all rows that hold a share of `threshold` of an item."""
        out = []
        for c in chunks(column):
            c = Chunk(c.first, PLAIN[c.data], c.offsets)
            starts, ends = c.pieces(SPACE[c.data])
            at = np.searchsorted(starts, c.offsets)
            words = c.hashes(starts, ends)
            pairs = [np.zeros((0, 2), np.int64)]
            for n, (unique, first, owner, seen) in self.probes.items():
                h, h_at = windows(words, at, n, False)
                where = np.flatnonzero(seen[(h >> U64(44)).astype(np.int64)])
                slot = np.minimum(np.searchsorted(unique, h[where]), len(unique) - 1)
                hit = unique[slot] == h[where]
                slot, rows = slot[hit], np.searchsorted(h_at, where[hit], "right") - 1
                # a row and a shingle once, then all items that have it
                rows, slot = np.unique(np.stack([rows, slot], axis=1), axis=0).T
                each = first[slot + 1] - first[slot]
                place = np.arange(each.sum()) + np.repeat(first[slot] - (np.cumsum(each) - each), each)
                pairs.append(np.unique(np.stack([np.repeat(rows, each), owner[place]], axis=1), axis=0))
            held: dict[tuple[int, int], set] = {}
            for row, i in sorted(map(tuple, np.concatenate(pairs).tolist())):
                n = int(self.width[i])
                if (row, n) not in held:
                    held = {k: v for k, v in held.items() if k[0] == row}
                    held[row, n] = shingles(c.data[c.offsets[row] : c.offsets[row + 1]].tobytes().split(), n)
                own = shingles(plain_words(self.texts[i]), n)
                shared = len(own & held[row, n])
                if shared >= self.threshold * len(own) - 1e-9:
                    out.append((c.first + row, i, shared))
        return out


def plain_words(text: bytes) -> list[bytes]:
    return PLAIN[np.frombuffer(text, np.uint8)].tobytes().split()


def shingles(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[k:] for k in range(n)), strict=False)) if n else set()


def item_blocks(items: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float):
    """The items in blocks of bounded count and bytes."""
    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        found = [(r["item_id"], r["text"]) for r in part.collect()]
        if found:
            yield Items(found, shingle, threshold)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for each document with that share of an item.

    Shingles are distinct ones; an item of fewer than `shingle` words is one shingle of all its words; an
    item or document without words, or null, never matches. Repeated rows each have their own result rows; null
    ids are carried; texts of any length are searched whole; an empty table on either side gives no rows. Only ids
    and texts are read, whatever other columns are called.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    item_type = items.schema[item_id_col].dataType
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, item_id {item_type.simpleString()}, n_item long, n_shared long, containment double"
    result = None
    for block in item_blocks(items, item_id_col, item_text_col, shingle, threshold):

        def run(batches, shared=docs.sparkSession.sparkContext.broadcast(block)):
            block = shared.value
            for batch in batches:
                if found := block.found(batch.column(1)):
                    rows = pa.array([r for r, _, _ in found])
                    sizes = [int(block.size[i]) for _, i, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(rows),
                            pa.array([block.ids[i] for _, i, _ in found]),
                            pa.array(sizes, pa.int64()),
                            pa.array([s for _, _, s in found], pa.int64()),
                            pa.array([s / n for (_, _, s), n in zip(found, sizes, strict=True)], pa.float64()),
                        ],
                        ["doc_id", "item_id", "n_item", "n_shared", "containment"],
                    )

        part = source.mapInArrow(run, schema)
        result = part if result is None else result.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result


def remove_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """`docs` without the rows that hold a share of `threshold` of an item; nothing is joined or shuffled.

    Items and texts match as in `leaks`; rows with a null text stay, repeated rows go or stay together, an empty
    table gives an empty one, and columns may have any names.
    """
    kept = docs
    at = docs.columns.index(text_col)
    for block in item_blocks(items, item_id_col, item_text_col, shingle, threshold):

        def run(batches, shared=docs.sparkSession.sparkContext.broadcast(block)):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _, _ in shared.value.found(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
