"""Packing token pieces into sequences by swap-based local search.

Pieces of one length are interchangeable, so the packing is found on the histogram of lengths, which has
no more entries than the sequence has tokens, however many documents there are. A packing is a list of
runs (pattern, count): `count` sequences that each hold the pattern's pieces, (length, number) each.

The first packing is plain best fit in an unsorted order. The local search then
takes the emptiest pattern and shifts tokens from it to fuller ones by moving pieces, exchanging one for
one, two for one or one for two, for all sequences of the two patterns at once. Each shift goes from an
emptier sequence to a fuller one and so increases the sum of squared fill. Small pieces gather in the emptiest
sequences, until those are empty. It ends when no shift is left or no fewer sequences could hold the tokens.

Rows find their place by their rank among the pieces of their length. The rank is counted in as many cells as
each then has rows, so a length that a third of all pieces have is no hot group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release
from .textvec import U64, mix
from .tokens import encoded, vocabulary_path

END = 1
#: Parts in which the pieces of one length are first packed.
ARRIVALS = 16

#: ((length, number), ...) in descending order of lengths.
Pattern = tuple[tuple[int, int], ...]
Run = tuple[Pattern, int]
#: Target, pieces that go to it, pieces that come back.
Shift = tuple[Pattern, list[tuple[int, int]], list[tuple[int, int]]]


def fill(pattern: Pattern) -> int:
    return sum(n * k for n, k in pattern)


def changed(pattern: Pattern, gone: list[tuple[int, int]], come: list[tuple[int, int]]) -> Pattern:
    have = dict(pattern)
    for n, k in gone:
        have[n] -= k
    for n, k in come:
        have[n] = have.get(n, 0) + k
    return tuple(sorted(((n, k) for n, k in have.items() if k), reverse=True))


def first_packing(counts: dict[int, int], size: int) -> list[Run]:
    """Runs that hold all pieces: each goes where least room is left beside it, in an order by hash and so unsorted.

    The pieces of a length come in ARRIVALS parts, each at its place in that order.
    """
    length = np.repeat(np.array(sorted(counts), np.int64), ARRIVALS)
    part = np.tile(np.arange(ARRIVALS), len(counts))
    rooms: list[int] = []
    held: dict[int, dict[Pattern, int]] = {}

    def put(pattern: Pattern, times: int) -> None:
        room = size - fill(pattern)
        own = held.setdefault(room, {})
        if not own and room:
            insort(rooms, room)
        own[pattern] = own.get(pattern, 0) + times

    for k in np.argsort(mix(length.astype(U64) * U64(ARRIVALS) + part.astype(U64))).tolist():
        n = int(length[k])
        left = counts[n] * (int(part[k]) + 1) // ARRIVALS - counts[n] * int(part[k]) // ARRIVALS
        while left and (at := bisect_left(rooms, n)) < len(rooms):
            room = rooms[at]
            pattern, times = held[room].popitem()
            if not held[room]:
                del rooms[at]
            if times > left:
                held[room][pattern] = times - left
                if len(held[room]) == 1:
                    insort(rooms, room)
                times = left
            each = min(room // n, left // times)
            put(changed(pattern, [], [(n, each)]), times)
            left -= times * each
        each = size // n
        for k, times in ((each, left // each), (left % each, 1)):
            if k and times:
                put(((n, k),), times)
    return [run for own in held.values() for run in own.items()]


class Targets:
    """The underfull patterns by what they hold: for each length, the rooms of those that have a piece of it (0: all)."""

    def __init__(self, size: int):
        self.size = size
        self.rooms: dict[int, list[int]] = {}
        self.patterns: dict[tuple[int, int], dict[Pattern, None]] = {}
        #: length + the largest room beside it: what can take a piece's place; -1 where no underfull pattern has one
        self.reach = np.full(size + 1, -1, np.int64)
        # the pairs of pieces of each pattern: their sum, that and the pattern's room, and the pattern's number in `known`
        self.new: dict[Pattern, None] = {}
        self.known: list[Pattern] = []
        self.number: dict[Pattern, int] = {}
        self.sum, self.upto, self.owner = (np.zeros(0, np.int64) for _ in range(3))
        self.live = np.zeros(0, bool)

    def add(self, pattern: Pattern) -> None:
        room = self.size - fill(pattern)
        for y in (0, *(n for n, _ in pattern)):
            own = self.patterns.setdefault((y, room), {})
            if not own:
                insort(self.rooms.setdefault(y, []), room)
                self.reach[y] = y + self.rooms[y][-1]
            own[pattern] = None
        self.new[pattern] = None

    def remove(self, pattern: Pattern) -> None:
        if pattern in self.new:
            del self.new[pattern]
        else:
            self.live[self.number.pop(pattern)] = False
        room = self.size - fill(pattern)
        for y in (0, *(n for n, _ in pattern)):
            own = self.patterns[y, room]
            del own[pattern]
            if not own:
                rooms = self.rooms[y]
                del rooms[bisect_left(rooms, room)]
                self.reach[y] = y + rooms[-1] if rooms else -1

    def least(self, sums: np.ndarray) -> np.ndarray:
        """For each sum of pieces, the shortest piece (0: none) that an underfull pattern can give for it; the sum itself if none."""
        y = np.searchsorted(np.maximum.accumulate(self.reach), sums)
        return np.minimum(y, sums)

    def tightest(self, y: int, room: int) -> Pattern:
        """A pattern with a piece y and the least room that is at least `room`."""
        rooms = self.rooms[y]
        return next(iter(self.patterns[y, rooms[bisect_left(rooms, room)]]))

    def _settle(self) -> None:
        """Take the new patterns' pairs in, and leave out those of patterns that are gone."""
        if not self.new:
            return
        own = self.live[self.owner]
        columns = [[x[own]] for x in (self.sum, self.upto, self.owner)]
        at = len(self.known)
        for k, pattern in enumerate(self.new, at):
            sums = np.unique(_twos(pattern)[0])
            for column, x in zip(columns, (sums, sums + self.size - fill(pattern), np.full(len(sums), k)), strict=True):
                column.append(x)
            self.number[pattern] = k
            self.known.append(pattern)
        self.sum, self.upto, self.owner = (np.concatenate(x) for x in columns)
        self.live = np.concatenate([self.live, np.ones(len(self.new), bool)])
        self.new = {}

    def two_for(self, ones: np.ndarray) -> Shift | None:
        """The exchange of one of the pieces `ones` for two of an underfull pattern that moves most tokens."""
        self._settle()
        own = np.flatnonzero(self.live[self.owner])
        top = np.full(2 * self.size + 1, -1, np.int64)
        np.maximum.at(top, self.sum[own], self.upto[own])
        given = np.searchsorted(np.maximum.accumulate(top), ones)
        best = int((ones - given).argmax())
        x, y = int(ones[best]), int(given[best])
        if x <= y:
            return None
        fit = own[(self.sum[own] == y) & (self.upto[own] >= x)]
        target = self.known[int(self.owner[fit[self.upto[fit].argmin()]])]
        sums, first, second = _twos(target)
        k = int(np.flatnonzero(sums == y)[0])
        return target, [(x, 1)], _both(int(first[k]), int(second[k]))


def _twos(pattern: Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of two pieces of a pattern, and the two."""
    n, k = np.array(pattern).T
    i, j = np.triu_indices(len(n))
    ok = (i != j) | (k[i] > 1)
    return n[i[ok]] + n[j[ok]], n[i[ok]], n[j[ok]]


def _pieces(*lengths: int) -> list[tuple[int, int]]:
    return [(n, 1) for n in lengths if n]


def shift_from(source: Pattern, targets: Targets) -> Shift | None:
    """The shift out of `source` that moves most tokens: (target, pieces that go, pieces that come)."""
    ones = np.array([n for n, _ in source])
    given = targets.least(ones)
    best = int((ones - given).argmax())
    x, y = int(ones[best]), int(given[best])
    if x > y:
        target = targets.tightest(y, x - y)
        if y:
            return target, [(x, 1)], [(y, 1)]
        # a move takes as many pieces of the length as fit
        times = min(dict(source)[x], (targets.size - fill(target)) // x)
        return target, [(x, times)], []
    sums, first, second = _twos(source)
    if len(sums):
        given = targets.least(sums)
        best = int((sums - given).argmax())
        y = int(given[best])
        if sums[best] > y:
            return targets.tightest(y, int(sums[best]) - y), _both(int(first[best]), int(second[best])), _pieces(y)
    return targets.two_for(ones)


def _both(x: int, y: int) -> list[tuple[int, int]]:
    return [(x, 2)] if x == y else [(x, 1), (y, 1)]


def local_search(runs: list[Run], size: int, watch: Callable[[int, int], None] | None = None) -> list[Run]:
    """Fewer sequences by shifts between underfull ones.

    The emptiest pattern is the source of shifts until nothing helps it; then it is set aside, and taken up again
    when the others are through, if anything has changed. `watch` is told each shift's number of sequences and the
    tokens that it moves in one.
    """
    bins: dict[Pattern, int] = {}
    for pattern, n in runs:
        bins[pattern] = bins.get(pattern, 0) + n
    number = sum(bins.values())
    least = -(-sum(fill(p) * n for p, n in bins.items()) // size)

    changes = True
    while changes and number > least:
        changes = False
        targets = Targets(size)
        for pattern in bins:
            if fill(pattern) < size:
                targets.add(pattern)

        def add(pattern: Pattern, n: int, targets: Targets = targets) -> None:
            have = bins.get(pattern, 0)
            bins[pattern] = have + n
            if not bins[pattern]:
                del bins[pattern]
            if fill(pattern) < size and (not have) != (not have + n):
                (targets.remove if have else targets.add)(pattern)

        while number > least and targets.rooms.get(0):
            # the emptiest of those that are left; what was set aside is emptier still and no target
            source = next(iter(targets.patterns[0, targets.rooms[0][-1]]))
            alone = bins[source] == 1
            if alone:
                targets.remove(source)
            shift = shift_from(source, targets)
            if shift is None:
                if not alone:
                    targets.remove(source)
                continue
            if alone:
                targets.add(source)
            target, gone, come = shift
            times = bins[source] // 2 if source == target else min(bins[source], bins[target])
            changes = True
            add(source, -times)
            add(target, -times)
            add(changed(target, come, gone), times)
            rest = changed(source, gone, come)
            if rest:
                add(rest, times)
            else:
                number -= times
            if watch:
                watch(times, fill(tuple(gone)) - fill(tuple(come)))
    return sorted(bins.items(), key=lambda r: (-fill(r[0]), r[0]))


class Places:
    """Where the piece of a given length and rank goes: a sequence and an offset in it."""

    def __init__(self, runs: list[Run]):
        taken: dict[int, int] = {}
        rows = []
        sequence = 0
        for pattern, n in runs:
            offset = 0
            for length, k in pattern:
                rows.append((length, taken.get(length, 0), sequence, k, offset))
                taken[length] = taken.get(length, 0) + k * n
                offset += k * length
            sequence += n
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.length, self.low, self.first, self.each, self.offset = table.T.copy()
        self.key = (self.length << 48) | self.low

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 48) | rank, "right") - 1
        k = rank - self.low[i]
        return self.first[i] + k // self.each[i], self.offset[i] + k % self.each[i] * length


def pieces(docs: DataFrame, id_col: str, text_col: str, size: int, end: int, vocabulary: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only beyond `size`."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        release()
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for first, ids, at in encoded(batch.column(1), vocabulary, end):
                view = memoryview(ids.astype("<u4")).cast("B")
                for row, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True), first):
                    for piece, p in enumerate(range(s, e, size)):
                        q = min(p + size, e)
                        out.append((row, piece, p - s, q - p, zlib.crc32(view[4 * p : 4 * q])))
            if out:
                a = np.array(out, np.int64)
                columns = [pa.array(a[:, 1].astype(np.int32)), *(pa.array(np.ascontiguousarray(a[:, k])) for k in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a[:, 0])), *columns], names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4096,
    end: int = END,
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Ids need not be unique or known; equal rows are packed each; bytes that
    are no UTF-8 are read as replacement characters; texts of any length are read whole. An empty table gives no rows.
    Only the id and the text are read, whatever other columns are called.
    """
    spark = docs.sparkSession
    found = cut(pieces(docs, id_col, text_col, size, end, vocabulary or vocabulary_path()), "pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(local_search(first_packing(histogram, size), size)))

    # a length's cells: as many as each then has rows; the table has one row for a length, `size` at most
    cells = spark.createDataFrame([(n, isqrt(c - 1) + 1) for n, c in histogram.items()], "length long, cells long")
    celled = found.join(F.broadcast(cells), "length").withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("cells")))
    counted = celled.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = counted.select("length", "cell", (F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = celled.withColumn("row", F.row_number().over(within)).join(before, ["length", "cell"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("row") - 1 + F.col("before")).alias("rank"))

    def run(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = places.value.of(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"]
            )

    kind = found.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
