"""Near-duplicate lines by a segment-partition edit join.

Two lines are linked if their edit distance over UTF-8 bytes is at most t of the shorter one: 0 below 10
bytes, 1 below 20, else 2. A line of length n is split into t(n) + 1 even segments. A line within the
distance holds one of them whole, and at few places: for each length and segment it is probed at
the positions that t edits can shift the segment to, counted from the left and from the right.

Segments and probes are hashed with their length and number. The segments of all lines form a key set
on the workers (see keysets), so that probes which meet nothing are never shuffled. The keys that do meet
another line form a second set; only the lines that have those are sent, with their texts, to where
banded bit-parallel edit distance verifies them. Of each key only a spanning forest of the links leaves
the task, so a thousand variants of a line make a thousand rows and not a million.

Many lines may share a segment and nothing else, as lines with one beginning do. The lines of such a key are
dealt to pairs of blocks, a task's work each, and only pairs whose byte pairs are nearly the same are verified:
an edit changes at most four bits of a line's 256-bit map of them.

Equal lines are one node of the join. A class is a connected component of links; its earliest line
(document id, line number) is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, keyed, spare
from .components import components
from .keysets import BLOCK, Shipper, build, parts_for
from .simhash import breadth_first, dealt, sorted_groups, spanning
from .textvec import SPACE, U64, Chunk, chunks, mix, powers

#: Lines shorter than the first number must be equal, than the second may differ by one byte, else by two.
LIMITS = (10, 20)
MOST = len(LIMITS)
#: Lines that are compared in one task.
MOST_LINES = 16_384


def allowed(length: np.ndarray) -> np.ndarray:
    return (length >= LIMITS[0]).astype(np.int64) + (length >= LIMITS[1])


def trimmed(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each line that has a word, without white space at its ends."""
    start, end = c.pieces(c.data == 10)
    blank = SPACE[c.data]
    start, end = start.copy(), end.copy()
    for side, step in ((start, 1), (end, -1)):
        at = np.arange(len(start))
        for _ in range(64):
            at = at[(start[at] < end[at])]
            at = at[blank[side[at] - (step < 0)]]
            if not len(at):
                break
            side[at] += step
        else:  # long runs of white space: look the next word up
            words = np.flatnonzero(~blank)
            if step > 0:
                side[at] = np.minimum(np.append(words, len(blank))[np.searchsorted(words, side[at])], end[at])
            else:
                side[at] = np.maximum(np.append(words, -1)[np.searchsorted(words, side[at]) - 1] + 1, start[at])
    has = end > start
    return start[has], end[has]


def lines(c: Chunk) -> tuple[np.ndarray, ...]:
    """Row, number in the row, start, end and hash of each line that has a word."""
    start, end = trimmed(c)
    row = np.searchsorted(c.offsets, start, "right") - 1
    breaks = np.flatnonzero(c.data == 10)
    number = np.searchsorted(breaks, start) - np.searchsorted(breaks, c.offsets[row])
    return row, number, start, end, c.hashes(start, end)


class Substrings:
    """Hashes of many substrings of a chunk at once."""

    def __init__(self, c: Chunk):
        up, self.down = powers(len(c.data) + 1)
        self.total = np.zeros(len(c.data) + 1, U64)
        np.cumsum((c.data.astype(U64) + U64(1)) * up[: len(c.data)], out=self.total[1:])

    def whole(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """As Chunk.hashes gives them."""
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U64))

    def keys(self, start: np.ndarray, size: np.ndarray, length: np.ndarray, segment: int) -> np.ndarray:
        h = (self.total[start + size] - self.total[start]) * self.down[start]
        return mix(h ^ mix(length.astype(U64) * U64(8) + U64(segment)))


def segments(length: np.ndarray, parts: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Where segment i of `parts` begins and how long it is: the last ones take what is over."""
    base, over = length // parts, length % parts
    longer = np.maximum(i - (parts - over), 0)
    return i * base + longer, base + (i >= parts - over)


def index_keys(sub: Substrings, start: np.ndarray, length: np.ndarray):
    """(which lines, their keys) for every segment of every line."""
    t = allowed(length)
    for most in range(MOST + 1):
        of = np.flatnonzero(t == most)
        for i in range(most + 1):
            at, size = segments(length[of], most + 1, i)
            yield of, sub.keys(start[of] + at, size, length[of], i)


def probe_keys(sub: Substrings, start: np.ndarray, length: np.ndarray):
    """(which lines, their keys) for all substrings that may be a segment of a line not longer than them.

    The line's own segments are among them.
    """
    for less in range(MOST + 1):
        other = length - less
        t = allowed(np.maximum(other, 0))
        for most in range(less, MOST + 1):
            of = np.flatnonzero((t == most) & (other > 0))
            if not len(of):
                continue
            for i in range(most + 1):
                at, size = segments(other[of], most + 1, i)
                for shift in range(max(-i, less - (most - i)), min(i, less + (most - i)) + 1):
                    fits = (at + shift >= 0) & (at + shift + size <= length[of])
                    yield of[fits], sub.keys((start[of] + at + shift)[fits], size[fits], other[of][fits], i)


# --- verification ----------------------------------------------------------------------------------


def banded_distance(pairs: list[tuple[bytes, bytes]], most: int) -> np.ndarray:
    """The edit distance of each pair, or `most` + 1 if it is more: bit-parallel along a band of 2 * most + 1 rows.

    Column by column for all pairs at once, bit r stands for the row that is `most` - r above the diagonal;
    the distance is followed along the diagonal and then down the last column.
    """
    out = np.full(len(pairs), most + 1, np.int64)
    work = []
    for k, (a, b) in enumerate(pairs):
        if len(a) < len(b):
            a, b = b, a
        if len(a) - len(b) > most:
            continue
        if a == b:
            out[k] = 0
            continue
        x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        n = len(y)
        differ = x[:n] != y
        head = int(differ.argmax()) if differ.any() else n
        rest = n - head
        differ = x[len(x) - rest :] != y[head:]
        tail = int(differ[::-1].argmax()) if differ.any() else rest
        x, y = x[head : len(x) - tail], y[head : n - tail]
        if not len(y):
            out[k] = len(x)
        else:
            work.append((len(y), k, x, y))
    work.sort(key=lambda w: -w[0])
    at = 0
    while at < len(work):
        # batches of pairs of like length, of bounded size
        size = max(1, min(len(work) - at, 4_000_000 // (work[at][0] + 1)))
        _banded(work[at : at + size], most, out)
        at += size
    return out


def _banded(work: list, most: int, out: np.ndarray) -> None:
    n = np.array([w[0] for w in work])
    where = np.array([w[1] for w in work])
    over = np.array([len(w[2]) for w in work]) - n
    width = int(n[0])
    a = np.full((len(work), width + 3 * most + 2), 256, np.uint16)
    b = np.full((len(work), width), 257, np.uint16)
    for k, (_, _, x, y) in enumerate(work):
        a[k, most : most + len(x)] = x
        b[k, : len(y)] = y
    rows = 2 * most + 1
    mask = np.uint32((1 << rows) - 1)
    vp = np.full(len(work), ((1 << (most + 1)) - 1) << most, np.uint32)
    vn = np.zeros(len(work), np.uint32)
    distance = np.zeros(len(work), np.int64)
    for j in range(1, width + 1):
        match = np.zeros(len(n), np.uint32)
        for r in range(rows):
            match |= (a[:, j - 1 + r] == b[:, j - 1]).astype(np.uint32) << np.uint32(r)
        zero = ((((match & vp) + vp) ^ vp) | match | vn) & mask
        across_up = (vn | ~(zero | vp)) & mask
        across_down = zero & vp
        distance += 1 - (zero >> np.uint32(most) & np.uint32(1)).astype(np.int64)
        below = zero >> np.uint32(1)
        vp = (across_down | ~(below | across_up)) & mask
        vn = below & across_up
        # the longest come first, so the pairs that end here are the last ones
        live = len(n)
        while live and n[live - 1] == j:
            live -= 1
        if live < len(n):
            last = distance[live:].copy()
            for r in range(most):
                inside = r < over[live:]
                last += np.where(inside, (vp[live:] >> np.uint32(most + r) & np.uint32(1)).astype(np.int64) - (vn[live:] >> np.uint32(most + r) & np.uint32(1)).astype(np.int64), 0)
            out[where[live:]] = np.minimum(last, most + 1)
        # no cell of a column's band is more than `most` below the diagonal one, which never falls
        keep = np.flatnonzero(distance[:live] <= 2 * most) if j % 4 == 0 or live < len(n) else None
        if keep is not None and len(keep) < len(n):
            if not len(keep):
                return
            a, b, vp, vn, distance, n, where, over = (x[keep] for x in (a, b, vp, vn, distance, n, where, over))


def pair_maps(texts: list[bytes]) -> np.ndarray:
    """For each text 256 bits (four words), those that its pairs of neighbouring bytes hash to."""
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(texts)), size)
    bucket = ((data[:-1] * 256 + data[1:]) * np.uint32(2654435761) >> np.uint32(24)).astype(np.int64)
    inside = row[:-1] == row[1:]
    found = np.zeros((len(texts), 256), bool)
    found[row[:-1][inside], bucket[inside]] = True
    return np.packbits(found, axis=1).view(U64)


def forest(texts: list[bytes], index: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links among distinct lines of one key, each pair with an indexed one of the two."""
    length = np.array([len(t) for t in texts])
    t = allowed(length)
    maps = pair_maps(texts)

    def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = np.minimum(t[a][:, None], t[b])
        close = (np.abs(length[a][:, None] - length[b]) <= most) & (index[a][:, None] | index[b])
        apart = np.zeros(close.shape, np.uint8)
        for k in range(maps.shape[1]):
            apart += np.bitwise_count(maps[a, k][:, None] ^ maps[b, k])
        i, j = np.nonzero(close & (apart <= 4 * most))
        i, j = a[i], b[j]
        i, j = i[i != j], j[i != j]
        d = [banded_distance([(texts[x], texts[y]) for x, y in zip(i[s : s + 4096].tolist(), j[s : s + 4096].tolist(), strict=True)], MOST) for s in range(0, len(i), 4096)]
        linked = np.concatenate(d) <= np.minimum(t[i], t[j]) if d else np.zeros(0, bool)
        return i[linked], j[linked]

    return breadth_first(index, near)


# --- the join --------------------------------------------------------------------------------------


def _distinct_lines(c: Chunk) -> tuple[Substrings, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's substrings, and start, length and hash of its distinct lines."""
    start, end = trimmed(c)
    sub = Substrings(c)
    h, first = np.unique(sub.whole(start, end), return_index=True)
    return sub, start[first], (end - start)[first], h


def _rows(h: np.ndarray, pairs: list[tuple[int, int]]) -> list[pa.RecordBatch]:
    found = spanning(pairs)
    if not found:
        return []
    i, j = np.array(found).T
    return [pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(h[j])], ["a", "b"])]


def _settle(groups: list[tuple[np.ndarray, list[bytes], list[tuple[int, int]]]]) -> list[pa.RecordBatch]:
    """The links of small groups, (hashes, texts, pairs to verify) each."""
    asked = [(text[i], text[j]) for _, text, pairs in groups for i, j in pairs]
    if not asked:
        return []
    d = banded_distance(asked, MOST)
    most = allowed(np.array([min(len(x), len(y)) for x, y in asked]))
    close = (d <= most).tolist()
    at, a, b = 0, [], []
    for h, _, pairs in groups:
        own = [p for p, yes in zip(pairs, close[at : at + len(pairs)], strict=True) if yes]
        at += len(pairs)
        for i, j in spanning(own):
            a.append(int(h[i]))
            b.append(int(h[j]))
    return [pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])] if a else []


def links(texts: DataFrame) -> DataFrame:
    """(a, b): links among the hashes of distinct lines of `text` that join all that are close."""
    parts = parts_for(texts, "text", 60)

    def own_segments(batches):
        shipper = Shipper(parts)
        for batch in batches:
            for c in chunks(batch.column(0)):
                sub, start, length, h = _distinct_lines(c)
                for of, key in index_keys(sub, start, length):
                    yield from shipper.add(key, h[of])
        yield from shipper.ship()

    every, shared = build(texts.mapInArrow(own_segments, BLOCK), parts, 1, 2)

    def met(batches):
        """Keys that some line probes and another has: owners 0 and 1 make two."""
        shipper = Shipper(parts)
        for batch in batches:
            for c in chunks(batch.column(0)):
                sub, start, length, h = _distinct_lines(c)
                own = np.unique(np.concatenate([key for _, key in index_keys(sub, start, length)] or [np.zeros(0, U64)]))
                probes = np.concatenate([key for _, key in probe_keys(sub, start, length)] or [np.zeros(0, U64)])
                probes, times = np.unique(probes, return_counts=True)
                hit = every.contains(probes)
                probes, times = probes[hit], times[hit]
                # a key that this line alone has and probes once meets no other
                alone = np.isin(probes, own, assume_unique=True) & (times == 1)
                alone[alone] = ~shared.contains(probes[alone])
                probes = probes[~alone]
                yield from shipper.add(np.concatenate([probes, probes]), np.repeat(np.array([0, 1], U64), len(probes)))
        yield from shipper.ship()

    (meeting,) = build(texts.mapInArrow(met, BLOCK), parts, 2)

    def members(batches):
        for batch in batches:
            for c in chunks(batch.column(0)):
                sub, start, length, h = _distinct_lines(c)
                which, keys, index = [], [], []
                for is_index, found in ((True, index_keys(sub, start, length)), (False, probe_keys(sub, start, length))):
                    for of, key in found:
                        which.append(of)
                        keys.append(key)
                        index.append(np.full(len(of), is_index))
                if not which:
                    continue
                of, key, is_index = (np.concatenate(x) for x in (which, keys, index))
                hit = meeting.contains(key)
                of, key, is_index = of[hit], key[hit], is_index[hit]
                # a line's own segments come first, its probes of the same keys are left out
                order = np.lexsort((~is_index, of, key))
                of, key, is_index = of[order], key[order], is_index[order]
                new = np.ones(len(of), bool)
                new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                of, key, is_index = of[new], key[new], is_index[new]
                if len(of):
                    text = [c.data[s : s + n].tobytes() for s, n in zip(start[of].tolist(), length[of].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(h[of].view(np.int64)), pa.array(is_index), pa.array(text, pa.binary())],
                        ["key", "line", "indexed", "text"],
                    )

    def verify(batches):
        held: list[tuple[np.ndarray, list[bytes], list[tuple[int, int]]]] = []
        waiting = 0
        for table in sorted_groups(batches):
            h = np.concatenate([b.column(1).to_numpy() for b in table])
            h, first = np.unique(h, return_index=True)
            if len(h) < 2:
                continue
            index = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in table])[first]
            text = pa.chunked_array([b.column(3) for b in table]).take(pa.array(first)).to_pylist()
            if len(h) > 8:
                yield from _rows(h, forest(text, index))
                continue
            # the pairs of small groups are verified many groups at a time
            length = np.array([len(t) for t in text])
            t = allowed(length)
            i, j = np.nonzero(np.triu(np.abs(length[:, None] - length) <= np.minimum(t[:, None], t), 1) & (index[:, None] | index))
            if len(i):
                held.append((h, text, list(zip(i.tolist(), j.tolist(), strict=True))))
                waiting += len(i)
            if waiting >= 4000:
                yield from _settle(held)
                held, waiting = [], 0
        yield from _settle(held)

    sent = cut(texts.mapInArrow(members, "key long, line long, indexed boolean, text binary"), "line-members")
    cells = dealt(sent, "line", MOST_LINES).repartition("cell").sortWithinPartitions("cell")
    found = cut(cells.mapInArrow(verify, "a long, b long"), "line-links")
    drop_cut(sent)
    for one in (every, shared, meeting):
        one.drop(texts.sparkSession)
    return found


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_key: list[Column] | None = None) -> DataFrame:
    """One row per line with a word: doc_id, line_no (from 0), start, end, class_doc_id, class_line_no, class_size, kept.

    The class is named by its earliest line (id, row, number); class_size counts its lines; kept is true for
    the earliest alone. start and end are characters of the text, white space at the line's ends left out.
    Null texts and lines without a word have no row; null ids rank first; rows of one id are texts of their
    own, also if they are equal, told apart by `row_key` (see common.keyed); lines of any length are compared
    whole; an empty table gives no rows. Only the id and the text are read, whatever other columns are called.
    """
    rows, row = keyed(docs, row_key)
    return _classes(rows, row, id_col, text_col).drop(*row)


def _classes(rows: DataFrame, row: list[str], id_col: str, text_col: str) -> DataFrame:
    """`classes` with the columns `row` behind the id."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    joined = links(rows.select(text))
    roots = components(joined)
    drop_cut(joined)
    source = rows.select(F.col(f"`{id_col}`").alias("doc_id"), *row, text)
    names = ["doc_id", *row, "line_no", "start", "end", "line"]

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(batch.num_columns - 1)):
                of, number, start, end, h = lines(c)
                char = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
                origin = char[c.offsets[of]]
                at = pa.array(of + c.first)
                columns = [
                    *(batch.column(k).take(at) for k in range(batch.num_columns - 1)),
                    pa.array(number.astype(np.int32)),
                    *(pa.array((char[x] - origin).astype(np.int32)) for x in (start, end)),
                    pa.array(h.view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    found = source.mapInArrow(run, f"{kinds}, line_no int, start int, end int, line long")
    named = found.join(roots, F.col("line") == F.col("node"), "left").withColumn("root", F.coalesce("root", "line"))
    named = cut(named.select("doc_id", *row, "line_no", "start", "end", "root"), "lines")
    # written, so that the join below reads both sides plainly and a hot class's rows can be split
    place = F.struct("doc_id", *row, "line_no")
    first = cut(named.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("class_size")), "line-classes")
    return named.join(first, "root").select(
        "doc_id",
        *row,
        "line_no",
        "start",
        "end",
        F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.line_no").alias("class_line_no"),
        "class_size",
        place.eqNullSafe(F.col("first")).alias("kept"),
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 0, row_key: list[Column] | None = None) -> DataFrame:
    """`docs` without lines that are near an earlier one; documents left without a line go.

    Lines shorter than `least_chars` characters stay. Each row is a text of its own, also if rows share an id or are
    equal (the first of equal rows stays); null ids rank first. A document that had no line with a word, or a null
    text, stays as it is. Line breaks of removed lines go with them. Lines and texts of any length are treated whole;
    an empty table gives an empty one; columns may have any names.
    """
    rows, row = keyed(docs, row_key)
    names = [spare(rows, f"of{k}") for k in range(len(row))]
    drop, new = spare(rows, "gone"), spare(rows, "rest")
    gone = (
        _classes(rows, row, id_col, text_col)
        .filter(~F.col("kept") & (F.col("end") - F.col("start") >= least_chars))
        .groupBy(*[F.col(r).alias(n) for r, n in zip(row, names, strict=True)])
        .agg(F.collect_set("line_no").alias(drop))
    )
    text = F.col(f"`{text_col}`")
    line = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(line) - 1), F.col(drop))
    rest = F.array_join(F.transform(left, lambda i: F.get(line, i)), "\n")
    same = [F.col(r) == F.col(n) for r, n in zip(row, names, strict=True)]
    joined = rows.join(gone, same, "left").withColumn(new, F.when(F.col(drop).isNull(), text).otherwise(rest))
    joined = joined.filter(F.col(drop).isNull() | F.col(new).rlike("[^\\x20\\x09-\\x0D]"))
    return joined.select(*[F.col(new).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
