"""Repeated passages by hashed units: lines, split further at the ends of sentences and at anchor words.

A unit is normalised to its words, lower-cased (A-Z), whatever white space lies between them, and
identified by 96 bits of hashes of them. Of each repeated unit the occurrence of the smallest rank (document
id, row, position) stays. Other occurrences go where they form, with their neighbours, a run of at least
`least_words` words: short sentences that recur by chance stay. What goes is given as spans of the original text.

Anchor words are one in ANCHOR of all, chosen by hash. Units end behind them wherever they stand, so that a
passage is cut into the same units in any surroundings, also without an end of a sentence. The words before
a passage's first boundary share a unit with what precedes them and stay, as those behind its last do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keyed, spare
from .textvec import LOWER, U64, Chunk, chunks, mix, powers

#: One in so many distinct words is an anchor.
ANCHOR = 16
#: Runs of repeated units of fewer words stay.
LEAST_WORDS = 20

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in "\"')]"]] = True


def units(c: Chunk) -> tuple[np.ndarray, ...]:
    """Row, number in the row, start and end byte, words, and two hashes of every unit."""
    starts, ends, at = c.words()
    n = len(starts)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty, empty.view(U64), empty.view(U64)
    lines = np.concatenate([[0], np.cumsum(c.data == 10)])
    word = Chunk(0, LOWER[c.data], c.offsets).hashes(starts, ends)
    sign = c.data[ends - 1]
    inner = c.data[np.maximum(ends - 2, starts)]
    last = _STOP[sign] | (_CLOSE[sign] & _STOP[inner]) | (mix(word) % U64(ANCHOR) == 0)
    last[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    last[at[1:][np.diff(at) > 0] - 1] = True
    to = np.flatnonzero(last)
    first = np.concatenate([[0], to[:-1] + 1])
    up, down = powers(n + 1)
    digests = []
    for salt in (U64(0), U64(0x2545F4914F6CDD1D)):
        total = np.zeros(n + 1, U64)
        np.cumsum(mix(word ^ salt) * up[:n], out=total[1:])
        digests.append(mix((total[to + 1] - total[first]) * down[first] + (to + 1 - first).astype(U64)))
    row = np.searchsorted(at, first, "right") - 1
    begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=c.rows))])
    number = np.arange(len(to)) - begin[row]
    return row, number, starts[first], ends[to], to + 1 - first, *digests


def hashed_units(rows: DataFrame, row: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, the columns `row`, unit, start, end, words, h1, h2): all units, offsets in characters."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    source = rows.select(F.col(f"`{id_col}`").alias("doc_id"), *row, text)
    names = ["doc_id", *row, "unit", "start", "end", "words", "h1", "h2"]

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(batch.num_columns - 1)):
                of, number, start, end, words, h1, h2 = units(c)
                char = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
                origin = char[c.offsets[of]]
                at = pa.array(of + c.first)
                columns = [
                    *(batch.column(k).take(at) for k in range(batch.num_columns - 1)),
                    pa.array(number.astype(np.int32)),
                    *(pa.array((char[x] - origin).astype(np.int32)) for x in (start, end)),
                    pa.array(words.astype(np.int32)),
                    pa.array(h1.view(np.int64)),
                    pa.array((h2 >> U64(32)).astype(np.uint32).view(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, unit int, start int, end int, words int, h1 long, h2 int")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, row_key: list[Column] | None = None) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_ids): a row for each span of a text that occurs earlier.

    start and end are characters of the original text, end not included; first_doc_ids are the documents
    that keep the span's units, null ids left out. A null text has no unit; null ids rank first; rows of one id
    are texts of their own, also if they are equal, told apart by `row_key` (see common.keyed); texts of any
    length are read whole; an empty table gives no rows. Only the id and the text are read.
    """
    rows, row = keyed(docs, row_key)
    return _spans(rows, row, id_col, text_col, least_words).drop(*row)


def _spans(rows: DataFrame, row: list[str], id_col: str, text_col: str, least_words: int) -> DataFrame:
    """`spans` with the columns `row` behind the id."""
    found = cut(hashed_units(rows, row, id_col, text_col), "units")
    # written, so that the join below reads both sides plainly and a hot unit's rows can be split
    place = F.struct("doc_id", *row, "unit")
    earliest = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    earliest = cut(earliest, "earliest")
    later = (
        found.join(earliest, ["h1", "h2"])
        .filter(~place.eqNullSafe(F.col("first")))
        .select("doc_id", *row, "unit", "start", "end", "words", F.col("first.doc_id").alias("first_doc"))
    )
    run = F.col("unit") - F.row_number().over(Window.partitionBy(*row).orderBy("unit"))
    return (
        later.withColumn("run", run)
        .groupBy(*row, "run")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("words").alias("n_words"),
            F.array_sort(F.collect_set("first_doc")).alias("first_doc_ids"),
        )
        .filter(F.col("n_words") >= least_words)
        .select("doc_id", *row, "start", "end", "n_words", "first_doc_ids")
    )


def without_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, row_key: list[Column] | None = None) -> DataFrame:
    """`docs` with the repeated spans cut out of the texts; all other columns and all rows stay.

    Each row is a text of its own, as in `spans`; null texts stay null; an empty table gives an empty one; columns may
    have any names.
    """
    rows, row = keyed(docs, row_key)
    names = [spare(rows, f"of{k}") for k in range(len(row))]
    own = spare(rows, "spans")
    gone = (
        _spans(rows, row, id_col, text_col, least_words)
        .groupBy(*[F.col(r).alias(n) for r, n in zip(row, names, strict=True)])
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(own))
    )
    same = [F.col(r) == F.col(n) for r, n in zip(row, names, strict=True)]
    joined = rows.join(gone, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], own)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            # as bytes, which need not be UTF-8
            texts = batch.column(at).cast(pa.large_string()).view(pa.large_binary()).to_pylist()
            for i, cuts in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if cuts:
                    begins = np.flatnonzero((np.frombuffer(texts[i], np.uint8) & 0xC0) != 0x80).tolist() + [len(texts[i])]
                    bounds = [0, *(begins[x] for s in cuts for x in (s["start"], s["end"])), len(texts[i])]
                    texts[i] = b"".join(texts[i][a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
