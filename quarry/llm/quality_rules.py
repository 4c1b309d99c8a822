"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

One pass over the texts measures every document and writes the measures beside what is kept of it. They are
added to a sketch per (language, source): a histogram over logarithmic buckets, which gives any quantile
within a fixed relative error and merges by adding counts, so that hot groups are summed map-side and no group
is ever gathered. From each sketch come fences, ``Q3 + spread * max(Q3 - Q1, floor)`` and the like, to which
each document of the group is joined.

Groups of fewer than `least_rows` documents take the fences of their language, and languages of
fewer those of the whole corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from .common import cut, drop_cut, spare, spare_prefix
from .textvec import U64, chunks, mix, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A fence on `value`; `spread` interquartile ranges, of `floor` at least, beyond the quartile."""

    name: str
    value: str
    side: str
    spread: float
    floor: float


#: Ratios are taken of documents that have words.
RULES = (
    Rule("symbols", "n_symbols / n_words", "above", 3.0, 0.05),
    Rule("duplicate_lines", "n_dup_lines / n_words", "above", 3.0, 0.01),
    Rule("repeated_words", "n_repeat_words / n_words", "above", 3.0, 0.08),
    Rule("long_words", "word_chars / n_words", "above", 6.0, 0.5),
    Rule("short_words", "word_chars / n_words", "below", 6.0, 0.4),
)

#: Buckets grow by this factor: a quantile is within 1 % of a value that has this rank.
GAMMA = 1.02
LEAST_VALUE = 1e-4


def _repeats(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True where the same key occurs twice or more for its owner."""
    both = key ^ mix(owner.astype(U64) + U64(1))
    order = np.argsort(both, kind="stable")
    s = both[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure_column(column: pa.Array) -> dict[str, np.ndarray]:
    """The five measures of every text of an Arrow column."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in MEASURES}
    for c in chunks(column):
        starts, ends, at = c.words()
        n = np.diff(at)
        parts["n_words"].append(n)
        inside = np.zeros(len(c.data) + 1, np.int32)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        parts["word_chars"].append(c.per_row((np.cumsum(inside[:-1]) > 0) & ((c.data & 0xC0) != 0x80)))
        parts["n_symbols"].append(c.per_row(SYMBOLS[c.data]))

        line_start, line_end = c.pieces(c.data == 10)
        row = np.searchsorted(c.offsets, line_start, "right") - 1
        has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
        line_hash, row = c.hashes(line_start, line_end)[has_word], row[has_word]
        both = line_hash ^ mix(row.astype(U64) + U64(1))
        _, first = np.unique(both, return_index=True)
        again = np.ones(len(both), bool)
        again[first] = False
        parts["n_dup_lines"].append(np.bincount(row[again], minlength=c.rows).astype(np.int64))

        tri, tri_at = windows(c.hashes(starts, ends), at, 3, whole=False)
        owner = np.repeat(np.arange(c.rows), np.diff(tri_at))
        # window k of row i begins at word at[i] + k
        first_word = np.arange(len(tri)) - np.repeat(tri_at[:-1], np.diff(tri_at)) + np.repeat(at[:-1], np.diff(tri_at))
        begin = first_word[_repeats(tri, owner)]
        cover = np.zeros(len(starts) + 4, bool)
        for k in range(3):
            cover[begin + k] = True
        total = np.concatenate([[0], np.cumsum(cover[: len(starts)])])
        parts["n_repeat_words"].append(total[at[1:]] - total[at[:-1]])
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in parts.items()}


def with_measures(docs: DataFrame, text_col: str = "text", prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with the measures, each a long, as more columns."""
    kept = docs.columns if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(spare(docs, "text_of")))

    def add(batches):
        for batch in batches:
            found = measure_column(batch.column(batch.num_columns - 1))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(found[k]) for k in MEASURES],
                [*batch.schema.names[:-1], *(prefix + k for k in MEASURES)],
            )

    schema = StructType(source.schema.fields[:-1] + [StructField(prefix + k, DataType.fromDDL("bigint")) for k in MEASURES])
    return source.mapInArrow(add, schema)


def _expr(value: str, prefix: str) -> Column:
    """A rule's value as a double; null for a document without words."""
    top, bottom = value.split(" / ")
    return F.when(F.col(prefix + bottom) > 0, F.col(prefix + top).cast("double") / F.col(prefix + bottom))


def bucket(value: Column) -> Column:
    """0 for values below LEAST_VALUE, else the k for which GAMMA**(k-1) < value / LEAST_VALUE <= GAMMA**k, plus one."""
    return F.when(value < LEAST_VALUE, F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.ceil(F.log(value / LEAST_VALUE) / float(np.log(GAMMA)))).cast("int") + 1
    )


def bucket_value(b: Column) -> Column:
    """The value that stands for a bucket, within GAMMA ** 0.5 of all in it."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.lit(LEAST_VALUE) * F.pow(F.lit(GAMMA), b - F.lit(1.5)))


def sketches(measured: DataFrame, lang_col: str, source_col: str, prefix: str) -> DataFrame:
    """Sketch rows (lang, source, rule, bucket, n): add `n` of equal keys to merge any two of them."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), bucket(_expr(r.value, prefix)).alias("bucket")) for i, r in enumerate(RULES)]))
    return (
        measured.filter(F.col(f"{prefix}n_words") > 0)
        .select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), values.alias("v"))
        .groupBy("lang", "source", "v.rule", "v.bucket")
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, least_rows: int) -> DataFrame:
    """(level, lang, source, fences array): quartiles of each merged sketch, then each rule's fence.

    level 2 is a (lang, source) pair, 1 a language, 0 the corpus; only those with `least_rows` documents
    are there, but for level 0.
    """
    levels = F.explode(F.array(F.lit(2), F.lit(1), F.lit(0)))
    merged = (
        sketch.withColumn("level", levels)
        .withColumn("source", F.when(F.col("level") == 2, F.col("source")))
        .withColumn("lang", F.when(F.col("level") >= 1, F.col("lang")))
        .groupBy("level", "lang", "source", "rule", "bucket")
        .agg(F.sum("n").alias("n"))
        # one sketch has at most some 2,000 buckets, whatever the number of documents
        .groupBy("level", "lang", "source", "rule")
        .agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("cells"), F.sum("n").alias("rows"))
    )

    def quantile(q: float) -> Column:
        reached = F.aggregate(
            "cells",
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("at")),
            lambda acc, x: F.struct(
                (acc["sum"] + x["n"]).alias("sum"),
                F.when((acc["at"] < 0) & (acc["sum"] + x["n"] >= F.ceil(F.col("rows") * F.lit(q))), x["bucket"]).otherwise(acc["at"]).alias("at"),
            ),
        )
        return bucket_value(reached["at"])

    q1, q3 = quantile(0.25), quantile(0.75)
    fence = F.lit(None).cast("double")
    for i, r in enumerate(RULES):
        width = F.greatest(F.col("q3") - F.col("q1"), F.lit(r.floor))
        edge = F.col("q3") + F.lit(r.spread) * width if r.side == "above" else F.col("q1") - F.lit(r.spread) * width
        fence = F.when(F.col("rule") == i, edge).otherwise(fence)
    return (
        merged.filter((F.col("rows") >= least_rows) | (F.col("level") == 0))
        .select("level", "lang", "source", "rule", q1.alias("q1"), q3.alias("q3"))
        .select("level", "lang", "source", "rule", fence.alias("fence"))
        .groupBy("level", "lang", "source")
        .agg(F.array_sort(F.collect_list(F.struct("rule", "fence"))).alias("cells"))
        .select("level", "lang", "source", F.transform("cells", lambda x: x["fence"]).alias("fences"))
    )


def judge(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_rows: int = 200,
    broadcast_rows: int = 200_000,
    prefix: str = "__q_",
    keep: list[str] | None = None,
) -> DataFrame:
    """`docs` (or its columns `keep`) with the measures, `base_failed` and `kept`, their names after `prefix`.

    A null text has no word and so fails; a null language or source is a group of its own. Texts of any length are
    measured whole. An empty table gives an empty result, repeated rows are judged alike, and other columns pass
    through, whatever they are called but for the result's own names.

    The fences are broadcast when there are at most `broadcast_rows` groups, counted first (some 150
    bytes each); beyond that they are joined by shuffle, where adaptive execution splits hot groups.
    """
    kept = docs.columns if keep is None else keep
    group = [spare(docs, n) for n in ("lang_of", "source_of")]
    own = spare_prefix(docs, "measured_")
    wide = docs.select("*", *[F.col(f"`{c}`").alias(n) for c, n in zip((lang_col, source_col), group, strict=True)])
    measured = cut(with_measures(wide, text_col, own, keep=[*kept, *group]), "quality-measures")
    sketch = cut(sketches(measured, *group, own), "quality-sketch")
    fence = cut(fences(sketch, least_rows), "quality-fences")
    drop_cut(sketch)

    small = fence.count() <= broadcast_rows
    hint = F.broadcast if small else (lambda df: df)
    levels = [spare(measured, n) for n in ("fence_0", "fence_1", "fence_2", "fence_lang", "fence_source", "fence_only_lang", "fence_all")]
    f0, f1, f2, l2, s2, l1, every = levels
    pair = fence.filter("level = 2").select(F.col("lang").alias(l2), F.col("source").alias(s2), F.col("fences").alias(f2))
    language = fence.filter("level = 1").select(F.col("lang").alias(l1), F.col("fences").alias(f1))
    # one row at most
    corpus = fence.filter("level = 0").select(F.col("fences").alias(f0))
    lang, source = (F.col(n) for n in group)
    joined = (
        measured.join(hint(pair), lang.eqNullSafe(F.col(l2)) & source.eqNullSafe(F.col(s2)), "left")
        .join(hint(language), lang.eqNullSafe(F.col(l1)), "left")
        .join(F.broadcast(corpus), F.lit(True), "left")
        .withColumn(every, F.coalesce(f2, f1, f0))
    )
    n = F.col(own + "n_words")
    failed = (n < 50) | (F.col(own + "n_repeat_words") * 100 > n * 50)
    outside = F.lit(False)
    for i, r in enumerate(RULES):
        value, fence_i = _expr(r.value, own), F.element_at(every, i + 1)
        outside = outside | F.coalesce(value > fence_i if r.side == "above" else value < fence_i, F.lit(False))
    return joined.select(
        *[F.col(f"`{c}`") for c in kept],
        *[F.col(own + k).alias(prefix + k) for k in MEASURES],
        failed.alias(f"{prefix}base_failed"),
        (~failed & ~outside).alias(f"{prefix}kept"),
    )


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """Only the documents that the rules of `judge` keep, with the columns of `docs` alone.

    Nulls, long texts, repeated rows and an empty table are treated as there; columns may have any names.
    """
    prefix = spare_prefix(docs, "judged_")
    judged = judge(docs, prefix=prefix, **options)
    return judged.filter(F.col(f"{prefix}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
