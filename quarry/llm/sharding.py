"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows are first held in logical partitions. A hash of the id, the text and, if it is given, the row's key
decides, so the result does not depend on how Spark happens to split its input. How many rows of each partition go to each
shard is drawn exactly, one multivariate hypergeometric draw a partition, so all shard sizes are
exact and every assignment is equally likely. Rows are permuted within their partition, sent by
the matrix, and permuted again within their shard.

All row work is in DataFrame functions; the driver only draws the matrix, whose size is the number of
logical partitions (one for `rows_per_partition` rows) times the number of shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keyed, target_partitions

#: Rows of the matrix, of some 200 bytes each, that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def communication_matrix(counts: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Row p: how many of partition p's `counts[p]` rows each shard gets. Columns sum to `shard_sizes`."""
    left = np.array(shard_sizes, np.int64)
    rng = np.random.default_rng(seed)
    matrix = []
    for n in counts:
        draw = np.zeros(len(left), np.int64)
        rest, total = n, int(left.sum())
        for s, size in enumerate(left.tolist()):
            if rest == 0:
                break
            total -= size
            got = rest if total == 0 else _hypergeometric(rng, size, total, rest)
            draw[s] = got
            rest -= got
        left -= draw
        matrix.append(draw.tolist())
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric draw; past numpy's bound of 1e9, by inversion of the probabilities about the mode."""
    if good == 0 or draws == 0:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad
    deviation = (draws * (good / n) * (bad / n) * ((n - draws) / (n - 1))) ** 0.5
    mode = (draws + 1) * (good + 1) // (n + 2)
    low, high = max(0, draws - bad, int(mode - 40 * deviation - 40)), min(good, draws, int(mode + 40 * deviation + 40))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((draws - k) / (bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    total = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(total, rng.random() * total[-1], "right"))


def _values(spark, rows: list[list[int]], p: str, name: str) -> DataFrame:
    """A table (p int, name array<bigint>) from one literal, without Python data on the executors."""
    text = ";".join(",".join(map(str, row)) for row in rows or [[0]])
    split = spark.range(1).select(F.posexplode(F.split(F.lit(text), ";")).alias(p, "row"))
    return split.select(p, F.transform(F.split("row", ","), lambda x: x.cast("long")).alias(name))


def _joined(rows: DataFrame, small: DataFrame, n_rows: int, on: Column) -> DataFrame:
    """`rows` with those of a table of known size, which is broadcast if it is no larger than BROADCAST_ROWS."""
    return rows.join(F.broadcast(small) if n_rows <= BROADCAST_ROWS else small, on)


def shard(
    docs: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 20_240_501,
    rows_per_partition: int = 250_000,
    least_partitions: int = 64,
    row_key: list[Column] | None = None,
) -> DataFrame:
    """One row per row of `docs`: its id, size, text_crc32, law, shard, slot and grown_shard (null).

    Shard sizes are n // n_shards or one more. A null text has size 1 and the checksum of no bytes; a
    null id is an id like others; equal rows each get their own slot, and spread over the partitions if `row_key`
    (see common.keyed) tells them apart; texts of any length are read whole; an empty table gives no rows. Only the id and the text are read,
    whatever other columns are called.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows, row = keyed(docs, row_key)
    base = cut(
        rows.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.struct(*row).alias("__tie"),
        ),
        "shard-base",
    )
    n = base.count()

    def draw(salt: int) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(salt), "doc_id", "text_crc32", "size", *(["__tie"] if row_key else []))

    n_parts = target_partitions(n, rows_per_partition, least_partitions)
    placed = base.withColumn("__p", F.pmod(draw(0), F.lit(n_parts)).cast("int"))
    counted = {r["__p"]: r["n"] for r in placed.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([counted.get(p, 0) for p in range(n_parts)], sizes, seed)
    upto = [np.cumsum(row).tolist() for row in matrix]

    local = Window.partitionBy("__p").orderBy(draw(1), "doc_id", "__tie")
    sent = (
        _joined(placed.withColumn("__rank", F.row_number().over(local)), _values(spark, upto, "__mp", "__upto"), n_parts, F.col("__p") == F.col("__mp"))
        .withColumn("shard", F.size(F.filter("__upto", lambda x: x < F.col("__rank"))).cast("int"))
    )

    # the second permutation, in cells of a shard: the cells follow one another and each is permuted
    n_cells = target_partitions(-(-n // n_shards), rows_per_partition, max(1, least_partitions // n_shards))
    celled = cut(
        sent.select("doc_id", "size", "text_crc32", "shard", "__tie", draw(2).alias("__draw")).withColumn(
            "__cell", F.pmod("__draw", F.lit(n_cells)).cast("int")
        ),
        "shard-sent",
    )
    per_cell = {(r["shard"], r["__cell"]): r["n"] for r in celled.groupBy("shard", "__cell").agg(F.count("*").alias("n")).collect()}
    before = []
    for s in range(n_shards):
        row = [per_cell.get((s, c), 0) for c in range(n_cells)]
        before.append([0, *np.cumsum(row).tolist()])
    within = Window.partitionBy("shard", "__cell").orderBy("__draw", "doc_id", "__tie")
    return (
        # one row a shard
        _joined(celled.withColumn("__rank", F.row_number().over(within)), _values(spark, before, "__ms", "__before"), n_shards, F.col("shard") == F.col("__ms"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.element_at("__before", F.col("__cell") + 1) + F.col("__rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
