"""Extensions on Structured Streaming: pages that arrive are indexed batch by batch, and request rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index, page_terms


def ingest(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    id_col: str,
    text_col: str | None = None,
    fields: dict[str, Column] | None = None,
    metas: dict[str, Column] | None = None,
    deleted: Column | None = None,
) -> StreamingQuery:
    """Write each micro-batch's pages and terms under its number; a batch that runs twice overwrites itself.

    A page that comes again replaces its old terms, also with none; rows for which `deleted` holds delete theirs.
    """

    def write(batch: DataFrame, number: int) -> None:
        gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
        page_terms(batch.filter(~gone), id_col, text_col, fields, metas).distinct().write.mode("overwrite").parquet(f"{path}/terms/batch={number}")
        batch.select(F.col(id_col).cast("bigint").alias("page_id")).distinct().write.mode("overwrite").parquet(f"{path}/pages/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> Index:
    """The index of all batches: of a page that came several times, the last batch's terms."""
    last = spark.read.parquet(f"{path}/pages").groupBy("page_id").agg(F.max("batch").alias("batch"))
    terms = spark.read.parquet(f"{path}/terms")
    return Index.of(terms.join(last, ["page_id", "batch"], "left_semi").select("term", "page_id"))


def requests_per_minute(events: DataFrame, time_col: str = "ts") -> DataFrame:
    """(minute, requests); over a stream, set a watermark first."""
    return events.groupBy(F.window(time_col, "1 minute").alias("w")).agg(F.count("*").alias("requests")).select(F.col("w.start").alias("minute"), "requests")
