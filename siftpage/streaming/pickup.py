"""Incremental classification: a file stream of pages, each batch classified and recorded once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siftpage.functions.url import url_key
from siftpage.sources.ledger_store import LedgerStore

PAGE_SCHEMA = "page_id bigint, url string, html string"


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    return (
        spark.readStream.schema(PAGE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(folder)
    )


def classify_stream(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    classify: Callable[[DataFrame], DataFrame],
    files_per_batch: int = 64,
) -> StreamingQuery:
    """Classifies every page file that is new since the last run, then stops.

    The checkpoint remembers the files already read. Each batch writes its own folder in overwrite
    mode, so a batch that is repeated after a failure replaces its rows instead of adding to them.
    """

    def write(batch: DataFrame, number: int) -> None:
        classify(batch).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    return (
        page_stream(spark, in_dir, files_per_batch)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def classified_updates(classified: DataFrame, at: Column) -> DataFrame:
    """Ledger updates of classified pages (url, verdict); a page without a verdict keeps its label."""
    return classified.filter("url is not null").select(
        "url",
        url_key(F.col("url")).alias("key"),
        F.col("verdict.label").alias("label"),
        F.lit("success").alias("scrape_status"),
        F.when(F.col("verdict").isNotNull(), "success").otherwise("pending").alias("extract_status"),
        F.lit("").alias("scrape_reason"),
        at.alias("scrape_completed_at"),
        at.alias("last_updated"),
    )


def record_stream(
    spark: SparkSession,
    in_dir: str,
    store: LedgerStore,
    out_dir: str,
    checkpoint: str,
    classify: Callable[[DataFrame], DataFrame],
    at: Column,
    name: str = "pages",
    files_per_batch: int = 64,
) -> StreamingQuery:
    """Classifies every page file that is new since the last run and records the pages in the ledger.

    A batch first writes its own folder of verdicts in overwrite mode, then lays its updates over the
    ledger under the stream's name and the batch's number. If it is repeated after a failure, the folder
    is replaced, and the ledger takes the updates only if its manifest has no such batch yet.
    """

    def record(batch: DataFrame, number: int) -> None:
        out = f"{out_dir}/batch={number}"
        classify(batch).write.mode("overwrite").parquet(out)
        store.upsert(classified_updates(spark.read.parquet(out), at), batch=(name, number))

    return (
        page_stream(spark, in_dir, files_per_batch)
        .writeStream.foreachBatch(record)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
