"""Reading the page table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftpage.session import configure


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    """page_id, url, html.

    Parsing is CPU work, and a file with few row groups gives few tasks: ``parts`` spreads the rows
    over that many, html included, with a shuffle. Without it the scan is read as it is.
    """
    configure(spark)
    return spread(table(spark, folder, "pages").select("page_id", "url", "html"), "page_id", parts)


def spread(scan: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """The rows in ``parts`` partitions, by default as many as the session's ``spark.siftpage.parts`` says;
    as they are where neither is given."""
    parts = parts or int(scan.sparkSession.conf.get("spark.siftpage.parts", "0"))
    return scan.repartition(parts, key) if parts else scan
