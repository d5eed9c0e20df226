"""File sources and sinks: URL tables, raw pages, snapshots, features, ledger, predictions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpage.operators.decide import batch_row
from siftpage.operators.evaluate import export_rows
from siftpage.operators.features import FEATURE_COLUMNS
from siftpage.operators.ledger import LEDGER, accepted_urls, rejected_urls

BATCH_COLUMNS = (
    "url", "predicted_label", "confidence", "method", "fallback_used", "scrape_status", "status",
)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; ``row`` rises with the position in the file."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return rows.withColumn("row", F.monotonically_increasing_id())


def labelled_urls(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a CSV with columns url and label."""
    rows = _csv(spark, path)
    return accepted_urls(rows), rejected_urls(rows)


def batch_urls(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a CSV whose column is called url or URL; blank ones dropped."""
    rows = spark.read.option("header", True).csv(path)
    return pick_url(rows)


def pick_url(rows: DataFrame) -> DataFrame:
    """Case matters here, so the two spellings are told apart by position, not by name."""
    columns = rows.columns
    named = rows.toDF(*[f"c{i}" for i in range(len(columns))])
    order = [i for want in ("url", "URL") for i, c in enumerate(columns) if c == want]
    if not order:
        raise ValueError("no column named url")
    values: list[Column] = [F.nullif(F.col(f"c{i}"), F.lit("")) for i in order]
    picked = F.trim(F.coalesce(*values))
    return named.select(picked.alias("url")).filter(F.coalesce("url", F.lit("")) != "")


def raw_pages(spark: SparkSession, root: str) -> DataFrame:
    """key, label, html of ``root/<label>/<key>/raw.html``; undecodable bytes become U+FFFD."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "raw.html").load(root)
    )
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -2).alias("key"),
        F.element_at(parts, -3).alias("label"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("html"),
    )


def with_urls(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Raw pages with the URL looked up by key: null when unknown, and when several URLs share the key, which
    ``ambiguous`` tells apart."""
    once = known.filter("url is not null").groupBy("key").agg(F.min("url").alias("_a"), F.max("url").alias("_b"))
    looked = once.select("key", F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias("url"), (F.col("_a") != F.col("_b")).alias("ambiguous"))
    return raw.join(looked, "key", "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_snapshots(snapshots: DataFrame, path: str, as_json: bool = False) -> None:
    writer = snapshots.write.mode("overwrite")
    writer.json(path) if as_json else writer.parquet(path)


def read_snapshots(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Stored snapshots; JSON ones need the schema of the records that were written."""
    return spark.read.schema(schema).json(path) if schema else spark.read.parquet(path)


def predicted_pages(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """key, label, html, url of ``root/<predicted label>/<key>/raw.html``, URLs from the ledger or the
    stored predictions (``known``: key, url)."""
    return with_urls(raw_pages(spark, root), known)


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """key, label and files (array) of what lies in ``root/<label>/<key>/``; contents are not read."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    )
    parts = F.split("path", "/")
    named = listed.select(
        F.element_at(parts, -3).alias("label"),
        F.element_at(parts, -2).alias("key"),
        F.element_at(parts, -1).alias("file"),
    )
    return named.groupBy("label", "key").agg(F.sort_array(F.collect_set("file")).alias("files"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Stored features; a feature an older store lacks is read as 0."""
    stored = spark.read.parquet(path)
    filled = {c: F.lit(0) for c in FEATURE_COLUMNS if c not in stored.columns}
    return stored.withColumns(filled) if filled else stored


def read_ledger(spark: SparkSession, root: str, version: int | None) -> DataFrame:
    """Version ``version`` of the ledger; an empty ledger when there is none yet."""
    if version is None:
        return spark.createDataFrame([], LEDGER)
    return spark.read.parquet(f"{root}/v={version}")


def write_ledger(ledger: DataFrame, root: str, version: int) -> None:
    """Writes a new version; the one it was computed from stays readable meanwhile."""
    ledger.write.mode("error").parquet(f"{root}/v={version}")


def prediction_rows(predictions: DataFrame, at: Column, status: Column) -> DataFrame:
    """Prediction records with time, fetch status and the list of stored files."""
    ok = status == "success"
    files = F.when(
        ok, F.array(F.lit("raw.html"), F.lit("features.json"), F.lit("prediction.json"))
    ).otherwise(F.array(F.lit("prediction.json")))
    return predictions.withColumns({"predicted_at": at, "status": status, "files": files})


def write_predictions(predictions: DataFrame, path: str) -> None:
    write_table(predictions, path, "predicted_label")


def batch_results(results: DataFrame) -> DataFrame:
    """The seven columns of the batch file; failures show their own name as label."""
    label = batch_row(F.col("status"), F.col("predicted_label"))
    return results.withColumn("predicted_label", label).select(*BATCH_COLUMNS)


def write_csv(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("nullValue", "")
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)


def write_misclassified(wrong: DataFrame, root: str) -> None:
    """All wrong rows, and the same rows by actual class."""
    write_csv(wrong, f"{root}/all")
    write_csv(wrong, f"{root}/by_class", "actual")


def write_evaluation(verdicts: DataFrame, path: str) -> None:
    write_csv(export_rows(verdicts), path)
