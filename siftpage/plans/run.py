"""A run over stores, from URLs to predictions and evaluation, each step on what the ledger says is due.

    root/ledger        status of every URL (``LedgerStore``)
    root/pages         fetched pages (``PageStore``)
    root/features      features and rule verdicts with the hash of their page, a folder for each extraction
    root/predictions   prediction records by label
    root/evaluation    the three verdicts of each held-out sample

A step reads the newest ledger, does what is due and records it, so that a step that is repeated or broken
off does nothing twice. Only training needs all features at once; the rest goes by what is new.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpage.operators.features import FEATURE_COLUMNS
from siftpage.operators.ledger import extract_outcome, fetch_outcome, register
from siftpage.operators.reports import status_rollup
from siftpage.plans.classify import evaluate, parsed_pages, predict_parsed, train
from siftpage.sources.files import prediction_rows, write_evaluation, write_predictions
from siftpage.sources.ledger_store import LedgerStore
from siftpage.sources.page_store import PageStore
from siftpage.sources.shared_files import names

#: Stored beside the features, for ``predicted`` alone.
ABOUT = ("content", "jsonld", "x_blank")


class StoredRun:
    """``at``: the time that the steps stamp their records with."""

    def __init__(self, spark: SparkSession, root: str, at: Column, buckets: int = 64):
        self.spark, self.root, self.at = spark, root.rstrip("/"), at
        self.ledger = LedgerStore(spark, f"{self.root}/ledger", buckets)
        self.pages = PageStore(spark, f"{self.root}/pages")

    def intake(self, urls: DataFrame) -> int:
        """Registers URLs (url, label, row) that the ledger has not finished; the ledger's version."""
        return self.ledger.upsert(register(self.ledger.pick_new(urls), self.at))

    def fetched(self, results: DataFrame) -> int:
        """Stores what a crawler brings (url, html, reason; html null: failed) of URLs that are pending."""
        due = self.ledger.read().filter("scrape_status = 'pending'").select("url", "label")
        write = f"{self.root}/fetched/{uuid.uuid4().hex}"
        results.join(due, "url").write.parquet(write)
        found = self.spark.read.parquet(write)
        ok = F.col("html").isNotNull()
        self.pages.add(found.filter(ok).select("url", "label", "html"))
        told = found.select(
            "url", F.when(ok, "success").otherwise("failed").alias("status"), "reason", ok.alias("has_html"), F.lit(False).alias("has_page")
        )
        return self.ledger.upsert(fetch_outcome(told, self.at))

    def extracted(self, jsonld: bool = False, retry_failed: bool = False) -> int:
        """Features and rule verdicts of fetched pages that have none; a page without content fails."""
        over = ("success",) if retry_failed else ("success", "failed")
        done = self.ledger.read().filter(F.col("extract_status").isin(*over)).select("url")
        rows = self._hashed(self.pages.read(self.pages.pending(done)))
        write = f"{self.root}/features/{uuid.uuid4().hex}"
        parsed = parsed_pages(rows, jsonld, keep=("content",)).withColumn("jsonld", F.lit(jsonld))
        parsed.withColumn("extracted_at", self.at).write.parquet(write)
        count = F.when(F.col("content_available") == 1, F.lit(len(FEATURE_COLUMNS)))
        told = self.spark.read.parquet(write).select(
            "url", count.alias("feature_count"), F.when(count.isNull(), "no_content").alias("error")
        )
        return self.ledger.upsert(extract_outcome(told, self.at))

    def features(self) -> DataFrame:
        """The newest features of each URL."""
        stored = self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.root}/features")
        fields = [c for c in stored.columns if c not in ("url", "extracted_at", *ABOUT)]
        return stored.groupBy("url").agg(F.max_by(F.struct(*fields), "extracted_at").alias("f")).select("url", "f.*")

    def train(self, **options) -> tuple[PipelineModel, DataFrame]:
        return train(self.ledger.read(), self.features(), **options)

    @staticmethod
    def _hashed(pages: DataFrame) -> DataFrame:
        """Pages with the hash that tells whether stored features are of this very page."""
        content = F.sha2(F.coalesce("html", F.lit("")), 256).alias("content")
        return pages.select(F.xxhash64("url").alias("page_id"), "url", content, "html")

    def parsed(self, jsonld: bool = False) -> DataFrame:
        """``parsed_pages`` of all stored pages: read where the same page was extracted, parsed where not."""
        html = self._hashed(self.pages.read(self.pages.index()))
        columns = ["page_id", "url", "verdict", "x_blank", *FEATURE_COLUMNS]
        root = f"{self.root}/features"
        if not names(self.spark, root):
            return parsed_pages(html, jsonld).select(*columns)
        stored = self.spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(root)
        if not set(ABOUT) <= set(stored.columns):
            return parsed_pages(html, jsonld).select(*columns)
        known = stored.filter(F.col("jsonld") == F.lit(jsonld)).drop("page_id").dropDuplicates(["url", "content"])
        on = ["url", "content"]
        read = html.drop("html").join(known, on).select(*columns)
        anew = html.join(known.select(*on), on, "left_anti")
        return read.unionByName(parsed_pages(anew, jsonld).select(*columns))

    def predicted(self, model: PipelineModel, jsonld: bool = False) -> DataFrame:
        """Prediction records of all stored pages, written and read back."""
        predictions = predict_parsed(self.parsed(jsonld), model)
        records = prediction_rows(predictions, self.at, F.col("status"))
        write_predictions(records, f"{self.root}/predictions")
        return self.spark.read.parquet(f"{self.root}/predictions")

    def evaluated(self, model: PipelineModel, samples: DataFrame) -> DataFrame:
        """The three verdicts of each held-out sample; the evaluation file is written too."""
        verdicts = evaluate(samples, model)
        write_evaluation(verdicts, f"{self.root}/evaluation")
        return verdicts

    def status(self) -> DataFrame:
        return status_rollup(self.ledger.read())
