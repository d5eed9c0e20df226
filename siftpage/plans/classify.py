"""End-to-end plans: pages -> prediction, pages + ledger -> training set -> model -> evaluation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpage.functions.url import url_key
from siftpage.operators.decide import decide, fetch_failures
from siftpage.operators.evaluate import three_verdicts
from siftpage.operators.features import FEATURE_COLUMNS
from siftpage.operators.features.assemble import features_of, prepare
from siftpage.operators.model import fit, score, split, training_set
from siftpage.operators.rules import with_verdict


def features_and_verdict(pages: DataFrame, jsonld: bool = False) -> DataFrame:
    """page_id, url, the 211 features and the rule verdict, from one parse of each page."""
    both = features_of(with_verdict(prepare(pages, jsonld)))
    return both.select("page_id", "url", "verdict", *FEATURE_COLUMNS)


def predict(
    pages: DataFrame, model: PipelineModel, policy: str = "tiebreak", jsonld: bool = False
) -> DataFrame:
    """One prediction per page, pages without content included. One scan, a map-only job: no shuffle."""
    return predict_parsed(parsed_pages(pages, jsonld), model, policy)


def parsed_pages(pages: DataFrame, jsonld: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """All that ``predict_parsed`` needs of each page: ``features_and_verdict``, x_blank, fetch_reason if there;
    ``keep`` names further columns of the pages that stay."""
    kept = (*(c for c in ("fetch_reason",) if c in pages.columns), *keep)
    both = features_of(with_verdict(prepare(pages, jsonld, keep=kept)))
    return both.select("page_id", "url", "verdict", "x_blank", *kept, *FEATURE_COLUMNS)


def predict_parsed(parsed: DataFrame, model: PipelineModel, policy: str = "tiebreak") -> DataFrame:
    """``predict`` over the rows of ``parsed_pages``, which may be stored."""
    keep = [
        "page_id", "url", "predicted_label", "confidence", "method", "reason", "probabilities",
        "fallback_used", "content_available", "pre_label", "pre_confidence", "ml_label",
        "ml_confidence", "tiebreaker", "is_error_page",
    ]
    scored = score(parsed, model)
    decided = decide(scored.withColumn("content_available", F.col("content_available") == 1), policy)
    both = fetch_failures(decided, "x_blank").select(*keep)
    failure = F.col("method") == "scrape_failed"
    return both.select(
        url_key(F.col("url")).alias("key"),
        *keep,
        failure.alias("is_scrape_failed"),
        F.when(failure, "scrape_failed").otherwise("success").alias("status"),
        F.when(failure, "failed").otherwise("success").alias("scrape_status"),
    )


def train(
    ledger: DataFrame, features: DataFrame, grid: list | None = None, **options
) -> tuple[PipelineModel, DataFrame]:
    """(model, samples with is_test and fold). Samples are read several times by the trees, so they
    are kept at executor level while the fit runs; lost blocks are rebuilt from the feature table."""
    samples = split(training_set(ledger, features)).persist()
    model = fit(samples.filter("not is_test"), grid=grid, **options)
    samples.unpersist()
    return model, samples


def evaluate(samples: DataFrame, model: PipelineModel) -> DataFrame:
    """Three verdicts per held-out sample. ``samples`` carries the features and the rule verdict."""
    scored = score(samples.filter("is_test"), model)
    return three_verdicts(
        scored.select(
            "url",
            F.col("label").alias("true_label"),
            "ml_label",
            F.col("ml_confidence").alias("ml_conf"),
            "verdict",
            F.lit(None).cast("string").alias("read_error"),
        )
    )
