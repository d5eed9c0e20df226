"""From documents to token ids: the stages of a training corpus, each written and read again.

A stage gets what its predecessor kept. Rejected documents go, one document of each group of near
copies stays, the mix repeats documents of sources that are to weigh more, and the last stage adds the
token ids (`ids`), their number (`n_tokens`) and the text that they decode to (`decoded`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpage.llm import bpe_tree, mixing, pu_quality, quality_rules, simhash_dedup
from siftpage.llm.common import table, written

#: Words of a shingle and least similarity in the near-duplicate stage.
SHINGLE, SIMILAR = 5, 0.8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier predicts to be good."""
    model = pu_quality.learnt(docs, table(spark, sf_dir, "labels"))
    scored = pu_quality.score(docs, model)
    return scored.filter("predicted = 1").select(*docs.columns)


def quality_rule_cascade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what no rule rejects."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one of the smallest id."""
    return simhash_dedup.keep_similar(docs, SHINGLE, SIMILAR)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, n_tokens and decoded."""
    return bpe_tree.encode(docs, decoded=True).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rule_cascade),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: The classifier, the fingerprints and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
