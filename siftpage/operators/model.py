"""Training, scoring and model reports with spark.ml."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftpage.functions.url import url_fallback, url_features, url_parts
from siftpage.operators.features import FEATURE_COLUMNS
from siftpage.operators.permute import SCHEMA, forest_arrays

MIN_PER_CLASS = 3
LOW_CONFIDENCE = 0.50
TEST_SHARE = 0.2
SEED = 42
FOLDS = 5


def training_set(ledger: DataFrame, features: DataFrame) -> DataFrame:
    """Features of rows that are fetched, extracted, keyed and labelled, with that label."""
    ready = ledger.filter(
        (F.col("scrape_status") == "success")
        & (F.col("extract_status") == "success")
        & (F.coalesce("label", F.lit("")) != "")
        & (F.coalesce("key", F.lit("")) != "")
    ).select("url", "key", "label")
    stored = features.drop(*[c for c in features.columns if c.startswith("_")], "label", "key")
    return ready.join(stored, "url")


def stale_features(ledger: DataFrame, features: DataFrame) -> DataFrame:
    """Stored features whose ledger row is no longer fetched and extracted."""
    bad = ledger.filter(
        ~(
            (F.coalesce("scrape_status", F.lit("")) == "success")
            & (F.coalesce("extract_status", F.lit("")) == "success")
        )
        & (F.coalesce("label", F.lit("")) != "")
        & (F.coalesce("key", F.lit("")) != "")
    ).select("url")
    return features.join(bad.distinct(), "url", "left_semi")


def purge_stale(ledger: DataFrame, features: DataFrame) -> DataFrame:
    return features.join(stale_features(ledger, features).select("url").distinct(), "url", "left_anti")


def small_classes(samples: DataFrame, least: int = MIN_PER_CLASS) -> DataFrame:
    """Classes with too few rows to train on."""
    return samples.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") < least)


def require_classes(samples: DataFrame, least: int = MIN_PER_CLASS) -> None:
    """Raise if a class is too small; the message names the first twenty."""
    short = {r["label"]: r["n"] for r in small_classes(samples, least).take(20)}
    if short:
        raise ValueError(f"classes with fewer than {least} rows: {short}")


def split(
    samples: DataFrame,
    label: str = "label",
    key: str = "key",
    share: float = TEST_SHARE,
    seed: int = SEED,
    folds: int = FOLDS,
) -> DataFrame:
    """Adds ``is_test`` and ``fold``: exact stratified shares, ordered by md5(key + seed).

    The draw of a row depends on its key alone, so it is the same whatever the order or number of
    partitions, and the same key never sits on both sides. A class may hold nearly all rows, so
    there is no window per class: rows get their rank within (class, slice of the hash) and the
    counts of the earlier slices, a table bounded by classes x slices, are added to it.
    """
    hashed = samples.withColumn("h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    sliced = hashed.withColumn("slice", F.conv(F.left("h", F.lit(3)), 16, 10).cast("int"))
    counts = sliced.groupBy(label, "slice").agg(F.count("*").alias("slice_n"))
    before = Window.partitionBy(label).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(label)
    offsets = counts.select(
        F.col(label).alias("c"),
        F.col("slice").alias("s"),
        F.coalesce(F.sum("slice_n").over(before), F.lit(0)).alias("offset"),
        F.sum("slice_n").over(whole).alias("class_n"),
    )
    inner = Window.partitionBy(label, "slice").orderBy("h", key)
    ranked = sliced.withColumn("r", F.rank().over(inner))  # rows of one key stay together
    joined = ranked.join(
        offsets, (F.col(label) == F.col("c")) & (F.col("slice") == F.col("s"))
    )
    rank = F.col("offset") + F.col("r")
    cut = F.bround(F.col("class_n") * F.lit(share), 0)
    return joined.select(
        *samples.columns,
        (rank <= cut).alias("is_test"),
        F.when(rank > cut, ((rank - 1) % folds).cast("int")).alias("fold"),
    )


class MacroF1(Evaluator):
    """Mean of the per-class F1, which spark.ml's own weighted ``f1`` is not."""

    @keyword_only
    def __init__(self, labelCol: str = "y", predictionCol: str = "prediction", classes: int = 3):
        super().__init__()
        self.label, self.prediction, self.classes = labelCol, predictionCol, classes

    def _evaluate(self, dataset: DataFrame) -> float:
        from siftpage.operators.evaluate import class_report

        pairs = dataset.select(
            F.col(self.label).cast("int").cast("string").alias("actual"),
            F.col(self.prediction).cast("int").cast("string").alias("predicted"),
        )
        report = class_report(pairs, classes=tuple(str(i) for i in range(self.classes)))
        seen = report.filter("support > 0 or predicted > 0")
        return seen.agg(F.coalesce(F.avg("f1"), F.lit(0.0))).first()[0]

    def isLargerBetter(self) -> bool:
        return True


def assembler(columns: tuple[str, ...] = FEATURE_COLUMNS) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="x", handleInvalid="keep")


def label_indexer() -> StringIndexer:
    return StringIndexer(
        inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="error"
    )


def forest(trees: int = 100, depth: int = 8, seed: int = SEED) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed,
        featureSubsetStrategy="sqrt", subsamplingRate=0.8,
    )


def default_grid(classifier: RandomForestClassifier) -> list:
    return (
        ParamGridBuilder()
        .addGrid(classifier.maxDepth, [4, 6, 8])
        .addGrid(classifier.numTrees, [100, 200])
        .addGrid(classifier.subsamplingRate, [0.8, 1.0])
        .addGrid(classifier.featureSubsetStrategy, ["sqrt", "0.8"])
        .addGrid(classifier.minInstancesPerNode, [1, 3])
        .build()
    )


def in_fixed_order(train: DataFrame) -> DataFrame:
    """Rows dealt and sorted by a hash of their key, as trees are drawn by where a row lies.

    The number of partitions follows the session's setting, so a fit repeats in sessions alike.
    """
    if "key" not in train.columns:
        return train
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in ("url", "label") if c in train.columns]
    return train.repartition(parts, "key").sortWithinPartitions("key", *others)


def fit(
    train: DataFrame,
    columns: tuple[str, ...] = FEATURE_COLUMNS,
    grid: list | None = None,
    classifier: RandomForestClassifier | None = None,
    parallelism: int = 4,
) -> PipelineModel:
    """Indexer, assembler and forest; with a grid, cross-validated on ``fold`` by macro-F1."""
    learner = classifier or forest()
    ready = in_fixed_order(train.fillna(0, list(columns)))
    stages = Pipeline(stages=[label_indexer(), assembler(columns)])
    prepared = stages.fit(ready)
    data = prepared.transform(ready)
    if grid:
        search = CrossValidator(
            estimator=learner, estimatorParamMaps=grid,
            evaluator=MacroF1(classes=len(prepared.stages[0].labelsArray[0])),
            foldCol="fold", numFolds=FOLDS, parallelism=parallelism, seed=SEED,
        )
        # Test rows have no fold. They are filtered out, but the fold check may run before the filter.
        folded = data.withColumn("fold", F.coalesce("fold", F.lit(0)))
        searched = search.fit(folded)
        best = searched.bestModel
        best.grid_scores = list(searched.avgMetrics)
    else:
        best = learner.fit(data)
    return PipelineModel(stages=[*prepared.stages, best])


def fit_boosted(
    train: DataFrame,
    columns: tuple[str, ...] = FEATURE_COLUMNS,
    rounds: int = 50,
    depth: int = 4,
    rate: float = 0.1,
    sampling: float = 0.8,
    seed: int = SEED,
) -> PipelineModel:
    """Boosted trees: one model of each class against the rest; ``score`` divides their positive
    probabilities by the sum."""
    ready = in_fixed_order(train.fillna(0, list(columns)))
    prepared = Pipeline(stages=[label_indexer(), assembler(columns)]).fit(ready)
    data = prepared.transform(ready)
    learners = []
    for i in range(len(prepared.stages[0].labelsArray[0])):
        learner = GBTClassifier(
            featuresCol="x", labelCol=f"y_{i}", predictionCol=f"prediction_{i}", maxIter=rounds,
            maxDepth=depth, stepSize=rate, subsamplingRate=sampling, seed=seed,
        )
        learner.setProbabilityCol(f"probability_{i}").setRawPredictionCol(f"raw_{i}")
        learners.append(learner.fit(data.withColumn(f"y_{i}", (F.col("y") == i).cast("double"))))
    return PipelineModel(stages=[*prepared.stages, *learners])


def _stages(model: PipelineModel) -> tuple:
    indexer, vectors, *learners = model.stages
    return list(indexer.labelsArray[0]), vectors.getInputCols(), learners


def with_probabilities(df: DataFrame, learners: list) -> DataFrame:
    """Adds ``p``, the class probabilities of the assembled rows (``x``)."""
    if len(learners) == 1:
        scored = learners[0].transform(df).withColumn("p", vector_to_array("probability"))
        return scored.drop("rawPrediction", "probability", "prediction")
    for learner in learners:
        df = learner.transform(df)
    each = [vector_to_array(f"probability_{i}")[1] for i in range(len(learners))]
    made = [f"{c}_{i}" for i in range(len(learners)) for c in ("raw", "probability", "prediction")]
    positive = df.withColumn("p", F.array(*each)).drop(*made)
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return positive.withColumn("p", F.transform("p", lambda x: x / total))


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ml_label, ml_confidence (4 places), ml_method, probabilities, fallback_used.

    Below 0.50 on a page without content, the URL alone decides.
    """
    labels, columns, learners = _stages(model)
    ready = df.fillna(0, [c for c in columns])
    scored = with_probabilities(assembler(tuple(columns)).transform(ready), learners)
    staged = scored.withColumns(
        {
            "top": F.array_max("p"),
            "weak": url_fallback(url_features(F.col("url"), url_parts(F.col("url")))),
        }
    )
    staged = staged.withColumn(
        "fallback_used", (F.col("top") < LOW_CONFIDENCE) & (F.col("content_available") == 0)
    )
    fallback = F.col("fallback_used")
    names = F.array(*[F.lit(x) for x in labels])
    best = F.element_at(names, F.array_position("p", F.col("top")).cast("int"))
    out = {
        "ml_label": F.when(fallback, F.col("weak.label")).otherwise(best),
        "ml_confidence": F.when(fallback, F.col("weak.confidence")).otherwise(
            F.bround("top", 4)
        ),
        "ml_method": F.when(fallback, "ml_model_url_fallback").otherwise("ml_model"),
        "probabilities": F.map_from_arrays(names, F.transform("p", lambda x: F.bround(x, 4))),
    }
    drop = ("x", "p", "top", "weak")
    return staged.withColumns(out).drop(*drop)


def importance(model: PipelineModel, spark) -> DataFrame:
    """(feature, importance): the learners' own normalised importances, unused features 0."""
    _, columns, learners = _stages(model)
    each = sum(learner.featureImportances.toArray() for learner in learners) / len(learners)
    rows = [(c, round(float(v), 6)) for c, v in zip(columns, each)]
    return spark.createDataFrame(rows, "feature string, importance double")


def _swapped(pairs: DataFrame, learners: list, tested: list[int], labels: list[str]) -> DataFrame:
    """column, actual, predicted, n of any learners: a pair is repeated in place for each column."""
    each = pairs.withColumn("column", F.explode(F.array(*[F.lit(i) for i in tested])))
    swapped = each.select(
        "label",
        "column",
        array_to_vector(
            F.transform(
                "v", lambda own, i: F.when(i == F.col("column"), F.get("other", i)).otherwise(own)
            )
        ).alias("x"),
    )
    names = F.array(*[F.lit(x) for x in labels])
    return with_probabilities(swapped, learners).select(
        "column",
        F.col("label").alias("actual"),
        F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("predicted"),
        F.lit(1).cast("bigint").alias("n"),
    )


#: Test rows of one bucket, in which each row takes its values from another one.
DONOR_ROWS = 10_000


def permutation_importance(test: DataFrame, model: PipelineModel, seed: int = SEED) -> DataFrame:
    """(feature, importance): loss of macro-F1 on the test rows when one column is shuffled.

    One shuffle pairs each row with a donor, the next row of its bucket in an order drawn by hash;
    buckets are added as the rows grow. A pair is then scored for each column that the trees use (a
    forest: see ``permute``) and added up to counts before anything is shuffled again. Columns that no
    tree uses lose nothing. Column -1 is the unshuffled base.
    """
    from siftpage.operators.evaluate import class_report, summary

    labels, columns, learners = _stages(model)
    spark = test.sparkSession
    used = sum(learner.featureImportances.toArray() for learner in learners)
    tested = [-1, *[i for i, v in enumerate(used) if v > 0]]
    values = F.array(*[F.col(c).cast("double") for c in columns])
    rows = test.fillna(0, list(columns)).select(
        F.col("label").cast("string").alias("label"), values.alias("v"), F.xxhash64("url", F.lit(seed)).alias("row")
    )
    buckets = max(1, test.count() // DONOR_ROWS)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(buckets)))
    group = Window.partitionBy("bucket")
    donor = F.coalesce(F.lag("v").over(group.orderBy("row")), F.max_by("v", "row").over(group))
    pairs = dealt.select("label", "v", donor.alias("other"))
    forest = isinstance(learners[0], RandomForestClassificationModel) and forest_arrays(learners[0], spark)
    if forest:
        scored = pairs.mapInArrow(lambda batches: forest.counted(batches, tested, labels), SCHEMA)
    else:
        scored = _swapped(pairs, learners, tested, labels)
    groups = spark.createDataFrame([(i,) for i in tested], "column int")
    report = summary(class_report(scored, tuple(labels), ("column",), groups, "n"), ("column",))
    # one row for each column of the model, whatever the number of test rows
    f1 = report.select("column", "macro_f1")
    base = F.max(F.when(F.col("column") == -1, F.col("macro_f1"))).over(Window.partitionBy())
    every = spark.createDataFrame(list(enumerate(columns)), "column int, feature string")
    lost = f1.withColumn("lost", base - F.col("macro_f1"))
    return every.join(lost, "column", "left").select(
        "feature", F.bround(F.coalesce("lost", F.lit(0.0)), 6).alias("importance")
    )


def misclassified_test(scored: DataFrame) -> DataFrame:
    """url, actual, predicted, confidence of wrong test rows."""
    return scored.filter(F.col("ml_label") != F.col("label")).select(
        "url",
        F.col("label").alias("actual"),
        F.col("ml_label").alias("predicted"),
        F.bround("ml_confidence", 4).alias("confidence"),
    )


def training_report(
    sample_split: DataFrame, scored_test: DataFrame, model: PipelineModel | None = None, top: int = 30
) -> dict[str, DataFrame]:
    """Small tables of a training run: sizes, label distribution, per-class report, confusion; with
    the model also its parameters and top features."""
    from siftpage.operators.evaluate import class_report, confusion, summary
    from siftpage.operators.reports import top_features

    pairs = scored_test.select(
        F.col("label").alias("actual"), F.col("ml_label").alias("predicted")
    )
    report = class_report(pairs)
    out = {
        "sizes": sample_split.agg(
            F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test")
        ),
        "labels": sample_split.groupBy("label").agg(F.count("*").alias("n")),
        "per_class": report,
        "summary": summary(report),
        "confusion": confusion(pairs),
    }
    if model is not None:
        spark = sample_split.sparkSession
        _, _, learners = _stages(model)
        settings = [
            (i, p.name, str(v))
            for i, learner in enumerate(learners)
            for p, v in sorted(learner.extractParamMap().items(), key=lambda x: x[0].name)
        ]
        out["parameters"] = spark.createDataFrame(settings, "learner int, name string, value string")
        out["top_features"] = top_features(importance(model, spark), top)
    return out


def save_model(model: PipelineModel, path: str, tables: dict[str, DataFrame]) -> None:
    """Model, report and importance as one artefact: spark.ml's own format and a table each."""
    model.write().overwrite().save(f"{path}/model")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/tables/{name}")


def load_model(spark, path: str, tables: tuple[str, ...] = ()) -> tuple[PipelineModel, dict[str, DataFrame]]:
    """The model and the named tables of ``save_model``."""
    return PipelineModel.load(f"{path}/model"), {t: spark.read.parquet(f"{path}/tables/{t}") for t in tables}
