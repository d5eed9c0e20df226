"""Boosted trees with one joint softmax over the classes.

A round fits one regression tree for each class to what the classes' probabilities lack, all of them to
the same probabilities. A tree says which rows go together; what a leaf adds to its class's margin is
the Newton step of its rows, an aggregate by leaf: (K - 1) / K * sum(r) / sum(|r| (1 - |r|)). Margins
are columns of the training rows and are written after each round, so no round repeats another. Trees
are turned to column expressions: scoring is one projection, whatever the number of rounds.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpage.operators.features import FEATURE_COLUMNS
from siftpage.operators.model import SEED, assembler, in_fixed_order, label_indexer
from siftpage.sources.shared_files import publish_json, read_json

#: A node is a leaf's number, or feature, threshold and the nodes of both sides.
Node = int | list


@dataclass
class SoftmaxTrees:
    """Labels, feature names, margins to start from, and for each round and class a tree and its leaf values."""

    labels: list[str]
    columns: list[str]
    base: list[float]
    rate: float
    rounds: list[list[tuple[Node, list[float]]]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def margins(self, vector: Column) -> list[Column]:
        """The margin of each class; ``vector`` is the array of the features."""
        out = []
        for k, start in enumerate(self.base):
            steps = [walked(node, vector, lambda leaf, v=values: F.lit(float(v[leaf]))) for node, values in (r[k] for r in self.rounds)]
            out.append(sum(steps, F.lit(0.0)) * self.rate + F.lit(start))
        return out

    def save(self, spark, path: str) -> None:
        publish_json(spark, path, self.__dict__)

    @classmethod
    def load(cls, spark, path: str) -> SoftmaxTrees:
        return cls(**read_json(spark, path))


def walked(node: Node, vector: Column, leaf) -> Column:
    if not isinstance(node, list):
        return leaf(node)
    feature, threshold, left, right = node
    return F.when(F.get(vector, F.lit(feature)) <= F.lit(threshold), walked(left, vector, leaf)).otherwise(walked(right, vector, leaf))


def nodes_of(tree) -> tuple[Node, int]:
    """The splits of a fitted tree, and how many leaves it has; leaves are numbered from the left."""
    count = 0

    def walk(node) -> Node:
        nonlocal count
        if node.subtreeDepth() == 0:
            count += 1
            return count - 1
        split = node.split()
        return [split.featureIndex(), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild())]

    return walk(tree._java_obj.rootNode()), count


def softmax(margins: list[Column]) -> Column:
    most = F.greatest(*margins) if len(margins) > 1 else margins[0]
    powers = F.transform(F.array(*margins), lambda m: F.exp(m - most))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def fit_softmax(
    train: DataFrame,
    folder: str,
    columns: tuple[str, ...] = FEATURE_COLUMNS,
    rounds: int = 20,
    depth: int = 4,
    rate: float = 0.3,
    sampling: float = 0.8,
    seed: int = SEED,
) -> SoftmaxTrees:
    """Trees for the labels of train. ``folder``: where the rows of each round go, shared by all machines.

    A round takes a share of the rows, drawn by hash of the round and the row; leaves are valued on all.
    """
    spark = train.sparkSession
    ready = in_fixed_order(train.fillna(0, list(columns)))
    prepared = Pipeline(stages=[label_indexer(), assembler(columns)]).fit(ready)
    labels = list(prepared.stages[0].labelsArray[0])
    classes = len(labels)
    data = prepared.transform(ready).select("x", F.col("y").cast("int").alias("y"), F.xxhash64(*train.columns).alias("row"))
    counts = dict(data.groupBy("y").count().collect())
    total = sum(counts.values())
    model = SoftmaxTrees(labels, list(columns), [math.log(counts[k] / total) for k in range(classes)], rate)

    def stored(df: DataFrame, n: int) -> DataFrame:
        df.write.parquet(f"{folder}/round-{n}")
        return spark.read.schema(df.schema).parquet(f"{folder}/round-{n}")

    now = stored(data.withColumn("m", F.array(*(F.lit(b) for b in model.base))), 0)

    def grown(k: int, df: DataFrame) -> tuple[Node, int]:
        learner = DecisionTreeRegressor(featuresCol="x", labelCol=f"r{k}", maxDepth=depth, seed=seed)
        return nodes_of(learner.fit(df))

    for n in range(1, rounds + 1):
        p = softmax([F.col("m")[k] for k in range(classes)])
        lacking = now.withColumn("p", p).withColumns({f"r{k}": (F.col("y") == k).cast("double") - F.col("p")[k] for k in range(classes)})
        drawn = F.pmod(F.xxhash64(F.lit(n + seed), "row"), F.lit(1000)) < int(1000 * sampling)
        part = lacking.filter(drawn).persist()
        with ThreadPoolExecutor(classes) as pool:
            trees = list(pool.map(lambda k, df=part: grown(k, df), range(classes)))
        part.unpersist()
        vector = vector_to_array("x")
        placed = lacking.withColumn("v", vector).withColumns(
            {f"leaf{k}": walked(node, F.col("v"), F.lit) for k, (node, _) in enumerate(trees)}
        )
        pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"leaf{k}").alias("leaf"), F.col(f"r{k}").alias("r")) for k in range(classes))))
        sums = placed.select(pairs.alias("s")).groupBy("s.k", "s.leaf").agg(
            F.sum("s.r").alias("r"), F.sum(F.abs("s.r") * (1 - F.abs("s.r"))).alias("h")
        )
        # a few leaves for each class
        steps = {(s["k"], s["leaf"]): (classes - 1) / classes * s["r"] / max(s["h"], 1e-9) for s in sums.collect()}
        values = [[steps.get((k, leaf), 0.0) for leaf in range(size)] for k, (_, size) in enumerate(trees)]
        model.rounds.append([(node, own) for (node, _), own in zip(trees, values, strict=True)])
        added = [
            F.col("m")[k] + rate * F.get(F.array(*(F.lit(v) for v in own)), F.col(f"leaf{k}")) for k, own in enumerate(values)
        ]
        now = stored(placed.select("x", "y", "row", F.array(*added).alias("m")), n)
        after = softmax([F.col("m")[k] for k in range(classes)])
        loss = now.select(F.avg(-F.log(F.greatest(F.get(after, F.col("y")), F.lit(1e-300))))).first()[0]
        model.losses.append(loss)
    return model


def score_softmax(df: DataFrame, model: SoftmaxTrees) -> DataFrame:
    """Adds ml_label, ml_confidence (4 places) and probabilities; features that are null or missing count as 0."""
    have = set(df.columns)
    vector = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in model.columns))
    own = df.columns
    p = softmax([F.col("_margins")[k] for k in range(len(model.labels))])
    scored = df.withColumn("_vector", vector).withColumn("_margins", F.array(*model.margins(F.col("_vector")))).withColumn("_p", p)
    names = F.array(*(F.lit(x) for x in model.labels))
    return scored.select(
        *own,
        F.element_at(names, F.array_position("_p", F.array_max("_p")).cast("int")).alias("ml_label"),
        F.bround(F.array_max("_p"), 4).alias("ml_confidence"),
        F.map_from_arrays(names, F.transform("_p", lambda x: F.bround(x, 6))).alias("probabilities"),
    )
