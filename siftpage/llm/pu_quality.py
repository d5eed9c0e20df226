"""Quality classifier by positive-unlabelled learning.

Trusted positives are the rows labelled good; the unlabelled set is web text of the same folds, taken
whether labelled or not and without looking at the label. The class prior is estimated on the labelled
rows. A small network is fitted by minimising the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with the logistic loss; while the bracket is negative its gradient is turned back, so that the fit
does not drive it below zero. A score is the sigmoid of the network's output.

The fit uses samples bounded by `FIT_ROWS` rows for each set, chosen by hash; scoring reads every whole
text. Features are ratios, so that the length of a text matters only where it is meant to.

Defined results: null and empty texts have the features of the empty text and get its score; without
positives or without unlabelled rows every score is 0.5; a repeated label row counts once, a document
with contradicting labels not at all; repeated documents are scored alike; an empty table gives no rows;
other columns pass through (own columns `score` and `predicted` are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpage.llm.common import fold_of, give_back, slices, small_batches, table

#: Bound of the expected rows of each of the two samples that are fitted on.
FIT_ROWS = 6_000
THRESHOLD = 0.3
HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 1_500, 512, 0.01, 1e-4

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASSES = np.zeros((256, 10), np.float32)
for _i, _set in enumerate(
    (
        range(97, 123),  # a-z
        range(65, 91),  # A-Z
        range(48, 58),  # digits
        range(128, 256),  # beyond ASCII
        b"#*$%&|<>{}[]=_~^\\/@+",
        b".,;:",
        b"!?",
        b"'\"()-",
        (10,),
        (32, 9, 11, 12, 13),
    )
):
    _CLASSES[list(_set), _i] = 1
FEATURES = 10 + 9


def features(texts: list[str]) -> np.ndarray:
    """One row for each text: shares of byte classes, word and line statistics, compressibility."""
    packer = zstandard.ZstdCompressor(level=1)
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "replace")
        n = len(data)
        if not n:
            continue
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        out[i, :10] = counts @ _CLASSES / n
        words = data.split()
        lines = data.split(b"\n")
        m = max(1, len(words))
        different = len(set(words))
        letters = max(1.0, float(counts[65:91].sum() + counts[97:123].sum()))
        shares = counts[counts > 0] / n
        out[i, 10:] = (
            np.log1p(m) / 10,
            (n - int(counts[_SPACE].sum())) / m / 10,
            counts[65:91].sum() / letters,
            # the number of different words grows as a power of the length below 1
            np.log1p(different) / np.log1p(m),
            different / m,
            len(set(lines)) / len(lines),
            np.log1p(m / len(lines)) / 10,
            len(packer.compress(data)) / n,
            -(shares * np.log(shares)).sum() / 5,
        )
    return out


class Model:
    """Standardised features, one hidden layer of tanh units, one output."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.tanh(self.prepared(x) @ w1 + b1) @ w2 + b2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimated_prior(good: int, bad: int) -> float:
    """The share of positives, from labelled rows; kept off 0 and 1."""
    return min(0.99, max(0.01, (good + 1) / (good + bad + 2)))


def risk_gradient(z_pos, z_unl, prior):
    """The non-negative risk and its derivatives with respect to the outputs.

    Losses: log(1 + exp(-z)) as positive, log(1 + exp(z)) as negative.
    """
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)
    negative = soft(z_unl).mean() - prior * soft(z_pos).mean()
    d_neg_unl, d_neg_pos = sig(z_unl) / len(z_unl), -prior * sig(z_pos) / len(z_pos)
    if negative >= 0:
        d_pos = prior * (sig(z_pos) - 1) / len(z_pos)
        return prior * soft(-z_pos).mean() + negative, d_pos + d_neg_pos, d_neg_unl
    return prior * soft(-z_pos).mean(), -d_neg_pos, -d_neg_unl


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 5) -> Model:
    """Adam on mini-batches of both sets. Rows are put in order first, so that a fit repeats."""
    positives = positives[np.lexsort(positives.T)]
    unlabelled = unlabelled[np.lexsort(unlabelled.T)]
    rng = np.random.default_rng(seed)
    model = Model(unlabelled.mean(0), unlabelled.std(0) + 1e-3, None)
    p, u = model.prepared(positives), model.prepared(unlabelled)
    w = [rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step in range(1, STEPS + 1):
        xp, xu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        x = np.concatenate([xp, xu])
        h = np.tanh(x @ w[0] + w[1])
        z = h @ w[2] + w[3]
        _, dp, du = risk_gradient(z[: len(xp)], z[len(xp) :], prior)
        dz = np.concatenate([dp, du])
        dh = dz[:, None] * w[2] * (1 - h * h)
        grads = [x.T @ dh + DECAY * w[0], dh.sum(0), h.T @ dz + DECAY * w[2], dz.sum(keepdims=True)]
        rate = RATE * (1 - step / STEPS) + 1e-4
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model.weights = w
    return model


def sampled_features(docs: DataFrame, rows: int, bound: int) -> np.ndarray:
    """Features of about `bound` of the `rows` rows of docs (doc_id, text), chosen by hash."""
    limit = min(1.0, bound / max(1, rows))
    chosen = docs.filter(F.xxhash64(F.lit(3), "doc_id") / F.lit(2.0**64) + 0.5 <= limit).select("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in slices(b.column("text")):
                rows = pa.array(list(features(texts)), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([rows], ["f"])
        give_back()

    found = chosen.mapInArrow(each, "f array<float>").toPandas()["f"].tolist()
    return np.array(found, np.float64).reshape(-1, FEATURES)


def train(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model | None:
    """The model from docs (doc_id, text) and labels (doc_id, quality); None where a set is empty.

    Only the documents given here are learnt from: hold out before.
    """
    one = (
        labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("high"))
        .filter("quality = high")
    )
    marked = docs.select("doc_id").join(one, "doc_id").groupBy("quality").count().collect()
    counts = {r["quality"]: r["count"] for r in marked}
    total = docs.count()
    good = docs.select("doc_id", "text").join(one.filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    positives = sampled_features(good, counts.get(1, 0), bound)
    unlabelled = sampled_features(docs.select("doc_id", "text"), total, bound)
    if not len(positives) or not len(unlabelled):
        return None
    return fit(positives, unlabelled, estimated_prior(counts.get(1, 0), counts.get(0, 0)))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """All rows of docs with `score` and `predicted`."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [np.full(len(t), 0.5) if model is None else model.scores(features(t)) for t in slices(texts)]
            yield pa.array(np.concatenate(found) if found else [], pa.float64())
        give_back()

    small_batches(docs.sparkSession)
    out = docs.withColumn("score", scored(F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def learnt(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model from the documents outside fold 0 of five."""
    rest = fold_of(F.col("doc_id"), 5) != 0
    return train(docs.select("doc_id", "text").filter(rest), labels.select("doc_id", "quality").filter(rest))


def op10_quality_classifier(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = learnt(docs, table(spark, folder, "labels"))
    return score(docs, model).select(
        "doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted"
    )
