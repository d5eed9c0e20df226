"""Predictions of a forest on rows that take one value after another from a donor row.

A changed value matters only to trees whose path for the row asks for it. So each row goes through all trees
once, and for each column only those pairs of row and tree that met the column go through again; votes are
then added in the forest's own order, so that they are equal to its own to the last bit. The module is
pickled by value, so executors need no copy of the package.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel

from siftpage.session import checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "column int, actual string, predicted string, n bigint"


class Forest:
    """The trees side by side in arrays: a leaf asks for feature 0 and leads to itself."""

    def __init__(self, feature, threshold, left, right, votes, roots):
        self.feature, self.threshold, self.left, self.right = feature, threshold, left, right
        self.votes, self.roots = votes, roots
        self.asks = np.where(left == np.arange(len(left)), -1, feature).astype(np.int32)

    def step(self, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.where(value <= self.threshold[node], self.left[node], self.right[node])

    def best(self, leaves: np.ndarray) -> np.ndarray:
        """The first class of the highest probability; leaves: trees by rows."""
        raw = np.zeros((leaves.shape[1], self.votes.shape[1]))
        for of_tree in leaves:
            raw += self.votes[of_tree]
        total = np.zeros(len(raw))
        for votes in raw.T:
            total += votes
        return np.argmax(np.divide(raw, total[:, None], out=raw, where=total[:, None] != 0), axis=1)

    def predictions(self, own: np.ndarray, other: np.ndarray, columns: list[int]) -> Iterator[np.ndarray]:
        """The classes of the rows for each column that is taken from ``other``; none for column -1."""
        rows = np.arange(len(own))[None, :]
        node = np.repeat(self.roots[:, None], len(own), axis=1)
        asked = []
        while (self.asks[node] >= 0).any():
            asked.append(self.asks[node])
            node = self.step(node, own[rows, self.feature[node]])
        base = self.best(node)
        for column in columns:
            found = base
            if column >= 0:
                differs = np.flatnonzero(own[:, column] != other[:, column])
                met = np.zeros((len(self.roots), len(differs)), bool)
                for level in asked:
                    met |= level[:, differs] == column
                tree, at = np.nonzero(met)
                row, moved = differs[at], self.roots[tree]
                while (self.asks[moved] >= 0).any():
                    feature = self.feature[moved]
                    moved = self.step(moved, np.where(feature == column, other[row, column], own[row, feature]))
                changed = np.unique(row[moved != node[tree, row]])
                if len(changed):
                    leaves = node.copy()
                    leaves[tree, row] = moved
                    found = base.copy()
                    found[changed] = self.best(leaves[:, changed])
            yield found

    def counted(self, batches: Iterator[pa.RecordBatch], columns: list[int], labels: list[str]) -> Iterator[pa.RecordBatch]:
        """Batches of label, v and other to rows of ``SCHEMA``: how often each pair of classes comes up."""
        for batch in batches:
            if not batch.num_rows:
                continue
            own, other = (batch[name].flatten().to_numpy().reshape(batch.num_rows, -1) for name in ("v", "other"))
            actual = batch["label"].dictionary_encode()
            kinds = [*actual.dictionary.to_pylist(), None]
            code = actual.indices.fill_null(len(kinds) - 1).to_numpy()
            out = []
            for column, found in zip(columns, self.predictions(own, other, columns)):
                counts = np.bincount(code * len(labels) + found, minlength=len(kinds) * len(labels))
                out += [(column, kinds[i // len(labels)], labels[i % len(labels)], int(counts[i])) for i in np.flatnonzero(counts)]
            types = (pa.int32(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(zip(*out), types)], ["column", "actual", "predicted", "n"]
            )


def forest_arrays(model: RandomForestClassificationModel, spark) -> Forest | None:
    """The trees of a model, as its own file format tells them; None where a split is not by a threshold.

    The driver holds the nodes, whose number is bounded by trees and depth.
    """
    path = f"{checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    if any(r["split"]["numCategories"] >= 0 for r in stored if r["leftChild"] >= 0):
        return None
    place = {key: i for i, key in enumerate(sorted((r["treeID"], r["id"]) for r in stored))}
    size, classes = len(stored), model.numClasses
    feature, threshold = np.zeros(size, np.int32), np.full(size, np.inf)
    left, right, votes = np.arange(size), np.arange(size), np.zeros((size, classes))
    for r in stored:
        i = place[r["treeID"], r["id"]]
        if r["leftChild"] >= 0:
            feature[i], threshold[i] = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0]
            left[i], right[i] = place[r["treeID"], r["leftChild"]], place[r["treeID"], r["rightChild"]]
        elif total := sum(r["impurityStats"]):
            votes[i] = [x / total for x in r["impurityStats"]]
    roots = np.array([place[t, 0] for t in range(model.getNumTrees)])
    return Forest(feature, threshold, left, right, votes, roots)
