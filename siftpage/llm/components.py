"""Connected components by alternating stars, one checkpoint a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpage.llm.common import shared_folder


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b); root is the smallest node that can be reached.

    A round first ties every node's larger neighbours, then its smaller ones, to the smallest of them.
    All that meets is a minimum for each node, added up before it is shuffled; the joins on a node that
    has very many neighbours have one row on the other side and can be split. Rounds grow with the
    logarithm of the longest chain. Ends when a round changes nothing.
    """
    shared_folder(edges.sparkSession)
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = now.distinct().checkpoint()
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # larger neighbours of n are tied to the smallest of n and its neighbours
        large = both.join(least, both["a"] == least["n"]).filter("b > n").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        tied = large.join(least, large["a"] == least["n"])
        small = tied.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("n").alias("a"), F.col("m").alias("b"))
        )
        now = small.distinct().checkpoint()
