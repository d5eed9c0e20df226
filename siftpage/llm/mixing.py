"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source's documents are shuffled by hash. A document's virtual finish time is the running size of
its source up to and with it, divided by the source's target; a source that must be repeated goes
round again, up to `most` times. All documents are put in order of their finish times and the order is
cut where the running size reaches the total budget. Sources thus advance in step and come near their
targets at the cut, within one document.

No running sum sees more than a slice: a source is dealt into slices by the hash that shuffles it, the
finish times into slices of equal width (which hold equal sizes, as the sources advance in step), and
the sums of the slices are added up first. Both numbers of slices grow with the rows.

Defined results: a null text has size 0; a document of size 0 is never taken; null is a source of its
own, the last; repeated rows are documents of their own; of rows equal in all that is read it does not
matter which is taken; an empty table gives no rows. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftpage.llm.common import WORD, free, quoted, table, written

WEIGHTS, MOST = (5, 2, 1), 3
#: Rows of one slice of a running sum.
SLICE_ROWS = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """`target` of each source, from one row for each: source, source_size, source_rows, largest.

    Sources by code point, null last, get the weights in turn. A target above `most` times the size
    stops there; sources are therefore filled in the order of that stop by weight, and the level at
    which the rest shares what is left is the first one that leaves no source above its stop.
    Also: rank; budget and all_rows, the sums over all sources; slack: past the finish time 1 + slack
    the sources together have passed the budget, whatever the sizes of the documents at the cut.
    """
    cycle = F.array(*(F.lit(w) for w in weights))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), "rank")
    everything = by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_stop.rowsBetween(Window.unboundedPreceding, 0)

    def rest(column: str, all_of: str) -> Column:
        return F.sum(all_of).over(everything) - F.coalesce(F.sum(column).over(before), F.lit(0))

    return (
        sources.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")).cast("bigint"))
        .withColumn("stop", F.col("source_size") * most)
        .withColumn("level", rest("stop", "source_size") / rest("weight", "weight"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("stop"))
        .withColumn("open", F.max("fits").over(so_far))
        .withColumn("shared", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(everything))
        .withColumn(
            "target",
            F.when(F.col("open"), F.col("shared") * F.col("weight")).otherwise(F.col("stop").cast("double")),
        )
        .withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("all_rows", F.sum("source_rows").over(everything))
        .withColumn(
            "slack",
            F.coalesce(
                F.try_divide(
                    F.sum("largest").over(everything), F.sum(F.when(F.col("open"), F.col("target"))).over(everything)
                ),
                F.lit(0.0),
            ),
        )
        .select("source", "source_size", "source_rows", "rank", "target", "budget", "all_rows", "slack")
    )


def offsets(df: DataFrame, keys: list[str], slice_: str, value: str, out: str) -> DataFrame:
    """For each slice the sum of `value` in the slices before it, below the same keys."""
    sums = df.groupBy(*keys, slice_).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, slice_, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(out))


def plan(
    docs: DataFrame,
    carry: Sequence[str] = ("doc_id",),
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    slice_rows: int = SLICE_ROWS,
    seed: int = 11,
) -> DataFrame:
    """One row for each document: `carry`, source, size, source_size, target and taken.

    docs: doc_id, source, size and what else `carry` names; read once, as the narrow rows are written.
    """
    base = written(docs.select(*dict.fromkeys([*carry, "doc_id", "source", "size"])), "sizes")
    sources = base.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("source_rows"), F.max("size").alias("largest")
    )
    goal = targets(sources, weights, most)
    # the hash that shuffles: its share of the whole range also gives the slice
    hashed = base.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")))
    joined = hashed.join(goal, hashed["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    share = F.col("h") / F.lit(2.0**64) + 0.5
    dealt = joined.withColumn("s", F.floor(share * F.ceil(F.col("source_rows") / slice_rows)).cast("int"))
    ahead = offsets(dealt, ["rank"], "s", "size", "ahead")
    within = Window.partitionBy("rank", "s").orderBy("h", "doc_id", "size", *(c for c in carry if c != "doc_id"))
    queued = (
        dealt.withColumn("i", F.row_number().over(within))
        .withColumn("run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(ahead, ["rank", "s"])
        .withColumn("run", F.col("run") + F.col("ahead"))
    )
    rounds = F.least(F.lit(most), F.ceil(F.col("target") / F.col("source_size")).cast("int") + 1)
    timed = (
        queued.filter((F.col("size") > 0) & (F.col("target") > 0))
        .select(
            "rank", "s", "i", "size", "run", "source_size", "target", "budget", "all_rows", "slack",
            F.explode(F.sequence(F.lit(0), rounds - 1)).alias("round"),
        )
        .withColumn("finish", (F.col("round") * F.col("source_size") + F.col("run")) / F.col("target"))
        .filter(F.col("finish") <= 1 + F.col("slack"))
    )
    dealt2 = timed.withColumn(
        "f", F.least(F.floor(F.col("finish") * F.ceil(F.col("all_rows") / slice_rows)), F.lit(2**31 - 1)).cast("int")
    )
    ahead2 = offsets(dealt2.withColumn("all", F.lit(0)), ["all"], "f", "size", "ahead").drop("all")
    order = Window.partitionBy("f").orderBy("finish", "rank", "round", "s", "i").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        dealt2.withColumn("total", F.sum("size").over(order))
        .join(ahead2, "f")
        .filter(F.col("total") + F.col("ahead") <= F.col("budget"))
    )
    taken = cut.groupBy("rank", "s", "i").agg(F.sum("size").alias("taken"))
    return queued.join(taken, ["rank", "s", "i"], "left").select(
        *carry,
        *(c for c in ("source", "size") if c not in carry),
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mix, repeated ones repeated, with the columns of `docs`.

    The plan is made on narrow rows and joined back by id and content. Rows that are equal in both
    are merged before, so that each joins once and stands for the copies that all of them got.
    """
    own = docs.columns
    key = ["doc_id", "source", "size", "content"]
    size, content, times, copy, packed = (free(n, own) for n in ("size_", "content_", "times_", "copy_", "packed_"))
    marked = docs.withColumns({size: size_of(F.col("text")), content: F.xxhash64("text")})
    rows = marked.select("doc_id", "source", F.col(size).alias("size"), F.col(content).alias("content"))
    chosen = (
        plan(rows, carry=key, weights=weights, most=most)
        .filter("taken > 0")
        .groupBy(*key)
        .agg((F.sum("taken") / F.first("size")).cast("int").alias("n"))
    )
    heads = {c: free(f"k_{c}", own) for c in key}
    k = chosen.select(*(F.col(c).alias(heads[c]) for c in key), F.col("n").alias(times))
    twice = rows.groupBy(*key).count().filter("count > 1").select(*(F.col(c).alias(heads[c]) for c in key))

    def same(a: DataFrame, b: DataFrame) -> Column:
        mine = {"size": size, "content": content}
        out = a["doc_id"].eqNullSafe(b[heads["doc_id"]])
        for c in key[1:]:
            out = out & a[mine.get(c, c)].eqNullSafe(b[heads[c]])
        return out

    single = marked.join(twice, same(marked, twice), "left_anti")
    merged = marked.join(twice, same(marked, twice), "left_semi")
    others = [c for c in own if c not in ("doc_id", "source")]
    merged = merged.groupBy("doc_id", "source", size, content).agg(F.first(F.struct(*quoted(others))).alias(packed))
    merged = merged.select("doc_id", "source", size, content, *(F.col(packed)[c].alias(c) for c in others))
    both = single.unionByName(merged.select(*quoted(single.columns)))
    return (
        both.join(k, same(both, k))
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
        .select(*quoted(own))
    )


def op7_mixing(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", size_of(F.col("text")).alias("size"))
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")
