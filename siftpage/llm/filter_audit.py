"""Filter interaction audit by contractions of contingency tensors.

Every document is a pattern of failed filters. The patterns are counted for each part, and the counts
of a part reshaped to a tensor with one axis of two (passed, failed) for each filter. What any order of
the filters does at any step is then a contraction: along each axis a selector takes what passed
(1, 0), what failed (0, 1) or all (1, 1), and one einsum applies the selectors of all steps of all
orders. So documents are read once, however many orders are asked for.

    kept          pass for the filters up to this step, all for the rest
    removed       pass before, fail here, all after; good_lost and toxic_lost alike on their own tensors
    redundant     fail here, all else, less what is removed here
    unique_fails  fail here, pass everywhere else
    shapley       what the filter removes, summed over all orders

No part is gathered anywhere: only its counts meet, 2^filters rows of them. Copies are found by the
smallest doc_id of each text, a minimum that is merged before it is shuffled; it is joined back by text
and doc_id, so that the copies of one text lie in many tasks. Texts are compared by 128 bits of hash.

Defined results: null text is the empty text; a null part is the empty string; a null doc_id has no
label, is no copy and makes no other row one; rows that repeat a doc_id are documents of their own, and
not copies of each other; of several label rows of a document any may mark it good or toxic; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpage.llm.common import let, table, words_of

FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
STEP = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def text_failures(text: Column) -> Column:
    """Struct A, B, C, D: the failures that a text shows by itself."""

    long = lambda n: n.cast("bigint")  # noqa: E731  a hundred times a count may pass 32 bits

    def judged(t: Column) -> Column:
        return let(
            words_of(t),
            lambda w: F.struct(
                (F.size(w) < 100).alias("A"),
                (100 * long(F.size(F.array_distinct(w))) < 80 * long(F.size(w))).alias("B"),
                (100 * long(F.regexp_count(t, F.lit("[A-Z]"))) > 10 * long(F.char_length(t))).alias("C"),
                t.rlike("[#$%&*|]").alias("D"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), judged)


def later_copies(rows: DataFrame, keys: Sequence[str], id_: str = "doc_id") -> DataFrame:
    """rows with `later`: whether a smaller id has the same keys (none of them null)."""
    least = rows.groupBy(*keys).agg(F.min(id_).alias("_least"))
    first = least.select(*(F.col(k).alias(f"_{k}") for k in keys), "_least")
    same = rows[id_] == first["_least"]
    for k in keys:
        same = same & (rows[k] == first[f"_{k}"])
    return rows.join(first, same, "left").select(
        *rows.columns, (F.col(id_).isNotNull() & F.col("_least").isNull()).alias("later")
    )


def contingency(rows: DataFrame, part: str, failures: Mapping[str, Column], measures: Mapping[str, Column]) -> DataFrame:
    """part, pattern and the measures: one row for each part and each pattern of failures that occurs.

    The first filter is the pattern's highest bit, so that counts in the order of patterns reshape to
    a tensor whose axes are the filters in their order.
    """
    bits = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << k) for k, c in enumerate(reversed(failures.values()))), F.lit(0))
    return rows.groupBy(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("pattern")).agg(
        *(F.sum(m).cast("bigint").alias(name) for name, m in measures.items())
    )


def selectors(orders: Sequence[Sequence[int]], filters: int) -> dict[str, np.ndarray]:
    """For kept, removed, failing and unique an array (order x step, filter, 2) of selectors."""
    kept, removed, failing, unique = [], [], [], []
    for order in orders:
        for step, here in enumerate(order):
            before = order[:step]
            kept.append([PASS if f in before or f == here else ALL for f in range(filters)])
            removed.append([FAIL if f == here else PASS if f in before else ALL for f in range(filters)])
            failing.append([FAIL if f == here else ALL for f in range(filters)])
            unique.append([FAIL if f == here else PASS for f in range(filters)])
    named = {"kept": kept, "removed": removed, "failing": failing, "unique": unique}
    return {name: np.array(x, np.int64).reshape(-1, filters, 2) for name, x in named.items()}


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The sums that each row of selectors takes from a tensor of 2 x 2 x ..., all in one einsum."""
    axes, steps = list(range(tensor.ndim)), tensor.ndim
    operands: list = [tensor, axes]
    for f in axes:
        operands += [chosen[:, f], [steps, f]]
    return np.einsum(*operands, [steps], optimize="greedy")


def steps_of(counts: Mapping[str, np.ndarray], filters: str = FILTERS) -> dict[str, list]:
    """The columns of all steps of all orders of one part, from its counts by pattern."""
    k = len(filters)
    orders = sorted(permutations(range(k)))
    take = selectors(orders, k)
    n, good, toxic = (np.asarray(counts[m], np.int64).reshape((2,) * k) for m in MEASURES)
    removed = contract(n, take["removed"])
    here = np.array(orders).ravel()
    shapley = np.array([removed[here == f].sum() for f in range(k)])
    return {
        "filter_order": ["".join(filters[f] for f in o) for o in orders for _ in o],
        "step": np.tile(np.arange(1, k + 1, dtype=np.int32), math.factorial(k)),
        "kept": contract(n, take["kept"]),
        "removed": removed,
        "redundant": contract(n, take["failing"]) - removed,
        "unique_fails": contract(n, take["unique"]),
        "good_lost": contract(good, take["removed"]),
        "toxic_lost": contract(toxic, take["removed"]),
        "shapley": shapley[here],
    }


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All steps of all orders for each part of a contingency table (part, pattern, n, good, toxic).

    The counts of a part are first folded into one row of arrays; a task holds one part's tensors at a time.
    """
    width = 1 << len(filters)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dense = {m: np.zeros(width, np.int64) for m in MEASURES}
                for cell in row["cells"]:
                    for m in MEASURES:
                        dense[m][cell["pattern"]] = cell[m] or 0
                out = steps_of(dense, filters)
                arrays = {"part": [row["part"]] * len(out["step"])} | out
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays.values()], list(arrays))

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("pattern", *MEASURES)).alias("cells"))
    return cells.mapInArrow(each, STEP)


def document_failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, A to E for each row of docs (doc_id, text and the part's column)."""
    seen = docs.select(
        "doc_id",
        F.col(part).alias("part"),
        text_failures(F.col("text")).alias("own"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("h1"),
        F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("h2"),
    )
    marked = later_copies(seen, ["h1", "h2"])
    return marked.select("doc_id", "part", *(F.col(f"own.{f}").alias(f) for f in "ABCD"), F.col("later").alias("E"))


def op11_filter_audit(spark, folder: str) -> DataFrame:
    failures = document_failures(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # rows that repeat one document meet the labels as one
    narrow = failures.groupBy(*failures.columns).agg(F.count("*").alias("rows"))
    rows = narrow.join(labels, "doc_id", "left")
    n = F.col("rows")
    measures = {"n": n, "good": n * F.coalesce("good", F.lit(0)), "toxic": n * F.coalesce("toxic", F.lit(0))}
    return audit(contingency(rows, "part", {f: F.col(f) for f in FILTERS}, measures))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(d.doc_id > least, false) AS e
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), p AS (
  SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS x, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY part, a, b, c, d, e
), one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k), orders AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order
  FROM one a JOIN one b ON b.k <> a.k JOIN one c ON c.k NOT IN (a.k, b.k) JOIN one d ON d.k NOT IN (a.k, b.k, c.k)
  JOIN one e ON e.k NOT IN (a.k, b.k, c.k, d.k)
), steps AS (
  SELECT filter_order, s::INT AS step, filter_order[s] AS here,
         string_split(filter_order[1:s], '') AS upto,
         CASE WHEN s = 1 THEN [] ELSE string_split(filter_order[1:s - 1], '') END AS before
  FROM orders, range(1, 6) t(s)
), r AS (
  SELECT part, filter_order, step, here, n, good, toxic, x[here] AS fails,
         list_bool_or(list_transform(before, lambda k: x[k])) IS TRUE AS gone,
         list_bool_or(list_transform(upto, lambda k: x[k])) AS out,
         list_sum(list_transform(['A', 'B', 'C', 'D', 'E'], lambda k: x[k]::INT)) AS failed
  FROM p, steps
), t AS (
  SELECT part, filter_order, step, here,
         coalesce(sum(n) FILTER (NOT out), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails AND failed = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, here
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, here))::BIGINT AS shapley
FROM t
"""
