"""Ancestors and descendants in the element table, joined by position.

An element covers the tokens from its start to its stop. Of a page's elements in the order of their
starts those that are still open lie on a stack, so one pass finds all open ancestors of each
element: the work grows with the elements and the pairs found, not with their product, as a join on
``start < x and x < stop`` would. Pages are dealt by hash; what a task holds is a page's open ancestors.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def descendants(ancestors: DataFrame, elements: DataFrame, page: str = "page_id") -> DataFrame:
    """page, ancestor, eid and level: each element with each of the given ancestors that it lies in.

    Both sides have page, eid, start and stop, as ``html.elements`` gives them. level counts from the
    nearest of the given ancestors (1). Rows that repeat an element repeat its pairs.
    """
    spark = elements.sparkSession
    sides = [
        side.select(page, "eid", "start", "stop", F.lit(opens).alias("opens")) for side, opens in ((ancestors, 1), (elements, 0))
    ]
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # of an element that is on both sides the plain one comes first: it does not lie in itself
    both = sides[0].unionByName(sides[1]).repartition(tasks, page).sortWithinPartitions(page, "start", "opens", "eid")
    kind = elements.schema[page].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []
        for batch in batches:
            pages, inner, outer, levels = [], [], [], []
            for own, eid, start, stop, opens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != at:
                    at, stack = own, []
                while stack and stack[-1][1] <= start:
                    stack.pop()
                if opens:
                    stack.append((eid, stop, start))
                    continue
                above = [a for a, _, begun in stack if begun < start]
                pages += [own] * len(above)
                inner += [eid] * len(above)
                outer += above
                levels += range(len(above), 0, -1)
            columns = [pa.array(pages, batch.schema.field(0).type), *(pa.array(x, pa.int32()) for x in (outer, inner, levels))]
            yield pa.RecordBatch.from_arrays(columns, [page, "ancestor", "eid", "level"])

    return both.mapInArrow(merge, f"`{page}` {kind}, ancestor int, eid int, level int")


FIELDS = ("input", "select", "textarea")


def form_fields(elements: DataFrame) -> DataFrame:
    """One row per form field, forms without fields kept with nulls: ``snapshot.forms_table`` from elements."""
    attr = lambda name: F.col("attrs")[name]
    forms = elements.filter("tag = 'form'")
    numbered = forms.select(
        "page_id",
        F.col("eid").alias("form_eid"),
        F.coalesce(attr("action"), F.lit("")).alias("action"),
        F.lower(F.coalesce(attr("method"), F.lit("get"))).alias("method"),
    )
    fields = elements.filter(F.col("tag").isin(*FIELDS))
    inside = descendants(forms, fields).select("page_id", F.col("ancestor").alias("form_eid"), "eid")
    found = inside.join(fields, ["page_id", "eid"]).select(
        "page_id",
        "form_eid",
        F.struct(
            "eid",
            F.coalesce(attr("type"), "tag").alias("type"),
            F.coalesce(attr("name"), F.lit("")).alias("name"),
            F.coalesce(attr("placeholder"), F.lit("")).alias("placeholder"),
            F.map_contains_key("attrs", F.lit("required")).alias("required"),
        ).alias("i"),
    )
    listed = found.groupBy("page_id", "form_eid").agg(F.sort_array(F.collect_list("i")).alias("inputs"))
    whole = numbered.join(listed, ["page_id", "form_eid"], "left")
    pages = whole.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("form_eid", "action", "method", "inputs"))).alias("forms"))
    rows = pages.select("page_id", F.posexplode("forms").alias("form", "f"))
    return rows.select("page_id", "form", "f.action", "f.method", F.posexplode_outer("f.inputs").alias("pos", "i")).select(
        "page_id", "form", "action", "method", "pos", "i.type", "i.name", "i.placeholder", "i.required"
    )


def breadcrumb_items(elements: DataFrame) -> DataFrame:
    """page_id, breadcrumb_depth: list items, spans and links in the first breadcrumb element of each page."""
    named = lambda name: F.rlike(F.col("attrs")[name], F.lit("(?iU)breadcrumb"))
    ranked = F.struct((~F.coalesce(named("class"), F.lit(False))).alias("by_label"), "eid", "start", "stop")
    first = elements.filter(named("class") | named("aria-label")).groupBy("page_id").agg(F.min(ranked).alias("e"))
    crumbs = first.select("page_id", "e.eid", "e.start", "e.stop")
    inside = descendants(crumbs, elements.filter(F.col("tag").isin("li", "span", "a"))).groupBy("page_id").agg(F.count("*").alias("n"))
    pages = elements.select("page_id").distinct()
    return pages.join(inside, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("int").alias("breadcrumb_depth"))
