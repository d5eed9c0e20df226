"""Pages as SQL tables: temporary views over the element and snapshot tables.

A view is the plan behind it, so a query reads and parses only what it asks for, in JVM expressions; filters
on ``page_id`` reach the scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpage.operators.html import elements, page_text, tokens
from siftpage.operators.snapshot import (
    forms_table,
    headings_table,
    images_table,
    links_table,
    map_table,
    schema_types_table,
    snapshot,
)
from siftpage.operators.structural import descendants
from siftpage.session import checkpoint_dir

VIEWS = (
    "tokens", "elements", "inside", "page_text", "snapshots", "links", "images", "forms", "headings", "meta",
    "open_graph", "schema_types",
)


def register_views(pages: DataFrame, prefix: str = "html_") -> list[str]:
    """Registers a view for each of ``VIEWS`` under the prefix; their names.

    pages: page_id, url, html. ``inside`` has each element with each element that it lies in.
    """
    snapshots = snapshot(pages)
    parsed = elements(pages)
    made = {
        "tokens": tokens(pages),
        "elements": parsed,
        "inside": descendants(parsed, parsed),
        "page_text": page_text(pages),
        "snapshots": snapshots,
        "links": links_table(snapshots),
        "images": images_table(snapshots),
        "forms": forms_table(snapshots),
        "headings": headings_table(snapshots),
        "meta": map_table(snapshots, "meta"),
        "open_graph": map_table(snapshots, "open_graph"),
        "schema_types": schema_types_table(snapshots),
    }
    for name in VIEWS:
        made[name].createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in VIEWS]


def tag_report(pages: DataFrame) -> DataFrame:
    """How often each tag lies directly or indirectly in each other one, as SQL over the views says it.

    The statement reads the elements four times. They are written once, narrow, and of all pairs of elements
    only those are made whose outer tag it asks for.
    """
    spark = pages.sparkSession
    register_views(pages, "report_")
    folder = f"{checkpoint_dir(spark)}/elements-{uuid.uuid4().hex}"
    elements(pages).select("page_id", "eid", "start", "stop", "tag").write.parquet(folder)
    parsed = spark.read.parquet(folder)
    parsed.createOrReplaceTempView("report_elements")
    outer = parsed.filter(F.col("tag").isin("form", "nav", "article", "table", "ul"))
    descendants(outer, parsed).createOrReplaceTempView("report_inside")
    return spark.sql(
        """
        SELECT o.tag AS outer_tag, i.tag AS inner_tag, count(*) AS n, count(DISTINCT x.page_id) AS pages
        FROM report_inside x
        JOIN report_elements o ON o.page_id = x.page_id AND o.eid = x.ancestor
        JOIN report_elements i ON i.page_id = x.page_id AND i.eid = x.eid
        WHERE o.tag IN ('form', 'nav', 'article', 'table', 'ul')
        GROUP BY o.tag, i.tag
        """
    ).select("outer_tag", "inner_tag", F.col("n"), "pages")
