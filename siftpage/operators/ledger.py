"""URL ledger: keyed status rows, upserts and incremental pick-up as joins.

The ledger is an ordinary table. An update is a full outer join that writes a new version; both
sides are reduced to one row per key before the join, so a hot key cannot multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftpage.functions.url import url_key

FINISHED = ("success", "failed", "skipped")
LABELS = ("list", "detail", "others")

LEDGER = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("scrape_status", T.StringType()),
        T.StructField("extract_status", T.StringType()),
        T.StructField("scrape_reason", T.StringType()),
        T.StructField("extract_reason", T.StringType()),
        T.StructField("scrape_completed_at", T.TimestampType()),
        T.StructField("extract_completed_at", T.TimestampType()),
        T.StructField("label_fixed_at", T.TimestampType()),
        T.StructField("feature_count", T.IntegerType()),
        T.StructField("files", T.ArrayType(T.StringType())),
        T.StructField("last_updated", T.TimestampType()),
    ]
)


def latest(updates: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: for every column the last non-null value in ``order``.

    Mergeable aggregates, so the shuffle carries one partial row per key and task.
    """
    columns = [c for c in updates.columns if c not in (key, order)]
    merged = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns
    ]
    return updates.groupBy(key).agg(*merged, F.max(order).alias(order))


def ledger_upsert(ledger: DataFrame, updates: DataFrame, key: str = "url") -> DataFrame:
    """Rows of ``updates`` laid over the ledger; a null update leaves a field as it is.

    Updates of one key are reduced to one row first, in each field the last that is not null by
    ``last_updated`` (without that column the greatest). ``last_updated`` of a touched row comes from
    the update.
    """
    if "last_updated" in updates.columns:
        updates = latest(updates, key, "last_updated").select(*updates.columns)
    else:
        others = [F.max(c).alias(c) for c in updates.columns if c != key]
        updates = updates.groupBy(key).agg(*others).select(*updates.columns)
    old, new = ledger.alias("o"), updates.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")

    def pick(name: str) -> Column:
        if name in updates.columns and name in ledger.columns:
            return F.coalesce(F.col(f"n.{name}"), F.col(f"o.{name}")).alias(name)
        side = "n" if name in updates.columns else "o"
        return F.col(f"{side}.{name}").alias(name)

    names = list(ledger.columns) + [c for c in updates.columns if c not in ledger.columns]
    return joined.select(*[pick(c) for c in names])


def pick_new(urls: DataFrame, ledger: DataFrame, skip: tuple[str, ...] = FINISHED) -> DataFrame:
    """URLs not in the ledger, or there with a status outside ``skip``."""
    done = ledger.filter(F.col("scrape_status").isin(*skip)).select("url").distinct()
    return urls.join(done, "url", "left_anti")


def register(urls: DataFrame, at: Column) -> DataFrame:
    """Update rows for new URLs: pending, keyed, last label of a repeated URL kept.

    ``urls``: url, label and ``row``, the position in the intake.
    """
    once = urls.groupBy("url").agg(F.max_by("label", "row").alias("label"))
    return once.select(
        "url",
        url_key(F.col("url")).alias("key"),
        "label",
        F.lit("pending").alias("scrape_status"),
        F.lit("pending").alias("extract_status"),
        at.alias("created_at"),
        at.alias("last_updated"),
    )


def fetch_outcome(results: DataFrame, at: Column) -> DataFrame:
    """Update rows after a fetch: status, reason, time and files (none unless it succeeded)."""
    ok = F.col("status") == "success"
    files = F.filter(
        F.array(
            F.when(ok & F.col("has_html"), F.lit("raw.html")),
            F.when(ok & F.col("has_page"), F.lit("page.json")),
        ),
        lambda f: f.isNotNull(),
    )
    return results.select(
        "url",
        F.coalesce("status", F.lit("failed")).alias("scrape_status"),
        F.coalesce("reason", F.lit("")).alias("scrape_reason"),
        at.alias("scrape_completed_at"),
        files.alias("files"),
        at.alias("last_updated"),
    )


def pick_extract(
    ledger: DataFrame, pages: DataFrame, retry_failed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(pages to extract, failure updates for ready rows whose page is missing).

    Only the page's id and URL take part in the joins; the HTML is read afterwards, for the ids found.
    """
    status = F.coalesce("extract_status", F.lit("pending"))
    wanted = (
        (F.col("scrape_status") == "success")
        & (status != "success")
        & F.col("key").isNotNull()
        & F.col("label").isNotNull()
    )
    if not retry_failed:
        wanted = wanted & (status != "failed")
    ready = ledger.filter(wanted).select("url", "key", "label")
    known = pages.select("url", "page_id")
    todo = ready.join(known, "url", "inner")
    missing = ready.join(known, "url", "left_anti").select(
        "url",
        F.lit("failed").alias("extract_status"),
        F.lit("missing_html").alias("extract_reason"),
    )
    return todo, missing


def extract_outcome(results: DataFrame, at: Column) -> DataFrame:
    """Update rows after extraction; ``error`` null means success."""
    ok = F.col("error").isNull()
    return results.select(
        "url",
        F.when(ok, "success").otherwise("failed").alias("extract_status"),
        F.col("error").alias("extract_reason"),
        at.alias("extract_completed_at"),
        F.when(ok, F.col("feature_count")).alias("feature_count"),
        at.alias("last_updated"),
    )


def valid_labels(corrections: DataFrame) -> DataFrame:
    """url, label, row -> one valid label per URL, the last row wins."""
    cleaned = corrections.select(
        F.trim("url").alias("url"), F.lower(F.trim("label")).alias("label"), "row"
    ).filter((F.col("url") != "") & F.col("label").isin(*LABELS))
    return cleaned.groupBy("url").agg(F.max_by("label", "row").alias("label"))


def _changed(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    new = valid_labels(corrections).withColumnRenamed("label", "new_label")
    joined = ledger.join(new, "url", "left")
    hit = (
        F.col("new_label").isNotNull()
        & F.col("key").isNotNull()
        & (F.coalesce("label", F.lit("")) != F.col("new_label"))
    )
    return joined.withColumn("hit", hit)


def relabel(ledger: DataFrame, corrections: DataFrame, at: Column) -> DataFrame:
    """Ledger with corrected labels; changed rows go back to pending and lose their features."""
    hit = F.col("hit")
    cleared = F.lit(None)
    return (
        _changed(ledger, corrections)
        .withColumns(
            {
                "label": F.when(hit, F.col("new_label")).otherwise(F.col("label")),
                "extract_status": F.when(hit, "pending").otherwise(F.col("extract_status")),
                "extract_reason": F.when(hit, cleared).otherwise(F.col("extract_reason")),
                "extract_completed_at": F.when(hit, cleared).otherwise(
                    F.col("extract_completed_at")
                ),
                "feature_count": F.when(hit, cleared).otherwise(F.col("feature_count")),
                "label_fixed_at": F.when(hit, at).otherwise(F.col("label_fixed_at")),
                "files": F.when(hit, F.array_remove("files", "features.json")).otherwise(
                    F.col("files")
                ),
            }
        )
        .select(*ledger.columns)
    )


def relabel_counts(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row: moved (changed, files present), unchanged (incl. changed without files), unknown."""
    new = valid_labels(corrections).withColumnRenamed("label", "new_label")
    joined = new.join(ledger, "url", "left")
    known = F.col("scrape_status").isNotNull()
    changed = (
        known
        & F.col("key").isNotNull()
        & (F.coalesce("label", F.lit("")) != F.col("new_label"))
    )
    moved = changed & (F.coalesce(F.size("files"), F.lit(0)) > 0)
    return joined.agg(
        F.count_if(moved).alias("moved"),
        F.count_if(known & ~F.coalesce(moved, F.lit(False))).alias("unchanged"),
        F.count_if(~known).alias("unknown"),
    )


def reset_failed(ledger: DataFrame) -> DataFrame:
    """Failed or skipped fetches start over; else failed extractions become pending."""
    fetch = F.coalesce(F.col("scrape_status").isin("failed", "skipped"), F.lit(False))
    extract = ~fetch & F.coalesce(F.col("extract_status") == "failed", F.lit(False))
    return ledger.withColumns(
        {
            "scrape_status": F.when(fetch, "pending").otherwise(F.col("scrape_status")),
            "extract_status": F.when(fetch | extract, "pending").otherwise(
                F.col("extract_status")
            ),
            "scrape_reason": F.when(~fetch, F.col("scrape_reason")),
            "extract_reason": F.when(~extract, F.col("extract_reason")),
        }
    )


def reset_extract(ledger: DataFrame) -> DataFrame:
    """Every fetched page is to be extracted again."""
    hit = F.coalesce(F.col("scrape_status") == "success", F.lit(False))
    return ledger.withColumns(
        {
            "extract_status": F.when(hit, "pending").otherwise(F.col("extract_status")),
            "extract_reason": F.when(~hit, F.col("extract_reason")),
            "extract_completed_at": F.when(~hit, F.col("extract_completed_at")),
            "feature_count": F.when(~hit, F.col("feature_count")),
            "files": F.when(hit, F.array_remove("files", "features.json")).otherwise(
                F.col("files")
            ),
        }
    )


def url_of_key(keys: DataFrame, *sources: DataFrame) -> DataFrame:
    """key -> url from the first source (key, url) that knows it; null when none does.

    A short key may belong to several URLs: all that the source has are returned, and ``ambiguous`` is set.
    """
    out = None
    for i, source in enumerate(sources):
        ranked = source.filter("url is not null").select("key", "url").withColumn("_rank", F.lit(i))
        out = ranked if out is None else out.unionByName(ranked)
    once = out.groupBy("key", "url").agg(F.min("_rank").alias("_rank"))
    best = once.groupBy("key").agg(F.min("_rank").alias("_rank"))
    found = once.join(best, ["key", "_rank"])
    many = found.groupBy("key").agg((F.count("*") > 1).alias("ambiguous"))
    known = found.join(many, "key").drop("_rank")
    return keys.join(known, "key", "left").select(*keys.columns, "url", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def rejected_urls(rows: DataFrame) -> DataFrame:
    """Intake rows that are dropped, with the reason."""
    url, label = F.coalesce(F.trim("url"), F.lit("")), F.lower(F.trim(F.coalesce("label", F.lit(""))))
    reason = F.when(url == "", "empty_url").when(~label.isin(*LABELS), "invalid_label")
    return rows.withColumn("reason", reason).filter("reason is not null")


def accepted_urls(rows: DataFrame) -> DataFrame:
    url, label = F.trim("url"), F.lower(F.trim("label"))
    return rows.withColumns({"url": url, "label": label}).filter(
        (F.col("url") != "") & F.col("label").isin(*LABELS)
    )
