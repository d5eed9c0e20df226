"""Status tables over the ledger, the feature store and the predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpage.operators.features import FEATURE_COLUMNS

STATUSES = ("success", "failed", "pending", "skipped")


def _is(column: str, value: str) -> Column:
    return F.col(column) == value


def _ready() -> Column:
    return _is("scrape_status", "success") & _is("extract_status", "success")


def status_rollup(ledger: DataFrame) -> DataFrame:
    """Per label and for TOTAL: rows, fetch statuses, extract statuses, ready for training."""
    labelled = ledger.withColumn("label", F.coalesce("label", F.lit("unknown")))
    counts = [F.count_if(_is("scrape_status", s)).alias(f"scrape_{s}") for s in STATUSES]
    counts += [F.count_if(_is("extract_status", s)).alias(f"extract_{s}") for s in STATUSES[:3]]
    return (
        labelled.rollup("label")
        .agg(F.count("*").alias("total"), *counts, F.count_if(_ready()).alias("ready"))
        .withColumn("label", F.coalesce("label", F.lit("TOTAL")))
    )


def ready_count(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count_if(_ready()).alias("ready"))


def file_completeness(folders: DataFrame) -> DataFrame:
    """Per label: folders, those with each file, and complete ones. ``files`` is an array column."""

    def has(name: str) -> Column:
        return F.coalesce(F.array_contains("files", name), F.lit(False))

    complete = has("raw.html") & has("page.json") & has("features.json")
    return folders.groupBy("label").agg(
        F.count("*").alias("folders"),
        F.count_if(has("raw.html")).alias("html"),
        F.count_if(has("page.json")).alias("page"),
        F.count_if(has("features.json")).alias("features"),
        F.count_if(complete).alias("complete"),
    )


def recent(predictions: DataFrame, k: int = 10) -> DataFrame:
    """Newest ``k`` predictions (a top-k, not a full sort)."""
    return (
        predictions.orderBy(F.col("predicted_at").desc(), "url")
        .limit(k)
        .select(
            "url",
            "predicted_label",
            "confidence",
            "fallback_used",
            F.date_format("predicted_at", "yyyy-MM-dd HH:mm:ss").alias("predicted_at"),
        )
    )


def warnings(ledger: DataFrame, imbalance: int = 5, low: int = 10) -> DataFrame:
    """Issue rows (issue, label, n): pending extractions, class imbalance, small classes.

    Everything is derived from one count per label; small classes stay rows of their own.
    """
    waiting = _is("scrape_status", "success") & _is("extract_status", "pending")
    per_label = ledger.groupBy("label").agg(
        F.count_if(waiting).alias("waiting"), F.count_if(_ready()).alias("ready")
    )
    ready = F.when(F.col("ready") > 0, F.col("ready"))
    summary = per_label.agg(
        F.sum("waiting").alias("waiting"), F.max(ready).alias("most"), F.min(ready).alias("least")
    )

    def issue(name: str, condition: Column, n: Column) -> Column:
        row = F.struct(
            F.lit(name).alias("issue"), F.lit(None).cast("string").alias("label"), n.alias("n")
        )
        return F.filter(F.array(F.when(condition, row)), lambda x: x.isNotNull())

    overall = F.concat(
        issue("extract_pending", F.col("waiting") > 0, F.col("waiting")),
        issue(
            "class_imbalance", F.col("most") > F.col("least") * imbalance, F.col("most")
        ),
    )
    small = per_label.filter((F.col("ready") > 0) & (F.col("ready") < low)).select(
        F.lit("few_samples").alias("issue"), "label", F.col("ready").alias("n")
    )
    return summary.select(F.explode(overall).alias("i")).select("i.*").unionByName(small)


def failed_list(ledger: DataFrame) -> DataFrame:
    return ledger.filter(
        _is("scrape_status", "failed") | _is("extract_status", "failed")
    ).select("url", "scrape_status", "extract_status", "scrape_reason", "extract_reason")


def url_list(ledger: DataFrame, label: str | None = None, status: str | None = "success") -> DataFrame:
    """Ledger rows filtered by label and fetch status, ordered by label and URL.

    The URL keeps a frequent label from being one range of the sort.
    """
    rows = ledger
    if label:
        rows = rows.filter(_is("label", label))
    if status:
        rows = rows.filter(_is("scrape_status", status))
    return rows.select(
        "url",
        "label",
        "scrape_status",
        "extract_status",
        "key",
    ).orderBy(F.coalesce("label", F.lit("")), "url")


def url_table_check(rows: DataFrame, columns: tuple[str, ...] = ("url", "label")) -> DataFrame:
    """(check, ok, detail) rows for an intake table: columns, labels, size, rows per class."""
    spark = rows.sparkSession
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        return spark.range(1).select(
            F.lit("columns").alias("check"),
            F.lit(False).alias("ok"),
            F.lit("missing: " + ", ".join(missing)).alias("detail"),
        )
    counts = (
        rows.groupBy(F.lower(F.coalesce("label", F.lit(""))).alias("label"))
        .agg(F.count("*").alias("n"))
    )
    valid = F.col("label").isin("list", "detail", "others")
    per_class = counts.select(
        F.concat(F.lit("class:"), F.col("label")).alias("check"),
        F.when(valid, F.col("n") >= 30).otherwise(False).alias("ok"),
        F.col("n").cast("string").alias("detail"),
    )
    overall = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).alias("bad"),
    ).select(
        F.explode(
            F.array(
                F.struct(
                    F.lit("rows").alias("check"),
                    (F.col("rows") >= 3).alias("ok"),
                    F.col("rows").cast("string").alias("detail"),
                ),
                F.struct(
                    F.lit("labels").alias("check"),
                    (F.col("bad") == 0).alias("ok"),
                    F.col("bad").cast("string").alias("detail"),
                ),
            )
        ).alias("r")
    ).select("r.*")
    return per_class.unionByName(overall)


# ---- features in long form ------------------------------------------------------------------

# How the inspection view sorts features into pillars. A feature can be in several.
PILLAR_PREFIXES = {
    "STRUCTURAL": ("tag_", "li_", "dom_", "has_data_table", "grid_", "article_section"),
    "CONTENT": (
        "h1_", "h2_", "h3_", "h4_", "word_", "char_", "para", "avg_para", "rich_", "log_word",
        "log_rich", "deep_content", "has_main", "has_article_el", "text_conc", "single_h1",
        "heading_hier", "content_avail",
    ),
    "MEDIA": (
        "image_", "log_image", "alt_", "gallery_", "has_image_gallery", "has_video", "figure_",
        "figcaption_", "images_with",
    ),
    "URL": ("url_",),
    "COMPOSITE": ("composite_",),
}
PILLAR_PARTS = {
    "LINK": ("link", "anchor"),
    "LISTING": (
        "pagination", "filter_ui", "result_count", "repeated", "breadcrumb", "compare_check",
    ),
    "DETAIL": (
        "price", "buy_cta", "author", "publish_date", "rating", "toc", "internal_anchor",
        "spec_section", "share_button", "comments", "related",
    ),
    "INTERACTION": ("form", "button", "select", "range_input", "tab", "login", "search_form"),
    "METADATA": (
        "og_type", "twitter", "schema", "microdata", "canonical", "robots", "lang",
    ),
    "SEMANTIC": ("cue_word", "numeric_token", "title_"),
}


def pillars_of(feature: Column) -> Column:
    """Array of the pillars a feature name belongs to."""
    tests = []
    for pillar, prefixes in PILLAR_PREFIXES.items():
        hits = [F.startswith(feature, F.lit(p)) for p in prefixes]
        tests.append(F.when(reduce(lambda a, b: a | b, hits), F.lit(pillar)))
    for pillar, parts in PILLAR_PARTS.items():
        hits = [F.contains(feature, F.lit(p)) for p in parts]
        tests.append(F.when(reduce(lambda a, b: a | b, hits), F.lit(pillar)))
    return F.filter(F.array(*tests), lambda p: p.isNotNull())


def feature_unpivot(features: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keys, feature, value), one row per page and feature."""
    names = [c for c in features.columns if c in FEATURE_COLUMNS]
    as_double = features.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    return as_double.unpivot(list(keys), names, "feature", "value")


def feature_long(features: DataFrame) -> DataFrame:
    """(page_id, pillar, feature, value); features outside every pillar are left out."""
    long = feature_unpivot(features)
    return long.select(
        "page_id", F.explode(pillars_of(F.col("feature"))).alias("pillar"), "feature", "value"
    )


def feature_compare(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Features that differ between the two pages of each pair (``a``, ``b`` are page ids).

    ``features`` is read once: a page's values, one array, go to each pair it is in, and the two sides
    meet by pair; only the differing features become rows. Equal pairs count once. A page without
    stored features counts as all zeros.
    """
    names = [c for c in features.columns if c in FEATURE_COLUMNS]
    packed = features.select(
        F.col("page_id").alias("page"), F.array(*[F.col(n).cast("double") for n in names]).alias("v")
    )
    sides = F.array(
        *[F.struct(F.col(p).alias("page"), F.lit(p).alias("side")) for p in ("a", "b")]
    )
    members = pairs.select("a", "b", F.explode(sides).alias("m")).select("a", "b", "m.*")
    of_side = lambda p: F.any_value(F.when(F.col("side") == p, F.col("v")), ignoreNulls=True)
    joined = (
        members.join(packed, "page", "left")
        .groupBy("a", "b")
        .agg(of_side("a").alias("va"), of_side("b").alias("vb"))
    )
    zeros = F.array_repeat(F.lit(0.0), len(names))
    name_list = F.array(*[F.lit(n) for n in names])
    entries = F.zip_with(
        name_list,
        F.arrays_zip(
            F.coalesce("va", zeros).alias("x"), F.coalesce("vb", zeros).alias("y")
        ),
        lambda n, v: F.struct(
            n.alias("feature"), v["x"].alias("value_a"), v["y"].alias("value_b")
        ),
    )
    differing = F.filter(entries, lambda e: e["value_a"] != e["value_b"])
    rows = joined.select("a", "b", F.explode_outer(differing).alias("e")).filter("e is not null")
    return rows.select("a", "b", "e.*", (F.col("e.value_b") - F.col("e.value_a")).alias("diff"))


def top_features(importance: DataFrame, k: int = 40) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(k)


def feature_lookup(url: str, ledger: DataFrame, stored: DataFrame, predicted: DataFrame) -> DataFrame:
    """Features of one URL: the training store through the ledger first, else the predicted store."""
    from siftpage.functions.url import url_key

    first = (
        ledger.filter(F.col("url") == url)
        .filter(F.col("key").isNotNull() & F.col("label").isNotNull())
        .select("key", F.lit(0).alias("rank"))
        .join(stored, "key")
    )
    second = predicted.filter(F.col("key") == url_key(F.lit(url))).withColumn("rank", F.lit(1))
    both = first.unionByName(second, allowMissingColumns=True)
    return both.orderBy("rank").limit(1).drop("rank")
