"""Evaluation tables from (actual, predicted) pairs. Every metric starts from one small count table.

The count per (group, actual, predicted) is a partial aggregate with at most classes squared rows per
group, so everything after it is tiny whatever the number of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpage.functions.vocab import CLASSES


MODES = ("ml", "pre", "full")


def _guarded(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def pair_counts(rows: DataFrame, group: tuple[str, ...] = (), counted: str | None = None) -> DataFrame:
    """``counted`` names a column with the number of rows that a row stands for."""
    n = F.sum(counted) if counted else F.count("*")
    return rows.groupBy(*group, "actual", "predicted").agg(n.alias("n"))


def confusion(
    rows: DataFrame, classes: tuple[str, ...] = CLASSES, group: tuple[str, ...] = ()
) -> DataFrame:
    """Rows: actual class, columns: predicted class; classes without rows appear as zeros."""
    counted = pair_counts(rows, group)
    cells = [
        F.sum(F.when((F.col("predicted") == c), F.col("n")).otherwise(0)).alias(c) for c in classes
    ]
    return _with_all_classes(counted, classes, group).groupBy(*group, "actual").agg(*cells)


def _with_all_classes(counted: DataFrame, classes: tuple[str, ...], group: tuple[str, ...]):
    """A zero row per class (and group), so that no class is missing after the group-by."""
    spark = counted.sparkSession
    if group:
        zero = counted.select(*group).distinct()
    else:
        zero = spark.range(1).select()
    blank = zero.select(
        *group,
        F.explode(F.array(*[F.lit(c) for c in classes])).alias("actual"),
        F.lit(None).cast("string").alias("predicted"),
        F.lit(0).cast("bigint").alias("n"),
    )
    return counted.filter(F.col("actual").isin(*classes)).unionByName(blank)


def class_report(
    rows: DataFrame,
    classes: tuple[str, ...] = CLASSES,
    group: tuple[str, ...] = (),
    groups: DataFrame | None = None,
    counted_by: str | None = None,
) -> DataFrame:
    """Per class: support, predicted, correct, precision, recall, f1; zeros where undefined.

    ``groups`` names the groups where they are known, so that the rows need not be read for them;
    ``counted_by`` a column with the number of rows that a row stands for.
    """
    counted = pair_counts(rows, group, counted_by)
    sides = counted.select(
        *group,
        "n",
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("class"), F.lit(1).alias("is_actual")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).alias("is_actual")),
            )
        ).alias("s"),
        (F.col("actual") == F.col("predicted")).alias("hit"),
    )
    actual = F.col("s.is_actual") == 1
    if groups is None:
        groups = counted.select(*group).distinct() if group else rows.sparkSession.range(1)
    blank = groups.select(
        *group,
        F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"),
        *[F.lit(0).cast("bigint").alias(x) for x in ("support", "predicted", "correct")],
    )
    per_class = (
        sides.groupBy(*group, F.col("s.class").alias("class"))
        .agg(
            F.sum(F.when(actual, F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(~actual, F.col("n")).otherwise(0)).alias("predicted"),
            F.sum(F.when(actual & F.col("hit"), F.col("n")).otherwise(0)).alias("correct"),
        )
        .filter(F.col("class").isin(*classes))
        .unionByName(blank)
        .groupBy(*group, "class")
        .agg(*[F.sum(x).alias(x) for x in ("support", "predicted", "correct")])
    )
    precision = _guarded(F.col("correct"), F.col("predicted"))
    recall = _guarded(F.col("correct"), F.col("support"))
    return (
        per_class.withColumns({"precision": precision, "recall": recall})
        .withColumn(
            "f1",
            _guarded(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )


def summary(report: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """One row (per group): n, correct, accuracy, macro and weighted averages."""
    n = F.sum("support")
    out = [
        n.alias("n"),
        F.sum("correct").alias("correct"),
        _guarded(F.sum("correct"), n).alias("accuracy"),
    ]
    for metric in ("precision", "recall", "f1"):
        out.append(F.avg(metric).alias(f"macro_{metric}"))
        out.append(_guarded(F.sum(F.col(metric) * F.col("support")), n).alias(f"weighted_{metric}"))
    return report.groupBy(*group).agg(*out)


def three_verdicts(rows: DataFrame) -> DataFrame:
    """Adds model, rule and full-pipeline label, confidence and method to each sample.

    Input: url, true_label, ml_label, ml_conf, verdict (nullable), read_error (nullable text).
    """
    error = F.col("read_error").isNotNull()
    verdict = F.when(~error, F.col("verdict"))
    fired = verdict.isNotNull()
    rule = lambda field, otherwise: F.when(fired, F.col(f"verdict.{field}")).otherwise(otherwise)
    return rows.select(
        "url",
        "true_label",
        "ml_label",
        "ml_conf",
        F.lit("ml_model").alias("ml_method"),
        rule("label", F.col("ml_label")).alias("pre_label"),
        rule("confidence", F.col("ml_conf")).alias("pre_conf"),
        F.when(error, F.concat(F.lit("html_error: "), F.col("read_error")))
        .when(fired, F.col("verdict.method"))
        .otherwise("no_rule")
        .alias("pre_method"),
        rule("label", F.col("ml_label")).alias("full_label"),
        rule("confidence", F.col("ml_conf")).alias("full_conf"),
        rule("method", F.lit("ml_model")).alias("full_method"),
    )


def fired() -> Column:
    """A rule gave the verdict; unreadable pages do not count."""
    return (F.col("pre_method") != "no_rule") & ~F.startswith("pre_method", F.lit("html_error"))


def by_mode(verdicts: DataFrame) -> DataFrame:
    """Long table (mode, actual, predicted): ml and full for every sample, pre for fired rules."""
    pair = lambda mode, label: F.struct(F.lit(mode).alias("mode"), label.alias("predicted"))
    modes = F.array(
        pair("ml", F.col("ml_label")),
        F.when(fired(), pair("pre", F.col("pre_label"))),
        pair("full", F.col("full_label")),
    )
    return verdicts.select(
        F.col("true_label").alias("actual"), F.explode(modes).alias("m")
    ).filter("m is not null").select("m.mode", "actual", "m.predicted")


def compare_modes(verdicts: DataFrame) -> DataFrame:
    return summary(mode_report(verdicts), ("mode",))


def mode_report(verdicts: DataFrame) -> DataFrame:
    """The class report of each mode, from one pass over the verdicts."""
    modes = verdicts.sparkSession.createDataFrame([(m,) for m in MODES], "mode string")
    return class_report(by_mode(verdicts), group=("mode",), groups=modes)


def class_by_mode(verdicts: DataFrame) -> DataFrame:
    """Per class: f1 in the three modes and the support among all samples."""
    report = mode_report(verdicts)
    picks = [
        F.coalesce(F.max(F.when(F.col("mode") == m, F.col("f1"))), F.lit(0.0)).alias(f"{m}_f1")
        for m in MODES
    ]
    support = F.max(F.when(F.col("mode") == "ml", F.col("support"))).alias("support")
    return report.groupBy("class").agg(*picks, support)


def rule_breakdown(verdicts: DataFrame) -> DataFrame:
    """Per rule method and for TOTAL: fired, correct, accuracy; unreadable pages are listed too."""
    hit = F.col("pre_label") == F.col("true_label")
    return (
        verdicts.filter(F.col("pre_method") != "no_rule")
        .rollup("pre_method")
        .agg(F.count("*").alias("fired"), F.count_if(hit).alias("correct"))
        .select(
            F.coalesce("pre_method", F.lit("TOTAL")).alias("method"),
            "fired",
            "correct",
            _guarded(F.col("correct"), F.col("fired")).alias("accuracy"),
        )
    )


def rule_errors(verdicts: DataFrame) -> DataFrame:
    wrong = (F.col("pre_method") != "no_rule") & (F.col("pre_label") != F.col("true_label"))
    return verdicts.filter(wrong).select(
        "url", "true_label", "pre_label", "pre_method", "pre_conf"
    )


def disagreements(verdicts: DataFrame) -> DataFrame:
    differs = (F.col("pre_method") != "no_rule") & (F.col("pre_label") != F.col("ml_label"))
    ok = lambda name: (F.col(f"{name}_label") == F.col("true_label")).alias(f"{name}_ok")
    return verdicts.filter(differs).select(
        "url", "true_label", "pre_label", "ml_label", "full_label", "pre_method",
        ok("pre"), ok("ml"), ok("full"),
    )


def misclassified(verdicts: DataFrame, mode: str = "full") -> DataFrame:
    label = F.col(f"{mode}_label")
    return verdicts.filter(label != F.col("true_label")).select(
        "url",
        "true_label",
        label.alias("predicted"),
        F.col(f"{mode}_conf").alias("confidence"),
        F.col(f"{mode}_method").alias("method"),
    )


def gain_summary(verdicts: DataFrame) -> DataFrame:
    """One row: both accuracies, the gain from rules, how many samples rules decided."""
    n = F.count("*")
    ml = F.count_if(F.col("ml_label") == F.col("true_label"))
    full = F.count_if(F.col("full_label") == F.col("true_label"))
    hits = F.count_if(fired())
    return verdicts.agg(
        n.alias("n"),
        _guarded(ml, n).alias("ml_accuracy"),
        _guarded(full, n).alias("full_accuracy"),
        (_guarded(full, n) - _guarded(ml, n)).alias("gain"),
        hits.alias("fired"),
        (n - hits).alias("for_model"),
    )


def export_rows(verdicts: DataFrame) -> DataFrame:
    """The 14 columns of the evaluation file; pre_correct is null where no rule fired."""
    hit = lambda name: (F.col(f"{name}_label") == F.col("true_label")).cast("int")
    return verdicts.select(
        "url", "true_label", "ml_label", "ml_conf", "pre_label", "pre_conf", "pre_method",
        "full_label", "full_conf", "full_method",
        hit("ml").alias("ml_correct"),
        hit("full").alias("full_correct"),
        fired().cast("int").alias("pre_fired"),
        F.when(fired(), hit("pre")).alias("pre_correct"),
    )


def load_samples(ledger: DataFrame, features: DataFrame, pages: DataFrame) -> DataFrame:
    """Samples fit for evaluation: fetched and extracted, with features and page present."""
    ready = ledger.filter(
        (F.col("scrape_status") == "success")
        & (F.col("extract_status") == "success")
        & F.col("label").isNotNull()
        & F.col("key").isNotNull()
    ).select("url", "key", F.col("label").alias("true_label"))
    stored = features.drop("url", "label")
    return ready.join(pages.select("url", "page_id"), "url").join(stored, "page_id")


def held_out(samples: DataFrame, split: DataFrame) -> DataFrame:
    """Samples whose URL is in the test part of the split."""
    return samples.join(split.filter("is_test").select("url").distinct(), "url", "left_semi")
