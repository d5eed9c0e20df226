"""From rule verdict and model score to one prediction per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABSOLUTE = 0.95  # at or above: the rule stands and the model is not asked
STRONG_RULE = 0.90
MODEL_OVER_STRONG = 0.70
MODEL_OVER_SOFT = 0.60

PREDICTION_COLUMNS = (
    "predicted_label", "confidence", "method", "reason", "probabilities", "fallback_used",
    "content_available", "pre_label", "pre_confidence", "ml_label", "ml_confidence",
    "tiebreaker", "is_error_page",
)


def _percent(x: Column) -> Column:
    return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))


def decide(df: DataFrame, policy: str = "tiebreak") -> DataFrame:
    """Adds the prediction columns.

    Input columns: ``verdict`` (nullable rule struct), ``ml_label``, ``ml_confidence``,
    ``ml_method``, ``probabilities``, ``fallback_used``, ``content_available``.

    ``tiebreak``: a rule at 0.95 or above is final; a model that agrees changes nothing; a model that
    differs wins from 0.70 over a rule at 0.90 or above and from 0.60 over a softer one.
    ``rules_first``: any rule wins, the model only decides where no rule fired.
    """
    if policy not in ("tiebreak", "rules_first"):
        raise ValueError(f"unknown policy: {policy}")
    pre, label, conf = F.col("verdict"), F.col("ml_label"), F.col("ml_confidence")
    fired = pre.isNotNull()
    bar = F.when(pre["confidence"] >= STRONG_RULE, MODEL_OVER_STRONG).otherwise(MODEL_OVER_SOFT)
    if policy == "tiebreak":
        step = (
            F.when(~fired, "ml_only")
            .when(pre["confidence"] >= ABSOLUTE, "absolute_rule")
            .when(pre["label"] == label, "agreement")
            .when(conf >= bar, "ml_wins")
            .otherwise("pre_wins")
        )
    else:
        step = F.when(fired, "rule").otherwise("ml_only")
    staged = df.withColumn("tiebreaker", step)
    step = F.col("tiebreaker")
    by_model = step.isin("ml_only", "ml_wins")
    alone = step.isin("absolute_rule", "rule")
    override = F.when(pre["confidence"] >= STRONG_RULE, "ml_override_pre").otherwise(
        "ml_override_soft_rule"
    )
    shown_ml = F.concat(F.lit("ML("), label, F.lit("@"), _percent(conf), F.lit(")"))
    shown_pre = F.concat(pre["label"], F.lit("@"), _percent(pre["confidence"]))
    reason = (
        F.when(step == "ml_only", F.lit(""))
        .when(
            step == "ml_wins",
            F.concat(
                shown_ml, F.lit(" overrode pre("), shown_pre, F.lit(" via "), pre["method"],
                F.lit(")"),
            ),
        )
        .when(
            step == "pre_wins",
            F.concat(
                F.lit("pre("), shown_pre, F.lit(") held; "), shown_ml,
                F.lit(" below threshold("), _percent(bar), F.lit(")"),
            ),
        )
        .otherwise(F.coalesce(pre["reason"], F.lit("")))
    )
    no_probs = F.create_map().cast("map<string,double>")
    out = {
        "predicted_label": F.when(by_model, label).otherwise(pre["label"]),
        "confidence": F.when(by_model, conf).otherwise(pre["confidence"]),
        "method": F.when(step == "ml_only", F.col("ml_method"))
        .when(step == "ml_wins", override)
        .otherwise(pre["method"]),
        "reason": reason,
        "probabilities": F.when(alone, no_probs).otherwise(F.col("probabilities")),
        "fallback_used": F.when(by_model, F.col("fallback_used")).otherwise(F.lit(False)),
        "content_available": F.when(alone, F.lit(True)).otherwise(F.col("content_available")),
        "pre_label": pre["label"],
        "pre_confidence": pre["confidence"],
        "ml_label": F.when(~alone, label),
        "ml_confidence": F.when(~alone, conf),
        "is_error_page": F.coalesce(pre["is_error_page"], F.lit(False)),
    }
    others = [c for c in df.columns if c not in (*PREDICTION_COLUMNS, "verdict", "ml_method")]
    return staged.select(
        *others, *[(out[c] if c in out else F.col(c)).alias(c) for c in PREDICTION_COLUMNS]
    )


def fetch_failures(decided: DataFrame, blank: str, reason: str = "fetch_reason") -> DataFrame:
    """Overrides the predictions of pages without content (``blank`` names that flag): others at 0.0,
    method ``scrape_failed``; what the rules or the model said of them becomes null."""
    why = F.coalesce(F.col(reason), F.lit("unknown")) if reason in decided.columns else F.lit("unknown")
    failed = {
        "predicted_label": F.lit("others"),
        "confidence": F.lit(0.0),
        "method": F.lit("scrape_failed"),
        "reason": F.concat(F.lit("scraping_failed: "), why),
    }
    return decided.withColumns(
        {
            c: F.when(F.col(blank), failed[c]).otherwise(F.col(c))
            if c in failed
            else F.when(~F.col(blank), F.col(c))
            for c in PREDICTION_COLUMNS
        }
    )


def no_content() -> Column:
    return F.col("html").isNull() | ~F.rlike("html", F.lit(r"(?U)\S"))


def batch_row(status: Column, label: Column) -> Column:
    """Label shown in the batch file: failures carry their own name."""
    return (
        F.when(status == "scrape_failed", "scrape_failed")
        .when(status == "failed", "error")
        .otherwise(label)
    )


def skip_done(urls: DataFrame, done: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """URLs that have no stored prediction in one of the statuses.

    By the URL itself where both sides have it: the key is short and two URLs may share one.
    """
    on = "url" if "url" in urls.columns and "url" in done.columns else "key"
    finished = done.filter(F.col("status").isin(*statuses)).select(on).distinct()
    return urls.join(finished, on, "left_anti")


def decision_summary(results: DataFrame) -> DataFrame:
    """Batch totals as (section, name, n): all, by status, and by label and method of successes."""
    ok = F.col("status") == "success"
    grouped = results.groupBy("status", "predicted_label", "method").agg(F.count("*").alias("n"))
    pairs = F.array(
        F.struct(F.lit("total").alias("section"), F.lit("urls").alias("name")),
        F.struct(F.lit("status").alias("section"), F.col("status").alias("name")),
        F.when(ok, F.struct(F.lit("label").alias("section"), F.col("predicted_label").alias("name"))),
        F.when(ok, F.struct(F.lit("method").alias("section"), F.col("method").alias("name"))),
    )
    return (
        grouped.select("n", F.explode(pairs).alias("p"))
        .filter("p is not null")
        .groupBy("p.section", "p.name")
        .agg(F.sum("n").alias("n"))
    )
