"""Classification reports per window and overall, from one confusion table.

The confusion counts are a partial aggregate (at most windows x classes^2
rows), so everything after the first ``groupBy`` works on a tiny table; the
per-window and overall levels come from one ``GROUPING SETS`` pass instead
of a loop over windows.

Semantics follow the usual text report of a classifier: the classes of a
group are those present in its truth or its predictions; a zero division
gives 0; ``macro avg`` is the plain mean over those classes, ``weighted avg``
weights by support, ``accuracy`` is correct / all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmon.functions.periods import decimal_year, display_month, extract_date_info

AVERAGES = ("macro avg", "weighted avg")


def confusion_counts(pred: DataFrame, keys=("project",), period_col: str | None = "period",
                     true_col: str = "y_true", pred_col: str = "y_pred") -> DataFrame:
    """Rows per (keys, window, true class, predicted class)."""
    groups = [*keys, *([period_col] if period_col else []), true_col, pred_col]
    return pred.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))


def _class_sides(conf: DataFrame, keys, period_col, true_col, pred_col) -> DataFrame:
    """Each confusion cell counts once for its true class and once for its predicted class."""
    n = F.col("n")
    truth = F.struct(F.col(true_col).alias("class"), n.alias("support"),
                     F.when(F.col(true_col) == F.col(pred_col), n).otherwise(F.lit(0)).alias("tp"),
                     F.lit(0).cast("bigint").alias("predicted"))
    guess = F.struct(F.col(pred_col).alias("class"), F.lit(0).cast("bigint").alias("support"),
                     F.lit(0).cast("bigint").alias("tp"), n.alias("predicted"))
    cols = [*keys, *([period_col] if period_col else [])]
    return conf.select(*cols, F.explode(F.array(truth, guess)).alias("s")).select(*cols, "s.*")


def _metrics(df: DataFrame) -> DataFrame:
    tp, sup, prd = (F.col(c).cast("double") for c in ("tp", "support", "predicted"))
    return (
        df.withColumn("precision", F.coalesce(F.try_divide(tp, prd), F.lit(0.0)))
        .withColumn("recall", F.coalesce(F.try_divide(tp, sup), F.lit(0.0)))
        .withColumn("f1_score", F.coalesce(F.try_divide(2 * tp, sup + prd), F.lit(0.0)))
    )


def _share(part, whole):
    """``part / whole``, 0 where a window has no row of the classes asked for."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def report_by_window(pred: DataFrame, keys=("project",), period_col: str = "period",
                     true_col: str = "y_true", pred_col: str = "y_pred", labels=None) -> DataFrame:
    """Long report: ``keys, scope, period, class, precision, recall, f1_score, support``.

    ``scope`` is ``window`` (one report per window) or ``overall`` (period null).
    ``labels`` fixes the class set of every group (absent classes get zeros).
    """
    keys = list(keys)
    conf = confusion_counts(pred, keys, period_col, true_col, pred_col)
    sides = _class_sides(conf, keys, period_col, true_col, pred_col)
    if labels:
        zero = F.lit(0).cast("bigint")
        fixed = (sides.select(*keys, period_col).distinct()
                 .withColumn("class", F.explode(F.array(*[F.lit(c) for c in labels])))
                 .withColumn("support", zero).withColumn("tp", zero).withColumn("predicted", zero))
        sides = sides.where(F.col("class").isin(list(labels))).unionByName(fixed)
    per_class = sides.groupingSets([[*keys, period_col, "class"], [*keys, "class"]], *keys, period_col, "class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.grouping(period_col).alias("_overall"),
    )
    per_class = _metrics(per_class.withColumn(
        "scope", F.when(F.col("_overall") == 1, F.lit("overall")).otherwise(F.lit("window"))))
    group = [*keys, "scope", period_col]
    totals = per_class.groupBy(*group).agg(
        F.avg("precision").alias("m_p"), F.avg("recall").alias("m_r"), F.avg("f1_score").alias("m_f"),
        _share(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("w_p"),
        _share(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("w_r"),
        _share(F.sum(F.col("f1_score") * F.col("support")), F.sum("support")).alias("w_f"),
        _share(F.sum("tp"), F.sum("support")).alias("acc"),
        F.sum("support").alias("support"),
    )
    out_cols = [*group, "class", "precision", "recall", "f1_score", "support"]
    classes = per_class.select(*out_cols)
    macro = totals.select(*group, F.lit("macro avg").alias("class"), F.col("m_p").alias("precision"),
                          F.col("m_r").alias("recall"), F.col("m_f").alias("f1_score"), "support")
    weighted = totals.select(*group, F.lit("weighted avg").alias("class"), F.col("w_p").alias("precision"),
                             F.col("w_r").alias("recall"), F.col("w_f").alias("f1_score"), "support")
    accuracy = totals.select(*group, F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                             F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1_score"), "support")
    return (classes.unionByName(macro).unionByName(weighted).unionByName(accuracy)
            .withColumn("support", F.col("support").cast("bigint")))


def classification_report(pred: DataFrame, keys=("project",), true_col: str = "y_true",
                          pred_col: str = "y_pred", labels=None) -> DataFrame:
    """One report per key over all its rows."""
    r = report_by_window(pred.withColumn("_all", F.lit("all")), keys, "_all", true_col, pred_col, labels)
    return r.where(F.col("scope") == "overall").drop("scope", "_all")


def report_averages(report: DataFrame) -> DataFrame:
    """Only the ``accuracy``, ``macro avg`` and ``weighted avg`` rows."""
    return report.where(F.col("class").isin("accuracy", *AVERAGES))


def macro_f1_series(report: DataFrame, keys=("project",), period_col: str = "period") -> DataFrame:
    """Macro F1 per window; a key without window reports gets one ``aggregated`` row."""
    keys = list(keys)
    macro = report.where(F.col("class") == "macro avg")
    windows = macro.where(F.col("scope") == "window").select(*keys, period_col, F.col("f1_score").alias("f1_macro"))
    overall = macro.where(F.col("scope") == "overall").select(
        *keys, F.lit("aggregated").alias(period_col), F.col("f1_score").alias("f1_macro"))
    fallback = overall.join(windows.select(*keys).distinct(), keys, "left_anti")
    return windows.unionByName(fallback)


def performance_timeline(series: DataFrame, keys=("project",), period_col: str = "period") -> DataFrame:
    """(decimal date, macro F1, window) per window, windows with unreadable labels skipped."""
    info = series.withColumn("_info", extract_date_info(period_col))
    pts = info.where(F.col("_info").isNotNull()).withColumn("decimal_date", decimal_year("_info"))
    return pts.where(F.col("decimal_date").isNotNull()).select(
        *keys, period_col, "decimal_date", "f1_macro", display_month("decimal_date").alias("display_date"))


def report_as_nested(report: DataFrame, keys=("project",), period_col: str = "period") -> DataFrame:
    """Export form: one row per (keys, window) with ``MAP<class, STRUCT<metrics>>`` and its JSON."""
    entry = F.struct(F.col("class"), F.struct("precision", "recall", "f1_score", "support"))
    nested = report.groupBy(*keys, "scope", period_col).agg(
        F.map_from_entries(F.collect_list(entry)).alias("report"))
    return nested.withColumn("report_json", F.to_json("report"))
