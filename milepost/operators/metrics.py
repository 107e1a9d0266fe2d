"""Metrics of scored rows: a ``label`` (0/1), a ``score`` and a prediction.

Scores are aggregated to distinct values first; ranks over them are running
totals, so no task sees more than a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milepost.functions import expressions as X
from milepost.operators.distributed import running_totals


def apply_threshold(score: str | Column, threshold: float | Column) -> Column:
    """``score >= threshold``; a literal threshold must lie in [0, 1]."""
    if isinstance(threshold, int | float):
        if not 0.0 <= threshold <= 1.0:
            raise ValueError("threshold must be between 0 and 1")
        threshold = F.lit(float(threshold))
    column = F.col(score) if isinstance(score, str) else score
    return column >= threshold


def score_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: positives, negatives, and both counted from the top down."""
    counted = scored.groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    return running_totals(
        counted, [F.col("score").desc()],
        {"tp": F.col("pos"), "fp": F.col("neg")}, list(by),
    )


def pr_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 at every distinct score used as threshold."""
    curve = score_curve(scored, by)
    totals = curve.groupBy(*by).agg(F.max("tp").alias("_positives"))
    joined = (
        curve.join(totals, list(by), "left") if by
        else curve.withColumn("_positives", totals.scalar())
    )
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.when(F.col("_positives") > 0, F.col("tp") / F.nullif("_positives", F.lit(0)))
    p, r = F.col("precision"), F.col("recall")
    return (
        joined.withColumns({"precision": precision, "recall": F.coalesce(recall, F.lit(1.0))})
        .withColumn("f1", F.when(p + r > 0, 2.0 * p * r / F.nullif(p + r, F.lit(0.0)))
                    .otherwise(0.0))
        .select(*by, F.col("score").alias("threshold"), "precision", "recall", "f1", "tp", "fp")
    )


def best_f1(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The threshold with the highest F1; among ties the lowest."""
    best = F.max_by(
        F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", -F.col("threshold"))
    )
    return curve.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def ranking_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC and step-wise average precision."""
    curve = score_curve(scored, by)
    above = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    step = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    sums = curve.groupBy(*by).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
        F.sum(above).alias("_above"), F.sum(step).alias("_step"),
    )
    pairs = F.col("_p") * F.col("_n").cast("double")
    return sums.select(
        *by,
        (F.col("_above") / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"),
        (F.col("_step") / F.nullif("_p", F.lit(0))).alias("pr_auc"),
    )


def confusion(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The four counts of ``label`` against ``prediction``."""
    y, z = F.col("label") == 1, F.col("prediction").cast("int") == 1
    return scored.groupBy(*by).agg(
        F.count("*").alias("row_count"),
        F.count_if(y & z).alias("true_positives"),
        F.count_if(~y & ~z).alias("true_negatives"),
        F.count_if(~y & z).alias("false_positives"),
        F.count_if(y & ~z).alias("false_negatives"),
    )


def class_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, balanced accuracy and positive rate from the four counts."""
    tp, tn = F.col("true_positives"), F.col("true_negatives")
    fp, fn = F.col("false_positives"), F.col("false_negatives")
    sensitivity = tp / F.nullif(tp + fn, F.lit(0))
    specificity = tn / F.nullif(tn + fp, F.lit(0))
    both = F.when(sensitivity.isNull(), specificity).when(specificity.isNull(), sensitivity)
    return counts.select(
        *by, "row_count",
        X.ratio(tp, tp + fp).alias("precision"),
        X.ratio(tp, tp + fn).alias("recall"),
        X.ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"),
        both.otherwise((sensitivity + specificity) / 2.0).alias("balanced_accuracy"),
        X.ratio(tp + fp, F.col("row_count")).alias("predicted_positive_rate"),
        "true_positives", "true_negatives", "false_positives", "false_negatives",
    )


def binary_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All metrics; ``note`` marks a group that holds one class only."""
    classes = class_metrics(confusion(scored, by), by)
    ranks = ranking_metrics(scored, by)
    if by:
        joined = classes.join(ranks, list(by), "left")
    else:
        joined = classes.withColumn("_r", ranks.select(F.struct("*")).scalar()).select(
            *classes.columns, "_r.*"
        )
    return joined.withColumn(
        "note", F.when(F.col("roc_auc").isNull(), "one class only").otherwise("")
    )
