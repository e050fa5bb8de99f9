"""Validation of binary predictions: confusion counts, lift, ROC and AUC.

The predictions are ranked by a range sort and partition totals, never by a
window over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.expressions import count_where
from touchline.operators.ordered import ordered, running_totals, with_position


def _ranked_scores(data: DataFrame, target: Column, prediction: str) -> DataFrame:
    """Per distinct prediction: its own rows, and the rows at or above it, by class."""
    scores = data.groupBy(F.col(prediction).alias("threshold")).agg(
        count_where(target).alias("_pos"), count_where(~target).alias("_neg")
    )
    return running_totals(
        ordered(scores, F.desc("threshold")), {"tp": F.col("_pos"), "fp": F.col("_neg")}
    )


def roc_points(data: DataFrame, target: Column, prediction: str) -> DataFrame:
    """True and false positives at every distinct prediction taken as threshold."""
    ranked = _ranked_scores(data, target, prediction)
    totals = ranked.agg(F.struct(F.sum("_pos").alias("p"), F.sum("_neg").alias("n"))).scalar()
    return ranked.select(
        "threshold", "tp", "fp",
        F.try_divide("tp", totals["p"]).alias("tpr"),
        F.try_divide("fp", totals["n"]).alias("fpr"),
    )


def auc(data: DataFrame, target: Column, prediction: str) -> DataFrame:
    """Area under the ROC curve by trapezoids; tied predictions share a point."""
    points = _ranked_scores(data, target, prediction)
    area = F.sum(F.col("_neg") * (F.col("tp") - F.col("_pos") / 2))
    return points.agg(
        F.try_divide(area, F.sum("_pos").cast("double") * F.sum("_neg")).alias("auc")
    )


def validate(
    label: str,
    data: DataFrame,
    target: Column,
    prediction: str,
    baseline: float = 0.5,
    ties: Sequence[str] = ("matchid", "teamid"),
    compute_auc: bool = False,
) -> DataFrame:
    """Confusion counts and scores when the highest predictions are taken as True.

    ``baseline`` is the share (or, above 1, the number) of rows to predict as
    True. Predictions of exactly 0 or 1 are taken at their word. Equal
    predictions are ranked by ``ties``. ``compute_auc`` adds the area under the ROC
    curve. Runs a job.
    """
    judged = data.select(
        *ties, target.alias("_actual"), F.col(prediction).cast("double").alias("_score")
    )
    ranked = with_position(ordered(judged, F.desc("_score"), *ties))
    rows = ranked.agg(F.count("*")).scalar()
    expected = F.lit(float(baseline)) if baseline > 1 else rows * F.lit(float(baseline))
    predicted = (
        F.when(F.col("_score") == 0, False)
        .when(F.col("_score") == 1, True)
        .otherwise(F.col("_pos") < expected)
    )
    actual = F.coalesce("_actual", F.lit(False))
    cells = ranked.select(actual.alias("a"), predicted.alias("p")).agg(
        count_where(F.col("a") & F.col("p")).alias("tp"),
        count_where(~F.col("a") & ~F.col("p")).alias("tn"),
        count_where(~F.col("a") & F.col("p")).alias("fp"),
        count_where(F.col("a") & ~F.col("p")).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(name) for name in ("tp", "tn", "fp", "fn"))
    count = tp + tn + fp + fn
    hit_rate = F.coalesce(F.try_divide(tp, tp + fp), F.lit(-1.0))
    base_rate = F.try_divide(tp + fn, count)
    report = cells.select(
        F.lit(label).alias("label"),
        "tp", "tn", "fp", "fn",
        (tp + fn).alias("positives"),
        (tn + fp).alias("negatives"),
        count.alias("rows"),
        (F.lit(float(baseline)) / (count if baseline > 1 else 1)).alias("baseline"),
        hit_rate.alias("p1_t"),
        F.coalesce(F.try_divide(tn, tn + fn), F.lit(-1.0)).alias("p0_f"),
        F.when(base_rate > 0, hit_rate / base_rate).otherwise(0.0).alias("lift"),
        F.try_divide(tp + tn, count).alias("accuracy"),
    )
    if not compute_auc:
        return report
    return report.join(F.broadcast(auc(data, target, prediction)))  # one row each
