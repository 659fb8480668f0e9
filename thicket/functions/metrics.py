"""Metrics of predictions; a ratio of nothing is -infinity."""

from __future__ import annotations

from pyspark.sql import DataFrame

UNDEFINED = "cast('-Infinity' as double)"


def ratio(a: str, b: str) -> str:
    return f"case when {b} = 0 then {UNDEFINED} else {a} / {b} end"


def binary(df: DataFrame) -> DataFrame:
    """One row from columns pred and label."""
    cell = lambda p, y: f"count_if(pred = {p} and label = {y})"
    c = df.selectExpr(f"{cell(1, 1)} as tp", f"{cell(1, 0)} as fp", f"{cell(0, 0)} as tn", f"{cell(0, 1)} as fn")
    r = c.selectExpr("*", "(fp + fn) / (tp + fp + tn + fn) as risk", f"{ratio('tp', '(tp + fp)')} as precision", f"{ratio('tp', '(tp + fn)')} as recall", f"{ratio('tn', '(tn + fp)')} as specificity")
    f1 = f"case when precision = {UNDEFINED} or recall = {UNDEFINED} or precision + recall = 0 then {UNDEFINED} else 2 * precision * recall / (precision + recall) end"
    return r.selectExpr("tp", "fp", "tn", "fn", "risk", "precision", "recall as sensitivity", "recall", "specificity", f"{f1} as f1")


def confusion(df: DataFrame, classes: int) -> DataFrame:
    """label, pred, n for every pair of classes."""
    spark = df.sparkSession
    grid = spark.range(classes * classes).selectExpr(f"cast(id div {classes} as int) as label", f"cast(id % {classes} as int) as pred")
    n = df.groupBy("label", "pred").count()
    return grid.join(n, ["label", "pred"], "left").selectExpr("label", "pred", "coalesce(count, 0L) as n")
