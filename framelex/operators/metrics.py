"""Classifier metrics as one-row DataFrames (A7, A8) and the text report
(S12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def binary_metrics(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Accuracy, precision, recall, F1 of 0/1 predictions;
    ``zero_division=0``."""
    p, y = F.col(pred), F.col(label)
    a = df.agg(F.count(F.lit(1)).alias("n"),
               F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"),
               F.count_if((p == 0) & (y == 1)).alias("fn"), F.count_if(p == y).alias("ok"))

    def ratio(num, den):
        return F.when(den == 0, F.lit(0.0)).otherwise(num / den)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return a.select(ratio(F.col("ok"), F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
                    ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def report_lines(metrics: DataFrame, key_width: int = 16) -> DataFrame:
    """Sorted ``key=value`` lines, key left-aligned in ``key_width``
    columns (one row per metric, via ``stack``)."""
    cols = metrics.columns
    stack = "stack({n}, {pairs}) as (key, value)".format(
        n=len(cols), pairs=", ".join(f"'{c}', cast(round(`{c}`, 6) as string)" for c in cols))
    return (metrics.selectExpr(stack)
            .select("key", F.concat(F.rpad("key", key_width, " "), F.lit("="), F.col("value")).alias("line")))
