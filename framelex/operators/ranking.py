"""Ragged multiple-choice ranking in long form.

Input rows ``(example_id, choice_idx, logit[, label])``; padding is never
materialised. Per-example statistics are grouped aggregates (partial
aggregation before the shuffle) joined back on ``example_id`` (AQE splits
a skewed example), not per-example windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.rownum import global_index


def argmax(logits: DataFrame) -> DataFrame:
    """First index of the maximum logit per example."""
    return (logits.groupBy("example_id")
            .agg(F.max_by("choice_idx", F.struct(F.col("logit"), -F.col("choice_idx"))).alias("pred")))


def softmax(logits: DataFrame) -> DataFrame:
    """A10: ``exp(x - max) / sum(exp(x - max))`` per example."""
    m = logits.groupBy("example_id").agg(F.max("logit").alias("_m"))
    e = logits.join(m, "example_id").withColumn("_e", F.exp(F.col("logit") - F.col("_m")))
    s = e.groupBy("example_id").agg(F.sum("_e").alias("_s"))
    return e.join(s, "example_id").withColumn("p", F.col("_e") / F.col("_s")).drop("_m", "_e", "_s")


def example_loss(logits: DataFrame) -> DataFrame:
    """A11 per example: ``logsumexp(x) - x[label]`` over its own choices."""
    m = logits.groupBy("example_id").agg(F.max("logit").alias("_m"))
    e = logits.join(m, "example_id")
    return (e.groupBy("example_id")
            .agg(F.first("_m").alias("_m"),
                 F.sum(F.exp(F.col("logit") - F.col("_m"))).alias("_s"),
                 F.max(F.when(F.col("choice_idx") == F.col("label"), F.col("logit"))).alias("_xl"))
            .select("example_id", (F.log("_s") + F.col("_m") - F.col("_xl")).alias("loss")))


def mean_loss(logits: DataFrame) -> DataFrame:
    """Mean example loss; 0.0 when there are no labels."""
    l = example_loss(logits.where(F.col("label").isNotNull()))
    return l.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))


def batch_ids(examples: DataFrame, batch_size: int, order: list = None) -> DataFrame:
    """``batch_id = floor(rank / B)`` in example order (global row
    numbers by range partitioning, never one unpartitioned window)."""
    order = order or ["example_id"]
    g = global_index(examples, order, "_rn")
    return g.withColumn("batch_id", F.floor(F.col("_rn") / batch_size).cast("bigint")).drop("_rn")


def batched_loss(logits: DataFrame, batch_size: int) -> DataFrame:
    """Mean of per-batch mean losses (a short last batch weighs the
    same as a full one)."""
    l = example_loss(logits.where(F.col("label").isNotNull()))
    b = batch_ids(l, batch_size)
    per = b.groupBy("batch_id").agg(F.avg("loss").alias("bl"))
    return per.agg(F.coalesce(F.avg("bl"), F.lit(0.0)).alias("loss"))


def choice_offsets(logits: DataFrame, batch_size: int) -> DataFrame:
    """Per example, its choice count and the exclusive running sum
    of counts inside its batch (the flat offset of its first choice)."""
    n = logits.groupBy("example_id").agg(F.count(F.lit(1)).alias("n_choice"))
    b = batch_ids(n, batch_size)
    w = Window.partitionBy("batch_id").orderBy("example_id").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("offset", F.coalesce(F.sum("n_choice").over(w), F.lit(0)).cast("bigint"))


def tanh_prob(logits: DataFrame) -> DataFrame:
    """``(1 + tanh(x)) / 2``."""
    return logits.withColumn("p", (F.lit(1.0) + F.tanh("logit")) / 2)


def accuracy(preds: DataFrame) -> DataFrame:
    """Mean of ``pred == label`` over labelled rows."""
    return (preds.where(F.col("label").isNotNull())
            .agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"),
                 F.count(F.lit(1)).alias("n")))
