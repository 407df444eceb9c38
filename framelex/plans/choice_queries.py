"""Registered queries: ragged choice ranking on ``lineitem`` and
training-log windows on ``events``.

Mapping: example = ``l_orderkey``; choice_idx = 0-based rank inside the
order by all columns; logit = ``l_discount * 10`` (many ties);
label = ``l_orderkey % n_choice``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ranking
from ..plans.rownum import global_index, rank_in_group
from ..session import scratch_path
from ..sources import files
from .context import table

EVAL_BATCH = 8          # default evaluation batch size
LOG_WINDOW = 50         # steps per logging window

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def lineitem_logits(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    r = rank_in_group(li, ["l_orderkey"], LINE_ORDER, "choice_idx", size_name="n_choice")
    return r.select(F.col("l_orderkey").alias("example_id"), "choice_idx",
                    (F.col("l_discount") * 10).alias("logit"),
                    (F.col("l_orderkey") % F.col("n_choice")).cast("int").alias("label"),
                    F.col("n_choice").cast("int").alias("n_choice"))


def q_choice_offsets(spark, sf):
    o = ranking.choice_offsets(lineitem_logits(spark, sf), EVAL_BATCH)
    return o.select("example_id", F.col("n_choice").cast("bigint").alias("n_choice"), "batch_id", "offset")


def q_choice_argmax(spark, sf):
    return ranking.argmax(lineitem_logits(spark, sf)).select("example_id", F.col("pred").cast("int").alias("pred"))


def q_choice_accuracy(spark, sf):
    lg = lineitem_logits(spark, sf)
    p = ranking.argmax(lg).join(lg.select("example_id", "label").distinct(), "example_id")
    a = ranking.accuracy(p)
    return a.select(F.round("accuracy", 6).alias("accuracy"), "n")


def q_choice_softmax(spark, sf):
    s = ranking.softmax(lineitem_logits(spark, sf))
    return s.select("example_id", "choice_idx", F.round("p", 6).alias("p"))


def q_choice_probs(spark, sf):
    s = ranking.tanh_prob(lineitem_logits(spark, sf))
    return s.select("example_id", "choice_idx", F.round("p", 6).alias("p"))


def q_choice_loss(spark, sf):
    return ranking.mean_loss(lineitem_logits(spark, sf)).select(F.round("loss", 6).alias("loss"))


def q_eval_loss_batched(spark, sf):
    return ranking.batched_loss(lineitem_logits(spark, sf), EVAL_BATCH).select(F.round("loss", 6).alias("loss"))


def q_sink_pred_lines(spark, sf):
    """S11 rows: one line per example in id order: predicted label, and the
    comma-joined tanh probabilities of its choices."""
    lg = lineitem_logits(spark, sf)
    pred = ranking.argmax(lg)
    probs = (ranking.tanh_prob(lg).groupBy("example_id")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("choice_idx", "p"))),
                                           lambda x: F.format_number(x["p"], 6)), ",").alias("probs")))
    return pred.join(probs, "example_id").select(
        "example_id", F.concat_ws("\t", F.col("pred").cast("string"), "probs").alias("line"))


def _written_lines(spark, df, order, column):
    path = scratch_path(spark, f"lines/{uuid.uuid4().hex}")
    files.write_lines(df, order, column, path)
    lines = files.read_lines(spark, path)
    return lines.select("line_no", F.col("value").alias("line"))


def q_pred_files(spark, sf):
    """Predicted labels, one a line in id order, written to text files
    and read back file by file with their line numbers."""
    pred = ranking.argmax(lineitem_logits(spark, sf)).withColumn("line", F.col("pred").cast("string"))
    return _written_lines(spark, pred, ["example_id"], "line")


def q_prob_files(spark, sf):
    """The same for the comma-joined probabilities."""
    lines = q_sink_pred_lines(spark, sf).select("example_id", F.substring_index("line", "\t", -1).alias("line"))
    return _written_lines(spark, lines, ["example_id"], "line")


def q_report_file(spark, sf):
    """The report's sorted lines, written and read back."""
    from .label_queries import q_metrics_report
    return _written_lines(spark, q_metrics_report(spark, sf), ["key"], "line")


def q_train_batches(spark, sf, batch_size: int = 36, seed: int = 0, epoch: int = 0):
    """Seeded shuffle of labelled documents into batches."""
    lab = table(spark, sf, "labels")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col("doc_id").cast("string")))
    g = global_index(lab.withColumn("_k", key), ["_k", "doc_id"], "rn")
    b = g.withColumn("batch_id", F.floor(F.col("rn") / batch_size).cast("bigint"))
    return (b.groupBy("batch_id")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "doc_id"))),
                                                lambda x: x["doc_id"].cast("string")), ",")).alias("ids_md5")))


def q_train_log_windows(spark, sf):
    """Events as a training log (step = position by (ts,
    event_id), loss = value): mean loss per window of 50 steps and the
    window's best step (highest value, first on ties)."""
    ev = table(spark, sf, "events").select("event_id", "ts", "value")
    g = global_index(ev, ["ts", "event_id"], "rn").withColumn("step", F.col("rn") + 1)
    win = F.floor((F.col("step") - 1) / LOG_WINDOW).cast("bigint")
    return (g.groupBy(win.alias("window"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_loss"),
                 F.max_by("step", F.struct(F.col("value"), -F.col("step"))).alias("best_step")))
