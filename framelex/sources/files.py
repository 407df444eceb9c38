"""File sources and sinks: choice CSV by split (S8/S9), text and JSON
sinks (S11-S13)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path

SPLITS = ("train", "dev", "test")


def read_choice_csv(spark: SparkSession, path: str, schema: str, split: str | None = None) -> DataFrame:
    """Header, quoted multi-line fields, no field size limit,
    explicit schema. With a ``split`` the folder is one table partitioned
    by ``split`` and only that partition is read (partition pruning)."""
    if split is not None and split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    r = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
         .option("maxCharsPerColumn", -1))
    if split is None:
        return r.schema(schema).csv(path)
    return r.schema(schema + ", split STRING").csv(path).where(F.col("split") == split)


def write_choice_splits(rows: DataFrame, path: str) -> None:
    """One CSV table partitioned by ``split`` (the test split carries no
    label)."""
    rows = rows.withColumn("label", F.when(F.col("split") == "test", F.lit(None)).otherwise(F.col("label")))
    (rows.write.mode("overwrite").partitionBy("split").option("header", True).option("quote", '"')
     .option("escape", '"').csv(path))


def write_lines(df: DataFrame, order: list[str], line_col: str, path: str) -> None:
    """One line per row in ``order`` (a range-partitioned sort;
    the part files are ordered and their lines are in order)."""
    df.orderBy(*order).select(F.col(line_col).alias("value")).write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Scored rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def round_trip_predictions(df: DataFrame) -> DataFrame:
    """Scored rows written as JSON lines to the stage folder, and what a
    reader of these files gets."""
    path = scratch_path(df.sparkSession, f"predictions/{uuid.uuid4().hex}")
    write_predictions(df, path)
    return df.sparkSession.read.schema(df.schema).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): the lines of a folder of text files as a reader of
    its files in name order sees them. A file is one row while its lines are
    numbered; the sink's files are bounded by its partitions."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    body = F.regexp_replace("value", "\n$", "")
    # an empty file holds no line
    lines = whole.where("value != ''").select("file", F.posexplode(F.split(body, "\n")).alias("at", "value"))
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    starts = sizes.select(F.col("file").alias("_f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return lines.join(starts, lines["file"] == starts["_f"]).select((F.col("_start") + F.col("at")).alias("line_no"), "value")
