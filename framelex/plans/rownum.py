"""Skew-safe global row numbers and per-group ranks.

Cost: one range shuffle and one checkpoint write of the numbered rows.

A window ``row_number() OVER (PARTITION BY g ORDER BY ...)`` puts a whole
group in one task; a group holding a third of the rows would then be one
task. Instead: range-partition by the sort key (the sampler splits a hot
group across partitions), number rows inside each partition, add the
partition's offset (a table with one row per partition), and subtract the
group's first global number (a partial aggregate plus a join that AQE's
skew handling can split).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint_dir

_LOCAL_BITS = 33


def global_index(df: DataFrame, order: list[Column | str], name: str = "gidx",
                 partitions: int | None = None) -> DataFrame:
    """0-based position of each row in the total order ``order``."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    # The ids depend on the range bounds, which are sampled per exchange;
    # freezing the numbered rows in the shared checkpoint folder makes the
    # partition counts and the rows come from one materialisation (and
    # survives lost executors).
    checkpoint_dir(spark)
    t = ordered.withColumn("_mid", mid).checkpoint(eager=True)
    t = t.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS)).withColumn(
        "_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
    counts = t.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: this window is over a table of size n
    offs = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    return (t.join(F.broadcast(offs), "_pid")
            .withColumn(name, (F.col("_off") + F.col("_loc")).cast("bigint"))
            .drop("_mid", "_pid", "_loc", "_off"))


def rank_in_group(df: DataFrame, group: list[str], order: list[Column | str],
                  name: str = "rank", size_name: str | None = None) -> DataFrame:
    """0-based rank of each row inside its group, ordered by ``order``;
    optionally the group's size. One path at every size: the
    range-partitioned global index splits a hot group across tasks, and the
    group's first number (a partial aggregate, joined back) is subtracted."""
    g = global_index(df, [*group, *order], "_g")
    aggs = [F.min("_g").alias("_g0")] + ([F.count(F.lit(1)).alias(size_name)] if size_name else [])
    first = g.groupBy(*group).agg(*aggs)
    out = g.join(first, group).withColumn(name, (F.col("_g") - F.col("_g0")).cast("int"))
    return out.select(*df.columns, name, *([size_name] if size_name else []))
