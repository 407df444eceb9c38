"""Frames x LU tables, tiered negative sampling (O3) and splits.

Sampling without cross joins: every candidate list is ranked once per tier
group by ``md5(seed|frame|lu)`` and cut to the few rows a query can use;
examples then equi-join those short lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import lu_no_pos, lu_pos
from ..plans.joins import broadcast_within

SALT_BUCKETS = 64


def frame_lu_defs(lus: DataFrame) -> DataFrame:
    """(frame_name, lu, lu_def, lu_no_pos), one row per (frame, lu)."""
    d = lus.groupBy("frame_name", "lu").agg(F.min("lu_def").alias("lu_def"))
    return d.withColumn("lu_no_pos", lu_no_pos(F.col("lu")))


def _suffixes(col: str, max_len: int) -> Column:
    return F.array(*[F.when(F.length(col) >= k, F.substring(col, -k, k)) for k in range(1, max_len + 1)])


def top_k_per_group(df: DataFrame, group: list[str], order: list[str], k: int,
                    buckets: int = SALT_BUCKETS) -> DataFrame:
    """First ``k`` rows of every group in ``order``, skew-safe: rank inside
    (group, salt) sub-groups first, so a group holding a third of the rows
    is split over ``buckets`` tasks; the second ranking sees at most
    ``buckets * k`` rows per group."""
    salted = df.withColumn("_salt", F.abs(F.xxhash64(*order)) % buckets)
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    pre = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return pre.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= k).drop("_r")


def sample_negatives(examples: DataFrame, defs: DataFrame, k: int = 4, seed: int = 0) -> DataFrame:
    """Up to ``k`` other LUs per example ``(frame_name, lu)``, by tiers:
    1 same frame and LU text ends with the example's POS; 2 same frame;
    3 ends with the POS; 4 any. Always ``lu != own``. Inside a tier the
    order is ``md5(seed|frame|lu)``; earlier tiers first; a (frame, lu)
    row counts once (its lowest tier)."""
    ex = examples.select("frame_name", "lu").distinct().withColumn("pos", lu_pos(F.col("lu")))
    d = defs.select(F.col("frame_name").alias("c_frame"), F.col("lu").alias("c_lu"))
    d = d.withColumn("rk", F.md5(F.concat_ws("|", F.lit(str(seed)), "c_frame", "c_lu")))
    # A list of 3k rows with at most k rows per LU text is enough at any size:
    # leaving out the example's own LU removes at most k of them, and rows
    # that earlier tiers already drew at most k more.
    keep = 3 * k
    # POS strings that occur, and for each the LUs ending with it (equi-join
    # on every short suffix of the LU text)
    pos_set = ex.select("pos").distinct()
    pst = pos_set.agg(F.max(F.length("pos")).alias("m"), F.count(F.lit(1)).alias("c")).first()
    max_pos, n_pos = int(pst["m"] or 1), int(pst["c"] or 0)
    sfx = d.select("c_frame", "c_lu", "rk", F.explode(F.array_distinct(F.filter(
        _suffixes("c_lu", max_pos), lambda x: x.isNotNull()))).alias("sfx"))
    sfx = sfx.join(F.broadcast(pos_set), sfx["sfx"] == pos_set["pos"], "left_semi")

    order = ["rk", "c_frame", "c_lu"]
    # t1, t2: an LU text occurs once in a frame, so the per-LU cap is met
    t1 = top_k_per_group(sfx, ["c_frame", "sfx"], order, keep)
    t2 = top_k_per_group(d, ["c_frame"], order, keep)
    t3 = top_k_per_group(top_k_per_group(sfx, ["sfx", "c_lu"], order, k), ["sfx"], order, keep)
    # global first rows: per-partition top-k then a merge (no single-task window)
    t4 = top_k_per_group(d, ["c_lu"], order, k).orderBy(*order).limit(keep)
    # replicate the bounded list over a few hash buckets of the examples:
    # an equi-join on the bucket (a constant key would be folded into a
    # nested-loop join)
    t4 = t4.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT_BUCKETS - 1))).alias("_b"))
    c1 = ex.join(t1, (ex["frame_name"] == t1["c_frame"]) & (ex["pos"] == t1["sfx"])).withColumn("tier", F.lit(1))
    c2 = ex.join(t2, ex["frame_name"] == t2["c_frame"]).withColumn("tier", F.lit(2))
    # t3 has at most keep rows per POS string and t4 keep rows: both are
    # bounded lists, broadcast and equi-joined (t4 on a constant key)
    c3 = ex.join(broadcast_within(t3, n_pos * keep), ex["pos"] == t3["sfx"]).withColumn("tier", F.lit(3))
    c4 = (ex.withColumn("_b", F.pmod(F.xxhash64("frame_name", "lu"), F.lit(SALT_BUCKETS)).cast("int"))
          .join(broadcast_within(t4, keep * SALT_BUCKETS), "_b").withColumn("tier", F.lit(4)))
    cols = ["frame_name", "lu", "c_frame", "c_lu", "rk", "tier"]
    allc = (c1.select(*cols).unionByName(c2.select(*cols)).unionByName(c3.select(*cols))
            .unionByName(c4.select(*cols)).where(F.col("c_lu") != F.col("lu")))
    best = allc.groupBy("frame_name", "lu", "c_frame", "c_lu").agg(F.min("tier").alias("tier"), F.first("rk").alias("rk"))
    w = Window.partitionBy("frame_name", "lu").orderBy("tier", "rk", "c_frame", "c_lu")
    return (best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
            .select("frame_name", "lu", F.col("c_frame").alias("neg_frame"), F.col("c_lu").alias("neg_lu"),
                    "tier", (F.col("r") - 1).alias("rank")))


def assign_split(files: DataFrame, col: str, dev: list[str], test: list[str]) -> DataFrame:
    """Dev and test by list; train = every other value (anti
    join against the held-out lists)."""
    spark = files.sparkSession
    held = spark.createDataFrame([(x, "dev") for x in dev] + [(x, "test") for x in test], f"{col} STRING, split STRING")
    held = F.broadcast(held)
    train = files.join(held, col, "left_anti").withColumn("split", F.lit("train"))
    return files.join(held, col).unionByName(train)
