"""A group holding most rows: ranks stay exact when the hot group is
split across range partitions; per-example softmax stays exact."""

from pyspark.sql import functions as F

from framelex.operators import ranking
from framelex.plans.rownum import global_index, rank_in_group


def test_rank_in_hot_group(spark):
    hot = spark.range(3000).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    cold = spark.range(300).select((F.col("id") % 7 + 2).alias("g"), F.col("id").alias("v"))
    df = hot.unionByName(cold)
    r = rank_in_group(df, ["g"], ["v"], "rk", size_name="n").collect()
    sizes = {x.g: x.n for x in r}
    assert sizes[1] == 3000 and sum(sizes.values()) == 3300
    by = {}
    for x in r:
        by.setdefault(x.g, []).append((x.v, x.rk))
    for g, rows in by.items():
        rows.sort()
        assert [rk for _, rk in rows] == list(range(len(rows))), g
    g = global_index(df, ["g", "v"], "i").agg(F.countDistinct("i"), F.min("i"), F.max("i")).first()
    assert tuple(g) == (3300, 0, 3299)


def test_softmax_hot_example(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, F.lit("hot")).otherwise((F.col("id") % 10).cast("string")).alias("example_id"),
                                  F.col("id").cast("int").alias("choice_idx"), (F.col("id") % 13).cast("double").alias("logit"))
    s = ranking.softmax(df).groupBy("example_id").agg(F.sum("p").alias("s")).collect()
    assert all(abs(x.s - 1) < 1e-9 for x in s)
