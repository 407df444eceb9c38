"""What a mixed row carries through the shuffles does not grow with the shards."""

from pyspark.sql import functions as F

from framelex.llm import mixing


def test_no_row_carries_the_shards_through_a_shuffle(spark, monkeypatch):
    seen, sums = [], mixing.prefix_sums

    def watched(rows, *args):
        seen.append(rows.columns)
        return sums(rows, *args)

    monkeypatch.setattr(mixing, "prefix_sums", watched)
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 7 else None, i % 50) for i in range(300)], "doc_id long, source string, size long")
    got = mixing.plan(df, shards=40).withColumn("taken", mixing.taken()).collect()
    assert seen and not any(c in ("_ends", "_end") for c in seen[0])
    # a source's shards still come from its own line, and their words add up
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5
        assert len({c.shard for r in mine for c in r.copies}) > 10
    assert mixing.plan(df.where("false"), shards=40).count() == 0
    wide = mixing.plan(df.withColumn("size", F.lit(0)), shards=40).select(mixing.taken().alias("taken")).collect()
    assert {r.taken for r in wide} == {0}
