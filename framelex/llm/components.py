"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest
    node that a path reaches. Rounds of large-star and small-star steps, each
    written to the shared folder, until the edges form stars; a hub is a hot
    key of plain joins, which adaptive execution splits."""
    e = cut(_oriented(edges), "cc-0")
    state = _state(e)
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-min")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(_oriented(large), "cc-large")
        least = cut(e.groupBy("a").agg(F.min("b").alias("m")), "cc-min")
        small = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        e = cut(_oriented(small), "cc-small")
        now = _state(e)
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now


def _oriented(edges: DataFrame) -> DataFrame:
    return (edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _state(e: DataFrame):
    """Number and fingerprint of the edges; nothing here can overflow."""
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(0), "a"))).first())
