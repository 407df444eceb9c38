"""Mixing sources to target weights by a multivariate-hypergeometric tree.

Each source's documents form a line of words in a pseudo-random but fixed
order (md5 of the seed and the id). The mix takes the line's first
``quota`` words, going round again where the quota exceeds the source, so a
source meets its target to the word and only the document at the line's end
is cut. The taken line is divided into blocks; a binary tree over the output
shards splits the sources' block counts by multivariate-hypergeometric draws
of exact size, so that every shard is a random sample of the mix without
replacement. A shard's blocks of a source are a stretch of the source's line
that no other shard has, and rows are shuffled within the shard.

Targets: the sources, by code point with null last, get the weights in turn;
they share ``share`` times all words by weight, no source more than ``cap``
times its own, and the excess is shared again by weight until none is above.

Defined cases: a null text has no words; sources of no words get no target;
a null source is a source; rows that repeat an id stand next to each other
in the line and each counts; an empty table gives an empty result. Extra
columns stay, whatever their names; those named as a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.joins import broadcast_measured
from .common import WORD, cut, hidden, importable, prefix_sums, shown

#: Least words of a block; more where the mix would exceed MAX_BLOCKS.
BLOCK_WORDS, MAX_BLOCKS = 64, 1 << 26
#: Sub-ranges of a source's line, so that no source is one task.
LINE_BUCKETS_HEX = 3
#: Shards that one task of the tree splits into.
FAN_OUT = 64
#: Words of an output shard, and the least and most shards: a source's line
#: carries one entry a shard, and rows of a shard may span several tasks.
SHARD_WORDS, MIN_SHARDS, MAX_SHARDS = 1 << 20, 16, 4_096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0,
            source: str = "source", size: str = "size") -> DataFrame:
    """One row per source: s (rank), source, source_size, target."""
    stats = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    # windows over one row per source
    s = stats.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    s = s.withColumns({"_weight": weight, "_cap": F.col("source_size") * F.lit(float(cap))})
    s = s.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    every = Window.partitionBy(F.lit(1))
    rising = every.orderBy("_ratio", "s")
    s = s.withColumn("_all", F.sum("source_size").over(every) * F.lit(float(share)))
    # the level if the sources before this one are full: what is left over
    # the weights from here on; the first that stays below its cap sets it
    s = s.withColumn("_before", F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_rest", F.sum("_weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_rest"))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "s", "_level"))).over(every)["_level"]
    s = s.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("_weight"), F.col("_cap"))))
    return s.select("s", "source", "source_size", "target")


def shard_counts(blocks: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(s, shard, n): the blocks (s, blocks) of each source dealt to shards of
    equal size, by hypergeometric splits down a binary tree. A task handles
    one node and the ``FAN_OUT`` nodes below it."""
    importable(blocks.sparkSession)
    t = blocks.select(F.col("s").cast("int").alias("s"), F.col("blocks").cast("long").alias("n"), F.lit(0).alias("lo"), F.lit(shards).alias("hi"))

    def splitter(step):
        def run(table):
            import numpy as np
            import pyarrow as pa

            lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
            order = np.argsort(table.column("s").to_numpy())
            s, n = table.column("s").to_numpy()[order], table.column("n").to_numpy()[order]
            out, todo = [], [(lo, hi, n)]
            while todo:
                a, b, n = todo.pop()
                if b - a <= step:
                    out.append((a, b, n))
                    continue
                # cut at a multiple of the step near the middle
                mid = min(a + max(step, (b - a) // 2 // step * step), b - 1)
                total = int(n.sum())
                left = total * (mid - a) // (b - a)
                rng = np.random.default_rng([seed, a, b])
                first = rng.multivariate_hypergeometric(n, left, method="marginals") if total else n
                todo += [(a, mid, first), (mid, b, n - first)]
            keep = [(x, y, s[n > 0], n[n > 0]) for x, y, n in out]
            return pa.table({"s": np.concatenate([k[2] for k in keep]).astype(np.int32), "n": np.concatenate([k[3] for k in keep]),
                             "lo": np.concatenate([np.full(len(k[2]), k[0], np.int32) for k in keep]),
                             "hi": np.concatenate([np.full(len(k[2]), k[1], np.int32) for k in keep])})

        return run

    width = shards
    while width > 1:
        width = -(-width // FAN_OUT)
        t = t.groupBy("lo", "hi").applyInArrow(splitter(width), "s int, n long, lo int, hi int")
    return t.select("s", F.col("lo").alias("shard"), "n")


def plan(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int | None = None, seed: int = 0,
         doc_id: str = "doc_id", source: str = "source", size: str = "size") -> DataFrame:
    """``docs`` (with a size in words) plus source_size, target and copies:
    for each round of the line that reaches the document a struct of copy,
    shard, words taken and ``more`` (whether over half of it is taken).
    ``shards``: by default one for each ``SHARD_WORDS`` words of the mix."""
    docs, names = hidden(docs)
    doc_id, source, size = names[doc_id], names[source], names[size]
    # one row per source, read several times below
    lines = cut(targets(docs, weights, share, cap, source, size).withColumn("_quota", F.round("target").cast("bigint")), "mixing-targets")
    known = lines.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length("source"), F.lit(0))), F.sum("_quota")).first()
    if shards is None:
        shards = min(MAX_SHARDS, max(MIN_SHARDS, -(-(known[2] or 0) // SHARD_WORDS)))
    every = Window.partitionBy(F.lit(1))
    lines = lines.withColumn("_block", F.greatest(F.lit(BLOCK_WORDS), F.ceil(F.sum("_quota").over(every) / F.lit(MAX_BLOCKS))).cast("bigint"))
    blocks = lines.select("s", F.ceil(F.col("_quota") / F.col("_block")).alias("blocks")).where("blocks > 0")
    counts = shard_counts(blocks, shards, seed)
    # upper ends of the shards' stretches of blocks, one per shard
    ends = counts.withColumn("_end", F.sum("n").over(Window.partitionBy("s").orderBy("shard")))
    ends = ends.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("_end", "shard"))).alias("_ends"))
    lines = lines.withColumnRenamed("source", "_source")
    side = broadcast_measured(lines, known[0] * 128 + (known[1] or 0))
    t = docs.join(side, docs[source].eqNullSafe(side["_source"]))
    spot = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    t = t.withColumn("_spot", spot).withColumn("_bucket", F.substring("_spot", 1, LINE_BUCKETS_HEX))
    t = prefix_sums(t, ["s"], "_bucket", ["_spot", doc_id, size], F.col(size), "_at")
    # the ends grow with the shards, so they meet the rows after the last
    # shuffle: no row carries them through one
    t = t.join(broadcast_measured(ends, known[0] * (64 + 16 * shards)), "s", "left")

    def copy(c):
        start = c * F.col("source_size") + F.col("_at")
        block = F.floor(start / F.col("_block"))
        # the first stretch that ends beyond the block
        stretch = F.get(F.filter("_ends", lambda e: e["_end"] > block), F.lit(0))
        return F.struct(c.cast("int").alias("copy"), stretch["shard"].alias("shard"),
                        F.least(F.col(size), F.col("_quota") - start).alias("words"),
                        (2 * start + F.col(size) <= 2 * F.col("_quota")).alias("more"))

    rounds = F.ceil(F.col("_quota") / F.col("source_size"))
    copies = F.transform(F.sequence(F.lit(0).cast("bigint"), rounds - 1), copy)
    copies = F.filter(copies, lambda c: c["shard"].isNotNull() & (c["words"] >= 0))
    none = F.array().cast("array<struct<copy:int,shard:int,words:bigint,more:boolean>>")
    return shown(t, names, "source_size", "target", F.when((F.col("source_size") > 0) & (F.col("_quota") > 0), copies).otherwise(none).alias("copies"))


def taken(copies: str = "copies") -> Column:
    """Words that the mix takes of a document, repeats counted."""
    return F.aggregate(copies, F.lit(0).cast("bigint"), lambda a, c: a + c["words"])


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int | None = None, seed: int = 0,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed rows: every document as often as the mix takes it whole (the
    one at a line's end if over half of it is taken), with copy and shard,
    shard by shard in shuffled order."""
    docs, names = hidden(docs)
    t = plan(docs.withColumn("_words", words(F.col(names[text]))), weights, share, cap, shards, seed, names[doc_id], names[source], "_words")
    t = t.select(*names.values(), F.explode(F.filter("copies", lambda c: c["more"])).alias("_c")).select(*names.values(), "_c.copy", "_c.shard")
    t = t.withColumn("_order", F.xxhash64(F.lit(seed), F.col(names[doc_id]), F.col("copy"), F.col("shard")))
    # by range: a shard may be spread over tasks, and no task is left empty
    t = t.repartitionByRange("shard", "_order").sortWithinPartitions("shard", "_order")
    return shown(t, names, "copy", "shard")
