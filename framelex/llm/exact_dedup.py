"""Exact dedup by deterministic block naming.

Each text, A-Z lower-cased, is cut into blocks of ``BLOCK`` bytes. All blocks
are sorted in buckets of bounded size, and a block's place among the distinct
ones is its integer name. Then adjacent names are paired, and the pairs are
named in the same way, until each document has one name. Names are given by
comparing contents, never by a digest alone, so two documents of equally many
blocks share a name if and only if their texts are equal. A hash only chooses
the bucket that a block is sorted in.

A content may be very frequent. Those that occur more often than a 4096th of
all rows are counted first: there are at most 4096 of them, they are named on
their own and their rows never meet in one task.

Defined cases: a null text counts as empty, and all empty texts are one group;
texts may be of any length; of equal texts the row of largest id stays, null
ids lose to all others; of equal rows exactly one stays; an empty table gives
an empty result. The caller's columns travel in one struct, so their names
cannot clash with the operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..plans.joins import broadcast_measured
from .common import cut, discard, importable, remembered

#: Bytes of a block.
BLOCK = 1024
#: Rows of a bucket that contents are sorted in.
BUCKET_ROWS = 8_192
#: A content is frequent beyond rows / FREQUENT occurrences (and at least
#: LEAST of them), so there are fewer than FREQUENT such contents.
FREQUENT, LEAST = 4_096, 1_024
#: Bytes of blocks that a Python worker hands over at a time.
FLUSH = 8 << 20


def blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None,
           size: int = BLOCK) -> DataFrame:
    """(row, pos, n, block, id, sha, kept): one row for each block of each
    text; ``row`` numbers the documents, ``n`` counts the document's blocks.
    The id, the SHA-256 of the normalised text and the struct of the columns to
    carry stand at the first block only."""
    spark = docs.sparkSession
    importable(spark)
    packed = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("struct<none:int>")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), packed.alias("kept"),
                       F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("block", T.BinaryType()), T.StructField("id", rows.schema["id"].dataType),
                           T.StructField("sha", T.StringType()), T.StructField("kept", rows.schema["kept"].dataType)])

    def run(batches):
        import hashlib

        import pyarrow as pa

        remembered("exact", dict)  # drops what other operators keep

        def out(batch, at, pos, n, parts, sha):
            first = pa.array([a if p == 0 else None for a, p in zip(at, pos)], pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(parts, pa.binary()), batch.column(1).take(first), pa.array(sha, pa.string()), batch.column(2).take(first)],
                names=["row", "pos", "n", "block", "id", "sha", "kept"])

        for batch in batches:
            texts, held = batch.column(3), 0
            at, pos, n, parts, sha = [], [], [], [], []
            for i in range(batch.num_rows):
                t = (texts[i].as_py() or "").encode().lower()  # of bytes: A-Z only
                cuts = [t[a:a + size] for a in range(0, len(t), size)] or [b""]
                at += [i] * len(cuts)
                pos += range(len(cuts))
                n += [len(cuts)] * len(cuts)
                parts += cuts
                sha += [hashlib.sha256(t).hexdigest()] + [None] * (len(cuts) - 1)
                held += len(t)
                if held > FLUSH:
                    yield out(batch, at, pos, n, parts, sha)
                    held, at, pos, n, parts, sha = 0, [], [], [], [], []
            if at:
                yield out(batch, at, pos, n, parts, sha)

    return rows.mapInArrow(run, schema)


def named(rows: DataFrame, key: list[str], frequent: int = FREQUENT, least: int = LEAST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` (a written table) with ``key`` replaced by ``name``, an integer
    that is equal if and only if the keys are (nulls equal each other)."""
    total = rows.count()
    t = rows.withColumn("_h", F.xxhash64(*key))
    others = [c for c in rows.columns if c not in key]
    often = cut(t.groupBy("_h").count().where(F.col("count") > max(least, total // frequent)).select("_h"), "exact-often")
    buckets = total // bucket_rows + 1
    w = Window.partitionBy("_bucket").orderBy("_h", *key)
    hot = F.broadcast(often)  # fewer than ``frequent`` integers
    rare = (t.join(hot, "_h", "left_anti").withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
            .select(*others, (F.col("_bucket") * F.lit(1 << 32) + F.dense_rank().over(w)).alias("name")))
    if often.isEmpty():
        return rare
    # the frequent contents themselves, named below zero in their order
    whole = t.join(hot, "_h", "left_semi").select("_h", *key).distinct()
    whole = cut(whole.withColumn("_name", -F.row_number().over(Window.orderBy("_h", *key)).cast("bigint")), "exact-frequent")
    n_bytes = whole.agg(F.sum(sum([F.octet_length(F.col(c).cast("binary") if c == "block" else F.col(c).cast("string")) for c in key],
                                  F.lit(32)))).first()[0]
    whole = whole.select(F.col("_h").alias("_wh"), *[F.col(c).alias(f"_w_{c}") for c in key], "_name")
    on = t["_h"] == whole["_wh"]
    for c in key:
        on = on & t[c].eqNullSafe(whole[f"_w_{c}"])
    found = t.join(broadcast_measured(whole, int(n_bytes or 0)), on).select(*others, F.col("_name").alias("name"))
    return rare.unionByName(found)


def identities(scan: DataFrame, **limits) -> DataFrame:
    """(row, level, name) of each document of ``scan``, the written table of
    :func:`blocks`: equal if and only if the texts are."""
    nodes, key = scan.select("row", "pos", "n", "block"), ["block"]
    most = nodes.agg(F.max("n")).first()[0] or 0
    done, level = [], 0
    while most > 0:
        given = cut(named(nodes, key, **limits), "exact-names")
        done.append(given.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        if level:
            discard(nodes)
        if most == 1:
            break
        # two neighbours a pair; an odd last name is paired with nothing
        pairs = (given.where("n > 1").groupBy("row", F.expr("pos div 2").alias("half"))
                 .agg(F.max(F.expr("(n + 1) div 2")).alias("n"),
                      F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                      F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"))
                 .withColumnRenamed("half", "pos"))
        nodes, key = cut(pairs, "exact-pairs"), ["a", "b"]
        most, level = (most + 1) // 2, level + 1
    if not done:
        return scan.select("row", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("name")).limit(0)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None,
           block: int = BLOCK, frequent: int = FREQUENT, least: int = LEAST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id (id of the row that stays of its
    group of equal texts), group_size, kept, text_sha256, and ``carried``, the
    struct of the columns to carry."""
    scan = cut(blocks(docs, doc_id, text, carry, block), "exact-blocks")
    ids = identities(scan, frequent=frequent, least=least, bucket_rows=bucket_rows)
    head = scan.where("pos = 0").select("row", "id", "sha", "kept")
    rows = cut(head.join(ids, "row"), "exact-documents")
    discard(scan)
    best = F.max(F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id"), (-F.col("row")).alias("place")))
    sizes = cut(rows.groupBy("level", "name").agg(F.count(F.lit(1)).alias("size"), best.alias("best")).where("size > 1"), "exact-groups")
    bound = max(least, rows.count() // frequent)
    # fewer than ``frequent`` groups are large; their rows stay where they are
    large = F.broadcast(sizes.where(F.col("size") > bound))
    in_large = rows.join(large, ["level", "name"])
    others = (rows.join(large.select("level", "name"), ["level", "name"], "left_anti")
              .join(sizes.where(F.col("size") <= bound), ["level", "name"], "left"))
    alone = F.col("size").isNull()
    return in_large.unionByName(others).select(
        F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (-F.col("row") == F.col("best.place"))).alias("kept"),
        F.col("sha").alias("text_sha256"), F.col("kept").alias("carried"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return groups(docs, doc_id, text, docs.columns, block).where("kept").select("carried.*")
