"""Approximate nearest neighbours by multi-index hashing.

Vectors get 64-bit codes: the signs of their coordinates in learned rotations
(principal directions of a bounded sample, rotated to lose the least by
quantisation). The code is split into 8 substrings with a table each. For a
radius r, a code within r bits of the query is within floor(r / 8) bits of it
in one substring at least (one bit less in those beyond r mod 8), so probing
the tables at those substring distances retrieves every code within r. What
is retrieved is checked by its full Hamming distance and reranked by the exact
cosine of the original vectors.

The queries are a stated set. Rows and queries are dealt to blocks of bounded
size, each cell (query block, row block) builds the row block's tables, and
the cells' best meet per query. The radius is learned: the sample's true
neighbours lie within it with probability ``WITHIN``. Where a cell finds fewer
than k, it widens the radius until it has k or all of its rows.

Defined cases: vectors that are null, zero, of another than the most frequent
length, or hold null or non-finite components take no part, nor do null ids;
of rows that repeat an id the smallest vector counts; no vectors, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import bucket_of, cut, importable

BITS, SUBSTRINGS = 64, 8
#: Rows of the sample that the rotation and the radius are learned from.
FIT_ROWS, FIT_QUERIES = 4_096, 256
WITHIN = 0.99
ROW_BLOCK, QUERY_BLOCK = 8_192, 16_384


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(x):
    """Rows as doubles, each scaled by a power of two (no cosine changes) so
    that squares neither overflow nor vanish."""
    import numpy as np

    x = np.asarray(x, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def cosines(x, q):
    """Cosine of each row with q; every row is summed alike, so equal rows
    have equal cosines."""
    import numpy as np

    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def codes(x, rotation):
    """64-bit codes of the rows as unsigned integers."""
    import numpy as np

    return np.packbits(x @ rotation > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def learn(sample, k: int, seed: int = 0, rounds: int = 40):
    """(dim x 64 rotation, radius) from the sample's rows."""
    import numpy as np

    rng = np.random.default_rng(seed)
    x = scaled(sample)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    dim = x.shape[1]
    width = min(dim, BITS)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :width]
    parts = []
    for _ in range(-(-BITS // width)):  # several rotations for short vectors
        r = np.linalg.qr(rng.standard_normal((width, width)))[0]
        v = x @ axes
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(axes @ r)
    rotation = np.concatenate(parts, axis=1)[:, :BITS]
    c = codes(x, rotation)
    far = []
    for i in range(0, len(x), max(1, len(x) // FIT_QUERIES)):
        s = x @ x[i]
        s[i] = -2
        near = np.argsort(-s)[:min(k, len(x) - 1)]
        far.append(np.bitwise_count(c[near] ^ c[i]))
    far = np.concatenate(far) if far else np.zeros(0)
    return rotation, int(np.quantile(far, WITHIN)) + 1 if len(far) else BITS


class Tables:
    """The substring tables of a block of codes."""

    def __init__(self, block):
        import numpy as np

        self.codes = block
        self.bytes = block.view(np.uint8).reshape(-1, SUBSTRINGS)
        self.order = [np.argsort(self.bytes[:, t], kind="stable") for t in range(SUBSTRINGS)]
        self.start = [np.searchsorted(self.bytes[o, t], np.arange(257)) for t, o in enumerate(self.order)]
        every = np.arange(256)
        self.flips = [every[np.bitwise_count(every.astype(np.uint8)) <= r] for r in range(9)]

    def within(self, code, radius: int):
        """Rows whose codes are within the radius."""
        import numpy as np

        if radius >= BITS:
            return np.arange(len(self.codes))
        found, q = np.zeros(len(self.codes), bool), np.array([code]).view(np.uint8)
        for t in range(SUBSTRINGS):
            # pigeonhole: only the first radius % 8 + 1 substrings need the
            # full share, the others one bit less
            r = radius // SUBSTRINGS - (t > radius % SUBSTRINGS)
            if r < 0:
                continue
            v = self.flips[r] ^ int(q[t])
            a, n = self.start[t][v], self.start[t][v + 1] - self.start[t][v]
            total = int(n.sum())
            if total:
                found[self.order[t][np.repeat(a - np.cumsum(n) + n, n) + np.arange(total)]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
           fit_rows: int = FIT_ROWS, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, radius: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row
    that ``is_query`` picks, its own id left out."""
    spark = vectors.sparkSession
    importable(spark)
    id_type = vectors.schema[vec_id].dataType
    t = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    t = t.where(F.col("id").isNotNull() & usable(F.col("v")))
    t = t.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    t = cut(t, "ann-rows")
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])
    result = "query_id", "rank", "vec_id", "score"
    lengths = t.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1)).select(*result)
    t = t.where(F.size("v") == lengths["n"])
    sample = t.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").collect()
    rotation, learned = learn([r["v"] for r in sample], k)
    radius = learned if radius is None else radius
    rows, queries = t.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    row_blocks, query_blocks = max(1, -(-rows // row_block)), max(1, -(-queries // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = t.select("id", "v", F.lit(False).alias("ask"), bucket_of("id", n=row_blocks).alias("rb"), every(query_blocks).alias("qb"))
    asked = t.where("q").select("id", "v", F.lit(True).alias("ask"), every(row_blocks).alias("rb"), bucket_of("id", n=query_blocks).alias("qb"))

    def cell(table):
        import numpy as np
        import pyarrow as pa

        ask = table.column("ask").to_numpy(zero_copy_only=False)
        ids = table.column("id").combine_chunks()
        x = scaled(np.stack(table.column("v").to_numpy()))
        code = codes(x, rotation)
        row, query = np.flatnonzero(~ask), np.flatnonzero(ask)
        # in the order of ids, so that a stable sort by score keeps ties right
        key = np.array(ids.to_pylist(), object) if not np.issubdtype(ids.to_numpy(zero_copy_only=False).dtype, np.number) else ids.to_numpy()
        row = row[np.argsort(key[row], kind="stable")]
        block, tables = x[row], Tables(code[row])
        out_q, out_v, out_s = [], [], []
        for q in query if len(row) else ():
            r = radius
            while True:
                near = tables.within(code[q], r)
                near = near[key[row[near]] != key[q]]
                if len(near) >= k or r >= BITS:
                    break
                r += 4
            s = cosines(block[near], x[q])
            best = np.argsort(-s, kind="stable")[:k]
            out_q += [q] * len(best)
            out_v += row[near[best]].tolist()
            out_s += s[best].tolist()
        return pa.table({"query_id": ids.take(pa.array(out_q, pa.int64())), "vec_id": ids.take(pa.array(out_v, pa.int64())),
                         "score": pa.array(out_s, pa.float64())})

    best = dealt.unionByName(asked).groupBy("qb", "rb").applyInArrow(cell, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*result)
