"""Ranked lexical search: exact inner-product search in sparse ball trees.

A document is a sparse vector of integer term impacts, a query one of integer
term weights; the score is their inner product. Documents are dealt to blocks
of bounded size in the order of their heaviest terms, so that a block's vectors
lie close together, and each block carries a ball tree. A node knows the
centroid of its documents, the terms that occur in it, and for each band of
terms the largest distance of a document from the centroid (its radius). For a query q and every document d of the node,

    q.d  <=  q.centroid + sum over bands of |q, this band, the node's terms| * radius,

as terms that no document of the node holds add nothing. The bounds are taken
in doubles and widened by far more than their rounding error. Subtrees are
visited best bound first and left out once the bound is below the k-th best
score so far; leaves are scored in 64-bit integers, so results are exact.

Only terms of the query set move through Spark: a bitmap of fixed size thins
the documents' terms where they are read, a join then confirms them. Queries
are searched in groups of bounded size against all blocks, and a group's best
rows of all partitions meet in a ranked window.

Defined cases: a null text has no terms; documents without terms count neither
in N nor in L; terms that occur in all documents weigh zero; scores of zero are
no result; equal scores go by ascending document id, null ids last; repeated
documents are rows of their own, and so are repeated items, each of which gets
its own ranks; empty tables give empty results. Only ids and texts are read, so
further columns and their names do not matter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..plans.joins import broadcast_measured
from ..plans.rownum import global_index
from .common import cut, importable, remembered, texts_of

#: Bits of the bitmap that thins terms: 1 MB at any size of the query set.
BITMAP = 1 << 23


class Shape(NamedTuple):
    """A block ends after ``docs`` documents or ``terms`` terms, a leaf holds
    ``leaf`` documents, a node is split into ``fan``, and radii are kept for
    ``bands`` bands of terms."""

    docs: int = 2_048
    terms: int = 1 << 19
    leaf: int = 32
    fan: int = 4
    bands: int = 256


#: Queries and their terms in a group that is searched at once.
QUERY_ROWS, QUERY_TERMS = 4_096, 1 << 18
#: Relative widening of a bound; doubles err by less than 1e-12 here.
SAFE = 1e-9

#: Byte table: A-Z to a-z, what is no term byte to a blank. Bytes from 128 on
#: belong to code points outside ASCII, which are all term characters.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(rows: DataFrame, bitmap: bytes | None = None) -> DataFrame:
    """(row, id, n, terms, tfs) for rows (row, id, text): the number of terms
    with repeats, and the distinct ones (of the bitmap) with their counts."""
    importable(rows.sparkSession)
    schema = T.StructType([rows.schema["row"], rows.schema["id"], T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
    bits = rows.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def run(batches):
        from collections import Counter
        from zlib import crc32

        import numpy as np
        import pyarrow as pa

        remembered("ball", dict)  # drops what other operators keep
        mask = bits.value if bits is not None else None
        flush = Shape().terms

        def out(batch, at, n, found):
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            names = pa.array([t.decode() for f in found for t, _ in f], pa.string())
            counts = pa.array([c for f in found for _, c in f], pa.int64())
            part = batch.slice(at, len(n))
            return pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, names),
                 pa.ListArray.from_arrays(offsets, counts)], names=["row", "id", "n", "terms", "tfs"])

        for batch in batches:
            at, n, found, held = 0, [], [], 0
            for text in texts_of(batch.column(2), 64):
                words = (text or b"").translate(_TERM_BYTES).split()
                counted = Counter(words).items()
                if mask is not None:
                    counted = [(t, c) for t, c in counted if mask[(b := crc32(t) % BITMAP) >> 3] >> (b & 7) & 1]
                n.append(len(words))
                found.append(list(counted))
                held += len(found[-1])
                if held > flush:
                    yield out(batch, at, n, found)
                    at, n, found, held = at + len(n), [], [], 0
            if n:
                yield out(batch, at, n, found)

    return rows.select("row", "id", "text").mapInArrow(run, schema)


def bitmap_of(vocabulary: DataFrame) -> bytes:
    """The bitmap of the vocabulary's terms, gathered as at most BITMAP / 64
    words of 64 bits whatever the vocabulary's size."""
    import numpy as np

    bit = F.crc32(F.col("term").cast("binary")) % BITMAP
    words = (vocabulary.select(F.expr(f"crc32(cast(term as binary)) % {BITMAP} div 64").alias("word"), (bit % 64).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    out = np.zeros(BITMAP // 64, np.int64)
    got = words.toPandas()
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.tobytes()  # bit b of word w is bit b % 8 of byte 8 * w + b // 8


def vectors(docs: DataFrame, vocabulary: DataFrame, measured: int, m: tuple[int, int] = (75, 25)) -> tuple[DataFrame, DataFrame]:
    """The documents' sparse vectors (id, terms: array of (tid, s), lead: the
    heaviest terms) and the terms' weights (tid, w). ``vocabulary``: (term,
    tid), with its measured bytes; ``m``: the length norm's share and slope."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("id"), F.col("text").cast("string").alias("text"))
    read = cut(terms(rows, bitmap_of(vocabulary)), "ball-terms")
    n_docs, length = read.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    both = F.explode(F.arrays_zip("terms", "tfs")).alias("t")
    hits = (read.select("row", "id", "n", both).select("row", "id", "n", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
            .join(broadcast_measured(vocabulary, measured), "term").drop("term"))
    odds = F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)
    weights = hits.groupBy("tid").agg(F.count(F.lit(1)).alias("df")).select("tid", F.floor(1000 * F.log(odds)).cast("bigint").alias("w"))
    weights = cut(weights.where("w > 0"), "ball-weights")
    norm = F.expr(f"{m[0]}L + ({m[1]}L * n * {n_docs}L) div {length or 1}L")
    impact = F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)")
    known = hits.withColumn("m", norm).join(broadcast_measured(weights, measured), "tid").withColumn("s", impact)
    vec = known.groupBy("row").agg(
        F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("tid", "s"))).alias("terms"),
        F.max(F.struct((F.col("w") * F.col("s")).alias("ws"), F.col("tid"))).alias("lead"),
        F.max(F.struct("w", "tid")).alias("rarest"))
    return vec, weights


class Block:
    """The ball tree over a block's vectors: arrays (doc, tid, s) in document
    order, so each node is a range of documents."""

    def __init__(self, ids, doc, tid, s, w_of, shape=Shape()):
        import numpy as np

        self.ids, self.shape, n = ids, shape, len(ids)
        bands = shape.bands
        self.tids, local = np.unique(tid, return_inverse=True)
        self.w = w_of(self.tids)
        band = self.tids % bands
        # coordinates are scaled by the root of the weight, on both sides
        x = s * np.sqrt(self.w[local].astype(float)) * 1e-6
        self.doc, self.local, self.s = doc, local, s
        sizes = [shape.leaf]
        while sizes[-1] < n:
            sizes.append(sizes[-1] * shape.fan)
        self.sizes = sizes[::-1]  # documents of a node, from the root down
        self.first, at = [], 0
        node_terms, node_of, centre, radius = [], [], [], []
        norms = np.zeros((n, bands))
        np.add.at(norms, (doc, band[local]), x * x)
        for size in self.sizes:
            nodes = -(-n // size)
            self.first.append(at)
            members = np.minimum(size, n - np.arange(nodes) * size)
            key, back = np.unique((doc // size) * len(self.tids) + local, return_inverse=True)
            c = np.bincount(back, x) / members[key // len(self.tids)]
            inner = np.zeros((n, bands))
            np.add.at(inner, (doc, band[local]), x * c[back])
            own = np.zeros((nodes, bands))
            np.add.at(own, (key // len(self.tids), band[key % len(self.tids)]), c * c)
            of = np.arange(n) // size
            gap = norms - 2 * inner + own[of] + SAFE * (norms + own[of])
            r = np.zeros((nodes, bands))
            np.maximum.at(r, of, np.sqrt(np.maximum(gap, 0)))
            node_of.append(at + key // len(self.tids))
            node_terms.append(key % len(self.tids))
            centre.append(c)
            radius.append(r)
            at += nodes
        self.nodes, self.radius = at, np.concatenate(radius)
        node_terms, node_of, centre = map(np.concatenate, (node_terms, node_of, centre))
        order = np.argsort(node_terms, kind="stable")
        self.entry_node, self.entry_c = node_of[order], centre[order]
        self.entry_at = np.searchsorted(node_terms[order], np.arange(len(self.tids) + 1))
        self.band = band
        # postings by (leaf, term)
        leaf = doc // shape.leaf
        order = np.lexsort((doc, local, leaf))
        self.post_doc, self.post_s = doc[order], s[order]
        self.post_key = (leaf * len(self.tids) + local)[order]

    def bounds(self, mine, weight):
        """Upper bound of every node's scores for one query: its terms' places
        in the block's vocabulary and their weights (query count times w)."""
        import numpy as np

        bands = self.shape.bands
        begin, stop = self.entry_at[mine], self.entry_at[mine + 1]
        count = stop - begin
        take = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        of = np.repeat(np.arange(len(mine)), count)
        q = weight / np.sqrt(self.w[mine].astype(float))
        node = self.entry_node[take]
        middle = np.bincount(node, q[of] * self.entry_c[take], self.nodes)
        spread = np.bincount(node * bands + self.band[mine][of], (q * q)[of], self.nodes * bands).reshape(-1, bands)
        return (middle + (np.sqrt(spread) * self.radius).sum(1)) * (1 + SAFE) * 1e6 + 1

    def scores(self, leaves, mine, weight):
        """Exact scores of the documents of some leaves: (docs, scores)."""
        import numpy as np

        keys = (leaves[:, None] * len(self.tids) + mine).ravel()
        begin, stop = np.searchsorted(self.post_key, keys), np.searchsorted(self.post_key, keys, "right")
        count = stop - begin
        take = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        docs = self.post_doc[take]
        total = np.zeros(len(self.ids), np.int64)
        np.add.at(total, docs, self.post_s[take] * np.repeat(np.tile(weight, len(leaves)), count))
        docs = np.unique(docs)
        return docs, total[docs]

    def search(self, mine, weight, best):
        """Best-first search of one query; ``best`` keeps its k best rows and
        tells the least score that still counts. Returns the leaves scored."""
        import heapq

        import numpy as np

        fan, bound = self.shape.fan, self.bounds(mine, weight)
        heap, visited = [(-bound[0], 0, 0)], 0
        while heap and -heap[0][0] >= best.least:
            ready = []
            while heap and -heap[0][0] >= best.least and not ready:
                _, level, at = heapq.heappop(heap)
                if level == len(self.sizes) - 1:
                    ready.append(at)
                    continue
                below = at * fan
                last = -(-len(self.ids) // self.sizes[level + 1])
                for child in range(below, min(below + fan, last)):
                    b = min(bound[self.first[level] + at], bound[self.first[level + 1] + child])
                    if b >= best.least:
                        heapq.heappush(heap, (-b, level + 1, child))
            if ready:
                visited += len(ready)
                docs, scores = self.scores(np.array(ready), mine, weight)
                best.add(self.ids[docs], scores)
        return visited


class Best:
    """The k best (score, id) of a query, equal scores by ascending id."""

    def __init__(self, k):
        import numpy as np

        self.k, self.least = k, 1
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids, scores):
        import numpy as np

        on = scores >= self.least
        if not on.any():
            return
        ids, scores = np.concatenate((self.ids, ids[on])), np.concatenate((self.scores, scores[on]))
        order = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def _search(index: DataFrame, queries, k: int, shape: Shape) -> DataFrame:
    """(qid, id, score): the k best rows of each partition for each query of
    a group, given as sorted arrays (qid, tid, query count times w, w)."""
    group = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        qid, q_tid, q_weight, q_w = group.value
        starts = np.concatenate(([0], np.flatnonzero(qid[1:] != qid[:-1]) + 1, [len(qid)]))
        names = qid[starts[:-1]]
        best = [Best(k) for _ in names]
        tids, firsts = np.unique(q_tid, return_index=True)
        w = q_w[firsts]
        visited = leaves = 0

        def search(ids, doc, tid, s):
            nonlocal visited, leaves
            at = np.minimum(np.searchsorted(tids, tid), len(tids) - 1)
            on = tids[at] == tid  # terms of this group of queries
            if not on.any():
                return
            block = Block(ids, doc[on], tid[on], s[on], lambda t: w[np.searchsorted(tids, t)], shape)
            place = np.minimum(np.searchsorted(block.tids, q_tid), len(block.tids) - 1)
            held = block.tids[place] == q_tid
            for i, (a, b) in enumerate(zip(starts, starts[1:])):
                mine = place[a:b][held[a:b]]
                if len(mine):
                    visited += block.search(mine, q_weight[a:b][held[a:b]], best[i])
            leaves += len(names) * -(-len(ids) // shape.leaf)

        for ids, doc, tid, s in _blocks(batches, shape):
            search(ids, doc, tid, s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(names, [len(b.ids) for b in best]), pa.int64()),
             pa.array(np.concatenate([b.ids for b in best]) if best else np.zeros(0, np.int64), pa.int64()),
             pa.array(np.concatenate([b.scores for b in best]) if best else np.zeros(0, np.int64), pa.int64()),
             pa.array(np.full(sum(len(b.ids) for b in best), visited), pa.int64()),
             pa.array(np.full(sum(len(b.ids) for b in best), leaves), pa.int64())],
            names=["qid", "id", "score", "visited", "leaves"])

    return index.mapInArrow(run, "qid long, id long, score long, visited long, leaves long")


def _blocks(batches, shape):
    """Arrays (ids, doc, tid, s) of blocks of bounded size, in row order."""
    import numpy as np

    ids, count, tid, s, held = [], [], [], [], 0

    def out():
        n = np.concatenate(count)
        return np.concatenate(ids), np.repeat(np.arange(len(n)), n), np.concatenate(tid), np.concatenate(s)

    docs = 0
    for batch in batches:
        column = batch.column(1)
        offsets = column.offsets.to_numpy()
        items = column.values
        b_tid, b_s = items.field(0).to_numpy(zero_copy_only=False), items.field(1).to_numpy(zero_copy_only=False)
        b_ids = batch.column(0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            # as many rows as the block has room for, one at least
            room = np.searchsorted(offsets, offsets[at] + max(shape.terms - held, 1), "right") - 1
            stop = min(max(room, at + 1), at + shape.docs - docs, batch.num_rows)
            ids.append(b_ids[at:stop])
            count.append(np.diff(offsets[at:stop + 1]))
            tid.append(b_tid[offsets[at]:offsets[stop]])
            s.append(b_s[offsets[at]:offsets[stop]])
            docs, held, at = docs + stop - at, held + int(offsets[stop] - offsets[at]), stop
            if docs >= shape.docs or held >= shape.terms:
                yield out()
                ids, count, tid, s, held, docs = [], [], [], [], 0, 0
    if docs:
        yield out()


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", shape: Shape = Shape(), statistics: bool = False) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    asked = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).alias("id"), F.col(item_text).cast("string").alias("text"))
    asked = cut(terms(asked), "ball-items")
    vocabulary = asked.select(F.explode("terms").alias("term")).distinct()
    vocabulary = cut(global_index(vocabulary, ["term"], "tid"), "ball-vocabulary")
    measured = vocabulary.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    vec, weights = vectors(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), vocabulary, measured)
    # neighbours share their heaviest terms; a partition is searched in blocks
    index = vec.repartitionByRange(F.col("lead.tid"), F.col("rarest.tid"), "row").sortWithinPartitions("lead.tid", "rarest.tid", "row")
    # null ids come after all others among equal scores
    index = cut(index.select(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "terms"), "ball-index")
    parts = asked.select("row", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("row", F.col("t.terms").alias("term"), F.col("t.tfs").alias("qtf"))
    parts = parts.join(broadcast_measured(vocabulary, measured), "term").join(broadcast_measured(weights, measured), "tid")
    parts = cut(parts.select("row", "tid", (F.col("qtf") * F.col("w")).alias("weight"), "w"), "ball-queries")
    found = None
    for rows in _groups(parts):
        got = _search(index, rows, k, shape)
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = spark.createDataFrame([], "qid long, id long, score long, visited long, leaves long")
    found = cut(found, "ball-found")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    top = found.select("qid", "score", "id", F.row_number().over(w).cast("int").alias("rank")).where(F.col("rank") <= k)
    out = top.join(asked.select(F.col("row").alias("qid"), F.col("id").alias("_item")), "qid").select(
        F.col("_item").alias("item_id"), "rank", F.when(F.col("id") != (1 << 63) - 1, F.col("id")).alias("doc_id"), "score")
    if statistics:  # scored and all (query, leaf) pairs, by partition
        out._visits = found.select("visited", "leaves").distinct()
    return out


def _groups(parts: DataFrame):
    """The queries' terms in groups of at most QUERY_ROWS queries and
    QUERY_TERMS terms (a longer query stands alone), as sorted arrays."""
    sizes = parts.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    placed = global_index(sizes, ["row"], "place")
    before = Window.partitionBy("chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("chunk", F.expr(f"place div {QUERY_ROWS}"))
    placed = placed.withColumn("_sum", F.sum("n").over(before))
    placed = cut(placed.select(F.col("row").alias("_r"), "chunk", F.expr(f"(_sum - 1) div {QUERY_TERMS}").alias("sub")), "ball-groups")
    for g in placed.groupBy("chunk", "sub").count().orderBy("chunk", "sub").toLocalIterator():
        mine = placed.where((F.col("chunk") == g["chunk"]) & (F.col("sub") == g["sub"]))
        rows = parts.join(mine, parts["row"] == mine["_r"], "left_semi").orderBy("row", "tid").toPandas()
        yield tuple(rows[c].to_numpy("int64") for c in ("row", "tid", "weight", "w"))
