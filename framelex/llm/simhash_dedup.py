"""SimHash near-duplicates: shingle fingerprints, pigeonhole blocks, components.

Texts are lower-cased (A-Z), split into words at ASCII blanks and shingled;
each shingle's XXH64 votes on the 64 bits of the fingerprint, and a bit is set
if more than half of the shingles, repeats included, set it. Two fingerprints
that differ in at most r bits agree on at least ``BLOCKS - r`` of ``BLOCKS``
blocks of bits, so they meet in one of the tables keyed by that many blocks.
Only distinct fingerprints are compared, every meeting is verified by its
Hamming distance, and a component is the set of fingerprints that links reach.

A bucket of a table is compared in one task, without giving out its pairs: it
returns a spanning forest. Buckets of more than ``BUCKET`` fingerprints are
not compared; their fingerprints are linked exactly by shared midpoints: two
fingerprints are within r bits if and only if some value is within
floor(r / 2) of one and ceil(r / 2) of the other, so every fingerprint joins
the values around it and no pairs arise.

Defined cases: a text of no words (or null) has fingerprint 0 and is linked
like any other; fewer words than a shingle give one shingle, the whole
sequence; repeated rows share their component; a null id never names a
component unless the component has no other id; an empty table gives an empty
result. Extra columns of the rows that ``deduplicate`` keeps stay, whatever
their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F, types as T

from .common import bucket_of, cut, hidden, importable, remembered, shown, texts_of
from .components import components

BITS = 64
SEED = 42
#: Blocks that the bits are split into; with r = 4 there are 35 tables, each
#: keyed by 3 blocks of 9 or 10 bits.
BLOCKS = 7
#: Largest bucket that one task compares.
BUCKET = 8_192
#: Parts of a component, so that a component of any size is no single task.
PARTS = 64


def fingerprints(docs: DataFrame, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    return with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "fp", shingle, "_text", ["doc_id"])


def with_fingerprint(docs: DataFrame, name: str, shingle: int, text: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and the fingerprint of each row's text as ``name``."""
    importable(docs.sparkSession)
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField(name, T.LongType())])
    at, kept = docs.columns.index(text), [docs.columns.index(c) for c in columns]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        remembered("simhash", dict)  # drops what other operators keep
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, t in enumerate(texts_of(batch.column(at))):
                words = (t or b"").lower().split()
                if not words:
                    continue
                if len(words) <= shingle:
                    out[i] = xxh64_intdigest(b" ".join(words), SEED)
                    continue
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                starts = np.concatenate(([0], ends[:-shingle])).tolist()
                stops = (ends[shingle - 1:] - 1).tolist()
                h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))
                out[i] = majority(h)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out.view(np.int64))], names=[*columns, name])

    return docs.mapInArrow(run, schema)


def majority(h):
    """Bits set in more than half of the hashes, as one hash."""
    import numpy as np

    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):  # bounded memory for texts of any length
        bits = np.unpackbits(h[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0]


def block_masks(radius: int, blocks: int = BLOCKS) -> list[int]:
    """One mask of the agreeing bits for each table."""
    if not 0 <= radius < blocks:
        raise ValueError("the radius must be below the number of blocks")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(fps: DataFrame, radius: int, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect exactly what the links within ``radius`` bits
    connect. ``fps``: distinct fingerprints (column fp), read twice."""
    importable(fps.sparkSession)
    masks = block_masks(radius, blocks)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(keys).alias("key"))
    # most keys have one fingerprint: a count first, then only the others move
    shared = cut(rows.groupBy("key").count().where("count > 1"), "simhash-keys")
    met = cut(rows.join(shared, "key"), "simhash-buckets")
    small = met.where(F.col("count") <= bucket).select("key", "fp")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def out(pairs):
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*pairs)) if pairs else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def flush(key, fp, last):
            """Forests of the runs of equal keys; the last run may go on."""
            starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else np.zeros(1, int)
            upto = len(starts) - 1 if last else max(0, len(starts) - 2)
            pairs = [p for i in range(upto) for p in forest(fp[starts[i]:starts[i + 1]], radius)]
            rest = starts[upto]
            return pairs, key[rest:], fp[rest:]

        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key = np.concatenate((key, batch.column(0).to_numpy()))
            fp = np.concatenate((fp, batch.column(1).to_numpy()))
            pairs, key, fp = flush(key, fp, False)
            yield out(pairs)
        yield out(flush(key, fp, True)[0])

    near = small.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")
    return near.unionByName(_midpoint_links(met.where(F.col("count") > bucket).select("fp").distinct(), radius))


def forest(values, radius: int):
    """Spanning forest of the links within the radius, as arrays of pairs:
    each step takes all values near one of the component's off the rest."""
    import numpy as np

    left = values
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            v = todo.pop()
            near = np.bitwise_count((left ^ v).view(np.uint64)) <= radius
            if near.any():
                found, left = left[near], left[~near]
                todo.extend(found)
                yield found, np.full(len(found), v)


def _midpoint_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links within the radius by shared midpoints, for any number of
    fingerprints: each joins the values around it. A value has at most as many
    fingerprints around it as the ball has values, so the groups are bounded."""
    from pyspark.sql import Window

    inner, outer = radius // 2, radius - radius // 2

    def flips(r):
        return [sum(1 << b for b in c) for k in range(r + 1) for c in combinations(range(BITS), k)]

    hub_masks = flips(inner)
    far_masks = flips(outer)[len(hub_masks):]
    rows = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in hub_masks])).alias("m"), F.lit(True).alias("hub"))
    if far_masks:
        rows = rows.unionByName(fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in far_masks])).alias("m"), F.lit(False).alias("hub")))
    rows = rows.select("fp", "hub", F.col("fp").bitwiseXOR(F.col("m")).alias("z"))
    w = Window.partitionBy("z")
    hub = F.min(F.when(F.col("hub"), F.col("fp"))).over(w)
    return rows.select(F.col("fp").alias("a"), hub.alias("b")).where("b is not null and a != b").distinct()


def _clustered(docs: DataFrame, shingle: int, radius: int, doc_id: str, text: str, blocks: int = BLOCKS, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and for each distinct fingerprint (_fp) the
    root, which tells the components apart, and the component_id."""
    prints = cut(fingerprints(docs, shingle, doc_id, text), "simhash-fp")
    firsts = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = cut(components(links(firsts.select("fp"), radius, blocks, bucket)), "simhash-roots")
    # only fingerprints with links have a root; the others are their own
    linked = firsts.join(roots, firsts["fp"] == roots["node"]).select("fp", "first", "root")
    linked = _with_group(linked, "fp", component_id=(F.min, F.col("first")))
    linked = cut(linked.select(F.col("fp").alias("_fp"), F.col("root").alias("_root"), F.col("component_id").alias("_linked")), "simhash-linked")
    known = cut(firsts.join(linked, firsts["fp"] == linked["_fp"], "left")
                .select(F.col("fp").alias("_fp"), F.coalesce("_root", "fp").alias("root"), F.coalesce("_linked", "first").alias("component_id")), "simhash-components")
    return prints, known


def _with_group(rows: DataFrame, part: str, **totals) -> DataFrame:
    """``rows`` with totals of their root, each (function, Column), where the
    function may be applied to its own results. The rows of a root are dealt to
    parts by ``part``; the totals of the parts, then of the root, go back to the
    parts, so no task has more than a part of a root's rows."""
    rows = rows.withColumn("_part", bucket_of(part, n=PARTS))
    parts = rows.groupBy("root", "_part").agg(*[f(c).alias(name) for name, (f, c) in totals.items()])
    roots = parts.groupBy("root").agg(*[f(F.col(name)).alias(name) for name, (f, _) in totals.items()])
    known = parts.select("root", "_part").join(roots, "root")
    return rows.join(known, ["root", "_part"]).drop("_part")


def cluster(docs: DataFrame, shingle: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text",
            blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id that links
    reach, the document's own included."""
    prints, known = _clustered(docs, shingle, radius, doc_id, text, blocks, bucket)
    known = known.select("_fp", "component_id")
    return prints.join(known, prints["fp"] == known["_fp"], "left").drop("_fp")


def deduplicate(docs: DataFrame, shingle: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns: the one of
    least id, null ids last, then of least fingerprint, then of least text and
    other columns. Rows are judged by id and fingerprint, so an id that loses
    through one text keeps its others; of equal rows one stays."""
    docs, names = hidden(docs)
    doc_id, text = names[doc_id], names[text]
    prints, known = _clustered(docs, shingle, radius, doc_id, text)
    members = cut(prints.join(known, prints["fp"] == known["_fp"]).groupBy("root", "doc_id", "fp").agg(F.count(F.lit(1)).alias("n")), "simhash-members")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    grouped = _with_group(members, "fp", _first=(F.min, rank), _rows=(F.sum, F.col("n"))).where("_rows > 1")
    marks = grouped.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), rank.eqNullSafe(F.col("_first")).alias("_stays"), "n")
    # rows without a mark are the only ones of their group, or its first
    marks = cut(marks.where("not _stays or n > 1").drop("n"), "simhash-marks")
    rows = with_fingerprint(docs, "_print", shingle, text, docs.columns)
    same = rows[doc_id].eqNullSafe(marks["_id"]) & (rows["_print"] == marks["_fp"])
    out = rows.join(marks, same, "left_anti").select(*docs.columns)
    repeated = marks.where("_stays")
    if repeated.isEmpty():
        return shown(out, names)
    sortable = [f.name for f in docs.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    one = rows.join(repeated, same, "left_semi").groupBy(doc_id, "_print").agg(
        F.min_by(F.struct(*docs.columns), F.struct(text, *[c for c in sortable if c != text])).alias("_row"))
    return shown(out.unionByName(one.select("_row.*")), names)
