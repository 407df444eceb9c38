"""Substring dedup: repeated word windows by a compacted de Bruijn graph.

A window is ``window`` consecutive words of one document; a word goes if a
window covers it whose word sequence also starts earlier. Every window is an
edge of the de Bruijn graph of (window - 1)-word nodes. Most edges occur once
and are never built:

1. Each window has an anchor, its k-mer of least hash. Equal windows have
   equal anchors, so only windows whose anchor occurs more than once can
   repeat. One row per run of windows that share an anchor leaves the scan
   (about one for six words).
2. The runs are the graph's paths: consecutive edges without a branch at the
   anchor, compacted to one hash of all their words. A run that also starts
   earlier is repeated as a whole; a join tells, hot paths being counted
   before they move.
3. Only the first occurrence of each distinct run is taken apart into its
   windows, which meet the windows of other runs by (anchor, window) hashes of
   64 bits each. A window's earliest occurrence always lies in such a first
   run: in any other, its run, and so the window, would start earlier.

Each repeated stretch carries the coordinates of its source, and stretches at
the same distance from one source merge to spans. The spans are then verified by
those coordinates: cut at a grid of the source's words, each piece is read again
at both places and the words compared by a digest of their own. A span with a
piece that differs is verified window by window, and windows that differ go.

Defined cases: a null text has no words; rows that repeat an id and a text
count once and get the same result; other texts under one id are documents in
the order of their hashes; a null id comes before all others; texts shorter
than a window stay whole; an empty table gives an empty result. Extra columns
stay, whatever their names; those named as a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from .common import bucket_of, cut, discard, hidden, importable, release, remembered, shown, texts_of

#: Words of an anchor.
ANCHOR = 8
#: Words that a Python worker remembers the hash of, and words that it
#: handles at a time.
CACHE_WORDS, CHUNK_WORDS = 200_000, 1 << 18
#: Words of a piece that is verified as one, words of a document whose pieces
#: one row lists, and parts of the pieces that have one source.
PIECE, LISTED, PARTS = 256, 8_192, 64
_POSITION = (1 << 24) - 1


class WordHashes(dict):
    """64-bit hash of a word; what was hashed is remembered."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def rolling(words, size: int, factor: int):
    """Hash of the ``size`` words from each place on, by doubling."""
    import numpy as np

    h, width, out, done = words, 1, None, 0
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while True:
        if size & width:
            power = np.uint64(pow(factor, width, 1 << 64))
            out = h[:n] if out is None else out * power + h[done:done + n]
            done += width
        if done == size:
            return _mix(out)
        h = h[:-width] * np.uint64(pow(factor, width, 1 << 64)) + h[width:]
        width *= 2


def sliding_min(h, size: int):
    """Least of the ``size`` values from each place on, by doubling."""
    import numpy as np

    width = 1
    while 2 * width <= size:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = size - width
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def runs(texts, window: int):
    """For chunks of texts: (indices of the texts, anchor hash, run hash,
    text in the chunk, start, windows of each run, hashes of all windows,
    first window of each run)."""
    import numpy as np

    k = min(ANCHOR, window)
    known = remembered("word hashes", WordHashes).__getitem__
    chunk, lengths, rows, total = [], [], [], 0

    def flush():
        flat, n = np.concatenate(chunk), np.array(lengths)
        off = np.concatenate(([0], np.cumsum(n)))
        kmer = rolling(flat, k, 0x9E3779B97F4A7C15)
        # the top bits decide, the place breaks ties: the same in any text
        marked = (kmer & np.uint64(~_POSITION & (2 ** 64 - 1))) | (np.arange(len(kmer), dtype=np.uint64) & np.uint64(_POSITION))
        low = (sliding_min(marked, window - k + 1) & np.uint64(_POSITION)).astype(np.int64)
        at = np.arange(len(low)) + ((low - np.arange(len(low))) & _POSITION)
        doc = np.repeat(np.arange(len(n)), np.maximum(n - window + 1, 0))
        place = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(n - window + 1, 0)) - np.maximum(n - window + 1, 0),
                                                np.maximum(n - window + 1, 0))
        flat_place = off[doc] + place
        at = at[flat_place]
        hashes = rolling(flat, window, 0xD6E8FEB86659FD93)[flat_place]
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        count = np.diff(np.concatenate((first, [len(at)])))
        whole = _mix(hashes[first] * np.uint64(0x9E3779B97F4A7C15) + hashes[first + count - 1] * np.uint64(0xC2B2AE3D27D4EB4F)
                     + count.astype(np.uint64))
        return np.array(rows), kmer[at[first]].view(np.int64), whole.view(np.int64), doc[first], place[first], count, hashes.view(np.int64), first

    for i, t in enumerate(texts):
        words = t.split() if t else ()
        if len(words) < window:
            continue
        chunk.append(np.fromiter(map(known, words), np.uint64, len(words)))
        lengths.append(len(words))
        rows.append(i)
        total += len(words)
        if total >= CHUNK_WORDS:
            yield flush()
            chunk, lengths, rows, total = [], [], [], 0
    if chunk:
        yield flush()


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumns({"_d": F.col(doc_id), "_t": F.xxhash64(text)})


def _same(a: DataFrame, b: DataFrame):
    return a["_d"].eqNullSafe(b["_ld"]) & (a["_t"] == b["_lt"])


def repeats(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeated stretches: (d, t, start, windows, source), where d and t are
    the document's id and text hash, ``windows`` windows from word ``start``
    on start earlier too, and source is the earliest place (d, t, start)."""
    docs, names = hidden(docs.select(doc_id, text))
    return _repeats(docs, window, names[doc_id], names[text])[0]


def _repeats(docs: DataFrame, window: int, doc_id: str, text: str) -> tuple[DataFrame, list[DataFrame]]:
    """The stretches, and the written tables that they are read from."""
    spark = docs.sparkSession
    importable(spark)
    # the anchors name their document by a hash: two documents that share it
    # only share their lists of anchors to look at
    keyed = _keyed(docs, doc_id, text).withColumn("_doc", F.xxhash64(F.col("_t"), F.col(doc_id)))
    d = T.StructField("d", docs.schema[doc_id].dataType)
    t = T.StructField("t", T.LongType())

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for rows, anchor, _, doc, _, _, _, _ in runs(texts_of(batch.column(1)), window):
                yield pa.RecordBatch.from_arrays([pa.array(anchor), batch.column(0).take(pa.array(rows[doc]))], names=["h", "doc"])

    found = cut(keyed.select("_doc", text).mapInArrow(scan, "h long, doc long"), "substring-anchors")
    again = cut(found.groupBy("h").count().where("count > 1").select("h"), "substring-repeated")
    release(spark)
    lists = cut(found.join(again, "h").groupBy("doc").agg(F.collect_set("h").alias("hs")), "substring-lists")
    discard(found, again)

    fields = [T.StructField(c, T.LongType()) for c in ("h", "run")] + [d, t, T.StructField("start", T.IntegerType()),
                                                                      T.StructField("w", T.ArrayType(T.LongType()))]

    def take_apart(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(3)
            for rows, anchor, whole, doc, place, count, hashes, first in runs(texts_of(batch.column(2)), window):
                keep = np.zeros(len(anchor), bool)
                edges = np.searchsorted(doc, np.arange(len(rows) + 1))
                for i, row in enumerate(rows.tolist()):
                    a, b = edges[i], edges[i + 1]
                    keep[a:b] = np.isin(anchor[a:b], lists[row].values.to_numpy())
                of = pa.array(rows[doc[keep]])
                sizes = count[keep]
                inner = np.repeat(first[keep] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                windows = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(hashes[inner]))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[keep]), pa.array(whole[keep]), batch.column(0).take(of), batch.column(1).take(of),
                                                  pa.array(place[keep].astype(np.int32)), windows], names=[f.name for f in fields])

    met = keyed.select("_d", "_t", "_doc", F.col(text).alias("_text")).join(lists, F.col("_doc") == F.col("doc")).select("_d", "_t", "_text", "hs")
    paths = cut(met.mapInArrow(take_apart, T.StructType(fields)), "substring-paths")
    discard(lists)

    here = F.struct("d", "t", "start")
    firsts = cut(paths.groupBy("h", "run").agg(F.min(here).alias("source"), F.min_by("w", here).alias("w"), F.count(F.lit(1)).alias("n")), "substring-firsts")
    release(spark)
    known = firsts.where("n > 1").select(F.col("h").alias("_h"), F.col("run").alias("_run"), "source")
    later = paths.select("h", "run", "d", "t", "start", F.size("w").alias("windows")).join(
        known, (F.col("h") == F.col("_h")) & (F.col("run") == F.col("_run")))
    later = cut(later.where(~here.eqNullSafe(F.col("source"))).select("d", "t", "start", "windows", "source"), "substring-later")
    discard(paths)  # the largest table goes before the windows move

    edges = firsts.select("h", "source", F.posexplode("w").alias("i", "w")).select(
        "h", "w", F.col("source.d").alias("d"), F.col("source.t").alias("t"), (F.col("source.start") + F.col("i")).alias("start"))
    shared = cut(edges.groupBy("h", "w").agg(F.min(here).alias("source"), F.count(F.lit(1)).alias("n")).where("n > 1")
                 .select(F.col("h").alias("_h"), F.col("w").alias("_w"), "source"), "substring-edges")
    release(spark)
    single = edges.join(shared, (F.col("h") == F.col("_h")) & (F.col("w") == F.col("_w")))
    single = single.where(~here.eqNullSafe(F.col("source"))).select("d", "t", "start", F.lit(1).alias("windows"), "source")
    return later.unionByName(single), [later, firsts, shared]


def _merged(found: DataFrame, window: int) -> DataFrame:
    """Stretches at one distance from a source as maximal spans: (d, t, start,
    stop, source_d, source_t, source_start) in words, stop exclusive."""
    from pyspark.sql import Window

    r = found.select(
        "d", "t", "start", (F.col("start") + F.col("windows")).alias("_end"), F.col("source.d").alias("source_d"),
        F.col("source.t").alias("source_t"), (F.col("source.start") - F.col("start")).alias("_shift"))
    keys = ["d", "t", "source_d", "source_t", "_shift"]
    # sets combine before the shuffle, however often rows repeat a text, and
    # hold one document's stretches; the window then needs no further shuffle
    r = r.groupBy(*keys).agg(F.collect_set(F.struct("start", "_end")).alias("_all")).select(*keys, F.explode("_all").alias("_one"))
    r = r.select(*keys, "_one.start", "_one._end")
    w = Window.partitionBy(*keys).orderBy("start")
    r = r.withColumn("_new", (F.col("start") > F.coalesce(F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    r = r.withColumn("_run", F.sum("_new").over(w))
    return r.groupBy(*keys, "_run").agg(F.min("start").alias("start"), (F.max("_end") + window - 1).alias("stop")).select(
        "d", "t", "start", "stop", "source_d", "source_t", (F.col("start") + F.col("_shift")).alias("source_start"))


def _digests(docs: DataFrame, places: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(place, digest) of the words at each place (struct of d, t, start, stop)."""
    importable(docs.sparkSession)
    lists = places.select("place.*").groupBy("d", "t", F.expr(f"start div {LISTED}").alias("_part")).agg(
        F.collect_set(F.struct("start", "stop")).alias("_spans")).select(F.col("d").alias("_ld"), F.col("t").alias("_lt"), "_spans")
    keyed = _keyed(docs, doc_id, text).select("_d", "_t", F.col(text).alias("_text"))
    schema = T.StructType([T.StructField("d", docs.schema[doc_id].dataType), T.StructField("t", T.LongType()), T.StructField("start", T.IntegerType()),
                           T.StructField("stop", T.IntegerType()), T.StructField("digest", T.BinaryType())])

    def run(batches):
        from hashlib import blake2b

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            row, start, stop, digest = [], [], [], []
            spans = batch.column(3)
            for i, t in enumerate(texts_of(batch.column(2))):
                words, here = t.split(), spans[i].values
                for a, b in zip(here.field("start").to_pylist(), here.field("stop").to_pylist()):
                    row.append(i)
                    start.append(a)
                    stop.append(b)
                    digest.append(blake2b(b" ".join(words[a:b]), digest_size=16).digest())
            at = pa.array(np.array(row, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), pa.array(stop, pa.int32()),
                                              pa.array(digest, pa.binary())], names=[f.name for f in schema])

    found = keyed.join(lists, _same(keyed, lists)).select("_d", "_t", "_text", "_spans").mapInArrow(run, schema)
    # rows that repeat an id and a text digest alike
    return found.groupBy(F.struct("d", "t", "start", "stop").alias("place")).agg(F.min("digest").alias("digest"))


def _checked(docs: DataFrame, spans: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``spans`` with ``same``: whether the words at both places are the same.

    Pieces end at a grid of the source's words, so those of copies of one source
    are mostly the same pieces of the source; a source's digest goes to at most
    PARTS parts of the pieces that wait for it, however many they are."""
    columns = spans.columns
    length = F.col("stop") - F.col("start")
    grid = F.sequence(F.expr(f"source_start div {PIECE}"), ((F.col("source_start") + length - 1) / PIECE).cast("bigint"))
    p = spans.withColumn("_grid", F.explode(grid))
    p = p.withColumns({"_a": F.greatest(F.col("source_start"), F.col("_grid") * PIECE).cast("int"),
                       "_b": F.least(F.col("source_start") + length, (F.col("_grid") + 1) * PIECE).cast("int")})
    back = F.col("source_start") - F.col("start")
    p = cut(p.select(*columns,
                     F.struct("d", "t", (F.col("_a") - back).cast("int").alias("start"), (F.col("_b") - back).cast("int").alias("stop")).alias("later"),
                     F.struct(F.col("source_d").alias("d"), F.col("source_t").alias("t"), F.col("_a").alias("start"), F.col("_b").alias("stop")).alias("source"),
                     bucket_of("d", "t", n=PARTS).alias("_part")), "substring-pieces")
    asked = p.select("source", "_part").distinct()
    places = p.select(F.col("later").alias("place")).unionByName(asked.select(F.col("source").alias("place"))).distinct()
    digests = cut(_digests(docs, places, doc_id, text), "substring-digests")
    sources = asked.join(digests, asked["source"] == digests["place"]).select(
        F.col("source").alias("_source"), F.col("_part").alias("_of"), F.col("digest").alias("_wanted"))
    met = p.join(digests, p["later"] == digests["place"]).join(sources, (F.col("source") == F.col("_source")) & (F.col("_part") == F.col("_of")))
    out = cut(met.groupBy(*columns).agg(F.bool_and(F.col("digest") == F.col("_wanted")).alias("same")), "substring-checked")
    discard(p, digests)
    return out


def verified(docs: DataFrame, spans: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans (columns of :func:`spans` and source_t) whose words are the
    same at both places; of any other span, its windows of which that holds."""
    checked = _checked(docs, spans, doc_id, text)
    good, bad = checked.where("same").drop("same"), checked.where("not same").drop("same")
    if bad.isEmpty():
        return good
    step = F.explode(F.sequence(F.lit(0), F.col("stop") - F.col("start") - window))
    single = bad.withColumn("_i", step).select(
        "d", "t", (F.col("start") + F.col("_i")).alias("start"), (F.col("start") + F.col("_i") + window).alias("stop"),
        "source_d", "source_t", (F.col("source_start") + F.col("_i")).alias("source_start"))
    return good.unionByName(_checked(docs, single, doc_id, text).where("same").drop("same"))


def _spans(docs: DataFrame, window: int, doc_id: str, text: str) -> DataFrame:
    found, tables = _repeats(docs, window, doc_id, text)
    merged = cut(_merged(found, window), "substring-spans")
    discard(*tables)
    out = verified(docs, merged, window, doc_id, text)
    discard(merged)
    return out


def spans(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal repeated spans, verified: (d, t, start, stop, source_d,
    source_start) in words, stop exclusive."""
    docs, names = hidden(docs.select(doc_id, text))
    return _spans(docs, window, names[doc_id], names[text]).drop("source_t")


def remove(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed and kept, the words that stay joined
    by one space. Every row and column stays."""
    docs, names = hidden(docs)
    doc_id, text = names[doc_id], names[text]
    lists = cut(_spans(docs, window, doc_id, text).groupBy("d", "t").agg(F.collect_set(F.struct("start", "stop")).alias("_covered"))
                .withColumnsRenamed({"d": "_ld", "t": "_lt"}), "substring-covered")
    columns = docs.columns
    keyed = _keyed(docs, doc_id, text)
    met = keyed.join(lists, _same(keyed, lists), "left").select(*columns, "_covered")
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                                                               T.StructField("kept", T.StringType())])
    at = columns.index(text)

    def apply(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n_words, n_removed, kept = [], [], []
            covered = batch.column(len(columns))
            for i, t in enumerate(texts_of(batch.column(at))):
                words = t.split() if t else []
                n_words.append(len(words))
                c = covered[i].values
                if c is not None and len(c):
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, c.field("start").to_numpy(), 1)
                    np.add.at(change, c.field("stop").to_numpy(), -1)
                    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                    words = [words[j] for j in stay]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(batch.columns[:len(columns)] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                             pa.array(kept, pa.binary()).cast(pa.string())], names=[f.name for f in schema])

    return shown(met.mapInArrow(apply, schema), names, "n_words", "n_removed", "kept")


def deduplicate(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated words: a text that loses words becomes
    its other words joined by one space, any other text stays as it is."""
    docs, names = hidden(docs)
    out = remove(docs, window, names[doc_id], names[text])
    return shown(out.withColumn(names[text], F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(names[text]))), names)
