"""Document fingerprints: SimHash over weighted terms (DataFrame functions only).

Terms are the pairs of neighbouring words (the last word alone), weighted by
how often they occur. Every occurrence votes on 128 signed bits by the bits of
two 64-bit hashes; a bit is set if more than half of the votes are for it.
Votes are counted four bits to a long: ``(hash >> k) & 0x0001000100010001``
summed over at most 32,767 terms cannot carry from one 16-bit lane to the
next, so 32 sums count 128 bits, and the segments of longer texts are added
up afterwards. Equal texts have equal fingerprints.

``find_near`` finds all fingerprints within a Hamming radius by block tables:
the bits are split into blocks, each table permutes another choice of blocks
to the front as its key, and by the pigeonhole principle every pair within the
radius agrees on the key of one table; the distance is then verified.

Defined cases: a null text is empty; a text of no words has fingerprint 0;
null ids come before all others in the order of the documents, rows that
repeat an id are ordered by text, each row that repeats id and text counts,
and the only document follows itself; an empty table gives an empty result.
Extra columns stay, whatever their names; results replace columns of theirs.
"""

from __future__ import annotations

import json
import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import hidden, shown

BITS = 128
_LANES = 0x0001000100010001
#: Terms of a segment: the highest lane of a sum stays below 2**63.
SEGMENT = (1 << 15) - 1
#: Rows of a bucket of ``with_next``, sampled rows that set each of its bounds,
#: and the characters of a text in a bound.
BUCKET_ROWS, BOUND_SAMPLE, BOUND_CHARS = 2_048, 16, 64


def terms(text: Column) -> Column:
    """Array of the text's terms, repeats included."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))


def _hashes(term: Column) -> list[Column]:
    return [F.xxhash64(term), F.xxhash64(term, F.lit(1))]


def fingerprints(rows: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """One row per row of ``rows`` (told apart by ``keys``): the keys and for
    each entry (name: text column) the fingerprint as longs name_0, name_1."""
    kinds = list(texts)
    shown_keys, keys = keys, [f"__in{i}" for i in range(len(keys))]
    listed = F.array(*[F.struct(F.lit(i).alias("kind"), terms(F.col(texts[k])).alias("terms")) for i, k in enumerate(kinds)])
    t = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(shown_keys, keys)], F.explode(listed).alias("_k")).select(*keys, F.col("_k.kind").alias("_kind"), F.posexplode_outer("_k.terms").alias("_pos", "_term"))
    t = t.withColumn("_segment", F.expr(f"_pos div {SEGMENT}"))
    for i, h in enumerate(_hashes(F.col("_term"))):
        t = t.withColumn(f"_h{i}", F.when(F.col("_term").isNotNull(), h).otherwise(F.lit(0)))
    sums = [F.sum(F.shiftrightunsigned(f"_h{i}", k).bitwiseAND(F.lit(_LANES))).alias(f"_s{i}_{k}") for i in range(2) for k in range(16)]
    t = t.groupBy(*keys, "_kind", "_segment").agg(F.count("_term").alias("_n"), *sums)
    counts = [F.sum(F.shiftrightunsigned(f"_s{i}_{k}", 16 * lane).bitwiseAND(F.lit(0xFFFF))).alias(f"_c{i}_{16 * lane + k}")
              for i in range(2) for k in range(16) for lane in range(4)]
    t = t.groupBy(*keys, "_kind").agg(F.sum("_n").alias("_n"), *counts)
    halves = []
    for i in range(2):
        bits = F.lit(0).cast("bigint")
        for b in range(64):
            set_bit = F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("bigint")
            bits = bits.bitwiseOR(F.when(2 * F.col(f"_c{i}_{b}") > F.col("_n"), set_bit).otherwise(F.lit(0)))
        halves.append(bits.alias(f"_f{i}"))
    t = t.select(*keys, "_kind", *halves)
    out = t.groupBy(*keys).agg(*[F.max(F.when(F.col("_kind") == j, F.col(f"_f{i}"))).alias(f"{k}_{i}") for j, k in enumerate(kinds) for i in range(2)])
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, shown_keys)], *[f"{k}_{i}" for k in kinds for i in range(2)])


def as_string(name: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(f"{name}_{i}"), 16, "0") for i in range(2)]))


def distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}_{i}").bitwiseXOR(F.col(f"{b}_{i}"))) for i in range(2)), F.lit(0))


def likeness(a: str, b: str) -> Column:
    """Share of the bits that agree."""
    return (F.lit(1.0) - distance(a, b) / F.lit(float(BITS))).cast("double")


def buckets_for(rows: int) -> int:
    """Buckets of ``with_next``: about BUCKET_ROWS rows each while the table is
    small; beyond, both the buckets and the rows of each grow with the root of
    the rows, so neither the list of bounds nor a task grows in proportion to the table."""
    return max(1, rows // max(BUCKET_ROWS, 2 * math.isqrt(rows)))


def _bounds(t: DataFrame, order: list[str], n: int, total: int) -> list:
    """Up to n - 1 rows' places in ``order`` that cut the table into about
    equal parts, from a sample of about BOUND_SAMPLE rows a part. Texts are cut
    to BOUND_CHARS: any value is a valid bound."""
    cols = [F.substring(c, 1, BOUND_CHARS).alias(f"o{i}") if t.schema[c].dataType == T.StringType() else F.col(c).alias(f"o{i}")
            for i, c in enumerate(order)]
    rows = t.select(*cols).sample(min(1.0, BOUND_SAMPLE * n / max(1, total)), 0).collect()
    rank = lambda r: [(v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0) for v in r]
    rows = sorted(map(tuple, rows), key=rank)
    return sorted({rows[len(rows) * i // n] for i in range(1, n)}, key=rank) if rows else []


def with_next(rows: DataFrame, order: list[str], columns: list[str], buckets: int | None = None, place: str | None = None) -> DataFrame:
    """Adds next_<column>: the value in the row that follows in ``order``
    (nulls first); the first row follows the last. ``place`` names a column of
    whole numbers that are unique and ascend in ``order``; they are the same in
    every run of the plan if rows that are equal in ``order`` are equal in all
    columns. ``rows`` is read several times.

    Bounds in the whole ``order`` deal the rows to buckets, each sorted by
    itself, so rows of one id spread by what follows the id; only rows that are
    equal in all of ``order`` (texts: in their first BOUND_CHARS characters)
    share a bucket at any number. The first row of each bucket also goes to the
    end of the bucket before it, so the rows move once and no window spans the
    table."""
    t, names = hidden(rows)
    order = [names[c] for c in order]
    total = t.count() if buckets is None else 0
    n = buckets or buckets_for(total)
    bounds = _bounds(t, order, n, total or t.count()) if n > 1 else []
    bucket = F.lit(0)
    if bounds:
        kind = T.StructType([T.StructField(f"o{i}", t.schema[c].dataType) for i, c in enumerate(order)])
        known = F.from_json(F.lit(json.dumps([{f"o{i}": v for i, v in enumerate(b)} for b in bounds])), T.ArrayType(kind))
        here = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
        # binary search: the number of bounds up to the row
        steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
        bucket = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda p, s: F.when(F.get(known, p + s - 1) <= here, p + s).otherwise(p))
    t = t.withColumns({"_bucket": bucket, "_guest": F.lit(0)})
    own = list(names.values())
    firsts = t.groupBy("_bucket").agg(F.min_by(F.struct(*own), F.struct(*order)).alias("_row"))
    # one row per bucket: these windows span as many rows as there are buckets
    every = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.lag("_bucket").over(every.orderBy("_bucket")), F.max("_bucket").over(every))
    guests = firsts.withColumn("_to", before).select(*[F.col("_row")[c].alias(c) for c in own], F.col("_to").alias("_bucket"), F.lit(1).alias("_guest"))
    w = Window.partitionBy("_bucket").orderBy("_guest", *[F.col(c).asc_nulls_first() for c in order])
    added = [F.lead(names[c]).over(w).alias(f"_next{i}") for i, c in enumerate(columns)]
    added += [(F.shiftleft(F.col("_bucket").cast("bigint"), 32) + F.row_number().over(w)).alias("_place")] if place else []
    t = t.unionByName(guests)
    # a task holds a few buckets, however low the session's number of partitions
    if n > 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        t = t.repartition(-(-n // 4), "_bucket")
    out = t.select("*", *added).where("_guest = 0")
    return shown(out, names, *[F.col(f"_next{i}").alias(f"next_{c}") for i, c in enumerate(columns)], *[F.col("_place").alias(c) for c in filter(None, [place])])


def find_near(index: DataFrame, queries: DataFrame, radius: int = 6, blocks: int = 10, name: str = "fp") -> DataFrame:
    """All pairs (query, found) of distinct fingerprints (columns name_0,
    name_1) within the radius: q_0, q_1, name_0, name_1, distance. An indexed
    fingerprint may equal the query. One row per pair: a pair is verified only
    in the first table whose key it shares."""
    if not 0 <= radius < blocks:
        raise ValueError("the radius must be below the number of blocks")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]

    def signed(v):
        v &= (1 << 64) - 1
        return F.lit(v - (1 << 64) if v >> 63 else v).cast("bigint")

    def keys(a, b):
        return F.posexplode(F.array(*[F.xxhash64(F.col(a).bitwiseAND(signed(m)), F.col(b).bitwiseAND(signed(m >> 64))) for m in masks])).alias("_table", "_key")

    i = index.select(F.col(f"{name}_0").alias("i_0"), F.col(f"{name}_1").alias("i_1")).distinct().select("*", keys("i_0", "i_1"))
    q = queries.select(F.col(f"{name}_0").alias("q_0"), F.col(f"{name}_1").alias("q_1")).distinct().select("*", keys("q_0", "q_1"))
    # the blocks that differ; the first table is the first choice of blocks without any of them
    low, high = (F.col(f"q_{h}").bitwiseXOR(F.col(f"i_{h}")) for h in range(2))
    first = F.coalesce(*[F.when((low.bitwiseAND(signed(m)) == 0) & (high.bitwiseAND(signed(m >> 64)) == 0), F.lit(j)) for j, m in enumerate(masks)])
    met = i.withColumnRenamed("_table", "_in").join(q, (F.col("_in") == F.col("_table")) & i["_key"].eqNullSafe(q["_key"]) & (distance("q", "i") <= radius) & (first == F.col("_table")))
    return met.select("q_0", "q_1", F.col("i_0").alias(f"{name}_0"), F.col("i_1").alias(f"{name}_1"), distance("q", "i").alias("distance"))


def near_counts(prints: DataFrame, is_query: Column, radius: int, blocks: int, name: str = "fp") -> DataFrame:
    """(q_0, q_1, near): for each fingerprint of the rows that ``is_query``
    picks, the number of rows of ``prints`` within the radius, itself included.
    Rows of one fingerprint are counted before any pair is made."""
    rows = prints.groupBy(F.col(f"{name}_0").alias("_w0"), F.col(f"{name}_1").alias("_w1")).count()
    pairs = find_near(prints, prints.where(is_query), radius, blocks, name)
    met = pairs.join(rows, (F.col(f"{name}_0") == F.col("_w0")) & (F.col(f"{name}_1") == F.col("_w1")))
    return met.groupBy("q_0", "q_1").agg(F.sum("count").alias("near"))
