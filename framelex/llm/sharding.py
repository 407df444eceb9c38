"""Sharding by jump consistent hashing (DataFrame functions only).

Jump hashing maps a key and a shard count to a shard without a ring table:
starting at shard 0 it jumps ahead pseudo-randomly until the next jump would
leave the range. Going from n to n + 1 shards a row either stays or moves to
shard n, so only about 1/(n + 1) of the rows move.

Defined cases: a null key has its own fixed hash; rows with equal keys share a
shard; a null text counts as empty; an empty table gives an empty result.
Extra columns stay, whatever their names; those named as a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import bucket_of, hidden, prefix_sums, shown

#: Multiplier of the generator of the published algorithm (a fixed value).
_MULTIPLIER = 2862933555777941757
_M32 = (1 << 32) - 1
#: Steps taken in the first pass; a row that is not through by then (less
#: than one in a million for 1,000 shards) goes on in a second pass.
_STEPS = 24
#: Sub-ranges of a shard for the slot numbers, so that no shard is one task.
_SLOT_BUCKETS = 512


def _next_state(key: Column) -> Column:
    """``key * _MULTIPLIER + 1`` modulo 2**64, without overflow: the product is
    summed from limb products below 2**63, in 32-bit halves."""
    limbs = [key.bitwiseAND(F.lit((1 << 22) - 1)),
             F.shiftrightunsigned(key, 22).bitwiseAND(F.lit((1 << 22) - 1)),
             F.shiftrightunsigned(key, 44)]
    factors = [(_MULTIPLIER & ((1 << 40) - 1), 0), (_MULTIPLIER >> 40, 40)]
    low, high = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    for i, limb in enumerate(limbs):
        for factor, shift in factors:
            if 22 * i + shift < 64:
                term = F.shiftleft(limb * F.lit(factor), 22 * i + shift)
                low = low + term.bitwiseAND(F.lit(_M32))
                high = high + F.shiftrightunsigned(term, 32)
    high = high + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_M32)))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a 64-bit key (a Column expression)."""
    if shards < 1:
        raise ValueError("shards must be positive")

    def step(s, _):
        k = _next_state(s["k"])
        # j = floor((b + 1) * 2**31 / ((k >> 33) + 1)), all below 2**53
        j = F.floor((s["j"] + 1) * F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + 1)).cast("bigint")
        done = s["j"] >= F.lit(shards)
        return F.when(done, s).otherwise(F.struct(k.alias("k"), s["j"].alias("b"), j.alias("j")))

    start = F.struct(key.cast("bigint").alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def run(state, steps):
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)

    first = run(start, min(_STEPS, shards + 1))
    if shards < _STEPS:
        return first["b"].cast("int")  # each step moves on by one at least
    return F.when(first["j"] >= F.lit(shards), first["b"]).otherwise(run(start, shards + 1)["b"]).cast("int")


def key_hash(*cols: Column | str) -> Column:
    """Stable 64-bit hash of the sharding key; a null key hashes like 42."""
    return F.xxhash64(*cols)


def shard(docs: DataFrame, key: str = "doc_id", shards: int = 16, grown: int | None = None) -> DataFrame:
    """Adds ``shard`` and, with ``grown``, ``grown_shard``: the shard for that
    many shards. No shuffle; the rows keep their columns."""
    h = key_hash(F.col(key))
    out = docs.withColumn("shard", jump_hash(h, shards))
    return out.withColumn("grown_shard", jump_hash(h, grown)) if grown else out


def slots(rows: DataFrame, order: list[str], shard_col: str = "shard") -> DataFrame:
    """Adds ``slot``: the place in the shard, gapless from 0, in the order of a
    hash of ``order`` and then ``order`` itself (equal rows in any order)."""
    t, names = hidden(rows)
    order = [names[c] for c in order]
    t = t.withColumn("_bucket", bucket_of(*order, n=_SLOT_BUCKETS))
    return shown(prefix_sums(t, [names[shard_col]], "_bucket", [F.col(c) for c in order], F.lit(1), "slot"), names, "slot")
