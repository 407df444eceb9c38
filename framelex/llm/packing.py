"""Best-fit packing of tokenised documents by hierarchical residual packing.

Items are dealt to groups of bounded size; each group packs its items best-fit
decreasing. Bins that are nearly full are final. The others go up a tree as
items themselves (a bin's fill is its length): all underfull bins are dealt to
the nodes of the next level, a ``FAN_IN``-th as many but enough of them that a
node holds about ``FAN_IN * CARRY`` bins at most, and are packed best-fit
again. So every underfull bin takes part in every round, and every task holds
a bounded number of items at any input size. The rounds end at the root, or,
where the bins are too many for one node, when a round merges fewer than a
tenth of them: what is left then are bins too full for each other. The moves of all rounds are composed before the
items move once.

Defined cases: a null text is empty and gives the end id alone; lengths of 0
are placed too; items longer than the capacity are an error (``pieces`` cuts
them); repeated rows are separate items; an empty table gives an empty result.
Items travel in one struct, so their columns' names cannot clash with the
operator's; columns named as its results are replaced.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut, importable, remembered, texts_of

#: Items of a leaf group, and groups that meet in a node of the tree.
LEAF_ITEMS = 16_384
FAN_IN = 16
#: Underfull bins of a node for each of the FAN_IN below it.
CARRY = 2_048
#: Words and pre-tokens whose ids a Python worker remembers.
CACHE_WORDS = 200_000


class WordEncoder(dict):
    """Token ids (little-endian unsigned 32 bits) of a word without blanks.

    The tokenizer normalises and splits at blanks, so the ids of a text are
    those of its blank-separated words in turn. Words of plain Latin letters
    and ASCII go pre-token by pre-token to the model; any other word goes
    through the tokenizer as a whole. What was encoded is remembered."""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # letters without case or composition rules of their own; "<|" may
        # open a special token
        self.plain = re.compile("(?!.*<\\|)[!-~À-ÖØ-öø-įı-ɏ]+").fullmatch
        self.parts = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ɏ]+|[0-9]|[^a-z0-9ß-öø-ɏ]+").findall
        # the byte alphabet of byte-level models: printable bytes stand for
        # themselves, the others follow from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.pretokens: dict = {}

    def _pretoken(self, part: str) -> bytes:
        got = self.pretokens.get(part)
        if got is None:
            text = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
            got = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(text))
            if len(self.pretokens) >= CACHE_WORDS:
                self.pretokens.clear()
            self.pretokens[part] = got
        return got

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain(text):
            got = b"".join(map(self._pretoken, self.parts(text.lower())))
        else:
            got = b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = got
        return got

    def text(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker process; its memory lasts over tasks."""
    return remembered(("encoder", path), lambda: WordEncoder(path))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1,
           doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """A row per piece of a document: doc_id, piece (from 0), start, length,
    ids_crc32 and, with ``ids``, the ids themselves (binary, little-endian
    unsigned 32 bits). ``tokenizer`` names a file of the tokenizers library
    that every executor can open, or a public_tokenizers file name."""
    importable(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType
    fields = [T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * ids)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = word_encoder(_tokenizer_file(tokenizer))
        end, size = end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            row, number, start, length, crc, blobs = [], [], [], [], [], []
            for i, t in enumerate(texts_of(batch.column(1))):
                blob = encoder.text(t) + end if t else end
                for k, at in enumerate(range(0, len(blob), size)):
                    part = blob[at:at + size] if len(blob) > size else blob
                    row.append(i)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if ids:
                        blobs.append(part)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(np.array(number, np.int32)),
                       pa.array(np.array(start, np.int64)), pa.array(np.array(length, np.int64)), pa.array(np.array(crc, np.int64))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(blobs, pa.binary())] * ids, names=[f.name for f in schema])

    return docs.select(doc_id, text).mapInArrow(run, schema)


def _tokenizer_file(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def best_fit(lengths, capacity: int):
    """Best-fit decreasing: (bin of each item, offset in it, fills of the bins).

    Open bins are stacked by room left; a bit mask of the rooms that occur
    gives the tightest one that is large enough."""
    import numpy as np

    n = len(lengths)
    bins, offsets, fills = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        if size > capacity:
            raise ValueError(f"an item of {size} does not fit {capacity}")
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        room -= size
        stacks[room].append(b)
        mask |= 1 << room
    return bins, offsets, np.array(fills, np.int64)


def pack(items: DataFrame, capacity: int = 4096, length: str = "length", slack: int | None = None,
         leaf_items: int = LEAF_ITEMS, fan_in: int = FAN_IN, carry: int = CARRY) -> DataFrame:
    """``items`` with sequence_id (unique numbers) and offset (the item's
    place in its sequence, gapless from 0). ``slack``: a bin with at most so
    much room left is final (default: 1/64 of the capacity)."""
    importable(items.sparkSession)
    slack = capacity // 64 if slack is None else slack
    keep = [c for c in items.columns if c not in ("sequence_id", "offset")]
    # written once: the dealing below then goes by row position, so equal
    # rows spread over all groups and a repeated task deals alike
    items = cut(items.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(length).cast("bigint").alias("_length")), "pack-items")
    groups = max(1, -(-items.count() // leaf_items))
    dealt = items.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = T.StructType(items.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
                                                 T.StructField("_fill", T.LongType()), T.StructField("_group", T.LongType())])

    def leaf(table):
        import numpy as np
        import pyarrow as pa

        group = table.column("_group")[0].as_py()
        bins, offsets, fills = best_fit(table.column("_length").to_numpy(), capacity)
        # the first item of a bin carries its fill
        fill = np.where(offsets == 0, fills[bins], 0)
        first = np.zeros(len(bins), bool)
        first[np.unique(np.where(offsets == 0, bins, -1), return_index=True)[1]] = True
        out = table.drop_columns("_group")
        for name, v in (("sequence_id", (group << 32) + bins), ("offset", offsets), ("_fill", np.where(first & (offsets == 0), fill, -1)),
                        ("_group", np.full(len(bins), group))):
            out = out.append_column(name, pa.array(v.astype(np.int64)))
        return out

    packed = cut(dealt.groupBy("_group").applyInArrow(leaf, schema), "pack-leaves")
    bins = packed.where("_fill >= 0").select(F.col("sequence_id").alias("bin"), F.col("_fill").alias("fill"))

    def merge(table):
        import numpy as np
        import pyarrow as pa

        bin_id, fill = table.column("bin").to_numpy(), table.column("fill").to_numpy()
        order = np.lexsort((bin_id, fill))
        bin_id, fill = bin_id[order], fill[order]
        to, shift, fills = best_fit(fill, capacity)
        parent = np.zeros(len(fills), np.int64)
        parent[to[shift == 0]] = bin_id[shift == 0]
        return pa.table({"bin": bin_id, "parent": parent[to], "shift": shift, "fill": np.where(shift == 0, fills[to], -1)})

    moved = bins.select("bin", F.col("bin").alias("parent"), F.lit(0).cast("bigint").alias("shift"))
    nodes, level = groups, 0
    while nodes > 1:
        under = cut(bins.where(F.col("fill") < capacity - slack).select("bin", "fill"), "pack-underfull")
        n = under.count()
        before, level = nodes, level + 1
        nodes = max(-(-nodes // fan_in), -(-n // (carry * fan_in)))
        dealt = under.withColumn("_up", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(nodes)))
        up = cut(dealt.groupBy("_up").applyInArrow(merge, "bin long, parent long, shift long, fill long"), f"pack-level{level}")
        step = up.where("parent != bin or shift != 0").select(F.col("bin").alias("_bin"), F.col("parent").alias("_parent"), F.col("shift").alias("_shift"))
        moved = (moved.join(step, moved["parent"] == step["_bin"], "left")
                 .select("bin", F.coalesce("_parent", "parent").alias("parent"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift")))
        bins = up.where("fill >= 0").select(F.col("parent").alias("bin"), "fill")
        if nodes >= before and step.count() * 10 < n:
            break
    moves = moved.where("parent != bin or shift != 0").select(F.col("bin").alias("_bin"), "parent", "shift")
    placed = packed.select("_row", "sequence_id", "offset")
    return (placed.join(moves, placed["sequence_id"] == moves["_bin"], "left")
            .select("_row.*", F.coalesce("parent", "sequence_id").alias("sequence_id"),
                    (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")))
