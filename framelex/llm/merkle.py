"""Merkle manifest of a dataset, with proofs by octopus multiproof.

A document's leaf is the SHA-256 of its fields. The leaves of a source, in the
order of their ids, are hashed in runs of ``ARITY`` until one node is left, the
subroot; the subroots, in the order of the sources, are hashed likewise to the
root. Each level of all trees is one grouped aggregate of at most ``ARITY``
rows a group, so a hot source is never one task.

Proofs are made by leaf partition, ``PART`` consecutive leaves in the order of
(source, id), whatever the sources' sizes. A partition works out the minimal
union of the coordinates (tree, level, place) that its leaves need and that
cannot be derived from them, fetches these nodes once by a join, derives the
interior nodes that its leaves share, and expands each leaf's own proof from
them. Checking a changed leaf folds it up its path with the untouched siblings.

Defined cases: nulls hash as ``-``; a null source is a source of its own and
comes first; null ids come first in their source; repeated rows are leaves of
their own, and as equal rows have equal leaves their order does not matter
(rows that share an id go by their leaf); a single leaf is its subroot, a
single subroot the root; an empty table has no root and gives no rows. Only
the stated columns are read, so further columns and their names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.rownum import global_index
from .common import cut, importable, remembered

ARITY = 16
#: Leaves of a partition that proofs are made for.
PART = 4_096
#: Nodes of the trees' upper levels that every partition asks for: levels of at
#: most this many nodes in all are broadcast (fixed by count, about 130 bytes a row).
UPPER = 32_768
#: The tree over the subroots.
TOP = -1


def leaf(*fields: Column) -> Column:
    """SHA-256 over the fields: ``-`` for null, else byte count, ``:``, value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def ordered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves (id, source, leaf, ...) with their partition, tree and place, and
    the trees (tree, n). A source is a tree, numbered in the order of sources."""
    rows = global_index(leaves, [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), "leaf"], "_g")
    rows = rows.withColumn("part", F.expr(f"_g div {PART}"))
    # what a partition holds of each source; a hot source is a row a partition
    runs = rows.groupBy("part", "source").agg(F.min("_g").alias("_lo"), F.count(F.lit(1)).alias("_c"))
    sources = runs.groupBy("source").agg(F.min("_lo").alias("start"), F.sum("_c").alias("n"))
    trees = cut(global_index(sources, ["start"], "tree"), "merkle-trees")
    runs = (runs.join(trees.withColumnRenamed("source", "_s"), runs["source"].eqNullSafe(F.col("_s")))
            .select(F.col("part").alias("_p"), F.col("source").alias("_s"), "tree", "start", "n"))
    out = (rows.join(runs, (rows["part"] == runs["_p"]) & rows["source"].eqNullSafe(runs["_s"]))
           .withColumn("place", F.col("_g") - F.col("start")).drop("_p", "_s", "_g", "start"))
    return cut(out, "merkle-leaves"), trees


def grow(level0: DataFrame, most: int) -> list[DataFrame]:
    """All levels of the trees over ``level0`` (tree, place, n, hash), each a
    written table (tree, place, n, hash) where n is the level's node count;
    ``most`` is the largest n of all."""
    levels = [level0]
    while most > 1:
        run = F.sort_array(F.collect_list(F.struct("place", "hash")))
        up = (levels[-1].where("n > 1").groupBy("tree", F.expr(f"place div {ARITY}").alias("up"))
              .agg(F.max(F.expr(f"(n + {ARITY - 1}) div {ARITY}")).alias("n"), run.alias("run"))
              .select("tree", F.col("up").alias("place"), "n", F.sha2(F.concat_ws("", F.col("run")["hash"]), 256).alias("hash")))
        levels.append(cut(up, "merkle-level"))
        most = -(-most // ARITY)
    return levels


def shape(n: int) -> list[int]:
    """Node counts of the levels of a tree of n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def missing(places, n: int):
    """For each level of a tree of n leaves, the places that proofs of the
    leaves at ``places`` (sorted, distinct) need and cannot derive."""
    import numpy as np

    known, out = places, []
    for count in shape(n)[:-1]:
        parents = np.unique(known // ARITY)
        children = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        children = children[children < count]
        out.append(np.setdiff1d(children, known, assume_unique=True))
        known = parents
    return out


def requests(leaves: DataFrame, n_trees: int) -> DataFrame:
    """(part, tree, level, place) of every node that a partition must fetch;
    the roots of its trees and the root are asked for too, as what proofs are
    held against."""
    def run(pdf):
        import numpy as np
        import pandas as pd

        out = []

        def ask(tree, places, n):
            need = missing(places, n)
            need.append(np.zeros(1, np.int64))
            for level, at in enumerate(need):
                out.append(pd.DataFrame({"tree": tree, "level": level, "place": at}))

        for tree, g in pdf.groupby("tree"):
            ask(tree, np.unique(g["place"].to_numpy()), int(g["n"].iloc[0]))
        ask(TOP, np.unique(pdf["tree"].to_numpy()), n_trees)
        got = pd.concat(out, ignore_index=True).astype("int64").drop_duplicates()
        got.insert(0, "part", int(pdf["part"].iloc[0]))
        return got

    return leaves.select("part", "tree", "place", "n").groupBy("part").applyInPandas(run, "part long, tree long, level long, place long")


def fetch(asked: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """The requested nodes with their hash. Low levels meet their requests in a
    shuffle join, where a node is asked for by few partitions; every partition
    asks for the nodes near the roots, whose levels are small."""
    out = None
    for level, nodes in levels:
        n = nodes.select(F.col("tree").alias("_t"), F.col("place").alias("_p"), "hash")
        if nodes.count() <= UPPER:
            n = F.broadcast(n)
        a = asked.where(F.col("level") == level)
        got = a.join(n, (a["tree"] == n["_t"]) & (a["place"] == n["_p"])).select("part", "tree", "level", "place", "hash")
        out = got if out is None else out.unionByName(got)
    return out


def _expand(leaves, nodes, n_trees):
    """The proofs of one partition; see :func:`prove`."""
    from hashlib import sha256

    import numpy as np
    import pandas as pd

    def digest(text):
        return sha256(text.encode()).hexdigest()

    known = {(t, lv, p): h for t, lv, p, h in zip(nodes["tree"], nodes["level"], nodes["place"], nodes["hash"])}

    def derive(tree, own, n):
        """Interior nodes from the partition's own (place -> hash) upwards;
        per level the siblings left and right of each node on a path."""
        counts, steps, at = shape(n), [], own
        for level, count in enumerate(counts[:-1]):
            step, up = {}, {}
            for parent in sorted({p // ARITY for p in at}):
                places = range(parent * ARITY, min(parent * ARITY + ARITY, count))
                run = [at[p] if p in at else known[tree, level, p] for p in places]
                up[parent] = digest("".join(run))
                for i, p in enumerate(places):
                    if p in at:
                        step[p] = ("".join(run[:i]), "".join(run[i + 1:]))
            steps.append(step)
            at = up
        return steps, at[0]

    def path(steps, place):
        out = []
        for step in steps:
            out.append(step[place])
            place //= ARITY
        return out

    def fold(h, way):
        for left, right in way:
            h = digest(left + h + right)
        return h

    subroots, inside = {}, {}
    for tree, g in leaves.groupby("tree"):
        inside[tree], subroots[tree] = derive(tree, dict(zip(g["place"], g["leaf"])), int(g["n"].iloc[0]))
    top, derived = derive(TOP, subroots, n_trees)
    root = known[TOP, len(shape(n_trees)) - 1, 0]
    upper = {t: path(top, t) for t in subroots}
    above = {t: "".join(a + b for a, b in way) for t, way in upper.items()}
    shared: dict = {}  # siblings from a leaf's parent up to its subroot
    out = []
    for tree, place, n, own, changed in zip(leaves["tree"], leaves["place"], leaves["n"], leaves["leaf"], leaves["changed"]):
        steps = inside[tree]
        if steps:
            a, b = steps[0][place]
            k = (tree, place // ARITY)
            if k not in shared:
                shared[k] = "".join(x + y for x, y in path(steps[1:], k[1]))
            proof = a + b + shared[k] + above[tree]
        else:
            proof = above[tree]
        # the partition's own leaves were folded together while deriving
        folded = derived if not isinstance(changed, str) or changed == own else fold(changed, path(steps, place) + upper[tree])
        out.append((known[tree, len(shape(n)) - 1, 0], root, digest(proof), folded, folded == root))
    cols = ["subroot", "root", "proof_sha256", "folded_root", "verified"]
    res = pd.DataFrame(out, columns=cols)
    res.insert(0, "leaf", leaves["leaf"].to_numpy(object))
    res.insert(0, "id", leaves["id"].to_numpy())
    return res


def prove(leaves: DataFrame) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for
    leaves (id long, source string, leaf, changed): ``changed`` is the leaf to
    check with the proof, null where it is the leaf itself."""
    spark = leaves.sparkSession
    importable(spark)
    placed, trees = ordered(cut(leaves.select("id", "source", "leaf", "changed"), "merkle-input"))
    n_trees, most = trees.count(), trees.agg(F.max("n")).first()[0] or 0
    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not most:
        return spark.createDataFrame([], schema)
    lower = grow(placed.select("tree", "place", "n", F.col("leaf").alias("hash")), most)
    subroots = None
    for t in lower:
        last = t.where("n = 1").select("tree", "hash")
        subroots = last if subroots is None else subroots.unionByName(last)
    base = cut(subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("place"),
                               F.lit(n_trees).cast("bigint").alias("n"), "hash"), "merkle-subroots")
    upper = grow(base, n_trees)
    fetched = fetch(cut(requests(placed, n_trees), "merkle-requests"), [*enumerate(lower), *enumerate(upper)])
    ids = placed.withColumn("known", F.col("id").isNotNull()).withColumn("id", F.coalesce("id", F.lit(0)))

    def run(key, own, nodes):
        remembered("merkle", dict)  # drops what other operators keep
        out = _expand(own, nodes, n_trees)
        out.insert(0, "known", own["known"].to_numpy())
        return out

    out = ids.groupBy("part").cogroup(fetched.groupBy("part")).applyInPandas(run, f"known boolean, {schema}")
    return out.select(F.when(F.col("known"), F.col("id")).alias("id"), *[c for c in out.columns if c not in ("known", "id")])
