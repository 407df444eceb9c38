"""Heads are followed inside a sentence's array: nothing of the pairs is
shuffled or written, and odd heads give what a walk over the rows gives."""

import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from framelex.operators import lexicon, match

SCHEMA = "sent_id STRING, pass INT, tok_idx INT, head_idx INT, lemma STRING, start INT, end INT"


def brute(rows, pats):
    out = set()
    heads, toks = {}, {}
    for s, p, i, h, w, a, b in rows:
        if None in (s, p, i):
            continue
        toks.setdefault((s, p, i), []).append((w, a, b))
        if h is not None and h != i:
            heads.setdefault((s, p, i), set()).add(h)
    for (s, p, i), firsts in toks.items():
        near, todo = set(), list(heads.get((s, p, i), ()))
        while todo:
            j = todo.pop()
            if j not in near:
                near.add(j)
                todo += heads.get((s, p, j), ())
        near |= {k for (x, y, k), hs in heads.items() if (x, y) == (s, p) and i in hs}
        for w, a, b in firsts:
            for k in near - {i}:
                for w2, a2, b2 in toks.get((s, p, k), ()):
                    if w is not None and w2 is not None and f"{w} {w2}" in pats and a != a2:
                        out.add((s, p, min(a, a2), b2 if a < a2 else b, f"{w} {w2}"))
    return out


def test_odd_and_deep_heads(spark):
    r = random.Random(11)
    rows = []
    # chains deeper than one stretch, up and down, and a long cycle
    for s, n, head in (("up", 150, lambda i: i - 1 if i else None), ("down", 131, lambda i: i + 1 if i < 130 else None), ("ring", 140, lambda i: (i + 1) % 140)):
        rows += [(s, 0, i, head(i), r.choice("abcdefgh"), 3 * i, 3 * i + 1) for i in range(n)]
    for s in range(15):
        n = r.randrange(1, 30)
        # gaps, repeats, absent and missing heads, indexes and lemmas
        rows += [(f"s{s}", s % 2, r.choice([None, *range(0, 60, 2)]), r.choice([None, 99, *range(0, 60, 2)]), r.choice(["a", "b", "c", None]), 5 * i, 5 * i + 2) for i in range(n)]
    rows += [(None, 0, 1, 0, "a", 0, 1), (None, 0, 0, None, "b", 2, 3), ("one", 0, 7, 7, "a", 0, 1)]
    pats = {"a b", "c a", "b c", "h a", "d e"}
    toks = spark.createDataFrame(rows, SCHEMA)
    lex = lexicon.compile_lexicon(spark.createDataFrame([(f"{p}.x", "F") for p in sorted(pats)], lexicon.LU_SCHEMA), with_extras=False)
    want, old = brute(rows, pats), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert len(want) > 300
    for threshold in (old, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = match.dependency_hits(toks, lex).select("sent_id", "pass", "start", "end", "lu").collect()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert set(map(tuple, got)) == want


def test_pairs_are_not_shuffled(spark):
    toks = spark.createDataFrame([("s", 0, i, i // 2 if i else None, "ab"[i % 2], i, i + 1) for i in range(9)], SCHEMA).repartition("sent_id")
    buf = io.StringIO()
    with redirect_stdout(buf):
        match.head_pairs(toks.withColumn("root", F.lit(True))).explain()
    # the tokens' own partitioning serves
    assert buf.getvalue().count("Exchange hashpartitioning") == 1 and "Join" not in buf.getvalue()
