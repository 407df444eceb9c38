"""Greedy subsumption (L25) against a plain fold, and the pattern walk
against an independent plain-Python trie walker on real sentences."""

import re

from pyspark.sql import functions as F

from framelex.operators import corpus, lexicon, match
from framelex.plans.context import table

from conftest import SF_SMALL


def fold(spans):
    best, last_s, last_e = {}, -1, -1
    for s, e in sorted(spans):
        if s > last_e:
            last_s, last_e = s, e
            best[(s, e)] = 1
        if s == last_s and e > last_e:
            best.pop((last_s, last_e))
            best[(s, e)] = 1
            last_s, last_e = s, e
    return set(best)


def test_subsumed_matches_fold(spark):
    spans = [(0, 3), (0, 7), (2, 5), (8, 9), (8, 12), (10, 11), (13, 14)]
    df = spark.createDataFrame([("s", a, b, [f"f{b}"]) for a, b in spans], "sent_id STRING, start INT, end INT, frames ARRAY<STRING>")
    rows = match.subsumed(df).collect()
    got = {(r.start, r.end) for r in rows}
    assert all(r.frames == [f"f{r.end}"] for r in rows)
    assert got == fold(spans)


TOKEN = re.compile(r"\s*([\w]+|[^\s\w])")


def py_walk(sentence, patterns):
    """Surface-view walk over pass 0 only, from the span contract."""
    toks = []
    for m in re.finditer(r"[^\W_]+|[^\s\w]|_", sentence):
        toks.append((m.start(), m.end(), m.group()))
    nodes = {}
    for p in patterns:
        w = p.split(" ")
        for k in range(1, len(w) + 1):
            nodes.setdefault(" ".join(w[:k]), False)
        nodes[p] = True
    out = set()
    for i in range(len(toks)):
        key = toks[i][2]
        j = i
        while key in nodes:
            if nodes[key]:
                out.add((toks[i][0], toks[j][1], key))
            j += 1
            if j >= len(toks):
                break
            key = key + " " + toks[j][2]
    return out


def test_walk_matches_python_trie(spark):
    pats = ["of", "the", "of the", "the the the", "and", "is the", "to the", "That", "the and attion"]
    lus = spark.createDataFrame([(p + ".x", "F") for p in pats], lexicon.LU_SCHEMA)
    lex = lexicon.compile_lexicon(lus, with_extras=False)
    docs = table(spark, SF_SMALL, "documents").where("lang = 'en'").limit(30)
    sents = corpus.distinct_sentences(corpus.sentences(docs)).cache()
    toks = corpus.annotate(corpus.tokens(sents, passes=False))
    rows = match.walk(toks, lex).where("view = 'surface'").select("sent_id", "start", "end", "lu").distinct()
    got = {}
    for r in rows.collect():
        got.setdefault(r.sent_id, set()).add((r.start, r.end, r.lu))
    n = 0
    for r in sents.collect():
        want = py_walk(r.sentence, sorted(set(pats) | {p.lower() for p in pats}))  # L6 lower-cased copies
        assert got.get(r.sent_id, set()) == want, r.sentence[:80]
        n += 1
    assert n > 50
