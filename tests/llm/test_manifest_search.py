"""Exact dedup, Merkle manifest and lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framelex.llm import ball_tree, exact_dedup, merkle, registry


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# exact dedup

def texts_with_copies():
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(5000))
    out = [None, "", "", "A", "a", "Ä", "ä", long, long.upper(), long + "x", long[:-1], "x" + long, long[:1024], long[:1024] * 3,
           long[:2048], long[:2049]]
    out += ["hot copy " * 30] * 60 + ["".join(r.choice("ab") for _ in range(r.randrange(12))) for _ in range(80)]
    return out


def exact_expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            stays = i == keep and left == 1
            left -= stays
            out.append((i, keep, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,limits", [(1024, {}), (4, {"frequent": 8, "least": 2, "bucket_rows": 16}), (7, {"frequent": 4096, "least": 1})])
def test_exact_groups_against_brute_force(spark, block, limits):
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts_with_copies())]
    rows += [(3, "A"), (3, "A"), (None, "A"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.groups(docs, block=block, **limits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == exact_expected(rows)


def test_exact_keeps_rows_with_clashing_columns(spark):
    names = ["row", "pos", "n", "block", "id", "sha", "kept", "name", "level", "size", "best", "_h", "carried", "a", "b"]
    docs = spark.createDataFrame([(1, "Same", *names), (2, "same", *names), (3, "other", *names)],
                                 ", ".join(["doc_id int", "text string", *[f"`{c}` string" for c in names]]))
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(2, "same", *names), (3, "other", *names)]


def test_exact_empty_table(spark, tmp_path):
    write(spark, tmp_path, "documents", [], "doc_id long, text string")
    assert registry.op11_exact_dedup(spark, str(tmp_path)).collect() == []


def test_exact_query(spark, tmp_path):
    rows = list(enumerate(texts_with_copies()))
    write(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = sorted(map(tuple, registry.op11_exact_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == exact_expected(rows)


# Merkle manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle_expected(rows):
    def leaf(*fields):
        return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def way(levels, i):
        out = []
        for lv in levels[:-1]:
            a = i - i % 16
            out.append(("".join(lv[a:i]), "".join(lv[i + 1:a + 16])))
            i //= 16
        return out

    first = {}
    for d in rows:
        first.setdefault(d[1], []).append((d[0] is not None, d[0] or 0, leaf(*d), d))
    sources = sorted(first, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(first[s], key=lambda x: x[:3]) for s in sources}
    levels = {s: tree([x[2] for x in trees[s]]) for s in sources}
    top = tree([levels[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, mine, d) in enumerate(trees[s]):
            path = way(levels[s], i) + way(top, k)
            changed = mine
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0:
                changed = leaf(*d[:4], None if d[4] is None else lower(d[4]))
            for left, right in path:
                changed = h(left, changed, right)
            root = top[-1][0]
            out.append((d[0], mine, levels[s][-1][0], root, h(*[a + b for a, b in path]), changed, changed == root))
    return sorted(out, key=str)


MERKLE = "doc_id long, source string, lang string, n_chars long, text string"


def merkle_rows(n, sources):
    r = random.Random(n)
    out = []
    for i in range(n):
        t = r.choice([None, "", f"Text {i}", f"lower {i}", "Same Text", "ÄÖ é"])
        out.append((None if r.random() < 0.03 else i, r.choice(sources), r.choice(["en", None]), None if t is None else len(t), t))
    return out + out[:3]


@pytest.mark.parametrize("n,sources,part", [(1, ["a"], 4096), (16, ["a"], 4096), (17, ["a"], 10), (700, ["hot"] * 8 + ["b", None, ""], 50),
                                            (400, [f"s{i}" for i in range(290)], 64), (600, ["one"], 100)])
def test_merkle_query_against_brute_force(spark, tmp_path, monkeypatch, n, sources, part):
    monkeypatch.setattr(merkle, "PART", part)
    rows = merkle_rows(n, sources)[:n] if n < 20 else merkle_rows(n, sources)
    write(spark, tmp_path, "documents", rows, MERKLE)
    out = registry.op12_merkle(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.collect()), key=str) == merkle_expected(rows)


def test_merkle_empty_table(spark, tmp_path):
    write(spark, tmp_path, "documents", [], MERKLE)
    assert registry.op12_merkle(spark, str(tmp_path)).collect() == []


def test_merkle_shuffled_nodes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "UPPER", 0)  # no level is broadcast
    monkeypatch.setattr(merkle, "PART", 40)
    rows = merkle_rows(300, ["hot"] * 3 + ["b", None])
    write(spark, tmp_path, "documents", rows, MERKLE)
    assert sorted(map(tuple, registry.op12_merkle(spark, str(tmp_path)).collect()), key=str) == merkle_expected(rows)


def test_missing_is_the_minimal_union():
    import numpy as np

    need = merkle.missing(np.arange(20, 300), 1000)
    # runs of 16 that are cut at both ends, then the other runs of each level
    assert need[0].tolist() == [16, 17, 18, 19, 300, 301, 302, 303]
    assert need[1].tolist() == [0, *range(19, 32)]
    assert need[2].tolist() == [2, 3]


# lexical search

def lexical_expected(docs, items, k=20):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))

    vecs = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(1 for _, v in vecs if v), sum(sum(v.values()) for _, v in vecs)
    df = Counter(t for _, v in vecs for t in v)
    out = []
    for item, text in items:
        q = Counter(terms(text))
        scored = []
        for i, v in vecs:
            m = 75 + 25 * sum(v.values()) * n_docs // max(length, 1)
            s = sum(c * math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1))) * (10**9 * v[t] // (1000 * v[t] + 12 * m))
                    for t, c in q.items() if t in v)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def lexical_tables(seed=5, n=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["the", "Über", "naïve", "日本", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(k):
        return "".join(r.choice([w, w.upper(), w]) + r.choice([" ", ", ", "\n", "_", "-"]) for w in r.choices(words, weights, k=k))

    docs = [(i, text(r.randrange(1, 60))) for i in range(n)]
    copy = text(30)
    docs += [(n + i, copy) for i in range(150)] + [(-1, copy), (None, copy), (7, docs[7][1]), (None, None), (n + 500, ""), (n + 501, "?! \x7f")]
    items = [(i, text(r.randrange(1, 25))) for i in range(20)] + [(100, copy), (100, copy + " the"), (None, "w3 w3 w100"), (101, ""), (102, None),
                                                                  (103, "absent words only")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_lexical_query_against_brute_force(spark, tmp_path, monkeypatch, small):
    if small:  # many groups of queries, a bitmap that is full
        for name, value in [("QUERY_ROWS", 7), ("QUERY_TERMS", 40), ("BITMAP", 64)]:
            monkeypatch.setattr(ball_tree, name, value)
    docs, items = lexical_tables()
    write(spark, tmp_path, "documents", docs, "doc_id long, text string")
    write(spark, tmp_path, "benchmark", items, "item_id long, text string")
    got = registry.op13_lexical_search(spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == lexical_expected(docs, items)


def test_lexical_search_in_many_blocks(spark):
    docs, items = lexical_tables(6)
    d = spark.createDataFrame([(i, t, i, "x") for i, t in docs], "doc_id long, text string, id long, terms string")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, row string")
    shape = ball_tree.Shape(docs=37, terms=300, leaf=4, fan=2, bands=3)
    assert sorted(map(tuple, ball_tree.search(d, q, shape=shape).collect()), key=str) == lexical_expected(docs, items)


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a b")], []), ([(1, None)], [(1, "a")])])
def test_lexical_empty_tables(spark, tmp_path, docs, items):
    write(spark, tmp_path, "documents", docs, "doc_id long, text string")
    write(spark, tmp_path, "benchmark", items, "item_id long, text string")
    assert registry.op13_lexical_search(spark, str(tmp_path)).collect() == []


def test_ball_bounds_hold_and_prune():
    import numpy as np

    r = np.random.default_rng(1)
    w = np.sort(r.integers(1, 12_000, 400))[::-1]
    n = 512
    rows = [np.unique(np.concatenate([r.integers(0, 20, 8), 20 + (i // 64) * 40 + r.integers(0, 40, 12)])) for i in range(n)]
    doc, tid = np.repeat(np.arange(n), [len(x) for x in rows]), np.concatenate(rows)
    s = r.integers(1, 900_000, len(tid))
    block = ball_tree.Block(np.arange(n), doc, tid, s, lambda t: w[t])
    visited = 0
    for i in range(40):
        mine = np.unique(r.choice(rows[i * 12], 6))
        weight = w[mine] * r.integers(1, 4, len(mine))
        at = np.searchsorted(block.tids, mine)
        scores = np.zeros(n, np.int64)
        for t, c in zip(mine, weight):
            scores[doc[tid == t]] += s[tid == t] * c
        bound, offset = block.bounds(at, weight), 0
        for size in block.sizes:
            for node in range(-(-n // size)):
                assert scores[node * size:(node + 1) * size].max() <= bound[offset]
                offset += 1
        best = ball_tree.Best(5)
        visited += block.search(at, weight, best)
        order = np.lexsort((np.arange(n), -scores))[:5]
        assert best.ids.tolist() == order[scores[order] > 0].tolist()
    assert visited < 0.8 * 40 * (n // block.shape.leaf)
