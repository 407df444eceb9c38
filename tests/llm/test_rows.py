"""Per-row and per-key operators: URL rules, sharding, token counts."""

import random

import pytest
from pyspark.sql import functions as F

from framelex.llm import packing, sharding, token_counts, url_filter

DOCS = "doc_id long, text string, source string, n_chars long"


def rules(spark, rows):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def test_url_rules_longest_wins(spark):
    urls = [(1, "http://Example.ORG/en/12?x#y"), (2, "https://www.example.org/es/a"), (3, "http://example.org/de/1"), (4, "http://badexample.org"),
            (5, "http://shop.com/de/1"), (6, "http://com/fr/"), (7, "no scheme"), (8, None), (9, "http://a.com#/de/1"), (9, "http://a.com#/de/1"),
            (10, ""), (11, "http://" + "x." * 300 + "org/" + "p" * 5000), (12, "ftp://org/"), (13, "http:///org/"), (14, "http://example.org/en/2")]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit(1), "other": F.lit("kept")})
    r = rules(spark, [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
                      ("com", "/de/", "block"), ("com", "/de/", "block"), (None, "/", "block"), ("x", None, "block"), ("a.b", "/", None)])
    out = url_filter.judge(df, r)
    assert out.columns == ["page_id", "url", "other", "host", "path", "rule", "verdict"]
    got = {(x.page_id, x.rule, x.verdict) for x in out.collect()}
    assert out.count() == len(urls)
    assert got == {(1, "example.org/en/1", "block"), (2, "example.org/es/", "block"), (3, "org/", "allow"), (4, None, "allow"), (5, "com/de/", "block"),
                   (6, "com/fr/", "allow"), (7, None, "allow"), (8, None, "allow"), (9, None, "allow"), (10, None, "allow"), (11, "org/", "allow"),
                   (12, "org/", "allow"), (13, None, "allow"), (14, "org/", "allow")}


def test_url_ties_block_and_shuffle_join(spark):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    r = rules(spark, [("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("com", "/x/yz", "allow"), ("b.com", "/xx", "block"), ("com", "/xx", "allow")])
    df = spark.createDataFrame([(1, "http://a.com/x/yz"), (2, "http://a.com/x/"), (3, "http://b.com/xxx")], "page_id long, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in url_filter.judge(df, r).collect()}
    # equal length: the longer host decides; the same rule twice blocks
    assert got == {1: ("a.com/x" if len("a.com/x") > len("com/x/yz") else "com/x/yz", "allow"), 2: ("a.com/x", "block"), 3: ("b.com/xx", "block")}
    spark.conf.set(threshold, before)


def test_url_hosts_of_many_labels(spark):
    deep = "http://" + "a.b." * 8_000
    urls = [(1, deep + "example.org/en/1"), (2, deep + "com./fr/"), (3, "http://./x"), (4, "http://x..com/fr/"), (5, "http://com./x"), (6, "http:///x")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    r = rules(spark, [("example.org", "/en/1", "block"), ("com", "/fr/", "block"), ("", "/x", "block"), ("b.com", "/", "block")])
    assert {x.page_id: x.rule for x in url_filter.judge(df, r).collect()} == {1: "example.org/en/1", 2: None, 3: "/x", 4: "com/fr/", 5: "/x", 6: None}


def test_url_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [x.verdict for x in url_filter.judge(df, rules(spark, [])).collect()] == ["allow"]
    assert url_filter.judge(df.where("false"), rules(spark, [("com", "/", "block")])).count() == 0


def jump(key, n):
    """The published algorithm."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 1000])
def test_jump_hash_is_the_published_one(spark, shards):
    rng = random.Random(shards)
    keys = [0, 1, -1, 2 ** 63 - 1, -2 ** 63] + [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {x.k: x.s for x in df.select("k", sharding.jump_hash(F.col("k"), shards).alias("s")).collect()}
    assert all(got[k] == jump(k, shards) for k in keys)


def test_shards_move_only_to_the_new_one_and_slots_are_gapless(spark):
    rows = [(i if i % 50 else None, "t" * (i % 7), "s", 0) for i in range(2000)] + [(7, "same", "s", 0)] * 3
    df = spark.createDataFrame(rows, DOCS).withColumns({"shard": F.lit(-5), "slot": F.lit("old")})
    out = sharding.slots(sharding.shard(df, "doc_id", 16, grown=17).drop("slot"), ["doc_id", "text"])
    got = out.collect()
    assert len(got) == len(rows)
    assert all(x.grown_shard in (x.shard, 16) for x in got)
    for s in {x.shard for x in got}:
        slots = sorted(x.slot for x in got if x.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.slots(sharding.shard(df.drop("slot").where("false"), "doc_id", 4), ["doc_id"]).count() == 0


def test_token_counts_against_viterbi(spark):
    import public_tokenizers

    scores = token_counts.zipf_scores(token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    least, longest = min(scores.values()) - 10, max(map(len, scores))

    def viterbi(word):
        t, best = token_counts.MARK + word, [(0.0, 0)]
        for i in range(1, len(t) + 1):
            n = len(t[i - 1].encode())
            c = [(best[i - 1][0] + n * least, -(best[i - 1][1] + n))]
            c += [(scores[t[j:i]] + best[j][0], -(best[j][1] + 1)) for j in range(max(0, i - longest), i) if t[j:i] in scores]
            m = max(c)
            best.append((m[0], -m[1]))
        return best[-1][1]

    texts = ["the cat then thesaurus", "", None, " \t\n", "漢字 😀x ▁▁ a\x00b", "unbelievable " * 400, "x" * 3000, "the cat then thesaurus", "É é É"]
    df = spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(texts)], DOCS).withColumn("n_tokens", F.lit("clash"))
    got = {x.doc_id: (x.n_words, x.n_tokens) for x in token_counts.count_tokens(df).collect()}
    for i, t in enumerate(texts):
        words = [w.decode() for w in (t or "").encode().split()]
        assert got[i] == (len(words), sum(map(viterbi, words)))
    assert token_counts.count_tokens(df.where("false")).count() == 0


def test_trie_forgets_and_recounts(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 3)
    trie = token_counts.TrieCounter(token_counts.zipf_scores(["a", "b", "ab", "▁", "▁a"]))
    for words in ([b"a", b"ab", b"abab"], [b"ab", b"b", b"ba"]):
        trie.insert(words)
        assert {w: trie[w] for w in words} == {w: {b"a": 1, b"ab": 2, b"abab": 3, b"b": 2, b"ba": 3}[w] for w in words}


def test_pieces_match_the_tokenizer(spark):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    alphabet = "abAB'`~<|>12 .,-éÉßÀſ́ \n\tİΣσ漢😀×²"
    texts = [None, "", "  ", "Hello <|endoftext|> it's 'RE", "long " * 9000, "long " * 9000] + ["".join(rng.choices(alphabet, k=60)) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts)], DOCS)
    got = packing.pieces(df, "word_bpe_49k.json", capacity=4096, ids=True).collect()
    for i, t in enumerate(texts):
        ids = np.array((tok.encode(t, add_special_tokens=False).ids if t else []) + [1], "<u4")
        mine = sorted((x for x in got if x.doc_id == i), key=lambda x: x.piece)
        assert [x.start for x in mine] == list(range(0, len(ids), 4096))
        assert b"".join(x.ids for x in mine) == ids.tobytes()
        assert all(zlib.crc32(x.ids) == x.ids_crc32 and len(x.ids) == 4 * x.length for x in mine)


@pytest.mark.parametrize("leaf,carry", [(10_000, 2048), (40, 2048), (40, 3)])
def test_packing_fills_sequences(spark, leaf, carry):
    rng = random.Random(leaf)
    lengths = [rng.choice([1, 5, 30, 60, 64, 100, rng.randint(0, 100)]) for _ in range(700)] + [33] * 300
    df = spark.createDataFrame([(i // 2 if i % 9 else None, n) for i, n in enumerate(lengths)], "doc_id long, length long").withColumn("offset", F.lit("clash"))
    got = packing.pack(df, capacity=100, slack=2, leaf_items=leaf, fan_in=3, carry=carry).collect()
    assert sorted(x.length for x in got) == sorted(lengths)
    bins = {}
    for x in got:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 100
    assert len(bins) <= (1.04 if carry > 3 else 1.1) * sum(lengths) / 100 + 2
    assert packing.pack(df.where("false"), capacity=100).count() == 0




def test_packing_keeps_columns_of_any_name(spark):
    names = ["_row", "_length", "_group", "_fill", "_up", "_bin", "_parent", "parent", "shift", "bin", "fill", "node", "s"]
    df = spark.createDataFrame([(i, 7, *[f"{c}{i}" for c in names]) for i in range(90)], ", ".join(["doc_id long", "length long", *[f"{c} string" for c in names]]))
    got = packing.pack(df, capacity=20, leaf_items=10, fan_in=2).collect()
    assert sorted(tuple(x[c] for c in df.columns) for x in got) == sorted(map(tuple, df.collect()))
    assert len({x.sequence_id for x in got}) == 45
