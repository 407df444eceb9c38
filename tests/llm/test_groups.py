"""Operators on groups of rows, each against a brute-force version."""

import hashlib
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framelex.llm import ann, components, fingerprint, mixing, registry, simhash_dedup, substring_dedup, toxicity

DOCS = "doc_id long, text string, source string, n_chars long"


def make(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "s", 0) for i, t in zip(ids, texts)], DOCS)


# --- SimHash near duplicates -------------------------------------------------

def brute_fp(text, k=4):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return {x: least[find(i)] for i, x in enumerate(ids)}


def near_copies(rng, n):
    words = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("radius,bucket", [(4, 8192), (4, 5), (3, 5)])
def test_simhash_components(spark, radius, bucket):
    rng = random.Random(5)
    texts = near_copies(rng, 40) + near_copies(rng, 10) + [None, "", " \t", "One", "one", "a b c", "A b C", "long " * 20000] + ["dup text here now again"] * 5
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    df = make(spark, texts, ids).withColumns({"fp": F.lit("clash"), "component_id": F.lit(0)})
    got = {x.doc_id: (x.fp, x.component_id) for x in simhash_dedup.cluster(df, 4, radius, bucket=bucket).collect()}
    fps = [brute_fp(t) for t in texts]
    want = brute_components(ids, fps, radius)
    assert len(got) == len(texts)
    for i, f in zip(ids, fps):
        assert got[i] == (f - (1 << 64) if f >> 63 else f, want[i])


def test_simhash_dedup_keeps_one_of_each_group_and_all_columns(spark):
    df = make(spark, ["a b c d e f"] * 3 + [None, ""] + ["quite another text with more words"]).withColumn("component_id", F.lit("x"))
    out = simhash_dedup.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(x.doc_id for x in out.collect()) == [0, 3, 5]
    assert simhash_dedup.deduplicate(df.where("false")).count() == 0
    assert simhash_dedup.cluster(df.where("false")).count() == 0


def test_simhash_dedup_judges_rows_not_ids(spark):
    a, b, c = "a b c d e f g h", "quite another text with more words in it", "third text that nobody else has here at all"
    dup = lambda rows: sorted((-1 if x.doc_id is None else x.doc_id, x.text) for x in simhash_dedup.deduplicate(make(spark, [t for _, t in rows], [i for i, _ in rows])).collect())
    # an id that loses through one text keeps its other text, and names it for both groups
    assert dup([(3, a), (5, a), (5, b), (8, b), (9, c)]) == [(3, a), (5, b), (9, c)]
    assert dup([(5, a), (5, b), (8, a), (8, b)]) == [(5, a), (5, b)]
    # null ids come last, and one of them stays; of equal rows and of texts of one fingerprint one stays
    assert dup([(None, a)] * 50 + [(None, b), (7, b), (None, c)]) == [(-1, a), (-1, c), (7, b)]
    assert dup([(2, a)] * 4 + [(2, a.upper())] * 2 + [(4, a), (None, b), (None, b.upper())]) == [(-1, b.upper()), (2, a.upper())]


def test_components_of_long_paths(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500 + i, 500) for i in range(50)] + [(7, 7), (3, 2), (2, 3)]
    rng.shuffle(edges)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 500 for i in range(500, 550)}}


def test_component_state_of_many_edges(spark):
    edges = spark.range(30_000_000).select(F.col("id").alias("a"), (F.col("id") * 7919).alias("b"))
    assert components._state(edges) == components._state(edges.repartition(5))
    assert components._state(edges) != components._state(edges.withColumn("a", F.when(F.col("a") == 5, -5).otherwise(F.col("a"))))


# --- Substring dedup ---------------------------------------------------------

def brute_kept(rows, window):
    """Kept words by (id, text), for rows in the order of ids, None first."""
    seen, out = set(), {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            if k in seen:
                gone[s:s + window] = [True] * window
            seen.add(k)
        out[i, t] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("window", [5, 20])
def test_substrings_against_brute_force(spark, window):
    rng = random.Random(window)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 2)
    shared = [[word() for _ in range(rng.randint(window, 3 * window))] for _ in range(6)]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [word() for _ in range(rng.randint(0, 2 * window))]
            w += rng.choice(shared)[rng.randint(0, 3):]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    texts += [None, "", "Ha " * 500, "ha " * 30, texts[0], texts[0], "nb sp " * 40]
    df = make(spark, texts).withColumns({"kept": F.lit(1), "d": F.lit("x"), "h": F.lit("y")})
    out = substring_dedup.remove(df, window)
    got = {(x.doc_id, x.text): (x.n_words, x.n_removed, x.kept) for x in out.collect()}
    assert got == brute_kept(list(enumerate(texts)), window)
    # spans: maximal, verified word by word against their source
    for s in substring_dedup.spans(df, window).collect():
        here, there = texts[s.d].encode().split(), texts[s.source_d].encode().split()
        n = s.stop - s.start
        assert n >= window and here[s.start:s.stop] == there[s.source_start:s.source_start + n]


def test_substring_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = make(spark, [a, a, b, b, b, a + " " + b], [5, None, 7, 7, None, 9])
    got = sorted((x.doc_id or -1, x.text == a, x.n_removed) for x in substring_dedup.remove(df, 20).collect())
    # the null id is first, so its texts stay; equal rows get the same result
    assert got == [(-1, False, 0), (-1, True, 0), (5, True, 30), (7, False, 30), (7, False, 30), (9, False, 60)]
    assert substring_dedup.remove(df.where("false"), 20).count() == 0
    same = substring_dedup.deduplicate(df.where("doc_id = 7 or doc_id is null and text like 'a%'"), 20)
    assert sorted(x.text for x in same.collect()) == [a, b, b]  # a row and its repetition are one document


def test_spans_are_verified_by_their_sources(spark, monkeypatch):
    w = [f"w{i}" for i in range(700)]
    other = w[:300] + ["x"] + w[301:]
    df = make(spark, [" ".join(w), " ".join(["a", "b"] + w), "\t".join(other), " ".join(w[:25])], [None, 4, 5, 5])
    ids = {(r.doc_id, len(r.text.split())): r.t for r in df.withColumn("t", F.xxhash64("text")).collect()}
    first, second, third, short = ids[None, 700], ids[4, 702], ids[5, 700], ids[5, 25]
    claims = [(4, second, 2, 702, None, first, 0), (4, second, 2, 40, None, first, 1), (5, third, 0, 700, None, first, 0), (5, third, 300, 321, None, first, 300),
              (5, short, 0, 25, 4, second, 2), (5, short, 0, 20, 4, second, 3)]
    spans = spark.createDataFrame(claims, "d long, t long, start int, stop int, source_d long, source_t long, source_start int")
    for piece in (256, 7):
        monkeypatch.setattr(substring_dedup, "PIECE", piece)
        got = {(x.d, x.t, x.start, x.stop, x.source_start) for x in substring_dedup.verified(df, spans, 20).collect()}
        whole = {(4, second, 2, 702, 0), (5, short, 0, 25, 2)}
        # of a span that differs in one word, the windows without that word; no window of the shifted ones
        windows = {(5, third, i, i + 20, i) for i in range(681) if not i <= 300 < i + 20}
        assert got == whole | windows


# --- Mixing ------------------------------------------------------------------

def brute_targets(sizes, weights, share, cap):
    """Round after round of filling by weight and sharing what is above."""
    target = {s: 0.0 for s in sizes}
    left, free = share * sum(sizes.values()), set(sizes)
    while left > 1e-9 and free:
        w = sum(weights[s] for s in free)
        over = 0.0
        for s in list(free):
            target[s] += left * weights[s] / w
            if target[s] >= cap * sizes[s]:
                over += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
        left = over
    return target


def test_mixing_targets_and_takes(spark):
    rng = random.Random(2)
    rows = [(i if i % 40 else None, rng.choice(["b", "é", "z", None, "a", "tiny"]) if i % 3 else "hot", rng.randint(0, 60)) for i in range(1500)]
    rows = [(i, s, n if s != "tiny" else 1) for i, s, n in rows] + [(9999, "nothing", 0), (77, "a", 5), (77, "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumns({"target": F.lit("x"), "shard": F.lit(3)})
    out = mixing.plan(df, shards=7).withColumn("taken", mixing.taken())
    got = out.collect()
    assert len(got) == len(rows)
    sizes = {s: sum(n for _, x, n in rows if x == s) for s in {r[1] for r in rows}}
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    for s in sizes:
        mine = [x for x in got if x.source == s]
        assert all(abs(x.target - want[s]) < 1e-6 and x.source_size == sizes[s] for x in mine)
        assert sum(x.taken for x in mine) == round(want[s] + 1e-9) or abs(sum(x.taken for x in mine) - want[s]) <= 0.5
        assert all(0 <= x.taken <= 2 * x.size for x in mine)
    # shards hold equal numbers of blocks, so nearly equal words
    words = {}
    for x in got:
        for c in x.copies:
            words[c.shard] = words.get(c.shard, 0) + c.words
    assert len(words) == 7 and max(words.values()) - min(words.values()) < 0.25 * max(words.values())
    again = mixing.plan(df.repartition(5), shards=7).withColumn("taken", mixing.taken())
    assert sorted((x.doc_id or -1, x.size, x.taken) for x in again.collect()) == sorted((x.doc_id or -1, x.size, x.taken) for x in got)


def test_shard_tree_is_exact(spark):
    blocks = spark.createDataFrame([(0, 1000), (1, 10), (2, 333), (3, 1)], "s int, blocks long")
    for shards in (1, 2, 13, 200):
        got = mixing.shard_counts(blocks, shards, seed=4).collect()
        by_source, by_shard = {}, {}
        for x in got:
            by_source[x.s] = by_source.get(x.s, 0) + x.n
            by_shard[x.shard] = by_shard.get(x.shard, 0) + x.n
        assert by_source == {0: 1000, 1: 10, 2: 333, 3: 1}
        assert set(by_shard) <= set(range(shards)) and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_mix_makes_more_shards_of_more_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    df = spark.createDataFrame([(i, "w " * (10 * (i % 9 + 1)), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert max(x.shard for x in got) == -(-sum(len(x[1].split()) for x in df.collect()) * 15 // 5000) - 1
    per = [sum(len(x.text.split()) for x in got if x.shard == k) for k in range(60)]
    assert min(per) > 0


def test_mix_rows_and_empty_tables(spark):
    df = make(spark, ["a b c", None, "", "d e", "f"], [1, 2, 3, 4, 4]).withColumn("copy", F.lit("clash"))
    out = mixing.mix(df, weights=(1,), share=2.0, shards=3)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "copy", "shard"]
    assert sorted(x.text for x in out.where("length(text) > 0").collect()) == ["a b c", "a b c", "d e", "d e", "f", "f"]
    assert mixing.mix(df.where("false")).count() == 0
    assert mixing.mix(df.where("doc_id = 2")).count() == 0
    assert [r.taken for r in mixing.plan(df.where("doc_id = 2").withColumn("size", F.lit(0))).select(mixing.taken().alias("taken")).collect()] == [0]


# --- Toxicity ----------------------------------------------------------------

def test_toxicity_learns_sentences_from_document_labels(spark):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(300)]
    bad = ["vilest", "vilex", "rotten"]
    rows, labels = [], []
    for i in range(600):
        sents = [[rng.choice(vocabulary) for _ in range(8)] for _ in range(rng.randint(1, 12))]
        toxic = i % 3 == 0
        if toxic:
            sents[rng.randrange(len(sents))].insert(3, rng.choice(bad))
        rows.append((i, ". ".join(" ".join(s) for s in sents) + "!"))
        labels.append((i, int(toxic) if i % 7 else None))
    docs = spark.createDataFrame(rows + [(9000, None), (9001, ""), (9002, "... !"), (9003, "Rotten")], "doc_id long, text string").withColumn("score", F.lit("x"))
    known = spark.createDataFrame(labels + [(None, 1), (5, 0)], "doc_id long, toxic int")
    pairs, counts = toxicity.sample(docs, known, rows=150, learn=~toxicity.held_out(F.col("doc_id")))
    assert len(pairs) <= 300 and set(counts) == {0, 1}
    model = toxicity.fit(pairs, counts)
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    wrong = sum((got[i] >= 0.5) != (i % 3 == 0) for i in range(600))
    assert wrong <= 6
    assert got[9000] == got[9001] == got[9002] == 0.0 and got[9003] > 0.5
    # the score is the noisy-or of the sentences, and the offending ones are the planted ones
    words = toxicity.WordWeights(model[1])
    for i, t in rows[:50]:
        none = 1.0
        for s in t.replace("!", ".").split("."):
            if s.split():
                z = model[0] + sum(model[1].get(f, 0.0) for w in set(s.lower().split()) for f in toxicity.features(w))
                none *= 1 - 1 / (1 + np.exp(-z))
        assert abs(got[i] - (1 - none)) < 1e-9
    found = toxicity.offending(docs, model).collect()
    hits = sum(any(b in x.sentence for b in bad + ["Rotten"]) for x in found)
    assert hits >= 0.97 * len(found) and hits >= 190
    texts = dict(rows)
    assert all(texts[x.doc_id][x.start:x.stop] == x.sentence for x in found if x.doc_id < 9000)
    assert words["nothing"] == 0.0


def test_toxicity_takes_one_text_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i:03d}") for i in range(300)] + [(2, "x"), (2, None)], "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.sample(docs, known)[0] == [("x", 0), ("text 000", 1)]


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [x.score for x in toxicity.score(docs, toxicity.fit(*toxicity.sample(docs, none))).orderBy("doc_id").collect()] == pytest.approx([0, 0], abs=1e-9)
    assert [x.score for x in toxicity.score(docs, toxicity.fit(*toxicity.sample(docs, one))).orderBy("doc_id").collect()] == pytest.approx([1, 0], abs=1e-9)
    assert toxicity.score(docs.where("false"), (0.0, {"=a": 1.0})).count() == 0


# --- Fingerprints ------------------------------------------------------------

def brute_128(text):
    w = (text or "").encode().split()
    terms = [b" ".join(w[i:i + 2]) for i in range(len(w))]
    votes = [0] * 128
    for t in terms:
        a = xxhash.xxh64_intdigest(t, 42)
        b = xxhash.xxh64_intdigest(struct.pack("<i", 1), a)
        for k in range(64):
            votes[k] += a >> k & 1
            votes[64 + k] += b >> k & 1
    return "".join(f"{sum(1 << k for k in range(64) if 2 * votes[64 * i + k] > len(terms)):016x}" for i in range(2))


def test_fingerprints_against_brute_force(spark):
    texts = ["a b c", "a  b\tc", "one", None, "", "x y " * 40_000, "é 漢 😀", "a b c"]
    df = make(spark, texts).withColumn("fp_0", F.lit("clash"))
    out = fingerprint.fingerprints(df, ["doc_id"], {"fp": "text"}).select("doc_id", fingerprint.as_string("fp").alias("s"))
    got = {x.doc_id: x.s for x in out.collect()}
    assert got == {i: brute_128(t) for i, t in enumerate(texts)}
    assert fingerprint.fingerprints(df.where("false"), ["doc_id"], {"fp": "text"}).count() == 0


def test_with_next_wraps_around(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 200) + [5] * 3
    df = make(spark, [f"t{k:04}" for k in range(len(ids))], ids)
    for rows, buckets in ((df, 7), (df, 90), (df.limit(1), 7), (df.where("doc_id = 5"), 7)):
        want = sorted((x.doc_id, x.text) for x in rows.collect())
        got = sorted((x.doc_id, x.text, x.next_text) for x in fingerprint.with_next(rows, ["doc_id", "text"], ["text"], buckets=buckets).collect())
        assert got == [(i, t, want[(k + 1) % len(want)][1]) for k, (i, t) in enumerate(want)]
    assert fingerprint.with_next(df.where("false"), ["doc_id"], ["text"], buckets=3).count() == 0
    nulls = make(spark, ["a", "b", "c"], [None, None, 4])
    assert sorted((x.text, x.next_text) for x in fingerprint.with_next(nulls, ["doc_id", "text"], ["text"], buckets=3).collect()) == [("a", "b"), ("b", "c"), ("c", "a")]


def test_op9_on_repeated_rows_and_null_ids(spark, tmp_path):
    long = "x y " * 20_000
    rows = [(i, f"text {i} of some words") for i in range(30)] + [(7, "b c d"), (7, "a"), (7, "a"), (7, "zz top")]
    rows += [(12, "same row here again")] * 5 + [(13, long)] * 4 + [(None, None)] * 6 + [(None, "x")] * 3 + [(None, ""), (None, "null id text"), (29, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(x) for x in registry.op9_fingerprint(spark, str(tmp_path)).selectExpr("coalesce(doc_id, -1)", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect())
    line = sorted((-1 if i is None else i, t or "") for i, t in rows)
    fp = {t: brute_128(t) for _, t in line}
    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    want = []
    for (i, t), (_, after) in zip(line, line[1:] + line[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        ed = brute_128(edited)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp[t], ed, like(fp[t], ed), like(fp[t], fp[after])))
    assert len(got) == len(rows) and got == sorted(want)


def test_op9_counts_near_documents(spark, tmp_path):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(400)) for _ in range(6)]
    texts = [rng.choice(base) + (f" tail{rng.randrange(3)}" if rng.random() < 0.5 else "") for _ in range(150)] + ["", None, "alone"] * 7
    make(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    fps = [int(brute_128(t), 16) for t in texts]
    got = {x.doc_id: x.near_count for x in registry.op9_fingerprint(spark, str(tmp_path)).collect()}
    assert got == {i: sum((f ^ g).bit_count() <= registry.NEAR_RADIUS for g in fps) - 1 if i % 20 == 0 else None for i, f in enumerate(fps)}
    assert max(v for v in got.values() if v is not None) > 10


def test_rows_of_one_id_spread_over_buckets(spark):
    rng = random.Random(5)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"t{rng.randrange(10 ** 6):06}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fingerprint.with_next(df, ["doc_id", "text"], ["text"], buckets=12, place="place").collect()
    line = sorted((-1 if i is None else i, t) for i, t in rows)
    assert [(-1 if x.doc_id is None else x.doc_id, x.text, x.next_text) for x in sorted(out, key=lambda x: x.place)] == [
        (i, t, line[(k + 1) % len(line)][1]) for k, (i, t) in enumerate(line)]
    sizes = {}
    for x in out:
        sizes[x.place >> 32] = sizes.get(x.place >> 32, 0) + 1
    assert len(sizes) == 12 and max(sizes.values()) < 2.5 * 900 / 12
    assert fingerprint.buckets_for(0) == 1 and fingerprint.buckets_for(10 ** 10) < 10 ** 5


@pytest.mark.parametrize("radius,blocks", [(0, 4), (3, 6), (6, 10)])
def test_find_near_finds_all(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(20)]
    fps = base + [b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(0, 8))) for b in base for _ in range(8)] + base[:3]
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    lo = lambda v: sign(v & (1 << 64) - 1)
    df = spark.createDataFrame([(lo(f), lo(f >> 64)) for f in fps], "fp_0 long, fp_1 long")
    got = sorted((x.q_0, x.q_1, x.fp_0, x.fp_1, x.distance) for x in fingerprint.find_near(df, df.limit(60), radius, blocks).collect())
    want = sorted({(lo(q), lo(q >> 64), lo(f), lo(f >> 64), (q ^ f).bit_count()) for q in fps[:60] for f in fps if (q ^ f).bit_count() <= radius})
    assert got == want


# --- Nearest neighbours ------------------------------------------------------

def exact(rows, k, is_query):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if is_query(i):
            s = ann.cosines(x, np.array(v, float))
            out[i] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


@pytest.mark.parametrize("dim,blocks", [(64, (8192, 16384)), (12, (70, 4)), (100, (150, 3))])
def test_neighbours_recall(spark, dim, blocks):
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((12, dim))
    rows = [(i, (centres[i % 12] + 0.7 * rng.standard_normal(dim)).astype(np.float32).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "rank": F.lit("y")})
    out = ann.search(df, F.col("vec_id") % 50 == 0, k=5, row_block=blocks[0], query_block=blocks[1]).collect()
    want = exact(rows, 5, lambda i: i % 50 == 0)
    hit = 0
    for q in want:
        mine = sorted((x for x in out if x.query_id == q), key=lambda x: x.rank)
        assert [x.rank for x in mine] == [1, 2, 3, 4, 5]
        assert [(-x.score, x.vec_id) for x in mine] == sorted((-x.score, x.vec_id) for x in mine)
        hit += len({x.vec_id for x in mine} & {v for v, _ in want[q]})
    assert hit >= 0.9 * 5 * len(want)


def test_neighbours_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (7, [0.0, 0.0]), (8, None), (9, [nan, 1.0]), (10, [inf, 1.0]),
            (11, [None, 1.0]), (100, [0.0, 0.0]), (12, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (13, [1e30, -1e30]), (14, [1e-300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.search(df, F.col("vec_id") % 50 == 0, k=5)
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in out.collect()}
    good = [(i, ann.scaled([v])[0].tolist()) for i, v in {r[0]: r[1] for r in rows}.items() if i in (0, 50, 3, 2, 13, 14)]
    want = exact(good, 5, lambda i: i in (0, 50))
    assert {k: v[0] for k, v in got.items()} == {(q, r + 1): v for q in want for r, (v, _) in enumerate(want[q])}
    assert all(got[q, r + 1][1] == pytest.approx(s, abs=1e-12) for q in want for r, (_, s) in enumerate(want[q]))
    assert ann.search(df.where("false"), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_tables_retrieve_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 63, 500, dtype=np.uint64) >> np.uint64(20)
    t = ann.Tables(codes)
    for q in codes[:20]:
        for r in (0, 3, 8, 17, 25, 64):
            assert t.within(q, r).tolist() == np.flatnonzero(np.bitwise_count(codes ^ q) <= r).tolist()
