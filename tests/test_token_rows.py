"""Tokens become rows in compiled code, matched once; alignment, head pairs
and choice features need no second run of their input; XML is packed."""

import io
import os
import random
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

import __spark_entry__ as E
from framelex.operators import choices, corpus, lexicon, match, spans
from framelex.sources import xml

PATTERN = re.compile(r"\s*(?:[^\W_]+|[^\s])")


def plan(df):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def sentences(spark):
    r = random.Random(5)
    texts = ["a", "-", "One-two  the\tzebra, \n of", " ".join(r.choice(["of", "The", "x-y", ",", "zebra\t", "Ä"]) for _ in range(150))]
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "sent_id STRING, sentence STRING")


def test_sentences_are_matched_once(spark):
    sents = sentences(spark)
    for df in (corpus.tokens(sents, passes=False), corpus.sequence_starts(sents, 3, ("of", "zeb")), corpus.walk_tokens(sents, 2, ("of", "zeb"))):
        text = plan(df)
        filters = "\n".join(x for x in text.splitlines() if "Filter" in x)
        assert "regexp_extract_all" in text and "regexp_extract_all" not in filters


def test_sequence_starts_carry_what_offsets_need(spark):
    for r in corpus.sequence_starts(sentences(spark), 2, None, block=4).collect():
        i = int(r.sent_id)
        text = sentences(spark).collect()[i].sentence if i < 3 else None
        if text is None:
            continue
        found = list(PATTERN.finditer(text))
        m = found[r.tok_idx]
        assert r.end == m.end() and r.s == [x.group() for x in found[r.tok_idx:r.tok_idx + 3]]
        assert r.words == [x.strip() for x in r.s] and r.before == (found[r.tok_idx - 1].group() if r.tok_idx else None)


def test_alignment_without_windows(spark):
    r = random.Random(3)
    toks, rows = [], []
    for s in range(6):
        at = 0
        for i in range(r.randrange(1, 40)):
            at += r.randrange(0, 3)
            toks.append((f"s{s}", i, at, at + r.randrange(1, 5), f"w{i}"))
            at = toks[-1][3]
        rows += [(f"s{s}", a, a + r.randrange(0, 9)) for a in [r.randrange(-2, at + 4) for _ in range(30)]]
    rows += [("none", 0, 3), (None, 0, 3), ("s1", None, 3), ("s1", 0, None)]

    def holds(s, p):
        met = [t for t in toks if t[0] == s and p is not None and t[2] <= p]
        t = max(met, key=lambda t: t[2]) if met else None
        return t[1] if t and p < t[3] else None

    want = set()
    for s, a, b in set(rows):
        first, last = holds(s, a), holds(s, None if b is None else b - 1)
        last = first if last is None else last
        name = lambda x: None if x is None else f"w{x}"
        want.add((s, a, b, first, last, name(first), name(last)))
    sp = spark.createDataFrame(rows, "sent_id STRING, start INT, end INT")
    tk = spark.createDataFrame(toks, "sent_id STRING, tok_idx INT, start INT, end INT, text STRING")
    arrays = tk.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias("toks"))
    for t in (tk, arrays):
        al = spans.align(sp, t, ["sent_id", "start", "end"], texts=True)
        got = al.collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
        assert "Window" not in plan(al)


def test_pairs_that_are_no_pattern_are_not_shuffled(spark):
    toks = spark.createDataFrame([("s", 0, i, i // 2 if i else None, "ab"[i % 2], i, i + 1) for i in range(9)],
                                 "sent_id STRING, pass INT, tok_idx INT, head_idx INT, lemma STRING, start INT, end INT")
    lex = lexicon.compile_lexicon(spark.createDataFrame([("a b.x", "F"), ("b a.x", "F")], lexicon.LU_SCHEMA), with_extras=False)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = set(map(tuple, match.dependency_hits(toks, lex).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(lex.sizes["two_ids"]))
    try:
        df = match.dependency_hits(toks, lex)
        assert "xxhash64(lu" in plan(df) and want and set(map(tuple, df.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # heads are climbed to by numbers, not gathered in sets first; what has the
    # sentence's arrays is compiled with what drops them, so no pair's row holds them
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(match.head_pairs(toks.withColumn("root", F.lit(True))))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert "getbit" in text and all("*(" in x.split("Generate")[0] for x in text.splitlines() if "Generate posexplode" in x)


def test_choice_features_are_made_once(spark):
    from conftest import SF_SMALL
    assert plan(E.queries()["choice_features"](spark, SF_SMALL)).count("l_linenumber:") == 1


def test_positions_ride_with_the_features(spark):
    rows = spark.createDataFrame([(1, 0, 5, False, 2, 3), (1, 1, 6, True, 0, 3), (2, 0, 7, False, 1, 1), (2, 0, 7, False, 1, 1)],
                                 "example_id INT, choice_idx INT, n_real INT, cropped BOOLEAN, choice_position INT, n_choice INT")
    got = choices.with_positions(rows, 2)
    want = rows.join(choices.example_positions(rows, 2).select("example_id", "position", "n_kept"), "example_id")
    assert sorted(map(tuple, got.select("example_id", "choice_idx", "position", "n_kept").collect())) == sorted(
        map(tuple, want.select("example_id", "choice_idx", "position", "n_kept").collect()))


def test_xml_is_packed(spark, tmp_path):
    rows = [(f"frame{i}", "F") for i in range(50)]
    xml.write_xml(spark.createDataFrame(rows, "_name STRING, _frameName STRING"), str(tmp_path / "x"), "lu", "luIndex")
    assert all(f.endswith(".gz") for f in os.listdir(tmp_path / "x") if f.startswith("part-"))
    assert sorted(map(tuple, xml.read_lu_index(spark, str(tmp_path / "x")).collect())) == sorted(rows)


def test_longest_ngrams_are_not_dealt_again(spark, tmp_path):
    docs = [(1, "one two one two one two three", "en", "web", 40), (2, "one two one two one two three four", "en", None, 20), (3, "a", "en", "web", 1)]
    spark.createDataFrame(docs, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(str(tmp_path / "documents.parquet"))
    parts = [(0, "large ring", "Brand#1", "LARGE", 1, 9.0)]
    spark.createDataFrame(parts, "p_partkey LONG, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE").write.parquet(str(tmp_path / "part.parquet"))
    df = E.queries()["ngrams"](spark, str(tmp_path))
    got = {r.n: (r.n_ngrams, r.n_distinct) for r in df.collect()}
    for n in got:
        grams = [tuple(t[i:i + n]) for t in (d[1].split() for d in docs) for i in range(len(t) - n + 1)]
        assert got[n] == (len(grams), len(set(grams)))
    assert "substring_index" in plan(df) and max(got) >= 4
