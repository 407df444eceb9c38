"""Spelling in both directions, whole numbers in words, one-word roots."""

import pytest
from pyspark.sql import functions as F

from framelex.functions.text import number_words
from framelex.operators import corpus, lexicon, match

NUMBERS = {"0": "zero", "7": "seven", "007": "seven", "21": "twenty-one", "100": "one hundred", "101": "one hundred and one",
           "1000": "one thousand", "1001": "one thousand and one", "1234": "one thousand, two hundred and thirty-four",
           "20000": "twenty thousand", "1000000": "one million", "1000100": "one million, one hundred",
           "12345678901": "twelve billion, three hundred and forty-five million, six hundred and seventy-eight thousand, nine hundred and one",
           "9" * 37: "9" * 37, "x1": "x1", "": ""}


def test_number_words(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS], "d string")
    assert {r.d: r.w for r in df.select("d", number_words(F.col("d")).alias("w")).collect()} == NUMBERS


def hits(spark, lus, sentences, pairs=None):
    lex = lexicon.compile_lexicon(spark.createDataFrame(lus, lexicon.LU_SCHEMA), with_extras=False, pairs=pairs)
    sents = spark.createDataFrame([(s, s) for s in sentences], "sent_id STRING, sentence STRING")
    rows = match.candidate_rows(corpus.annotate(corpus.tokens(sents)), lex)
    out = {s: {} for s in sentences}
    for r in match.dedupe(rows).collect():
        out[r.sent_id][r.start, r.end] = list(r.frames)
    return out


def test_both_spellings_of_a_word_keep_their_frames(spark):
    lus = [("color.n", "Color"), ("colour.n", "Colour_gb"), ("center.n", "Mid"), ("centre.n", "Mid_gb"), ("odor.n", "Smell"), ("four.num", "Number")]
    got = hits(spark, lus, ["my colour is", "the color", "the center", "an odour", "for me", "colours"])
    assert got["my colour is"] == {(3, 9): ["Color", "Colour_gb"]}
    assert got["the color"] == {(4, 9): ["Color", "Colour_gb"]}
    assert got["the center"] == {(4, 10): ["Mid", "Mid_gb"]}
    assert got["an odour"] == {(3, 8): ["Smell"]}
    assert got["for me"] == {}
    assert got["colours"] == {(0, 7): ["Color", "Colour_gb"]}  # through the stem


def test_spelling_pairs_of_the_user_replace_the_rules(spark):
    pairs = spark.createDataFrame([("gray", "grey"), ("jail", "gaol"), ("slate", "grey")], "us string, gb string")
    lus = [("gray.a", "Gray"), ("jail.n", "Prison"), ("slate.n", "Slate"), ("color.n", "Color")]
    got = hits(spark, lus, ["grey gaol colour"], pairs)
    assert got["grey gaol colour"] == {(0, 4): ["Gray", "Slate"], (5, 9): ["Prison"]}


@pytest.mark.parametrize("sentence,expected", [("100 cats", {}), ("1000 cats", {}), ("7 cats", {(0, 1): ["Seven"]}), ("one hundred", {(0, 11): ["Hundred"]})])
def test_numbers_start_at_one_word_roots(spark, sentence, expected):
    lus = [("one hundred.num", "Hundred"), ("one thousand.num", "Thousand"), ("seven.num", "Seven")]
    assert hits(spark, lus, [sentence])[sentence] == expected


def test_wide_frames_are_not_broadcast(spark):
    """Broadcasts go by measured bytes, not by row counts."""
    from framelex.plans.joins import threshold_bytes
    lus = spark.range(40_000).select(F.lit("wide.n").alias("name"), F.concat(F.lit("F" * 300), F.col("id").cast("string")).alias("frame"))
    lex = lexicon.compile_lexicon(lus, with_extras=False)
    assert lex.n_nodes == 1 and lex.sizes["patterns"] > threshold_bytes(spark) > lex.sizes["nodes"]
    toks = corpus.annotate(corpus.tokens(spark.createDataFrame([("s", "wide")], "sent_id STRING, sentence STRING")))
    plan = match.walk(toks, lex)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "t_key" in line and "Join" in line]
    assert joins and not any("broadcast" in line for line in joins)
