"""A walk's tokens: only what may start a pattern becomes a row, with the
offsets and look-ahead of the whole sentence; spans are dealt once."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from framelex.operators import corpus, lexicon, match

TEXT = ["is the 21 the the the", "let him be", "on-the brother-in-law of the", "x", "of their it has to do with", "kind of coloured",
        "\tof  the\u000b12 kinds of pulling her leg", "colours cm Could one know", "zebra yak", " ".join(["a of the b-c"] * 80)]


def sentences(spark):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXT)], "sent_id STRING, sentence STRING")


def test_few_tokens_walk_like_all(spark):
    sents, lex = sentences(spark), lexicon.compile_lexicon(lexicon.fixture_lus(spark))
    cols = ["sent_id", "pass", "view", "start", "end", "lu"]
    few = corpus.annotated(sents, corpus.annotate, lex.lmax - 1, lex.firsts)
    rows = [sorted(map(tuple, match.walk(t, lex).select(*cols).collect())) for t in (corpus.annotate(corpus.tokens(sents)), few)]
    assert rows[0] == rows[1] and len(rows[0]) > 200
    # zebra, yak and x start nothing
    assert {r.sent_id for r in few.collect()}.isdisjoint({"3", "8"})


def test_walk_tokens_keep_their_offsets(spark):
    sents = sentences(spark)
    cols = ["sent_id", "pass", "tok_idx", "start", "end", "text"]
    for block in (2, 64):
        got = sorted(map(tuple, corpus.walk_tokens(sents, 2, block=block).select(*cols).collect()))
        assert got == sorted(map(tuple, corpus.tokens(sents).collect()))


def test_letters_of_starts(spark):
    lus = spark.createDataFrame([("pull <X> leg.v", "A"), ("Ox.n", "B")], "name STRING, frame STRING")
    lex = lexicon.compile_lexicon(lus, with_extras=False)
    assert {"pul", "ox", "has", "cm"} <= set(lex.firsts) and lex.seconds is None


def test_spans_are_made_once(spark):
    lex = lexicon.compile_lexicon(lexicon.fixture_lus(spark))
    toks = corpus.annotated(sentences(spark), corpus.annotate, lex.lmax - 1, lex.firsts)
    by_span, by_set = match.candidates(toks, lex), match.with_set_frames(match.spans(toks, lex), lex).drop("lus")

    def walks(df):
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain()
        return buf.getvalue().count("Scan ExistingRDD[sent_id#")

    # one walk, and none where the spans are read back
    assert walks(by_span) == 1 and walks(by_set) == 0
    cols = ["sent_id", "start", "end", "frames"]
    assert sorted(map(str, by_span.select(*cols).collect())) == sorted(map(str, by_set.select(*cols).collect()))
