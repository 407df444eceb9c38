"""A lexicon beyond the broadcast bound is dealt to the tokens' buckets: the
rows are those of the plain walk, and no token is shuffled for a word."""

import io
from contextlib import redirect_stdout

import pytest

from framelex.operators import corpus, lexicon, match

from test_walk_starts import TEXT


def lexicons(spark):
    lus = spark.createDataFrame([("of the.n", "A"), ("of.n", "B"), ("the the the.n", "C"), ("colour.n", "D"), ("pull.v", "E")], "name STRING, frame STRING")
    pairs = spark.createDataFrame([("color", "colour"), ("of", "on")], "us STRING, gb STRING")
    aliases = spark.createDataFrame([("zebra", "pull"), ("b", "of")], "form STRING, word STRING")
    over = spark.createDataFrame([("let", "X", "of the", 2)], "lemma STRING, pos STRING, lu STRING, extra INT")
    return lexicon.compile_lexicon(lus, with_extras=False, pairs=pairs, aliases=aliases, overrides=over)


def test_dealt_walk_is_the_plain_walk(spark):
    sents = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXT)], "sent_id STRING, sentence STRING")
    lex, cols = lexicons(spark), ["sent_id", "pass", "views", "start", "end", "lu"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plain = match.hits(corpus.annotated(sents, corpus.annotate, lex.lmax - 1, lex.firsts), lex).select(*cols).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert lexicon.is_large(lex)
        rows = match.hits(corpus.annotated(corpus.in_buckets(sents), corpus.annotate, lex.lmax - 1, lex.firsts), lex)
        buf = io.StringIO()
        with redirect_stdout(buf):
            rows.explain()
        got = rows.select(*cols).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and len(got) > 20
    # sentences move once; tokens are not sorted for a join
    assert "SortMergeJoin" not in buf.getvalue()


@pytest.mark.parametrize("ahead", (0, 2))
def test_merged_passes_meet_the_same_spans(spark, ahead):
    sents = spark.createDataFrame([(str(i), t) for i, t in enumerate([*TEXT, "Of the The of", "a  b of"])], "sent_id STRING, sentence STRING")
    cols = ["sent_id", "pass", "tok_idx", "start", "end", "text"]
    both, few = ({tuple(r) for r in corpus.walk_tokens(sents, ahead, merged=m).select(*cols).collect()} for m in (False, True))
    assert few < both
    # what is left out is in the second pass
    assert {(r[0], 1, *r[2:]) for r in both - few} <= few and {r[1] for r in both - few} == {0}
