"""The walk beyond the broadcast bound: same results with shuffle joins."""

import io
from contextlib import redirect_stdout

from framelex.operators import corpus, lexicon, match
from framelex.plans import joins

from test_golden import GOLDEN, adjust, run


def test_walk_without_broadcast(spark, monkeypatch):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = run(spark, list(GOLDEN), adjust)
        sents = spark.createDataFrame([(s, s) for s in GOLDEN], "sent_id STRING, sentence STRING")
        toks = corpus.annotate(corpus.tokens(sents))
        lex = lexicon.compile_lexicon(lexicon.fixture_lus(spark))
        buf = io.StringIO()
        with redirect_stdout(buf):
            match.walk(toks, lex).explain()
        plan = buf.getvalue()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for sent, expected in GOLDEN.items():
        assert got.get(sent, {}) == expected, sent
    assert "SortMergeJoin" in plan
