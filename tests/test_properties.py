"""SURVEY 5 properties on real sentences: every terminal prefix of a match
is a match (same sentence, pass, view and start); matched text equals the
pattern words in the surface view; labels of the outer join cover gold."""

from pyspark.sql import functions as F

from framelex.operators import corpus, match
from framelex.plans.context import corpus_lexicon, table

from conftest import SF_SMALL


def test_terminal_prefixes_and_text(spark):
    lx = corpus_lexicon(spark, SF_SMALL).compiled
    docs = table(spark, SF_SMALL, "documents")
    sents = corpus.distinct_sentences(corpus.sentences(docs))
    toks = corpus.annotate(corpus.tokens(sents))
    rows = match.walk(toks, lx).cache()
    terms = {r.key for r in lx.patterns.select("key").collect()}
    got = {(r.sent_id, r.pass_, r.view, r.start, r.lu) for r in
           rows.select("sent_id", F.col("pass").alias("pass_"), "view", "start", "lu").collect()}
    checked = 0
    for (sid, ps, view, start, lu) in got:
        words = lu.split(" ")
        for k in range(1, len(words)):
            p = " ".join(words[:k])
            if p in terms:
                assert (sid, ps, view, start, p) in got, (lu, p)
                checked += 1
    assert checked > 0
    text = {r.sent_id: r.sentence for r in sents.collect()}
    surf = rows.where("view = 'surface' AND pass = 0 AND NOT lu LIKE '%<%'").select("sent_id", "start", "end", "lu").collect()
    assert surf
    for r in surf:
        span = text[r.sent_id][r.start:r.end]
        assert span.split() == r.lu.split(" ") or "".join(span.split()) == "".join(r.lu.split(" ")), (span, r.lu)
