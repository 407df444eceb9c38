"""Token work stays inside a sentence: no window sorts tokens, lexicons made of
the corpus are read from written words, and tables may be folders."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

import __spark_entry__ as E
from framelex.operators import choices, corpus, lexicon, match
from framelex.plans import context, lexicon_queries, source_queries

from conftest import SF_SMALL


def plan(df):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("extended")
    return buf.getvalue().split("== Physical Plan ==")[-1]


def test_running_sums_at_block_borders(spark):
    for n in (0, 1, 31, 32, 33, 64, 65, 1100):
        values = [i % 7 for i in range(n)]
        got = spark.createDataFrame([(values,)], "v array<int>").select(corpus.running_sums(F.col("v")).alias("s")).first().s
        assert got == [sum(values[:i + 1]) for i in range(n)]


def test_token_queries_sort_no_tokens(spark):
    for name in ("tokens", "ngrams", "candidates", "cand_views", "target_spans", "mined_nodes"):
        assert "Window" not in plan(E.queries()[name](spark, SF_SMALL)), name


def test_both_ways_to_look_ahead_agree(spark):
    text = ["is the 21 the the the", "let him be", "on-the brother-in-law of the", "x", "of their it has to do with", "kind of coloured"]
    sents = spark.createDataFrame([(t, t) for t in text], "sent_id STRING, sentence STRING")
    lex = lexicon.compile_lexicon(lexicon.fixture_lus(spark))
    with_window = match.walk(corpus.annotate(corpus.tokens(sents)), lex)
    narrow = match.walk(corpus.annotated(sents, corpus.annotate, lex.lmax - 1), lex)
    cols = ["sent_id", "pass", "view", "start", "end", "lu"]
    a, b = (sorted(map(tuple, x.select(*cols).collect())) for x in (with_window, narrow))
    assert a == b and len(a) > 20


def test_lexicons_of_the_corpus_do_not_read_it_again(spark):
    _, plural = lexicon_queries._plural_lexicon(spark, SF_SMALL)
    for table in (plural.variants, plural.aliases, plural.overrides, context.mined_lexicon(spark, SF_SMALL).variants):
        assert "documents.parquet" not in plan(table)


def test_stream_reads_a_table_of_part_files(spark, tmp_path):
    for name in ("documents", "part"):
        t = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        t.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = lambda d: sorted(map(tuple, E.queries()["stream_tagger"](spark, d).collect()))
    assert rows(str(tmp_path)) == rows(SF_SMALL) != []


def test_model_input_takes_one_shuffle(spark):
    feats = spark.createDataFrame([(1, 0, ["a"], [0], 0, 2, 1), (1, 1, ["b", "c"], [0, 1], 0, 2, 1)],
                                  "example_id INT, choice_idx INT, tokens ARRAY<STRING>, segment_ids ARRAY<INT>, choice_position INT, n_choice INT, label INT")
    d = choices.dense(feats, max_length=3, max_choice=3)
    assert "Join" not in plan(d)
    r = d.first()
    assert r.attention_mask == [[1, 0, 0], [1, 1, 0], [0, 0, 0]] and (r.n_choice, r.n_kept, r.position, r.label) == (2, 2, 0, 1)


def test_a_number_of_full_text_files_grows_with_the_partitions(spark, monkeypatch):
    written = {}

    def write(df, path, *tags, old=source_queries.xml.write_xml):
        old(df, path, *tags)
        written["rows"] = df.select(F.spark_partition_id().alias("p"), F.substring("_ID", 1, 1).alias("n")).distinct().collect()

    monkeypatch.setattr(source_queries.xml, "write_xml", write)
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (8, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(tuple, E.queries()["fulltext_rows"](spark, SF_SMALL).collect())))
            files = [r.p for r in written["rows"]]
            assert len(files) == len(set(files)) and max(files) < 16 * -(-n // 16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] != [] and len(files) > 16
