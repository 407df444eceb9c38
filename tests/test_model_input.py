"""Model input, head/dependent pairs, filter, sinks and arguments against
plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from framelex.operators import choices, corpus, filter_model, lexicon, match
from framelex.plans import frame_queries, label_queries, score_queries
from framelex.sources import files, xml
from framelex.streaming import tagger


def choice_rows(spark):
    return spark.createDataFrame([
        (1, "The cat sat here", "sit.v", 3, "d1", "A", "one def", 0),
        (2, "A dog ran", "run.v", 3, "d1~$~d2~$~d3", "A~$~B~$~C", "x y z~$~" + " ".join(["w"] * 150) + "~$~last", 2),
        (3, "No label here", "be.v", 2, "d", "A~$~B", "p~$~q", None),
    ], frame_queries.CHOICE_SCHEMA)


def word_id(w):
    if w in (choices.CLS, choices.SEP):
        return 1 if w == choices.CLS else 2
    return 3 + int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 29_997


@pytest.mark.parametrize("max_choice,left,real", [(2, False, 1), (5, True, 1), (3, False, 0)])
def test_dense_input(spark, max_choice, left, real):
    feats = choices.examples(choice_rows(spark), max_length=20)
    plain = {(r.example_id, r.choice_idx): r for r in feats.collect()}
    got = {r.example_id: r for r in choices.dense(feats, 20, max_choice, pad_id=7, pad_segment=9, mask_real=real, pad_left=left).collect()}
    assert set(got) == {1, 2, 3}
    for e, r in got.items():
        assert len(r.input_ids) == len(r.attention_mask) == len(r.segment_ids) == max_choice
        n = max(c for x, c in plain if x == e) + 1
        assert (r.n_choice, r.n_kept) == (n, min(n, max_choice))
        for c in range(max_choice):
            if c >= n:
                assert r.input_ids[c] == r.attention_mask[c] == r.segment_ids[c] == [0] * 20
                continue
            p = plain[e, c]
            room = 20 - len(p.tokens)

            def pad(values, filler):
                return [filler] * room + values if left else values + [filler] * room

            assert r.input_ids[c] == pad([word_id(w) for w in p.tokens], 7)
            assert r.attention_mask[c] == pad([real] * len(p.tokens), 1 - real)
            assert r.segment_ids[c] == pad(list(p.segment_ids), 9)


def test_padded_rows_have_one_length(spark):
    sents = spark.createDataFrame([("a", "one two three"), ("b", "one"), ("c", "a-b c d")], "sent_id STRING, sentence STRING")
    out = {r.sent_id: r for r in score_queries.padded(corpus.tokens(sents, passes=False), "sent_id", pad_id=5, mask_pad=5).collect()}
    assert {r.n_total for r in out.values()} == {5}
    assert out["b"].input_ids == [word_id("one"), 5, 5, 5, 5] and out["b"].attention_mask == [1, 5, 5, 5, 5]
    assert out["c"].attention_mask == [1] * 5


def test_unknown_task_is_an_error(spark):
    with pytest.raises(ValueError):
        choices.task("nonsense")
    q = choices.examples(choice_rows(spark), "ludef_fndef_q").where("example_id = 2").orderBy("choice_idx")
    assert [r.question for r in q.collect()] == ["d1", "d2", "d3"]


def forest_tokens(spark, seed=4, sentences=12):
    r = random.Random(seed)
    rows = []
    for s in range(sentences):
        n = r.randrange(1, 40)
        heads = [None if i == 0 or r.random() < 0.1 else r.randrange(i) if r.random() < 0.8 else r.randrange(n) for i in range(n)]
        rows += [(f"s{s}", 0, i, heads[i], r.choice("abcd"), i * 3, i * 3 + 1) for i in range(n)]
    # a cycle and a token that is its own head
    rows += [("loop", 0, 0, 1, "a", 0, 1), ("loop", 0, 1, 2, "b", 3, 4), ("loop", 0, 2, 0, "c", 6, 7), ("loop", 0, 3, 3, "d", 9, 10), ("loop", 0, 4, 3, "a", 12, 13)]
    return rows, spark.createDataFrame(rows, "sent_id STRING, pass INT, tok_idx INT, head_idx INT, lemma STRING, start INT, end INT")


def test_dependency_pairs_against_brute_force(spark):
    rows, toks = forest_tokens(spark)
    pats = ["a b", "b a", "c d", "d", "a c e"]
    lex = lexicon.compile_lexicon(spark.createDataFrame([(p + ".x", "F") for p in pats], lexicon.LU_SCHEMA), with_extras=False)
    at = {(s, i): (h, w, a, b) for s, _, i, h, w, a, b in rows}
    expected = set()
    for (s, i), (h, w, a, b) in at.items():
        near, j = set(), h
        while j is not None and j not in near and at[s, j] is not None:
            near.add(j)
            j = at[s, j][0] if at[s, j][0] != j else None
        near |= {k for (x, k), v in at.items() if x == s and v[0] == i}
        for k in near - {i}:
            _, w2, a2, b2 = at[s, k]
            if f"{w} {w2}" in pats:
                expected.add((s, min(a, a2), b2 if a < a2 else b, f"{w} {w2}"))
    got = {(r.sent_id, r.start, r.end, r.lu) for r in match.dependency_hits(toks, lex).collect()}
    assert got == expected and len(got) > 20


def test_walks_in_shuffle_and_broadcast_agree_on_mined_lexicon(spark):
    text = [("a b c a b d", 3), ("a b c", 4), ("x y", 5), ("b c d", 2)]
    sents = spark.createDataFrame([(f"s{i}-{k}", t) for i, (t, n) in enumerate(text) for k in range(n)], "sent_id STRING, sentence STRING")
    toks = corpus.annotate(corpus.tokens(sents))
    grams = lexicon.frequent_ngrams(toks.where("pass = 1"), support=5, nmax=3)
    assert {r.gram for r in grams.collect()} == {"a", "b", "c", "d", "x", "y", "a b", "b c", "x y", "a b c"}
    lus = grams.where("n > 1").select(F.concat("gram", F.lit(".n")).alias("name"), F.lit("F").alias("frame"))
    lex = lexicon.compile_lexicon(lus, with_extras=False)
    a = sorted(map(tuple, match.lu_hits(toks, lex).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        b = sorted(map(tuple, match.lu_hits(toks, lex).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert a == b and len(a) == 31


def test_alias_and_override_tables(spark):
    lus = spark.createDataFrame([("go.v", "Motion"), ("go on.v", "Continue")], lexicon.LU_SCHEMA)
    alias = spark.createDataFrame([("gonna", "go"), ("x", "no root")], "form STRING, word STRING")
    over = spark.createDataFrame([("wend", "X", "go", 3)], "lemma STRING, pos STRING, lu STRING, extra INT")
    lex = lexicon.compile_lexicon(lus, with_extras=False, aliases=alias, overrides=over)
    sents = spark.createDataFrame([("s", "they gonna on x wend abc")], "sent_id STRING, sentence STRING")
    rows = match.walk(corpus.annotate(corpus.tokens(sents, passes=False)), lex)
    assert {(r.view, r.start, r.end, r.lu) for r in rows.collect()} == {
        ("alias", 5, 10, "go"), ("alias", 5, 13, "go on"), ("override", 16, 23, "go")}


def test_second_annotator(spark):
    docs = spark.createDataFrame([(1, "He walked on. On it walked.")], "doc_id LONG, text STRING")
    lex = lexicon.compile_lexicon(spark.createDataFrame([("march.v", "Motion")], lexicon.LU_SCHEMA), with_extras=False)

    def other(toks):
        return toks.withColumns({"lemma": F.when(F.lower("text") == "walked", F.lit("march")).otherwise(F.lower("text")),
                                 "stem": F.lower("text"), "pos": F.lit("Y")})

    assert tagger.tag_batch(docs, lex).collect() == []
    assert sorted((r.sent_idx, r.start, r.end) for r in tagger.tag_batch(docs, lex, other).collect()) == [(0, 3, 9), (1, 6, 12)]


def test_counted_filter_against_plain_python(spark):
    r = random.Random(2)
    rows = [(f"s{i}", 0, r.randrange(3), r.choice("abc"), r.choice("xyz"), r.randrange(2)) for i in range(200)]
    spans = filter_model.count_features(spark.createDataFrame(rows, "sent_id STRING, first INT, last INT, first_tok STRING, last_tok STRING, label INT"))
    model, totals = filter_model.fit_counts(spans)
    got = {x.sent_id: x.p1 for x in filter_model.score_counts(spans, model, totals, 0.5).collect()}
    pos = sum(x[5] for x in rows)
    neg = len(rows) - pos
    assert totals == (pos, neg)
    for s, first, last, a, b, _ in rows:
        logit = math.log((pos + 0.5) / (neg + 0.5))
        for same in (lambda x: x[2] - x[1] == last - first, lambda x: x[3] == a, lambda x: x[4] == b):
            p, n = (sum(1 for x in rows if same(x) and x[5] == y) for y in (1, 0))
            logit += math.log((p + 0.5) / (pos + 0.5 * 4096)) - math.log((n + 0.5) / (neg + 0.5 * 4096))
        assert got[s] == pytest.approx(1 / (1 + math.exp(-logit)))


def test_lines_come_back_in_order(spark, tmp_path):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("k"))
    files.write_lines(df.repartition(7).withColumn("line", F.format_string("%04d", "k")), ["k"], "line", str(tmp_path / "out"))
    back = files.read_lines(spark, str(tmp_path / "out")).orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in back] == [(i, f"{i:04d}") for i in range(1000)]


def test_only_listed_files_are_read(spark, tmp_path):
    layer = "<layer name='Target' rank='1'><label name='Target' start='0' end='1'/></layer>"
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.xml").write_text(
            f"<fullTextAnnotation><sentence ID='{name}'><text>{name}{name} word</text><annotationSet status='MANUAL' frameName='F' luName='x.n'>"
            f"{layer}</annotationSet></sentence></fullTextAnnotation>")
    listed = spark.createDataFrame([("a.xml", "train"), ("c.xml", "test"), ("none.xml", "dev")], "file_name STRING, split STRING")
    got = xml.read_fulltext(spark, str(tmp_path), listed).select("sent_key", "split").collect()
    assert sorted(map(tuple, got)) == [("a", "train"), ("c", "test")]


def test_targets_of_several_words(spark):
    from conftest import SF_SMALL
    gold = label_queries.pattern_grams(spark, SF_SMALL)
    assert gold.where("n > 1").count() > 0
