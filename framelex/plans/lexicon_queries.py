"""Registered queries: tokens, lexicon compile, candidate generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import lu_base, lu_no_pos, lu_pos
from ..operators import corpus, lexicon, match
from ..session import checkpoint_dir
from .context import corpus_distinct, corpus_lexicon, corpus_token_arrays, corpus_tokens, mined_lexicon, table


def q_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Per sentence and pass, token count, offset sums and a digest
    of the token texts in order."""
    t = corpus_token_arrays(spark, sf).where(F.size("toks") > 0)

    def total(field):
        return F.aggregate("toks", F.lit(0).cast("bigint"), lambda s, x: s + x[field])

    return t.select("sent_id", "pass", F.size("toks").cast("bigint").alias("n_tokens"), total("start").alias("sum_start"),
                    total("end").alias("sum_end"), F.md5(F.array_join(F.col("toks")["text"], " ")).alias("tokens_md5"))


def q_distinct_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """A2: sentence occurrences and distinct sentence texts."""
    d = corpus_distinct(spark, sf)
    return d.agg(F.sum("n_occ").alias("n_sentences"), F.count(F.lit(1)).alias("n_distinct"))


def q_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """N-gram counts (pass 0 surface words) for n from 1 to the
    longest pattern of the lexicon."""
    nmax = corpus_lexicon(spark, sf).compiled.lmax
    # words hold no blanks, so a text stands for a run; it is half an array's bytes
    a = corpus.runs(corpus.text_arrays(corpus_distinct(spark, sf), 0), nmax).select(F.array_join("s", " ").alias("a"), F.size("s").alias("k"))
    # equal runs are counted together first: the shorter n-grams are the
    # beginnings of the distinct runs, so they shuffle as often as these
    runs = a.groupBy("a", "k").agg(F.count(F.lit(1)).alias("c"))
    # 128 bits stand for a gram, as for a sentence; the longest are the runs
    # themselves, which are told apart already: what they count stays in place
    n = F.col("n")
    g = runs.select("a", "c", F.explode(F.sequence(F.lit(1), "k")).alias("n"))
    g = g.select("n", "c", F.when(n < nmax, F.unhex(F.md5(F.call_function("substring_index", F.col("a"), F.lit(" "), n)))).alias("g"))
    whole = F.col("g").isNull()
    per = g.groupBy("n", "g").agg(F.sum("c").alias("c"), F.count_if(whole).alias("d"))
    return per.groupBy("n").agg(F.sum("c").alias("n_ngrams"), F.sum(F.when(whole, F.col("d")).otherwise(1)).alias("n_distinct"))


def q_lu_names(spark: SparkSession, sf: str) -> DataFrame:
    """LU without POS, POS, and trie name of every corpus LU."""
    lx = corpus_lexicon(spark, sf)
    return (lx.lus.select("name").distinct()
            .select(F.col("name").alias("lu"), lu_no_pos(F.col("name")).alias("lu_no_pos"),
                    lu_pos(F.col("name")).alias("lu_pos"), lu_base(F.col("name")).alias("trie_name")))


def q_lu_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Every (LU, frame, variant)."""
    return corpus_lexicon(spark, sf).variants.select("lu", "frame", "variant")


def q_lu_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Pattern, length, merged frames."""
    p = corpus_lexicon(spark, sf).patterns
    return p.select(F.col("key").alias("pattern"), F.col("n").cast("int").alias("n"),
                    F.array_join("frames", "|").alias("frames"))


def q_lu_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Every node with its number of distinct children and whether it
    is terminal."""
    n = corpus_lexicon(spark, sf).nodes
    parent = F.when(F.col("depth") > 1, F.regexp_replace("key", " [^ ]*$", ""))
    kids = n.where(F.col("depth") > 1).groupBy(parent.alias("pkey")).agg(F.count(F.lit(1)).alias("n_children"))
    j = n.join(kids, n["key"] == kids["pkey"], "left")
    return j.select(F.col("key").alias("prefix"), F.col("depth").cast("int").alias("depth"),
                    F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
                    (F.size("frames") > 0).alias("terminal"))


def q_lu_exact_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of every corpus LU name by exact lookup."""
    lx = corpus_lexicon(spark, sf)
    names = lx.lus.select(F.col("name").alias("lu")).distinct()
    r = lexicon.exact_lookup(names, lx.nodes, "lu")
    return r.select("lu", F.array_join("frames", "|").alias("frames"))


def _cand_rows(spark: SparkSession, sf: str) -> DataFrame:
    lx = corpus_lexicon(spark, sf)
    toks = corpus_tokens(spark, sf, lex=lx.compiled)
    return match.candidate_rows(toks, lx.compiled)


def corpus_candidates(spark: SparkSession, sf: str, annotator=corpus.annotate) -> DataFrame:
    """Spans with their frames over all distinct sentences."""
    lex = corpus_lexicon(spark, sf).compiled
    return match.candidates(corpus_tokens(spark, sf, annotator=annotator, lex=lex, merged=True), lex)


def q_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every matching span of every distinct sentence with its
    frame set (flagship)."""
    return corpus_candidates(spark, sf).select("sent_id", "start", "end", F.array_join("frames", "|").alias("frames"))


def _lu_hits(spark: SparkSession, sf: str) -> DataFrame:
    lex = corpus_lexicon(spark, sf).compiled
    return match.lu_hits(corpus_tokens(spark, sf, lex=lex, merged=True), lex)


def _hit_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lu").agg(F.count(F.lit(1)).alias("n_hits"),
                                  F.sum("start").alias("sum_start"), F.sum("end").alias("sum_end"))


def q_cand_unigram(spark: SparkSession, sf: str) -> DataFrame:
    """Single-word LU hits per LU."""
    h = _lu_hits(spark, sf)
    return _hit_stats(h.where(~F.col("lu").contains(" ")))


def q_cand_multiword(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-word LU hits per LU (every terminal prefix counted)."""
    h = _lu_hits(spark, sf)
    return _hit_stats(h.where(F.col("lu").contains(" ")))


def q_cand_wildcard(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of patterns with a POS slot."""
    h = _lu_hits(spark, sf)
    return _hit_stats(h.where(F.col("lu").contains("<")))


def q_cand_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Hits that start on a number token (number words)."""
    d = corpus_distinct(spark, sf)
    h = _lu_hits(spark, sf).join(d.select("sent_id", "sentence"), "sent_id")
    h = h.where(F.substring("sentence", F.col("start") + 1, 1).rlike("[0-9]")).drop("sentence")
    return _hit_stats(h)


def q_cand_views(spark: SparkSession, sf: str) -> DataFrame:
    """Rows emitted per pass and view (surface, lemma, stem,
    alias, spelling, override)."""
    rows = _cand_rows(spark, sf)
    return rows.groupBy("pass", "view").agg(F.count(F.lit(1)).alias("n_rows"),
                                            F.sum("start").alias("sum_start"), F.sum("end").alias("sum_end"))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """(text): the corpus's words of three letters a-z or more, written once:
    a lexicon that is made of them is read many times."""
    checkpoint_dir(spark)
    w = corpus.words(table(spark, sf, "documents"))
    return w.where(F.col("text").rlike("^[a-z]{3,}$")).checkpoint(eager=True)


def q_cand_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Hits through a spelling table and a lexicon derived from the
    corpus: where a word and the word with ``ing`` both occur, they are a
    (us, gb) pair and the shorter one is an LU, so both grow with the data."""
    words = _words(spark, sf)
    longer = words.select(F.col("text").alias("gb"))
    pairs = words.join(longer, F.concat("text", F.lit("ing")) == F.col("gb")).select(F.col("text").alias("us"), "gb")
    lus = pairs.select(F.concat("us", F.lit(".n")).alias("name"), F.concat(F.lit("Word_"), F.col("us")).alias("frame"))
    lex = lexicon.compile_lexicon(lus, with_extras=False, pairs=pairs)
    return _hit_stats(_view_hits(corpus_tokens(spark, sf, lex=lex, merged=True), lex, "spelling"))


def _view_hits(toks: DataFrame, lex: lexicon.Compiled, view: str) -> DataFrame:
    return match.distinct_hits(match.hits(toks, lex).where(F.array_contains(F.split("views", ","), view)))


def _plural_lexicon(spark: SparkSession, sf: str) -> tuple[DataFrame, lexicon.Compiled]:
    """Tokens, and a lexicon with alias and override tables, all derived from
    the corpus: where a word and the word with ``s`` both occur, the shorter
    one is an LU, the longer one its alias and, but for the first token of a
    sentence, an override that ends two characters later."""
    words = _words(spark, sf)
    longer = words.select(F.col("text").alias("form"))
    pairs = words.join(longer, F.concat("text", F.lit("s")) == F.col("form")).select(F.col("text").alias("word"), "form")
    lus = pairs.select(F.concat("word", F.lit(".n")).alias("name"), F.concat(F.lit("Word_"), F.col("word")).alias("frame"))
    over = pairs.select(F.col("form").alias("lemma"), F.lit("X").alias("pos"), F.col("word").alias("lu"), F.lit(2).alias("extra"))
    none = spark.createDataFrame([], "us STRING, gb STRING")
    lex = lexicon.compile_lexicon(lus, with_extras=False, pairs=none, aliases=pairs, overrides=over)
    return corpus_tokens(spark, sf, lex=lex, merged=True), lex


def q_cand_alias(spark: SparkSession, sf: str) -> DataFrame:
    """Hits through an alias table derived from the corpus."""
    return _hit_stats(_view_hits(*_plural_lexicon(spark, sf), "alias"))


def q_cand_override(spark: SparkSession, sf: str) -> DataFrame:
    """Hits through an override table derived from the corpus."""
    return _hit_stats(_view_hits(*_plural_lexicon(spark, sf), "override"))


def q_mined_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the lexicon mined from frequent n-grams, by depth."""
    n = mined_lexicon(spark, sf).nodes
    return n.groupBy(F.col("depth").cast("int").alias("depth")).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if("has_children").alias("n_inner"), F.count_if(F.size("frames") > 0).alias("n_terminal"))


def q_cand_mined(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of the mined lexicon, which grows with the corpus."""
    lex = mined_lexicon(spark, sf).compiled
    return _hit_stats(match.lu_hits(corpus_tokens(spark, sf, lex=lex, merged=True), lex))


def q_cand_dependency(spark: SparkSession, sf: str) -> DataFrame:
    """head/dependent pairs of the mined lexicon, on heads by rule: an
    odd token hangs on the one before, an even one on that of half its index."""
    i = F.col("tok_idx")
    head = F.when(i == 0, F.lit(None)).when(i % 2 == 1, i - 1).otherwise(F.expr("tok_idx div 2")).cast("int")
    toks = corpus_tokens(spark, sf).withColumn("head_idx", head)
    rows = match.dependency_hits(toks, mined_lexicon(spark, sf).compiled).where(F.col("end") > F.col("start"))
    return _hit_stats(rows.select("sent_id", "start", "end", "lu").distinct())


def q_cand_by_lu(spark: SparkSession, sf: str) -> DataFrame:
    """Per span, LU -> frames, flattened to text."""
    lx = corpus_lexicon(spark, sf)
    b = match.with_set_frames(match.spans(corpus_tokens(spark, sf, lex=lx.compiled, merged=True), lx.compiled), lx.compiled, by_lu=True)
    txt = F.array_join(F.transform(F.map_entries("frames"),
                                   lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ";")
    return b.select("sent_id", "start", "end", txt.alias("lu_frames"))


def q_cand_subsumed(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy non-overlapping spans per sentence, with their frames."""
    lex = corpus_lexicon(spark, sf).compiled
    spans = match.spans(corpus_tokens(spark, sf, lex=lex, merged=True), lex)
    # the sweep needs the spans only; the kept ones get their frames
    kept = match.subsumed(spans.withColumnRenamed("lus", "frames")).withColumnRenamed("frames", "lus")
    k = match.with_set_frames(kept, lex)
    return k.select("sent_id", "start", "end", F.array_join("frames", "|").alias("frames"))
