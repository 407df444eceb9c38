"""Inputs of the registered queries, derived from the given tables.

Every builder is lazy (returns DataFrames); a query pays only for what it
uses. Mapping of the input shapes onto the tables:
  sentences       documents.text split on [.!?\\n]+
  lexicon         inline fixture LUs + LUs derived from ``part``
  frames x LUs    ``part`` (frame = p_type/p_size, lu = p_name.pos)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import corpus, lexicon
from ..session import checkpoint_dir
from .joins import broadcast_measured


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass
class Lexicon:
    lus: DataFrame
    compiled: lexicon.Compiled

    @property
    def variants(self):
        return self.compiled.variants

    @property
    def patterns(self):
        return self.compiled.patterns

    @property
    def nodes(self):
        return self.compiled.nodes


_LEXICONS: dict = {}


def corpus_lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    """Compiled once per (session, data folder) and reused by every query
    (the lexicon is loaded once for all jobs)."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _LEXICONS:
        lus = lexicon.corpus_lus(spark, table(spark, sf_dir, "part"))
        _LEXICONS[key] = Lexicon(lus, lexicon.compile_lexicon(lus))
    return _LEXICONS[key]


def mined_lexicon(spark: SparkSession, sf_dir: str, support: int = 5, nmax: int = 3) -> Lexicon:
    """Lexicon of the corpus's own frequent n-grams (n from 2 on), so that it
    grows with the data; compiled once like :func:`corpus_lexicon`."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"), support, nmax)
    if key not in _LEXICONS:
        texts = corpus.text_arrays(corpus_distinct(spark, sf_dir), 1)
        # counted once: the lexicon's tables are read from the written grams
        checkpoint_dir(spark)
        grams = lexicon.frequent_grams(texts, support, 2, nmax).checkpoint(eager=True)
        lus = grams.select(F.concat("gram", F.lit(".n")).alias("name"),
                           F.concat(F.lit("Gram_"), F.substring_index("gram", " ", 1)).alias("frame"))
        none = spark.createDataFrame([], "us STRING, gb STRING")
        _LEXICONS[key] = Lexicon(lus, lexicon.compile_lexicon(lus, with_extras=False, pairs=none))
    return _LEXICONS[key]


def corpus_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sentences(table(spark, sf_dir, "documents"))


def corpus_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.distinct_sentences(corpus_sentences(spark, sf_dir))


def corpus_tokens(spark: SparkSession, sf_dir: str, annotated: bool = True, annotator=corpus.annotate,
                  lex: lexicon.Compiled | None = None, merged: bool = False) -> DataFrame:
    """Token table of the distinct sentences; ``annotator`` maps tokens to
    tokens with lemma, stem and pos (and head_idx, where a parser is used).
    ``lex``: the lexicon that a walk over the tokens looks words up in; beyond
    the broadcast bound the sentences are dealt into buckets for it.
    ``merged``: the reader does not ask which pass met a span."""
    sents = corpus_distinct(spark, sf_dir)
    if annotated and lex is not None:
        if annotator is corpus.annotate and lexicon.is_large(lex):
            sents = corpus.in_buckets(sents)
        return corpus.annotated(sents, annotator, lex.lmax - 1, lex.firsts, merged)
    t = corpus.tokens(sents)
    return annotator(t) if annotated else t


def corpus_token_arrays(spark: SparkSession, sf_dir: str, passes: bool = True) -> DataFrame:
    """(sent_id, pass, toks) of the distinct sentences."""
    return corpus.token_arrays(corpus_distinct(spark, sf_dir), passes)


def pattern_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass-0 word sequences that are a pattern of the corpus lexicon, of any
    length: (sent_id, tok_idx, n, start, end, p_start, p_end, after, text,
    gram, frames), ``after`` being the two tokens behind the sequence. Only
    tokens that begin like a pattern are looked at."""
    lx = corpus_lexicon(spark, sf_dir)
    most = lx.compiled.lmax
    at = corpus.sequence_starts(corpus_distinct(spark, sf_dir), most + 1, lx.compiled.firsts)
    n = F.col("n")
    g = at.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("s")))).alias("n"))
    g = g.withColumn("gram", F.array_join(F.slice("words", F.lit(1), n), " "))
    # few sequences are patterns: the keys alone find them, then they meet the
    # frames, which may be too many to broadcast
    keys = broadcast_measured(lx.patterns.select("key"), lx.compiled.sizes["keys"])
    pats = broadcast_measured(lx.patterns.select("key", "frames"), lx.compiled.sizes["patterns"])
    g = g.join(keys, g["gram"] == keys["key"], "left_semi")
    # matches follow one another without a gap, so their lengths give all offsets
    upto = lambda k: F.col("end") + F.length(F.array_join(F.slice("s", F.lit(2), k - 1), ""))
    word = lambda k: F.get("words", k - 1)
    spot = lambda k: F.struct((upto(k) - F.length(word(k))).alias("start"), upto(k).alias("end"), word(k).alias("text"))
    after = F.when(word(n + 2).isNotNull(), F.array(spot(n + 1), spot(n + 2))).when(word(n + 1).isNotNull(), F.array(spot(n + 1)))
    p_end = F.col("end") - F.length(F.get("s", F.lit(0)))
    # a generator: else Spark works the offsets out again for each condition that a reader has
    o = F.struct((F.col("end") - F.length(word(F.lit(1)))).alias("start"), upto(n).alias("end"),
                 (p_end - F.length(corpus.stripped(F.col("before")))).alias("p_start"), F.when(F.col("before").isNotNull(), p_end).alias("p_end"),
                 F.coalesce(after, F.slice(F.array(spot(n)), 1, 0)).alias("after"), word(n).alias("text"))
    g = g.select("sent_id", "tok_idx", "n", "gram", F.explode(F.array(o)).alias("o"))
    g = g.select("sent_id", "tok_idx", "n", "o.*", "gram")
    return g.join(pats, g["gram"] == pats["key"]).drop("key")
