"""Scoring choices (M1) as joins and grouped sums: TF-IDF cosine of a
context text and each of its own choice texts. Pairs come only from the
choice table (never all contexts x all definitions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.joins import broadcast_within

TERM_PATTERN = r"[\p{L}\p{N}]+"


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): lower-cased letter/digit runs, counted per text."""
    t = df.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(TERM_PATTERN), 0)).alias("term"))
    return t.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_scores(pairs: DataFrame, contexts: DataFrame, defs: DataFrame, n_defs: int) -> DataFrame:
    """``pairs(example_id, choice_idx, def_id)``; ``contexts(id, text)``;
    ``defs(id, text)`` with ``n_defs`` rows. IDF over the definitions:
    ``ln(n_defs / df)``; weights ``tf * idf``; score = cosine over terms
    known to the definitions (0 when either norm is 0)."""
    dt = term_counts(defs, "id", "text")
    idf = dt.groupBy("term").agg(F.log(F.lit(float(n_defs)) / F.count(F.lit(1))).alias("idf"))
    dw = dt.join(idf, "term").select(F.col("id").alias("def_id"), "term", (F.col("tf") * F.col("idf")).alias("wd"))
    dnorm = dw.groupBy("def_id").agg(F.sqrt(F.sum(F.col("wd") * F.col("wd"))).alias("nd"))
    cw = term_counts(contexts, "id", "text").join(idf, "term")
    cw = cw.select(F.col("id").alias("example_id"), "term", (F.col("tf") * F.col("idf")).alias("wc"))
    cnorm = cw.groupBy("example_id").agg(F.sqrt(F.sum(F.col("wc") * F.col("wc"))).alias("nc"))
    dot = (pairs.join(cw, "example_id")
           .join(dw, ["def_id", "term"])
           .groupBy("example_id", "choice_idx").agg(F.sum(F.col("wc") * F.col("wd")).alias("dot")))
    s = (pairs.join(dot, ["example_id", "choice_idx"], "left")
         .join(cnorm, "example_id", "left").join(broadcast_within(dnorm, n_defs, row_bytes=24), "def_id", "left"))
    score = F.when((F.coalesce("nc", F.lit(0.0)) == 0) | (F.coalesce("nd", F.lit(0.0)) == 0), F.lit(0.0)).otherwise(
        F.coalesce("dot", F.lit(0.0)) / (F.col("nc") * F.col("nd")))
    return s.select("example_id", "choice_idx", "def_id", score.alias("logit"))


# scorers by name; a scorer maps (pairs, contexts, defs, n_defs) to logits
SCORERS = {"tfidf": tfidf_scores}


def scorer(name: str):
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}")
    return SCORERS[name]
