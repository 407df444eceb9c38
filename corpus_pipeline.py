"""Corpus pipeline: filter, deduplicate, mix and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows to
the shared folder before the next one reads them.

Defined cases, for every stage: a null or empty text scores as a text without
evidence, has fingerprint 0 (all such rows are one group), loses no words, adds
no words to the mix and packs as the end id alone. Null ids and sources are
values like any other, equal rows are separate rows until the near-copies
stage, which keeps one. Texts are taken whole at any length, an empty table
gives an empty result, and extra columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framelex.llm import mixing, packing, simhash_dedup, substring_dedup, toxicity
from framelex.llm.common import cut, hidden, shown, table
from framelex.llm.registry import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the fit learns from labels outside op7's
    held-out rows."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(*toxicity.sample(docs, labels, learn=~toxicity.held_out(F.col("doc_id"))))
    rows, names = hidden(docs)
    return shown(toxicity.score(rows, model, names["text"]).where("score < 0.5"), names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each SimHash group (4-word shingles, 4 bits)."""
    return simhash_dedup.deduplicate(docs, shingle=4, radius=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 20-word windows that start earlier
    elsewhere; n_chars follows the text where it changes."""
    rows, names = hidden(docs)
    text, n_chars = names["text"], names["n_chars"]
    out = substring_dedup.remove(rows, 20, names["doc_id"], text)
    changed = F.col("n_removed") > 0
    out = out.withColumns({text: F.when(changed, F.col("kept")).otherwise(F.col(text)),
                           n_chars: F.when(changed, F.length("kept").cast("bigint")).otherwise(F.col(n_chars))})
    return shown(out, names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them, shard by shard."""
    rows, names = hidden(docs)
    out = mixing.mix(rows, weights=(5, 2, 1), share=1.5, cap=2.0, doc_id=names["doc_id"], text=names["text"], source=names["source"])
    return shown(out, names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    pieces = packing.pieces(docs, TOKENIZER, capacity=4096, end_id=1)
    return packing.pack(pieces, capacity=4096)


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", drop_near_copies), ("substring_dedup", cut_repeats),
          ("mixing", mix_sources), ("packing", pack_sequences)]
#: SQL can express neither the fit nor the fingerprints; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage-{name}")
    return docs
