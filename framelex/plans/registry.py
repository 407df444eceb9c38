"""Query registry: name -> (spark builder, oracle SQL or None)."""

from __future__ import annotations

from . import annotation_queries as aq
from . import choice_queries as cq
from . import frame_queries as fq
from . import label_queries as bq
from . import lexicon_queries as lq
from . import score_queries as sq
from . import source_queries as xq
from .oracle import SQL

QUERIES = {
    "tokens": lq.q_tokens,
    "distinct_sentences": lq.q_distinct_sentences,
    "ngrams": lq.q_ngrams,
    "lu_names": lq.q_lu_names,
    "lu_variants": lq.q_lu_variants,
    "lu_patterns": lq.q_lu_patterns,
    "lu_prefixes": lq.q_lu_prefixes,
    "lu_exact_lookup": lq.q_lu_exact_lookup,
    "candidates": lq.q_candidates,
    "cand_unigram": lq.q_cand_unigram,
    "cand_multiword": lq.q_cand_multiword,
    "cand_wildcard": lq.q_cand_wildcard,
    "cand_numbers": lq.q_cand_numbers,
    "cand_views": lq.q_cand_views,
    "cand_spelling": lq.q_cand_spelling,
    "cand_alias": lq.q_cand_alias,
    "cand_override": lq.q_cand_override,
    "mined_nodes": lq.q_mined_nodes,
    "cand_mined": lq.q_cand_mined,
    "cand_dependency": lq.q_cand_dependency,
    "cand_by_lu": lq.q_cand_by_lu,
    "cand_subsumed": lq.q_cand_subsumed,
    "choice_offsets": cq.q_choice_offsets,
    "choice_argmax": cq.q_choice_argmax,
    "choice_accuracy": cq.q_choice_accuracy,
    "choice_softmax": cq.q_choice_softmax,
    "choice_probs": cq.q_choice_probs,
    "choice_loss": cq.q_choice_loss,
    "eval_loss_batched": cq.q_eval_loss_batched,
    "sink_pred_lines": cq.q_sink_pred_lines,
    "train_batches": cq.q_train_batches,
    "train_log_windows": cq.q_train_log_windows,
    "label_candidates": bq.q_label_candidates,
    "align_span": bq.q_align_span,
    "span_labels": bq.q_span_labels,
    "binary_metrics": bq.q_binary_metrics,
    "metrics_report": bq.q_metrics_report,
    "frame_lu_defs": fq.q_frame_lu_defs,
    "frame_info": fq.q_frame_info,
    "sample_negatives": fq.q_sample_negatives,
    "split_files": fq.q_split_files,
    "choice_examples": fq.q_choice_examples,
    "choice_text": fq.q_choice_text,
    "choice_features": fq.q_choice_features,
    "choice_crop_count": fq.q_choice_crop_count,
    "eval_single_choice": fq.q_eval_single_choice,
    "choice_csv": fq.q_choice_csv,
    "target_spans": aq.q_target_spans,
    "target_merged": aq.q_target_merged,
    "fe_spans": aq.q_fe_spans,
    "fe_rows": aq.q_fe_rows,
    "os_prepare": aq.q_os_prepare,
    "os_stage": aq.q_os_stage,
    "os_lookup_misses": aq.q_os_lookup_misses,
    "choice_tfidf": sq.q_choice_tfidf,
    "frame_identify": sq.q_frame_identify,
    "pad_global": sq.q_pad_global,
    "stage_roundtrip": sq.q_stage_roundtrip,
    "feature_cache": sq.q_feature_cache,
    "stream_tagger": sq.q_stream_tagger,
    "src_frame_xml": xq.q_src_frame_xml,
    "src_lu_index": xq.q_src_lu_index,
    "src_fulltext_xml": xq.q_src_fulltext_xml,
    "filter_predictions": bq.q_filter_predictions,
    "choice_split_read": fq.q_choice_split_read,
    "choice_nested": fq.q_choice_nested,
    "choice_dense": fq.q_choice_dense,
    "choice_dense_left": fq.q_choice_dense_left,
    "choice_questions": fq.q_choice_questions,
    "choice_splits": fq.q_choice_splits,
    "pad_rows": sq.q_pad_rows,
    "pred_files": cq.q_pred_files,
    "prob_files": cq.q_prob_files,
    "report_file": cq.q_report_file,
    "fulltext_rows": xq.q_fulltext_rows,
    "filter_predictions_ml": bq.q_filter_predictions_ml,
}


def _configured(fn):
    """Apply the library's session settings before building the query, so
    a caller's own session behaves the same (map-key policy, AQE, ...)."""
    from functools import wraps

    from ..session import configure

    @wraps(fn)
    def run(spark, sf_dir):
        configure(spark)
        return fn(spark, sf_dir)

    return run


def queries():
    return {k: _configured(v) for k, v in QUERIES.items()}


def oracle_sql():
    return {k: v for k, v in SQL.items() if k in QUERIES}
