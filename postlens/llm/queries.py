"""Registered queries of the training-data operators: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from postlens.llm import (decontam, html_lstm, mixing, ngram_join, periodic_runs, pii_feistel, quality_bt, quality_llr,
                          substring_dedup, suffix_dedup, token_counts, toxicity_crf, whitening)
from postlens.llm.jobs import table


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def op1_simhash_decontamination(spark, sf_dir):
    return decontam.leaks(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("th")


def op4_bradley_terry_quality(spark, sf_dir):
    return quality_bt.quality(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(_documents(spark, sf_dir))


def op3_source_mixing(spark, sf_dir):
    return mixing.mix(_documents(spark, sf_dir))


def op5_feistel_pseudonyms(spark, sf_dir):
    return pii_feistel.find_and_replace(_documents(spark, sf_dir))


def op6_lstm_html_extraction(spark, sf_dir):
    return html_lstm.extract(table(spark, sf_dir, "pages"))


def op7_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.link_components(_documents(spark, sf_dir)).drop("th")


def op8_ngram_likelihood_quality(spark, sf_dir):
    return quality_llr.judge(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_toxicity_crf(spark, sf_dir):
    return toxicity_crf.toxicity(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_edit_aware_token_counts(spark, sf_dir):
    return token_counts.edited_counts(_documents(spark, sf_dir).select("doc_id", "text"))


def op11_blockmatrix_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.digest(_documents(spark, sf_dir))


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.run_report(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_simhash_decontamination, op2_substring_dedup, op3_source_mixing, op4_bradley_terry_quality, op5_feistel_pseudonyms,
    op6_lstm_html_extraction, op7_ngram_jaccard_join, op8_ngram_likelihood_quality, op9_toxicity_crf, op10_edit_aware_token_counts,
    op11_blockmatrix_whitening, op12_suffix_array_dedup, op13_periodic_runs)}

ORACLE = {"op2_substring_dedup": substring_dedup.ORACLE,
          "op3_source_mixing": mixing.ORACLE,
          "op7_ngram_jaccard_join": ngram_join.ORACLE}
