"""The operators' queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from tessel.llm import chat, decontaminate, exact_dedup, html_extract, line_dedup, mixing, ngram_join, quality, token_counts, wavelet
from tessel.llm.frames import table


def op1_html_extract(spark, sf_dir):
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"), mixing.WEIGHTS, mixing.BUDGET_SHARE)


def op4_ngram_join(spark, sf_dir):
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_wavelet_shards(spark, sf_dir):
    return wavelet.wavelet_shards(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_chat_format(spark, sf_dir):
    return chat.format_trees(chat.messages_of(table(spark, sf_dir, "conversations")))


def op9_substring_dedup(spark, sf_dir):
    return line_dedup.dedup_units(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    kept = quality.filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "quality_score", "quality_passage")


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_exact_dedup, op3_mixing, op4_ngram_join, op5_token_counts, op6_wavelet_shards, op7_decontamination, op8_chat_format, op9_substring_dedup, op10_quality_classifier)}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op8_chat_format": chat.ORACLE,
    "op9_substring_dedup": line_dedup.ORACLE,
}
