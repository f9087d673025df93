"""Registered queries of this subpackage: one per operator, each over its whole tables."""

from __future__ import annotations

from . import chat_format, exact_dedup, filter_audit, language_id, line_dedup, lm_scoring, mixing, ngram_join, quality, sentencepiece_codec, simhash_dedup, spelling, topk_search
from .common import table


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_groups(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_topk_search(spark, sf_dir):
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op6_lm_scoring(spark, sf_dir):
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.line_groups(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark, sf_dir):
    return chat_format.formatted_query(table(spark, sf_dir, "conversations"))


def op9_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op13_simhash_dedup(spark, sf_dir):
    return simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_source_mixing": op2_source_mixing,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_language_id": op4_language_id,
        "op5_topk_search": op5_topk_search,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_line_dedup": op7_line_dedup,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_simhash_dedup": op13_simhash_dedup,
    }


def oracle_sql():
    return {
        "op2_source_mixing": mixing.ORACLE_SQL,
        "op5_topk_search": topk_search.ORACLE_SQL,
        "op8_chat_formatting": chat_format.ORACLE_SQL,
        "op10_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_filter_audit": filter_audit.ORACLE_SQL,
        "op12_spelling_variants": spelling.ORACLE_SQL,
    }
