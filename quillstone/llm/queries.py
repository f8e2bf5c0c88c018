"""The ``opN_<name>`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from . import bpe, decontam, html_cut, langid, license_scan, line_dedup, lm_trie, quality_crf, simhash, url_filter
from .common import table


def op1_elias_fano_lm(spark, sf_dir):
    return lm_trie.result(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return langid.result(table(spark, sf_dir, "documents"))


def op3_min_cut_html(spark, sf_dir):
    return html_cut.result(table(spark, sf_dir, "pages"))


def op4_bloom_url_filter(spark, sf_dir):
    return url_filter.result(table(spark, sf_dir, "pages"))


def op5_license_scan(spark, sf_dir):
    return license_scan.result(table(spark, sf_dir, "documents"))


def op6_crf_quality(spark, sf_dir):
    return quality_crf.result(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_winnowing_decontamination(spark, sf_dir):
    return decontam.result(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.result(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_template_line_dedup(spark, sf_dir):
    return line_dedup.result(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark, sf_dir):
    return simhash.result(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_elias_fano_lm, op2_language_id, op3_min_cut_html, op4_bloom_url_filter, op5_license_scan, op6_crf_quality, op7_winnowing_decontamination, op8_byte_bpe, op9_template_line_dedup, op10_simhash_near_dedup)}
ORACLES = {
    "op4_bloom_url_filter": url_filter.ORACLE_SQL,
    "op5_license_scan": license_scan.ORACLE_SQL,
    "op7_winnowing_decontamination": decontam.ORACLE_SQL,
    "op9_template_line_dedup": line_dedup.ORACLE_SQL,
}
