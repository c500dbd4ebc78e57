"""The queries opN_<name> and what SQL can say of them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import fill_middle, html_text, ivfpq, langid, licenses, mpeg, ngram_join, packing, pii, sentencepiece_codec, separators, topk, whitening
from tilewright.llm.common import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.features(mpeg.store_texts(table(spark, sf_dir, "documents")))


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.document_lengths(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op4_bidirectional_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_t_occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op9_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op10_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.nearest(table(spark, sf_dir, "embeddings"))


def op11_vertical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_weak_supervision_pii": op1_weak_supervision_pii,
    "op2_mpeg_audio": op2_mpeg_audio,
    "op3_separator_scan": op3_separator_scan,
    "op4_bidirectional_gru": op4_bidirectional_gru,
    "op5_t_occurrence_join": op5_t_occurrence_join,
    "op6_tree_scoring": op6_tree_scoring,
    "op7_license_join": op7_license_join,
    "op8_bin_slack_packing": op8_bin_slack_packing,
    "op9_sentencepiece_codec": op9_sentencepiece_codec,
    "op10_ivf_pq": op10_ivf_pq,
    "op11_vertical_topk": op11_vertical_topk,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_tsqr_whitening": op13_tsqr_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op7_license_join": licenses.oracle_sql(),
    "op11_vertical_topk": topk.oracle_sql(),
    "op12_fill_in_middle": fill_middle.oracle_sql(),
}
