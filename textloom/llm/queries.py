"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import ann, bpe, cotrain, near_dup, packing, pii_crf, quality_rules, substring, tokenfile, warc
from textloom.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_personal_data(table(spark, sf_dir, "documents"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), WORD_BPE, keep_ids=False)


def op4_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_config_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("score")


def op8_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op9_unit_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(table(spark, sf_dir, "documents"))


def op10_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_rank")


QUERIES = {
    "op1_skip_chain_crf": op1_skip_chain_crf,
    "op2_cross_polytope": op2_cross_polytope,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_tensored_minhash": op4_tensored_minhash,
    "op5_config_lp_packing": op5_config_lp_packing,
    "op6_co_training": op6_co_training,
    "op7_ngram_ratio_rules": op7_ngram_ratio_rules,
    "op8_bit_packed_ids": op8_bit_packed_ids,
    "op9_unit_hashing": op9_unit_hashing,
    "op10_warc_index_merge": op10_warc_index_merge,
}
ORACLE_SQL: dict[str, str] = {
    "op4_tensored_minhash": near_dup.SQL,
    "op7_ngram_ratio_rules": quality_rules.SQL,
    "op9_unit_hashing": substring.SQL,
    "op10_warc_index_merge": warc.SQL,
}
