"""The registered query of each operator: production parameters over the whole intended table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bpe, chat, iblt, licence_rules, licences, mixing, negatives, pieces, quality, simhash, toxicity, url_filter, warc, whitening
from foliant.session import read_table

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_rules.scan_licences(read_table(spark, sf_dir, "documents"))


def op2_licence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licence_texts(read_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(read_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = url_filter.labelled_outcomes(read_table(spark, sf_dir, "labels"))
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), outcomes)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare_edits(read_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_and_read_back(read_table(spark, sf_dir, "conversations"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(read_table(spark, sf_dir, "embeddings"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.contract_rows(read_table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_licences": op2_licences,
    "op2_licence_texts": op2_licence_texts,
    "op3_bpe": op3_bpe,
    "op4_mixing": op4_mixing,
    "op5_url_filter": op5_url_filter,
    "op6_fingerprints": op6_fingerprints,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_chat": op10_chat,
    "op11_pieces": op11_pieces,
    "op12_whitening": op12_whitening,
    "op13_negatives": op13_negatives,
}

ORACLE_SQL = {
    "op2_licences": licence_rules.scan_sql(),
    "op2_licence_texts": licences.scan_texts_sql(),
}
