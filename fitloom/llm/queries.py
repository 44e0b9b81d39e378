"""The corpus operators as registered queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fitloom.llm import kmeans, linededup, media, mixing, mixscore, namejoin, pii, secretscan, segment, simhash, tokencount, toxicity, vectors
from fitloom.llm.common import table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixscore.score(table(spark, sf_dir, "documents"))


def op2_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.encode_samples(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_dedup(table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_all(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.stored(table(spark, sf_dir, "documents")))


def op11_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.summary(table(spark, sf_dir, "embeddings"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.find_all(table(spark, sf_dir, "documents"))


def op13_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namejoin.vendor_clients(table(spark, sf_dir, "clients"), table(spark, sf_dir, "vendors"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_segment": op2_segment,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_media": op10_media,
    "op11_kmeans": op11_kmeans,
    "op12_secret_scan": op12_secret_scan,
    "op13_name_join": op13_name_join,
}

ORACLES: dict[str, str] = {
    "op8_line_dedup": linededup.ORACLE,
    "op11_kmeans": kmeans.ORACLE,
}
