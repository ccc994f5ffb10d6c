"""The operators' queries over their whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiverlog.llm import compression_rules as rules
from quiverlog.llm import decontaminate, packing, probminhash, quality_net, sharding, suffix_dedup, token_counts, token_output, warc
from quiverlog.llm.common import documents_of
from quiverlog.llm.oracles import ORACLES


def op1_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(documents_of(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents_of(spark, sf_dir), documents_of(spark, sf_dir, "benchmark")).drop("key_a", "key_b")


def op3_cover_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(documents_of(spark, sf_dir))


def op4_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_round_trip(documents_of(spark, sf_dir))


def op5_linear_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_pieces(documents_of(spark, sf_dir))


def op6_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents_of(spark, sf_dir))


def op7_byte_convolution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.quality_scores(documents_of(spark, sf_dir), documents_of(spark, sf_dir, "labels"))


def op8_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.compression_rules(documents_of(spark, sf_dir))


def op9_probability_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(documents_of(spark, sf_dir)).select("doc_id", "class_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents_of(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_content_addressed_warc, op2_ngram_decontamination, op3_cover_suffix_repeats, op4_arrow_token_files, op5_linear_piece_counts, op6_prefix_sum_shards, op7_byte_convolution_quality, op8_compression_bands, op9_probability_minhash_classes, op10_best_fit_packing)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
