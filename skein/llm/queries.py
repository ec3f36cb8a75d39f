"""The registered queries of this subpackage: one ``opN_<name>`` for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, langid, licenses, media, mixing, neardup, quality, secrets, substring, toxicity
from skein.llm.common import crc_remainder, read_table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), crc_remainder("doc_id", 5) != 0)
    return toxicity.score(docs, model)


def op3_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.remove_repeats(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), crc_remainder("doc_id", 3) != 1)
    return quality.score(docs, model)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs, crc_remainder("doc_id", 4) != 2))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_toxicity": op2_toxicity,
    "op3_repeated_windows": op3_repeated_windows,
    "op4_line_quality": op4_line_quality,
    "op5_minhash": op5_minhash,
    "op6_mix_sources": op6_mix_sources,
    "op7_secrets": op7_secrets,
    "op8_decontaminate": op8_decontaminate,
    "op9_language": op9_language,
    "op10_licenses": op10_licenses,
}

ORACLES: dict[str, str] = {
    "op3_repeated_windows": substring.ORACLE_SQL,
    "op5_minhash": neardup.ORACLE_SQL,
    "op6_mix_sources": mixing.ORACLE_SQL,
}
