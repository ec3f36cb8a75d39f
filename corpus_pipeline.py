"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Defined results: documents without a text are scored as empty ones, are in no group and in no mix (their size is 0);
rows that repeat an id are judged one by one for toxicity and benchmark items, stay or go together in near-duplicates,
where rows equal in every column become one, and are sampled one by one; rows without an id are in no group; texts of
any length are read whole; further columns are kept, but for those named like a result of the mix; without labels
nothing is toxic, without a benchmark nothing is contaminated, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, mixing, neardup, secrets, toxicity
from skein.llm.common import crc_remainder, read_table, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), crc_remainder("doc_id", 5) != 0)
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return neardup.first_of_groups(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_benchmark(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a placeholder; every document stays."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes."""
    return mixing.emit_copies(mixing.mix_sources(docs)).drop("copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("mixing", mix),
]

#: Trained models have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:  # nothing reads it any more
            target = spark._jvm.org.apache.hadoop.fs.Path(before)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        before = path
    return docs
