"""Readers of task tables, id lists and dialogs."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {".parquet": "parquet", ".json": "json", ".jsonl": "json", ".csv": "csv"}


def read_source(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file or folder by its extension; a folder without one is Parquet. A hub name or another extension raises."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix and suffix not in FORMATS:
        raise ValueError(f"no reader for {suffix!r}")
    if not suffix and "/" in path and not path.startswith(("/", ".")) and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        raise ValueError(f"{path!r} looks like a hub name; there is no network reader")
    kind = FORMATS.get(suffix, "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if suffix == ".json":
        return reader.option("multiLine", True).json(path)
    return reader.format(kind).load(path)


def read_training(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Several files as one table; columns that one lacks are null."""
    out = None
    for path in paths:
        part = read_source(spark, path, schema)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def read_preferences(spark: SparkSession, paths: list[str], prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    return read_training(spark, paths).select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


def read_dialogs(spark: SparkSession, paths: list[str], messages: str = "messages") -> DataFrame:
    """Messages, and the optional columns ``tools`` and ``enable_thinking`` as nulls where there are none."""
    df = read_training(spark, paths)
    extra = [(F.col(c) if c in df.columns else F.lit(None).cast(kind)).alias(c) for c, kind in (("tools", "string"), ("enable_thinking", "boolean"))]
    return df.select(F.col(messages).alias("messages"), *extra)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("data_source", "responses", "reward_model")


def read_ids(spark: SparkSession, path: str, field: str = "instance_id") -> DataFrame:
    """Distinct ids of a Parquet table (``extra_info`` or a plain column), of a JSON list, or of a text, one per line."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".parquet":
        df = spark.read.parquet(path)
        ids = df.select(F.col(f"extra_info.{field}").alias(field)) if "extra_info" in df.columns else df.select(field)
    elif suffix == ".json":
        text = spark.read.text(path, wholetext=True)
        ids = text.select(F.explode(F.from_json("value", "array<string>")).alias(field))
    else:
        ids = spark.read.text(path).select(F.trim("value").alias(field)).filter(F.col(field) != "")
    return ids.filter(F.col(field).isNotNull()).distinct()


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """The prefixes of an allow list; blank lines and # comments do not count, an empty list raises."""
    rows = spark.read.text(path).select(F.trim("value").alias("prefix")).filter((F.col("prefix") != "") & ~F.col("prefix").startswith("#")).distinct()
    if rows.isEmpty():
        raise ValueError("the list of prefixes is empty")
    return rows


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, name, length of files, for filters by existence. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
