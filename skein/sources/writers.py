"""Writers: guarded tables, sorted dumps, step files, metric logs, and the key-value store of trajectory columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_table(df: DataFrame, path: str, overwrite: bool = False, by: str | None = None) -> DataFrame:
    """Writes Parquet, refusing to replace unless told to; returns one row with the count and a content hash.

    The hash is a sum of row hashes, so it depends neither on order nor on files. With ``by`` there is a row for each
    value of that column, a source for instance.
    """
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return fingerprint(df.sparkSession.read.parquet(path), *([by] if by else []))


def fingerprint(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content_hash"))


def with_responses(tasks: DataFrame, responses: Column) -> DataFrame:
    """A task table with the list of responses that a model gave to each row."""
    return tasks.withColumn("responses", responses)


def dump_sorted(df: DataFrame, path: str, *order: str, extra: dict[str, DataFrame] | None = None, key: str = "row_id") -> None:
    """JSON lines in the order of the keys, over all part files.

    ``extra`` has further columns as tables of (key, name); one that has not as many rows as ``df`` is left out.
    """
    for name, column in (extra or {}).items():
        if column.count() == df.count():
            df = df.join(column.select(key, name), key, "left")
    df.orderBy(*(order or ("uid", "session_id", "index"))).write.mode("overwrite").json(path)


def write_step(df: DataFrame, root: str) -> None:
    """Rows with ``phase`` and ``step``: replaces just the steps they hold, so a resumed run writes the same files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("phase", "step").json(root)


def long_metrics(wide: DataFrame, step: str = "step") -> DataFrame:
    """step, metric, value out of one column per metric."""
    names = [c for c in wide.columns if c != step]
    return wide.select(step, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([step], names, "metric", "value")


def fan_out(metrics: DataFrame, sinks: dict[str, Callable[[DataFrame], object]]) -> dict[str, object]:
    """Hands a table of metrics to each named sink, what one returns or raises under its name; one that fails stops no other."""
    out: dict[str, object] = {}
    for name, sink in sinks.items():
        try:
            out[name] = sink(metrics)
        except Exception as why:  # a tracker that is down must not end a run
            out[name] = why
    return out


def log_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").json(path)


def show_metrics(metrics: DataFrame) -> str:
    """The console form: one line per step with its metrics in order of name; steps are read one partition at a time."""
    lines = metrics.groupBy("step").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", "value"))), lambda m: F.format_string("%s:%.6f", m["metric"], m["value"])), " - ").alias("m"))
    return "\n".join(f"step:{r.step} - {r.m}" for r in lines.orderBy("step").toLocalIterator())


def flattened(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested structs as columns with joined names."""

    def leaves(schema: StructType, prefix: str, name: str) -> list[Column]:
        out = []
        for f in schema.fields:
            path, label = f"{prefix}`{f.name}`", f"{name}{f.name}"
            out += leaves(f.dataType, path + ".", label + separator) if isinstance(f.dataType, StructType) else [F.col(path).alias(label)]
        return out

    return df.select(*leaves(df.schema, "", ""))


def sample_table(df: DataFrame, n: int, seed: int = 42, column: str = "input") -> DataFrame:
    """n rows in a seeded order of their inputs, the same on every run."""
    return df.orderBy(F.md5(F.concat(F.col(column).cast("string"), F.lit(f"/{seed}")).cast("binary")), column).limit(n)


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def manifest(df: DataFrame, path: str, key: str, *columns: str, order: str = "row_id") -> DataFrame:
    """The first row of each key, written as JSON."""
    picked = df.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("r")).select(key, "r.*")
    picked.write.mode("overwrite").json(path)
    return picked


class TrajectoryStore:
    """Columns of trajectories keyed by (partition_id, key), a Parquet folder per set of columns.

    Putting adds a set; getting joins the sets that the wanted fields need and prunes the rest.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def put(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition_id").parquet(f"{self.root}/{name}")

    def get(self, keys: DataFrame, partition_id: str, fields: dict[str, list[str]]) -> DataFrame:
        """fields: the wanted columns of each set."""
        out = keys.select("key").distinct()
        for name, columns in fields.items():
            out = out.join(self.spark.read.parquet(f"{self.root}/{name}").filter(F.col("partition_id") == partition_id).select("key", *columns), "key")
        return out

    def keys(self, name: str, partition_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}").filter(F.col("partition_id") == partition_id).select("key")

    def clear(self, name: str, partition_id: str, keys: DataFrame) -> None:
        whole = self.spark.read.parquet(f"{self.root}/{name}")
        kept = whole.filter(F.col("partition_id") == partition_id).join(keys.select("key"), "key", "left_anti")
        spare = f"{self.root}/{name}__next"
        kept.write.mode("overwrite").parquet(spare)
        self.put(self.spark.read.schema(whole.schema).parquet(spare), name)
