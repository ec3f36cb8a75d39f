"""Trajectory-shaped views of the benchmark tables, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored trajectory per order: row_id, uid, session_id, score, pred, data_source."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    score = F.when(F.col("o_orderstatus") == "F", F.lit(1.0)).when(F.col("o_orderstatus") == "O", F.lit(0.0)).otherwise(F.lit(-0.2))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("uid"), (F.row_number().over(w) - 1).cast("long").alias("session_id"),
        score.alias("score"), F.col("o_orderpriority").alias("pred"), F.col("o_orderstatus").alias("data_source"),
    )


def tokens(spark: SparkSession, sf_dir: str, orders: Column | None = None, parts: int | None = None) -> DataFrame:
    """One token per order line: uid, traj, pos, reward, value, old_lp, roll_lp, lp, ref_lp, adv, mask.

    ``orders``, a condition on ``l_orderkey``, keeps other orders out before lines are dealt to number them; one on
    ``uid`` would only be met after that. ``parts`` deals orders into just so many partitions, which a copy of the
    tokens keeps; partitions that Spark merges as it likes are dealt anew by each join."""
    q, d, t = (F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax"))
    place = ("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem")
    lines = lines if orders is None else lines.filter(orders)
    lines = lines if parts is None else lines.repartition(parts, "l_orderkey")
    named = lines.select(
        (F.col("l_orderkey") % 500).alias("uid"), F.col("l_orderkey").alias("traj"), *place,
        d.alias("reward"), t.alias("value"), (-q / 50).alias("old_lp"), (-(q + d * 10) / 50).alias("roll_lp"),
        (-(q - t * 20) / 50).alias("lp"), (-(q + t * 5) / 50).alias("ref_lp"), (d * 20 - 1).alias("adv"),
        F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("mask"),
    )
    pos = (F.row_number().over(Window.partitionBy("traj").orderBy(*place)) - 1).cast("long")  # by traj, so that what follows knows how rows are dealt
    return named.withColumn("pos", pos).select("uid", "traj", "pos", "reward", "value", "old_lp", "roll_lp", "lp", "ref_lp", "adv", "mask")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a trajectory as arrays in order of their positions."""
    names = ("reward", "value", "old_lp", "roll_lp", "mask")
    packed = tokens(spark, sf_dir).groupBy("uid", "traj").agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("cells"))
    return packed.select("uid", "traj", *[F.col(f"cells.{n}").alias(n) for n in names])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("uid"), F.col("event_type").alias("event"), "ts", F.col("value").cast("double").alias("value"),
        F.from_json("props", "k int").getField("k").alias("n"),
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("uid"), F.col("n_chars").alias("seqlen"), "lang", "text")


#: The same views in DuckDB, to stand after WITH.
SQL = {
    "v_sample": """v_sample AS (SELECT o_orderkey AS row_id, o_custkey AS uid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS session_id,
  CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE ELSE -0.2::DOUBLE END AS score, o_orderpriority AS pred, o_orderstatus AS data_source FROM orders)""",
    "v_token": """v_token AS (SELECT l_orderkey % 500 AS uid, l_orderkey AS traj, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
  l_discount::DOUBLE AS reward, l_tax::DOUBLE AS value, -(l_quantity::DOUBLE) / 50 AS old_lp, -(l_quantity::DOUBLE + l_discount::DOUBLE * 10) / 50 AS roll_lp,
  -(l_quantity::DOUBLE - l_tax::DOUBLE * 20) / 50 AS lp, -(l_quantity::DOUBLE + l_tax::DOUBLE * 5) / 50 AS ref_lp, l_discount::DOUBLE * 20 - 1 AS adv,
  CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS mask FROM lineitem)""",
    "v_event": """v_event AS (SELECT event_id, user_id AS uid, event_type AS event, ts, value::DOUBLE AS value, CAST(json_extract(props, '$.k') AS INTEGER) AS n FROM events)""",
    "v_seq": """v_seq AS (SELECT doc_id AS row_id, source AS uid, n_chars AS seqlen, lang, text FROM documents)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
