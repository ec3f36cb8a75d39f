"""Queries that run a stream over a table that is there now, and naming rules of the dataset build."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein import views
from skein.operators import building, losses
from skein.plans.registry import Registry, rounded
from skein.session import shared_folder
from skein.streaming import queues

REGISTRY = Registry()
add = REGISTRY.add


def _shared(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _event_stream(spark, sf_dir):
    batch = views.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.select(F.col("user_id").cast("string").alias("uid"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))


def _keyed(spark, sf_dir, processor, stream=_event_stream):
    own = spark.newSession()  # the state store is set for this stream alone
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = _shared(spark)
    out = queues.run_keyed(stream(own, sf_dir), processor)
    queues.collect_stream(out, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@add("stream_count_windows", "WITH r AS (SELECT CAST(user_id AS VARCHAR) AS uid, event_id AS seq, event_type AS payload, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS batch, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT uid, batch, seq, payload FROM r WHERE batch < n // 4")
def stream_count_windows(spark, sf_dir):
    return _keyed(spark, sf_dir, queues.CountWindow(4))


@add("stream_bounded_queue", "SELECT CAST(user_id AS VARCHAR) AS uid, count(*) AS produced, greatest(count(*) - 10, 0) AS dropped, least(count(*), 10) AS size, list_sort(list(event_id), 'DESC')[least(count(*), 10)::INTEGER] AS oldest FROM events GROUP BY 1")
def stream_bounded_queue(spark, sf_dir):
    return _keyed(spark, sf_dir, queues.BoundedQueue(10))


@add("stream_dedup", "WITH r AS (SELECT CAST(user_id AS VARCHAR) AS uid, event_id AS seq, row_number() OVER w AS k, event_type, first_value(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT uid, seq, CASE WHEN k = 1 THEN 'accepted' WHEN event_type = f THEN 'repeat' ELSE 'conflict' END AS verdict FROM r")
def stream_dedup(spark, sf_dir):
    return _keyed(spark, sf_dir, queues.DedupQueue())


@add("image_names", "SELECT o_orderkey, 'docker.io/swerebench/sweb.eval.x86_64.' || lower(o_orderstatus) || '_1776_' || o_orderkey || ':latest' AS image, 'swerebench_sweb.eval.x86_64.' || lower(o_orderstatus) || '_1776_' || o_orderkey || '_latest.tar' AS archive FROM orders")
def image_names(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderstatus", F.lit("__"), F.col("o_orderkey").cast("string")).alias("i"))
    named = o.withColumn("image", building.image_name(F.col("i"), F.lit("SWE_rebench"), F.lit(None).cast("string")))
    return named.select("o_orderkey", "image", building.archive_name(F.col("image"), F.lit("SWE_rebench")).alias("archive"))


@add("problem_texts", "SELECT doc_id, md5(CASE WHEN source = 'src1' THEN text || chr(10) || chr(10) || 'Requirements:' || chr(10) || lang || chr(10) || chr(10) || 'New interfaces introduced:' || chr(10) || source ELSE text END) AS digest FROM documents")
def problem_texts(spark, sf_dir):
    kind = F.when(F.col("source") == "src1", "SWE-bench_Pro").otherwise("other")
    return views.table(spark, sf_dir, "documents").select("doc_id", F.md5(building.problem_text(F.col("text"), kind, F.col("lang"), F.col("source")).cast("binary")).alias("digest"))


@add("reverse_kl_loss", f"{views.with_views('v_token')} SELECT round(sum((lp - ref_lp) * mask) / sum(mask), 6) AS loss FROM v_token")
def reverse_kl_loss(spark, sf_dir):
    return rounded(losses.reverse_kl(views.tokens(spark, sf_dir)), "loss")


@add("bypass_loss", f"""{views.with_views('v_token')}, r AS (SELECT *, lp - roll_lp AS g, exp(least(greatest(lp - roll_lp, -20), 20)) AS r, CASE WHEN 0.5 * (lp - roll_lp) ** 2 <= 0.001 THEN mask ELSE 0 END AS k FROM v_token)
SELECT round(sum(-adv * lp * least(r * mask, 2.0) * k) / sum(k), 6) AS loss FROM r""")
def bypass_loss(spark, sf_dir):
    return rounded(losses.bypass_loss(views.tokens(spark, sf_dir), options="token_k2", thresholds=0.001, mode="token-mean"), "loss")
