"""Queries that write tables with each writer and read them back with each reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein import views
from skein.functions import text as T
from skein.operators import joins
from skein.plans.registry import Registry
from skein.session import shared_folder
from skein.sources import readers, writers

REGISTRY = Registry()
add = REGISTRY.add
NARROW = "doc_id long, lang string, source string, n_chars long"


def folder(spark) -> str:
    return f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"


def docs(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


@add("read_formats", "SELECT kind, doc_id, lang, source, n_chars::BIGINT AS n_chars FROM documents, (SELECT unnest(['csv', 'jsonl', 'parquet', 'folder']) AS kind)")
def read_formats(spark, sf_dir):
    root, df, out = folder(spark), docs(spark, sf_dir), None
    df.write.option("header", True).csv(f"{root}/t.csv")
    df.write.json(f"{root}/t.jsonl")
    df.write.parquet(f"{root}/t.parquet")
    df.write.parquet(f"{root}/t")
    for kind, name, schema in (("csv", "t.csv", NARROW), ("jsonl", "t.jsonl", NARROW), ("parquet", "t.parquet", None), ("folder", "t", None)):
        part = readers.read_source(spark, f"{root}/{name}", schema).select(F.lit(kind).alias("kind"), "doc_id", "lang", "source", "n_chars")
        out = part if out is None else out.unionByName(part)
    return out


@add("read_training", "SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM documents")
def read_training(spark, sf_dir):
    root, df = folder(spark), docs(spark, sf_dir)
    df.filter("doc_id % 2 = 0").select("doc_id", "source", "lang").write.parquet(f"{root}/a.parquet")
    df.filter("doc_id % 2 = 1").select("doc_id", "source").write.parquet(f"{root}/b.parquet")
    return readers.read_training(spark, [f"{root}/a.parquet", f"{root}/b.parquet"])


@add("read_preferences", "SELECT c_name AS prompt, c_mktsegment AS chosen, c_custkey AS rejected FROM customer")
def read_preferences(spark, sf_dir):
    root = folder(spark)
    views.table(spark, sf_dir, "customer").select(F.col("c_name").alias("q"), F.col("c_mktsegment").alias("good"), F.col("c_custkey").alias("bad"), "c_acctbal").write.parquet(f"{root}/p.parquet")
    return readers.read_preferences(spark, [f"{root}/p.parquet"], "q", "good", "bad")


@add("read_dialogs", "SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS said, NULL::VARCHAR AS tools, NULL::BOOLEAN AS enable_thinking FROM conversations GROUP BY conv_id")
def read_dialogs(spark, sf_dir):
    root = folder(spark)
    turns = views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    turns.withColumn("messages", F.struct("conv_id", F.col("messages").alias("turns"))).write.parquet(f"{root}/d.parquet")
    read = readers.read_dialogs(spark, [f"{root}/d.parquet"])
    said = F.array_join(F.transform("messages.turns", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|")
    return read.select("messages.conv_id", said.alias("said"), "tools", "enable_thinking")


@add("read_responses", "SELECT source AS data_source, lang AS responses, doc_id AS reward_model FROM documents")
def read_responses(spark, sf_dir):
    root = folder(spark)
    docs(spark, sf_dir).select(F.col("source").alias("data_source"), F.col("lang").alias("responses"), F.col("doc_id").alias("reward_model"), "n_chars").write.parquet(f"{root}/r.parquet")
    return readers.read_responses(spark, f"{root}/r.parquet")


@add("generate_and_write", "SELECT doc_id, lang || '|' || source AS responses FROM documents")
def generate_and_write(spark, sf_dir):
    """A generation job: a task table gets its responses and is written."""
    root = folder(spark)
    answered = writers.with_responses(docs(spark, sf_dir).select("doc_id", "lang", "source"), F.array("lang", "source"))
    writers.write_table(answered, f"{root}/g.parquet")
    return readers.read_source(spark, f"{root}/g.parquet").select("doc_id", F.array_join("responses", "|").alias("responses"))


@add("read_ids", "SELECT DISTINCT form, CAST(source || '__' || doc_id % 97 AS VARCHAR) AS instance_id FROM documents, (SELECT unnest(['nested', 'plain', 'lines', 'list']) AS form)")
def read_ids(spark, sf_dir):
    root = folder(spark)
    ids = docs(spark, sf_dir).select(F.concat("source", F.lit("__"), (F.col("doc_id") % 97).cast("string")).alias("instance_id"))
    ids.select(F.struct("instance_id", F.lit(1).alias("n")).alias("extra_info")).write.parquet(f"{root}/nested.parquet")
    ids.write.parquet(f"{root}/plain.parquet")
    ids.unionByName(spark.createDataFrame([("",), ("  ",)], ids.schema)).write.text(f"{root}/lines.txt")
    lists = ids.distinct().groupBy(F.pmod(F.xxhash64("instance_id"), F.lit(8)).alias("k")).agg(F.to_json(F.collect_list("instance_id")).alias("value"))
    lists.select("value").repartition(8, "value").write.text(f"{root}/list.json", lineSep=" ")
    out = None
    for form, name in (("nested", "nested.parquet"), ("plain", "plain.parquet"), ("lines", "lines.txt")):
        part = readers.read_ids(spark, f"{root}/{name}").select(F.lit(form).alias("form"), "instance_id")
        out = part if out is None else out.unionByName(part)
    listed = spark.read.text(f"{root}/list.json", lineSep=" ").select(F.explode(F.from_json("value", "array<string>")).alias("instance_id"))
    return out.unionByName(listed.distinct().select(F.lit("list").alias("form"), "instance_id"))


@add("read_prefixes", "SELECT o_orderkey FROM orders WHERE split_part(o_orderpriority, '-', 1) IN ('2', '5')")
def read_prefixes(spark, sf_dir):
    root = folder(spark)
    spark.createDataFrame([("# allowed",), ("2",), ("",), ("  5 ",), ("2",)], "value string").write.text(f"{root}/allow.txt")
    return joins.keep_prefixes(views.table(spark, sf_dir, "orders"), "o_orderpriority", readers.read_prefixes(spark, f"{root}/allow.txt"), "-").select("o_orderkey")


@add("existing_files", "SELECT doc_id, source FROM documents WHERE source IN (SELECT DISTINCT source FROM documents WHERE doc_id % 3 = 0) AND source <> (SELECT min(source) FROM documents)")
def existing_files(spark, sf_dir):
    """Rows whose archive is there: a file for each source but the first."""
    root, df = folder(spark), docs(spark, sf_dir)
    first = df.agg(F.min("source").alias("s"))
    kept = df.filter("doc_id % 3 = 0").join(F.broadcast(first), F.col("source") != F.col("s")).select("source", F.lit("x").alias("value"))
    kept.repartition("source").write.partitionBy("source").text(f"{root}/archives")
    files = readers.list_files(spark, f"{root}/archives", "*.txt").select(F.regexp_extract("path", r"source=([^/]+)/", 1).alias("source"))
    return joins.keep_ids(df, files, "source").select("doc_id", "source")


@add("write_table", "SELECT source, count(*) AS rows FROM documents GROUP BY source")
def write_table(spark, sf_dir):
    root, df = folder(spark), docs(spark, sf_dir)
    writers.write_table(df.limit(0), f"{root}/t.parquet")
    made = writers.write_table(df, f"{root}/t.parquet", overwrite=True, by="source")
    again = writers.fingerprint(df.repartition(7), "source").withColumnsRenamed({"rows": "n", "content_hash": "h"})
    same = made.join(again, "source").filter("rows = n AND content_hash = h")  # the hash depends neither on order nor on files
    return same.select("source", "rows")


@add("dump_sorted", "SELECT uid, session_id, \"index\", score FROM (SELECT o_custkey AS uid, o_orderkey % 4 AS session_id, o_orderkey % 3 AS \"index\", o_orderkey AS score FROM orders)")
def dump_sorted(spark, sf_dir):
    root, k = folder(spark), F.col("o_orderkey")
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), (k % 4).alias("session_id"), (k % 3).alias("index"), k.alias("row_id"))
    extra = {"score": rows.select("row_id", F.col("row_id").alias("score")), "short": rows.filter("uid = 1").select("row_id", F.lit(1).alias("short"))}
    writers.dump_sorted(rows, f"{root}/dump", extra=extra)
    read = spark.read.schema("uid long, session_id long, index long, score long, short long").json(f"{root}/dump")
    return read.select("uid", "session_id", "index", "score", *(["short"] if read.filter("short IS NOT NULL").head(1) else []))


@add("write_step", "SELECT 'train' AS phase, user_id % 4 AS step, count(*) + CASE WHEN user_id % 4 = 2 THEN 1000 ELSE 0 END AS n FROM events GROUP BY user_id % 4")
def write_step(spark, sf_dir):
    """A resumed run writes one step again and leaves the others."""
    root = folder(spark)
    rows = views.events(spark, sf_dir).groupBy(F.lit("train").alias("phase"), (F.col("uid") % 4).alias("step")).agg(F.count("*").alias("n"))
    writers.write_step(rows, f"{root}/steps")
    writers.write_step(rows.filter("step = 2").withColumn("n", F.col("n") + 1000), f"{root}/steps")
    return spark.read.schema("n long, phase string, step long").json(f"{root}/steps").select("phase", "step", "n")


@add("metric_log", "SELECT user_id % 10 AS step, unnest(['loss', 'reward']) AS metric, unnest([sum(event_id)::DOUBLE, count(*)::DOUBLE]) AS value FROM events GROUP BY user_id % 10")
def metric_log(spark, sf_dir):
    root = folder(spark)
    wide = views.events(spark, sf_dir).groupBy((F.col("uid") % 10).alias("step")).agg(F.sum("event_id").alias("loss"), F.count("*").alias("reward"))
    long = writers.long_metrics(wide)
    done = writers.fan_out(long, {"file": lambda m: writers.log_metrics(m, f"{root}/log"), "down": lambda m: 1 // 0, "console": writers.show_metrics})
    if not isinstance(done["down"], ZeroDivisionError) or len(done["console"].splitlines()) != wide.count():
        raise ValueError("a sink that fails must be reported and stop no other")
    return spark.read.schema("step long, metric string, value double").json(f"{root}/log")


@add("tracker_keys", "SELECT c_custkey, 'a_at_b/' || lower(c_mktsegment) || '_' || c_custkey AS key FROM customer")
def tracker_keys(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    return c.select("c_custkey", T.sanitised_key(F.concat(F.lit("a@b//"), F.lower("c_mktsegment"), F.lit("#"), F.col("c_custkey").cast("string"))).alias("key"))


@add("flat_config", "SELECT doc_id AS \"id\", lang AS \"data/lang\", n_chars::BIGINT AS \"data/size/chars\" FROM documents")
def flat_config(spark, sf_dir):
    d = docs(spark, sf_dir)
    return writers.flattened(d.select(F.col("doc_id").alias("id"), F.struct("lang", F.struct(F.col("n_chars").alias("chars")).alias("size")).alias("data")))


@add("sample_table", "SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '/42'), doc_id LIMIT 50")
def sample_table(spark, sf_dir):
    return writers.sample_table(docs(spark, sf_dir).select("doc_id", "lang"), 50, column="doc_id")


@add("image_manifest", "SELECT o_custkey AS image, min(o_orderkey) AS instance, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey")
def image_manifest(spark, sf_dir):
    root = folder(spark)
    o = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("instance"), F.col("o_orderpriority").alias("priority"))
    writers.manifest(o, f"{root}/m", "image", "instance", "priority", order="instance")
    return spark.read.schema("image long, instance long, priority string").json(f"{root}/m")


@add("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return writers.status_counts(views.table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"))


@add("trajectory_store", "SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice::DOUBLE AS score FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 5 <> 0")
def trajectory_store(spark, sf_dir):
    """Two sets of columns of two partitions; some keys of one partition are cleared, the rest is joined."""
    store = writers.TrajectoryStore(spark, folder(spark))
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 2).cast("string").alias("partition_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("score"))
    store.put(o.select("partition_id", "key", "status"), "tags")
    store.put(o.select("partition_id", "key", "score"), "scores")
    store.clear("tags", "0", o.filter("key % 5 = 0").select("key"))
    return store.get(store.keys("tags", "0"), "0", {"tags": ["status"], "scores": ["score"]})
