"""Queries over batches: selection, reshaping, joins by membership, deduplication, sampling, routing and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import views
from skein.operators import frames, joins, packing
from skein.plans.registry import Registry, rounded

REGISTRY = Registry()
add = REGISTRY.add
D = "WITH d AS (SELECT doc_id AS row_id, source AS uid, n_chars AS seqlen, lang FROM documents)"


def docs(spark, sf_dir):
    return views.sequences(spark, sf_dir).drop("text")


@add("slice_rows", f"{D} SELECT (row_id - 10) // 3 AS row_id, uid, seqlen, lang FROM d WHERE row_id >= 10 AND row_id < (SELECT max(row_id) + 1 FROM d) - 5 AND (row_id - 10) % 3 = 0")
def slice_rows(spark, sf_dir):
    return frames.slice_rows(docs(spark, sf_dir), 10, -5, 3)


@add("select_rows", f"{D}, n AS (SELECT count(*) AS n FROM d), i AS (SELECT row_id AS position, row_id * 7 % n AS idx FROM d, n UNION ALL SELECT n + row_id, n - 1 - row_id FROM d, n) SELECT position AS row_id, uid, seqlen, lang FROM i JOIN d ON d.row_id = i.idx")
def select_rows(spark, sf_dir):
    df = docs(spark, sf_dir)
    n = frames.size_of(df)
    twice = spark.range(2 * n).select(F.col("id").alias("position"), F.when(F.col("id") < n, F.col("id") * 7 % n).otherwise(2 * n - 1 - F.col("id")).alias("index"))
    return frames.select_rows(df, twice)


@add("union_columns", "SELECT doc_id AS row_id, lang, n_chars AS seqlen, source AS uid FROM documents")
def union_columns(spark, sf_dir):
    df = docs(spark, sf_dir)
    return frames.union_columns(df.select("row_id", "lang", "uid"), df.select("row_id", "uid", "seqlen")).select("row_id", "lang", "seqlen", "uid")


@add("rename_and_prefix", f"{D} SELECT row_id, uid AS in_group, seqlen AS in_tokens, lang AS in_lang FROM d")
def rename_and_prefix(spark, sf_dir):
    return frames.prefix_columns(frames.rename(docs(spark, sf_dir), ["uid", "seqlen"], ["group", "tokens"]), "in_", "row_id")


@add("concat_batches", f"{D}, n AS (SELECT count(*) AS n FROM d) SELECT row_id, uid, seqlen FROM d UNION ALL SELECT row_id + n, uid, NULL FROM d, n")
def concat_batches(spark, sf_dir):
    df = docs(spark, sf_dir).drop("lang")
    return frames.concat(df, df.drop("seqlen"), missing=True)


@add("chunk_rows", f"{D} SELECT row_id, row_id // ((SELECT count(*) FROM d) // 4) AS chunk FROM d")
def chunk_rows(spark, sf_dir):
    return frames.chunk_number(docs(spark, sf_dir), 4, rest=True).select("row_id", "chunk")


@add("split_and_batches", f"{D} SELECT row_id, row_id // 48 AS batch FROM d WHERE row_id // 48 < (SELECT count(*) FROM d) // 48")
def split_and_batches(spark, sf_dir):
    return frames.batches(docs(spark, sf_dir), 48).select("row_id", "batch")


@add("dataset_split", f"{D} SELECT row_id, row_id // ((SELECT count(*) FROM d) // 7) AS part FROM d WHERE row_id // ((SELECT count(*) FROM d) // 7) < 7")
def dataset_split(spark, sf_dir):
    return frames.dataset_split(docs(spark, sf_dir), 7).select("row_id", "part")


@add("repeat_interleaved", f"{D} SELECT row_id * 3 + r AS row_id, uid, seqlen FROM d, (SELECT unnest([0, 1, 2]) AS r)")
def repeat_interleaved(spark, sf_dir):
    return frames.repeat(docs(spark, sf_dir), 3).select("row_id", "uid", "seqlen")


@add("repeat_tiled", f"{D}, n AS (SELECT count(*) AS n FROM d) SELECT r * n + row_id AS row_id, uid FROM d, n, (SELECT unnest([0, 1]) AS r)")
def repeat_tiled(spark, sf_dir):
    return frames.repeat(docs(spark, sf_dir), 2, interleave=False).select("row_id", "uid")


@add("repeat_each", f"{D} SELECT row_id, r AS rep FROM d, (SELECT unnest([0, 1, 2, 3]) AS r) WHERE r < row_id % 4")
def repeat_each(spark, sf_dir):
    return frames.repeat_each(docs(spark, sf_dir), F.col("row_id") % 4).select("row_id", "rep")


@add("pad_to_divisor", f"{D}, n AS (SELECT count(*) AS n, (-count(*)) % 64 + CASE WHEN (-count(*)) % 64 < 0 THEN 64 ELSE 0 END AS p FROM d) SELECT row_id, seqlen, false AS is_padding FROM d UNION ALL SELECT row_id + n, seqlen, true FROM d, n WHERE row_id < p")
def pad_to_divisor(spark, sf_dir):
    return frames.pad_to_divisor(docs(spark, sf_dir), 64).select("row_id", "seqlen", "is_padding")


@add("pad_with_no_ops", f"{D}, n AS (SELECT count(*) AS n, (96 - count(*) % 96) % 96 AS p FROM d) SELECT row_id, uid, seqlen, false AS is_padding FROM d UNION ALL SELECT n + i, 'padding', 1, true FROM n, (SELECT unnest(range(96)) AS i) WHERE i < p")
def pad_with_no_ops(spark, sf_dir):
    return frames.pad_with_no_ops(docs(spark, sf_dir).drop("lang"), 96, {"uid": F.lit("padding"), "seqlen": F.lit(1).cast("long")})


@add("fold_groups", f"{D}, f AS (SELECT row_id // ((SELECT count(*) FROM d) // 10) AS \"group\", array_to_string(list(seqlen ORDER BY row_id), ',') AS lens FROM d GROUP BY 1) SELECT * FROM f")
def fold_groups(spark, sf_dir):
    made = frames.fold(docs(spark, sf_dir), 10, "seqlen")
    return made.select("group", F.array_join(F.transform("seqlen", lambda x: x.cast("string")), ",").alias("lens"))


@add("collate_turns", "SELECT conv_id, array_to_string(list(role ORDER BY turn), ',') AS roles FROM conversations GROUP BY conv_id")
def collate_turns(spark, sf_dir):
    made = frames.collate(views.table(spark, sf_dir, "conversations"), "conv_id", "role", order="turn")
    return made.select("conv_id", F.array_join("role", ",").alias("roles"))


_ARR = f"{views.with_views('v_token')}, a AS (SELECT traj, list(reward ORDER BY pos) AS r, list(mask ORDER BY pos) AS m FROM v_token GROUP BY traj)"
_TXT = "array_to_string(list_transform({}, lambda x: CAST(CAST(round(x * 100) AS INTEGER) AS VARCHAR)), ',')"


def _text(c):
    return F.array_join(F.transform(c, lambda x: F.round(x * 100).cast("int").cast("string")), ",")


@add("ragged_cells", f"{_ARR} SELECT traj, {_TXT.format('list_filter(r, lambda x, i: m[i] <> 0)')} AS cells FROM a")
def ragged_cells(spark, sf_dir):
    return views.trajectories(spark, sf_dir).select("traj", _text(frames.ragged("reward", "mask")).alias("cells"))


@add("padded_cells", f"{_ARR} SELECT traj, {_TXT.format('list_concat(list_transform(range(greatest(10 - len(r), 0)), lambda x: -1.0::DOUBLE), r)')} AS cells FROM a")
def padded_cells(spark, sf_dir):
    return views.trajectories(spark, sf_dir).select("traj", _text(frames.padded("reward", 10, -1.0, "left")).alias("cells"))


@add("truncated_cells", f"{_ARR} SELECT traj, {_TXT.format('CASE WHEN len(r) <= 5 THEN r ELSE list_concat(r[1:2], r[len(r) - 2:len(r)]) END')} AS middle, {_TXT.format('CASE WHEN len(r) <= 5 THEN r ELSE r[len(r) - 4:len(r)] END')} AS tail, {_TXT.format('r[1:5]')} AS head FROM a")
def truncated_cells(spark, sf_dir):
    return views.trajectories(spark, sf_dir).select("traj", *[_text(frames.truncated("reward", 5, mode)).alias(n) for n, mode in (("middle", "middle"), ("tail", "left"), ("head", "right"))])


@add("eos_mask", "WITH a AS (SELECT l_orderkey AS traj, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY l_orderkey) SELECT traj, array_to_string(list_transform(ids, lambda x, i: CASE WHEN list_position(ids, 3) IS NULL OR list_position(ids, 3) = 0 OR i <= list_position(ids, 3) THEN '1' ELSE '0' END), '') AS mask FROM a")
def eos_mask(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("traj")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    ids = li.select("traj", F.transform("x", lambda x: x["l_linenumber"].cast("long")).alias("ids"))
    return ids.select("traj", F.array_join(F.transform(frames.eos_mask("ids", 3), lambda x: x.cast("string")), "").alias("mask"))


@add("last_position_reward", f"{views.with_views('v_token')} SELECT traj, pos::INTEGER AS pos, CASE WHEN pos = max(pos) OVER (PARTITION BY traj) THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM v_token")
def last_position_reward(spark, sf_dir):
    return views.trajectories(spark, sf_dir).select("traj", F.posexplode(frames.last_position_reward(F.col("reward"), F.lit(1.5))).alias("pos", "score"))


# --- joins


@add("semi_filter", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_filter(spark, sf_dir):
    good = views.table(spark, sf_dir, "labels").filter("quality = 1")
    return joins.keep_ids(views.table(spark, sf_dir, "documents"), good, "doc_id").select("doc_id", "source")


@add("anti_filter", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (quality = 0 OR toxic = 1))")
def anti_filter(spark, sf_dir):
    labels = views.table(spark, sf_dir, "labels")
    return joins.drop_ids(views.table(spark, sf_dir, "documents"), "doc_id", labels.filter("quality = 0"), labels.filter("toxic = 1")).select("doc_id", "source")


@add("prefix_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE split_part(o_orderpriority, '-', 1) IN ('1', '3')")
def prefix_filter(spark, sf_dir):
    allowed = spark.createDataFrame([("1",), ("3",)], "prefix string")
    return joins.keep_prefixes(views.table(spark, sf_dir, "orders"), "o_orderpriority", allowed, "-").select("o_orderkey", "o_orderpriority")


@add("length_filter", "SELECT doc_id, n_chars FROM documents WHERE n_chars <= 1500")
def length_filter(spark, sf_dir):
    return joins.keep_short(views.table(spark, sf_dir, "documents"), F.col("n_chars"), 1500).select("doc_id", "n_chars")


@add("coalesce_fields", "SELECT d.doc_id, coalesce(l.quality, l.toxic, -1) AS grade, coalesce(CASE WHEN d.n_chars % 5 = 0 THEN NULL ELSE d.n_chars / 2.0::DOUBLE END, 0.0::DOUBLE) AS half FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality END AS quality, toxic FROM labels) l ON d.doc_id = l.doc_id")
def coalesce_fields(spark, sf_dir):
    labels = views.table(spark, sf_dir, "labels").withColumn("quality", F.when(F.col("doc_id") % 3 != 0, F.col("quality")))
    df = views.table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("h", F.when(F.col("n_chars") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars") / 2.0))
    return joins.coalesce_fields(df, {"grade": (["quality", "absent", "toxic"], -1), "half": (["h"], 0.0)}).select("doc_id", "grade", "half")


@add("lookup_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_join(spark, sf_dir):
    customers = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.lookup(views.table(spark, sf_dir, "orders"), customers, "o_custkey").select("o_orderkey", "c_mktsegment")


@add("upsert_columns", "SELECT d.doc_id, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def upsert_columns(spark, sf_dir):
    base = views.table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("toxic"))
    return joins.upsert_columns(base, views.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")


@add("expected_against_seen", """WITH e AS (SELECT DISTINCT c_custkey AS uid FROM customer WHERE c_mktsegment <> 'BUILDING'), g AS (SELECT o_custkey AS uid, count(*) AS n FROM orders GROUP BY 1), j AS (SELECT e.uid AS e, coalesce(g.n, 0) AS n FROM e FULL JOIN g ON e.uid = g.uid)
SELECT sum(CASE WHEN e IS NOT NULL THEN greatest(10 - n, 0) ELSE 0 END)::BIGINT AS missing, sum(CASE WHEN e IS NOT NULL THEN greatest(n - 10, 0) ELSE 0 END)::BIGINT AS excess, sum(CASE WHEN e IS NULL THEN n ELSE 0 END)::BIGINT AS unexpected FROM j""")
def expected_against_seen(spark, sf_dir):
    expected = views.table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("uid"))
    seen = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"))
    return joins.expected_against_seen(expected, seen, "uid", 10)


@add("first_of_key", "SELECT source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def first_of_key(spark, sf_dir):
    return joins.first_of(views.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", order="doc_id")


@add("latest_of_sessions", f"{views.with_views('v_sample')}, r AS (SELECT *, row_number() OVER (PARTITION BY uid, session_id // 3 ORDER BY session_id % 3 DESC, row_id) AS k FROM v_sample WHERE row_id % 11 <> 0) SELECT uid, session_id // 3 AS session, row_id, score FROM r WHERE k = 1")
def latest_of_sessions(spark, sf_dir):
    df = views.samples(spark, sf_dir).select("uid", F.floor(F.col("session_id") / 3).alias("session"), (F.col("session_id") % 3).alias("index"), "row_id", "score", (F.col("row_id") % 11 == 0).alias("is_padding"))
    return joins.latest_of_sessions(df, "uid", "session", padding="is_padding").select("uid", "session", "row_id", "score")


@add("final_turns", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def final_turns(spark, sf_dir):
    return joins.latest_of_sessions(views.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", index="turn", order="turn")


@add("head_rows", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25")
def head_rows(spark, sf_dir):
    return joins.head_rows(views.table(spark, sf_dir, "documents"), 25, "doc_id").select("doc_id", "source")


@add("sample_rows", "SELECT doc_id, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '/42'), doc_id LIMIT 100")
def sample_rows(spark, sf_dir):
    return joins.sample_rows(views.table(spark, sf_dir, "documents"), 100, 42, "doc_id").select("doc_id", "source")


@add("shuffle_pages", "WITH r AS (SELECT item_id, row_number() OVER (ORDER BY md5(CAST(item_id AS VARCHAR) || '/42'), item_id) - 1 AS k FROM (SELECT DISTINCT item_id FROM benchmark)) SELECT item_id, k // 9 + 1 AS page, k % 9 AS place FROM r")
def shuffle_pages(spark, sf_dir):
    return joins.shuffle_pages(views.table(spark, sf_dir, "benchmark"), "item_id", 42, 9)


@add("hash_bucket", "SELECT doc_id, ((('0x' || substr(md5(source), 1, 8))::BIGINT % 7 * (4294967296 % 7) + ('0x' || substr(md5(source), 9, 8))::BIGINT) % 7 * (4294967296 % 7) + ('0x' || substr(md5(source), 17, 8))::BIGINT) % 7 * (4294967296 % 7) % 7 AS part, (((('0x' || substr(md5(source), 1, 8))::BIGINT % 7 * (4294967296 % 7) + ('0x' || substr(md5(source), 9, 8))::BIGINT) % 7 * (4294967296 % 7) + ('0x' || substr(md5(source), 17, 8))::BIGINT) % 7 * (4294967296 % 7) + ('0x' || substr(md5(source), 25, 8))::BIGINT) % 7 AS bucket FROM documents")
def hash_bucket(spark, sf_dir):
    b = joins.hash_bucket("source", 7)
    last = F.conv(F.substring(F.md5(F.col("source").cast("binary")), 25, 8), 16, 10).cast("long")
    return views.table(spark, sf_dir, "documents").select("doc_id", ((b - last % 7 + 7) % 7).alias("part"), b.alias("bucket"))


@add("routed_instances", """WITH RECURSIVE z AS (SELECT source, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS i, greatest(sum(n) OVER () / 4.0, 1e-9)::DOUBLE AS share FROM z),
g AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS source, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS load, []::INTEGER[] AS groups
UNION ALL SELECT i, source, list_transform(load, lambda x, k: CASE WHEN list_contains(chosen, k::INTEGER) THEN x + n / len(chosen) ELSE x END), list_sort(chosen) FROM (SELECT r.i, r.source, r.n, g.load, list_transform(list_sort(list_transform(g.load, lambda x, k: {'l': x, 'k': k}))[1:least(4, greatest(1, ceil(r.n / r.share)))::INTEGER], lambda x: x.k::INTEGER) AS chosen FROM g JOIN r ON r.i = g.i + 1)),
h AS (SELECT doc_id AS row_id, source, source || '__' || doc_id AS instance_id, md5(source || '__' || doc_id) AS m FROM documents)
SELECT row_id, instance_id, groups[(list_reduce([('0x' || substr(m, 1, 8))::BIGINT % len(groups), ('0x' || substr(m, 9, 8))::BIGINT, ('0x' || substr(m, 17, 8))::BIGINT, ('0x' || substr(m, 25, 8))::BIGINT], lambda a, x: (a * (4294967296 % len(groups)) + x) % len(groups)) + 1)::INTEGER] - 1 AS group_id FROM h JOIN g USING (source)""")
def routed_instances(spark, sf_dir):
    df = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "source", F.concat("source", F.lit("__"), F.col("doc_id").cast("string")).alias("instance_id"))
    return joins.route(df, joins.routing_map(df, "source", 4), "source", "instance_id").select("row_id", "instance_id", "group_id")


@add("repo_of_instance", "SELECT doc_id, source AS repo FROM documents")
def repo_of_instance(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", joins.repo_of(F.concat("source", F.lit("__"), F.col("doc_id").cast("string"))).alias("repo"))


@add("set_report", "WITH a AS (SELECT o_custkey AS uid, list_sort(list_distinct(list(o_orderpriority))) AS req, list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'F')) AS got FROM orders GROUP BY o_custkey) SELECT uid, array_to_string(list_filter(req, lambda x: list_contains(coalesce(got, []), x)), '|') AS hit, array_to_string(list_filter(req, lambda x: NOT list_contains(coalesce(got, []), x)), '|') AS missing, len(list_filter(req, lambda x: NOT list_contains(coalesce(got, []), x))) = 0 AS complete FROM a")
def set_report(spark, sf_dir):
    g = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.collect_set("o_orderpriority").alias("req"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("got"))
    r = joins.set_report(F.col("req"), F.col("got"))
    return g.select("uid", F.array_join(r["hit"], "|").alias("hit"), F.array_join(r["missing"], "|").alias("missing"), r["complete"].alias("complete"))


# --- packing


@add("workload", "SELECT doc_id, 24576 * n_chars + n_chars * n_chars AS workload FROM documents")
def workload(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", packing.workload(F.col("n_chars")).alias("workload"))


@add("balanced_parts")
def balanced_parts(spark, sf_dir):
    return packing.pack_batches(docs(spark, sf_dir), "seqlen", 8, 512)


@add("greedy_parts", """WITH RECURSIVE r AS (SELECT doc_id AS row_id, doc_id // 512 AS batch, row_number() OVER (PARTITION BY doc_id // 512 ORDER BY doc_id) AS i, (24576 * n_chars + n_chars * n_chars)::HUGEINT AS w, count(*) OVER (PARTITION BY doc_id // 512) AS n, sum(24576 * n_chars + n_chars * n_chars) OVER (PARTITION BY doc_id // 512) AS s FROM documents),
g AS (SELECT DISTINCT batch, 0::BIGINT AS i, NULL::BIGINT AS row_id, list_transform(range(8), lambda x: 0::HUGEINT) AS load, NULL::INTEGER AS part FROM r
UNION ALL SELECT batch, i, row_id, list_transform(load, lambda x, k: CASE WHEN k = p THEN x + w ELSE x END), p - 1 FROM (SELECT g.batch, r.i, r.row_id, g.load, list_position(g.load, list_min(g.load))::INTEGER AS p, r.w + CASE WHEN r.n % 8 = 0 THEN r.s + 1 ELSE 0 END AS w FROM g JOIN r ON r.batch = g.batch AND r.i = g.i + 1))
SELECT batch, row_id, part FROM g WHERE i > 0""")
def greedy_parts(spark, sf_dir):
    return packing.pack_batches(docs(spark, sf_dir), "seqlen", 8, 512, method="greedy")


_BATCH = "WITH b AS (SELECT doc_id // 240 AS batch, count(*) AS n, sum(n_chars) AS t FROM documents GROUP BY 1)"


def whole_batches(spark, sf_dir):
    """The rows of whole batches of 240."""
    df = docs(spark, sf_dir)
    return df.filter(F.col("row_id") < F.lit(frames.size_of(df) // 240 * 240))


@add("micro_batches", f"{_BATCH}, c AS (SELECT batch, n, t, greatest(6, least(n // 4, ceil(t / 200000.0))) AS k FROM b WHERE n = 240) SELECT batch, (ceil(k / 5) * 5)::BIGINT AS micro_batches, n AS rows, 0 AS torn, 0 AS uneven FROM c")
def micro_batches(spark, sf_dir):
    """Per batch: micro-batches, rows, groups of four rows that are torn, and how often light ones do not stand at both ends."""
    made = packing.micro_batches_of(whole_batches(spark, sf_dir), "seqlen", 200_000, 240, least=6, divided_by=5, group_size=4)
    rows = made.join(docs(spark, sf_dir), "row_id").withColumn("w", packing.workload(F.col("seqlen")))
    groups = rows.groupBy("batch", F.floor(F.col("row_id") / 4).alias("g")).agg((F.count_distinct("micro_batch") - 1).alias("torn"))
    loads = rows.groupBy("batch", "micro_batch").agg(F.sum("w").alias("w"), F.count("*").alias("n")).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("micro_batch", "w"))).alias("x"), F.sum("n").alias("rows"))
    top = F.array_position("x.w", F.array_max("x.w"))
    ends = F.size(F.filter(F.sequence(F.lit(2), F.size("x")), lambda i: F.when(i <= top, F.col("x.w")[i - 1] < F.col("x.w")[i - 2]).otherwise(F.col("x.w")[i - 1] > F.col("x.w")[i - 2])))
    return loads.join(groups.groupBy("batch").agg(F.sum("torn").alias("torn")), "batch").select("batch", F.size("x").cast("long").alias("micro_batches"), "rows", "torn", ends.alias("uneven"))


@add("batch_balance", f"{_BATCH} SELECT batch, unnest(range(6))::INTEGER AS rank, n // 6 AS rows, n // 6 AS places, 10 AS of_first FROM b WHERE n = 240")
def batch_balance(spark, sf_dir):
    """Per batch and rank: as many rows for each, each at a place of its own, ten of each mini-batch of sixty."""
    made = packing.balanced_batches(whole_batches(spark, sf_dir), "seqlen", 6, 240, mini_batch=60)
    first = F.count_if(F.col("row_id") % 240 < 60).cast("int")
    return made.groupBy("batch", "rank").agg(F.count("*").alias("rows"), F.count_distinct("place").alias("places"), first.alias("of_first"))


@add("group_balanced_parts", f"{_BATCH} SELECT batch, unnest(range(4))::INTEGER AS part, n // 12 AS groups, n // 4 AS rows FROM b WHERE n = 240")
def group_balanced_parts(spark, sf_dir):
    """Per batch and part: as many whole groups of three rows for each."""
    df = whole_batches(spark, sf_dir).withColumn("uid", F.floor(F.col("row_id") / 3))
    made = packing.group_balanced_batches(df, "seqlen", "uid", 4, 240)
    return made.groupBy("batch", "part").agg(F.count_distinct(F.floor(F.col("row_id") / 3)).alias("groups"), F.count("*").alias("rows"))


@add("imbalance", """WITH n AS (SELECT count(*) AS n FROM documents), d AS (SELECT n_chars, (row_number() OVER (ORDER BY doc_id) - 1) * 8 // n AS b, doc_id % 8 AS p FROM documents, n), b AS (SELECT sum(n_chars) AS t FROM d GROUP BY b), p AS (SELECT sum(n_chars) AS t FROM d GROUP BY p)
SELECT (SELECT min(t) FROM b)::BIGINT AS before_min, (SELECT max(t) FROM b)::BIGINT AS before_max, round((SELECT avg(t) FROM b), 6) AS before_mean, (SELECT min(t) FROM p)::BIGINT AS after_min, (SELECT max(t) FROM p)::BIGINT AS after_max, round((SELECT avg(t) FROM p), 6) AS after_mean""")
def imbalance(spark, sf_dir):
    df = docs(spark, sf_dir).withColumn("part", F.col("row_id") % 8)
    return rounded(packing.imbalance(df, "seqlen", "part", 8), "before_mean", "after_mean")


@add("top_k_per_group", "WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) SELECT * FROM r WHERE rank <= 2")
def top_k_per_group(spark, sf_dir):
    return packing.top_k(views.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "n_chars", 2, "source", order="doc_id")


@add("inverse_permutation", "SELECT (doc_id * 7 + 3) % (SELECT count(*) FROM documents) AS position, doc_id AS idx FROM documents")
def inverse_permutation(spark, sf_dir):
    df = views.table(spark, sf_dir, "documents")
    n = df.count()
    return packing.inverse(df.select(F.col("doc_id").alias("position"), ((F.col("doc_id") * 7 + 3) % n).alias("idx")), "position", "idx")


@add("trajectory_keys", f"{views.with_views('v_sample')} SELECT row_id, uid || '_' || session_id || '_0' AS key, CAST(uid AS VARCHAR) AS uid, CAST(session_id AS VARCHAR) AS session_id, 0 AS index FROM v_sample")
def trajectory_keys(spark, sf_dir):
    df = views.samples(spark, sf_dir).withColumn("key", packing.trajectory_key(F.col("uid").cast("string"), F.col("session_id"), F.lit(0)))
    p = packing.parsed_key(F.col("key"))
    return df.select("row_id", "key", p["uid"].alias("uid"), p["session_id"].alias("session_id"), p["index"].alias("index"))
