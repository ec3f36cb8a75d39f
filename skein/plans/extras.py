"""Queries over the operators that the other plans do not reach: batches, estimators by name, losses, scores, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import views
from skein.functions import text as T
from skein.operators import building, corrections, diagnostics, estimators, frames, groups, joins, losses, metrics, parsing, rewards, scoring, sequences
from skein.plans.registry import Registry, rounded
from skein.plans.streams import _keyed
from skein.session import checkpointed
from skein.streaming import queues

REGISTRY = Registry()
add = REGISTRY.add
TOKEN = views.with_views("v_token")
#: Up to so many positions of each of 500 prompts, baselines of positions are broadcast; more are joined by a shuffle.
FEW_POSITIONS = 200
D = "WITH d AS (SELECT doc_id AS row_id, source AS uid, n_chars AS seqlen, lang FROM documents), n AS (SELECT count(*) AS n FROM d)"


def docs(spark, sf_dir):
    return views.sequences(spark, sf_dir).drop("text")


# --- batches


@add("pop_columns", "SELECT p.doc_id AS row_id, p.lang, d.source AS uid, d.n_chars AS seqlen, 'none' AS absent FROM documents p JOIN documents d USING (doc_id)")
def pop_columns(spark, sf_dir):
    popped, rest = frames.pop_columns(docs(spark, sf_dir), "lang")
    return popped.join(rest, "row_id").withColumn("absent", frames.column_or(rest, "absent", "none"))


@add("equal_batches", "SELECT * FROM (VALUES ('copy', true), ('changed', false), ('shorter', false)) v(what, same)")
def equal_batches(spark, sf_dir):
    df = docs(spark, sf_dir)
    changed = df.withColumn("seqlen", F.when(F.col("row_id") == 3, F.lit(-1)).otherwise(F.col("seqlen")))
    made = [("copy", frames.equal_batches(df, df.select(*reversed(df.columns)))), ("changed", frames.equal_batches(df, changed)), ("shorter", frames.equal_batches(df, df.filter("row_id > 0")))]
    return spark.createDataFrame(made, "what string, same boolean")


@add("appended_lists", "SELECT user_id AS uid, event_type AS key, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY 1, 2")
def appended_lists(spark, sf_dir):
    rows = views.events(spark, sf_dir).select("uid", F.col("event").alias("key"), F.col("event_id").alias("row_id"), F.col("event_id").cast("string").alias("value"))
    return frames.appended(rows, "uid").select("uid", "key", F.array_join("value", ",").alias("ids"))


@add("constructed", "SELECT * FROM (VALUES (0, 1, 'a'), (1, 2, 'b'), (2, 3, NULL)) v(row_id, x, y) UNION ALL SELECT * FROM (VALUES (0, 7, NULL), (1, NULL, 'z')) w(row_id, x, y)")
def constructed(spark, sf_dir):
    return frames.from_columns(spark, {"x": [1, 2, 3], "y": ["a", "b", None]}, "x long, y string").unionByName(frames.from_rows(spark, [{"x": 7}, {"y": "z"}], "x long, y string"))


@add("unfolded_cells", f"{TOKEN}, a AS (SELECT traj, list(reward ORDER BY pos) AS r FROM v_token GROUP BY traj) SELECT traj, p::INTEGER AS part, array_to_string(list_transform(r[p * (len(r) // 2) + 1 : (p + 1) * (len(r) // 2)], lambda x: CAST(CAST(round(x * 100) AS INTEGER) AS VARCHAR)), ',') AS cells FROM a, (SELECT unnest([0, 1]) AS p)")
def unfolded_cells(spark, sf_dir):
    made = frames.unfold(views.trajectories(spark, sf_dir).select("traj", "reward"), "reward", 2)
    return made.select("traj", "part", F.array_join(F.transform("reward", lambda x: F.round(x * 100).cast("int").cast("string")), ",").alias("cells"))


@add("pad_with_row", f"{D} SELECT row_id, uid, seqlen FROM d UNION ALL SELECT n + i, uid, seqlen FROM d, n, (SELECT unnest([0, 1, 2]) AS i) WHERE row_id = n - 1 UNION ALL SELECT row_id + 1000000, uid, seqlen FROM d UNION ALL SELECT n + 1000000 + i, uid, seqlen FROM d, n, (SELECT unnest([0, 1]) AS i) WHERE row_id = 0")
def pad_with_row(spark, sf_dir):
    df = docs(spark, sf_dir).drop("lang")
    first = frames.pad_with_row(df, 2, "first").withColumn("row_id", F.col("row_id") + 1_000_000)
    return frames.pad_with_row(df, 3).unionByName(first)


@add("unpadded", f"{D} SELECT row_id, seqlen FROM d")
def unpadded(spark, sf_dir):
    return frames.unpad(frames.pad_to_divisor(docs(spark, sf_dir), 64)).select("row_id", "seqlen")


@add("shape_report", "SELECT 'doc_id' AS name, 'bigint' AS type, count(*) FILTER (doc_id IS NULL) AS nulls, count(*) AS rows FROM documents UNION ALL SELECT 'lang', 'string', count(*) FILTER (lang IS NULL), count(*) FROM documents")
def shape_report(spark, sf_dir):
    return frames.shape_report(views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "lang"))


@add("mini_batches", f"{D}, e AS (SELECT row_id, epoch::INTEGER AS epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5(row_id || '/' || epoch || '/7'), row_id) - 1 AS p FROM d, (SELECT unnest([0, 1]) AS epoch), n WHERE row_id < n // 8 * 8) SELECT row_id, epoch, p // 8 AS batch FROM e")
def mini_batches(spark, sf_dir):
    df = docs(spark, sf_dir)
    whole = df.filter(F.col("row_id") < frames.size_of(df) // 8 * 8)
    return frames.mini_batches(whole, 8, 2, 7).select("row_id", "epoch", "batch")


@add("shuffled_rows", f"{D} SELECT row_number() OVER (ORDER BY md5(row_id || '/5'), row_id) - 1 AS row_id, uid, seqlen, lang FROM d")
def shuffled_rows(spark, sf_dir):
    return frames.shuffled(docs(spark, sf_dir), 5)


@add("feed", f"{D} SELECT row_id, epoch::INTEGER AS epoch, epoch * (n // 48) + row_id // 48 AS batch FROM d, n, (SELECT unnest([0, 1, 2]) AS epoch) WHERE row_id // 48 < n // 48")
def feed(spark, sf_dir):
    return frames.feed(docs(spark, sf_dir), 3, 48).select("row_id", "epoch", "batch")


@add("response_parts", f"{TOKEN}, a AS (SELECT traj, list(reward ORDER BY pos) AS r FROM v_token GROUP BY traj), b AS (SELECT *, len(r) // 2 AS k FROM a) SELECT traj, round(coalesce(list_sum(r[len(r) - k : len(r) - 1]), 0), 6) AS part, round(coalesce(list_sum(r[1:k]), 0), 6) AS cut, k * 2.5::DOUBLE AS spread FROM b")
def response_parts(spark, sf_dir):
    half = F.floor(F.size("reward") / 2).cast("int")
    rows = views.trajectories(spark, sf_dir).select("traj", "reward", F.slice("reward", F.lit(1), half).alias("resp"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    made = rows.select("traj", total(frames.response_part("reward", "resp")).alias("part"), total(frames.cut_to("reward", F.size("resp"))).alias("cut"), total(frames.spread(F.lit(2.5), "resp")).alias("spread"))
    return rounded(made, "part", "cut", "spread")


# --- joins


@add("required_fields", "SELECT doc_id, lang FROM documents")
def required_fields(spark, sf_dir):
    return joins.require_fields(views.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang")


@add("ordered_distinct", "WITH f AS (SELECT o_custkey, min(o_orderkey) AS f FROM orders GROUP BY 1) SELECT o_custkey, row_number() OVER (ORDER BY f) - 1 AS row_id FROM f")
def ordered_distinct(spark, sf_dir):
    return joins.ordered_distinct(views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@add("required_multiple", "SELECT 4 * 9 AS multiple, count(*) // 36 * 36 AS rows FROM documents")
def required_multiple(spark, sf_dir):
    m = joins.least_common_multiple(4, 9, 12)
    return views.table(spark, sf_dir, "documents").agg(F.lit(m).alias("multiple"), (F.floor(F.count("*") / m) * m).alias("rows"))


@add("without_host_paths", "SELECT doc_id, lang AS kept FROM documents")
def without_host_paths(spark, sf_dir):
    names = [F.lit("/host").alias(n) for n in building.HOST_PATHS]
    df = building.without_host_paths(views.table(spark, sf_dir, "documents").select("doc_id", F.struct(F.col("lang").alias("kept"), *names).alias("extra_info")))
    return df.select("doc_id", "extra_info.*")


@add("sticky_routes", """WITH RECURSIVE c AS (SELECT event_id AS row_id, event_id // 64 AS batch, user_id AS request_id, event_id % 64 AS i FROM events WHERE event_id < 2048),
g AS (SELECT DISTINCT batch, -1::BIGINT AS i, NULL::BIGINT AS row_id, [0, 0, 0]::BIGINT[] AS load, MAP {}::MAP(BIGINT, INTEGER) AS known, NULL::INTEGER AS server FROM c
UNION ALL SELECT batch, i, row_id, list_transform(load, lambda x, k: CASE WHEN k = s THEN x + 1 ELSE x END), map_concat(known, MAP {request_id: s::INTEGER}), s - 1 FROM (SELECT g.batch, c.i, c.row_id, g.load, g.known, c.request_id, coalesce(g.known[c.request_id], list_position(g.load, list_min(g.load)))::INTEGER AS s FROM g JOIN c ON c.batch = g.batch AND c.i = g.i + 1))
SELECT row_id, server FROM g WHERE i >= 0""")
def sticky_routes(spark, sf_dir):
    """The calls of the first 32 batches, as a router that starts anew with each batch places them."""
    calls = views.events(spark, sf_dir).select(F.col("event_id").alias("row_id"), F.floor(F.col("event_id") / 64).alias("batch"), F.col("uid").alias("request_id"))
    return joins.sticky_routes(calls.filter("row_id < 2048"), 3, batch="batch").select("row_id", "server")


# --- estimators and losses


@add("estimator_by_name", f"""{TOKEN}, s AS (SELECT uid, traj, sum(reward * mask) AS score FROM v_token GROUP BY 1, 2), a AS (SELECT traj, CASE WHEN count(*) OVER w > 1 THEN (score - avg(score) OVER w) * count(*) OVER w / (count(*) OVER w - 1) ELSE score END AS a FROM s WINDOW w AS (PARTITION BY uid))
SELECT traj, pos, round(a * mask, 6) + 0.0 AS advantage FROM v_token JOIN a USING (traj)""")
def estimator_by_name(spark, sf_dir):
    return rounded(estimators.estimate("rloo", views.tokens(spark, sf_dir)), "advantage")


def agreement(name, tokens, parts, **options):
    """One row: the tokens that the named estimator gives an advantage to, and those of them that are masked and get another than 0."""
    masks = tokens.select("traj", "pos", "mask", F.lit(None).cast("double").alias("advantage"))
    made = estimators.estimate(name, tokens, **options).select("traj", "pos", F.lit(None).cast("int").alias("mask"), "advantage")
    made = made.repartition(parts, "traj") if name in ("gae", "reinforce_plus_plus") else made  # what Python returns is dealt by nothing
    # What a join on (traj, pos) would meet, but where both are dealt by traj this needs no further exchange.
    met = made.unionByName(masks).groupBy("traj", "pos").agg(
        F.count("mask").alias("known"), F.max("mask").alias("mask"), F.count("advantage").alias("given"), F.count_if(F.abs("advantage") > 1e-12).alias("other")
    )
    wrong = F.coalesce(F.sum(F.when(F.col("mask") == 0, F.col("other") * F.col("known")).otherwise(0)), F.lit(0))
    return met.agg(F.lit(name).alias("name"), F.coalesce(F.sum(F.col("given") * F.col("known")), F.lit(0)).alias("tokens"), (F.lit(0) if name == "gae" else wrong).cast("int").alias("masked"))


@add("estimators_agree", "SELECT unnest(['gae', 'gdpo', 'gpg', 'grpo', 'grpo_passk', 'grpo_vectorized', 'opo', 'optimal_token_baseline', 'reinforce_plus_plus', 'reinforce_plus_plus_baseline', 'remax', 'rloo', 'rloo_vectorized', 'tir_optimal_token_baseline']) AS name, (SELECT count(l_orderkey) FROM lineitem) AS tokens, 0 AS masked")
def estimators_agree(spark, sf_dir):
    """Every registered estimator gives an advantage to each token, and 0 to those that are masked.

    All lines that have an order are tokens; a line without one is in no trajectory. Tokens are dealt by traj once, and
    estimators read a copy of them. They run one by one: all their plans in one would fill the driver."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = views.tokens(spark, sf_dir, F.col("l_orderkey").isNotNull(), parts)
    tokens = checkpointed(known.select("uid", "traj", "pos", "reward", "value", "old_lp", "mask"), dealt=True)
    baselines = F.broadcast(tokens.groupBy("uid").agg(F.avg("reward").alias("baseline")))  # a row for each remainder of 500
    few = {"few": (tokens.agg(F.max("pos")).first()[0] or 0) < FEW_POSITIONS}
    options = {"remax": {"baselines": baselines}, "grpo_passk": {"normalize": False}, "optimal_token_baseline": few, "tir_optimal_token_baseline": few}
    rows = [agreement(name, tokens, parts, **options.get(name, {})).first() for name in sorted(estimators.REGISTRY)]
    return spark.createDataFrame(rows, "name string, tokens long, masked int")


@add("factorised_groups", "WITH k AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS group_id FROM (SELECT DISTINCT source FROM documents)) SELECT 'text' AS kind, doc_id, group_id FROM documents JOIN k USING (source) UNION ALL SELECT 'number', doc_id, n_chars FROM documents")
def factorised_groups(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    text = groups.factorised(d.select("doc_id", "source"), "source").select(F.lit("text").alias("kind"), "doc_id", "group_id")
    number = groups.factorised(d.select("doc_id", F.concat(F.col("n_chars").cast("string"), F.lit(".0")).alias("k")), "k")
    return text.unionByName(number.select(F.lit("number").alias("kind"), "doc_id", "group_id"))


@add("slowest_row", "SELECT o_orderkey, round(o_totalprice::DOUBLE + o_custkey, 4) AS total FROM orders ORDER BY o_totalprice::DOUBLE + o_custkey DESC LIMIT 1")
def slowest_row(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("a"), F.col("o_custkey").cast("double").alias("b"))
    return rounded(sequences.slowest_row(o, "a", "b", keep=["o_orderkey"]), "total", digits=4)


@add("squared_probabilities", "WITH l AS (SELECT event_id, list_transform([value::DOUBLE / 10, (event_id % 7)::DOUBLE, 1.5::DOUBLE], lambda x: exp(x)) AS e FROM events) SELECT event_id, round((e[1] ** 2 + e[2] ** 2 + e[3] ** 2) / (e[1] + e[2] + e[3]) ** 2, 6) AS p2 FROM l")
def squared_probabilities(spark, sf_dir):
    logits = F.array(F.col("value") / 10, (F.col("event_id") % 7).cast("double"), F.lit(1.5))
    return rounded(views.events(spark, sf_dir).select("event_id", losses.sum_of_squared_probabilities(logits).alias("p2")), "p2")


@add("corrected_rows", f"{TOKEN}, r AS (SELECT *, old_lp - roll_lp AS g FROM v_token) SELECT traj, pos, round(least(exp(least(greatest(g, -20), 20)), 2.0) * mask, 6) AS is_weight, CASE WHEN 0.5 * g * g <= 0.0008 THEN mask ELSE 0 END AS mask FROM r")
def corrected_rows(spark, sf_dir):
    made = corrections.correct(views.tokens(spark, sf_dir), options="token_k2", thresholds=0.0008).select("traj", "pos", "is_weight", "mask")
    return rounded(made, "is_weight")


@add("loss_clip_cov", f"""{TOKEN}, m AS (SELECT sum(adv * mask) / (sum(mask) + 1e-8) AS ma, sum(lp * mask) / (sum(mask) + 1e-8) AS ml, greatest((sum(mask) * 0.01)::BIGINT - CASE WHEN (sum(mask) * 0.01)::BIGINT > sum(mask) * 0.01 THEN 1 ELSE 0 END, 1) AS few FROM v_token),
c AS (SELECT v.*, few, exp(lp - old_lp) AS r, (adv - ma) * (lp - ml) AS cov FROM v_token v, m), i AS (SELECT *, mask > 0 AND NOT (-adv * least(greatest(r, 0.8), 1.2) > -adv * r) AND cov > 0.05 AND cov < 5 AS inside FROM c),
k AS (SELECT *, CASE WHEN inside AND row_number() OVER (PARTITION BY inside ORDER BY ('0x' || substr(md5(traj || '/' || pos || '/0'), 1, 12))::BIGINT, traj, pos) <= few THEN 0 ELSE 1 END AS keep FROM i)
SELECT round(sum(greatest(-adv * r, -adv * least(greatest(r, 0.8), 1.2)) * keep * mask) / sum(mask), 6) AS loss FROM k""")
def loss_clip_cov(spark, sf_dir):
    return rounded(losses.policy_loss("clip_cov", views.tokens(spark, sf_dir), ratio=0.01, band=(0.05, 5.0)), "loss")


@add("sft_loss", f"{TOKEN} SELECT round(-sum(lp * mask) / 1000 * 2, 6) AS loss FROM v_token")
def sft_loss(spark, sf_dir):
    return rounded(losses.sft_loss(views.tokens(spark, sf_dir), tokens=1000, ranks=2), "loss")


@add("composite_loss", f"""{TOKEN}, c AS (SELECT sum(-lp * adv * mask) / sum(mask) AS pg_loss, sum(value * mask) / sum(mask) AS entropy, sum((lp - ref_lp) * mask) / sum(mask) AS kl_loss FROM v_token)
SELECT round(pg_loss, 6) AS pg_loss, round(entropy, 6) AS entropy, round(kl_loss, 6) AS kl_loss, round(pg_loss - 0.1 * entropy + 0.2 * kl_loss, 6) AS loss FROM c""")
def composite_loss(spark, sf_dir):
    made = losses.composite_loss(views.tokens(spark, sf_dir), "gpg", entropy="value", entropy_coef=0.1, ref="ref_lp", kl_coef=0.2, kind="k1")
    return rounded(made, "pg_loss", "entropy", "kl_loss", "loss")


@add("top_k_forward_kl", f"""{TOKEN}, c AS (SELECT mask, greatest(exp(old_lp - 1) * (old_lp - lp) + exp(ref_lp - 2) * (ref_lp - roll_lp), 0) AS kl, exp(old_lp - 1) + exp(ref_lp - 2) AS t, exp(lp - 1) + exp(roll_lp - 2) AS s FROM v_token)
SELECT round(sum(kl * mask) / sum(mask), 6) AS loss, round(sum(s * mask) / sum(mask), 6) AS student_mass, round(sum(t * mask) / sum(mask), 6) AS teacher_mass FROM c""")
def top_k_forward_kl(spark, sf_dir):
    rows = views.tokens(spark, sf_dir).withColumn("teacher_lp", F.array(F.col("old_lp") - 1, F.col("ref_lp") - 2)).withColumn("student_lp", F.array(F.col("lp") - 1, F.col("roll_lp") - 2))
    return rounded(losses.top_k_forward_kl(rows), "loss", "student_mass", "teacher_mass")


# --- metrics and validation


@add("typed_reduce", "SELECT event_type AS metric, unnest(['MEAN', 'SUM', 'MIN', 'MAX']) AS kind, round(unnest([avg(value)::DOUBLE, sum(value)::DOUBLE, min(value)::DOUBLE, max(value)::DOUBLE]), 4) AS reduced FROM events GROUP BY event_type")
def typed_reduce(spark, sf_dir):
    rows, out = views.events(spark, sf_dir).withColumnRenamed("event", "metric"), None
    for kind in ("MEAN", "SUM", "MIN", "MAX"):
        one = metrics.typed_reduce(rows, kind).select("metric", F.lit(kind).alias("kind"), "reduced")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "reduced", digits=4)


@add("subset_sizes", "WITH n AS (SELECT o_custkey AS uid, count(*) AS n FROM orders GROUP BY 1) SELECT uid, k AS size FROM n, (SELECT unnest([2, 4, 8, 16, 32, 64, 128]) AS k) WHERE k < n UNION ALL SELECT uid, n FROM n WHERE n > 1")
def subset_sizes(spark, sf_dir):
    per = views.samples(spark, sf_dir).groupBy("uid").agg(F.count("*").alias("n"))
    most = per.agg(F.max("n")).first()[0] or 0
    table = spark.createDataFrame([(n, size) for n in range(most + 1) for size in metrics.subset_sizes(n)], "n long, size long")
    return per.join(F.broadcast(table), "n").select("uid", "size")


@add("core_names", "WITH m AS (SELECT unnest(['s1', 's2']) AS source), v AS (SELECT source, unnest(['acc', 'reward', 'acc', 'acc']) AS variable, unnest(['mean@8', 'mean@8', 'best@2/mean', 'best@8/mean']) AS metric FROM m) SELECT source, variable, metric, CASE WHEN variable = 'acc' AND metric <> 'best@2/mean' AND source = 's1' OR source = 's2' AND variable = 'reward' THEN 'val-core' ELSE 'val-aux' END || '/' || source || '/' || variable || '/' || metric AS name FROM v WHERE NOT (source = 's2' AND variable = 'acc')")
def core_names(spark, sf_dir):
    rows = [("s1", "acc", "mean@8"), ("s1", "reward", "mean@8"), ("s1", "acc", "best@2/mean"), ("s1", "acc", "best@8/mean"), ("s2", "reward", "mean@8")]
    return metrics.core_names(spark.createDataFrame(rows, "source string, variable string, metric string"))


@add("merged_results", "SELECT doc_id, source AS data_source, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS score, CASE WHEN doc_id % 2 = 1 THEN lang END AS pred FROM documents")
def merged_results(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").withColumnRenamed("source", "data_source")
    left = d.filter("doc_id % 2 = 0").select("doc_id", "data_source", F.col("n_chars").alias("score"))
    return metrics.merge_results(left, d.filter("doc_id % 2 = 1").select("doc_id", "data_source", F.col("lang").alias("pred")))


@add("terminal_outcomes", "SELECT user_id AS uid, coalesce(arg_min(event_type, event_id) FILTER (event_type <> 'view'), 'unknown') AS outcome FROM events GROUP BY 1")
def terminal_outcomes(spark, sf_dir):
    rows = views.events(spark, sf_dir).select("uid", "event_id", F.when(F.col("event") == "view", "unknown").otherwise(F.col("event")).alias("outcome"))
    return diagnostics.terminal_outcomes(rows, "uid", "event_id")


@add("first_k_per_outcome", "WITH r AS (SELECT event_id AS row_id, event_type AS terminal_outcome, substr(repeat(event_type, 200), 1, 300) AS failure_detail, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank FROM events) SELECT * FROM r WHERE rank <= 3")
def first_k_per_outcome(spark, sf_dir):
    rows = views.events(spark, sf_dir).select(F.col("event_id").alias("row_id"), F.col("event").alias("terminal_outcome"), F.repeat("event", F.lit(200)).alias("failure_detail"))
    return diagnostics.first_examples(rows, 3)


@add("rates", "SELECT user_id AS uid, coalesce(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'click'), 0), 0) AS rate FROM events GROUP BY 1")
def rates(spark, sf_dir):
    is_ = lambda name: F.count_if(F.col("event") == name)
    return views.events(spark, sf_dir).groupBy("uid").agg(diagnostics.rate(is_("purchase"), is_("click")).alias("rate"))


# --- text


@add("parsed_lists", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang || '|' || source WHEN 1 THEN 'a|b' WHEN 2 THEN lang WHEN 3 THEN '' ELSE '7' END AS items FROM documents")
def parsed_lists(spark, sf_dir):
    k = F.col("doc_id") % 5
    text = F.when(k == 0, F.concat(F.lit('["'), "lang", F.lit('", "'), "source", F.lit('"]'))).when(k == 1, "['a', 'b']").when(k == 2, F.col("lang")).when(k == 3, "  ").otherwise("7")
    return views.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.parsed_list(text), "|").alias("items"))


@add("code_blocks", "SELECT event_id, event_type AS first, event_type || chr(10) || 'x = ' || user_id AS every FROM events")
def code_blocks(spark, sf_dir):
    text = F.concat(F.lit("a ```python\n"), "event_type", F.lit("\n``` b ```\nx = "), F.col("user_id").cast("string"), F.lit("\n``` c"))
    return views.table(spark, sf_dir, "events").select("event_id", T.code_blocks(text, first=True).alias("first"), T.code_blocks(text).alias("every"))


@add("text_patches", "SELECT event_id, 'diff --git a/' || event_type || chr(10) || '+x' || chr(10) || 'diff --git a/z' || chr(10) || '-y' || chr(10) AS patch, true AS good FROM events")
def text_patches(spark, sf_dir):
    patch = F.concat(F.lit("diff --git a/"), "event_type", F.lit("\n+x\ndiff --git a/b.png\nGIT binary patch\nabc\ndiff --git a/c.so\nBinary files a and b differ\ndiff --git a/z\n-y\n"))
    made = T.without_binary_hunks(patch)
    return views.table(spark, sf_dir, "events").select("event_id", made.alias("patch"), parsing.is_git_patch(made).alias("good"))


@add("truncated_texts", "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 60) || chr(10) || '[... cut ...]' || chr(10) || right(text, 40) END AS text, CASE WHEN doc_id % 20 <= 10 THEN (SELECT string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FROM range(doc_id % 20) r(i)) ELSE '0,1,2,3,4,5,-1,' || (doc_id % 20 - 4) || ',' || (doc_id % 20 - 3) || ',' || (doc_id % 20 - 2) || ',' || (doc_id % 20 - 1) END AS ids FROM documents")
def truncated_texts(spark, sf_dir):
    n = (F.col("doc_id") % 20).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cut = T.truncated_tokens(ids, 10, notice=[-1])
    joined = F.array_join(F.transform(cut, lambda x: x.cast("string")), ",")
    return views.table(spark, sf_dir, "documents").select("doc_id", T.truncated_text(F.col("text"), 100).alias("text"), F.when(n > 0, joined).alias("ids"))


@add("durations", "SELECT event_id, printf('%02d:%02d:%02d', event_id * 37 // 3600, event_id * 37 // 60 % 60, event_id * 37 % 60) AS d FROM events")
def durations(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", T.duration_text(F.col("event_id") * 37).alias("d"))


@add("merged_maps", "SELECT doc_id, lang AS a, source AS b, 'right' AS c FROM documents")
def merged_maps(spark, sf_dir):
    left = F.create_map(F.lit("a"), F.col("lang"), F.lit("c"), F.lit("left"))
    right = F.create_map(F.lit("b"), F.col("source"), F.lit("c"), F.lit("right"))
    m = T.merged_maps(left, right, strict=False)
    same = T.merged_maps(m, F.create_map(F.lit("c"), F.lit("right")))  # equal values are no clash
    return views.table(spark, sf_dir, "documents").select("doc_id", *[same[k].alias(k) for k in "abc"])


# --- scores and parsing


@add("dispatched_scores", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN CASE WHEN o_custkey % 7 = 3 THEN 1.0 ELSE -1.0 END WHEN 4 THEN round(0.1 + CASE WHEN o_custkey % 7 = 3 THEN 0.9 ELSE 0.0 END, 6) ELSE CASE WHEN o_custkey % 7 = 3 THEN 1.0 ELSE 0.0 END END::DOUBLE AS score FROM orders")
def dispatched_scores(spark, sf_dir):
    k, n = F.col("o_orderkey") % 5, (F.col("o_custkey") % 7).cast("string")
    source = F.when(k == 0, "openai/gsm8k").when(k == 1, "aime24").when(k == 2, "searchR1_nq").when(k == 3, "HuggingFaceH4/MATH-500").otherwise("hiyouga/geometry3k")
    said = F.when(k == 0, F.concat(F.lit("so #### "), n)).when(k == 1, F.concat(F.lit("Answer: "), n)).when(k == 2, F.concat(F.lit("<answer>"), n, F.lit("</answer>")))
    said = said.otherwise(F.concat(F.lit("<think>a</think> it is \\boxed{"), n, F.lit("}.")))
    return rounded(views.table(spark, sf_dir, "orders").select("o_orderkey", scoring.dispatch(source, said, F.lit("3")).alias("score")), "score")


@add("format_and_accuracy", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.9 * (l_returnflag = 'R')::INT + 0.1 * (l_linestatus = 'O')::INT, 6) AS score FROM lineitem")
def format_and_accuracy(spark, sf_dir):
    flag = lambda c, v: (F.col(c) == v).cast("double")
    made = building.format_and_accuracy(flag("l_returnflag", "R"), flag("l_linestatus", "O"))
    return rounded(views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", made.alias("score")), "score")


@add("tool_call_rewards", "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 3.0 WHEN 1 THEN 6 * (1 + 1 + 0.0) / 3 - 3 WHEN 2 THEN 6 * 0.0 / 3 - 3 WHEN 3 THEN -3.0 WHEN 4 THEN -3.0 WHEN 5 THEN -3.0 WHEN 6 THEN -3.0 WHEN 7 THEN 0.0 ELSE 6 * (0.5 + 1 + 1) / 3 - 3 END::DOUBLE AS score FROM events")
def tool_call_rewards(spark, sf_dir):
    """Exact, another value, another name, no call, null and text for parameters, a list for the name, none wanted, one too many."""
    k = F.col("event_id") % 9
    call = lambda *lines: "<tool_call>\n" + "\n".join(lines) + "\n</tool_call>"
    good = '{"name": "run", "parameters": {"cmd": "ls"}}'
    made = F.when(k == 0, call(good)).when(k == 1, call(good.replace("ls", "cd"))).when(k == 2, call(good.replace("run", "go"))).when(k == 3, "no call")
    made = made.when(k == 4, call('{"name": "run", "arguments": null}')).when(k == 5, call('{"name": "run", "parameters": "ls"}')).when(k == 6, call('{"name": ["run"], "parameters": {}}'))
    made = made.when(k == 7, call(good)).otherwise(call('{"name": "go", "parameters": {}}', good))
    wanted = F.when(k == 7, "nothing to call").otherwise(call(good))
    return rounded(views.table(spark, sf_dir, "events").select("event_id", scoring.tool_call_reward(made, wanted).alias("score")), "score")


@add("log_status", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'test_markers_missing' WHEN 2 THEN 'harness_apply_patch_failed' WHEN 3 THEN 'harness_reset_failed' WHEN 4 THEN 'tests_timeout' ELSE 'tests_error' END AS status, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS passed FROM events")
def log_status(spark, sf_dir):
    k, whole = F.col("event_id") % 6, f"{scoring.LOG_START}\nok\n{scoring.LOG_END}\n"
    marks = [m for m, _ in scoring.LOG_MARKERS]
    log = F.when(k == 0, whole).when(k == 1, scoring.LOG_START).when(k == 2, whole + marks[0] + marks[3]).when(k == 3, whole + marks[1]).when(k == 4, marks[2] + whole).otherwise(marks[3])
    got = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a")))
    return views.table(spark, sf_dir, "events").select("event_id", scoring.log_status(log).alias("status"), scoring.all_required_passed(F.array(F.lit("a"), F.lit("b")), got).alias("passed"))


_RWD = "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 7 = 3 THEN 1.0 ELSE 0.0 END AS s, o_orderkey % 12 AS n FROM orders"


@add("reward_managers", f"""WITH r AS ({_RWD}), m AS (SELECT o_orderkey, n, unnest(['naive', 'dapo', 'gdpo', 'given']) AS manager, unnest([s, s + least(-(n - 6) / 4.0, 0.0), s + n, 0.5]) AS score FROM r)
SELECT o_orderkey, manager, round(score, 6) AS score, n AS cells, round(CASE WHEN n > 0 THEN score ELSE 0 END, 6) AS last FROM m""")
def reward_managers(spark, sf_dir):
    o, out = views.table(spark, sf_dir, "orders"), None
    n = F.col("o_orderkey") % 12
    rows = o.select("o_orderkey", F.lit("openai/gsm8k").alias("data_source"), F.concat(F.lit("#### "), (F.col("o_custkey") % 7).cast("string")).alias("solution"), F.lit("3").alias("truth"), n.alias("n_tokens"))
    parts = {"answer": scoring.gsm8k(F.col("solution"), F.col("truth")), "length": F.col("n_tokens")}
    made = {
        "naive": rewards.reward_table(rows), "dapo": rewards.reward_table(rows, "dapo", limit=10, buffer=4), "gdpo": rewards.reward_table(rows, "gdpo", parts=parts),
        "given": rewards.reward_table(rows.withColumn("rm_score", F.lit(0.5))),
    }
    for name, df in made.items():
        one = df.select("o_orderkey", F.lit(name).alias("manager"), "score", F.size("rewards").alias("cells"), F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x).alias("last"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "score", "last")


@add("rate_limited", """WITH RECURSIVE c AS (SELECT event_id, user_id % 5 AS k, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS i, event_id::DOUBLE AS t, (event_id % 4 + 1)::DOUBLE AS cost FROM events WHERE event_id < 3000),
g AS (SELECT k, i, event_id, t AS begun, greatest(t, t + (cost - 3) / 0.5) AS starts_at, t + cost / 0.5 AS owed FROM c WHERE i = 1 UNION ALL SELECT c.k, c.i, c.event_id, c.t, greatest(c.t, greatest(c.t, g.owed) + (c.cost - 3) / 0.5), greatest(c.t, g.owed) + c.cost / 0.5 FROM g JOIN c ON c.k = g.k AND c.i = g.i + 1)
SELECT event_id, round(starts_at, 4) AS starts_at FROM g""")
def rate_limited(spark, sf_dir):
    """Requests 0 to 2999, as five buckets of 3 tokens that refill at half a token a second let them begin."""
    rows = views.events(spark, sf_dir).filter("event_id < 3000").select("event_id", (F.col("uid") % 5).alias("k"), F.col("event_id").cast("double").alias("t"), (F.col("event_id") % 4 + 1).alias("cost"))
    return rounded(rewards.rate_limited(rows, 0.5, 3.0, key="k", time="t", cost="cost", order="event_id").select("event_id", "starts_at"), "starts_at", digits=4)


@add("channel_calls", "SELECT event_id, 0 AS call_no, event_type AS name, props AS arguments FROM events")
def channel_calls(spark, sf_dir):
    text = F.concat(F.lit("<|start|>assistant<|channel|>analysis<|message|>no<|end|><|start|>assistant<|channel|>commentary to=functions."), "event_type", F.lit(" <|constrain|>json<|message|>"), "props", F.lit("<|call|>"))
    return parsing.call_rows(views.table(spark, sf_dir, "events").withColumn("t", text), parsing.tool_calls(F.col("t"), "channel"), "event_id")


@add("braced_calls", """SELECT event_id, 0 AS call_no, event_type AS name, '{"cmd": "ls, x", "n": ' || user_id || ', "ok": true, "none": null}' AS arguments FROM events""")
def braced_calls(spark, sf_dir):
    text = F.concat(F.lit("so <|tool_call>call:"), "event_type", F.lit('{cmd:<|"|>ls, x<|"|>,n:'), F.col("user_id").cast("string"), F.lit(",ok:true,none:null}<tool_call|> end"))
    return parsing.call_rows(views.table(spark, sf_dir, "events").withColumn("t", text), parsing.tool_calls(F.col("t"), "braced"), "event_id")


@add("media_parts", "SELECT event_id, 'text:look at |image:|text: and |video:|text: ' || event_type AS parts FROM events")
def media_parts(spark, sf_dir):
    parts = parsing.split_media(F.concat(F.lit("look at <image> and <video> "), "event_type"))
    joined = F.array_join(F.transform(parts, lambda p: F.concat(p["type"], F.lit(":"), F.coalesce(p["text"], F.lit("")))), "|")
    return views.table(spark, sf_dir, "events").select("event_id", joined.alias("parts"))


# --- streams


def _stream(payload):
    def read(spark, sf_dir):
        batch = views.table(spark, sf_dir, "events")
        stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        return stream.select((F.col("user_id") % 50).cast("string").alias("uid"), F.col("event_id").alias("seq"), payload.alias("payload"))

    return read


_SEQ = "WITH r AS (SELECT CAST(user_id % 50 AS VARCHAR) AS uid, event_id AS seq, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) - 1 AS i, event_type FROM events)"


@add("stream_staleness", "WITH r AS (SELECT CAST(user_id % 50 AS VARCHAR) AS uid, event_id AS seq, event_id // 500 AS v FROM events) SELECT uid, seq, v AS version, row_number() OVER (PARTITION BY uid, v ORDER BY seq) <= 4 AS admitted, 0 AS staleness FROM r")
def stream_staleness(spark, sf_dir):
    return _keyed(spark, sf_dir, queues.StalenessGate(4), _stream(F.floor(F.col("event_id") / 500).cast("string")))


@add("stream_upserts", "SELECT CAST(user_id % 50 AS VARCHAR) AS uid, event_type AS name, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY 1, 2")
def stream_upserts(spark, sf_dir):
    return _keyed(spark, sf_dir, queues.KeyedUpsert(), _stream(F.concat("event_type", F.lit("="), F.col("event_id").cast("string"))))


@add("stream_removed_keys", f"{_SEQ}, l AS (SELECT uid, max(seq) AS last FROM r WHERE seq % 10 = 0 GROUP BY uid) SELECT r.uid, event_type AS name, CAST(max(seq) AS VARCHAR) AS value FROM r LEFT JOIN l ON l.uid = r.uid WHERE seq > coalesce(last, -1) GROUP BY 1, 2")
def stream_removed_keys(spark, sf_dir):
    field = F.concat("event_type", F.lit("="), F.col("event_id").cast("string"))
    return _keyed(spark, sf_dir, queues.KeyedUpsert(), _stream(F.when(F.col("event_id") % 10 == 0, "!").otherwise(field)))


@add("stream_barrier", f"{_SEQ}, s AS (SELECT uid, CAST(seq % 7 AS VARCHAR) AS session, arg_max(seq % 3, seq) AS k FROM r GROUP BY 1, 2), b AS (SELECT uid FROM s GROUP BY uid HAVING count(*) FILTER (k = 0 AND CAST(uid AS INT) % 2 = 0) = 0) SELECT s.uid, session FROM s JOIN b USING (uid) WHERE k = 1")
def stream_barrier(spark, sf_dir):
    """Sessions of a step; steps of odd number have no running one at the end, the others wait where they have."""
    k = F.col("event_id") % 3
    status = F.when((k == 0) & ((F.col("user_id") % 50) % 2 == 0), "running").when(k == 1, "success").otherwise("failure")
    return _keyed(spark, sf_dir, queues.StepBarrier(), _stream(F.concat((F.col("event_id") % 7).cast("string"), F.lit(":"), status)))


@add("stream_end", f"{_SEQ}, e AS (SELECT uid, max(seq) AS last FROM r GROUP BY uid) SELECT uid, i // 4 AS batch, seq, event_type AS payload FROM r")
def stream_end(spark, sf_dir):
    """Batches of four with the short rest, as the stream says for each key that it ends."""
    def read(own, folder):
        rows = _stream(F.col("event_type"))(own, folder)
        ends = own.readStream.schema(views.table(own, folder, "events").schema).option("pathGlobFilter", "events.parquet").parquet(folder)
        marks = ends.select((F.col("user_id") % 50).cast("string").alias("uid"), F.lit((1 << 62)).alias("seq"), F.lit(queues.END).alias("payload"))
        return rows.unionByName(marks)

    return _keyed(spark, sf_dir, queues.CountWindow(4), read)


@add("stream_retries", f"""WITH RECURSIVE r AS (SELECT CAST(user_id % 50 AS VARCHAR) AS uid, event_id AS seq, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS i, event_id % 5 AS k, (event_id // 5) % 2 AS p FROM events),
g AS (SELECT DISTINCT uid, 0::BIGINT AS i, -1::BIGINT AS seq, '' AS what, -1::BIGINT AS priority, 0::BIGINT AS attempt, 0.0::DOUBLE AS wait FROM r
UNION ALL SELECT r.uid, r.i, r.seq, CASE WHEN k < 2 THEN CASE WHEN priority < 0 THEN 'added' ELSE 'merged' END WHEN priority < 0 THEN 'unknown' WHEN k < 4 THEN 'retry' ELSE 'done' END,
 CASE WHEN k < 2 THEN greatest(priority, p) WHEN priority < 0 THEN -1 WHEN k < 4 THEN priority ELSE -1 END, CASE WHEN priority < 0 THEN 0 WHEN k < 2 THEN attempt WHEN k < 4 THEN attempt + 1 ELSE 0 END,
 CASE WHEN priority >= 0 AND k IN (2, 3) THEN least(2.0 ** attempt, 60.0) ELSE 0.0 END FROM g JOIN r ON r.uid = g.uid AND r.i = g.i + 1)
SELECT uid, seq, what, priority, attempt, wait FROM g WHERE i > 0""")
def stream_retries(spark, sf_dir):
    k, p = F.col("event_id") % 5, (F.floor(F.col("event_id") / 5) % 2).cast("string")
    return _keyed(spark, sf_dir, queues.RetryQueue(), _stream(F.when(k < 2, F.concat(F.lit("add:"), p)).when(k < 4, "fail").otherwise("done")))


@add("service_order", "SELECT CAST(event_id AS VARCHAR) AS container_id, user_id % 2 AS priority, least(2.0 ** (event_id % 9), 60.0) AS wait FROM events WHERE event_id % 100 <= 50 ORDER BY user_id % 2 DESC, event_id, CAST(event_id AS VARCHAR) LIMIT 40")
def service_order(spark, sf_dir):
    rows = views.events(spark, sf_dir).select(F.col("event_id").cast("string").alias("container_id"), (F.col("uid") % 2).alias("priority"), (F.col("event_id") % 100).cast("double").alias("ready_at"), F.col("event_id").alias("enqueued_at"), (F.col("event_id") % 9).alias("attempt"))
    return queues.service_order(rows, 50.0, 40).select("container_id", "priority", queues.backoff_seconds(F.col("attempt")).alias("wait"))


@add("production_pauses", "SELECT event_id, event_id % 20 >= 16 OR event_id % 33 >= 32 AS paused FROM events")
def production_pauses(spark, sf_dir):
    budget = queues.staleness_budget(8, 1.0, 2)
    return views.events(spark, sf_dir).select("event_id", queues.paused(F.col("event_id") % 20, 16, F.col("event_id") % 33, budget).alias("paused"))
