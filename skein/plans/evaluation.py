"""Queries over metrics, validation, diagnostics, scores, parsing and the dataset build."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import views
from skein.functions import text as T
from skein.operators import diagnostics, joins, metrics, parsing, scoring
from skein.plans.registry import Registry, rounded
from skein.streaming import queues

REGISTRY = Registry()
add = REGISTRY.add
S, E = views.with_views("v_sample"), views.with_views("v_event")


@add("batch_metrics", """WITH r AS (SELECT n_chars % 13 AS score, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars % 2000 END AS len, length(source) AS p FROM documents)
SELECT round(avg(score) FILTER (len > 0), 6) AS score_mean, max(score) FILTER (len > 0)::DOUBLE AS score_max, min(score) FILTER (len > 0)::DOUBLE AS score_min, round(avg(len), 6) AS response_length_mean, max(len)::DOUBLE AS response_length_max, min(len)::DOUBLE AS response_length_min,
round(avg(p), 6) AS prompt_length_mean, max(p)::DOUBLE AS prompt_length_max, min(p)::DOUBLE AS prompt_length_min, round(avg((len >= 1500)::INT), 6) AS response_clip_ratio, round(avg((len = 0)::INT), 6) AS aborted_ratio FROM r""")
def batch_metrics(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").select((F.col("n_chars") % 13).cast("double").alias("score"), F.when(F.col("doc_id") % 17 == 0, 0.0).otherwise((F.col("n_chars") % 2000).cast("double")).alias("response_length"), F.length("source").cast("double").alias("prompt_length"))
    made = metrics.batch_metrics(rows, 1500)
    return rounded(made, *made.columns)


@add("explained_variance", f"{views.with_views('v_token')} SELECT round(1 - var_samp(reward - value) / (var_samp(reward) + 1e-5), 6) AS explained_variance FROM v_token WHERE mask <> 0")
def explained_variance(spark, sf_dir):
    return rounded(metrics.explained_variance(views.tokens(spark, sf_dir), ret="reward"), "explained_variance")


@add("timing_metrics", """WITH s AS (SELECT CASE event_type WHEN 'click' THEN 'gen' ELSE event_type END AS stage, sum(value)::DOUBLE AS seconds FROM events GROUP BY 1), t AS (SELECT sum(n_chars) AS r, sum(n_chars) + count(*) * 10 AS a FROM documents)
SELECT stage, round(seconds, 4) AS seconds, round(seconds * 1000 / CASE WHEN stage = 'gen' THEN r ELSE a END, 6) AS ms_per_token FROM s, t""")
def timing_metrics(spark, sf_dir):
    stage = F.when(F.col("event") == "click", "gen").otherwise(F.col("event"))
    stages = views.events(spark, sf_dir).groupBy(stage.alias("stage")).agg(F.sum("value").alias("seconds"))
    totals = views.table(spark, sf_dir, "documents").agg(F.sum("n_chars").alias("response_tokens"), (F.sum("n_chars") + F.count("*") * 10).alias("all_tokens"))
    return rounded(rounded(metrics.timing_metrics(stages, totals), "ms_per_token"), "seconds", digits=4)


@add("variance_proxies", f"""{views.with_views('v_token')}, p AS (SELECT traj, greatest(sum((1 - 2 * exp(old_lp)) * mask), 0) AS w, sum(adv * mask) / greatest(sum(mask), 1) AS a FROM v_token GROUP BY traj), o AS (SELECT avg(a * sqrt(w)) AS g, avg(a * a * w) AS p2, count(*) AS n FROM p)
SELECT round(g * g, 6) AS signal, round(p2, 6) AS total_power, round(greatest((p2 - g * g) / greatest(n - 1, 1), 0), 8) AS noise FROM o""")
def variance_proxies(spark, sf_dir):
    made = metrics.variance_proxies(views.tokens(spark, sf_dir))
    return rounded(rounded(made, "signal", "total_power"), "noise", digits=8)


_LONG = "WITH m AS (SELECT uid_step AS step, metric, value FROM (SELECT user_id % 20 AS uid_step, unnest(['score/max', 'len/min', 'len/minmax', 'loss']) AS metric, value::DOUBLE AS value, event_id FROM events))"


def _long(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("score/max", "len/min", "len/minmax", "loss")])
    return views.events(spark, sf_dir).select((F.col("uid") % 20).alias("step"), F.explode(names).alias("metric"), "value", "event_id")


@add("reduce_by_name", f"{_LONG} SELECT metric, round(CASE WHEN contains(metric, 'max') THEN max(value) WHEN contains(metric, 'min') THEN min(value) ELSE avg(value) END, 6) AS reduced FROM m GROUP BY metric")
def reduce_by_name(spark, sf_dir):
    return rounded(metrics.reduce_by_name(_long(spark, sf_dir)), "reduced")


@add("across_ranks", "WITH s AS (SELECT user_id % 20 AS step, avg(value)::DOUBLE AS v FROM events GROUP BY 1) SELECT round(sum(v), 6) AS reduced FROM s")
def across_ranks(spark, sf_dir):
    return rounded(metrics.across_ranks(views.events(spark, sf_dir).withColumn("step", F.col("uid") % 20), "SUM"), "reduced")


@add("aggregate_steps", """WITH names AS (SELECT unnest(['perf/throughput', 'perf/total_num_tokens', 'perf/time_per_step', 'timing_s/gen', 'timing_s/step', 'training/global_step', 'score/mean', 'len/total', 'global_seqlen/minmax_diff', 'global_seqlen/max', 'global_seqlen/min', 'x/weighted_avg']) AS metric),
m AS (SELECT user_id AS step, metric, sum(value)::DOUBLE + length(metric) AS value FROM events, names GROUP BY 1, 2), k AS (SELECT metric, CASE WHEN metric = 'perf/time_per_step' OR contains(metric, 'timing_s/') THEN sum(value) WHEN metric = 'training/global_step' THEN arg_max(value, step)
 WHEN contains(metric, 'mean') OR contains(metric, 'avg') THEN avg(value) WHEN contains(metric, 'max') THEN max(value) WHEN contains(metric, 'min') THEN min(value) WHEN contains(metric, 'sum') OR contains(metric, 'total') THEN sum(value) ELSE avg(value) END AS r FROM m GROUP BY metric),
g AS (SELECT max(r) FILTER (metric = 'perf/total_num_tokens') / (max(r) FILTER (metric = 'perf/time_per_step') * 8) AS t, max(r) FILTER (metric = 'global_seqlen/max') - max(r) FILTER (metric = 'global_seqlen/min') AS d, max(r) FILTER (metric = 'timing_s/gen') / max(r) FILTER (metric = 'timing_s/step') AS i FROM k)
SELECT metric, round(CASE metric WHEN 'perf/throughput' THEN t WHEN 'global_seqlen/minmax_diff' THEN d ELSE r END, 4) AS reduced FROM k, g UNION ALL SELECT 'fully_async/trainer/idle_ratio', round(i, 4) FROM g""")
def aggregate_steps(spark, sf_dir):
    names = ("perf/throughput", "perf/total_num_tokens", "perf/time_per_step", "timing_s/gen", "timing_s/step", "training/global_step", "score/mean", "len/total", "global_seqlen/minmax_diff", "global_seqlen/max", "global_seqlen/min", "x/weighted_avg")
    per = views.events(spark, sf_dir).groupBy(F.col("uid").alias("step")).agg(F.sum("value").alias("v"))
    long = per.select("step", F.explode(F.array(*[F.lit(n) for n in names])).alias("metric"), "v").select("step", "metric", (F.col("v") + F.length("metric")).alias("value"))
    return rounded(metrics.aggregate_steps(long, 8), "reduced", digits=4)


@add("majority_vote", f"""{S}, v AS (SELECT uid, pred, count(*) AS n, min(row_id) AS f, arg_min(score, row_id) AS maj FROM v_sample GROUP BY uid, pred), k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, f) AS k FROM v) SELECT uid, maj FROM k WHERE k = 1""")
def majority_vote(spark, sf_dir):
    return metrics.majority(views.samples(spark, sf_dir), "uid")


@add("plain_validation", f"""{S}, p AS (SELECT data_source AS source, uid, count(*) AS n, avg(score + row_id % 3) AS mean, stddev_pop(score + row_id % 3) AS std, max(score + row_id % 3) AS best, min(score + row_id % 3) AS worst FROM v_sample GROUP BY 1, 2)
SELECT source, n, count(*) AS prompts, round(avg(mean), 6) + 0.0 AS mean, round(avg(std) FILTER (n > 1), 6) + 0.0 AS std, round(avg(best), 6) + 0.0 AS best, round(avg(worst), 6) + 0.0 AS worst FROM p GROUP BY source, n""")
def plain_validation(spark, sf_dir):
    df = views.samples(spark, sf_dir).withColumn("score", F.col("score") + F.col("row_id") % 3)
    return rounded(metrics.plain_validation(df), "mean", "std", "best", "worst")


@add("validation_bootstrap")
def validation_bootstrap(spark, sf_dir):
    made = metrics.validation_metrics(views.samples(spark, sf_dir).withColumn("data_source", F.lit("all")))
    return rounded(metrics.core_names(made).select("name", "value"), "value")


@add("percentiles", f"{E} SELECT event, count(value) AS n, round(avg(value), 6) AS avg, max(value) AS max, min(value) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM v_event GROUP BY event")
def percentiles(spark, sf_dir):
    return rounded(metrics.percentiles(views.events(spark, sf_dir), "value", "event"), "avg", "max", "min", "p50", "p95", "p99")


@add("spec_decode_rates", "SELECT round(avg(CASE WHEN l_linenumber % 3 > 0 THEN (l_quantity::DOUBLE) / (l_linenumber % 3) ELSE 0 END), 6) AS acceptance_rate, round(avg(1 + l_quantity::DOUBLE / l_linenumber), 6) AS accepted_length FROM lineitem")
def spec_decode_rates(spark, sf_dir):
    df = views.table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).alias("d"), F.col("l_quantity").cast("double").alias("a"), F.col("l_linenumber").alias("v"))
    return rounded(metrics.spec_decode_rates(df, "d", "a", "v"), "acceptance_rate", "accepted_length")


@add("offline_eval", f"{S}, u AS (SELECT data_source, uid, avg(score) AS m FROM v_sample GROUP BY 1, 2) SELECT data_source, round(avg(m), 6) + 0.0 AS score FROM u GROUP BY 1")
def offline_eval(spark, sf_dir):
    lists = views.samples(spark, sf_dir).groupBy("data_source", "uid").agg(F.collect_list("score").alias("scores"))
    return rounded(metrics.offline_eval(lists, "scores"), "score")


# --- diagnostics over records made from the orders table

_OUT = diagnostics.TERMINAL_OUTCOMES
_REC = f"""WITH o AS (SELECT o_orderkey AS row_id, o_custkey AS uid, [{', '.join(f"'{x}'" for x in _OUT)}][o_orderkey % {len(_OUT)} + 1] AS terminal_outcome, o_orderkey % 23 <> 0 AS ok, o_orderkey % 5 = 0 AS fake0, o_orderkey % {len(_OUT)} < 4 AS eval0,
  CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE ELSE -0.2::DOUBLE END AS reward0, [{', '.join(f"'{x}'" for x in diagnostics.STAGES)}][o_orderkey % 10 + 1] AS stage0 FROM orders),
r AS (SELECT row_id, uid, CASE WHEN ok THEN terminal_outcome ELSE 'unknown' END AS outcome, NOT ok AS missing, ok AND fake0 AS is_fake, ok AND eval0 AS did_eval, CASE WHEN ok THEN reward0 END AS reward, CASE WHEN ok THEN stage0 ELSE 'unknown' END AS stage FROM o)"""


def records(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    reward = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0).otherwise(-0.2)
    events = F.create_map(
        F.lit("action_attempt"), (k % 7 + 3).cast("int"), F.lit("action_parse_success"), (k % 7 + 2).cast("int"), F.lit("action_execute_attempt"), (k % 7 + 1).cast("int"),
        F.lit("action_execute_success"), (k % 7).cast("int"), F.lit("odd_event"), (k % 3).cast("int"), F.lit("repeated_action"), F.lit(-1),
    )
    timing = F.create_map(F.lit("llm_seconds"), (k % 100).cast("double"), F.lit("env_step_seconds"), (k % 50 - 5).cast("double"), F.lit("env_step_timed_count"), (k % 7).cast("double"), F.lit("other"), F.lit(1.0))
    return o.select(
        k.alias("row_id"), F.col("o_custkey").alias("uid"), F.when(k % 23 == 0, 9).otherwise(1).alias("schema_version"), F.when(k % 4 == 0, 0).otherwise(1).alias("timing_metrics_version"),
        pick(_OUT, len(_OUT)).alias("terminal_outcome"), pick(diagnostics.STAGES, 10).alias("final_stage"), F.lit("model").alias("failure_owner"), (k % 5 == 0).alias("is_fake"), (k % len(_OUT) < 4).alias("did_real_eval"),
        reward.alias("reward_score"), events.alias("events"), timing.alias("timing"), F.col("o_orderpriority").alias("task_id"), k.cast("string").alias("request_id"), F.col("o_orderstatus").alias("failure_detail"),
    )


def normal(spark, sf_dir):
    return diagnostics.normalise(records(spark, sf_dir))


def _in(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_RWD = "CASE WHEN reward = 1 THEN 'real_reward_1' WHEN reward = 0 THEN 'real_reward_0' WHEN reward < 0 THEN 'real_reward_negative' ELSE 'real_reward_other' END"
_SET = "CASE " + " ".join(f"WHEN outcome IN {_in(x)} THEN '{n}'" for n, x in diagnostics._SET_REASONS) + " ELSE 'set_other' END"
_FAKE = "CASE " + " ".join(f"WHEN outcome IN {_in(x)} THEN '{n}'" for n, x in diagnostics._FAKE_REASONS) + f" WHEN stage IN {_in(diagnostics._EVAL_STAGES)} THEN 'fake_eval_other' ELSE 'fake_rollout_other' END"
_TFAKE = _FAKE.replace("'rollout_env_init_failed')", "'rollout_env_init_failed', 'reset_git_log_failed')")
_INV = _in(x for x in diagnostics.INVALID_EVAL if x not in diagnostics.APPLY_FAILURE)


@add("diagnostic_buckets", f"""{_REC}, b AS (SELECT 'raw' AS view, CASE WHEN missing THEN 'diagnostics_missing' WHEN is_fake THEN {_FAKE} WHEN did_eval THEN {_RWD} WHEN outcome IN {_INV} THEN 'invalid_eval_nonfake' ELSE {_SET} END AS bucket FROM r
UNION ALL SELECT 'tracker', CASE WHEN missing THEN 'fake_diagnostics_missing' WHEN NOT is_fake AND did_eval AND outcome IN {_in(diagnostics.REAL_EVAL)} THEN {_RWD} WHEN NOT is_fake AND NOT did_eval AND outcome IN {_in(diagnostics.SET_OUTCOMES)} THEN {_SET} ELSE {_TFAKE} END FROM r),
l AS (SELECT view, bucket, count(*) AS n FROM b GROUP BY 1, 2) SELECT * FROM l
UNION ALL SELECT view, CASE WHEN bucket LIKE 'real_reward%' THEN 'real_eval' WHEN bucket LIKE 'set_%' THEN 'set_eval' ELSE 'fake_data' END, sum(n)::BIGINT FROM l WHERE bucket LIKE 'real_reward%' OR bucket LIKE 'set\\_%' ESCAPE '\\' OR bucket LIKE 'fake\\_%' ESCAPE '\\' GROUP BY 1, 2
UNION ALL SELECT view, 'real_data', sum(n)::BIGINT FROM l WHERE bucket NOT LIKE 'fake%' AND bucket <> 'diagnostics_missing' GROUP BY 1 UNION ALL SELECT view, 'total', sum(n)::BIGINT FROM l GROUP BY 1""")
def diagnostic_buckets(spark, sf_dir):
    return diagnostics.buckets(normal(spark, sf_dir)).select("view", "bucket", "n")


@add("outcome_frequency", f"{_REC}, n AS (SELECT unnest([{', '.join(repr(x) for x in _OUT)}]) AS name) SELECT name, count(r.row_id) AS n FROM n LEFT JOIN r ON r.outcome = n.name GROUP BY name")
def outcome_frequency(spark, sf_dir):
    return diagnostics.frequency(normal(spark, sf_dir), "terminal_outcome", _OUT)


@add("event_totals", f"""{_REC}, e AS (SELECT unnest(['action_attempt', 'action_parse_success', 'action_execute_attempt', 'action_execute_success', 'unknown_event']) AS event, unnest([row_id % 7 + 3, row_id % 7 + 2, row_id % 7 + 1, row_id % 7, row_id % 3]) AS k FROM r WHERE NOT missing)
SELECT event, sum(k)::BIGINT AS occurrences, count(*) AS trajectories FROM e WHERE k > 0 GROUP BY event""")
def event_totals(spark, sf_dir):
    return diagnostics.event_totals(normal(spark, sf_dir))


@add("top_tasks", f"{_REC}, c AS (SELECT outcome AS terminal_outcome, o_orderpriority AS task_id, count(*) AS n, min(row_id) AS f FROM r JOIN orders ON o_orderkey = row_id GROUP BY 1, 2), k AS (SELECT terminal_outcome, task_id, n, row_number() OVER (PARTITION BY terminal_outcome ORDER BY n DESC, f) AS rank FROM c) SELECT * FROM k WHERE rank <= 3")
def top_tasks(spark, sf_dir):
    return diagnostics.top_tasks(normal(spark, sf_dir), 3)


@add("group_health", f"""{_REC}, g AS (SELECT uid, count(*) AS n, count(*) FILTER (missing) AS m, count(*) FILTER (is_fake) AS f FROM r GROUP BY uid), h AS (SELECT *, CASE WHEN n <> 10 THEN 'incomplete' WHEN m > 0 THEN 'diagnostics_missing' WHEN f = 0 THEN 'all_real' WHEN f = n THEN 'all_fake' ELSE 'partial_fake' END AS health FROM g)
SELECT uid, health, CASE WHEN health = 'partial_fake' THEN f ELSE 0 END AS fake_rows, CASE WHEN health = 'partial_fake' THEN n - f ELSE 0 END AS real_rows FROM h""")
def group_health(spark, sf_dir):
    return diagnostics.group_health(normal(spark, sf_dir), 10)


@add("action_funnel", f"{_REC} SELECT sum(row_id % 7 + 3)::BIGINT AS total, sum(row_id % 7 + 2)::BIGINT AS parsed, sum(row_id % 7 + 1)::BIGINT AS dispatched, sum(row_id % 7)::BIGINT AS executed FROM r WHERE NOT missing")
def action_funnel(spark, sf_dir):
    return diagnostics.action_funnel(normal(spark, sf_dir))


@add("timing_summary", f"""{_REC}, t AS (SELECT unnest(['llm_seconds', 'env_step_seconds']) AS field, unnest([(row_id % 100)::DOUBLE, (row_id % 50 - 5)::DOUBLE]) AS v FROM r WHERE NOT missing AND row_id % 4 <> 0), s AS (SELECT field, count(*) AS samples, avg(v) AS mean, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, max(v) AS max FROM t WHERE v >= 0 GROUP BY field),
n AS (SELECT unnest([{', '.join(repr(x) for x in diagnostics.TIMINGS)}]) AS field) SELECT n.field, coalesce(samples, 0) AS samples, round(mean, 6) AS mean, round(p50, 6) AS p50, round(p95, 6) AS p95, round(max, 6) AS max FROM n LEFT JOIN s USING (field)""")
def timing_summary(spark, sf_dir):
    return rounded(diagnostics.timing_summary(normal(spark, sf_dir)), "mean", "p50", "p95", "max")


@add("action_timing", f"""{_REC}, t AS (SELECT row_id % 4 <> 0 AS timed, row_id % 7 AS n, row_id % 50 - 5 AS s, row_id % 7 + 1 AS d FROM r WHERE NOT missing), x AS (SELECT sum(CASE WHEN timed THEN n ELSE 0 END) AS c, sum(CASE WHEN timed AND n > 0 AND s >= 0 THEN s ELSE 0 END)::DOUBLE AS q, sum(d) AS d FROM t)
SELECT c::BIGINT AS timed_count, q AS sum_seconds, round(q / c, 6) AS mean_seconds, round(c / d, 6) AS coverage FROM x""")
def action_timing(spark, sf_dir):
    return rounded(diagnostics.action_timing(normal(spark, sf_dir)), "sum_seconds", "mean_seconds", "coverage")


@add("final_outcomes", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 7 THEN 'patch_empty' WHEN l_linenumber = 6 THEN 'tests_error' WHEN l_linenumber = 5 THEN 'unknown'
WHEN l_tax::DOUBLE >= 0.05::DOUBLE AND l_discount::DOUBLE >= 0.05::DOUBLE THEN 'resolved_full' WHEN l_discount > 0 AND l_tax::DOUBLE >= 0.05::DOUBLE THEN 'resolved_partial' WHEN l_tax::DOUBLE < 0.05::DOUBLE THEN 'unresolved_regression' ELSE 'unresolved_no_progress' END AS outcome FROM lineitem""")
def final_outcomes(spark, sf_dir):
    n = F.col("l_linenumber")
    out = diagnostics.final_outcome(
        F.when(n == 7, "patch_empty").otherwise("unknown"), F.when(n == 6, "tests_error").otherwise(""), n != 5, F.lit(False),
        F.col("l_discount").cast("double") * 20, F.when(F.col("l_tax").cast("double") >= 0.05, 1.0).otherwise(0.0),
    )
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", out.alias("outcome"))


# --- scores and parsing


@add("score_gsm8k", """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'so 1,000 and 7' ELSE 'thus #### ' || (o_custkey % 10) END AS t, CAST(o_custkey % 7 AS VARCHAR) AS truth FROM orders)
SELECT o_orderkey, CASE WHEN NOT contains(t, '####') THEN 0.0::DOUBLE WHEN regexp_extract(t, '#### (-?[0-9.,]+)', 1) = truth THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS strict, CASE WHEN (CASE WHEN contains(t, '####') THEN regexp_extract(t, '#### (-?[0-9.,]+)', 1) ELSE '7' END) = truth THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS flexible FROM s""")
def score_gsm8k(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "so 1,000 and 7").otherwise(F.concat(F.lit("thus #### "), (F.col("o_custkey") % 10).cast("string"))).alias("t"), (F.col("o_custkey") % 7).cast("string").alias("truth"))
    return o.select("o_orderkey", scoring.gsm8k(F.col("t"), F.col("truth"), format_score=0.1).alias("strict"), scoring.gsm8k(F.col("t"), F.col("truth"), "flexible", format_score=0.1).alias("flexible"))


@add("score_qa", """WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE '<answer>x</answer> <answer> The ' || upper(c_mktsegment) || '! </answer>' END AS t FROM customer)
SELECT c_custkey, CASE WHEN t = 'none' THEN 0.0::DOUBLE WHEN contains(t, 'BUILDING') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em, CASE WHEN t <> 'none' AND regexp_matches(t, 'BUILD|AUTO') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sub FROM s""")
def score_qa(spark, sf_dir):
    t = F.when(F.col("c_custkey") % 5 == 0, "none").otherwise(F.concat(F.lit("<answer>x</answer> <answer> The "), F.upper("c_mktsegment"), F.lit("! </answer>")))
    return views.table(spark, sf_dir, "customer").select("c_custkey", scoring.qa_match(t, F.array(F.lit("a building"))).alias("em"), scoring.qa_match(t, F.array(F.lit("build"), F.lit("Auto")), part=True).alias("sub"))


@add("score_math", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score, o_orderkey % 2 = 0 AS acc, CASE WHEN o_orderkey % 2 = 0 THEN '1234' ELSE '[INVALID]' END AS pred FROM orders""")
def score_math(spark, sf_dir):
    t = F.when(F.col("o_orderkey") % 2 == 0, r"so Answer: $x = 1,234$ dollars").otherwise("no idea")
    r = scoring.math_answer(t, F.lit("1234"))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", r["score"].alias("score"), r["acc"].alias("acc"), r["pred"].alias("pred"))


@add("score_boxed", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM orders")
def score_boxed(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, r"is \boxed{\frac12}").when(k == 1, r"\boxed{9} then \boxed{\dfrac{1}{2}}").when(k == 2, r"\boxed{2}").otherwise(r"\boxed{\frac{1}{2}")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(scoring.math_boxed(t, F.lit("1/2")), F.lit(0.0)).alias("score"))


@add("graded_tests", """WITH t AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'FAIL_TO_PASS' ELSE 'PASS_TO_PASS' END AS kind, CASE WHEN l_returnflag = 'A' THEN 'PASSED' WHEN l_returnflag = 'N' AND l_linenumber % 3 = 0 THEN 'SKIPPED' WHEN l_returnflag = 'N' THEN 'XFAIL' WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'FAILED' END AS status FROM lineitem),
r AS (SELECT id, coalesce((count(*) FILTER (kind = 'FAIL_TO_PASS' AND status IN ('PASSED', 'XFAIL')))::DOUBLE / nullif(count(*) FILTER (kind = 'FAIL_TO_PASS' AND (status IS NULL OR status <> 'SKIPPED')), 0), 1.0) AS f2p_rate, coalesce((count(*) FILTER (kind = 'PASS_TO_PASS' AND status IN ('PASSED', 'XFAIL')))::DOUBLE / nullif(count(*) FILTER (kind = 'PASS_TO_PASS' AND (status IS NULL OR status <> 'SKIPPED')), 0), 1.0) AS p2p_rate FROM t GROUP BY id),
s AS (SELECT *, CASE WHEN f2p_rate = 1 AND p2p_rate = 1 THEN 'FULL' WHEN f2p_rate < 1 AND f2p_rate > 0 AND p2p_rate = 1 THEN 'PARTIAL' ELSE 'NO' END AS resolution FROM r)
SELECT id, round(f2p_rate, 6) AS f2p_rate, round(p2p_rate, 6) AS p2p_rate, resolution, round(CASE WHEN resolution = 'FULL' THEN 1.0 WHEN f2p_rate > 0 THEN f2p_rate * p2p_rate WHEN p2p_rate >= 1 THEN 0.05 ELSE 0 END, 6) AS reward FROM s""")
def graded_tests(spark, sf_dir):
    f, n = F.col("l_returnflag"), F.col("l_linenumber") % 3 == 0
    status = F.when(f == "A", "PASSED").when((f == "N") & n, "SKIPPED").when(f == "N", "XFAIL").when(n, F.lit(None).cast("string")).otherwise("FAILED")
    tests = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "FAIL_TO_PASS").otherwise("PASS_TO_PASS").alias("kind"), status.alias("status"))
    graded = scoring.graded_tests(tests, "id")
    made = graded.withColumn("reward", scoring.report_reward(F.col("resolution") == "FULL", F.col("f2p_rate"), F.col("p2p_rate"), sparse=False))
    return rounded(made, "f2p_rate", "p2p_rate", "reward")


@add("overlong_penalty", "SELECT doc_id, round(least(-(n_chars - 1500) / 500.0::DOUBLE, 0.0), 6) + 0.0 AS penalty FROM documents")
def overlong_penalty(spark, sf_dir):
    return rounded(views.table(spark, sf_dir, "documents").select("doc_id", scoring.overlong_penalty(F.col("n_chars"), 2000, 500).alias("penalty")), "penalty")


@add("hermes_calls", """SELECT event_id, 0 AS call_no, event_type AS name, replace(props, ' ', '') AS arguments FROM events""")
def hermes_calls(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events")
    text = F.concat(F.lit('say <tool_call>{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}</tool_call> <tool_call>broken</tool_call>"))
    return parsing.call_rows(ev.withColumn("t", text), parsing.tool_calls(F.col("t"), "hermes"), "event_id")


@add("xml_calls", """SELECT event_id, 0 AS call_no, 'run' AS name, '{"cmd": "ls ' || event_id || '", "n": ' || (user_id % 9) || ', "ok": true}' AS arguments FROM events""")
def xml_calls(spark, sf_dir):
    text = F.format_string("<tool_call>\n<function=run>\n<parameter=cmd>\nls %d\n</parameter>\n<parameter=n>\n%d\n</parameter>\n<parameter=ok>True</parameter>\n</function>\n</tool_call>", F.col("event_id"), F.col("user_id") % 9)
    ev = views.table(spark, sf_dir, "events").withColumn("t", text)
    return parsing.call_rows(ev, parsing.tool_calls(F.col("t"), "xml", {"run": {"cmd": "string", "n": "integer", "ok": "boolean"}}), "event_id")


@add("envelope_errors", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'no call' WHEN 2 THEN 'opening and closing tags differ|a call is not closed|text after the last call' ELSE 'text after the last call' END AS errors FROM events")
def envelope_errors(spark, sf_dir):
    whole = "<tool_call><function=f><parameter=a>1</parameter></function></tool_call>"
    k = F.col("event_id") % 4
    text = F.when(k == 0, whole).when(k == 1, "hello").when(k == 2, whole + "<tool_call>").otherwise(whole + " and more")
    return views.table(spark, sf_dir, "events").select("event_id", F.array_join(parsing.envelope_errors(text), "|").alias("errors"))


@add("single_actions", "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN event_type END AS command, CASE WHEN event_id % 3 = 0 THEN 'expected 1 action, found 0' WHEN event_id % 3 = 2 THEN 'expected 1 action, found 2' END AS error FROM events")
def single_actions(spark, sf_dir):
    one = F.concat(F.lit("```bash\n"), "event_type", F.lit("\n```"))
    k = F.col("event_id") % 3
    text = F.when(k == 0, "none").when(k == 1, one).otherwise(F.concat(one, F.lit(" "), one))
    r = parsing.single_action(text, r"```bash\s*\n(.*?)\n```")
    return views.table(spark, sf_dir, "events").select("event_id", r["command"].alias("command"), r["error"].alias("error"))


@add("call_verdicts", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'no tool call' WHEN 2 THEN 'unknown tool' WHEN 3 THEN 'unexpected arguments' ELSE 'empty command' END AS verdict FROM events")
def call_verdicts(spark, sf_dir):
    k = F.col("event_id") % 5
    call = lambda name, args: F.array(F.struct(F.lit(name).alias("name"), F.lit(args).alias("arguments")))
    calls = F.when(k == 0, call("bash", '{"command": "ls"}')).when(k == 1, F.array().cast(parsing.CALLS)).when(k == 2, call("sh", '{"command": "ls"}')).when(k == 3, call("bash", '{"command": "ls", "cwd": "/"}')).otherwise(call("bash", '{"command": " "}'))
    return views.table(spark, sf_dir, "events").withColumn("calls", calls).select("event_id", parsing.call_verdict(F.col("calls")).alias("verdict"))


@add("loss_mask_tokens", "SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN greatest(length(text) - 2, 0) ELSE 0 END)::BIGINT AS trained, sum(length(text))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def loss_mask_tokens(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations").select("conv_id", parsing.loss_mask(F.col("role"), F.length("text"), 2).alias("m"))
    return c.groupBy("conv_id").agg(F.sum(F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x)).alias("trained"), F.sum(F.size("m")).alias("tokens"))


@add("normal_answers", "SELECT c_custkey, lower(c_mktsegment) AS answer FROM customer")
def normal_answers(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select("c_custkey", T.normal_answer(F.concat(F.lit("  The "), "c_mktsegment", F.lit("!, an"))).alias("answer"))


@add("multiset_jaccard", "WITH a AS (SELECT o_custkey AS uid, o_orderpriority AS p, count(*) FILTER (o_orderstatus = 'F') AS l, count(*) FILTER (o_orderstatus = 'O') AS r FROM orders GROUP BY 1, 2) SELECT uid, round(CASE WHEN sum(l) + sum(r) = 0 THEN 1 ELSE sum(least(l, r))::DOUBLE / sum(greatest(l, r)) END, 6) AS share FROM a GROUP BY uid")
def multiset_jaccard(spark, sf_dir):
    of = lambda s: F.collect_list(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    g = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(of("F").alias("l"), of("O").alias("r"))
    return rounded(g.select("uid", T.multiset_jaccard(F.col("l"), F.col("r")).alias("share")), "share")


@add("canonical_json", "SELECT event_id, '{\"a\":' || user_id || ',\"b\":' || replace(props, ' ', '') || '}' AS j FROM events")
def canonical_json(spark, sf_dir):
    text = F.concat(F.lit('{ "b": '), "props", F.lit(', "a": '), F.col("user_id").cast("string"), F.lit("}"))
    return views.table(spark, sf_dir, "events").select("event_id", T.canonical_json(text).alias("j"))


# --- the dataset build: filters, then routing on what is left, then length and assembly


@add("build_dataset", """WITH k AS (SELECT d.* FROM documents d WHERE lang IN ('en', 'de') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT doc_id, source AS data_source, 'user' AS role, length(text) AS prompt_length, coalesce(l.quality, -1) AS quality FROM k LEFT JOIN labels l USING (doc_id) WHERE length(text) <= 4000""")
def build_dataset(spark, sf_dir):
    d, labels = views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "labels")
    kept = joins.drop_ids(d.filter(F.col("lang").isin("en", "de")), "doc_id", labels.filter("toxic = 1"))
    joined = joins.coalesce_fields(kept.join(labels.select("doc_id", "quality"), "doc_id", "left"), {"grade": (["quality"], -1)})
    short = joins.keep_short(joined, F.length("text"), 4000)
    prompt = joins.user_roles(F.array(F.struct(F.lit("system").alias("role"), F.col("text").alias("content"))))
    return short.select("doc_id", F.col("source").alias("data_source"), prompt[0]["role"].alias("role"), F.length("text").alias("prompt_length"), F.col("grade").alias("quality"))


@add("stale_count", "SELECT count(*) FILTER (100 - user_id >= 1) AS stale, count(*) AS rows FROM events")
def stale_count(spark, sf_dir):
    return queues.stale_count(views.events(spark, sf_dir), "uid", 100)


@add("assembly_stats", f"{E} SELECT event AS batch, count(*) AS n, round(avg(value), 6) AS avg, round(max(value), 6) AS max, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(DISTINCT uid) AS versions, max(uid) - min(uid) AS span FROM v_event GROUP BY event")
def assembly_stats(spark, sf_dir):
    made = queues.assembly_stats(views.events(spark, sf_dir), "event", "value", "uid").withColumnRenamed("event", "batch")
    return rounded(made, "avg", "max", "min", "p50", "p95", "p99")
