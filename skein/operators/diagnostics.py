"""Trajectory diagnostics: normalised records, outcome buckets, funnels, group health and timing.

Records have schema_version, terminal_outcome, final_stage, failure_owner, is_fake, did_real_eval, reward_score,
events (map of counts), timing (map of seconds), timing_metrics_version, task_id, request_id, failure_detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.quantiles import quantiles

SCHEMA_VERSION = 1
# Terminal outcomes.
REAL_EVAL = ("resolved_full", "resolved_partial", "unresolved_regression", "unresolved_no_progress")
APPLY_FAILURE = ("patch_apply_timeout", "patch_apply_failed", "harness_apply_patch_failed")
INVALID_EVAL = (
    "eval_env_init_timeout", "eval_env_init_failed", "patch_apply_timeout", "patch_apply_failed", "eval_timeout", "eval_output_limit",
    "eval_execution_failed", "harness_apply_patch_failed", "harness_reset_failed", "tests_timeout", "tests_error", "test_markers_missing",
    "test_parser_empty", "eval_report_missing",
)
TERMINAL_OUTCOMES = (
    *REAL_EVAL, "rollout_env_init_timeout", "rollout_env_init_failed", "reset_git_log_failed", "rollout_global_timeout", "rollout_internal_error",
    "rollout_step_infra_failed", "trajectory_output_missing", "prompt_too_long", "action_timeout_limit", "repeated_action_limit",
    "response_length_limit", "assistant_turn_limit", "patch_empty", "agent_terminated_other", *INVALID_EVAL, "skipped_other", "unknown",
)
INFRA_FAILURE = (
    "rollout_env_init_timeout", "rollout_env_init_failed", "reset_git_log_failed", "rollout_internal_error", "rollout_step_infra_failed",
    "trajectory_output_missing", "eval_env_init_timeout", "eval_env_init_failed", "eval_execution_failed", "harness_reset_failed",
)
# Names of events, timings, owners and stages.
EVENTS = (
    "action_attempt", "action_parse_success", "action_execute_attempt", "action_execute_success", "action_parse_failed", "native_tool_protocol_error",
    "submission_attempt", "submission_protocol_rejected", "submission_patch_empty_rejected", "submission_patch_invalid_rejected", "accepted_submission",
    "manual_patch_write_blocked", "action_timeout", "repeated_action", "action_output_limit", "action_system_error", "action_nonzero_exit",
    "submission_timeout", "unknown_event",
)
TIMINGS = ("trajectory_wall_seconds", "rollout_env_init_seconds", "interaction_seconds", "llm_seconds", "env_step_seconds", "final_eval_seconds")
OWNERS = ("model", "infra", "evaluator", "unknown")
STAGES = ("rollout_env_init", "rollout", "prompt", "action", "submission", "eval_env_init", "apply_patch", "evaluation", "tests", "unknown")
# Failure codes that name their outcome.
FAILURE_CODES = ("harness_apply_patch_failed", "harness_reset_failed", "tests_timeout", "tests_error", "test_markers_missing", "test_parser_empty", "eval_report_missing")

# Reasons of buckets and the outcomes that stand for them.
_SET_REASONS = (
    ("set_terminated_turns", ("assistant_turn_limit",)), ("set_terminated_response", ("response_length_limit",)),
    ("set_terminated_other", ("agent_terminated_other",)), ("set_patch_empty", ("patch_empty",)), ("set_patch_apply_failed", APPLY_FAILURE),
    ("set_agent_timeout", ("action_timeout_limit",)), ("set_repeated_action", ("repeated_action_limit",)),
)
_FAKE_REASONS = (
    ("fake_task_skipped", ("prompt_too_long", "skipped_other")), ("fake_rollout_global_timeout", ("rollout_global_timeout",)),
    ("fake_rollout_env_failed", ("rollout_env_init_timeout", "rollout_env_init_failed")), ("fake_eval_env_failed", ("eval_env_init_timeout", "eval_env_init_failed")),
    ("fake_eval_timeout", ("eval_timeout", "tests_timeout")),
    ("fake_eval_execution_error", ("eval_output_limit", "eval_execution_failed", "harness_apply_patch_failed", "harness_reset_failed", "tests_error", "test_markers_missing", "test_parser_empty", "eval_report_missing")),
)
_EVAL_STAGES = ("eval_env_init", "apply_patch", "evaluation", "tests")
SET_OUTCOMES = tuple(o for _, names in _SET_REASONS for o in names)


def _known(value: Column, names: tuple[str, ...]) -> Column:
    return F.when(value.isin(*names), value).otherwise("unknown")


def normalise(df: DataFrame) -> DataFrame:
    """Clamps enumerations, events and timings; a record of another version becomes unknown and ``missing``."""
    good = F.coalesce(F.col("schema_version") == SCHEMA_VERSION, F.lit(False))
    positive = F.map_filter("events", lambda _k, v: v > 0)
    total = lambda name: F.aggregate(F.map_values(F.map_filter(positive, lambda k, _v: ~k.isin(*EVENTS[:-1]))), F.lit(0), lambda s, v: s + v)  # noqa: E731, ARG005
    named = F.map_filter(positive, lambda k, _v: k.isin(*EVENTS[:-1]))
    events = F.when(total(None) > 0, F.map_concat(named, F.create_map(F.lit(EVENTS[-1]), total(None)))).otherwise(named)
    timed = F.coalesce(F.col("timing_metrics_version") == 1, F.lit(False))
    finite = lambda v: (v >= 0) & ~F.isnan(v) & (v < float("inf"))
    timing = F.when(timed, F.map_filter("timing", lambda k, v: k.isin(*TIMINGS, "env_step_timed_count") & finite(v)))
    empty = F.create_map().cast("map<string,double>")
    return df.withColumns({
        "terminal_outcome": F.when(good, _known(F.col("terminal_outcome"), TERMINAL_OUTCOMES)).otherwise("unknown"),
        "failure_owner": F.when(good, _known(F.col("failure_owner"), OWNERS)).otherwise("unknown"),
        "final_stage": F.when(good, _known(F.col("final_stage"), STAGES)).otherwise("unknown"),
        "events": F.when(good, events).otherwise(F.create_map().cast("map<string,int>")),
        "timing": F.when(good, F.coalesce(timing, empty)).otherwise(empty), "timed": good & timed,
        "is_fake": good & F.coalesce("is_fake", F.lit(False)), "did_real_eval": good & F.coalesce("did_real_eval", F.lit(False)),
        "reward_score": F.when(good, F.col("reward_score")), "missing": ~good,
    })


def final_outcome(outcome: Column, code: Column, did_eval: Column, resolved: Column, f2p: Column, p2p: Column) -> Column:
    """An outcome that is already known stays; else the failure code; else what the tests say, in this order."""
    by_tests = F.when(resolved | ((f2p >= 1) & (p2p >= 1)), "resolved_full").when((f2p > 0) & (p2p >= 1), "resolved_partial").when(p2p < 1, "unresolved_regression").otherwise("unresolved_no_progress")
    return F.when(outcome != "unknown", outcome).when(code.isin(*FAILURE_CODES), code).when(did_eval, by_tests).otherwise("unknown")


def terminal_outcomes(events: DataFrame, key: str, order: str, outcome: str = "outcome") -> DataFrame:
    """The first outcome of each trajectory that is not unknown."""
    first = F.min_by(outcome, F.when(F.col(outcome) != "unknown", F.col(order)))
    return events.groupBy(key).agg(F.coalesce(first, F.lit("unknown")).alias(outcome))


def frequency(df: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """name, n for every name, 0 where it does not occur."""
    every = df.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return F.broadcast(every).join(df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("c")), "name", "left").select("name", F.coalesce("c", F.lit(0)).alias("n"))


def event_totals(df: DataFrame) -> DataFrame:
    """event, occurrences, trajectories."""
    return df.select(F.explode("events").alias("event", "k")).groupBy("event").agg(F.sum("k").alias("occurrences"), F.count("*").alias("trajectories"))


def top_tasks(df: DataFrame, k: int, outcome: str = "terminal_outcome", task: str = "task_id", order: str = "row_id") -> DataFrame:
    """The k most frequent tasks of each outcome, ties by who came first."""
    counts = df.groupBy(outcome, task).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy(outcome).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("first")


def first_examples(df: DataFrame, k: int, outcome: str = "terminal_outcome", detail: str = "failure_detail", order: str = "row_id") -> DataFrame:
    w = Window.partitionBy(outcome).orderBy(order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn(detail, F.substring(detail, 1, 300))


def group_health(df: DataFrame, size: int, uid: str | tuple[str, ...] = "uid", expected: DataFrame | None = None) -> DataFrame:
    """uid (or the columns that name a group), health, fake_rows, real_rows: incomplete, diagnostics_missing, all_real, all_fake or partial_fake, in this order."""
    names = (uid,) if isinstance(uid, str) else uid
    per = df.groupBy(*names).agg(F.count("*").alias("n"), F.count_if(F.col("missing")).alias("m"), F.count_if(F.col("is_fake")).alias("f"))
    rows = per if expected is None else expected.select(*names).distinct().join(per, list(names), "left").fillna(0, ["n", "m", "f"])
    health = F.when((F.col("n") != size) if size > 0 else F.lit(False), "incomplete").when(F.col("m") > 0, "diagnostics_missing").when(F.col("f") == 0, "all_real").when(F.col("f") == F.col("n"), "all_fake").otherwise("partial_fake")
    partial = F.col("health") == "partial_fake"
    return rows.withColumn("health", health).select(*names, "health", F.when(partial, F.col("f")).otherwise(0).alias("fake_rows"), F.when(partial, F.col("n") - F.col("f")).otherwise(0).alias("real_rows"))


def _first_match(outcome: Column, table, otherwise: Column) -> Column:
    out = otherwise
    for name, outcomes in reversed(table):
        out = F.when(outcome.isin(*outcomes), F.lit(name)).otherwise(out)
    return out


def _reward_bucket(reward: Column) -> Column:
    finite = reward.isNotNull() & ~F.isnan(reward) & (F.abs(reward) < float("inf"))
    return F.when(finite & (reward == 1), "real_reward_1").when(finite & (reward == 0), "real_reward_0").when(finite & (reward < 0), "real_reward_negative").otherwise("real_reward_other")


def raw_bucket(df: DataFrame) -> Column:
    """One leaf for each normalised record: what the agent's data says."""
    o = F.col("terminal_outcome")
    fake = _first_match(o, _FAKE_REASONS, F.when(F.col("final_stage").isin(*_EVAL_STAGES), "fake_eval_other").otherwise("fake_rollout_other"))
    invalid = tuple(x for x in INVALID_EVAL if x not in APPLY_FAILURE)
    real = F.when(F.col("did_real_eval"), _reward_bucket(F.col("reward_score"))).when(o.isin(*invalid), "invalid_eval_nonfake").otherwise(_first_match(o, _SET_REASONS, F.lit("set_other")))
    return F.when(F.col("missing"), "diagnostics_missing").when(F.col("is_fake"), fake).otherwise(real)


def tracker_bucket(df: DataFrame) -> Column:
    """One leaf for each normalised record: real only if tests ran, or if an outcome sets the evaluation."""
    o = F.col("terminal_outcome")
    reasons = tuple((n, (*x, "reset_git_log_failed")) if n == "fake_rollout_env_failed" else (n, x) for n, x in _FAKE_REASONS)
    fake = _first_match(o, reasons, F.when(F.col("final_stage").isin(*_EVAL_STAGES), "fake_eval_other").otherwise("fake_rollout_other"))
    docker = ~F.col("is_fake") & F.col("did_real_eval") & o.isin(*REAL_EVAL)
    by_set = ~F.col("is_fake") & ~F.col("did_real_eval") & o.isin(*SET_OUTCOMES)
    return F.when(F.col("missing"), "fake_diagnostics_missing").when(docker, _reward_bucket(F.col("reward_score"))).when(by_set, _first_match(o, _SET_REASONS, F.lit("set_other"))).otherwise(fake)


def buckets(df: DataFrame) -> DataFrame:
    """view, bucket, n: the leaves of both views, and totals that must add up, or it raises."""
    both = df.select(F.explode(F.array(F.struct(F.lit("raw").alias("view"), raw_bucket(df).alias("bucket")), F.struct(F.lit("tracker").alias("view"), tracker_bucket(df).alias("bucket")))).alias("x"))
    leaves = both.groupBy(F.col("x.view").alias("view"), F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))
    parent = F.when(F.col("bucket").startswith("real_reward"), "real_eval").when(F.col("bucket").startswith("set_"), "set_eval").when(F.col("bucket").startswith("fake_"), "fake_data").otherwise(F.col("bucket"))
    middle = leaves.filter(parent != F.col("bucket")).groupBy("view", parent.alias("bucket")).agg(F.sum("n").alias("n"))
    real = leaves.filter(~F.col("bucket").startswith("fake_") & (F.col("bucket") != "diagnostics_missing")).groupBy("view").agg(F.sum("n").alias("n")).withColumn("bucket", F.lit("real_data"))
    total = leaves.groupBy("view").agg(F.sum("n").alias("n"), F.sum(F.when(parent == "fake_data", F.col("n")).otherwise(0)).alias("f"), F.sum(F.when(F.col("bucket") == "diagnostics_missing", F.col("n")).otherwise(0)).alias("m"))
    checked = total.join(real.select("view", F.col("n").alias("r")), "view", "left").select("view", F.lit("total").alias("bucket"), F.when(F.col("n") == F.coalesce("r", F.lit(0)) + F.col("f") + F.col("m"), F.col("n")).otherwise(F.raise_error(F.lit("buckets do not add up")).cast("long")).alias("n"))
    return leaves.unionByName(middle).unionByName(real).unionByName(checked)


def action_funnel(df: DataFrame, dispatched_known: bool = True) -> DataFrame:
    """One row: executed <= dispatched <= parsed <= total, or it raises; older records dispatch what they parse."""
    count = lambda name: F.coalesce(F.sum(F.coalesce(F.col("events")[name], F.lit(0))), F.lit(0)).cast("long")
    one = df.agg(count("action_attempt").alias("total"), count("action_parse_success").alias("parsed"), count("action_execute_attempt").alias("dispatched"), count("action_execute_success").alias("executed"))
    if not dispatched_known:
        one = one.withColumn("dispatched", F.col("parsed"))
    good = (F.col("executed") <= F.col("dispatched")) & (F.col("dispatched") <= F.col("parsed")) & (F.col("parsed") <= F.col("total"))
    return one.withColumn("total", F.when(good, F.col("total")).otherwise(F.raise_error(F.lit("the action counts are out of order")).cast("long")))


def rate(count: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(count, total), F.lit(0.0))


def timing_summary(df: DataFrame) -> DataFrame:
    """field, samples, mean, p50, p95, max of each timing; null statistics without a sample."""
    every = df.sparkSession.createDataFrame([(n,) for n in TIMINGS], "field string")
    long = df.select(F.explode("timing").alias("field", "v"))
    plain = long.groupBy("field").agg(F.count("v").alias("samples"), F.avg("v").alias("mean"), F.max("v").alias("max"))
    stats = plain.join(quantiles(long, "v", {"p50": 0.5, "p95": 0.95}, "field"), "field")
    return every.join(stats.select("field", "samples", "mean", "p50", "p95", "max"), "field", "left").withColumn("samples", F.coalesce("samples", F.lit(0)))


def action_timing(df: DataFrame, dispatched: str = "action_execute_attempt") -> DataFrame:
    """Timed action calls, their pooled mean seconds, and how many of the dispatched ones are timed."""
    n = F.coalesce(F.col("timing")["env_step_timed_count"], F.lit(0.0))
    one = df.agg(F.sum(n).cast("long").alias("timed_count"), F.sum(F.when(n > 0, F.coalesce(F.col("timing")["env_step_seconds"], F.lit(0.0))).otherwise(0.0)).alias("sum_seconds"), F.sum(F.coalesce(F.col("events")[dispatched], F.lit(0))).alias("__d"))
    mean = F.when(F.col("timed_count") > 0, F.col("sum_seconds") / F.col("timed_count"))
    return one.select("timed_count", "sum_seconds", mean.alias("mean_seconds"), rate(F.col("timed_count"), F.col("__d")).alias("coverage"))
