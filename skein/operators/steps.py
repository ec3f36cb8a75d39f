"""Step summaries: all counts of a (phase, step) as one long table of facts, its tracker layout and its text report.

A record is exploded into the facts that it stands for (a section, a name, a number), and one aggregate adds them up,
whatever the number of steps. Layout and report only read the facts of a step, which are a bounded list of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import diagnostics as D
from skein.operators.quantiles import quantiles

KEYS = ("phase", "step")
# Sections of the tracker by phase, leaf names, the buckets that they add up, and the bucket they are a
# share of (none: a count).
SECTIONS = {
    "overview": ("swe1train", "swe1val"), "real": ("swe2trainreal", "swe3valreal"), "fake": ("swe4trainfake", "swe5valfake"),
    "time": ("swe6traintime", "swe6valtime"), "action": ("swe7trainact", "swe7valact"),
}
LAYOUT = (
    ("overview", "traj_cnt", ("total",), None), ("overview", "real_rate", ("real_data",), "total"), ("overview", "docker_eval_rate", ("real_eval",), "total"),
    ("overview", "set_eval_rate", ("set_eval",), "total"), ("overview", "fake_rate", ("fake_data",), "total"),
    ("overview", "eval_fail_rate", ("fake_eval_failed", "set_patch_apply_failed"), "total"), ("overview", "miss_rate", ("fake_diagnostics_missing",), "total"),
    ("real", "docker_eval_rate", ("real_eval",), "total"), ("real", "set_eval_rate", ("set_eval",), "total"), ("real", "resp_limit_rate", ("set_terminated_response",), "total"),
    ("real", "turn_limit_rate", ("set_terminated_turns",), "total"), ("real", "act_timeout_rate", ("set_agent_timeout",), "total"),
    ("real", "repeat_act_rate", ("set_repeated_action",), "total"), ("real", "patch_empty_rate", ("set_patch_empty",), "total"),
    ("real", "patch_fail_rate", ("set_patch_apply_failed",), "total"), ("real", "reward1_rate", ("real_reward_1",), "real_eval"),
    ("real", "reward0_rate", ("real_reward_0",), "real_eval"), ("real", "rewardneg_rate", ("real_reward_negative",), "real_eval"),
    ("real", "rewardother_rate", ("real_reward_other",), "real_eval"), ("real", "set_other_rate", ("set_terminated_other", "set_other"), "total"),
    ("fake", "fake_cnt", ("fake_data",), None), ("fake", "rollout_env_fail_rate", ("fake_rollout_env_failed",), "total"),
    ("fake", "rollout_timeout_rate", ("fake_rollout_global_timeout",), "total"), ("fake", "eval_env_fail_rate", ("fake_eval_env_failed",), "total"),
    ("fake", "eval_timeout_rate", ("fake_eval_timeout",), "total"), ("fake", "eval_error_rate", ("fake_eval_execution_error",), "total"),
    ("fake", "eval_other_rate", ("fake_eval_other",), "total"), ("fake", "task_skip_rate", ("fake_task_skipped",), "total"),
    ("fake", "rollout_other_error_rate", ("fake_rollout_other",), "total"), ("fake", "diag_miss_rate", ("fake_diagnostics_missing",), "total"),
)
ACTIONS = (
    ("act_cnt", "action_attempt", None), ("parse_success_rate", "action_parse_success", "action_attempt"),
    ("dispatch_cnt", "action_execute_attempt", None), ("execute_success_rate", "action_execute_success", "action_execute_attempt"),
)
TIMES = (
    ("traj_s", "trajectory_wall_seconds"), ("rollout_env_init_s", "rollout_env_init_seconds"), ("llm_s", "llm_seconds"),
    ("env_step_s", "env_step_seconds"), ("eval_s", "final_eval_seconds"),
)
REWARD_LEAVES = ("reward1_rate", "reward0_rate", "rewardneg_rate", "rewardother_rate")
EVAL_FAILED = ("fake_eval_env_failed", "fake_eval_timeout", "fake_eval_execution_error", "fake_eval_other")


def _version(df: DataFrame, column: str, wanted: int) -> Column:
    """Whether a record carries an instrumentation; a table without the column is taken to carry it."""
    return ~F.col("missing") & (F.coalesce(F.col(column) == wanted, F.lit(False)) if column in df.columns else F.lit(True))


def _parents(bucket: Column) -> Column:
    """The buckets that a leaf of the tracker view counts in, itself included."""
    real = bucket.startswith("real_reward")
    by_set = bucket.startswith("set_")
    return F.array_compact(F.array(
        F.lit("total"), bucket, F.when(real, "real_eval"), F.when(by_set, "set_eval"), F.when(real | by_set, "real_data").otherwise("fake_data"),
        F.when(bucket.isin(*EVAL_FAILED), "fake_eval_failed"), F.when(bucket.isin("set_terminated_turns", "set_terminated_response", "set_terminated_other"), "set_agent_terminated"),
        F.when(bucket.isin("fake_rollout_other", "fake_eval_other"), "fake_other"),
    ))


def step_facts(df: DataFrame, *keys: str) -> DataFrame:
    """keys, section, name, n of normalised records: outcomes, owners, stages, events, flags and buckets of each step."""
    keys = keys or KEYS

    def fact(section: str, name: Column, n: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), name.alias("name"), n.cast("long").alias("n"))

    outcome = F.col("terminal_outcome")
    flags = {
        "trajectories": F.lit(True), "fake": F.col("is_fake"), "real_eval": F.col("did_real_eval"), "invalid_eval": outcome.isin(*D.INVALID_EVAL),
        "infra_failure": outcome.isin(*D.INFRA_FAILURE), "diagnostics_missing": F.col("missing"),
        "conflicting_flags": ~F.col("missing") & ((F.col("is_fake") & F.col("did_real_eval")) | (F.col("did_real_eval") != outcome.isin(*D.REAL_EVAL))),
        "instrumented": _version(df, "core_metrics_version", 1), "dispatch_instrumented": _version(df, "action_metrics_version", 2), "timed": F.col("timed"),
    }
    single = [fact("flag", F.lit(name), test) for name, test in flags.items()]
    single += [fact(section, F.col(column), F.lit(1)) for section, column in (("outcome", "terminal_outcome"), ("owner", "failure_owner"), ("stage", "final_stage"))]
    single.append(fact("raw", D.raw_bucket(df), F.lit(1)))
    events = F.map_entries("events")
    every = F.concat(
        F.array(*single), F.transform(_parents(D.tracker_bucket(df)), lambda b: fact("tracker", b, F.lit(1))),
        F.transform(events, lambda e: fact("event", e["key"], e["value"])), F.transform(events, lambda e: fact("event_trajectories", e["key"], F.lit(1))),
    )
    facts = df.select(*keys, F.explode(every).alias("f")).groupBy(*keys, F.col("f.section").alias("section"), F.col("f.name").alias("name"))
    return facts.agg(F.sum("f.n").alias("n"))


def filled_facts(facts: DataFrame, *keys: str) -> DataFrame:
    """The facts, with a 0 for every outcome, owner, stage and event of a step that has none."""
    keys = keys or KEYS
    known = [("outcome", n) for n in D.TERMINAL_OUTCOMES] + [("owner", n) for n in D.OWNERS] + [("stage", n) for n in D.STAGES]
    known += [(s, n) for s in ("event", "event_trajectories") for n in D.EVENTS]
    names = facts.sparkSession.createDataFrame(known, "section string, name string")
    wanted = facts.select(*keys).distinct().crossJoin(F.broadcast(names))  # a fixed list of names
    return facts.join(wanted, [*keys, "section", "name"], "full").select(*keys, "section", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def group_facts(df: DataFrame, size: int, *keys: str, uid: str = "uid") -> DataFrame:
    """keys, section, name, n: how many prompt groups of a step are in what state, and the rows of the mixed ones."""
    keys = keys or KEYS
    health = D.group_health(df, size, uid=(*keys, uid))
    entries = F.array(
        F.struct(F.lit("total").alias("name"), F.lit(1).cast("long").alias("n")), F.struct(F.col("health").alias("name"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit("partial_fake_rows").alias("name"), F.col("fake_rows").cast("long").alias("n")), F.struct(F.lit("partial_real_rows").alias("name"), F.col("real_rows").cast("long").alias("n")),
    )
    long = health.select(*keys, F.explode(entries).alias("e")).groupBy(*keys, F.lit("group").alias("section"), F.col("e.name").alias("name"))
    return long.agg(F.sum("e.n").alias("n"))


def step_times(df: DataFrame, *keys: str) -> DataFrame:
    """keys, field, samples, mean, p95 of the timings of a step, and of ``action`` the pooled mean of a dispatched call."""
    keys = keys or KEYS
    long = df.select(*keys, F.explode("timing").alias("field", "v")).filter(F.col("field").isin(*D.TIMINGS))
    fields = long.groupBy(*keys, "field").agg(F.count("v").alias("samples"), F.avg("v").alias("mean"))
    fields = fields.join(quantiles(long, "v", {"p95": 0.95}, *keys, "field"), [*keys, "field"])
    calls = F.coalesce(F.col("timing")["env_step_timed_count"], F.lit(0.0))
    seconds = F.when(calls > 0, F.coalesce(F.col("timing")["env_step_seconds"], F.lit(0.0))).otherwise(0.0)
    action = df.groupBy(*keys).agg(F.sum(calls).cast("long").alias("samples"), F.sum(seconds).alias("s"))
    pooled = action.select(*keys, F.lit("action").alias("field"), "samples", F.when(F.col("samples") > 0, F.col("s") / F.col("samples")).alias("mean"), F.lit(None).cast("double").alias("p95"))
    return fields.unionByName(pooled)


def step_summary(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """keys, section, name, n: everything that is counted in a step, with zeros for known names."""
    keys = keys or KEYS
    return filled_facts(step_facts(df, *keys), *keys).unionByName(group_facts(df, size, *keys))


def _maps(facts: DataFrame, *keys: str) -> DataFrame:
    """One row a step with a map of names for each section that is read; the names of a section are a fixed list."""

    def named(section: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col("section") == section, F.struct("name", "n")))).alias(section)

    return facts.groupBy(*keys).agg(named("tracker"), named("event"), named("flag"))


def _share(counts: str, names: tuple[str, ...], of: str | None) -> Column:
    n = sum((F.coalesce(F.col(counts)[x], F.lit(0)) for x in names), F.lit(0)).cast("double")
    return n if of is None else D.rate(n, F.coalesce(F.col(counts)[of], F.lit(0)).cast("double"))


def _all(flag: str) -> Column:
    return F.coalesce(F.col("flag")[flag], F.lit(0)) == F.col("flag")["trajectories"]


def tracker_layout(facts: DataFrame, times: DataFrame, *keys: str, phase: str = "phase") -> DataFrame:
    """keys, metric, value: the tracker's keys of each step. Rewards and actions need all records to be instrumented."""
    keys = keys or KEYS

    def key(section: str, leaf: Column | str) -> Column:
        train, other = SECTIONS[section]
        return F.concat_ws("/", F.when(F.col(phase) == "train", train).otherwise(other), F.lit(leaf) if isinstance(leaf, str) else leaf)

    def cell(section: str, leaf: str, value: Column, available: Column | None = None) -> Column:
        made = F.struct(key(section, leaf).alias("metric"), value.alias("value"))
        return made if available is None else F.when(available, made)

    acting = _all("instrumented") & _all("dispatch_instrumented")
    cells = [cell(s, leaf, _share("tracker", names, of), _all("instrumented") if leaf in REWARD_LEAVES else None) for s, leaf, names, of in LAYOUT]
    cells += [cell("action", leaf, _share("event", (name,), of), acting) for leaf, name, of in ACTIONS]
    maps = _maps(facts, *keys)
    counted = maps.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("c")).select(*keys, "c.metric", "c.value")
    display = F.create_map(*[F.lit(x) for shown, field in TIMES for x in (field, shown)])
    leaf = F.concat_ws("_", display[F.col("field")], F.col("t.statistic"))
    cells = F.array(F.struct(F.lit("mean").alias("statistic"), F.col("mean").alias("v")), F.struct(F.lit("p95").alias("statistic"), F.col("p95").alias("v")))
    timed = times.filter(F.col("field").isin(*[f for _, f in TIMES])).withColumn("t", F.explode(cells)).filter("t.v IS NOT NULL").select(*keys, key("time", leaf).alias("metric"), F.col("t.v").alias("value"))
    action = times.filter("field = 'action' AND mean IS NOT NULL").join(maps.filter(acting).select(*keys), list(keys)).select(*keys, key("action", "env_step_s_mean").alias("metric"), F.col("mean").alias("value"))
    return counted.unionByName(timed).unionByName(action)


# Fixed order: the lines of the report and the buckets that they name.
REPORT = (
    ("real", ("real_data", "real_eval", "real_reward_1", "real_reward_0", "real_reward_negative")),
    ("set", ("set_eval", "set_agent_terminated", "set_terminated_turns", "set_terminated_response", "set_patch_empty", "set_patch_apply_failed", "set_agent_timeout", "set_repeated_action")),
    ("fake", ("fake_data", "fake_task_skipped", "fake_rollout_global_timeout", "fake_rollout_env_failed", "fake_eval_failed", "fake_eval_env_failed", "fake_eval_timeout", "fake_eval_execution_error", "fake_diagnostics_missing")),
    ("more", ("real_reward_other", "set_terminated_other", "set_other", "fake_other")),
)


def step_report(facts: DataFrame, *keys: str) -> DataFrame:
    """keys, line_no, line: a text of a few lines a step; every share is of all its trajectories."""
    keys = keys or KEYS

    def item(name: str) -> Column:
        n = F.coalesce(F.col("tracker")[name], F.lit(0))
        return F.format_string("%s=%d (%.2f%%)", F.lit(name), n, D.rate(n, F.col("tracker")["total"]).cast("double") * 100)

    lines = [F.concat(F.lit("trajectories="), F.col("tracker")["total"].cast("string"))]
    lines += [F.concat(F.lit(f"{title}: "), F.concat_ws(", ", *[item(n) for n in names])) for title, names in REPORT]
    counts = [F.format_string("%s=%d", F.lit(leaf), F.coalesce(F.col("event")[name], F.lit(0))) for leaf, name in (("total", "action_attempt"), ("parsed", "action_parse_success"), ("dispatched", "action_execute_attempt"), ("executed", "action_execute_success"))]
    lines.append(F.when(_all("instrumented") & _all("dispatch_instrumented"), F.concat(F.lit("actions: "), F.concat_ws(", ", *counts))).otherwise(F.lit("actions: not recorded")))
    return _maps(facts, *keys).select(*keys, F.posexplode(F.array(*lines)).alias("line_no", "line"))
