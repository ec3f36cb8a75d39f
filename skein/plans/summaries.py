"""Queries over step summaries: all facts of a step, the tracker's keys, and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import diagnostics, steps
from skein.plans.evaluation import _FAKE, _INV, _OUT, _REC, _RWD, _SET, _TFAKE, _in, records
from skein.plans.registry import Registry, rounded

REGISTRY = Registry()
add = REGISTRY.add
GROUP = 4

# Step 0 holds the records of another version, step 3 those without instrumentation.
_STEP = f"""{_REC}, s0 AS (SELECT *, CASE WHEN row_id % 2 = 0 THEN 'train' ELSE 'val' END AS phase, CASE WHEN row_id % 23 = 0 THEN 0 ELSE uid % 3 + 1 END AS step,
  CASE WHEN missing THEN 'diagnostics_missing' WHEN is_fake THEN {_FAKE} WHEN did_eval THEN {_RWD} WHEN outcome IN {_INV} THEN 'invalid_eval_nonfake' ELSE {_SET} END AS raw,
  CASE WHEN missing THEN 'fake_diagnostics_missing' WHEN NOT is_fake AND did_eval AND outcome IN {_in(diagnostics.REAL_EVAL)} THEN {_RWD} WHEN NOT is_fake AND NOT did_eval AND outcome IN {_in(diagnostics.SET_OUTCOMES)} THEN {_SET} ELSE {_TFAKE} END AS leaf FROM r),
s AS (SELECT *, list_filter(['total', leaf, CASE WHEN leaf LIKE 'real_reward%' THEN 'real_eval' WHEN leaf LIKE 'set\\_%' ESCAPE '\\' THEN 'set_eval' END, CASE WHEN leaf LIKE 'fake\\_%' ESCAPE '\\' THEN 'fake_data' ELSE 'real_data' END,
  CASE WHEN leaf IN {_in(steps.EVAL_FAILED)} THEN 'fake_eval_failed' END, CASE WHEN leaf LIKE 'set_terminated%' THEN 'set_agent_terminated' END, CASE WHEN leaf IN ('fake_rollout_other', 'fake_eval_other') THEN 'fake_other' END], lambda x: x IS NOT NULL) AS view,
  NOT missing AND step <> 3 AS core, NOT missing AND row_id % 4 <> 0 AS timed FROM s0),
e AS (SELECT phase, step, unnest(['action_attempt', 'action_parse_success', 'action_execute_attempt', 'action_execute_success', 'unknown_event']) AS name, unnest([row_id % 7 + 3, row_id % 7 + 2, row_id % 7 + 1, row_id % 7, row_id % 3]) AS k FROM s WHERE NOT missing)"""


def step_records(spark, sf_dir):
    k, raw = F.col("row_id"), records(spark, sf_dir)
    step = F.when(k % 23 == 0, 0).otherwise(F.col("uid") % 3 + 1)
    core = F.when(F.col("step") != 3, 1)
    made = raw.withColumn("phase", F.when(k % 2 == 0, "train").otherwise("val")).withColumn("step", step.cast("long"))
    return diagnostics.normalise(made.withColumn("core_metrics_version", core).withColumn("action_metrics_version", core * 2))


_FLAGS = (
    ("trajectories", "true"), ("fake", "is_fake"), ("real_eval", "did_eval"), ("invalid_eval", f"outcome IN {_in(diagnostics.INVALID_EVAL)}"), ("infra_failure", f"outcome IN {_in(diagnostics.INFRA_FAILURE)}"),
    ("diagnostics_missing", "missing"), ("conflicting_flags", f"NOT missing AND ((is_fake AND did_eval) OR did_eval <> (outcome IN {_in(diagnostics.REAL_EVAL)}))"),
    ("instrumented", "core"), ("dispatch_instrumented", "core"), ("timed", "timed"),
)
_KNOWN = [("outcome", n) for n in _OUT] + [("owner", n) for n in diagnostics.OWNERS] + [("stage", n) for n in diagnostics.STAGES] + [(x, n) for x in ("event", "event_trajectories") for n in diagnostics.EVENTS]
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in _KNOWN)


@add("step_summary", f"""{_STEP}, f AS (SELECT phase, step, 'outcome' AS section, outcome AS name, 1 AS n FROM s UNION ALL SELECT phase, step, 'owner', CASE WHEN missing THEN 'unknown' ELSE 'model' END, 1 FROM s UNION ALL SELECT phase, step, 'stage', stage, 1 FROM s
UNION ALL SELECT phase, step, 'raw', raw, 1 FROM s UNION ALL SELECT phase, step, 'tracker', unnest(view), 1 FROM s UNION ALL SELECT phase, step, 'event', name, k FROM e WHERE k > 0 UNION ALL SELECT phase, step, 'event_trajectories', name, 1 FROM e WHERE k > 0
UNION ALL SELECT phase, step, 'flag', unnest([{', '.join(f"'{n}'" for n, _ in _FLAGS)}]), unnest([{', '.join(f'({x})::INT' for _, x in _FLAGS)}]) FROM s
UNION ALL SELECT phase, step, section, name, 0 FROM (SELECT DISTINCT phase, step FROM s), (VALUES {_PAIRS}) k(section, name)),
g AS (SELECT phase, step, uid, count(*) AS n, count(*) FILTER (missing) AS m, count(*) FILTER (is_fake) AS fk FROM s GROUP BY 1, 2, 3),
h AS (SELECT *, CASE WHEN n <> {GROUP} THEN 'incomplete' WHEN m > 0 THEN 'diagnostics_missing' WHEN fk = 0 THEN 'all_real' WHEN fk = n THEN 'all_fake' ELSE 'partial_fake' END AS health FROM g),
q AS (SELECT phase, step, 'total' AS name, 1 AS n FROM h UNION ALL SELECT phase, step, health, 1 FROM h UNION ALL SELECT phase, step, 'partial_fake_rows', CASE WHEN health = 'partial_fake' THEN fk ELSE 0 END FROM h UNION ALL SELECT phase, step, 'partial_real_rows', CASE WHEN health = 'partial_fake' THEN n - fk ELSE 0 END FROM h)
SELECT phase, step, section, name, sum(n)::BIGINT AS n FROM f GROUP BY ALL UNION ALL SELECT phase, step, 'group', name, sum(n)::BIGINT FROM q GROUP BY 1, 2, 3, 4""")
def step_summary(spark, sf_dir):
    return steps.step_summary(step_records(spark, sf_dir), GROUP)


def _count(names):
    return " + ".join(f"count(*) FILTER (list_contains(view, '{n}'))" for n in names)


def _cell(section, leaf, value, test="true"):
    train, other = steps.SECTIONS[section]
    return f"SELECT CASE WHEN phase = 'train' THEN '{train}' ELSE '{other}' END || '/{leaf}' AS metric, phase, step, {value} AS value FROM c WHERE {test}"


_WIDE = ", ".join(f"({_count(names)})::DOUBLE AS v{k}" for k, (_, _, names, _) in enumerate(steps.LAYOUT))
_CELLS = [_cell(s, leaf, f"v{k}" if of is None else f"coalesce(v{k} / nullif({'real_eval' if of == 'real_eval' else 'n'}, 0), 0)", "core" if leaf in steps.REWARD_LEAVES else "true") for k, (s, leaf, _, of) in enumerate(steps.LAYOUT)]
_CELLS += [_cell("action", leaf, name if of is None else f"coalesce({name} / nullif({of}, 0), 0)", "core") for leaf, name, of in steps.ACTIONS]
_CELLS += [_cell("time", f"{shown}_{k}", f"{field}_{k}", f"{field}_{k} IS NOT NULL") for shown, field in steps.TIMES if field in ("llm_seconds", "env_step_seconds") for k in ("mean", "p95")]
_CELLS.append(_cell("action", "env_step_s_mean", "secs / calls", "core AND calls > 0"))


@add("tracker_metrics", f"""{_STEP}, w AS (SELECT phase, step, count(*) AS n, {_count(['real_eval'])} AS real_eval, bool_and(core) AS core, {_WIDE},
  avg(row_id % 100) FILTER (timed) AS llm_seconds_mean, quantile_cont((row_id % 100)::DOUBLE, 0.95) FILTER (timed) AS llm_seconds_p95,
  avg(row_id % 50 - 5) FILTER (timed AND row_id % 50 >= 5) AS env_step_seconds_mean, quantile_cont((row_id % 50 - 5)::DOUBLE, 0.95) FILTER (timed AND row_id % 50 >= 5) AS env_step_seconds_p95,
  coalesce(sum(row_id % 7) FILTER (timed), 0)::DOUBLE AS calls, coalesce(sum(row_id % 50 - 5) FILTER (timed AND row_id % 7 > 0 AND row_id % 50 >= 5), 0)::DOUBLE AS secs FROM s GROUP BY 1, 2),
a AS (SELECT phase, step, {', '.join(f"sum(k) FILTER (name = '{n}')::DOUBLE AS {n}" for n in ('action_attempt', 'action_parse_success', 'action_execute_attempt', 'action_execute_success'))} FROM e GROUP BY 1, 2), c AS (SELECT * FROM w LEFT JOIN a USING (phase, step))
SELECT phase, step, metric, round(value, 6) AS value FROM ({' UNION ALL '.join(_CELLS)})""")
def tracker_metrics(spark, sf_dir):
    rows = step_records(spark, sf_dir)
    return rounded(steps.tracker_layout(steps.step_facts(rows), steps.step_times(rows)), "value")


def _item(name):
    return f"'{name}=' || v_{name} || printf(' (%.2f%%)', v_{name} * 100.0 / n)"


_NAMES = [n for _, names in steps.REPORT for n in names]
_LINES = ["'trajectories=' || n", *[f"'{title}: ' || " + " || ', ' || ".join(_item(n) for n in names) for title, names in steps.REPORT]]
_LINES.append("CASE WHEN core THEN 'actions: total=' || t::BIGINT || ', parsed=' || p::BIGINT || ', dispatched=' || d::BIGINT || ', executed=' || x::BIGINT ELSE 'actions: not recorded' END")


@add("diagnostic_report", f"""{_STEP}, w AS (SELECT phase, step, count(*) AS n, bool_and(core) AS core, {', '.join(f'{_count([n])} AS v_{n}' for n in _NAMES)} FROM s GROUP BY 1, 2),
a AS (SELECT phase, step, sum(k) FILTER (name = 'action_attempt') AS t, sum(k) FILTER (name = 'action_parse_success') AS p, sum(k) FILTER (name = 'action_execute_attempt') AS d, sum(k) FILTER (name = 'action_execute_success') AS x FROM e GROUP BY 1, 2), c AS (SELECT * FROM w LEFT JOIN a USING (phase, step))
{' UNION ALL '.join(f'SELECT phase, step, {k} AS line_no, {line} AS line FROM c' for k, line in enumerate(_LINES))}""")
def diagnostic_report(spark, sf_dir):
    return steps.step_report(steps.step_facts(step_records(spark, sf_dir)))
