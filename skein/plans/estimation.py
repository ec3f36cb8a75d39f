"""Queries over advantages, token windows, losses and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import views
from skein.operators import corrections, groups, losses, masked, sequences
from skein.plans.registry import Registry, rounded

REGISTRY = Registry()
add = REGISTRY.add
S, T = views.with_views("v_sample"), views.with_views("v_token")


def _outcome(name, estimator, sql, digits=6, **options):
    @add(name, f"{S}, s AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS mu, stddev_samp(score) OVER w AS sd FROM v_sample WINDOW w AS (PARTITION BY uid)) {sql}")
    def query(spark, sf_dir):
        df = views.samples(spark, sf_dir).withColumn("length", F.col("row_id") % 17 + 1)
        return rounded(groups.estimate(estimator, df, **options).select("row_id", "uid", "advantage"), "advantage", digits=digits)


_outcome("adv_grpo", "grpo", "SELECT row_id, uid, round(CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mu) / (sd + 1e-6) END, 6) + 0.0 AS advantage FROM s")
_outcome("adv_grpo_no_std", "grpo", "SELECT row_id, uid, round(CASE WHEN n = 1 THEN score ELSE score - mu END, 6) + 0.0 AS advantage FROM s", normalize=False)
_outcome("adv_grpo_vectorized", "grpo_vectorized", "SELECT row_id, uid, round(CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mu) / (sd + 1e-6) END, 6) + 0.0 AS advantage FROM s")
_outcome("adv_rloo", "rloo", "SELECT row_id, uid, round(CASE WHEN n > 1 THEN (score - mu) * n / (n - 1) ELSE score END, 6) + 0.0 AS advantage FROM s")
_outcome("adv_rloo_vectorized", "rloo_vectorized", "SELECT row_id, uid, round(CASE WHEN n > 1 THEN (score - mu) * n / (n - 1) ELSE 0 END, 6) + 0.0 AS advantage FROM s")
_outcome("adv_opo", "opo", """SELECT row_id, uid, round(score - CASE WHEN n > 1 THEN sum((row_id % 17 + 1) * score) OVER (PARTITION BY uid) / sum(row_id % 17 + 1) OVER (PARTITION BY uid) ELSE 0 END, 9) + 0.0 AS advantage FROM s""", digits=9)
_outcome("adv_gpg", "gpg", """, a AS (SELECT count(*)::DOUBLE / greatest(count(*) FILTER (score <> 0), 1) AS alpha FROM v_sample)
SELECT row_id, uid, round(alpha * CASE WHEN n = 1 THEN score ELSE score - mu END, 6) + 0.0 AS advantage FROM s, a""")
_outcome("adv_reinforce_pp_baseline", "reinforce_plus_plus_baseline", """, c AS (SELECT row_id, uid, CASE WHEN n = 1 THEN score ELSE score - mu END AS a FROM s),
m AS (SELECT sum(a) / (count(*) + 1e-8) AS mean, count(*) AS n FROM c), v AS (SELECT sum((a - mean) ** 2) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM c, m)
SELECT row_id, uid, round((a - mean) / sqrt(var + 1e-8), 6) + 0.0 AS advantage FROM c, m, v""")
_outcome("adv_gdpo", "gdpo", """, l AS (SELECT *, (row_id % 17 + 1)::DOUBLE AS len FROM s), l2 AS (SELECT *, avg(len) OVER (PARTITION BY uid) AS lmu, stddev_samp(len) OVER (PARTITION BY uid) AS lsd FROM l),
c AS (SELECT row_id, uid, CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mu) / (sd + 1e-6) END + 0.5 * CASE WHEN n = 1 THEN len / (1 + 1e-6) ELSE (len - lmu) / (lsd + 1e-6) END AS a FROM l2),
m AS (SELECT sum(a) / (count(*) + 1e-8) AS mean, count(*) AS n FROM c), v AS (SELECT sum((a - mean) ** 2) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM c, m)
SELECT row_id, uid, round((a - mean) / sqrt(var + 1e-8), 6) + 0.0 AS advantage FROM c, m, v""", scores={"score": 1.0, "length": 0.5})


@add("adv_grpo_passk", f"""{S}, s AS (SELECT *, count(*) OVER (PARTITION BY uid) AS n, stddev_samp(score) OVER (PARTITION BY uid) AS sd, row_number() OVER (PARTITION BY uid ORDER BY score DESC, row_id) AS k FROM v_sample),
t AS (SELECT uid, max(score) FILTER (k = 2) AS second FROM s GROUP BY uid)
SELECT row_id, s.uid, round(CASE WHEN k = 1 THEN (score - second) / (sd + 1e-6) ELSE 0 END, 6) + 0.0 AS advantage FROM s JOIN t USING (uid) WHERE n > 1""")
def adv_grpo_passk(spark, sf_dir):
    df = views.samples(spark, sf_dir)
    many = df.groupBy("uid").count().filter("count > 1").select("uid")
    return rounded(groups.estimate("grpo_passk", df.join(many, "uid", "left_semi")).select("row_id", "uid", "advantage"), "advantage")


@add("adv_last_outputs", f"""{S}, o AS (SELECT *, session_id // 2 AS sess, session_id % 2 AS idx FROM v_sample), l AS (SELECT *, max(idx) OVER (PARTITION BY uid, sess) = idx AS is_last FROM o),
g AS (SELECT uid, sess, score, count(*) OVER (PARTITION BY uid) AS n, avg(score) OVER (PARTITION BY uid) AS mu, stddev_samp(score) OVER (PARTITION BY uid) AS sd FROM l WHERE is_last)
SELECT row_id, l.uid, round(CASE WHEN n = 1 THEN g.score / (1 + 1e-6) ELSE (g.score - mu) / (sd + 1e-6) END, 6) + 0.0 AS advantage FROM l JOIN g USING (uid, sess)""")
def adv_last_outputs(spark, sf_dir):
    df = views.samples(spark, sf_dir).withColumn("index", F.col("session_id") % 2).withColumn("session_id", F.floor(F.col("session_id") / 2))
    return rounded(groups.group_of_last_outputs(df).select("row_id", "uid", "advantage"), "advantage")


@add("informative_groups", f"{S}, s AS (SELECT *, max(score) OVER (PARTITION BY uid) > min(score) OVER (PARTITION BY uid) AS k FROM v_sample) SELECT row_id, uid, score FROM s WHERE k")
def informative_groups(spark, sf_dir):
    return groups.informative_groups(views.samples(spark, sf_dir)).select("row_id", "uid", "score")


@add("resample_weights", f"{S} SELECT row_id, round(greatest(pow(abs(score), 2) + 1e-8, 1e-8), 10) AS weight FROM v_sample")
def resample_weights(spark, sf_dir):
    return groups.resample_weights(views.samples(spark, sf_dir)).select("row_id", F.round("weight", 10).alias("weight"))


@add("resample_with_replacement")
def resample_with_replacement(spark, sf_dir):
    return groups.resample(views.samples(spark, sf_dir)).groupBy("score").agg(F.count("*").alias("n"))


@add("resample_size", "SELECT count(*) AS drawn, count(*) AS known FROM orders")
def resample_size(spark, sf_dir):
    """As many rows are drawn as there are, each of them a row of the table."""
    rows = views.samples(spark, sf_dir)
    drawn = groups.resample(rows, seed=5)
    return drawn.join(rows.select("row_id"), "row_id", "left_semi").agg(F.count("*").alias("known")).crossJoin(drawn.agg(F.count("*").alias("drawn")))


# --- token windows


@add("reward_to_go", f"{T} SELECT traj, pos, round(sum(reward * mask) OVER (PARTITION BY traj ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS ret FROM v_token")
def reward_to_go(spark, sf_dir):
    return rounded(views.tokens(spark, sf_dir).select("traj", "pos", sequences.reward_to_go().alias("ret")), "ret")


@add("running_weight", f"{T} SELECT traj, pos, round(sum((1 - 2 * exp(old_lp)) * mask) OVER (PARTITION BY traj ORDER BY pos), 6) + 0.0 AS w FROM v_token")
def running_weight(spark, sf_dir):
    return rounded(views.tokens(spark, sf_dir).select("traj", "pos", sequences.running_sum(1 - 2 * F.exp("old_lp")).alias("w")), "w")


@add("adv_gae", f"""{views.with_views('v_token').replace('WITH ', 'WITH RECURSIVE ', 1)}, t AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY pos DESC) AS k FROM v_token),
g AS (SELECT traj, pos, k, mask, value, (mask * (reward - value))::DOUBLE AS last, (mask * value)::DOUBLE AS nxt FROM t WHERE k = 1
  UNION ALL SELECT t.traj, t.pos, t.k, t.mask, t.value, CASE WHEN t.mask = 1 THEN t.reward + 0.99::DOUBLE * g.nxt - t.value + (0.99::DOUBLE * 0.95::DOUBLE) * g.last ELSE g.last END, CASE WHEN t.mask = 1 THEN t.value ELSE g.nxt END FROM g JOIN t ON t.traj = g.traj AND t.k = g.k + 1),
m AS (SELECT sum(last * mask) / (sum(mask) + 1e-8) AS mean, sum(mask)::DOUBLE AS n FROM g), v AS (SELECT sum((last - mean) ** 2 * mask) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM g, m)
SELECT traj, pos::INTEGER AS pos, round(last + value, 6) + 0.0 AS ret, round((last - mean) / sqrt(var + 1e-8), 6) + 0.0 AS advantage FROM g, m, v""")
def adv_gae(spark, sf_dir):
    done = sequences.gae(views.trajectories(spark, sf_dir), gamma=0.99, lam=0.95)
    return rounded(done.select("traj", "pos", "ret", "advantage"), "ret", "advantage")


@add("adv_reinforce_pp", f"""{views.with_views('v_token').replace('WITH ', 'WITH RECURSIVE ', 1)}, t AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY pos DESC) AS k FROM v_token),
g AS (SELECT traj, pos, k, mask, reward AS ret FROM t WHERE k = 1 UNION ALL SELECT t.traj, t.pos, t.k, t.mask, t.reward + 0.9::DOUBLE * (g.ret * g.mask) FROM g JOIN t ON t.traj = g.traj AND t.k = g.k + 1),
m AS (SELECT sum(ret * mask) / (sum(mask) + 1e-8) AS mean, sum(mask)::DOUBLE AS n FROM g), v AS (SELECT sum((ret - mean) ** 2 * mask) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM g, m)
SELECT traj, pos::INTEGER AS pos, round(ret, 6) + 0.0 AS ret, round((ret - mean) / sqrt(var + 1e-8) * mask, 6) + 0.0 AS advantage FROM g, m, v""")
def adv_reinforce_pp(spark, sf_dir):
    done = sequences.reinforce_plus_plus(views.trajectories(spark, sf_dir), gamma=0.9)
    return rounded(done.select("traj", "pos", "ret", "advantage"), "ret", "advantage")


@add("adv_remax", f"""{T}, b AS (SELECT uid, avg(reward) AS baseline FROM v_token GROUP BY uid)
SELECT traj, pos, round((sum(reward * mask) OVER (PARTITION BY traj ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - baseline) * mask, 9) + 0.0 AS advantage FROM v_token JOIN b USING (uid)""")
def adv_remax(spark, sf_dir):
    df = views.tokens(spark, sf_dir)
    base = df.groupBy("uid").agg(F.avg("reward").alias("baseline"))
    return rounded(sequences.remax(df, base).select("traj", "pos", "advantage"), "advantage", digits=9)


def _baseline_sql(place, keep):
    return f"""{T}, r AS (SELECT *, sum(reward * mask) OVER (PARTITION BY traj ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret,
  sum((1 - 2 * exp(old_lp)) * mask) OVER (PARTITION BY traj ORDER BY pos) AS w, {place} AS p FROM v_token),
b AS (SELECT uid, p, sum(ret * w * mask) / (sum(w * mask) + 1e-8) AS b FROM r GROUP BY uid, p),
l AS (SELECT uid, traj, sum(mask) AS len FROM v_token GROUP BY uid, traj {keep}), k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY len DESC, traj) AS k, count(*) OVER (PARTITION BY uid) AS n FROM l),
g AS (SELECT uid, max(len) FILTER (k = 1) AS l1, max(len) FILTER (k = 2) AS l2 FROM k GROUP BY uid)
SELECT r.traj, r.pos, round(ret, 6) + 0.0 AS ret, round((ret - CASE WHEN coalesce(k.n, 1) <= 1 THEN 0 WHEN k.len = l1 AND l1 > l2 AND r.p >= l2 THEN 0 ELSE b END) * mask, 6) + 0.0 AS advantage
FROM r JOIN b USING (uid, p) LEFT JOIN k ON k.traj = r.traj LEFT JOIN g ON g.uid = r.uid"""


@add("adv_optimal_baseline", _baseline_sql("pos", ""))
def adv_optimal_baseline(spark, sf_dir):
    return rounded(sequences.optimal_token_baseline(views.tokens(spark, sf_dir)).select("traj", "pos", "ret", "advantage"), "ret", "advantage")


@add("adv_optimal_baseline_turns", _baseline_sql("sum(mask) OVER (PARTITION BY traj ORDER BY pos) - 1", "HAVING sum(mask) > 0"))
def adv_optimal_baseline_turns(spark, sf_dir):
    done = sequences.optimal_token_baseline(views.tokens(spark, sf_dir), compact=True)
    return rounded(done.select("traj", "pos", "ret", "advantage"), "ret", "advantage")


@add("first_unmasked_value", f"""{T} SELECT traj, round(coalesce(arg_min(reward, pos) FILTER (mask = 1), arg_min(reward, pos)), 6) AS first_reward FROM v_token GROUP BY traj""")
def first_unmasked_value(spark, sf_dir):
    return rounded(views.trajectories(spark, sf_dir).select("traj", sequences.first_unmasked("reward").alias("first_reward")), "first_reward")


@add("action_streaks", f"""{views.with_views('v_event')}, a AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR event IS DISTINCT FROM lag(event) OVER w OR (n % 7 = 0) IS DISTINCT FROM lag(n % 7 = 0) OVER w THEN 1 ELSE 0 END AS new FROM v_event WINDOW w AS (PARTITION BY uid ORDER BY event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY uid ORDER BY event_id) AS run FROM a), c AS (SELECT event_id, uid, CASE WHEN n % 7 = 0 THEN 0 ELSE row_number() OVER (PARTITION BY uid, run ORDER BY event_id) END AS streak FROM b)
SELECT event_id, uid, streak, CASE WHEN streak >= 3 THEN 'terminate' WHEN streak >= 2 THEN 'warn' ELSE 'none' END AS verdict FROM c""")
def action_streaks(spark, sf_dir):
    return sequences.streaks(views.events(spark, sf_dir), "event", order="event_id", reset=F.col("n") % 7 == 0, warn=2, stop=3).select("event_id", "uid", "streak", "verdict")


@add("run_index", f"""{views.with_views('v_event')}, a AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR event IS DISTINCT FROM lag(event) OVER w THEN 1 ELSE 0 END AS new FROM v_event WINDOW w AS (PARTITION BY uid ORDER BY event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY uid ORDER BY event_id) AS run FROM a) SELECT event_id, uid, row_number() OVER (PARTITION BY uid, run ORDER BY event_id) - 1 AS rollout_n FROM b""")
def run_index(spark, sf_dir):
    return sequences.run_index(views.events(spark, sf_dir), "event", order="event_id", group="uid").select("event_id", "uid", "rollout_n")


# --- masked reductions and losses


@add("masked_reductions", f"""{T}, m AS (SELECT sum(mask)::DOUBLE AS n, sum(reward * mask) AS s, sum(reward * mask) / (sum(mask) + 1e-8) AS mean FROM v_token)
SELECT round(any_value(s), 6) AS masked_sum, round(any_value(mean), 6) AS masked_mean, round(sum((reward - mean) ** 2 * mask) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1), 6) AS masked_var FROM v_token, m""")
def masked_reductions(spark, sf_dir):
    df = views.tokens(spark, sf_dir)
    total = df.agg(masked.masked_sum("reward", "mask").alias("masked_sum"))
    moments = masked.masked_moments(df, "reward", "mask").select(F.col("mean").alias("masked_mean"), F.col("var").alias("masked_var"))
    return rounded(total.crossJoin(moments), "masked_sum", "masked_mean", "masked_var")


@add("whiten", f"""{T}, m AS (SELECT sum(mask)::DOUBLE AS n, sum(reward * mask) / (sum(mask) + 1e-8) AS mean FROM v_token), v AS (SELECT sum((reward - mean) ** 2 * mask) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM v_token, m)
SELECT traj, pos, round((reward - mean) / sqrt(var + 1e-8), 6) + 0.0 AS white FROM v_token, m, v""")
def whiten(spark, sf_dir):
    return rounded(masked.masked_whiten(views.tokens(spark, sf_dir), "reward", "mask", "white").select("traj", "pos", "white"), "white")


@add("kl_estimators", f"""{T}, k AS (SELECT *, least(greatest(ref_lp - lp, -20), 20) AS g FROM v_token) SELECT
round(sum((lp - ref_lp) * mask) / (sum(mask) + 1e-8), 6) AS k1, round(sum(abs(lp - ref_lp) * mask) / (sum(mask) + 1e-8), 6) AS k_abs, round(sum(0.5 * (lp - ref_lp) ** 2 * mask) / (sum(mask) + 1e-8), 6) AS k2,
round(sum(least(greatest(exp(g) - g - 1, -10), 10) * mask) / (sum(mask) + 1e-8), 6) AS k3 FROM k""")
def kl_estimators(spark, sf_dir):
    df = views.tokens(spark, sf_dir)
    kinds = {"k1": "k1", "k_abs": "abs", "k2": "k2", "k3": "k3+"}
    return rounded(df.agg(*[masked.masked_mean(masked.kl_estimate("lp", "ref_lp", k), "mask").alias(n) for n, k in kinds.items()]), *kinds)


@add("loss_modes", f"""{T}, q AS (SELECT traj, sum(-lp * adv * mask) AS s, sum(mask) AS n, count(*) AS len FROM v_token GROUP BY traj)
SELECT 'token-mean' AS mode, round(sum(s) / sum(n), 6) AS loss FROM q UNION ALL SELECT 'seq-mean-token-sum', round(sum(s) FILTER (n > 0) / count(*) FILTER (n > 0), 6) FROM q
UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) FILTER (n > 0) / count(*) FILTER (n > 0) / max(len), 6) FROM q UNION ALL SELECT 'seq-mean-token-mean', round(sum(s / (n + 1e-8)) FILTER (n > 0) / count(*) FILTER (n > 0), 6) FROM q""")
def loss_modes(spark, sf_dir):
    df, out = views.tokens(spark, sf_dir), None
    for mode in masked.LOSS_MODES:
        one = losses.policy_loss("gpg", df, mode=mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "loss")


_SEQ = "round(sum(s / (n + 1e-8)) FILTER (n > 0) / count(*) FILTER (n > 0), 6)"
_TOK = "round(sum(v * mask) / sum(mask), 6)"
_RATIO = "exp(least(greatest(lp - old_lp, -20), 20))"
_LOSS_SQL = {
    "vanilla": f"SELECT {_TOK} AS loss FROM (SELECT mask, CASE WHEN adv < 0 THEN least(-adv * 3.0, c) ELSE c END AS v FROM (SELECT *, greatest(-adv * r, -adv * least(greatest(r, 0.8), 1.2)) AS c FROM r))",
    "dppo_tv": f"SELECT {_TOK} AS loss FROM (SELECT mask, -adv * least(r, 20) * lp * CASE WHEN (adv > 0 AND exp(lp) - exp(old_lp) <= 0.2) OR (adv <= 0 AND exp(lp) - exp(old_lp) >= -0.2) THEN 1 ELSE 0 END AS v FROM r)",
    "dppo_kl": f"SELECT {_TOK} AS loss FROM (SELECT mask, -adv * least(r, 20) * lp * CASE WHEN k <= 0.05 OR (adv > 0 AND exp(lp) <= exp(old_lp)) OR (adv <= 0 AND exp(lp) >= exp(old_lp)) THEN 1 ELSE 0 END AS v FROM (SELECT *, exp(old_lp) * (old_lp - lp) + (1 - exp(old_lp)) * ln((1 - exp(old_lp) + 1e-8) / (1 - exp(lp) + 1e-8)) AS k FROM r))",
    "gspo": f"SELECT {_SEQ} AS loss FROM (SELECT traj, sum(mask) AS n, sum(greatest(-adv * g, -adv * least(greatest(g, 1 - 3e-4), 1 + 4e-4)) * mask) AS s FROM (SELECT *, exp(least(sum((lp - old_lp) * mask) OVER (PARTITION BY traj) / greatest(sum(mask) OVER (PARTITION BY traj), 1), 10)) AS g FROM r) GROUP BY traj)",
    "sapo": f"SELECT {_SEQ} AS loss FROM (SELECT traj, sum(mask) AS n, sum(-(4 / tau) / (1 + exp(-tau * (r - 1))) * adv * mask) AS s FROM (SELECT *, CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END AS tau FROM r) GROUP BY traj)",
    "gpg": f"SELECT {_TOK} AS loss FROM (SELECT mask, -lp * adv AS v FROM r)",
    "cispo": f"SELECT {_TOK} AS loss FROM (SELECT mask, -least(greatest(r, 0.8), 1.2) * adv * lp AS v FROM r)",
    "reinforce": "SELECT round(sum(s) FILTER (n > 0) / count(*) FILTER (n > 0), 6) AS loss FROM (SELECT traj, sum(mask) AS n, sum(-adv * lp * mask) AS s FROM r GROUP BY traj)",
    "geo_mean": "SELECT round(avg(-a * exp(g)), 6) AS loss FROM (SELECT traj, sum(adv * mask) / (sum(mask) + 1e-8) AS a, sum(sign(adv) * least(sign(adv) * (lp - old_lp), sign(adv) * least(greatest(lp - old_lp, -0.4), 0.4)) * mask) / (sum(mask) + 1e-8) AS g FROM r GROUP BY traj)",
    "kl_cov": f"SELECT {_TOK} AS loss FROM (SELECT mask, -adv * exp(lp - old_lp) + CASE WHEN mask > 0 AND k <= greatest(1, floor(0.001 * (SELECT count(*) FROM r WHERE mask > 0))) THEN abs(lp - old_lp) ELSE 0 END AS v FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN mask > 0 THEN (adv - ma) * (lp - ml) ELSE -1e300 END DESC, traj, pos) AS k FROM r, (SELECT avg(adv) AS ma, avg(lp) AS ml FROM r WHERE mask > 0)))",
}
for _name, _sql in _LOSS_SQL.items():

    @add(f"loss_{_name}", f"{T}, r AS (SELECT *, {_RATIO} AS r FROM v_token) {_sql}")
    def _loss(spark, sf_dir, _name=_name):
        return rounded(losses.policy_loss(_name, views.tokens(spark, sf_dir), **({"ratio": 0.001} if _name == "kl_cov" else {})), "loss")


@add("clip_fractions", f"""{T}, r AS (SELECT *, {_RATIO} AS r FROM v_token), c AS (SELECT *, -adv * r AS a, -adv * least(greatest(r, 0.8), 1.2) AS b FROM r)
SELECT round(sum((b > a)::INT * mask) / (sum(mask) + 1e-8), 6) AS clipfrac, round(sum((greatest(a, b) > -adv * 3 AND adv < 0)::INT * mask) / (sum(mask) + 1e-8), 6) + 0.0 AS clipfrac_lower, round(sum(-least(greatest(lp - old_lp, -20), 20) * mask) / (sum(mask) + 1e-8), 6) AS ppo_kl FROM c""")
def clip_fractions(spark, sf_dir):
    return rounded(losses.clip_fractions(views.tokens(spark, sf_dir)), "clipfrac", "clipfrac_lower", "ppo_kl")


@add("value_loss", f"{T} SELECT round(sum(0.5 * greatest((value - reward) ** 2, (least(greatest(value, value * 0.5 - 0.01), value * 0.5 + 0.01) - reward) ** 2) * mask) / sum(mask), 8) AS loss FROM v_token")
def value_loss(spark, sf_dir):
    df = views.tokens(spark, sf_dir).withColumn("old_value", F.col("value") * 0.5)
    return rounded(losses.value_loss(df, ret="reward", bound=0.01), "loss", digits=8)


@add("entropy_from_logits", """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_quantity::DOUBLE / 10, l_discount::DOUBLE * 20, l_tax::DOUBLE * 30] AS x FROM lineitem), e AS (SELECT *, ln(list_sum(list_transform(x, lambda v: exp(v)))) AS lse, ln(list_sum(list_transform(x, lambda v: exp(2 * v)))) AS lse2 FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(lse - list_sum(list_transform(x, lambda v: exp(v - lse) * v)), 6) + 0.0 AS entropy, round(exp(lse2 - 2 * lse), 6) AS sum_pi2 FROM e""")
def entropy_from_logits(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    x = F.array(F.col("l_quantity").cast("double") / 10, F.col("l_discount").cast("double") * 20, F.col("l_tax").cast("double") * 30)
    df = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.alias("logits"))
    made = df.withColumn("entropy", losses.entropy("logits")).withColumn("sum_pi2", losses.sum_of_squared_probabilities("logits")).drop("logits")
    return rounded(made, "entropy", "sum_pi2")


@add("kl_penalised_rewards", f"{T} SELECT traj, pos, round(reward - 0.1::DOUBLE * (lp - ref_lp) * mask, 6) + 0.0 AS penalised FROM v_token")
def kl_penalised_rewards(spark, sf_dir):
    kl = masked.kl_estimate("lp", "ref_lp", "k1")
    return rounded(views.tokens(spark, sf_dir).select("traj", "pos", losses.penalised_rewards("reward", kl, 0.1).alias("penalised")), "penalised")


@add("mean_sequence_kl", f"{T}, k AS (SELECT traj, sum(abs(lp - ref_lp) * mask) / (sum(mask) + 1e-8) AS k FROM v_token GROUP BY traj) SELECT round(avg(k), 6) AS kl FROM k")
def mean_sequence_kl(spark, sf_dir):
    return rounded(losses.mean_sequence_kl(views.tokens(spark, sf_dir), masked.kl_estimate("lp", "ref_lp", "abs")), "kl")


@add("adaptive_kl", f"""{T}, k AS (SELECT uid AS step, avg(abs(lp - ref_lp)) AS kl, count(*) AS n FROM v_token GROUP BY uid)
SELECT step, round(0.2::DOUBLE * exp(sum(ln(1 + least(greatest(kl / 0.03 - 1, -0.2), 0.2) * n / 10000)) OVER (ORDER BY step)), 6) AS coef FROM k""")
def adaptive_kl(spark, sf_dir):
    steps = views.tokens(spark, sf_dir).groupBy(F.col("uid").alias("step")).agg(F.avg(F.abs(F.col("lp") - F.col("ref_lp"))).alias("kl"), F.count("*").alias("n"))
    return rounded(losses.adaptive_coefficient(steps, 0.2, 0.03, 10000), "coef")


# --- corrections

_LR = f"{T}, q AS (SELECT *, old_lp - roll_lp AS lr FROM v_token)"


def _ratios(spark, sf_dir):
    return views.tokens(spark, sf_dir).withColumn("log_ratio", F.col("old_lp") - F.col("roll_lp"))


@add("is_weights_token", f"{_LR}, w AS (SELECT *, least(exp(least(greatest(lr, -20), 20)) * mask, 1.01) AS w FROM q), m AS (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS mean FROM w) SELECT traj, pos, round(w / mean, 6) AS is_weight FROM w, m")
def is_weights_token(spark, sf_dir):
    return rounded(corrections.weights(_ratios(spark, sf_dir), "token", 1.01, normalize=True).select("traj", "pos", "is_weight"), "is_weight")


@add("is_weights_sequence", f"{_LR}, w AS (SELECT *, exp(least(greatest(sum(lr * mask) OVER (PARTITION BY traj), -20), 20)) * mask AS w FROM q) SELECT traj, pos, round(CASE WHEN w BETWEEN 0.95 AND 1.04 THEN w ELSE 0 END, 6) AS is_weight FROM w")
def is_weights_sequence(spark, sf_dir):
    return rounded(corrections.weights(_ratios(spark, sf_dir), "sequence", "0.95_1.04").select("traj", "pos", "is_weight"), "is_weight")


@add("rejection_mask", f"""{_LR}, k AS (SELECT *, least(greatest(lr, -20), 20) AS c FROM q), s AS (SELECT *, -c AS k1, sum(-c * mask) OVER w AS s1, sum((exp(c) - 1 - c) * mask) OVER w / (sum(mask) OVER w + 1e-8) AS m3,
  coalesce(max(CASE WHEN mask <> 0 THEN 0.5 * c * c END) OVER w, 0) AS x2 FROM k WINDOW w AS (PARTITION BY traj))
SELECT traj, pos, CASE WHEN k1 BETWEEN ln(0.985) AND ln(1.5) AND s1 BETWEEN ln(1 / 1.05) AND ln(1.05) AND m3 <= 0.0001 AND x2 <= 0.00018 THEN mask ELSE 0 END AS kept_mask FROM s""")
def rejection_mask(spark, sf_dir):
    kept = corrections.reject(_ratios(spark, sf_dir), "token_k1,seq_sum_k1,seq_mean_k3,seq_max_k2", ["0.985_1.5", "1.05", 0.0001, 0.00018])
    return kept.select("traj", "pos", "kept_mask")


@add("rejection_metrics", f"""{_LR}, s AS (SELECT traj, mask, 0.5 * lr * lr AS v FROM q), g AS (SELECT traj, sum(v * mask) AS seq, sum(mask) AS n FROM s GROUP BY traj), t AS (SELECT s.*, g.seq, g.n FROM s JOIN g USING (traj)),
a AS (SELECT 'token_k2' AS option, sum(v * mask) / (sum(mask) + 1e-8) AS mean, min(v) FILTER (mask <> 0) AS min, max(v) FILTER (mask <> 0) AS max, sum((v > 0.0001)::INT * mask) / (sum(mask) + 1e-8) AS fraction_high, 0.0 AS fraction_low,
  sqrt(greatest(sum(least(v, 0.0001) ** 2 * mask) / (sum(mask) + 1e-8) - (sum(least(v, 0.0001) * mask) / (sum(mask) + 1e-8)) ** 2, 0)) AS std, sum((v > 0.0001)::INT * mask) / (sum(mask) + 1e-8) AS masked_fraction FROM t),
b AS (SELECT 'seq_sum_k2' AS option, sum(seq * mask) / (sum(mask) + 1e-8) AS mean, min(seq) FILTER (mask <> 0) AS min, max(seq) FILTER (mask <> 0) AS max, (SELECT avg((seq > 0.0001)::INT) FROM g WHERE n > 0) AS fraction_high, 0.0 AS fraction_low,
  sqrt(greatest(sum(least(seq, 0.0001) ** 2 * mask) / (sum(mask) + 1e-8) - (sum(least(seq, 0.0001) * mask) / (sum(mask) + 1e-8)) ** 2, 0)) AS std, sum((seq > 0.0001)::INT * mask) / (sum(mask) + 1e-8) AS masked_fraction FROM t),
u AS (SELECT a.*, (SELECT avg(m) FROM (SELECT max((v > 0.0001 AND mask <> 0)::INT) AS m FROM t WHERE n > 0 GROUP BY traj)) AS seq_masked_fraction FROM a UNION ALL SELECT b.*, (SELECT avg((seq > 0.0001)::INT) FROM g WHERE n > 0) FROM b)
SELECT option, round(mean, 8) AS mean, round(min, 8) AS min, round(max, 8) AS max, round(fraction_high, 6) AS fraction_high, round(fraction_low, 6) AS fraction_low, round(std, 8) AS std, round(masked_fraction, 6) AS masked_fraction, round(seq_masked_fraction, 6) AS seq_masked_fraction FROM u""")
def rejection_metrics(spark, sf_dir):
    made = corrections.rejection_metrics(_ratios(spark, sf_dir), "token_k2,seq_sum_k2", 0.0001)
    fine = rounded(made, "mean", "min", "max", "std", digits=8)
    return rounded(fine, "fraction_high", "fraction_low", "masked_fraction", "seq_masked_fraction")


@add("weight_metrics", f"""{_LR}, w AS (SELECT *, exp(lr) AS raw, least(exp(lr) * mask, 1.01) AS w FROM q), m AS (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS mu, sum(w * w * mask) / (sum(mask) + 1e-8) AS sq FROM w)
SELECT round(any_value(mu), 6) AS mean, round(min(w) FILTER (mask <> 0), 6) AS min, round(max(w) FILTER (mask <> 0), 6) AS max, round(sum((raw > 1.01)::INT * mask) / (sum(mask) + 1e-8), 6) AS fraction_high,
round(sum((raw < 1 / 1.01)::INT * mask) / (sum(mask) + 1e-8), 6) + 0.0 AS fraction_low, round(sqrt(greatest(any_value(sq) - any_value(mu) ** 2, 0)), 5) AS std, round((any_value(mu) + 1e-8) ** 2 / any_value(sq), 6) AS ess FROM w, m""")
def weight_metrics(spark, sf_dir):
    made = corrections.weight_metrics(corrections.weights(_ratios(spark, sf_dir), "token", 1.01), high=1.01)
    return rounded(rounded(made, "mean", "min", "max", "fraction_high", "fraction_low", "ess"), "std", digits=5)


@add("off_policy_metrics", f"""{_LR}, p AS (SELECT traj, sum(old_lp * mask) / (sum(mask) + 1e-8) AS t, sum(roll_lp * mask) / (sum(mask) + 1e-8) AS r, sum(lr * mask) AS g, sum(mask) AS n, sum((exp(lr) - lr - 1) * mask) AS k3, sum(exp(2 * lr) * mask) AS sq FROM q GROUP BY traj)
SELECT round(avg(exp(-t)), 6) AS training_ppl, round(avg(exp(-r)), 6) AS rollout_ppl, round(avg(r - t), 6) + 0.0 AS log_ppl_diff, round(avg(abs(r - t)), 6) AS log_ppl_abs_diff, round(sum(-g) / (sum(n) + 1e-8), 6) AS kl,
round(sum(k3) / (sum(n) + 1e-8), 6) AS k3_kl, round(sum(sq) / (sum(n) + 1e-8) - 1, 6) AS chi2_token, round(avg(exp(2 * least(greatest(g, -20), 20))) - 1, 6) AS chi2_seq FROM p""")
def off_policy_metrics(spark, sf_dir):
    made = corrections.off_policy_metrics(views.tokens(spark, sf_dir))
    return rounded(made, *made.columns)


@add("policy_agreement", f"""{T}, d AS (SELECT *, abs(lp - ref_lp) AS d FROM v_token WHERE mask <> 0)
SELECT round(corr(lp, ref_lp), 6) AS pearson, round(max(d), 6) AS max_diff, round(avg(d), 6) AS mean_diff, round(stddev_samp(d), 6) AS std_diff, count(*) FILTER (d > 0) AS differing, count(*) > 0 AS valid FROM d""")
def policy_agreement(spark, sf_dir):
    return rounded(corrections.agreement(views.tokens(spark, sf_dir), "lp", "ref_lp"), "pearson", "max_diff", "mean_diff", "std_diff")
