"""Values of policy losses over token rows (traj, mask, adv, lp, old_lp): an expression per token, then one aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import corrections
from skein.operators.masked import aggregate_loss, clip, column, kl_estimate, masked_mean, masked_sum

#: Cells that a key's range is cut into to find a bound, and how many rows may then be brought together.
CUTS, MOST_TIES = 1024, 100_000
LOSSES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def keep(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        LOSSES[name] = function
        return function

    return keep


def policy_loss(name: str, df: DataFrame, **options) -> DataFrame:
    """One row with the loss ``name``."""
    if name not in LOSSES:
        raise ValueError(f"no loss {name!r}; there are {sorted(LOSSES)}")
    return LOSSES[name](df, **options)


def log_ratio(bound: float | None = 20.0) -> Column:
    gap = F.col("lp") - F.col("old_lp")
    return gap if bound is None else clip(gap, -bound, bound)


def _finish(df: DataFrame, value: Column, mode: str, weights: str | None, scale: float | None = None) -> DataFrame:
    return aggregate_loss(df, value if weights is None else value * F.col(weights), mode, scale=scale)


def clipped(ratio: Column, low: float, high: float) -> Column:
    adv = F.col("adv")
    return F.greatest(-adv * ratio, -adv * clip(ratio, 1 - low, 1 + high))


@register("vanilla")
def vanilla(df: DataFrame, low: float = 0.2, high: float = 0.2, clip_c: float = 3.0, mode: str = "token-mean", weights: str | None = None, **_) -> DataFrame:
    adv, worst = F.col("adv"), clipped(F.exp(log_ratio()), low, high)
    return _finish(df, F.when(adv < 0, F.least(-adv * clip_c, worst)).otherwise(worst), mode, weights)


def clip_fractions(df: DataFrame, low: float = 0.2, high: float = 0.2, clip_c: float = 3.0) -> DataFrame:
    """Shares of unmasked tokens that the upper and the lower clip changed, and the mean k1 estimate."""
    adv, ratio = F.col("adv"), F.exp(log_ratio())
    plain, bound = -adv * ratio, -adv * clip(ratio, 1 - low, 1 + high)
    worst = F.greatest(plain, bound)
    flags = df.select("mask", (bound > plain).cast("double").alias("up"), ((worst > -adv * clip_c) & (adv < 0)).cast("double").alias("down"), (-log_ratio()).alias("kl"))
    return flags.agg(masked_mean("up", "mask").alias("clipfrac"), masked_mean("down", "mask").alias("clipfrac_lower"), masked_mean("kl", "mask").alias("ppo_kl"))


def _trusted(kind: str, df: DataFrame, low: float, high: float, cap: float, mode: str, weights: str | None) -> DataFrame:
    adv, lp = F.col("adv"), F.col("lp")
    ratio, p, old = F.exp(log_ratio()), F.exp("lp"), F.exp("old_lp")
    if kind == "tv":
        up, down = p - old <= high, p - old >= -low
    else:
        kl = old * (F.col("old_lp") - lp) + (1 - old) * F.log((1 - old + 1e-8) / (1 - p + 1e-8))
        up, down = (kl <= high) | (p <= old), (kl <= low) | (p >= old)
    valid = F.when(adv > 0, up).otherwise(down).cast("double")
    return _finish(df, -adv * F.least(ratio, F.lit(float(cap))) * lp * valid, mode, weights)


@register("dppo_tv")
def dppo_tv(df: DataFrame, low: float = 0.2, high: float = 0.2, cap: float = 20.0, mode: str = "token-mean", weights: str | None = None, **_) -> DataFrame:
    return _trusted("tv", df, low, high, cap, mode, weights)


@register("dppo_kl")
def dppo_kl(df: DataFrame, low: float = 0.05, high: float = 0.05, cap: float = 20.0, mode: str = "token-mean", weights: str | None = None, **_) -> DataFrame:
    return _trusted("kl", df, low, high, cap, mode, weights)


@register("gspo")
def gspo(df: DataFrame, low: float = 3e-4, high: float = 4e-4, weights: str | None = None, **_) -> DataFrame:
    w = Window.partitionBy("traj")
    mean = F.sum((F.col("lp") - F.col("old_lp")) * F.col("mask")).over(w) / F.greatest(F.sum("mask").over(w), F.lit(1))
    rows = df.withColumn("__ratio", F.exp(F.least(mean, F.lit(10.0))))
    return _finish(rows, clipped(F.col("__ratio"), low, high), "seq-mean-token-mean", weights)


@register("sapo")
def sapo(df: DataFrame, tau_pos: float = 1.0, tau_neg: float = 1.05, weights: str | None = None, **_) -> DataFrame:
    adv = F.col("adv")
    tau = F.when(adv > 0, F.lit(float(tau_pos))).otherwise(F.lit(float(tau_neg)))
    gate = 1 / (1 + F.exp(-tau * (F.exp(log_ratio()) - 1))) * (4 / tau)
    return _finish(df, -gate * adv, "seq-mean-token-mean", weights)


@register("gpg")
def gpg(df: DataFrame, mode: str = "token-mean", weights: str | None = None, **_) -> DataFrame:
    return _finish(df, -F.col("lp") * F.col("adv"), mode, weights)


@register("cispo")
def cispo(df: DataFrame, low: float = 0.2, high: float = 0.2, mode: str = "token-mean", weights: str | None = None, **_) -> DataFrame:
    return _finish(df, -clip(F.exp(log_ratio()), 1 - low, 1 + high) * F.col("adv") * F.col("lp"), mode, weights)


@register("reinforce")
def reinforce(df: DataFrame, mode: str = "seq-mean-token-sum", weights: str | None = None, **_) -> DataFrame:
    return _finish(df, -F.col("adv") * F.col("lp"), mode, weights)


@register("geo_mean")
def geo_mean(df: DataFrame, low: float = 0.4, high: float = 0.4, weights: str | None = None, **_) -> DataFrame:
    """One value a trajectory: the mean advantage times the geometric mean of sign-clipped ratios; their plain mean."""
    gap, sign = log_ratio(None), F.signum("adv")
    kept = sign * F.least(sign * gap, sign * clip(gap, -low, high))
    rows = df.groupBy("traj").agg(
        masked_mean("adv", "mask").alias("a"), masked_mean(kept, "mask").alias("g"),
        masked_mean(F.log(F.col(weights) + 1e-10) if weights else F.lit(0.0), "mask").alias("w"),
    )
    return rows.agg(F.avg(-F.col("a") * F.exp("g") * F.exp("w")).alias("loss"))


def _covariances(df: DataFrame) -> DataFrame:
    means = df.agg(masked_mean("adv", "mask").alias("__ma"), masked_mean("lp", "mask").alias("__ml"))
    return df.crossJoin(F.broadcast(means)).withColumn("cov", (F.col("adv") - F.col("__ma")) * (F.col("lp") - F.col("__ml"))).drop("__ma", "__ml")


def _first_rows(df: DataFrame, key: Column, few: int, order: tuple[str, ...]) -> Column:
    """Whether a row is among the ``few`` of smallest ``key`` (null: never), ties by ``order``.

    The bound is found by counting, not by sorting: the key's range is cut into ``CUTS`` equal cells, the cell that holds
    the bound is cut again, and only when few rows are left in it are they brought together.
    """
    rows = df.select(key.cast("double").alias("k"), *order).filter("k IS NOT NULL")
    low, high, total = rows.agg(F.min("k"), F.max("k"), F.count("*")).first()
    if total <= few:
        return key.isNotNull()
    below, inside = 0, total
    while inside > MOST_TIES and high > low:
        cell = F.least(F.floor((F.col("k") - low) / (high - low) * CUTS), F.lit(CUTS - 1)).cast("int")
        counts = dict(rows.filter(F.col("k").between(low, high)).groupBy(cell.alias("c")).agg(F.struct(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b"))).collect())
        for c in sorted(counts):
            n, a, b = counts[c]
            if below + n >= few:
                break
            below += n
        if (a, b) == (low, high):
            break
        low, high, inside = a, b, n
    edge = rows.filter(F.col("k").between(low, high)).orderBy("k", *order).limit(few - below).agg(F.max(F.struct("k", *order)).alias("e")).first().e
    mine = F.struct(key.cast("double").alias("k"), *order)
    return key.isNotNull() & (mine <= F.struct(F.lit(edge[0]).alias("k"), *[F.lit(v).cast(dict(df.dtypes)[c]).alias(c) for c, v in zip(order, edge[1:], strict=True)]))


@register("clip_cov")
def clip_cov(df: DataFrame, low: float = 0.2, high: float = 0.2, ratio: float = 0.0002, band: tuple[float, float] = (1.0, 5.0), seed: int = 0, mode: str = "token-mean", weights: str | None = None, order: tuple[str, ...] = ("traj", "pos"), **_) -> DataFrame:
    """Clipped loss with a random few tokens of a covariance band set to 0; the draw is by a seeded hash of the token."""
    adv, r = F.col("adv"), F.exp(log_ratio(None))
    by_origin = (-adv * clip(r, 1 - low, 1 + high) > -adv * r) & (F.col("mask") > 0)
    rows = _covariances(df)
    inside = (F.col("mask") > 0) & ~by_origin & (F.col("cov") > band[0]) & (F.col("cov") < band[1])
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in order], F.lit(str(seed)))
    keyed = rows.withColumn("__h", F.when(inside, F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("double")))
    tokens = df.agg(F.sum("mask")).first()[0] or 0
    drawn = _first_rows(keyed, F.col("__h"), max(int(ratio * tokens), 1), order)
    return _finish(keyed, clipped(r, low, high) * F.when(drawn, 0.0).otherwise(1.0), mode, weights)


@register("kl_cov")
def kl_cov(df: DataFrame, ratio: float = 0.0002, coef: float = 1.0, mode: str = "token-mean", weights: str | None = None, order: tuple[str, ...] = ("traj", "pos"), **_) -> DataFrame:
    """-A r, and a KL penalty on the unmasked tokens of largest covariance; ties by ``order``."""
    gap = log_ratio(None)
    used = df.filter("mask > 0")
    means = used.agg(F.avg("adv").alias("__ma"), F.avg("lp").alias("__ml"), F.count("*").alias("__n"))
    few = max(1, int((used.count()) * ratio))
    cov = (F.col("adv") - F.col("__ma")) * (F.col("lp") - F.col("__ml"))
    ranked = df.crossJoin(F.broadcast(means)).withColumn("__minus", F.when(F.col("mask") > 0, -cov))
    top = _first_rows(ranked, F.col("__minus"), few, order)
    return _finish(ranked, -F.col("adv") * F.exp(gap) + F.when(top, float(coef)).otherwise(0.0) * F.abs(gap), mode, weights)


def value_loss(df: DataFrame, value: str = "value", old: str = "old_value", ret: str = "ret", bound: float = 0.5, mode: str = "token-mean") -> DataFrame:
    near = F.least(F.greatest(F.col(value), F.col(old) - bound), F.col(old) + bound)
    worst = F.greatest((F.col(value) - F.col(ret)) ** 2, (near - F.col(ret)) ** 2)
    return aggregate_loss(df, 0.5 * worst, mode)


def _log_sum_exp(values: Column, times: float = 1.0) -> Column:
    top = F.array_max(values)
    return F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp((x - top) * times))) + top * times


def entropy(logits: Column | str) -> Column:
    """Entropy of the distribution that an array of logits stands for."""
    x = column(logits)
    lse = _log_sum_exp(x)
    return lse - F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - lse) * v)


def entropy_loss(df: DataFrame, logits: str = "logits", mode: str = "token-mean") -> DataFrame:
    return aggregate_loss(df.withColumn("__e", entropy(logits)), "__e", mode)


def sum_of_squared_probabilities(logits: Column | str) -> Column:
    x = column(logits)
    return F.exp(_log_sum_exp(x, 2.0) - 2 * _log_sum_exp(x))


def penalised_rewards(score: str, kl: Column, beta: float, mask: str = "mask") -> Column:
    return F.col(score) - F.lit(float(beta)) * kl * F.col(mask)


def mean_sequence_kl(df: DataFrame, kl: Column, traj: str = "traj", mask: str = "mask") -> DataFrame:
    """Batch mean of the masked mean of every sequence."""
    return df.groupBy(traj).agg(masked_mean(kl, mask).alias("k")).agg(F.avg("k").alias("kl"))


def adaptive_coefficient(steps: DataFrame, start: float, target: float, horizon: float, *, order: str = "step", kl: str = "kl", n: str = "n") -> DataFrame:
    """step, coef after it: coef *= 1 + clip(kl / target - 1, -0.2, 0.2) * n / horizon, over the steps in order.

    A product over steps is a sum of logarithms, so this is a window, not a fold.
    """
    factor = 1 + clip(F.col(kl) / target - 1, -0.2, 0.2) * F.col(n) / horizon
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("coef", F.lit(float(start)) * F.exp(F.sum(F.log(factor)).over(w))).select(order, "coef")


def reverse_kl(df: DataFrame, teacher: str = "ref_lp", kind: str = "k1", mode: str = "token-mean") -> DataFrame:
    """The distillation loss that estimates the reverse KL to a teacher from sampled tokens."""
    return aggregate_loss(df, kl_estimate("lp", teacher, kind), mode)


def sft_loss(df: DataFrame, lp: str = "lp", mask: str = "mask", tokens: float | None = None, ranks: int = 1) -> DataFrame:
    """Minus the summed log probability of trained tokens, over ``tokens`` of the whole batch times the ranks."""
    total = F.sum(mask) if tokens is None else F.lit(float(tokens))
    return df.agg((-masked_sum(lp, mask) / total * ranks).alias("loss"))


def composite_loss(df: DataFrame, loss: str = "vanilla", *, entropy: str | None = None, entropy_coef: float = 0.0, ref: str | None = None, kl_coef: float = 0.0, kind: str = "k3", mode: str = "token-mean", **options) -> DataFrame:
    """One row: the policy loss, its entropy bonus and its KL penalty to a reference, and their sum ``loss``."""
    made = policy_loss(loss, df, mode=mode, **options).withColumnRenamed("loss", "pg_loss")
    total = F.col("pg_loss")
    if entropy and entropy_coef:
        made = made.crossJoin(aggregate_loss(df, F.col(entropy), mode, out="entropy"))
        total = total - F.col("entropy") * entropy_coef
    if ref and kl_coef:
        made = made.crossJoin(aggregate_loss(df, kl_estimate("lp", ref, kind), mode, out="kl_loss"))
        total = total + F.col("kl_loss") * kl_coef
    return made.withColumn("loss", total)


def top_k_forward_kl(df: DataFrame, teacher: str = "teacher_lp", student: str = "student_lp", mode: str = "token-mean") -> DataFrame:
    """One row: the forward KL on the teacher's likeliest tokens (arrays of log probabilities), and both masses.

    The few tokens do not sum to 1, so a cell can be negative and is taken as 0 then.
    """
    cells = F.zip_with(teacher, student, lambda t, s: F.exp(t) * (t - s))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    mass = lambda c: total(F.transform(c, F.exp))
    rows = df.withColumn("__kl", F.greatest(total(cells), F.lit(0.0))).withColumn("__t", mass(teacher)).withColumn("__s", mass(student))
    masses = rows.agg(masked_mean("__s", "mask").alias("student_mass"), masked_mean("__t", "mask").alias("teacher_mass"))
    return aggregate_loss(rows, "__kl", mode).crossJoin(masses)


def bypass_loss(df: DataFrame, *, level: str = "token", threshold: float | str = 2.0, options: str | None = None, thresholds=None, mode: str = "seq-mean-token-sum", loss: str = "reinforce") -> DataFrame:
    """A loss with the rollout policy in place of the old one: weights and rejection come from lp - roll_lp."""
    rows = corrections.bypass(df).withColumn("log_ratio", F.col("lp") - F.col("roll_lp"))
    rows = corrections.weights(rows, level, threshold)
    if options:
        rows = corrections.reject(rows, options, thresholds, "__kept").withColumn("mask", F.col("__kept"))
    return policy_loss(loss, rows, mode=mode, weights="is_weight")
