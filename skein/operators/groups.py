"""Group-relative advantages: one score per trajectory, compared within its prompt group.

Each estimator adds ``advantage`` to a table of trajectories. Statistics of a group are window aggregates over one
partitioning, so several estimators on a table share an exchange. Conventions for a group of one differ between
estimators and are part of each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.frames import with_row_ids
from skein.operators.masked import masked_whiten

EPS = 1e-6
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def keep(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        ESTIMATORS[name] = function
        return function

    return keep


def estimate(name: str, df: DataFrame, **options) -> DataFrame:
    if name not in ESTIMATORS:
        raise ValueError(f"no estimator {name!r}; there are {sorted(ESTIMATORS)}")
    return ESTIMATORS[name](df, **options)


def _stats(score: str, uid: str) -> tuple[Column, Column, Column]:
    w = Window.partitionBy(uid)
    return F.count(score).over(w), F.avg(score).over(w), F.stddev_samp(score).over(w)


def grpo_value(score: str, uid: str, eps: float = EPS, normalize: bool = True) -> Column:
    """(s - mean) / (std + eps); a group of one has mean 0 and std 1."""
    n, mean, std = _stats(score, uid)
    s = F.col(score)
    if not normalize:
        return F.when(n == 1, s).otherwise(s - mean)
    return F.when(n == 1, s / (1 + eps)).otherwise((s - mean) / (std + eps))


@register("grpo")
def grpo(df: DataFrame, score: str = "score", uid: str = "uid", eps: float = EPS, normalize: bool = True, **_) -> DataFrame:
    return df.withColumn("advantage", grpo_value(score, uid, eps, normalize))


ESTIMATORS["grpo_vectorized"] = grpo


@register("gdpo")
def gdpo(df: DataFrame, scores: dict[str, float] | None = None, uid: str = "uid", eps: float = EPS, mask: str | None = None, **_) -> DataFrame:
    """A weighted sum of one group advantage per reward column, whitened over the batch (weighted by ``mask``)."""
    scores = scores or {"score": 1.0}
    total = sum((F.lit(float(weight)) * grpo_value(name, uid, eps) for name, weight in scores.items()), F.lit(0.0))
    summed = df.withColumn("__a", total)
    weights = mask or "__one"
    if mask is None:
        summed = summed.withColumn(weights, F.lit(1))
    white = masked_whiten(summed, "__a", weights, "__w", weighted=mask is not None)
    return white.withColumn("advantage", F.col("__w") * (F.col(weights) != 0).cast("int")).drop("__a", "__w", *([weights] if mask is None else []))


@register("grpo_passk")
def grpo_passk(df: DataFrame, score: str = "score", uid: str = "uid", order: str = "row_id", eps: float = EPS, normalize: bool = True, **_) -> DataFrame:
    """The first of a group's best rows gets (best - second) / (std + eps), all others 0; a group of one raises."""
    n, _mean, std = _stats(score, uid)
    ranked = Window.partitionBy(uid).orderBy(F.desc(score), order)
    second = F.nth_value(score, 2).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gain = F.col(score) - second
    if normalize:
        gain = gain / (std + eps)
    value = F.when(n < 2, F.raise_error(F.lit("pass@k needs two samples in a group")).cast("double")).when(F.row_number().over(ranked) == 1, gain).otherwise(0.0)
    return df.withColumn("advantage", value)


@register("reinforce_plus_plus_baseline")
def baseline_whitened(df: DataFrame, score: str = "score", uid: str = "uid", mask: str | None = None, **_) -> DataFrame:
    """s - mean (0 for a group of one), whitened over the batch; ``mask`` is the weight of a row."""
    centred = df.withColumn("__a", grpo_value(score, uid, normalize=False))
    weights = mask or "__one"
    if mask is None:
        centred = centred.withColumn(weights, F.lit(1))
    white = masked_whiten(centred, "__a", weights, "__w", weighted=mask is not None)
    return white.withColumn("advantage", F.col("__w") * (F.col(weights) != 0).cast("int")).drop("__a", "__w", *([weights] if mask is None else []))


def _left_out(score: str, uid: str) -> tuple[Column, Column]:
    n, mean, _std = _stats(score, uid)
    return n, (F.col(score) - mean) * n / (n - 1)


@register("rloo")
def rloo(df: DataFrame, score: str = "score", uid: str = "uid", **_) -> DataFrame:
    """Leave-one-out; a group of one keeps its score."""
    n, value = _left_out(score, uid)
    return df.withColumn("advantage", F.when(n > 1, value).otherwise(F.col(score)))


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame, score: str = "score", uid: str = "uid", **_) -> DataFrame:
    """Leave-one-out; a group of one gets 0."""
    n, value = _left_out(score, uid)
    return df.withColumn("advantage", F.when(n > 1, value).otherwise(0.0))


@register("opo")
def opo(df: DataFrame, score: str = "score", uid: str = "uid", length: str = "length", **_) -> DataFrame:
    """s minus the length-weighted mean of the group, 0 for a group of one or one without any length."""
    w = Window.partitionBy(uid)
    total = F.sum(length).over(w)
    base = F.when(total == 0, 0.0).otherwise(F.sum(F.col(length) * F.col(score)).over(w) / total)
    return df.withColumn("advantage", F.col(score) - F.when(F.count(score).over(w) > 1, base).otherwise(0.0))


@register("gpg")
def gpg(df: DataFrame, score: str = "score", uid: str = "uid", f_norm: float = 1.0, **_) -> DataFrame:
    """alpha * (s - mean) / f_norm, alpha being rows over rows with a score other than 0."""
    alpha = df.agg((F.count("*") / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).alias("__alpha"))
    value = F.col("__alpha") * grpo_value(score, uid, normalize=False) / F.lit(float(f_norm))
    return df.crossJoin(F.broadcast(alpha)).withColumn("advantage", value).drop("__alpha")


def group_of_last_outputs(df: DataFrame, score: str = "score", uid: str = "uid", session: str = "session_id", index: str = "index", **options) -> DataFrame:
    """Only the last output of a session enters its group; its advantage goes to the earlier outputs."""
    w = Window.partitionBy(uid, session)
    marked = df.withColumn("__last", F.col(index) == F.max(index).over(w))
    last = ESTIMATORS["grpo"](marked.filter("__last"), score=score, uid=uid, **options).select(uid, session, "advantage")
    return marked.drop("__last").join(last, [uid, session])


def informative_groups(df: DataFrame, metric: str = "score", uid: str = "uid") -> DataFrame:
    """An extension: groups whose rows all have the same metric go."""
    w = Window.partitionBy(uid)
    return df.withColumn("__spread", F.max(metric).over(w) > F.min(metric).over(w)).filter("__spread").drop("__spread")


def resample_weights(df: DataFrame, score: str = "score", method: str = "pow", power: float = 2.0) -> DataFrame:
    """Adds ``weight`` for drawing rows with replacement: by power, by extremes, or by the best."""
    s = F.col(score)
    if method == "pow":
        return df.withColumn("weight", F.greatest(F.pow(F.abs(s), F.lit(power)) + 1e-8, F.lit(1e-8)))
    edges = df.agg(F.max(score).alias("__high"), F.min(score).alias("__low"))
    if method == "max_min":
        weight = F.when((s == F.col("__high")) | (s == F.col("__low")), 1.0).otherwise(0.0)
    elif method == "max_random":
        weight = F.when(s == F.col("__high"), 0.4).otherwise(0.1)
    else:
        raise ValueError(f"no method {method!r}")
    return df.crossJoin(F.broadcast(edges)).withColumn("weight", weight + 1e-8).drop("__high", "__low")


def factorised(df: DataFrame, key: str = "uid", out: str = "group_id") -> DataFrame:
    """Adds ``out``: numbers from 0 for the distinct keys in their order; whole numbers, also as text, stay as they are."""
    text = F.col(key).cast("string")
    whole = F.when(text.rlike(r"^\s*[+-]?\d{1,15}(\.0+)?\s*$"), text.cast("double").cast("long"))
    plain = df.agg(F.count_if(whole.isNull() & F.col(key).isNotNull()).alias("n")).first().n == 0
    if plain:
        return df.withColumn(out, whole)
    numbered = with_row_ids(df.select(key).distinct(), key).withColumnRenamed("row_id", out)
    return df.join(numbered, key)


def resample(df: DataFrame, order: str = "row_id", seed: int = 0, buckets: int = 1024, **options) -> DataFrame:
    """As many rows as there are, drawn with replacement by weight: a draw is a seeded hash of a row on the summed weights.

    Summed weights are made in two levels (hash buckets, then rows of a bucket), so no window holds the whole table.
    Each stretch ends where the next one begins, the first at 0 and the last beyond 1, so every draw meets one row. A
    draw finds it by a grid over the sums: both sides are keyed by cell, and there are an eighth as many cells as rows.
    """
    weighted = resample_weights(df, **options).withColumn("__b", F.pmod(F.xxhash64(order, F.lit(seed)), F.lit(buckets)))
    sums = weighted.groupBy("__b").agg(F.sum("weight").alias("__w"))
    along = Window.orderBy("__b")  # one row a bucket
    edges = sums.select("__b", ((F.sum("__w").over(along) - F.col("__w")) / F.sum("__w").over(Window.partitionBy())).alias("__from"), "__w")
    edges = edges.withColumn("__to", F.lead("__from", 1, 2.0).over(along))
    inside = Window.partitionBy("__b").orderBy(order)
    inner = F.col("__from") + (F.col("__to") - F.col("__from")) * F.sum("weight").over(inside) / F.col("__w")
    top = F.least(F.greatest(inner, F.col("__from")), F.col("__to"))
    rows = weighted.join(F.broadcast(edges), "__b").withColumn("__high", F.when(F.lead(order).over(inside).isNull(), F.col("__to")).otherwise(top))
    rows = rows.withColumn("__low", F.coalesce(F.lag("__high").over(inside), F.when(F.col("__from") <= 0, 0.0).otherwise(F.col("__from"))))
    cells = max(buckets, df.count() // 8)
    covered = F.sequence(F.floor(F.col("__low") * cells), F.least(F.floor(F.col("__high") * cells), F.lit(cells).cast("long")))
    uniform = F.pmod(F.xxhash64(order, F.lit(seed + 1)), F.lit(1 << 52)) / float(1 << 52)
    draws = df.select(uniform.alias("__u")).withColumn("__cell", F.floor(F.col("__u") * cells))
    met = rows.filter("__low < __high AND __low < 1").withColumn("__cell", F.explode(covered))
    return draws.join(met, "__cell").filter("__u >= __low AND __u < __high").select(*df.columns)
