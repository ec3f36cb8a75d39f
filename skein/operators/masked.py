"""Masked reductions and whitening over token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MASK_EPS, VAR_EPS = 1e-8, 1e-8


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def masked_sum(value: Column | str, mask: Column | str, over: WindowSpec | None = None) -> Column:
    """Sum of value * mask; what stands at mask 0 does not count, even if it is NaN."""
    mask = column(mask)
    total = F.sum(F.when(mask != 0, column(value) * mask).otherwise(F.lit(0.0)))
    return total.over(over) if over is not None else total


def masked_mean(value: Column | str, mask: Column | str, over: WindowSpec | None = None) -> Column:
    count = F.sum(column(mask))
    return masked_sum(value, mask, over) / ((count.over(over) if over is not None else count) + F.lit(MASK_EPS))


def masked_moments(df: DataFrame, value: str, mask: str, weighted: bool = False) -> DataFrame:
    """One row: mask sum ``n``, masked ``mean`` and Bessel-corrected ``var``; raises at a mask sum of 0 or 1.

    A mask of zeros and ones takes one pass, by Spark's merged second moments; ``weighted`` masks take two.
    """
    if weighted:
        first = df.agg(F.sum(mask).cast("double").alias("n"), masked_mean(value, mask).alias("mean"))
        made = df.crossJoin(F.broadcast(first)).groupBy("n", "mean").agg(masked_mean((F.col(value) - F.col("mean")) ** 2, mask).alias("v"))
    else:
        kept = F.when(F.col(mask) != 0, F.col(value))
        one = df.agg(F.sum(mask).cast("double").alias("n"), masked_mean(value, mask).alias("mean"), F.avg(kept).alias("__avg"), F.var_pop(kept).alias("__var"))
        around = F.col("__var") + (F.col("__avg") - F.col("mean")) ** 2
        made = one.select("n", "mean", (around * F.col("n") / (F.col("n") + MASK_EPS)).alias("v"))
    return made.select(
        "n", "mean", F.when(F.col("n") > 1, F.col("v") * F.col("n") / (F.col("n") - 1)).otherwise(F.raise_error(F.lit("masked variance needs a mask sum above 1")).cast("double")).alias("var")
    )


def masked_whiten(df: DataFrame, value: str, mask: str, out: str, shift_mean: bool = True, weighted: bool = False) -> DataFrame:
    """(value - mean) / sqrt(var + 1e-8) over the whole table; the moments are one row, sent to all tasks."""
    moments = masked_moments(df, value, mask, weighted)
    white = (F.col(value) - F.col("__mean")) / F.sqrt(F.col("__var") + VAR_EPS)
    if not shift_mean:
        white = white + F.col("__mean")
    sent = moments.select(F.col("mean").alias("__mean"), F.col("var").alias("__var"))
    return df.crossJoin(F.broadcast(sent)).withColumn(out, white).drop("__mean", "__var")


def clip(value: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(column(value), F.lit(float(low))), F.lit(float(high)))


def kl_estimate(lp: Column | str, ref: Column | str, kind: str = "k1") -> Column:
    """Forward value of a KL estimator; a trailing ``+`` changes gradients only, so it has the same value."""
    lp, ref = column(lp), column(ref)
    kind = {"kl": "k1", "mse": "k2", "low_var_kl": "k3"}.get(kind.rstrip("+"), kind.rstrip("+"))
    if kind == "k1":
        return lp - ref
    if kind == "abs":
        return F.abs(lp - ref)
    if kind == "k2":
        return F.lit(0.5) * (lp - ref) * (lp - ref)
    if kind == "k3":
        gap = clip(ref - lp, -20, 20)
        return clip(F.exp(gap) - gap - 1, -10, 10)
    raise ValueError(f"no KL estimator {kind!r}")


LOSS_MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-sum-norm", "seq-mean-token-mean")


def aggregate_loss(df: DataFrame, loss: Column | str, mode: str = "token-mean", *, traj: str = "traj", mask: str = "mask", scale: float | None = None, out: str = "loss") -> DataFrame:
    """One row with the loss over the batch. Trajectories without an unmasked token do not count as sequences.

    ``scale`` divides in the ``-norm`` mode; by default it is the longest trajectory.
    """
    if mode == "token-mean":
        return df.agg((masked_sum(loss, mask) / F.sum(mask)).alias(out))
    rows = df.groupBy(traj).agg(masked_sum(loss, mask).alias("__s"), F.sum(mask).alias("__n"), F.count("*").alias("__len"))
    used = F.when(F.col("__n") > 0, 1).otherwise(0)
    per_row = F.col("__s") / (F.col("__n") + MASK_EPS) if mode == "seq-mean-token-mean" else F.col("__s")
    total = F.sum(F.when(used == 1, per_row).otherwise(0.0)) / F.sum(used)
    if mode == "seq-mean-token-sum-norm":
        total = total / (F.lit(float(scale)) if scale else F.max("__len"))
    elif mode not in LOSS_MODES:
        raise ValueError(f"no loss mode {mode!r}")
    return rows.agg(total.alias(out))
