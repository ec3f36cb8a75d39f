"""Importance weights, rejection masks and off-policy measures between a training and a rollout policy.

All work on token rows with ``log_ratio`` = log pi_train - log pi_rollout, ``mask`` and ``traj``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.masked import clip, masked_mean, masked_sum

BOUND = 20.0
TOKEN_OPTIONS = ("token_k1", "token_k2", "token_k3")
SEQUENCE_OPTIONS = ("seq_sum_k1", "seq_sum_k2", "seq_sum_k3", "seq_mean_k1", "seq_mean_k2", "seq_mean_k3", "seq_max_k2", "seq_max_k3")
OPTIONS = TOKEN_OPTIONS + SEQUENCE_OPTIONS


def parse_is_threshold(value: float | str) -> tuple[float | None, float]:
    """(lower, upper): a number truncates at the upper bound; ``"lo_hi"`` zeroes what lies outside."""
    parts = [float(x) for x in str(value).split("_")]
    if len(parts) > 2 or parts[-1] <= 0 or (len(parts) == 2 and not 0 < parts[0] <= parts[1]):
        raise ValueError(f"bad weight threshold {value!r}")
    return (parts[0], parts[1]) if len(parts) == 2 else (None, parts[0])


def parse_thresholds(options: str | list[str], thresholds: float | str | list) -> dict[str, tuple[float | None, float]]:
    """(lower, upper) of each option: one value for all or one each; only k1 options have a lower bound."""
    names = [o.strip() for o in (options.split(",") if isinstance(options, str) else options) if o.strip()]
    names = list(dict.fromkeys(names))
    if bad := [n for n in names if n not in OPTIONS]:
        raise ValueError(f"no rejection option {bad[0]!r}")
    values = [v.strip() if isinstance(v, str) else v for v in (thresholds.split(",") if isinstance(thresholds, str) else thresholds if isinstance(thresholds, list) else [thresholds])]
    if len(values) == 1:
        values = values * len(names)
    if len(values) != len(names):
        raise ValueError("one threshold for all options, or one for each")
    out = {}
    for name, value in zip(names, values, strict=True):
        text = str(value)
        if not name.endswith("k1"):
            if "_" in text:
                raise ValueError(f"{name} takes an upper bound only")
            out[name] = (None, float(text))
        elif "_" in text:
            low, high = (float(x) for x in text.split("_"))
            out[name] = (low, high)
        else:
            out[name] = (1 / float(text), float(text))
    return out


def weights(df: DataFrame, level: str = "token", threshold: float | str = 2.0, normalize: bool = False, out: str = "is_weight") -> DataFrame:
    """Adds the importance weight of each token: its own ratio, or that of its whole trajectory."""
    if level not in ("token", "sequence"):
        raise ValueError(f"no level {level!r}")
    low, high = parse_is_threshold(threshold)
    ratio = F.col("log_ratio") if level == "token" else masked_sum("log_ratio", "mask", Window.partitionBy("traj"))
    raw = F.exp(clip(ratio, -BOUND, BOUND)) * F.col("mask")
    kept = F.least(raw, F.lit(high)) if low is None else F.when((raw >= low) & (raw <= high), raw).otherwise(0.0)
    made = df.withColumn(out, kept)
    if not normalize:
        return made
    if level == "token":
        mean = made.agg(masked_mean(out, "mask").alias("__mean"))
    else:
        rows = made.groupBy("traj").agg(masked_mean(out, "mask").alias("w"), F.sum("mask").alias("n")).filter("n > 0")
        mean = rows.agg(F.avg("w").alias("__mean"))
    scaled = F.when(F.col("__mean") > 1e-8, F.col(out) / F.col("__mean")).otherwise(F.col(out))
    return made.crossJoin(F.broadcast(mean)).withColumn(out, scaled).drop("__mean")


def statistic(option: str) -> Column:
    """The statistic of an option at every token; sequence statistics are windows over the trajectory."""
    safe = clip("log_ratio", -BOUND, BOUND)
    kind = option[-2:]
    token = {"k1": -safe, "k2": 0.5 * safe * safe, "k3": F.exp(safe) - 1 - safe}[kind]
    w = Window.partitionBy("traj")
    if option.startswith("token"):
        return token
    if option.startswith("seq_sum"):
        return masked_sum(token, "mask", w)
    if option.startswith("seq_mean"):
        return masked_mean(token, "mask", w)
    return F.coalesce(F.max(F.when(F.col("mask") != 0, token)).over(w), F.lit(0.0))


def _passes(option: str, bounds: tuple[float | None, float], value: Column) -> Column:
    low, high = bounds
    return (value >= math.log(low)) & (value <= math.log(high)) if option.endswith("k1") else value <= high


def reject(df: DataFrame, options: str | list[str], thresholds, out: str = "kept_mask") -> DataFrame:
    """Adds the mask of tokens that pass every option; all options share one exchange by trajectory."""
    keep = F.lit(True)
    for option, bounds in parse_thresholds(options, thresholds).items():
        keep = keep & _passes(option, bounds, statistic(option))
    return df.withColumn(out, F.when(keep, F.col("mask")).otherwise(0))


def rejection_metrics(df: DataFrame, options: str | list[str], thresholds) -> DataFrame:
    """One row per option: mean, extremes, clamped std and shares beyond the bounds of its statistic over unmasked
    tokens, and the shares of tokens and of sequences that it masks."""
    parts = []
    for option, bounds in parse_thresholds(options, thresholds).items():
        k1, token = option.endswith("k1"), option.startswith("token")
        low, high = (math.log(bounds[0]), math.log(bounds[1])) if k1 else (0.0, bounds[1])
        rows = df.withColumn("__v", statistic(option)).withColumn("__bad", (~_passes(option, bounds, F.col("__v"))).cast("double"))
        held = clip("__v", low, high)
        per = rows.groupBy("traj").agg(
            masked_sum("__v", "mask").alias("s"), F.sum("mask").alias("n"), F.min(F.when(F.col("mask") != 0, F.col("__v"))).alias("lo"),
            F.max(F.when(F.col("mask") != 0, F.col("__v"))).alias("hi"), masked_sum("__bad", "mask").alias("bad"),
            masked_sum(held, "mask").alias("c"), masked_sum(held * held, "mask").alias("c2"),
            masked_sum((F.col("__v") > high).cast("double"), "mask").alias("up"), masked_sum((F.col("__v") < low).cast("double"), "mask").alias("down"),
        )
        used, tokens = F.col("n") > 0, F.sum("n") + 1e-8
        share = lambda c: F.sum(c) / tokens if token else F.avg(F.when(used, (F.col(c) > 0).cast("double")))  # noqa: E731, B023
        parts.append(per.agg(
            F.lit(option).alias("option"), (F.sum("s") / tokens).alias("mean"), F.min("lo").alias("min"), F.max("hi").alias("max"),
            share("up").alias("fraction_high"), (share("down") if k1 else F.lit(0.0)).alias("fraction_low"),
            F.sqrt(F.greatest(F.sum("c2") / tokens - (F.sum("c") / tokens) ** 2, F.lit(0.0))).alias("std"),
            (F.sum("bad") / tokens).alias("masked_fraction"), F.avg(F.when(used, (F.col("bad") > 0).cast("double"))).alias("seq_masked_fraction"),
        ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def weight_metrics(df: DataFrame, weight: str = "is_weight", high: float = 2.0, low: float | None = None) -> DataFrame:
    """Mean, extremes, shares of raw ratios beyond the bounds, clamped std and effective sample size of token weights."""
    low = 1 / high if low is None else low
    held = clip(weight, 0.0, high)
    raw = F.exp(clip("log_ratio", -BOUND, BOUND))
    mean, square = masked_mean(held, "mask"), masked_mean(held * held, "mask")
    return df.agg(
        masked_mean(weight, "mask").alias("mean"), F.min(F.when(F.col("mask") != 0, F.col(weight))).alias("min"), F.max(F.when(F.col("mask") != 0, F.col(weight))).alias("max"),
        masked_mean((raw > high).cast("double"), "mask").alias("fraction_high"), masked_mean((raw < low).cast("double"), "mask").alias("fraction_low"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), ((mean + 1e-8) * (mean + 1e-8) / square).alias("ess"),
    )


def off_policy_metrics(df: DataFrame, train: str = "old_lp", rollout: str = "roll_lp") -> DataFrame:
    """Perplexities, their log gap, KL (k1 and k3) and chi-square at token and sequence level."""
    gap = F.col(train) - F.col(rollout)
    per = df.groupBy("traj").agg(
        masked_mean(train, "mask").alias("t"), masked_mean(rollout, "mask").alias("r"), masked_sum(gap, "mask").alias("g"), F.sum("mask").alias("n"),
        masked_sum(-gap, "mask").alias("kl"), masked_sum(F.exp(gap) - gap - 1, "mask").alias("k3"), masked_sum(F.exp(2 * clip(gap, -BOUND, BOUND)), "mask").alias("sq"),
    )
    tokens = F.sum("n") + 1e-8
    return per.agg(
        F.avg(F.exp(-F.col("t"))).alias("training_ppl"), F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"), F.avg(F.col("r") - F.col("t")).alias("log_ppl_diff"),
        F.avg(F.abs(F.col("r") - F.col("t"))).alias("log_ppl_abs_diff"), (F.sum("kl") / tokens).alias("kl"), (F.sum("k3") / tokens).alias("k3_kl"),
        (F.sum("sq") / tokens - 1).alias("chi2_token"), (F.avg(F.exp(2 * clip("g", -BOUND, BOUND))) - 1).alias("chi2_seq"),
    )


def correct(df: DataFrame, *, level: str | None = "token", threshold: float | str = 2.0, options: str | None = None, thresholds=None, train: str = "old_lp", rollout: str = "roll_lp") -> DataFrame:
    """Adds ``is_weight`` (if a level is given) and always replaces ``mask`` by the mask after rejection."""
    rows = df.withColumn("log_ratio", F.col(train) - F.col(rollout))
    if level:
        rows = weights(rows, level, threshold)
    kept = reject(rows, options, thresholds, "__kept") if options else rows.withColumn("__kept", F.col("mask"))
    return kept.withColumn("mask", F.col("__kept")).drop("__kept", "log_ratio")


def bypass(df: DataFrame, rollout: str = "roll_lp", old: str = "old_lp") -> DataFrame:
    """Rollout log-probabilities stand in for the old policy's."""
    return df.withColumn(old, F.col(rollout))


def agreement(df: DataFrame, left: str, right: str, mask: str = "mask") -> DataFrame:
    """Correlation and absolute differences of two columns over unmasked tokens, and whether there are any."""
    rows = df.filter(F.col(mask) != 0).withColumn("__d", F.abs(F.col(left) - F.col(right)))
    return rows.agg(
        F.corr(left, right).alias("pearson"), F.max("__d").alias("max_diff"), F.avg("__d").alias("mean_diff"), F.stddev_samp("__d").alias("std_diff"),
        F.count_if(F.col("__d") > 0).alias("differing"), (F.count("*") > 0).alias("valid"),
    )
