"""Batch metrics, name-driven reductions over steps, and validation roll-ups with bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.quantiles import quantiles

NAN = float("nan")
#: The bootstrap: up to this length groups share their draws, so many at once; more draws than that are made in slices.
SMALL_GROUP, GROUPS_AT_ONCE, MOST_DRAWS = 64, 256, 1 << 20


def or_nan(value: Column) -> Column:
    return F.coalesce(value, F.lit(NAN))


def _mean_max_min(name: str, value: Column) -> list[Column]:
    return [or_nan(f(value)).alias(f"{name}_{k}") for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]


def batch_metrics(rows: DataFrame, limit: int, *, score: str = "score", length: str = "response_length", prompt: str = "prompt_length") -> DataFrame:
    """One row over trajectories: scores without aborted ones (no response token), lengths and clip shares."""
    kept = F.when(F.col(length) > 0, F.col(score))
    return rows.agg(
        *_mean_max_min("score", kept), *_mean_max_min("response_length", F.col(length)), *_mean_max_min("prompt_length", F.col(prompt)),
        or_nan(F.avg((F.col(length) >= limit).cast("double"))).alias("response_clip_ratio"),
        or_nan(F.avg((F.col(length) == 0).cast("double"))).alias("aborted_ratio"),
    )


def explained_variance(df: DataFrame, value: str = "value", ret: str = "ret", mask: str = "mask") -> DataFrame:
    """1 - var(ret - value) / (var(ret) + 1e-5) over unmasked tokens."""
    used = df.filter(F.col(mask) != 0)
    return used.agg(or_nan(1 - F.var_samp(F.col(ret) - F.col(value)) / (F.var_samp(ret) + 1e-5)).alias("explained_variance"))


def timing_metrics(stages: DataFrame, totals: DataFrame) -> DataFrame:
    """stage, seconds, ms_per_token: generation by response tokens, all other stages by all tokens."""
    tokens = F.when(F.col("stage") == "gen", F.col("response_tokens")).otherwise(F.col("all_tokens"))
    return stages.crossJoin(F.broadcast(totals)).select("stage", "seconds", (F.col("seconds") * 1000 / tokens).alias("ms_per_token"))


def throughput(tokens: Column, seconds: Column, gpus: int) -> Column:
    return tokens / (seconds * gpus)


def variance_proxies(tokens: DataFrame, *, traj: str = "traj", lp: str = "old_lp", mask: str = "mask", adv: str = "adv", sum_pi2: Column | None = None) -> DataFrame:
    """Signal, total power and noise of the gradient: mean advantage squared and mean squared advantage, weighted by
    the path variance of each trajectory."""
    w = 1 - 2 * F.exp(lp) + (F.lit(0.0) if sum_pi2 is None else sum_pi2)
    per = tokens.groupBy(traj).agg(F.sum(w * F.col(mask)).alias("w"), (F.sum(F.col(adv) * F.col(mask)) / F.greatest(F.sum(mask), F.lit(1))).alias("a"))
    a, w = F.col("a"), F.greatest(F.col("w"), F.lit(0.0))
    one = per.agg(F.avg(a * F.sqrt(w)).alias("g"), F.avg(a * a * w).alias("p2"), F.count("*").alias("n"))
    p1, p2 = F.col("g") * F.col("g"), F.col("p2")
    return one.select(p1.alias("signal"), p2.alias("total_power"), F.greatest((p2 - p1) / F.greatest(F.col("n") - 1, F.lit(1)), F.lit(0.0)).alias("noise"))


def reduce_by_name(df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Names with ``max`` take the maximum, else with ``min`` the minimum, else the mean."""
    name = F.col(metric)
    return df.groupBy(metric).agg(F.when(name.contains("max"), F.max(value)).when(name.contains("min"), F.min(value)).otherwise(F.avg(value)).alias("reduced"))


def typed_reduce(df: DataFrame, kind: str, metric: str = "metric", value: str = "value") -> DataFrame:
    functions = {"MEAN": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max}
    if kind not in functions:
        raise ValueError(f"no aggregation {kind!r}")
    return df.groupBy(metric).agg(functions[kind](value).alias("reduced"))


def across_ranks(df: DataFrame, kind: str, *, step: str = "step", value: str = "value") -> DataFrame:
    """SUM and MEAN average each step over ranks first; MIN and MAX look at all values."""
    if kind in ("MIN", "MAX"):
        return df.agg((F.min if kind == "MIN" else F.max)(value).alias("reduced"))
    per = df.groupBy(step).agg(F.avg(value).alias("v"))
    return per.agg((F.sum if kind == "SUM" else F.avg)("v").alias("reduced"))


# Metrics with a rule of their own.
RULES = {
    "time_sum": ("perf/time_per_step",),
    "min": ("timing_s/agent_loop/tool_calls/min",),
    "avg": ("timing_s/agent_loop/tool_calls/mean",),
    "max": ("timing_s/agent_loop/tool_calls/max",),
    "last": (
        "fully_async/count/total_generated_samples", "fully_async/count/stale_samples_processed", "fully_async/count/stale_trajectory_processed",
        "fully_async/count/current_param_version", "fully_async/count/dropped_stale_samples", "training/global_step",
    ),
}
# Parts of names and their rules, the first that fits; a weighted average is never reached, as ``avg`` fits first.
NAME_RULES = (("timing_s/", "time_sum"), ("mean", "avg"), ("avg", "avg"), ("average", "avg"), ("max", "max"), ("min", "min"), ("sum", "sum"), ("total", "sum"))


def rule_of(metric: Column) -> Column:
    rule = F.lit(None).cast("string")
    for part, kind in reversed(NAME_RULES):
        rule = F.when(F.lower(metric).contains(part), kind).otherwise(rule)
    rule = F.coalesce(rule, F.lit("avg"))
    for kind, names in RULES.items():
        rule = F.when(metric.isin(*names), kind).otherwise(rule)
    return rule


def aggregate_steps(df: DataFrame, gpus: int, *, step: str = "step", metric: str = "metric", value: str = "value") -> DataFrame:
    """metric, reduced: each metric over its steps by its rule, then ratios derived from reduced ones."""
    r = F.first(rule_of(F.col(metric)))
    made = df.groupBy(metric).agg(
        F.when(r == "last", F.max_by(value, step)).when(r.isin("sum", "time_sum"), F.sum(value)).when(r == "max", F.max(value)).when(r == "min", F.min(value)).otherwise(F.avg(value)).alias("reduced")
    )
    wide = made.agg(F.map_from_entries(F.collect_list(F.struct(metric, "reduced"))).alias("__m"))  # one entry per metric name
    get = lambda k: F.col("__m")[k]
    derived = F.filter(F.array(
        F.struct(F.lit("perf/throughput").alias(metric), (get("perf/total_num_tokens") / (get("perf/time_per_step") * gpus)).alias("d")),
        F.struct(F.lit("global_seqlen/minmax_diff").alias(metric), (get("global_seqlen/max") - get("global_seqlen/min")).alias("d")),
        F.struct(F.lit("fully_async/trainer/idle_ratio").alias(metric), (get("timing_s/gen") / get("timing_s/step")).alias("d")),
    ), lambda x: x["d"].isNotNull())
    extra = wide.select(F.explode(derived).alias("x")).select(F.col(f"x.{metric}").alias(metric), F.col("x.d").alias("d"))
    needs_own = F.col(metric).isin("perf/throughput", "global_seqlen/minmax_diff")
    both = made.join(extra, metric, "full")
    new = F.when(F.col("d").isNotNull() & (~needs_own | F.col("reduced").isNotNull()), F.col("d")).otherwise(F.col("reduced"))
    return both.select(metric, new.alias("reduced")).filter("reduced IS NOT NULL")


def subset_sizes(n: int) -> list[int]:
    """2, 4, 8, ... below n, then n; nothing for a single sample."""
    out, k = [], 2
    while k < n:
        out.append(k)
        k *= 2
    return [*out, n] if n > 1 else []


def majority(df: DataFrame, *keys: str, pred: str = "pred", value: str = "score", order: str = "row_id") -> DataFrame:
    """The first value of the most frequent prediction of each group; ties by who came first."""
    votes = df.groupBy(*keys, pred).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias("maj"))
    return votes.groupBy(*keys).agg(F.max_by("maj", F.struct(F.col("n"), (-F.col("first")).alias("f"))).alias("maj"))


def _first_of_most(codes: np.ndarray) -> np.ndarray:
    """For each row the first place whose code is as frequent in that row as any."""
    r, size = codes.shape
    k = int(codes.max()) + 1
    keys = codes + k * np.arange(r)[:, None]
    if k <= 4 * size:
        votes = np.bincount(keys.ravel(), minlength=r * k)[keys]
    else:
        _, at, counts = np.unique(keys.ravel(), return_inverse=True, return_counts=True)
        votes = counts[at].reshape(r, size)
    return votes.argmax(1)


def _resample_one(values: np.ndarray, codes: np.ndarray | None, size: int, resamples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and std of the best, the worst and the majority value over resamples of one group, a bounded number of draws
    at a time."""
    draw, n = np.random.RandomState(seed), len(values)
    parts = []
    for at in range(0, resamples, step := max(1, MOST_DRAWS // size)):
        drawn = draw.choice(n, size=(min(step, resamples - at), size), replace=True)  # goes on in the same stream
        picked = values[drawn]
        part = [picked.max(1), picked.min(1)]
        if codes is not None:
            part.append(picked[np.arange(len(picked)), _first_of_most(codes[drawn])])
        parts.append(part)
    found = np.concatenate(parts, 1)
    return found.mean(1), found.std(1)


def _resample_many(values: np.ndarray, codes: np.ndarray | None, size: int, resamples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for small groups of one length with finite values, a row each: (statistic, group).

    They share their draws. Values are compared by their rank in the group, a byte, and moments come from how often each
    rank was met.
    """
    count, n = values.shape
    drawn = np.random.RandomState(seed).choice(n, size=(resamples, size), replace=True).T
    order = values.argsort(1, kind="stable")
    ordered, ranks = np.take_along_axis(values, order, 1), order.argsort(1).astype(np.int8)
    moments = []
    for at in range(0, count, GROUPS_AT_ONCE):
        mine = np.ascontiguousarray(ranks[at : at + GROUPS_AT_ONCE].T)
        picked = [mine[x] for x in drawn]  # by draw: (resample, group)
        best, worst = picked[0].copy(), picked[0].copy()
        for x in picked[1:]:
            np.maximum(best, x, out=best)
            np.minimum(worst, x, out=worst)
        found = [best, worst]
        if codes is not None:
            numbers = np.ascontiguousarray(codes[at : at + GROUPS_AT_ONCE].T)
            votes, top = [numbers[x] for x in drawn], None
            for k, vote in enumerate(votes):
                # Equal votes from here on: of a prediction's places the first has them all, so none behind it can win.
                same = np.ones(vote.shape, np.int8)
                for other in votes[k + 1 :]:
                    same += (vote == other).view(np.int8)
                key = same.astype(np.int32)
                key <<= 16
                key += 256 * (255 - k)
                key += picked[k]
                top = key if top is None else np.maximum(top, key, out=top)
            found.append(top & 255)
        groups = mine.shape[1]
        met = np.stack([np.bincount((x + n * np.arange(groups)).ravel(), minlength=n * groups).reshape(groups, n) for x in found])
        these = ordered[at : at + GROUPS_AT_ONCE]
        mean = (met * these).sum(2) / resamples
        moments.append((mean, np.sqrt((met * (these - mean[:, :, None]) ** 2).sum(2) / resamples)))
    return tuple(np.concatenate(x, 1) for x in zip(*moments, strict=True))


def bootstrap_groups(values: np.ndarray, codes: np.ndarray | None, resamples: int = 1000, seed: int = 42) -> list[tuple[str, np.ndarray]]:
    """``bootstrap_group`` of many groups of one length, a row each; ``codes`` number their predictions from 0. Groups
    of one length meet the same draws, as the generator starts anew for each size."""
    count, n = values.shape
    out = [(f"mean@{n}", values.mean(1))]
    if n > 1:
        out.append((f"std@{n}", values.std(1)))
    names = ("best", "worst") if codes is None else ("best", "worst", "maj")
    small = (n <= SMALL_GROUP) & np.isfinite(values).all(1)
    for size in subset_sizes(n):
        mean, std = np.empty((2, len(names), count))
        if small.any():
            mean[:, small], std[:, small] = _resample_many(values[small], None if codes is None else codes[small], size, resamples, seed)
        for g in np.flatnonzero(~small):
            mean[:, g], std[:, g] = _resample_one(values[g], None if codes is None else codes[g], size, resamples, seed)
        for k, name in enumerate(names):
            out += [(f"{name}@{size}/mean", mean[k]), (f"{name}@{size}/std", std[k])]
    return out


def bootstrap_group(values: np.ndarray, preds: np.ndarray | None, resamples: int = 1000, seed: int = 42) -> list[tuple[str, float]]:
    """Metrics of one group in its order: mean, population std, and for each subset size the mean and population std
    over resamples of the best, the worst and the majority value. The generator starts anew for each size."""
    codes = None if preds is None else pd.factorize(preds, use_na_sentinel=False)[0][None, :]
    return [(name, float(x[0])) for name, x in bootstrap_groups(np.asarray(values)[None, :], codes, resamples, seed)]


def _bootstrap_batch(batch: pa.RecordBatch, voted: bool, resamples: int) -> pa.RecordBatch:
    """Sums and counts of each metric over the groups of a batch (source, variable, values, preds)."""
    names = pd.DataFrame({"source": batch.column(0).to_pandas(), "variable": batch.column(1).to_pandas()})
    kind, kinds = names.groupby(["source", "variable"], dropna=False, sort=False).ngroup().to_numpy(), names.drop_duplicates().to_numpy()
    lists = batch.column(2)
    lengths = np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(lengths) - lengths
    values = lists.flatten().to_numpy(zero_copy_only=False)
    codes = batch.column(3).flatten().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if voted else None
    rows = []
    for n in np.unique(lengths):
        mine = np.flatnonzero(lengths == n)
        for part in np.array_split(mine, max(1, len(mine) * int(n) // MOST_DRAWS)):
            places = starts[part][:, None] + np.arange(n)
            numbers = None
            if voted:
                numbers = codes[places]
                if n > SMALL_GROUP:
                    numbers = np.stack([np.unique(x, return_inverse=True)[1] for x in numbers])
                elif numbers.max() > 127:  # the first place of a prediction tells it as well
                    numbers = (numbers[:, :, None] == numbers[:, None, :]).argmax(2)
                numbers = numbers.astype(np.int8 if n <= SMALL_GROUP else np.int64)
            for metric, x in bootstrap_groups(values[places], numbers, resamples):
                sums, counts = np.bincount(kind[part], x, len(kinds)), np.bincount(kind[part], minlength=len(kinds))
                rows += [(*kinds[k], metric, float(sums[k]), int(counts[k])) for k in np.flatnonzero(counts)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()), strict=True)], ["source", "variable", "metric", "total", "groups"])


def validation_metrics(df: DataFrame, *, source: str = "data_source", uid: str = "uid", variables: tuple[str, ...] = ("score",), pred: str | None = "pred", order: str = "row_id", resamples: int = 1000) -> DataFrame:
    """source, variable, metric, value: metrics of each prompt, then their plain mean over the prompts of a source."""
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])
    long = df.select(F.col(source).cast("string").alias("source"), F.col(uid).cast("string").alias("uid"), F.col(order).alias("o"), (F.col(pred).cast("string") if pred else F.lit(None).cast("string")).alias("pred"), F.explode(cells).alias("c"))
    rows = long.select("source", "uid", "o", "pred", F.col("c.variable").alias("variable"), F.col("c.value").alias("value")).filter("value IS NOT NULL")
    packed = rows.groupBy("source", "uid", "variable").agg(F.sort_array(F.collect_list(F.struct(F.col("o").isNull().alias("last"), "o", "pred", "value"))).alias("cells"))
    groups = packed.select("source", "variable", F.col("cells.value").alias("values"), F.col("cells.pred").alias("preds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _bootstrap_batch(batch, pred is not None, resamples)

    sums = groups.mapInArrow(run, "source string, variable string, metric string, total double, groups long")
    return sums.groupBy("source", "variable", "metric").agg((F.sum("total") / F.sum("groups")).alias("value"))


def plain_validation(df: DataFrame, *, source: str = "data_source", uid: str = "uid", value: str = "score") -> DataFrame:
    """source, n, mean, std without resampling: metrics of each prompt by its size, then the mean over prompts."""
    per = df.groupBy(F.col(source).alias("source"), uid).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("best"), F.min(value).alias("worst"))
    return per.groupBy("source", "n").agg(F.count("*").alias("prompts"), F.avg("mean").alias("mean"), F.avg(F.when(F.col("n") > 1, F.col("std"))).alias("std"), F.avg("best").alias("best"), F.avg("worst").alias("worst"))


def merge_results(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two validation sets as one; a column that one side lacks is null there, so rows stay aligned."""
    return left.unionByName(right, allowMissingColumns=True)


def core_names(metrics: DataFrame) -> DataFrame:
    """Adds ``name``: the core variable (acc if a source has it, else reward) at its largest size goes to val-core."""
    w = Window.partitionBy("source")
    size = F.regexp_extract("metric", r"@(\d+)", 1).cast("int")
    core = F.when(F.max((F.col("variable") == "acc").cast("int")).over(w) == 1, "acc").otherwise("reward")
    named = metrics.withColumn("__size", size).withColumn("__core", core).withColumn("__most", F.max("__size").over(w))
    is_core = (F.col("variable") == F.col("__core")) & F.col("metric").rlike("^(mean|maj|best)@") & (F.col("__size") == F.col("__most"))
    section = F.when(is_core, "val-core").otherwise("val-aux")
    return named.withColumn("name", F.concat_ws("/", section, "source", "variable", "metric")).drop("__size", "__core", "__most")


def percentiles(df: DataFrame, value: str, *keys: str) -> DataFrame:
    plain = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"))
    ranks = quantiles(df, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, *keys)
    return plain.join(ranks, list(keys), "left") if keys else plain.crossJoin(F.broadcast(ranks))


def spec_decode_rates(df: DataFrame, drafted: str, accepted: str, verified: str) -> DataFrame:
    """Means over requests of the acceptance rate (0 without drafts) and of the accepted length."""
    rate = F.when(F.col(drafted) > 0, F.col(accepted) / F.col(drafted)).otherwise(0.0)
    length = F.when(F.col(verified) > 0, 1 + F.col(accepted) / F.col(verified)).otherwise(1.0)
    return df.agg(F.avg(rate).alias("acceptance_rate"), F.avg(length).alias("accepted_length"))


def offline_eval(df: DataFrame, scores: str, source: str = "data_source") -> DataFrame:
    """Mean of each response list's mean score, per source."""
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)
    return df.withColumn("__m", mean).groupBy(source).agg(F.avg("__m").alias("score"))


