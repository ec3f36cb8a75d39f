"""Ordered computations over the tokens of a trajectory.

Sums run as windows over token rows; recurrences that a window cannot hold are scans over Arrow batches of arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from skein.operators.masked import masked_whiten
from skein.session import checkpointed


def _along(traj: str, pos: str) -> Window:
    return Window.partitionBy(traj).orderBy(pos)


def reward_to_go(reward: str = "reward", mask: str = "mask", traj: str = "traj", pos: str = "pos") -> Column:
    return F.sum(F.col(reward) * F.col(mask)).over(_along(traj, pos).rowsBetween(Window.currentRow, Window.unboundedFollowing))


def running_sum(value: Column | str, mask: str = "mask", traj: str = "traj", pos: str = "pos") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(value * F.col(mask)).over(_along(traj, pos).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _scan_back(df: DataFrame, traj: str, columns: list[str], out: str, step: Callable[[np.ndarray, list[np.ndarray]], np.ndarray]) -> DataFrame:
    """traj, pos, the cells of ``columns`` and ``out``: a recurrence from the end of each row's arrays.

    All rows of a batch advance together, the longest first, so a step is a few numpy operations whatever the number of
    trajectories, and a long trajectory costs time in proportion to its length. ``step(state, cells)`` changes the two
    rows of ``state`` and returns the results. Arrays of a row have equal lengths; an empty or null one gives no row.
    """
    schema = StructType([df.schema[traj], StructField("pos", IntegerType()), *[StructField(c, DoubleType()) for c in (*columns, out)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.columns[1:]
            lengths = np.diff(lists[0].offsets.to_numpy())
            flat = [x.flatten().to_numpy(zero_copy_only=False).astype(float) for x in lists]
            order = np.argsort(-lengths, kind="stable")
            ends, sizes = np.cumsum(lengths)[order], lengths[order]
            result, state = np.empty(int(lengths.sum())), np.zeros((2, len(lengths)))
            for k in range(int(sizes[0]) if len(sizes) else 0):
                active = int(np.searchsorted(-sizes, -k, "left"))
                at = ends[:active] - 1 - k
                result[at] = step(state[:, :active], [f[at] for f in flat])
            owner = np.repeat(np.arange(len(lengths)), lengths)
            pos = (np.arange(len(result)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(pos), *map(pa.array, flat), pa.array(result)], schema.names)

    return df.select(traj, *columns).mapInArrow(run, schema)


def discounted_returns(df: DataFrame, rewards: str = "reward", mask: str = "mask", gamma: float = 1.0, traj: str = "traj") -> DataFrame:
    """traj, pos, the cells and ``ret``: R_t = r_t + gamma * (R_{t+1} * mask_{t+1})."""

    def step(state: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
        now = cells[0] + gamma * state[0]
        state[0] = now * cells[1]
        return now

    return _scan_back(df, traj, [rewards, mask], "ret", step)


def reinforce_plus_plus(df: DataFrame, rewards: str = "reward", mask: str = "mask", gamma: float = 1.0, traj: str = "traj") -> DataFrame:
    """Discounted returns of a table of arrays, whitened over all unmasked tokens: traj, pos, ret, mask, advantage."""
    flat = checkpointed(discounted_returns(df, rewards, mask, gamma, traj)).select(traj, "pos", "ret", F.col(mask).alias("mask"))
    white = masked_whiten(flat, "ret", "mask", "advantage")
    return white.withColumn("advantage", F.col("advantage") * F.col("mask"))


def gae(df: DataFrame, rewards: str = "reward", values: str = "value", mask: str = "mask", gamma: float = 1.0, lam: float = 1.0, traj: str = "traj", whiten: bool = True) -> DataFrame:
    """Generalised advantage estimation over a table of arrays: traj, pos, mask, ret, advantage.

    A token of mask 0 hands on the next value and the running advantage. Returns are advantages before whitening
    plus values.
    """

    def step(state: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
        r, v, m = cells
        last = r + gamma * state[0] - v + gamma * lam * state[1]
        state[1] = m * last + (1 - m) * state[1]
        state[0] = m * v + (1 - m) * state[0]
        return state[1]

    made = _scan_back(df, traj, [rewards, values, mask], "raw", step)
    made = checkpointed(made) if whiten else made  # read twice below
    flat = made.select(traj, "pos", F.col(mask).alias("mask"), (F.col("raw") + F.col(values)).alias("ret"), "raw")
    done = masked_whiten(flat, "raw", "mask", "advantage") if whiten else flat.withColumn("advantage", F.col("raw"))
    return done.drop("raw")


def optimal_token_baseline(
    df: DataFrame, *, uid: str = "uid", traj: str = "traj", pos: str = "pos", reward: str = "reward", mask: str = "mask", lp: str = "old_lp",
    sum_pi2: Column | None = None, weights: str | None = None, eps: float = 1e-8, zero_tail: bool = True, compact: bool = False, few: bool = False,
) -> DataFrame:
    """Adds ``ret`` and ``advantage``: returns minus the variance-optimal baseline of the group at each position.

    w = 1 - 2 exp(lp) + sum_pi2 (times the squared weight), summed along the trajectory; the baseline is
    sum(ret * W) / (sum(W) + eps) over the group's unmasked tokens at a position, 0 for a group of one and, with
    ``zero_tail``, where only the single longest trajectory still has tokens. ``compact`` counts positions over
    unmasked tokens only, as turns leave gaps. ``few`` says that groups and positions are few, so that their baselines
    are sent to all tasks and tokens stay where they are.
    """
    w = 1 - 2 * F.exp(F.col(lp)) + (F.lit(0.0) if sum_pi2 is None else sum_pi2)
    if weights:
        w = w * F.col(weights) * F.col(weights)
    rows = df.withColumn("ret", reward_to_go(reward, mask, traj, pos)).withColumn("__w", running_sum(w, mask, traj, pos))
    place = F.sum(mask).over(_along(traj, pos)) - 1 if compact else F.col(pos)
    rows = rows.withColumn("__p", place.cast("long")).withColumn("__len", F.sum(mask).over(Window.partitionBy(traj, uid)))
    sizes = df.groupBy(uid, traj).agg(F.sum(mask).alias("__len"))
    if compact:
        sizes = sizes.filter("__len > 0")
    # The two longest lengths of a group, from its distinct lengths; a length that two share stands for both.
    by_length = sizes.groupBy(uid, "__len").agg(F.count("*").alias("__c"))
    lengths = by_length.groupBy(uid).agg(F.sum("__c").alias("__n"), F.sort_array(F.collect_list(F.struct("__len", "__c")), False).alias("__ls"))
    second = F.when(F.col("__ls")[0]["__c"] > 1, F.col("__ls")[0]["__len"]).otherwise(F.get("__ls", F.lit(1))["__len"])
    shape = lengths.select(uid, "__n", F.col("__ls")[0]["__len"].alias("__l1"), second.alias("__l2"))
    base = rows.groupBy(uid, "__p").agg((F.sum(F.col("ret") * F.col("__w") * F.col(mask)) / (F.sum(F.col("__w") * F.col(mask)) + eps)).alias("__b"))
    said = base.join(shape, uid, "left")
    joined = rows.join(F.broadcast(said) if few else said, [uid, "__p"])  # what a group says is joined first, so tokens move once
    n = F.when(F.col("__len") > 0, F.col("__n")) if compact else F.col("__n")
    baseline = F.when(F.coalesce(n, F.lit(1)) <= 1, 0.0)
    if zero_tail:
        alone = (F.col("__len") == F.col("__l1")) & (F.col("__l1") > F.col("__l2")) & (F.col("__p") >= F.col("__l2"))
        baseline = baseline.when(alone, 0.0)
    value = (F.col("ret") - baseline.otherwise(F.col("__b"))) * F.col(mask)
    return joined.withColumn("advantage", value).select(*df.columns, "ret", "advantage")


def remax(df: DataFrame, baselines: DataFrame, *, uid: str = "uid", reward: str = "reward", mask: str = "mask", traj: str = "traj", pos: str = "pos") -> DataFrame:
    """Adds ``advantage``: reward-to-go minus the baseline (uid, baseline) of its prompt; a prompt without one raises."""
    joined = df.withColumn("__g", reward_to_go(reward, mask, traj, pos)).join(baselines.select(uid, "baseline"), uid, "left")
    missing = F.raise_error(F.lit("a prompt has no baseline")).cast("double")
    value = F.when(F.col("baseline").isNull(), missing).otherwise((F.col("__g") - F.col("baseline")) * F.col(mask))
    return joined.withColumn("advantage", value).drop("__g", "baseline")


def first_unmasked(values: str, mask: str = "mask") -> Column:
    """The value at the first 1 of the mask, the first value if there is none."""
    at = F.array_position(mask, F.lit(1).cast("int"))
    return F.element_at(values, F.greatest(at, F.lit(1)).cast("int"))


def runs(df: DataFrame, *keys: str, group: str | None = None, order: str = "row_id", out: str = "run") -> DataFrame:
    """Numbers the runs of equal neighbouring ``keys`` (nulls equal) from 1 in ``order``, within ``group``."""
    w = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(order)
    first = F.row_number().over(w) == 1
    new = first
    for k in keys:
        new = new | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    return df.withColumn("__new", new.cast("int")).withColumn(out, F.sum("__new").over(w)).drop("__new")


def streaks(df: DataFrame, *keys: str, group: str = "uid", order: str = "row_id", reset: Column | None = None, warn: int = 3, stop: int = 5) -> DataFrame:
    """Length so far of a run of equal actions, and what it calls for; a row of ``reset`` starts anew."""
    base = df.withColumn("__r", reset if reset is not None else F.lit(False))
    numbered = runs(base, *keys, "__r", group=group, order=order, out="__run")
    w = Window.partitionBy(group, "__run").orderBy(order)
    length = F.when(F.col("__r"), 0).otherwise(F.row_number().over(w)).cast("long")
    verdict = F.when(F.col("streak") >= stop, "terminate").when(F.col("streak") >= warn, "warn").otherwise("none")
    return numbered.withColumn("streak", length).withColumn("verdict", verdict).drop("__r", "__run")


def run_index(df: DataFrame, key: str, order: str = "row_id", group: str | None = None, out: str = "rollout_n") -> DataFrame:
    """Position from 0 within a run of equal neighbouring keys."""
    numbered = runs(df, key, order=order, group=group, out="__run")
    parts = [group, "__run"] if group else ["__run"]
    return numbered.withColumn(out, (F.row_number().over(Window.partitionBy(*parts).orderBy(order)) - 1).cast("long")).drop("__run")


def last_value(value: str, order: str) -> Column:
    return F.max_by(value, order)


def slowest_row(df: DataFrame, *times: str, keep: list[str]) -> DataFrame:
    """The row with the largest sum of ``times``."""
    total = sum((F.col(t) for t in times), F.lit(0.0))
    return df.agg(F.max_by(F.struct(*keep), total).alias("s"), F.max(total).alias("total")).select(*[f"s.{c}" for c in keep], "total")
