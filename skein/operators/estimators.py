"""All advantage estimators by name, over one table of tokens.

Estimators need trajectories (a score each), arrays of cells, or token rows. ``estimate`` takes token rows (uid, traj,
pos, reward, value, old_lp, mask), brings them into the shape that the named one asks for, and returns token rows again:
traj, pos, advantage, and ``ret`` where the estimator has returns of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import groups, sequences
from skein.operators.masked import masked_sum

#: Estimators of trajectories: one advantage for all unmasked tokens of a trajectory.
OUTCOME = ("grpo", "grpo_vectorized", "gdpo", "grpo_passk", "reinforce_plus_plus_baseline", "rloo", "rloo_vectorized", "opo", "gpg")


def _outcome(name: str) -> Callable[..., DataFrame]:
    def run(tokens: DataFrame, **options) -> DataFrame:
        scores = tokens.groupBy("uid", "traj").agg(masked_sum("reward", "mask").alias("score"), F.sum("mask").alias("length"))
        rows = scores.withColumn("row_id", F.col("traj"))
        if name in ("gdpo", "reinforce_plus_plus_baseline"):
            options = {"mask": "length"} | options  # the batch is whitened over tokens
        made = groups.estimate(name, rows, **options).select("traj", F.col("advantage").alias("__a"))
        return tokens.select("traj", "pos", "mask").join(made, "traj").select("traj", "pos", (F.col("__a") * F.col("mask")).alias("advantage"))

    return run


def _arrays(tokens: DataFrame) -> DataFrame:
    cells = tokens.groupBy("traj").agg(F.array_sort(F.collect_list(F.struct("pos", "reward", "value", "mask"))).alias("c"))
    return cells.select("traj", *[F.col(f"c.{n}").alias(n) for n in ("reward", "value", "mask")])


def gae(tokens: DataFrame, gamma: float = 1.0, lam: float = 1.0, **_) -> DataFrame:
    return sequences.gae(_arrays(tokens), gamma=gamma, lam=lam).select("traj", F.col("pos").cast("long").alias("pos"), "ret", "advantage")


def reinforce_plus_plus(tokens: DataFrame, gamma: float = 1.0, **_) -> DataFrame:
    return sequences.reinforce_plus_plus(_arrays(tokens), gamma=gamma).select("traj", F.col("pos").cast("long").alias("pos"), "ret", "advantage")


def remax(tokens: DataFrame, baselines: DataFrame | None = None, **_) -> DataFrame:
    if baselines is None:
        raise ValueError("remax needs a baseline (uid, baseline) for each prompt")
    return sequences.remax(tokens, baselines).select("traj", "pos", "advantage")


def _optimal(compact: bool) -> Callable[..., DataFrame]:
    def run(tokens: DataFrame, sum_pi2: Column | None = None, weights: str | None = None, few: bool = False, **_) -> DataFrame:
        made = sequences.optimal_token_baseline(tokens, sum_pi2=sum_pi2, weights=weights, compact=compact, few=few)
        return made.select("traj", "pos", "ret", "advantage")

    return run


REGISTRY: dict[str, Callable[..., DataFrame]] = {name: _outcome(name) for name in OUTCOME} | {
    "gae": gae, "reinforce_plus_plus": reinforce_plus_plus, "remax": remax, "optimal_token_baseline": _optimal(False), "tir_optimal_token_baseline": _optimal(True),
}


def register(name: str) -> Callable:
    def keep(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = function
        return function

    return keep


def estimate(name: str, tokens: DataFrame, **options) -> DataFrame:
    if name not in REGISTRY:
        raise ValueError(f"no estimator {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](tokens, **options)
