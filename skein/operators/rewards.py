"""Reward managers: a scorer over a table of responses, with what each manager adds to the score, and a rate limit.

A table has data_source, solution, truth and n_tokens (response tokens; others are kept). A manager adds ``score`` and
``rewards``, an array over the response tokens with the score at the last one. Only the last output of a session is
scored where a table has several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import scoring

MANAGERS = ("naive", "batch", "prime", "dapo", "gdpo", "remote", "limited")


def last_outputs(df: DataFrame, session: str, index: str) -> DataFrame:
    """The output of highest index of each session."""
    rest = [c for c in df.columns if c != session]
    picked = df.groupBy(session).agg(F.max_by(F.struct(*rest), index).alias("r"))
    return picked.select(*[F.col(c) if c == session else F.col(f"r.{c}").alias(c) for c in df.columns])


def token_rewards(score: Column, n_tokens: Column) -> Column:
    """0 for all tokens but the last, which has the score; none for an empty response."""
    return F.when(n_tokens > 0, F.concat(F.array_repeat(F.lit(0.0), (n_tokens - 1).cast("int")), F.array(score))).otherwise(F.array().cast("array<double>"))


def reward_table(
    df: DataFrame, manager: str = "naive", *, scorer: Column | None = None, limit: int | None = None, buffer: int | None = None, factor: float = 1.0,
    parts: dict[str, Column] | None = None, session: str | None = None, index: str | None = None,
) -> DataFrame:
    """Adds ``score`` and ``rewards``; a column ``rm_score`` that is there already is taken as it is.

    ``scorer`` replaces the dispatch by source. naive, batch, prime and the served ones differ in how they call a
    scorer, which is one expression here. dapo adds the penalty of overlong responses (``limit``, ``buffer``), gdpo
    keeps every part of the score as a column of its own and adds them up.
    """
    if manager not in MANAGERS:
        raise ValueError(f"no manager {manager!r}; there are {sorted(MANAGERS)}")
    rows = last_outputs(df, session, index) if session and index else df
    score = scoring.dispatch(F.col("data_source"), F.col("solution"), F.col("truth")) if scorer is None else scorer
    if manager == "gdpo":
        if not parts:
            raise ValueError("gdpo needs the parts of the score")
        rows = rows.withColumns({f"score_{name}": part.cast("double") for name, part in parts.items()})
        score = sum((F.col(f"score_{name}") for name in parts), F.lit(0.0))
    if "rm_score" in df.columns:
        score = F.coalesce(F.col("rm_score").cast("double"), score)
    if manager == "dapo":
        if limit is None or buffer is None:
            raise ValueError("dapo needs the limit and the buffer of overlong responses")
        score = score + scoring.overlong_penalty(F.col("n_tokens"), limit, buffer, factor)
    scored = rows.withColumn("score", score.cast("double"))
    return scored.withColumn("rewards", token_rewards(F.col("score"), F.col("n_tokens")))


def rate_limited(df: DataFrame, rate: float, burst: float | None = None, *, key: str, time: str, cost: str | None = None, order: str = "row_id") -> DataFrame:
    """Adds ``starts_at``: when a token bucket lets each request of a key begin, first come first served.

    A bucket refills at ``rate`` tokens a second up to ``burst``. What was taken and is not yet refilled is a backlog
    that empties at that rate: after request i it ends at e_i = max(t_i, e_(i-1)) + c_i / rate, which unrolls into a
    running maximum over a running sum. A request begins when the backlog that it joins fits the bucket; one that
    is larger than the bucket waits for what it lacks and leaves the bucket in debt.
    """
    size = burst or rate
    spent = (F.col(cost) if cost else F.lit(1.0)).cast("double")
    along = Window.partitionBy(key).orderBy(time, order)
    before = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(spent / rate).over(before)
    return (
        df.withColumn("__s", total).withColumn("__e", F.max(F.col(time) - (F.col("__s") - spent / rate)).over(before) + F.col("__s"))
        .withColumn("starts_at", F.greatest(F.col(time).cast("double"), F.col("__e") - size / rate)).drop("__s", "__e")
    )
