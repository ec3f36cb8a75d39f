"""Balanced packing of sequences into parts and micro-batches.

Placing one sequence depends on all before it. A single batch, which a training step bounds, is placed on the driver
and joins back as a small table; ``pack_batches`` packs the batches of a whole table, one in a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS = 1_000_000


def workload(length: Column) -> Column:
    """Linear and quadratic cost of a sequence."""
    return length * 24576 + length * length


def _cost(length: int) -> int:
    return 24576 * length + length * length


def differencing(weights: list[int], parts: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing: repeatedly joins the two most uneven partial partitions, heaviest part with lightest."""
    if not weights:
        return [[] for _ in range(parts)]
    order = sorted(range(len(weights)), key=lambda i: (weights[i], i))
    if equal_size and len(weights) % parts:
        raise ValueError(f"{len(weights)} rows do not make {parts} equal parts")
    width = parts if equal_size else 1

    def heavy_first(sets: list) -> list:
        return sorted(sets, key=lambda s: (-s[0], -len(s[1]), [(-i, -w) for i, w in s[1]]))

    def entry(sets: list) -> tuple:
        top = sets[0]
        return (-(top[0] - sets[-1][0]), -top[0], -len(top[1]), [(-i, -w) for i, w in top[1]]), sets

    heap: list[tuple] = []
    for start in range(0, len(order), width):
        sets = [(weights[i], [(i, weights[i])]) for i in order[start : start + width]] + [(0, [])] * (parts - width if not equal_size else 0)
        key, sets = entry(heavy_first(sets))
        heapq.heappush(heap, (key, start, sets))
    tick = len(order)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = [(a[k][0] + b[parts - 1 - k][0], a[k][1] + b[parts - 1 - k][1]) for k in range(parts)]
        key, sets = entry(heavy_first(joined))
        tick += 1
        heapq.heappush(heap, (key, tick, sets))
    return [sorted(i for i, _ in s[1]) for s in heap[0][2]]


def greedy(weights: list[int], parts: int, equal_size: bool = False) -> list[list[int]]:
    """Each row in order to the least loaded part, the lowest number of ties."""
    bias = sum(weights) + 1 if equal_size else 0
    load, out = [0] * parts, [[] for _ in range(parts)]
    for i, weight in enumerate(weights):
        k = min(range(parts), key=lambda p: (load[p], p))
        load[k] += weight + bias
        out[k].append(i)
    return out


def checked(partition: list[list[int]], rows: int) -> list[list[int]]:
    if any(not p for p in partition) or sorted(i for p in partition for i in p) != list(range(rows)):
        raise ValueError("a part is empty, or a row is missing or twice there")
    return [sorted(p) for p in partition]


def _collected(df: DataFrame, *columns: str, order: str) -> list:
    rows = df.select(order, *columns).orderBy(order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a batch of more than {MOST_ROWS} rows; pack it by groups")
    return rows


def _assigned(df: DataFrame, ids: list, partition: list[list[int]], order: str, name: str) -> DataFrame:
    pairs = [(ids[i], k) for k, part in enumerate(partition) for i in part]
    table = df.sparkSession.createDataFrame(pairs, f"{order} {dict(df.dtypes)[order]}, {name} int")
    return df.join(table, order)


def balanced_parts(df: DataFrame, length: str, parts: int, *, order: str = "row_id", equal_size: bool = True, method=differencing, name: str = "part") -> DataFrame:
    rows = _collected(df, length, order=order)
    return _assigned(df, [r[0] for r in rows], checked(method([_cost(r[1]) for r in rows], parts, equal_size), len(rows)), order, name)


def group_balanced_parts(df: DataFrame, length: str, uid: str, parts: int, *, order: str = "row_id", name: str = "part") -> DataFrame:
    """Runs of equal uid stay together, and each part gets as many runs."""
    rows = _collected(df, length, uid, order=order)
    groups: list[list[int]] = []
    for i, r in enumerate(rows):
        if i and rows[i - 1][2] == r[2]:
            groups[-1].append(i)
        else:
            groups.append([i])
    placed = checked(differencing([sum(_cost(rows[i][1]) for i in g) for g in groups], parts, True), len(groups))
    return _assigned(df, [r[0] for r in rows], [[i for g in part for i in groups[g]] for part in placed], order, name)


def micro_batch_plan(lengths: list[int], most_tokens: int, least: int = 1, divided_by: int = 1, group_size: int = 1, interleave: bool = True) -> list[list[int]]:
    """Rows of each micro-batch: as few as the token limit asks for, at least ``least``, a multiple of ``divided_by``,
    evenly loaded, groups of consecutive rows kept together; small ones stand at both ends."""
    if lengths and max(lengths) > most_tokens:
        raise ValueError("a sequence is longer than a micro-batch")
    if len(lengths) % group_size:
        raise ValueError("the rows do not divide into groups")
    groups = len(lengths) // group_size
    count = max(least, min(groups, -(-sum(lengths) // most_tokens)))
    count = -(-count // divided_by) * divided_by
    if count > groups:
        raise ValueError("fewer groups than micro-batches")
    cost = [sum(_cost(lengths[g * group_size + j]) for j in range(group_size)) for g in range(groups)]
    placed = checked(differencing(cost, count), groups)
    if interleave:
        placed.sort(key=lambda p: (sum(cost[g] for g in p), p[0]), reverse=True)
        placed = placed[::2][::-1] + placed[1::2]
    return [[g * group_size + j for g in part for j in range(group_size)] for part in placed]


def micro_batches(df: DataFrame, length: str, most_tokens: int, *, order: str = "row_id", least: int = 1, divided_by: int = 1, group_size: int = 1, interleave: bool = True, name: str = "micro_batch") -> DataFrame:
    rows = _collected(df, length, order=order)
    plan = micro_batch_plan([r[1] for r in rows], most_tokens, least, divided_by, group_size, interleave)
    return _assigned(df, [r[0] for r in rows], plan, order, name)


def balance_plan(lengths: list[int], ranks: int, mini_batch: int | None = None) -> list[list[int]]:
    """Rows of each rank in the order in which it takes them: as many and as much for each, within every mini-batch if
    there are any; of what a rank gets at once the light rows stand at both ends."""
    size = mini_batch or len(lengths)
    out: list[list[int]] = [[] for _ in range(ranks)]
    for start in range(0, len(lengths), max(size, 1)):
        block = lengths[start : start + size]
        cost = [_cost(n) for n in block]
        for rank, part in enumerate(checked(differencing(cost, ranks, True), len(block))):
            light = sorted(part, key=lambda i: (cost[i], i))
            out[rank] += [start + i for i in light[::2] + light[1::2][::-1]]
    return out


def _in_batches(df: DataFrame, batch_size: int, columns: list[str], order: str, plan: Callable[[pd.DataFrame], list[list[int]]], name: str) -> DataFrame:
    """(batch, order, name, place): consecutive batches of a whole table, one planned in a task; a part's rows keep the
    order of the plan in ``place``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order).reset_index(drop=True)
        placed = sorted((i, k, at) for k, rows in enumerate(plan(group)) for at, i in enumerate(rows))
        return pd.DataFrame({"batch": group["batch"], order: group[order], name: [k for _, k, _ in placed], "place": [at for _, _, at in placed]})

    batched = df.select(*columns, F.floor(F.col(order) / batch_size).cast("long").alias("batch"))
    return batched.groupBy("batch").applyInPandas(run, f"batch long, {order} {dict(df.dtypes)[order]}, {name} int, place int")


def micro_batches_of(df: DataFrame, length: str, most_tokens: int, batch_size: int, *, order: str = "row_id", name: str = "micro_batch", **options) -> DataFrame:
    """``micro_batch_plan`` for every batch of a whole table."""
    return _in_batches(df, batch_size, [order, length], order, lambda g: micro_batch_plan([int(x) for x in g[length]], most_tokens, **options), name)


def balanced_batches(df: DataFrame, length: str, ranks: int, batch_size: int, *, mini_batch: int | None = None, order: str = "row_id", name: str = "rank") -> DataFrame:
    """``balance_plan`` for every batch of a whole table; a batch, or mini-batch, has to divide by the ranks."""
    return _in_batches(df, batch_size, [order, length], order, lambda g: balance_plan([int(x) for x in g[length]], ranks, mini_batch), name)


def group_balanced_batches(df: DataFrame, length: str, uid: str, parts: int, batch_size: int, *, order: str = "row_id", name: str = "part") -> DataFrame:
    """Runs of equal uid stay together, and each part of a batch gets as many runs, or it raises."""

    def plan(group: pd.DataFrame) -> list[list[int]]:
        number = (group[uid] != group[uid].shift()).cumsum() - 1
        members = [list(rows.index) for _, rows in group.groupby(number)]
        placed = checked(differencing([sum(_cost(int(group[length][i])) for i in m) for m in members], parts, True), len(members))
        return [[i for g in part for i in members[g]] for part in placed]

    return _in_batches(df, batch_size, [order, length, uid], order, plan, name)


def pack_batches(df: DataFrame, length: str, parts: int, batch_size: int, *, order: str = "row_id", method: str = "differencing", name: str = "part") -> DataFrame:
    """Parts of every batch of a whole table, of equal sizes where the batch divides."""
    run = {"differencing": differencing, "greedy": greedy}[method]

    def plan(group: pd.DataFrame) -> list[list[int]]:
        cost = [_cost(int(x)) for x in group[length]]
        return checked(run(cost, min(parts, len(cost)), len(cost) % parts == 0), len(cost))

    return _in_batches(df, batch_size, [order, length], order, plan, name).drop("place")


def inverse(df: DataFrame, position: str, index: str) -> DataFrame:
    """The inverse of a permutation (position -> index)."""
    return df.select(F.col(index).alias(position), F.col(position).alias(index))


def imbalance(df: DataFrame, length: str, part: str, parts: int, order: str = "row_id") -> DataFrame:
    """One row: least, most and mean tokens of contiguous blocks before, and of the parts after.

    ``order`` counts the rows from 0, so a block is arithmetic on it.
    """
    size = df.agg(F.count("*").alias("__n"))
    rows = df.crossJoin(F.broadcast(size)).withColumn("__block", F.floor(F.col(order) * parts / F.col("__n")))
    sides = []
    for column, name in (("__block", "before"), (part, "after")):
        per = rows.groupBy(column).agg(F.sum(length).alias("t"))
        sides.append(per.agg(F.min("t").alias(f"{name}_min"), F.max("t").alias(f"{name}_max"), F.avg("t").alias(f"{name}_mean")))
    return sides[0].crossJoin(sides[1])


def top_k(df: DataFrame, value: str, k: int, *keys: str, order: str = "row_id") -> DataFrame:
    """The k largest rows of each key, ties by ``order``."""
    if not keys:
        return df.orderBy(F.desc(value), order).limit(k)
    w = Window.partitionBy(*keys).orderBy(F.desc(value), order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def trajectory_key(uid: Column, session: Column, index: Column) -> Column:
    return F.concat_ws("_", uid, session.cast("string"), index.cast("string"))


def parsed_key(key: Column) -> Column:
    """(uid, session_id, index) of a key; one that does not fit is a session of its own."""
    fits = key.rlike(r"^.*_\d+_\d+$")
    return F.struct(
        F.when(fits, F.regexp_extract(key, r"^(.*)_(\d+)_(\d+)$", 1)).otherwise(key).alias("uid"),
        F.when(fits, F.regexp_extract(key, r"^(.*)_(\d+)_(\d+)$", 2)).otherwise(key).alias("session_id"),
        F.when(fits, F.regexp_extract(key, r"^(.*)_(\d+)_(\d+)$", 3).cast("int")).otherwise(0).alias("index"),
    )


def sort_by_key(df: DataFrame) -> DataFrame:
    return df.orderBy("uid", "session_id", "index")
