"""Filters by membership, lookups, deduplication, audits, sampling and routing."""

from __future__ import annotations

import math

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.frames import with_row_ids


def keep_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(column).distinct(), column, "left_semi")


def drop_ids(df: DataFrame, column: str, *lists: DataFrame) -> DataFrame:
    """Rows whose id is in none of the lists; a null id stays."""
    out = df
    for ids in lists:
        out = out.join(ids.select(column).distinct(), column, "left_anti")
    return out


def keep_prefixes(df: DataFrame, column: str, prefixes: DataFrame, separator: str = "_") -> DataFrame:
    """Rows whose id starts with a listed prefix (``prefix`` column); the list must not be empty."""
    if prefixes.isEmpty():
        raise ValueError("the list of prefixes is empty")
    return df.withColumn("prefix", F.split_part(column, F.lit(separator), F.lit(1))).join(prefixes.select("prefix").distinct(), "prefix", "left_semi").drop("prefix")


def keep_short(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows of at most ``most`` tokens; where the length is null (it could not be found) the row goes."""
    return df.filter(F.coalesce(length, F.lit(most + 1)) <= most)


def require_fields(df: DataFrame, *names: str) -> DataFrame:
    """Raises if any row lacks a field, naming all fields that are missing anywhere."""
    lacking = df.agg(F.concat_ws(",", *[F.when(F.count_if(F.col(n).isNull()) > 0, F.lit(n)) for n in names]).alias("__absent"))
    checked = F.when(F.col("__absent") == "", F.col(names[0])).otherwise(F.raise_error(F.concat(F.lit("missing fields: "), F.col("__absent"))))
    return df.crossJoin(F.broadcast(lacking)).withColumn(names[0], checked).drop("__absent")


def coalesce_fields(df: DataFrame, fields: dict[str, tuple[list[str], object]]) -> DataFrame:
    """Each field from the first of its aliases that is there and not missing (NaN counts as missing), else its default."""
    kinds = dict(df.dtypes)

    def seen(name: str) -> Column:
        return F.when(~F.isnan(name), F.col(name)) if kinds[name] in ("double", "float") else F.col(name)

    made = {field: F.coalesce(*[seen(a) for a in aliases if a in kinds], F.lit(default)) for field, (aliases, default) in fields.items()}
    return df.withColumns(made)


def lookup(df: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """Inner join that raises where a key is absent; a table that proves small at run time is broadcast by Spark itself."""
    joined = df.join(table.withColumn("__found", F.lit(True)), list(keys), "left")
    ok = F.when(F.col("__found"), F.col(keys[0])).otherwise(F.raise_error(F.lit("a key is not in the lookup table")).cast(dict(df.dtypes)[keys[0]]))
    return joined.withColumn(keys[0], ok).drop("__found")


def upsert_columns(base: DataFrame, update: DataFrame, *keys: str) -> DataFrame:
    """Adds or replaces columns of existing keys; rows without an update keep what they have."""
    new = [c for c in update.columns if c not in keys]
    other = update.select(*keys, *[F.col(c).alias(f"__{c}") for c in new])
    joined = base.join(other, list(keys), "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) if c in base.columns else F.col(f"__{c}") for c in new}).drop(*[f"__{c}" for c in new])


def expected_against_seen(expected: DataFrame, seen: DataFrame, uid: str, each: int) -> DataFrame:
    """One row: missing, excess and unexpected rows, when each expected uid should have ``each`` rows."""
    want = expected.select(uid).distinct().withColumn("__e", F.lit(1))
    have = seen.groupBy(uid).agg(F.count("*").alias("__n"))
    both = want.join(have, uid, "full").withColumn("__n", F.coalesce("__n", F.lit(0)))
    known = F.col("__e").isNotNull()
    return both.agg(
        F.coalesce(F.sum(F.when(known, F.greatest(F.lit(each) - F.col("__n"), F.lit(0)))), F.lit(0)).cast("long").alias("missing"),
        F.coalesce(F.sum(F.when(known, F.greatest(F.col("__n") - each, F.lit(0)))), F.lit(0)).cast("long").alias("excess"),
        F.coalesce(F.sum(F.when(~known, F.col("__n"))), F.lit(0)).cast("long").alias("unexpected"),
    )


def first_of(df: DataFrame, *keys: str, order: str = "row_id") -> DataFrame:
    """The first row of each key in order. An aggregate, so a hot key combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def ordered_distinct(df: DataFrame, column: str, order: str = "row_id") -> DataFrame:
    """The distinct values, numbered in the order in which they come first (null is a value)."""
    first = df.groupBy(column).agg(F.min(order).alias("__first"))
    return with_row_ids(first, "__first").drop("__first")


def latest_of_sessions(df: DataFrame, *keys: str, index: str = "index", order: str = "row_id", padding: str | None = None) -> DataFrame:
    """The row of highest index of each session, the first of ties; padding rows do not count."""
    rows = df.filter(~F.col(padding)) if padding else df
    rest = [c for c in df.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(index), (-F.col(order)).alias("o"))).alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def head_rows(df: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    return df.orderBy(order).limit(n)


def seeded_order(column: str, seed: int) -> Column:
    """A text that orders rows at random, the same on every run and in other engines."""
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f"/{seed}")).cast("binary"))


def sample_rows(df: DataFrame, n: int, seed: int, order: str = "row_id") -> DataFrame:
    """n rows without replacement, the first by a seeded hash of their number."""
    return df.orderBy(seeded_order(order, seed), order).limit(n)


def shuffle_pages(ids: DataFrame, column: str, seed: int, part_size: int) -> DataFrame:
    """(id, page, place): the distinct ids in a seeded order, cut into pages counted from 1, the last one short."""
    keyed = ids.select(column).distinct().withColumn("__h", seeded_order(column, seed))
    numbered = with_row_ids(keyed, "__h", column)
    return numbered.select(column, (F.floor(F.col("row_id") / part_size) + 1).cast("long").alias("page"), (F.col("row_id") % part_size).alias("place"))


def hash_bucket(text: Column | str, buckets: int) -> Column:
    """The 128-bit md5 of a text modulo ``buckets``, from four 32-bit pieces."""
    digest = F.md5(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))
    value = F.lit(0).cast("long")
    for k in range(4):
        piece = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
        value = (value * ((1 << 32) % buckets) + piece) % buckets
    return value


def repo_of(instance: Column | str) -> Column:
    """What stands before the first double underscore; raises without one."""
    c = F.col(instance) if isinstance(instance, str) else instance
    return F.when(c.contains("__"), F.split_part(c, F.lit("__"), F.lit(1))).otherwise(F.raise_error(F.lit("no repository in the id")))


def routing_map(df: DataFrame, repo: str, groups: int, order: str = "row_id") -> DataFrame:
    """(repo, groups): repositories by size, each dealt to the least loaded groups, as many as its share asks for.

    Placing one repository depends on all before it; the table has one row per repository, so it is placed here.
    """
    sizes = df.groupBy(repo).agg(F.count("*").alias("n"), F.min(order).alias("first")).collect()
    share, load, out = max(sum(r.n for r in sizes) / groups, 1e-9), [0.0] * groups, []
    for r in sorted(sizes, key=lambda r: (-r.n, r.first)):
        k = min(groups, max(1, math.ceil(r.n / share)))
        chosen = sorted(range(groups), key=lambda g: (load[g], g))[:k]
        for g in chosen:
            load[g] += r.n / k
        out.append((r[0], sorted(chosen)))
    return df.sparkSession.createDataFrame(out, f"{repo} {dict(df.dtypes)[repo]}, groups array<int>")


def route(df: DataFrame, routes: DataFrame, repo: str, instance: str) -> DataFrame:
    """Adds ``group_id``: the groups of the repository, taken by the hash of the instance."""
    joined = df.join(routes, repo)
    digest = F.md5(F.col(instance).cast("binary"))
    value, n = F.lit(0).cast("long"), F.size("groups").cast("long")
    for k in range(4):
        piece = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
        value = (value * (F.lit(1 << 32) % n) + piece) % n
    return joined.withColumn("group_id", F.element_at("groups", (value + 1).cast("int"))).drop("groups")


def least_common_multiple(*numbers: int) -> int:
    return math.lcm(*numbers)


def user_roles(messages: Column | str) -> Column:
    """Every message's role set to user."""
    return F.transform(messages, lambda m: F.struct(F.lit("user").alias("role"), m["content"].alias("content")))


def set_report(required: Column | str, passed: Column | str) -> Column:
    """Sorted hits and misses of a required list, and whether nothing is missing."""
    return F.struct(
        F.array_sort(F.array_intersect(required, passed)).alias("hit"), F.array_sort(F.array_except(required, passed)).alias("missing"),
        (F.size(F.array_except(required, passed)) == 0).alias("complete"),
    )


def sticky_routes(df: DataFrame, servers: int, *, batch: str, request: str = "request_id", order: str = "row_id") -> DataFrame:
    """Adds ``server`` to the calls of each batch, in order: a request keeps its server, a new one takes the least loaded.

    A call counts as load until the batch ends; of equal loads the first server wins. Each choice depends on all before
    it, so a batch, which one router serves, is one group.
    """

    def assign(calls: pd.DataFrame) -> pd.DataFrame:
        load, known, out = [(0, k) for k in range(servers)], {}, []
        counts, calls = [0] * servers, calls.sort_values(order)
        for name in calls[request]:
            if name not in known:
                while load[0][0] != counts[load[0][1]]:  # entries are brought up to date when they come to the top
                    heapq.heapreplace(load, (counts[load[0][1]], load[0][1]))
                known[name] = load[0][1]
            counts[known[name]] += 1
            out.append(known[name])
        return pd.DataFrame({order: calls[order], batch: calls[batch], "server": out})

    kinds = dict(df.dtypes)
    schema = f"{order} {kinds[order]}, {batch} {kinds[batch]}, server int"
    return df.join(df.select(order, batch, request).groupBy(batch).applyInPandas(assign, schema), [order, batch])
