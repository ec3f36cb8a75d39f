"""Row selection, reshaping and combination of ordered batches.

A batch is a DataFrame with a ``row_id`` counting from 0; where the row order matters it is that of ``row_id``.
Nothing here collects; sizes are read as one-row aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.session import checkpointed

ROW = "row_id"


def with_row_ids(df: DataFrame, *order: str) -> DataFrame:
    """Numbers the rows from 0 in ``order``, in two levels: counts of range partitions, then ranks inside them."""
    parts = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    parts = checkpointed(parts)  # both readers must see the same ranges, also after an executor is lost
    sizes = parts.groupBy("__p").count()
    base = sizes.select("__p", (F.sum("count").over(Window.orderBy("__p")) - F.col("count")).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return parts.withColumn("__i", inside).join(F.broadcast(base), "__p").withColumn(ROW, (F.col("__base") + F.col("__i")).cast("long")).drop("__p", "__i", "__base")


def select_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def pop_columns(df: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """(the named columns with the row number, the rest)."""
    return df.select(ROW, *names), df.drop(*names)


def column_or(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones")
    return df.toDF(*[dict(zip(old, new, strict=True)).get(c, c) for c in df.columns])


def prefix_columns(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return df.toDF(*[c if c in keep else prefix + c for c in df.columns])


def size_of(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.max(ROW) + 1, F.lit(0))).first()[0]


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... before stop; negative bounds count from the end. Rows are numbered anew."""
    negative = (start or 0) < 0 or (stop or 0) < 0
    n = size_of(df) if negative else None
    low = max(start + n, 0) if (start or 0) < 0 else start or 0
    rows = df.filter(F.col(ROW) >= low)
    if stop is not None:
        rows = rows.filter(F.col(ROW) < (stop + n if stop < 0 else stop))
    return rows.filter((F.col(ROW) - low) % step == 0).withColumn(ROW, ((F.col(ROW) - low) / step).cast("long"))


def select_rows(df: DataFrame, indices: DataFrame) -> DataFrame:
    """Rows by a table (position, index): duplicates stay, the order is that of ``position``."""
    picked = indices.select(F.col("position"), F.col("index").alias(ROW))
    return df.join(picked, ROW).drop(ROW).withColumnRenamed("position", ROW).select(*df.columns)


def union_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of two batches of equal length; columns of both must be equal in every row, or it raises."""
    shared = [c for c in right.columns if c in left.columns and c != ROW]
    other = right.select(ROW, *[F.col(c).alias(f"__{c}") if c in shared else F.col(c) for c in right.columns if c != ROW])
    same = F.lit(True)
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    both = left.withColumn("__l", F.lit(1)).join(other.withColumn("__r", F.lit(1)), ROW, "full")
    good = F.col("__l").isNotNull() & F.col("__r").isNotNull() & same
    checked = F.when(good, F.col(ROW)).otherwise(F.raise_error(F.lit("the batches differ in length or in a shared column")).cast("long"))
    return both.withColumn(ROW, checked).drop("__l", "__r", *[f"__{c}" for c in shared])


def equal_batches(left: DataFrame, right: DataFrame) -> bool:
    return sorted(left.columns) == sorted(right.columns) and left.exceptAll(right.select(*left.columns)).isEmpty() and right.select(*left.columns).exceptAll(left).isEmpty()


def concat(*parts: DataFrame, missing: bool = False) -> DataFrame:
    """Batches one after the other, numbered on; ``missing`` fills columns that a part lacks with null."""
    out, base = None, 0
    for part in parts:
        moved = part.withColumn(ROW, F.col(ROW) + base)
        base += size_of(part)
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=missing)
    return out


def merged_meta(metas: list[dict]) -> dict:
    """What batches say beside their rows, when they are put together: lists of ``metrics`` one after the other, all
    else has to agree, or it raises, naming what does not."""
    out: dict = {}
    for meta in metas:
        for name, value in meta.items():
            if name == "metrics":
                out[name] = out.get(name, []) + (value if isinstance(value, list) else [value])
            elif out.setdefault(name, value) != value:
                raise ValueError(f"batches do not agree on {name!r}: {out[name]!r} and {value!r}")
    return out


def chunk_number(df: DataFrame, chunks: int, rest: bool = False) -> DataFrame:
    """Adds ``chunk``: equal chunks in order; raises unless the rows divide. With ``rest`` rows left over are numbered on
    in chunks of that size, and only fewer rows than chunks raise."""
    n = size_of(df)
    if n % chunks and (n < chunks or not rest):
        raise ValueError(f"{n} rows do not make {chunks} equal chunks")
    return df.withColumn("chunk", F.floor(F.col(ROW) / max(n // chunks, 1)).cast("long"))


def split_number(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("part", F.floor(F.col(ROW) / size).cast("long"))


def dataset_split(df: DataFrame, parts: int) -> DataFrame:
    """Equal parts in order; rows left over go."""
    size = size_of(df) // parts
    return df.withColumn("part", F.floor(F.col(ROW) / max(size, 1)).cast("long")).filter(F.col("part") < parts)


def batches(df: DataFrame, size: int, drop_last: bool = True, order: Column | None = None) -> DataFrame:
    """Adds ``batch`` in the order of ``row_id``; a short last batch goes with ``drop_last``."""
    made = split_number(df, size).withColumnRenamed("part", "batch")
    return made.filter(F.col("batch") < size_of(df) // size) if drop_last else made


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """The rows in a seeded order, the same on every run, numbered anew."""
    keyed = df.withColumn("__h", F.md5(F.concat_ws("/", ROW, F.lit(seed)).cast("binary"))).withColumnRenamed(ROW, "__old")
    return with_row_ids(keyed, "__h", "__old").drop("__h", "__old")


def mini_batches(df: DataFrame, size: int, epochs: int, seed: int) -> DataFrame:
    """Rows of every epoch in an order of its own, with ``epoch`` and ``batch``; the rows must divide."""
    n = size_of(df)
    if n % size:
        raise ValueError(f"{n} rows do not divide into batches of {size}")
    every = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    keyed = every.withColumn("__h", F.md5(F.concat_ws("/", ROW, "epoch", F.lit(seed)).cast("binary"))).withColumnRenamed(ROW, "__old")
    placed = with_row_ids(keyed, "epoch", "__h", "__old")  # epochs one after the other, so no window holds a whole one
    return placed.withColumn("batch", F.floor((F.col(ROW) - F.col("epoch") * n) / size).cast("long")).drop(ROW, "__h").withColumnRenamed("__old", ROW)


def repeat(df: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    many = df.withColumn("__rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    place = F.col(ROW) * times + F.col("__rep") if interleave else F.col("__rep") * size_of(df) + F.col(ROW)
    return many.withColumn(ROW, place.cast("long")).drop("__rep")


def repeat_each(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` says, numbered by ``rep``; 0 drops it."""
    return df.withColumn("rep", F.explode(F.when(times > 0, F.sequence(F.lit(0), times.cast("int") - 1)).otherwise(F.array().cast("array<int>"))))


def unfold(df: DataFrame, column: str, parts: int) -> DataFrame:
    """An array column cut into ``parts`` rows of equal width, numbered by ``part``; other columns repeat."""
    width = (F.size(column) / parts).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(F.col(column), i * width + 1, width))
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode(pieces).alias("part", column))


def fold(df: DataFrame, groups: int, column: str) -> DataFrame:
    """Rows of each of ``groups`` equal runs as one array in order."""
    size = size_of(df) // groups
    return df.groupBy(F.floor(F.col(ROW) / size).cast("long").alias("group")).agg(F.transform(F.array_sort(F.collect_list(F.struct(ROW, column))), lambda x: x[column]).alias(column))


def pad_to_divisor(df: DataFrame, divisor: int) -> DataFrame:
    """Repeats rows from the start, wrapping around, until the count divides; marks them in ``is_padding``."""
    n = size_of(df)
    short = -n % divisor if n else 0
    marked = df.withColumn("is_padding", F.lit(False))
    if not short:
        return marked
    rounds = math.ceil(short / n)
    extra = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("__at", F.col("__k") * n + F.col(ROW)).filter(F.col("__at") < short)
    return marked.unionByName(extra.withColumn(ROW, F.col("__at") + n).withColumn("is_padding", F.lit(True)).drop("__k", "__at"))


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_padding")).drop("is_padding")


def pad_with_row(df: DataFrame, extra: int, which: str = "last") -> DataFrame:
    """Appends copies of the first or last row."""
    n = size_of(df)
    row = df.filter(F.col(ROW) == (0 if which == "first" else n - 1)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(extra - 1))))
    return df.unionByName(row.withColumn(ROW, (F.col("__k") + n).cast("long")).drop("__k")) if extra else df


def pad_with_no_ops(df: DataFrame, divisor: int, template: dict[str, Column]) -> DataFrame:
    """Appends rows that train nothing until the count divides: ``template`` values, else null, ``is_padding`` true."""
    n = size_of(df)
    short = -n % divisor
    marked = df.withColumn("is_padding", F.lit(False))
    made = df.sparkSession.range(short).select((F.col("id") + n).alias(ROW), *[v.alias(k) for k, v in template.items()], F.lit(True).alias("is_padding"))
    return marked.unionByName(made, allowMissingColumns=True)


def collate(df: DataFrame, key: str, *columns: str, order: str = ROW) -> DataFrame:
    """Columns of the rows of a batch as arrays in order."""
    packed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("__rows"))
    return packed.select(key, *[F.col(f"__rows.{c}").alias(c) for c in columns])


def shape_report(df: DataFrame) -> DataFrame:
    """name, type, nulls and rows of each column."""
    counts = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    kinds = F.create_map(*[x for name, kind in df.dtypes for x in (F.lit(name), F.lit(kind))])
    return counts.unpivot(["__n"], df.columns, "name", "nulls").select("name", kinds[F.col("name")].alias("type"), "nulls", F.col("__n").alias("rows"))


# --- arrays of a row


def ragged(values: Column | str, mask: Column | str) -> Column:
    """Cells whose mask is not 0."""
    v, m = (F.col(x) if isinstance(x, str) else x for x in (values, mask))
    return F.transform(F.filter(F.arrays_zip(v.alias("v"), m.alias("m")), lambda z: z["m"] != 0), lambda z: z["v"])


def padded(values: Column | str, width: Column | int, fill, side: str = "right") -> Column:
    v = F.col(values) if isinstance(values, str) else values
    w = F.lit(width) if isinstance(width, int) else width
    gap = F.array_repeat(F.lit(fill), F.greatest(w - F.size(v), F.lit(0)).cast("int"))
    return F.concat(v, gap) if side == "right" else F.concat(gap, v)


def truncated(values: Column | str, width: int, mode: str = "left") -> Column:
    """At most ``width`` cells: ``left`` keeps the end, ``right`` the start, ``middle`` width // 2 of the start and the
    rest of the end, ``error`` raises."""
    v = F.col(values) if isinstance(values, str) else values
    n, head = F.size(v), width // 2
    cut = {
        "left": F.slice(v, F.greatest(n - width, F.lit(0)) + 1, F.lit(width)), "right": F.slice(v, F.lit(1), F.lit(width)),
        "middle": F.concat(F.slice(v, F.lit(1), F.lit(head)), F.slice(v, F.greatest(n - (width - head), F.lit(0)) + 1, F.lit(width - head))),
    }
    if mode == "error":
        return F.when(n <= width, v).otherwise(F.raise_error(F.lit("the sequence is too long")).cast("array<bigint>"))
    return F.when(n <= width, v).otherwise(cut[mode])


def response_part(values: Column | str, response: Column | str) -> Column:
    """The cells that predict the response: as many as it has, shifted left by one."""
    v, r = (F.col(x) if isinstance(x, str) else x for x in (values, response))
    return F.slice(v, F.size(v) - F.size(r), F.size(r))


def cut_to(values: Column | str, length: Column) -> Column:
    return F.slice(values, F.lit(1), length)


def spread(value: Column, like: Column | str) -> Column:
    return F.transform(like, lambda _x: value)


def eos_mask(ids: Column | str, eos: int) -> Column:
    """1 up to and with the first end token, all 1 without one."""
    at = F.array_position(ids, F.lit(eos).cast("long"))
    return F.transform(ids, lambda _x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def last_position_reward(response: Column | str, reward: Column) -> Column:
    return F.transform(response, lambda _x, i: F.when(i == F.size(response) - 1, reward).otherwise(F.lit(0.0)))


def appended(df: DataFrame, *keys: str, key: str = "key", value: str = "value", order: str = ROW) -> DataFrame:
    """The lists of a multi-map: for each key (of ``keys``, if any) all its values in order."""
    cells = df.groupBy(*keys, key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("c"))
    return cells.select(*keys, key, F.col(f"c.{value}").alias(value))


def from_columns(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A batch out of lists of equal lengths, numbered from 0; a list of another length raises, naming both."""
    sizes = {name: len(values) for name, values in columns.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"columns of different lengths: {sizes}")
    rows = zip(range(next(iter(sizes.values()), 0)), *columns.values(), strict=True)
    return spark.createDataFrame(list(rows), f"{ROW} long, {schema}")


def from_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A batch out of one dictionary a row; a name that a row lacks is null there."""
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([(k, *(row.get(n) for n in names)) for k, row in enumerate(rows)], f"{ROW} long, {schema}")


def feed(df: DataFrame, epochs: int, size: int, drop_last: bool = True) -> DataFrame:
    """Adds ``epoch`` and ``batch``: the rows over and over, in batches counted through all epochs."""
    n = df.agg((F.coalesce(F.max(ROW) + 1, F.lit(0))).alias("__n"))
    per = F.floor(F.col("__n") / size) if drop_last else F.ceil(F.col("__n") / size)
    rows = df.crossJoin(F.broadcast(n)).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("__b", F.floor(F.col(ROW) / size))
    return rows.filter(F.col("__b") < per).withColumn("batch", (F.col("epoch") * per + F.col("__b")).cast("long")).drop("__n", "__b")
