"""Exact quantiles whose cost does not depend on how many distinct values a group has.

A percentile aggregate holds all distinct values of a group in one task. Here values are counted, the counts are summed
along ranges of (keys, value) in two levels, and the values at the wanted ranks are picked from the running sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import checkpointed


def quantiles(df: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """keys and a column for each of ``shares``, by linear interpolation between neighbours; null values do not count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    ranged = checkpointed(counts.repartitionByRange(*keys, "__v").withColumn("__p", F.spark_partition_id()))
    parts = ranged.groupBy("__p").agg(F.sum("__c").alias("__s"))
    base = parts.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__base"))  # one row a partition
    along = Window.partitionBy("__p").orderBy(*keys, "__v")
    summed = ranged.join(F.broadcast(base), "__p").withColumn("__end", F.col("__base") + F.sum("__c").over(along)).select(*keys, "__v", "__end", (F.col("__end") - F.col("__c")).alias("__start"))
    # A group's ranks begin where the sums of the groups before it end.
    spans = summed.groupBy(*keys).agg(F.min("__start").alias("__lo"), F.max("__end").alias("__hi"))
    rows = summed.join(spans, list(keys)) if keys else summed.crossJoin(F.broadcast(spans))
    picked, made = [], []
    for k, (name, share) in enumerate(shares.items()):
        at = (F.col("__hi") - F.col("__lo") - 1) * F.lit(float(share))
        for side, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            rank = rank + F.col("__lo")
            picked.append(F.max(F.when((F.col("__start") <= rank) & (rank < F.col("__end")), F.col("__v"))).alias(f"__{side}{k}"))
        picked.append(F.max(at - F.floor(at)).alias(f"__f{k}"))
        made.append((F.col(f"__a{k}") + (F.col(f"__b{k}") - F.col(f"__a{k}")) * F.col(f"__f{k}")).alias(name))
    return rows.groupBy(*keys).agg(*picked).select(*keys, *made)
