"""Mixing sources to target weights by systematic sampling. DataFrame operations only.

Within a source the expected copies of its documents are prefix-summed in an order by size, one random offset
is added, and a document is emitted once for each integer boundary that its step crosses.

The order is (size class, hash cell, size, id). Ranks are found in two levels, so that no source is ever one
task: counts of the cells are prefix-summed in a table that has at most ``SIZE_CLASSES * HASH_CELLS`` rows per
source however many documents it holds, and rows are ranked inside their cell only. Going through the sizes in
order makes the words taken miss the target by about one document at most.

Defined results: a null text has size 0; a null source is a source of its own, last in order; an empty table
gives an empty result; repeated rows are sampled one by one; ties of size and id are broken by a hash of all columns, so that
only rows equal in all of them may change places; rows without an id are placed by that hash; further columns are kept as they are, and
columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import WORD_PATTERN, checkpointed

SIZE_CLASSES, HASH_CELLS = 1024, 256
#: The weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3

_KEY, _CLASS, _CELL = "__source_key", "__size_class", "__hash_cell"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Adds ``target`` and ``rate`` to a table of one row per source (``source``, ``source_size``).

    Weighted shares of the sum of all sizes, none above ``most`` times its source: sources are taken by how soon
    they reach that, and the rest shares what is left. Sums stay whole numbers, so targets do not depend on order.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), "source")
    ranked = (
        sources.withColumn("__i", F.row_number().over(order) - 1)
        .withColumn("__w", weight.cast("long"))
        .withColumn("__cap", F.col("source_size") * most)
        .withColumn("__all", F.sum("source_size").over(everything))
        .withColumn("__before", F.coalesce(F.sum("__cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__rest_w", F.sum("__w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__share", (F.col("__all") - F.col("__before")).cast("double") / F.col("__rest_w"))
        .withColumn("__open", F.col("__share") * F.col("__w") <= F.col("__cap"))
        .withColumn("__first", F.min(F.when(F.col("__open"), F.struct("__before", "__rest_w"))).over(everything))
    )
    left = (F.col("__all") - F.col("__first.__before")).cast("double")
    free = F.col("__first").isNotNull() & (F.col("__before") >= F.col("__first.__before")) & (F.col("__rest_w") <= F.col("__first.__rest_w"))
    target = F.when(free, left * F.col("__w") / F.col("__first.__rest_w")).otherwise(F.col("__cap").cast("double"))
    return ranked.withColumn("target", target).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ).drop("__i", "__w", "__cap", "__all", "__before", "__rest_w", "__share", "__open", "__first")


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, seed: int = 7,
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES,
) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``; ``size`` counts the words of ``text`` by default."""
    made = ("size", "source_size", "target", "copies", "taken")
    size = word_count(F.col("text")) if size is None else size
    keep = [c for c in docs.columns if c not in made]
    keyed = docs.withColumn("__tie", F.xxhash64(*keep)).withColumns({
        "__size": size,
        _KEY: F.coalesce(F.concat(F.lit("+"), F.col(source_col)), F.lit("-")),
        _CELL: F.coalesce(_hex(F.concat(F.col(id_col).cast("string"), F.lit(f"/{seed}")), 2) % HASH_CELLS, F.pmod(F.col("__tie"), F.lit(HASH_CELLS))),
    }).withColumn(_CLASS, F.least(F.floor(F.sqrt(F.col("__size").cast("double"))), F.lit(SIZE_CLASSES - 1)))

    # Read twice below: written once, so that the texts are counted once for it.
    cells = checkpointed(keyed.groupBy(_KEY, _CLASS, _CELL).agg(F.count("*").alias("__n"), F.sum("__size").alias("__sum")))
    source = F.when(F.col(_KEY) != "-", F.substring(_KEY, 2, 1 << 30))
    sources = cells.groupBy(_KEY).agg(F.sum("__sum").alias("source_size"), F.sum("__n").alias("__docs")).withColumn("source", source)
    targets = source_targets(sources, weights, most).select(_KEY, "source_size", "target", "rate", "__docs")
    before = Window.partitionBy(_KEY).orderBy(_CLASS, _CELL).rowsBetween(Window.unboundedPreceding, -1)
    offset = _hex(F.concat(F.col(_KEY), F.lit(f"/{seed}")), 8) / F.lit(float(1 << 32))
    places = (
        cells.withColumn("__rank0", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .join(targets, _KEY)
        .withColumn("__u", offset)
        .select(_KEY, _CLASS, _CELL, "__rank0", "__u", "rate", "__docs", "source_size", "target")
        .withColumnsRenamed({"rate": "__rate", "source_size": "__source_size", "target": "__target"})
    )
    inside = Window.partitionBy(_KEY, _CLASS, _CELL).orderBy("__size", id_col, "__tie")
    rank = F.col("__rank0") + F.col("__rank")
    crossed = F.floor(F.col("__u") + rank * F.col("__rate")) - F.floor(F.col("__u") + (rank - 1) * F.col("__rate"))
    return (
        keyed.withColumn("__rank", F.row_number().over(inside))
        .join(places, [_KEY, _CLASS, _CELL])
        .withColumn("copies", F.least(crossed, F.lit(most)).cast("long"))
        .select(
            *keep, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
            "copies", (F.col("copies") * F.col("__size")).alias("taken"),
        )
    )


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1 in ``copy`` (which replaces a column of that name); documents without a copy go."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


#: DuckDB: the same mix with plain windows over each source.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce('+' || source, '-') AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) AS BIGINT) AS size
  FROM documents
), c AS (
  SELECT *, least(CAST(floor(sqrt(CAST(size AS DOUBLE))) AS BIGINT), {SIZE_CLASSES - 1}) AS cls,
         coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '/7'), 1, 2) AS BIGINT) % {HASH_CELLS}, 0) AS cell
  FROM d
), s AS (
  SELECT k, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT) AS w, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s
), f AS (
  SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bef,
         CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rw FROM w
), g AS (SELECT bef, rw FROM f WHERE CAST(total - bef AS DOUBLE) / rw * w <= cap ORDER BY bef, rw LIMIT 1
), t AS (
  SELECT f.k, f.source_size,
         CASE WHEN g.bef IS NOT NULL AND f.bef >= g.bef AND f.rw <= g.rw THEN CAST(total - g.bef AS DOUBLE) * w / g.rw ELSE CAST(cap AS DOUBLE) END AS target,
         CAST('0x' || substr(md5(f.k || '/7'), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM f LEFT JOIN g ON true
), r AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, CAST(t.u AS DOUBLE) AS u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY c.k ORDER BY cls, cell, c.size, c.doc_id) AS rank
  FROM c JOIN t ON c.k = t.k
)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(u + rank * rate) - floor(u + (rank - 1) * rate), 3) AS BIGINT) AS copies,
       CAST(least(floor(u + rank * rate) - floor(u + (rank - 1) * rate), 3) * size AS BIGINT) AS taken
FROM r
"""
