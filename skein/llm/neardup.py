"""MinHash near-duplicates by an inverted join over signature coordinates.

A text's set is its distinct word shingles. Rows with equal sets form a class that is represented once. A class has
a signature of ``COORDINATES`` minima, and is posted under each (coordinate, value) pair. Two sets of similarity 0.8
share at least ``MATCHES`` of 64 pairs but with a probability of 2e-5, and of 1e-7 at 0.85. Pairs that occur once post
nothing, so a class with fewer than ``MATCHES`` others is done. Two classes must already meet in all but
``MATCHES - 1`` of their pairs, the rarest: only this prefix is merged, and the skipped pairs are looked up in the
signatures of those that met, which completes the count of collisions.

Posting lists are not expanded into all pairs.

1. The class of a list whose values are the most common ones is its hub, and each member is paired with the hubs of
   its lists: a few pairs a member. Pairs that collide often enough are compared on full sets and linked, and
   components are found.
2. A class that may still be linked shares ``MATCHES`` of its pairs, and the wanted percentage of its shingles, with
   classes of other components. Both are counted over lists, without looking at pairs of classes. All others are done.
3. What is left is listed again. Members of a hub are dealt into blocks of bounded size, and the blocks of all but the
   largest component are compared with each other and with those of the largest: collisions first, then full sets,
   across components only. Nothing but the links is emitted, so no link is given up for the size of a list.

Components come from repeated minimum exchange with pointer jumping over tables in the shared folder. Rows of a hot
key (a hub, a value, a text with many copies) are dealt to as many tasks as they ask for.

Defined results: a text without words has an empty set, is linked with nothing and kept; a row is judged by its own
text, so repeated rows get equal results; rows without an id are linked with nothing; classes whose smallest doc_id
is the same count as one; texts of any length are read whole; an empty table gives an empty result; other columns are
not read by ``near_duplicates`` and kept by ``first_of_groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from skein.llm.common import by_size, checkpointed, mix64, release, shingles, small_batches, sorted_distinct, text_bytes, trim, word_hashes

COORDINATES, MATCHES = 64, 38
SIMILARITY_PERCENT = 80
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 500_000
#: Keys with more rows are hot; rows are at most a thousandth of all or this many, so hot keys are a thousand at most.
HOT_ROWS, HOT_KEYS = 20_000, 1000
#: Ids of documents that are sent to all tasks; more of them are joined by a shuffle.
BROADCAST_IDS = 100_000
_SLICE_CHARS = 1_000_000

_RANDOM = np.random.default_rng(101)
_MULTIPLY = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return sorted_distinct(shingles(word_hashes(text_bytes(text).lower().split()), size))


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of seeded linear permutations of the 64-bit shingle hashes; one row for each set, none empty.

    A minimum is mixed with its coordinate, so a value stands for the pair; 64 bits keep values of unrelated texts
    apart in large tables too.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), COORDINATES), np.uint64)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(flat * _MULTIPLY[k] + _ADD[k], starts)
    return mix64(out + np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, key and values of every row.

    Key and values are null for an empty set and for a row without an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 1, _SLICE_CHARS):
                sets = [shingle_set(t.as_py(), size) for t in part.column(1)]
                used = np.array([len(s) > 0 for s in sets]) & np.asarray(part.column(0).is_valid())
                kept = [s for s, u in zip(sets, used, strict=True) if u]
                values = signatures(kept).astype(np.int64).ravel() if kept else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(used * COORDINATES)]).astype(np.int32)
                keys = [set_key(s) if u else None for s, u in zip(sets, used, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(ends, values)],
                    ["doc_id", "n_shingles", "key", "values"],
                )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, n_shingles long, key binary, values array<long>")


def _sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, the other columns of ``nodes`` and the set of those documents, from one further pass over the texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string"))
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes.hint("shuffle_hash")
    rows = texts.join(wanted, "node")
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, batch.schema.get_field_index("text"), _SLICE_CHARS):
                sets = [shingle_set(t.as_py(), size) for t in part.column("text")]
                ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(sets).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), lists], [*kept, "set"])

    schema = StructType([rows.schema[c] for c in kept]).add("set", ArrayType(LongType()))
    with small_batches(docs.sparkSession):
        return checkpointed(rows.mapInArrow(run, schema))


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``edges`` (a, b); ``known`` is an earlier result.

    Each round a node takes the smallest label of its neighbours and then the label of its label. Labels only fall,
    so the rounds end when none does.
    """
    if known is not None:
        left = edges.join(known.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left")
        both = left.join(known.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
        edges = both.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b")
    ways = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpointed(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    sizes = ways.groupBy("b").agg(F.count("*").alias("n"))
    while True:
        met = spread_join(ways, labels.withColumnRenamed("node", "b"), "b", "a", sizes)
        near = met.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        roots = labels.select(F.col("node").alias("mid"), F.col("component").alias("root"))
        moved = checkpointed(step.join(roots, "mid", "left").select("node", "old", F.least(F.coalesce("root", "mid"), "mid").alias("component")))
        labels = moved.select("node", "component")
        if moved.filter("old <> component").isEmpty():
            break
    if known is not None:
        names = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        old = known.join(names, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        new = labels.join(known.select("node"), "node", "left_anti")
        labels = checkpointed(old.union(new))
    return labels


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two blocks of sets, from products of 0/1 tables over the shingles they share."""
    ls, rs = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(ls, rs)
    out = np.zeros((len(left), len(right)), np.float32)
    lo, ro = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    for start in range(0, len(shared), 4096):
        part = shared[start : start + 4096]
        tables = []
        for flat, owner, n in ((ls, lo, len(left)), (rs, ro, len(right))):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            table = np.zeros((n, len(part)), np.float32)
            table[owner[hit], at[hit]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _across_components(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (hub, blocks, main, node, c, values, set) of a hub of different components c.

    Members of the component ``main`` are never compared with each other. A group is one pair of blocks of a hub, and a
    hub has as many blocks as its members and their shingles ask for, so the size of a group is bounded.
    """
    number = F.pmod(F.xxhash64("node"), F.col("blocks"))
    small = F.when(F.col("c") == F.col("main"), F.lit(-1) - number).otherwise(number)  # blocks of the main component are negative
    placed = members.withColumn("own", small.cast("int")).withColumn("block", F.col("blocks").cast("int"))
    each = F.sequence(F.lit(0), F.col("block") - 1)
    others = F.when(F.col("own") < 0, each).otherwise(F.concat(each, F.transform(each, lambda x: -1 - x)))
    dealt = placed.withColumn("other", F.explode(others)).select(
        "hub", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "c", "values", "set"
    )

    def run(table: pa.Table) -> pa.Table:
        trim()
        own, node, c = (table.column(x).to_numpy() for x in ("own", "node", "c"))
        low, high = int(table.column("low")[0].as_py()), int(table.column("high")[0].as_py())
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        links: dict[tuple[int, int], tuple[int, int]] = {}
        if len(left) and len(right) and c.min() != c.max():
            values, sets = ([x.values.to_numpy() for x in table.column(name).combine_chunks()] for name in ("values", "set"))
            apart = c[left][:, None] != c[right][None]
            rows, columns = np.nonzero(apart & (overlaps([values[i] for i in left], [values[i] for i in right]) >= MATCHES))
            if len(rows):
                some, others = np.unique(rows), np.unique(columns)
                both = overlaps([sets[i] for i in left[some]], [sets[i] for i in right[others]])
                both = both[np.searchsorted(some, rows), np.searchsorted(others, columns)]
                sizes = np.array([len(s) for s in sets])
                near = both * 100 >= (sizes[left[rows]] + sizes[right[columns]] - both) * percent
                for i, j in zip(left[rows[near]], right[columns[near]], strict=True):
                    links[min(c[i], c[j]), max(c[i], c[j])] = (int(node[i]), int(node[j]))  # one between two components is enough
        found = list(links.values())
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return dealt.groupBy("hub", "low", "high").applyInArrow(run, "a long, b long").distinct()


def spread_join(many: DataFrame, few: DataFrame, key: str, by: str, sizes: DataFrame, how: str = "inner") -> DataFrame:
    """Join of rows with a table of one row per key. ``sizes`` (key, n) counts the rows of keys, of hot ones at least.

    The rows of a hot key are dealt by ``by`` to as many tasks as it has ``HOT_ROWS``, or a thousandth of all rows.
    """
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= limit:
        return many.join(few, key, how)
    parts = F.broadcast(sizes.filter(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("__parts")))  # HOT_KEYS rows at most
    left = many.join(parts, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")).cast("int"), F.lit(0)))
    salts = F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1)
    right = few.join(parts, key, "left").withColumn("__salt", F.explode(salts)).drop("__parts")
    return left.drop("__parts").join(right, [key, "__salt"], how).drop("__salt")


def _listed(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """node, weight and values, the rarest first, of the nodes of rows (node, value) with at least ``MATCHES`` listed ones."""
    found = spread_join(rows, counts, "value", "node", counts)
    lists = found.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("list")).filter(F.size("list") >= MATCHES)
    weight = F.aggregate("list", F.lit(0.0), lambda total, x: total + F.log2(x.n))
    return lists.select("node", F.round(weight, 3).alias("weight"), F.col("list.value").alias("values"))


def _met(lists: DataFrame) -> DataFrame:
    """hub, node: the members of the lists of each hub, itself not among them."""
    prefix = F.slice("values", 1, F.size("values") - F.lit(MATCHES - 1))
    posts = lists.select("node", "weight", F.explode(prefix).alias("value"))
    top = F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top")
    hubs = checkpointed(posts.groupBy("value").agg(top, F.count("*").alias("n")).filter("n > 1").select("value", (-F.col("top.minus")).alias("hub"), "n"))
    joined = spread_join(posts.select("node", "value"), hubs.select("value", "hub"), "value", "node", hubs)
    return checkpointed(joined.filter("hub <> node").groupBy("hub", "node").agg(F.count("*").alias("collisions")))


def _with_partner(pairs: DataFrame, own: DataFrame, its: DataFrame, column: str, sizes: DataFrame) -> DataFrame:
    """Adds ``column`` of both ends (as ``own`` and ``its``) to pairs (hub, node)."""
    left = pairs.join(own.select("node", F.col(column).alias("own")), "node")
    return spread_join(left, its.select(F.col("node").alias("hub"), F.col(column).alias("its")), "hub", "node", sizes)


def _in_two_components(rows: DataFrame, key: str) -> DataFrame:
    """Keys of rows (key, c) that two components or more hold, and how many rows they have."""
    ends = rows.groupBy(key).agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"))
    return checkpointed(ends.filter("low <> high").select(key, "n"))


def _left_open(sets: DataFrame, lists: DataFrame, found: DataFrame, percent: int) -> DataFrame | None:
    """node, c, weight, values, set of the nodes that may be linked with another component; none where there is none."""
    placed = lists.join(found, "node", "left").select("node", "values", F.coalesce("component", "node").alias("c"))
    rows = placed.select("node", "c", F.explode("values").alias("value"))
    open_lists = checkpointed(_listed(rows.select("node", "value"), _in_two_components(rows, "value")))
    if open_lists.isEmpty():
        return None
    known = open_lists.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    named = checkpointed(sets.select("node", "set").join(known, "node"))  # read three times below
    shingle_rows = named.select("node", "c", F.explode("set").alias("shingle"))
    shared = _in_two_components(shingle_rows, "shingle")
    held = spread_join(shingle_rows.select("node", "shingle"), shared.select("shingle"), "shingle", "node", shared).groupBy("node").count()
    able = named.select("node", F.size("set").alias("n_set")).join(held, "node").filter(F.col("count") * 100 >= F.col("n_set") * percent)
    return checkpointed(named.join(able.select("node").distinct(), "node", "left_semi"))


def near_duplicates(docs: DataFrame, *, size: int = 4, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    with small_batches(docs.sparkSession):
        signed = checkpointed(_signed(docs, size))
    copies = F.count("*").alias("n")
    classes = checkpointed(signed.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("node"), F.first("values").alias("values"), copies))

    posted = classes.select("node", F.explode("values").alias("value"))
    counts = checkpointed(posted.groupBy("value").agg(copies).filter("n > 1"))
    lists = checkpointed(_listed(posted, counts))
    del posted, counts
    release(docs.sparkSession)
    met = _met(lists)
    sizes = met.groupBy("hub").agg(copies)
    collided = F.size(F.array_intersect("own", "its")) >= MATCHES
    close = checkpointed(_with_partner(met.select("hub", "node"), lists, lists, "values", sizes).filter(collided).select("hub", "node"))
    roles = lists.select("node").join(close.select("node", F.lit(True).alias("is_close")).distinct(), "node", "left")
    roles = roles.join(close.select(F.col("hub").alias("node"), F.lit(True).alias("is_hub")).distinct(), "node", "left")
    sets = _sets_of(docs, checkpointed(roles), size)
    pairs = _with_partner(close, sets.filter("is_close"), sets.filter("is_hub"), "set", close.groupBy("hub").agg(copies))
    sized = pairs.withColumn("both", F.size(F.array_intersect("own", "its")))
    union = F.size("own") + F.size("its") - F.col("both")
    links = checkpointed(sized.filter(F.col("both") * 100 >= union * percent).select(F.col("node").alias("a"), F.col("hub").alias("b")))
    del met, sizes, close, roles, pairs, sized
    release(docs.sparkSession)
    found = components(links)
    rest = _left_open(sets, lists, found, percent)
    del sets, lists
    release(docs.sparkSession)
    if rest is not None:
        groups = _met(rest)
        everyone = groups.select("hub", "node").union(groups.select("hub", F.col("hub").alias("node"))).distinct()
        owners = rest.select("node", "c", F.size("set").alias("s"))
        by_part = everyone.join(owners, "node").groupBy("hub", "c").agg(copies, F.sum("s").alias("s"))
        by_hub = by_part.groupBy("hub").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "c")).getField("c").alias("main"), F.min("c").alias("low"), F.max("c").alias("high"))
        blocks = F.ceil(F.greatest(F.col("n") / BLOCK_MEMBERS, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks")
        open_hubs = checkpointed(by_hub.filter("low <> high").select("hub", "main", blocks, "n"))
        members = spread_join(everyone, open_hubs.select("hub", "main", "blocks"), "hub", "node", open_hubs)
        found = components(_across_components(members.join(rest.drop("weight"), "node"), percent), found)

    named = classes.join(found, "node", "left").select("key", "n", F.coalesce("component", "node").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "key")
    placed = spread_join(rows.filter("key IS NOT NULL"), named.select("key", "component"), "key", "doc_id", classes.select("key", "n"))
    everything = placed.select("doc_id", "n_shingles", "component").union(rows.filter("key IS NULL").select("doc_id", "n_shingles", "doc_id"))
    return everything.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def first_of_groups(docs: DataFrame, *, size: int = 5, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """``docs`` with one document of each group, the one of smallest id.

    Rows that share an id stay or go together, and those that are equal in every column become one; rows without an id
    stay.
    """
    judged = near_duplicates(docs.select("doc_id", "text"), size=size, percent=percent)
    kept = judged.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    first = docs.join(kept, "doc_id", "left_semi").dropDuplicates()
    return first.unionByName(docs.filter("doc_id IS NULL"))


#: DuckDB: all pairs of texts that share a shingle, and all that can be reached over the similar ones.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+'), []) AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
c AS (SELECT s, min(doc_id) AS node FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT node, len(s) AS n, unnest(s) AS x FROM c),
p AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.node < b.node GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)), t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
m AS (SELECT node AS a, node AS b FROM c UNION SELECT m.a, t.b FROM m JOIN t ON m.b = t.a),
q AS (SELECT a AS node, min(b) AS component_id FROM m GROUP BY a)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id = doc_id, true) AS kept FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN q USING (node)
"""
