"""Substring dedup: a count-min prefilter over word windows, then exact grouping of the windows estimated repeated.

Documents are dealt into chunks by their id and windows into blocks by their hash; chunks and blocks write each
other packed messages, so no window is a row of its own.

1. Each chunk sketches its windows: two rows of saturating counters in every block, sent as the cells in use. A block
   adds the sketches of all chunks and answers each of them with the cells that reach two. Counts can only be too
   high, so no repeated window is lost.
2. Each chunk sends the windows whose two cells both reach two, once each: hashes and smallest doc_id; whether the
   chunk starts it more than once is settled inside the chunk. A block groups them and answers, for each, whether a
   document of smaller id starts it elsewhere.
3. Each chunk marks the words of the windows that a smaller document starts, and removes them.

Windows are equal if 128 bits are: two sums over the 13 words, modulo 2^64, of the two halves of 128-bit word hashes
and powers of two odd numbers. Two different windows collide in one half with a probability of at most 2^-60 (the
difference of two powers can lose a few low bits), in both with 2^-120; among 10^13 windows that is below 10^-10.

Numbers of chunks and blocks follow the bytes of the table. A message grows with the windows that it speaks of and no
window is in two messages of a chunk, so all messages together grow with the text; a window that occurs everywhere is
one entry per chunk.

Defined results: a null or short text has no window and loses nothing; rows that repeat an id count as one document
and none of them is the smaller; a row without an id neither removes nor loses words; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import mix64, sorted_distinct, text_bytes, trim, word_digests

WINDOW = 13
CHUNK_BYTES = 12 << 20
#: Bytes of text that one block of the sketch answers for, and cells in each of its two rows.
BLOCK_BYTES, CELL_BITS = 24 << 20, 24
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_CELLS = np.uint64((1 << CELL_BITS) - 1)


def rolling(hashes: np.ndarray, base: np.uint64, window: int) -> np.ndarray:
    """Hash of every run of ``window`` words, put together from runs of powers of two."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, run, size, weight = np.zeros(n, np.uint64), 0, hashes, 1, int(base)
    while True:
        if window & size:
            total = total * np.uint64(weight) + run[done : done + n]
            done += size
        if done == window:
            return mix64(total)
        run = run[:-size] * np.uint64(weight) + run[size:]
        size, weight = size * 2, weight * weight & ((1 << 64) - 1)


def pack(numbers: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """The stretches between ``edges`` of unsigned numbers below 2^28, in groups of seven bits, the low ones first."""
    numbers = numbers.astype(np.uint32)
    width = np.ones(len(numbers), np.int64)
    for k in (1, 2, 3):
        width += numbers >> np.uint32(7 * k) > 0
    ends = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(4):
        some = np.flatnonzero(width > k)
        out[ends[some] + k] = (numbers[some] >> np.uint32(7 * k) & np.uint32(127)) | ((width[some] > k + 1) * 128).astype(np.uint32)
    data, cuts = out.tobytes(), ends[edges].tolist()
    return [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def unpack(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all stretches, and where each stretch begins and the last ends."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    value = raw[last].astype(np.int64) << 7 * (last - first)
    for k in range(3):
        more = np.flatnonzero(last - first > k)
        value[more] += (raw[first[more] + k].astype(np.int64) & 127) << 7 * k
    edges = np.searchsorted(last, np.concatenate([[0], np.cumsum([len(d) for d in data])]), "left")
    return value, edges


class Chunk:
    """The windows of a chunk's documents, in order of their ids."""

    def __init__(self, ids: list[int | None], texts: list[str | None], window: int, blocks: int):
        self.ids, self.texts, self.window = ids, texts, window
        counts, digests = np.zeros(len(ids), np.int64), []
        for k, text in enumerate(texts):
            words = text_bytes(text).split()
            counts[k] = len(words)
            digests.append(word_digests(words))
        self.first, self.size = np.cumsum(counts) - counts, int(counts.sum())
        flat = np.concatenate(digests) if digests else np.zeros((0, 2), np.uint64)
        digests.clear()
        named = np.array([i is not None for i in ids], bool)
        counts = np.where(named, np.maximum(counts - window + 1, 0), 0)  # windows of each document
        owner = np.repeat(np.arange(len(ids)), counts)
        self.at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + self.first[owner]
        self.h1 = rolling(np.ascontiguousarray(flat[:, 0]), _A, window)[self.at]
        self.h2 = rolling(np.ascontiguousarray(flat[:, 1]), _B, window)[self.at]
        self.doc = np.array([0 if i is None else i for i in ids], np.int64)[owner]
        self.blocks = np.uint64(blocks)

    def block_of(self, h1: np.ndarray) -> np.ndarray:
        return (h1 >> np.uint64(32)) * self.blocks >> np.uint64(32)

    def cells(self) -> Iterator[np.ndarray]:
        """Block and cell of every window, as one number, for each row of the sketch."""
        block = self.block_of(self.h1) << np.uint64(CELL_BITS)
        yield block | self.h1 & _CELLS
        yield block | self.h2 & _CELLS


def _edges(sorted_cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks that sorted cells are in, and where each begins and the last ends."""
    return _runs(sorted_cells >> np.uint64(CELL_BITS))


def _runs(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of an ascending list, and where each begins and the last ends."""
    first = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])[: len(blocks)])
    return blocks[first].astype(np.int64), np.append(first, len(blocks))


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _chunk_of(table: pa.Table, window: int, blocks: int) -> Chunk:
    trim()
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k] or ""))
    return Chunk([ids[k] for k in order], [texts[k] for k in order], window, blocks)


def _sketch(chunk: Chunk) -> list[tuple[int, bytes, bytes]]:
    """For each block and row the steps from cell to cell, and in the lowest bit whether the chunk has the cell twice."""
    rows = []
    for cells in chunk.cells():
        cells.sort()
        first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])[: len(cells)])
        more = np.diff(first, append=len(cells)) > 1
        cells = cells[first]
        blocks, edges = _edges(cells)
        cells &= _CELLS
        steps = np.diff(cells.astype(np.int64), prepend=0)
        steps[edges[:-1]] = cells[edges[:-1]]
        rows.append(pack(steps * 2 + more, edges))
    return list(zip(blocks.tolist(), *rows, strict=True)) if chunk.size else []


def _suspects(chunk: Chunk, answers: dict[int, tuple[bytes, bytes]]) -> np.ndarray:
    """Positions of the windows whose cells both reach two; ``answers`` has a bit for each cell that was sent."""
    left = np.arange(len(chunk.h1))
    for k, cells in enumerate(chunk.cells()):
        own = sorted_distinct(cells)
        blocks, edges = _edges(own)
        reached = np.concatenate([np.zeros(0, bool), *(_bits(answers[b][k], n) for b, n in zip(blocks.tolist(), np.diff(edges).tolist(), strict=True))])
        own, cells = own[reached], cells[left]
        if not len(own):
            return left[:0]
        marks = np.zeros(1 << CELL_BITS, bool)  # most of the others end here; a table is far quicker than a search
        marks[_slot(own)] = True
        some = np.flatnonzero(marks[_slot(cells)])
        some = some[np.argsort(cells[some])]  # sorted needles are searched for in order
        asked = cells[some]
        left = left[np.sort(some[own[np.minimum(np.searchsorted(own, asked), len(own) - 1)] == asked])]
    return left


def _slot(cells: np.ndarray) -> np.ndarray:
    return (cells * _A >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class Questions:
    """The distinct windows among the suspects, in order of their hashes, and the smallest document of each here."""

    def __init__(self, chunk: Chunk, suspects: np.ndarray):
        h1, h2 = chunk.h1[suspects], chunk.h2[suspects]
        order = np.argsort(h1)
        if (np.diff(h1[order]) + (np.diff(h2[order]) == 0) == 0).any():  # equal in one half only
            order = np.lexsort((h2, h1))
        self.where, h1, h2 = suspects[order], h1[order], h2[order]
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))[: len(h1)]
        first = np.flatnonzero(new)
        self.h1, self.h2, self.group = h1[first], h2[first], np.cumsum(new) - 1
        self.low = np.minimum.reduceat(chunk.doc[self.where], first) if len(first) else chunk.doc[:0]
        self.blocks, self.edges = (x.tolist() for x in _runs(chunk.block_of(self.h1)))

    def parts(self) -> Iterator[tuple[int, slice]]:
        for block, i, j in zip(self.blocks, self.edges, self.edges[1:], strict=False):
            yield block, slice(i, j)


def _removed(chunk: Chunk, answers: dict[int, tuple[bytes, bytes]], verdicts: dict[int, bytes]) -> list[tuple]:
    asked = Questions(chunk, _suspects(chunk, answers))
    elsewhere = np.zeros(len(asked.low), bool)
    for block, part in asked.parts():
        elsewhere[part] = _bits(verdicts[block], part.stop - part.start)
    hit = chunk.at[asked.where[elsewhere[asked.group] | (chunk.doc[asked.where] > asked.low[asked.group])]]
    depth = np.bincount(hit, minlength=chunk.size + 1) - np.bincount(hit + chunk.window, minlength=chunk.size + 1)
    gone = np.cumsum(depth)[:-1] > 0
    out = []
    for doc_id, text, first in zip(chunk.ids, chunk.texts, chunk.first, strict=True):
        words = text_bytes(text).split()
        own = gone[first : first + len(words)]
        kept = [w for w, g in zip(words, own.tolist(), strict=True) if not g] if own.any() else words
        out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept)))
    return out


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema, strict=True)], schema=schema)


_SKETCH = pa.schema([("chunk", pa.int64()), ("block", pa.int64()), ("cells0", pa.binary()), ("cells1", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("block", pa.int64()), ("bits0", pa.binary()), ("bits1", pa.binary())])
_QUESTION = pa.schema([("chunk", pa.int64()), ("block", pa.int64()), ("h1", pa.binary()), ("h2", pa.binary()), ("low", pa.binary())])
_VERDICT = pa.schema([("chunk", pa.int64()), ("block", pa.int64()), ("bits", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _merge_sketches(table: pa.Table) -> pa.Table:
    bits = []
    for name in ("cells0", "cells1"):
        steps, edges = unpack(table.column(name).to_pylist())
        more, steps = (steps & 1).astype(np.uint8), steps >> 1
        count = np.zeros(1 << CELL_BITS, np.uint8)
        cells = [np.cumsum(steps[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
        for own, i, j in zip(cells, edges, edges[1:], strict=False):
            count[own] = np.minimum(count[own] + 1 + more[i:j], 2)
        bits.append(pa.array([np.packbits(count[own] > 1).tobytes() for own in cells], pa.binary()))
    return pa.Table.from_arrays([table.column("chunk"), table.column("block"), *bits], schema=_ANSWER)


def _merge_questions(table: pa.Table) -> pa.Table:
    lists = [[np.frombuffer(x, kind) for x in table.column(n).to_pylist()] for n, kind in (("h1", np.uint64), ("h2", np.uint64), ("low", np.int64))]
    h1, h2, low = (np.concatenate(x) for x in lists)
    order = np.lexsort((low, h2, h1))
    a, b = h1[order], h2[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    smallest = low[order][new][np.cumsum(new) - 1]
    verdict = np.empty(len(order), bool)
    verdict[order] = smallest < low[order]
    ends = np.cumsum([len(x) for x in lists[0]])[:-1]
    bits = pa.array([np.packbits(v).tobytes() for v in np.split(verdict, ends)], pa.binary())
    return pa.Table.from_arrays([table.column("chunk"), table.column("block"), bits], schema=_VERDICT)


def remove_repeats(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (``kept``, joined by one space) of every row."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, blocks = (max(1, -(-total // size)) for size in (CHUNK_BYTES, BLOCK_BYTES))
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn(
        "chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(chunks))
    )
    placed = dealt.repartition(chunks, "chunk")

    def sketch(table: pa.Table) -> pa.Table:
        number = table.column("chunk")[0].as_py()
        return _table([(number, *r) for r in _sketch(_chunk_of(table, window, blocks))], _SKETCH)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], _QUESTION)
        chunk, number = _chunk_of(left, window, blocks), left.column("chunk")[0].as_py()
        answers = {r["block"]: (r["bits0"], r["bits1"]) for r in right.to_pylist()}
        asked = Questions(chunk, _suspects(chunk, answers))
        rows = [(number, b, asked.h1[w].tobytes(), asked.h2[w].tobytes(), asked.low[w].tobytes()) for b, w in asked.parts()]
        return _table(rows, _QUESTION)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _RESULT)
        rows = right.to_pylist()
        answers = {r["block"]: (r["bits0"], r["bits1"]) for r in rows if r["bits0"] is not None}
        verdicts = {r["block"]: r["bits"] for r in rows if r["bits"] is not None}
        return _table(_removed(_chunk_of(left, window, blocks), answers, verdicts), _RESULT)

    answers = placed.groupBy("chunk").applyInArrow(sketch, _ddl(_SKETCH)).groupBy("block").applyInArrow(_merge_sketches, _ddl(_ANSWER)).repartition(chunks, "chunk")
    questions = placed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask, _ddl(_QUESTION))
    verdicts = questions.groupBy("block").applyInArrow(_merge_questions, _ddl(_VERDICT))
    replies = answers.unionByName(verdicts, allowMissingColumns=True).repartition(chunks, "chunk")
    return placed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, _ddl(_RESULT))


#: DuckDB: every window as a text, and the smallest document that starts it.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'), []) AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS f FROM g GROUP BY g),
x AS (SELECT DISTINCT r, i + k AS i FROM g JOIN f USING (g), (SELECT unnest(range(13)) AS k) WHERE f < doc_id),
w AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN x USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
