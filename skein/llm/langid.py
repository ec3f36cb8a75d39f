"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of lower-cased characters, everything but letters being a blank; a feature is its
share of the text times its inverse document frequency. The weights are learned by follow-the-regularised-leader
with an elastic net (``L1``, ``L2``), per-coordinate rates and most weights exactly zero; one temperature is
then fitted on training rows that were held back. A text's logits are a mean over its positions, so scoring reads
whole texts in one pass.

Document frequencies are counted over all rows that have a language and may be learned from. The fit reads whole texts of
at most ``LANG_ROWS`` of them for each language, the first by a hash of id and text, so that rare languages are learned
from all of their rows. Every fifth row of a language is held back for the temperature, which is 1 where none is.

Defined results: no letter or no text gives ``und`` with score 0; without labelled rows every text is ``und``; rows that
repeat id and text are learned from once and scored one by one; of equal scores the first language by code point wins;
texts of any length are read whole; rows without an id are scored, not held out and not learned from; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import by_size, crc_remainder

LANG_ROWS = 750
BUCKETS = 1 << 16
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.5, 1.0, 0.02, 0.05, 3, 10
UNKNOWN = "und"
_ORDERS = (1, 2, 3)
_SLICE_CHARS = 1_000_000
_COUNT_BLOCKS, _COUNT_TASKS = 16, 64


def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


_LETTERS = _letter_table()


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points; all but letters are blanks."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points < 0x10000
    letters = _LETTERS[np.where(low, points, 32)]
    if not low.all():
        letters |= ~low & np.isin(points, [c for c in np.unique(points[~low]) if chr(c).isalpha()])
    return np.where(letters, points, np.uint32(32))


def gram_buckets(points: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each position; ``points`` ends with two blanks."""
    n, h, out = len(points) - 2, np.zeros(len(points) - 2, np.uint32), []
    for k, order in enumerate(_ORDERS):
        h = (h ^ points[k : n + k]) * np.uint32(0x01000193) + np.uint32(0x9E3779B9)
        out.append(((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64) + (order - 1) * BUCKETS)
    return out


_BLANKS = np.full(2, 32, np.uint32)


def sparse_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    points = code_points(text)
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    found, count = np.unique(np.concatenate(gram_buckets(np.concatenate([points, _BLANKS]))), return_counts=True)
    return found.astype(np.int32), (count / len(points)).astype(np.float32)


class Ftrl:
    """Multinomial logistic regression, one proximal step per example."""

    def __init__(self, classes: int, width: int):
        self.z, self.n = np.zeros((width, classes)), np.zeros((width, classes))

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p[None]
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[rows] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by bisection on a grid of its logarithm."""
    low, high = -4.0, 4.0
    for _ in range(6):
        grid = np.linspace(low, high, 9)
        loss = [-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
        best, width = grid[int(np.argmin(loss))], (high - low) / 8
        low, high = best - width, best + width
    return float(np.exp((low + high) / 2))


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> dict:
    """rows: (lang, buckets, shares), in an order that does not depend on the language."""
    langs = sorted({lang for lang, _, _ in rows})
    model, number = Ftrl(len(langs), len(idf)), {lang: k for k, lang in enumerate(langs)}
    kept, held, seen = [], [], dict.fromkeys(langs, 0)
    for row in rows:
        seen[row[0]] += 1
        (kept if seen[row[0]] % 5 else held).append(row)
    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in order.permutation(len(kept)):
            lang, found, share = kept[k]
            model.learn(found, share * idf[found] * SCALE, number[lang])
    table = model.weights() * (idf * SCALE)[:, None]
    temperature = 1.0
    if held and len(langs) > 1:
        temperature = fit_temperature(np.array([share @ table[found] for _, found, share in held]), np.array([number[lang] for lang, _, _ in held]))
    return {"langs": langs, "table": (table / temperature).astype(np.float32)}


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each bucket occurs, and how many texts there are.

    A task sends its counts in blocks; blocks are added in two steps, so that no task adds those of all others.
    """
    width = BUCKETS * len(_ORDERS)
    edges = np.linspace(0, width, _COUNT_BLOCKS + 1).astype(int)
    schema = "part int, block int, texts long, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, marks, texts, part = np.zeros(width, np.int64), np.zeros(width, bool), 0, TaskContext.get().partitionId() % _COUNT_TASKS
        for batch in batches:
            for text in batch.column(0):
                points = code_points(text.as_py())
                if len(points):
                    for found in gram_buckets(np.concatenate([points, _BLANKS])):
                        marks[found] = True
                    own = np.flatnonzero(marks)
                    total[own] += 1
                    marks[own] = False
                texts += 1
        blocks = [total[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)]
        columns = [pa.array([part] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int32()), pa.array([texts] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "block", "texts", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total, texts = 0, 0
        for batch in table.to_batches():
            texts += sum(batch.column("texts").to_pylist())
            for data in batch.column("counts"):
                total = total + np.frombuffer(data.as_py(), np.int64)
        return pa.table({"part": pa.array([0], pa.int32()), "block": table.column("block")[:1], "texts": pa.array([texts], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(count, schema).groupBy("part", "block").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).collect()
    counts = np.zeros(width, np.int64)
    for r in sums:  # one row a block
        counts[edges[r.block] : edges[r.block + 1]] = np.frombuffer(r.counts, np.int64)
    return counts, max((r.texts for r in sums), default=0)


def train(docs: DataFrame, usable: F.Column, lang_rows: int = LANG_ROWS) -> dict | None:
    """Fits on at most ``lang_rows`` of the usable rows of each language."""
    picked = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string"), F.col("text").cast("string"), F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("h")
    )
    sizes = picked.groupBy("lang").count().collect()  # one row a language, as many as the model has classes
    if not sizes:
        return None
    # Hashes below a bound that twice the wanted rows are expected to pass; of those the first are taken.
    bound = [((1 << 63) - 1) if r["count"] <= 2 * lang_rows else int((1 << 64) * (2 * lang_rows / r["count"])) - (1 << 63) for r in sizes]
    bounds = docs.sparkSession.createDataFrame([(r.lang, b) for r, b in zip(sizes, bound, strict=True)], "lang string, bound long")
    few = picked.join(F.broadcast(bounds), "lang").filter("h <= bound").groupBy("lang", "h").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sparse_features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([b.tobytes() for _, b in made], pa.binary())],
                ["lang", "h", "found", "share"],
            )

    order = Window.partitionBy("lang").orderBy("h")
    sample = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= lang_rows)
    found = sample.select("lang", "h", "text").mapInArrow(run, "lang string, h long, found binary, share binary").collect()
    data = sorted((r.h, r.lang, bytes(r.found), bytes(r.share)) for r in found)
    rows = [(lang, np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for _, lang, a, b in data if a]
    if not rows:
        return None
    counts, texts = document_frequencies(picked.select("text"))
    return fit(rows, np.log((1 + texts) / (1 + counts)) + 1)


def predict_batch(model: dict | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    table, names = model["table"], model["langs"]
    at = 0
    while at < len(texts):
        group, parts, size = [], [], 0
        while at < len(texts) and (not group or size < _SLICE_CHARS):
            text = texts[at] or ""
            points = code_points(text)
            if len(points) and (points != 32).any():
                group.append((at, size, len(points)))
                parts += [points, _BLANKS]
                size += len(points) + 2
            at += 1
        if not group:
            continue
        buckets = gram_buckets(np.concatenate(parts))
        total = np.zeros((len(buckets[0]), len(names)), np.float32)
        for found in buckets:
            total += table[found]
        for row, start, length in group:
            p = softmax(total[start : start + length].mean(axis=0, dtype=np.float64))
            best = int(np.argmax(p))
            langs[row], scores[row] = names[best], float(p[best])
    return langs, scores


def identify(docs: DataFrame, model: dict | None, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce(crc_remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 2, 2 * _SLICE_CHARS):
                langs, scores = predict_batch(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
