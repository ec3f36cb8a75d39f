"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's potential comes from its own measures and those of the lines before and after
it; a 2 x 2 table scores the step from line to line. Lines start with their document's label; after a first fit, lines
of bad documents that look good (``GOOD_LINE``) are labelled good, one bad line at least being left, and the chain is
fitted again, so that steps between good and bad lines are seen. At scoring, forward-backward gives each line's
probability of being good, and their mean weighted by line length, calibrated by one logistic curve, is the document's
score.

The fit reads whole texts of at most ``TRAIN_ROWS`` labelled rows and ``TRAIN_BYTES`` bytes, the first by a hash of
their id, those of more than a sixteenth of these bytes left out, in one task; no text reaches the driver.

Defined results: a null or empty text is one empty line and scored as such; repeated rows get equal scores; texts of
any length are scored whole; without labelled rows of both classes every score is the share of label 1, or 0 where
there is none; rows without an id are scored and not held out; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import by_size, crc_remainder, text_bytes
from skein.llm.toxicity import labelled_sample

TRAIN_ROWS, TRAIN_BYTES = 4000, 12_000_000
GOOD_LINE = 0.9
STEPS, RATE, RIDGE = 120, 0.1, 1e-3
MEASURES = 16
WIDTH = 3 * MEASURES + 3
_SLICE_CHARS = 1_000_000

_KINDS = np.zeros(256, np.int64)  # 1 lower, 2 capital, 3 digit, 4 stop, 5 other sign, 6 blank, 7 above ASCII
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[128:] = 1, 2, 3, 7
for _c in b".,;:'\"-()?":
    _KINDS[_c] = 4
for _c in b"!#$%&*+/<=>@[\\]^_`{|}~":
    _KINDS[_c] = 5
for _c in b" \t\r\x0b\x0c":
    _KINDS[_c] = 6


def line_measures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines, their lengths in bytes, and how many lines each text has."""
    lines, counts = [], []
    for text in texts:
        own = text_bytes(text).split(b"\n")
        lines += own
        counts.append(len(own))
    size = np.array([len(x) for x in lines])
    data = np.frombuffer(b"".join(lines), np.uint8)
    owner = np.repeat(np.arange(len(lines)), size)
    kind = _KINDS[data]
    kinds = np.bincount(owner * 8 + kind, minlength=8 * len(lines)).reshape(-1, 8)
    # Signs that repeat the byte before them, and signs between blanks; a line's ends count as blanks.
    same = np.append(False, owner[1:] == owner[:-1])[: len(data)]
    signs, blank = (kind == 4) | (kind == 5), kind == 6
    after_blank = ~same | np.append(False, blank[:-1])[: len(data)]
    before_blank = np.append(~same[1:] | blank[1:], True)[: len(data)]
    again = np.bincount(owner[signs & same & np.append(False, data[1:] == data[:-1])[: len(data)]], minlength=len(lines))
    lone = np.bincount(owner[signs & after_blank & before_blank], minlength=len(lines))
    x = np.empty((len(lines), MEASURES))
    share = kinds / np.maximum(size, 1)[:, None]
    x[:, 0] = np.log1p(size) / 5
    x[:, 1:8] = share[:, 1:]
    for k, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if n:
            x[k, 8:] = np.log1p(n) / 4, size[k] / n / 10, 1 - len(set(words)) / n, sum(map(eq, words, words[1:])) / n, lone[k] / n, again[k] / n, line[-1:] in b".!?", line[:1].isupper()
        else:
            x[k, 8:] = 0
    return x, size, np.array(counts, np.int64)


def chain_features(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own measures, those of the neighbours (0 beyond the ends), and marks for the ends."""
    first = np.cumsum(counts) - counts
    out = np.zeros((len(x), WIDTH))
    out[:, :MEASURES] = x
    out[1:, MEASURES : 2 * MEASURES] = x[:-1]
    out[:-1, 2 * MEASURES : 3 * MEASURES] = x[1:]
    last = first + counts - 1
    out[first, MEASURES : 2 * MEASURES] = 0
    out[last, 2 * MEASURES : 3 * MEASURES] = 0
    out[:, -3] = 1
    out[first, -2] = 1
    out[last, -1] = 1
    return out


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(1)
    return top + np.log(np.exp(a - top[:, None, :]).sum(1)) if a.ndim == 3 else top + np.log(np.exp(a - top[:, None]).sum(1))


def marginals(node: np.ndarray, step: np.ndarray, counts: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected steps summed over all chains; chains advance together, longest first."""
    order = np.argsort(-counts, kind="stable")
    first, length = (np.cumsum(counts) - counts)[order], counts[order]
    alpha, beta = node.copy(), np.zeros_like(node)
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]))]  # chains longer than t
    for t in range(1, len(active)):
        at = first[: active[t]] + t
        alpha[at] += _log_sum(alpha[at - 1][:, :, None] + step[None])
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        beta[at - 1] = _log_sum(np.swapaxes(step[None] + (node[at] + beta[at])[:, None, :], 1, 2))
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    expected = np.zeros((2, 2))
    if pairs:
        total = np.repeat(_log_sum(alpha[np.cumsum(counts) - 1]), counts)
        later = np.ones(len(node), bool)
        later[np.cumsum(counts) - counts] = False
        at = np.flatnonzero(later)
        logs = alpha[at - 1][:, :, None] + step[None] + (node[at] + beta[at])[:, None, :] - total[at][:, None, None]
        expected = np.exp(logs).sum(0)
    return good, expected


def _fit_chain(f: np.ndarray, y: np.ndarray, counts: np.ndarray, by_line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and steps of greatest likelihood of the line labels, by Adam."""
    later = np.ones(len(y), bool)
    later[np.cumsum(counts) - counts] = False
    seen_steps = np.bincount(y[np.flatnonzero(later) - 1] * 2 + y[later], minlength=4).reshape(2, 2)
    w, step = np.zeros(WIDTH), np.zeros((2, 2))
    state = [np.zeros(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), np.zeros((2, 2))]
    for k in range(1, STEPS + 1):
        node = np.zeros((len(f), 2))
        node[:, 1] = f @ w
        good, expected = marginals(node, step, counts, pairs=True)
        slope_w = f.T @ (by_line * (good - y)) / len(counts) + RIDGE * w
        slope_s = (expected - seen_steps) / max(1, later.sum()) + RIDGE * 10 * step
        for value, slope, m, v in ((w, slope_w, state[0], state[1]), (step, slope_s, state[2], state[3])):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            value -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w, step


def line_labels(good: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 for the lines of good documents and the good-looking lines of bad ones, but for the worst of each."""
    first = np.cumsum(counts) - counts
    y = np.repeat(labels, counts).astype(np.int64)
    y[good >= GOOD_LINE] = 1
    worst = np.repeat(np.minimum.reduceat(good, first), counts)
    y[(good == worst) & (np.repeat(labels, counts) == 0)] = 0
    return y


def fit(texts: list[str | None], labels: np.ndarray) -> dict:
    x, size, counts = line_measures(texts)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    f = chain_features((x - centre) / scale, counts)
    share = np.clip(labels.mean(), 0.01, 0.99)
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))  # both labels weigh the same
    by_line = np.repeat(balance / counts, counts)
    y = np.repeat(labels, counts).astype(np.int64)
    for last in (False, True):
        w, step = _fit_chain(f, y, counts, by_line)
        if not last:
            node = np.zeros((len(f), 2))
            node[:, 1] = f @ w
            y = line_labels(marginals(node, step, counts)[0], labels, counts)
    model = {"centre": centre, "scale": scale, "w": w, "step": step, "curve": (1.0, 0.0)}
    raw = _logit(document_means(model, x, size, counts))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a one-variable logistic curve
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        d, h = p - labels, np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(h * raw * raw).sum() + 1e-2, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-2]])
        move = np.linalg.solve(hess, [(d * raw).sum() + 1e-2 * (a - 1), d.sum() + 1e-2 * b])
        a, b = a - move[0], b - move[1]
    return model | {"curve": (float(a), float(b))}


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def document_means(model: dict, x: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    f = chain_features((x - model["centre"]) / model["scale"], counts)
    node = np.zeros((len(f), 2))
    node[:, 1] = f @ model["w"]
    good, _ = marginals(node, model["step"], counts)
    weight, owner = size + 1.0, np.repeat(np.arange(len(counts)), counts)
    return np.bincount(owner, good * weight) / np.bincount(owner, weight)


def score_texts(model: dict, texts: list[str | None]) -> np.ndarray:
    if "constant" in model or not texts:
        return np.full(len(texts), model.get("constant", 0.0))
    a, b = model["curve"]
    raw = _logit(document_means(model, *line_measures(texts)))
    return 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> dict:
    """Fits in one task on a sample of bounded rows and bytes; only the model comes back."""
    sized = labelled_sample(docs, labels, "quality", usable, max_rows).filter("text IS NOT NULL").withColumn("bytes", F.octet_length("text"))
    before = F.sum("bytes").over(Window.orderBy("h", "doc_id"))  # over max_rows rows at most
    sample = sized.filter(F.col("bytes") <= max_bytes // 16).withColumn("before", before).filter(F.col("before") <= max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((h, i, y, t) for batch in batches for h, i, y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        y = np.array([r[2] for r in rows], float)
        model = fit([r[3] for r in rows], y) if 0 < y.sum() < len(y) else {"constant": float(y.mean()) if len(y) else 0.0}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = sample.select("h", "doc_id", "y", "text").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else {"constant": 0.0}


def score(docs: DataFrame, model: dict, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce(crc_remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 2, _SLICE_CHARS):
                scores = score_texts(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
