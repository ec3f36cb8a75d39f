"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities of a fixed and of a learned lexicon, how near its words stand to second-person pronouns,
capitals, punctuation and obfuscation (words that only match once digits, signs or repeats are undone). What a word
contributes depends on the word alone and is cached; texts are measured in batches of bounded size.

The fit reads at most ``TRAIN_ROWS`` labelled rows, the first by a hash of their id, whole texts, and is cross-fitted
over ``PARTS`` parts of them. The lexicon holds all words and stems that occur in toxic texts almost only; the features
of a training row come from a lexicon that was learned without its part, those of other texts from that of all parts.
Trees of each part's complement give the margins that the calibration is fitted on; the trees of all rows score.

Defined results: null and empty texts get the calibrated score of a text without any word; repeated rows get equal
scores; texts of any length are read whole; without labelled rows of both classes every score is the share of label 1,
or 0 where there is none; rows without an id are scored and not held out; ``score`` reads no other column and
``without_toxic`` keeps all; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import LETTERS_DIGITS, by_size, checkpointed, crc_remainder, text_bytes

TRAIN_ROWS = 20_000
PARTS, LEAST_TEXTS, PURITY, SURE_TEXTS, SURE_PURITY = 3, 3, 0.95, 6, 0.985
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 60, 3, 0.2, 32, 4, 1.0
STEMS = (4, 5, 6, 7, 8)

# Common insults.
LEXICON = frozenset(
    b"idiot idiots moron morons loser losers stupid scum trash worthless pathetic disgusting clown clowns dumb fool "
    b"fools imbecile cretin jerk jerks garbage vermin filth filthy ugly hate despicable shut dumbass bastard freak creep "
    b"coward liar lunatic retard parasite degenerate".split()
)
# Second-person pronouns of a few languages.
SECOND_PERSON = frozenset(b"you your yours yourself u ur tu te ton ta tes toi vous votre vos du dich dir dein deine euch ihr usted ustedes ti tus".split())
# Signs that stand for letters.
_LEET = bytes.maketrans(b"013457@$!|", b"oieastasil")

_SEED, _LEARNED, _SECOND, _CAPS, _HIDDEN, _MIXED, _SIGNS, _REPEATS, _STRONG = (1 << k for k in range(9))
_REPEAT = re.compile(rb"(.)\1{2,}")
_MARKS = b".,;:!?\"'()[]{}*#%$&-"
_CACHE_WORDS = 100_000
_SLICE_CHARS = 2_000_000
FEATURES = 17
NEAR_WORDS = 6


def core(word: bytes) -> bytes:
    return word.translate(LETTERS_DIGITS).replace(b" ", b"")


def terms_of(word: bytes) -> list[bytes]:
    """The word without signs, and its stems by length, marked with a star."""
    return [word, *(word[:k] + b"*" for k in STEMS if len(word) > k)] if len(word) > 2 else []


class _Codes(dict):
    """Flags of each raw word; bounded."""

    def __init__(self, learned: dict[bytes, int]):
        super().__init__()
        self.learned = learned
        self.heads = {t[: STEMS[0]] for t in learned}  # most words are told apart by their first letters

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        inner = word.strip(_MARKS)
        plain = inner.isalpha() and inner.islower()
        bare = inner if plain else core(word)
        code = _SEED * (bare in LEXICON) | _SECOND * (bare in SECOND_PERSON)
        if bare[: STEMS[0]] in self.heads:
            rank = max((self.learned.get(t, 0) for t in terms_of(bare)), default=0)
            code |= _LEARNED * (rank > 0) | _STRONG * (rank > 1)
        if not plain:
            if len(inner) > 1 and inner.isupper():
                code |= _CAPS
            has_digit, has_letter = any(48 <= c <= 57 for c in inner), any(c >= 65 for c in inner)
            code |= _MIXED * (has_digit and has_letter)
            if len(inner) != len(core(inner)):
                code |= _SIGNS
        if _REPEAT.search(inner):
            code |= _REPEATS
        if not code & _SEED and (code & (_MIXED | _SIGNS | _REPEATS)):
            seen = core(inner.lower().translate(_LEET))
            if seen in LEXICON or _REPEAT.sub(rb"\1", seen) in LEXICON:
                code |= _HIDDEN
        self[word] = code
        return code


_ALPHA = np.zeros(256, np.int8)  # 1 lower, 2 capital, 3 digit, 4 sign, 0 the rest
_ALPHA[97:123], _ALPHA[65:91], _ALPHA[48:58] = 1, 2, 3
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _ALPHA[_c] = 4


def _sums(values: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the stretches that start at ``begins``; those of none are 0."""
    return np.where(counts > 0, np.add.reduceat(np.append(values, 0), begins), 0)


def features(texts: list[str | None], codes: _Codes) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    data = [text_bytes(t) for t in texts]
    words = [d.split() for d in data]
    n, size = np.array([len(w) for w in words]), np.array([len(d) for d in data])
    begins, offsets = np.cumsum(n) - n, np.cumsum(size) - size
    code = np.fromiter(map(codes.__getitem__, chain.from_iterable(words)), np.int32, int(n.sum()))
    flags = (_SEED, _LEARNED, _STRONG, _HIDDEN, _SECOND, _CAPS, _MIXED | _SIGNS, _REPEATS)
    count = [_sums((code & flag > 0).astype(np.int64), begins, n) for flag in flags]
    raw = np.frombuffer(b"".join(data), np.uint8)
    kinds = _ALPHA[raw]
    capitals, signs = (_sums((kinds == k).astype(np.int64), offsets, size) for k in (2, 4))
    shouts = np.array([d.count(b"!") for d in data])
    near = np.zeros(len(data))
    hit, second = np.flatnonzero(code & (_SEED | _LEARNED | _HIDDEN)), np.flatnonzero(code & _SECOND)
    if len(hit) and len(second):
        owner, other = (np.searchsorted(begins, x, "right") - 1 for x in (hit, second))
        at, close = np.searchsorted(second, hit), np.zeros(len(hit), bool)
        for side in (np.minimum(at, len(second) - 1), np.maximum(at - 1, 0)):
            close |= (np.abs(hit - second[side]) <= NEAR_WORDS) & (owner == other[side])
        near = np.bincount(owner[close], minlength=len(data))
    per_word, per_byte = np.maximum(n, 1), np.maximum(size, 1)
    return np.column_stack([
        np.log1p(n), *(np.log1p(c) for c in count[:4]), count[0] / per_word, count[1] / per_word, count[2] / per_word, near, near / per_word,
        count[4] / per_word, count[5] / per_word, capitals / per_byte, signs / per_byte, shouts / per_byte, count[6] / per_word, count[7] / per_word,
    ])


class Trees:
    """Second-order boosting of log loss with quantile bins; a tree is complete, its nodes in heap order."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, col, "right") for c, col in zip(cuts, x.T, strict=True)])
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        margin = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree, place = self._grow(binned, cuts, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            margin += tree[2][place]

    @staticmethod
    def _grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple:
        inner = (1 << DEPTH) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(g), np.int64)
        for depth in range(DEPTH):
            first, width = (1 << depth) - 1, 1 << depth
            local = node - first
            best = np.full(width, 1e-9)
            bin_cut = np.full(width, BINS)
            total = [np.bincount(local, v, width) for v in (g, h)]
            for f in range(binned.shape[1]):
                if not len(cuts[f]):
                    continue
                key = local * BINS + binned[:, f]
                gl, hl, nl = (np.cumsum(np.bincount(key, v, width * BINS).reshape(width, BINS), 1)[:, :-1] for v in (g, h, None))
                gr, hr = total[0][:, None] - gl, total[1][:, None] - hl
                rows = np.bincount(local, minlength=width)[:, None]
                gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (total[0] ** 2 / (total[1] + RIDGE))[:, None]
                gain[(nl < LEAST_ROWS) | (rows - nl < LEAST_ROWS)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best):
                    if at[k] < len(cuts[f]):
                        best[k], bin_cut[k], feature[first + k], cut[first + k] = top[k], at[k], f, cuts[f][at[k]]
            node = 2 * node + 1 + (binned[np.arange(len(g)), feature[node]] > bin_cut[local])
        place = node - inner
        leaves = 1 << DEPTH
        value = -RATE * np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + RIDGE)
        return (feature, cut, value), place

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] >= cut[node])
            out += value[node - len(feature)]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of an increasing map through the centres of the blocks; equal margins are pooled first.

    Beyond the outer centres the map still rises, so that ties of the margin alone are ties of the score.
    """
    at, group = np.unique(margin, return_inverse=True)
    weight, total = np.bincount(group).astype(float), np.bincount(group, y)
    blocks: list[list[float]] = []
    for x, w, s in zip(at, weight, total, strict=True):
        blocks.append([s, w, x * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            for k, value in enumerate(blocks.pop()):
                blocks[-1][k] += value
    sums, weights, moments = np.array(blocks).T
    knots, values = moments / weights, np.maximum.accumulate((sums + 0.01) / (weights + 0.02))
    reach = 2 * (at[-1] - at[0]) + 1
    return np.concatenate([[at[0] - reach], knots, [at[-1] + reach]]), np.concatenate([[values[0] / 4], values, [1 - (1 - values[-1]) / 4]])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int) -> DataFrame:
    """doc_id, text, y, h of at most ``max_rows`` labelled ids, the first by a hash, one row each; written once.

    Of rows that repeat an id the largest text counts, of its labels the largest.
    """
    ids = (
        labels.filter(usable & F.col(label).isNotNull())
        .select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"), F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(1 << 30)).alias("h"))
        .orderBy("h", "doc_id", "y")
        .limit(max_rows)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"), F.first("h").alias("h"))
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    met = texts.join(F.broadcast(ids), "doc_id")  # at most max_rows narrow rows are sent
    return checkpointed(met.groupBy("doc_id", "y", "h").agg(F.max("text").alias("text")))


def _term_counts(rows: DataFrame, wanted: frozenset[bytes] | None) -> DataFrame:
    """term, n0, n1, n2: in how many texts of each part a term occurs; of ``wanted`` terms only, if they are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 0, _SLICE_CHARS):
                counts: Counter = Counter()
                for text, h in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    found = {t for w in {core(w) for w in set(text_bytes(text.as_py()).split())} for t in terms_of(w)}
                    counts.update((t, h % PARTS) for t in (found if wanted is None else found & wanted))
                terms = list(dict.fromkeys(t for t, _ in counts))
                columns = [pa.array(terms, pa.binary()), *(pa.array([counts[t, k] for t in terms], pa.int64()) for k in range(PARTS))]
                yield pa.RecordBatch.from_arrays(columns, ["term", "n0", "n1", "n2"])

    made = rows.select("text", "h").mapInArrow(run, "term binary, n0 long, n1 long, n2 long")
    return made.groupBy("term").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(PARTS)])


def learn_lexicons(sample: DataFrame) -> list[dict[bytes, int]]:
    """Terms that occur in toxic texts almost only, counted once a text: 1, and 2 for the surest.

    The first lexicons leave out one part each, the last is of all parts.
    """
    often = F.col("n0") + F.col("n1") + F.col("n2")
    toxic = _term_counts(sample.filter("y = 1"), None).filter(often >= LEAST_TEXTS).collect()  # terms of at most TRAIN_ROWS texts
    toxic_counts = {bytes(r.term): np.array([r.n0, r.n1, r.n2]) for r in toxic}
    clean = _term_counts(sample.filter("y = 0"), frozenset(toxic_counts)).collect() if toxic_counts else []
    clean_counts = {bytes(r.term): np.array([r.n0, r.n1, r.n2]) for r in clean}
    sizes = {y: np.zeros(PARTS) for y in (0, 1)}
    for r in sample.groupBy("y", (F.col("h") % PARTS).alias("k")).count().collect():
        sizes[r.y][r.k] = r["count"]
    terms = sorted(toxic_counts)
    hits = np.array([toxic_counts[t] for t in terms]).reshape(-1, PARTS)
    misses = np.array([clean_counts.get(t, np.zeros(PARTS)) for t in terms]).reshape(-1, PARTS)
    out = []
    for left_out in (*range(PARTS), None):
        used = np.array([k != left_out for k in range(PARTS)])
        n_toxic, n_clean = max(sizes[1][used].sum(), 1), max(sizes[0][used].sum(), 1)
        found = hits[:, used].sum(1)
        share = found / n_toxic
        purity = share / (share + (misses[:, used].sum(1) + 0.5) / n_clean)
        rank = 1 * ((found >= LEAST_TEXTS) & (purity >= PURITY)) + ((found >= SURE_TEXTS) & (purity >= SURE_PURITY))
        out.append({terms[k]: int(rank[k]) for k in np.flatnonzero(rank)})
    return out


def fit(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> tuple[Trees, tuple[np.ndarray, np.ndarray]]:
    """Trees of all rows, and the calibration of margins that each part gets from trees of the others."""
    trees, margin = Trees(x, y), np.zeros(len(y))
    for k in np.unique(part):
        own = part == k
        margin[own] = (Trees(x[~own], y[~own]) if not own.all() else trees).margin(x[own])
    return trees, isotonic(margin, y)


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = TRAIN_ROWS) -> dict:
    sample = labelled_sample(docs, labels, "toxic", usable, max_rows)
    lexicons = learn_lexicons(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [_Codes(x) for x in lexicons]
        for batch in batches:
            made: list[bytes] = []
            for part in by_size(batch, 3, _SLICE_CHARS):
                texts, parts = part.column(3).to_pylist(), np.array(part.column(1).to_pylist()) % PARTS
                x = np.zeros((len(texts), FEATURES))
                for k in np.unique(parts):
                    x[parts == k] = features([texts[i] for i in np.flatnonzero(parts == k)], codes[k])
                made += [row.tobytes() for row in x]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], ["doc_id", "h", "y", "x"])

    rows = sample.select("doc_id", "h", "y", "text").mapInArrow(run, "doc_id long, h long, y int, x binary").collect()
    rows = sorted((r.h, r.doc_id, r.y, bytes(r.x)) for r in rows)
    y = np.array([r[2] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return {"learned": lexicons[-1], "constant": float(y.mean()) if len(y) else 0.0}
    trees, knots = fit(np.array([np.frombuffer(r[3]) for r in rows]), y, np.array([r[0] % PARTS for r in rows]))
    return {"learned": lexicons[-1], "trees": trees, "knots": knots}


def score_batch(model: dict, texts: list[str | None], codes: _Codes) -> np.ndarray:
    if "constant" in model or not texts:
        return np.full(len(texts), model.get("constant", 0.0))
    return np.interp(model["trees"].margin(features(texts, codes)), *model["knots"])


def score(docs: DataFrame, model: dict, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce(crc_remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(model["learned"])
        for batch in batches:
            for part in by_size(batch, 2, _SLICE_CHARS):
                scores = score_batch(model, part.column(2).to_pylist(), codes)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` without the documents that score 0.5 or more; all columns stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(model["learned"])
        for batch in batches:
            for part in by_size(batch, at, _SLICE_CHARS):
                yield part.filter(pa.array(score_batch(model, part.column(at).to_pylist(), codes) < 0.5))

    return docs.mapInArrow(run, docs.schema)
