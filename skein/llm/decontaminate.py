"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

Words are runs of letters and digits, A-Z lower-cased; scripts without blanks count one word a character. A repetition
has a seeded walk over the whole window: at step t it writes the word under its pointer and moves on by a random bit of
(repetition, t, word), for 1.75 steps a word, so that the edit distance of two texts becomes a Hamming distance of
their walks. Every other repetition walks from the last word to the first, so that a window that lacks one end of the
item is walked from the other. The LSH key of a window is what its walk writes at ``SAMPLED_STEPS`` steps, one drawn from each part of
the walk. Items come in classes of like lengths. Repetitions are added to a class until seeded mutations of its items,
with as many edits as allowed and words of the benchmark or unknown ones put in, are found at the target recall.
Items of ``SHORT_WORDS`` or fewer, and classes that miss the recall after ``MOST_REPETITIONS``, are searched exactly:
of one piece more than the allowed edits, one piece stands unchanged in any copy. Windows that hold fewer words of a
class's vocabulary than any copy of its items must are not walked. Candidates are verified: the smallest number of
word edits between the item and any stretch around the window, against ``max_rate`` of the item's words.

The benchmark is a stated query set: it is taken in blocks of at most ``BLOCK_WORDS`` words (or one item), whose index
is built once and sent to all tasks, and each block runs over all documents.

Defined results: an item under five words has to stand there unchanged (no edit is within its rate); items without a
word and null items are in no document; a null or empty text holds no item; repeated rows are judged one by one, and
items that share an id are items of their own; texts of any length are read whole; other columns are not read by
``benchmark_hits`` and kept by ``without_benchmark``; an empty table on either side gives no hit.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import LETTERS_DIGITS, by_size, mix64, text_bytes

BLOCK_WORDS = 1_000_000
SHORT_WORDS = 8
SAMPLED_STEPS, STEPS_PER_WORD = 3, 1.75
MAX_RATE, TARGET_RECALL, MOST_REPETITIONS = 0.2, 0.98, 96
MUTANTS, CONTEXT = 300, 12
_SLICE_CHARS = 4_000_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SIGN = np.uint64(63)
# Blocks of scripts that are written without blanks.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿⺀-⿟぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")


def normal_words(text: str | None) -> list[bytes]:
    if text and not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text_bytes(text).translate(LETTERS_DIGITS).split()


def edit_distance_within(item: np.ndarray, region: np.ndarray) -> int:
    """The smallest edit distance between ``item`` and any stretch of ``region``."""
    n = len(region)
    row = np.zeros(n + 1, np.int64)
    steps = np.arange(n + 1)
    for i, word in enumerate(item, 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (region != word), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def length_class(n: int) -> int:
    """Lengths to 15 stand alone, then eight classes an octave."""
    shift = max(n.bit_length() - 4, 0)
    return n >> shift << shift


def _matches(keys: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the sorted ``keys`` that equal each of ``met``, and which of ``met``."""
    low, high = np.searchsorted(keys, met, "left"), np.searchsorted(keys, met, "right")
    count = high - low
    return np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), np.repeat(np.arange(len(met)), count)


def _among(good: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return good[np.minimum(np.searchsorted(good, keys), len(good) - 1)] == keys


class Repetition:
    """One walk over the items of a class, and the LSH table of its sampled steps."""

    def __init__(self, number: int, length: int, values: np.ndarray, begins: np.ndarray, ends: np.ndarray, members: np.ndarray):
        random = np.random.default_rng([11, number, length])
        steps = max(int(STEPS_PER_WORD * length), SAMPLED_STEPS)
        edges = np.linspace(0, steps, SAMPLED_STEPS + 1).astype(int)
        self.steps = [int(random.integers(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
        self.odd = random.integers(0, 1 << 63, self.steps[-1] + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.good: list[np.ndarray] = []
        at, key, kept = begins.copy(), np.zeros(len(begins), np.uint64), np.arange(len(begins))
        for step, odd in enumerate(self.odd):
            if step in self.steps:
                inside = at < ends[kept]  # a walk that has left its item writes nothing more
                at, key, kept = at[inside], key[inside], kept[inside]
                key = mix64(key * _GOLDEN + values[at])
                self.good.append(np.unique(key))
            at = at + (values[np.minimum(at, len(values) - 1)] * odd >> _SIGN).astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.members = key[order], members[kept[order]]
        self.mask = np.uint64((1 << (8 * max(len(self.good[0]), 1)).bit_length()) - 1)
        self.first = np.zeros(int(self.mask) + 1, bool)  # most windows end here
        self.first[(self.good[0] & self.mask).astype(np.int64)] = True

    def candidates(self, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and starts of the windows whose key is an item's."""
        at, key, sampled = starts, np.zeros(len(starts), np.uint64), 0
        if not len(self.keys):
            return self.members, starts[:0]
        for step, odd in enumerate(self.odd):
            word = values[at]
            if step == self.steps[sampled]:
                key = mix64(key * _GOLDEN + word)
                if not sampled:
                    stay = np.flatnonzero(self.first[(key & self.mask).astype(np.int64)])
                    starts, at, key, word = starts[stay], at[stay], key[stay], word[stay]
                stay = np.flatnonzero(_among(self.good[sampled], key))
                starts, at, key, word = starts[stay], at[stay], key[stay], word[stay]
                sampled += 1
                if not len(starts) or sampled == SAMPLED_STEPS:
                    break
            at = at + (word * odd >> _SIGN).astype(np.int64)
        if not len(starts):
            return self.members[:0], starts
        rows, of = _matches(self.keys, key)
        return self.members[rows], starts[of]


class LengthClass:
    """Items of like lengths: their vocabulary, how much of it a copy must hold, and their repetitions."""

    def __init__(self, index: Index, members: list[int]):
        self.members = np.array(members)
        sizes = [len(index.items[k]) for k in members]
        self.least, self.longest = min(sizes), max(sizes)
        edits = max(index.allowed[k] for k in members)
        self.span, self.need = self.least + edits, max(self.least - edits, 1)
        self.known = np.zeros(len(index.words), bool)
        self.sizes = np.zeros(len(index.items), np.int64)
        self.sizes[members] = sizes
        self.ends = np.cumsum(sizes)
        self.begins, self.values = self.ends - sizes, []
        for step in (1, -1):
            flat = np.concatenate([index.items[k][::step] for k in members])
            self.known[flat] = True
            self.values.append(index.words[flat])
        self.repetitions: list[Repetition] = []

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """Windows that hold enough words of the vocabulary and begin with one of them."""
        inside = self.known[ids]
        held = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(inside, out=held[1:])
        whole = len(ids) - self.span
        enough = np.empty(len(ids), bool)
        if whole > 0:
            enough[:whole] = held[self.span : -1] - held[:whole] >= self.need
        enough[max(whole, 0) :] = held[-1] - held[max(whole, 0) : -1] >= self.need
        return np.flatnonzero(enough & inside)

    def grow(self) -> None:
        number = len(self.repetitions)
        self.repetitions.append(Repetition(number, self.least, self.values[number % 2], self.begins, self.ends, self.members))

    def candidates(self, both: list[tuple[np.ndarray, np.ndarray]], fresh: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Items, where their windows were entered, and where they start, by the repetitions from ``fresh`` on.

        ``both`` has the word numbers and values of the texts forwards and backwards.
        """
        entered = [self.starts(ids) if len(self.repetitions) > fresh else ids[:0] for ids, _ in both]
        for number, repetition in enumerate(self.repetitions[fresh:], fresh):
            (ids, values), starts = both[number % 2], entered[number % 2]
            if len(starts):
                items, at = repetition.candidates(values, starts)
                if number % 2:
                    at = len(ids) - 1 - at
                yield items, at, at - self.sizes[items] + 1 if number % 2 else at


class Index:
    """The LSH tables of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]], max_rate: float = MAX_RATE, recall: float = TARGET_RECALL):
        found = [(i, w) for i, t in items if (w := normal_words(t))]
        self.ids = [i for i, _ in found]
        self.vocabulary: dict[bytes, int] = {}
        for _, words in found:
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.words = mix64(np.arange(len(self.vocabulary) + 1, dtype=np.uint64) * _GOLDEN + np.uint64(1))
        self.items = [np.array([self.vocabulary[w] for w in words], np.int32) for _, words in found]
        self.allowed = [int(max_rate * len(x)) for x in self.items]
        self.longest_walk = int(STEPS_PER_WORD * max(map(len, self.items), default=0)) + 1
        self._fill(recall)

    def _mutant(self, k: int, random: np.random.Generator) -> np.ndarray:
        """An item with all the edits that are allowed, between words of the benchmark."""
        words, most = self.items[k].tolist(), len(self.vocabulary) + 1
        for _ in range(self.allowed[k]):
            at, kind = int(random.integers(0, len(words))), int(random.integers(0, 3))
            new = int(random.integers(0, most)) * int(random.integers(0, 2))
            if kind == 0:
                words[at] = new
            elif kind == 1 and len(words) > 1:
                del words[at]
            else:
                words.insert(at, new)
        return np.concatenate([random.integers(0, most, CONTEXT), words, random.integers(0, most, CONTEXT)]).astype(np.int32)

    def _fill(self, recall: float) -> None:
        members: dict[int, list[int]] = {}
        for k, item in enumerate(self.items):
            members.setdefault(length_class(len(item)), []).append(k)
        exact: list[int] = []
        self.classes: list[LengthClass] = []
        #: Share of the mutants of each class that is found; 1 where the search is exact.
        self.recalls: dict[int, float] = {}
        for c, own in sorted(members.items()):
            self.recalls[c] = 1.0
            if c <= SHORT_WORDS:
                exact += own
                continue
            random, group = np.random.default_rng([23, c]), LengthClass(self, own)
            missed = [(k, self._mutant(k, random)) for k in (own[m] for m in random.integers(0, len(own), MUTANTS))]
            while len(group.repetitions) < MOST_REPETITIONS:
                group.grow()
                ends = np.cumsum([len(w) for _, w in missed])
                met = group.candidates(self._both_ways(np.concatenate([w for _, w in missed])), len(group.repetitions) - 1)
                found = {m for got, at, _ in met for m, k in zip(np.searchsorted(ends, at, "right").tolist(), got.tolist(), strict=True) if missed[m][0] == k}
                missed = [x for m, x in enumerate(missed) if m not in found]
                self.recalls[c] = 1 - len(missed) / MUTANTS
                if self.recalls[c] >= recall:
                    self.classes.append(group)
                    break
            else:
                exact += own
                self.recalls[c] = 1.0
        self.recall = min(self.recalls.values(), default=1.0)
        self.pieces = self._pieces(exact)

    def _pieces(self, chosen: list[int]) -> list[tuple]:
        """For each length of pieces: the prefixes of keys allowed after each word, the keys, items and places in them."""
        groups: dict[int, list[tuple[int, int]]] = {}
        for k in chosen:
            n = len(self.items[k])
            cuts = np.linspace(0, n, min(self.allowed[k] + 1, n) + 1).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                groups.setdefault(b - a, []).append((k, a))
        tables = []
        for size, members in sorted(groups.items()):
            flat = np.concatenate([self.items[k][a : a + size] for k, a in members])
            keys = self._grams(flat, np.arange(0, len(flat), size), size, None)[1]
            order = np.argsort(keys[-1], kind="stable")
            tables.append((size, [np.unique(x) for x in keys], keys[-1][order], np.array([k for k, _ in members])[order], np.array([a for _, a in members])[order]))
        return tables

    @staticmethod
    def _grams(flat: np.ndarray, starts: np.ndarray, size: int, allowed: list[np.ndarray] | None) -> tuple:
        """Keys of the runs of ``size`` words from all starts, less those that can no longer match."""
        key, keys = np.zeros(len(starts), np.uint64), []
        for step in range(size):
            key = mix64(key * _GOLDEN + flat[starts + step].astype(np.uint64) + np.uint64(1))
            if allowed is not None:
                stay = _among(allowed[step], key)
                starts, key = starts[stay], key[stay]
            keys.append(key)
        return starts, keys

    def _both_ways(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        beyond = np.zeros(self.longest_walk, np.int32)
        return [(x, self.words[np.concatenate([x, beyond])]) for x in (ids, ids[::-1])]

    def _candidates(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Item numbers, a place inside of windows and their starts, from repetitions and from unchanged pieces."""
        both = self._both_ways(ids)
        for group in self.classes:
            yield from group.candidates(both)
        for size, allowed, keys, members, offsets in self.pieces:
            starts, met = self._grams(ids, np.flatnonzero(ids[: max(len(ids) - size + 1, 0)]), size, allowed)
            rows, of = _matches(keys, met[-1])
            yield members[rows], starts[of], starts[of] - offsets[rows]

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(position in ``texts``, item number, distance, first word of the window), the best of each pair."""
        if not self.items or not texts:
            return
        parts, begins, at = [], [], 0
        gap = np.zeros(1, np.int32)
        for text in texts:
            words = normal_words(text)
            parts += [np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words)), gap]
            begins.append(at)
            at += len(words) + 1
        ids, begin = np.concatenate(parts), np.array([*begins, at])
        met = list(self._candidates(ids))
        if not met:
            return
        items, places, starts = (np.concatenate([m[j] for m in met]).astype(np.int64) for j in range(3))
        starts = np.maximum(starts, begin[np.searchsorted(begin, places, "right") - 1])  # an end of the item can be cut off
        pairs = np.unique(items * (at + 1) + starts)
        items, starts = pairs // (at + 1), pairs % (at + 1)
        docs = np.searchsorted(begin, starts, "right") - 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        low = 0
        while low < len(items):
            k, doc, size = int(items[low]), int(docs[low]), len(self.items[items[low]])
            high = low + 1  # windows of one item that stand close together are verified at once
            while high < len(items) and items[high] == k and docs[high] == doc and starts[high] - starts[low] <= size:
                high += 1
            found = self._verified(k, ids, int(starts[low]), int(starts[high - 1]), int(begin[doc]), int(begin[doc + 1]) - 1)
            if found is not None:
                best[doc, k] = min(found, best.get((doc, k), found))
            low = high
        for (doc, k), (distance, start) in sorted(best.items()):
            yield doc, k, distance, start

    def _verified(self, k: int, ids: np.ndarray, first: int, last: int, begin: int, end: int) -> tuple[int, int] | None:
        item, most = self.items[k], self.allowed[k]
        region = ids[max(first - most, begin) : min(last + len(item) + most, end)]
        if len(region) < len(item) - most or np.isin(item, region).sum() < len(item) - most:  # an edit accounts for one word at most
            return None
        distance = edit_distance_within(item, region)
        return (distance, max(first - begin, 0)) if distance <= most else None


def _blocks(benchmark: DataFrame, max_rate: float) -> Iterator[Index]:
    """Indexes over runs of items in order of their ids, read one partition at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        words = len(normal_words(r.text))
        if block and size + words > BLOCK_WORDS:
            yield Index(block, max_rate)
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += words
    if block:
        yield Index(block, max_rate)


HITS_SCHEMA = "doc_id long, item_id long, distance int, item_words int, start_word long"


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """One row per document and benchmark item that it holds, with the word edits between them."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in HITS_SCHEMA.split(", ")]

    def scan(index: Index) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by BLOCK_WORDS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                for part in by_size(batch, 1, _SLICE_CHARS):
                    ids = part.column(0).to_pylist()
                    rows = [(ids[d], known.ids[k], e, len(known.items[k]), w) for d, k, e, w in known.find(part.column(1).to_pylist())]
                    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        return narrow.mapInArrow(run, HITS_SCHEMA)

    found = [scan(index) for index in _blocks(benchmark, max_rate)]
    return functools.reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], HITS_SCHEMA)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns stay, nothing is shuffled."""
    at = docs.columns.index("text")

    def drop(kept: DataFrame, index: Index) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by BLOCK_WORDS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in by_size(batch, at, _SLICE_CHARS):
                    clean = np.ones(part.num_rows, bool)
                    clean[[d for d, *_ in sent.value.find(part.column(at).to_pylist())]] = False
                    yield part.filter(pa.array(clean))

        return kept.mapInArrow(run, kept.schema)

    return functools.reduce(drop, _blocks(benchmark, max_rate), docs)
