"""License scans by diagonal voting.

Every rolling pair of words of every text is hashed and Spark-joined to the places of that pair in the templates.
A hit votes for the diagonal (place in the text minus place in the template) of its template; diagonals at most
``NEAR`` apart are one match with words put in or left out; a match whose distinct places cover enough of the template
is a candidate. Its words are aligned with the template: on a stretch about as long as the template, enough distinct
pairs have to stand in order, the words that mark the licence have to be there, and no word of another variant. Of
overlapping stretches of one family the closest stays.

The base phrases are templates too: a phrase stands where one diagonal has all of its pairs. Other templates add
labels of their own. Words are runs of letters and digits, A-Z lower-cased.

Defined results: a null text is empty; rows that repeat an id are judged one by one; a text without a hit has
n_base 0, null places, empty labels and score 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import LETTERS_DIGITS, mix64, text_bytes, word_hashes

NEAR = 3
LEAST_COVER, LONGEST_SPAN = 0.6, 1.5
MOST_TEMPLATE_ROWS = 10_000
_SLICE_WORDS = 100_000
_NEAR_WORDS = np.dtype([("at", np.int32), ("word", np.uint64)])

# The base phrases and their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Opening words of public licence notices.
NOTICES = (
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("you should have received a copy of the gnu affero general public license along with this program", "agpl"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("the person who associated a work with this deed has dedicated the work to the public domain", "cc0"),
    ("boost software license version 1 0", "bsl"),
)
# Words too common for a pair of them to vote.
_COMMON = frozenset("the of to and in is a an any or it this that as for with by are be at on".split())
# Words that a notice cannot do without where its template has them, words that name another variant of
# a family, and the families of labels that do not begin with the family's name.
MARKS = frozenset("gnu general lesser affero apache mozilla eclipse boost unencumbered deed nc sa nd".split())
VARIANTS = {
    "gpl": ("lesser", "affero"),
    "cc": ("nc", "sa", "nd", "noncommercial", "commercial", "sharealike", "alike", "noderivatives", "noderivs", "derivatives", "derivs"),
}
FAMILIES = {"lgpl": "gpl", "agpl": "gpl"}


def pair_hashes(words: list[bytes]) -> np.ndarray:
    h = word_hashes(words)
    return mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]).astype(np.int64)


def template_rows(notices: tuple = NOTICES) -> list[tuple[int, int, int, int, int, str]]:
    """(template, is_base, place, pair hash, number of pairs, label)."""
    rows = []
    for t, (text, label) in enumerate([*BASE_PHRASES, *notices]):
        words = text.split()
        hashes = pair_hashes([w.encode() for w in words]).tolist()
        base = int(t < len(BASE_PHRASES))
        kept = [(p, h) for p, h in enumerate(hashes) if base or not {words[p], words[p + 1]} <= _COMMON]
        rows += [(t, base, p, h, len(kept), label) for p, h in kept]
    return rows


def templates(spark: SparkSession, notices: tuple = NOTICES) -> DataFrame:
    rows = template_rows(notices)
    table = spark.createDataFrame(rows, "template int, base int, place int, pair long, pairs int, label string")
    return F.broadcast(table) if len(rows) <= MOST_TEMPLATE_ROWS else table


def _hash(words: list[str] | tuple[str, ...]) -> np.ndarray:
    return word_hashes([w.encode() for w in words])


class Template:
    """A notice as the alignment needs it."""

    def __init__(self, text: str, label: str):
        words = text.split()
        self.words, self.label = _hash(words), label
        self.family = FAMILIES.get(label, label.split("-")[0])
        self.voting = [p for p in range(len(words) - 1) if not {words[p], words[p + 1]} <= _COMMON]
        self.marks = [p for p, w in enumerate(words) if w in MARKS]
        self.others = _hash([w for w in VARIANTS.get(self.family, ()) if w not in words])
        self.longest = int(LONGEST_SPAN * len(words)) + NEAR
        self.least = int(np.ceil(LEAST_COVER * len(self.voting)))

    def align(self, region: np.ndarray) -> tuple[int, int, int] | None:
        """(edits, start, end) of the closest stretch of ``region`` that is this notice."""
        if self.family == "gpl":  # the lesser licence was called the library licence
            gnu, library, lesser = _hash(("gnu", "library", "lesser"))
            region = region.copy()
            region[1:][(region[1:] == library) & (region[:-1] == gnu)] = lesser
        n, size = len(region), len(self.words)
        cost = np.zeros((size + 1, n + 1), np.int32)
        steps = np.arange(n + 1, dtype=np.int32)
        for i, word in enumerate(self.words, 1):
            new = np.empty(n + 1, np.int32)
            new[0] = i
            np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (region != word), out=new[1:])
            cost[i] = np.minimum.accumulate(new - steps) + steps
        ends = cost[size].copy()
        while ends.min() < size:
            end = int(ends.argmin())
            place, i, j = np.full(size, -2), size, end
            while i:
                if j and cost[i, j] == cost[i - 1, j - 1] + (region[j - 1] != self.words[i - 1]):
                    i, j = i - 1, j - 1
                    if region[j] == self.words[i]:
                        place[i] = j
                elif cost[i, j] == cost[i - 1, j] + 1:
                    i -= 1
                else:
                    j -= 1
            held = sum(place[p] >= 0 and place[p + 1] == place[p] + 1 for p in self.voting)
            whole = held >= self.least and end - j <= self.longest and (place[self.marks] >= 0).all()
            if whole and not np.isin(region[j:end], self.others).any():
                return int(ends[end]), j, end
            ends[j + 1 : end + 1] = size
            ends[end] = size
        return None


def verified_labels(known: list[Template | None], found: list[dict], near: bytes | None) -> set[str]:
    """The labels of the candidates of one text whose words are those of their template."""
    words = np.frombuffer(near or b"", _NEAR_WORDS)
    held = []
    for c in found:
        template = known[c["template"]]
        low, high = c["low"] - template.longest, c["high"] + 2 + template.longest
        a, b = np.searchsorted(words["at"], [low, high])
        # Apart stretches of near words do not touch each other.
        for part in np.split(words[a:b], np.flatnonzero(np.diff(words["at"][a:b]) > 1) + 1):
            if len(part) and (best := template.align(part["word"])):
                at = int(part["at"][0])
                held.append((best[0], at + best[1], at + best[2], template))
    return {
        t.label for edits, start, end, t in held
        if not any(o.family == t.family and o.label != t.label and e < edits and s < end and start < f for e, s, f, o in held)
    }


def _pairs(docs: DataFrame, notices: tuple) -> DataFrame:
    """A row for each pair of words, and one with at = -1 and the number of words for each text.

    The latter holds the words near places where so many pairs of notices stand together that one can be verified.
    """
    noticed = [r for r in template_rows(notices) if not r[1]]
    known = np.unique(np.array([r[3] for r in noticed], np.int64))
    least = min((t.least for t in (Template(*n) for n in notices)), default=0)
    reach = max((2 * t.longest + 2 for t in (Template(*n) for n in notices)), default=0)

    def near(words: list[bytes], pairs: np.ndarray) -> bytes | None:
        if not len(known) or not len(pairs):
            return None
        hits = np.flatnonzero(known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] == pairs)
        if len(hits) < max(least, 1):
            return None
        k = max(least, 1) - 1
        close = np.flatnonzero(hits[k:] - hits[: len(hits) - k] <= reach)
        if not len(close):
            return None
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, np.maximum(hits[close] - reach, 0), 1)
        np.add.at(change, np.minimum(hits[close + k] + 2 + reach, len(words)), -1)
        at = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        out = np.empty(len(at), _NEAR_WORDS)
        out["at"], out["word"] = at, word_hashes([words[i] for i in at.tolist()])
        return out.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for k, (row, doc_id, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True), 1):
                words = text_bytes(text).translate(LETTERS_DIGITS).split()
                pairs = pair_hashes(words) if len(words) > 1 else np.zeros(0, np.int64)
                rows.append((row, doc_id, len(words), pairs, near(words, pairs)))
                size += len(words)
                if size >= _SLICE_WORDS or k == batch.num_rows:
                    counts = np.array([len(r[3]) for r in rows])
                    total = int(counts.sum())
                    at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
                    columns = [
                        pa.array(np.concatenate([np.repeat([r[0] for r in rows], counts), [r[0] for r in rows]]).astype(np.int64)),
                        pa.concat_arrays([pa.nulls(total, pa.int64()), pa.array([r[1] for r in rows], pa.int64())]),
                        pa.array(np.concatenate([at, np.full(len(rows), -1)]).astype(np.int32)),
                        pa.array(np.concatenate([*(r[3] for r in rows), [r[2] for r in rows]]).astype(np.int64)),
                        pa.concat_arrays([pa.nulls(total, pa.binary()), pa.array([r[4] for r in rows], pa.binary())]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "at", "pair", "near"])
                    rows, size = [], 0

    # The row number is read in the one pass over the table, so that it need not be the same in another.
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return named.mapInArrow(run, "row long, doc_id long, at int, pair long, near binary")


def scan_licenses(docs: DataFrame, notices: tuple = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    met = _pairs(docs, notices).join(templates(docs.sparkSession, notices), "pair", "left").filter("template IS NOT NULL OR at = -1")
    diagonals = (
        met.repartition("row")
        .withColumn("diagonal", F.when(F.col("template").isNotNull(), F.col("at") - F.col("place")))
        .groupBy("row", "template", "base", "pairs", "label", "diagonal")
        .agg(
            F.count("*").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"),
            F.max("doc_id").alias("doc_id"), F.max(F.when(F.col("at") == -1, F.col("pair"))).alias("n_words"),
            F.collect_list("place").alias("places"), F.collect_list("near").alias("near"),
        )
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(along) > NEAR
    runs = diagonals.withColumn("far", F.when(F.coalesce(far, F.lit(False)), 1).otherwise(0)).withColumn("run", F.sum("far").over(along))
    is_base = (F.col("base") == 1) & (F.col("votes") == F.col("pairs"))
    matches = runs.groupBy("row", "template", "base", "pairs", "label", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum(F.when(is_base, 1).otherwise(0)).alias("n_base"),
        F.min(F.when(is_base, F.col("diagonal"))).alias("first"), F.max(F.when(is_base, F.col("diagonal"))).alias("last"),
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("near")).alias("near"),
    )
    cover = F.when(F.col("base") == 0, F.col("votes") / F.col("pairs")).when(F.col("n_base") > 0, 1.0)
    candidate = (F.col("base") == 0) & (F.col("votes") >= LEAST_COVER * F.col("pairs"))
    base_label = F.when(F.col("n_base") > 0, F.col("label"))
    voted = matches.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("n_base").cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base_label)), ",").alias("base_labels"),
        F.coalesce(F.max(cover), F.lit(0.0)).alias("score"),
        F.collect_list(F.when(candidate, F.struct("template", "low", "high"))).alias("candidates"),
        F.get(F.flatten(F.collect_list("near")), 0).alias("near"),
    ).drop("row")
    return _verified(voted, notices)


def _verified(voted: DataFrame, notices: tuple) -> DataFrame:
    """Adds the labels of the candidates that are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [None] * len(BASE_PHRASES) + [Template(*n) for n in notices]
        for batch in batches:
            labels = batch.column("base_labels").to_pylist()
            for k in np.flatnonzero(np.asarray(pc.list_value_length(batch.column("candidates")))).tolist():
                found = verified_labels(known, batch.column("candidates")[k].as_py(), batch.column("near")[k].as_py())
                labels[k] = ",".join(sorted(found | set(filter(None, labels[k].split(",")))))
            columns = [pa.array(labels, pa.string()) if n == "labels" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    names = [c.split()[0] for c in schema.split(", ")]
    near = F.when(F.size("candidates") > 0, F.col("near")).alias("near")
    return voted.select(*(n for n in names if n != "labels"), "candidates", near).mapInArrow(run, schema)
