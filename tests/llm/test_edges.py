"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from skein.llm import decontaminate, langid, licenses, media, mixing, neardup, quality, secrets, substring, toxicity
from skein.llm.common import crc_remainder

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, target double, score double, node long, "
    "key string, value long, row long, chunk long, held_out boolean, kept boolean, h long, y int, hub long, component long"
)
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards hum and quietly box with jovial elves near old mills"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, 7, -1, -1.0, -1.0, 5, "k", 3, 9, 1, None, None, 2, 1, 8, 6)


ROWS = [
    row(1, PROSE), row(2, PROSE.upper()), row(3, None, None, None), row(4, ""), row(5, " \t\n "), row(6, LONG), row(6, LONG),
    row(7, "Un été à la mer", "fr", None), row(8, "x", None), row(None, PROSE + " tail", None, "b"), row(9, "\x00 \x1f odd"), row(10, "🙂 12 34"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, 1, 0), (None, 1, 1), (8, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")


def test_media(docs, none):
    got = media.text_media(docs).collect()
    assert len(got) == len(ROWS) and media.text_media(none).count() == 0
    for r, text in ((r, t) for r in got for i, t, *_ in ROWS if i == r.doc_id):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(media.store_text(text)).hexdigest() and r.media_bytes == len(media.store_text(text))


def test_toxicity(docs, none, labels):
    model = toxicity.train(docs, labels, F.lit(True))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.score(none, toxicity.train(none, labels.limit(0), F.lit(True))).count() == 0
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_quality(docs, none, labels):
    model = quality.train(docs, labels, F.lit(True))
    got = quality.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1 and len({r.score for r in got if r.doc_id == 6}) == 1
    assert quality.score(none, quality.train(none, labels, F.lit(True))).count() == 0
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0), F.lit(True))).collect()} == {0.0}


def test_language(docs, none):
    model = langid.train(docs, F.lit(True))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(ROWS)
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 10)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(docs, langid.train(none, F.lit(True))).collect()} == {"und"}


def test_substring(docs, none):
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert substring.remove_repeats(docs).count() == len(ROWS) and substring.remove_repeats(none).count() == 0
    assert got[1].n_removed == 0 and got[2].n_removed == 0 and bytes(got[1].kept).decode() == PROSE
    assert got[3].n_words == 0 and bytes(got[3].kept) == b"" and got[6].n_removed == 0 and got[None].n_removed == 0
    copies = docs.sparkSession.createDataFrame([(1, PROSE), (2, "intro " + PROSE + " outro"), (3, PROSE)], "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in substring.remove_repeats(copies).collect()} == {
        1: (0, PROSE.encode()), 2: (len(PROSE.split()), b"intro outro"), 3: (len(PROSE.split()), b"")
    }


def test_near_duplicates(docs, none):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert got[2].component_id == 1 and not got[2].kept and got[1].kept and got[6].kept
    assert all(got[i].n_shingles == 0 and got[i].kept and got[i].component_id == i for i in (3, 4, 5))
    assert got[8].n_shingles == 1 and got[None].component_id is None and got[None].kept
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.first_of_groups(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "None", "9", "10"])


def test_mixing(docs, none):
    mixed = mixing.mix_sources(docs)
    got = mixed.collect()
    assert len(got) == len(ROWS) and mixing.mix_sources(none).count() == 0
    assert all(r.taken == r.copies * r.size and r.taken <= 3 * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    assert mixing.emit_copies(mixed).count() == sum(r.copies for r in got)
    ties = docs.sparkSession.createDataFrame([(7, f"{k} b", "s") for k in range(30)] + [(None, f"{k} b", "t") for k in range(30)], "doc_id long, text string, source string")
    first = sorted(map(str, mixing.emit_copies(mixing.mix_sources(ties)).collect()))
    assert first == sorted(map(str, mixing.emit_copies(mixing.mix_sources(ties.repartition(7, "text"))).collect()))


def test_pipeline(docs, none, spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    tables = {
        "labels": spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, PROSE), (2, None)], "item_id long, text string"),
    }
    for name, rows in (("full", docs), ("empty", none)):
        for table, df in (tables | {"documents": rows}).items():
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {"doc_id", "text", "source", "copy"} <= set(got.columns)
        ids = {r.doc_id for r in got.collect()}
        assert not ids & {1, 2, None} and ids <= {3, 4, 5, 6, 7, 8, 9, 10} and (ids if name == "full" else not ids)


def test_secrets(docs, none):
    text = 'say token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 end'
    with_secret = docs.limit(2).withColumn("text", F.lit(text))
    found = secrets.scan_secrets(with_secret).collect()
    assert [(r.start_byte, r.n_bytes, r.kind) for r in found] == [(13, 40, "hex")] * 2
    clean = secrets.redact(with_secret).first()
    assert clean.text == text.replace("04dbebab91ab85687d33eeaaf9ac699e1188f962", "[SECRET]", 1) and clean.n_chars == len(clean.text)
    assert secrets.scan_secrets(docs).count() == 0 and secrets.scan_secrets(none).count() == 0
    assert secrets.redact(docs).exceptAll(docs).count() == 0


HEX = "9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c04dbebab"
VALUES = [
    ("API_KEY=", HEX), ("token=", HEX), ("PASSWORD=", "Abc123def456Ghi789"), ("TOKEN=", "ghp_abcdefghijKLMNOPqrstuvwxyz0123456789"),
    ("api_key==", HEX), ("secret=", "YWJjZGVmZ2hpamtsbW5vcHFyMTIzNA=="), ('password = "', "abcDEF1234567890ab!xyz.q9"),
    ("Authorization: Bearer ", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"),
    ("https://a.org/b?page=2&token=", HEX), ("(token=", HEX),
]


@pytest.mark.parametrize(("name", "value"), VALUES)
def test_assigned_secrets(name, value):
    after = {"h": "&x=1 end", "(": ") end"}.get(name[0], '" end' if name[-1] == '"' else " end")
    data = f"say {name}{value}{after}".encode()
    found = secrets.find(data, secrets.default_forest())
    assert [data[s:e].decode() for s, e, _ in found] == [value]
    assert not secrets.find(f"commit={HEX} end".encode(), secrets.default_forest())


@pytest.mark.parametrize(("name", "value"), [("token = ", "ab!9" * 80), ("SECRET_ACCESS_KEY_FOR_PRODUCTION=", "aB3!xY7.qZ9")])
def test_long_values_and_names(name, value):
    data = f"say {name}{value} end".encode()
    assert [data[s:e].decode() for s, e, _ in secrets.find(data, secrets.default_forest())] == [value]


def test_decontaminate(docs, none, spark):
    items = spark.createDataFrame([(1, PROSE), (2, None), (3, "x"), (4, "one two three four five six")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.benchmark_hits(docs, items).collect()}
    assert got == {(1, 1, 0), (2, 1, 0), (None, 1, 0), (8, 3, 0)}
    clean = decontaminate.without_benchmark(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 4
    assert decontaminate.benchmark_hits(none, items).count() == 0 and decontaminate.benchmark_hits(docs, items.limit(0)).count() == 0


def test_licenses(docs, none, spark):
    text = "x Apache License, then the MIT license; CC BY. MIT LICENSE"
    got = licenses.scan_licenses(docs.limit(1).withColumn("text", F.lit(text))).first()
    assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels) == (11, 4, 1, 9, "apache,cc-by,mit") and got.score == 1.0
    rest = licenses.scan_licenses(docs).collect()
    assert len(rest) == len(ROWS) and all(r.n_base == 0 and r.first_word is None and r.labels == "" and r.score == 0 for r in rest)
    assert licenses.scan_licenses(none).count() == 0
    notice = licenses.NOTICES[4][0].replace("charge", "any charge")
    own = licenses.scan_licenses(docs.limit(1).withColumn("text", F.lit("so " + notice + " then"))).first()
    assert own.base_labels == "" and own.labels == "mit" and 0.6 <= own.score <= 1


def test_license_variants(docs, spark):
    gpl, lgpl = (n[0] for n in licenses.NOTICES[:2])
    texts = {
        gpl: "gpl", lgpl: "lgpl", gpl.replace("gnu general", "gnu affero general"): "", lgpl.replace("lesser", "library"): "lgpl",
        gpl.replace("gnu general public", "artistic"): "", gpl + " or " + lgpl: "gpl,lgpl", "free software " * 14: "",
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc", "licensed under CC BY 4.0": "cc-by", "licensed under CC BY-NC-SA 4.0": "cc-by",
        "so " * 99 + gpl.replace("can", "may") + " free software" * 14: "gpl", " ".join(gpl.split()[::-1]): "",
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(rows).collect()}
    assert [got[k].labels for k in range(len(texts))] == list(texts.values())
    assert got[6].score < 0.6


def test_folds(docs):
    got = docs.select("doc_id", crc_remainder("doc_id", 5).alias("r")).collect()
    assert all(r.r is None if r.doc_id is None else r.r == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)
