"""Keyed state over file streams, one micro-batch a file."""

import pytest
from pyspark.sql import functions as F

from skein.streaming import queues


@pytest.fixture
def run(spark, tmp_path):
    def go(processor, batches, mode="append"):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, "uid string, seq long, payload string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema("uid string, seq long, payload string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        out = queues.run_keyed(stream, processor)
        return [tuple(r) for r in queues.collect_stream(out, f"{tmp_path}/out", f"{tmp_path}/ck").collect()]

    return go


def test_bounded_queue(run):
    got = run(queues.BoundedQueue(3), [[("a", 1, "x"), ("a", 2, "x")], [("a", 3, "x"), ("a", 4, "x"), ("a", 5, "x")]])
    assert sorted(got) == [("a", 2, 0, 2, 1), ("a", 5, 2, 3, 3)]


def test_count_window(run):
    got = run(queues.CountWindow(2), [[("a", 1, "p"), ("b", 1, "p")], [("a", 2, "q"), ("a", 3, "r")]])
    assert sorted(got) == [("a", 0, 1, "p"), ("a", 0, 2, "q")]


def test_staleness_gate(run):
    got = run(queues.StalenessGate(2), [[("a", 1, "0"), ("a", 2, "0"), ("a", 3, "0")], [("a", 4, "1"), ("a", 5, "0")]])
    assert sorted(got) == [("a", 1, 0, True, 0), ("a", 2, 0, True, 0), ("a", 3, 0, False, 0), ("a", 4, 1, True, 0), ("a", 5, 1, True, 1)]


def test_upsert_and_barrier_and_dedup(run):
    got = run(queues.KeyedUpsert(), [[("a", 1, "s=1"), ("a", 2, "t=2")], [("a", 3, "s=9")]])
    assert ("a", "s", "9") in got and ("a", "t", "2") in got


def test_barrier(run):
    got = run(queues.StepBarrier(), [[("7", 1, "x:running"), ("7", 2, "y:success")], [("7", 3, "x:success"), ("7", 4, "z:failed")]])
    assert sorted(got) == [("7", "x"), ("7", "y")]


def test_dedup(run):
    got = run(queues.DedupQueue(), [[("k", 1, "f")], [("k", 2, "f"), ("k", 3, "g")]])
    assert sorted(got) == [("k", 1, "accepted"), ("k", 2, "repeat"), ("k", 3, "conflict")]


def test_helpers(spark):
    assert queues.staleness_budget(4, 0.5, 2) == 12
    df = spark.createDataFrame([("a", 1, 5.0, 0.0), ("b", 2, 6.0, 0.0), ("c", 2, 4.0, 99.0)], "container_id string, priority int, enqueued_at double, ready_at double")
    assert [r.container_id for r in queues.service_order(df, 10.0, 5).collect()] == ["b", "a"]
    assert spark.range(8).select(queues.backoff_seconds(F.col("id")).alias("s")).agg(F.max("s")).first()[0] == 60.0
