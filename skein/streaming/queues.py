"""Keyed state over streams: bounded queues, count windows, staleness, barriers, upserts and retry queues.

Every operator is a processor for ``transformWithStateInPandas``; order within a key is that of a sequence column,
and freshness is by version and count, not by event time. State is bounded where the operator says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skein.operators.metrics import percentiles

_ROW = "seq long, payload string"


def _rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(frames)
    return pd.concat(parts).sort_values("seq", kind="stable") if parts else pd.DataFrame({"seq": [], "payload": []})


class BoundedQueue(StatefulProcessor):
    """Keeps the last ``size`` rows of a key; when full the oldest is dropped and counted. Emits its statistics."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", _ROW)
        self.counts = handle.getValueState("counts", "produced long, dropped long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.items.get()) if self.items.exists() else []
        produced, dropped = self.counts.get() if self.counts.exists() else (0, 0)
        new = [(int(s), p) for s, p in _rows(rows)[["seq", "payload"]].itertuples(index=False)]
        held = [(int(s), p) for s, p in held] + new
        over = max(0, len(held) - self.size)
        held = held[over:]
        self.items.put(held)
        self.counts.update((produced + len(new), dropped + over))
        yield pd.DataFrame({"uid": [key[0]], "produced": [produced + len(new)], "dropped": [dropped + over], "size": [len(held)], "oldest": [held[0][0] if held else -1]})

    def close(self) -> None:
        pass


END = "\0end"


class CountWindow(StatefulProcessor):
    """Emits rows of a key in batches of exactly ``size``; what is short waits in state.

    A row whose payload is ``END`` says that no more will come: the short rest is emitted then, as the last batch, or
    dropped if ``drop_last``.
    """

    def __init__(self, size: int, drop_last: bool = False):
        self.size, self.drop_last = size, drop_last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", _ROW)
        self.done = handle.getValueState("done", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(s), p) for s, p in self.items.get()] if self.items.exists() else []
        batch = int(self.done.get()[0]) if self.done.exists() else 0
        new = [(int(s), p) for s, p in _rows(rows)[["seq", "payload"]].itertuples(index=False)]
        ended = any(p == END for _, p in new)
        held += [x for x in new if x[1] != END]
        out = []
        while len(held) >= self.size or (ended and held and not self.drop_last):
            out += [(key[0], batch, s, p) for s, p in held[: self.size]]
            held, batch = held[self.size :], batch + 1
        held = [] if ended else held
        if held:
            self.items.put(held)
        else:
            self.items.clear()
        self.done.update((batch,))
        if out:
            yield pd.DataFrame(out, columns=["uid", "batch", "seq", "payload"])

    def close(self) -> None:
        pass


class StalenessGate(StatefulProcessor):
    """Admits up to a budget of rows per version; a newer version starts anew with the rows that still wait.

    The payload is the version. Rows beyond the budget are emitted as paused.
    """

    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "version long, used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        version, used = (int(x) for x in self.seen.get()) if self.seen.exists() else (-1, 0)
        out = []
        for seq, payload in _rows(rows)[["seq", "payload"]].itertuples(index=False):
            if int(payload) > version:
                version, used = int(payload), 0
            admitted = used < self.budget
            used += admitted
            out.append((key[0], int(seq), version, bool(admitted), int(version - int(payload))))
        self.seen.update((version, used))
        if out:
            yield pd.DataFrame(out, columns=["uid", "seq", "version", "admitted", "staleness"])

    def close(self) -> None:
        pass


class KeyedUpsert(StatefulProcessor):
    """Merges rows ``name=value`` into the fields of a key, later ones winning; ``!`` removes the key. Emits the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "name string", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for _, payload in _rows(rows)[["seq", "payload"]].itertuples(index=False):
            if payload == "!":
                self.fields.clear()
            else:
                name, _, value = payload.partition("=")
                self.fields.updateValue((name,), (value,))
        got = sorted((k[0], v[0]) for k, v in self.fields.iterator()) if self.fields.exists() else []
        if got:
            yield pd.DataFrame([(key[0], n, v) for n, v in got], columns=["uid", "name", "value"])

    def close(self) -> None:
        pass


class RetryQueue(StatefulProcessor):
    """Requests of a key by priority, with retries: ``add:<p>``, ``fail``, ``done``. Emits the state after each row.

    A request that is waiting is not added again but keeps the higher priority; a failure waits for the back-off of its
    attempt; done forgets it.
    """

    def __init__(self, base: float = 1.0, cap: float = 60.0):
        self.base, self.cap = base, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "priority long, attempt long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(int(x) for x in self.state.get()) if self.state.exists() else None
        out = []
        for seq, payload in _rows(rows)[["seq", "payload"]].itertuples(index=False):
            kind, _, value = payload.partition(":")
            wait = 0.0
            if kind == "add":
                what, held = ("merged", (max(held[0], int(value)), held[1])) if held else ("added", (int(value), 0))
            elif held is None:
                what = "unknown"
            elif kind == "fail":
                wait = float(min(self.base * 2 ** held[1], self.cap))
                what, held = "retry", (held[0], held[1] + 1)
            else:
                what, held = "done", None
            out.append((key[0], int(seq), what, held[0] if held else -1, held[1] if held else 0, wait))
        if held:
            self.state.update(held)
        else:
            self.state.clear()
        yield pd.DataFrame(out, columns=["uid", "seq", "what", "priority", "attempt", "wait"])

    def close(self) -> None:
        pass


class StepBarrier(StatefulProcessor):
    """Holds the rows ``session:status`` of a step until none is running, then emits the successful ones once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getMapState("status", "session string", "status string")
        self.sent = handle.getValueState("sent", "done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for _, payload in _rows(rows)[["seq", "payload"]].itertuples(index=False):
            session, _, status = payload.rpartition(":")
            self.status.updateValue((session,), (status,))
        now = {k[0]: v[0] for k, v in self.status.iterator()} if self.status.exists() else {}
        if now and not self.sent.exists() and "running" not in now.values():
            self.sent.update((True,))
            good = sorted(s for s, v in now.items() if v == "success")
            if good:
                yield pd.DataFrame({"uid": key[0], "session": good})

    def close(self) -> None:
        pass


class DedupQueue(StatefulProcessor):
    """Accepts a request ``fingerprint`` of a key once: the same again is a repeat, another one a conflict.

    With ``ttl_ms`` a fingerprint is forgotten that long after its key was last seen, which bounds the state.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "fingerprint string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.known.get()[0] if self.known.exists() else None
        out = []
        for seq, payload in _rows(rows)[["seq", "payload"]].itertuples(index=False):
            verdict = "accepted" if known is None else "repeat" if payload == known else "conflict"
            known = payload if known is None else known
            out.append((key[0], int(seq), verdict))
        self.known.update((known,))
        if out:
            yield pd.DataFrame(out, columns=["uid", "seq", "verdict"])

    def close(self) -> None:
        pass


OUTPUTS = {
    BoundedQueue: "uid string, produced long, dropped long, size long, oldest long", CountWindow: "uid string, batch long, seq long, payload string",
    StalenessGate: "uid string, seq long, version long, admitted boolean, staleness long", KeyedUpsert: "uid string, name string, value string",
    RetryQueue: "uid string, seq long, what string, priority long, attempt long, wait double", StepBarrier: "uid string, session string", DedupQueue: "uid string, seq long, verdict string",
}


def run_keyed(stream: DataFrame, processor: StatefulProcessor, key: str = "uid", mode: str = "Append") -> DataFrame:
    """Applies a processor to a stream of (key, seq, payload)."""
    rows = stream.select(F.col(key).cast("string").alias("uid"), F.col("seq").cast("long"), F.col("payload").cast("string"))
    clock = "ProcessingTime" if getattr(processor, "ttl_ms", None) else "None"
    return rows.groupBy("uid").transformWithStateInPandas(processor, OUTPUTS[type(processor)], mode, clock)


def collect_stream(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and reads back its rows."""
    query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)


def write_steps(stream: DataFrame, root: str, checkpoint: str):
    """Writes each micro-batch of rows with ``phase`` and ``step`` over their own step files."""
    from skein.sources.writers import write_step

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _n: write_step(df, root)).trigger(availableNow=True).start()


def staleness_budget(required: int, threshold: float, sync_steps: int) -> int:
    return int(required * (threshold + 1) * sync_steps)


def paused(queued: Column, size: int, stale: Column, budget: int) -> Column:
    """Whether production waits: the queue is full, or as many rows are under way as staleness allows."""
    return (queued >= size) | (stale >= budget)


def stale_count(df: DataFrame, version: str, current: Column | int) -> DataFrame:
    now = F.lit(current) if isinstance(current, int) else current
    return df.agg(F.count_if(now - F.col(version) >= 1).alias("stale"), F.count("*").alias("rows"))


def assembly_stats(df: DataFrame, batch: str = "batch", seconds: str = "seconds", version: str = "version") -> DataFrame:
    """Per batch: processing times and the spread of versions, with the share of rows that span several."""
    plain = df.groupBy(batch).agg(F.count("*").alias("n"), F.count_distinct(version).alias("versions"), (F.max(version) - F.min(version)).alias("span"))
    return plain.join(percentiles(df, seconds, batch).drop("n"), batch).select(batch, "n", "avg", "max", "min", "p50", "p95", "p99", "versions", "span")


def backoff_seconds(attempt: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt), F.lit(float(cap)))


def service_order(df: DataFrame, now: float, most: int) -> DataFrame:
    """The next requests to serve: ready ones, urgent before normal, first come first."""
    return df.filter(F.col("ready_at") <= now).orderBy(F.desc("priority"), "enqueued_at", "container_id").limit(most)
