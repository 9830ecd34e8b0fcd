"""A provider cache as stateful streaming: fresh, stale and negative entries, answered in event time.

Keys are dealt by hash into ``SHARDS`` shards, and a shard is what has state: a
call to the state costs the same for one row as for many, and is made for a
shard's rows of a batch together, packed as Arrow. A batch appends its rows and
doesn't touch those that wait already.

Requests of a key wait in its shard until the watermark has passed them, so
files and batches may come in any order; then they are answered one after
another, as a cache at that time would have. ``lateness`` says how far behind
the newest request one may still come; what is later than that is dropped. A
key's entry stays as a stale one when it has expired, for ``keep`` seconds if
that is given, until an event-time timer forgets it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.serving import TTL_SECONDS
from .streams import folder, run

REQUEST = "key string, at timestamp, id bigint, provider string, failed boolean, items int, own int"
ANSWER = "id bigint, key string, provider string, status string, source string, items int, available boolean"

#: What a status names as its source.
PROVIDER, DATASET = "Yahoo Finance via yfinance", "Committed demo dataset"
STALE, CACHE = f"{PROVIDER} (stale cache)", f"{PROVIDER} (cache)"

#: Shards of keys. A checkpoint belongs to one number of them.
SHARDS = 1024


class Entry(NamedTuple):
    stored: int  # microseconds
    items: int
    source: str


def answer(provider: str, entry: Entry | None, at: int, failed: bool, items: int, own: int, ttl: int) -> tuple[str, str, int, Entry | None]:
    """Status, source, items and the entry afterwards. Times and ``ttl`` are microseconds; an entry is expired if its age is more than ``ttl``.

    Headlines fall back to ``own`` rows of the dataset, and an empty answer is
    cached for them even after an error. Fundamentals and history cache empty
    answers of a working provider only.
    """
    if entry and at - entry.stored <= ttl:
        return "cached" if entry.items else "unavailable", entry.source if provider == "headlines" else CACHE, entry.items, entry
    if failed and entry:
        return "fallback", STALE, entry.items, entry
    if provider == "headlines" and own and (failed or not items):
        return "cached", DATASET, own, Entry(at, own, DATASET)
    if failed:
        return "unavailable", PROVIDER, 0, Entry(at, 0, PROVIDER) if provider == "headlines" else None
    return "live" if items else "unavailable", PROVIDER, items, Entry(at, items, PROVIDER)


def packed(rows) -> bytes:
    """An Arrow table as bytes."""
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


class ProviderCache(StatefulProcessor):
    """Requests of one shard's keys in, answers out."""

    def __init__(self, ttl: int, keep: int | None = None) -> None:
        self.ttl, self.keep = ttl * 1_000_000, None if keep is None else keep * 1_000_000

    def init(self, handle) -> None:
        import pyarrow as pa

        self.handle = handle
        self.schema = pa.schema([("key", pa.string()), ("micros", pa.int64()), ("id", pa.int64()), ("provider", pa.string()), ("failed", pa.bool_()), ("items", pa.int32()), ("own", pa.int32())])
        self.kept = pa.schema([("key", pa.string()), ("stored", pa.int64()), ("items", pa.int32()), ("source", pa.string())])
        self.waiting = handle.getListState("waiting", "rows binary")
        self.entries = handle.getValueState("entries", "rows binary")
        self.due = handle.getValueState("due", "at bigint")  # the earliest request that waits

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        watermark = timerValues.getCurrentWatermarkInMs()
        new = [pa.Table.from_pandas(frame[self.schema.names], self.schema, preserve_index=False) for frame in rows]
        self.waiting.appendList([(packed(table),) for table in new])
        first = min((at for at in (pc.min(table["micros"]).as_py() for table in new) if at is not None), default=None)
        before = self.due.get()
        if first is not None and (before is None or first < before[0]):
            self.due.update((first,))
            self._wake(first, watermark)
        if first is not None and first <= watermark * 1000:
            yield from self._settle(watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield from self._settle(timerValues.getCurrentWatermarkInMs())

    def _wake(self, micros: int, watermark: int) -> None:
        self.handle.registerTimer(max(-(-micros // 1000), watermark + 1))

    def _settle(self, watermark: int) -> Iterator:
        """Answer what the watermark has passed; the rest waits for its timer."""
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        waiting = pa.concat_tables([self.schema.empty_table(), *(pa.ipc.open_stream(row[0]).read_all() for row in self.waiting.get())])
        passed = pc.fill_null(pc.less_equal(waiting["micros"], watermark * 1000), False)
        keys: dict = {}
        for name, *request in zip(*(c.to_pylist() for c in waiting.filter(passed).columns)):
            keys.setdefault(name, []).append(tuple(request))
        held = self.entries.get()
        entries = {name: Entry(*entry) for name, *entry in zip(*(c.to_pylist() for c in pa.ipc.open_stream(held[0]).read_all().columns))} if held else {}
        out = []
        for name, requests in keys.items():
            entry = entries.get(name)
            for at, number, provider, failed, items, own in sorted(requests):
                if entry and self.keep is not None and at - entry.stored > self.keep:
                    entry = None
                status, source, count, entry = answer(provider, entry, at, failed, items, own, self.ttl)
                out.append((number, name, provider, status, source, count, count > 0))
            entries[name] = entry
        entries = {name: e for name, e in entries.items() if e and (self.keep is None or e.stored + self.keep >= watermark * 1000)}
        if entries:
            columns = [list(entries), *map(list, zip(*entries.values()))]
            self.entries.update((packed(pa.table(columns, schema=self.kept)),))
        elif held:
            self.entries.clear()
        rest = waiting.filter(pc.invert(passed))
        if len(rest):
            if keys:
                self.waiting.put([(packed(rest.slice(at, 10_000)),) for at in range(0, len(rest), 10_000)])
            first = pc.min(rest["micros"]).as_py()
        else:
            self.waiting.clear()
            first = None
        if first is not None:
            self.due.update((first,))
            self._wake(first, watermark)
        elif self.due.exists():
            self.due.clear()
        if entries and self.keep is not None:
            self._wake(min(e.stored for e in entries.values()) + self.keep + 1000, watermark)
        yield pd.DataFrame(out, columns=["id", "key", "provider", "status", "source", "items", "available"]).astype({"id": "int64", "items": "int32", "available": "bool"})

    def close(self) -> None:
        pass


@contextmanager
def several_states(spark: SparkSession):
    """Processors with more than one state need the RocksDB store; the session's own choice comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def answers(spark: SparkSession, requests: DataFrame, lateness: str, ttl: int = TTL_SECONDS, keep: int | None = None, label: str = "cache") -> DataFrame:
    """All answers to a stream of ``REQUEST`` rows that is read to its end.

    The run goes over what is there, then takes up its checkpoint again with a
    closing mark far in the future, which lets the watermark pass all that waits.
    """
    marks, out, state = (folder(spark, f"{label}-{name}") for name in ("marks", "out", "state"))
    none = spark.createDataFrame([], REQUEST)
    none.write.parquet(marks)
    own = spark.readStream.schema(none.schema).parquet(marks)
    both = requests.select(*none.columns).unionByName(own).withWatermark("at", lateness).withColumn("micros", F.unix_micros("at"))
    with several_states(spark):
        found = both.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(SHARDS))).groupBy("shard").transformWithStateInPandas(ProviderCache(ttl, keep), ANSWER, "append", "eventTime")
        for mark in (False, True):
            if mark:
                spark.sql("SELECT '' AS key, timestamp'2200-01-01' AS at, -1L AS id, '' AS provider, false AS failed, 0 AS items, 0 AS own").write.mode("append").parquet(marks)
            run(found.writeStream.outputMode("append").format("parquet").option("path", out), spark, label, state)
    return spark.read.schema(ANSWER).parquet(out)
