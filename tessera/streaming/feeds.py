"""Change feeds: latest-only slots, change batches into an index store, coalescing, readiness and progress."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from ..operators.catalog import difference


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: an aggregate with partial results, not a window, so a hot key costs no sort."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*key).agg(best.alias("_b")).select("_b.*")


def in_lanes(rows: DataFrame, lane: str, order: list[str]) -> DataFrame:
    """Rows dealt so that each lane is in one task, in order: for sinks that must see a lane's rows one after another.

    A lane is as serial as its order asks for; lanes run side by side.
    """
    return rows.repartition(lane).sortWithinPartitions(lane, *order)


#: Keys of the state that slots are dealt over by hash. Calls to Python are one a key and batch, however many slots it has.
BUCKETS = 256


class _Slots(StatefulProcessor):
    """The newest submission of each slot of a bucket. With times, a slot is forgotten `keep` ms after its last submission, by a
    timer on event time, which stands at the bucket's least; without, `keep` ms after it on the clock."""

    def __init__(self, keep: int | None, timed: bool):
        self.keep, self.timed = keep, timed

    def init(self, handle) -> None:
        self.handle = handle
        lives = {} if self.timed or self.keep is None else {"ttlDurationMs": self.keep}
        self.state = handle.getValueState("slots", "lanes array<string>, keys array<string>, seqs array<bigint>, dues array<bigint>, timer bigint", **lives)

    def _load(self) -> tuple[dict, int | None]:
        """{(lane, key): (seq, due)} and the timer."""
        if not self.state.exists():
            return {}, None
        lanes, keys, seqs, dues, timer = self.state.get()
        return dict(zip(zip(lanes, keys), zip(seqs, dues))), timer

    def _store(self, slots: dict, timer: int | None) -> None:
        least = min((due for _, due in slots.values()), default=None) if self.timed and self.keep is not None else None
        if least != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if least is not None:
                self.handle.registerTimer(least)
        if slots:
            self.state.update(([x for x, _ in slots], [x for _, x in slots], [x for x, _ in slots.values()], [x for _, x in slots.values()], least))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues):
        slots, timer = self._load()
        clock = None
        if self.keep is not None and not self.timed:
            clock = timerValues.getCurrentProcessingTimeInMs()
            slots = {k: x for k, x in slots.items() if x[1] > clock}
        newer = {}
        for pdf in rows:
            # Text columns give None for null; times are there whenever slots end by them.
            times = pdf["ms"].tolist() if self.timed else [clock] * len(pdf)
            for lane, name, seq, ms in zip(pdf["lane"].tolist(), pdf["key"].tolist(), pdf["seq"].tolist(), times):
                top, due = slots.get((lane, name), (None, None))
                ends = None if self.keep is None else ms + self.keep
                if top is None or seq > top:
                    top = newer[lane, name] = seq
                slots[lane, name] = top, ends if due is None else max(due, ends)
        self._store(slots, timer)
        if newer:
            yield _told("kept", newer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        slots, timer = self._load()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        mark = timerValues.getCurrentWatermarkInMs()
        over = {k: seq for k, (seq, due) in slots.items() if due <= mark}
        # The timer that went off is no longer there to be deleted.
        self._store({k: x for k, x in slots.items() if k not in over}, None)
        if over:
            yield _told("expired", over)

    def close(self) -> None:
        pass


def _told(kind: str, slots: dict) -> pd.DataFrame:
    return pd.DataFrame({"kind": [kind] * len(slots), "lane": [lane for lane, _ in slots], "key": [key for _, key in slots], "seq": list(slots.values())})


def latest_stream(stream: DataFrame, lane: str, key: str, seq: str, at: str | None = None, keep_ms: int | None = None, late_ms: int = 0) -> DataFrame:
    """(kind, lane, key, seq): submissions that are newer than all before them in their slot; stale ones are dropped.

    State is one row per bucket of slots, BUCKETS by hash, kept in RocksDB (the session must name that provider; rocksdb() does):
    a checkpoint stays with the number it began with. A bucket that gets rows is read and written whole. keep_ms bounds how long:
    with a column of event times `at`, a slot expires (kind 'expired') once the watermark, late_ms behind the latest time, is
    keep_ms past its last submission, and rows behind the watermark are dropped as late; without one, state lives keep_ms
    on the clock. Rows without a number or, where there is one, a time are left out.
    """
    s = stream.select(F.col(lane).cast("string").alias("lane"), F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), *([F.col(at).cast("timestamp").alias("at")] if at else []))
    if at:
        s = s.where("at is not null and seq is not null").withColumn("ms", F.unix_millis("at")).withWatermark("at", f"{late_ms} milliseconds")
    else:
        s = s.where("seq is not null")
    mode = "EventTime" if at else "ProcessingTime" if keep_ms is not None else "None"
    s = s.withColumn("bucket", F.pmod(F.xxhash64("lane", "key"), F.lit(BUCKETS)).cast("int"))
    return s.groupBy("bucket").transformWithStateInPandas(_Slots(keep_ms, at is not None), "kind string, lane string, key string, seq long", "Append", mode)


def window_counts(stream: DataFrame, at: str, every: str, late: str, *keys: str) -> DataFrame:
    """(start, *keys, n) of tumbling windows, each told once, when the watermark (late behind the latest time) has passed its
    end. Rows whose window was told before the batch before are late and left out."""
    t = stream.withWatermark(at, late).groupBy(F.window(at, every), *keys).agg(F.count("*").alias("n"))
    return t.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, number: str, at: str, by: str, gap: str, late: str) -> DataFrame:
    """(by, start, last, n) of runs of rows less than a gap apart, each told once, when the watermark has passed its end. A row
    that comes again within the time that rows may be late counts once; its number is forgotten after that."""
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([number])
    t = once.groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"), F.max(at).alias("last"))
    return t.select(by, F.col("session_window.start").alias("start"), "last", "n")


def rocksdb(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB with changelogs; the caller's stays as it is."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    return own


def maintain(stream: DataFrame, store, checkpoint: str, to_files: Callable[[DataFrame], DataFrame] | None = None):
    """Start a query that applies each micro-batch of change events to an IndexStore, then ends when all is read.

    Events: op, file_id, seq and the columns extractors read. Of several events of a file in a batch the last counts.
    The store swaps snapshots atomically, and notes checkpoint and number of the batch with each: a batch that is run again
    after it was published, as happens when the query dies before its own commit, changes nothing.
    """

    def one(batch: DataFrame, number: int):
        last = latest(batch, ["file_id"], ["seq"]).persist()
        changed = last.where("op <> 'deleted'").drop("op", "seq")
        store.apply(to_files(changed) if to_files else changed, last.where("op = 'deleted'").select("file_id"), batch=(checkpoint, number))
        last.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush(*queries, store=None) -> int | None:
    """Wait until running queries have worked off all that had come in before; with a store, the number of the manifest that
    then holds it. Batch writes to a store are done when they return."""
    for q in queries:
        if q.isActive:
            q.processAllAvailable()
        if q.exception() is not None:
            raise q.exception()
    return store.manifest()["number"] if store is not None else None


def fan_out(stream: DataFrame, listeners: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Every micro-batch to each listener in turn; the batch is read once."""

    def one(batch: DataFrame, n: int):
        batch = batch.persist()
        for f in listeners:
            f(batch, n)
        batch.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll(old: DataFrame, new: DataFrame, **how) -> DataFrame:
    """Events between two listings, renames first, then created, changed and deleted."""
    order = F.array_position(F.array(*map(F.lit, ("renamed", "created", "changed", "deleted"))), F.col("op"))
    return difference(old, new, **how).orderBy(order, "uri")


def read_in_batches(spark: SparkSession, path: str, schema, files: int, glob: str | None = None) -> DataFrame:
    """A stream over a folder of Parquet that takes so many files a micro-batch."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(path)


class Readiness:
    """Counts work in progress; callbacks wait until none is left."""

    def __init__(self):
        self.open, self.waiting = 0, []

    def __enter__(self):
        self.open += 1
        return self

    def __exit__(self, *_):
        self.open -= 1
        while not self.open and self.waiting:
            self.waiting.pop(0)()

    @property
    def ready(self) -> bool:
        return self.open == 0

    def when_ready(self, fn: Callable[[], None]) -> None:
        if self.ready:
            fn()
        else:
            self.waiting.append(fn)


class Progress(StreamingQueryListener):
    """Rows and batches seen by streaming queries; notify is called at most once per `every_ms`."""

    def __init__(self, notify: Callable[[dict], None] | None = None, every_ms: int = 100):
        self.rows, self.batches, self.running, self.notify, self.every_ms, self._last = 0, 0, 0, notify, every_ms, 0.0

    def snapshot(self) -> dict:
        return {"running": self.running, "batches": self.batches, "rows": self.rows}

    def onQueryStarted(self, event):
        self.running += 1

    def onQueryProgress(self, event):
        import time

        self.rows += event.progress.numInputRows
        self.batches += 1
        now = time.monotonic() * 1000
        if self.notify and now - self._last >= self.every_ms:
            self._last = now
            self.notify(self.snapshot())

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.running -= 1
