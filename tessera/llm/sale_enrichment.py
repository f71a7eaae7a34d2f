"""Sales enriched with the version of their client that was valid when they were sold: a streaming query with state.

The tables are cut into batches of arrival, written, and fed in order to one streaming query that is started anew for every
batch on one checkpoint. Its stage is keyed by client. It accepts a batch's changes, holds sales until H, the smaller of the two
tables' watermarks, has passed them, answers those that are released from the versions it holds, and prunes only then.

    sales   -> pack -+
    changes -> pack -+-> versions and waiting sales (key: slot of the client) -> parquet

A key stands for many clients: it has about KEY_ROWS rows of the whole table, so one call of Python serves thousands of them in
arrays. A client with more than SLICE_ROWS rows (or a 600th of all rows, where that is more, so there are at most 600 such) has
slots of its own, one a slice of time with about as many rows each, so its rows are dealt over many keys and tasks.
A slice answers from its own versions and reports its head (count, last version, whether it still
holds one at or before H); what earlier and later slices mean for a sale follows from the heads of its client, at most
SLICES a batch, by a join on client, batch and slice. Nothing that grows with the input meets in one task, reaches the
driver (12 pairs of watermarks do) or is broadcast (600 clients with SLICES bounds each are).

State lies in maps that a task reads from the checkpoint and drops when it commits: a partition has one key's rows or few, so its
state is small, and nothing of a start outlives it in an executor. (RocksDB, which transformWithState asks for, leaves native
memory behind with every store that is opened, and each start opens all of them anew.)

Every start has its batch, H and the changes' watermark as parameters, computed from the written batches; a start that is
repeated after a failure reads the same files from its checkpoint's log and gives the same rows once. Rows that only wake a
key let empty batches, waiting sales and pruning take their turn.

Defined results: a null sold_at is released at once and finds no version; a sale with a null client has none. Rows of sales
that repeat are sales each; changes that repeat in all columns are one. A null valid_at is left out, a null client of a
change makes a version that no sale finds. Versions of equal valid_at and change_id stand in order of balance and op. A null
arrival counts for the last batch, one before the first day for the first. Null balances and ops are passed on as null. Empty
tables give no rows; extra columns are not read (but tell changes apart).
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..storage import forget_path
from .common import forget, fresh_path, load, saved, shuffle_parts

BATCHES, FIRST_DAY, DAYS, DELAY_DAYS = 12, 19723, 152, 4
#: Rows of both tables that share a key.
KEY_ROWS = 40_000
#: Rows of a slice of a client's time, and slices of a client at most.
SLICE_ROWS, SLICES = 20_000, 256
#: No client is sliced with less than this share of all rows.
HOT_SHARE = 600
#: Rows packed at once by a task.
PACKED = 400_000

_NEVER = -(1 << 62)
_SALE, _CHANGE = "slot long, id long, client long, at long, wake boolean", "slot long, id long, client long, at long, cents long, op string, wake boolean"
_PACKED = "slot long, kind string, rows binary, names array<string>"
RESULT = "rec string, id long, batch long, n_held long, change_id long, balance_cents long, op string, client long, at long, slot long, held boolean, n_low long"


def arrival(day, late=0):
    """The batch of a day since 1970."""
    n = F.floor((day + late - FIRST_DAY) * F.lit(BATCHES) / F.lit(DAYS)).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(BATCHES - 1).cast("long"), n))


def _day(at):
    return F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date"))


def _micros(at: str) -> Column:
    """Microseconds since 1970 as the clock says, whatever the session's zone."""
    hours = F.lit(24).cast("long") * _day(at) + F.hour(at)
    return (hours * 60 + F.minute(at)) * 60_000_000 + (F.expr(f"extract(SECOND FROM {at})") * 1_000_000).cast("long")


def batched(sales: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch, id, client, at) of sales; (batch, id, client, at, cents, op) of distinct changes."""
    s = sales.select(arrival(_day("arrived_at")).alias("batch"), F.col("sale_id").cast("long").alias("id"), F.col("client_id").cast("long").alias("client"), _micros("sold_at").alias("at"))
    jitter = F.crc32(F.col("change_id").cast("string").cast("binary")) % DELAY_DAYS
    c = changes.where("valid_at is not null").distinct().select(
        arrival(_day("valid_at"), jitter).alias("batch"), F.col("change_id").cast("long").alias("id"), F.col("client_id").cast("long").alias("client"), _micros("valid_at").alias("at"),
        F.floor(F.col("balance") * 100 + 0.5).cast("long").alias("cents"), F.col("op").cast("string").alias("op"),
    )
    return s, c


def watermarks(s: DataFrame, c: DataFrame) -> tuple[list[tuple[int, int]], int]:
    """(H, the changes' watermark) of every batch, from 2 x 12 numbers; and the rows of both tables."""

    def of(df):
        rows = df.groupBy("batch").agg(F.max("at").alias("most"), F.count("*").alias("n")).collect()
        most = {r["batch"]: r["most"] for r in rows if r["most"] is not None}
        out, now = [], _NEVER
        for k in range(BATCHES):
            out.append(now)
            now = max(now, most.get(k, _NEVER))
        return out, sum(r["n"] for r in rows)

    (a, m), (b, n) = of(s), of(c)
    return [(min(x, y), y) for x, y in zip(a, b)], m + n


def sliced(s: DataFrame, c: DataFrame, rows: int) -> DataFrame:
    """(client, hot, bounds) of clients that are dealt over slices: bounds are quantiles of their rows' times."""
    most = max(SLICE_ROWS, rows // HOT_SHARE)
    both = s.select("client", "at").union(c.select("client", "at")).where("client is not null")
    hot = both.groupBy("client").count().where(F.col("count") > most)
    times = both.join(F.broadcast(hot), "client").groupBy("client", "count").agg(F.percentile_approx("at", [k / SLICES for k in range(1, SLICES)], 10 * SLICES).alias("q"))
    n = F.least(F.lit(SLICES), F.ceil(F.col("count") / most))
    picked = F.transform(F.sequence(F.lit(1).cast("long"), n - 1), lambda k: F.get("q", (k * SLICES / n).cast("int") - 1))
    return times.withColumn("bounds", F.when(n > 1, F.array_distinct(picked)).otherwise(F.array().cast("array<long>"))).select("client", F.row_number().over(Window.orderBy("client")).alias("hot"), "bounds")


def _slot(keys: int, spread) -> F.Column:
    """Slots below keys are shared by clients; those of a sliced client follow."""
    slice_ = F.size(F.filter("bounds", lambda b: b <= F.col("at")))
    own = keys + F.col("hot") * SLICES + F.when(F.col("at").isNull(), 0).otherwise(slice_)
    return F.when(F.col("hot").isNotNull(), own).otherwise(F.pmod(F.xxhash64(F.coalesce(F.col("client"), spread)), F.lit(keys))).cast("long")


def write_feed(s: DataFrame, c: DataFrame, hot: DataFrame, path: str, slots: int) -> None:
    """Both tables under path, a folder a batch, with rows of no id that wake every key in every batch."""
    spark = s.sparkSession
    every = F.explode(F.sequence(F.lit(0), F.lit(BATCHES))).alias("batch")
    none = lambda *names: [F.lit(None).cast("string" if x == "op" else "long").alias(x) for x in names]
    s = s.join(F.broadcast(hot), "client", "left").withColumn("slot", _slot(slots, F.col("id")))
    wake = spark.range(1).select(every, F.col("id").alias("slot"), *none("id", "client", "at"), F.lit(True).alias("wake"))
    s.select("batch", "slot", "id", "client", "at", F.lit(False).alias("wake")).union(wake).write.partitionBy("batch").parquet(f"{path}/sales")
    c = c.join(F.broadcast(hot), "client", "left").withColumn("slot", _slot(slots, F.col("id")))
    own = hot.select(F.explode(F.sequence(F.lit(0), F.size("bounds"))).alias("k"), "hot").select((slots + F.col("hot") * SLICES + F.col("k")).cast("long").alias("slot"))
    wake = spark.range(slots).select(F.col("id").alias("slot")).union(own).select(every, "slot", *none("id", "client", "at", "cents", "op"), F.lit(True).alias("wake"))
    c.select("batch", "slot", "id", "client", "at", "cents", "op", F.lit(False).alias("wake")).union(wake).write.partitionBy("batch").parquet(f"{path}/changes")


def _ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values with 0 for nulls, and where nulls are."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), missing


def _split(keys: np.ndarray):
    """Keys and the places of their rows."""
    order = np.argsort(keys, kind="stable")
    at, first = np.unique(keys[order], return_index=True)
    return zip(at.tolist(), np.split(order, first[1:]))


def _together(batches):
    """Batches of a task joined to tables of about PACKED rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= PACKED:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _packed(kind: str, slot: np.ndarray, rows: np.ndarray, wake: pa.ChunkedArray, names: list | None) -> pa.RecordBatch:
    """(slot, kind, rows, names), one row a slot; rows that only wake a slot are left out."""
    real = ~wake.chunk(0).to_numpy(zero_copy_only=False)
    out = [(s, rows[k[real[k]]].tobytes()) for s, k in _split(slot)]
    n = len(out)
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([kind] * n), pa.array([r for _, r in out], pa.binary()), pa.array([names] * n, pa.list_(pa.string()))], ["slot", "kind", "rows", "names"])


def pack_sales(batches):
    """One row a slot: its sales as an array of (id, client, at, flags); flags: 1 null client, 2 null time, 4 null id."""
    for t in _together(batches):
        slot, _ = _ints(t["slot"].chunk(0))
        (id_, no_id), (client, no_client), (at, no_at) = (_ints(t[x].chunk(0)) for x in ("id", "client", "at"))
        rows = np.stack([id_, client, at, no_client * 1 + no_at * 2 + no_id * 4], axis=1)
        yield _packed("sale", slot, rows, t["wake"], None)


def pack_changes(batches):
    """One row a slot: its changes as an array of (id, client, at, cents, op's place in names, flags); 1 null client, 2 null cents, 4 null op, 8 null id."""
    for t in _together(batches):
        slot, _ = _ints(t["slot"].chunk(0))
        (id_, no_id), (client, no_client), (at, _), (cents, no_cents) = (_ints(t[x].chunk(0)) for x in ("id", "client", "at", "cents"))
        ops = t["op"].chunk(0).dictionary_encode()
        names = ops.dictionary.to_pylist()
        op, no_op = _ints(ops.indices)
        rows = np.stack([id_, client, at, cents, op, no_client * 1 + no_cents * 2 + no_op * 4 + no_id * 8], axis=1)
        yield _packed("change", slot, rows, t["wake"], names)


def _last_at_or_before(versions, sales) -> np.ndarray:
    """For sales (client, at) the place of the last of the versions (client, at; in order) with the client and no later time; -1: none."""
    (vc, va), (sc, sa) = versions, sales
    clients, times = np.unique(vc), np.unique(va)
    if not len(vc):
        return np.full(len(sc), -1)
    place = np.searchsorted(clients, sc)
    known = clients[np.minimum(place, len(clients) - 1)] == sc
    key = np.searchsorted(clients, vc) * (len(times) + 1) + np.searchsorted(times, va) + 1
    found = np.searchsorted(key, place * (len(times) + 1) + np.searchsorted(times, sa, side="right"), side="right") - 1
    return np.where(known & (found >= 0) & (vc[np.maximum(found, 0)] == sc), found, -1)


class Versions:
    """Holds the versions of clients and sales that H has not passed: accepts changes, answers sales, prunes."""

    #: names: the ops that versions point into, as JSON.
    STATE = "versions binary, names string, waiting binary"

    def __init__(self, batch: int, h: int, before: int, watermark: int, slots: int):
        self.batch, self.h, self.before, self.watermark, self.slots = batch, h, before, watermark, slots

    def __call__(self, key, rows, state):
        sales, changes = [], []
        for pdf in rows:
            for kind, r, names in zip(pdf["kind"], pdf["rows"], pdf["names"]):
                if kind == "sale":
                    sales.append(r)
                else:
                    changes.append((r, names))
        names, code = [], {}

        def coded(blob, own, flag=0):
            v = np.frombuffer(blob, np.int64).reshape(-1, 6).copy()
            if len(v) and own is not None and len(own):
                for o in own:
                    if o not in code:
                        code[o] = len(names)
                        names.append(o)
                v[:, 4] = np.array([code[o] for o in own], np.int64)[v[:, 4]]
            v[:, 5] |= flag
            return v

        was = state.exists
        versions, own, waiting = state.get if was else (b"", "[]", b"")
        old = versions, json.loads(own)
        new = np.concatenate([np.zeros((0, 6), np.int64), *(coded(*x) for x in changes)])
        late = new[:, 2] < self.watermark
        v = np.concatenate([coded(*old, 16 * (self.before > _NEVER)), new[~late]])
        rank = np.argsort(np.argsort(np.array(names, object))) if names else np.zeros(1, np.int64)
        ops = np.where(v[:, 5] & 4 > 0, -1, rank[v[:, 4]] if len(v) else 0)
        v = v[np.lexsort((ops, v[:, 3], v[:, 5] & 2 == 0, v[:, 0], v[:, 5] & 8 == 0, v[:, 2], v[:, 1], v[:, 5] & 1 == 0))]
        named = v[v[:, 5] & 1 == 0]
        hot = key[0] >= self.slots
        if late.any():
            gone = new[late]
            yield self.table("late", len(gone), id=pd.arrays.IntegerArray(gone[:, 0].copy(), gone[:, 5] & 8 > 0))
        s = np.frombuffer(b"".join([*sales, waiting]), np.int64).reshape(-1, 4)
        free = (s[:, 2] < self.h) | (s[:, 3] & 2 > 0) | (self.batch == BATCHES)
        s, waiting = s[free], s[~free]
        if len(s):
            found = _last_at_or_before((named[:, 1], named[:, 2]), (s[:, 1], s[:, 2]))
            found = np.where(s[:, 3] & 3 > 0, -1, found)
            clients, n = np.unique(named[:, 1], return_counts=True)
            at = np.minimum(np.searchsorted(clients, s[:, 1]), max(0, len(clients) - 1))
            n_held = np.where((clients[at] == s[:, 1]) & (s[:, 3] & 1 == 0), n[at], 0) if len(clients) else np.zeros(len(s), np.int64)
            yield self.table(
                "open" if hot else "sale", len(s), id=pd.arrays.IntegerArray(s[:, 0].copy(), s[:, 3] & 4 > 0), n_held=n_held, **self.version(named, found, names),
                **({"client": s[:, 1].copy(), "slot": np.full(len(s), key[0])} if hot else {}),
            )
        if hot and len(named):
            low = int(self.kept(named).sum())
            yield self.table("head", 1, n_held=np.array([len(named)]), n_low=np.array([low]), client=named[:1, 1].copy(), slot=np.array([key[0]]), **self.version(named, np.array([len(named) - 1]), names))
        # Of a client's versions at or before H the last stays; with one order, that is the one whose successor is another client's or past H.
        passed = v[:, 2] <= self.h
        same = np.r_[(v[1:, 1] == v[:-1, 1]) & (v[1:, 5] & 1 == v[:-1, 5] & 1) & passed[1:], False] if len(v) else passed
        v = v[~(passed & same)]
        v[:, 5] &= 15
        if len(v) or len(waiting):
            state.update((v.tobytes(), json.dumps(names), waiting.tobytes()))
        elif was:
            state.remove()

    def kept(self, v):
        return (v[:, 5] & 16 > 0) & (v[:, 2] <= self.before)

    def version(self, v, at, names) -> dict:
        """Columns of the versions at places at; null where at is -1. held: what the last pruning left of those at or before its H."""
        none = at < 0
        x = v[np.maximum(at, 0)] if len(v) else np.zeros((len(at), 6), np.int64)
        text = np.array([*names, None], object)[np.where(none | (x[:, 5] & 4 > 0), len(names), x[:, 4])]
        return {
            "change_id": pd.arrays.IntegerArray(x[:, 0].copy(), none | (x[:, 5] & 8 > 0)), "balance_cents": pd.arrays.IntegerArray(x[:, 3].copy(), none | (x[:, 5] & 2 > 0)), "op": pd.array(text, "string"),
            "at": pd.arrays.IntegerArray(x[:, 2].copy(), none), "held": ~none & self.kept(x),
        }

    def table(self, rec: str, n: int, **cols) -> pd.DataFrame:
        none = pd.arrays.IntegerArray(np.zeros(n, np.int64), np.ones(n, bool))
        out = {"rec": np.full(n, rec, object), **dict.fromkeys(["id", "batch", "n_held", "change_id", "balance_cents", "op", "client", "at", "slot", "held", "n_low"], none), "batch": np.full(n, self.batch)}
        return pd.DataFrame(out | {"op": pd.array([None] * n, "string"), "held": pd.array([None] * n, "boolean")} | cols)


def stream(session: SparkSession, feed: str, batch: int, marks: list[tuple[int, int]], slots: int) -> DataFrame:
    """The streaming query as it is started for one batch."""
    last = batch == BATCHES
    h, watermark = (_NEVER, _NEVER) if last else marks[batch]
    before = marks[batch - 1][0] if batch else _NEVER
    # What has arrived by now: the folders up to this batch's, of which the checkpoint's log knows all but the last.
    come = "{" + ",".join(map(str, range(batch + 1))) + "}"
    read = lambda name, schema: session.readStream.schema(schema).option("basePath", f"{feed}/{name}").parquet(f"{feed}/{name}/batch={come}").drop("batch")
    s, c = read("sales", _SALE), read("changes", _CHANGE)
    stage = Versions(batch, h, before, watermark, slots)
    both = s.mapInArrow(pack_sales, _PACKED).unionByName(c.mapInArrow(pack_changes, _PACKED))
    return both.groupBy("slot").applyInPandasWithState(lambda key, rows, state: stage(key, rows, state), RESULT, stage.STATE, "append", "NoTimeout")


def _session(spark: SparkSession) -> SparkSession:
    """A session of the same application for the streams; the caller's settings stay as they are."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    # A start runs one batch, after which its stores are of no use to an executor.
    own.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    own.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
    return own


def joined(out: DataFrame) -> DataFrame:
    """Answers of sliced clients put together: an open sale, what its slice found, and the heads of its client's slices."""
    heads = out.where("rec = 'head'").select("client", "batch", "slot", "n_held", "n_low", F.struct("change_id", "balance_cents", "op", "held").alias("v"))
    open_ = out.where("rec = 'open'")
    # Every slice that has an open sale or a head; at most SLICES a client and batch.
    places = open_.select("client", "batch", "slot").distinct().join(heads, ["client", "batch", "slot"], "full")
    of = Window.partitionBy("client", "batch")
    earlier = of.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce("n_low", F.lit(0))
    known = places.select(
        "client", "batch", "slot", F.last("v", ignorenulls=True).over(earlier).alias("carry"), F.max(F.when(F.col("v").isNotNull(), F.col("slot"))).over(earlier).alias("carry_slot"),
        F.max(F.when(low > 0, F.col("slot"))).over(of).alias("low_slot"), (F.sum(F.coalesce("n_held", F.lit(0))).over(of) - F.sum((low > 0).cast("long")).over(of) + F.max((low > 0).cast("long")).over(of)).alias("n"),
    )
    s = open_.join(known, ["client", "batch", "slot"])
    mine = F.struct("change_id", "balance_cents", "op", "held")
    # "at" is the time of the version that the slice itself found. Sales without a time are in the first slice, which nothing precedes.
    s = s.withColumn("v", F.when(F.col("at").isNotNull(), mine).otherwise(F.col("carry"))).withColumn("v_slot", F.when(F.col("at").isNotNull(), F.col("slot")).otherwise(F.col("carry_slot")))
    # One at or before the last H that isn't the client's last such has been pruned.
    v = F.when(~(F.col("v.held") & (F.col("v_slot") < F.col("low_slot"))), F.col("v"))
    return s.withColumn("v", v).select(F.lit("sale").alias("rec"), "id", "batch", F.col("n").alias("n_held"), F.col("v.change_id").alias("change_id"), F.col("v.balance_cents").alias("balance_cents"), F.col("v.op").alias("op"))


def enriched(sales: DataFrame, changes: DataFrame) -> DataFrame:
    """rec (sale or late), id, batch, n_held, change_id, balance_cents, op, by streaming both tables batch by batch."""
    spark = sales.sparkSession
    s, c = batched(sales, changes)
    c = saved(c, "changes")
    marks, rows = watermarks(s, c)
    hot = saved(sliced(s, c, rows), "hot")
    keys = max(shuffle_parts(spark), -(-rows // KEY_ROWS))
    feed, state, out = (fresh_path(spark, x) for x in ("feed", "stream", "enriched"))
    write_feed(s, c, hot, feed, keys)
    forget(c)
    forget(hot)
    session = _session(spark)
    for batch in range(BATCHES + 1):
        query = stream(session, feed, batch, marks, keys).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    forget_path(feed)
    forget_path(state)
    done = spark.read.schema(RESULT).parquet(out)
    plain = done.where("rec in ('sale', 'late')").select("rec", "id", "batch", "n_held", "change_id", "balance_cents", "op")
    return plain.union(joined(done))


def op13_sale_enrichment(spark, sf_dir: str) -> DataFrame:
    return enriched(load(spark, sf_dir, "sales"), load(spark, sf_dir, "client_changes"))


#: The checksum of a change's number digit by digit; batches and H from windows. A version is pruned in the first batch by
#: which a later one of its client has been accepted and passed by H; sales look among versions accepted and not yet pruned.
SQL = f"""
WITH RECURSIVE bits AS (SELECT b, b::BIGINT AS c, 0 AS k FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY b) AS crcs FROM bits WHERE k = 8),
s AS MATERIALIZED (SELECT sale_id, client_id, sold_at, greatest(0, least({BATCHES - 1}, floor((date_diff('day', DATE '1970-01-01', arrived_at::DATE) - {FIRST_DAY}) * {BATCHES} / {DAYS})))::BIGINT AS b FROM sales),
d AS (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
j AS (SELECT d.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(change_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda acc, x: xor(acc >> 8, crcs[(xor(acc, x) & 255) + 1])), 4294967295) % {DELAY_DAYS} AS late FROM d, crc_table),
c AS MATERIALIZED (SELECT change_id, client_id, valid_at, op, floor(100 * balance + 0.5)::BIGINT AS cents,
      greatest(0, least({BATCHES - 1}, floor((date_diff('day', DATE '1970-01-01', valid_at::DATE) + late - {FIRST_DAY}) * {BATCHES} / {DAYS})))::BIGINT AS b FROM j),
k AS (SELECT unnest(range(0, {BATCHES})) AS k),
w AS (SELECT k, (SELECT max(sold_at) FROM s WHERE b < k) AS ws, (SELECT max(valid_at) FROM c WHERE b < k) AS wc FROM k),
h AS MATERIALIZED (SELECT k, wc, CASE WHEN ws IS NOT NULL AND wc IS NOT NULL THEN least(ws, wc) END AS h FROM w),
a AS (SELECT c.*, h.wc IS NOT NULL AND c.valid_at < h.wc AS gone FROM c JOIN h ON h.k = c.b),
v AS (SELECT *, greatest(b, coalesce((SELECT min(k) FROM h WHERE h.h >= valid_at), 99)) AS passed FROM a WHERE NOT gone),
p AS MATERIALIZED (SELECT *, greatest(b, coalesce(min(passed) OVER (PARTITION BY client_id ORDER BY valid_at, change_id, cents NULLS FIRST, op ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 99)) AS pruned FROM v),
e AS MATERIALIZED (SELECT row_number() OVER () AS n, s.*, CASE WHEN sold_at IS NULL THEN b ELSE coalesce((SELECT min(k) FROM h WHERE k >= s.b AND s.sold_at < h.h), {BATCHES}) END AS batch FROM s),
m AS (SELECT e.n, count(*) AS n_held, max({{'t': p.valid_at, 'i': p.change_id, 'c': p.cents, 'o': p.op}}) FILTER (WHERE p.valid_at <= e.sold_at) AS v
      FROM e JOIN p ON e.client_id = p.client_id AND p.b <= e.batch AND p.pruned >= e.batch GROUP BY e.n)
SELECT 'sale' AS rec, sale_id AS id, batch, coalesce(n_held, 0)::BIGINT AS n_held, v.i AS change_id, v.c AS balance_cents, v.o AS op FROM e LEFT JOIN m USING (n)
UNION ALL SELECT 'late', change_id, b, NULL, NULL, NULL, NULL FROM a WHERE gone
"""
