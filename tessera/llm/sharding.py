"""Sharding by histogram sort: exact bytes below candidate boundaries, refined until splitters meet tolerance.

The sort key is 16 bytes: 8 of the text's digest, then the doc_id, so equal texts lie together in an order that has
nothing to do with length. In each round every boundary not yet known sends probes into the range it lies in; one pass over the (key, size)
column counts exact bytes and rows between all probes, partial sums per task, and the ranges shrink. A range of at most
FEW rows is read itself. When all boundaries are met, rows are exchanged once, straight to their place.

Law `bytes`: shards' bytes are nearly equal. The boundary of shard i is the edge between two texts nearest to i shares of
all bytes (the lower of two as near), so that copies stay in one shard; if no such edge lies within GROUP_SLACK of a
shard's share, as in a large group of copies, it is the edge between two doc_ids that is nearest. So tolerance is half a
document there, and shards don't depend on how rows are partitioned.

A shard is sorted in parts of about PART_BYTES, whose edges only need to be about even. The driver tells at most MAX_CUTS
of them apart in all shards together, a few MB whatever the table: 100 TB are sorted in parts of half a GB.

Defined results: size is the text's UTF-8 bytes plus 1, 1 for null; null and empty texts are one group with crc 0.
Rows equal in doc_id and text can't be told apart and share a shard; a null doc_id comes before all others. Input
columns stay; what is added starts with "shard_" and replaces input columns of those names. An empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import forget, load, saved

SHARDS = 16
GROUP_SLACK = 0.02
#: Probes a round for each unmet boundary, and rows of a range that are read themselves.
PROBES, FEW = 63, 4096
#: Shards are sorted in parts of about so many bytes, in all at most MAX_CUTS of them (one for each shard at least).
PART_BYTES, MAX_CUTS = 32 << 20, 200_000
_GROUP, _END = 1 << 64, 1 << 128


def with_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    # Flipping the sign bit makes byte order the order of signed ids; null becomes the least.
    num = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    key = F.unhex(F.concat(F.substring(F.md5(text), 1, 16), F.coalesce(num, F.lit("0" * 16))))
    return docs.withColumn("shard_size", (F.octet_length(text) + 1).cast("long")).withColumn("shard_key", key)


def _array(keys) -> np.ndarray:
    """Fixed 16-byte strings; numpy compares them byte by byte, zero-padded, as Spark does."""
    return np.array(list(keys), dtype="S16")


def histogram(slim: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) with keys below each of the ascending probes. Only len(probes) + 1 sums reach the driver."""
    edges = _array(p.to_bytes(16, "big") for p in probes)

    def count(batches):
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for pdf in batches:
            at = np.searchsorted(edges, _array(pdf["shard_key"]), side="right")
            np.add.at(size, at, pdf["shard_size"].to_numpy())
            np.add.at(rows, at, 1)
        some = np.flatnonzero(rows)
        yield pd.DataFrame({"bin": some, "size": size[some], "n": rows[some]})

    got = {r["bin"]: (r["s"], r["k"]) for r in slim.mapInPandas(count, "bin long, size long, n long").groupBy("bin").agg(F.sum("size").alias("s"), F.sum("n").alias("k")).collect()}
    out, s, k = [], 0, 0
    for i in range(len(probes)):
        s, k = s + got.get(i, (0, 0))[0], k + got.get(i, (0, 0))[1]
        out.append((s, k))
    return out


def _edges(slim: DataFrame, ranges: set[tuple[int, int]], at: dict, unit: int) -> dict:
    """For short ranges (lo, hi) of keys: the edges in them that are multiples of unit, with (bytes, rows) below."""
    if not ranges:
        return {}
    blob = lambda k: F.lit(k.to_bytes(16, "big"))
    inside = reduce(or_, [(F.col("shard_key") >= blob(lo)) & (F.col("shard_key") <= blob(hi - 1)) for lo, hi in sorted(ranges)])
    found = sorted((int.from_bytes(r["shard_key"], "big"), r["shard_size"]) for r in slim.where(inside).collect())
    out = {}
    for lo, hi in ranges:
        (size, rows), out[lo, hi], last = at[lo], [], None
        for key, s in found:
            if lo <= key < hi:
                if key // unit != last:
                    last = key // unit
                    out[lo, hi].append((last * unit, (size, rows)))
                size, rows = size + s, rows + 1
    return out


def _around(order: list[int], below: list, t) -> tuple[int, int]:
    """The last of the ascending edges with at most t below it, and the next one."""
    a = bisect_right(below, t) - 1
    return order[a], order[min(a + 1, len(order) - 1)]


def _spread(lo: int, hi: int, unit: int, probes: int) -> set[int]:
    cells = (hi - lo) // unit
    return {lo + unit * (cells * k // (probes + 1)) for k in range(1, probes + 1)} - {lo, hi}


def splitters(slim: DataFrame, shards: int, total: int, rows: int) -> list[tuple[int, int]]:
    """(key, rows below) of the shards - 1 boundaries, ascending; total and rows are those of slim."""
    at, done = {0: (0, 0), _END: (total, rows)}, {}
    for unit in (_GROUP, 1):  # edges between texts; where none is near enough, between doc_ids
        want = set(range(1, shards)) - set(done)
        while want:
            order = sorted(p for p in at if p % unit == 0)
            below = [at[p][0] * shards for p in order]
            ask, short = set(), {}
            for i in want:
                lo, hi = _around(order, below, total * i)
                if hi - lo <= unit or at[hi][1] - at[lo][1] <= FEW:
                    short[i] = lo, hi
                else:
                    ask |= _spread(lo, hi, unit, PROBES)
            read = _edges(slim, {(lo, hi) for lo, hi in short.values() if hi - lo > unit}, at, unit)
            for i, (lo, hi) in short.items():
                far = lambda e: (abs(e[1][0] * shards - total * i), e[1][0])  # noqa: E731, B023
                best = min([(lo, at[lo]), *read.get((lo, hi), ()), (hi, at[hi])], key=far)
                if unit == 1 or far(best)[0] <= GROUP_SLACK * total:
                    done[i] = best
                want.discard(i)
            new = sorted(ask - set(at))
            at |= dict(zip(new, histogram(slim, new))) if new else {}
    return [(done[i][0], done[i][1][1]) for i in range(1, shards)]


def _part_edges(slim: DataFrame, n: int, total: int, rows: int) -> list[tuple[int, int]]:
    """(key, rows below) of about n - 1 edges that cut slim into parts of about even bytes."""
    at, done, want = {0: (0, 0), _END: (total, rows)}, {}, set(range(1, n))
    while want:
        order = sorted(at)
        below, ranges = [at[p][0] * n for p in order], set()
        for i in list(want):
            lo, hi = _around(order, below, total * i)
            best = min((lo, hi), key=lambda p: abs(at[p][0] * n - total * i))  # noqa: B023
            if hi - lo <= 1 or abs(at[best][0] * n - total * i) <= 0.3 * total:
                done[best] = at[best][1]
                want.discard(i)
            else:
                ranges.add((lo, hi))
        # Several edges may lie in one range, all of them at first.
        probes = 7 if len(at) > 2 else max(PROBES, 2 * n)
        new = sorted({p for lo, hi in ranges for p in _spread(lo, hi, 1, probes)} - set(at))
        at |= dict(zip(new, histogram(slim, new))) if new else {}
    return sorted((k, r) for k, r in done.items() if 0 < k < _END)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with shard_size, shard_shard and shard_slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    keyed = with_keys(docs)
    slim = saved(keyed.select("shard_key", "shard_size"), "shard")
    total, rows = slim.agg(F.sum("shard_size"), F.count("*")).first()
    parts = int(min(max(1, MAX_CUTS // shards), max(1, -(-(total or 0) // (shards * PART_BYTES)))))
    bounds = splitters(slim, shards, total, rows) if rows else []
    cuts = sorted({*bounds, *(_part_edges(slim, shards * parts, total, rows) if rows and parts > 1 else [])})
    forget(slim)
    cuts = [(k, n) for k, n in cuts if 0 < k < _END]
    edges = _array(k.to_bytes(16, "big") for k, _ in cuts)

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, _array(key), side="right").astype(np.int32))

    # One row for each part, shards + MAX_CUTS at most: bounded, so broadcast.
    starts, first = [], [k for k, _ in bounds]
    for part, (key, under) in enumerate([(0, 0), *cuts]):
        shard_ = bisect_right(first, key)  # an empty shard has its bounds at one key
        starts.append((part, shard_, under - (bounds[shard_ - 1][1] if shard_ else 0)))
    starts = spark.createDataFrame(starts, "shard_part int, shard_shard int, shard_start long")
    # The one exchange: rows go to their part, in order of their key.
    order = Window.partitionBy("shard_part").orderBy("shard_key")
    out = keyed.drop("shard_shard", "shard_slot").withColumn("shard_part", place("shard_key")).withColumn("shard_row", F.row_number().over(order))
    out = out.join(F.broadcast(starts), "shard_part").withColumn("shard_slot", F.col("shard_start") + F.col("shard_row") - 1)
    return out.drop("shard_part", "shard_row", "shard_start", "shard_key")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    out = shard(docs.withColumn("text_crc32", crc))
    return out.select("doc_id", F.col("shard_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("shard_shard").alias("shard"), F.col("shard_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


_BYTES = "list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)"

#: The boundaries by the rule of the module's docstring, from running sums over the sorted table; the checksum byte by byte.
SQL = f"""
WITH RECURSIVE bits AS (SELECT b, b::BIGINT AS c, 0 AS k FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY b) AS crcs FROM bits WHERE k = 8),
texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
sums AS MATERIALIZED (SELECT t, xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES}), lambda acc, x: xor(acc >> 8, crcs[(xor(acc, x) & 255) + 1])), 4294967295) AS crc FROM texts, crc_table),
d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 1 AS size, substr(md5(coalesce(text, '')), 1, 16) AS g FROM documents),
r AS (SELECT *, sum(size) OVER (ORDER BY g, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before, row_number() OVER (ORDER BY g, doc_id NULLS FIRST) - 1 AS place FROM d),
n AS (SELECT sum(size)::HUGEINT AS total FROM d),
edges AS (SELECT min(before) AS below, true AS texts FROM r GROUP BY g UNION ALL SELECT min(before), false FROM r GROUP BY g, doc_id
          UNION ALL SELECT total, unnest([true, false]) FROM n),
b AS (SELECT i, arg_min(below, (abs(below * {SHARDS} - total * i), below)) FILTER (WHERE texts) AS text_edge, arg_min(below, (abs(below * {SHARDS} - total * i), below)) AS edge, any_value(total) AS total
      FROM (SELECT unnest(range(1, {SHARDS})) AS i), edges, n GROUP BY i),
cuts AS MATERIALIZED (SELECT CASE WHEN abs(text_edge * {SHARDS} - total * i) <= {GROUP_SLACK} * total THEN text_edge ELSE edge END AS cut FROM b),
k AS (SELECT g, doc_id, min(before) AS first FROM r GROUP BY ALL),
s AS (SELECT k.g, k.doc_id, count(cut) AS shard FROM k LEFT JOIN cuts ON cut <= k.first GROUP BY k.g, k.doc_id),
j AS (SELECT r.*, s.shard FROM r JOIN s ON r.g = s.g AND r.doc_id IS NOT DISTINCT FROM s.doc_id)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM j JOIN sums USING (t)
"""
