"""Line dedup: sharded cuckoo filters in front of exact reference-count tables, reversible by document.

State (all tables in the shared folder, written anew by each step):
  postings(key, doc_id)          one row per document and distinct long line
  refs(key, n_docs, owner)       exact reference count, and the largest document that holds the line
  filters(shard, cells)          cuckoo filters over the keys of refs

A key's hash names its shard, and a shard is one filter of fixed size: there are as many shards as the number of keys asks
for (SHARD_KEYS each), a shuffle partition's worth at least, and when keys outgrow them the filters are dealt anew from refs into twice as many. So one filter
is probed for a key, and wrong answers stay as rare, however many keys there are.

An insertion tests its distinct keys against their shard's filter: keys it has never seen go straight to refs,
the others are joined with refs exactly; those that aren't there (the filter was wrong) get a fingerprint too, so each
key of refs has one of its own, equal or not to others. A deletion lowers counts, finds new owners from postings and removes keys
that reach 0 from the filter (a cuckoo filter can forget; a Bloom filter can't). Insert followed by delete gives
the tables that were there before.

Keys are 128-bit digests of the normalised line, so no line text is stored.

Defined results: a null or empty text is one empty line. A document is what has one doc_id: repeated rows, and ids that
are inserted again, count once for each line, and all rows of the largest doc_id keep the line. Rows without a doc_id are
no document: they don't count and keep all their lines. Lines are split at \\n only. Extra columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import BLANKS, lean_batches, load, saved, shuffle_parts, trimmed

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of a shard, on average: half of its filter's cells.
SHARD_KEYS = 1 << 15
#: Keys of a task that works on filters.
TASK_KEYS = 1 << 19


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of the line without outer blanks and with A-Z lower-cased; None for short lines."""
    line = line.strip(BLANKS)
    # bytes.lower() changes A-Z only
    return hashlib.md5(line.encode("utf-8", "surrogatepass").lower()).digest() if len(line) >= min_chars else None


class Cuckoo:
    """Buckets of four 16-bit fingerprints in a block of fixed size; another opens in the rare case that it is full."""

    BUCKETS = 1 << 14

    def __init__(self, cells: list[bytes] = ()):
        self.blocks = [np.frombuffer(c, dtype="<u2").reshape(-1, 4).copy() for c in cells]

    @staticmethod
    def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = (h & np.uint64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        one = ((h >> np.uint64(16)) & np.uint64(Cuckoo.BUCKETS - 1)).astype(np.int64)
        return fp, one, Cuckoo.other(fp, one)

    @staticmethod
    def other(fp, at):
        return at ^ ((fp.astype(np.int64) * 0x5BD1E995 >> 7) & (Cuckoo.BUCKETS - 1))

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, one, two = self.places(h)
        hit = np.zeros(len(h), bool)
        for b in self.blocks:
            hit |= (b[one] == fp[:, None]).any(1) | (b[two] == fp[:, None]).any(1)
        return hit

    def insert(self, h: np.ndarray) -> None:
        """Bulk insert: whole rounds at once into free cells of either bucket, then evictions one by one."""
        room = int(self.BUCKETS * 4 * 0.85)
        while len(h):
            if not self.blocks or np.count_nonzero(self.blocks[-1]) >= room:
                self.blocks.append(np.zeros((self.BUCKETS, 4), np.uint16))
            b = self.blocks[-1]
            k = max(1, room - np.count_nonzero(b))
            now, h = h[:k], h[k:]
            fp, one, two = self.places(now)
            for second in (False, True):
                at = two if second else one
                order = np.argsort(at, kind="stable")
                a = at[order]
                first = np.r_[True, a[1:] != a[:-1]]
                place = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
                cell = place + np.count_nonzero(b, axis=1)[a]
                fits = cell < 4  # cells fill from the left and deletions keep that
                b[a[fits], cell[fits]] = fp[order][fits]
                rest = np.sort(order[~fits])
                fp, one, two = fp[rest], one[rest], two[rest]
                if not len(rest):
                    break
            for f, at in zip(fp.tolist(), one.tolist()):
                self._evict(f, at)

    def _evict(self, f: int, at: int) -> None:
        b = self.blocks[-1]
        for turn in range(500):
            cells = b[at]
            free = np.flatnonzero(cells == 0)
            if len(free):
                cells[free[0]] = f
                return
            k = turn % 4
            f, cells[k] = int(cells[k]), f
            at = int(self.other(np.array([f], np.uint16), np.array([at]))[0])
        self.blocks.append(np.zeros((self.BUCKETS, 4), np.uint16))
        self.blocks[-1][at, 0] = f

    def delete(self, h: np.ndarray) -> None:
        """Only for keys that are known to be in (refs says so)."""
        for f, one, two in zip(*(x.tolist() for x in self.places(h))):
            for b, at in ((b, at) for b in self.blocks for at in (one, two)):
                k = np.flatnonzero(b[at] == f)
                if len(k):
                    last = np.flatnonzero(b[at])[-1]
                    b[at, k[0]], b[at, last] = b[at, last], 0
                    break

    def cells(self) -> list[bytes]:
        return [b.astype("<u2").tobytes() for b in self.blocks if b.any()]


def _hash(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), dtype="<u8")


def _filter_step(op: str):
    """Streams a shard's blocks, then its keys; emits keys with `known`, then the shard's new blocks."""

    def run(batches):
        shard, filt, past, cols = None, None, None, ["kind", "shard", "key", "n", "owner", "known", "cells"]

        def blocks():
            return pd.DataFrame([("f", shard, None, None, None, None, c) for c in filt.cells()], columns=cols)

        for pdf in batches:
            for s, part in pdf.groupby("shard", sort=False):
                if s != shard:
                    if shard is not None:
                        yield blocks()
                    shard, filt, past = s, Cuckoo(), Cuckoo()
                old = part[part["kind"] == "f"]
                if len(old):
                    filt, past = Cuckoo([*filt.cells(), *old["cells"]]), Cuckoo([*past.cells(), *old["cells"]])
                keys = part[part["kind"] == "k"]
                if len(keys):
                    h = _hash(keys["key"])
                    known = past.contains(h)  # keys are distinct: those of one step aren't known by each other's fingerprints
                    if op == "insert":
                        filt.insert(h[~known])
                    elif op == "add":  # keys that refs doesn't have, whatever the filter says
                        filt.insert(h)
                    else:
                        filt.delete(h)
                    yield keys.assign(known=known)[cols]
        if shard is not None:
            yield blocks()

    return run


_STEP = "kind string, shard int, key binary, n long, owner long, known boolean, cells binary"


@dataclass(frozen=True)
class LineIndex:
    """An immutable version of the state; insert and delete return the next version."""

    spark: object
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS
    postings: DataFrame | None = None
    refs: DataFrame | None = None
    filters: DataFrame | None = None
    #: Rows of refs.
    n_keys: int = 0

    @staticmethod
    def empty(spark, shards: int | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        make = lambda s: spark.createDataFrame([], s)
        return LineIndex(spark, shards or shuffle_parts(spark), min_chars, min_docs, make("key binary, doc_id long"), make("key binary, n_docs long, owner long"), make("shard int, cells binary"))

    def _extract(self, docs: DataFrame) -> DataFrame:
        least = self.min_chars

        def keys(batches):
            for pdf in batches:
                ids, out = [], []
                for i, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
                    # A line costs nothing when it is short, and counts once a document.
                    found = {line_key(x, least) for x in (text or "").split("\n") if len(x) >= least} - {None}
                    out += found
                    ids += [i] * len(found)
                yield pd.DataFrame({"key": out, "doc_id": pd.array(ids, dtype="Int64")})

        d = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
        return d.mapInPandas(trimmed(keys), "key binary, doc_id long").distinct()

    def _through_filters(self, keys: DataFrame, n: int, op: str) -> DataFrame:
        """Rows of kind k (the keys, with `known`) and f (filters of the shards) after a step on about n keys."""
        shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")
        rows = keys.select(F.lit("k").alias("kind"), shard.alias("shard"), "key", "n", "owner", F.lit(None).cast("boolean").alias("known"), F.lit(None).cast("binary").alias("cells"))
        old = self.filters.select(F.lit("f").alias("kind"), "shard", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("owner"), F.lit(None).cast("boolean").alias("known"), "cells")
        parts = min(self.shards, max(shuffle_parts(self.spark), n // TASK_KEYS))
        dealt = old.unionByName(rows).repartition(parts, "shard").sortWithinPartitions("shard", "kind")
        return saved(dealt.mapInPandas(_filter_step(op), _STEP), "lines")

    @staticmethod
    def _filters(step: DataFrame) -> DataFrame:
        return step.where("kind = 'f'").select("shard", "cells")

    def _room_for(self, n: int) -> LineIndex:
        """With shards for n keys; if that needs more of them, fingerprints are dealt anew."""
        shards = self.shards
        while shards * SHARD_KEYS < n:
            shards *= 2
        if shards == self.shards:
            return self
        wide = replace(self, shards=shards, filters=self.filters.limit(0))
        if not self.n_keys:
            return wide
        return replace(wide, filters=self._filters(wide._through_filters(self.refs.select("key", F.col("n_docs").alias("n"), "owner"), self.n_keys, "add")))

    def insert(self, docs: DataFrame) -> LineIndex:
        lean_batches(self.spark)
        new = self._extract(docs)
        if self.n_keys:  # lines that a document has already
            new = new.join(self.postings, ["key", "doc_id"], "left_anti")
        new = saved(new, "postings")
        # Keys are counted before anything is dealt by shard: a hot line is one row from here on.
        delta = saved(new.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("owner")), "lines")
        n = delta.count()
        now = self._room_for(self.n_keys + n)
        step = now._through_filters(delta, n, "insert")
        met = step.where("kind = 'k'").select("key", F.col("n").alias("_n"), F.col("owner").alias("_o"), "known")
        fresh = met.where("not known").select("key", F.col("_n").alias("n_docs"), F.col("_o").alias("owner"))
        if not self.n_keys:
            refs = fresh
        else:
            merged = self.refs.join(met.where("known"), "key", "full_outer").select("key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("owner", "_o").alias("owner"))
            wrong = saved(met.where("known").join(self.refs, "key", "left_anti").select("key", F.col("_n").alias("n"), F.col("_o").alias("owner")), "lines")
            refs = saved(merged.unionByName(fresh), "refs")
            if not wrong.isEmpty():
                step = replace(now, filters=self._filters(step))._through_filters(wrong, n, "add")
        # A step passes every filter on, also those no key of it belongs to.
        return replace(now, postings=self.postings.unionByName(new) if self.n_keys else new, refs=refs, filters=self._filters(step), n_keys=refs.count())

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of doc_ids (column doc_id); ids that aren't in change nothing."""
        gone = doc_ids.select(F.col("doc_id").cast("long")).distinct()
        left = saved(self.postings.join(gone, "doc_id", "left_anti").select("key", "doc_id"), "postings")
        less = saved(self.postings.join(gone, "doc_id", "left_semi").groupBy("key").agg(F.count("*").alias("_n")), "lines")
        owners = left.join(less.select("key"), "key", "left_semi").groupBy("key").agg(F.max("doc_id").alias("_new"))
        refs = saved(
            self.refs.join(less, "key", "left").join(owners, "key", "left")
            .select("key", (F.col("n_docs") - F.coalesce("_n", F.lit(0))).alias("n_docs"), F.when(F.col("_n").isNull(), F.col("owner")).otherwise(F.col("_new")).alias("owner")),
            "refs",
        )
        dead = refs.where("n_docs <= 0").select("key", F.lit(0).cast("long").alias("n"), "owner")
        step = self._through_filters(dead, self.n_keys, "delete")
        refs = refs.where("n_docs > 0")
        return replace(self, postings=left, refs=refs, filters=self._filters(step), n_keys=refs.count())

    def render(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_text of each row of docs under the current counts."""
        lean_batches(self.spark)
        least = self.min_chars
        hot = self.refs.where(F.col("n_docs") >= self.min_docs).select("key", "owner")
        # Hot lines skew the left side only; the right side has one row a key, so AQE can split it.
        drops = self.postings.join(hot, "key").where("doc_id <> owner")
        drops = drops.groupBy("doc_id").agg(F.collect_set("key").alias("keys")).withColumnRenamed("doc_id", "_d")
        d = docs.select(F.col("doc_id").cast("long"), "text")

        def cut(batches):
            for pdf in batches:
                n, k, kept = [], [], []
                for text, keys in zip(pdf["text"], pdf["keys"]):
                    text = text or ""
                    if keys is None:
                        n.append(text.count("\n") + 1)
                        k.append(0)
                        kept.append(text)
                        continue
                    drop, lines = {bytes(x) for x in keys}, text.split("\n")
                    left = [x for x in lines if line_key(x, least) not in drop]
                    n.append(len(lines))
                    k.append(len(lines) - len(left))
                    kept.append("\n".join(left))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_lines": n, "n_dropped": k, "kept_text": kept})

        return d.join(drops, d["doc_id"] == drops["_d"], "left").select("doc_id", "text", "keys").mapInPandas(trimmed(cut), "doc_id long, n_lines long, n_dropped long, kept_text string")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One-shot form: all documents into an empty index, then rendered."""
    return LineIndex.empty(docs.sparkSession, None, min_chars, min_docs).insert(docs).render(docs)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
keyed AS (SELECT r, doc_id, pos, line, {_KEY} AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k.doc_id <> h.owner) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE (k.doc_id <> h.owner) IS NOT TRUE), '')) AS kept_sha256
FROM keyed k LEFT JOIN hot h ON k.key = h.key GROUP BY k.r
"""
