"""N-gram Jaccard join: a size-aware heavy-light join over word shingles.

Two texts link if 100 * |A & B| >= 75 * |A | B| for their sets of 5-word shingles. Sets that are equal are one class.

Shared tokens. One exchange counts in how many sets each shingle occurs. It carries sorted hashes in packed columns, not
rows; a task counts its own frequent shingles first, so a shingle of very many texts is one number per task. Only
shingles of two or more sets come back, and only sets of which 75 % are shared go on: no other set can link.

Light sets (size up to a boundary) enumerate subsets. Sets of sizes a and b link if they share c(a, b) shingles, so each
set lists its subsets of that size for each possible size of a partner, under the pair of sizes; everything under one key
is linked by construction. One link to the key's least set says it all: output is linear in the members of a key.

Heavy sets scan inverted lists. In order of frequency, two sets that link share one of their rarest n - ceil(.75 n) + 1
shingles, so only those are listed. Each list first compares its members with a few leaders, which connects large groups
of near copies without all pairs. Lists whose members are one component by then are done. The others are scanned whole,
so no link that joins two components is lost: lists that hold much the same sets choose the same first leader and are
scanned as one, a pair of blocks of bounded bytes at a time, each by an inverted index of its own. Blocks of the largest
component never meet each other. A scan gives a forest of its links, no candidate pairs: at most one row for each set in it.

The boundary between light and heavy is the size at which subsets cost less than the scans they save, from exact counts.
Sizes above MOST_LIGHT aren't tried: one set of 25 shingles may already list 326,587 subsets.

Hashes: shingles are 56-bit hashes of five 64-bit word hashes, sets 128-bit digests of their shingles. Everything is
decided on these.

The join gives components, not the links of each set: comparisons within a component already known would be all pairs of
a group of copies.

Defined results: a null or blank text has no set, n_shingles 0, and is a component of its own. A null doc_id is never a
component's id unless all its ids are null. Each row gives one row; repeated rows are copies. Extra columns are not read
by join and kept by one_per_group(), which keeps one document of each group; rows equal in doc_id and text (null ids
equal) are one document and stay or go together, and rows that share a doc_id but not a text are told apart. An empty
table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
from itertools import combinations, islice
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import components, forget, lean_batches, load, saved, shuffle_parts, sized, trim, trimmed
from .runs import edges, hashed, mixed

WORDS = 5
#: Similarity in percent.
PERCENT = 75
#: A task counts this many shingles at a time (or one text).
CHUNK = 1 << 19
#: Bits of a shingle's hash.
BITS = 56
#: A shingle of this many sets of one chunk leaves the task as a number.
LOCAL = 64
#: About so many texts' shingles meet in one group of the counting exchange.
TEXTS_A_PART = 1000
#: Sets of up to this size may be light.
MOST_LIGHT = 24
#: Subsets that a task holds at a time.
SUBSETS = 20_000
#: Leaders of a list.
LEADERS = 4
#: Shingles of so many bytes (or one set) make a block of a scan.
SCAN_BYTES = 1 << 20
#: Words are hashed for texts of about so many bytes (or one text) at a time.
BATCH_BYTES = 1 << 17
#: Texts of a chunk, distinct or not.
CHUNK_TEXTS = 65_000


def need(n: int) -> int:
    """Least overlap of a set of size n with any set it links with."""
    return -(-PERCENT * n // 100)


def overlap(a: int, b: int) -> int:
    """Least overlap of linked sets of sizes a and b."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: What a byte adds to a word's hash: upper-case ASCII letters add what the lower-case ones add.
_VALUE = mixed(np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + np.uint64(1))


def _chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, at each word that has so many."""
    m = len(h) - k + 1
    out = np.full(max(m, 0), k, np.uint64)
    for i in range(k if m > 0 else 0):
        out = (out ^ h[i : i + m]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out >> np.uint64(64 - BITS)


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingles of each text. Words are found, and lower-cased at ASCII letters, in the UTF-8 bytes."""
    blobs, out, i = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts], [], 0
    while i < len(blobs):
        j, size = i, 0
        while j < len(blobs) and (j == i or size < BATCH_BYTES):
            size, j = size + len(blobs[j]), j + 1
        data = np.frombuffer(b"\n".join(blobs[i:j]) + b"\n", np.uint8)
        first, past = edges(~_BLANK[data])
        h = hashed(_VALUE[data], first, past)
        at = np.searchsorted(first, np.r_[0, np.cumsum([len(b) + 1 for b in blobs[i:j]])])
        whole = _chained(h, WORDS)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            s = np.sort(whole[a : b - WORDS + 1] if b - a >= WORDS else _chained(h[a:b], b - a) if b > a else h[:0])
            out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s)
        i = j
    return out


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Numbers as byte planes: the upper ones of small numbers are nearly all zero and compress away in the exchange."""
    width = np.dtype(kind).itemsize
    return x.astype(kind).view(np.uint8).reshape(-1, width).T.tobytes()


def _numbers(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pack(x: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return _planes(np.diff(x, prepend=np.uint64(0)), "<u8")


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(_numbers(blob, "<u8"), dtype=np.uint64)


def _few(batch: pa.RecordBatch, n: int = 64):
    """(doc_id, tag, shingles) of a batch's rows, not many texts at a time."""
    for i in range(0, batch.num_rows, n):
        doc, tag, text = (c.to_pylist() for c in batch.slice(i, n).columns)
        yield from zip(doc, tag, shingles(text))


_ROW = "kind string, gk long, chunk long, toks binary, idx binary, num binary"
_ARROW = pa.schema([("kind", pa.string()), ("gk", pa.int64()), ("chunk", pa.int64()), ("toks", pa.binary()), ("idx", pa.binary()), ("num", pa.binary())])
_COLS = ["kind", "gk", "chunk", "toks", "idx", "num"]


def _extract(parts: int):
    """Per chunk of texts: rows T (shingles, sets), A (frequent shingles, counts), L (their lists), D (the sets)."""

    def run(batches):
        pid = TaskContext.get().partitionId() << 32
        turn, state = 0, None

        def flush():
            nonlocal turn
            docs, where, sets, sigs, tags = state
            chunk = pid | turn
            turn += 1
            own = -1 - chunk % (1 << 62)
            size = np.array([len(s) for s in sets], "<u4")
            rows = [("D", own, chunk, b"".join(sigs), size.tobytes(), b""), ("M", own, chunk, b"", np.array(where, "<i4").tobytes(), np.array([0 if d is None else d for d in docs], "<i8").tobytes() + np.array(tags, "<i8").tobytes() + np.array([d is None for d in docs], "?").tobytes())]
            if len(sets):
                toks, idx = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype="<u4"), size)
                order = np.argsort(toks, kind="stable")
                toks, idx = toks[order], idx[order]
                starts = np.flatnonzero(np.r_[True, toks[1:] != toks[:-1]])
                run_len = np.diff(np.r_[starts, len(toks)])
                often = np.repeat(run_len >= LOCAL, run_len)
                big = starts[run_len >= LOCAL]
                if len(big):
                    rows.append(("L", own, chunk, _pack(toks[big]), idx[often].tobytes(), run_len[run_len >= LOCAL].astype("<u4").tobytes()))
                for kind, t, other in (("T", toks[~often], idx[~often]), ("A", toks[big], run_len[run_len >= LOCAL].astype("<u4"))):
                    part = (t >> np.uint64(BITS - 32)) * np.uint64(parts) >> np.uint64(32)  # ranges of the sorted hashes
                    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(t) else []
                    for a, b in zip(cut, [*cut[1:], len(t)]):
                        o = other[a:b]
                        rows.append((kind, int(part[a]), chunk, _pack(t[a:b]), _planes(o, "<u2") if kind == "T" else o.tobytes(), b""))
            return pa.RecordBatch.from_pylist([dict(zip(_COLS, r)) for r in rows], _ARROW)

        state, known, n = ([], [], [], [], []), {}, 0
        for batch in batches:
            for doc, tag, s in _few(batch):
                state[0].append(doc)
                state[4].append(tag)
                if len(s):
                    sig = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    at = known.setdefault(sig, len(known))
                    if at == len(state[2]):
                        state[2].append(s)
                        state[3].append(sig)
                        n += len(s)
                    state[1].append(at)
                else:
                    state[1].append(-1)
                if n >= CHUNK or len(state[0]) == CHUNK_TEXTS:
                    yield flush()
                    state, known, n = ([], [], [], [], []), {}, 0
        if state[0]:
            yield flush()

    return run


def _count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One range of shingles: those of two or more sets go back to their chunks with their counts."""
    if key[0] < 0:
        return pdf[_COLS]
    kinds = pdf["kind"].tolist()
    toks = [_unpack(b) for b in pdf["toks"]]
    weight = [np.ones(len(t), np.int64) if k == "T" else np.frombuffer(i, "<u4").astype(np.int64) for k, t, i in zip(kinds, toks, pdf["idx"])]
    cat = np.concatenate(toks)
    order = np.argsort(cat, kind="stable")
    s = cat[order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    total = np.add.reduceat(np.concatenate(weight)[order], starts)
    df = np.empty(len(cat), "<u4")
    df[order] = np.repeat(np.minimum(total, 0xFFFFFFFF), np.diff(np.r_[starts, len(s)]))
    rows, at = [], 0
    for k, t, i, chunk in zip(kinds, toks, pdf["idx"], pdf["chunk"]):
        mine = df[at : at + len(t)]
        at += len(t)
        if k == "A":
            rows.append(("B", 0, chunk, _pack(t), b"", mine.tobytes()))
        elif (mine > 1).any():
            keep = mine > 1
            rows.append(("N", 0, chunk, _pack(t[keep]), _planes(_numbers(i, "<u2")[keep], "<u2"), _planes(mine[keep], "<u4")))
    del toks, weight, cat, order, s, df
    trim()
    return pd.DataFrame(rows, columns=_COLS)


def _assemble(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One chunk: rows M (doc_id, tag, n, sig) for its texts and R (sig, n, shared tokens, rarest first) for its sets."""
    by = {k: g for k, g in pdf.groupby("kind")}
    d, m = by["D"].iloc[0], by["M"].iloc[0]
    size = np.frombuffer(d["idx"], "<u4").astype(np.int64)
    sigs = [d["toks"][i : i + 16] for i in range(0, len(d["toks"]), 16)]
    where = np.frombuffer(m["idx"], "<i4")
    n = len(where)
    ids, tags, null = np.frombuffer(m["num"][: 8 * n], "<i8"), np.frombuffer(m["num"][8 * n : 16 * n], "<i8"), np.frombuffer(m["num"][16 * n :], "?")
    out = [pd.DataFrame({"kind": "M", "doc_id": pd.array(np.where(null, 0, ids), dtype="Int64"), "tag": pd.array(tags, dtype="Int64"), "n": [int(size[w]) if w >= 0 else 0 for w in where], "sig": [sigs[w] if w >= 0 else None for w in where], "toks": None})]
    out[0].loc[null, "doc_id"] = pd.NA
    t, i, f = [], [], []
    if "N" in by:
        for _, r in by["N"].iterrows():
            t.append(_unpack(r["toks"]))
            i.append(_numbers(r["idx"], "<u2").astype(np.int64))
            f.append(_numbers(r["num"], "<u4"))
    if "L" in by:
        r = by["L"].iloc[0]
        tok, run_len = _unpack(r["toks"]), np.frombuffer(r["num"], "<u4")
        found = {}
        bt = np.concatenate([_unpack(b) for b in by["B"]["toks"]])
        bf = np.concatenate([np.frombuffer(b, "<u4") for b in by["B"]["num"]])
        order = np.argsort(bt)
        found = bf[order][np.searchsorted(bt[order], tok)]
        t.append(np.repeat(tok, run_len))
        i.append(np.frombuffer(r["idx"], "<u4").astype(np.int64))
        f.append(np.repeat(found, run_len))
    if t:
        t, i, f = np.concatenate(t), np.concatenate(i), np.concatenate(f)
        order = np.lexsort((t, f, i))
        t, i = t[order], i[order]
        starts = np.searchsorted(i, np.arange(len(size) + 1))
        shared = np.diff(starts)
        good = np.flatnonzero(100 * shared >= PERCENT * size)
        nothing = pd.array([pd.NA] * len(good), dtype="Int64")
        out.append(pd.DataFrame({"kind": "R", "doc_id": nothing, "tag": nothing, "n": size[good], "sig": [sigs[g] for g in good], "toks": [t[starts[g] : starts[g + 1]].astype("<u8").tobytes() for g in good]}))
    trim()
    return pd.concat(out, ignore_index=True)


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members(doc_id, tag, n, sig) of all rows, and sets(sig, n, toks) of those that can link with another set. A tag is a
    hash of the text."""
    spark = docs.sparkSession
    lean_batches(spark)
    parts = max(shuffle_parts(spark), -(-docs.count() // TEXTS_A_PART))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tag"), "text").mapInArrow(trimmed(_extract(parts)), _ROW)
    counted = rows.groupBy("gk").applyInPandas(_count, _ROW)
    base = saved(counted.groupBy("chunk").applyInPandas(_assemble, "kind string, doc_id long, tag long, n long, sig binary, toks binary"), "shingles")
    del rows, counted
    tidy(spark)
    # Chunks may hold the same set; its tokens and their order are the same in all.
    sets = saved(base.where("kind = 'R'").groupBy("sig").agg(F.first("n").alias("n"), F.first("toks").alias("toks")), "sets")
    return base.where("kind = 'M'").select("doc_id", "tag", "n", "sig"), sets


def tidy(spark) -> None:
    """Let Spark drop shuffle files of plans that are no longer referenced: its cleaner acts on the driver's garbage
    collections, which are rare when executors do all the work."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def _subsets(n: int, m: int) -> int:
    """Subsets a set of n shingles, m of them shared, lists if it is light."""
    return sum(comb(m, overlap(n, p)) for p in range(need(n), 100 * n // PERCENT + 1) if overlap(n, p) <= m)


def boundary(sets: DataFrame, lists: DataFrame) -> int:
    """Largest size that is light: where scans saved less subsets listed is greatest. At most MOST_LIGHT^2 sums come back."""
    small = sets.where(F.col("n") <= MOST_LIGHT)
    hist = small.groupBy("n", (F.length("toks") / 8).cast("int").alias("m")).agg(F.count("*").alias("k")).collect()
    of = lists.where(F.col("n") <= MOST_LIGHT)
    scans = {r["n"]: r["s"] for r in of.join(of.groupBy("tok").agg(F.count("*").alias("k")), "tok").groupBy("n").agg(F.sum("k").alias("s")).collect()}
    best, gain, at = 0, 0, 0
    for n in range(1, MOST_LIGHT + 1):
        at += scans.get(n, 0) - sum(r["k"] * _subsets(n, r["m"]) for r in hist if r["n"] == n)
        if at > gain:
            best, gain = n, at
    return best


def subsets_of(sets, most: int):
    """(key, low, sig) of each subset that sets (sig, n, toks) list for partners of up to `most` shingles, one after another:
    a set may list a hundred thousand."""
    for sig, n, toks in sets:
        t = np.sort(np.frombuffer(toks, "<u8")).tolist()
        for p in range(need(n), min(most, 100 * n // PERCENT) + 1):
            lo, hi, c = min(n, p), max(n, p), overlap(n, p)
            for sub in combinations(t, c):
                yield hashlib.md5(repr((lo, hi, sub)).encode()).digest(), n == lo, sig


def light_links(sets: DataFrame, most: int) -> DataFrame:
    """(a, b): links among sets of at most `most` shingles, enough of them to connect all that link."""

    def run(batches):
        listed = subsets_of((x for pdf in batches for x in zip(pdf["sig"], pdf["n"], pdf["toks"])), most)
        while rows := list(islice(listed, SUBSETS)):
            yield pd.DataFrame(rows, columns=["key", "low", "sig"])

    subsets = sets.where(F.col("n") <= most).mapInPandas(run, "key binary, low boolean, sig binary")
    # Sets of the smaller size link among themselves and with all of the larger; without one nothing is implied.
    centre = subsets.groupBy("key").agg(F.min(F.when(F.col("low"), F.col("sig"))).alias("a"), F.count("*").alias("k")).where("k > 1 and a is not null")
    return subsets.join(centre.select("key", "a"), "key").where("a <> sig").select("a", F.col("sig").alias("b")).distinct()


def inverted(sets: DataFrame) -> DataFrame:
    """(tok, sig, n, pos, place): each set's prefix; pos is the shingle's place among all of the set, rarest first, and
    place that within the prefix."""

    def run(batches):
        for pdf in batches:
            out = {"tok": [], "sig": [], "n": [], "pos": [], "place": []}
            for sig, n, toks in zip(pdf["sig"], pdf["n"], pdf["toks"]):
                t = np.frombuffer(toks, "<i8")
                own = n - len(t)  # shingles of no other set are rarer still
                q = n - need(n) + 1 - own
                out["tok"] += t[:q].tolist()
                out["sig"] += [sig] * q
                out["n"] += [n] * q
                out["pos"] += range(own, own + q)
                out["place"] += range(q)
            yield pd.DataFrame(out)

    return sets.mapInPandas(run, "tok long, sig binary, n long, pos long, place int")


def _may_link(a: str, b: str):
    """Sizes and places allow a link, if this is the first shingle the two have in common."""
    na, nb, pa, pb = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    left = 1 + F.least(na - pa - 1, nb - pb - 1)
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & ((100 + PERCENT) * left >= PERCENT * (na + nb))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of sets that link."""

    def run(batches):
        for pdf in batches:
            keep = []
            for na, nb, ta, tb in zip(pdf["na"], pdf["nb"], pdf["ta"], pdf["tb"]):
                both = len(np.intersect1d(np.frombuffer(ta, "<u8"), np.frombuffer(tb, "<u8"), assume_unique=True))
                keep.append(100 * both >= PERCENT * (na + nb - both))
            yield pdf.loc[keep, ["a", "b"]]

    p = pairs.join(sets.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta")), "a")
    p = p.join(sets.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb")), "b")
    return p.mapInPandas(trimmed(run), "a binary, b binary")


def _leader_pairs(lists: DataFrame, most_light: int) -> DataFrame:
    """Pairs of each list's members with its leaders. Leaders go by a hash of the set alone: lists of the same group choose
    the same ones, so few distinct pairs arise."""
    first = [F.min(F.struct(F.xxhash64("sig", F.lit(r)), "sig", "n", "pos")).alias(f"l{r}") for r in range(LEADERS)]
    each = F.array_distinct(F.array(*[F.struct(*[f"l{r}.{c}" for c in ("sig", "n", "pos")]) for r in range(LEADERS)]))
    leaders = lists.groupBy("tok").agg(*first).select("tok", F.explode(each).alias("l")).select("tok", "l.*")
    # Not both light, and by sizes and places a link is possible.
    worth = (F.col("x.sig") != F.col("y.sig")) & (F.greatest("x.n", "y.n") > most_light) & _may_link("x", "y")
    both = lists.alias("x").join(leaders.alias("y"), "tok").where(worth)
    return both.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()


def _open(lists: DataFrame, label: DataFrame) -> DataFrame:
    """(hood, sig, comp): the members of lists that aren't one component yet, under the list's first leader."""
    now = lists.join(label.select(F.col("id").alias("sig"), "root"), "sig", "left").withColumn("comp", F.coalesce("root", "sig"))
    of = now.groupBy("tok").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y"), F.min(F.struct(F.xxhash64("sig", F.lit(0)), "sig")).alias("_l"))
    apart = of.where("_x <> _y").select("tok", F.col("_l.sig").alias("hood"))
    return saved(now.join(apart, "tok").select("hood", "sig", "comp").distinct(), "open")


def _scan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A pair of blocks: a forest (a, b) of its links between sets of different components, by counts along inverted lists."""
    mine = (pdf["block"] == key[1]).to_numpy()
    own, n, comp = np.flatnonzero(mine), pdf["n"].to_numpy(), pd.factorize(pdf["comp"])[0]
    met = own if key[1] == key[2] else np.flatnonzero(~mine)
    toks = [np.frombuffer(t, "<u8") for t in pdf["toks"]]
    size = np.array([len(t) for t in toks])
    flat = np.unique(np.concatenate(toks), return_inverse=True)[1]
    begin = np.r_[0, np.cumsum(size)]
    # The inverted lists of the second block: list k is holder[first[k]:first[k + 1]].
    held = np.concatenate([flat[begin[x] : begin[x + 1]] for x in met]) if len(met) else flat[:0]
    order = np.argsort(held, kind="stable")
    holder = np.repeat(np.arange(len(met)), size[met])[order]
    first = np.searchsorted(held[order], np.arange(flat.max() + 2))
    parent = list(range(len(pdf)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    a, b, sigs = [], [], pdf["sig"].to_list()
    for x in own.tolist():
        t = flat[begin[x] : begin[x + 1]]
        run = first[t + 1] - first[t]
        at = np.repeat(first[t] - np.cumsum(run) + run, run) + np.arange(run.sum())
        both = np.bincount(holder[at], minlength=len(met))
        for y in met[(100 * both >= PERCENT * (n[x] + n[met] - both)) & (comp[met] != comp[x])].tolist():
            p, q = find(x), find(y)
            if p != q:
                parent[p] = q
                a.append(sigs[x])
                b.append(sigs[y])
    return pd.DataFrame({"a": a, "b": b})


def _scanned(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that connect what is apart under one hood and does link, block by block."""
    m = open_.join(sets.select("sig", "n", "toks"), "sig").withColumn("bytes", F.octet_length("toks"))
    per = m.groupBy("hood", "comp").agg(F.sum("bytes").alias("bytes"))
    per = per.groupBy("hood").agg(F.max(F.struct("bytes", "comp")).alias("main"), F.sum("bytes").alias("all"))
    blocks = lambda c: F.ceil(c / SCAN_BYTES).cast("int")
    per = per.select("hood", F.col("main.comp").alias("main"), blocks(F.col("all") - F.col("main.bytes")).alias("rest"), blocks(F.col("main.bytes")).alias("mains"))
    m = m.join(per, "hood").withColumn("in_main", F.col("comp") == F.col("main"))
    deal = lambda n: F.pmod(F.xxhash64("sig"), n).cast("int")
    m = m.withColumn("block", F.when(F.col("in_main"), F.col("rest") + deal(F.col("mains"))).otherwise(deal(F.col("rest"))))
    # Blocks of the rest meet all blocks, those of the largest component only the rest's.
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest") - 1 + F.when(F.col("in_main"), 0).otherwise(F.col("mains")))))
    m = m.select("hood", "sig", "n", "toks", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return m.groupBy("hood", "i", "j").applyInPandas(_scan, "a binary, b binary")


def heavy_links(sets: DataFrame, lists: DataFrame, light: DataFrame, most_light: int) -> DataFrame:
    """(a, b): with light, links enough to connect all sets that link."""
    links = light.unionByName(verified(_leader_pairs(lists, most_light), sets))
    label = saved(components(links), "labels")
    tidy(sets.sparkSession)
    return label.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")).unionByName(_scanned(_open(lists, label), sets))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, tag, n, comp for every row of docs (doc_id, text); comp is null for texts without a set."""
    members, sets = classes(docs)
    lists = inverted(sets)
    lists = saved(lists.join(lists.groupBy("tok").agg(F.count("*").alias("_k")).where("_k > 1").select("tok"), "tok"), "lists")
    # Sets that share no list can't link any more.
    sets = saved(sets.join(lists.select("sig").distinct(), "sig", "left_semi"), "sets")
    tidy(docs.sparkSession)
    most = boundary(sets, lists)
    light = saved(light_links(sets, most), "links") if most else docs.sparkSession.createDataFrame([], "a binary, b binary")
    root = saved(components(heavy_links(sets, lists, light, most)), "roots")
    forget(lists)
    # Texts without a set stay alone.
    return members.join(root.withColumnRenamed("id", "sig"), "sig", "left").withColumn("comp", F.coalesce("root", "sig")).drop("root", "sig")


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    m = grouped(docs)
    least = m.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("_least"))
    out = m.join(least, "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of linked texts: that of the least doc_id (null last), then of the least tag."""
    m = grouped(docs).where("comp is not null")
    stays = m.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tag")).alias("_s"))
    gone = m.join(stays, "comp").where(~(F.col("doc_id").eqNullSafe(F.col("_s.doc_id")) & (F.col("tag") == F.col("_s.tag"))))
    gone = saved(gone.select(F.col("doc_id").alias("_gone"), F.col("tag").alias("_tag")).distinct(), "gone")
    gone = sized(gone)  # so that texts aren't shuffled for it
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_tag"]), "left_anti")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return components_of(load(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM r JOIN both_ways t ON r.b = t.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM r GROUP BY a) m ON m.a = d.doc_id
"""
