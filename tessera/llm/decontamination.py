"""Benchmark decontamination by template canonicalisation.

Text becomes a sequence of tokens; numbers, names (words with a capital first letter only) and units after numbers
become typed placeholders. Windows of WINDOW canonical tokens are hashed and joined with the benchmark's windows by hash.
Hits at one alignment of a document with an item form a run, and a run counts only if its slots are consistent: what an
item's placeholder held must always be replaced by the same value, and different values by different ones. So verbatim
passages are found and so are questions asked again with other numbers, names or units.

Two canonical forms are matched: one keeps names as lower-case words (copies with changed case), one replaces them.
Windows with fewer than LITERALS plain words say too little by themselves: they only propose an alignment (unless they
have no plain word at all), and the whole item is then laid on the document there. The alignment counts if its consistent
runs hold LITERALS words of the item unchanged, or are unchanged altogether. Items with fewer words than that match only
with their slots unchanged.

A document holds an item if a run covers RUN_TOKENS of its tokens (the whole item where that is shorter), or if all runs
together cover the share COVER of it. Items shorter than a window are matched whole. Items of up to SHORT tokens say
little in a longer text: such matches are reported as "short", and decontaminate() counts them if it is told to; in a
document that holds nothing else they are "whole" like all other matches.

The join. The benchmark's windows are a table of its distinct texts. Documents are cut into windows in one pass; a Bloom
filter of the benchmark's window hashes (at most FILTER_BITS bits, so broadcast) lets hardly any other window through,
and those that pass are joined with the table by hash: broadcast up to BROADCAST_WINDOWS rows, a shuffle beyond, whose
left side AQE splits where a window is hot. What is left are alignments; texts of documents and items meet only there, a
document with several items is encoded once, and each distinct text is judged once however often it occurs.

Defined results: null and empty texts match nothing, null or empty items neither. Each document row gives one row for
each item it holds; repeated rows repeat, repeated items too. Extra columns are not read by matches() and kept by
decontaminate(). Empty tables give empty results, and an empty benchmark leaves all documents.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import forget, lean_batches, load, saved, sized, trimmed
from .runs import edges, hashed, mixed

WINDOW, LITERALS, RUN_TOKENS, COVER, SHORT = 8, 4, 13, 0.6, 4
#: Bits of the filter for each window of the benchmark, most bits in all, and bits set by a window.
BITS_EACH, FILTER_BITS, PROBES = 32, 1 << 30, 4
#: A filter is built in segments of so many bits.
SEGMENT = 1 << 20
BROADCAST_WINDOWS = 1_000_000
#: Documents of a batch are worked on so many characters (or one text) at a time.
BATCH_CHARS = 1 << 17

UNITS = frozenset(
    "kg g mg km m cm mm mi miles mile lb lbs oz ft feet inch inches l ml liters litres hours hour minutes minute seconds second days day "
    "weeks week months month years year dollars dollar euros euro cents usd eur gbp percent degrees meters metres kilometers kilometres "
    "grams kilograms watts volts amps hz khz mhz ghz kb mb gb tb".split()
)
#: What a token is. All tokens of a batch are found at once, by what each code point is; tests hold that against this.
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
_SLOT = {NUMBER: 0x9E3779B97F4A7C15, NAME: 0xC2B2AE3D27D4EB4F, UNIT: 0x165667B19E3779F9}
_K = np.uint64(0x100000001B3)
#: Code points from here on are neither letters nor digits.
_PAST = 0x32400
_LETTER, _DIGIT, _POINT, _UPPER, _LOWER, _TITLE = 1, 2, 4, 8, 16, 32


@lru_cache(maxsize=None)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: what it is, and the value of its lower case in a token's hash."""
    kind, low = np.zeros(_PAST, np.uint8), np.arange(_PAST, dtype=np.uint64)
    for c in range(_PAST):
        x = chr(c)
        if x.isdecimal():
            kind[c] = _DIGIT
        elif x.isalnum():
            kind[c] = _LETTER
        if x.isupper() or x.istitle():
            kind[c] |= _UPPER if x.isupper() else _TITLE
            if len(x.lower()) == 1:
                low[c] = ord(x.lower())
        elif x.islower():
            kind[c] |= _LOWER
    kind[ord(".")] = kind[ord(",")] = _POINT
    return kind, mixed(low + np.uint64(1))


def _tokens(texts: list[str | None]):
    """(hashes of the lower-cased tokens, is a number, is a name, where each text starts) for all texts."""
    joined = "\n".join(t or "" for t in texts) + "\n"
    points = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), _PAST - 1)
    table, value = _characters()
    what = table[points]
    letter, digit = (what & _LETTER) != 0, what == _DIGIT
    # A point or comma between digits is part of a number.
    number = digit.copy()
    number[1:-1] |= (what[1:-1] == _POINT) & digit[:-2] & digit[2:]
    first, past = edges(letter)
    nfirst, npast = edges(number)
    order = np.argsort(np.r_[first, nfirst], kind="stable")
    starts, ends = np.r_[first, nfirst][order], np.r_[past, npast][order]
    lit = hashed(value[points], starts, ends)
    is_number = digit[starts] if len(starts) else np.zeros(0, bool)
    upper, lower = (np.r_[0, np.cumsum((what & bit) != 0)] for bit in (_UPPER | _TITLE, _LOWER))
    capital = (what[starts] & (_UPPER | _LETTER)) == (_UPPER | _LETTER) if len(starts) else np.zeros(0, bool)
    rest = (upper[ends] == upper[starts + 1]) & (lower[ends] > lower[starts + 1])
    is_name = capital & (rest | (ends - starts == 1))
    begin = np.r_[0, np.cumsum([len(t or "") + 1 for t in texts])]
    return lit, is_number, is_name, np.searchsorted(starts, begin)


@lru_cache(maxsize=None)
def _unit_hashes() -> np.ndarray:
    return np.sort(_tokens(sorted(UNITS))[0])


def encode(texts: list[str | None]):
    """Concatenated (literal hashes, kinds) of all texts, and where each text starts."""
    lit, is_number, is_name, start = _tokens(texts)
    units = _unit_hashes()
    unit = units[np.minimum(np.searchsorted(units, lit), len(units) - 1)] == lit
    kind = np.where(is_number, NUMBER, np.where(unit, UNIT, np.where(is_name, NAME, WORD))).astype(np.int8)
    before = np.r_[np.int8(WORD), kind[:-1]] if len(kind) else kind
    first = np.zeros(len(kind), bool)
    first[start[:-1][start[:-1] < len(kind)]] = True
    kind[(kind == UNIT) & ((before != NUMBER) | first)] = WORD  # a unit is one only after a number
    return lit, kind, start


def windows(lit: np.ndarray, kind: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(starts, hashes, weak) of n-token windows in the two forms, names kept and names replaced: of all windows, with
    slots unchanged where there are few plain words, and the weak ones: those of few plain words with slots replaced."""
    out = []
    for slots in ((NUMBER, UNIT), (NUMBER, UNIT, NAME)):
        code, plain = lit.copy(), np.ones(len(lit), np.int64)
        for k in slots:
            code[kind == k] = _SLOT[k]
            plain[kind == k] = 0
        m = len(lit) - n + 1
        if m <= 0:
            continue
        roll = lambda c: _roll(c, n, m)
        total = np.r_[0, np.cumsum(plain)]
        words = total[n:] - total[:-n]
        few = words < min(LITERALS, n)
        h = roll(code)
        if few.any():
            weak = np.flatnonzero(few & (words > 0))
            out.append((weak, h[weak] + np.uint64(n) * _K, True))
            h[few] = roll(lit)[few] ^ np.uint64(0x5555)
        out.append((np.arange(m), h + np.uint64(n) * _K, False))
    return out


def _roll(code: np.ndarray, n: int, m: int) -> np.ndarray:
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ code[i : i + m]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
    return h


def wordy(kind: np.ndarray) -> bool:
    """Enough words to be told by them when slots hold other values."""
    return int(((kind == WORD) | (kind == NAME)).sum()) >= min(LITERALS, WINDOW, len(kind))


def aligned(lit, kind, item_lit, item_kind, shift: int, n: int) -> list[tuple[int, int]]:
    """Runs of n tokens or more of a text that are the item's at this alignment, slots aside."""
    a, b = max(0, shift), min(len(lit), shift + len(item_lit))
    x, y = item_kind[a - shift : b - shift], kind[a:b]
    fits = item_lit[a - shift : b - shift] == lit[a:b]
    if wordy(item_kind):
        fits |= (x == y) & (x != WORD)
    edge = np.flatnonzero(np.diff(np.r_[False, fits, False].astype(np.int8)))
    return [(a + int(i), a + int(j)) for i, j in zip(edge[::2], edge[1::2]) if j - i >= n]


def consistent(lit, kind, item_lit, item_kind, shift: int, a: int, b: int) -> tuple[int, int]:
    """The longest stretch of [a, b) over which slot values map one to one."""
    there, back, lo, best = {}, {}, a, (a, a)
    last: dict[int, int] = {}
    for t in range(a, b):
        x, y = int(item_lit[t - shift]), int(lit[t])
        if item_kind[t - shift] == WORD and kind[t] == WORD or x == y and x not in there and y not in back:
            if x != y:  # can't be: literal positions of a hit are equal
                lo, there, back = t + 1, {}, {}
        elif there.get(x, y) != y or back.get(y, x) != x:
            lo = max(last.get(x, lo - 1), last.get(-1 - y, lo - 1)) + 1
            there = {p: q for p, q in there.items() if last[p] >= lo}
            back = {q: p for p, q in there.items()}
            there[x], back[y] = y, x
        else:
            there[x], back[y] = y, x
        last[x], last[-1 - y] = t, t
        if t + 1 - lo > best[1] - best[0]:
            best = (lo, t + 1)
    return best


def judge(lit, kind, item_lit, item_kind, shifts) -> tuple[int, int, int, bool, bool] | None:
    """(first token, tokens, item's tokens, verbatim, short) of the longest run if a text holds the item, else None."""
    size = len(item_lit)
    n, best, covered = min(WINDOW, size), None, set()
    for shift in sorted(shifts):
        spans = [consistent(lit, kind, item_lit, item_kind, shift, a, b) for a, b in aligned(lit, kind, item_lit, item_kind, shift, n)]
        spans = [(a, b) for a, b in spans if b - a >= n]
        same = [lit[a:b] == item_lit[a - shift : b - shift] for a, b in spans]
        words = sum(int((x & ((kind[a:b] == WORD) | (kind[a:b] == NAME))).sum()) for (a, b), x in zip(spans, same))
        for (a, b), x in zip(spans, same):
            if words >= min(LITERALS, n) or x.all():
                covered.update(range(a - shift, b - shift))
                if best is None or b - a > best[1]:
                    best = (a, b - a, size, bool(x.all()), size <= SHORT and len(lit) > size)
    return best if best and (best[1] >= min(RUN_TOKENS, size) or len(covered) >= COVER * size) else None


def templates(items: DataFrame) -> DataFrame:
    """(h, n, item, pos): the hashed windows of items(item, text)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item"], pdf["text"]):
                lit, kind, _ = encode([text])
                n = min(WINDOW, len(lit))
                for ps, hs, weak in windows(lit, kind, n) if n else ():
                    if wordy(kind) or not weak:
                        rows += zip(hs.view(np.int64).tolist(), [n] * len(ps), [item] * len(ps), ps.tolist())
            yield pd.DataFrame(rows, columns=["h", "n", "item", "pos"])

    return items.mapInPandas(run, "h long, n int, item binary, pos int").distinct()


def _probes(h: np.ndarray, bits: int):
    """The places of hashes in a filter, one probe at a time."""
    for k in range(PROBES):
        with np.errstate(over="ignore"):
            yield ((h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(29))) & np.uint64(bits - 1)


def bloom(table: DataFrame, rows: int) -> np.ndarray:
    """A Bloom filter of the table's hashes as bytes; built in segments on the executors, at most FILTER_BITS reach the driver."""
    bits = min(FILTER_BITS, max(SEGMENT, 1 << (max(1, rows) * BITS_EACH - 1).bit_length()))

    def places(batches):
        for pdf in batches:
            h = pdf["h"].to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([p for p in _probes(h, bits)])) if len(h) else h
            yield pd.DataFrame({"seg": (at // np.uint64(SEGMENT)).astype(np.int32), "at": (at % np.uint64(SEGMENT)).astype(np.int32)})

    def segment(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(SEGMENT, np.uint8)
        on[pdf["at"].to_numpy()] = 1
        return pd.DataFrame({"seg": [key[0]], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    # Segments have SEGMENT places at most, so a group is bounded too.
    segments = table.select("h").mapInPandas(places, "seg int, at int").distinct().groupBy("seg").applyInPandas(segment, "seg int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in segments.toLocalIterator():
        out[r["seg"] * (SEGMENT // 8) : (r["seg"] + 1) * (SEGMENT // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def passing(h: np.ndarray, filt: np.ndarray) -> np.ndarray:
    """Places of the hashes the filter may hold."""
    maybe = np.arange(len(h))
    for at in _probes(h, 8 * len(filt)):
        at = at[maybe]  # later probes only for what has passed the earlier ones
        maybe = maybe[(filt[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return maybe


def hits(texts: DataFrame, filt, lengths: list[int]) -> DataFrame:
    """(key, h, pos): windows of texts(key, text) that the filter (a broadcast) lets through."""

    def run(batches):
        for pdf in batches:
            keys, texts_, i = pdf["key"].to_numpy(), pdf["text"].to_list(), 0
            while i < len(texts_):
                j, chars = i, 0
                while j < len(texts_) and (j == i or chars < BATCH_CHARS):
                    chars += len(texts_[j] or "")
                    j += 1
                lit, kind, start = encode(texts_[i:j])
                for n in lengths:
                    for ps, hs, _ in windows(lit, kind, n):
                        met = passing(hs, filt.value)
                        d = np.searchsorted(start, ps[met], side="right") - 1
                        inside = ps[met] + n <= start[d + 1]  # not running over into the next text
                        met, d = met[inside], d[inside]
                        if n <= SHORT and len(met):  # the first place says all of an item matched whole and word by word
                            first = np.unique(np.stack([d.astype(np.uint64), hs[met]]), axis=1, return_index=True)[1]
                            met, d = met[first], d[first]
                        if len(met):
                            yield pd.DataFrame({"key": keys[i + d], "h": hs[met].view(np.int64), "pos": (ps[met] - start[d]).astype(np.int32)})
                i = j

    return texts.mapInPandas(trimmed(run), "key binary, h long, pos int")


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item, first_token, n_tokens, item_tokens, verbatim, short) by md5 of the texts: what each distinct document text
    holds of each distinct item text."""
    spark = docs.sparkSession
    lean_batches(spark)
    key = F.md5("text").cast("binary")
    texts = docs.where("text <> ''").select(key.alias("key"), "text")
    items = benchmark.where("text <> ''").select(key.alias("item"), "text").dropDuplicates(["item"])
    table = saved(templates(items), "templates")
    rows = table.count()
    sent = spark.sparkContext.broadcast(bloom(table, rows))
    lengths = sorted(r["n"] for r in table.select("n").distinct().collect())  # eight at most
    small = rows <= BROADCAST_WINDOWS
    t = table.select("h", "item", F.col("pos").alias("at"))
    at = hits(texts, sent, lengths).join(F.broadcast(t) if small else t, "h").select("key", "item", (F.col("pos") - F.col("at")).alias("shift"))
    # Shifts of one text and one item: fewer than they have tokens.
    at = saved(at.groupBy("key", "item").agg(F.collect_set("shift").alias("shifts")), "aligned")
    held = texts.join(sized(at.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
    both = at.join(held, "key").join(items.withColumnRenamed("text", "item_text"), "item")

    def run(batches):
        own, bench = (None, None), {}
        for pdf in batches:
            out = []
            for k, i, shifts, text, item in zip(pdf["key"], pdf["item"], pdf["shifts"], pdf["text"], pdf["item_text"]):
                if own[0] != k:  # rows of a text come together
                    own = k, encode([text])[:2]
                if i not in bench:
                    if len(bench) > 10_000:
                        bench.clear()
                    bench[i] = encode([item])[:2]
                got = judge(*own[1], *bench[i], shifts.tolist())
                if got:
                    out.append((k, i, *got))
            yield pd.DataFrame(out, columns=["key", "item", "first_token", "n_tokens", "item_tokens", "verbatim", "short"])

    out = both.sortWithinPartitions("key").mapInPandas(trimmed(run), "key binary, item binary, first_token long, n_tokens long, item_tokens long, verbatim boolean, short boolean")
    out = saved(out, "found")
    forget(table)
    forget(at)
    return out


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_token, n_tokens, item_tokens, verbatim, kind: one row for each document row and item it holds.

    kind is "whole", or "short" for items of up to SHORT tokens within longer texts.
    """
    f = found(docs, benchmark)
    key = F.md5("text").cast("binary")
    d = docs.select(F.col("doc_id").cast("long"), key.alias("key"))
    ids = benchmark.select(F.col("item_id").cast("long"), key.alias("item"))
    out = d.join(f, "key").join(ids, "item")
    return out.select("doc_id", "item_id", "first_token", "n_tokens", "item_tokens", "verbatim", F.when(F.col("short"), "short").otherwise("whole").alias("kind"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, short: bool = False) -> DataFrame:
    """docs without the rows that hold benchmark items; short: also without those that hold only items of up to SHORT tokens
    within longer texts."""
    gone = sized(found(docs, benchmark).where(F.lit(short) | ~F.col("short")).select(F.col("key").alias("_gone")).distinct())
    return docs.join(gone, F.md5(docs["text"]).cast("binary") == gone["_gone"], "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
