"""Tokens a document has under a byte-level BPE vocabulary, counted without materialising the ids of any document.

A token never spans two pre-tokens, so a document's tokens are the sum, over its pre-tokens, of frequency times pieces.
Tasks cut texts into pre-tokens and count them a document; documents of up to CHUNK characters share one list of distinct
pre-tokens. What a chunk knows of a pre-token (which documents have it, how often) travels to the bucket that the pre-token
hashes to. There the vocabulary is asked once for each distinct pre-token, joined to the frequencies, and what goes back is
one number a document and bucket. Two exchanges, no broadcast, nothing on the driver; a pre-token that every document has is
one entry a chunk, so no key is hot. Work and rows exchanged are in proportion to the text at every size.

Pre-tokens are found for many texts at once: characters are classed as letter, number, white space or other by the Unicode
database, and runs of a class, the blank before them and contractions follow from the classes. Texts with characters whose
class changed between versions of Unicode are cut by the library itself.

Defined results: a null text is an empty one: no bytes, no tokens. Rows are counted one by one, so repeated ids, null ids
and equal texts give a row each. An empty table gives an empty result. Columns other than doc_id and text are not read.
Strings of added tokens inside a text count as one token each, as is the library's default. A text is never cut: very
long ones are worked on in pieces that begin where a pre-token begins. A file of another kind than byte-level BPE raises.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import lean_batches, load, shuffle_parts, trim, trimmed
from .runs import hashed

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters worked on at once; a longer text goes in pieces of about so many.
BLOCK = 400_000
#: Characters, and documents, that share a list of distinct pre-tokens.
CHUNK, CHUNK_DOCUMENTS = 32_000_000, 65_000
#: Buckets a shuffle partition.
BUCKETS = 4

_OTHER, _LETTER, _NUMBER, _SPACE, _UNSURE, _END = range(6)
#: Code points of the Unicode property White_Space.
_BLANK = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

SENT = "chunk long, bucket int, ids binary, missing binary, sizes binary, added binary, words string, lengths binary, holders binary, documents binary, times binary"
BACK = "chunk long, ids binary, missing binary, sizes binary, added binary, documents binary, sums binary"

#: A blank between two characters that aren't white space begins a pre-token.
_CUT = re.compile(r"(?<=\S) (?=\S)")


_classed: np.ndarray | None = None


def _classes() -> np.ndarray:
    """The class of every code point; built once a process."""
    global _classed
    if _classed is None:
        kinds = {"L": _LETTER, "N": _NUMBER}
        of = lambda u: np.array([kinds.get(u.category(chr(c))[0], _OTHER) for c in range(0x30000)], np.uint8)
        now, then = of(unicodedata), of(unicodedata.ucd_3_2_0)
        table = np.full(0x110000, _UNSURE, np.uint8)
        free = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x30000)])
        table[:0x30000] = np.where((now == then) & ~free, now, _UNSURE)
        table[_BLANK] = _SPACE
        _classed = table
    return _classed


def _bounds(u: np.ndarray, cls: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first, past) of pre-tokens in code points u, each text of which ends with one of class _END; two ascending lists."""
    first = np.r_[0, np.flatnonzero(cls[1:] != cls[:-1]) + 1]
    past = np.r_[first[1:], len(u)]
    kind = cls[first]
    after = np.r_[kind[1:], _END]
    # Words take one blank (U+0020) before them.
    solid = kind < _SPACE
    begin = first.copy()
    begin[1:] -= solid[1:] & (kind[:-1] == _SPACE) & (u[first[1:] - 1] == 32)
    end = past.copy()
    # An apostrophe by itself takes what makes it a contraction from the letters after it.
    alone = np.flatnonzero((kind == _OTHER) & (past - first == 1) & (u[first] == 39) & (begin == first) & (after == _LETTER))
    if len(alone):
        a, b = u[past[alone]], u[np.minimum(past[alone] + 1, len(u) - 1)]
        two = (past[alone + 1] - first[alone + 1] > 1) & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        took = np.where(np.isin(a, [115, 116, 109, 100]), 1, np.where(two, 2, 0))
        end[alone] += took
        begin[alone + 1] += took
    keep = solid & (end > begin)
    words = begin[keep], end[keep]
    # White space before a text's end is one; else its last character stands by itself or belongs to the word behind it.
    s, e, last = first[kind == _SPACE], past[kind == _SPACE], after[kind == _SPACE] == _END
    body = np.where(last, e, e - 1)
    own = ~last & (u[e - 1] != 32)
    f, p = np.r_[s, e[own] - 1], np.r_[body, e[own]]
    order = np.argsort(f, kind="stable")
    f, p = f[order], p[order]
    return [words, (f[p > f], p[p > f])]


class Splitter:
    """Cuts texts into pre-tokens as the vocabulary's file says, and tells the pieces of one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model, added = spec["pre_tokenizer"] or {}, spec["model"], spec.get("added_tokens") or []
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and model["type"] == "BPE"
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        self.tokenizer = Tokenizer.from_file(path)
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        # Byte-level vocabularies write bytes as characters that can be printed: those that can stand for themselves.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        self.shown = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def pieces(self, word: str) -> int:
        return len(self.tokenizer.model.tokenize("".join([self.shown[b] for b in word.encode()])))

    def parts(self, text: str):
        """Segments of a text without added tokens, cut further where they are very long; and the number of added tokens."""
        segments = self.added.split(text) if self.added else [text]
        out = []
        for s in segments:
            at = 0
            while len(s) - at > BLOCK:
                cut = _CUT.search(s, at + BLOCK)
                if not cut:
                    break
                out.append(s[at : cut.start()])
                at = cut.start()
            out.append(s[at:])
        return [s for s in out if s], len(segments) - 1

    def slow(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


class _Chunk:
    """Distinct pre-tokens of some documents, and who holds them."""

    def __init__(self, splitter: Splitter):
        self.splitter = splitter
        self.ids, self.sizes, self.added = [], [], []
        self.chars = 0
        self.waiting, self.wait_docs, self.wait_chars = [], [], 0
        self.hashes, self.docs, self.times, self.seen, self.words = [], [], [], [], []

    def add(self, doc_id, text: str) -> None:
        k = len(self.ids)
        parts, n = self.splitter.parts(text)
        self.ids.append(doc_id)
        self.sizes.append(len(text.encode()))
        self.added.append(n)
        self.chars += len(text)
        for p in parts:
            if self.waiting and self.wait_chars + len(p) > BLOCK:
                self.block()
            self.waiting.append(p)
            self.wait_docs.append(k)
            self.wait_chars += len(p) + 1

    def block(self) -> None:
        """The pre-tokens of the texts that wait."""
        if not self.waiting:
            return
        texts, docs = self.waiting, np.array(self.wait_docs, np.int64)
        self.waiting, self.wait_docs, self.wait_chars = [], [], 0
        whole = "\n".join(texts) + "\n"
        u = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        cls = _classes()[u]
        unsure = np.flatnonzero(cls == _UNSURE)
        cls[ends] = _END
        values = u.astype(np.uint64) + np.uint64(1)
        odd = np.unique(np.searchsorted(ends, unsure)) if len(unsure) else unsure
        first, past, owner = [], [], []
        for f, p in _bounds(u, cls):
            n = np.diff(np.searchsorted(f, ends), prepend=0)
            w = np.repeat(np.arange(len(texts)), n)
            if len(odd):
                keep = ~np.isin(w, odd)
                f, p, w = f[keep], p[keep], w[keep]
            first.append(f)
            past.append(p)
            owner.append(w)
        for k in odd.tolist():
            spans = np.array([s for _, s in self.splitter.tokenizer.pre_tokenizer.pre_tokenize_str(texts[k])], np.int64).reshape(-1, 2) + (ends[k] - len(texts[k]))
            first.append(spans[:, 0])
            past.append(spans[:, 1])
            owner.append(np.full(len(spans), k))
        first, past, owner = np.concatenate(first), np.concatenate(past), np.concatenate(owner)
        hashes, at, which = np.unique(hashed(values, first, past), return_index=True, return_inverse=True)
        pair, times = np.unique(docs[owner] * len(hashes) + which, return_counts=True)
        self.hashes.append(hashes[pair % len(hashes)] if len(hashes) else hashes)
        self.docs.append((pair // max(1, len(hashes))).astype(np.uint16))
        self.times.append(times.astype(np.uint32))
        self.seen.append(hashes)
        self.words += [whole[a:b] for a, b in zip(first[at].tolist(), past[at].tolist())]

    def rows(self, chunk: int, buckets: int):
        """One row for the documents themselves and one a bucket."""
        self.block()
        ids = np.array([i or 0 for i in self.ids], np.int64).tobytes()
        yield {"chunk": chunk, "bucket": chunk % buckets, "ids": ids, "missing": bytes([i is None for i in self.ids]), "sizes": _narrow(self.sizes), "added": _narrow(self.added)}
        if not self.words:
            return
        seen = np.concatenate(self.seen)
        words, at = np.unique(seen, return_index=True)
        texts = self.words
        k = np.searchsorted(words, np.concatenate(self.hashes))
        bucket = (words >> np.uint64(17)) % np.uint64(buckets)
        # By bucket, then word, then document.
        word_order = np.lexsort((words, bucket))
        place = np.empty(len(words), np.int64)
        place[word_order] = np.arange(len(words))
        docs, times = np.concatenate(self.docs), np.concatenate(self.times)
        order = np.argsort(place[k] << 16 | docs)
        k, docs, times = k[order], docs[order], times[order]
        holders = np.bincount(k, minlength=len(words))
        edges = np.r_[0, np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))]
        posts = np.r_[0, np.cumsum(holders[word_order])]
        for b in range(buckets):
            own = word_order[edges[b] : edges[b + 1]]
            if not len(own):
                continue
            names = [texts[i] for i in at[own].tolist()]
            lo, hi = posts[edges[b]], posts[edges[b + 1]]
            yield {
                "chunk": chunk, "bucket": b, "words": "".join(names), "lengths": _narrow([len(n) for n in names]), "holders": _narrow(holders[own]),
                "documents": docs[lo:hi].tobytes(), "times": _narrow(times[lo:hi]),
            }


def _narrow(values) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs; the first byte says how many."""
    v = np.asarray(values, np.int64)
    width = next(w for w in (1, 2, 4, 8) if not len(v) or int(v.max()) < 1 << (8 * w))
    return bytes([width]) + v.astype(f"<u{width}").tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def frequencies(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    """Rows of SENT: chunks of documents, and their pre-tokens with frequencies, one row a chunk and bucket."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SENT))

    def run(batches):
        splitter, part, made = Splitter(path), TaskContext.get().partitionId(), 0

        def out(chunk):
            nonlocal made
            rows = []
            for row in chunk.rows(part << 32 | made, buckets):
                rows.append(row)
                if len(rows) == 64:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
            made += 1
            trim()

        chunk = _Chunk(splitter)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunk.add(doc_id, text.as_py() or "")
                if chunk.chars >= CHUNK or len(chunk.ids) >= CHUNK_DOCUMENTS:
                    yield from out(chunk)
                    chunk = _Chunk(splitter)
        if chunk.ids:
            yield from out(chunk)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), SENT)


def summed(sent: DataFrame, path: str) -> DataFrame:
    """Rows of BACK: for each chunk and bucket, tokens a document has in the bucket's pre-tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(BACK))

    def run(batches):
        splitter, known = Splitter(path), {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["ids"] is not None:
                    rows.append({k: r[k] for k in ("chunk", "ids", "missing", "sizes", "added")})
                    continue
                ends = np.cumsum(_wide(r["lengths"])).tolist()
                text, at, n = r["words"], 0, []
                for e in ends:
                    word = text[at:e]
                    at = e
                    c = known.get(word)
                    if c is None:
                        c = known[word] = splitter.pieces(word)
                    n.append(c)
                each = np.repeat(np.array(n, np.int64), _wide(r["holders"])) * _wide(r["times"])
                docs = np.frombuffer(r["documents"], np.uint16)
                # Sums in integers: a text may have more tokens than a float tells apart.
                order = np.argsort(docs, kind="stable")
                d, s = np.unique(docs, return_index=True)
                rows.append({"chunk": r["chunk"], "documents": d.tobytes(), "sums": _narrow(np.add.reduceat(each[order], np.searchsorted(docs[order], d)) if len(s) else each)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return sent.mapInArrow(trimmed(run), BACK)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of docs. path: the vocabulary's file, which every executor can read."""
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    lean_batches(spark)
    parts = shuffle_parts(spark)
    sent = frequencies(docs, path, parts * BUCKETS).repartition(parts, "bucket")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        meta = pdf[pdf["ids"].notna()].iloc[0]
        total = _wide(meta["added"]).copy()
        for d, s in zip(pdf["documents"], pdf["sums"]):
            if d is not None:
                total[np.frombuffer(d, np.uint16)] += _wide(s)
        ids = pd.arrays.IntegerArray(np.frombuffer(meta["ids"], np.int64), np.frombuffer(meta["missing"], np.bool_))
        return pd.DataFrame({"doc_id": ids, "n_bytes": _wide(meta["sizes"]), "n_tokens": total})

    return summed(sent, path).groupBy("chunk").applyInPandas(whole, "doc_id long, n_bytes long, n_tokens long")


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
