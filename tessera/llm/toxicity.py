"""Toxic spans by a linear-chain conditional random field.

Training, on at most MAX_DOCS labelled documents of each class (those of least hash among texts of at most MAX_CHARS;
rows whose crc32(doc_id) mod 4 is 2 never train). Labels are of documents; which tokens are toxic is latent:
  1. units are words and their first 4 to 7 letters, so that rare words share what they begin with. A unit is marked if it
     is met, or met more than once, in far more toxic than clean documents (a G-test over fresh contexts);
  2. a token's features are its marked units and, if it has any, how many tokens of other words with marked units stand within
     NEAR tokens: the same word may be clean alone and toxic in company. Transitions join neighbours;
  3. the field maximises the likelihood of the labels: a clean document has only clean tokens, a toxic one at least one
     that is toxic. The gradient is that of this likelihood but for bounds that keep it finite: scores of a token are held
     within 25, and the pull of a document, which grows without end as its score falls, within 50. A toxic document pulls its features by the forward-backward posterior given
     that not all tokens are clean, less the free one; a clean one pushes by the free one. Documents are worked on in groups
     of FIT_TOKENS tokens (or one text);
  4. document scores are calibrated on the training documents from the field's probability that any token is toxic, the
     sum of the token marginals and their density.

Scoring: forward-backward over every token of the whole text, many documents side by side; memory is bounded by
BATCH_TOKENS tokens (or one text). The text is the only input of a score.

Defined results: a null or empty text has no tokens and gets the calibrated score of no evidence. If there are no
labels of both classes, all scores are 0. Repeated rows are scored alike. Labels other than 0 and 1 don't train; a document
with both labels is toxic. A score of exactly THRESHOLD is toxic. Extra columns are not read. Empty tables give empty
results.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import forget, lean_batches, load, saved, trimmed

MAX_DOCS, MAX_CHARS = 2_000, 20_000
PREFIXES = (4, 5, 6, 7)
#: A token keeps company with others up to so many tokens away, and more than CROWD of them are as many as CROWD.
NEAR, CROWD = 64, 2
RIDGE = 0.1
THRESHOLD = 0.3
BATCH_TOKENS = 1 << 20
#: The expectations of a fit are summed over groups of documents of so many tokens.
FIT_TOKENS = 1 << 18
#: A unit is marked if its odds in toxic documents are so many times those in clean ones, and if a G-test of
#: that is beyond GUESS (one in a million: there are very many words to try).
ODDS, GUESS = 12.0, 27.6
_TOKEN = re.compile(r"[^\W\d_]+")


def units(word: str) -> tuple[str, ...]:
    """What words are told by: the word and how it begins."""
    return (word, *[f"{k}{word[:k]}" for k in PREFIXES if len(word) > k])


class _Emissions(dict):
    """Lower- or mixed-case token to the weight of its marked units; nan if it has none."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) > 150_000:
            self.clear()
        w = [self.weights[u] for u in units(token.lower()) if u in self.weights]
        out = self[token] = float(np.clip(sum(w), -25, 25)) if w else np.nan
        return out


def company(at: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For tokens at ascending places with the numbers of their words: how many tokens of other words are within NEAR of
    each, up to CROWD."""
    if not len(at):
        return at
    n = np.searchsorted(at, at + NEAR, side="right") - np.searchsorted(at, at - NEAR)
    # The same count among tokens of the same word: their places in a range of their own.
    mine = word * (2 * NEAR + int(at[-1]) + 1) + at
    own = np.sort(mine)
    same = np.searchsorted(own, mine + NEAR, side="right") - np.searchsorted(own, mine - NEAR)
    return np.minimum(n - same, CROWD)


@dataclass
class Model:
    #: Weight of each marked unit.
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -9.0
    #: What a token with marked units gets for the company it keeps.
    near: tuple = (8.0,) * (CROWD + 1)
    #: a[i][j]: potential of state j after state i.
    a: tuple = ((1.0, 1.0), (1.0, 1.0))
    calibration: tuple | None = None

    def emissions(self, text: str | None) -> np.ndarray:
        """The field's score of the toxic state for each token."""
        emit = self.__dict__.setdefault("_emit", _Emissions(self.weights))
        words = _TOKEN.findall(text) if text else []
        e = np.fromiter(map(emit.__getitem__, words), float, len(words))
        at = np.flatnonzero(~np.isnan(e))
        number: dict[str, int] = {}
        which = np.array([number.setdefault(words[t].lower(), len(number)) for t in at.tolist()], np.int64)
        out = np.full(len(e), self.bias)
        out[at] += e[at] + np.array(self.near)[company(at, which)]
        return np.clip(out, -25, 25)

    def score(self, texts: list) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Document scores, and each document's toxic spans as (first, past last) character offsets."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))
        score, spans = np.zeros(len(texts)), [[] for _ in texts]
        group, size = [], 0

        def flush():
            none: list = []
            for (i, _), p, z in zip(group, marginal([e for _, e in group], self.a, none=none), none):
                score[i] = self._calibrated(p, z)
                if len(p) and p.max() >= 0.5:
                    hit = set(np.flatnonzero(p >= 0.5).tolist())
                    spans[i] = [m.span() for k, m in enumerate(_TOKEN.finditer(texts[i])) if k in hit]
            group.clear()

        for i in order:
            group.append((i, self.emissions(texts[i])))
            size += len(group[-1][1])
            if size >= BATCH_TOKENS:
                flush()
                size = 0
        flush()
        return score, spans

    def _calibrated(self, p: np.ndarray, none: float) -> float:
        if self.calibration is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(_evidence(p, none) @ np.array(self.calibration), -30, 30))))


def _evidence(p: np.ndarray, none: float) -> np.ndarray:
    """From the token marginals and the log-probability that no token is toxic."""
    total = float(p.sum())
    odds = np.log(max(-np.expm1(none), 1e-9)) - none
    return np.array([float(np.clip(odds, -6, 6)) / 3, min(total, 6.0) / 2, float(np.log1p(500 * total / (len(p) + 25))), 1.0])


def _ragged(seqs: list[np.ndarray]):
    """Sequences, longest first, laid out by time: at step t the first width[t] sequences have a token."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    lens = np.array([len(seqs[i]) for i in order])
    width = np.searchsorted(-lens, -np.arange(1, (lens[0] if len(lens) else 0) + 1), side="right")
    off = np.r_[0, np.cumsum(width)]
    at = [off[: len(seqs[i])] + j for j, i in enumerate(order)]
    return order, width, off, at


def marginal(seqs: list[np.ndarray], a, pairs: list | None = None, none: list | None = None) -> list[np.ndarray]:
    """P(state 1) of each token of each sequence of emission scores, by forward-backward in ratio form.

    pairs, if given, gets each sequence's four pair expectations (state now, state next); none gets the log-probabilities
    that a sequence has no token in state 1.
    """
    if not seqs:
        return []
    (a00, a01), (a10, a11) = a
    order, width, off, at = _ragged(seqs)
    e = np.empty(off[-1])
    for j, i in enumerate(order):
        e[at[j]] = seqs[i]
    e = np.exp(e)
    r, b = e.copy(), np.ones(off[-1])
    T = len(width)
    for t in range(1, T):
        w, s, q = width[t], off[t], off[t - 1]
        x = r[q : q + w]
        r[s : s + w] = np.clip(e[s : s + w] * (a01 + x * a11) / (a00 + x * a10), 1e-280, 1e280)
    for t in range(T - 2, -1, -1):
        w, s, q = width[t + 1], off[t + 1], off[t]
        y = e[s : s + w] * b[s : s + w]
        b[q : q + w] = np.clip((a10 + a11 * y) / (a00 + a01 * y), 1e-280, 1e280)
    if pairs is not None:
        total = np.zeros((4, len(seqs)))
        for t in range(T - 1):
            w, s, q = width[t + 1], off[t + 1], off[t]
            x, y = r[q : q + w], e[s : s + w] * b[s : s + w]
            z = np.stack([a00 * np.ones(w), a01 * y, a10 * x, a11 * x * y])
            total[:, :w] += z / z.sum(0)
        pairs += total[:, np.argsort(order)].T.tolist()
    if none is not None:
        gone = np.zeros(len(seqs))
        for t in range(T):
            w, s = width[t], off[t]
            on = width[t + 1] if t + 1 < T else 0  # these have a next token, the others end here
            x = r[s : s + w]
            gone[:on] -= np.log1p(x[:on] * a10 / a00)
            gone[on:w] -= np.log1p(x[on:])
        none += gone[np.argsort(order)].tolist()
    odds = np.minimum(r, 1e150) * np.minimum(b, 1e150)
    p = odds / (1 + odds)
    out: list = [None] * len(seqs)
    for j, i in enumerate(order):
        out[i] = p[at[j]]
    return out


def _telling(a: int, n1: int, b: int, n0: int) -> bool:
    if a < 3 or a / n1 < ODDS * (b + 0.1) / (n0 + 1):
        return False
    share = n1 / (n1 + n0)
    g = a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0.0)
    return 2 * g >= GUESS


def _marked(docs: list[tuple[list[int], int]], names: list[str]) -> dict[str, float]:
    """Units that toxic documents show, or show more than once, far more often than clean ones do; with their log odds.

    A document counts for a unit if it shows it in a context (word before and after) not met before: near copies of a toxic
    document would otherwise make all their rare words look toxic.
    """
    met, seen = (set(), set()), {(y, k): Counter() for y in (0, 1) for k in (1, 2)}
    for words, y in docs:
        new = Counter()
        for before, w, after in zip([-1, *words], words, [*words[1:], -1]):
            c = hash((before, w, after))
            if c not in met[y]:
                met[y].add(c)
                new[w] += 1
        of = Counter()
        for w, n in new.items():
            for u in units(names[w]):
                of[u] += n
        seen[y, 1].update(of.keys())
        seen[y, 2].update(u for u, n in of.items() if n > 1)
    n1 = sum(y for _, y in docs)
    n0 = len(docs) - n1
    told = {u for k in (1, 2) for u, n in seen[1, k].items() if _telling(n, n1, seen[0, k][u], n0)}
    return {u: float(np.clip(np.log((seen[1, 1][u] + 0.5) / (seen[0, 1][u] + 0.5) * n0 / n1), 0, 8)) for u in told}


def fit(rows: list[tuple[str, int]], weight_clean: float = 1.0, rounds: int = 40) -> Model:
    """Fit on (text, toxic) documents; texts met twice count once. A clean document counts weight_clean."""
    rows = sorted(set(rows))
    n1 = sum(y for _, y in rows)
    if not n1 or n1 == len(rows):
        return Model()
    # Words are kept once; a document is the numbers of its words.
    types: dict[str, int] = {}
    docs = [([types.setdefault(w, len(types)) for w in _TOKEN.findall(t.lower())], y) for t, y in rows]
    names = list(types)
    del rows, types
    odds = _marked(docs, names)
    marked = sorted(odds)
    index = {u: k for k, u in enumerate(marked)}
    of = {w: [index[u] for u in units(x) if u in index] for w, x in enumerate(names)}
    # A document from here on: its length, the places of tokens with marked units, those words and the company they keep.
    docs.sort(key=lambda d: -len(d[0]))
    slim = []
    for words, y in docs:
        at = np.array([t for t, w in enumerate(words) if of[w]], np.int64)
        which = [words[t] for t in at]
        slim.append((len(words), at, which, company(at, np.array(which, np.int64)), y))
    groups, size = [[]], 0
    for d in slim:
        if size >= FIT_TOKENS:
            groups.append([])
            size = 0
        groups[-1].append(d)
        size += d[0]
    used = sorted({w for d in slim for w in d[2]})
    row = {w: k for k, w in enumerate(used)}
    slim_words = [np.array([row[w] for w in d[2]], np.int64) for d in slim]
    unit_rows = np.array([k for k, w in enumerate(used) for _ in of[w]], np.int64)
    unit_cols = np.array([u for w in used for u in of[w]], np.int64)
    # One toxic token in ten documents, unless something is marked. A unit's weight is drawn to its log odds, shared among the
    # units that stand for the same words.
    bias = -float(np.log(10 * max(10.0, sum(d[0] for d in slim) / len(slim))))
    together = np.bincount(unit_cols, [len(of[used[k]]) for k in unit_rows], minlength=len(index)) / np.maximum(1, np.bincount(unit_cols, minlength=len(index)))
    prior = np.array([odds[u] for u in marked]) / np.maximum(1, together)
    w, trans, near = prior.copy(), np.zeros(4), -bias - 4 + np.arange(-1.0, CROWD)
    steps = [np.full(len(index), 1e-6), np.full(4, 1e-6), np.full(CROWD + 1, 1e-6), 1e-6]

    def scores(d, words):
        e = np.full(d[0], bias)
        e[d[1]] += word_weight[words] + near[d[3]]
        return np.clip(e, -25, 25)

    for turn in range(rounds + 1):
        word_weight = np.bincount(unit_rows, w[unit_cols], minlength=len(used))
        a = tuple(map(tuple, np.exp(trans).reshape(2, 2)))
        gw, gt, gn, gb, evidence, k = np.zeros(len(used)), np.zeros(4), np.zeros(CROWD + 1), 0.0, [], 0
        for group in groups:
            pairs, none = [], []
            mine = slim_words[k : k + len(group)]
            k += len(group)
            found = marginal([scores(d, x) for d, x in zip(group, mine)], a, pairs, none)
            for d, x, p, two, z in zip(group, mine, found, pairs, none):
                if turn == rounds:
                    evidence.append(_evidence(p, z))
                    continue
                # The posterior given the label, less the free one, of all that isn't the all-clean sequence.
                pull = float(np.exp(z - np.log(max(-np.expm1(z), 1e-9)))) if d[4] else -weight_clean
                pull = min(pull, 50.0)
                np.add.at(gw, x, pull * p[d[1]])
                np.add.at(gn, d[3], pull * p[d[1]])
                gb += pull * p.sum()
                gt += pull * (np.array(two) - [max(0, d[0] - 1), 0, 0, 0])
        if turn == rounds:
            break
        gu = np.bincount(unit_cols, gw[unit_rows], minlength=len(index)) - RIDGE * (w - prior)
        gt -= 2.0 * trans
        for k, g in enumerate((gu, gt, gn, gb)):
            steps[k] = steps[k] + g * g
        w = w + 0.5 * gu / np.sqrt(steps[0])
        trans = np.clip(trans + 0.1 * gt / np.sqrt(steps[1]), -3, 3)
        near = near + 0.5 * gn / np.sqrt(steps[2])
        bias += 0.3 * gb / np.sqrt(steps[3])
    model = Model(dict(zip(marked, w.tolist())), float(bias), tuple(near.tolist()), a)
    x, y = np.array(evidence), np.array([d[4] for d in slim], float)
    c = np.where(y == 1, 1.0, weight_clean)
    theta = np.array([0.0, 0.0, 0.0, -3.0])
    for _ in range(200):  # Newton steps, shortened so that well separated classes can't throw them off
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (c * (y - q)) - 0.5 * theta
        step = np.linalg.solve((x * (c * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(4), g)
        theta = theta + step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    model.calibration = tuple(theta)
    return model


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Model:
    """The model of the documents' labels. At most max_docs texts of max_chars characters of each class reach the driver."""
    may = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    l = labels.where("toxic in (0, 1) and doc_id is not null").where(may).groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    # Slim rows first: one a labelled document, of its texts the least by hash (a document may be met twice).
    fit_in = docs.where(F.length("text") <= max_chars).select("doc_id", F.xxhash64("text").alias("_t"))
    have = saved(fit_in.join(l, "doc_id").groupBy("doc_id", "_y").agg(F.min("_t").alias("_t")), "toxic")
    count = {r["_y"]: r["n"] for r in have.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    rows = []
    for y in (0, 1):
        some = have.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).select(F.col("doc_id").alias("_d"), "_t")
        # max_docs ids: bounded, so broadcast. Rows of one document are dropped here if they have one text.
        texts = docs.select("doc_id", "text").where(F.length("text") <= max_chars)
        texts = texts.join(F.broadcast(some), (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_t"))).dropDuplicates(["doc_id"])
        rows += [(r["text"], y) for r in texts.select("text").collect()]
    forget(have)
    n0 = sum(y == 0 for _, y in rows)
    ratio = (count.get(0, 0) / max(1, n0)) / (count.get(1, 0) / max(1, len(rows) - n0)) if count.get(1) and n0 else 1.0
    return fit(rows, max(1.0, ratio))


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, spans (array of first and past-last character offsets) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            score, spans = sent.value.score(list(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": score, "spans": [[{"first": a, "past": b} for a, b in s] for s in spans]})

    lean_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(trimmed(run), "doc_id long, score double, spans array<struct<first int, past int>>")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    out = tag(docs, train(docs, labels))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
