"""Quality classifier with hierarchical empirical Bayes over sites.

1. A logistic classifier on what a text looks like (shares of character kinds, word and line repetition) gives each
   document evidence. It is fitted on at most MAX_TRAIN labelled rows, taken in order of a hash of doc_id; only their
   feature vectors reach the driver.
2. Outcomes are summed by host (the document's source) and by path below it (by default source and language) in one
   grouped aggregation with partial sums: every document's probability counts 1, every label counts LABEL_WEIGHT more.
3. Site rates are Beta-Binomial posteriors: a path shrinks toward its host, a host toward the global rate. The strength
   of each prior is estimated from the spread between sites (method of moments), so sparse sites lean on their parents.
4. A document's log-odds are the classifier's plus the shift of its path's posterior from the global rate. The posterior
   leaves out the document's own probability, so evidence isn't counted twice and a document alone at its site has the
   global rate. (A label at a site stays known to all its documents.)

Defined results: null and empty texts have features 0 and are scored like any other; a null host or path is a site of
its own. Without labels of both classes every document has evidence 0. Repeated rows count as often as they occur, and so
do the labels of repeated rows. Documents whose label is null or neither 0 nor 1 don't train and count as unlabelled; if a
document has both labels it is good. A score of exactly REJECT_BELOW is kept. Extra columns are not read by the query and
kept by filter_quality() and score(), whatever their names; score() adds columns with the prefix "quality_". Empty tables
give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import lean_batches, load, packed, saved, trim

MAX_TRAIN = 20_000
#: Documents whose probability of being good is below this are rejected.
REJECT_BELOW = 0.25
#: What a label at a site counts, beside the one that each document there counts.
LABEL_WEIGHT = 3.0
#: Up to so many sites (three numbers each) are broadcast; more are joined by a shuffle.
BROADCAST_SITES = 100_000
NAMES = ("upper", "digit", "blank", "mark", "symbol", "word_len", "repeat_words", "repeat_lines", "end_symbol", "log_words")

_KIND = np.full(256, 5, np.int64)
for _c in range(128):
    _s = chr(_c)
    _KIND[_c] = 0 if _s.isupper() else 1 if _s.isdigit() else 2 if _s.isspace() else 3 if _s in ".,;:'\"()-?" else 5 if _s.isalpha() else 4


def features(texts) -> np.ndarray:
    out = np.zeros((len(texts), len(NAMES)))
    for i, t in enumerate(texts):
        if not t:
            continue
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        kinds = np.bincount(_KIND[raw], minlength=6)
        n = len(raw)
        # letters beyond ASCII take several bytes; upper-case ones are told by isupper per word below
        words = t.split()
        k = max(1, len(words))
        lines = t.split("\n")
        loud = sum(map(str.isupper, words))
        odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:'\")?" for w in words)
        out[i] = (loud / k, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, min(n / k, 30) / 10, 1 - len(set(words)) / k, 1 - len(set(lines)) / len(lines), odd / k, np.log1p(len(words)) / 5)
    return out


def _spread(x: np.ndarray) -> np.ndarray:
    """Features and their square roots: small shares matter more than large ones differ."""
    return np.hstack([x, np.sqrt(np.maximum(x, 0)), np.ones((len(x), 1))])


@dataclass
class Classifier:
    weights: np.ndarray | None = None

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Classifier:
        """Newton steps of ridge logistic regression."""
        if len(y) == 0 or y.min() == y.max():
            return Classifier()
        x = _spread(x)
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (y - p) - ridge * w
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return Classifier(w)

    def logit(self, texts) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return np.clip(_spread(features(texts)) @ self.weights, -12, 12)


def known(labels: DataFrame) -> DataFrame:
    """doc_id, _y: one row a labelled document."""
    return labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("_y"))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Classifier:
    """Fit on the max_train labelled documents of least hash. Texts stay on the executors; features come back."""
    l = known(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # max_train rows of two numbers: bounded, so broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(l), "doc_id").select("doc_id", "text", F.col("_y").alias("y"))

    def measure(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": list(features(list(pdf["text"]))), "y": pdf["y"]})

    # A document met twice trains once.
    got = rows.mapInPandas(measure, "doc_id long, x array<double>, y double").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(NAMES))
    order = np.lexsort((*x.T, got["y"].to_numpy())) if len(x) else []  # sums in one order: reruns agree
    return Classifier.fit(x[order], got["y"].to_numpy()[order]) if len(x) else Classifier()


def evidence(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with quality_logit, the classifier's log-odds that a document is good."""

    @F.pandas_udf("double")
    def logit(text: pd.Series) -> pd.Series:
        out = pd.Series(model.logit(list(text)))
        trim()
        return out

    # Marked as not deterministic, or a filter on the score would have it computed twice.
    return docs.withColumn("quality_logit", logit.asNondeterministic()("text"))


def _kappa(sites: DataFrame, mean: float) -> float:
    """Prior strength from the spread of site rates about mean (method of moments), at least 1, at most 10,000."""
    r = F.col("s") / F.col("n")
    n, v, within = sites.agg(F.sum("n"), F.sum(F.col("n") * (r - mean) ** 2), F.sum(F.lit(mean * (1 - mean)))).first()
    if not n:
        return 1.0
    between = max((v - within) / n, 1e-9)
    return float(min(1e4, max(1.0, mean * (1 - mean) / between - 1)))


@dataclass(frozen=True)
class Rates:
    """Posterior sums by site: table has _host, _path, what is known at the path and its host, and both priors are here."""

    table: DataFrame
    mean: float
    host_strength: float
    path_strength: float

    def shift(self):
        """Column: the log-odds of a document's site without the document, less the global ones."""
        own = 1 / (1 + F.exp(-F.col("quality_logit")))
        host = (F.col("_hs") - own + self.host_strength * self.mean) / (F.col("_hn") - 1 + self.host_strength)
        path = (F.col("_ps") - own + self.path_strength * host) / (F.col("_pn") - 1 + self.path_strength)
        path = F.least(F.greatest(path, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.round(F.log(path / (1 - path)) - float(np.log(self.mean / (1 - self.mean))), 9)


def posteriors(scored: DataFrame, labelled: DataFrame) -> Rates:
    """From scored(_host, _path, quality_logit) of all documents and labelled(_host, _path, _y) of those with labels."""
    p = 1 / (1 + F.exp(-F.col("quality_logit")))
    each = scored.select("_host", "_path", F.lit(1.0).alias("w"), p.alias("v"))
    each = each.unionByName(labelled.select("_host", "_path", F.lit(LABEL_WEIGHT).alias("w"), (LABEL_WEIGHT * F.col("_y")).alias("v")))
    # Paths first (partial sums on each task), hosts from paths: a hot source is a few numbers by then.
    path = saved(each.groupBy("_host", "_path").agg(F.sum("w").alias("n"), F.sum("v").alias("s")), "quality")
    host = path.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n, s = path.agg(F.sum("n"), F.sum("s")).first()
    mean = float(np.clip(s / n, 1e-4, 1 - 1e-4)) if n else 0.5
    at_host = host.select(F.col("_host").alias("_h"), F.col("n").alias("_hn"), F.col("s").alias("_hs"))
    both = path.join(at_host, path["_host"].eqNullSafe(at_host["_h"])).select("_host", "_path", F.col("n").alias("_pn"), F.col("s").alias("_ps"), "_hn", "_hs")
    return Rates(saved(both, "quality"), mean, _kappa(host, mean), _kappa(path, mean))


def _judged(rows: DataFrame, labels: DataFrame, max_train: int, wide: bool) -> DataFrame:
    """rows(doc_id, text, _host, _path, more) without text and with quality_logit, quality_shift and quality_score.

    Evidence is needed twice, for sites and for documents. It is stored between if rows without text are slim, and computed
    again if they are wide (hold the text once more).
    """
    lean_batches(rows.sparkSession)
    model = train(rows, labels, max_train)
    scored = evidence(rows, model).drop("text")
    scored = scored if wide else saved(scored, "quality")
    rates = posteriors(evidence(rows.select("_host", "_path", "text"), model) if wide else scored, rows.select("doc_id", "_host", "_path").join(known(labels), "doc_id"))
    t = rates.table.withColumnsRenamed({"_host": "_rh", "_path": "_rp"})
    t = F.broadcast(t) if t.count() <= BROADCAST_SITES else t
    out = scored.join(t, scored["_host"].eqNullSafe(F.col("_rh")) & scored["_path"].eqNullSafe(F.col("_rp"))).withColumn("quality_shift", rates.shift())
    return out.withColumn("quality_score", 1 / (1 + F.exp(-(F.col("quality_logit") + F.col("quality_shift"))))).drop("_rh", "_rp", "_pn", "_ps", "_hn", "_hs")


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, host: str = "source", path: tuple[str, ...] = ("lang",)) -> DataFrame:
    """docs with quality_logit, quality_shift and quality_score (probability of being good). host and path name the columns
    that say where a document comes from."""
    rows = packed(docs.drop("quality_logit", "quality_shift", "quality_score"), "doc_id", "text", F.col(f"`{host}`").alias("_host"), F.struct(*[F.col(f"`{c}`") for c in path]).alias("_path"))
    return _judged(rows, labels, max_train, wide=True).select("row.*", "quality_logit", "quality_shift", "quality_score")


def filter_quality(docs: DataFrame, labels: DataFrame, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of docs that aren't rejected."""
    rows = packed(docs, "doc_id", "text", F.col("source").alias("_host"), F.col("lang").alias("_path"))
    return _judged(rows, labels, MAX_TRAIN, wide=True).where(F.col("quality_score") >= reject_below).select("row.*")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("_host"), F.col("lang").alias("_path"))
    out = _judged(rows, load(spark, sf_dir, "labels"), MAX_TRAIN, wide=False)
    return out.select("doc_id", F.col("_host").alias("source"), F.col("_path").alias("lang"), F.col("quality_logit").alias("evidence"), F.col("quality_shift").alias("site_shift"), F.col("quality_score").alias("score"), (F.col("quality_score") >= REJECT_BELOW).alias("kept"))
