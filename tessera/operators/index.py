"""Index definitions and extraction: files to (index_id, key, file_id, value) rows.

A definition says which files it takes (a predicate) and how their rows come about: with DataFrame functions, or with a
Python function per file whose failures are set aside as error rows instead of failing the batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

ENTRY = "index_id string, key string, file_id long, value string"


@dataclass(frozen=True)
class IndexDefinition:
    """id, version, the files it takes, and extract: files to (file_id, key, value) with one value per key and file.

    value is text; typed values are JSON (see typed()).
    """

    id: str
    version: int
    extract: Callable[[DataFrame], DataFrame]
    supports: Column | None = field(default=None, compare=False)

    def rows(self, files: DataFrame) -> DataFrame:
        f = files if self.supports is None else files.where(self.supports)
        out = self.extract(f).select(F.lit(self.id).alias("index_id"), F.col("key").cast("string"), F.col("file_id").cast("long"), F.col("value").cast("string"))
        return out.where("key is not null")


class PythonExtractor:
    """An extractor from a function of one file's columns, and, with a helper, of what the helper made of them. Of equal keys
    the last value stays.

    Extractors with one helper share its result: it runs once a file, however many of them take the file. A file for which
    a function raises gives one row with a null key and the error as value; errors_of() shows them.
    """

    def __init__(self, per_file: Callable[..., Iterable[tuple[str, str]]], columns: list[str], helper: Callable[[dict], object] | None = None):
        self.per_file, self.columns, self.helper = per_file, columns, helper

    def found(self, row: dict, helped: dict) -> list[tuple]:
        """(file_id, key, value) of a file; helped keeps what helpers made of it."""
        try:
            if self.helper is None:
                pairs = dict(self.per_file(row))
            else:
                if self.helper not in helped:
                    helped[self.helper] = _attempt(self.helper, row)
                made, error = helped[self.helper]
                if error:
                    raise error
                pairs = dict(self.per_file(row, made))
            return [(row["file_id"], k, v if v is None or isinstance(v, str) else json.dumps(v, sort_keys=True)) for k, v in pairs.items()]
        except Exception as e:  # a broken file must not stop the batch
            return [(row["file_id"], None, f"{type(e).__name__}: {e}")]

    def __call__(self, files: DataFrame) -> DataFrame:
        return _together(files, {"": self}, {}).drop("index_id")


def _attempt(fn, row):
    try:
        return fn(row), None
    except Exception as e:  # told to each extractor that needs it
        return None, e


def _together(files: DataFrame, extractors: dict[str, PythonExtractor], supports: dict[str, Column]) -> DataFrame:
    """(index_id, file_id, key, value) of all extractors in one pass over files."""
    columns = list(dict.fromkeys(c for e in extractors.values() for c in e.columns if c != "file_id"))
    flag = {i: f"_takes{k}" for k, i in enumerate(extractors)}

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                helped: dict = {}
                for i, e in extractors.items():
                    if r[flag[i]] is True:
                        out += [(i, *x) for x in e.found(r, helped)]
            yield pd.DataFrame(out, columns=["index_id", "file_id", "key", "value"])

    taken = [F.coalesce(supports.get(i, F.lit(True)), F.lit(False)).alias(flag[i]) for i in extractors]
    return files.select("file_id", *columns, *taken).mapInPandas(run, "index_id string, file_id long, key string, value string")


def python_extractor(per_file, columns: list[str], helper=None) -> PythonExtractor:
    return PythonExtractor(per_file, columns, helper)


def errors_of(definition: IndexDefinition, files: DataFrame) -> DataFrame:
    """(index_id, file_id, message) of files that couldn't be extracted."""
    f = files if definition.supports is None else files.where(definition.supports)
    return definition.extract(f).where("key is null").select(F.lit(definition.id).alias("index_id"), "file_id", F.col("value").alias("message"))


def run_all(files: DataFrame, definitions: list[IndexDefinition]) -> DataFrame:
    """Entries of all definitions. Those in Python share one pass over files, in which each helper runs once a file; each
    native one is a plan of its own, so callers with several persist files (as IndexStore does)."""
    python = {d.id: d for d in definitions if isinstance(d.extract, PythonExtractor)}
    parts = [d.rows(files) for d in definitions if d.id not in python]
    if python:
        rows = _together(files, {i: d.extract for i, d in python.items()}, {i: d.supports for i, d in python.items() if d.supports is not None})
        parts.append(rows.where("key is not null").select("index_id", "key", "file_id", "value"))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else files.sparkSession.createDataFrame([], ENTRY)


def forward(entries: DataFrame) -> DataFrame:
    """(index_id, file_id, keys): each file's distinct keys, sorted."""
    return entries.groupBy("index_id", "file_id").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def typed(entries: DataFrame, schema: str) -> DataFrame:
    """entries with value parsed from JSON."""
    return entries.withColumn("value", F.from_json("value", schema))


def words(column: str = "text") -> Callable[[DataFrame], DataFrame]:
    """Words of a text (lower case, split at single spaces), valued by how often they occur in the file."""

    def extract(files: DataFrame) -> DataFrame:
        w = files.select("file_id", F.explode(F.split(F.lower(F.col(column)), " ")).alias("key")).where("key <> ''")
        return w.groupBy("file_id", "key").agg(F.count("*").cast("string").alias("value"))

    return extract


def word_after(marker: str, column: str = "text", value: str = "path") -> Callable[[DataFrame], DataFrame]:
    """The token that follows each marker token, e.g. names after `class`; valued by a column of the file."""

    def extract(files: DataFrame) -> DataFrame:
        t = F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")
        at = F.filter(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.get(t, i) == marker)
        keys = F.when(F.size(t) >= 2, F.array_distinct(F.transform(at, lambda i: F.get(t, i + 1))))
        return files.select("file_id", F.explode(keys).alias("key"), F.col(value).alias("value"))

    return extract


def column_key(key: str, value: str) -> Callable[[DataFrame], DataFrame]:
    """An index over a column of the files themselves."""
    return lambda files: files.select("file_id", F.col(key).alias("key"), F.col(value).cast("string").alias("value"))


def counters(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(index_id, files, entries, keys) per index; files that gave nothing aren't counted."""
    return entries.groupBy("index_id").agg(F.count_distinct("file_id").alias("files"), F.count("*").alias("entries"), F.count_distinct("key").alias("keys"))


#: Cells of a histogram of percentiles().
CELLS = 4096


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """Values at places of the sorted column (from 0), exact, by refining histograms; non-finite values must be gone.

    A pass counts, in up to CELLS cells a range, the values within the ranges that still hold a wanted place, with least and
    largest of each cell; the cell of a place is the next range, until its least is its largest. No task holds more than
    the cells, and they are all that reaches the driver. df is read once a pass.
    """
    v = df.select(F.col(column).cast("double").alias("v"))
    lo, hi, n = v.agg(F.min("v"), F.max("v"), F.count("v")).first()
    found, open_ = {}, {r: (lo, hi, 0) for r in ranks if 0 <= r < n}
    while open_:
        for r, (a, b, _) in list(open_.items()):
            if a == b:
                found[r] = a
                del open_[r]
        ranges = sorted({(a, b) for a, b, _ in open_.values()})
        if not ranges:
            break
        which = F.lit(None).cast("int")
        cell = F.lit(None).cast("int")
        for k, (a, b) in reversed(list(enumerate(ranges))):
            inside = F.col("v").between(a, b)
            which = F.when(inside, k).otherwise(which)
            # Halves, so that the width of a range is a number.
            share = (F.col("v") / 2 - a / 2) / (b / 2 - a / 2)
            cell = F.when(inside, F.least(F.lit(CELLS - 1), F.floor(share * CELLS)).cast("int")).otherwise(cell)
        cells = v.select("v", which.alias("k"), cell.alias("c")).where("k is not null").groupBy("k", "c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r, (a, b, before) in list(open_.items()):
            k = ranges.index((a, b))
            for x in sorted((x for x in cells if x["k"] == k), key=lambda x: x["c"]):
                if r < before + x["n"]:
                    open_[r] = (x["lo"], x["hi"], before)
                    break
                before += x["n"]
    return found


def percentiles(df: DataFrame, column: str) -> DataFrame:
    """least, p50, p90, p99 and largest, interpolated between neighbours; nulls and non-finite values are left out, and
    without any values all are null."""
    v = df.select(F.col(column).cast("double").alias("v")).where(F.abs("v") < float("inf"))
    n, names = v.count(), {"least": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "largest": 1.0}
    places = {name: (n - 1) * p for name, p in names.items()}
    at = order_statistics(v, "v", sorted({int(x) + k for x in places.values() for k in (0, 1)})) if n else {}
    row = []
    for x in places.values():
        low = at.get(int(x))
        row.append(None if low is None else low + (at.get(int(x) + 1, low) - low) * (x - int(x)))
    return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{name} double" for name in names))


def sketched() -> list[Column]:
    """Aggregates of (file_id, key): mergeable sketches (HLL) of keys and of files, and the rows."""
    return [F.hll_sketch_agg("key").alias("keys"), F.hll_sketch_agg("file_id").alias("files"), F.count("*").alias("entries")]


def sketches(rows: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Of (index_id, file_id, key): one row an index with mergeable sketches of its distinct keys and files (HLL) and of the
    keys that a file has (KLL), a few kB each whatever their number. parts: sketched() of parts of rows, in which no key is there
    twice for a file, so none need be told apart."""
    each = rows.groupBy("index_id", "file_id").agg((F.count_distinct("key") if parts is None else F.count("*")).alias("n"))
    kll = each.groupBy("index_id").agg(F.kll_sketch_agg_bigint("n").alias("per_file"))
    whole = sketched() if parts is None else [F.hll_union_agg("keys").alias("keys"), F.hll_union_agg("files").alias("files"), F.sum("entries").alias("entries")]
    return (rows if parts is None else parts).groupBy("index_id").agg(*whole).join(kll, "index_id")


def estimates(sketched: DataFrame) -> DataFrame:
    """(index_id, entries, keys, files, p50, p90, p99 of the keys a file has) from sketches of any number of layers."""
    m = sketched.groupBy("index_id").agg(
        F.sum("entries").alias("entries"), F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("keys"), F.hll_sketch_estimate(F.hll_union_agg("files")).alias("files"), F.kll_merge_agg_bigint("per_file").alias("_s"),
    )
    return m.select("index_id", "entries", "keys", "files", *[F.kll_sketch_get_quantile_bigint("_s", F.lit(q)).alias(n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))])
