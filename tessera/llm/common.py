"""What the training-data operators share: tables in the shared folder, total ranks, components.

Cluster rules kept here: lineage is cut only by Parquet tables in the folder that the cluster names in
``spark.checkpoint.dir`` (reachable from every executor and readable again after an executor is lost), and
nothing that grows with the data is collected to the driver.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..storage import forget, fresh_path, remove, saved, shared_dir  # noqa: F401  passed on to the operators

#: Characters that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a range of a global rank, if their number is known.
RANGE_ROWS = 2_000_000

def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, *cols) -> DataFrame:
    """cols of df, and all of df as one column `row`: whatever names df has, they can't clash with those of an operator."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *cols)


def lean_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB: texts may be long, and a batch is in memory several times over on its way to Python.
    Left alone where the session has a setting of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "4m")


def trim() -> None:
    """Give free memory back to the system; Python workers live on after a task, and texts leave much of it in pieces."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def trimmed(run):
    """A function for mapInPandas or mapInArrow that gives memory back when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


#: Up to so many slim rows (about 50 bytes each) are broadcast by sized(); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def sized(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Slim rows to be joined with wide ones: broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= most else rows


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, cols: list, name: str = "rank", rows: int = 0) -> DataFrame:
    """df with a gapless total rank from 0 by cols, without bringing all rows to one task.

    Rows are range-partitioned and sorted once and saved; only one count per partition reaches the driver.
    Rows equal on cols get ranks in any order; callers add a unique last column where it matters. rows, if known, says how
    many ranges there should be: RANGE_ROWS each, a shuffle's partitions at least.
    """
    spark = df.sparkSession
    sorted_ = df.repartitionByRange(max(shuffle_parts(spark), rows // RANGE_ROWS), *cols).sortWithinPartitions(*cols)
    mid = F.monotonically_increasing_id()
    # The upper bits of the id are the partition, the lower 33 the row's place in it.
    t = saved(sorted_.withColumn("_m", mid).withColumn("_p", F.shiftright("_m", 33).cast("int")), name)
    counts = {r["_p"]: r["n"] for r in t.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    offset, base = {}, 0
    for p in sorted(counts):
        offset[p], base = base, base + counts[p]
    if not offset:
        return t.withColumn(name, F.lit(0).cast("long")).drop("_m", "_p")
    offsets = spark.createDataFrame(list(offset.items()), "_p int, _o long")
    within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition of the sort: bounded by the partition count, so broadcast.
    return t.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + within).drop("_m", "_p", "_o")


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to a forest with the same components per partition, each tree a star around its least id."""
    fields = edges.schema

    def shrink(batches):
        parent: dict = {}

        def find(x):
            root = x
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        def out():
            rows = [(find(x), x) for x in parent]
            return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"])

        for pdf in batches:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 1_000_000:  # bounded memory: what is known so far goes out as a star forest
                yield out()
                parent.clear()
        yield out()

    return edges.mapInPandas(shrink, T.StructType([T.StructField("a", fields["a"].dataType), T.StructField("b", fields["b"].dataType)]))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root) for every id on an edge (a, b): root is the least id reachable. Ids are longs or binaries.

    Partition-local union-find first, then alternating large-star and small-star steps until nothing changes.
    Each step joins a vertex's edges with its one minimum, so a hub's edges can be split over tasks.
    Nulls and loops are ignored. Raises when the steps don't settle.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    now = saved(forest(e), "cc")

    def print_of(df):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    seen = print_of(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()  # u > v holds from here on
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
        after = saved(small.where("a <> b").distinct(), "cc")
        mark = print_of(after)
        forget(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("id"), "root")
    return roots.union(now.select("a", "a").distinct().toDF("id", "root"))


def u64(blob) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u8")
