"""Lookups over index entries (index_id, key, file_id, value). All are lazy filters that reach the Parquet scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .paths import path_fits_kind
from .store import BLOCK_BITS


def exact(entries: DataFrame, index_id: str, key: str, scope: Column | None = None) -> DataFrame:
    """(file_id, value) under a key; none for an index that doesn't exist."""
    return _scoped(entries.where((F.col("index_id") == index_id) & (F.col("key") == key)), scope).select("file_id", "value")


def prefix(entries: DataFrame, index_id: str, start: str, scope: Column | None = None) -> DataFrame:
    """(key, file_id, value) of keys that begin with start; an empty start takes all."""
    return _scoped(entries.where((F.col("index_id") == index_id) & F.col("key").startswith(start)), scope).select("key", "file_id", "value")


def _scoped(df: DataFrame, scope: Column | None) -> DataFrame:
    return df if scope is None else df.where(scope)


def values(entries: DataFrame, index_id: str, key: str) -> DataFrame:
    return exact(entries, index_id, key).select("value")


def grouped(entries: DataFrame, index_id: str, start: str) -> DataFrame:
    """(key, block, values): sorted values of every key that begins with start, in blocks of file numbers, so that no row
    grows with the files that a key has."""
    hits = prefix(entries, index_id, start)
    return hits.groupBy("key", F.shiftright(F.col("file_id"), BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list("value")).alias("values"))


def all_of(store, index_id: str, keys: list[str]) -> DataFrame:
    """file_id of the files that are under every one of the keys.

    Posting lists meet block by block: a block that one of them lacks is dropped by the join on block numbers, and what is
    left is intersected within blocks.
    """
    first, *rest = [store.blocks(index_id, k) for k in dict.fromkeys(keys)]
    both = first
    for k, other in enumerate(rest):
        both = both.join(other.withColumnRenamed("ids", f"_{k}"), "block").select("block", F.array_intersect("ids", f"_{k}").alias("ids")).where(F.size("ids") > 0)
    return both.select("block", F.explode("ids").alias("_i")).select(F.shiftleft("block", BLOCK_BITS).bitwiseOR(F.col("_i").cast("long")).alias("file_id"))


def first_n(rows: DataFrame, n: int, *order) -> DataFrame:
    """Stop after n rows; in order if given."""
    return (rows.orderBy(*order) if order else rows).limit(n)


def keys_of(entries: DataFrame, index_id: str, file_id: int) -> DataFrame:
    """Distinct keys of one file."""
    return entries.where((F.col("index_id") == index_id) & (F.col("file_id") == file_id)).select("key").distinct()


def indexed(files: DataFrame, entries: DataFrame, index_id: str) -> DataFrame:
    """The files that have entries in the index."""
    return files.join(entries.where(F.col("index_id") == index_id).select("file_id"), "file_id", "left_semi")


def has_data(entries: DataFrame, index_id: str) -> bool:
    return not entries.where(F.col("index_id") == index_id).isEmpty()


def with_fallback(names: DataFrame, entries: DataFrame, index_id: str) -> DataFrame:
    """(name, key, value): the first hit among the name and its nested forms, a/b/C, then a/b$C, then a$b$C.

    One equi-join for all candidates of all names; the least place wins by an aggregate.
    """
    parts = F.split("name", "/")
    made = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.concat_ws("/", F.filter(F.array(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k - 1), "/"), F.array_join(F.slice(parts, F.size(parts) - k, k + 1), "$")), lambda s: s != "")))
    c = names.select("name").distinct().select("name", F.posexplode(made).alias("place", "key"))
    e = entries.where(F.col("index_id") == index_id).groupBy("key").agg(F.min(F.struct("file_id", "value")).alias("_v"))
    return c.join(e, "key").groupBy("name").agg(F.min(F.struct("place", "key", "_v")).alias("_b")).select("name", F.col("_b.key").alias("key"), F.col("_b._v.value").alias("value"))


def union_stores(*stores: DataFrame) -> DataFrame:
    """Entries of several stores with store_id; duplicates stay. The key of a file is (store_id, file_id)."""
    return reduce(lambda a, b: a.unionByName(b), [s.withColumn("store_id", F.lit(i)) for i, s in enumerate(stores)])


def global_id(store, file) -> Column:
    """One integer for a store's file: bit 31 marks it, 7 bits of store, 24 of file; local files (store 0) stay as they are.
    Numbers that don't fit raise, as they would be another file's."""
    s, f = (x if isinstance(x, Column) else F.col(x) for x in (store, file))
    fits = F.when(s == 0, f.between(0, (1 << 31) - 1)).otherwise(s.between(1, 127) & f.between(0, (1 << 24) - 1))
    packed = F.lit(1 << 31).bitwiseOR(F.shiftleft(s.cast("long"), 24)).bitwiseOR(f.cast("long"))
    packed = F.when(s == 0, f.cast("long")).otherwise(packed)
    wrong = F.raise_error(F.concat_ws(" ", F.lit("no global id for store"), s.cast("string"), F.lit("file"), f.cast("string")))
    return F.when(s.isNull() | f.isNull(), F.lit(None).cast("long")).when(fits, packed).otherwise(wrong.cast("long"))


def local_id(packed) -> tuple[Column, Column]:
    """(store, file) of a global_id."""
    p = (packed if isinstance(packed, Column) else F.col(packed)).cast("long")
    shared = p.bitwiseAND(F.lit(1 << 31)) != 0
    return F.when(shared, F.shiftright(p, 24).bitwiseAND(F.lit(127))).otherwise(0).cast("int"), F.when(shared, p.bitwiseAND(F.lit((1 << 24) - 1))).otherwise(p)


def first_compatible(entries: DataFrame, files: DataFrame, index_id: str, key: str, kind: str) -> DataFrame:
    """The least file under key whose path fits the kind."""
    hit = exact(entries, index_id, key).join(files.select("file_id", "path"), "file_id")
    return hit.where(path_fits_kind("path", F.lit(kind))).orderBy("file_id").limit(1)


def package_listing(entries: DataFrame, files: DataFrame, index_id: str, package: str, kinds: list[str], scope: Column | None = None) -> DataFrame:
    """(file_id, path, simple_name, kind) of a package. value holds {"simple_name", "kind"}."""
    v = F.from_json("value", "simple_name string, kind string")
    hit = exact(entries, index_id, package).withColumn("_v", v).where(F.col("_v.kind").isin(*kinds))
    out = hit.join(files.select("file_id", "path"), "file_id")
    return _scoped(out, scope).select("file_id", "path", "_v.simple_name", "_v.kind")


def first_value(entries: DataFrame, index_id: str, dotted: str) -> DataFrame:
    """The first value under a dotted name, whose key may be written with slashes."""
    e = entries.where((F.col("index_id") == index_id) & F.col("key").isin(dotted, dotted.replace(".", "/")))
    return e.orderBy("file_id").limit(1).select("file_id", "value")
