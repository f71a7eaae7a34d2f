"""File catalogue: stable ids, snapshots, differences between snapshots, roots and overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import in_or_under
from ..storage import saved


def assign_ids(known: DataFrame, seen: DataFrame) -> DataFrame:
    """The next id table (file_id, uri, file_key, live) after seeing uris.

    A file key that a live row has keeps its id, whatever its uri is now; else a live uri keeps its id; new uris get the
    next ids in order of uri. Rows not seen stay as tombstones (live = false), so ids are never used again.
    known: file_id, uri, file_key, live. seen: uri, file_key (nullable).
    """
    now = seen.select("uri", "file_key").groupBy("uri").agg(F.max("file_key").alias("file_key"))
    live = known.where("live")
    by_key = live.where("file_key is not null").groupBy("file_key").agg(F.min("file_id").alias("_k"))
    by_uri = live.groupBy("uri").agg(F.min("file_id").alias("_u"))
    m = now.join(by_key, "file_key", "left").join(by_uri, "uri", "left")
    m = m.withColumn("file_id", F.coalesce("_k", "_u")).drop("_k", "_u")
    # Two uris may claim one id (one by key, one by uri); the key's claim is stronger, then the least uri.
    claim = Window.partitionBy("file_id").orderBy(F.col("file_key").isNull(), "uri")
    old = m.where("file_id is not null").withColumn("_r", F.row_number().over(claim))
    kept = old.where("_r = 1").drop("_r")
    new = m.where("file_id is null").unionByName(old.where("_r > 1").drop("_r"))
    top = known.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("top")).first()["top"]
    # Only rows without an id are numbered; partition offsets keep it parallel.
    new = number_rows(new.drop("file_id"), "file_id", ["uri"], int(top) + 1)
    current = kept.unionByName(new.select(*kept.columns)).withColumn("live", F.lit(True))
    gone = known.join(current.select("file_id"), "file_id", "left_anti").withColumn("live", F.lit(False))
    return current.select("file_id", "uri", "file_key", "live").unionByName(gone.select("file_id", "uri", "file_key", "live"))


def number_rows(df: DataFrame, name: str, order: list[str], first: int = 0) -> DataFrame:
    """df with consecutive numbers in order, without one task seeing all rows (one count per partition is collected)."""
    spark = df.sparkSession
    s = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    s = s.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33).cast("int"))
    s = saved(s, "numbered")  # numbers depend on how rows lie, so they are stored
    counts = sorted((r["_p"], r["n"]) for r in s.groupBy("_p").agg(F.count("*").alias("n")).collect())
    starts, at = [], first
    for p, n in counts:
        starts.append((p, at))
        at += n
    t = spark.createDataFrame(starts, "_p int, _s long")
    return s.join(F.broadcast(t), "_p").withColumn(name, (F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_p", "_m", "_s")


def snapshot(files: DataFrame, root: str | None = None, ordered: bool = True) -> DataFrame:
    """One row per path at or below root; sorted by path at the end."""
    s = files if root is None else files.where(in_or_under("path", root))
    s = s.dropDuplicates(["path"])
    return s.orderBy("path") if ordered else s


def difference(old: DataFrame, new: DataFrame, key: str = "uri", stamp: list[str] = ("last_modified", "length"), file_key: str | None = None) -> DataFrame:
    """(op, uri, old_uri): created, deleted, changed and, if file_key is given, renamed.

    One full outer join; stamps compare null-safely. A rename takes both its sides out of created and deleted.
    """
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in stamp]
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    op = F.when(F.col(f"o.{key}").isNull(), "created").when(F.col(f"n.{key}").isNull(), "deleted").when(~reduce(lambda a, b: a & b, same), "changed")
    fk = [F.coalesce(F.col(f"n.{file_key}"), F.col(f"o.{file_key}")).alias("_fk")] if file_key else [F.lit(None).cast("string").alias("_fk")]
    d = j.select(op.alias("op"), F.coalesce(f"n.{key}", f"o.{key}").alias("uri"), *fk).where("op is not null")
    if file_key is None:
        return d.select("op", "uri", F.lit(None).cast("string").alias("old_uri"))
    r = renames(old, new, key, file_key)
    r1 = r.select(F.lit("renamed").alias("op"), "uri", "old_uri")
    left = d.join(r.select("uri"), ["uri"], "left_anti").where("op <> 'deleted'").unionByName(d.where("op = 'deleted'").join(r.select(F.col("old_uri").alias("uri")), ["uri"], "left_anti"))
    return r1.unionByName(left.select("op", "uri", F.lit(None).cast("string").alias("old_uri")))


def renames(old: DataFrame, new: DataFrame, key: str = "uri", file_key: str = "file_key") -> DataFrame:
    """(uri, old_uri): a new uri whose file key an old uri had that is gone; the least old uri wins."""
    gone = old.join(new.select(key), key, "left_anti").where(F.col(file_key).isNotNull()).groupBy(file_key).agg(F.min(key).alias("old_uri"))
    fresh = new.join(old.select(key), key, "left_anti").where(F.col(file_key).isNotNull()).groupBy(file_key).agg(F.min(key).alias("uri"))
    return fresh.join(gone, file_key).select("uri", "old_uri")


def collect_inputs(roots: list[DataFrame], build_dir: str | None, fallback: DataFrame | None = None) -> DataFrame:
    """Files of all root providers without the build directory's, each once; the fallback's if providers give none."""
    out = reduce(lambda a, b: a.unionByName(b), roots) if roots else None
    if out is None or (fallback is not None and out.isEmpty()):
        out = fallback
    if build_dir:
        out = out.where(~in_or_under("path", build_dir))
    return distinct_roots(out) if "file_id" in out.columns else out.dropDuplicates(["path"])


def distinct_roots(files: DataFrame) -> DataFrame:
    """One row per positive file_id, else per path."""
    k = F.when(F.col("file_id") > 0, F.concat(F.lit("#"), F.col("file_id").cast("string"))).otherwise(F.col("path"))
    return files.withColumn("_k", k).dropDuplicates(["_k"]).drop("_k")


def with_overlay(files: DataFrame, overlay: DataFrame) -> DataFrame:
    """files (path, text, ...) with the newest unsaved text of overlay (path, text, stamp) where there is one."""
    o = overlay.groupBy("path").agg(F.max(F.struct("stamp", "text")).alias("_o"))
    j = files.join(o, "path", "left")
    return j.withColumn("text", F.when(F.col("_o").isNotNull(), F.col("_o.text")).otherwise(F.col("text"))).select(*files.columns)


def locate(rows: DataFrame, files: DataFrame, cols: list[str] = ("path",)) -> DataFrame:
    """rows (file_id) with columns of files; small file tables are broadcast by the optimiser's size check."""
    return rows.join(files.select("file_id", *cols), "file_id")
