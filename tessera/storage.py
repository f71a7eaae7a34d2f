"""The folder that all executors share, for tables that cut lineage and for stores a query builds."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_own_dir: str | None = None
_kept: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Without it: a folder of our own on a local master, an error on a cluster, where a
    folder of one machine can't be read by the others."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tessera-")
    return _own_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there is deleted when the session's process ends."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _kept[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget_path(path: str | None) -> None:
    """Delete what is at a fresh path, if it is still there."""
    if path in _kept:
        remove(_kept.pop(path), path)


@atexit.register
def _cleanup() -> None:
    for path, spark in list(_kept.items()):
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may be gone at exit
            return


def saved(df, name: str = "table"):
    """df written once to the shared folder and read again: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def forget(df) -> None:
    """Delete a saved table that nothing reads any more."""
    forget_path(getattr(df, "_tessera_path", None))
