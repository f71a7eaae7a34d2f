"""Files, archives, configuration and documents as sources and sinks."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import in_or_under
from ..operators.registry import Registry

#: Readers by URI scheme: functions of (spark, uri) to a DataFrame of files.
SCHEMES = Registry()

_FILE = "uri string, path string, name string, ext string, is_folder boolean, last_modified long, length long, content binary"


def scan(spark: SparkSession, uri: str, content: bool = True) -> DataFrame:
    """All files at or below uri, leaves only: uri, path, name, ext, last_modified, length, content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(uri)
    return _described(f.select(F.col("path").alias("uri"), F.unix_millis("modificationTime").alias("last_modified"), "length", *(["content"] if content else [])))


def _described(f: DataFrame) -> DataFrame:
    path = F.regexp_replace("uri", r"\A[a-z][a-z0-9+.-]*:(?://[^/]*)?", "")
    name = F.substring_index(path, "/", -1)
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return f.withColumns({"path": path, "name": name, "ext": ext, "is_folder": F.lit(False)})


def scan_archives(spark: SparkSession, uri: str) -> DataFrame:
    """Entries of the zip archives at uri as files: uri is jar:<archive>!/<entry>. Archives that don't open give no rows."""

    def entries(batches):
        for pdf in batches:
            out = []
            for path, modified, raw in zip(pdf["path"], pdf["modified"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        out += [(f"jar:{path}!/{i.filename}", modified, i.file_size, z.read(i)) for i in sorted(z.infolist(), key=lambda i: i.filename) if not i.is_dir()]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(out, columns=["uri", "last_modified", "length", "content"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(uri).select("path", F.unix_millis("modificationTime").alias("modified"), "content")
    f = raw.mapInPandas(entries, "uri string, last_modified long, length long, content binary")
    return _described(f).withColumn("path", F.concat(F.lit("/"), F.element_at(F.split("uri", "!/", 2), 2)))


def children(files: DataFrame, directory: str) -> DataFrame:
    """(name, is_folder): what lies directly in a directory, sorted; folders are known from what lies below them."""
    d = directory.rstrip("/") + "/"
    rest = F.substring("path", len(d) + 1, 1 << 20)
    f = files.where(F.col("path").startswith(d)).select(F.substring_index(rest, "/", 1).alias("name"), rest.contains("/").alias("is_folder"))
    return f.where("name <> ''").groupBy("name").agg(F.bool_or("is_folder").alias("is_folder")).orderBy("name")


def find(spark: SparkSession, uri: str) -> DataFrame:
    """Route a URI to the reader of its scheme; a plain path is a file."""
    scheme = uri.split(":", 1)[0].lower() if ":" in uri.split("/", 1)[0] else "file"
    reader = SCHEMES.find(scheme)
    if reader is None:
        raise ValueError(f"no reader for scheme {scheme}")
    return reader(spark, uri)


def _archive_uri(spark: SparkSession, uri: str) -> DataFrame:
    archive, _, entry = uri[4:].partition("!/")
    f = scan_archives(spark, archive)
    return f.where(in_or_under("path", f"/{entry}")) if entry else f


def runtime_image(exported: str):
    """A reader for jrt: URIs over a runtime image that was exported to a folder (<folder>/<module>/<package>/<name>.class):
    register it under "jrt". Images don't change, so stamps are 0; what is asked for that isn't there gives no rows."""

    def read(spark: SparkSession, uri: str) -> DataFrame:
        inside = uri.split(":", 1)[1].strip("/").removeprefix("modules").strip("/")
        f = scan(spark, exported)
        base = F.regexp_extract("path", r"\A(.*)\z", 1)
        root = exported.split("://", 1)[-1].removeprefix("file:").rstrip("/")
        path = F.concat(F.lit("jrt:/modules/"), F.expr(f"substring(path, length('{root}') + 2, length(path))"))
        f = f.where(base.startswith(root + "/")).withColumns({"uri": path, "path": path, "last_modified": F.lit(0).cast("long")})
        return f.where(in_or_under("path", f"jrt:/modules/{inside}")) if inside else f

    return read


SCHEMES.register("file", scan)
SCHEMES.register("jar", _archive_uri)


def write_archive(files: DataFrame, path: str) -> int:
    """One zip of files (path, content): entries sorted, the first of each name, times fixed, so equal input gives equal
    bytes. One archive is one file, so its entries stream through the driver."""
    w = Window.partitionBy("path").orderBy("ordinal") if "ordinal" in files.columns else Window.partitionBy("path").orderBy(F.lit(0))
    f = files.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.regexp_replace("path", r"\A/+", "").alias("name"), "content").orderBy("name")
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for n, r in enumerate(f.toLocalIterator(), 1):  # noqa: B007
            z.writestr(zipfile.ZipInfo(r["name"], (1980, 1, 1, 0, 0, 0)), bytes(r["content"] or b""))
    return n


def copy_tree(spark: SparkSession, source: str, target: str) -> None:
    """Recursive copy by the file system's own means."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def delete_tree(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def commit_documents(open_documents: DataFrame, files: DataFrame, target: str) -> DataFrame:
    """Write the newest text of each modified document under target and return the change events (op, path).

    open_documents: path, text, stamp, modified. Files that are read-only reject the commit.
    """
    newest = open_documents.where("modified").groupBy("path").agg(F.max(F.struct("stamp", "text")).alias("_d")).select("path", "_d.text")
    d = newest.join(files.select("path", "read_only"), "path", "left")
    if not d.where("read_only").isEmpty():
        raise PermissionError("read-only documents can't be committed")
    d.select("path", "text").write.mode("append").parquet(target)
    return d.select(F.when(F.col("read_only").isNull(), "created").otherwise("changed").alias("op"), "path")


def flat_config(text: str, name: str = "project") -> dict[str, str]:
    """A YAML project description as flat string properties; anything that isn't a mapping gives none.

    id, properties, subprojects (with paths) and plugins (names, or mappings with options) are read; order is kept in lists.
    """
    import yaml

    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError:
        return {}
    if not isinstance(doc, dict):
        return {}
    s = lambda v: "" if v is None else str(v)
    out = {f"{name}.id": s(doc["id"])} if doc.get("id") is not None else {}
    if isinstance(doc.get("properties"), dict):
        out |= {f"{name}.properties.{k}": s(v) for k, v in doc["properties"].items() if k is not None}
    subs = [x for x in doc.get("subprojects") or [] if isinstance(x, dict) and x.get("id") is not None] if isinstance(doc.get("subprojects"), list) else []
    if subs:
        out[f"{name}.subprojects"] = ",".join(str(x["id"]) for x in subs)
        out |= {f"{name}.subproject.{x['id']}.path": str(x["path"]) for x in subs if x.get("path") is not None}
    plugins = []
    for p in doc["plugins"] if isinstance(doc.get("plugins"), list) else []:
        pid = p if isinstance(p, str) else str(p.get("id") or "") if isinstance(p, dict) else ""
        if not pid.strip():
            continue
        plugins.append(pid.strip())
        if isinstance(p, dict) and isinstance(p.get("options"), dict):
            out |= {f"{name}.plugin.{pid.strip()}.option.{k}": s(v) for k, v in p["options"].items() if k is not None}
    if plugins:
        out[f"{name}.plugins"] = ",".join(plugins)
    return out
