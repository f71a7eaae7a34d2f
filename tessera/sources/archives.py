"""Zip archives as a data source of Spark's own: spark.read.format("archive") and df.write.format("archive").

Reading: archives are read through their central directories, which lie at their ends. A partition is a range of entries of
one archive of about splitBytes compressed bytes, and its task reads just these, one at a time; so an archive may be larger
than a row or a task's memory, and many tasks share it. Options or pushed filters on the entry's name leave out entries, and
whole partitions, before anything is read. Writing: each task writes an archive of its rows into the folder; archives get
their names when all tasks are done, so a task that is run again leaves nothing twice.

Paths are URIs of the file systems that pyarrow knows (local, HDFS, S3, GCS); what opens them on executors is a parameter of
the class. An archive that doesn't open gives no rows, or fails the read with option("broken", "fail"). Folders within
archives aren't entries; repeated names are entries each. Null content is written as empty; a null entry name fails.

spark.dataSource.register(ArchiveSource) makes the format known; register() also takes filters where the session allows a
Python source to have them (spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

import re
import uuid
import zipfile
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

SCHEMA = "archive string, entry string, size long, content binary"
#: Compressed bytes of a partition.
SPLIT_BYTES = 64 << 20
_SUFFIXES = (".zip", ".jar")


def open_path(uri: str):
    """The file system of a URI or plain path, and the path within it."""
    from pyarrow.fs import FileSystem

    if re.match(r"file:/", uri):
        uri = "file:///" + uri[5:].lstrip("/")
    return FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else FileSystem.from_uri("file://" + uri)


@dataclass
class Entries(InputPartition):
    """Entries first to past of an archive, in the order in which they lie."""

    archive: str
    first: int
    past: int


def _infos(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.header_offset)


class ArchiveReader(DataSourceReader):
    opener = staticmethod(open_path)

    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.content = str(options.get("content", "true")).lower() == "true"
        self.fail = options.get("broken", "skip") == "fail"
        self.only = {options["entry"]} if "entry" in options else None
        self.under = options.get("under", "")

    def _wanted(self, name: str) -> bool:
        return name.startswith(self.under) and (self.only is None or name in self.only)

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        fs, path = self.opener(self.path)
        info = fs.get_file_info(path)
        if info.type == FileType.Directory:
            found = sorted(f.path for f in fs.get_file_info(FileSelector(path, recursive=True)) if f.type == FileType.File and f.path.lower().endswith(_SUFFIXES) and not f.base_name.startswith(("_", ".")))
        else:
            found = [path] if info.type == FileType.File else []
        out = []
        for archive in found:
            try:
                with fs.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                    infos = _infos(z)
            except (zipfile.BadZipFile, ValueError) as e:  # a file too short for an archive's end is a wrong place to seek
                if self.fail:
                    raise zipfile.BadZipFile(f"not a zip archive: {archive}") from e
                continue
            first, size, any_ = 0, 0, False
            for k, i in enumerate(infos):
                size += i.compress_size
                any_ = any_ or self._wanted(i.filename)
                if size >= self.split or k == len(infos) - 1:
                    if any_:
                        out.append(Entries(archive, first, k + 1))
                    first, size, any_ = k + 1, 0, False
        return out or [Entries("", 0, 0)]

    def read(self, partition):
        if partition.past == partition.first:
            return
        fs, _ = self.opener(self.path)
        with fs.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z:
            for i in _infos(z)[partition.first : partition.past]:
                if self._wanted(i.filename):
                    yield partition.archive, i.filename, i.file_size, z.read(i) if self.content else None


class FilteringReader(ArchiveReader):
    """Takes filters on the entry's name from the query."""

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("entry",) and isinstance(f, EqualTo):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            elif getattr(f, "attribute", None) == ("entry",) and isinstance(f, In):
                self.only = set(f.value) if self.only is None else self.only & set(f.value)
            elif getattr(f, "attribute", None) == ("entry",) and isinstance(f, StringStartsWith) and (not self.under or f.value.startswith(self.under)):
                self.under = f.value
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    name: str | None
    entries: int = 0


class ArchiveWriter(DataSourceWriter):
    opener = staticmethod(open_path)

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        fs, path = self.opener(self.path)
        fs.create_dir(path, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.zip", 0
        temporary = f"{path}/_{name}"
        with fs.open_output_stream(temporary) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for row in iterator:
                z.writestr(zipfile.ZipInfo(row["entry"], (1980, 1, 1, 0, 0, 0)), bytes(row["content"] or b""), zipfile.ZIP_DEFLATED)
                n += 1
        if not n:
            fs.delete_file(temporary)
            return Written(None, None)
        return Written(temporary, f"{path}/{name}", n)

    def commit(self, messages):
        from pyarrow.fs import FileSelector, FileType

        fs, path = self.opener(self.path)
        mine = {m.temporary for m in messages if m and m.temporary}
        if self.overwrite:
            for f in fs.get_file_info(FileSelector(path, allow_not_found=True)):
                if f.type == FileType.File and f.path not in mine:
                    fs.delete_file(f.path)
        for m in messages:
            if m and m.temporary:
                fs.move(m.temporary, m.name)

    def abort(self, messages):
        fs, _ = self.opener(self.path)
        for m in messages:
            if m and m.temporary:
                fs.delete_file(m.temporary)


class ArchiveSource(DataSource):
    filtering = False

    @classmethod
    def name(cls):
        return "archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (FilteringReader if self.filtering else ArchiveReader)(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options, overwrite)


class FilteringArchiveSource(ArchiveSource):
    filtering = True


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    spark.dataSource.register(FilteringArchiveSource if pushes else ArchiveSource)
