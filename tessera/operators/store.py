"""An index kept on disk as immutable layers and a manifest that is swapped atomically.

A batch of changes adds one layer, so what is written grows with the change and not with the store. A layer has seven
Parquet tables:

- postings, by index_id: what is filed under a key, in blocks of BLOCK file numbers, so that a key that every file has is many
  rows of bounded size. Range-partitioned and sorted by key and block, with Bloom filters on the key.
- forward, by index_id: what was extracted, file_id, key and value, dealt by ranges of files and sorted by file, for the other
  direction. Postings are made of it, so texts are read and cut up once.
- zones: least and greatest key and file of every file of these two. A lookup reads zones first and then opens only the files
  that can hold what it looks for; in those the scan's filters and the Bloom filters skip row groups.
- sketches: of each index, its keys, files and keys a file, to be merged over layers.
- done (index_id, file_id: what was extracted, also where it gave nothing), stamps (file_id, last_modified, length) and gone
  (file_id: what the batch touched).

Rows of a file count unless a later layer has it in gone; without later layers a read is a plain scan. When layers are many
they are compacted into one.

The manifest names the layers, the version of each definition, the versions each layer was written with, and the last batch
of each stream of changes. A reader that opened a snapshot keeps reading it while its layers are kept (KEEP manifests); a
write that fails leaves the manifest as it was. A batch that comes again is known by its stream and number and changes
nothing. Of writers that finish at one time one publishes first; the others put their layers after its, as if they had
begun later, and start anew only where definitions changed under them. Publishing rests on a rename that refuses to replace
a file (HDFS and local disks do; object stores need a file system layer that does).
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .index import ENTRY, IndexDefinition, estimates, run_all, sketched, sketches

_DONE, _STAMPS, _GONE = "file_id long, index_id string", "file_id long, last_modified long, length long", "file_id long"
_POSTINGS, _FORWARD = "key string, block long, ids array<int>, values array<string>, index_id string", "file_id long, key string, value string, index_id string"
_ZONES = "name string, file string, index_id string, key_lo string, key_hi string, id_lo long, id_hi long, rows long"
_SKETCHES = "index_id string, keys binary, files binary, entries long, per_file binary"
#: A block is the files whose numbers differ in these low bits only.
BLOCK_BITS = 16
#: Times a write is tried again after other writers published first.
TRIES = 20
#: Layers beyond this are compacted; manifests whose layers are kept for readers.
MOST_LAYERS, KEEP = 8, 8


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, most_layers: int = MOST_LAYERS):
        self.spark, self.root, self.most_layers = spark, root.rstrip("/"), most_layers
        self.definitions: dict[str, IndexDefinition] = {}
        self._jvm = spark.sparkContext._jvm
        path = self._path("")
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)

    # --- manifest ---------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _numbers(self) -> list[int]:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n[9:]) for n in found if n.startswith("manifest-"))

    def manifest(self, number: int | None = None) -> dict:
        """The newest complete manifest: manifests are numbered files, and a file appears by one rename."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "layers": [], "versions": {}, "batches": {}}
        stream = self._fs.open(self._path(f"manifest-{numbers[-1] if number is None else number}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, layers: list[dict], versions: dict, batches: dict, base: int) -> bool:
        """Write the manifest after base; False if there is one already."""
        m = {"number": base + 1, "layers": layers, "versions": versions, "batches": batches}
        temp, place = self._path(f".manifest-{uuid.uuid4().hex}"), self._path(f"manifest-{base + 1}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        if not self._fs.exists(place) and self._fs.rename(temp, place):
            return True
        self._fs.delete(temp, False)
        return False

    def _commit(self, layer: dict, written: dict, seen: dict, batch: tuple[str, int] | None) -> bool:
        """Publish a layer written against the manifest `seen`, after whatever others published since. False if the batch is
        there already. Raises Conflict if a definition it wrote is no longer as it was."""
        now = seen
        for _ in range(TRIES):
            if _has(now, batch):
                self._fs.delete(self._path(layer["name"]), True)
                return False
            if any(now["versions"].get(i) != seen["versions"].get(i) for i in written):
                self._fs.delete(self._path(layer["name"]), True)
                raise Conflict(f"definitions changed while a layer was written: {sorted(written)}")
            batches = {**now.get("batches", {}), **({batch[0]: batch[1]} if batch else {})}
            if self._publish([*now["layers"], layer], {**now["versions"], **written}, batches, now["number"]):
                return True
            now = self.manifest()
        raise Conflict("other writers published first every time")

    def expire(self, keep: int = KEEP) -> int:
        """Delete all but the newest manifests, and layers that none of them names. Returns the layers deleted."""
        numbers = self._numbers()
        named = {x["name"] for n in numbers[-keep:] for x in self.manifest(n)["layers"]}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"manifest-{n}"), False)
        old = [p for p in (s.getPath() for s in self._fs.listStatus(self._path(""))) if p.getName().startswith("layer-") and p.getName() not in named]
        for p in old:
            self._fs.delete(p, True)
        return len(old)

    # --- reading ----------------------------------------------------------------------------------------------------

    def _visible(self, m: dict) -> dict:
        """Versions of the indexes that are shown: not those whose registered definition has another."""
        return {i: v for i, v in m["versions"].items() if i not in self.definitions or self.definitions[i].version == v}

    def _table(self, layer: dict, name: str, schema: str, files: list[str] | None = None) -> DataFrame:
        root = f"{self.root}/{layer['name']}/{name}"
        r = self.spark.read.schema(schema)
        return r.parquet(root) if files is None else r.option("basePath", root).parquet(*[f"{root}/{f}" for f in files])

    def _empty(self, schema: str) -> DataFrame:
        """No rows, in a form that the optimiser knows to be empty, so joins with it fall away."""
        return self.spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", "))])

    def _read(self, m: dict, name: str, schema: str, versions: dict | None = None, files: dict[str, list[str]] | None = None) -> DataFrame:
        """Rows of a table over all layers that no later layer has retracted; files: those to read of each layer."""
        parts, layers, none = [], m["layers"], None
        for k, layer in enumerate(layers):
            if files is not None and not files[layer["name"]]:
                continue
            t = self._table(layer, name, schema, files and files[layer["name"]])
            if versions is not None:
                t = t.where(F.col("index_id").isin(*[i for i, v in versions.items() if layer["versions"].get(i) == v]))
            t = _unpacked(t) if name == "postings" else t
            later = [self._table(x, "gone", _GONE) for x in layers[k + 1 :]]
            if later:
                t = t.join(reduce(DataFrame.unionByName, later).distinct(), "file_id", "left_anti")
            parts.append(t)
        if not parts:
            none = self._empty(schema)
        return reduce(DataFrame.unionByName, parts) if parts else _unpacked(none) if name == "postings" else none

    def _files_of(self, m: dict, name: str, admits) -> dict[str, list[str]]:
        """Files of a table, by layer, whose zone admits what is looked for. One job over the zones."""
        parts = [self.spark.read.schema(_ZONES).parquet(f"{self.root}/{x['name']}/zones").where((F.col("name") == name) & admits).select(F.lit(x["name"]).alias("layer"), "file") for x in m["layers"]]
        out: dict[str, list[str]] = {x["name"]: [] for x in m["layers"]}
        for r in reduce(DataFrame.unionByName, parts).distinct().collect() if parts else []:
            out[r["layer"]].append(r["file"])
        return out

    def _only(self, m: dict, name: str, schema: str, index_id: str, admits) -> DataFrame:
        """_read of one index, which opens only files whose zone admits what is looked for."""
        return self._read(m, name, schema, {i: v for i, v in self._visible(m).items() if i == index_id}, self._files_of(m, name, (F.col("index_id") == index_id) & admits))

    def entries(self) -> DataFrame:
        """Entries of the current snapshot; what a definition of another version wrote is not shown."""
        m = self.manifest()
        return self._read(m, "postings", _POSTINGS, self._visible(m)).select("index_id", "key", "file_id", "value")

    def find(self, index_id: str, key: str) -> DataFrame:
        """Entries under a key, from the files that can hold it."""
        rows = self._only(self.manifest(), "postings", _POSTINGS, index_id, F.lit(key).between(F.col("key_lo"), F.col("key_hi")))
        return rows.where((F.col("index_id") == index_id) & (F.col("key") == key)).select("index_id", "key", "file_id", "value")

    def under(self, index_id: str, start: str) -> DataFrame:
        """Entries under keys that begin with start, from the files that can hold such."""
        admits = (F.col("key_hi") >= start) & ((F.col("key_lo") <= start) | F.col("key_lo").startswith(start))
        rows = self._only(self.manifest(), "postings", _POSTINGS, index_id, admits)
        return rows.where((F.col("index_id") == index_id) & F.col("key").startswith(start)).select("index_id", "key", "file_id", "value")

    def keys_of(self, index_id: str, file_id: int) -> DataFrame:
        """Distinct keys of a file, from the table that lies by file."""
        rows = self._only(self.manifest(), "forward", _FORWARD, index_id, F.lit(file_id).between(F.col("id_lo"), F.col("id_hi")))
        return rows.where((F.col("index_id") == index_id) & (F.col("file_id") == file_id)).select("key").distinct()

    def blocks(self, index_id: str, key: str) -> DataFrame:
        """(block, ids): the files under a key as offsets in their blocks, sorted; retracted files are taken out block by block."""
        m = self.manifest()
        admitted = self._files_of(m, "postings", (F.col("index_id") == index_id) & F.lit(key).between(F.col("key_lo"), F.col("key_hi")))
        version, parts = self._visible(m).get(index_id), []
        for k, layer in enumerate(m["layers"]):
            if version is None or layer["versions"].get(index_id) != version or not admitted[layer["name"]]:
                continue
            t = self._table(layer, "postings", _POSTINGS, admitted[layer["name"]]).where((F.col("index_id") == index_id) & (F.col("key") == key)).select("block", "ids")
            if m["layers"][k + 1 :]:
                later = reduce(DataFrame.unionByName, [self._table(x, "gone", _GONE) for x in m["layers"][k + 1 :]])
                later = later.groupBy(_block("file_id").alias("block")).agg(F.collect_set(_offset("file_id")).alias("_gone"))
                t = t.join(later, "block", "left").select("block", F.array_except("ids", F.coalesce("_gone", F.array().cast("array<int>"))).alias("ids"))
            parts.append(t)
        if not parts:
            return self._empty("block long, ids array<int>")
        # A file is in one layer at most, so blocks of layers only need to be put together.
        out = reduce(DataFrame.unionByName, parts).groupBy("block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
        return out.where(F.size("ids") > 0)

    def estimates(self) -> DataFrame:
        """(index_id, entries, keys, files, p50, p90, p99 of the keys a file has), estimated from the layers' sketches without
        reading entries. What later layers have retracted counts until layers are compacted."""
        m, parts = self.manifest(), []
        for layer in m["layers"]:
            shown = [i for i, v in self._visible(m).items() if layer["versions"].get(i) == v]
            parts.append(self._table(layer, "sketches", _SKETCHES).where(F.col("index_id").isin(*shown)))
        return estimates(reduce(DataFrame.unionByName, parts) if parts else self._empty(_SKETCHES))

    def ready(self) -> bool:
        """All registered definitions have been brought up at their versions."""
        v = self.manifest()["versions"]
        return all(v.get(i) == d.version for i, d in self.definitions.items())

    # --- registry ---------------------------------------------------------------------------------------------------

    def register(self, definition: IndexDefinition) -> None:
        """A changed version, up or down, hides the index's entries at once and has them rebuilt by the next refresh."""
        self.definitions[definition.id] = definition

    def invalidate(self) -> None:
        """Forget all entries, stamps and versions."""
        for _ in range(TRIES):
            m = self.manifest()
            if self._publish([], {}, m.get("batches", {}), m["number"]):
                return
        raise Conflict("other writers published first every time")

    def missing(self, files: DataFrame) -> DataFrame:
        """(index_id, file_id) of supported files that a registered index lacks at its version."""
        m = self.manifest()
        done = self._read(m, "done", _DONE, self._visible(m))
        parts = []
        for d in self.definitions.values():
            f = _supported(files, d)
            lacks = f.join(done.where(F.col("index_id") == d.id).select("file_id"), "file_id", "left_anti")
            parts.append((lacks if m["versions"].get(d.id) == d.version else f).select("index_id", "file_id"))
        return reduce(DataFrame.unionByName, parts) if parts else self._empty("index_id string, file_id long")

    # --- maintenance ------------------------------------------------------------------------------------------------

    def stamps(self) -> DataFrame:
        return self._read(self.manifest(), "stamps", _STAMPS)

    def stale(self, files: DataFrame, m: dict | None = None) -> DataFrame:
        """files whose stamp isn't the stored one; a null stamp equals only a null stamp. m: the manifest to read, else the newest."""
        s = self._read(m or self.manifest(), "stamps", _STAMPS)
        on = (files["file_id"] == s["file_id"]) & files["last_modified"].eqNullSafe(s["last_modified"]) & files["length"].eqNullSafe(s["length"])
        return files.join(s, on, "left_anti")

    def refresh(self, files: DataFrame) -> dict:
        """Bring the store to these files (all of them): new and changed are extracted, gone are retracted, unchanged are
        extracted only for indexes that lack them."""
        for left in reversed(range(TRIES)):
            m = self.manifest()
            gone = self._read(m, "stamps", _STAMPS).join(files, "file_id", "left_anti").select("file_id")
            try:
                # Without layers all files are stale, and none is left to fill in.
                return self._apply(m, self.stale(files, m), gone, files if m["layers"] else None, None)
            except Conflict:
                if not left:
                    raise
        return {}

    def apply(self, changed: DataFrame, deleted: DataFrame, backfill: DataFrame | None = None, batch: tuple[str, int] | None = None) -> dict:
        """One batch as one layer: entries of changed and deleted files go, changed files are extracted anew.

        changed: the columns the extractors read, with file_id, last_modified, length; of several rows of a file the newest
        counts, then the longest, then the one of greatest hash. backfill: all files, for indexes that lack them. batch: the
        stream and number of the batch, if it may come again; one that has been published is left out.
        """
        return self._apply(self.manifest(), changed, deleted, backfill, batch)

    def _apply(self, m: dict, changed: DataFrame, deleted: DataFrame, backfill: DataFrame | None, batch: tuple[str, int] | None) -> dict:
        """apply() on the state that a manifest tells."""
        if _has(m, batch):
            return {"changed": 0, "touched": 0}
        place = F.struct(F.coalesce("last_modified", F.lit(-1)), F.coalesce("length", F.lit(-1)), F.xxhash64(*changed.columns))
        newest = changed.repartitionByRange("file_id").groupBy("file_id").agg(F.max_by(F.struct(*changed.columns), place).alias("_f"))
        # The group's own file_id, by whose ranges rows are dealt: extractors that group by it need no exchange, and what they
        # give lies by ranges of files.
        newest = newest.select("file_id", *[F.col("_f").getField(c).alias(c) for c in changed.columns if c != "file_id"]).persist()
        touched = newest.select(F.col("file_id").cast("long")).unionByName(deleted.select(F.col("file_id").cast("long"))).distinct().persist()
        live = [d for i, d in self.definitions.items() if m["versions"].get(i) == d.version]
        new = [d for i, d in self.definitions.items() if m["versions"].get(i) != d.version] if backfill is not None or not m["layers"] else []
        entries, done, rest = [run_all(newest, live + new)], [_supported(newest, d) for d in live + new], None
        if backfill is not None and new:
            rest = backfill.join(touched, "file_id", "left_anti").repartitionByRange("file_id").persist()
            entries.append(run_all(rest, new))
            done += [_supported(rest, d) for d in new]
        versions = {**m["versions"], **{d.id: d.version for d in live + new}}
        union = lambda parts, schema: reduce(DataFrame.unionByName, parts) if parts else self._empty(schema)
        stamps = newest.select("file_id", "last_modified", "length").select(*[F.col(c).cast("long") for c in ("file_id", "last_modified", "length")])
        layer = self._layer(union(entries, ENTRY), union(done, _DONE), stamps, touched, versions)
        self._commit(layer, {d.id: d.version for d in live + new}, m, batch)
        counts = {"changed": newest.count(), "touched": touched.count()}
        for df in (newest, touched, rest):
            if df is not None:
                df.unpersist()
        if len(m["layers"]) >= self.most_layers:
            self.compact()
        return counts

    def _layer(self, entries: DataFrame, done: DataFrame, stamps: DataFrame, gone: DataFrame, versions: dict) -> dict:
        """Write a layer; entries come dealt by ranges of files."""
        name = f"layer-{uuid.uuid4().hex}"
        root, layer = f"{self.root}/{name}", {"name": name, "versions": versions}
        entries.select("file_id", "key", "value", "index_id").sortWithinPartitions("index_id", "file_id", "key").write.partitionBy("index_id").parquet(f"{root}/forward")
        # What has been written is read again, so nothing is extracted twice, also not for the bounds of the ranges.
        back = self._table(layer, "forward", _FORWARD).withColumn("block", _block("file_id"))
        # A key's files in blocks: the group of a key and block has the files of one block only, however hot the key is.
        # One exchange by ranges serves the grouping, the order of the rows and that of the files.
        dealt = back.repartitionByRange("index_id", "key", "block")
        packed = dealt.groupBy("index_id", "key", "block").agg(F.array_sort(F.collect_list(F.struct(_offset("file_id").alias("id"), "value"))).alias("_f"))
        packed = packed.select("index_id", "key", "block", F.col("_f.id").alias("ids"), F.col("_f.value").alias("values"))
        packed = packed.sortWithinPartitions("index_id", "key", "block")
        blooms = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(1 << 20)}
        packed.write.partitionBy("index_id").options(**blooms).parquet(f"{root}/postings")
        # Sketches a file, in one pass with the zones: a task has a few files, so it groups them by hashing and sorts no rows.
        forward = self._of_files(layer, "forward", *sketched()).persist()
        self._zones(layer, forward).write.parquet(f"{root}/zones")
        sketches(self._table(layer, "forward", _FORWARD), forward).write.parquet(f"{root}/sketches")
        forward.unpersist()
        done.write.partitionBy("index_id").parquet(f"{root}/done")
        stamps.write.parquet(f"{root}/stamps")
        gone.write.parquet(f"{root}/gone")
        return layer

    def _of_files(self, layer: dict, name: str, *more) -> DataFrame:
        """One row a file of postings or forward: its zone, and more aggregates."""
        low, size = F.shiftleft("block", BLOCK_BITS), (1 << BLOCK_BITS) - 1
        schema, lo, hi = (_POSTINGS, low, low + size) if name == "postings" else (_FORWARD, F.col("file_id"), F.col("file_id"))
        # Grouped by paths as they are: what is derived from a path is worked out once a file, not once a row.
        t = self._table(layer, name, schema).groupBy(F.col("_metadata.file_path").alias("path"), "index_id")
        t = t.agg(F.min("key").alias("key_lo"), F.max("key").alias("key_hi"), F.min(lo).alias("id_lo"), F.max(hi).alias("id_hi"), F.count("*").alias("rows"), *more)
        # Names from the table's folder on, as they stand in its index_id folders.
        file = F.url_decode(F.replace(F.substring_index("path", "/", -2), F.lit("+"), F.lit("%2B")))
        return t.withColumns({"file": file, "name": F.lit(name)})

    def _zones(self, layer: dict, forward: DataFrame | None = None) -> DataFrame:
        """One row a file of postings and forward; forward: _of_files of that, if it is there."""
        parts = [self._of_files(layer, "postings"), self._of_files(layer, "forward") if forward is None else forward]
        return reduce(DataFrame.unionByName, [p.select(*[c.split()[0] for c in _ZONES.split(", ")]) for p in parts]).coalesce(1)

    def compact(self) -> None:
        """All layers as one, without what is retracted or of versions no longer current."""
        m = self.manifest()
        if not m["layers"]:
            return
        now = lambda name, schema, v: self._read(m, name, schema, v)
        entries = now("forward", _FORWARD, m["versions"]).repartitionByRange("index_id", "file_id")
        layer = self._layer(entries, now("done", _DONE, m["versions"]), now("stamps", _STAMPS, None), self._empty(_GONE), m["versions"])
        seen = [x["name"] for x in m["layers"]]
        for _ in range(TRIES):
            latest = self.manifest()
            # Layers that others added meanwhile stay behind the compacted one; if they compacted or invalidated, theirs holds.
            if [x["name"] for x in latest["layers"][: len(seen)]] != seen:
                self._fs.delete(self._path(layer["name"]), True)
                return
            if self._publish([layer, *latest["layers"][len(seen) :]], latest["versions"], latest.get("batches", {}), latest["number"]):
                self.expire()
                return


class Conflict(RuntimeError):
    """Definitions changed, or others published first, while a layer was written."""


def _has(m: dict, batch: tuple[str, int] | None) -> bool:
    return batch is not None and m.get("batches", {}).get(batch[0], -1) >= batch[1]


def _block(file: str):
    return F.shiftright(F.col(file).cast("long"), BLOCK_BITS)


def _offset(file: str):
    return F.col(file).cast("long").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _unpacked(postings: DataFrame) -> DataFrame:
    """Blocks as rows: key, file_id, value, index_id."""
    t = postings.select("index_id", "key", "block", F.explode(F.arrays_zip("ids", "values")).alias("_z"))
    return t.select("key", F.shiftleft("block", BLOCK_BITS).bitwiseOR(F.col("_z.ids").cast("long")).alias("file_id"), F.col("_z.values").alias("value"), "index_id")


def _supported(files: DataFrame, d: IndexDefinition) -> DataFrame:
    f = files if d.supports is None else files.where(d.supports)
    return f.select(F.col("file_id").cast("long").alias("file_id"), F.lit(d.id).alias("index_id"))


def mount(spark: SparkSession, roots: list[str]) -> list[DataFrame]:
    """Entries of other stores, read only; ones that are missing or broken are left out, repeated ones are read once."""
    out = []
    for root in dict.fromkeys(r.rstrip("/") for r in roots):
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                s = IndexStore(spark, root)
                if s.manifest()["layers"]:
                    out.append(s.entries())
        except Exception:  # best effort: a broken store must not stop the others
            continue
    return out


def build_shared(files: DataFrame, definitions: list[IndexDefinition], root: str) -> dict:
    """A store of its own over files, for others to mount."""
    store = IndexStore(files.sparkSession, root)
    for d in definitions:
        store.register(d)
    return store.refresh(files)
