"""Queries on what moves: catalogues and their changes, files and archives, documents, streams, tasks."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, functions as F

from ..functions import text as t
from ..operators import catalog, index, paths
from ..operators.store import IndexStore
from ..operators.tasks import Task, TaskGraph
from ..sources import archives, files as sources
from ..storage import fresh_path, saved
from ..streaming import feeds
from .queries import _files, query, table


@query("""
WITH k AS (SELECT doc_id AS file_id, source || '/' || doc_id AS uri, 'k' || doc_id AS file_key, lang FROM documents),
n AS (SELECT 'items/' || item_id AS uri FROM benchmark)
SELECT file_id, CASE WHEN lang = 'fr' THEN 'moved/' || file_id ELSE uri END AS uri, file_key, lang <> 'de' AS live FROM k WHERE lang <> 'de'
UNION ALL SELECT file_id, uri, file_key, false FROM k WHERE lang = 'de'
UNION ALL SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY uri), uri, NULL, true FROM n""")
def id_dictionary(spark, d):
    """Ids after a new listing: moved files keep theirs by key, gone ones become tombstones, new uris get the next numbers."""
    docs = table(spark, d, "documents")
    name, key = F.col("doc_id").cast("string"), F.concat(F.lit("k"), F.col("doc_id").cast("string"))
    uri = F.concat(F.col("source"), F.lit("/"), name)
    known = docs.select(F.col("doc_id").alias("file_id"), uri.alias("uri"), key.alias("file_key"), F.lit(True).alias("live"))
    seen = docs.where("lang <> 'de'").select(F.when(F.col("lang") == "fr", F.concat(F.lit("moved/"), name)).otherwise(uri).alias("uri"), key.alias("file_key"))
    items = table(spark, d, "benchmark").select(F.concat(F.lit("items/"), F.col("item_id").cast("string")).alias("uri"), F.lit(None).cast("string").alias("file_key"))
    return catalog.assign_ids(known, seen.unionByName(items))


@query("SELECT DISTINCT '/' || source || '/' || doc_id AS path FROM documents WHERE source = 'src1'")
def snapshot_tree(spark, d):
    """What lies at or below a root, each path once, in order of path."""
    f = _files(spark, d).select("path")
    return catalog.snapshot(f.unionByName(f), "/src1")


@query("SELECT name, bool_or(folder) AS is_folder FROM (SELECT split_part(p, '/', 2) AS name, contains(substr(p, 2), '/') AS folder FROM (SELECT regexp_replace(substr(split_part(url, '://', 2), length(split_part(split_part(url, '://', 2), '/', 1)) + 1), '[?#].*$', '') AS p FROM pages)) GROUP BY name")
def folder_children(spark, d):
    """What lies directly in a folder; folders are known from what lies below them."""
    rest = F.split_part("url", F.lit("://"), F.lit(2))
    path = F.regexp_replace(F.substring(rest, F.length(F.substring_index(rest, "/", 1)) + 1, F.length(rest)), r"[?#].*\z", "")
    return sources.children(table(spark, d, "pages").select(path.alias("path")), "/")


@query("SELECT '/' || source || '/' || doc_id AS path FROM documents WHERE source IN ('src1', 'src12') UNION ALL SELECT '/' || source || '/' || doc_id FROM documents WHERE source IN ('src1', 'src12') UNION ALL SELECT 'jrt:/modules/m/' || n_name FROM nation")
def source_roots(spark, d):
    """Rows at or below roots of a table, from configuration and of the runtime image; repeated rows stay."""
    f = _files(spark, d).select("path")
    image = table(spark, d, "nation").select(F.concat(F.lit("jrt:/modules/m/"), F.col("n_name")).alias("path"))
    roots = paths.root_rows(spark, ["/src1/", "/src12", "/src1/"]).unionByName(paths.runtime_roots(spark))
    return paths.semi_under_roots(f.unionByName(f).unionByName(image), "path", roots)


@query("SELECT 'changed' AS op, '/' || source || '/' || doc_id AS path FROM documents WHERE lang = 'es' UNION ALL SELECT 'created', '/new/' || item_id FROM benchmark")
def committed_documents(spark, d):
    """The newest text of each modified document, written, and the events that tell of it."""
    f = _files(spark, d)
    edited = f.where("lang in ('es', 'fr')").select("path", F.lit("old").alias("text"), F.lit(1).alias("stamp"), (F.col("lang") == "es").alias("modified"))
    new = table(spark, d, "benchmark").select(F.concat(F.lit("/new/"), F.col("item_id").cast("string")).alias("path"), "text", F.lit(1).alias("stamp"), F.lit(True).alias("modified"))
    open_ = edited.unionByName(new).unionByName(edited.withColumns({"text": F.lit("new"), "stamp": F.lit(2)}))
    return sources.commit_documents(open_, f.select("path", F.lit(False).alias("read_only")), fresh_path(spark, "documents"))


def _exported(spark, d) -> str:
    """Nations as small files of an image: <folder>/<region>/<nation>.class. Twenty-five rows, so the driver writes them."""
    root = fresh_path(spark, "image")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").collect():
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{r['r_name']}/{r['n_name']}.class")
        out = p.getFileSystem(conf).create(p, True)
        out.write(bytearray(r["n_name"].encode()))
        out.close()
    return root


@query("SELECT n_name || '.class' AS name, 'class' AS ext, length(n_name) AS length, sha256(n_name) AS hash FROM nation")
def scanned_files(spark, d):
    """Files of a folder, whatever lies below it, with their content."""
    f = sources.find(spark, _exported(spark, d))
    return f.select("name", "ext", "length", F.sha2("content", 256).alias("hash"))


@query("SELECT 'jrt:/modules/' || r_name || '/' || n_name || '.class' AS path, length(n_name) AS length FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2")
def image_classes(spark, d):
    """One module of an exported runtime image, by its URI."""
    sources.SCHEMES.register("jrt", sources.runtime_image(_exported(spark, d)))
    module = table(spark, d, "region").where("r_regionkey = 2").first()["r_name"]
    out = sources.find(spark, f"jrt:/modules/{module}").select("path", "length")
    sources.SCHEMES.unregister("jrt")
    return out


@query("SELECT n_name || '.class' AS name, length(n_name) AS length FROM nation")
def copied_tree(spark, d):
    """A folder copied, and the first one deleted."""
    a, b = _exported(spark, d), fresh_path(spark, "copy")
    sources.copy_tree(spark, a, b)
    sources.delete_tree(spark, a)
    return sources.scan(spark, b, content=False).select("name", "length")


@query("SELECT '/items/' || item_id || '.txt' AS path, octet_length(encode(text)) AS length, sha256(text) AS hash FROM benchmark")
def archived_files(spark, d):
    """Files written to an archive, each name once, and read back as a source."""
    b = table(spark, d, "benchmark").select(F.concat(F.lit("/items/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"), F.lit(0).alias("ordinal"))
    path = f"{fresh_path(spark, 'archive')}.zip"
    if "://" in path or path.startswith("file:"):
        path = path.removeprefix("file:").replace("///", "/", 1)
    sources.write_archive(b.unionByName(b.withColumns({"content": F.lit(b"x"), "ordinal": F.lit(1)})), path)
    out = saved(sources.find(spark, f"jar:{path}").select("path", "length", F.sha2("content", 256).alias("hash")), "archived")
    sources.delete_tree(spark, path)
    return out


@query("SELECT source || '/' || doc_id || '.txt' AS entry, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS hash FROM documents WHERE source = 'src2'")
def archive_folder(spark, d):
    """All documents written to zip archives, one a task, and those under one folder read back by ranges of entries."""
    archives.register(spark)
    path = fresh_path(spark, "archives")
    entry = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    table(spark, d, "documents").select(entry.alias("entry"), F.encode("text", "UTF-8").alias("content")).write.format("archive").mode("append").save(path)
    back = spark.read.format("archive").option("under", "src2/").option("splitBytes", 1 << 20).load(path)
    return back.select("entry", "size", F.sha2("content", 256).alias("hash"))


@query("SELECT 'project.id' AS key, 'shop' AS value UNION ALL SELECT 'project.properties.' || n_name, n_regionkey::VARCHAR FROM nation UNION ALL SELECT 'project.subprojects', string_agg(r_name, ',' ORDER BY r_regionkey) FROM region UNION ALL SELECT 'project.subproject.' || r_name || '.path', 'sub/' || r_regionkey FROM region UNION ALL SELECT 'project.plugins', 'words' UNION ALL SELECT 'project.plugin.words.option.least', '3'")
def project_config(spark, d):
    """A project's YAML as flat properties."""
    n = table(spark, d, "nation").orderBy("n_nationkey").collect()  # twenty-five rows
    r = table(spark, d, "region").orderBy("r_regionkey").collect()
    lines = ["id: shop", "properties:", *[f"  {x['n_name']}: {x['n_regionkey']}" for x in n], "subprojects:", *[f"  - {{id: {x['r_name']}, path: sub/{x['r_regionkey']}}}" for x in r], "plugins:", "  - {id: ' words ', options: {least: 3}}", "  - '  '"]
    return spark.createDataFrame(list(sources.flat_config("\n".join(lines)).items()), "key string, value string")


def _event_stream(spark, d, files: int = 4):
    """The events as a stream over several files."""
    path = fresh_path(spark, "events")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    e.repartition(files, "event_id").write.parquet(path)
    return feeds.read_in_batches(spark, path, e.schema, 1)


@query("SELECT user_id::VARCHAR AS lane, event_type AS key, max(event_id) AS seq FROM events GROUP BY ALL")
def streamed_latest(spark, d):
    """Latest-only slots over a stream: each slot's last submission, whatever order files come in."""
    out, checkpoint = fresh_path(spark, "slots"), fresh_path(spark, "checkpoint")
    s = feeds.latest_stream(_event_stream(feeds.rocksdb(spark), d), "user_id", "event_type", "event_id")
    s.drop("kind").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    # The stream tells of every newer submission; the last of them is the slot's.
    return feeds.latest(spark.read.parquet(out), ["lane", "key"], ["seq"])


_KEEP_HOURS, _PARTS = 12, 4


def _in_order(spark, d, name: str, columns: list[str], at: str, moved=None, end: dict | None = None) -> DataFrame:
    """A table as a stream of _PARTS batches, by ranges of a time: cut at quarters of its span, written one after another.
    moved: batches that a row comes later than that. end: the columns of one more row, in a batch of its own."""
    t = table(spark, d, name).select(*columns)
    lo, hi = t.select(F.min(at).cast("timestamp").cast("double"), F.max(at).cast("timestamp").cast("double")).first()
    path = fresh_path(spark, name)
    place = F.least(F.lit(_PARTS - 1), F.floor((F.col(at).cast("timestamp").cast("double") - lo) * _PARTS / ((hi or 0) - (lo or 0) or 1)))
    dealt = t.withColumn("_n", F.least(F.lit(_PARTS - 1), F.coalesce(place, F.lit(0)) + (F.lit(0) if moved is None else moved)))
    if end:
        last = t.limit(0).unionByName(spark.range(1).select(*[F.lit(end.get(f.name)).cast(f.dataType).alias(f.name) for f in t.schema]))
        dealt = dealt.unionByName(last.withColumn("_n", F.lit(_PARTS)))
    for n in range(_PARTS + bool(end)):
        dealt.where(F.col("_n") == n).drop("_n").coalesce(1).write.mode("append").parquet(path)
    return feeds.read_in_batches(spark, path, t.schema, 1)


@query(f"""
WITH x AS (SELECT min(epoch(ts)) AS lo, max(epoch(ts)) AS hi FROM events),
e AS (SELECT user_id::VARCHAR AS lane, event_type AS key, event_id, epoch(ts) AS sec, least({_PARTS - 1}, floor((epoch(ts) - lo) * {_PARTS} / (hi - lo)))::INT AS b FROM events, x),
w AS (SELECT b, max(m) OVER (ORDER BY b) AS mark FROM (SELECT b, max(sec) AS m FROM e GROUP BY b)),
s AS (SELECT lane, key, b, max(event_id) AS seq, max(sec) AS last_sec FROM e GROUP BY ALL),
k AS (SELECT *, max(seq) OVER (PARTITION BY lane, key ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, lead(b) OVER (PARTITION BY lane, key ORDER BY b) AS next_b FROM s),
g AS (SELECT k.*, (SELECT min(w.b) FROM w WHERE floor(w.mark * 1000) >= floor(last_sec * 1000) + {_KEEP_HOURS} * 3600000) AS passed FROM k)
SELECT 'kept' AS kind, lane, key, seq FROM k WHERE top IS NULL OR seq > top
UNION ALL SELECT 'expired', lane, key, seq FROM g WHERE passed IS NOT NULL AND (next_b IS NULL OR greatest(passed, b) + 1 < next_b)""")
def expiring_slots(spark, d):
    """Latest-only slots with event time: submissions come a quarter of the time at once, slots expire hours after their last."""
    own, out = feeds.rocksdb(spark), fresh_path(spark, "slots")
    s = feeds.latest_stream(_in_order(own, d, "events", ["user_id", "event_type", "event_id", "ts"], "ts"), "user_id", "event_type", "event_id", "ts", _KEEP_HOURS * 3_600_000)
    s.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("kind string, lane string, key string, seq long").parquet(out)


_PLACED = f"""WITH x AS (SELECT min(epoch(ts)) AS lo, max(epoch(ts)) AS hi FROM events),
e AS (SELECT *, least({_PARTS - 1}, least({_PARTS - 1}, floor((epoch(ts) - lo) * {_PARTS} / (hi - lo))) + CASE WHEN event_id % 25 = 0 THEN 2 WHEN event_id % 10 = 0 THEN 1 ELSE 0 END)::INT AS b FROM events, x)"""


@query(f"""
{_PLACED},
w AS (SELECT b, max(m) OVER (ORDER BY b) - 3600000 AS mark FROM (SELECT b, max(epoch_us(ts) // 1000) AS m FROM e GROUP BY b)),
r AS (SELECT e.*, time_bucket(INTERVAL 6 HOUR, ts) AS start, coalesce((SELECT max(mark) FROM w WHERE w.b <= e.b - 2), 0) AS mark FROM e),
k AS (SELECT *, epoch_ms(start) + 6 * 3600000 > mark AS kept FROM r)
SELECT epoch_ms(start)::BIGINT AS start, event_type, count(*) AS n FROM k WHERE kept GROUP BY ALL
UNION ALL SELECT NULL, 'late', count(*) FROM k WHERE NOT kept""")
def streamed_windows(spark, d):
    """Counts of six hours and type over events that come out of order, each window told once; and how many rows were late.
    The stream ends with a row far ahead, which lets all windows be told."""
    end = {"ts": "2100-01-01 00:00:00"}
    moved = F.when(F.col("event_id") % 25 == 0, 2).when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    out = fresh_path(spark, "windows")
    s = _in_order(spark, d, "events", ["event_id", "event_type", "ts"], "ts", moved, end).withColumn("ts", F.col("ts").cast("timestamp"))
    w = feeds.window_counts(s.withColumn("event_type", F.coalesce("event_type", F.lit("end"))), "ts", "6 hours", "1 hour", "event_type")
    w.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema("start timestamp, event_type string, n long").parquet(out).where("event_type <> 'end'").select(F.unix_millis("start").alias("start"), "event_type", "n")
    late = table(spark, d, "events").agg(F.count("*").alias("n")).union(told.agg(-F.coalesce(F.sum("n"), F.lit(0)))).agg(F.sum("n").alias("n"))
    return told.unionByName(late.select(F.lit(None).cast("long").alias("start"), F.lit("late").alias("event_type"), "n"))


@query("""
WITH g AS (SELECT user_id, event_id, epoch_us(ts) AS us, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 21600000000)::INT, 1) AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(us) AS start, max(us) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def streamed_sessions(spark, d):
    """Sessions of users over events that come out of order and, every third, twice; a session ends six hours after its last row."""
    out = fresh_path(spark, "sessions")
    moved = F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    s = _in_order(spark, d, "events", ["event_id", "user_id", "ts"], "ts", moved, {"ts": "2100-01-01 00:00:00", "event_id": -1}).withColumn("ts", F.col("ts").cast("timestamp"))
    s = s.withColumn("event_id", F.explode(F.when(F.col("event_id") % 3 == 0, F.array("event_id", "event_id")).otherwise(F.array("event_id"))))
    # Rows may be as late as the whole table is long, so none is lost.
    w = feeds.sessions(s.withColumn("user_id", F.coalesce("user_id", F.lit(-1))), "event_id", "ts", "user_id", "6 hours", "1000 days")
    w.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema("user_id long, start timestamp, last timestamp, n long").parquet(out).where("user_id >= 0")
    return told.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "n")


@query("SELECT 'events' AS listener, count(*) AS n FROM events UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'progress', count(*) FROM events UNION ALL SELECT 'manifest', 0")
def streamed_fan_out(spark, d):
    """Every micro-batch to several listeners, read once; progress counted; a flush that waits for all of it."""
    seen, progress = {"events": 0, "errors": 0}, feeds.Progress(every_ms=0)
    spark.streams.addListener(progress)

    def every(batch, _):
        seen["events"] += batch.count()

    def errors(batch, _):
        seen["errors"] += batch.where("event_type = 'error'").count()

    q = feeds.fan_out(_event_stream(spark, d), [every, errors], fresh_path(spark, "checkpoint"))
    q.awaitTermination()
    number = feeds.flush(q, store=IndexStore(spark, fresh_path(spark, "store")))
    for _ in range(100):  # progress comes on another thread
        if progress.snapshot()["rows"] >= seen["events"]:
            break
        import time

        time.sleep(0.1)
    spark.streams.removeListener(progress)
    return spark.createDataFrame([("events", seen["events"]), ("errors", seen["errors"]), ("progress", progress.snapshot()["rows"]), ("manifest", number)], "listener string, n long")


_CHANGED = "SELECT source AS key, doc_id AS file_id, 'v2' AS value FROM documents WHERE lang = 'en' UNION ALL SELECT source, doc_id, 'v1' FROM documents WHERE lang IN ('es', 'fr')"


def _changes(spark, d) -> DataFrame:
    """Events of all documents as files: created, the English changed, the German deleted."""
    docs = table(spark, d, "documents").select("source", "lang", F.col("doc_id").alias("file_id"), F.lit(1).cast("long").alias("length"))
    ev = docs.select(F.lit("created").alias("op"), "file_id", (F.col("file_id") * 3).alias("seq"), "source", F.lit("v1").alias("v"), F.lit(1).cast("long").alias("last_modified"), "length", "lang")
    ev = ev.unionByName(ev.where("lang = 'en'").withColumns({"op": F.lit("changed"), "seq": F.col("seq") + 1, "v": F.lit("v2"), "last_modified": F.lit(2).cast("long")}))
    ev = ev.unionByName(ev.where("lang = 'de'").withColumns({"op": F.lit("deleted"), "seq": F.col("seq") + 2})).drop("lang")
    return ev


@query(_CHANGED)
def streamed_index(spark, d):
    """An index kept by a stream of changes: of several events of a file in a batch the last counts; German files go."""
    ev, path = _changes(spark, d), fresh_path(spark, "changes")
    ev.repartition(4, "file_id").write.parquet(path)  # a file's events lie together, so one batch has them
    s = IndexStore(spark, fresh_path(spark, "store"))
    s.register(index.IndexDefinition("sources", 1, index.column_key("source", "v")))
    feeds.maintain(feeds.read_in_batches(spark, path, ev.schema, 2), s, fresh_path(spark, "checkpoint")).awaitTermination()
    return s.entries().select("key", "file_id", "value")


class _Dying:
    """A store whose process dies right after a batch was published, once."""

    def __init__(self, store, at: int):
        self.store, self.at = store, at

    def apply(self, *args, batch):
        self.store.apply(*args, batch=batch)
        if batch[1] == self.at:
            raise RuntimeError("lost after publishing")


@query(f"SELECT *, 3 AS layers FROM ({_CHANGED})")
def replayed_batches(spark, d):
    """A stream of created, changed and deleted files, a batch each. The process is lost after the second batch was published
    and before the stream noted it, so the batch comes again: it is known by its number and leaves one layer."""
    ev, path, checkpoint = _changes(spark, d), fresh_path(spark, "changes"), fresh_path(spark, "checkpoint")
    for op in ("created", "changed", "deleted"):  # in this order by the time files were written
        ev.where(F.col("op") == op).coalesce(2).write.mode("append").parquet(path)
    s = IndexStore(spark, fresh_path(spark, "store"))
    s.register(index.IndexDefinition("sources", 1, index.column_key("source", "v")))
    files = len(spark.read.schema(ev.schema).parquet(path).inputFiles()) // 3
    for store in (_Dying(s, 1), s):
        q = feeds.maintain(feeds.read_in_batches(spark, path, ev.schema, files), store, checkpoint)
        try:
            q.awaitTermination()
        except StreamingQueryException as e:
            if "lost after publishing" not in str(e):
                raise
    layers = len(s.manifest()["layers"])
    return s.entries().select("key", "file_id", "value", F.lit(layers).alias("layers"))


@query("SELECT CASE WHEN lang = 'fr' THEN 'renamed' ELSE 'changed' END AS op, CASE WHEN lang = 'fr' THEN 'moved/' || doc_id ELSE source || '/' || doc_id END AS uri FROM documents WHERE lang IN ('fr', 'de')")
def polled_changes(spark, d):
    """Events between two listings of tracked roots, renames first."""
    docs = table(spark, d, "documents")
    uri = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    old = docs.select(uri.alias("uri"), F.col("doc_id").alias("file_key"), "n_chars")
    new = docs.select(F.when(F.col("lang") == "fr", F.concat(F.lit("moved/"), F.col("doc_id").cast("string"))).otherwise(uri).alias("uri"), F.col("doc_id").alias("file_key"), F.when(F.col("lang") == "de", F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"))
    return feeds.poll(old, new, stamp=["n_chars"], file_key="file_key").select("op", "uri")


@query("SELECT user_id, count(*) AS n, true AS one_task, true AS in_order FROM events GROUP BY user_id")
def lanes(spark, d):
    """Rows of a lane are in one task and in order, lanes side by side."""
    e = feeds.in_lanes(table(spark, d, "events").select("user_id", "event_id"), "user_id", ["event_id"])
    e = saved(e.withColumns({"p": F.spark_partition_id(), "m": F.monotonically_increasing_id()}), "lanes")
    by_place, by_id = F.transform(F.array_sort(F.collect_list(F.struct("m", "event_id"))), lambda x: x["event_id"]), F.array_sort(F.collect_list("event_id"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), (F.count_distinct("p") == 1).alias("one_task"), (by_place == by_id).alias("in_order"))


@query("SELECT * FROM (VALUES (0, 'open'), (1, 'inner closed'), (2, 'now ready')) t(k, what), (SELECT count(*) AS n FROM events)")
def readiness(spark, d):
    """Callbacks wait until no work is in progress."""
    r, seen = feeds.Readiness(), []
    with r:
        r.when_ready(lambda: seen.append("now ready"))
        with r:
            n = table(spark, d, "events").count()
            seen.append("open")
        seen.append("inner closed")
    return spark.createDataFrame([(k, w, n) for k, w in enumerate(seen)], "k int, what string, n long")


_STATES = "SELECT * FROM (VALUES (1, 0, 'count', 'EXECUTED'), (1, 1, 'use', 'EXECUTED'), (2, 0, 'count', 'UP_TO_DATE'), (2, 1, 'use', 'UP_TO_DATE'), (3, 0, 'count', 'EXECUTED'), (3, 1, 'use', 'EXECUTED'), (4, 0, 'count', 'UP_TO_DATE'), (4, 1, 'use', 'EXECUTED'), (5, 0, 'count', 'UP_TO_DATE'), (5, 1, 'use', 'UP_TO_DATE'), (6, 0, 'count', 'UP_TO_DATE'), (6, 1, 'use', 'UP_TO_DATE'), (6, 2, 'bad', 'FAILED'), (6, 3, 'top', 'FAILED')) t(run, ordinal, task, status), (SELECT count(*) AS rows FROM nation)"


@query(_STATES)
def dag_status(spark, d):
    """Tasks over real files, run again and again: what is new runs, what didn't change doesn't; then an input changes, a task
    is marked dirty, the state is stored and loaded, and a failing task fails what needs it."""
    source, counted, used, state = (fresh_path(spark, n) for n in ("source", "counted", "used", "state"))
    table(spark, d, "nation").coalesce(1).write.parquet(source)
    read = lambda: spark.read.parquet(counted).first()["n"]

    def fail():
        raise RuntimeError("broken")

    def graph() -> TaskGraph:
        g = TaskGraph(spark)
        g.add(Task("count", lambda: spark.read.parquet(source).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(counted), [source], [counted], fingerprint="content"))
        g.add(Task("use", lambda: spark.createDataFrame([(read(),)], "n long").write.mode("overwrite").parquet(used), [g.output("count")], [used], options={"k": "1"}))
        g.add(Task("bad", fail, cacheable=False))
        g.add(Task("top", lambda: None, depends_on=["use", "bad"]))
        return g

    g, runs = graph(), []
    runs += [g.run("use"), g.run("use")]
    table(spark, d, "nation").select("n_nationkey").coalesce(1).write.mode("overwrite").parquet(source)
    runs.append(g.run("use"))
    g.mark_dirty(spark.createDataFrame([(used,)], "path string"))
    runs.append(g.run("use"))
    g.save_state(state)
    h = graph()
    h.load_state(state)
    runs += [h.run("use"), h.run("top")]
    out = None
    for k, r in enumerate(runs, 1):
        r = r.select(F.lit(k).alias("run"), "ordinal", "task", "status", F.lit(read()).alias("rows"))
        out = r if out is None else out.unionByName(r)
    return out


@query("SELECT * FROM (VALUES ('lib:make', 'EXECUTED'), ('app', 'EXECUTED')) t(task, status), (SELECT count(*) AS n FROM region)")
def linked_graphs(spark, d):
    """A task of one project that needs a task of another."""
    made = []
    lib, app = TaskGraph(spark), TaskGraph(spark)
    lib.add(Task("make", lambda: made.append(table(spark, d, "region").count())))
    app.linked["lib"] = lib
    app.add(Task("app", lambda: None, depends_on=["lib:make"]))
    return app.run("app").select("task", "status", F.lit(made[0]).cast("long").alias("n"))


@query("SELECT doc_id, '/' || source || '/' || doc_id AS path, lower(text) = text AS lower FROM documents WHERE lang <> 'es'")
def unsaved_search(spark, d):
    """A plain scan of texts as they are shown: unsaved ones in place of stored ones, and those that were closed as stored."""
    f = _files(spark, d)
    over = f.where("lang = 'es'").select("path", F.lit("").alias("text"), F.lit(1).alias("stamp"))
    shown = catalog.with_overlay(f, over).where(F.length("text") > 0)
    return shown.select(F.col("file_id").alias("doc_id"), "path", (F.lower("text") == F.col("text")).alias("lower")).where(~t.in_or_under("path", "/none"))
