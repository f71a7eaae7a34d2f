import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import index, lookup, store as stores
from tessera.operators.tasks import EXECUTED, FAILED, UP_TO_DATE, Task, TaskGraph
from tessera.sources import files as sources
from tessera.streaming import feeds

FILES = "file_id long, path string, text string, last_modified long, length long"
NAMES = index.IndexDefinition("names", 1, index.word_after("class"))
EXTS = index.IndexDefinition("exts", 1, lambda f: f.select("file_id", F.substring_index("path", ".", -1).alias("key"), F.col("path").alias("value")))


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


def files(spark, *r):
    return spark.createDataFrame(list(r), FILES)


def test_retraction_and_sharing(spark, tmp_path):
    s = stores.IndexStore(spark, str(tmp_path / "s"))
    s.register(NAMES)
    s.refresh(files(spark, (1, "/a.x", "class Old {}", 1, 1), (2, "/b.x", "class Old {}", 1, 1)))
    assert rows(lookup.exact(s.entries(), "names", "Old"), "file_id") == [(1,), (2,)]
    before = s.entries()
    s.refresh(files(spark, (1, "/a.x", "class New {}", 2, 1), (2, "/b.x", "class Old {}", 1, 1)))
    assert rows(s.entries(), "key", "file_id") == [("New", 1), ("Old", 2)]
    assert before.count() == 2  # a reader keeps its snapshot
    s.refresh(files(spark, (1, "/a.x", "nothing", 3, 1), (2, "/b.x", "class Old {}", 1, 1)))  # extraction became empty
    assert rows(s.entries(), "key", "file_id") == [("Old", 2)]
    s.refresh(files(spark, (1, "/a.x", "nothing", 3, 1)))  # delete
    assert rows(s.entries()) == []
    assert s.missing(files(spark, (1, "/a.x", "nothing", 3, 1))).isEmpty()


def test_unchanged_files_are_skipped_and_new_indexes_filled(spark, tmp_path):
    s = stores.IndexStore(spark, str(tmp_path / "s"))
    s.register(NAMES)
    f = files(spark, (1, "/a.x", "class A", 1, 1), (2, "/b.y", "class B", None, 1))
    assert s.refresh(f)["changed"] == 2
    assert s.refresh(f)["changed"] == 0
    s.register(EXTS)
    assert not s.ready() and s.missing(f).count() == 2
    assert s.refresh(f)["changed"] == 0
    assert s.ready() and rows(s.entries(), "index_id", "key") == [("exts", "x"), ("exts", "y"), ("names", "A"), ("names", "B")]


@pytest.mark.parametrize("version", [2, 0])
def test_version_change_hides_old_entries(spark, tmp_path, version):
    s = stores.IndexStore(spark, str(tmp_path / "s"))
    s.register(NAMES)
    f = files(spark, (1, "/a.x", "class A", 1, 1))
    s.refresh(f)
    s.register(index.IndexDefinition("names", version, index.column_key("path", "path")))
    assert rows(s.entries()) == []
    s.refresh(f)
    assert rows(s.entries(), "key") == [("/a.x",)]


def test_a_new_store_is_filled_with_few_exchanges(spark, tmp_path):
    """What names a file is worked out once a file and not once an entry; a first fill joins nothing."""
    s = stores.IndexStore(spark, str(tmp_path / "s"))
    s.register(index.IndexDefinition("a+b %2B", 1, index.words()))
    f = spark.createDataFrame([(i, f"/f{i}", "x y" if i % 2 else "y z z", 0, 3) for i in range(50)], "file_id long, path string, text string, last_modified long, length long")
    written = []
    write, s._layer = s._layer, lambda *a: written.append(a) or write(*a)
    s.refresh(f)
    entries, _, stamps, gone, _ = written[0]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in plan(df) for df in (entries, stamps, gone))
    zones = plan(s._zones(s.manifest()["layers"][0]))
    grouping = [line.split("], [")[0] for line in zones.splitlines() if "Aggregate [" in line]
    assert grouping and not any("url_decode" in g or "regexp" in g or "substring" in g for g in grouping)
    assert sorted(tuple(r) for r in s.find("a+b %2B", "z").select("file_id", "value").collect()) == [(i, "2") for i in range(0, 50, 2)]
    assert sorted(r["key"] for r in s.keys_of("a+b %2B", 1).collect()) == ["x", "y"]
    assert s.estimates().select("entries", "keys", "files").first() == (100, 3, 50)


def test_files_are_extracted_once_and_lie_in_order(spark, tmp_path):
    """Neither the bounds of the ranges nor the table by file extract anew; what is extracted is written by ranges of files."""
    runs = spark.sparkContext.accumulator(0)
    one, two = index.python_extractor(lambda r: runs.add(1) or {"b": "1", "a": r["path"]}, ["path"]), index.words()
    s = stores.IndexStore(spark, str(tmp_path / "s"))
    s.register(index.IndexDefinition("one", 1, one))
    s.register(index.IndexDefinition("two", 1, two))
    f = [(i, f"/{i}", "d c c", 1, 1) for i in range(60)]
    s.refresh(files(spark, *f[::-1]))
    assert runs.value == 60
    for at in (tmp_path / "s").glob("layer-*/forward/index_id=*/*.parquet"):
        got = [tuple(r) for r in spark.read.parquet(str(at)).select("file_id", "key").collect()]
        assert got and got == sorted(got)
    spans = sorted((z["id_lo"], z["id_hi"]) for z in s._zones(s.manifest()["layers"][0]).where("name = 'forward' and index_id = 'two'").collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert rows(s.entries(), "index_id", "key", "file_id", "value") == sorted([("one", "a", i, f"/{i}") for i in range(60)] + [("one", "b", i, "1") for i in range(60)] + [("two", "c", i, "2") for i in range(60)] + [("two", "d", i, "1") for i in range(60)], key=repr)
    s.compact()
    assert s.entries().count() == 240 and s.keys_of("two", 7).count() == 2 and s.estimates().where("index_id = 'two'").select("entries", "files", "p50").first() == (120, 60, 2)


def test_incremental_equals_rebuild(spark, tmp_path):
    words = index.IndexDefinition("words", 1, index.words())
    one, two = (stores.IndexStore(spark, str(tmp_path / n)) for n in ("one", "two"))
    one.register(words)
    two.register(words)
    one.refresh(files(spark, *[(i, f"/{i}", f"w{i % 3} common w{i}", 1, 1) for i in range(20)]))
    final = files(spark, *[(i, f"/{i}", f"w{i % 3} common w{i}" if i % 4 else "changed text", 1 if i % 4 else 2, 1) for i in range(20) if i % 5])
    one.refresh(final)
    two.refresh(final)
    assert rows(one.entries()) == rows(two.entries())


def test_a_batch_is_one_layer_and_many_are_compacted(spark, tmp_path):
    words = index.IndexDefinition("words", 1, index.words())
    s = stores.IndexStore(spark, str(tmp_path / "s"), most_layers=4)
    s.register(words)
    now = {i: f"common w{i}" for i in range(40)}
    s.refresh(files(spark, *[(i, f"/{i}", t, 1, 1) for i, t in now.items()]))
    seen = []
    for turn in range(6):
        changed = {i: f"turn{turn} w{i}" for i in (turn, turn + 1)}
        now |= changed
        now.pop(30 + turn)
        s.apply(files(spark, *[(i, f"/{i}", t, 2 + turn, 1) for i, t in changed.items()]), spark.createDataFrame([(30 + turn,)], "file_id long"))
        m = s.manifest()
        seen.append(len(m["layers"]))
        if len(m["layers"]) > 1:  # what was written is the change
            path = f"{s.root}/{m['layers'][-1]['name']}"
            assert spark.read.parquet(path + "/forward").count() == 4 and spark.read.parquet(path + "/gone").count() == 3
        assert rows(s.entries(), "key", "file_id") == sorted(((w, i) for i, t in now.items() for w in t.split()), key=repr)
    assert 1 in seen and max(seen) <= 4
    old = s.entries()
    s.compact()
    assert rows(old) == rows(s.entries())  # still there for readers
    assert s.expire(keep=1) > 0 and len(s.manifest()["layers"]) == 1
    assert rows(s.entries(), "key", "file_id") == sorted(((w, i) for i, t in now.items() for w in t.split()), key=repr)


def test_a_key_reaches_the_scan_and_few_files(spark, tmp_path):
    s = stores.IndexStore(spark, str(tmp_path / "s"))
    s.register(index.IndexDefinition("names", 1, index.column_key("path", "path")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s.refresh(files(spark, *[(i, f"k{i:04d}", "", 1, 1) for i in range(400)]))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hit = lookup.exact(s.entries(), "names", "k0123")
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,k0123)" in plan and "Exchange" not in plan and "index_id" in plan.split("PartitionFilters")[1]
    holding = s.entries().where("key between 'k0100' and 'k0150'").select(F.input_file_name()).distinct().count()
    assert holding < s.entries().select(F.input_file_name()).distinct().count()


def test_rows_of_one_time_are_decided(spark, tmp_path):
    got = []
    for turn in range(2):
        s = stores.IndexStore(spark, str(tmp_path / f"s{turn}"))
        s.register(index.IndexDefinition("names", 1, index.column_key("path", "path")))
        r = [(1, "/a", "", 5, 1), (1, "/b", "", 5, 1), (1, "/c", "", 5, 1), (2, "/d", "", None, 1), (2, "/e", "", None, 2)]
        s.refresh(files(spark, *(r if turn else r[::-1])).repartition(3))
        got.append(rows(s.entries(), "key", "file_id"))
    assert got[0] == got[1] and ("/e", 2) in got[0] and len(got[0]) == 2


def test_one_helper_call_a_file(spark):
    calls = spark.sparkContext.accumulator(0)

    def helper(r):
        calls.add(1)
        if r["text"] == "bad":
            raise ValueError("bad")
        return r["text"].split()

    one = index.IndexDefinition("one", 1, index.python_extractor(lambda r, w: [(w[0], "1")], ["text"], helper))
    two = index.IndexDefinition("two", 1, index.python_extractor(lambda r, w: [(x, None) for x in w], ["text"], helper), F.col("path") != "/c")
    lone = index.IndexDefinition("lone", 1, index.python_extractor(lambda r: {r["path"]: {"n": 1}}, ["path"]))
    f = files(spark, (1, "/a", "x y", 1, 1), (2, "/b", "bad", 1, 1), (3, "/c", "z", 1, 1))
    got = rows(index.run_all(f, [one, two, lone]), "index_id", "key", "file_id", "value")
    assert got == sorted([("one", "x", 1, "1"), ("one", "z", 3, "1"), ("two", "x", 1, None), ("two", "y", 1, None), *[("lone", p, i, '{"n": 1}') for i, p in ((1, "/a"), (2, "/b"), (3, "/c"))]], key=repr)
    assert calls.value == 3
    assert rows(index.errors_of(two, f)) == [("two", 2, "ValueError: bad")]


def test_shared_stores_and_invalidate(spark, tmp_path):
    stores.build_shared(files(spark, (1, "/a.x", "class A", 1, 1)), [NAMES], str(tmp_path / "lib"))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "manifest-1").write_text("{")
    got = stores.mount(spark, [str(tmp_path / "lib"), str(tmp_path / "lib") + "/", str(tmp_path / "broken"), str(tmp_path / "none")])
    assert len(got) == 1 and rows(lookup.union_stores(*got), "key", "store_id") == [("A", 0)]
    s = stores.IndexStore(spark, str(tmp_path / "lib"))
    s.invalidate()
    assert rows(s.entries()) == []


def test_tasks(spark, tmp_path):
    src, out = tmp_path / "in.txt", tmp_path / "out.txt"
    src.write_text("A")
    g, runs = TaskGraph(spark), []

    def copy():
        runs.append(1)
        out.write_text(src.read_text())

    g.add(Task("copy", copy, [str(src)], [str(out)], fingerprint="content"))
    status = lambda t: {r["task"]: r["status"] for r in g.run(t).collect()}
    assert status("copy") == {"copy": EXECUTED} and status("copy") == {"copy": UP_TO_DATE}
    src.write_text("B")
    assert status("copy") == {"copy": EXECUTED} and out.read_text() == "B"
    out.unlink()
    assert status("copy") == {"copy": EXECUTED}
    g.add(Task("copy", copy, [str(src)], [str(out)], options={"k": "v"}, fingerprint="content"))
    assert status("copy") == {"copy": EXECUTED}
    g.mark_dirty(spark.createDataFrame([(str(src),)], "path string"))
    assert status("copy") == {"copy": EXECUTED} and len(runs) == 5
    g.save_state(str(tmp_path / "state"))
    h = TaskGraph(spark)
    h.tasks = g.tasks
    h.load_state(str(tmp_path / "state"))
    assert h.run("copy").first()["status"] == UP_TO_DATE
    assert g.output("copy") == str(out)
    with pytest.raises(IndexError):
        g.output("copy", 1)
    with pytest.raises(KeyError):
        g.output("none")


def test_task_graph_shapes(spark, tmp_path):
    g, ran = TaskGraph(spark), []
    mid = tmp_path / "mid"
    g.add(Task("make", lambda: (ran.append("make"), mid.write_text("x")), outputs=[str(mid)]))
    g.add(Task("use", lambda: ran.append("use"), inputs=[str(mid)]))
    assert g.order("use") == ["make", "use"]

    def fail():
        raise RuntimeError("no")

    g.add(Task("bad", fail))
    g.add(Task("top", lambda: ran.append("top"), depends_on=["use", "bad"]))
    got = {r["task"]: r["status"] for r in g.run("top").collect()}
    assert got == {"make": EXECUTED, "use": EXECUTED, "bad": FAILED, "top": FAILED} and "top" not in ran
    g.add(Task("p", lambda: None, depends_on=["q"]))
    g.add(Task("q", lambda: None, depends_on=["p"]))
    with pytest.raises(ValueError):
        g.order("p")
    other = TaskGraph(spark)
    other.linked["lib"] = g
    other.add(Task("app", lambda: None, depends_on=["lib:make"]))
    assert {r["task"]: r["status"] for r in other.run("app").collect()}["app"] == EXECUTED


def test_files_and_archives(spark, tmp_path):
    d = tmp_path / "src" / "sub"
    d.mkdir(parents=True)
    (d / "A.txt").write_text("hi")
    with zipfile.ZipFile(tmp_path / "src" / "lib.jar", "w") as z:
        z.writestr("p/A.class", b"1")
        z.writestr("p/q/B.class", b"22")
    f = sources.find(spark, str(tmp_path / "src"))
    assert rows(f, "name", "ext") == [("A.txt", "txt"), ("lib.jar", "jar")]
    j = sources.find(spark, f"jar:{tmp_path}/src/lib.jar!/p")
    assert rows(j, "path", "length") == [("/p/A.class", 1), ("/p/q/B.class", 2)]
    assert rows(sources.children(j, "/p")) == [("A.class", False), ("q", True)]
    with pytest.raises(ValueError):
        sources.find(spark, "gopher:x")
    n = sources.write_archive(spark.createDataFrame([("/b", bytearray(b"2"), 1), ("/a", bytearray(b"1"), 0), ("/a", bytearray(b"x"), 2)], "path string, content binary, ordinal int"), str(tmp_path / "o.zip"))
    with zipfile.ZipFile(io.BytesIO((tmp_path / "o.zip").read_bytes())) as z:
        assert n == 2 and z.namelist() == ["a", "b"] and z.read("a") == b"1"
    sources.copy_tree(spark, str(tmp_path / "src"), str(tmp_path / "copy"))
    assert sources.scan(spark, str(tmp_path / "copy")).count() == 2
    assert sources.delete_tree(spark, str(tmp_path / "copy"))


def test_config():
    got = sources.flat_config("id: x\nproperties: {a: 1, b: }\nsubprojects: [{id: s, path: p}, {path: q}]\nplugins: [one, {id: ' two ', options: {k: v}}, ' ']")
    assert got == {"project.id": "x", "project.properties.a": "1", "project.properties.b": "", "project.subprojects": "s", "project.subproject.s.path": "p", "project.plugins": "one,two", "project.plugin.two.option.k": "v"}
    assert sources.flat_config("- a") == {} and sources.flat_config("a: [") == {}


def test_documents(spark, tmp_path):
    docs = spark.createDataFrame([("/a", "new", 2, True), ("/a", "old", 1, True), ("/b", "x", 1, False)], "path string, text string, stamp long, modified boolean")
    f = spark.createDataFrame([("/a", False), ("/b", True)], "path string, read_only boolean")
    assert rows(sources.commit_documents(docs, f, str(tmp_path / "w"))) == [("changed", "/a")]
    assert rows(spark.read.parquet(str(tmp_path / "w"))) == [("/a", "new")]
    with pytest.raises(PermissionError):
        sources.commit_documents(docs.withColumn("modified", F.lit(True)), f, str(tmp_path / "w"))


def test_latest(spark):
    d = spark.createDataFrame([("l", "k", 1, "a"), ("l", "k", 3, "c"), ("l", "j", 2, "b")], "lane string, key string, seq long, v string")
    assert rows(feeds.latest(d, ["lane", "key"], ["seq"]), "key", "v") == [("j", "b"), ("k", "c")]


def test_lanes(spark):
    d = spark.createDataFrame([(f"l{i % 3}", 30 - i) for i in range(30)], "lane string, seq long")
    parts = feeds.in_lanes(d, "lane", ["seq"]).withColumn("p", F.spark_partition_id()).collect()
    for lane in ("l0", "l1", "l2"):
        mine = [r for r in parts if r["lane"] == lane]
        assert len({r["p"] for r in mine}) == 1 and [r["seq"] for r in mine] == sorted(r["seq"] for r in mine)


def test_streamed_latest_equals_batch(spark, tmp_path):
    d = spark.createDataFrame([("l", f"k{i % 3}", i, "") for i in range(30)], "lane string, key string, seq long, v string")
    for k in range(3):
        d.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    own = feeds.rocksdb(spark)
    s = feeds.read_in_batches(own, str(tmp_path / "in"), d.schema, 1)
    q = feeds.latest_stream(s, "lane", "key", "seq").writeStream.format("memory").queryName("slots").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = own.table("slots").groupBy("lane", "key").agg(F.max("seq").alias("seq"))
    assert rows(got) == rows(feeds.latest(d, ["lane", "key"], ["seq"]), "lane", "key", "seq")


def test_slots_expire_and_late_submissions_are_dropped(spark, tmp_path):
    own, path = feeds.rocksdb(spark), str(tmp_path / "in")
    batches = [
        [("l", "a", 5, 0), ("l", "b", 1, 10), ("l", "n", None, 10), ("l", "n", 4, None)],
        [("l", "a", 4, 20), ("l", "b", 9, 60)],  # a's is stale
        [("l", "c", 1, 100), ("l", "a", 7, 1)],  # a's is late by now: the watermark is at 60
        [("l", "a", 3, 130), ("l", "c", 2, 130)],  # a has expired (20 + 30), so an older number counts again
        [("l", "z", 1, 131)],
    ]
    for b in batches:
        d = spark.createDataFrame(b, "lane string, key string, seq long, s long").selectExpr("lane", "key", "seq", "timestamp_seconds(1000 + s) as at")
        d.coalesce(1).write.mode("append").parquet(path)
    s = feeds.latest_stream(feeds.read_in_batches(own, path, d.schema, 1), "lane", "key", "seq", "at", 30_000)
    q = s.writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = rows(own.table("expiring"), "kind", "key", "seq")
    assert [r[1:] for r in got if r[0] == "kept"] == [("a", 3), ("a", 5), ("b", 1), ("b", 9), ("c", 1), ("c", 2), ("z", 1)]
    assert [r[1:] for r in got if r[0] == "expired"] == [("a", 5), ("b", 9)]


def test_slots_of_a_bucket_share_a_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "BUCKETS", 1)
    own, path = feeds.rocksdb(spark), str(tmp_path / "in")
    batches = [[(None, "a", 1, 1), ("l", None, 2, 10), ("l", "c", 3, 20), *[("m", f"k{i}", i, 20) for i in range(50)]], [("l", "c", 4, 75)], [("n", "d", 5, 90)], [("n", "d", 6, 91)]]
    for b in batches:
        spark.createDataFrame(b, "lane string, key string, seq long, s long").withColumn("at", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
    s = feeds.latest_stream(feeds.read_in_batches(own, path, "lane string, key string, seq long, at timestamp", 1), "lane", "key", "seq", "at", 60_000)
    q = s.writeStream.format("memory").queryName("bucket").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = set(rows(own.table("bucket")))
    many = [("m", f"k{i}", i) for i in range(50)]
    told = [(None, "a", 1), ("l", None, 2), ("l", "c", 3), *many, ("l", "c", 4), ("n", "d", 5), ("n", "d", 6)]
    assert got == {("kept", *x) for x in told} | {("expired", *x) for x in [(None, "a", 1), ("l", None, 2), *many]}
    # 53 slots, but one state and its timer (which has two rows)
    assert max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) <= 4


def test_streamed_maintenance(spark, tmp_path):
    ev = "op string, file_id long, seq long, path string, text string, last_modified long, length long"
    spark.createDataFrame([("created", 1, 1, "/a", "class A", 1, 1), ("created", 2, 2, "/b", "class B", 1, 1)], ev).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = stores.IndexStore(spark, str(tmp_path / "s"))
    s.register(NAMES)
    run = lambda: feeds.maintain(feeds.read_in_batches(spark, str(tmp_path / "in"), ev, 1), s, str(tmp_path / "c")).awaitTermination(120)
    run()
    assert rows(s.entries(), "key") == [("A",), ("B",)]
    spark.createDataFrame([("changed", 1, 3, "/a", "class X", 2, 1), ("changed", 1, 4, "/a", "class C", 3, 1), ("deleted", 2, 5, None, None, None, None)], ev).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert rows(s.entries(), "key", "file_id") == [("C", 1)]


def test_poll_order_and_readiness(spark):
    o = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "3", 1)], "uri string, file_key string, length long")
    n = spark.createDataFrame([("a", "1", 2), ("b2", "2", 1), ("d", "4", 1)], o.schema)
    assert [r["op"] for r in feeds.poll(o, n, stamp=["length"], file_key="file_key").collect()] == ["renamed", "created", "changed", "deleted"]
    r, seen = feeds.Readiness(), []
    with r:
        with r:
            r.when_ready(lambda: seen.append(1))
        assert not r.ready and not seen
    assert r.ready and seen == [1]


BY_PATH = index.IndexDefinition("names", 1, index.column_key("path", "path"))


def _spread(spark, store, r):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.refresh(files(spark, *r))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_lookups_open_only_files_that_can_hold_the_key(spark, tmp_path):
    s = stores.IndexStore(spark, str(tmp_path / "s"))
    s.register(BY_PATH)
    _spread(spark, s, [(i, f"k{(i * 7) % 400:04d}", "", 1, 1) for i in range(400)])
    every = len(s.entries().inputFiles())
    hit = s.find("names", "k0123")
    assert every >= 4 and len(hit.inputFiles()) == 1 and rows(hit, "file_id") == [(i,) for i in range(400) if (i * 7) % 400 == 123]
    assert s.find("names", "zzz").inputFiles() == [] and s.find("none", "k0123").collect() == []
    some = s.under("names", "k01")
    assert 1 <= len(some.inputFiles()) < every and some.count() == 100
    mine = s.keys_of("names", 5)
    assert len(mine.inputFiles()) == 1 and rows(mine) == [("k0035",)]
    s.refresh(files(spark, (1, "k0007", "", 1, 1), (5, "other", "", 2, 1)))
    assert rows(s.keys_of("names", 5)) == [("other",)] and s.find("names", "k0035").collect() == [] and rows(s.find("names", "k0007"), "file_id") == [(1,)]


def test_bloom_filters_are_written(spark, tmp_path):
    s = stores.IndexStore(spark, str(tmp_path / "s"))
    s.register(BY_PATH)
    s.refresh(files(spark, *[(i, f"k{2 * i:04d}", "", 1, 1) for i in range(300)]))
    (name,) = {x["name"] for x in s.manifest()["layers"]}
    f = next((tmp_path / "s" / name / "postings").glob("index_id=*/*.parquet"))
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(str(f))
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, jvm.org.apache.hadoop.conf.Configuration()))
    block = reader.getFooter().getBlocks().get(0)
    column = next(c for c in block.getColumns() if c.getPath().toDotString() == "key")
    bloom = reader.readBloomFilter(column)
    binary = jvm.org.apache.parquet.io.api.Binary
    assert bloom is not None and all(bloom.findHash(bloom.hash(binary.fromString(f"k{2 * i:04d}"))) for i in range(300))
    assert sum(bloom.findHash(bloom.hash(binary.fromString(f"k{2 * i + 1:04d}"))) for i in range(300)) < 30
    reader.close()


def test_posting_blocks(spark, tmp_path):
    """A key of many files lies in blocks; lists meet block by block, also over layers and retractions."""
    s = stores.IndexStore(spark, str(tmp_path / "s"))
    words = index.IndexDefinition("w", 1, index.words())
    s.register(words)
    step = 7001
    text = lambda i: " ".join(["all"] + ["even"] * (i % 2 == 0) + ["third"] * (i % 3 == 0))
    s.refresh(files(spark, *[(i * step - 200_000, f"/{i}", text(i), 1, 1) for i in range(120)]))
    b = s.blocks("w", "all").collect()
    assert len(b) > 8 and sum(len(r["ids"]) for r in b) == 120 and all(0 <= x < 1 << 16 for r in b for x in r["ids"])
    both = lambda *k: sorted((r["file_id"] + 200_000) // step for r in lookup.all_of(s, "w", list(k)).collect())
    assert both("even", "third", "all") == list(range(0, 120, 6)) and both("even", "none") == [] and both("third") == list(range(0, 120, 3))
    now = {i: text(i) for i in range(120)}
    now[6], now[7] = "all", "even third"
    del now[12]
    s.refresh(files(spark, *[(i * step - 200_000, f"/{i}", t, 1 + (t != text(i)), 1) for i, t in now.items()]))
    assert len(s.manifest()["layers"]) == 2 and both("even", "third") == sorted([*[i for i in range(0, 120, 6) if i not in (6, 12)], 7])
    s.compact()
    assert len(s.manifest()["layers"]) == 1 and both("even", "third") == sorted([*[i for i in range(0, 120, 6) if i not in (6, 12)], 7])


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    s = stores.IndexStore(spark, str(tmp_path / "s"))
    s.register(NAMES)
    none = files(spark).select("file_id")
    put = lambda name, n: s.apply(files(spark, (1, "/a", f"class {name}", 1, 1)), none, batch=("stream", n))
    assert put("A", 0)["changed"] == 1 and put("B", 0)["changed"] == 0
    assert len(s.manifest()["layers"]) == 1 and rows(s.entries(), "key") == [("A",)]
    put("C", 1)
    put("B", 0)
    assert len(s.manifest()["layers"]) == 2 and rows(s.entries(), "key") == [("C",)]
    s.compact()
    put("B", 1)
    assert rows(s.entries(), "key") == [("C",)]


def test_writers_that_finish_at_one_time_both_land(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    one, two = stores.IndexStore(spark, root), stores.IndexStore(spark, root)
    one.register(NAMES)
    two.register(NAMES)
    one.refresh(files(spark, (1, "/a", "class A", 1, 1)))
    none = files(spark).select("file_id")
    write = one._layer
    monkeypatch.setattr(one, "_layer", lambda *a: (two.apply(files(spark, (2, "/b", "class Two", 1, 1), (3, "/c", "class Two", 1, 1)), none), write(*a))[1])
    one.apply(files(spark, (3, "/c", "class One", 1, 1), (4, "/d", "class One", 1, 1)), none)
    assert rows(one.entries(), "key", "file_id") == [("A", 1), ("One", 3), ("One", 4), ("Two", 2)]
    monkeypatch.setattr(one, "_layer", lambda *a: (two.apply(files(spark, (5, "/e", "class Five", 1, 1)), none), write(*a))[1])
    one.compact()
    assert len(one.manifest()["layers"]) == 2 and rows(one.entries(), "key", "file_id") == [("A", 1), ("Five", 5), ("One", 3), ("One", 4), ("Two", 2)]


def test_a_definition_that_changes_under_a_writer_is_a_conflict(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    one, two = stores.IndexStore(spark, root), stores.IndexStore(spark, root)
    one.register(NAMES)
    f = files(spark, (1, "/a", "class A", 1, 1))
    one.refresh(f)
    two.register(index.IndexDefinition("names", 2, index.column_key("path", "path")))
    write, turns = one._layer, iter([True])
    monkeypatch.setattr(one, "_layer", lambda *a: (next(turns, None) and two.refresh(f), write(*a))[1])
    with pytest.raises(stores.Conflict):
        one.apply(files(spark, (1, "/a", "class B", 2, 1)), f.select("file_id").limit(0))
    assert rows(two.entries(), "key") == [("/a",)]


def test_registered_lookups_see_the_table_as_it_is(spark, tmp_path):
    from tessera.plans import QUERIES

    part = lambda n, name: spark.range(n).selectExpr("id + 1 as p_partkey", f"concat('{name} ', id % 10) as p_name", "'Brand#1' as p_brand", "5 as p_size")
    part(20, "big").write.parquet(f"{tmp_path}/part.parquet")
    count = lambda: QUERIES["prefix_scan"](spark, str(tmp_path)).count()
    assert count() == 20
    part(3, "blue").unionByName(part(30, "red").where("p_partkey > 3")).write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    assert count() == 3
