import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog, graph, index, lookup, paths, ranking
from tessera.operators.registry import Extensions, Registry, each


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


FILES = "file_id long, path string, text string, last_modified long, length long"


def test_word_after(spark):
    f = spark.createDataFrame([(1, "/a", "class Hello {}", 1, 1), (2, "/b", "x class A  class B", 1, 1), (3, "/c", "class", 1, 1), (4, "/d", None, 1, 1)], FILES)
    d = index.IndexDefinition("names", 1, index.word_after("class"))
    assert rows(d.rows(f), "key", "file_id", "value") == [("A", 2, "/b"), ("B", 2, "/b"), ("Hello", 1, "/a")]
    assert rows(index.forward(d.rows(f)), "file_id", "keys") == [(1, ["Hello"]), (2, ["A", "B"])]


def test_python_extractor_tolerates(spark):
    def per_file(r):
        if r["text"] == "bad":
            raise ValueError("no")
        return [("k", "first"), ("k", "last"), (r["text"], "v")]

    d = index.IndexDefinition("x", 1, index.python_extractor(per_file, ["text"]))
    f = spark.createDataFrame([(1, "/a", "bad", 1, 1), (2, "/b", "ok", 1, 1)], FILES)
    assert rows(d.rows(f), "key", "file_id", "value") == [("k", 2, "last"), ("ok", 2, "v")]
    assert rows(index.errors_of(d, f)) == [("x", 1, "ValueError: no")]


def test_supports_and_fan_out(spark):
    f = spark.createDataFrame([(1, "/a.java", "x", 1, 1), (2, "/b.txt", "y", 1, 1)], FILES).withColumn("ext", F.substring_index("path", ".", -1))
    a = index.IndexDefinition("a", 1, index.column_key("text", "path"), paths.supports("ext", ["java"]))
    b = index.IndexDefinition("b", 1, index.column_key("text", "path"))
    assert rows(index.run_all(f, [a, b]), "index_id", "key") == [("a", "x"), ("b", "x"), ("b", "y")]


E = "index_id string, key string, file_id long, value string"


def entries(spark):
    return spark.createDataFrame([("i", "ab", 1, "v2"), ("i", "abc", 2, "v3"), ("i", "b", 3, "v4"), ("j", "ab", 4, "w"), ("i", "ab", 5, "v1")], E)


def test_lookups(spark):
    e = entries(spark)
    assert rows(lookup.exact(e, "i", "ab")) == [(1, "v2"), (5, "v1")]
    assert rows(lookup.exact(e, "nope", "ab")) == []
    assert rows(lookup.exact(e, "i", "ab", F.col("file_id") > 1)) == [(5, "v1")]
    assert rows(lookup.exact(e, "i", "ab", paths.any_of())) == []
    assert rows(lookup.exact(e, "i", "ab", paths.everything())) == [(1, "v2"), (5, "v1")]
    assert rows(lookup.prefix(e, "i", "ab"), "key") == [("ab",), ("ab",), ("abc",)]
    assert lookup.prefix(e, "i", "").count() == 4
    assert rows(lookup.grouped(e, "i", "ab"), "key", "values") == [("ab", ["v1", "v2"]), ("abc", ["v3"])]
    assert rows(lookup.values(e, "i", "b")) == [("v4",)]
    assert rows(lookup.keys_of(e, "i", 2)) == [("abc",)]
    assert lookup.has_data(e, "j") and not lookup.has_data(e, "k")
    assert [r[0] for r in lookup.first_n(lookup.prefix(e, "i", ""), 2, "key", "file_id").collect()] == ["ab", "ab"]
    u = lookup.union_stores(e, e)
    assert u.count() == 10
    g = u.select(lookup.global_id("store_id", "file_id").alias("g"), "store_id", "file_id")
    s, f = lookup.local_id("g")
    assert g.where((s != F.col("store_id")) | (f != F.col("file_id"))).isEmpty()


def test_prefix_is_pushed_down(spark, tmp_path):
    entries(spark).write.parquet(str(tmp_path / "e"))
    plan = lookup.prefix(spark.read.parquet(str(tmp_path / "e")), "i", "ab")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,ab)" in plan


def test_supplementary_characters_order_by_code_point(spark):
    e = spark.createDataFrame([("i", "k\U0001f600", 1, ""), ("i", "k～", 2, "")], E)
    assert [r[0] for r in lookup.prefix(e, "i", "k").orderBy("key").select("key").collect()] == ["k～", "k\U0001f600"]


def test_nested_fallback(spark):
    e = spark.createDataFrame([("s", "a/b$C", 1, "nested"), ("s", "x/Y", 2, "plain"), ("s", "x$Y", 3, "deep")], E)
    n = spark.createDataFrame([("a/b/C",), ("x/Y",), ("no/no",)], "name string")
    assert rows(lookup.with_fallback(n, e, "s")) == [("a/b/C", "a/b$C", "nested"), ("x/Y", "x/Y", "plain")]


def test_listing_and_first_compatible(spark):
    e = spark.createDataFrame([("p", "a", 1, '{"simple_name":"X","kind":"CLASS"}'), ("p", "a", 2, '{"simple_name":"Y","kind":"SOURCE"}'), ("f", "a.X", 2, ""), ("f", "a.X", 1, ""), ("s", "a/X", 1, "stub")], E)
    f = spark.createDataFrame([(1, "/X.class"), (2, "/Y.java")], "file_id long, path string")
    assert rows(lookup.package_listing(e, f, "p", "a", ["CLASS"])) == [(1, "/X.class", "X", "CLASS")]
    assert lookup.first_compatible(e, f, "f", "a.X", "SOURCE").first()["path"] == "/Y.java"
    assert lookup.first_value(e, "s", "a.X").first()["value"] == "stub"


def test_scopes(spark):
    f = spark.createDataFrame([(p,) for p in ("/src/a", "/src2/a", "/src", "/lib/x")], "path string")
    assert rows(f.where(paths.under_roots("path", ["/src"]))) == [("/src",), ("/src/a",)]
    roots = spark.createDataFrame([("/src/",), ("/lib",)], "root string")
    assert rows(paths.semi_under_roots(f, "path", roots)) == [("/lib/x",), ("/src",), ("/src/a",)]


def test_exports(spark):
    names = ["jrt:/modules/m/open/A.class", "jrt:/modules/m/hidden/B.class", "jrt:/modules/m/module-info.class", "jrt:/modules/u/any/C.class", "jrt:/modules/m/X.class", "/plain/D.class", "jrt:/modules/m/hidden/r.txt"]
    f = spark.createDataFrame([(n,) for n in names], "path string")
    x = spark.createDataFrame([("m", "open")], "module string, package string")
    assert {r[0] for r in paths.exported(f, x).collect()} == {names[0], names[3], names[5], names[6]}


def test_contexts_and_intervals(spark):
    s = spark.createDataFrame([(1, "class", 0, 100), (1, "block", 10, 20)], "file_id long, kind string, start int, end int")
    p = spark.createDataFrame([(1, 10), (1, 50), (1, 200), (2, 5)], "file_id long, offset int")
    assert rows(paths.context_of(p, s)) == [(1, 10, "code_block"), (1, 200, "top_level"), (1, 50, "class_body"), (2, 5, "top_level")]
    n = spark.createDataFrame([(1, 7, 0, 100), (1, 8, 10, 20), (1, 9, 10, 20)], "file_id long, node_id int, start int, end int")
    assert rows(paths.innermost(p, n)) == [(1, 10, 8), (1, 50, 7)]
    assert rows(paths.keywords(spark, "top_level"), "keyword")[0] == ("class",)
    f = spark.createDataFrame([("java",), ("kt",), ("md",)], "ext string")
    assert rows(paths.first_language(f, [("jvm", ["java", "kt"]), ("java", ["java"])])) == [("java", "jvm"), ("kt", "jvm"), ("md", None)]


def test_ranking(spark):
    i = spark.createDataFrame([("foo", 0, "type", 0), ("foobar", 10000, "type", 1)], "lookup string, priority int, kind string, ordinal int")
    assert [r["lookup"] for r in ranking.rank(i, "foo").collect()] == ["foo", "foobar"]
    i = spark.createDataFrame([("foo", 0, "type", 0), ("fork", 100, "type", 1)], i.schema)
    assert [r["lookup"] for r in ranking.rank(i, "fo").collect()] == ["fork", "foo"]
    i = spark.createDataFrame([("ab", 0, "method", 0), ("ac", 0, "local", 1), ("ad", 0, "parameter", 2), ("ae", 0, "field", 3)], i.schema)
    assert [r["kind"] for r in ranking.rank(i, "a").collect()] == ["local", "parameter", "field", "method"]
    ties = spark.createDataFrame([("x", 0, "o", 2), ("X", 0, "o", 1)], i.schema)
    assert [r["ordinal"] for r in ties.orderBy(*ranking.order()).collect()] == [1, 2]
    assert ranking.queue_head(spark.createDataFrame([("a", 1), ("b", 0), ("c", 2)], "path string, ordinal int"), 2, "b").count() == 2


def test_priorities(spark):
    d = spark.createDataFrame([(1, True), (0x401, True), (0x601, True), (None, True), (1, False)], "f int, e boolean")
    assert [r[0] for r in d.select(ranking.construction_priority("f", "e")).collect()] == [110, 90, 80, 95, 100]
    assert [r[0] for r in d.select(ranking.plain_priority("f")).collect()] == [10, 0, -10, 0, 10]


METHODS = "name string, methods array<struct<name:string,descriptor:string,access_flags:int>>"


def test_members(spark):
    s = spark.createDataFrame([("A", [("<init>", "(I)V", 1), ("size", "()I", 1), ("size", "(I)I", 1), ("hidden", "()V", 2), ("of", "()LA;", 9)]), ("B", [("<init>", "()V", 1), ("<init>", "(I)V", 1)])], METHODS)
    assert rows(s.select("name", ranking.constructor_needs_arguments("methods"))) == [("A", True), ("B", False)]
    assert rows(ranking.members(s, "", False), "member") == [("size",), ("size",)]
    assert rows(ranking.members(s, "sizes", False), "member") == [("size",), ("size",)]
    assert rows(ranking.members(s, "", True), "member") == [("of",)]
    assert rows(ranking.overloads(ranking.members(s, "", False))) == [("A", "size", ["()I", "(I)I"])]


def test_graph_diamond_and_cycle(spark):
    e = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A")], "src string, dst string")
    r = graph.descendants(e, spark.createDataFrame([("A",)], "node string"))
    assert rows(r) == [("B", 1), ("C", 1), ("D", 2)]
    assert [x["node"] for x in graph.limited(r, 2).collect()] == ["B", "C"]
    assert rows(graph.limited(r, 50, F.col("node") == "D")) == [("D", 2)]
    with pytest.raises(ValueError):
        graph.descendants(e, spark.createDataFrame([("A",)], "node string"), max_depth=1).collect()


def test_hierarchy(spark):
    k = spark.createDataFrame([("a.b.c",), ("a.b.d",), ("a.e",), ("ab.c",)], "key string")
    assert rows(graph.child_segments(k, "a")) == [("b",), ("e",)]
    assert rows(graph.child_segments(k, "")) == [("a",), ("ab",)]
    n = spark.createDataFrame([("p", "Foo"), ("p", "Foo"), ("p", "bar"), ("q", "Fx")], "parent string, name string")
    assert rows(graph.names_in(n, "p", "f")) == [("Foo",)]


CAT = "uri string, file_key string, last_modified long, length long"


def test_difference(spark):
    o = spark.createDataFrame([("a", "1", 1, 1), ("b", "2", 1, 1), ("c", "3", 1, 1), ("n", None, None, 1)], CAT)
    n = spark.createDataFrame([("a", "1", 2, 1), ("b2", "2", 1, 1), ("d", "4", 1, 1), ("n", None, None, 1)], CAT)
    assert rows(catalog.difference(o, n, file_key="file_key")) == [("changed", "a", None), ("created", "d", None), ("deleted", "c", None), ("renamed", "b2", "b")]
    assert rows(catalog.difference(o, n)) == [("changed", "a", None), ("created", "b2", None), ("created", "d", None), ("deleted", "b", None), ("deleted", "c", None)]


def test_ids(spark):
    known = spark.createDataFrame([], "file_id long, uri string, file_key string, live boolean")
    see = lambda k, *r: catalog.assign_ids(k, spark.createDataFrame(list(r), "uri string, file_key string"))
    a = see(known, ("u1", "k1"), ("u2", None))
    ids = {r["uri"]: r["file_id"] for r in a.collect()}
    b = spark.createDataFrame(see(a, ("u9", "k1"), ("u2", "k7"), ("u3", "k3")).collect(), a.schema)
    got = {r["uri"]: (r["file_id"], r["live"]) for r in b.collect()}
    assert got["u9"] == (ids["u1"], True) and got["u2"] == (ids["u2"], True) and got["u3"][0] == 3
    # a deleted file's id isn't given to another file that has its key
    c = spark.createDataFrame(see(b, ("u2", None)).collect(), a.schema)
    d = {r["uri"]: r["file_id"] for r in see(c, ("u2", None), ("new", "k1")).where("live").collect()}
    assert d["new"] == 4


def test_inputs_and_overlay(spark):
    f = lambda *r: spark.createDataFrame(list(r), "file_id long, path string")
    got = catalog.collect_inputs([f((1, "/src/a"), (2, "/build/x")), f((1, "/src/a"), (0, "/other"))], "/build")
    assert rows(got, "path") == [("/other",), ("/src/a",)]
    assert rows(catalog.collect_inputs([f()], None, f((3, "/s"))), "path") == [("/s",)]
    assert rows(catalog.snapshot(f((1, "/src/b"), (1, "/src/b"), (2, "/src2")), "/src"), "path") == [("/src/b",)]
    base = spark.createDataFrame([("/a", "old"), ("/b", "keep"), ("/c", "x")], "path string, text string")
    over = spark.createDataFrame([("/a", "new", 2), ("/a", "older", 1), ("/c", None, 1)], "path string, text string, stamp long")
    assert rows(catalog.with_overlay(base, over)) == [("/a", "new"), ("/b", "keep"), ("/c", None)]


def test_extensions(spark):
    r = Registry()
    r.register(" a ", 1)
    assert r.find("a") == 1 and r.unregister("a") == 1 and r.find("a") is None
    with pytest.raises(ValueError):
        r.register(" ", 1)
    x = Extensions()
    x.providers.register("p", lambda: spark.range(2))
    assert x.complete().count() == 2 and x.complete(ready=False) is None
    x.plugins.register("make", lambda n: n + 1)
    assert x.load_plugin("make", 1) == 2
    seen = []
    assert each(spark.range(10), lambda row: seen.append(row["id"]) or len(seen) < 3) == 3


def test_shown_and_roots(spark):
    i = spark.createDataFrame([("Ab",), ("ab",)], "lookup string")
    assert rows(paths.shown(i, "a")) == [("ab",)] and paths.shown(i, "").count() == 2
    assert rows(paths.root_rows(spark, ["/a", "/a", "/b"], "library")) == [("/a", "library"), ("/b", "library")]


def test_repeated_rows_under_roots_stay(spark):
    f = spark.createDataFrame([("/a/x", 1), ("/a/x", 1), ("/a/b/y", 2), ("/ab/z", 3), ("/c", 4), (None, 5)], "path string, n int")
    roots = spark.createDataFrame([("/a/",), ("/a/b",), ("/c",)], "root string")
    assert sorted(r["n"] for r in paths.semi_under_roots(f, "path", roots).collect()) == [1, 1, 2, 4]


@pytest.mark.parametrize("store, file", [(128, 1), (1, 1 << 24), (-1, 1), (0, 1 << 31), (1, -1)])
def test_global_ids_that_dont_fit_raise(spark, store, file):
    df = spark.createDataFrame([(store, file)], "s int, f long").select(lookup.global_id("s", "f"))
    with pytest.raises(Exception, match="no global id"):
        df.collect()


def test_global_ids(spark):
    df = spark.createDataFrame([(127, (1 << 24) - 1), (0, 5), (None, 1)], "s int, f long").select(lookup.global_id("s", "f").alias("g"))
    df = df.select("g", *lookup.local_id("g"))
    assert [tuple(r) for r in df.collect()] == [((1 << 32) - 1, 127, (1 << 24) - 1), (5, 0, 5), (None, 0, None)]


def test_scope_members_by_blocks_are_all_there(spark, monkeypatch):
    monkeypatch.setattr(paths, "_BLOCK", 3, raising=False)
    scopes = [(p, d, t, p % 5 == 0, d == 1 and p % 7 == 0) for p in range(40) for d, t in enumerate(["A", "B" if p % 2 else "A", None if p % 3 else "none"])]
    scopes += [(None, 0, "B", None, None), (1, 0, "A", False, False)]
    members = [(t, f"{t}{k % 19}", k % 4 != 0 or None, (True, False, None)[k % 3]) for t in "AB" for k in range(24)] + [("A", None, True, True), (None, "x", True, True)]
    locals_ = [(p, 0, n) for p in range(40) for n in ("this", "l")]

    def static(p, d):
        of = [s for s in scopes if s[0] == p]
        return any(s[3] for s in of if s[1] <= d) or any(s[4] for s in of if s[1] < d)

    want = [(p, d, n) for p, d, t, _, _ in scopes for u, n, a, is_static in members if t is not None and t == u and a and (is_static or not static(p, d))]
    want += [(p, d, n) for p, d, n in locals_ for q, e, *_ in scopes if (q, e) == (p, d) and not (n == "this" and static(p, d))]
    s = spark.createDataFrame(scopes, "point long, depth int, type string, static_method boolean, static_type boolean")
    m = spark.createDataFrame(members, "type string, name string, accessible boolean, static boolean")
    assert rows(paths.scope_members(s, spark.createDataFrame(locals_, "point long, depth int, name string"), m)) == sorted(want, key=repr)


def test_scope_members_are_written_in_few_bytes(spark, tmp_path):
    no, some = F.lit(False), F.pmod(F.xxhash64("id"), F.lit(25)).cast("string").alias("type")
    s = spark.range(2000).select(F.col("id").alias("point"), F.lit(0).alias("depth"), some, no.alias("static_method"), no.alias("static_type"))
    m = spark.range(30000).select(some, F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"), F.lit(True).alias("accessible"), no.alias("static"))
    paths.scope_members(s, s.select("point", "depth", F.lit("l").alias("name")), m).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2403066
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 2000000


def one_type(spark, points, members):
    """scope_members of points that all have one type of so many members, and one local each."""
    no, one = F.lit(False), F.lit("A").alias("type")
    s = spark.range(points).select(F.col("id").alias("point"), F.lit(0).alias("depth"), one, no.alias("static_method"), no.alias("static_type"))
    m = spark.range(members).select(one, F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"), F.lit(True).alias("accessible"), no.alias("static"))
    return paths.scope_members(s, s.select("point", "depth", F.lit("l").alias("name")), m)


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_scope_members_of_one_type_are_made_by_many_tasks(spark, broadcast):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        counts = [n for _, n in rows(one_type(spark, 8000, 90).where("name <> 'l'").groupBy(F.spark_partition_id()).count())]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert sum(counts) == 8000 * 90 and max(counts) < sum(counts) / 2


def test_scope_members_are_not_held_whole_by_executors(spark):
    plan = one_type(spark, 8000, 90)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [point" in plan and "SortMergeJoin [_kind" in plan
    assert "BroadcastHashJoin [point" not in plan and "BroadcastHashJoin [_kind" not in plan
    lines = plan.split("\n")
    depths = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for k in [k for k, x in enumerate(lines) if "BroadcastExchange" in x]:
        end = next((j for j in range(k + 1, len(lines)) if depths[j] <= depths[k]), len(lines))
        assert not [x for x in lines[k:end] if "Window" in x or "AS name" in x]


def test_scope_members_meet_in_cells_of_any_size(spark, monkeypatch):
    for name, value in {"_POINTS": 5, "_MEMBERS": 4, "_PARTS": 3, "_FEW": 2, "_BLOCK_POINTS": 2, "_BLOCK_MEMBERS": 3}.items():
        monkeypatch.setattr(paths, name, value, raising=False)
    for points, members in ((1, 1), (1, 30), (23, 1), (23, 30)):
        want = [(p, 0, n) for p in range(points) for n in ["l", *(f"s{k}" for k in range(members))]]
        assert rows(one_type(spark, points, members)) == sorted(want, key=repr)
