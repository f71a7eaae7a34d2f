import os
import struct
from pathlib import Path

import pyspark
import pytest

from tessera.operators import graph, index
from tessera.sources import files as sources, jvm


def make(name, sup, interfaces=(), flags=0x21, fields=(), methods=(), source=None, signature=None):
    """A class file's bytes, written by the specification."""
    pool = []

    def text(s):
        pool.append(b"\x01" + struct.pack(">H", len(s.encode())) + s.encode())
        return len(pool)

    def cls(s):
        k = text(s)
        pool.append(b"\x07" + struct.pack(">H", k))
        return len(pool)

    pool.append(b"\x05" + b"\0" * 8)  # a long takes two places
    pool.append(b"")
    this, up, ifs = cls(name), cls(sup) if sup else 0, [cls(i) for i in interfaces]
    members = b""
    for group in (fields, methods):
        members += struct.pack(">H", len(group))
        for n, d, f in group:
            members += struct.pack(">HHHH", f, text(n), text(d), 0)
    attrs = [(text(k), text(v)) for k, v in (("SourceFile", source), ("Signature", signature)) if v]
    tail = struct.pack(">H", len(attrs)) + b"".join(struct.pack(">HIH", k, 2, v) for k, v in attrs)
    head = struct.pack(">IHHH", 0xCAFEBABE, 0, 61, len(pool) + 1) + b"".join(pool)
    return head + struct.pack(">HHHH", flags, this, up, len(ifs)) + b"".join(struct.pack(">H", i) for i in ifs) + members + tail


def test_parse():
    c = jvm.parse_class(make("a/B", "java/lang/Object", ["a/I"], 0x401, [("f", "I", 2)], [("<init>", "()V", 1), ("m", "(ILa/B;)V", 9)], "B.java", "<T:>La/B;"))
    assert (c.name, c.super_name, c.interfaces, c.flags, c.source_file, c.signature) == ("a/B", "java/lang/Object", ["a/I"], 0x401, "B.java", "<T:>La/B;")
    assert c.fields == [{"name": "f", "descriptor": "I", "signature": None, "access_flags": 2}] and [m["name"] for m in c.methods] == ["<init>", "m"]
    with pytest.raises(ValueError):
        jvm.parse_class(b"\0" * 20)
    assert jvm.parse_descriptor("(I[La/B;J)V") == (["int", "a.B[]", "long"], "void") and jvm.parse_descriptor("[[D") == ([], "double[][]")


def test_sources():
    text = 'package p; /* class No {} */ public class A { String s = "class X {}"; public static class In { class Deep {} } class Hid { public class Q {} } void m() { class Local {} } }\ninterface B {}\npublic @interface C {}'
    assert jvm.declared_types(text) == [("A", True), ("A.In", True), ("A.In.Deep", False), ("A.Hid", False), ("A.Hid.Q", False), ("B", False), ("C", True)]


def test_definitions(spark):
    rows = [
        (1, "/p/A.class", "A.class", "class", make("p/A", "java/lang/Object", ["p/I"])),
        (2, "/p/A$1.class", "A$1.class", "class", make("p/A$1", "p/A")),
        (3, "/p/A$In.class", "A$In.class", "class", make("p/A$In", "p/A", flags=0x20)),
        (4, "/p/S.java", "S.java", "java", b"package p; public class S { public class T {} class U {} }"),
        (5, "/p/bad.class", "bad.class", "class", b"nope"),
        (6, "/p/C.class", "C.class", "class", make("p/C", "p/A$In")),
    ]
    f = spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in rows], "file_id long, path string, name string, ext string, content binary")
    defs = jvm.definitions()
    e = index.run_all(f, defs).persist()
    got = lambda i: sorted((r["key"], r["value"]) for r in e.where(f"index_id = '{i}'").collect())
    assert got("short_names") == [("A", "p.A"), ("C", "p.C"), ("S", "p.S"), ("T", "p.S.T")]
    assert [k for k, _ in got("full_names")] == ["p.A", "p.A.In", "p.C", "p.S", "p.S.T", "p.S.U"]
    assert sorted(v for _, v in got("packages")) == ['{"kind": "CLASS", "simple_name": "A"}', '{"kind": "CLASS", "simple_name": "C"}', '{"kind": "SOURCE", "simple_name": "S"}']
    assert {r["name"] for r in jvm.stub_rows(e).collect()} == {"p/A", "p/A$1", "p/C"}
    down = graph.descendants(jvm.edges(e), spark.createDataFrame([("p/A",)], "node string"))
    assert sorted(map(tuple, down.collect())) == [("p/A$1", 1), ("p/A$In", 1), ("p/C", 2)]
    assert [r["file_id"] for r in index.errors_of(defs[0], f).collect()] == [5]


def test_real_archive(spark):
    jars = sorted((Path(pyspark.__file__).parent / "jars").glob("jakarta.inject*.jar")) or sorted((Path(pyspark.__file__).parent / "jars").glob("*.jar"), key=os.path.getsize)[:1]
    f = sources.scan_archives(spark, str(jars[0])).where("ext = 'class'").selectExpr("xxhash64(path) AS file_id", "path", "name", "ext", "content")
    n = f.count()
    e = index.run_all(f, jvm.definitions()[1:2])
    assert n and e.count() <= n and index.errors_of(jvm.definitions()[1], f).count() == 0


def test_signatures():
    s = jvm.parse_signature("<T:Ljava/lang/Object;K::Ljava/lang/Comparable<-TK;>;>(Ljava/util/Map<TK;+Ljava/util/List<*>;>;[[TT;)TT;^Ljava/io/IOException;^TE;")
    assert list(map(str, s.parameters)) == ["java.util.Map<K, ? extends java.util.List<?>>", "T[][]"] and str(s.result) == "T" and s.result.variable
    assert [str(x) for x in s.throws] == ["java.io.IOException", "E"]
    assert [(n, list(map(str, b))) for n, b in s.variables] == [("T", ["java.lang.Object"]), ("K", ["java.lang.Comparable<? super K>"])]
    assert str(jvm.parse_signature("[Lp/A<Ljava/lang/String;>.B<TX;>.C;").result) == "p.A<java.lang.String>.B<X>.C[]"
    assert [str(x) for x in jvm.parse_signature("Ljava/lang/Object;Ljava/util/List<TT;>;", True).supers] == ["java.lang.Object", "java.util.List<T>"]
    assert jvm.parse_signature("(I[J)V").parameters == (jvm.Type("int"), jvm.Type("long", dims=1))
    for bad in ("", "L", "(I", "Q", "Ljava", "II", "(I)", "<T>V"):
        with pytest.raises(ValueError):
            jvm.parse_signature(bad)
