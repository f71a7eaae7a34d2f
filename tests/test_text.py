from pyspark.sql import functions as F
from hypothesis import given, strategies as st

from tessera.functions import text as t


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).first()["x"]


def test_identifiers(spark):
    s = "import java.util.Li"
    assert one(spark, t.partial_identifier("s", F.lit(19)), s=s) == "Li"
    assert one(spark, t.qualified_identifier("s", F.lit(19)), s=s) == "java.util.Li"
    assert one(spark, t.chain_start("s", F.lit(19)), s=s) == 7
    assert one(spark, t.partial_identifier("s", F.lit(0)), s=s) == ""


def test_names_and_paths(spark):
    assert one(spark, t.display_name("s"), s="a/b/C$D") == "a.b.C.D"
    assert one(spark, t.simple_name("s"), s="a/b/C$D") == "D"
    assert one(spark, t.first_segment("s"), s="a.b") == "a"
    assert one(spark, t.trim_trailing_dot("s"), s="a.b.") == "a.b"
    for p, ok in (("/src", True), ("/src/a", True), ("/src2/a", False)):
        assert one(spark, t.in_or_under("p", "/src"), p=p) is ok
        assert one(spark, t.in_or_under("p", "/src/"), p=p) is ok
    assert one(spark, t.in_or_under("p", "/"), p="/x") is True
    assert one(spark, t.relative_path("p", "/src"), p="/src/a/b") == "a/b"
    assert one(spark, t.relative_path("p", "/src"), p="/src2/a") is None
    assert one(spark, t.normalize_uri("u"), u="HTTP://Host.X/a//b/./c#f") == "http://host.x/a/b/c"
    assert one(spark, t.root_prefix("u"), u="file:///a/b") == "file:///a/b/"
    got = {r[0]: r[1] for r in spark.createDataFrame([("a/./b/../c",), ("./x\\y",), ("/abs/../x",), (" ",)], "p string").select("p", t.resolve_path("p")).collect()}
    assert got == {"a/./b/../c": "a/c", "./x\\y": "x/y", "/abs/../x": "/abs/../x", " ": None}


def test_options(spark):
    m = F.create_map(F.lit("b"), F.lit("TRUE"), F.lit("n"), F.lit("x"), F.lit("k"), F.lit(" 7 "))
    d = spark.range(1).select(m.alias("o"))
    r = d.select(t.option_bool("o", "b"), t.option_bool("o", "none", True), t.option_int("o", "n", 3), t.option_int("o", "k", 3), t.option_long("o", "none", 9)).first()
    assert tuple(r) == (True, True, 3, 7, 9)
    other = spark.range(1).select(F.create_map(F.lit("k"), F.lit(" 7 "), F.lit("n"), F.lit("x"), F.lit("b"), F.lit("TRUE")).alias("o"))
    assert d.select(t.options_hash("o")).first() == other.select(t.options_hash("o")).first()
    assert [one(spark, t.truthy("v"), v=v) for v in ("Yes", " on ", "no", None)] == [True, True, False, False]


def test_ranges(spark):
    f = lambda s, e, p, n: tuple(one(spark, t.clamp_range("s", "e", "p", "n"), s=s, e=e, p=p, n=n))
    assert f(2, 4, 3, 10) == (2, 4)
    assert f(-1, 4, 3, 10) == (3, 4)
    assert f(5, 5, 5, 10) == (5, 6)
    assert f(20, 30, 0, 10) == (10, 10)
    assert f(-1, -1, -1, 10) == (0, 1)


def test_levels(spark):
    names = ["Blue", "Bluebird", "blue", "bluebird", "Blux", "zzz"]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in d.select(t.match_level("n", "Blue")).collect()] == [5, 3, 4, 2, 1, 0]


def test_packages():
    assert t.package_name("/* c */ // x\n package a . b /* y */ .c;class X{}") == "a.b.c"
    assert t.package_name("class X {}") == ""
    assert t.package_name("packages.x;") == ""
    assert t.package_name(None) == ""
    assert t.package_name("package a.b") == "a.b"


def _lcs(a, b):
    return 0 if not a or not b else 1 + _lcs(a[1:], b[1:]) if a[0] == b[0] else max(_lcs(a[1:], b), _lcs(a, b[1:]))


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_ratio_is_common_subsequence(a, b):
    want = 100 if not a + b else int(200 * _lcs(a, b) / len(a + b) + 0.5)
    assert t.ratio(a, b) == want == t.ratio(b, a)


def test_partial_measures():
    assert t.partial_ratio("get", "forget me") == 100
    assert t.token_set_partial_ratio("size of list", "list size") == 100
    assert t.token_set_partial_ratio("abc", "xyz") == 0


def test_pop_up(spark):
    d = spark.createDataFrame([(".", "x.", 2), (" ", "new ", 4), (" ", "renew ", 6), (" ", "= new ", 6), ("ab", "ab", 2), (" ", "kne ", 4)], "i string, t string, c int")
    assert [r[0] for r in d.select(t.pop_up_trigger("i", "t", "c")).collect()] == [True, True, False, True, False, False]


def test_common_subsequences_against_the_table():
    import random

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abcé") for _ in range(r.randrange(90))) for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert t._common_subsequence(a, b) == row[-1]


def test_patched_text():
    p = t.patch_incomplete
    assert p("a.b.\n c.}  x::; y. ; \"s.\" // t.\n 1.5 f(a.); ") == "a.b.anyName;\n c.anyName;}  x::anyName; y.anyName ; \"s.\" // t.\n 1.5 f(a.anyName); "
    assert p("a..b") == "a.anyName.b" and p("int... x; List.<T>of(); a.*") == "int... x; List.<T>of(); a.*"
    assert p("x = new  ", 8) == "x = new anyName() " and p("renew ", 6) == "renew " and p("new", 99) == "newanyName()"
    assert p(None) is None and p("") == "" and p("a.", dummy="z") == "a.z"
